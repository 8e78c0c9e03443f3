"""Byte-level encoding and decoding as a monoid over a text's bytes.

A piece is encoded by halves. Two encoded neighbours are joined by encoding a window around the seam
anew, growing the window until the tokens outside it are provably those of the whole: a row of tokens is
the encoding of its bytes exactly if each adjacent pair is the encoding of the pair's bytes, for a merge
that crossed a seam would have to be the lowest-ranked one within the two tokens at the seam, too.
Decoding concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Pieces, arrow_map, own_memory, small_batches, table, text_or_empty

#: Bytes that are encoded by merging alone; longer runs are halved.
LEAF = 24

_codecs: dict[str, "TreeCodec"] = {}


def codec(path: str) -> "TreeCodec":
    """The worker's codec for a rank file."""
    own_memory("bpe_tree", _codecs.clear)
    if path not in _codecs:
        _codecs[path] = TreeCodec(path)
    return _codecs[path]


class TreeCodec:
    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {b: a for a, b in self.ranks.items()}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.pieces = Pieces(self._piece, 600_000)
        self.chunks = Pieces(self._chunk, 300_000)
        self.seams: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """Merge the lowest-ranked pair, leftmost first, until none has a rank."""
        if len(data) > 64:
            return self._merged_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        pairs = [ranks.get(data[i : i + 2]) for i in range(len(parts) - 1)]
        while True:
            low = min((r for r in pairs if r is not None), default=None)
            if low is None:
                return parts
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1])
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i])

    def _merged_long(self, data: bytes) -> list[bytes]:
        """The same for a long window, with a heap of pairs in place of a scan for each merge."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # where the token that starts here ends; 0: none starts here
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, j, k = heappop(heap)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j] = k, 0
            if k < n:
                before[k] = i
                if (r := ranks.get(data[i : end[k]])) is not None:
                    heappush(heap, (r, i, k, end[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(data[h:k])) is not None:
                heappush(heap, (r, h, i, k))
        out, i = [], 0
        while i < n:
            out.append(data[i : end[i]])
            i = end[i]
        return out

    def stable(self, a: bytes, b: bytes) -> bool:
        """Whether the two tokens stay as they are when they stand side by side."""
        key = (a, b)
        if (known := self.seams.get(key)) is None:
            if len(self.seams) > 200_000:
                self.seams.clear()
            known = self.seams[key] = self.merged(a + b) == [a, b]
        return known

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            middle = self.merged(b"".join(left[i:] + right[:j]))
            if (i == 0 or self.stable(left[i - 1], middle[0])) and (j == len(right) or self.stable(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            k *= 2

    def encoded(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.encoded(data[:half]), self.encoded(data[half:]))

    def decoded(self, ids: list[int]) -> bytes:
        if len(ids) <= 64:
            return b"".join([self.bytes_of[i] for i in ids])
        half = len(ids) // 2
        return self.decoded(ids[:half]) + self.decoded(ids[half:])

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        return [self.ranks[t] for t in self.encoded(data)]

    def _node(self, pieces: list[str]) -> tuple[int, bytes, bytes]:
        """Value of a run of pieces: tokens, their decimal ids each with a comma, decoded bytes."""
        ids = [i for x in pieces for i in self.pieces[x]]
        return len(ids), b"".join([b"%d," % i for i in ids]), self.decoded(ids)

    def _chunk(self, chunk: str) -> tuple[int, bytes, bytes] | None:
        """Value of a blank and a chunk that stand between two blanks; None where a piece could reach over them."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        if chunk.isalpha():
            return self._node([" " + chunk])
        if chunk[-1] in ".," and chunk[:-1].isalpha():
            return self._node([" " + chunk[:-1], chunk[-1]])
        return self._node(self.pattern.findall(" " + chunk))

    def ids(self, text: str) -> list[int]:
        return [i for x in self.pattern.findall(text) for i in self.pieces[x]]

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """Tokens, digest of the decimal ids, digest of the bytes that those ids decode to."""
        nodes = None
        if text and text[0] != " ":
            first, *rest = text.split(" ")
            if not first[-1].isspace():
                chunks = self.chunks
                nodes = [self._node(self.pattern.findall(first)), *[chunks[x] for x in rest]]
        if nodes is None or None in nodes:
            nodes = [self._node(self.pattern.findall(text))]
        n, ids, data = zip(*nodes)
        return sum(n), hashlib.sha256(b"".join(ids)[:-1]).hexdigest(), hashlib.sha256(b"".join(data)).hexdigest()


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs (doc_id, text).

    Ids are those of the tiktoken library for the rank file, without special tokens. Null text counts as
    empty: 0 tokens and the digests of the empty string. Rows are independent of each other, so repeated
    rows and null doc_id pass through; other columns are ignored. There is no shuffle.
    """
    small_batches(docs.sparkSession)

    def make():
        own = codec(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, data = zip(*[own.round_trip(x) for x in batch.column(1).to_pylist()])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(data)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", text_or_empty().alias("text")), make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids array<int> for every row; null text gives an empty array."""
    small_batches(docs.sparkSession)

    def make():
        own = codec(path)
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([own.ids(x) for x in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(docs.select("doc_id", text_or_empty().alias("text")), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded bytes of rows (doc_id, ids); null ids give null."""
    small_batches(rows.sparkSession)

    def make():
        own = codec(path)
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else own.decoded(x) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return arrow_map(rows.select("doc_id", "ids"), make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, data binary")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of documents and what they decode to; null texts are empty, an empty table gives no rows."""
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
