"""Token counts by byte-pair merging with a heap of adjacent pairs over a linked list of symbols.

No ids are made: a piece of n bytes after m merges has n - m tokens. Texts are cut into the pieces of
the vocabulary's split pattern; a worker counts each distinct piece once.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Pieces, arrow_map, own_memory, small_batches, table, text_or_empty

_counters: dict[str, "TokenCounter"] = {}


def counter(path: str) -> "TokenCounter":
    """The worker's counter for a vocabulary file."""
    own_memory("token_counts", _counters.clear)
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabulary files: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left when the lowest-ranked adjacent pair, leftmost first, is merged until none has a rank."""
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapify(heap)
    left = n
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = a + b, ""
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((a + b, symbols[k]))) is not None:
                heappush(heap, (r, i, a + b, symbols[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get((symbols[h], a + b))) is not None:
            heappush(heap, (r, h, symbols[h], a + b))
    return left


class TokenCounter:
    """Callable: text to its number of tokens, for a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.letters = byte_letters()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(sorted(special, key=len, reverse=True))) if special else None
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.pieces = Pieces(self._piece, 800_000)
        self.chunks = Pieces(self._chunk, 400_000)

    def _piece(self, piece: str) -> int:
        letters = self.letters
        return merge_count([letters[b] for b in piece.encode("utf-8")], self.ranks)

    def _chunk(self, chunk: str) -> int | None:
        """Tokens of a blank and a chunk that stand between two blanks; None where a piece could reach over them."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return None
        if chunk.isalpha():
            return self.pieces[" " + chunk]
        if chunk[-1] in ".," and chunk[:-1].isalpha():
            return self.pieces[" " + chunk[:-1]] + self.pieces[chunk[-1]]
        return self._whole(" " + chunk)

    def _whole(self, text: str) -> int:
        pieces = self.pieces
        return sum([pieces[x] for x in self.pattern.findall(text)])

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        if any(m in text for m in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self(x) for x in parts)
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self._whole(text)
        chunks = self.chunks
        counts = [chunks[x] for x in rest]
        if None in counts:
            return self._whole(text)
        return self._whole(first) + sum(counts)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text).

    Counts are those of the tokenizers library without added special tokens; the strings of special
    tokens inside a text count as one token, its default. Null text counts as empty (0 tokens). Repeated
    rows and null doc_id are passed through row by row; other columns are ignored. There is no shuffle.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")

    def make():
        count = counter(path)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = [count(x) for x in batch.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

        return each

    out = arrow_map(rows, make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents; null texts are empty, repeated rows and null ids give a row each, an empty table gives none."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
