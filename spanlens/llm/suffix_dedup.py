"""Removal of long repeated byte strings: suffix sorting bucket by bucket with difference covers.

Documents are strings of bytes; a position repeats if the LENGTH bytes from it also start elsewhere.

1. Cover sample. Positions whose offset modulo PERIOD lies in a perfect difference set are the sample: any
   two suffixes have a common shift below PERIOD that brings both into it, so two equal strings of LENGTH
   bytes hold an equal sampled window of WINDOW = LENGTH - PERIOD + 1 bytes at the same place. A suffix with
   only unique samples among its first PERIOD positions has no equal and goes no further.
2. Suffix buckets. The bucket of a suffix follows from the least hash among the WINDOW-byte strings inside its
   LENGTH bytes, so equal strings share a bucket, and neighbouring suffixes mostly do, too: they travel
   as one segment of text, some four bytes a suffix. Of equal segments a task sends one.
3. Blockwise sort. A bucket holds the text of its segments, a few MB whatever the input. A denser cover's sample in
   it is ranked first, by whole windows; then suffixes are sorted a block of leading bytes at a time. Suffixes
   that tie have their common shift's ranks compared and the few bytes in front of and behind that window,
   which settles all LENGTH bytes exactly. Suffixes with an equal repeat.

Fingerprints only bring candidates together: a chance match of two cannot remove a byte, as ties are settled on
the bytes, and a miss would need a third string's match between two equal ones. Segments and whole texts are
told apart by 128 and 256 bits. Texts with an exact copy are wholly repeated; the first of them stands for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, own_memory, small_batches, table, text_or_empty
from .lsh_forest import mixed

LENGTH = 400
#: Perfect difference sets: each residue but 0 is the difference of exactly one pair. The first is for all documents, the second for the text of a bucket.
PERIOD, COVER = 273, (0, 1, 3, 7, 15, 31, 63, 90, 116, 127, 136, 181, 194, 204, 233, 238, 255)
DENSE_PERIOD, DENSE_COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
#: Bytes of documents in a batch, a longer one being a batch of its own; bytes of documents for each bucket of samples; bytes of segments in a bucket, on average.
BATCH_BYTES, SAMPLE_BYTES, BUCKET_BYTES = 1_000_000, 32_000_000, 1_000_000
#: Suffixes of a block, and starts of a segment at most.
BLOCK, LONGEST = 1 << 18, 4096

_BYTES = [mixed(np.arange(256, dtype=np.uint64) + np.uint64(k)) for k in (1 << 20, 1 << 21)]
_BASE = [0x9E3779B97F4A7C15 | 5, 0xD1342543DE82EF95]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0.. and B^-0.., modulo 2^64."""
    if which not in _powers or len(_powers[which][0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        both = []
        for base in (_BASE[which], pow(_BASE[which], -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _powers[which] = tuple(both)
    return tuple(x[:n] for x in _powers[which])


class Strings:
    """Documents of a batch laid end to end, with prefix sums from which the fingerprint of any window follows."""

    def __init__(self, docs: list[bytes]):
        own_memory("suffixes", _powers.clear)
        self.lens = np.array([len(d) for d in docs], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lens)))
        self.data = np.frombuffer(b"".join(docs), np.uint8)
        self.sums: dict[int, np.ndarray] = {}

    def prints(self, at: np.ndarray, width: int | np.ndarray, which: int = 0) -> np.ndarray:
        n = len(self.data)
        up, down = powers(which, n + 1)
        if which not in self.sums:
            p = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[which][self.data] * up[:n], out=p[1:])
            self.sums[which] = p
        p = self.sums[which]
        return mixed((p[at + width] - p[at]) * down[at])

    def sample(self, length: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
        """Positions of the cover sample whose window lies in its document, of documents that have `length` bytes."""
        parts = []
        for start, n in zip(self.starts, self.lens):
            if n >= length:
                room = n - (length - period + 1) + 1
                grid = (np.arange(0, room, period)[:, None] + np.array(cover)).ravel()
                parts.append(grid[grid < room] + start)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def buckets_of(values: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its distinct values)"""
    order = np.argsort(bucket, kind="stable")
    numbers, first = np.unique(bucket[order], return_index=True)
    for k, i, j in zip(numbers, first, [*first[1:], len(order)]):
        yield int(k), np.unique(values[order[i:j]])


SENT = "bucket long, owners binary, counts binary, data binary"
REPLY = "batch long, bucket long, data binary, uid long, first boolean"
#: Fingerprints and bytes of segments that a task holds before it sends them.
HELD, HELD_BYTES = 2_000_000, 16_000_000


def sent(found: Iterable[tuple[int, Iterable[tuple[int, np.ndarray]]]]) -> Iterator[pa.RecordBatch]:
    """Rows for the buckets from (batch, its (bucket, values)): a bucket gets one row for all batches of a task, so rows grow
    with tasks and not with batches."""
    held: dict[int, list[tuple[int, np.ndarray]]] = {}
    total = 0

    def out() -> pa.RecordBatch:
        rows = [(k, np.array([b for b, _ in v], "<i8").tobytes(), np.array([len(x) for _, x in v], "<i8").tobytes(), np.concatenate([x for _, x in v]).astype("<u8").tobytes()) for k, v in held.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)]], ["bucket", "owners", "counts", "data"])

    for batch_id, values in found:
        for k, v in values:
            held.setdefault(k, []).append((batch_id, v))
            total += len(v)
        if total > HELD:
            yield out()
            held.clear()
            total = 0
    if held:
        yield out()


def shared(group: pa.Table) -> pa.Table:
    """Of one bucket of samples: for each batch the values that another batch has sent too."""
    joined = lambda c: b"".join(group[c].to_pylist())
    values = np.frombuffer(joined("data"), "<u8")
    owner = np.repeat(np.frombuffer(joined("owners"), "<i8"), np.frombuffer(joined("counts"), "<i8"))
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    # A batch that goes over in several runs may send a value in each.
    once = np.ones(len(values), bool)
    once[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[once], owner[once]
    new = np.ones(len(values) + 1, bool)
    new[1:-1] = values[1:] != values[:-1]
    common = ~(new[:-1] & new[1:])
    values, owner = values[common], owner[common]
    order = np.argsort(owner, kind="stable")
    values, owner = values[order], owner[order]
    batches, edges = np.unique(owner, return_index=True)
    rows = [(b, values[i:j].tobytes()) for b, i, j in zip(batches, edges, [*edges[1:], len(owner)])]
    n = len(rows)
    bucket = group["bucket"][0].as_py() if len(group) else 0
    return pa.table({"batch": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([bucket] * n, pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary()), "uid": pa.nulls(n, pa.int64()), "first": pa.nulls(n, pa.bool_())})


def by_batch(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows of one batch (column 0); a batch may come in several where Arrow cuts it."""
    ids = batch.column(0).to_numpy()
    edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)]
    for i, j in zip(edges, edges[1:]):
        if i < j:
            yield int(ids[i]), batch.slice(i, j - i)


def runs(flags: np.ndarray) -> np.ndarray:
    """(start, end) of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)


def covered(pairs: np.ndarray, n: int) -> np.ndarray:
    """Flags of n positions, true inside any of the (start, end) pairs."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 1], -1)
    return np.cumsum(edge)[:n] > 0


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values: of a block's tail and the next block's head."""
    n = len(x) - width + 1
    whole = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    whole[: len(x)] = x
    head = np.minimum.accumulate(whole.reshape(-1, width), axis=1).ravel()
    tail = np.minimum.accumulate(whole.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


class Segments:
    """The segments of a batch: runs of starts that may repeat and share the least hash of a window. at and n: first start and number
    of starts; key: that hash; one, two: fingerprints of the whole segment's bytes."""

    def __init__(self, s: Strings, starts: list[bytes], length: int, period: int):
        pairs = [np.frombuffer(x, "<i8").reshape(-1, 2) + o for x, o in zip(starts, s.starts)]
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        at, sizes, keys = [], [], []
        for a, b in pairs:  # each run with the windows it needs
            least = sliding_least(s.prints(np.arange(a, b + period - 1), length - period + 1), period)
            new = np.flatnonzero(least[1:] != least[:-1]) + 1
            edges = np.unique(np.concatenate(([0], new, np.arange(0, b - a, LONGEST)))) if len(new) or b - a > LONGEST else np.zeros(1, np.int64)
            at.append(edges + a)
            sizes.append(np.diff(np.append(edges, b - a)))
            keys.append(least[edges])
        empty = [np.zeros(0, np.int64)]
        self.at, self.n, self.key = np.concatenate(at or empty), np.concatenate(sizes or empty), np.concatenate(keys or [np.zeros(0, np.uint64)])
        width = self.n + length - 1
        self.one, self.two = (s.prints(self.at, width, k) + mixed(width.astype(np.uint64)) for k in (0, 1))
        self.s, self.width = s, width


SEGMENT = "bucket long, batch long, one long, two long, several boolean, data binary"


def cut_segments(batches: Iterable[pa.RecordBatch], length: int, period: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """From rows (batch, b, starts): a row with text for each distinct segment of the task, telling whether it occurs several
    times, and a row without for each batch and distinct segment of it."""
    held: dict[tuple[int, int], list] = {}
    size = 0

    def out() -> pa.RecordBatch:
        rows = [(bucket, None, *k, several, data) for k, (bucket, several, data) in held.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    names = ["bucket", "batch", "one", "two", "several", "data"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    for whole in batches:
        for batch_id, rows in by_batch(whole):
            seg = Segments(Strings(rows.column(1).to_pylist()), rows.column(2).to_pylist(), length, period)
            if not len(seg.at):
                continue
            order = np.lexsort((seg.two, seg.one))
            one, two = seg.one[order], seg.two[order]
            first = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
            count = np.diff(np.append(np.flatnonzero(first), len(order)))
            ks = order[first]
            one, two, bucket = seg.one[ks].view(np.int64), seg.two[ks].view(np.int64), (seg.key[ks] % np.uint64(n_buckets)).astype(np.int64)
            n = len(ks)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array([batch_id] * n, pa.int64()), pa.array(one), pa.array(two), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary())], names)
            data = seg.s.data
            for k, a, b, q, c in zip(ks.tolist(), one.tolist(), two.tolist(), bucket.tolist(), count.tolist()):
                if (known := held.get((a, b))) is not None:
                    known[1] = True
                else:
                    o = int(seg.at[k])
                    held[a, b] = [q, c > 1, data[o : o + int(seg.width[k])].tobytes()]
                    size += int(seg.width[k])
            if size > HELD_BYTES:
                yield out()
                held.clear()
                size = 0
    if held:
        yield out()


class Bucket:
    """Distinct segments laid end to end, with 8-byte words at every position and the ranks of the dense cover's windows."""

    def __init__(self, segments: list[bytes], length: int, period: int = DENSE_PERIOD, cover: tuple[int, ...] = DENSE_COVER):
        self.s, self.length, self.period = Strings(segments), length, period
        n = len(self.s.data)
        padded = np.append(self.s.data, np.zeros(7, np.uint8))
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8").ravel().astype(np.uint64) if n else np.zeros(0, np.uint64)
        inside = np.isin(np.arange(period), cover)
        self.window = length - period + 1
        room = np.stack((self.s.starts[:-1], np.maximum(self.s.starts[1:] - self.window + 1, self.s.starts[:-1])), 1)
        at = np.flatnonzero(covered(room, n) & inside[np.arange(n) % period])
        prints = self.s.prints(at, self.window)
        order = np.argsort(prints, kind="stable")
        at, prints = at[order], prints[order]
        new = prints[1:] != prints[:-1]
        tied = np.flatnonzero(~new)
        new[tied] = ~self.equal(at[tied], at[tied + 1], range(0, self.window, 8), self.window)
        self.rank = np.full(n, -1, np.int32)
        if len(at):
            self.rank[at] = np.cumsum(np.append(0, new))
        phase = np.arange(period)
        #: The first shift that brings two phases into the cover.
        self.shift = np.array([[next(d for d in range(period) if inside[(f + d) % period] and inside[(g + d) % period]) for g in phase] for f in phase], np.int64)

    def equal(self, a: np.ndarray, b: np.ndarray, offsets: Iterable[int], end: int) -> np.ndarray:
        """Whether the words at the offsets, moved so that they end by `end`, are equal."""
        out = np.ones(len(a), bool)
        for k in offsets:
            k = min(k, end - 8)
            out &= self.words[a + k] == self.words[b + k]
        return out

    def tie(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two suffixes have equal first `length` bytes: by the window at their common shift and the bytes around it."""
        d = self.shift[a % self.period, b % self.period]
        out = self.rank[a + d] == self.rank[b + d]
        out &= self.equal(a, b, range(0, self.period - 1, 8), self.length)
        return out & self.equal(a, b, range(self.window, self.length, 8), self.length)

    def repeated(self) -> np.ndarray:
        """Flags of all positions: starts whose string starts elsewhere in the bucket, too."""
        s, mark = self.s, np.zeros(len(self.s.data), bool)
        room = np.stack((s.starts[:-1], np.maximum(s.starts[1:] - self.length + 1, s.starts[:-1])), 1)
        starts = np.flatnonzero(covered(room, len(s.data)))
        lead = s.data[starts]
        share = np.cumsum(np.bincount(lead, minlength=256)) // BLOCK
        for block in np.unique(share):
            p = starts[share[lead] == block]
            order = np.lexsort((s.prints(p, self.length), self.words[p]))
            p = p[order]
            prints = s.prints(p, self.length)
            ties = np.flatnonzero(prints[1:] == prints[:-1])
            same = self.tie(p[ties], p[ties + 1])
            mark[p[ties[same]]] = mark[p[ties[same] + 1]] = True
        return mark


FOUND = "one long, two long, runs binary"


def sort_bucket(group: pa.Table, length: int) -> pa.Table:
    """Of one bucket: for each segment with repeated starts their runs, counted from the segment's first start."""
    group = group.group_by(["one", "two"]).aggregate([("several", "max"), ("several", "count"), ("data", "min")])
    segments = group["data_min"].to_pylist()
    several = pc.or_(group["several_max"], pc.greater(group["several_count"], 1)).to_numpy(zero_copy_only=False)
    bucket = Bucket(segments, length)
    mark, out = bucket.repeated(), []
    for k, (o, x) in enumerate(zip(bucket.s.starts, segments)):
        n = len(x) - length + 1
        out.append((np.array([[0, n]]) if several[k] else runs(mark[o : o + n])).astype("<i4").tobytes())
    return pa.table({"one": group["one"], "two": group["two"], "runs": pa.array(out, pa.binary())}).filter(pa.array([len(x) > 0 for x in out], pa.bool_()))


def numbered(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """uid, batch, n (bytes), sha, doc_id, b: documents in batches of at most batch_bytes, a longer one alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, row, k, held = TaskContext.get().partitionId() << 33, 0, 0, 0
        for batch in batches:
            own = []
            for n in batch.column(0).to_pylist():
                if held and held + n > batch_bytes:
                    k, held = k + 1, 0
                held += n
                own.append(base + k)
            uid = np.arange(base + row, base + row + len(own))
            row += len(own)
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(own, pa.int64()), *batch.columns], ["uid", "batch", "n", "sha", "doc_id", "b"])

    rows = docs.select("doc_id", F.encode(text_or_empty(), "utf-8").alias("b")).select(F.length("b").cast("long").alias("n"), F.unhex(F.sha2("b", 256)).alias("sha"), "doc_id", "b")
    return rows.mapInArrow(run, f"uid long, batch long, n long, sha binary, doc_id {docs.schema['doc_id'].dataType.simpleString()}, b binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed, kept for every row of docs (doc_id, text).

    removed lists the removed runs of bytes (start, end exclusive), kept is what is left of the text as bytes (a cut may
    fall inside a character), null where nothing was removed. Null text counts as empty. Rows that repeat a doc_id
    are separate documents; null doc_id passes through; other columns are ignored; an empty table gives an
    empty result. docs is read once and numbered in a written table. A task holds a batch or a bucket of texts at
    some 60 bytes a byte: what a document of over batch_bytes needs grows with its length.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "suffixes")
    window = length - period + 1
    base = scratch.write(numbered(docs, batch_bytes))
    total = base.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_samples = max(1, -(-total // SAMPLE_BYTES))

    def sample_of(texts: list[bytes]) -> tuple[Strings, np.ndarray, np.ndarray]:
        s = Strings(texts)
        at = s.sample(length, period, cover)
        return s, at, s.prints(at, window) if len(at) else np.zeros(0, np.uint64)

    def send_samples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for whole in batches:
                for batch_id, rows in by_batch(whole):
                    _, at, prints = sample_of(rows.column(1).to_pylist())
                    if len(at):
                        yield batch_id, buckets_of(prints, ((prints >> np.uint64(32)) % np.uint64(n_samples)).astype(np.int64))

        yield from sent(found())

    samples = base.where(F.col("n") >= length).select("batch", "b").mapInArrow(send_samples, SENT).groupBy("bucket").applyInArrow(shared, REPLY)
    # Rows with an exact copy, the first of which stands for all.
    whole = scratch.write(base.where(F.col("n") >= length).groupBy(F.col("sha").alias("s")).agg(F.min("uid").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    copied = base.select("uid", "batch", "sha").join(whole.hint("merge"), F.col("sha") == F.col("s")).select("batch", F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("data"), "uid", (F.col("uid") == F.col("rep")).alias("first"))
    replies = scratch.write(samples.unionByName(copied))
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "removed array<struct<start:bigint,end:bigint>>"
    state = f"batch long, uid long, doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, b binary, starts binary"
    empty_sha = hashlib.sha256(b"").hexdigest()

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        """Decided rows have no bytes, or stand in for their copies; the rest carry the runs of starts that may repeat."""
        left = left.sort_by("uid")
        texts = left["b"].to_pylist()
        s, at, prints = sample_of(texts)
        known, copies = np.zeros(0, "<u8"), {}
        if len(right):
            known = np.sort(np.frombuffer(b"".join(x for x in right["data"].to_pylist() if x), "<u8"))
            copies = {u: f for u, f in zip(right["uid"].to_pylist(), right["first"].to_pylist()) if u is not None}
        values, inverse, count = np.unique(prints, return_inverse=True, return_counts=True)
        common = (count > 1) | np.isin(values, known)
        met = np.zeros(len(s.data) + 1, np.int32)
        met[at[common[inverse]] + 1] = 1
        met = np.cumsum(met)
        out = []
        for text, u, o in zip(texts, left["uid"].to_pylist(), s.starts):
            n, own = len(text), b""
            if n >= length and copies.get(u, True):
                lo = np.arange(o, o + n - length + 1)
                own = (runs(met[lo + period] > met[lo])).astype("<i8").tobytes()
            if u in copies:
                out.append((n, n, 1, empty_sha, text if own else None, own))
            elif own:
                out.append((n, None, None, None, text, own))
            else:
                out.append((n, 0, 0, hashlib.sha256(text).hexdigest(), None, b""))
        n, removed, n_spans, sha, b, starts = zip(*out)
        return pa.table({
            "batch": left["batch"], "uid": left["uid"], "doc_id": left["doc_id"], "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()),
            "kept_sha256": pa.array(sha, pa.string()), "b": pa.array(b, pa.binary()), "starts": pa.array(starts, pa.binary()),
        })

    rows = scratch.write(base.select("batch", "uid", "doc_id", "b").groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(_with_rows(candidates, state), state))
    scratch.drop(base)
    scratch.drop(replies)
    open_rows = rows.where("b IS NOT NULL")
    # Some four bytes for each start that may repeat; open texts are an upper bound of those.
    n_buckets = max(1, -(-4 * open_rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0] // (2 * bucket_bytes)))
    segments = scratch.write(open_rows.select("batch", "b", "starts").mapInArrow(lambda x: cut_segments(x, length, period, n_buckets), SEGMENT))
    met = scratch.write(segments.where("data IS NOT NULL").select("bucket", "one", "two", "several", "data").groupBy("bucket").applyInArrow(lambda g: sort_bucket(g, length), FOUND))
    found = segments.where("data IS NULL").select("batch", F.col("one").alias("a"), F.col("two").alias("c")).join(met.hint("merge"), (F.col("a") == F.col("one")) & (F.col("c") == F.col("two"))).select("batch", "one", "two", "runs")
    result = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, {spans}, kept binary"

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        texts, decided = left["b"].to_pylist(), left["kept_sha256"].to_pylist()
        s = Strings(texts)
        gone = np.zeros(len(s.data), bool)
        if len(right):
            seg = Segments(s, left["starts"].to_pylist(), length, period)
            own = {(a, c): np.frombuffer(x, "<i4").reshape(-1, 2).astype(np.int64) for a, c, x in zip(right["one"].to_pylist(), right["two"].to_pylist(), right["runs"].to_pylist())}
            hit = [own[k] + o for k, o in zip(zip(seg.one.view(np.int64).tolist(), seg.two.view(np.int64).tolist()), seg.at.tolist()) if k in own]
            if hit:
                gone = covered(np.concatenate(hit) + [0, length - 1], len(s.data))
        out = []
        for k, (text, sha) in enumerate(zip(texts, decided)):
            if sha is None:
                own = gone[s.starts[k] : s.starts[k + 1]]
                kept = s.data[s.starts[k] : s.starts[k + 1]][~own].tobytes()
                pairs = [{"start": a, "end": b} for a, b in runs(own).tolist()]
                out.append((left["doc_id"][k].as_py(), len(text), int(own.sum()), len(pairs), hashlib.sha256(kept).hexdigest(), pairs, kept if pairs else None))
        columns = list(zip(*out)) if out else [()] * 7
        kinds = (left["doc_id"].type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"])

    opened = open_rows.select("batch", "doc_id", "kept_sha256", "b", "starts")
    ended = opened.groupBy("batch").cogroup(found.groupBy("batch")).applyInArrow(_with_rows(removed, result), result)
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast(spans.split(" ", 1)[1])
    decided = rows.where("kept_sha256 IS NOT NULL").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.when(F.col("n_removed") > 0, all_of).otherwise(none).alias("removed"), F.when(F.col("n_removed") > 0, F.lit(b"")).alias("kept"))
    return decided.unionByName(ended)


def _with_rows(f, schema: str):
    """Batches that only got replies, as their rows went elsewhere, give nothing."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return f(left, right) if len(left) else empty

    return run


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, the removed runs of bytes, and the bytes left where any were removed."""
    return remove_repeats(table(spark, sf_dir, "documents"))
