"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Pieces of one length are interchangeable, and so are sequences with one gap, so both are kept as runs:
a run of pieces is a length and a range of ranks, a run of gaps a size and a range of sequences. Rows are
ranked inside their run by a distributed count; a run's range of ranks settles which piece gets which
sequence, so no two claim the same gap. A round sorts both kinds of runs by size, sweeps them from the
large to the small, hands every piece the smallest gap at or above its length that no larger piece of the
round has taken (one piece a gap), and updates the gaps. When a sweep places nothing, as many new sequences
are opened as the remaining ids need at least, seeded with the largest pieces. The runs of a round number at
most the capacity plus what earlier rounds have split, whatever the number of rows; rows are touched three
times: when they are encoded, ranked and handed their sequence.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, small_batches, table, text_or_empty
from .word_ids import word_encoder

#: Rows of one length that a task ranks, on average: a length that a third of all rows share is split by its count.
SALTED = 1000


def cut(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of each document's ids with the end id."""

    def make():
        encode = word_encoder(vocabulary)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc_id, own in zip(batch.column(0).to_pylist(), encode(batch.column(1), end_id)):
                ids = own.astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", text_or_empty().alias("text")), make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, end rank, first sequence, offset) for runs of pieces {length: count}."""
    left, rank = dict(counts), defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = {}
    out, opened = [], 0
    while any(left.values()):
        taken: list[tuple[int, int, int]] = []  # gap left, first sequence, count
        stack: list[list[int]] = []  # gap, first sequence, count
        for size in range(capacity, 0, -1):
            stack += [[size, *run] for run in gaps.get(size, ())]
            while left.get(size) and stack:
                top = stack[-1]
                n = min(left[size], top[2])
                out.append((size, rank[size], rank[size] + n, top[1], capacity - top[0]))
                taken.append((top[0] - size, top[1], n))
                rank[size] += n
                left[size] -= n
                top[1] += n
                top[2] -= n
                if not top[2]:
                    stack.pop()
        if not taken:
            need = -(-sum(k * n for k, n in left.items()) // capacity)
            for size in sorted(left, reverse=True):
                if n := min(need, left[size]):
                    out.append((size, rank[size], rank[size] + n, opened, 0))
                    taken.append((capacity - size, opened, n))
                    rank[size] += n
                    left[size] -= n
                    opened += n
                    need -= n
        least = min((k for k, n in left.items() if n), default=capacity + 1)
        gaps = {}
        for gap, first, n in [*map(tuple, stack), *taken]:
            if gap >= least:
                gaps.setdefault(gap, []).append((first, n))
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs (doc_id, text).

    Null text counts as empty: the document is the end id alone. Documents over the capacity are cut into
    pieces of that length, the last may be shorter; a full piece is a sequence of its own with a negative
    id. Repeated rows and null doc_id are packed like any other row. Other columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)  # a batch of 1,024 takes 40 MB more of a worker
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(cut(docs, vocabulary, end_id, capacity).withColumn("uid", F.monotonically_increasing_id()))
    small_batches(spark)
    part = pieces.where(F.col("length") < capacity)
    by_length = scratch.write(part.groupBy("length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in by_length.collect()}
    placed = spark.createDataFrame(plan(counts, capacity), "length long, lo long, hi long, first long, offset long")
    # A row for each length below the capacity.
    part = part.join(F.broadcast(by_length.select("length", F.ceil(F.col("n") / SALTED).alias("salts"))), "length").withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("salts"))).drop("salts")
    sizes = scratch.write(part.groupBy("length", "salt").agg(F.count("*").alias("n")))
    before = sizes.select(F.col("length").alias("l"), F.col("salt").alias("s"), (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1)
    ranked = ranked.join(scratch.write(before), (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("rank", F.col("rank") + F.col("before"))
    # The plan's runs are bounded by the capacity, so they are broadcast.
    met = ranked.join(F.broadcast(placed), "length").where("rank >= lo AND rank < hi")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(met.select(*columns, (F.col("first") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens: see pack. Null texts are one end token, longer documents are cut, an empty table gives no rows."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
