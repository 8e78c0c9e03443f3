"""Exact duplicates by distributed radix partitioning, most significant byte first.

A text is taken as its length followed by its bytes. Rows are split by the first bytes of that string,
and groups that still hold several rows are split again by the next, wider run of bytes, until a group
is a single row or its texts have ended. Whole bytes are compared; no digest takes part. Digits are wide, as
each round is a job: most groups are single after the first, and widths double, so the rounds number about the
logarithm of the longest repeated text.

Each round is one pre-aggregated count by (group, digit) and one equi-join that hands the new group back
to the rows, so a group that holds a third of all rows costs a row a task in the count, and the join's
oversized partitions are split by adaptive execution. Only rows that share their digit carry on the rest of
their text. The join is a sort-merge join at every size, as groups grow with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of the first digits; from then on the width doubles.
WIDTHS = (24, 2048, 65536)


def normalised(column: str = "text"):
    return F.translate(text_or_empty(column), UPPER, LOWER)


def exact_dedup(docs: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """exact_groups without uid."""
    numbered = Scratch(docs.sparkSession, "numbered").numbered(docs, "doc_id", "text")
    return exact_groups(numbered, widths).drop("uid")


def exact_groups(docs: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """uid, doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (uid, doc_id, text).

    uid is a number for each row that stays the same when docs, which is read twice, is read again (see Scratch.numbered).
    Null text counts as empty. Texts are equal when they are the same after lower-casing A-Z. Of equal
    texts the row with the largest doc_id stays, null being smallest; where rows also share the doc_id,
    exactly one of them stays. Rows with null doc_id take part and get keep_id of their group. An empty
    table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "radix")
    text = F.encode(normalised(), "utf-8")
    first = widths[0]
    rows = (
        docs.select("uid", "doc_id", text.alias("b"))
        .select(
            "doc_id", "uid", F.sha2("b", 256).alias("sha"),
            F.concat(F.unhex(F.lpad(F.hex(F.length("b").cast("long")), 16, "0")), F.substring("b", 1, first)).alias("digit"),
            F.substring("b", F.lit(first + 1), F.length("b")).alias("tail"), F.lit(0).cast("long").alias("grp"),
        )
    )
    done: list[DataFrame] = []
    level, w = 0, first
    while True:
        state = scratch.write(_split(rows, scratch))
        done.append(state.where(F.length("tail") == 0).drop("tail"))
        rest = state.where(F.length("tail") > 0)
        if rest.isEmpty():
            break
        level += 1
        w = widths[level] if level < len(widths) else 2 * w
        rows = rest.select("doc_id", "uid", "sha", F.substring("tail", 1, w).alias("digit"), F.substring("tail", F.lit(w + 1), F.length("tail")).alias("tail"), "grp")
    ended = done[0]
    for more in done[1:]:
        ended = ended.unionByName(more)
    top = F.max(F.struct("doc_id", "uid"))
    groups = scratch.write(ended.where("n > 1").groupBy(F.col("grp").alias("g0")).agg(top.alias("top"), F.count("*").alias("group_size")))
    several = ended.where("n > 1").join(groups, F.col("grp") == F.col("g0")).select(
        "uid", "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("top.uid")).alias("kept"), F.col("sha").alias("text_sha256"))
    single = ended.where("n = 1").select("uid", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    return single.unionByName(several)


def _split(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with the group of their digit, a row alone in it being a group of its own, whose tail goes.

    Groups of several rows are written first: both sides of the join then have an exchange of their own, so adaptive
    execution can split a large group, or broadcast the groups where they are few."""
    several = rows.groupBy(F.col("grp").alias("g0"), F.col("digit").alias("d0")).agg(F.count("*").alias("n"), F.min("uid").alias("new")).where("n > 1")
    groups = scratch.write(several)
    met = rows.join(groups.hint("merge"), (F.col("grp") == F.col("g0")) & (F.col("digit") == F.col("d0")), "left")
    tail = F.when(F.col("n").isNull(), F.lit(b"")).otherwise(F.col("tail"))
    return met.select("doc_id", "uid", "sha", F.coalesce("new", "uid").alias("grp"), F.coalesce("n", F.lit(1)).alias("n"), tail.alias("tail"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal but for the case of A-Z: see exact_groups. Null texts are empty ones, ties go to one row."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
