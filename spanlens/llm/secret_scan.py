"""Secret scan over an incremental ledger of blobs.

Every version of every path is addressed by the digest of its content. The ledger holds the (blob, rule,
rule version) triples that have been scanned and what was found in them; a scan reads only the content of
blobs that lack some triple, only for the rules they lack, and joins findings back to all paths that ever
held the blob. Only DataFrame functions are used.

Copies are dropped by a map-side aggregate before content is moved, so a blob that a third of all
paths share is moved and scanned once a task at most; the join back is an equi-join on the digest whose
oversized partitions adaptive execution splits.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free, shared_dir, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """kind is the name in spans; matches are leftmost and do not overlap; those whose `group` is shorter than `least` are dropped."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order that breaks ties of spans that start together.
RULES = (
    Rule("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)

SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Code-point spans (end exclusive) of a rule's matches: gaps between matches come from split, and running
    sums of the lengths of gaps and matches give the offsets."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.char_length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.char_length)
    part = whole if rule.group == 0 else F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.char_length)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(None).cast(SPAN).alias("out"))
    empty = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + x["whole"]).alias("end"), F.lit(rule.kind).alias("kind"))
        kept = F.coalesce(acc["out"], empty)
        return F.struct((at + x["whole"]).alias("at"), F.when(x["part"] >= rule.least, F.concat(kept, F.array(span))).otherwise(kept).alias("out"))

    zipped = F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part")), lambda x: F.struct(x["gap"].cast("long").alias("gap"), F.coalesce(x["whole"], F.lit(0)).cast("long").alias("whole"), F.coalesce(x["part"], F.lit(0)).alias("part")))
    found = F.aggregate(zipped, start, step, lambda acc: F.coalesce(acc["out"], empty))
    return F.when(text.rlike(rule.pattern), found).otherwise(empty)


def scan_blobs(paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new rows for paths (blob, text): blob, rule, spans, one for each unseen blob and rule version.

    ledger: rows of an earlier run with the same columns, or None. Blobs that lack a rule are found by their digests; only
    their contents are moved."""
    contents = paths.select("blob", "text")
    none = F.array().cast("array<string>")
    if ledger is None:
        blobs = contents.groupBy("blob").agg(F.first("text").alias("text")).withColumn("seen", none)
    else:
        known = ledger.where(F.col("rule").isin([r.key for r in rules])).groupBy(F.col("blob").alias("b")).agg(F.collect_set("rule").alias("seen"))
        lacking = paths.select("blob").distinct().join(known, F.col("blob") == F.col("b"), "left").where(F.coalesce(F.size("seen"), F.lit(0)) < len(rules))
        lacking = Scratch(paths.sparkSession, "lacking").write(lacking.select(F.col("blob").alias("b"), F.coalesce("seen", none).alias("seen")))
        blobs = contents.join(lacking, F.col("blob") == F.col("b")).groupBy("blob").agg(F.first("text").alias("text"), F.first("seen").alias("seen"))
    results = F.array(*[F.when(~F.array_contains("seen", r.key), F.struct(F.lit(r.key).alias("rule"), spans_of(F.col("text"), r, i).alias("spans"))) for i, r in enumerate(rules)])
    return blobs.select("blob", F.inline(F.filter(results, lambda x: x.isNotNull())))


def stored_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger written at path by earlier runs, or None."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(path)


def incremental_scan(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob and spans for every row of docs, by the ledger stored at path, to which the run's new rows are appended. A run
    that was cut short appends nothing, so it is run again. One run at a time may append."""
    spark = docs.sparkSession
    paths = addressed(docs.select("doc_id", "text"))
    scan_blobs(paths, stored_ledger(spark, path), rules).write.mode("append").parquet(path)
    return findings(paths.select("doc_id", "blob"), spark.read.parquet(path), Scratch(spark, "ledger"), rules)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def findings(paths: DataFrame, ledger: DataFrame, scratch: Scratch, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """paths (blob, ...) with spans, the sorted findings of all rules, one row for each path.

    Findings by blob are written before they are joined, so that each side of the join has its own exchange and the
    partition of a blob that many paths share can be split."""
    of = ledger.where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return paths.join(scratch.write(of), "blob")


def addressed(docs: DataFrame) -> DataFrame:
    """docs with blob, the digest of the text, null text counting as empty."""
    return docs.withColumn("text", text_or_empty()).withColumn("blob", F.unhex(F.sha2(F.encode("text", "utf-8"), 256)))


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(doc_id and spans for every row of docs (doc_id, text); the ledger with what this run adds).

    docs may hold several versions of a path and several paths of a content. Null text counts as empty and
    has no findings. Repeated rows and null doc_id give a row each; other columns are ignored; an empty
    table gives empty results. The added part of the ledger is written once and read for the join.
    """
    paths = addressed(docs.select("doc_id", "text"))
    scratch = Scratch(docs.sparkSession, "ledger")
    added = scratch.write(scan_blobs(paths, ledger, rules))
    whole = added if ledger is None else ledger.select(added.columns).unionByName(added)
    return findings(paths.select("doc_id", "blob"), whole, scratch, rules), whole


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """docs with each maximal run of found spans replaced by a mark; n_chars, where present, follows. Texts without findings stay as they are, null included."""
    found, _ = secret_scan(docs, None, rules)
    blob, id_, hit, found_spans = free(docs.columns, "blob", "id", "hit", "spans")
    hits = found.where(F.size("spans") > 0).select(F.col("doc_id").alias(id_), F.col("blob").alias(hit), F.col("spans").alias(found_spans)).dropDuplicates([id_, hit])
    text, spans = F.col("text"), F.col(found_spans)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], before, F.lit(mark)).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when((s["start"] >= acc["at"]) | (acc["at"] == 0), fresh).otherwise(longer)

    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text))))
    met = docs.withColumn(blob, F.unhex(F.sha2(F.encode(text_or_empty(), "utf-8"), 256))).join(hits, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(blob) == F.col(hit)), "left")
    out = met.withColumn("text", F.when(spans.isNotNull(), clean).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(spans.isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


#: Setting that names a ledger's folder to be kept between runs; where it is unset a run starts from an empty ledger of its own.
LEDGER = "spark.spanlens.secretLedger"


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns by the stored ledger: a second run with the same LEDGER scans unseen contents only."""
    path = spark.conf.get(LEDGER, None) or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    found = incremental_scan(table(spark, sf_dir, "documents"), path)
    spans = F.col("spans")
    return found.select(
        "doc_id", count_of(spans, "assign").alias("n_assign"), count_of(spans, "access").alias("n_access"), count_of(spans, "hex").alias("n_hex"),
        F.sha2(joined(spans), 256).alias("base_sha256"), joined(spans).alias("spans"),
    )


def _sql_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """All matches of a kind with offsets: string_split_regex gives the gaps."""
    return f"""
SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s AS start, s + length(m) AS stop FROM (
  SELECT doc_id, unnest(m) AS m, unnest(g) AS grp, unnest(list_transform(range(1, len(m) + 1), lambda i:
    CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT))) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, p, 0) AS m, regexp_extract_all(t, p, {group}) AS g, string_split_regex(t, p) AS gaps
        FROM (SELECT doc_id, coalesce(text, '') AS t, {pattern} AS p FROM documents))
) WHERE length(grp) >= {least}"""


OP1_SQL = f"""
WITH s AS ({_sql_spans("assign", 0, "'((?i:password|passwd|secret|token|api_?key))[\"'']? *[:=] *[\"'']?([A-Za-z0-9+/_.=-]+)'", 2, 8)}
UNION ALL {_sql_spans("access", 1, "'AKIA[A-Z0-9]+'", 0, 16)}
UNION ALL {_sql_spans("hex", 2, "'[0-9a-f]{32,}'", 0, 32)}),
a AS (SELECT doc_id, sum(CAST(kind = 'assign' AS INT)) AS n_assign, sum(CAST(kind = 'access' AS INT)) AS n_access, sum(CAST(kind = 'hex' AS INT)) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""
