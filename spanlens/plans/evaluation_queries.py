"""Queries for the evaluation of judged candidates and returned records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as e
from ..operators import scoring as s
from .metric_queries import GOLD, GUESS, PII, SENS, TEXT, scores

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Records made from the predictions, by expressions that both engines read.
_HASH = "(doc * 31 + span_start * 7 + span_end)"
RECORDS = f"""SELECT doc, span_start, span_end, label AS identifier, CASE {_HASH} % 5 WHEN 0 THEN 'not_identifier' WHEN 1 THEN 'review' ELSE 'identifier' END AS decision,
CASE WHEN label IN ({SENS}) AND {_HASH} % 3 = 0 THEN 'none' ELSE label END AS category, CASE WHEN {_HASH} % 13 = 0 THEN NULL ELSE CAST({_HASH} % 100 AS DOUBLE) / 100 END AS confidence,
CAST({_HASH} % 10 AS DOUBLE) / 10 AS category_p, {_HASH} % 17 = 0 AS fast_path, CASE WHEN {_HASH} % 2 = 0 THEN 'lexicon:genetic' ELSE 'shape:id' END AS source FROM ({GUESS}) r"""


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs, gold, records."""
    orders, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))
    of = lambda q: spark.sql(q.replace("FROM orders", "FROM {orders}"), orders=orders)
    docs = spark.sql(TEXT.replace("FROM customer", "FROM {customer}"), customer=customer)
    return docs, of(GOLD), of(RECORDS).withColumn("sources", F.array("source")).drop("source")


_WITH = f"WITH g AS ({GOLD}), t AS ({TEXT}), r AS ({RECORDS}), n AS (SELECT g.*, row_number() OVER () AS gid FROM g WHERE doc IN (SELECT doc FROM t)), shown AS (SELECT * FROM r WHERE decision <> 'not_identifier')"
_MEETS = "{a}.doc = g.doc AND {a}.span_start <= g.span_end AND g.span_start <= {a}.span_end"


def candidate_calibration(spark, sf_dir):
    """Calibration error of all judged candidates and by what they were called."""
    _, gold, records = tables(spark, sf_dir)
    return e.calibration_by_call(e.judged_candidates(gold, records))


QUERIES["candidate_calibration"] = candidate_calibration
SQL["candidate_calibration"] = f"""{_WITH}, c AS (SELECT r.*, CASE WHEN fast_path THEN 'fast_path' WHEN category IN ({SENS}) THEN CASE WHEN source LIKE 'lexicon:%' THEN 'shi_lexicon' ELSE 'shi_other' END WHEN category IS NULL OR category = 'none' THEN 'none' ELSE 'identifier' END AS call,
  EXISTS (SELECT 1 FROM g WHERE {_MEETS.format(a="r")}) AS hit, EXISTS (SELECT 1 FROM g WHERE {_MEETS.format(a="r")} AND g.label IN ({PII}, {SENS})) AS correct FROM r WHERE confidence IS NOT NULL),
k AS (SELECT unnest(['all', call]) AS call, confidence AS p, CAST(correct AS INT) AS y FROM c WHERE correct OR NOT hit),
b AS (SELECT call, least(floor(p * 10), 9) AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy FROM k GROUP BY ALL)
SELECT call, CAST(sum(n) AS BIGINT) AS n, CAST(sum(sy) AS BIGINT) AS positives, round(sum(abs(sp - sy)) / sum(n), 4) AS ece FROM b GROUP BY call"""

# Letters and digits of the composed text ("ab 1, ") at the ends of a gold span.
_NEED = """, x AS (SELECT n.*, substr(text, span_start, span_end - span_start + 1) AS m FROM n JOIN t ON n.doc = t.doc),
need AS (SELECT *, span_start + CASE WHEN regexp_matches(m, '[a-z0-9]') THEN length(regexp_extract(m, '^[^a-z0-9]*')) ELSE 0 END AS lo, span_end - CASE WHEN regexp_matches(m, '[a-z0-9]') THEN length(regexp_extract(m, '[^a-z0-9]*$')) ELSE 0 END AS hi FROM x),
o AS (SELECT n.gid, n.doc, n.span_start, n.span_end, n.label, coalesce(bool_or(s.span_start <= lo AND hi <= s.span_end), false) AS flagged, coalesce(bool_or(s.span_start <= lo AND hi <= s.span_end AND decision = 'identifier'), false) AS auto,
  coalesce(bool_or(s.doc IS NOT NULL), false) AS seen, coalesce(bool_or(s.span_start <= lo AND hi <= s.span_end AND identifier = n.label), false) AS label_ok
  FROM need n LEFT JOIN shown s ON n.doc = s.doc AND s.span_start <= n.span_end AND n.span_start <= s.span_end GROUP BY ALL)"""


def gold_outcomes(spark, sf_dir):
    """What came of each gold span."""
    return e.gold_outcomes(*tables(spark, sf_dir))


QUERIES["gold_outcomes"] = gold_outcomes
SQL["gold_outcomes"] = f"{_WITH}{_NEED} SELECT doc, span_start, span_end, label, flagged, auto, seen AND NOT flagged AS partial, label_ok FROM o"
QUERIES["label_outcomes"] = lambda spark, sf: e.per_label(*tables(spark, sf))
SQL["label_outcomes"] = f"{_WITH}{_NEED} SELECT label, count(*) AS n, round(avg(CAST(flagged AS INT)), 4) AS recall_flagged, round(avg(CAST(auto AS INT)), 4) AS recall_auto, round(avg(CAST(label_ok AS INT)), 4) AS label_ok FROM o GROUP BY label"

_DIRECT = ", ".join(f"'{x}'" for x in s.DIRECT)
QUERIES["end_to_end_summary"] = lambda spark, sf: e.summary(*tables(spark, sf))
SQL["end_to_end_summary"] = f"""{_WITH}{_NEED}, a AS (SELECT count(*) AS gold, count_if(flagged) AS flagged, count_if(label IN ({_DIRECT})) AS direct, count_if(label IN ({_DIRECT}) AND flagged) AS df, count_if(auto) AS auto, count_if(label_ok AND flagged) AS ok, count_if(seen AND NOT flagged) AS partial FROM o),
w AS (SELECT s.*, EXISTS (SELECT 1 FROM g WHERE {_MEETS.format(a="s")}) AS hit FROM shown s),
b AS (SELECT count(*) AS returned, count_if(hit) AS hits, count_if(decision = 'identifier') AS accepted, count_if(decision = 'identifier' AND hit) AS ah, count_if(decision = 'review') AS reviews, count_if(decision = 'review' AND NOT hit) AS fr FROM w),
d AS (SELECT count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM t), z AS (SELECT count_if(decision = 'not_identifier') AS dropped FROM r),
v AS (SELECT docs, chars, CAST(gold AS BIGINT) AS gold, CAST(returned AS BIGINT) AS returned, round(flagged / gold, 4) AS recall_flagged, round(df / direct, 4) AS recall_flagged_direct, round(auto / gold, 4) AS recall_auto, round(ok / flagged, 4) AS label_accuracy_flagged, CAST(partial AS BIGINT) AS partial,
  round(hits / returned, 4) AS precision_flagged, round(ah / accepted, 4) AS precision_auto, CAST(accepted - ah AS BIGINT) AS false_accepts, round(reviews / returned, 4) AS review_rate, round(reviews * 1000 / chars, 2) AS review_per_1k_chars, CAST(fr AS BIGINT) AS false_review, CAST(dropped AS BIGINT) AS dropped FROM a, b, d, z)
SELECT *, round(2 * precision_flagged * recall_flagged / (precision_flagged + recall_flagged), 4) AS f1_flagged FROM v"""

QUERIES["false_positive_kinds"] = lambda spark, sf: e.false_positives(tables(spark, sf)[1], tables(spark, sf)[2])
SQL["false_positive_kinds"] = f"{_WITH} SELECT decision || ':' || coalesce(identifier, 'None') || ':' || source AS kind, count(*) AS n FROM shown s WHERE NOT EXISTS (SELECT 1 FROM g WHERE {_MEETS.format(a='s')}) GROUP BY 1 ORDER BY n DESC, kind LIMIT 25"


def negative_notes(spark, sf_dir):
    """False positives, and those in documents without gold."""
    docs, gold, records = tables(spark, sf_dir)
    return e.score_more(docs, gold.where("doc % 3 <> 0"), records.withColumnRenamed("identifier", "label"))


QUERIES["negative_notes"] = negative_notes
SQL["negative_notes"] = f"""{_WITH}, k AS (SELECT * FROM g WHERE doc % 3 <> 0), w AS (SELECT r.doc FROM r WHERE identifier NOT IN ({SENS}) AND doc IN (SELECT doc FROM t) AND NOT EXISTS (SELECT 1 FROM k WHERE r.doc = k.doc AND r.span_start <= k.span_end AND k.span_start <= r.span_end))
SELECT count(*) AS fp, count_if(doc NOT IN (SELECT doc FROM k)) AS fp_on_negative_notes FROM w"""


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions under a temperature of 2 and other thresholds, over the records that were asked about."""
    _, gold, records = tables(spark, sf_dir)
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("confidence")))
    cooled = 1 / (1 + F.exp(-F.log(p / (1 - p)) / 2))
    rows = e.replay(records.withColumn("prior", F.lit(None).cast("array<string>")), cooled, 0.2, 0.7, 0.3)
    return rows.select("doc", "span_start", "span_end", F.col("identifier").alias("label"), ((F.col("doc") + F.col("span_start")) % 2 == 0).alias("is_pii"), "replayed")


QUERIES["replay_decisions"] = replayed
_COOLED = "1 / (1 + exp(-ln(least(1 - 1e-6, greatest(1e-6, confidence)) / (1 - least(1 - 1e-6, greatest(1e-6, confidence)))) / 2))"
SQL["replay_decisions"] = f"""SELECT doc, span_start, span_end, identifier AS label, (doc + span_start) % 2 = 0 AS is_pii, CASE WHEN fast_path THEN decision WHEN confidence IS NULL THEN 'review' WHEN q < 0.2 THEN 'not_identifier' WHEN q >= 0.7 AND category_p >= 0.3 THEN 'identifier' ELSE 'review' END AS replayed FROM (SELECT *, {_COOLED} AS q FROM ({RECORDS}) k) z"""
QUERIES["replay_metrics"] = lambda spark, sf: e.decision_metrics(replayed(spark, sf))
SQL["replay_metrics"] = f"""WITH x AS ({SQL["replay_decisions"]}) SELECT count(*) AS n, round(count_if(is_pii AND replayed <> 'not_identifier') / count_if(is_pii), 4) AS recall_flagged, round(count_if(is_pii AND label IN ({_DIRECT}) AND replayed <> 'not_identifier') / count_if(is_pii AND label IN ({_DIRECT})), 4) AS recall_flagged_direct,
round(count_if(is_pii AND replayed = 'identifier') / count_if(is_pii), 4) AS recall_auto, round(count_if(is_pii AND replayed = 'identifier') / count_if(replayed = 'identifier'), 4) AS precision_auto, round(count_if(NOT is_pii AND replayed = 'not_identifier') / count_if(NOT is_pii), 4) AS decoy_dropped, round(count_if(replayed = 'review') / count(*), 4) AS review_rate FROM x"""


def ece_bootstrap(spark, sf_dir):
    """The interval of the calibration error of the labelled scores, ten rows to a document."""
    return e.ece_interval(scores(spark, sf_dir).withColumn("doc", F.floor(F.col("doc_id") / 10)))


QUERIES["ece_bootstrap"] = ece_bootstrap
