"""Queries for metrics, calibrators, thresholds, scores and pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration as c
from ..operators import scoring as s

QUERIES: dict = {}
SQL: dict[str, str] = {}

P = "CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000"
SCORES = f"SELECT doc_id, {P} AS p, (doc_id * 31) % 1000 < (doc_id * 7919) % 1000 AS y, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS grp FROM labels"
SUMS = f"WITH s AS ({SCORES}), n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM s)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", f"{P} AS p", "(doc_id * 31) % 1000 < (doc_id * 7919) % 1000 AS y", "CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS grp")


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*[F.round(k, places).alias(k) if t == "double" else F.col(k) for k, t in df.dtypes])


def _metric(name: str, f, sql: str) -> None:
    QUERIES[name] = lambda spark, sf: rounded(f(scores(spark, sf)))
    SQL[name] = sql


_BINS = "SELECT least(CAST(floor(p * 10) AS INT), 9) AS bin, count(*) AS n, avg(p) AS mean_p, avg(CAST(y AS DOUBLE)) AS mean_y FROM s GROUP BY 1"
_metric("reliability_bins", c.reliability_bins, f"WITH s AS ({SCORES}) SELECT bin, n, round(mean_p, 9) AS mean_p, round(mean_y, 9) AS mean_y FROM ({_BINS})")
_metric("ece", c.ece, f"WITH s AS ({SCORES}) SELECT round(sum(n * abs(mean_p - mean_y)) / sum(n), 9) AS ece FROM ({_BINS})")
_metric("brier", c.brier, f"WITH s AS ({SCORES}) SELECT round(avg((p - CAST(y AS DOUBLE)) * (p - CAST(y AS DOUBLE))), 9) AS brier FROM s")
_metric("nll", c.nll, f"WITH s AS ({SCORES}), q AS (SELECT y, least(1 - 1e-6, greatest(1e-6, p)) AS p FROM s) SELECT round(avg(-CASE WHEN y THEN ln(p) ELSE ln(1 - p) END), 9) AS nll FROM q")
_metric("auroc", c.auroc, f"WITH s AS ({SCORES}) SELECT round(avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END), 9) AS auroc FROM s a, s b WHERE a.y AND NOT b.y")
_metric("choose_thresholds", c.choose_thresholds, f"""WITH s AS ({SCORES}), pos AS (SELECT list(p ORDER BY p) AS ps FROM s WHERE y),
t AS (SELECT greatest(0.0, least(ps[CAST(floor(len(ps) * (1 - 0.98) + 1e-9) AS INT) + 1], 0.05) - 1e-6) AS d, len(ps) AS n FROM pos),
a AS (SELECT p, count(*) OVER w AS n, sum(CAST(y AS INT)) OVER w AS tp FROM s WINDOW w AS (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT min(p) AS p FROM a WHERE n >= 20 AND p >= 0.5 AND tp / n >= 0.98)
SELECT CASE WHEN t.n < 20 THEN 0.0 ELSE round(d, 6) END AS drop_below, CASE WHEN t.n < 20 THEN 1.0 ELSE coalesce(round(b.p, 6), 1.0) END AS accept_at,
CASE WHEN t.n >= 20 THEN round((SELECT count(*) FROM s WHERE y AND p >= d) / t.n, 4) END AS recall_at_drop, CASE WHEN t.n >= 20 THEN round((SELECT max(tp / n) FROM a WHERE a.p = b.p), 4) END AS precision_at_accept FROM t, b""")

STEPS = c.Isotonic((0.1, 0.25, 0.5, 0.8, 0.95), (0.0, 0.125, 0.5, 0.75, 1.0))
_ISO = "CASE WHEN round(p, 6) <= 0.1 THEN 0.005 WHEN round(p, 6) <= 0.25 THEN 0.125 WHEN round(p, 6) <= 0.5 THEN 0.5 WHEN round(p, 6) <= 0.8 THEN 0.75 ELSE 0.995 END"
_CLIP = "least(1 - 1e-6, greatest(1e-6, p))"
_TEMP = f"1 / (1 + exp(-ln({_CLIP} / (1 - {_CLIP})) / 1.7))"
QUERIES["isotonic_apply"] = lambda spark, sf: scores(spark, sf).select("doc_id", F.round(STEPS.column(F.col("p")), 9).alias("q"))
SQL["isotonic_apply"] = f"SELECT doc_id, round({_ISO}, 9) AS q FROM ({SCORES})"
QUERIES["temperature_apply"] = lambda spark, sf: scores(spark, sf).select("doc_id", F.round(c.Temperature(1.7).column(F.col("p")), 9).alias("q"))
SQL["temperature_apply"] = f"SELECT doc_id, round({_TEMP}, 9) AS q FROM ({SCORES})"
QUERIES["grouped_apply"] = lambda spark, sf: scores(spark, sf).select("doc_id", F.round(c.Grouped({"toxic": STEPS}, c.Temperature(1.7)).column(F.col("p"), F.col("grp")), 9).alias("q"))
SQL["grouped_apply"] = f"SELECT doc_id, round(CASE WHEN grp = 'toxic' THEN {_ISO} ELSE {_TEMP} END, 9) AS q FROM ({SCORES})"


def isotonic_fit(spark, sf_dir):
    """Blocks of the fitted step function."""
    fitted = c.fit(scores(spark, sf_dir), "isotonic")
    return spark.createDataFrame(list(zip(range(len(fitted.xs)), fitted.xs, fitted.ys)), "block int, x double, y double")


def temperature_fit(spark, sf_dir):
    return spark.createDataFrame([(c.fit(scores(spark, sf_dir), "temperature").t,)], "t double")


def grouped_fit(spark, sf_dir):
    """Each row's score under a calibrator of its group."""
    rows = scores(spark, sf_dir).withColumnRenamed("grp", "group")
    return rows.select("doc_id", F.round(c.fit_grouped(rows).column(F.col("p"), F.col("group")), 6).alias("q"))


def oof_nll(spark, sf_dir):
    """Log loss of each kind of calibrator, fitted out of fold, and the kind that is chosen."""
    rows = c.folds(scores(spark, sf_dir).withColumn("doc", F.col("doc_id")).withColumn("seq", F.col("doc_id")), 5)
    losses = {k: c.nll(c.out_of_fold(rows, k).select(F.col("q").alias("p"), "y")).first()["nll"] for k in ("identity", "temperature", "isotonic")}
    best = c.choose_kind(losses)
    return spark.createDataFrame([(k, round(v, 6), k == best) for k, v in losses.items()], "kind string, nll double, chosen boolean")


QUERIES |= {"isotonic_fit": isotonic_fit, "temperature_fit": temperature_fit, "grouped_fit": grouped_fit, "oof_nll": oof_nll}
QUERIES["folds"] = lambda spark, sf: c.folds(scores(spark, sf).withColumn("doc", F.col("doc_id")).withColumn("seq", -F.col("doc_id")), 5).select("doc_id", "fold")
SQL["folds"] = "SELECT doc_id, CAST((row_number() OVER (ORDER BY -doc_id) - 1) % 5 AS INT) AS fold FROM labels"

# --- spans: gold composed from orders, predictions shifted, dropped and added ---

LABELS = "(CASE o_orderkey % 7 WHEN 0 THEN 'name' WHEN 1 THEN 'phone' WHEN 2 THEN 'dob' WHEN 3 THEN 'date_other' WHEN 4 THEN 'hiv_sti' WHEN 5 THEN 'genetic' ELSE 'mrn' END)"
GOLD = f"SELECT o_custkey AS doc, CAST((o_orderkey % 50) * 20 + 1 AS INT) AS span_start, CAST((o_orderkey % 50) * 20 + 3 + o_orderkey % 12 AS INT) AS span_end, {LABELS} AS label FROM orders"
_SHIFT = "greatest((o_orderkey % 50) * 20 + (o_orderkey % 9) * 3 - 10, 1)"
GUESS = f"SELECT o_custkey AS doc, CAST({_SHIFT} AS INT) AS span_start, CAST({_SHIFT} + 4 + o_orderkey % 8 AS INT) AS span_end, CASE WHEN o_orderkey % 11 = 0 THEN 'mental_health' ELSE {LABELS} END AS label FROM orders WHERE o_orderkey % 5 <> 0"
TEXT = "SELECT c_custkey AS doc, repeat('ab 1, ', 200) AS text FROM customer"
PII, SENS = (", ".join(f"'{x}'" for x in v) for v in (s.IDENTIFIERS, s.SENSITIVE))


def spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return tuple(spark.sql(q.replace("FROM orders", "FROM {orders}"), orders=orders) for q in (GOLD, GUESS))


_WITH = f"WITH g AS ({GOLD}), p AS ({GUESS}), q AS (SELECT * FROM p WHERE label NOT IN ({SENS}))"
_MEET = "q.doc = g.doc AND q.span_start <= g.span_end AND g.span_start <= q.span_end"
_HITS = f"SELECT g.*, EXISTS (SELECT 1 FROM q WHERE {_MEET}) AS hit FROM g WHERE label IN ({PII})"
QUERIES["span_score"] = lambda spark, sf: s.span_score(*spans(spark, sf))
SQL["span_score"] = f"""{_WITH}, h AS ({_HITS}), a AS (SELECT count(*) AS gold, sum(CAST(hit AS INT)) AS hits FROM h),
b AS (SELECT count(*) AS tp FROM q WHERE EXISTS (SELECT 1 FROM g WHERE {_MEET} AND g.label IN ({PII}))), f AS (SELECT count(*) AS fp FROM q WHERE NOT EXISTS (SELECT 1 FROM g WHERE {_MEET}))
SELECT gold, CAST(hits AS BIGINT) AS hits, round(hits / gold, 4) AS recall, tp, fp, round(tp / (tp + fp), 4) AS precision, round(2 * (tp / (tp + fp)) * (hits / gold) / (tp / (tp + fp) + hits / gold), 4) AS f1 FROM a, b, f"""
QUERIES["per_label_recall"] = lambda spark, sf: s.per_label_recall(*spans(spark, sf))
SQL["per_label_recall"] = f"{_WITH} SELECT label, count(*) AS n, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS hits, round(avg(CAST(hit AS DOUBLE)), 4) AS recall FROM ({_HITS}) GROUP BY label"


def span_covered(spark, sf_dir):
    gold, guess = spans(spark, sf_dir)
    text = spark.sql(TEXT.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return s.coverage(text, gold.where(F.col("label").isin(*s.IDENTIFIERS)), guess)


QUERIES["span_covered"] = span_covered
SQL["span_covered"] = f"""{_WITH}, t AS ({TEXT}), n AS (SELECT g.*, row_number() OVER () AS gid FROM g WHERE label IN ({PII})),
x AS (SELECT gid, n.doc, unnest(range(CAST(span_start AS BIGINT), span_end + 1)) AS pos, text FROM n JOIN t ON n.doc = t.doc),
m AS (SELECT DISTINCT gid FROM x WHERE regexp_matches(substr(text, CAST(pos AS INT), 1), '[A-Za-z0-9]') AND NOT EXISTS (SELECT 1 FROM q WHERE q.doc = x.doc AND q.span_start <= x.pos AND x.pos <= q.span_end))
SELECT doc, span_start, span_end, label, m.gid IS NULL AS covered FROM n LEFT JOIN m ON n.gid = m.gid WHERE n.doc IN (SELECT doc FROM t)"""


def _set(spark, sf_dir):
    """docs, gold and predictions, of which every fourth is only up for review."""
    gold, guess = spans(spark, sf_dir)
    text = spark.sql(TEXT.replace("FROM customer", "FROM {customer}"), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return text, gold, guess.withColumn("decision", F.expr("CASE WHEN (doc + span_start) % 4 = 0 THEN 'review' ELSE 'identifier' END"))


_SET = f"""{_WITH}, t AS ({TEXT}), n AS (SELECT g.*, row_number() OVER () AS gid FROM g WHERE label IN ({PII}) AND doc IN (SELECT doc FROM t)),
x AS (SELECT gid, n.doc, unnest(range(CAST(span_start AS BIGINT), span_end + 1)) AS pos, text FROM n JOIN t ON n.doc = t.doc),
c AS (SELECT * FROM x WHERE regexp_matches(substr(text, CAST(pos AS INT), 1), '[A-Za-z0-9]')),
m AS (SELECT DISTINCT gid FROM c WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.doc = c.doc AND q.span_start <= c.pos AND c.pos <= q.span_end)),
u AS (SELECT DISTINCT gid FROM c WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.doc = c.doc AND (q.doc + q.span_start) % 4 <> 0 AND q.span_start <= c.pos AND c.pos <= q.span_end)),
o AS (SELECT n.*, EXISTS (SELECT 1 FROM q WHERE q.doc = n.doc AND q.span_start <= n.span_end AND n.span_start <= q.span_end) AS hit, n.gid NOT IN (SELECT gid FROM m) AS covered, n.gid NOT IN (SELECT gid FROM u) AS auto FROM n),
w AS (SELECT q.*, EXISTS (SELECT 1 FROM g WHERE {_MEET} AND g.label IN ({PII})) AS tp, NOT EXISTS (SELECT 1 FROM g WHERE {_MEET}) AS fp, NOT EXISTS (SELECT 1 FROM g WHERE g.doc = q.doc) AS negative FROM q WHERE doc IN (SELECT doc FROM t))"""
QUERIES["set_score"] = lambda spark, sf: s.set_score(*_set(spark, sf))
SQL["set_score"] = f"""{_SET}, a AS (SELECT count(*) AS gold, count_if(hit) AS h, count_if(covered) AS c, count_if(auto) AS a FROM o), b AS (SELECT count_if(tp) AS tp, count_if(fp) AS fp, count_if(fp AND negative) AS neg FROM w)
SELECT CAST(gold AS BIGINT) AS gold, round(h / gold, 4) AS recall, round(c / gold, 4) AS covered, round(a / gold, 4) AS auto_covered, round(tp / (tp + fp), 4) AS precision, round(2 * (tp / (tp + fp)) * (h / gold) / (tp / (tp + fp) + h / gold), 4) AS f1,
  CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(neg AS BIGINT) AS fp_on_negative_notes FROM a, b"""
QUERIES["label_scores"] = lambda spark, sf: s.label_scores(*_set(spark, sf))
SQL["label_scores"] = f"{_SET} SELECT label, count(*) AS n, round(count_if(hit) / count(*), 4) AS recall, round(count_if(covered) / count(*), 4) AS covered FROM o GROUP BY label"
QUERIES["missed_spans"] = lambda spark, sf: s.misses(*_set(spark, sf))
SQL["missed_spans"] = f"{_SET} SELECT o.doc, span_start, span_end, label, substr(text, span_start, span_end - span_start + 1) AS match, hit AS overlapped, count(*) AS n FROM o JOIN t ON o.doc = t.doc WHERE NOT covered GROUP BY ALL"
QUERIES["score_shi"] = lambda spark, sf: s.score_sensitive(*spans(spark, sf))
SQL["score_shi"] = f"""WITH g AS ({GOLD}), p AS ({GUESS}), q AS (SELECT * FROM p WHERE label IN ({SENS})), r AS (SELECT *, row_number() OVER () AS gid FROM g WHERE label IN ({SENS})),
a AS (SELECT count(*) AS n, avg(CAST(EXISTS (SELECT 1 FROM q WHERE q.doc = r.doc AND q.span_start <= r.span_end AND r.span_start <= q.span_end) AS DOUBLE)) AS hit,
  avg(CAST(EXISTS (SELECT 1 FROM q WHERE q.doc = r.doc AND q.label = r.label AND q.span_start <= r.span_end AND r.span_start <= q.span_end) AS DOUBLE)) AS okay FROM r),
b AS (SELECT count(*) AS tp FROM q WHERE EXISTS (SELECT 1 FROM g WHERE {_MEET} AND g.label IN ({SENS}))), f AS (SELECT count(*) AS fp FROM q WHERE NOT EXISTS (SELECT 1 FROM g WHERE {_MEET}))
SELECT n AS gold, round(hit, 4) AS recall, round(okay, 4) AS category_ok, round(tp / (tp + fp), 4) AS precision, fp FROM a, b, f"""


def span_union(spark, sf_dir):
    """Predictions of two systems together, nothing dropped."""
    gold, guess = spans(spark, sf_dir)
    return guess.unionByName(gold)


QUERIES["span_union"] = span_union
SQL["span_union"] = f"SELECT * FROM ({GUESS}) UNION ALL SELECT * FROM ({GOLD})"

# --- pooling ---

SETS = "SELECT source, count(*) AS gold, count(CASE WHEN doc_id % 53 = 0 THEN 1 END) AS missed, count(CASE WHEN doc_id % 2 = 0 THEN 1 END) AS gold_direct, count(CASE WHEN doc_id % 106 = 0 THEN 1 END) AS missed_direct, count(CASE WHEN doc_id % 10 <> 0 THEN 1 END) AS tp, count(CASE WHEN doc_id % 17 = 0 THEN 1 END) AS fp FROM documents GROUP BY source"


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SETS.replace("FROM documents", "FROM {documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


_POOL = f"""SELECT *, round((gold - missed) / gold, 4) AS recall, round((gold_direct - missed_direct) / gold_direct, 4) AS direct_recall, round(tp / (tp + fp), 4) AS precision,
round(2 * ((gold - missed) / gold) * (tp / (tp + fp)) / ((gold - missed) / gold + tp / (tp + fp)), 4) AS f1
FROM (SELECT CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(gold_direct) AS BIGINT) AS gold_direct, CAST(sum(missed_direct) AS BIGINT) AS missed_direct, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp FROM ({SETS}))"""
QUERIES["pool_summary"] = lambda spark, sf: s.pool(sets(spark, sf))
SQL["pool_summary"] = _POOL


def gate_verdict(spark, sf_dir):
    """The gate over the pooled sets and the calibration error of the labelled scores."""
    error = c.ece(scores(spark, sf_dir)).select(F.round("ece", 9).alias("ece"))
    return s.gate(s.pool(sets(spark, sf_dir)).crossJoin(error))


QUERIES["gate_verdict"] = gate_verdict
_CHECKS = {"direct_recall": "direct_recall >= 0.98", "precision": "precision >= 0.90", "ece": "ece <= 0.05", "f1": "f1 > 0.889"}
SQL["gate_verdict"] = f"WITH x AS (SELECT * FROM ({_POOL}), ({SQL['ece']})), r AS (" + " UNION ALL ".join(f"SELECT '{k}' AS \"check\", CASE WHEN {k} IS NULL THEN 'INCOMPLETE' WHEN {v} THEN 'PASS' ELSE 'FAIL' END AS result FROM x" for k, v in _CHECKS.items()) + ") SELECT * FROM r UNION ALL SELECT 'overall', CASE WHEN count(CASE WHEN result = 'FAIL' THEN 1 END) > 0 THEN 'FAIL' WHEN count(CASE WHEN result = 'INCOMPLETE' THEN 1 END) > 0 THEN 'INCOMPLETE' ELSE 'PASS' END FROM r"

_KN = "SELECT o_custkey AS cust, count(CASE WHEN o_orderkey % 3 = 0 THEN 1 END) AS k, count(*) AS n FROM orders GROUP BY o_custkey"


def wilson(spark, sf_dir):
    counts = spark.sql(_KN.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return counts.select("cust", "k", "n", s.wilson(F.col("k"), F.col("n")).alias("w")).select("cust", "k", "n", "w.low", "w.high")


QUERIES["wilson"] = wilson
_HALF = "1.959964 * sqrt((k / n) * (1 - k / n) / n + 1.959964 * 1.959964 / (4 * n * n)) / (1 + 1.959964 * 1.959964 / n)"
_MID = "((k / n) + 1.959964 * 1.959964 / (2 * n)) / (1 + 1.959964 * 1.959964 / n)"
SQL["wilson"] = f"SELECT cust, k, n, round(greatest(0.0, {_MID} - {_HALF}), 4) AS low, round(least(1.0, {_MID} + {_HALF}), 4) AS high FROM ({_KN})"


def percentiles(spark, sf_dir):
    """Both percentiles of document lengths, nearest rank and index."""
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("n_chars").alias("value"))
    near = [s.percentile_nearest(n, q).select(F.lit("nearest").alias("kind"), F.lit(q).alias("q"), "value") for q in (0.5, 0.95)]
    index = [s.percentile_index(n, q).select(F.lit("index").alias("kind"), F.lit(q).alias("q"), "value") for q in (0.5, 0.95)]
    return near[0].unionByName(near[1]).unionByName(index[0]).unionByName(index[1])


QUERIES["percentiles"] = percentiles
SQL["percentiles"] = "WITH v AS (SELECT list(n_chars ORDER BY n_chars) AS v FROM documents) " + " UNION ALL ".join(
    f"SELECT '{k}' AS kind, CAST({q} AS DOUBLE) AS q, v[{e.format(q=q)}] AS value FROM v" for k, e in (("nearest", "CAST(greatest(ceil(len(v) * {q}), 1) AS INT)"), ("index", "CAST(least(floor(len(v) * {q}) + 1, len(v)) AS INT)")) for q in (0.5, 0.95))


def held_out_filter(spark, sf_dir):
    """Documents that are no benchmark item, for training."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return docs.join(items.select("text"), "text", "left_anti").select("doc_id")


QUERIES["held_out_filter"] = held_out_filter
SQL["held_out_filter"] = "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)"
