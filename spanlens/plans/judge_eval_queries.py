"""Queries for the judge by itself: order bias, what became of candidates of known truth, and the guard of a refit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as e
from ..operators.calibration import Isotonic
from .metric_queries import LABELS

QUERIES: dict = {}
SQL: dict[str, str] = {}

_OPTIONS = ("dob", "name", "none", "phone")
_MASS = "(o_orderkey * 7 + order_idx * 13 + opt * 29 + (o_orderkey * opt) % 17) % 11 + 1"
_SIZE = "3 + o_orderkey % 4"


def order_flips(spark, sf_dir):
    """Answers to each order's candidate in three to six orders of four options."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.explode(F.expr(f"sequence(0, CAST({_SIZE} AS INT) - 1)")).alias("order_idx"))
    masses = orders.withColumn("masses", F.expr(f"transform(sequence(0, {len(_OPTIONS) - 1}), opt -> CAST({_MASS} AS DOUBLE))"))  # of one answer, so its total needs no shuffle
    each = masses.withColumn("total", F.expr("aggregate(masses, CAST(0 AS DOUBLE), (a, x) -> a + x)")).select("*", F.posexplode(F.array(*map(F.lit, _OPTIONS))).alias("opt", "option"))
    shares = each.select(F.col("o_orderkey").alias("candidate"), "order_idx", "option", (F.get("masses", F.col("opt")) / F.col("total")).alias("share"))
    return e.order_bias(shares)


QUERIES["order_flips"] = order_flips
SQL["order_flips"] = f"""WITH c AS (SELECT o_orderkey, unnest(range(CAST({_SIZE} AS BIGINT))) AS order_idx FROM orders), m AS (SELECT c.*, opt, ['dob', 'name', 'none', 'phone'][opt + 1] AS option, CAST({_MASS} AS DOUBLE) AS mass FROM c, range(4) r(opt)),
s AS (SELECT o_orderkey, order_idx, option, mass / sum(mass) OVER (PARTITION BY o_orderkey, order_idx) AS share, list_contains(CASE {_SIZE} WHEN 3 THEN [0, 1, 2] WHEN 4 THEN [0, 1, 2, 3] WHEN 5 THEN [0, 1, 2, 4] ELSE [0, 2, 3, 4] END, order_idx) AS few FROM m),
o AS (SELECT o_orderkey, option, avg(share) AS p, max(share) FILTER (order_idx = 0) AS one, avg(share) FILTER (few) AS few, max(share) - min(share) AS move FROM s GROUP BY ALL),
k AS (SELECT o_orderkey, list(option ORDER BY round(p, 12) DESC, option)[1] AS best, list(option ORDER BY round(one, 12) DESC, option)[1] AS best_one, list(option ORDER BY round(few, 12) DESC, option)[1] AS best_few, max(move) AS move,
  max(abs(one - p)) FILTER (option = 'none') AS d_one, max(abs(few - p)) FILTER (option = 'none') AS d_few FROM o GROUP BY o_orderkey)
SELECT count(*) AS n, round(avg(move), 4) AS mean_choice_spread, round(count_if(best_one <> best) / count(*), 4) AS argmax_flip_single_order, round(count_if(best_few <> best) / count(*), 4) AS argmax_flip_4_rotations,
  round(avg(d_one), 4) AS mean_abs_dp_none_single, round(avg(d_few), 4) AS mean_abs_dp_none_4_rot FROM k"""

_JUDGED = f"""SELECT o_orderkey % 3 <> 0 AS is_pii, CASE WHEN o_orderkey % 3 <> 0 THEN {LABELS} END AS label, CASE WHEN o_orderkey % 5 = 0 THEN 'name' WHEN o_orderkey % 11 = 0 THEN NULL ELSE {LABELS} END AS category,
CASE o_orderkey % 4 WHEN 0 THEN 'not_identifier' WHEN 1 THEN 'review' ELSE 'identifier' END AS decision, CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 0.5 END AS confidence, o_orderkey % 13 = 0 AS fast_path,
CASE o_orderkey % 6 WHEN 1 THEN 'failed' WHEN 3 THEN 'cell+weak' ELSE '' END AS why FROM orders"""


def judged(spark, sf_dir):
    rows = spark.sql(_JUDGED.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return rows.withColumn("reasons", F.filter(F.split("why", "[+]"), lambda w: w != ""))


_NEAR = ", ".join(f"'{x}'" for x in e.IDENTIFIERS)
QUERIES["judge_summary"] = lambda spark, sf: e.judge_summary(judged(spark, sf))
SQL["judge_summary"] = f"""WITH r AS ({_JUDGED}), c AS (SELECT count(*) AS n, count_if(is_pii) AS g, count_if(NOT is_pii) AS d, count_if(confidence IS NULL) AS f, count_if(fast_path) AS fast, count_if(is_pii AND decision <> 'not_identifier') AS kept,
  count_if(is_pii AND label IN ({_NEAR})) AS near, count_if(is_pii AND label IN ({_NEAR}) AND decision <> 'not_identifier') AS near_kept, count_if(is_pii AND decision = 'identifier') AS r, count_if(decision = 'identifier') AS a,
  count_if(decision <> 'not_identifier') AS s, count_if(NOT is_pii AND decision = 'not_identifier') AS x, count_if(decision = 'review') AS v, count_if(is_pii AND category = label) AS o FROM r)
SELECT CAST(n AS BIGINT) AS n, CAST(g AS BIGINT) AS n_gold, CAST(d AS BIGINT) AS n_decoy, CAST(f AS BIGINT) AS n_failed, CAST(fast AS BIGINT) AS n_fast, round(kept / g, 4) AS recall_flagged, round(near_kept / near, 4) AS recall_flagged_direct,
  round(r / g, 4) AS recall_auto, round(r / a, 4) AS precision_auto, round(kept / s, 4) AS precision_flagged, round(x / d, 4) AS decoy_dropped, round(v / n, 4) AS review_rate, round(o / g, 4) AS category_acc_gold FROM c"""
QUERIES["review_reasons"] = lambda spark, sf: e.review_reasons(judged(spark, sf))
SQL["review_reasons"] = f"SELECT CASE WHEN is_pii THEN 'gold:' ELSE 'decoy:' END || CASE WHEN why = '' THEN 'error' ELSE why END AS kind, count(*) AS n FROM ({_JUDGED}) WHERE decision = 'review' GROUP BY 1"

_STEPS = Isotonic((0.25, 0.5, 0.75), (0.1, 0.45, 0.9))
_P = "CAST(o_orderkey % 1000 AS DOUBLE) / 1000"
_CONF = f"CASE WHEN {_P} <= 0.25 THEN 0.1 WHEN {_P} <= 0.5 THEN 0.45 ELSE 0.9 END"
_RUN = f"""SELECT 'name' AS category, {_P} AS p_identifier, 0.9 AS category_p, CASE WHEN o_orderkey % 1000 = 500 THEN 0.9 WHEN o_orderkey % 41 = 0 THEN 0.33 ELSE {_CONF} END AS confidence,
CASE WHEN o_orderkey % 37 = 0 THEN 'review' WHEN {_P} <= 0.25 THEN 'not_identifier' WHEN {_P} <= 0.5 THEN 'review' ELSE 'identifier' END AS decision, o_orderkey % 7 = 0 AS fast_path FROM orders"""


def replay_guard(spark, sf_dir):
    """How many of a run's judgments a replay of its calibration gives otherwise, and how many only by their rounding at a step."""
    rows = spark.sql(_RUN.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet")).withColumn("sources", F.array(F.lit("ner")))
    return e.replay_check(rows, _STEPS, 0.3, 0.8, 0.5)


QUERIES["replay_guard"] = replay_guard
SQL["replay_guard"] = f"""WITH r AS ({_RUN}), c AS (SELECT *, CASE WHEN p_identifier <= 0.25 THEN 'not_identifier' WHEN p_identifier <= 0.5 THEN 'review' ELSE 'identifier' END <> decision AS other,
  abs(confidence - CASE WHEN p_identifier <= 0.25 THEN 0.1 WHEN p_identifier <= 0.5 THEN 0.45 ELSE 0.9 END) > 0.000101 AS moved,
  (p_identifier IN (0.25, 0.5, 0.75) AND confidence = CASE p_identifier WHEN 0.25 THEN 0.45 ELSE 0.9 END) AS edge FROM r WHERE NOT fast_path)
SELECT count(*) AS rows, count_if(other OR (moved AND NOT edge))::BIGINT AS changed, count_if(NOT other AND moved AND edge)::BIGINT AS at_edges FROM c"""
