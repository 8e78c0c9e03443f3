"""Queries for the questions beside the choice and what they and rules add to a judgment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import questions as q
from ..operators.judge import readout
from .detect_queries import _orders

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Weights stand in for a model: each letter's mass follows from the candidate, the order and the place.
_WEIGHT = "CAST((candidate * 7 + order_idx * 13 + position * 29) % 100 + 1 AS DOUBLE) / {scale}"


def _answered(spark, sf_dir: str, options: tuple[str, ...], scale: int, **columns: str) -> DataFrame:
    cands = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id AS candidate", *[f"{e} AS {c}" for c, e in columns.items()])
    shown = q.both_ways(cands, options)
    answers = shown.selectExpr("candidate", "order_idx", f"substr('{q.LETTERS}', position + 1, 1) AS token", f"{_WEIGHT.format(scale=scale)} AS prob")
    return readout(shown.select("candidate", "order_idx", "position", "option"), answers)


def _read_sql(n: int, scale: int) -> str:
    """level (place of the option when shown forward), prob and least mass of the labelled documents under the same weights."""
    return f"""WITH w AS (SELECT candidate, order_idx, CASE order_idx WHEN 0 THEN position ELSE {n - 1} - position END AS level, {_WEIGHT.format(scale=scale)} AS m FROM (SELECT doc_id AS candidate, o AS order_idx, p AS position FROM labels, range(0, 2) t(o), range(0, {n}) u(p))),
t AS (SELECT candidate, order_idx, sum(m) AS total FROM w GROUP BY 1, 2), l AS (SELECT candidate, min(total) AS least FROM t GROUP BY 1),
r AS (SELECT w.candidate, level, avg(m / total) AS prob, min(least) AS least FROM w JOIN t ON w.candidate = t.candidate AND w.order_idx = t.order_idx JOIN l ON w.candidate = l.candidate GROUP BY 1, 2)"""


def harm(spark, sf_dir):
    """How sensitive each labelled document's span is; answers with too little mass have none."""
    return q.sensitivity(_answered(spark, sf_dir, q.HARM_LEVELS, 400))


QUERIES["judge_sensitivity"] = harm
SQL["judge_sensitivity"] = _read_sql(4, 400) + " SELECT candidate, CASE WHEN min(least) >= 0.5 THEN round(sum(level * prob) / 3, 4) END AS sensitivity FROM r GROUP BY candidate"


def agreement(spark, sf_dir):
    """Where the answer to yes or no is far from the choice, or failed."""
    read = _answered(spark, sf_dir, q.YES_NO, 150).where("option = 'yes'")
    p = (F.col("candidate") % 101) / 100
    why = lambda at: F.array_join(q.disagreement(F.col("prob"), p, at), ",")
    return read.select("candidate", F.round("prob", 9).alias("p_yes"), why(0.3).alias("reasons"), why(None).alias("unused"))


QUERIES["judge_agreement"] = agreement
SQL["judge_agreement"] = _read_sql(2, 150) + """, y AS (SELECT candidate, CASE WHEN least >= 0.5 THEN prob END AS p FROM r WHERE level = 0)
SELECT candidate, round(p, 9) AS p_yes, CASE WHEN p IS NULL THEN 'noul_failed' WHEN abs(p - (candidate % 101) / 100) >= 0.3 THEN 'choice_noul_disagree' ELSE '' END AS reasons, '' AS unused FROM y"""

_CATEGORY = "CASE o_orderkey % 7 WHEN 0 THEN 'dob' WHEN 1 THEN 'date_of_death' WHEN 2 THEN 'none' WHEN 3 THEN 'hiv_sti' WHEN 4 THEN 'name' WHEN 5 THEN 'other_sensitive' END"
_FAMILY = "CASE WHEN o_orderkey % 2 = 0 THEN 'date' ELSE 'text' END"
_SURE = "CAST(o_orderkey % 100 AS DOUBLE) / 100"
_TYPE = "CASE o_custkey % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'phone' END"
_SOURCES = "CASE o_orderkey % 5 WHEN 0 THEN 'shape:initials' WHEN 1 THEN 'lexicon:hiv_sti+shape:slot' WHEN 2 THEN 'shape:name' WHEN 3 THEN 'rule:date+shape:name_column' ELSE 'lexicon:genetic' END"
_MATCH = "CASE o_custkey % 4 WHEN 0 THEN 'SMN' WHEN 1 THEN 'known HIV infection' WHEN 2 THEN 'Prepared' ELSE 'her husband hit her' END"


def context(spark, sf_dir):
    """Sensitive calls on spans where a person stands, the group of the call, the role of a date."""
    rows = _orders(spark, sf_dir, category=_CATEGORY, family=_FAMILY, sure=_SURE, type=_TYPE, sources=f"split({_SOURCES}, '[+]')", match=_MATCH)
    fixed = rows.withColumn("named", q.name_in_slot(F.col("category"), F.col("type"), F.col("sources"), F.col("match")))
    return fixed.select("row", "match", "named", q.holds_sensitive_term(F.col("match")).alias("term"), q.group_of(F.col("named"), F.col("sources")).alias("grp"), q.date_role(F.col("named"), F.col("sure"), F.col("family")).alias("role"))


QUERIES["judge_context"] = context
SQL["judge_context"] = f"""SELECT row, match, named, term, CASE WHEN named IN ('hiv_sti', 'other_sensitive') THEN CASE WHEN contains(sources, 'lexicon:') THEN 'shi_lexicon' ELSE 'shi_other' END WHEN coalesce(named, 'none') <> 'none' THEN 'identifier' ELSE 'none' END AS grp,
CASE WHEN named IN ('dob', 'date_of_death') THEN CASE WHEN sure >= 0.6 THEN named ELSE 'unknown' END WHEN family = 'date' AND named = 'none' THEN CASE WHEN sure >= 0.6 THEN 'other' ELSE 'unknown' END END AS role
FROM (SELECT *, CASE WHEN category IN ('hiv_sti', 'other_sensitive') AND type = 'name' AND NOT term AND (contains(sources, 'shape:initials') OR contains(sources, 'shape:slot') OR contains(sources, 'shape:name_column')) THEN 'name' ELSE category END AS named
FROM (SELECT o_orderkey AS row, {_CATEGORY} AS category, {_FAMILY} AS family, {_SURE} AS sure, {_TYPE} AS type, {_SOURCES} AS sources, {_MATCH} AS match, o_custkey % 4 IN (1, 3) AS term FROM orders))"""

_PLACE = "CASE o_orderkey % 4 WHEN 0 THEN 'Blk 12 Hill Road' WHEN 1 THEN '8 Hill Road #03-12' WHEN 2 THEN '8 Hill Road' ELSE 'Block 7A' END"
_TOLD = "CASE o_custkey % 5 WHEN 0 THEN 'hdb' WHEN 1 THEN 'condo' WHEN 2 THEN 'landed' WHEN 3 THEN 'unknown' END"
_LIKELY = {"address": "CAST(o_orderkey % 11 AS DOUBLE) / 20", "postal": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 7 AS DOUBLE) / 20 END"}


def home(spark, sf_dir):
    """The kind of home that an address, or the line before a postal code, proves or an answer completes."""
    rows = _orders(spark, sf_dir, place=_PLACE, told=_TOLD, sure=_SURE, **_LIKELY).withColumn("text", F.concat("place", F.lit(", Singapore 560012")))
    span = lambda postal: (F.when(postal, F.char_length("text") - 5).otherwise(1), F.when(postal, F.char_length("text")).otherwise(F.char_length("place")))
    start, end = span(F.coalesce(F.col("postal") > F.col("address"), F.lit(False)))
    proved = rows.withColumn("proved", q.home_of(F.col("text"), start, end, F.col("address"), F.col("postal")))
    out = proved.withColumn("home", q.home_answered(F.col("proved"), F.col("told"), F.col("sure")))
    return out.select("row", "place", F.col("home.property_kind").alias("kind"), F.col("home.property_type").alias("type"))


QUERIES["judge_home"] = home
SQL["judge_home"] = f"""SELECT row, place, CASE WHEN known THEN CASE WHEN fits THEN told ELSE kind END END AS kind, CASE WHEN known THEN CASE WHEN fits THEN told_type ELSE type END END AS type
FROM (SELECT *, kind = 'unknown' AND coalesce(sure >= 0.6 AND told_type IS NOT NULL AND (type = 'unknown' OR type = told_type), false) AS fits
FROM (SELECT row, place, told, sure, coalesce(address, 0) + coalesce(postal, 0) >= 0.2 AS known, CASE WHEN place LIKE 'Bl%' THEN 'hdb' ELSE 'unknown' END AS kind, CASE WHEN place = '8 Hill Road' THEN 'unknown' ELSE 'non_landed' END AS type, CASE told WHEN 'hdb' THEN 'non_landed' WHEN 'condo' THEN 'non_landed' WHEN 'landed' THEN 'landed' END AS told_type
FROM (SELECT o_orderkey AS row, {_PLACE} AS place, {_TOLD} AS told, {_SURE} AS sure, {_LIKELY['address']} AS address, {_LIKELY['postal']} AS postal FROM orders)))"""
