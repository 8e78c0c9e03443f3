"""Queries for the certain spans and the whole engine, with a scripted backend in place of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import certain, engine
from .detect_queries import _orders

QUERIES: dict = {}
SQL: dict[str, str] = {}

_D = "lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0')"
LEAD = "CASE o_orderkey % 9 WHEN 0 THEN 'Singapore ' WHEN 1 THEN 'MRN: ' WHEN 2 THEN 'a/c no. ' WHEN 3 THEN 'Lab No ' WHEN 4 THEN 'see ' WHEN 5 THEN 'see ' WHEN 6 THEN 'see ' WHEN 7 THEN 'IC ' ELSE 'value ' END"
SPAN = f"CASE o_orderkey % 9 WHEN 0 THEN {_D} WHEN 1 THEN {_D} WHEN 2 THEN {_D} || '123' WHEN 3 THEN 'AB-' || {_D} WHEN 4 THEN 'u' || {_D} || '@x.org' WHEN 5 THEN 'https://x.org/' || {_D} WHEN 6 THEN 'HS26-' || {_D} WHEN 7 THEN 'X' || {_D} ELSE 'word' END"


def rule_certain(spark, sf_dir):
    """Which code is sure, by shape or by the words before."""
    rows = _orders(spark, sf_dir, lead=LEAD, span=SPAN).withColumn("text", F.concat("lead", "span", F.lit(" end")))
    start = F.char_length("lead") + 1
    sure = certain.rule_certain(F.col("text"), start, start + F.char_length("span") - 1)
    return rows.select("row", "text", sure.alias("s")).select("row", "text", "s.identifier", "s.reason")


QUERIES["rule_certain"] = rule_certain
SQL["rule_certain"] = f"""SELECT row, lead || span || ' end' AS text,
CASE k WHEN 0 THEN 'postal_code' WHEN 1 THEN 'mrn' WHEN 2 THEN 'other_id' WHEN 3 THEN 'other_id' WHEN 4 THEN 'email' WHEN 5 THEN 'other_id' WHEN 6 THEN 'other_id' WHEN 7 THEN 'national_id' END AS identifier,
CASE k WHEN 0 THEN 'postal_keyword' WHEN 1 THEN 'id_keyword' WHEN 2 THEN 'account_keyword' WHEN 3 THEN 'ref_keyword' WHEN 4 THEN 'email_shape' WHEN 5 THEN 'url_shape' WHEN 6 THEN 'accession_shape' WHEN 7 THEN 'id_keyword' END AS reason
FROM (SELECT o_orderkey AS row, o_orderkey % 9 AS k, {LEAD} AS lead, {SPAN} AS span FROM orders)"""


def scripted(questions: DataFrame) -> DataFrame:
    """A backend that finds the likeliest option by a hash: the same answer for a span in every order."""
    mass = F.pmod(F.xxhash64("match", "option"), F.lit(100)) + F.when(F.col("option") == "none", 20).otherwise(1)
    token = F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("position") + 1, F.lit(1))
    return questions.select("candidate", "order_idx", token.alias("token"), (mass / 1000).alias("prob"))


def engine_scan(spark, sf_dir):
    """Span records of the documents under the scripted backend."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("row"), "text", F.lit(None).cast("string").alias("column"))
    out = engine.scan(rows, scripted)
    return out.select("row", "span_start", "span_end", "match", "type", "identifier", "decision", "confidence", F.array_join("reasons", ",").alias("reasons"), F.array_join("sources", "+").alias("sources"), "fast_path")


QUERIES["engine_scan"] = engine_scan
