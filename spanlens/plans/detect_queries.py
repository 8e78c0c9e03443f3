"""Queries for detectors and single values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import validators as v
from ..operators import detect
from .notes import D7, DAY, LETTER, NOTES_SQL, NRIC, notes

ALL = {d.name: d for d in detect.detectors(postal6=True)}

#: DuckDB's checks of a match m.
SQL_VALID = {
    "nric": "substr(upper(m), 9, 1) = CASE WHEN upper(m)[1] IN ('S', 'T') THEN substr('JZIHGFEDCBA', r + 1, 1) WHEN upper(m)[1] IN ('F', 'G') THEN substr('XWUTRQPNMLK', r + 1, 1) ELSE substr('KLJNPQRTUWX', 11 - r, 1) END",
    "date_compact": "regexp_full_match(m, '[0-9]{8}([ T][0-9]{6})?') AND (year(try_strptime(substr(m, 1, 8), '%Y%m%d')) BETWEEN 1900 AND 2100 OR year(try_strptime(substr(m, 1, 8), '%d%m%Y')) BETWEEN 1900 AND 2100 OR year(try_strptime(substr(m, 1, 8), '%m%d%Y')) BETWEEN 1900 AND 2100)",
    "ip": "len(list_filter(string_split(m, '.'), lambda o: CAST(o AS INT) > 255)) = 0",
    "creditcard": "list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (CAST(substr(d, CAST(i AS INT), 1) AS INT) * 2) % 10 + (CAST(substr(d, CAST(i AS INT), 1) AS INT) // 5) ELSE CAST(substr(d, CAST(i AS INT), 1) AS INT) END)) % 10 = 0",
}
SQL_LET = {
    "nric": "(CAST(m[2] AS INT) * 2 + CAST(m[3] AS INT) * 7 + CAST(m[4] AS INT) * 6 + CAST(m[5] AS INT) * 5 + CAST(m[6] AS INT) * 4 + CAST(m[7] AS INT) * 3 + CAST(m[8] AS INT) * 2 + CASE WHEN upper(m)[1] IN ('T', 'G') THEN 4 WHEN upper(m)[1] = 'M' THEN 3 ELSE 0 END) % 11 AS r",
    "creditcard": "regexp_replace(m, '[^0-9]', '', 'g') AS d",
}


def sql_spans(name: str, source: str, key: str = "row") -> str:
    """A detector's spans over source (key, text) in DuckDB: offsets from the gaps between matches."""
    d = ALL[name]
    pattern = "(?i)" + d.pattern
    if name in SQL_VALID:
        low = round(max(0.1, d.base - 0.4), 10)
        conf = f"CASE WHEN {SQL_VALID[name]} THEN 0.99 ELSE {low} END"
    else:
        conf = str(d.base)
    let = f", {SQL_LET[name]}" if name in SQL_LET else ""
    return f"""SELECT {key}, CAST(s AS INT) AS span_start, CAST(s + length(m) - 1 AS INT) AS span_end, m AS match, '{d.type}' AS type, '{d.identifier}' AS identifier, 'rule:{name}' AS detector, CAST({conf} AS DOUBLE) AS confidence
FROM (SELECT *{let} FROM (SELECT {key}, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: 1 + list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))) AS s
  FROM (SELECT {key}, regexp_extract_all(text, p, 0) AS ms, string_split_regex(text, p) AS gaps FROM (SELECT {key}, text, '{pattern}' AS p FROM ({source})))))"""


DOCS = "SELECT doc_id AS row, text FROM documents WHERE text IS NOT NULL"
PAGES = "SELECT page_id AS row, url AS text FROM pages WHERE url IS NOT NULL"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, text of documents; a file of fewer splits than there are cores is dealt to all of them."""
    rows, cores = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("row"), "text"), spark.sparkContext.defaultParallelism
    return rows.repartition(2 * cores) if rows.rdd.getNumPartitions() < cores else rows


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("row"), F.col("url").alias("text"))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _detector(name: str, source, source_sql: str) -> None:
    QUERIES[f"detect_{name}"] = lambda spark, sf: detect.flat(detect.scan_text(source(spark, sf), [ALL[name]]))
    SQL[f"detect_{name}"] = sql_spans(name, source_sql)


for _n in ("email", "ip", "creditcard"):
    _detector(_n, docs, DOCS)
_detector("url", pages, PAGES)
for _n in ("nric", "temp_ic", "case", "mrn", "passport", "postal", "postal6", "date", "date_compact"):
    _detector(_n, notes, NOTES_SQL)


#: Text with its delimiters doubled, so that two numbers may share one, and a number in it with what stands around.
DOUBLED, PHONE = r"regexp_replace(text, '([^0-9])', '\1\1', 'g')", r"(?:^|[^0-9])((?:(?:\+\+)?65(?:  |--)?)?[3689][0-9]{3}(?:  |--)?[0-9]{4})(?:$|[^0-9])"


def phone_spans(source: str) -> str:
    """sql_spans for phone numbers, whose pattern looks around, which RE2 cannot: places in the doubled text are taken back to places in the text."""
    return f"""SELECT row, CAST(o AS INT) AS span_start, CAST(o + length(m) - 1 AS INT) AS span_end, m AS match, 'phone' AS type, 'phone' AS identifier, 'rule:phone' AS detector, CAST({ALL['phone'].base} AS DOUBLE) AS confidence FROM (
  SELECT row, replace(replace(replace(g, '++', '+'), '  ', ' '), '--', '-') AS m, 1 + length(regexp_replace(pre, '[^0-9]', '', 'g')) + length(regexp_replace(pre, '[0-9]', '', 'g')) // 2 AS o FROM (
    SELECT row, g, substr(t, 1, CAST(s + instr(h, g) - 1 AS BIGINT)) AS pre FROM (
      SELECT row, t, unnest(hs) AS h, unnest(gs) AS g, unnest(list_transform(range(1, len(hs) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hs[1:i-1], lambda x: length(x))), 0))) AS s
      FROM (SELECT row, t, regexp_extract_all(t, p, 0) AS hs, regexp_extract_all(t, p, 1) AS gs, string_split_regex(t, p) AS gaps FROM (SELECT row, {DOUBLED} AS t, '{PHONE}' AS p FROM ({source}))))))"""


QUERIES["detect_phone"] = lambda spark, sf: detect.flat(detect.scan_text(notes(spark, sf), [ALL["phone"]]))
SQL["detect_phone"] = phone_spans(NOTES_SQL)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).withColumn("kind", F.lit("document")).unionByName(notes(spark, sf_dir).withColumn("kind", F.lit("note")))


def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shipped rules over documents and notes together."""
    return detect.flat(detect.scan_text(_rows(spark, sf_dir)))


def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, rows and mean confidence by kind and detector, of all shipped detectors."""
    return detect.flat(detect.scan_text(_rows(spark, sf_dir))).groupBy("kind", "detector").agg(
        F.count("*").alias("hits"), F.countDistinct("row").alias("n_rows"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


QUERIES |= {"scan_all": scan_all, "scan_summary": scan_summary}
_KINDS = (("document", DOCS), ("note", NOTES_SQL))
_BOTH = " UNION ALL ".join(f"SELECT '{kind}' AS kind, * FROM ({phone_spans(s) if d.name == 'phone' else sql_spans(d.name, s)})" for kind, s in _KINDS for d in detect.DETECTORS)
SQL["scan_all"] = _BOTH
SQL["scan_summary"] = f"SELECT kind, detector, count(*) AS hits, count(DISTINCT row) AS n_rows, round(avg(confidence), 6) AS mean_confidence FROM ({_BOTH}) GROUP BY kind, detector"


# --- single values ---

CELL = f"CASE o_orderkey % 6 WHEN 0 THEN {NRIC} WHEN 1 THEN replace({DAY}, '-', '') WHEN 2 THEN {D7} || 'K' WHEN 3 THEN 'AB' || {D7} WHEN 4 THEN CAST(o_orderkey % 400 AS STRING) || '.1.2.3' ELSE {DAY} END"


def _orders(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS row", *[f"{e} AS {n}" for n, e in columns.items()])


def nric_query(spark, sf_dir):
    return _orders(spark, sf_dir, value=NRIC).select("row", "value", v.nric_valid(F.col("value")).alias("valid"))


QUERIES["nric_valid"] = nric_query
SQL["nric_valid"] = f"SELECT o_orderkey AS row, {NRIC} AS value, {LETTER} <> 'Q' AS valid FROM orders"

CARD = "'4' || lpad(CAST((o_orderkey * 1234567) % 1000000000 AS STRING), 9, '0') || lpad(CAST((o_orderkey * 97) % 1000000 AS STRING), 6, '0')"


def luhn_query(spark, sf_dir):
    return _orders(spark, sf_dir, value=CARD).select("row", "value", v.luhn(F.col("value")).alias("valid"))


QUERIES["luhn_valid"] = luhn_query
SQL["luhn_valid"] = f"SELECT row, value, {SQL_VALID['creditcard']} AS valid FROM (SELECT o_orderkey AS row, {CARD} AS value, {CARD} AS d FROM orders)"

COMPACT = f"CASE o_orderkey % 4 WHEN 0 THEN replace({DAY}, '-', '') WHEN 1 THEN substr({DAY}, 9, 2) || substr({DAY}, 6, 2) || substr({DAY}, 1, 4) WHEN 2 THEN substr({DAY}, 6, 2) || substr({DAY}, 9, 2) || substr({DAY}, 1, 4) ELSE lpad(CAST((o_orderkey * 7907) % 100000000 AS STRING), 8, '0') END"


def compact_query(spark, sf_dir):
    return _orders(spark, sf_dir, value=COMPACT).select("row", "value", v.compact_date(F.col("value")).cast("string").alias("day"))


QUERIES["compact_date"] = compact_query
_try = lambda f: f"CASE WHEN year(try_strptime(value, '{f}')) BETWEEN 1900 AND 2100 THEN CAST(CAST(try_strptime(value, '{f}') AS DATE) AS STRING) END"
SQL["compact_date"] = f"SELECT row, value, coalesce({_try('%Y%m%d')}, {_try('%d%m%Y')}, {_try('%m%d%Y')}) AS day FROM (SELECT o_orderkey AS row, {COMPACT} AS value FROM orders)"

WRITTEN = f"CASE o_orderkey % 4 WHEN 0 THEN {DAY} WHEN 1 THEN substr({DAY}, 9, 2) || '/' || substr({DAY}, 6, 2) || '/' || substr({DAY}, 3, 2) WHEN 2 THEN substr({DAY}, 9, 2) || '.' || substr({DAY}, 6, 2) || '.' || substr({DAY}, 1, 4) ELSE 'n/a' END"


def parse_query(spark, sf_dir):
    return _orders(spark, sf_dir, value=WRITTEN).select("row", "value", v.parse_date(F.col("value")).cast("string").alias("day"))


QUERIES["parse_date"] = parse_query
SQL["parse_date"] = f"SELECT o_orderkey AS row, {WRITTEN} AS value, CASE WHEN o_orderkey % 4 < 3 THEN {DAY} END AS day FROM orders"

OCR = f"replace(replace(substr({DAY}, 9, 2) || '.' || substr({DAY}, 6, 2) || '.' || substr({DAY}, 1, 4), '1', CASE WHEN o_orderkey % 2 = 0 THEN 'l' ELSE '1' END), '0', CASE WHEN o_orderkey % 3 = 0 THEN 'O' ELSE '0' END)"


def ocr_query(spark, sf_dir):
    return _orders(spark, sf_dir, value=OCR).select("row", "value", v.ocr_date(F.col("value")).alias("day"))


QUERIES["ocr_date"] = ocr_query
SQL["ocr_date"] = f"SELECT row, value, CASE WHEN regexp_matches(value, '[lO]') AND length(regexp_replace(value, '[^0-9]', '', 'g')) >= 3 THEN replace(replace(value, 'l', '1'), 'O', '0') END AS day FROM (SELECT o_orderkey AS row, {OCR} AS value FROM orders)"

IP = "CAST(o_orderkey % 300 AS STRING) || '.' || CAST((o_orderkey * 7) % 270 AS STRING) || '.0.1'"


def ip_query(spark, sf_dir):
    return _orders(spark, sf_dir, value=IP).select("row", "value", v.ip_valid(F.col("value")).alias("valid"))


QUERIES["ip_valid"] = ip_query
SQL["ip_valid"] = f"SELECT o_orderkey AS row, {IP} AS value, o_orderkey % 300 <= 255 AND (o_orderkey * 7) % 270 <= 255 AS valid FROM orders"

_WHOLE = detect.detectors(postal6=True)
PHONE_CELL = f"CASE WHEN o_orderkey % 12 = 3 THEN '+65 9' || substr({D7}, 1, 3) || '-' || substr({D7}, 4, 4) ELSE {CELL} END"


def classify_query(spark, sf_dir):
    cells = _orders(spark, sf_dir, value=PHONE_CELL)
    return cells.select("row", "value", F.explode(detect.classify_value(F.col("value"), _WHOLE)).alias("detector", "confidence"))


QUERIES["classify_value"] = classify_query


def _sql_classify(d: detect.Detector) -> str:
    pattern = "(?i)" + d.pattern.removeprefix("(?<![0-9])").removesuffix("(?![0-9])")  # a whole value has nothing around it
    low = round(d.base - 0.4, 10)
    conf = f"CASE WHEN {SQL_VALID[d.name]} THEN 0.99 ELSE {low} END" if d.name in SQL_VALID else str(d.base)
    let = f", {SQL_LET[d.name]}" if d.name in SQL_LET else ""
    return f"SELECT row, m AS value, '{d.name}' AS detector, CAST({conf} AS DOUBLE) AS confidence FROM (SELECT *{let} FROM (SELECT row, value AS m FROM cells WHERE regexp_full_match(value, '{pattern}')))"


SQL["classify_value"] = f"WITH cells AS (SELECT o_orderkey AS row, {PHONE_CELL} AS value FROM orders) " + " UNION ALL ".join(map(_sql_classify, _WHOLE))


def dedup_query(spark, sf_dir):
    """Spans of each note without overlaps."""
    dets = detect.detectors(postal6=True)
    spans = detect.spans_of("text", dets)
    found = notes(spark, sf_dir).select("row", F.explode_outer(detect.dedup_overlaps(spans)).alias("span"))  # outer: a plain explode makes the optimiser compute the array once more, to see if it is empty
    return detect.flat(found.where("span IS NOT NULL"))


QUERIES["dedup_overlaps"] = dedup_query
