"""Queries for option families, readout, decisions, overrides, resolution, policy and odd dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import judge as j
from ..operators import spans as s
from .detect_queries import CELL, WRITTEN, _orders

QUERIES: dict = {}
SQL: dict[str, str] = {}

# --- families, options, rotations ---

SHAPE = f"CASE o_orderkey % 11 WHEN 0 THEN '3/' || CAST(o_orderkey % 50 AS STRING) WHEN 1 THEN 'a' || CAST(o_orderkey AS STRING) || '@x.org' WHEN 2 THEN 'Blk ' || CAST(o_orderkey % 900 AS STRING) || ' Road' WHEN 3 THEN 'Some Name' WHEN 4 THEN CAST(o_orderkey AS STRING) || ' 12' WHEN 5 THEN {WRITTEN} WHEN 6 THEN 'l' || CAST(o_orderkey % 9 + 1 AS STRING) || '.O3.199' || CAST(o_orderkey % 10 AS STRING) ELSE {CELL} END"


def family_query(spark, sf_dir):
    return _orders(spark, sf_dir, value=SHAPE).select("row", "value", j.family_of(F.col("value")).alias("family"))


QUERIES["family_of"] = family_query
_DATE = r"regexp_matches(value, '^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}$') OR regexp_matches(value, '^\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2}$')"
_OCR = r"regexp_full_match(value, '[0-9lIOo]{1,2}[./-][0-9lIOo]{1,2}[./-]([0-9lIOo]{4}|[0-9lIOo]{2})') AND regexp_matches(value, '[lIOo]') AND CAST(string_split_regex(translate(value, 'lIOo', '1100'), '[./-]')[1] AS INT) BETWEEN 1 AND 31 AND CAST(string_split_regex(translate(value, 'lIOo', '1100'), '[./-]')[2] AS INT) BETWEEN 1 AND 12"
_REAL = " OR ".join(f"year(try_strptime(value, '{f}')) BETWEEN 1900 AND 2100" for f in ("%Y%m%d", "%d%m%Y", "%m%d%Y"))
SQL["family_of"] = rf"""SELECT row, value, CASE WHEN {_DATE} OR ({_OCR}) THEN 'date' WHEN regexp_full_match(value, '\d{{1,3}}/\d{{1,3}}') THEN 'fraction' WHEN contains(value, '@') THEN 'code'
WHEN regexp_full_match(value, '\d{{8}}') AND ({_REAL}) THEN 'numeric' WHEN NOT regexp_matches(value, '\d') THEN 'text' WHEN regexp_matches(value, '[A-Za-z]{{3,}}') THEN 'alnum' WHEN regexp_matches(value, '\s') THEN 'numeric' ELSE 'code' END AS family
FROM (SELECT o_orderkey AS row, {SHAPE} AS value FROM orders)"""

_FAMILIES = "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {i}, '{o}')" for f, options in j.FAMILIES.items() for i, o in enumerate(options)) + ") AS t(family, position, option)"
QUERIES["choice_options"] = lambda spark, sf: family_query(spark, sf).join(j.options_table(spark), "family").select("row", "family", "position", "option")
SQL["choice_options"] = f"SELECT row, f.family, position, option FROM ({SQL['family_of']}) v JOIN ({_FAMILIES}) f ON f.family = v.family"

QUERIES["rotations"] = lambda spark, sf: _orders(spark, sf, n="CAST(o_orderkey % 22 + 1 AS INT)").select("row", "n", F.posexplode(j.rotations(F.col("n"), F.lit(4))).alias("order_idx", "shift"))
SQL["rotations"] = "SELECT row, n, CAST(i AS INT) AS order_idx, CAST(round_even(i * n / least(4, n), 0) AS INT) AS shift FROM (SELECT o_orderkey AS row, CAST(o_orderkey % 22 + 1 AS INT) AS n FROM orders), range(0, 4) u(i) WHERE i < least(4, n)"

# --- answers ---

CAND = "doc_id AS candidate, CASE doc_id % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'fraction' WHEN 2 THEN 'text' ELSE 'code' END AS family"
WEIGHT = "((candidate * 7 + order_idx * 13 + position * 29) % 100 + 1) * CASE WHEN (candidate + position) % 3 = 0 THEN 4 ELSE 1 END"
TOKEN = "CASE (candidate + position) % 3 WHEN 0 THEN ' ' || letter WHEN 1 THEN letter || ')' ELSE lower(letter) || '.' END"


def answered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions and answers for each labelled document; the options' weights stand in for a model."""
    cands = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr(*[f"{x}" for x in ("doc_id AS candidate", CAND.split(", ", 1)[1])])
    shown = j.order_rows(cands)
    lettered = shown.selectExpr("*", "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', position + 1, 1) AS letter")
    return shown, lettered.selectExpr("candidate", "order_idx", f"{TOKEN} AS token", f"CAST({WEIGHT} AS DOUBLE) / 1000 AS prob")


QUERIES["judge_readout"] = lambda spark, sf: j.readout(*answered(spark, sf)).select("candidate", "option", *[F.round(x, 9).alias(x) for x in ("prob", "spread", "min_mass")], "failed")
_READ = f"""WITH f AS ({_FAMILIES}), n AS (SELECT family, count(*) AS n FROM f GROUP BY family), c AS (SELECT {CAND} FROM labels),
o AS (SELECT candidate, c.family, i AS order_idx, n, CAST(round_even(i * n / least(4, n), 0) AS INT) AS shift FROM c JOIN n ON c.family = n.family, range(0, 4) u(i) WHERE i < least(4, n)),
w AS (SELECT o.candidate, o.order_idx, f.option, CAST({WEIGHT.replace('position', 'x.position')} AS DOUBLE) / 1000 AS m FROM (SELECT o.*, unnest(range(0, n)) AS position FROM o) x JOIN o ON o.candidate = x.candidate AND o.order_idx = x.order_idx JOIN f ON f.family = x.family AND f.position = (x.position + x.shift) % x.n)""".replace("SELECT o.candidate, o.order_idx, f.option", "SELECT x.candidate, x.order_idx, f.option").replace("(candidate * 7 + order_idx * 13", "(x.candidate * 7 + x.order_idx * 13").replace("(candidate + x.position)", "(x.candidate + x.position)").replace(" JOIN o ON o.candidate = x.candidate AND o.order_idx = x.order_idx", "")
_READ += """, t AS (SELECT candidate, order_idx, sum(m) AS total FROM w GROUP BY 1, 2), e AS (SELECT w.candidate, w.order_idx, option, m / total AS share, total FROM w JOIN t ON w.candidate = t.candidate AND w.order_idx = t.order_idx),
a AS (SELECT candidate, option, avg(share) AS prob, max(share) - min(share) AS move FROM e GROUP BY 1, 2), z AS (SELECT candidate, min(total) AS min_mass FROM t GROUP BY 1), v AS (SELECT candidate, max(move) AS spread FROM a GROUP BY 1),
r AS (SELECT a.candidate, option, CASE WHEN min_mass >= 0.5 THEN prob END AS prob, CASE WHEN min_mass >= 0.5 THEN spread END AS spread, min_mass, min_mass < 0.5 AS failed FROM a JOIN z ON a.candidate = z.candidate JOIN v ON a.candidate = v.candidate)"""
SQL["judge_readout"] = _READ + " SELECT candidate, option, round(prob, 9) AS prob, round(spread, 9) AS spread, round(min_mass, 9) AS min_mass, failed FROM r"


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = j.choice(j.readout(*answered(spark, sf_dir)))
    reasons = F.when(F.col("candidate") % 10 == 0, F.array(F.lit("given"))).otherwise(F.array().cast("array<string>"))
    return picked.withColumn("d", j.decide(F.col("p_identifier"), F.col("category_p"), reasons, 0.3, 0.7, 0.5))


QUERIES["judge_decide"] = lambda spark, sf: decided(spark, sf).select("candidate", "category", F.round("p_identifier", 6).alias("p_identifier"), "d.decision", F.array_join("d.reasons", ",").alias("reasons"))
_RANKED = "CASE option " + " ".join(f"WHEN '{o}' THEN {i}" for i, o in enumerate(j.FAMILIES["all"])) + " END"
_DECIDE = _READ + f""", b AS (SELECT candidate, option AS category, prob AS category_p, row_number() OVER (PARTITION BY candidate ORDER BY prob DESC NULLS LAST, {_RANKED}) AS k, failed FROM r),
d AS (SELECT b.candidate, CASE WHEN NOT b.failed THEN category END AS category, category_p, round(1 - x.prob, 6) AS p, b.candidate % 10 = 0 AS given FROM b JOIN (SELECT candidate, prob FROM r WHERE option = 'none') x ON b.candidate = x.candidate WHERE k = 1)"""
_VERDICT = "CASE WHEN NOT given AND p < 0.3 THEN 'not_identifier' WHEN NOT given AND p >= 0.7 AND category_p >= 0.5 THEN 'identifier' ELSE 'review' END"
SQL["judge_decide"] = _DECIDE + f""" SELECT candidate, category, p AS p_identifier, {_VERDICT} AS decision,
CASE WHEN {_VERDICT} = 'review' THEN concat_ws(',', CASE WHEN given THEN 'given' END, CASE WHEN p >= 0.3 AND p < 0.7 THEN 'uncertain' END, CASE WHEN category_p < 0.5 THEN 'category_uncertain' END) ELSE '' END AS reasons FROM d"""

SOURCES = "CASE candidate % 5 WHEN 0 THEN 'rule:mrn+shape:id' WHEN 1 THEN 'shape:token' WHEN 2 THEN 'shape:id+shape:slot' WHEN 3 THEN 'lexicon:genetic' ELSE 'shape:name' END"


def veto(spark, sf_dir):
    rows = decided(spark, sf_dir).selectExpr("candidate", "category", "d.decision", f"split({SOURCES}, '[+]') AS sources")
    out = j.overridden(F.col("decision"), F.col("category"), F.col("sources"), F.lit(None).cast("string"))
    return rows.withColumn("o", out).select("candidate", F.col("o.decision").alias("decision"), F.coalesce("o.reason", F.lit("")).alias("reason"))


QUERIES["fail_closed_veto"] = veto
SQL["fail_closed_veto"] = _DECIDE + f""", y AS (SELECT candidate, category, {_VERDICT} AS d, CASE candidate % 5 WHEN 0 THEN 'rule:mrn' WHEN 2 THEN 'shape:slot' END AS src FROM d)
SELECT candidate, CASE WHEN d = 'not_identifier' AND src IS NOT NULL THEN 'review' WHEN candidate % 5 = 1 AND coalesce(category NOT IN ('name', 'address'), true) THEN 'not_identifier' ELSE d END AS decision,
CASE WHEN d = 'not_identifier' AND src IS NOT NULL THEN 'fail_closed:' || src ELSE '' END AS reason FROM y"""

HEAD = "CASE o_custkey % 4 WHEN 0 THEN 'ward' WHEN 1 THEN 'AdmitDate' WHEN 2 THEN 'DOB' ELSE '' END"


def cells(spark, sf_dir):
    rows = _orders(spark, sf_dir, value=CELL, head=HEAD, odd="o_orderkey % 13 = 0")
    reason = j.cell_reason(F.col("value"), j.family_of(F.col("value")), F.col("head"), F.lit(True), F.col("odd"))
    return rows.select("row", "value", "head", F.coalesce(reason, F.lit("")).alias("reason"))


QUERIES["cell_review"] = cells
SQL["cell_review"] = rf"""SELECT row, value, head, CASE WHEN head = '' THEN '' WHEN odd THEN 'column_outlier' WHEN {_DATE} OR (regexp_full_match(value, '\d{{8}}') AND ({_REAL})) THEN CASE WHEN head = 'ward' THEN 'misplaced_date' ELSE '' END
WHEN length(regexp_replace(value, '[^0-9]', '', 'g')) >= 5 THEN 'cell_id_shape' ELSE '' END AS reason FROM (SELECT o_orderkey AS row, {CELL} AS value, {HEAD} AS head, o_orderkey % 13 = 0 AS odd FROM orders)"""

HEADERS = ("DOB", "DateOfBirth", "date_of_death", "DOD", "Admitted", "birth place", "Deceased on", "ward", "robin", "born")
_HEADER = f"CASE o_orderkey % {len(HEADERS)} " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADERS)) + " END || CASE o_orderkey % 3 WHEN 0 THEN '_' || CAST(o_orderkey AS STRING) WHEN 1 THEN ' (' || CAST(o_orderkey % 9 AS STRING) || ')' ELSE 's' END"
QUERIES["date_columns"] = lambda spark, sf: _orders(spark, sf, head=_HEADER).select("row", "head", j.date_column_identifier(F.col("head")).alias("identifier"))
_SPLIT = "regexp_replace(head, '([a-z])([A-Z])', '\\1 \\2', 'g')"
SQL["date_columns"] = f"SELECT row, head, CASE WHEN regexp_matches({_SPLIT}, '(?i)(?:^|[^a-z])(?:dod|death|died|deceased)(?:[^a-z]|$)') THEN 'date_of_death' WHEN regexp_matches({_SPLIT}, '(?i)(?:^|[^a-z])(?:dob|d\\.o\\.b|birth|born)(?:[^a-z]|$)') THEN 'dob' END AS identifier FROM (SELECT o_orderkey AS row, {_HEADER} AS head FROM orders)"


# --- spans ---

JUDGED = "SELECT o_custkey AS row, o_orderkey AS idx, CAST((o_orderkey * 37) % 60 + 1 AS INT) AS span_start, CAST((o_orderkey * 37) % 60 + 1 + (o_orderkey * 13) % 30 AS INT) AS span_end, CASE o_orderkey % 3 WHEN 0 THEN 'identifier' WHEN 1 THEN 'review' ELSE 'not_identifier' END AS decision FROM orders"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(JUDGED.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


QUERIES["resolve_spans"] = lambda spark, sf: s.resolve(judged(spark, sf))
SQL["resolve_spans"] = f"""WITH j AS (SELECT *, CASE decision WHEN 'identifier' THEN 2 WHEN 'review' THEN 1 ELSE 0 END AS r FROM ({JUDGED}))
SELECT row, idx, span_start, span_end, decision FROM j a WHERE NOT EXISTS (SELECT 1 FROM j b WHERE a.row = b.row AND b.span_start <= a.span_start AND a.span_end <= b.span_end
  AND (-b.r, -(b.span_end - b.span_start), b.span_start, b.idx) < (-a.r, -(a.span_end - a.span_start), a.span_start, a.idx))"""


def pruned(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return s.outside(rows.where("decision <> 'identifier'"), rows.where("decision = 'identifier'"))


QUERIES["containment_pruning"] = pruned
SQL["containment_pruning"] = f"WITH j AS ({JUDGED}) SELECT * FROM j a WHERE decision <> 'identifier' AND NOT EXISTS (SELECT 1 FROM j b WHERE b.decision = 'identifier' AND a.row = b.row AND b.span_start <= a.span_start AND a.span_end <= b.span_end AND b.span_end - b.span_start > a.span_end - a.span_start)"

TYPE = "CASE o_orderkey % 5 WHEN 0 THEN 'nric' WHEN 1 THEN 'date' WHEN 2 THEN 'url' WHEN 3 THEN 'odd' ELSE NULL END"
_PROBS = "CASE WHEN o_orderkey % 4 = 0 THEN map('phone', 0.25D, 'mrn', 0.25D, 'none', 0.5D) WHEN o_orderkey % 4 = 1 THEN map('none', 1.0D) END"


def fallback(spark, sf_dir):
    rows = _orders(spark, sf_dir, type=TYPE, decision="CASE WHEN o_orderkey % 3 = 0 THEN 'identifier' ELSE 'review' END", identifier="CASE WHEN o_orderkey % 7 = 0 THEN 'name' END", probs=_PROBS)
    return rows.select("row", "decision", s.fallback_identifier(F.col("decision"), F.col("identifier"), F.col("probs"), F.col("type")).alias("identifier"))


QUERIES["record_fallback"] = fallback
SQL["record_fallback"] = f"""SELECT row, decision, CASE WHEN decision = 'review' AND identifier IS NULL THEN CASE WHEN row % 4 = 0 THEN 'mrn' ELSE CASE type WHEN 'nric' THEN 'national_id' WHEN 'date' THEN 'dob' WHEN 'url' THEN 'other_id' ELSE type END END ELSE identifier END AS identifier
FROM (SELECT o_orderkey AS row, {TYPE} AS type, CASE WHEN o_orderkey % 3 = 0 THEN 'identifier' ELSE 'review' END AS decision, CASE WHEN o_orderkey % 7 = 0 THEN 'name' END AS identifier FROM orders)"""

POLICY = {"rules": {
    "nric": {"action": "remove"}, "dob": {"action": "generalize", "method": "year"}, "other_id": {"action": "flag", "options": ["remove", "retain"]},
    "postal_code": {"by": "property_kind", "cases": {"hdb": {"action": "generalize", "method": "sector"}, "landed": {"action": "remove"}}, "unknown": {"action": "pseudonymize"}},
}}
_PT = "CASE o_orderkey % 5 WHEN 0 THEN 'nric' WHEN 1 THEN 'date' WHEN 2 THEN 'url' WHEN 3 THEN 'postal' ELSE 'name' END"
_PI = "CASE o_orderkey % 5 WHEN 0 THEN 'national_id' WHEN 1 THEN 'dob' WHEN 2 THEN 'other_id' WHEN 3 THEN 'postal_code' ELSE 'name' END"
_KIND = "CASE o_custkey % 3 WHEN 0 THEN 'hdb' WHEN 1 THEN 'landed' ELSE 'condo' END"


def policy(spark, sf_dir):
    rows = _orders(spark, sf_dir, type=_PT, identifier=_PI, context=f"map('property_kind', {_KIND})")
    out = s.resolve_policy(rows, s.policy_table(spark, POLICY))
    return out.select("row", "type", "policy_key", "action", "method", F.coalesce(F.array_join("options", ","), F.lit("")).alias("options"), "needs_review")


QUERIES["policy_resolve"] = policy
SQL["policy_resolve"] = f"""SELECT row, type, CASE type WHEN 'nric' THEN 'nric' WHEN 'date' THEN 'dob' WHEN 'url' THEN 'other_id' WHEN 'postal' THEN 'postal_code' END AS policy_key,
CASE type WHEN 'nric' THEN 'remove' WHEN 'date' THEN 'generalize' WHEN 'postal' THEN CASE kind WHEN 'hdb' THEN 'generalize' WHEN 'landed' THEN 'remove' ELSE 'pseudonymize' END ELSE 'flag' END AS action,
CASE WHEN type = 'date' THEN 'year' WHEN type = 'postal' AND kind = 'hdb' THEN 'sector' END AS method, CASE type WHEN 'url' THEN 'remove,retain' WHEN 'name' THEN 'generalize,pseudonymize,remove,retain' ELSE '' END AS options,
type IN ('url', 'name') OR (type = 'postal' AND kind = 'condo') AS needs_review FROM (SELECT o_orderkey AS row, {_PT} AS type, {_KIND} AS kind FROM orders)"""


def outliers(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS row", "o_orderpriority AS column", "CASE WHEN o_orderkey % 97 = 0 THEN add_months(to_date(o_orderdate), -480) WHEN o_orderkey % 11 <> 0 THEN to_date(o_orderdate) END AS day", "true AS filled")
    return s.date_outliers(rows).select("row", "outlier")


QUERIES["date_outliers"] = outliers
SQL["date_outliers"] = """WITH c AS (SELECT o_orderkey AS row, o_orderpriority AS grp, datediff('day', DATE '1970-01-01', CASE WHEN o_orderkey % 97 = 0 THEN CAST(CAST(o_orderdate AS DATE) - INTERVAL 480 MONTH AS DATE) WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END) AS d FROM orders),
m AS (SELECT grp, median(d) AS med, count(d) AS n, count(*) AS filled FROM c GROUP BY grp), a AS (SELECT c.grp, median(abs(d - med)) AS mad FROM c JOIN m ON c.grp = m.grp GROUP BY c.grp)
SELECT row, coalesce(n >= 8 AND n >= 0.7 * filled AND abs(d - med) > greatest(mad * 3 * 1.4826, 730), false) AS outlier FROM c JOIN m ON c.grp = m.grp JOIN a ON c.grp = a.grp"""
