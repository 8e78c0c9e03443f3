"""Queries for tables lined up with blanks and for XML elements, over text composed from the star schema."""

from __future__ import annotations

from ..operators import layouts
from ..operators.layouts import LOGIN, NAME_VALUE, PEOPLE, REACH, STAFF, TITLE_LABEL, UPPER_LABEL
from .notes import customers

QUERIES: dict = {}
SQL: dict[str, str] = {}

KEY = "CAST(c_custkey AS STRING)"
PERSON = "CASE c_custkey % 5 WHEN 0 THEN 'Tan Ah Kow' WHEN 1 THEN 'Ong Bee' WHEN 2 THEN 'n/a 5' WHEN 3 THEN 'Lopez Maria Clara' ELSE 'RN' END"
LOGIN_NAME = f"CASE WHEN c_custkey % 4 = 0 THEN 'U' ELSE 'u' END || 'x_' || {KEY} || 'ab'"
#: Rows are ragged; in every third text a blank line cuts the last row off, and every seventh has rows further down than a label reaches.
ROSTER = (
    f"'Roster of ' || c_mktsegment || chr(10) || 'No    Name           User     Ward -> bed' || chr(10) || '----  -------------  -------  ----' || chr(10) || "
    f"rpad({KEY}, 6, ' ') || rpad({PERSON}, 15, ' ') || rpad({LOGIN_NAME}, 9, ' ') || ' ' || 'W' || CAST(c_custkey % 60 AS STRING) || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN chr(10) ELSE '' END || "
    f"CASE WHEN c_custkey % 7 = 0 THEN repeat('..' || chr(10), 38) ELSE '' END || '  2     ' || {PERSON} || '    ' || {LOGIN_NAME} || chr(10) || '3   end'"
)
LOG = (
    f"'TIME      USER-ID      BY         ROLE' || chr(10) || '--------  -------      --         ----' || chr(10) || '08:00:00  ' || rpad({LOGIN_NAME}, 11, ' ') || '  ' || rpad('lim' || {KEY}, 9, ' ') || '  RN' || chr(10) || "
    f"CASE WHEN c_custkey % 3 = 0 THEN chr(10) ELSE '' END || '09:00:00  abc' || {KEY} || '  seen by' || chr(10)"
)
XML = f"'<Case id=\"' || {KEY} || '\">' || chr(10) || '<Nurse role=\"x\"> ' || {PERSON} || '</Nurse><SiteType>Polyclinic</SiteType>' || '<var_name>Height</var_name></Case>'"


def composed(text: str):
    return lambda spark, sf_dir: customers(spark, sf_dir).selectExpr("c_custkey AS row", f"{text} AS text")


def cells_sql(text: str, label: str) -> str:
    """Every cell under a header: a header's line number is carried down by a window of lines, and cut by a blank line's."""
    full, cell = label.replace("'", "''"), r"\S+(?: \S+)*"
    return f"""
WITH src AS (SELECT c_custkey AS row, {text} AS text FROM customer),
cut AS (SELECT row, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS nr FROM src),
placed AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY row ORDER BY nr) - length(line) - 1 AS place,
  regexp_full_match(line, ' *{full}(?:  +{full}){{2,}} *') AS is_head, trim(line) = '' AS is_blank FROM cut),
above AS (SELECT *, max(nr) FILTER (is_head) OVER w AS head, max(nr) FILTER (is_blank) OVER w AS blank FROM placed
  WINDOW w AS (PARTITION BY row ORDER BY nr ROWS BETWEEN {REACH} PRECEDING AND 1 PRECEDING)),
parts AS (SELECT row, nr, line, place, head, regexp_extract_all(line, '{cell}') AS hits, string_split_regex(line, '{cell}') AS gaps FROM above WHERE head IS NOT NULL AND (blank IS NULL OR blank < head) OR is_head),
cells AS (SELECT row, nr, line, place, head, len(hits) AS n_cells, unnest(hits) AS value, unnest(list_transform(range(1, len(hits) + 1), lambda i:
  CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS INT))) AS col FROM parts),
under AS (SELECT c.row, c.nr, c.line, c.n_cells, c.value, c.col, c.place, (SELECT arg_max(h.value, h.col) FROM cells h WHERE h.row = c.row AND h.nr = c.head AND h.col <= c.col) AS header
  FROM cells c WHERE c.head IS NOT NULL AND EXISTS (SELECT 1 FROM above a WHERE a.row = c.row AND a.nr = c.nr AND a.head = c.head AND (a.blank IS NULL OR a.blank < a.head))),
found AS (SELECT row, CAST(nr AS INT) AS line_no, line, n_cells, col, CAST(place + col + 1 AS INT) AS span_start, CAST(place + col + length(value) AS INT) AS span_end, value, header FROM under)
"""


_OUT = ("row", "span_start", "span_end", "value", "header")
_WORDS = "list_transform(regexp_extract_all(header, '[A-Z]?[a-z]+|[A-Z]+'), lambda x: lower(x))"
_listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_like = f"regexp_full_match(value, '{NAME_VALUE.replace(chr(39), chr(39) * 2)}') AND NOT list_contains({_listed(STAFF)}, value)"

QUERIES["fixed_width_cells"] = lambda spark, sf: layouts.fixed_width_cells(composed(ROSTER)(spark, sf)).select("row", "line_no", *_OUT[1:])
SQL["fixed_width_cells"] = cells_sql(ROSTER, TITLE_LABEL) + "SELECT row, line_no, span_start, span_end, value, header FROM found"
QUERIES["fixed_width_names"] = lambda spark, sf: layouts.fixed_width_names(composed(ROSTER)(spark, sf)).select(*_OUT)
SQL["fixed_width_names"] = cells_sql(ROSTER, TITLE_LABEL) + f"SELECT {', '.join(_OUT)} FROM found WHERE n_cells >= 3 AND {_like} AND list_has_any({_WORDS}, {_listed(PEOPLE)})"
QUERIES["login_cells"] = lambda spark, sf: layouts.login_cells(composed(LOG)(spark, sf)).select(*_OUT)
SQL["login_cells"] = cells_sql(LOG, UPPER_LABEL) + f"SELECT {', '.join(_OUT)} FROM found WHERE regexp_full_match(value, '{LOGIN}') AND header IN ('USER-ID', 'BY')"
QUERIES["xml_names"] = lambda spark, sf: layouts.xml_names(composed(XML)(spark, sf)).select(*_OUT)
SQL["xml_names"] = f"""SELECT row, CAST(place AS INT) AS span_start, CAST(place + length(value) - 1 AS INT) AS span_end, value, 'Nurse' AS header FROM (
SELECT c_custkey AS row, {PERSON} AS value, 11 + length({KEY}) + length('">' || chr(10) || '<Nurse role="x"> ') AS place FROM customer) WHERE {_like}"""
