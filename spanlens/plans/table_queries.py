"""Queries for tables in text and HL7 messages, over text composed from the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables
from .notes import customers

QUERIES: dict = {}
SQL: dict[str, str] = {}

ROW = "CAST(c_custkey AS STRING) || '|SCR-' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '|' || CASE WHEN c_custkey % 2 = 0 THEN 'Tan Ah Kow' ELSE 'n/a 5' END || '|' || c_mktsegment"
TABLE = f"'Listing below' || chr(10) || 'No|Subj ID|Patient Name|Ward' || chr(10) || {ROW} || chr(10) || 'end'"


def composed(spark, sf_dir):
    return customers(spark, sf_dir).selectExpr("c_custkey AS row", f"{TABLE} AS text")


def flat(df):
    return df.select("row", "line_no", "col", "header", "span_start", "span_end", "value")


_HEAD = len("Listing below\nNo|Subj ID|Patient Name|Ward\n")
_N = "length(CAST(c_custkey AS STRING))"
QUERIES["table_cells"] = lambda spark, sf: flat(tables.table_cells(composed(spark, sf)))
_CELL = "SELECT c_custkey AS row, 2 AS line_no, {k} AS col, '{h}' AS header, CAST({at} + 1 AS INT) AS span_start, CAST({at} + length({v}) AS INT) AS span_end, {v} AS value FROM customer"
_NAME = "(CASE WHEN c_custkey % 2 = 0 THEN 'Tan Ah Kow' ELSE 'n/a 5' END)"
_PARTS = (
    (0, "No", f"{_HEAD}", "CAST(c_custkey AS STRING)"),
    (1, "Subj ID", f"{_HEAD} + {_N} + 1", "('SCR-' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'))"),
    (2, "Patient Name", f"{_HEAD} + {_N} + 9", _NAME),
    (3, "Ward", f"{_HEAD} + {_N} + 10 + length({_NAME})", "c_mktsegment"),
)
SQL["table_cells"] = " UNION ALL ".join(_CELL.format(k=k, h=h, at=f"({at})", v=v) for k, h, at, v in _PARTS)
QUERIES["table_names"] = lambda spark, sf: flat(tables.name_cells(composed(spark, sf)))
SQL["table_names"] = _CELL.format(k=2, h="Patient Name", at=f"({_PARTS[2][2]})", v=_NAME) + " WHERE c_custkey % 2 = 0"
QUERIES["table_ids"] = lambda spark, sf: flat(tables.id_cells(composed(spark, sf)))
SQL["table_ids"] = _CELL.format(k=1, h="Subj ID", at=f"({_PARTS[1][2]})", v=_PARTS[1][3])

MESSAGE = "'MSH|x|TAN^A' || chr(10) || 'PID|1||' || CAST(c_custkey AS STRING) || '||TAN^MEI LING' || chr(10) || 'PV1|1|I|||||S123^LIM^KAI'"


def hl7(spark, sf_dir):
    rows = customers(spark, sf_dir).selectExpr("c_custkey AS row", f"{MESSAGE} AS text")
    return tables.hl7_people(rows)


QUERIES["hl7_people"] = hl7
_AT = [(21, "TAN", "name"), (25, "MEI LING", "name"), (46, "S123", "other_id"), (51, "LIM", "name"), (55, "KAI", "name")]
SQL["hl7_people"] = " UNION ALL ".join(f"SELECT c_custkey AS row, CAST({at} + {_N} + 1 AS INT) AS span_start, CAST({at} + {_N} + {len(v)} AS INT) AS span_end, '{v}' AS value, '{i}' AS identifier FROM customer" for at, v, i in _AT)
