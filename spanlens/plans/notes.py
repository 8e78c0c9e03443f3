"""Text composed from the star schema, by one expression that Spark SQL and DuckDB both read.

Driver documents hold few of the detectors' shapes; each order gives a note that holds all of them, some
with failing checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

D7 = "lpad(CAST((o_orderkey * 7919) % 10000000 AS STRING), 7, '0')"
NRIC_SUM = "(" + " + ".join(f"CAST(substr({D7}, {i + 1}, 1) AS INT) * {w}" for i, w in enumerate((2, 7, 6, 5, 4, 3, 2))) + ")"
LETTER = f"CASE WHEN o_orderkey % 3 = 0 THEN 'Q' ELSE substr('JZIHGFEDCBA', CAST({NRIC_SUM} % 11 AS INT) + 1, 1) END"
DAY = "substr(CAST(o_orderdate AS STRING), 1, 10)"


def digits(expression: str, n: int) -> str:
    return f"lpad(CAST({expression} AS STRING), {n}, '0')"


NRIC = f"'S' || {D7} || {LETTER}"
NOTE = " || ".join([
    "'Pt '", NRIC, "' seen '", DAY, "', temp IC X'", D7, "'K. '",
    "'Mail u'", "CAST(o_orderkey AS STRING)", "'@mail'", "CAST(o_orderkey % 7 AS STRING)", "'.example.com, tel +65 9'", digits("o_orderkey % 1000", 3), "' '", digits("(o_orderkey * 31) % 10000", 4),
    "'; Singapore '", digits("(o_orderkey * 17) % 1000000", 6), "'\n'", f"replace({DAY}, '-', '')", "' and '", digits("(o_orderkey * 7907) % 100000000", 8),
    "' at https://h.example.org/p/'", "CAST(o_orderkey AS STRING)", "'?q=1 from '", "CAST(o_orderkey % 300 AS STRING)", "'.'", "CAST(o_orderkey % 256 AS STRING)", "'.0.1, '",
    "'passport EA'", digits("(o_orderkey * 13) % 10000000", 7), "', case '", digits("o_orderkey", 10), "'C, MRN MR'", digits("o_custkey", 8),
    "', card 4'", digits("o_orderkey % 1000", 3), "'-'", digits("(o_orderkey * 7) % 10000", 4), "'-'", digits("(o_orderkey * 11) % 10000", 4), "'-'", digits("(o_orderkey * 3) % 10000", 4), "'.'",
])


#: Tasks for each split of a table of keys, from each row of which a text is made: a split of 128 MB holds millions of rows.
PER_SPLIT = 32


def dealt(rows: DataFrame) -> DataFrame:
    """rows in so many parts that a part grows neither with the table nor with the text made of a row: twice the cores, PER_SPLIT for each split of the file."""
    return rows.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, PER_SPLIT * rows.rdd.getNumPartitions()))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers that texts are composed of, dealt to tasks before that."""
    return dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, text: a note for each order. Orders are dealt to tasks before the text is made."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    return dealt(orders).selectExpr("o_orderkey AS row", f"{NOTE} AS text")


NOTES_SQL = f"SELECT o_orderkey AS row, {NOTE} AS text FROM orders"
