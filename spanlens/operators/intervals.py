"""Overlaps of intervals inside documents: intervals are dealt to bins of positions, so a long document is no task of its own.

An interval goes to every bin it touches; a pair of intervals is settled in the bin of its larger start alone, which both touch if they
overlap. Work follows the intervals and what overlaps, not the square of a document's intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a bin.
BIN = 512


def bin_of(place: Column) -> Column:
    return F.floor(place / BIN)


def dealt(spans: DataFrame, start: str, end: str) -> DataFrame:
    """spans with `_bin`, a row for each bin that they touch; those that end before they start touch none."""
    return spans.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(bin_of(F.col(start)), bin_of(F.col(end)))))


def touching(left: DataFrame, right: DataFrame, key: str, start: str = "span_start", end: str = "span_end") -> DataFrame:
    """The distinct (key, start, end) of left that overlap some interval (key, start, end) of right. A null key matches nothing."""
    l_ = dealt(left.select(key, start, end).distinct(), start, end)
    r_ = dealt(right.select(F.col(key).alias("_key"), F.col(start).alias("_start"), F.col(end).alias("_end")).distinct(), "_start", "_end").withColumnRenamed("_bin", "_at")
    meets = (F.col(key) == F.col("_key")) & (F.col("_bin") == F.col("_at")) & (F.col(start) <= F.col("_end")) & (F.col("_start") <= F.col(end))
    return l_.join(r_, meets, "left_semi").select(key, start, end).distinct()


def split(left: DataFrame, right: DataFrame, key: str, start: str = "span_start", end: str = "span_end") -> tuple[DataFrame, DataFrame]:
    """The rows of left that overlap some interval of right, and those that don't; repeated rows count each."""
    met = touching(left, right, key, start, end)
    return left.join(met, [key, start, end], "left_semi").select(left.columns), left.join(met, [key, start, end], "left_anti").select(left.columns)


def pairs(left: DataFrame, right: DataFrame, on: tuple[str, str], spans: tuple[str, str, str, str]) -> DataFrame:
    """All columns of both for every pair that overlaps: on names their keys, spans the starts and ends of both. Column names of the two differ."""
    l_key, r_key = on
    l_start, l_end, r_start, r_end = spans
    l_, r_ = dealt(left, l_start, l_end), dealt(right, r_start, r_end).withColumnRenamed("_bin", "_at")
    overlap = (F.col(l_start) <= F.col(r_end)) & (F.col(r_start) <= F.col(l_end))
    once = bin_of(F.greatest(l_start, r_start)) == F.col("_bin")
    return l_.join(r_, (F.col(l_key) == F.col(r_key)) & (F.col("_bin") == F.col("_at")) & overlap & once).drop("_bin", "_at")
