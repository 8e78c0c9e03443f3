"""Queries for the synthetic corpus, training rows and the end-to-end engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import synth

QUERIES: dict = {}
SQL: dict[str, str] = {}


def synth_corpus(spark, sf_dir):
    """Gold spans of a synthetic document for each customer."""
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    return synth.corpus(spark, n).select("id", "split", F.inline("spans")).withColumnsRenamed({"start": "span_start", "end": "span_end"})


def sft_rows(spark, sf_dir):
    """Training questions of the synthetic corpus, without texts of the benchmark."""
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    held = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return synth.sft_rows(synth.corpus(spark, n), held).withColumnsRenamed({"start": "span_start", "end": "span_end"})


QUERIES |= {"synth_corpus": synth_corpus, "sft_rows": sft_rows}
