"""A training-corpus pipeline over documents: language, exact copies, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlens.llm import exact_dedup, language_id, lsh_forest, packing, secret_scan
from spanlens.llm.common import Scratch, free, passing, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, null ones included, go. A null lang becomes the predicted language, or stays null where none could be learned; all else stays as it is."""
    import public_tokenizers

    own = [c for c in docs.columns if c.lower() in ("lang_pred", "score", "held_out")]  # columns that the operator gives, too
    aside = dict(zip(own, free(docs.columns, *own)))
    scored = language_id.language_id(docs.withColumnsRenamed(aside), public_tokenizers.path("piece_bpe_32k.model"))
    kept = scored.where("lang_pred <> 'und' OR score IS NULL")
    return kept.withColumn("lang", F.coalesce("lang", F.nullif("lang_pred", F.lit("und")))).select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def kept_rows(spark: SparkSession, docs: DataFrame, groups: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without the rows that groups doesn't keep. Rows are numbered once, in a written table that groups and the rows kept are
    read from; what groups writes on its way is cleared as soon as the rows to be dropped are known."""
    scratch, (number,) = Scratch(spark, "numbered"), free(docs.columns, "uid")
    numbered = scratch.numbered(docs, *docs.columns, name=number)
    with passing():
        found = groups(numbered.select("doc_id", "text", F.col(number).alias("uid")))
        dropped = scratch.write(found.where("NOT kept").select(F.col("uid").alias(number)))
    return numbered.join(dropped, number, "left_anti").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for the case of A-Z, the one with the largest doc_id stays."""
    return kept_rows(spark, docs, exact_dedup.exact_groups)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by a similarity of 0.8 on five-word shingles, the one with the smallest doc_id stays."""
    return kept_rows(spark, docs, lsh_forest.forest_groups)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found in a text are replaced by a mark; n_chars follows."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, with its sequence of at most 2048 tokens and its offset there."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: The stages tokenize, fit a model and hash, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, written = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
        written.append(docs)
        if len(written) > 1:
            scratch.drop(written[-2])
    return docs
