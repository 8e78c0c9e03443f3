"""A synthetic gold corpus from hashes of a row number, and training rows made of it.

A document depends on its number and a seed alone, so any range of it can be made again, anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.validators import NRIC_LETTERS, NRIC_WEIGHTS
from ..sources.corpora import parse_markup
from .judge import family_of, option_places

SURNAMES = ("Tan", "Lim", "Lee", "Ng", "Wong", "Goh", "Chua", "Koh", "Rahman", "Ismail", "Nair", "Pillai", "Singh", "Kumar", "Cruz", "Pereira")
GIVEN = ("Wei Ming", "Mei Ling", "Aisyah", "Farid", "Priya", "Arjun", "Hui Min", "Kai", "Sofia", "Daniel", "Nur Aini", "Ravi", "Jia Hao", "Siew Lan", "Marcus", "Deepa")
STREETS = ("Ang Mo Kio Ave", "Bedok North St", "Tampines St", "Clementi Ave", "Yishun Ring Road", "Hougang Ave", "Toa Payoh Lor", "Jurong West St")
CONDITIONS = (("hiv_sti", "hepatitis B infection"), ("mental_health", "bipolar disorder"), ("substance_use", "alcohol dependence"), ("genetic", "BRCA1 mutation carrier"), ("reproductive_sexual", "miscarriage"), ("other_sensitive", "elder abuse"))
#: Every fourth item of a pool is for the test split alone.
TEST_EVERY = 4


def draw(name: str, n: int, seed: int) -> Column:
    """A number below n that depends on the document, the slot's name and the seed."""
    return F.pmod(F.xxhash64("id", F.lit(name), F.lit(seed)), F.lit(n)).cast("int")


def from_pool(name: str, pool: tuple[str, ...], seed: int) -> Column:
    """An item of the split's part of a pool."""
    parts = [[x for i, x in enumerate(pool) if (i % TEST_EVERY == TEST_EVERY - 1) == test] for test in (False, True)]
    pick = [F.element_at(F.array(*map(F.lit, p)), draw(name, len(p), seed) + 1) for p in parts]
    return F.when(F.col("split") == "test", pick[1]).otherwise(pick[0])


def padded(name: str, digits: int, seed: int) -> Column:
    return F.lpad(draw(name, 10**digits, seed).cast("string"), digits, "0")


def nric(name: str, seed: int) -> Column:
    """A number of the S series with its check letter."""
    d = padded(name, 7, seed)
    total = sum((F.substring(d, i + 1, 1).cast("int") * w for i, w in enumerate(NRIC_WEIGHTS)), F.lit(0))
    return F.concat(F.lit("S"), d, F.substr(F.lit(NRIC_LETTERS["ST"]), total % 11 + 1, F.lit(1)))


def day(name: str, first: str, days: int, seed: int) -> Column:
    return F.date_format(F.date_add(F.lit(first).cast("date"), draw(name, days, seed)), "dd/MM/yyyy")


def mark(label: str | Column, value: Column) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.concat(F.lit("{{"), label, F.lit("|"), value, F.lit("}}"))


def corpus(spark: SparkSession, n: int, seed: int = 0, test_share: int = 5) -> DataFrame:
    """id, split, kind, text, spans, decoys of n documents; one in test_share is of the test split."""
    rows = spark.range(n).withColumn("split", F.when(F.pmod(F.xxhash64("id", F.lit("split"), F.lit(seed)), F.lit(test_share)) == 0, "test").otherwise("train"))
    person = mark("name", F.concat_ws(" ", from_pool("given", GIVEN, seed), from_pool("surname", SURNAMES, seed)))
    doctor = mark("name", from_pool("doctor", SURNAMES, seed))
    shi = draw("shi", len(CONDITIONS), seed) + 1
    illness = mark(F.element_at(F.array(*[F.lit(k) for k, _ in CONDITIONS]), shi), F.element_at(F.array(*[F.lit(v) for _, v in CONDITIONS]), shi))
    parts = [
        F.concat(F.lit("Patient "), person, F.lit(" (NRIC "), mark("national_id", nric("nric", seed)), F.lit("), DOB "), mark("dob", day("dob", "1930-01-01", 30000, seed)), F.lit(".")),
        F.concat(F.lit("Admitted on "), mark("date_other", day("admitted", "2023-01-01", 1000, seed)), F.lit(" under Dr "), doctor, F.lit(".")),
        F.concat(F.lit("Lives at "), mark("address", F.concat(F.lit("Blk "), (draw("block", 900, seed) + 1).cast("string"), F.lit(" "), from_pool("street", STREETS, seed), F.lit(" "), (draw("no", 90, seed) + 1).cast("string"))), F.lit(", Singapore "), mark("postal_code", padded("postal", 6, seed)), F.lit(".")),
        F.concat(F.lit("Contact "), mark("phone", F.concat(F.lit("9"), padded("phone", 3, seed), F.lit(" "), padded("phone2", 4, seed))), F.lit(" or "), mark("email", F.concat(F.lit("user"), F.col("id").cast("string"), F.lit("@mail.example.com"))), F.lit(".")),
        F.concat(F.lit("Known "), illness, F.lit(", MRN "), mark("mrn", F.concat(F.lit("MR"), padded("mrn", 8, seed))), F.lit(".")),
    ]
    chosen = F.array_join(F.filter(F.array(*[F.when(draw(f"use{i}", 10, seed) < 8, p) for i, p in enumerate(parts)]), lambda x: x.isNotNull()), " ")
    body = F.concat(chosen, F.lit(" BP 120/80, review in 3/7."))
    noted = rows.withColumn("body", body).withColumn("note", parse_markup("body"))
    where = F.locate("120/80", F.col("note.text"))
    decoy = F.array(F.struct(where.alias("start"), (where + 5).alias("end"), F.lit("120/80").alias("match"), F.lit("measurement").alias("type")))
    return noted.select(F.concat(F.lit("doc-"), F.col("id").cast("string")).alias("id"), "split", F.lit("note").alias("kind"), "note.text", "note.spans", decoy.alias("decoys"))


def faults(docs: DataFrame) -> DataFrame:
    """id and what is wrong: spans whose offsets don't give their match, or that overlap."""
    wrong = F.exists("spans", lambda s: F.substring(F.col("text"), s["start"], s["end"] - s["start"] + 1) != s["match"])
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"])))
    clash = F.exists(F.sequence(F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(1))), lambda i: F.coalesce(F.get(ordered, i)["start"] <= F.get(ordered, i - 1)["end"], F.lit(False)))
    return docs.select("id", F.when(wrong, "offsets").when(clash, "overlap").alias("fault")).where("fault IS NOT NULL")


def sft_rows(docs: DataFrame, held_out: DataFrame | None = None) -> DataFrame:
    """doc, start, end, label, family, order_idx, letter: a question for each gold span and decoy, in each option order.

    Spans whose label the family doesn't offer can't be answered and are left out, as are documents whose text is in
    held_out (text)."""
    if held_out is not None:
        docs = docs.join(held_out.select("text").distinct(), "text", "left_anti")
    some = lambda name: F.coalesce(name, F.array().cast(docs.schema[name].dataType))
    decoys = F.transform(some("decoys"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), F.lit("none").alias("label")))
    both = docs.select(F.col("id").alias("doc"), F.inline_outer(F.concat(some("spans"), decoys))).where("start IS NOT NULL")  # outer: see propose.raw_proposals
    asked = both.withColumn("label", F.when(F.col("label") == "date_other", "none").otherwise(F.col("label"))).withColumn("family", family_of(F.col("match")))
    letter = F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("position") + 1, F.lit(1))
    return option_places(asked).select("doc", "start", "end", "label", "family", "order_idx", letter.alias("letter"))
