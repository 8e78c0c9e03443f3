"""Readers and writers: marked-up gold notes, JSON sets, JSON lines with a manifest, file manifests and checks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import all_matches
from ..operators.judge import IDENTIFIERS, SENSITIVE

#: Labels that gold may carry: identifiers, sensitive labels, and dates that identify no one.
GOLD_LABELS = (*IDENTIFIERS, *SENSITIVE, "date_other")
MARK = r"\{\{[^|{}]*\|[^{}]*\}\}"
SPANS = "array<struct<start:int,end:int,match:string,label:string>>"


def parse_markup(name: str) -> Column:
    """Struct (text, spans) of the note in the column `name`, in which {{label|text}} marks gold. Unknown labels and unbalanced marks are errors."""
    body, marks = F.col(name), all_matches(name, MARK)
    inner = F.transform(marks, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.regexp_extract(m["match"], r"\A\{\{([^|]*)\|", 1).alias("label"), F.regexp_extract(m["match"], r"(?s)\|(.*)\}\}\z", 1).alias("match")))
    first = F.struct(F.lit(0).alias("cut"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        start = m["start"] - acc["cut"]
        size = F.char_length(m["match"])
        span = F.struct(start.alias("start"), (start + size - 1).alias("end"), m["match"].alias("match"), m["label"].alias("label"))
        return F.struct((acc["cut"] + m["end"] - m["start"] + 1 - size).alias("cut"), F.concat(acc["out"], F.array(span)).alias("out"))

    spans = F.aggregate(inner, first, step, lambda acc: acc["out"])
    text = F.regexp_replace(body, r"\{\{[^|{}]*\|([^{}]*)\}\}", "$1")
    known = F.forall(spans, lambda s: s["label"].isin(*GOLD_LABELS) & (F.char_length(s["match"]) > 0))
    fail = F.raise_error(F.concat(F.lit("bad mark in: "), F.substring(body, 1, 80))).cast(f"struct<text:string,spans:{SPANS}>")
    return F.when(known & ~text.contains("{{") & ~text.contains("}}"), F.struct(text.alias("text"), spans.alias("spans"))).otherwise(fail)


def read_markup(spark: SparkSession, path: str) -> DataFrame:
    """id, kind, text, spans of files of notes: `=== id | kind ===` opens a note; lines with # before the first note are comments."""
    files = spark.read.text(path, wholetext=True)
    split = files.select(F.posexplode(F.split(F.regexp_replace("value", "\r\n", "\n"), r"(?m)^=== ")).alias("at", "part")).where("at > 0")
    head = F.regexp_extract("part", r"\A([^\n]*?) ===[ \t]*\n?", 1)
    body = F.btrim(F.regexp_replace("part", r"\A[^\n]*\n?", ""), F.lit("\n"))
    named = split.select(F.trim(F.get(F.split(head, r"\|"), F.lit(0))).alias("id"), F.trim(F.get(F.split(head, r"\|"), F.lit(1))).alias("kind"), body.alias("body"))
    parsed = named.select("id", "kind", parse_markup("body").alias("note"))
    return parsed.select("id", "kind", "note.text", "note.spans")


def read_set(spark: SparkSession, path: str) -> DataFrame:
    """id, kind, text, spans of a JSON set; an error where a span's offsets don't give its match."""
    schema = f"id string, kind string, text string, spans {SPANS}"
    docs = spark.read.schema(schema).json(path, multiLine=True)
    good = F.forall("spans", lambda s: F.substring(F.col("text"), s["start"], s["end"] - s["start"] + 1) == s["match"])
    return docs.withColumn("text", F.when(F.coalesce(good, F.lit(True)), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("offsets disagree in "), F.col("id"))).cast("string")))


def write_jsonl(df: DataFrame, path: str) -> DataFrame:
    """Writes JSON lines and returns the manifest of the files, with the number of rows written, counted as they are written."""
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.json(path)
    return manifest(df.sparkSession, path).withColumn("rows", F.lit(counted.get["rows"]))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of the files under a path, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(expected: DataFrame, found: DataFrame) -> DataFrame:
    """file, state: ok, changed, missing or extra."""
    e, f = expected.select("file", F.col("sha256").alias("want")), found.select("file", F.col("sha256").alias("have"))
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") == F.col("have"), "ok").otherwise("changed")
    return e.join(f, "file", "full").select("file", state.alias("state"))


def set_check(docs: DataFrame) -> DataFrame:
    """what, name, n: documents, negatives (without gold), documents by kind, spans by label, ids that occur twice."""
    spans = docs.select(F.explode("spans").alias("s")).select(F.lit("label").alias("what"), F.col("s.label").alias("name"))
    parts = [
        docs.select(F.lit("documents").alias("what"), F.lit("all").alias("name")), docs.where(F.size("spans") == 0).select(F.lit("documents").alias("what"), F.lit("negative").alias("name")),
        docs.select(F.lit("kind").alias("what"), F.col("kind").alias("name")), spans, docs.groupBy("id").count().where("count > 1").select(F.lit("duplicate").alias("what"), F.col("id").alias("name")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy("what", "name").agg(F.count("*").alias("n"))


def lower_words(vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """word: the lower-case words of a vocabulary whose tokens mark a word's start."""
    return vocabulary.where(F.col(token).rlike("^Ġ[a-z]+$")).select(F.substring(F.col(token), 2, 1 << 30).alias("word")).distinct()


def guard_output(path: str, synced: tuple[str, ...] = ("OneDrive", "Dropbox", "Google Drive", "iCloud")) -> str:
    """The path, or an error if it lies in a version-controlled tree or a synced folder: what is written may be sensitive."""
    full = os.path.abspath(path)
    at = full
    while True:
        if os.path.isdir(os.path.join(at, ".git")):
            raise ValueError(f"{full} is inside a version-controlled tree")
        if any(s.lower() in os.path.basename(at).lower() for s in synced):
            raise ValueError(f"{full} is inside a synced folder")
        if os.path.dirname(at) == at:
            return full
        at = os.path.dirname(at)
