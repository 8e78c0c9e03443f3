"""How far the sources of a language differ in their terms: a triangular discrimination of smoothed shares, by
inclusion-exclusion over supports.

A pair's value is a sum over all kept terms, most of which neither source has. With f the divergence of one term, p(c) a
source's share of a term that it holds c times and 0 for none:

* every term is priced as if neither had it: V * f(p(0), q(0)), one constant a pair;
* each source's histogram of counts corrects that for the terms it has: m * (f(p(c), q(0)) - f(p(0), q(0))) for the m
  terms with c occurrences, without looking at the terms;
* a join of postings by term corrects what both corrections got wrong where both have the term.

So work follows occurrences, not sources x terms. Texts are cut into terms in Arrow batches, which come out counted by
source and term; all else are DataFrame aggregates and joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table

MIN_DOCS, TOP, SALTS = 10, 10, 16
SLICE_BYTES = 8 << 20

#: Bytes of terms, A-Z in lower case; every other ASCII byte is 0. Bytes of other scripts are terms' as they are.
FOLD = np.array([b | 32 if chr(b).isalpha() else 0 for b in range(128)] + list(range(128, 256)), np.uint8)

COUNTED = "lang string, source string, term string, n long, docs long"


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with up to SLICE_BYTES of text, a longer text by itself."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, SLICE_BYTES + (ends[lo - 1] if lo else 0), "right")))
        yield lo, hi
        lo = hi


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and for each the number of its text."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    size = int(offsets[-1] - offsets[0])
    if not size:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    folded = FOLD[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    inside = folded != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1] - offsets[0]
    first = first[first < size]
    begins[first] = inside[first]  # a term ends with its text
    starts = np.flatnonzero(begins)
    edges = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, np.count_nonzero(inside)).astype(np.int32)
    data = folded[inside]
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(data))
    return terms, np.searchsorted(offsets[1:] - offsets[0], starts, "right")


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source, and a row with a null term for each language and source."""
    for batch in batches:
        text = pc.fill_null(batch.column("text"), "")
        for lo, hi in _slices(text):
            langs, sources = (batch.column(c).slice(lo, hi - lo).dictionary_encode() for c in ("lang", "source"))
            n_sources = max(len(sources.dictionary), 1)
            group = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
            terms, doc = _terms(text.slice(lo, hi - lo))
            coded = terms.dictionary_encode()
            width = max(len(coded.dictionary), 1)
            in_doc, n = np.unique(doc * width + coded.indices.to_numpy(), return_counts=True)
            by, at = np.unique(group[in_doc // width] * width + in_doc % width, return_inverse=True)
            seen = np.unique(group)
            none = np.zeros(len(seen), np.int64)
            who = np.concatenate((by // width, seen))
            columns = [
                langs.dictionary.take(pa.array(who // n_sources)),
                sources.dictionary.take(pa.array(who % n_sources)),
                pa.concat_arrays([coded.dictionary.take(pa.array(by % width)).cast(pa.string()), pa.nulls(len(seen), pa.string())]),
                pa.array(np.concatenate((np.bincount(at, n, len(by)).astype(np.int64), none))),
                pa.array(np.concatenate((np.bincount(at, minlength=len(by)).astype(np.int64), none))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1000000000 * (n + 2) / (total + 2 * terms)), exact at any size."""
    return F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * (n + F.lit(2)).cast("decimal(19,0)"), (total + F.lit(2) * terms).cast("decimal(19,0)")) + F.lit(1)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank, as op13 describes them, for every (lang, source) of docs (lang, source, text and any other columns).

    Null lang, source and text are empty ones. A language without kept terms has pairs of value 0. No rows, no result."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "divergence")
    small_batches(spark)
    filled = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = scratch.write(filled.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    term = Window.partitionBy("lang", "term")
    seen = counts.where("term IS NOT NULL").withColumns({"all_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "nth": F.row_number().over(term.orderBy("source"))})
    kept = scratch.write(seen.where(F.col("all_docs") >= MIN_DOCS).drop("docs", "all_docs"))

    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum((F.col("nth") == 1).cast("long")).alias("firsts"))
    groups = counts.where("term IS NULL").select("lang", "source").join(by_source, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "firsts")))
    by_lang = groups.groupBy("lang").agg(F.sum("firsts").alias("v"), F.sum("total").alias("lang_total"))
    p = lambda n, total: _share(F.col(n) if isinstance(n, str) else n, F.col(total), F.col("v"))
    groups = scratch.write(groups.join(by_lang, "lang").select("lang", "source", "total", "v", "lang_total", F.when(F.col("v") > 0, p(F.lit(0), "total")).alias("p0")))

    postings = scratch.write(kept.join(groups, ["lang", "source"]).select("lang", "term", "source", "n", "p0", p("n", "total").alias("p"), p("lang_n", "lang_total").alias("q")))
    return _pairs(groups, postings).unionByName(_top_terms(postings))


def _ranked(values: DataFrame, part: str, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = values.withColumn("rank", F.row_number().over(order))
    ranked = ranked if most is None else ranked.where(F.col("rank") <= most)
    return ranked.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long"), "rank")


def _top_terms(postings: DataFrame) -> DataFrame:
    return _ranked(postings.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value")), "term", TOP)


def _pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """Parts of each pair's value from the three steps of the module's description, summed and ranked. Rows of one language are salted."""
    p, p0, q, q0 = (F.col(c) for c in ("p", "p0", "q", "q0"))
    salted = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = lambda *by: F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int").alias("salt")

    constant = groups.select("lang", "source", "p0", "v", salt("source")).join(salted, ["lang", "salt"]).where("source <> item")
    constant = constant.select("lang", "source", "item", F.coalesce(F.col("v") * _apart(p0, q0), F.lit(0)).alias("value"))

    histogram = postings.groupBy("lang", "source", "n", "p", "p0").agg(F.count("*").alias("m")).select("*", salt("source", "n"))
    alone = histogram.join(salted, ["lang", "salt"]).where("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("m") * (_apart(p, q0) - _apart(p0, q0))).alias("value"))

    a, b = postings.select("lang", "term", "source", "p", "p0"), postings.select("lang", "term", F.col("source").alias("item"), p.alias("q"), p0.alias("q0"))
    both = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item")
    both = both.agg(F.sum(_apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0)).alias("value"))

    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("way")
    parts = constant.unionByName(alone.unionByName(both).select("lang", ways, "value").select("lang", "way.*", "value"))
    return _ranked(parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each source of documents from every other source of its language, and the terms that set it apart most.
    Null lang, source and text are empty; copies count as often as they occur; other columns are not read; an empty table gives no rows."""
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (
  SELECT lang, source, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS id FROM docs)
),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM terms t JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(t.total, 0) + 2 * s.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 2) // (s.total + 2 * s.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c USING (lang, source, term) LEFT JOIN totals t USING (lang, source)
),
pairs AS (
  SELECT g.lang, g.source, o.source AS item, coalesce(f.value, 0) AS value
  FROM groups g JOIN groups o ON o.lang = g.lang AND o.source <> g.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
             FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) f
    ON f.lang = g.lang AND f.source = g.source AND f.item = o.source
),
parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM dense WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
) WHERE part = 'pair' OR rank <= 10
"""
