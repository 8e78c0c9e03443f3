"""Near-duplicate vectors: coarse inverted lists, product-quantised residuals, exact rerank.

Equal vectors of a label are one class. Coarse centroids and the codebooks of residual subspaces are fitted on a
bounded sample of classes, once for each dimension; every class is indexed. Lists number the square root of the
classes, as far as the sample can fit them.

A class is a query in its own list, and its codes, a few bytes, go to its own list and to each list of a lower
number that it probes: all that can hold a partner. A cell lies behind the bisecting plane between two centroids, so a partner
within the search radius lies in another list only if that plane is within the radius; and a list's members lie between its
least and its greatest distance to the centroid, so by the triangle inequality the class must lie within the radius of that
ring. Both bounds hold for every direction a difference may have: no link is lost.

In a list, distances are summed from lookup tables of a query's products with the codewords. They are off by at
most the stored residual error of the member, so nothing is lost there. Members with a likely link have their vectors
fetched, and are compared with the list's queries by exact cosine. A list is split into blocks of queries and of
members, and a pair of blocks emits link counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .components import components
from .lsh_forest import _roots

COSINE = 0.93
#: Bounds of the sample that the fit reads for a dimension, in rows and in components; sampled rows that a list wants; components of a subspace; codes of a codebook.
SAMPLE, SAMPLE_VALUES, LIST_ROWS, SUBSPACE, CODES = 20_000, 10_000_000, 16, 8, 256
#: Queries and members of a block; rows that a task is given at once, on average.
BLOCK_QUERIES, BLOCK_MEMBERS, GROUP_ROWS = 512, 4096, 8192


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        order = np.argsort(near, kind="stable")
        used, first, n = np.unique(near[order], return_index=True, return_counts=True)
        c[used] = np.add.reduceat(x[order], first) / n[:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)


class Quantiser:
    """Coarse centroids (lists x dimensions) and a codebook for each subspace, which is a slice of the dimensions."""

    def __init__(self, x: np.ndarray, lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centroids = k_means(x, lists, 8, rng)
        d = x.shape[1]
        self.slices = [slice(i, min(d, i + SUBSPACE)) for i in range(0, d, SUBSPACE)]
        residuals = x - self.centroids[nearest(x, self.centroids)]
        self.books = [k_means(residuals[:, s], CODES, 6, rng) for s in self.slices]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """list, distance to its centroid, codes, residual error and squared length of what list and codes stand for, of unit vectors."""
        at = nearest(x, self.centroids)
        r = x - self.centroids[at]
        codes = np.stack([nearest(r[:, s], b) for s, b in zip(self.slices, self.books)], 1)
        back = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], 1)
        return at, np.linalg.norm(r, axis=1), codes.astype(np.uint8), np.linalg.norm(r - back, axis=1), ((self.centroids[at] + back) ** 2).sum(1)

    def probes(self, x: np.ndarray, at: np.ndarray, radius: float, least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
        """Whether a list's cell and its ring, from least to greatest (by list), come within the radius, rows x lists."""
        c = self.centroids
        d2 = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T
        apart = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * c @ c.T, 1e-30))
        near = (d2 - d2[np.arange(len(x)), at][:, None]) / (2 * apart[at]) <= radius + 1e-9
        away = np.sqrt(np.maximum(d2, 0))
        return near & (away <= greatest + radius + 1e-7) & (away >= least - radius - 1e-7)

    def distances(self, x: np.ndarray, lists: np.ndarray, codes: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of unit vectors to what lists and codes stand for, queries x members: by a table of each query's products with all codewords."""
        products = (x @ self.centroids.T)[:, lists]
        for m, (s, b) in enumerate(zip(self.slices, self.books)):
            products += (x[:, s] @ b.T)[:, codes[:, m]]
        return np.sqrt(np.maximum(1 + length[None, :] - 2 * products, 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def stacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array column whose arrays have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """uid, label and embedding (doubles) of the rows that can link."""
    e = F.col("embedding")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return vectors.where("label IS NOT NULL AND embedding IS NOT NULL").select("uid", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(fine)


def fitted(classes: DataFrame, sample: int) -> dict[int, Quantiser]:
    """A quantiser for each dimension, from some `sample` of its classes (fewer of SAMPLE_VALUES components, where those are fewer), the ones
    with the least hashes: what exceeds the share stays with the executors."""
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, min(1.0, min(sample, SAMPLE_VALUES / d) / n))])
    drawn = classes.where(F.xxhash64("rep") / float(1 << 64) + 0.5 <= F.element_at(share, F.col("dim"))).select("dim", "rep", "embedding").toArrow().sort_by("rep")
    out = {}
    for d, n in sizes.items():
        own = drawn.filter(pc.equal(drawn["dim"], d))
        x = unit(stacked(own["embedding"])) if len(own) else np.ones((1, d)) / math.sqrt(d)
        out[d] = Quantiser(x, max(1, min(math.ceil(math.sqrt(n)), len(x) // LIST_ROWS)))
    return out


def rings(coded: DataFrame, quantisers: dict[int, Quantiser]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension the least and the greatest distance of a list's members to its centroid, by list; an empty list has none within reach."""
    out = {d: (np.full(len(q.centroids), np.inf), np.full(len(q.centroids), -np.inf)) for d, q in quantisers.items()}
    for r in coded.groupBy("dim", "list").agg(F.min("away").alias("least"), F.max("away").alias("greatest")).collect():  # as many rows as lists
        out[r["dim"]][0][r["list"]], out[r["dim"]][1][r["list"]] = r["least"], r["greatest"]
    return out


def vector_links(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Rows link if their labels are equal and not null, their dimensions are equal and their cosine, in double precision,
    is at least `cosine`. Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    component_id is the smallest vec_id reachable; kept tells whether it is the row's own. Rows that repeat a vec_id are
    rows of their own; a null vec_id is never a component_id unless all of the component are null, and is not kept. Other
    columns are ignored; an empty table gives an empty result. Dimensions are taken to be few: each has a quantiser.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = scratch.write(vectors.select("vec_id", "embedding", "label").withColumn("uid", F.monotonically_increasing_id()))
    classes = scratch.write(usable(rows).groupBy("label", "embedding").agg(F.min("uid").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding")))
    quantisers = fitted(classes, sample)
    if not quantisers:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    shared = spark.sparkContext.broadcast(quantisers)  # bounded by the sample, for each dimension
    radius = math.sqrt(2 - 2 * cosine) + 1e-7

    def by_dimension(each, names: list[str]):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                dims = whole.column("dim").to_numpy()
                for d in np.unique(dims):
                    b = whole.filter(pa.array(dims == d))
                    yield pa.RecordBatch.from_arrays([*b.columns, *each(int(d), b, unit(stacked(b.column("embedding"))))], [*b.schema.names, *names])

        return run

    def code(d: int, b: pa.RecordBatch, x: np.ndarray) -> list[pa.Array]:
        at, away, codes, error, length = shared.value[d].encode(x)
        return [pa.array(at, pa.int32()), pa.array(away), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(length)]

    def probe(d: int, b: pa.RecordBatch, x: np.ndarray) -> list[pa.Array]:
        at = b.column("list").to_numpy()
        near = shared.value[d].probes(x, at, radius, *ring.value[d])
        return [pa.array([np.flatnonzero(p[: k + 1]).tolist() for p, k in zip(near, at)], pa.list_(pa.int32()))]

    label = rows.schema["label"].dataType.simpleString()
    schema = f"rep long, label {label}, embedding array<double>, dim int, list int, away double, codes binary, error double, length double"
    coded = scratch.write(classes.select("rep", "label", "embedding", "dim").mapInArrow(by_dimension(code, ["list", "away", "codes", "error", "length"]), schema))
    ring = spark.sparkContext.broadcast(rings(coded, quantisers))  # two numbers for each list
    indexed = scratch.write(coded.mapInArrow(by_dimension(probe, ["probes"]), f"{schema}, probes array<int>"))
    scratch.drop(coded)
    asked = indexed.select("label", "dim", "rep", F.col("list").alias("own"), "codes", "error", "length", F.explode("probes").alias("list"))
    # Blocks of each list, by counts that are added up before they are moved.
    at = ["label", "dim", "list"]
    counts = asked.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("mb"), F.ceil(F.sum((F.col("own") == F.col("list")).cast("int")) / BLOCK_QUERIES).cast("int").alias("qb")).where("qb > 0")
    counts = scratch.write(counts)
    drawn = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = [F.xxhash64(*at, "m", "q", F.lit(k)).alias(f"key{k}") for k in (1, 2)]
    queries = indexed.select(*at, "rep", "embedding").join(counts, at).withColumn("m", every("mb")).withColumn("q", drawn("qb")).select(*key, "dim", "list", "rep", "embedding")
    members = asked.join(counts, at).withColumn("m", drawn("mb")).withColumn("q", every("qb")).select(*key, "dim", "list", "rep", "own", "codes", "error", "length")
    size = counts.agg(F.sum(F.col("qb") * BLOCK_QUERIES + F.col("mb") * F.lit(64))).first()[0] or 0
    likely = scratch.write(_paired(queries, members, size, lambda a, b: _likely(a, b, shared.value, radius), members.schema, None))
    fetched = likely.join(indexed.select(F.col("rep").alias("r"), F.col("embedding").alias("vector")), F.col("rep") == F.col("r")).select("key1", "key2", "dim", "list", "rep", "own", F.col("vector").alias("embedding"))
    reps = classes.select(F.col("rep").alias("r"), "copies")
    weigh = lambda df: df.join(reps, F.col("rep") == F.col("r")).drop("r")
    asking = weigh(queries.join(likely.select("key1", "key2").distinct(), ["key1", "key2"], "left_semi"))
    links = scratch.write(_paired(asking, weigh(fetched), size, lambda a, b: _links(a, b, cosine), None, "kind int, u long, v long"))
    direct = links.where("kind = 0").groupBy(F.col("u").alias("cu")).agg(F.sum("v").alias("others"))
    roots = components(links.where("kind = 1").select("u", "v"), scratch).select(F.col("node").alias("ru"), "root")
    per_class = classes.select("label", "embedding", "rep", "copies").join(direct, F.col("rep") == F.col("cu"), "left").join(roots, F.col("rep") == F.col("ru"), "left")
    per_class = scratch.write(per_class.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root")))
    met = rows.join(usable(rows).select(F.col("uid").alias("good"), F.col("label").alias("gl"), F.col("embedding").alias("ge")), F.col("uid") == F.col("good"), "left")
    met = met.join(per_class, (F.col("gl") == F.col("l")) & (F.col("ge") == F.col("e")), "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "uid").alias("root"))
    met = scratch.write(met)
    least = scratch.write(met.groupBy(F.col("root").alias("r")).agg(F.min("vec_id").alias("component_id")))
    return met.join(least, F.col("root") == F.col("r")).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _paired(queries: DataFrame, members: DataFrame, size: int, match, schema, ddl: str | None) -> DataFrame:
    """match(queries, members) over the pairs of blocks that have both, many pairs in a task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    task = F.pmod("key1", F.lit(max(1, -(-size // GROUP_ROWS)))).cast("int").alias("task")
    schema = schema or StructType.fromDDL(ddl)
    empty = to_arrow_schema(schema).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [match(a, b) for a, b in _by_key(left, right)]
        return pa.concat_tables(out) if out else empty

    own = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns], task).groupBy("task")  # noqa: E731  columns of its own, as both sides come from one table
    return own(queries).cogroup(own(members)).applyInArrow(run, schema)


def _by_key(left: pa.Table, right: pa.Table) -> Iterator[tuple[pa.Table, pa.Table]]:
    if not len(left) or not len(right):
        return
    cut = []
    for t in (left.drop_columns("task"), right.drop_columns("task")):
        t = t.sort_by([("key1", "ascending"), ("key2", "ascending"), ("rep", "ascending")]).combine_chunks()
        one, two = t["key1"].to_numpy(), t["key2"].to_numpy()
        edges = [0, *(np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1).tolist(), len(one)]
        cut.append({(one[i], two[i]): t.slice(i, j - i) for i, j in zip(edges, edges[1:])})
    for key, own in cut[0].items():
        if key in cut[1]:
            yield own, cut[1][key]


def _apart(queries: pa.Table, members: pa.Table) -> np.ndarray:
    """Pairs that count here, queries x members: of a list's own members a pair counts once."""
    own = members["own"].to_numpy() == queries["list"][0].as_py()
    return ~own[None, :] | (queries["rep"].to_numpy()[:, None] < members["rep"].to_numpy()[None, :])


def _likely(queries: pa.Table, members: pa.Table, quantisers: dict[int, Quantiser], radius: float) -> pa.Table:
    """The members that lie, by their codes, within the radius and their error of some query."""
    q = quantisers[queries["dim"][0].as_py()]
    x = unit(stacked(queries["embedding"]))
    codes = np.frombuffer(b"".join(members["codes"].to_pylist()), np.uint8).reshape(len(members), -1)
    near = q.distances(x, members["own"].to_numpy(), codes, members["length"].to_numpy()) <= radius + members["error"].to_numpy()[None, :] + 1e-7
    return members.filter(pa.array((near & _apart(queries, members)).any(0)))


def _links(queries: pa.Table, members: pa.Table, cosine: float) -> pa.Table:
    """kind 0: a class and links of it found here; kind 1: an edge of a spanning forest of the links."""
    i, j = np.nonzero((unit(stacked(queries["embedding"])) @ unit(stacked(members["embedding"])).T >= cosine) & _apart(queries, members))
    reps = [t["rep"].to_numpy() for t in (queries, members)]
    names, place = np.unique(np.concatenate((reps[0][i], reps[1][j])), return_inverse=True)
    a, b = place[: len(i)], place[len(i) :]
    count = np.bincount(a, members["copies"].to_numpy()[j], len(names)) + np.bincount(b, queries["copies"].to_numpy()[i], len(names))
    root = np.array(_roots(len(names), zip(a.tolist(), b[:, None].tolist())), np.int64)
    child = np.flatnonzero(root != np.arange(len(names)))
    kind = [0] * len(names) + [1] * len(child)
    return pa.table({"kind": pa.array(kind, pa.int32()), "u": pa.array(np.concatenate((names, names[child]))), "v": pa.array(np.concatenate((count.astype(np.int64), names[root[child]])).astype(np.int64))})


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all vectors of embeddings at a cosine of 0.93 or more within a label: see vector_links. Null, zero and non-finite vectors link with nothing."""
    return vector_links(table(spark, sf_dir, "embeddings"))


OP2_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
r AS (SELECT u, w FROM p UNION SELECT r.u, p.w FROM r JOIN p ON r.w = p.u),
c AS (SELECT u, min(w) AS low FROM r GROUP BY u), n AS (SELECT u, count(*) AS n FROM p GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON e.vec_id = c.u LEFT JOIN n ON e.vec_id = n.u
"""
