"""Similarity join on word shingles: a MinHash LSH forest, then exact verification.

A document's shingles are its runs of five words (all its words, if it has fewer). Each of the forest's
trees is a prefix trie of labels, a label being DEPTH MinHashes; a node is a prefix, and documents meet in the
nodes they share. A document's prefix is shortened from the full label until the chance to meet a link of the least
similarity that its number of shingles allows reaches the target recall: that depth follows from the number of shingles,
the trees and the target, not from what was met on the way. Short texts stop early, as with few shingles only high
similarities are possible, and some can have no link at all. A round for each depth takes the documents that end there,
and those longer ones that they could be linked with.

Two documents that meet in several trees are compared in the first of them only: a pair is settled as soon as the two share
a node of an earlier tree, which is seen from the nodes' numbers, and only what is left is compared by whole labels,
whose share of equal MinHashes estimates the similarity. Texts are moved only to the nodes where a document has a likely
link, and compared shingle by shingle there. Members of a large node are dealt to blocks bounded in members and in shingles,
each pair of blocks being a unit of its own. A unit gives a count of links for each document and a spanning
forest of its links, so output grows with documents and not with pairs. Texts with the same shingles are one class,
verified once and counted with its size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Pieces, Scratch, arrow_map, give_back, own_memory, small_batches, table, text_or_empty
from .components import components

WORDS, SIMILARITY = 5, 0.8
TREES, DEPTH = 20, 6
TARGET_RECALL = 0.9999
#: How far the labels' estimate may lie below the wanted similarity: over five standard deviations.
MARGIN = 0.2
#: Members of a node's block, and their shingles, on average; members that a task is given at once to compare labels, and shingles to compare texts.
BLOCK_DOCS, BLOCK_SHINGLES, GROUP_DOCS, GROUP_SHINGLES = 1024, 1 << 19, 2048, 1 << 20
#: Numbers of shingles whose possible similarities are looked at one by one; above, any is possible.
COUNTED = 64

_TOKEN = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def _chunk_hashes(chunk: str) -> tuple[int, ...]:
    return tuple(_word_hash(w) for w in _TOKEN.findall(chunk.lower()))


_single = Pieces(lambda chunk: h[0] if len(h := _chunk_hashes(chunk)) == 1 else None, 300_000)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the text's lower-cased words."""
    chunks = text.split(" ")
    one = [_single[c] for c in chunks]
    if None in one:
        flat: list[int] = []
        for c, h in zip(chunks, one):
            if h is None:
                flat += _chunk_hashes(c)
            else:
                flat.append(h)
        one = flat
    return np.array(one, np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; empty for a text without words."""
    h = word_hashes(text)
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = mixed(out * np.uint64(3) + h[k : k + n] + _ODD)
    return np.unique(out)


def seeds(count: int) -> np.ndarray:
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * _ODD)


def least_similarity(n: int, similarity: float) -> float | None:
    """The least similarity of `similarity` or more that a set of n shingles can have with another set; None if there is none."""
    best = None
    for lost in range(math.floor(n * (1 - similarity) + 1e-9) + 1):
        more = math.floor((n - lost) / similarity - n + 1e-9)
        if more >= 0 and lost + more:
            now = (n - lost) / (n + more)
            best = now if best is None else min(best, now)
    return best


def prefix_length(similarity: float, trees: int, depth: int, target: float) -> int:
    """The longest label prefix that reaches the target recall at the given similarity."""
    for k in range(depth, 1, -1):
        if 1 - (1 - similarity**k) ** trees >= target:
            return k
    return 1


def search_depths(similarity: float, trees: int, depth: int, target: float, counted: int = COUNTED) -> tuple[list[int], list[list[int]]]:
    """For each number of shingles up to `counted`, which stands for all larger ones: the depth at which its search ends, 0 for no
    search, and the rounds that it takes part in: its own, and deeper ones that end for texts it could be linked with."""
    own = []
    for n in range(counted + 1):
        s = similarity if n == counted else least_similarity(n, similarity) if n else None
        own.append(prefix_length(s, trees, depth, target) if s else 0)
    rounds = []
    for n, k in enumerate(own):
        near = {own[min(m, counted)] for m in range(math.ceil(n * similarity - 1e-9), math.floor(n / similarity + 1e-9) + 1)}
        rounds.append(sorted({k, *(x for x in near if x > k)}) if k else [])
    return own, rounds


def labels(s: np.ndarray, count: int) -> bytes:
    """`count` MinHashes, each the least multiply-shift value of the shingles, as 16-bit digests of them: equal ones stay equal, and others become so
    by a chance of 1 in 65,536, which can only make two documents meet that are then compared."""
    a = seeds(2 * count)
    times, plus = (a[0::2] | np.uint64(1))[:, None], a[1::2][:, None]
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(least, (s[None, i : i + 1024] * times + plus).min(1), out=least)
    return (mixed(least) >> np.uint64(48)).astype(">u2").tobytes()


def signatures(docs: DataFrame, count: int) -> DataFrame:
    """uid, doc_id, n (shingles), one and two (128 bits of the shingle set) and label (MinHashes, tree by tree)."""

    def make():
        own_memory("lsh_forest", _single.clear)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, one, two, label = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                n.append(len(s))
                one.append(int(mixed(s + _ODD).sum().astype(np.int64)) if len(s) else None)
                two.append(int(mixed(s ^ _ODD).sum().astype(np.int64)) if len(s) else None)
                label.append(labels(s, count) if len(s) else None)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(label, pa.binary())], ["uid", "doc_id", "n", "one", "two", "label"])

        return each

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("uid", "text", "doc_id"), make, f"uid long, doc_id {kind}, n long, one long, two long, label binary")


def verify(a: list[np.ndarray], b: list[np.ndarray], met: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, the j whose sets have a similarity of at least `least` with a[i]) over the pairs that met."""
    lens = np.array([len(x) for x in b])
    values, flat = np.unique(np.concatenate(b), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    mark = np.zeros(len(values), bool)
    for i in np.flatnonzero(met.any(1)):
        at = np.minimum(np.searchsorted(values, a[i]), len(values) - 1)
        at = at[values[at] == a[i]]
        mark[at] = True
        js = np.flatnonzero(met[i])
        if len(js) * 8 < len(b):
            common = np.array([mark[flat[starts[j] : starts[j] + lens[j]]].sum() for j in js])
        else:
            common = np.add.reduceat(mark[flat].astype(np.int64), starts)[js]
        mark[at] = False
        good = js[common >= least * (len(a[i]) + lens[js] - common) - 1e-9]
        if len(good):
            yield int(i), good


def _roots(n: int, pairs: Iterable[tuple[int, np.ndarray]]) -> list[int]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, js in pairs:
        for j in js:
            x, y = find(i), find(int(j))
            if x != y:
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def forest_join(docs: DataFrame, **options) -> DataFrame:
    """forest_groups without uid."""
    numbered = Scratch(docs.sparkSession, "numbered").numbered(docs, "doc_id", text_or_empty().alias("text"))
    return forest_groups(numbered, **options).drop("uid")


def forest_groups(docs: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> DataFrame:
    """uid, doc_id, class_id, n_links, component_id, kept for every row of docs (uid, doc_id, text).

    uid is a number for each row that stays the same when docs is read again. Words are runs of letters, digits and underscores in lower case. class_id is the smallest doc_id of
    the rows with the same set of shingles, n_links the number of other rows with a similarity of at least
    `similarity` (copies in the class included), component_id the smallest doc_id reachable by links; one
    row of each component is kept: the one with that doc_id. Null, empty and wordless texts link with
    nothing, even with each other, and are kept. Rows that share a doc_id are separate rows, linked if their texts are alike; exactly one row of a
    component is kept. A null doc_id is smaller than any other. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    scratch = Scratch(spark, "forest")
    base = docs.select("doc_id", text_or_empty().alias("text"), "uid")
    signed = scratch.write(signatures(base, trees * depth))
    # One row stands for each class of equal shingle sets.
    classes = scratch.write(signed.where("n > 0").groupBy("one", "two", "n").agg(F.min("uid").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label")))
    units = scratch.write(_likely(_units(classes, scratch, similarity, trees, depth, target), classes, similarity, trees, depth))
    links = scratch.write(_verified(units, base, similarity, trees, depth))
    scratch.drop(units)
    direct = links.where("kind = 0").groupBy(F.col("u").alias("rep")).agg(F.sum("v").alias("others"))
    roots = components(links.where("kind = 1").select("u", "v"), scratch).select(F.col("node").alias("rep"), F.col("root").alias("top"))
    per_class = scratch.write(
        classes.select("one", "two", "n", "rep", "copies").join(direct, "rep", "left").join(roots, "rep", "left")
        .select(F.col("one").alias("c1"), F.col("two").alias("c2"), F.col("n").alias("cn"), "rep", F.coalesce("top", "rep").alias("top"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    )
    rows = scratch.write(
        signed.select("uid", "doc_id", "one", "two", "n").join(per_class, (F.col("one") == F.col("c1")) & (F.col("two") == F.col("c2")) & (F.col("n") == F.col("cn")), "left")
        .select("uid", "doc_id", F.coalesce("rep", "uid").alias("rep"), F.coalesce("top", "uid").alias("top"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )
    by_class = rows.groupBy("rep").agg(F.min(F.struct("doc_id", "uid")).alias("first"), F.first("top").alias("top"))
    by_top = by_class.groupBy("top").agg(F.min("first").alias("least")).withColumnRenamed("top", "t")
    named = scratch.write(by_class.join(by_top, F.col("top") == F.col("t")).select(F.col("rep").alias("r"), F.col("first.doc_id").alias("class_id"), "least"))
    return rows.join(named, F.col("rep") == F.col("r")).select("uid", "doc_id", "class_id", "n_links", F.col("least.doc_id").alias("component_id"), (F.col("least.uid") == F.col("uid")).alias("kept"))


def _units(classes: DataFrame, scratch: Scratch, similarity: float, trees: int, depth: int, target: float) -> DataFrame:
    """rep, k, own, tree, unit, left, right: the members of every pair of blocks of every node with several members."""
    own, rounds = search_depths(similarity, trees, depth, target)
    at = F.least("n", F.lit(len(own) - 1)).cast("int") + 1
    of = lambda lists: F.element_at(F.array(*lists), at)
    searched = classes.select("rep", "label", "n", of([F.lit(k) for k in own]).alias("own"), F.explode(of([F.array(*map(F.lit, ks)).cast("array<int>") for ks in rounds])).alias("k"))
    tree = searched.select("rep", "own", "k", "label", "n", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    prefix = F.substring("label", F.col("tree") * (2 * depth) + 1, 2 * F.col("k"))
    entries = tree.select("rep", "own", "k", "tree", "n", F.concat(F.encode(F.concat_ws(":", "tree", "k", F.lit("")), "utf-8"), prefix).alias("node"))
    nodes = scratch.write(entries.groupBy(F.col("node").alias("at")).agg(F.count("*").alias("m"), F.sum("n").alias("size")).where("m > 1"))
    met = entries.join(nodes.hint("merge"), F.col("node") == F.col("at"))
    n_blocks = F.ceil(F.greatest(F.col("m") / BLOCK_DOCS, F.least("m", F.col("size") / BLOCK_SHINGLES))).cast("int")
    dealt = met.withColumn("blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other"))
    return scratch.write(paired.select("rep", "own", "k", "tree", unit.alias("unit"), (F.col("block") <= F.col("other")).alias("left"), (F.col("block") >= F.col("other")).alias("right")))


def _met(unit: pa.Table, similarity: float, trees: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the left and the right members of a unit and the pairs to be compared here: those whose search ends at this depth,
    that meet in this tree and in no earlier one, and that sizes and labels don't rule out."""
    left, right = (np.flatnonzero(unit[c].to_numpy(zero_copy_only=False)) for c in ("left", "right"))
    label = np.frombuffer(b"".join(unit["label"].to_pylist()), np.uint16).reshape(len(unit), trees, depth)
    n, own, rep = unit["n"].to_numpy(), unit["own"].to_numpy(), unit["rep"].to_numpy()
    k, tree = unit["k"][0].as_py(), unit["tree"][0].as_py()
    node = [np.unique(np.ascontiguousarray(label[:, t, :k]).view(f"V{2 * k}")[:, 0], return_inverse=True)[1].reshape(-1).astype(np.int32) for t in range(tree + 1)]
    out = np.zeros((len(left), len(right)), bool)
    step = max(1, (4 << 20) // max(1, len(right)))
    for i in range(0, len(left), step):
        a = left[i : i + step]
        open_ = node[tree][a][:, None] == node[tree][right]
        for t in range(tree):
            open_ &= node[t][a][:, None] != node[t][right]
            if not open_.any():
                break
        at, to = np.nonzero(open_)
        p, q = a[at], right[to]
        fine = np.minimum(n[p], n[q]) >= similarity * np.maximum(n[p], n[q]) - 1e-9
        fine &= (np.maximum(own[p], own[q]) == k) & (rep[p] != rep[q])
        fine &= ~(np.isin(p, right) & np.isin(q, left) & (rep[p] >= rep[q]))  # inside one block a pair counts once
        at, to, p, q = at[fine], to[fine], p[fine], q[fine]
        for j in range(0, len(at), 1 << 15):
            pairs = slice(j, j + (1 << 15))
            alike = (label[p[pairs]] == label[q[pairs]]).mean((1, 2)) >= similarity - MARGIN
            out[i + at[pairs][alike], to[pairs][alike]] = True
    return left, right, out


def _by_unit(group: pa.Table) -> Iterator[pa.Table]:
    group = group.sort_by([("unit", "ascending"), ("rep", "ascending")])
    unit = group["unit"].to_numpy()
    edges = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
    for i, j in zip(edges, edges[1:]):
        if j - i > 1:
            yield group.slice(i, j - i).combine_chunks()


def _grouped(rows: DataFrame, tasks: float) -> DataFrame:
    return rows.withColumn("task", F.pmod("unit", F.lit(max(1, math.ceil(tasks)))).cast("int"))


def _likely(units: DataFrame, classes: DataFrame, similarity: float, trees: int, depth: int) -> DataFrame:
    """The members of units that have a likely link there, with their classes' columns."""
    full = units.join(classes.select(F.col("rep").alias("r"), "n", "copies", "label"), F.col("rep") == F.col("r")).drop("r")
    names = ["unit", "rep", "own", "k", "tree", "left", "right", "n", "copies", "label"]

    def run(group: pa.Table) -> pa.Table:
        own_memory("lsh_forest", _single.clear)
        kept = []
        for unit in _by_unit(group.select(names)):
            left, right, met = _met(unit, similarity, trees, depth)
            if met.any():
                some = np.zeros(len(unit), bool)
                some[left[met.any(1)]] = some[right[met.any(0)]] = True
                kept.append(unit.filter(pa.array(some)))
        give_back()
        return pa.concat_tables(kept) if kept else group.select(names).slice(0, 0)

    schema = full.select(*names).schema
    return _grouped(full, units.count() / GROUP_DOCS).groupBy("task").applyInArrow(run, schema)


def _verified(units: DataFrame, base: DataFrame, similarity: float, trees: int, depth: int) -> DataFrame:
    """kind 0: u, links of u's class found in a unit; kind 1: an edge u, v of a spanning forest of a unit's links."""
    full = units.join(base.select("uid", "text"), F.col("rep") == F.col("uid")).drop("uid")

    def run(group: pa.Table) -> pa.Table:
        own_memory("lsh_forest", _single.clear)
        u, v, kind = [], [], []
        for unit in _by_unit(group):
            left, right, met = _met(unit, similarity, trees, depth)
            if not met.any():
                continue
            rep, copies, text = unit["rep"].to_numpy(), unit["copies"].to_numpy(), unit["text"]
            sets = {rep[i]: shingles(text[i].as_py()) for i in np.union1d(left[met.any(1)], right[met.any(0)])}
            left, right, met = left[met.any(1)], right[met.any(0)], met[met.any(1)][:, met.any(0)]
            count, found = np.zeros(len(rep), np.int64), []
            for i, js in verify([sets[x] for x in rep[left]], [sets[x] for x in rep[right]], met, similarity):
                i, js = left[i], right[js]
                count[i] += copies[js].sum()
                count[js] += copies[i]
                found.append((i, js))
            root = _roots(len(rep), found)
            linked = np.flatnonzero(count)
            edges = [(rep[x], rep[root[x]]) for x in linked if root[x] != x]
            u += [*rep[linked], *[e[0] for e in edges]]
            v += [*count[linked], *[e[1] for e in edges]]
            kind += [0] * len(linked) + [1] * len(edges)
        give_back()
        return pa.table({"kind": pa.array(kind, pa.int32()), "u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    size = units.agg(F.sum("n")).first()[0] or 0
    return _grouped(full, size / GROUP_SHINGLES).groupBy("task").applyInArrow(run, "kind int, u long, v long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all documents at a similarity of 0.8 or more of their five-word shingles: see forest_groups. Null and wordless texts link with nothing."""
    return forest_join(table(spark, sf_dir, "documents"))
