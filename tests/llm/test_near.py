import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanlens.llm import lsh_forest, pq_dedup
from spanlens.llm.common import Scratch
from spanlens.llm.components import components


def closed(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute_join(rows, least=0.8):
    """(doc_id, n_links, component_id) by comparing all pairs."""
    sets = []
    for r in rows:
        w = re.findall(r"\w+", (r.text or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9]
    roots = closed(len(rows), links)
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    least_of = {}
    for r, top in zip(rows, roots):
        least_of.setdefault(top, []).append(r.doc_id)
    low = {k: (None if None in v else min(v)) for k, v in least_of.items()}
    return sorted(((r.doc_id, k, low[t]) for r, k, t in zip(rows, n, roots)), key=repr), len(low)


@pytest.fixture(scope="module")
def near_docs(spark):
    """Chains of near copies around the threshold, and copies."""
    rng = np.random.default_rng(5)
    rows, words = [], [f"w{i}" for i in range(400)]
    for g in range(30):
        base = list(rng.choice(words, 60 + 10 * (g % 5)))
        for k in range(1 + g % 6):
            text = list(base)
            for at in rng.choice(len(base), k % 3, replace=False):
                text[at] = f"x{g}_{k}_{at}"
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, rows[i][1].upper()) for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_join_equals_all_pairs(odd_docs, documents, near_docs, spark):
    for docs in (odd_docs, near_docs, documents):
        rows = docs.collect()
        want, groups = brute_join(rows)
        got = lsh_forest.forest_join(docs).collect()
        assert sorted(((r.doc_id, r.n_links, r.component_id) for r in got), key=repr) == want
        assert sum(r.kept for r in got) == groups


def test_join_survives_other_splits(near_docs, shifting):
    docs = shifting(near_docs.collect())
    want, _ = brute_join(docs.collect())
    assert sorted(((r.doc_id, r.n_links, r.component_id) for r in lsh_forest.forest_join(docs).collect()), key=repr) == want


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK_DOCS", 7)
    words = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(i, f"{words} end{i}") for i in range(60)] + [(100, "other text here")], "doc_id long, text string")
    got = {r.doc_id: r for r in lsh_forest.forest_join(docs).collect()}
    assert got[100].n_links == 0 and all(got[i].n_links == 59 and got[i].component_id == 0 for i in range(60))


def test_search_depths():
    """The least similarity of a number of shingles by trying all, and the rounds that let two linkable texts meet at the deeper of their depths."""
    for n in range(1, 30):
        possible = [c / (n + m - c) for m in range(1, 60) for c in range(1, min(n, m) + 1) if (c, m) != (n, n) and c / (n + m - c) >= 0.8 - 1e-12]
        assert lsh_forest.least_similarity(n, 0.8) == (min(possible) if possible else None)
    own, rounds = lsh_forest.search_depths(0.8, 20, 6, 0.9999)
    assert own[0] == own[3] == 0 and own[-1] == 4 and max(own) <= 6
    for n, k in enumerate(own):
        assert not k or 1 - (1 - lsh_forest.least_similarity(n, 0.8) ** k) ** 20 >= 0.9999
        for m in range(n, min(len(own) - 1, int(n / 0.8)) + 1):
            if n and k and own[m]:
                assert max(k, own[m]) in rounds[n] and max(k, own[m]) in rounds[m]


def test_recall_on_a_larger_table(spark):
    """Links of every twentieth row of sf0.1 against all rows, exactly."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.n_links for r in lsh_forest.forest_join(docs).collect()}
    rows = docs.collect()
    sets = {r.doc_id: lsh_forest.shingles(r.text or "") for r in rows}
    holders = {}
    for i, s in sets.items():
        for x in s.tolist():
            holders.setdefault(x, []).append(i)
    found = wanted = 0
    for q in (i for i in sets if i % 20 == 0 and len(sets[i])):
        common = {}
        for x in sets[q].tolist():
            for i in holders[x]:
                common[i] = common.get(i, 0) + 1
        n = sum(c >= 0.8 * (len(sets[q]) + len(sets[i]) - c) - 1e-9 for i, c in common.items() if i != q)
        found, wanted = found + min(n, got[q]), wanted + n
        assert got[q] <= n
    assert wanted > 100 and found >= 0.999 * wanted


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=15))
def test_components_property(spark, links):
    df = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.root for r in components(df, Scratch(spark, "test")).collect()}
    want = closed(13, links)
    assert got == {k: want[k] for k in range(13) if any(k in e and e[0] != e[1] for e in links)}


def brute_vectors(rows):
    def usable(r):
        e = r.embedding
        return r.label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)

    links = []
    for dim in {len(r.embedding) for r in rows if usable(r)}:
        at = [i for i, r in enumerate(rows) if usable(r) and len(r.embedding) == dim]
        x = np.array([rows[i].embedding for i in at], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        c = x @ x.T
        links += [(at[i], at[j]) for i in range(len(at)) for j in range(i) if rows[at[i]].label == rows[at[j]].label and c[i, j] >= 0.93]
    roots = closed(len(rows), links)
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    low = {}
    for r, t in zip(rows, roots):
        low.setdefault(t, []).append(r.vec_id)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return sorted(((r.vec_id, k, low[t], r.vec_id is not None and r.vec_id == low[t]) for r, k, t in zip(rows, n, roots)), key=repr)


def test_vectors_equal_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    base = [float(x) for x in np.random.default_rng(1).normal(size=4)]
    odd = [(1, base, 0), (2, base, 0), (2, base, 0), (3, base, 1), (4, base, None), (5, None, 0), (6, [0.0] * 4, 0), (7, [float("nan"), 1.0, 1.0, 1.0], 0), (8, [None, 1.0, 1.0, 1.0], 0),
           (9, [float("inf"), 1.0, 1.0, 1.0], 0), (10, [1.0, 2.0], 0), (13, [2.0, 4.1], 0), (14, [5.0], 0), (None, base, 0), (11, [x * 1.01 + 0.01 for x in base], 0), (12, [], 0)]
    small = spark.createDataFrame([(*r, "x", 1, 2) for r in odd], "vec_id long, embedding array<float>, label int, codes string, list int, root int")
    empty = small.limit(0)
    for vectors in (table, small, empty):
        got = sorted(map(tuple, pq_dedup.vector_links(vectors).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)
        assert got == brute_vectors(vectors.select("vec_id", "embedding", "label").collect())


def test_vectors_in_blocks_at_the_threshold(spark, monkeypatch):
    """Clusters whose cosines lie around the threshold, many copies, lists over several blocks."""
    monkeypatch.setattr(pq_dedup, "BLOCK_QUERIES", 16)
    monkeypatch.setattr(pq_dedup, "BLOCK_MEMBERS", 32)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 64))
    rows = [(i, [float(x) for x in np.float32(centres[i % 12] + rng.normal(size=64) * (0.2 + 0.02 * (i % 8)))], i % 2) for i in range(700)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(80)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, pq_dedup.vector_links(vectors).collect()), key=repr)
    want = brute_vectors(vectors.collect())
    assert got == want and sum(w[1] for w in want) > 0


@pytest.mark.parametrize("dim", [64, 384])
@pytest.mark.parametrize("kind", ["arc", "subspace 3", "subspace 8"])
def test_vectors_on_a_surface_lose_no_link(spark, kind, dim):
    """Differences with a preferred direction, across which lists are cut."""
    rng = np.random.default_rng(5)
    n = 2000
    if kind == "arc":
        t = np.sort(rng.random(n)) * 20
        x = np.stack([np.cos(t / 20 * 3), np.sin(t / 20 * 3), t / 40], 1)
    else:
        k = int(kind[-1])
        x = rng.normal(size=(100, k))[np.arange(n) % 100] + rng.normal(size=(n, k)) * 0.3
    x = x @ np.linalg.qr(rng.normal(size=(dim, x.shape[1])))[0].T
    vectors = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, pq_dedup.vector_links(vectors).collect()), key=repr)
    want = brute_vectors(vectors.collect())
    assert sum(w[1] for w in want) > n
    assert got == want


def test_empty_table(no_docs):
    assert lsh_forest.forest_join(no_docs).count() == 0
