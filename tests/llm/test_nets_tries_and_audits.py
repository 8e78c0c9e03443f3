import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanlens.llm import divergence, prefix_trie, quality_net

# --- quality_net ---


def plain_log_odds(net, text):
    """The network window by window."""
    data = [*(text or "").encode(), *[0] * (quality_net.WIDTH - 1)]
    n = len(data) - quality_net.WIDTH + 1
    total = 0.0
    for lo in range(0, n, quality_net.CHUNK):
        hi = min(n, lo + quality_net.CHUNK)
        answers = [sum(net.filters[k, data[t + k]].astype(float) for k in range(quality_net.WIDTH)) for t in range(lo, hi)]
        total += (hi - lo) * float(np.maximum(np.max(answers, 0), 0) @ net.weights.astype(float))
    return net.bias + (total / n if n else 0)


def test_scores_cover_every_window_of_the_whole_text():
    rng = np.random.default_rng(3)
    filters = rng.normal(size=(quality_net.WIDTH, 256, quality_net.FILTERS))
    filters[:, 0] = 0
    net = quality_net.Network(filters, rng.normal(size=quality_net.FILTERS), 0.3)
    texts = [None, "", "a", "short", "x" * 255, "x" * 256 + "y", "é中\U0001f600" * 300, "word " * 900 + "end\0 NUL"]
    for chunks in (1, 2, 64):
        got = net.log_odds(pa.array(texts), chunks)
        assert np.allclose(got, [plain_log_odds(net, t) for t in texts], atol=1e-4)
    assert np.allclose(net.log_odds(pa.array(["skip", *texts]).slice(1)), net.log_odds(pa.array(texts)))
    for text in (t.encode() for t in texts if t):
        cut, sizes = quality_net.chunks_of(text, most=10**6)
        assert sizes.sum() == len(text) and b"".join(c[:s].tobytes() for c, s in zip(cut, sizes)) == text
    assert len(quality_net.chunks_of(b"x" * 10**6)[0]) == quality_net.SAMPLE_CHUNKS


def test_held_out_quality(spark):
    """Labels of rows that the fit never sees are found again; clean rows stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_net.quality(docs, labels).collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert len(bad) > 10 and auc > 0.97
    assert np.mean([s >= 0.5 for s in good]) > 0.97


def test_quality_of_odd_tables(spark, odd_docs, no_docs):
    some = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(28)] + [(6, 0, 1, "x"), (None, 1, 0, "x"), (8, 7, 0, "x"), (9, None, 0, "x"), (10**6, 1, 0, "x")], "doc_id long, quality int, toxic int, score string")
    for docs in (odd_docs.withColumn("score", F.lit("mine")), odd_docs.withColumn("h", F.lit(1))):
        got = quality_net.quality(docs, some).collect()
        assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
        assert [r.held_out for r in got if r.doc_id is None] == [False]
    one_kind = quality_net.quality(odd_docs, some.where("quality = 1")).collect()
    assert len({r.score for r in one_kind}) == 1 and one_kind[0].predicted == 1
    assert {r.score for r in quality_net.quality(odd_docs, some.limit(0)).collect()} == {0.5}
    assert quality_net.quality(no_docs, some).count() == 0


# --- prefix_trie ---


def brute_trie(rows):
    """Every node of the trie by walking each rebuilt conversation."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if paths[c] == p).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], ends(p)) for p, m in members.items())


CONVERSATION = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(df):
    return sorted(tuple(r) for r in prefix_trie.trie(df).select(COLUMNS).collect())


def test_trie_equals_brute_force(spark, sf, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["hi", "yes", "no", "é中", "", None]
    rows = []
    for c in range(60):
        for k in range(int(rng.integers(1, 12))):
            rows.append((c, int(k) if rng.random() > 0.1 else None, ["user", "assistant", None][k % 3], words[int(rng.integers(0, 6))] if k > 3 else "same"))
    rows += [(7, 0, "user", "tie"), (7, 0, "user", "tie"), (7, 0, "assistant", "tie"), (None, 0, "user", "lost"), (1004, 0, "user", "alone"), (1003, 0, "a:", "b"), (1002, 0, "a", ":b")]
    odd = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], f"{CONVERSATION}, node int, path string, depth int")
    given = spark.read.parquet(f"{sf}/conversations.parquet")
    assert trie_of(odd) == brute_trie(rows)
    assert trie_of(given) == brute_trie([tuple(r) for r in given.select("conv_id", "turn", "role", "text").collect()])
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2)
    assert trie_of(odd.repartition(5)) == brute_trie(rows)
    assert prefix_trie.trie(odd.limit(0)).count() == 0


def test_a_long_conversation_and_forks_of_it_take_few_rounds(spark, monkeypatch):
    """Chains are contracted: a fork at every other turn is one round of messages, a chain none."""
    def turns(c, cut, own):
        return [(c, k, "u", f"turn {k}" if k < cut else f"own {own} {k}") for k in range(max(cut, 0) + (3 if own else 0))]

    rows = turns(0, 300, 0)
    for i in range(40):  # ids that share the first turns by their text alone
        rows += turns(5 * (i + 1), 7 * i, i + 1)
    rounds = []
    write = prefix_trie.Scratch.write
    monkeypatch.setattr(prefix_trie.Scratch, "write", lambda self, df: (rounds.append(1), write(self, df))[1])
    assert trie_of(spark.createDataFrame(rows, CONVERSATION)) == brute_trie(rows)
    assert len(rounds) < 20


# --- divergence ---


def brute_audit(rows):
    import re

    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    groups = {r[:2] for r in rows}
    for lang, source, text in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 10]
        sources = sorted(s for x, s in groups if x == lang)
        v = len(kept)
        p = {}
        for s in [*sources, None]:
            c = counts[lang, s] if s is not None else sum((counts[lang, x] for x in sources), Counter())
            total = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, values, most in (("pair", pairs, None), ("term", terms, 10)):
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked[:most])]
    return sorted(out)


def test_audit_equals_brute_force(spark, odd_docs, no_docs, documents, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(8)] + ["É", "中文", "İx", "\x1cq", "A1b", " z"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    made = [(["en", "de", None][i % 3], f"s{rng.integers(0, 7)}" if i % 50 else None, " ".join(rng.choice(vocabulary, rng.integers(0, 40), p=weights / weights.sum()))) for i in range(400)]
    made += [("xx", "only", "few words"), ("yy", "a", None), ("yy", "b", ""), ("en", "empty", None)]
    made = spark.createDataFrame([(*r, 1, 2, "q") for r in made], "lang string, source string, text string, n int, p0 int, term string")
    for docs in (made, odd_docs, documents):
        want = brute_audit([tuple(r) for r in docs.select("lang", "source", "text").collect()])
        assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == want
    monkeypatch.setattr(divergence, "SLICE_BYTES", 100)
    monkeypatch.setattr(divergence, "SALTS", 3)
    assert sorted(tuple(r) for r in divergence.audit(made).collect()) == brute_audit([tuple(r) for r in made.select("lang", "source", "text").collect()])
    assert divergence.audit(no_docs).count() == 0


@pytest.mark.parametrize("n, total, terms", [(0, 0, 1), (10**13, 3 * 10**13, 10**9), (5, 7, 3)])
def test_shares_are_exact(spark, n, total, terms):
    got = spark.range(1).select(divergence._share(F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(terms).cast("long")).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)
