import hashlib
from collections import Counter

import numpy as np
import pytest

from spanlens.llm import suffix_dedup


def brute(rows, length):
    texts = [(r.text or "").encode() for r in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((r.doc_id, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_cover_is_a_perfect_difference_set():
    for d, v in ((suffix_dedup.COVER, suffix_dedup.PERIOD), (suffix_dedup.DENSE_COVER, suffix_dedup.DENSE_PERIOD)):
        assert sorted((a - b) % v for a in d for b in d if a != b) == list(range(1, v))


def test_bucket_finds_what_a_count_finds():
    rng = np.random.default_rng(8)
    word = lambda n: rng.integers(97, 101, n, np.uint8).tobytes()
    shared = word(700)
    segments = [word(k) + shared[a:b] + word(600 - k) for k, a, b in ((5, 0, 500), (17, 30, 640), (90, 100, 499), (0, 299, 700))] + [b"z" * 900, b"ab" * 450]
    count = Counter(t[i : i + 400] for t in segments for i in range(len(t) - 399))
    want = [count[t[i : i + 400]] > 1 if i < len(t) - 399 else False for t in segments for i in range(len(t))]
    assert suffix_dedup.Bucket(segments, 400).repeated().tolist() == want
    # Fingerprints that all meet decide nothing: the bytes do.
    bucket = suffix_dedup.Bucket(segments, 400)
    a, b = np.arange(0, 500), np.arange(500, 1000)
    at = np.concatenate(([0], np.cumsum([len(t) for t in segments])))
    fits = np.array([any(o <= x and x + 400 <= e for o, e in zip(at, at[1:])) for x in range(1000)])
    text = b"".join(segments)
    both = fits[a] & fits[b]
    assert bucket.tie(a[both], b[both]).tolist() == [text[x : x + 400] == text[y : y + 400] for x, y in zip(a[both], b[both])]


def test_least_of_runs():
    x = np.random.default_rng(2).integers(0, 50, 1000).astype(np.uint64)
    for width in (1, 7, 273, 1000):
        assert suffix_dedup.sliding_least(x, width).tolist() == [int(x[i : i + width].min()) for i in range(1000 - width + 1)]


@pytest.mark.parametrize("batch_bytes", [3000, 4 << 20])
def test_removal_equals_brute_force(spark, odd_docs, documents, batch_bytes):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefé \n"), n))
    shared = [word(n) for n in (399, 400, 401, 650, 1500)]
    texts = [word(300) + s[i:] + word(200) for s in shared for i in (0, 7)] + [word(50) + shared[2] + shared[2] + "é", "ab" * 500, "z" * 399, "z" * 400, shared[4], shared[4]]
    planted = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for docs in (planted, odd_docs) + ((documents,) if batch_bytes > 3000 else ()):
        got = suffix_dedup.remove_repeats(docs, batch_bytes=batch_bytes, bucket_bytes=20_000).collect()
        assert sorted((tuple(r)[:5] for r in got), key=repr) == brute(docs.collect(), 400)
        texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
        for r in got:
            ends = [0, *(x for s in r.removed for x in (s.start, s.end)), r.n_bytes]
            kept = b"".join(texts[r.doc_id][a:b] for a, b in zip(ends[::2], ends[1::2]))
            assert hashlib.sha256(kept).hexdigest() == r.kept_sha256 and r.kept == (kept if r.removed else None)


def test_copies_on_both_sides_of_a_long_document(spark):
    """The long one, over 1 MiB, holds a passage that another one shares, and one that it repeats itself."""
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdef \n"), n))
    copy, long = word(900), word(1_200_000)
    texts = [copy, long + long[5000:5600], copy, word(300) + copy[100:700] + word(200), copy, word(100), word(50) + long[-900:-200] + word(70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = brute(docs.collect(), 400)
    for batch_bytes in (4000, 4 << 20):
        got = suffix_dedup.remove_repeats(docs, batch_bytes=batch_bytes, bucket_bytes=1000).collect()
        assert sorted((tuple(r)[:5] for r in got), key=repr) == want


def test_removal_survives_other_splits(shifting):
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdef \n"), n))
    shared = [word(600) for _ in range(6)]
    docs = shifting([(i, word(300) + (shared[i % 6] if i % 3 else "") + word(200)) for i in range(40)])
    got = suffix_dedup.remove_repeats(docs, batch_bytes=3000)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == brute(docs.collect(), 400)


def test_empty_table(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_query_returns_what_is_left(spark, tmp_path):
    """A passage of over 50 words stays below 400 bytes and goes from 400 on; what is left comes with its digest."""
    rng = np.random.default_rng(9)
    words = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n)) + " "
    short, long = words(60), words(80)
    assert (len(short), len(long)) == (360, 480)
    texts = [words(40) + p + words(30) for p in (short, short, long, long)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffix_dedup.op8(spark, f"file://{tmp_path}").collect()}
    assert all(got[i].n_removed == 0 and got[i].kept is None and got[i].kept_sha256 == hashlib.sha256(texts[i].encode()).hexdigest() for i in (0, 1))
    for i in (2, 3):
        assert got[i].n_removed >= 480 and long.encode() not in got[i].kept and len(got[i].kept) == got[i].n_bytes - got[i].n_removed
        assert hashlib.sha256(got[i].kept).hexdigest() == got[i].kept_sha256
