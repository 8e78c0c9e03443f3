import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanlens.llm import language_id, packing

WORD, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "piece_bpe_32k.model"))


def packed_rows(docs):
    lib = Tokenizer.from_file(WORD)
    out = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            out.append((r.doc_id, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=repr)


def check_packing(rows, capacity=2048):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= capacity
    return len(at)


def test_pieces_and_sequences(odd_docs, documents):
    for docs in (odd_docs, documents):
        got = packing.pack(docs, WORD).collect()
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == packed_rows(docs)
        n = check_packing(got)
        assert n <= math.ceil(sum(r.length for r in got) / 2048) * 1.05 + 1


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_places_every_rank_once(counts):
    seen, used = defaultdict(list), defaultdict(list)
    for size, lo, hi, first, offset in packing.plan(counts, 64):
        seen[size] += range(lo, hi)
        for i in range(hi - lo):
            used[first + i].append((offset, size))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in used.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 64


def brute_log(word, p, number, none, unknown):
    """Sum over all segmentations by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        k = number.get(word[:n], unknown if n == 1 else none)
        if p[k] > 0:
            total += p[k] * brute_log(word[n:], p, number, none, unknown)
    return total


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba"]
    lattice = language_id.Lattice(pieces)
    p = np.array([0.1, 0.2, 0.1, 0.1, 0.2, 0.1, 0.1, 0.1, 1e-8, 0.0])[:, None]
    for word in ("▁a", "▁abab", "▁xab", "▁abaabba"):
        want = brute_log(word, p[:, 0], lattice.number, lattice.n + 1, lattice.n)
        (_, at), = lattice.blocks([word])
        assert np.isclose(language_id.forward(at, p)[0, -1, 0], want)
        assert np.isclose(language_id.log_word(lattice.of(word), p)[0], math.log(want))
    long = "▁" + "ab" * 300
    assert np.isfinite(language_id.log_word(lattice.of(long), p)[0])


def test_lattice_equals_lookup():
    lattice = language_id.Lattice(language_id.vocabulary(PIECES))
    words = ["▁haus", "▁don", "t", "▁straße", "▁中文", "▁a\u0301b", "\U0001f600x", "▁internationalisation", "s"]
    for ks, at in lattice.blocks(words, rows=2):
        for k, own in zip(ks, at):
            assert [[int(x) for x in row[: len(want)]] for row, want in zip(own, lattice.of(words[k]))] == lattice.of(words[k])


def test_predictions_equal_a_plain_predictor(spark, odd_docs, documents):
    """Each text's words one by one, with all segmentations summed word by word."""
    model = language_id.fit(documents, PIECES)
    lattice = language_id.Lattice(model.pieces)
    rows = [r.text for r in documents.limit(60).collect()] + [r.text for r in odd_docs.collect()]
    for got in language_id.predict(spark.createDataFrame([(t,) for t in rows], "text string"), model).collect():
        words = language_id.words_of(got.text or "")
        logs = model.prior + sum((language_id.log_word(lattice.of(w), model.p) for w in words), np.zeros(len(model.languages)))
        assert got.lang_pred == (model.languages[int(logs.argmax())] if words else "und")
        assert math.isclose(got.score, 1 / np.exp(logs - logs.max()).sum() if words else 0.0, rel_tol=1e-6)


def test_long_words_are_fitted():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aba"]
    lattice = language_id.Lattice(pieces)
    p = [0.1, 0.2, 0.1, 0.1, 0.2, 0.1, 0.1, 0.1, 1e-8, 0.0]
    for word in ("▁a", "▁abab", "▁xab", "▁abaabba"):
        rows = lattice.of(word)
        want = dict.fromkeys(range(lattice.n + 1), 0.0)

        def cut(at, chance, seen):
            if at == len(word):
                for x in seen:
                    want[x] += chance
            for w, x in enumerate(rows[at] if at < len(word) else ()):
                if p[x]:
                    cut(at + w + 1, chance * p[x], [*seen, x])

        cut(0, 1.0, [])
        total = brute_log(word, p, lattice.number, lattice.n + 1, lattice.n)
        got = dict.fromkeys(want, 0.0)
        for x, n in language_id.expected(rows, p):
            got[x] += n
        assert np.allclose([want[x] / total for x in want], list(got.values()))
    model = language_id.fit_counts(pieces, {"xx": {"▁" + "ab" * 20: 5.0, "▁" + "abé" * 900: 1.0}}, {"xx": 1})
    assert model.p[lattice.number["ab"], 0] > 5 * model.p[lattice.number["aba"], 0]


def test_language_of_few_texts_is_learned(spark):
    """Copies of few texts, none of which a draw by share would take, and letterless texts before them."""
    docs = [(f"wort zahl haus baum {'abcdefgh'[k % 8]}", "de") for k in range(4000)] + [(str(k), "de") for k in range(900)]
    docs += [(f"the house and a tree {'abcdefgh'[k % 8]}", "en") for k in range(20)]
    model = language_id.fit(spark.createDataFrame(docs, "text string, lang string"), PIECES, sample_docs=2)
    assert model.languages == ["de", "en"]
    got = language_id.predict(spark.createDataFrame([("zahl haus wort",)], "text string"), model).collect()
    assert [r.lang_pred for r in got] == ["de"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.language_id(docs.select("doc_id", "text", "lang"), PIECES).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_odd_texts(odd_docs, no_docs, documents):
    model = language_id.fit(documents, PIECES)
    got = {r.doc_id: r for r in language_id.predict(odd_docs, model).collect()}
    assert set(got[3].asDict()) == {*odd_docs.columns, "lang_pred", "score"}
    for r in got.values():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert language_id.language_id(no_docs, PIECES).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd_docs, language_id.fit(no_docs, PIECES)).collect()} == {"und"}
    assert packing.pack(no_docs, WORD).count() == 0
