import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanlens.llm import arrow_stream, bpe_tree, token_counts, word_ids

BYTE, WORD, MULTI = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))
TEXT = st.text(st.sampled_from("ab cdeThor.,'st\n\t  éÉ　\x1c<|endoftext|>19!\U0001f600"), max_size=60) | st.text(max_size=40)


@pytest.fixture(scope="module")
def library():
    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


@pytest.fixture(scope="module")
def tik():
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pairs(df):
    return sorted(((r["doc_id"], *[r[c] for c in df.columns if c != "doc_id"]) for r in df.collect()), key=repr)


def test_counts_equal_the_library(odd_docs, documents, library):
    for docs in (odd_docs, documents):
        want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(library[BYTE].encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in docs.collect()), key=repr)
        assert pairs(token_counts.token_counts(docs, BYTE)) == want


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_count_property(text):
    assert token_counts.counter(BYTE)(text) == len(_lib(BYTE).encode(text, add_special_tokens=False).ids)


_libs = {}


def _lib(path):
    return _libs.setdefault(path, Tokenizer.from_file(path))


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_word_ids_property(texts):
    got = word_ids.word_encoder(WORD)(pa.array(texts, pa.string()), 7)
    assert [x.tolist() for x in got] == [_lib(WORD).encode(t, add_special_tokens=False).ids + [7] for t in texts]


def test_tree_equals_tiktoken(odd_docs, documents, tik):
    for docs in (odd_docs, documents):
        want = []
        for r in docs.collect():
            ids = tik.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        assert pairs(bpe_tree.bpe_round_trip(docs, MULTI)) == sorted(want, key=repr)


@settings(max_examples=300, deadline=None)
@given(TEXT | st.text(st.sampled_from("ab"), min_size=20, max_size=400))
def test_tree_property(text):
    own = bpe_tree.codec(MULTI)
    ids = own.ids(text)
    assert own.decoded(ids) == text.encode()
    with open(MULTI, "rb") as f:
        enc = _libs.setdefault("tik", None) or _libs.update(tik=tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})) or _libs["tik"]
    assert ids == enc.encode_ordinary(text)
    assert own.round_trip(text)[1] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_encode_then_decode(odd_docs):
    ids = bpe_tree.encode_ids(odd_docs, MULTI)
    data = bpe_tree.decode_ids(ids, MULTI)
    want = sorted(((r.doc_id, (r.text or "").encode()) for r in odd_docs.collect()), key=repr)
    assert sorted(((r.doc_id, bytes(r.data)) for r in data.collect()), key=repr) == want


@pytest.mark.parametrize("length", [16, 2048])
def test_stream_files_hold_every_id_in_order(spark, odd_docs, documents, library, tmp_path, length):
    for k, docs in enumerate((odd_docs, documents)):
        manifest = arrow_stream.write_shards(docs, f"{tmp_path}/{k}", WORD, length=length)
        rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        at, want, flat = 0, [], []
        for r in rows:
            ids = library[WORD].encode(r.text or "", add_special_tokens=False).ids + [2]
            want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
            flat += ids
        assert pairs(arrow_stream.read_back(spark, manifest)) == sorted(want, key=repr)
        read = [ids[mask] for m in manifest for ids, mask in arrow_stream.read_sequences(m[1])]
        assert np.concatenate(read).tolist() == flat
        for m in manifest:
            shard = arrow_stream.Sequences(m[1], m[3])
            every = [(i.tolist(), k.tolist()) for ids, mask in arrow_stream.read_sequences(m[1]) for i, k in zip(ids, mask)]
            assert len(shard) == len(every)
            for k in (len(shard) - 1, 0, len(shard) // 2):
                ids, mask = shard[k]
                assert (ids.to_pylist(), mask.to_pylist()) == every[k]
                held = pa.total_allocated_bytes()
                assert len(shard[k][0]) == length and pa.total_allocated_bytes() == held  # nothing is copied
            with pytest.raises(IndexError):
                shard[len(shard)]


def test_string_ids_and_lost_attempts(spark, tmp_path, library):
    docs = spark.createDataFrame([("b", "two words"), (None, None), ("a", "one")], "doc_id string, text string")
    (tmp_path / "000000-lost.arrows").write_bytes(b"part")
    manifest = arrow_stream.write_shards(docs, str(tmp_path), WORD, shards=1)
    assert not (tmp_path / "000000-lost.arrows").exists()
    got = arrow_stream.read_back(spark, manifest, docs.schema["doc_id"].dataType).collect()
    assert [(r.doc_id, r.start) for r in got] == [(None, 0), ("a", 1), ("b", 1 + got[1].n_tokens)]


def test_empty_table(spark, no_docs, tmp_path):
    assert token_counts.token_counts(no_docs, BYTE).count() == 0
    assert bpe_tree.bpe_round_trip(no_docs, MULTI).count() == 0
    assert arrow_stream.read_back(spark, arrow_stream.write_shards(no_docs, str(tmp_path), WORD)).count() == 0
