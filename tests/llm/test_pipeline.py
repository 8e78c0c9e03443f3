import math
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spanlens.llm import language_id
from spanlens.llm.common import Scratch
from spanlens.llm.exact_dedup import LOWER, UPPER

from .test_langs_and_packing import check_packing
from .test_near import brute_join
from .test_secrets_and_copies import brute_spans


def masked(text):
    """The text with each maximal run of found spans replaced."""
    out, at = "", 0
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in brute_spans(text).split(",") if s)
    merged = []
    for a, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += text[at:a] + "[secret]"
        at = b
    return out + text[at:]


def test_pipeline_equals_brute_force(spark, sf, documents):
    got = corpus_pipeline.run(spark, sf).collect()
    docs = [r for r in documents.collect() if any(c.isalpha() for c in r.text or "")]
    last = {}
    for r in docs:
        key = r.text.translate(str.maketrans(UPPER, LOWER))
        last[key] = max(r.doc_id, last.get(key, -1))
    docs = [r for r in docs if r.doc_id in set(last.values())]
    roots = {d: c for d, _, c in brute_join(docs)[0]}
    docs = [r for r in docs if roots[r.doc_id] == r.doc_id]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in docs:
        ids = lib.encode(masked(r.text), add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            want.append((r.doc_id, k, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert check_packing(got) <= math.ceil(sum(w[3] for w in want) / 2048) * 1.05 + 1


def test_stages_return_the_columns_of_documents(spark, sf, odd_docs, no_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (odd_docs.select(columns), no_docs):
        scratch = Scratch(spark, "stages")
        docs = scratch.write(start)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = scratch.write(stage(spark, docs, sf))
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() >= docs.count()


def test_columns_of_any_name_pass_through(spark, sf):
    """Columns that operators use themselves stay as they are, in every stage, while two pipelines run in turn."""
    names = ["uid", "score", "lang_pred", "held_out", "_id", "_hit", "_spans", "_blob", "blob", "n", "label", "rep", "kept", "grp", "digit"]
    words = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(4)]
    rows = [(i, t, None, None, len(t), *(f"{c}{i}" for c in names)) for i, t in enumerate([*words, words[0], words[1] + " more", "token = 24be64439e3e49cf46b2d7c9"])]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars int", *(f"{c} string" for c in names)]))
    both = [docs, docs.where("doc_id <> 3")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        results = [stage(spark, d, sf) for d in both]
        scratch = Scratch(spark, "written")
        both = [scratch.write(r) for r in results]
        for d in both:
            assert d.columns == docs.columns, name
            assert all(r[c] == f"{c}{r.doc_id}" for r in d.collect() for c in names), name
    assert [sorted(r.doc_id for r in d.collect()) for d in both] == [[1, 2, 3, 4, 6], [1, 2, 4, 6]]
    assert [r.text for r in both[0].where("doc_id = 6").collect()] == ["[secret]"]


def test_copies_go_in_other_splits(spark, sf, shifting):
    """The rows that stay are those whose text has no other copy with a larger doc_id, or a smaller one for near copies."""
    texts = [" ".join(f"w{i % 30}x{j}" for j in range(40)) for i in range(45)]
    docs = shifting(list(enumerate(texts)))
    for stage, want in ((corpus_pipeline.drop_copies, range(15, 45)), (corpus_pipeline.drop_near_copies, range(30))):
        for splits in ("1", "16"):
            kept = stage(spark, docs, sf)
            spark.conf.set("spark.sql.files.minPartitionNum", splits)
            assert sorted(r.doc_id for r in kept.collect()) == list(want)


def test_unlabelled_documents_stay(spark, sf, documents):
    """Nothing can be learned where all lang are null, or all labelled rows are held out: only documents without a letter go."""
    held = language_id.held_out()
    some = documents.limit(60).unionByName(documents.limit(2).withColumns({"text": F.lit("12 !"), "doc_id": F.lit(10**6)}))
    for docs in (some.withColumn("lang", F.lit(None).cast("string")), some.withColumn("lang", F.when(held, F.col("lang")))):
        got = sorted((tuple(r) for r in corpus_pipeline.identify_language(spark, docs, sf).select("doc_id", "lang").collect()), key=lambda r: r[0])
        assert [r[0] for r in got] == sorted(r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or ""))
        assert {r[0]: r[1] for r in got} == {r.doc_id: r.lang for r in docs.collect() if r.doc_id in {x[0] for x in got}}
