import pytest
from pyspark.sql import functions as F

from spanlens.operators import judge, propose, spans, synth
from spanlens.sources import corpora
from spanlens.streaming.scan import counts_by_window, scan_stream


CASES = [
    ("seen 3 Mar 2020 ok", "3 Mar 2020", "shape:date"), ("on 2004年3月8日。", "2004年3月8日", "shape:date"), ("call +63 917 552 0184 now", "+63 917 552 0184", "shape:phone"), ("call 8xxx 6631.", "8xxx 6631", "shape:phone"),
    ("ref FDW/26/0071834 end", "FDW/26/0071834", "shape:id"), ("plate FBL 6632 E here", "FBL 6632 E", "shape:plate"), ("see IMG_4410.JPG.", "IMG_4410.JPG", "shape:file"), ("born l4.O2.l95l", "l4.O2.l95l", "shape:ocr_date"),
    ("nine one seven seven zero four two six", "nine one seven seven zero four two six", "shape:spoken_number"), ("he d. 1998 at home", "1998", "shape:date"), ("WeChat ID linzq_1992sg", "linzq_1992sg", "shape:handle"),
    ("social.example.com/a.b.1993 x", "social.example.com/a.b.1993", "shape:url"), ("G****262U", "G****262U", "shape:id"), ("NRIC ending 412D", "412D", "shape:id"), ("Sex/YOB M/1961", "1961", "shape:yob"),
    ("D3S1358 15/16, vWA 17/18", "D3S1358 15/16, vWA 17/18", "shape:dna"), ("known chronic hepatitis B infection", "known chronic hepatitis B infection", "lexicon:hiv_sti"), ("at Blk 12 Ang Mo Kio Ave 3, #05-12", "Blk 12 Ang Mo Kio Ave 3, #05-12", "shape:address"),
]


def test_shapes(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "row long, text string")
    found = propose.propose(rows).collect()
    got = {(r.row, r.match, s) for r in found for s in r.sources}
    assert [c for i, c in enumerate(CASES) if (i, c[1], c[2]) not in got] == []
    for r in found:
        assert CASES[r.row][0][r.span_start - 1 : r.span_end] == r.match


def test_shapes_need_their_cue(spark):
    rows = spark.createDataFrame([(1, "the steps 412D and line immunoassay and 1998")], "row long, text string")
    assert not [r for r in propose.propose(rows).collect() if r.match in ("412D", "immunoassay", "1998")]


def test_markup_round_trip(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("# a comment\n=== n1 | letter ===\nDr {{name|Tan}} \U0001f600 saw {{dob|1 Jan 1950}}.\n\n=== n2 | cell ===\nnothing\n", encoding="utf-8")
    got = {r.id: r for r in corpora.read_markup(spark, str(tmp_path)).collect()}
    assert got["n1"].kind == "letter" and got["n1"].text == "Dr Tan \U0001f600 saw 1 Jan 1950."
    assert [(x.label, got["n1"].text[x.start - 1 : x.end], x.match) for x in got["n1"].spans] == [("name", "Tan", "Tan"), ("dob", "1 Jan 1950", "1 Jan 1950")]
    assert got["n2"].spans == []
    checks = {(r.what, r.name): r.n for r in corpora.set_check(corpora.read_markup(spark, str(tmp_path))).collect()}
    assert checks["documents", "all"] == 2 and checks["documents", "negative"] == 1 and checks["label", "dob"] == 1
    (tmp_path / "bad.txt").write_text("=== n3 | x ===\n{{nolabel|x}}\n")
    with pytest.raises(Exception, match="bad mark"):
        corpora.read_markup(spark, str(tmp_path / "bad.txt")).collect()


def test_manifest(spark, tmp_path):
    out = f"{tmp_path}/out"
    first = corpora.write_jsonl(spark.range(3).toDF("n"), out)
    assert {r.state for r in corpora.verify_manifest(first, corpora.manifest(spark, out)).collect()} == {"ok"}
    with pytest.raises(ValueError):
        corpora.guard_output(f"{tmp_path}/Dropbox/x")


def test_corpus_is_sound_and_repeatable(spark):
    docs = synth.corpus(spark, 60)
    rows = docs.collect()
    assert synth.faults(docs).count() == 0
    assert rows == synth.corpus(spark, 60).collect()
    for r in rows:
        for x in [*r.spans, *r.decoys]:
            assert r.text[x.start - 1 : x.end] == x.match
    names = {s: {x.match.split()[-1] for r in rows if r.split == s for x in r.spans if x.label == "name"} for s in ("train", "test")}
    assert not names["train"] & names["test"]
    sft = synth.sft_rows(docs, docs.limit(1).select("text"))
    assert sft.where(F.col("doc") == rows[0].id).count() == 0 and sft.count() > 100


def test_policy_needs_its_parts(spark):
    for bad in ({}, {"rules": {"a": {"action": "x"}}}, {"rules": {"a": {"action": "generalize"}}}, {"rules": {"a": {"by": "k", "cases": {"c": {"action": "remove"}}}}}, {"rules": {"a": {"action": "flag", "options": ["flag"]}}}):
        with pytest.raises(ValueError):
            spans.check_policy(bad)


def test_answers_are_averaged_over_orders(spark):
    """A bias for the first letter cancels out over all rotations."""
    cands = spark.createDataFrame([(1, "fraction")], "candidate long, family string")
    shown = judge.order_rows(cands)
    answers = shown.select("candidate", "order_idx", F.substr(F.lit("ABC"), F.col("position") + 1, F.lit(1)).alias("token"), F.when(F.col("position") == 0, 0.6).otherwise(0.2).alias("prob"))
    got = judge.readout(shown, answers).collect()
    assert all(r.prob == pytest.approx(1 / 3) and r.spread == pytest.approx(0.4) for r in got)
    low = judge.readout(shown, answers.withColumn("prob", F.col("prob") / 3)).collect()
    assert all(r.failed and r.prob is None for r in low)
    assert judge.choice(judge.readout(shown, answers)).first()["category"] == "dob"


def test_stream_equals_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row"), "text").withColumn("at", F.timestamp_seconds(F.col("row") * 60))
    docs.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
    q = scan_stream(stream, ("at", "10 minutes")).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = scan_stream(docs).count()
    assert spark.table("found").count() == batch > 0
    windows = counts_by_window(scan_stream(docs), "at")
    assert windows.agg(F.sum("hits")).first()[0] == batch
