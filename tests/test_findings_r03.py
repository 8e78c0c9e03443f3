"""What the third round's findings asked for."""

from pyspark.sql import functions as F

from spanlens.functions.matching import all_matches, ascii_rules, found_by
from spanlens.operators import detect, propose


def test_rules_keep_their_order_in_merged_sources(spark):
    """the second mrn of a text came after its first postal code."""
    rows = spark.createDataFrame([(1, "MRN 12345678 then 654321 end")], "row long, text string")
    raw = propose.raw_proposals(rows, (), rules=("mrn", "postal6"))
    got = {r.match: (r.sources, r.type) for r in propose.merge_proposals(raw).collect()}
    assert got["654321"] == (["rule:mrn", "rule:postal6"], "mrn")
    assert {r.source: r.seq for r in raw.collect()} == {"rule:mrn": 11, "rule:postal6": 13}


def test_one_pass_over_all_rules_finds_what_each_pattern_finds(spark):
    texts = ["\U0001f600 S1234567D陈 ÉS1234567D a\nS7654321Z ſ1234567K", "a@b.co 999.1.1.1 Singapore 123456 Singapore\t123456", "", None, "+65 9123-4567 4111-1111 1111 1111 20200131T101010"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    dets = detect.detectors(postal6=True)
    got = rows.select("row", F.explode(found_by("text", detect.sought(dets))).alias("m")).select("row", "m.*").collect()
    want = rows.select("row", F.explode(F.concat(*[F.transform(all_matches("text", ascii_rules(d.pattern, d.words), d.needs), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), F.lit(d.name).alias("name"))) for d in dets])).alias("m")).select("row", "m.*").collect()
    assert sorted((r.row, r.start, r.end, r.match, dets[r.k].name) for r in got) == sorted(tuple(r[c] for c in ("row", "start", "end", "match", "name")) for r in want) and len(want) > 10


def test_texts_are_dealt_to_more_tasks_than_cores(spark, sf):
    from spanlens.plans.notes import notes
    from spanlens.plans.propose_queries import long_notes

    assert min(f(spark, sf).rdd.getNumPartitions() for f in (notes, long_notes)) >= 32


def test_composed_texts_are_dealt_to_many_tasks(spark, sf):
    """A small table of customers was one split and so one task."""
    from spanlens.plans.layout_queries import ROSTER, composed
    from spanlens.plans.mention_queries import _rows

    assert min(f(spark, sf).rdd.getNumPartitions() for f in (composed(ROSTER), _rows("'x'"))) >= 32


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_readout_sends_no_exploded_rows_whole(spark, sf):
    """options were joined by broadcast, as the planner takes exploded rows for as few as their source."""
    from spanlens.plans.judge_queries import QUERIES

    for name in ("judge_readout", "judge_decide", "fail_closed_veto"):
        assert "Broadcast" not in _plan(QUERIES[name](spark, sf))


def test_order_bias_deals_answers_once(spark, sf):
    """totals and the chosen orders were joined back to every answer."""
    from spanlens.plans.judge_eval_queries import QUERIES

    plan = _plan(QUERIES["order_flips"](spark, sf)).split("Initial Plan")[0]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_words_of_a_vocabulary_are_one_constant(spark, sf):
    """each of hundreds of words was an expression wherever a word was looked up, 24 MB of plan for the names alone."""
    from spanlens.functions.matching import one_of
    from spanlens.operators import names

    rows = spark.createDataFrame([("a",), ("b,c",), ("c",), ("",), (None,), ("a,b",)], "w string")
    for words in (("a", "b", "b,c"), ("a", ""), ("b,c",), ()):
        assert [r.x for r in rows.select(one_of(F.col("w"), words).alias("x")).collect()] == [r.x for r in rows.select(F.col("w").isin(*words).alias("x")).collect()]
    plan = names.name_proposals(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("row"), "text"))._jdf.queryExecution().analyzed()
    assert len(plan.toJSON()) < 12e6


def test_training_rows_are_made_in_one_pass(spark):
    """documents were made twice, for spans and for decoys, and every option of every order was a row before all but one were dropped."""
    from spanlens.operators import judge, synth

    docs = synth.corpus(spark, 40)
    got = synth.sft_rows(docs)
    assert _plan(got).split("Initial Plan")[0].count("Range") == 1
    asked = spark.createDataFrame([(i, f, o) for i, (f, options) in enumerate(judge.FAMILIES.items()) for o in (*options, "no option")], "row long, family string, label string")
    key = ("row", "family", "label", "order_idx", "position")
    want = judge.order_rows(asked).where("option = label").select(*key).collect()
    assert sorted(map(tuple, judge.option_places(asked).select(*key).collect())) == sorted(map(tuple, want)) and len(want) > 100


def test_no_text_is_made_before_rows_are_dealt(spark, sf):
    """A condition on the text went below the repartition, so that every note was made once more in one task."""
    from spanlens.plans.propose_queries import QUERIES

    for name in ("propose_handles", "propose_dates", "propose_ids"):
        below = _plan(QUERIES[name](spark, sf)).split("Initial Plan")[0].split("RoundRobinPartitioning")[1]
        assert " Filter (" not in below
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "@someone_here")], "row long, text string")
    assert [r.row for r in propose.raw_proposals(odd).select("row").distinct().collect()] == [3]


def test_every_grouped_task_of_near_copies_owns_the_worker(spark, sf):
    """Pipeline: a worker that only looked for likely members kept what an earlier stage had left in it, and packing took batches of 1,024 texts."""
    from spanlens.llm import common, packing

    kept = {}
    common._owner[:] = ["other", lambda: kept.update(cleared=True)]
    common.own_memory("lsh_forest", lambda: None)
    assert kept and common._owner[0] == "lsh_forest"
    common._owner[:] = [None, None]
    sizes, arrow_map = [], packing.arrow_map
    packing.arrow_map = lambda df, *rest: sizes.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or arrow_map(df, *rest)
    try:
        packing.op4(spark, sf)
    finally:
        packing.arrow_map = arrow_map
    assert sizes == ["256"] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1024"
