import json

import duckdb
import pytest
from pyspark.sql import functions as F

from spanlens.operators import calibration, engine, questions as q, spans
from spanlens.operators.judge import order_rows
from spanlens.plans import question_queries
from spanlens.plans.engine_queries import scripted

CELLS = [(i, f"{d:02}/03/2024", "Seen") for i, d in enumerate(range(1, 12))] + [(20, "04/03/1971", "Seen"), (21, None, "Seen"), (30, "Lives at Blk 12 Hill Road, Singapore 560012. ref 7734-2210-9, Rx by SMN", None), (31, "Moved to 9 Oak Road in May.", None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(CELLS, "row long, text string, column string")


@pytest.mark.parametrize("name", sorted(question_queries.SQL))
def test_queries_equal_their_sql(spark, sf, name):
    got = question_queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    for t in ("orders", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({question_queries.SQL[name]})").fetchall()
    key = lambda r: tuple(str(v) for v in r)
    assert want and sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_questions_are_worded_in_their_order(spark):
    cand = spark.createDataFrame([(1, "fraction", 'a "b"\nc', "choice")], "candidate int, family string, match string, kind string")
    asked = {r.order_idx: r.question.split("\n") for r in q.question_text(order_rows(cand)).collect()}
    assert asked[0] == ["In this text, what is \"a 'b' c\"?", "A) date of birth", "B) date of death", f"C) {q.NONE_TEXT['fraction']}", q.ANSWER_CUE]
    assert len(asked) == 3 and asked[1][1:3] == ["A) date of death", f"B) {q.NONE_TEXT['fraction']}"]
    homes = q.every_turn(cand, tuple(q.HOMES)).collect()
    assert {(r.position, r.option) for r in homes} == {(i, o) for i in range(4) for o in q.HOMES}


def options_of(asked, best):
    """Answers that are all for the option that `best` names for each kind of question."""
    letter = F.substr(F.lit(q.LETTERS), F.col("position") + 1, F.lit(1))
    chosen = F.element_at(F.create_map(*[F.lit(x) for kv in best.items() for x in kv]), F.col("kind"))
    return asked.select("candidate", "order_idx", letter.alias("token"), F.when(F.col("option") == chosen, 0.9).otherwise(0.0).alias("prob"))


def test_optional_questions_review_and_add_context(spark, rows):
    says = lambda asked: options_of(asked, {"choice": "none", "personal": "yes", "harm": "high", "home": "condo"})
    judge = engine.Judge(ask_personal=True, ask_harm=True, ask_home=True, disagree_at=0.5)
    got = engine.scan(rows, says, judge, include_dropped=True).collect()
    judged = [r for r in got if not r.fast_path]
    assert judged and all(r.decision == "review" and "choice_noul_disagree" in r.reasons and r.sensitivity == 1.0 for r in judged)
    address = [r for r in engine.scan(rows, lambda a: options_of(a, {"choice": "address", "home": "condo"}), engine.Judge(ask_home=True)).collect() if not r.fast_path and r.identifier == "address"]
    assert {r.context["property_kind"] for r in address} == {"hdb", "condo"}  # what the text proves outranks the answer
    postal = [r for r in got if r.fast_path == "postal_keyword"]
    assert postal and all(r.context["property_kind"] == "hdb" for r in postal)


def test_odd_dates_of_a_column_are_reviewed(spark, rows):
    got = engine.scan(rows, lambda a: options_of(a, {"choice": "none"}), include_dropped=True).collect()
    assert [r.row for r in got if "column_outlier" in r.reasons] == [20]
    assert {r.context.get("date_role") for r in got if r.row < 12} == {"other"}


def test_extra_spans_are_judged(spark, rows):
    extra = spark.createDataFrame([(30, 10, 14, "name", "ner"), (30, 0, 4, "name", "ner"), (30, 5, 999, "name", "ner")], "row long, span_start int, span_end int, type string, source string")
    got = engine.scan(rows, lambda a: options_of(a, {"choice": "name"}), extra=extra, include_dropped=True).where("array_contains(sources, 'ner')").collect()
    assert all(r.row == 30 and 1 <= r.span_start <= r.span_end <= 80 for r in got)


def test_calibrated_confidence_decides_unless_raw(spark, rows):
    low = calibration.Isotonic((1.0,), (0.5,))
    got = engine.scan(rows, scripted, engine.Judge(calibrator=low)).where("fast_path IS NULL").collect()
    assert got and {r.decision for r in got} == {"review"} and {r.confidence for r in got} == {0.5}
    raw = engine.scan(rows, scripted, engine.Judge(calibrator=low, raw=True)).where("fast_path IS NULL").collect()
    assert {r.confidence for r in raw} == {0.5} and {r.decision for r in raw} == {r.decision for r in engine.scan(rows, scripted).where("fast_path IS NULL").collect()}


def test_calibrations_hold_for_their_prompt_and_model():
    cal = (calibration.Identity(), {"drop_below": 0.1, "accept_at": 0.9, "space": "raw"}, {"prompt": "3", "model": "/m/a.gguf"})
    judge = engine.calibrated(cal, "3", "b/a.gguf", ask_harm=True)
    assert (judge.drop_below, judge.accept_at, judge.raw, judge.ask_harm) == (0.1, 0.9, True, True)
    for bad in (("4", None), ("3", "b.gguf")):
        with pytest.raises(ValueError, match="fitted for"):
            engine.calibrated(cal, *bad)


@pytest.mark.parametrize("bad", [{}, {"texts": "a"}, {"texts": [], "kind": "rows"}, {"texts": ["a"], "candidates": [[], []]}])
def test_malformed_requests_are_errors(bad):
    assert engine.check_request({"texts": ["a"], "kind": "cells", "candidates": [[]]})
    with pytest.raises(ValueError):
        engine.check_request(bad)


def test_policies_are_found_above(tmp_path, monkeypatch):
    monkeypatch.delenv("SPANLENS_POLICY", raising=False)
    deep, file = tmp_path / "a" / "b", tmp_path / "p" / "x.json"
    deep.mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        spans.load_policy(relative="p/x.json", search_from=str(deep))
    file.parent.mkdir()
    file.write_text(json.dumps({"rules": {"name": {"action": "remove"}}}))
    assert spans.load_policy(relative="p/x.json", search_from=str(deep))["rules"]
    monkeypatch.setenv("SPANLENS_POLICY", str(file))
    assert spans.load_policy()["rules"] == spans.load_policy(str(file))["rules"]
    file.write_text("{}")
    with pytest.raises(ValueError):
        spans.load_policy()
