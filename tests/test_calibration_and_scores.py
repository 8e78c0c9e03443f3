import math
import random

import pytest
from pyspark.sql import functions as F

from spanlens.operators import calibration as c
from spanlens.operators import scoring as s


def rows(spark, ps, ys, groups=None):
    return spark.createDataFrame([(float(p), bool(y), g) for p, y, g in zip(ps, ys, groups or [None] * len(ps))], "p double, y boolean, group string")


def test_metrics_equal_their_definitions(spark):
    rng = random.Random(7)
    ps = [round(rng.random(), 2) for _ in range(300)] + [0.0, 1.0]
    ys = [rng.random() < p for p in ps]
    df = rows(spark, ps, ys)
    pos, neg = [p for p, y in zip(ps, ys) if y], [p for p, y in zip(ps, ys) if not y]
    assert c.auroc(df).first()[0] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg))
    bins = {}
    for p, y in zip(ps, ys):
        bins.setdefault(min(int(p * 10), 9), []).append((p, y))
    assert c.ece(df).first()[0] == pytest.approx(sum(len(b) * abs(sum(p for p, _ in b) - sum(y for _, y in b)) / len(b) for b in bins.values()) / len(ps))
    assert c.auroc(rows(spark, [0.1], [True])).first()[0] is None
    with pytest.raises(Exception, match="out of range"):
        c.ece(rows(spark, [1.5], [True])).collect()


def test_isotonic_pools_and_steps(spark):
    f = c.fit(rows(spark, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.9], [0, 0, 1, 0, 1, 1, 1, 1]), "isotonic")
    at = {p: q for p, q in spark.createDataFrame([(x,) for x in (0.0, 0.3, 0.4, 1.0)], "p double").select("p", f.column(F.col("p"))).collect()}
    assert at == {0.0: 0.005, 0.3: 0.5, 0.4: 0.5, 1.0: 0.995}
    tied = c.fit(rows(spark, [0.2, 0.2, 0.9, 0.9, 0.9, 0.9], [0, 0, 0, 1, 1, 1]), "isotonic")
    assert tied.ys == (0.0, 0.75)


def test_temperature_softens(spark):
    rng = random.Random(1)
    z = [rng.gauss(0, 2) for _ in range(400)]
    ys = [rng.random() < 1 / (1 + math.exp(-v)) for v in z]
    over = [1 / (1 + math.exp(-3 * v)) for v in z]
    assert 2 < c.fit(rows(spark, over, ys), "temperature").t < 4.5


def test_grouped_and_files(spark):
    df = rows(spark, [0.9] * 60, [1] * 30 + [0] * 30, ["a"] * 30 + ["b"] * 30)
    g = c.fit_grouped(df, "isotonic")
    got = df.select("group", g.column(F.col("p"), F.col("group")).alias("q")).distinct().collect()
    assert {r.group: r.q for r in got} == {"a": 0.995, "b": 0.005}
    text = c.dumps(g, {"drop_below": 0.1, "accept_at": 0.9}, {})
    assert c.loads(text)[0] == g
    with pytest.raises(ValueError):
        c.loads(c.dumps(g, {"drop_below": 0.95, "accept_at": 0.9}, {}))
    with pytest.raises(ValueError):
        c.from_dict({"kind": "isotonic", "xs": [0.2, 0.1], "ys": [0.1, 0.2]})


def test_thresholds_fail_closed(spark):
    few = c.choose_thresholds(rows(spark, [0.9] * 5, [True] * 5)).first()
    assert (few.drop_below, few.accept_at, few.recall_at_drop) == (0.0, 1.0, None)
    got = c.choose_thresholds(rows(spark, [0.01] * 10 + [0.9] * 50, [False] * 10 + [True] * 50)).first()
    assert (got.drop_below, got.accept_at, got.precision_at_accept) == (0.049999, 0.9, 1.0)


def test_coverage_and_overlap(spark):
    docs = spark.createDataFrame([(1, "Tan Ah Kow")], "doc long, text string")
    gold = spark.createDataFrame([(1, 1, 10, "name")], "doc long, span_start int, span_end int, label string")
    part = spark.createDataFrame([(1, 1, 3, "name")], gold.schema)
    both = part.unionByName(spark.createDataFrame([(1, 5, 10, "name")], gold.schema))
    assert [s.coverage(docs, gold, p).first()["covered"] for p in (part, both)] == [False, True]
    assert s.span_score(gold, part).first()["recall"] == 1.0


def test_other_dates_are_neutral(spark):
    gold = spark.createDataFrame([(1, 1, 10, "date_other"), (1, 20, 25, "name")], "doc long, span_start int, span_end int, label string")
    guess = spark.createDataFrame([(1, 2, 5, "dob"), (1, 40, 42, "name")], gold.schema)
    got = s.span_score(gold, guess).first()
    assert (got.tp, got.fp, got.hits) == (0, 1, 0)
    assert s.span_score(gold, guess, (*s.IDENTIFIERS, "date_other")).first()["tp"] == 1


def test_pool_wilson_gate(spark):
    sets = spark.createDataFrame([(100, 1, 10, 0, 9, 1), (50, 2, 10, 0, 9, 1)], "gold long, missed long, gold_direct long, missed_direct long, tp long, fp long")
    pooled = s.pool(sets)
    assert pooled.first()["recall"] == 0.98
    w = spark.range(1).select(s.wilson(F.lit(249), F.lit(255)).alias("w")).first()["w"]
    assert (w.low, w.high) == (0.9496, 0.9892)
    got = {r["check"]: r["result"] for r in s.gate(pooled.withColumn("ece", F.lit(None).cast("double"))).collect()}
    assert got == {"direct_recall": "PASS", "precision": "PASS", "ece": "INCOMPLETE", "f1": "PASS", "overall": "INCOMPLETE"}


def test_ranks_and_percentiles_hold_over_many_ranges(spark):
    from spanlens.operators.ranks import running

    rng = random.Random(3)
    values = [rng.choice((1.5, rng.random() * 100)) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    for q in (0.0, 0.25, 0.5, 0.95, 1.0):
        ordered, n = sorted(values), len(values)
        assert s.percentile_nearest(df, q).first()[0] == ordered[max(math.ceil(n * q), 1) - 1]
        assert s.percentile_index(df, q).first()[0] == ordered[min(int(n * q), n - 1)]
    assert s.percentile_nearest(df.where("value < 0"), 0.5).first()[0] is None
    got = running(spark.range(1000).withColumn("id", -F.col("id")), "id", F.lit(1)).collect()
    assert all(r.before == r.id + 999 for r in got)
    dealt = c.folds(spark.range(97).selectExpr("id % 31 AS doc", "id AS seq"), 5).collect()
    assert len(dealt) == 97 and all(r.fold == r.doc % 5 for r in dealt)
