import re

import pytest
from pyspark.sql import functions as F

from spanlens.functions import validators as v
from spanlens.functions.matching import all_matches, ascii_rules
from spanlens.operators import detect


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("x, ok", [("S1234567D", True), (" t1234567j\n", True), ("S1234567A", False), ("F1234567N", True), ("S123456D", False), ("", False), (None, False), ("S1234567D\n\n", True), ("XS1234567D", False)])
def test_nric(spark, x, ok):
    assert one(spark, x, v.nric_valid) is ok


@pytest.mark.parametrize("x, day", [("19900131", "1990-01-31"), ("31011990", "1990-01-31"), ("12131990", "1990-12-13"), ("19901231 143000", "1990-12-31"), ("19901231T143000", "1990-12-31"), ("19901231t143000", None), ("12345678", None), ("18990101", None), ("", None), (None, None)])
def test_compact_date(spark, x, day):
    got = one(spark, x, v.compact_date)
    assert (got and got.isoformat()) == day


@pytest.mark.parametrize("x, day", [("3/4/49", "2049-04-03"), ("3/4/50", "1950-04-03"), ("2020-02-30", None), ("1st Jan 2020", "2020-01-01"), ("March 3, 2021", "2021-03-03"), ("3 Foo 2020", None), ("x 3/4/50", None)])
def test_parse_date(spark, x, day):
    got = one(spark, x, v.parse_date)
    assert (got and got.isoformat()) == day


@pytest.mark.parametrize("x, ok", [("4111111111111111", True), ("4111-1111 1111 1112", False), ("0" * 11, False), ("", False)])
def test_luhn(spark, x, ok):
    assert one(spark, x, v.luhn) is ok


def test_spoken_and_ocr(spark):
    assert one(spark, "plus six five nine double one oh", v.spoken_digits) == "+659110"
    assert one(spark, "l4.O2.l95l", v.ocr_date) == "14.02.1951"
    assert one(spark, "14.02.1951", v.ocr_date) is None
    assert one(spark, "l4.13.1951", v.ocr_date) is None


def test_offsets_are_code_points(spark):
    text = "\U0001f600 S1234567D陈 ÉS1234567D a\nS7654321Z"
    pattern = r"\b[STFGM][0-9]{7}[A-Z]\b"
    got = spark.createDataFrame([(text,)], "t string").select(all_matches("t", ascii_rules(pattern)).alias("m")).first()["m"]
    want = [(m.start() + 1, m.end(), m.group()) for m in re.finditer(pattern, text, re.A | re.I)]
    assert [(m["start"], m["end"], m["match"]) for m in got] == want and len(want) == 3


def test_confidences_of_failed_checks(spark):
    rows = spark.createDataFrame([(1, "S1234567A 12345678 999.1.1.1"), (2, ""), (3, None)], "row long, text string")
    got = {(r.detector, r.confidence) for r in detect.flat(detect.scan_text(rows)).collect()}
    assert {("rule:nric", 0.2), ("rule:date_compact", 0.15), ("rule:ip", 0.3)} <= got


def greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-(s[1] - s[0]), -s[2])):
        if not any(s[0] <= k[1] and s[1] >= k[0] for k in kept):
            kept.append(s)
    return kept


def test_dedup_keeps_the_widest_then_the_surest(spark):
    import random

    rng = random.Random(4)
    for _ in range(3):
        spans = [(a := rng.randint(1, 60), a + rng.randint(0, 12), rng.choice([0.2, 0.5, 0.9])) for _ in range(25)]
        rows = [(s, e, "m", "t", "i", "d", c) for s, e, c in spans]
        got = spark.createDataFrame([(rows,)], f"spans array<{detect.SPAN}>").select(detect.dedup_overlaps(F.col("spans")).alias("k")).first()["k"]
        assert [(k["start"], k["end"], k["confidence"]) for k in got] == greedy(spans)


def test_classify_and_registry(spark):
    dets = detect.detectors(postal6=True)
    got = one(spark, " 123456 ", lambda x: detect.classify_value(x, dets))
    assert got == {"mrn": 0.4, "postal6": 0.5}
    assert one(spark, "   ", detect.classify_value) == {}
    assert one(spark, "S1234567A", detect.classify_value)["nric"] == pytest.approx(0.2)
    own = detect.Detector("mrn", "mrn", "mrn", r"\bH[0-9]+\b", 0.9)
    assert [d.pattern for d in detect.detectors(extra=[own]) if d.name == "mrn"] == [r"\bH[0-9]+\b"]


def test_plain_boundaries_and_gates_change_nothing(spark):
    """Shipped detectors with written-out boundaries and without a gate find the same, also where non-word characters touch."""
    from dataclasses import replace

    texts = ["_S1234567D S1234567D_ (S1234567D) x-12345678-x 1234567890A. ÄX1234567K é12345678", "12/03/2020. -12/03/2020- 1.2.3.4.5 a1.2.3.4 4111-1111-1111-1111_ 4111 1111 1111 1111)", "S(123456) S123456) Singapore 123456x EA1234567\n12345678T123456", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "row int, text string")
    for d in detect.detectors(postal6=True):
        plain = replace(d, needs=None, words=False)
        both = [sorted(map(tuple, detect.flat(detect.scan_text(rows, [x])).collect())) for x in (d, plain)]
        assert both[0] == both[1], d.name
