"""What the fourth round's findings asked for."""

import random
import re

from pyspark.sql import functions as F

from spanlens.functions.matching import gate, relaxed
from spanlens.functions.validators import luhn
from spanlens.operators import detect, propose

PIECES = (
    "S1234567D", "ſ1234567k", "chronıc hepatİtis b", "HIV infection", "né 12/03/1999", "१२/०३/१९९९", "Dr Tan", "d. 1978", "a@b.co", "+65 9123 4567", "Blk 12 Ang Mo Kio Ave 3, #05-12", "nurse: Mei",
    "Singapore\t123456", "https://x.org/a", "IMG_1.jpg", "two three four five six seven eight", "†1999", "திரு குமார்", "李明 ", "by=lim_ah", "\x1c", "\n", "é", "[x]", "Kelvin K", "\U0001f600",
)


def _patterns():
    rules = [(d.pattern, None, True, re.ASCII) for d in detect.detectors(postal6=True)]
    shapes = [(s.pattern, s.lead, s.any_case, 0) for s in propose.EVERY_SHAPE]
    return [(p if lead is None else f"(?:{lead})(?:{p})", any_case, flags | (re.I if any_case else 0)) for p, lead, any_case, flags in rules + shapes]


def test_no_text_with_a_match_is_passed_over():
    """Which texts a pattern may match is decided by a wider pattern over a whole batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rng = random.Random(4)
    texts = [" ".join(rng.sample(PIECES, 5)) for _ in range(300)] + ["".join(rng.sample(PIECES, 3)) for _ in range(300)]
    met = 0
    for pattern, any_case, flags in _patterns():
        wide = gate(pattern, any_case)
        assert wide is not None
        passed = pc.match_substring_regex(pa.array(texts), wide).to_pylist()
        hit = [bool(re.search(pattern, t, flags)) for t in texts]
        met += any(hit)
        assert not [t for t, h, p in zip(texts, hit, passed) if h and not p], pattern
    assert met >= 20


def test_a_pattern_that_has_no_wider_form_is_read_in_every_text():
    assert gate(r"(a)\1") is None and gate(r"a{,3}b") is None and gate(r"[^\S]x") is None
    assert relaxed(r"(?<![\w\]])a\b[^\W_](?=x)$") == r"a[\pL\pM\pN\p{Pc}\p{Cf}]"


def test_a_rule_scan_reads_only_texts_that_may_match(spark):
    """a caller's detector with no wider form is still found, beside the shipped ones."""
    rows = spark.createDataFrame([(1, "ABAB S1234567D"), (2, None), (3, ""), (4, "CDCD")], "row long, text string")
    twice = detect.Detector("twice", "x", "other_id", r"\b([A-Z]{2})\1\b", 0.5)
    got = {(r.row, r.span.match, r.span.detector) for r in detect.scan_text(rows, (*detect.detectors(), twice)).collect()}
    assert {(1, "ABAB", "rule:twice"), (4, "CDCD", "rule:twice"), (1, "S1234567D", "rule:nric")} <= got and {r for r, _, _ in got} == {1, 4}


def test_conditions_are_asked_behind_the_explode(spark):
    """F4, and the scans: conditions inside an array are interpreted, not compiled."""
    rows = spark.createDataFrame([(1, "x")], "row long, text string")
    for df in (propose.raw_proposals(rows, propose.lexicon_shapes(), rules=()), detect.scan_text(rows, [d for d in detect.detectors() if d.name != "ip"])):
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_luhn_by_plain_functions(spark):
    def want(s):
        d = [int(c) for c in re.sub("[^0-9]", "", s)][::-1]
        return len(d) >= 12 and sum(v if i % 2 == 0 else v * 2 % 10 + v // 5 for i, v in enumerate(d)) % 10 == 0

    rng = random.Random(1)
    values = ["".join(rng.choice("0123456789- ") for _ in range(n)) for n in range(30) for _ in range(40)] + ["4111 1111 1111 1111"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", luhn(F.col("v")).alias("ok")).collect()
    assert [r.ok for r in got] == [want(r.v) for r in got] and any(r.ok for r in got)
    assert spark.range(1).select(luhn(F.lit(None).cast("string")).alias("ok")).first().ok is False


def test_greedy_overlaps_equal_the_plain_rule(spark):
    """each span was held against all that were kept, in an interpreted fold."""
    rng = random.Random(2)
    rows = [(0, None), (1, [])] + [(i, [(s, s + rng.randrange(-1 if i % 5 == 0 else 0, 6), "m", "t", "i", f"d{j}", rng.choice((0.5, 0.9))) for j, s in enumerate(rng.choices(range(1, 30), k=rng.randrange(14)))]) for i in range(2, 120)]
    got = dict(map(tuple, spark.createDataFrame(rows, f"row int, spans array<{detect.SPAN}>").select("row", detect.dedup_overlaps(F.col("spans")).alias("k")).collect()))
    for i, spans in rows:
        kept = None if spans is None else []
        for s in sorted(spans or [], key=lambda s: (s[0] - s[1], -s[6])):
            if not any(s[0] <= k[1] and s[1] >= k[0] for k in kept):
                kept.append(s)
        assert (None if got[i] is None else [tuple(k) for k in got[i]]) == kept



def test_a_names_words_are_looked_up_once(spark):
    """trimming a run named its words some thirty times over, and each time looked them up in the vocabulary."""
    from spanlens.operators.names import RUN, Vocabulary, trim_name
    from spanlens.operators.propose import shape_spans

    rows = spark.createDataFrame([(1, "Reviewed Goh Kai Wen with Nurse Tan; General Hospital Lim Ah Beng, THE BIG OF ALL")], "row long, text string")
    found = rows.select(F.filter(F.transform(shape_spans("text", RUN, 0), lambda m: trim_name(F.col("text"), m, Vocabulary())), lambda m: m.isNotNull()).alias("a"))
    assert found._jdf.queryExecution().analyzed().toString().count("find_in_set") <= 4
    assert [s.match for s in found.first().a] == ["Goh Kai Wen", "Tan", "Lim Ah Beng"]
