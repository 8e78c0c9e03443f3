import random

import pytest
from pyspark.sql import functions as F

from spanlens.operators import evaluation, intervals, names, questions, scoring
from spanlens.operators.propose import propose

CASES = [
    ("Review of Mdm Ong at noon", "Ong", "shape:name"),
    ("Anand s/o Kumaran, 50M", "Anand s/o Kumaran", "shape:name"),
    ("Lina binte Yusof came", "Lina binte Yusof", "shape:name"),
    ("Spoke to Goh Kai Wen today", "Goh Kai Wen", "shape:name"),
    ("GOH KAI WEN, 31F", "GOH KAI WEN", "shape:name"),
    ("NOK: de Silva.", "de Silva", "shape:name"),
    ("Nurse Teo called", "Teo", "shape:name"),
    ("Husband (Farid) waits", "Farid", "shape:name"),
    ("sons Amir and Zaki. Left", "Amir", "shape:name"),
    ("sons Amir and Zaki. Left", "Zaki", "shape:name"),
    ("Spoke to Nisha (daughter) again", "Nisha", "shape:name"),
    ("Name: LOW MEI, JOANNE   NRIC", "LOW MEI, JOANNE", "shape:name"),
    ("Regards,\nPriya\nWard 3", "Priya", "shape:name"),
    ("Patient: LIM Hui (林慧), 40F", "林慧", "shape:name"),
    ("மகள் ரேவதி வந்தார்", "ரேவதி", "shape:name"),
    ("known as \"Ah Seng\" here", "Ah Seng", "shape:name"),
    ("Checked: ABX/KLY", "KLY", "shape:initials"),
    ("Sign-out: ABX / KLY / RTS", "RTS", "shape:initials"),
    ("CY: hello\nBT: yes\nCY: bye", "CY", "shape:initials"),
    ("order.by=NAIR_SUNIL", "NAIR_SUNIL", "shape:name"),
    ("RN Priya gave it", "Priya", "shape:slot"),
    ("source H.K.L. seen", "H.K.L.", "shape:slot"),
    ("bed 12-3 (KW) after", "KW", "shape:slot"),
]


@pytest.fixture(scope="module")
def found(spark):
    texts = sorted({c[0] for c in CASES} | {"Tan Tock Seng Hospital was full", "COMPLAINT ABOUT THE WARD FOOD", "CY: only once", "McMurray Test negative", "Given at 9 A.M. today", "Ah Ma came", ""}) + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "row int, text string")
    got = {}
    for r in names.name_proposals(rows).collect():
        text = texts[r.row]
        assert text[r.span_start - 1 : r.span_end] == r.match
        got.setdefault(text, set()).add((r.match, r.source))
    return got


@pytest.mark.parametrize("text, match, source", CASES)
def test_names_are_found(found, text, match, source):
    assert (match, source) in found.get(text, set())


@pytest.mark.parametrize("text", ["Tan Tock Seng Hospital was full", "COMPLAINT ABOUT THE WARD FOOD", "CY: only once", "Given at 9 A.M. today", "Ah Ma came"])
def test_no_person_there(found, text):
    assert not found.get(text)


def test_proposer_calls_names_tables_fields_and_repeats(spark):
    text = "Dr Goh Kai Wen saw him.\nGoh Kai Wen left.\nUser|Ref|Note\nTan Lee|AB-1234|x\nPID|1||2||LOW^MEI LING\n"
    rows = spark.createDataFrame([(1, text), (2, None)], "row int, text string")
    extra = spark.createDataFrame([(1, 17, 18, "person", "ner"), (1, 20, 22, "person", "ner"), (1, 1, 2, "name", "ner")], "row int, span_start int, span_end int, type string, source string")
    got = {(r.match, tuple(r.sources)) for r in propose(rows, extra=extra).collect()}
    by = {}
    for m, s in got:
        by.setdefault(m, set()).update(s)
    assert "shape:name" in by["Goh Kai Wen"] and "shape:name_column" in by["Tan Lee"] and "shape:id_column" in by["AB-1234"] and "shape:hl7" in by["LOW"]
    assert "ner" in by["saw"] and not {"aw", "him", "Dr"} & set(by)  # a cut word is widened, stop words alone are dropped


@pytest.mark.parametrize("text, matches", [
    ("lives at Blk 12 Pasir Ris Drive 3, #07-403 now", ["Blk 12 Pasir Ris Drive 3, #07-403"]),
    ("near Bedok North Avenue 2 there", ["Bedok North Avenue 2"]),
    ("Sunny Hostel, Blk B, Rm 07-12, 12 Sungei Kadut Ave seen", ["Sunny Hostel, Blk B, Rm 07-12, 12 Sungei Kadut Ave"]),
    ("at 2 Riverside Medical Dr, Singapore", ["2 Riverside Medical Dr"]),
    ("from Purok 4, Brgy. Gunob today", ["Purok 4, Brgy. Gunob"]),
])
def test_addresses(spark, text, matches):
    rows = spark.createDataFrame([(1, text)], "row int, text string")
    from spanlens.operators.propose import raw_proposals

    got = {r.match for r in raw_proposals(rows).where("source = 'shape:address'").collect()}
    assert set(matches) <= got and not any(m != x and m in x and m.startswith("Pasir") for m in got for x in got)


def test_extension_goes_with_the_number(spark):
    rows = spark.createDataFrame([(1, "office 6225 1180 ext 312, mail"), (2, "+65 9123 4567 x12")], "row int, text string")
    from spanlens.operators.propose import raw_proposals

    got = {r.match for r in raw_proposals(rows).where("source = 'shape:phone'").collect()}
    assert {"6225 1180 ext 312", "+65 9123 4567 x12"} <= got


def test_outcomes_of_gold_and_records(spark):
    docs = spark.createDataFrame([(1, "call (Ann Lee), 9123"), (2, "none")], "doc int, text string")
    gold = spark.createDataFrame([(1, 6, 14, "name"), (1, 17, 20, "phone")], "doc int, span_start int, span_end int, label string")
    records = spark.createDataFrame([(1, 7, 13, "name", "identifier", ["a"]), (1, 18, 20, "phone", "review", ["b"]), (2, 1, 4, "name", "identifier", ["a"]), (1, 1, 4, "mrn", "not_identifier", ["a"])], "doc int, span_start int, span_end int, identifier string, decision string, sources array<string>")
    got = {r.label: (r.flagged, r.auto, r.partial, r.label_ok) for r in evaluation.gold_outcomes(docs, gold, records).collect()}
    assert got == {"name": (True, True, False, True), "phone": (False, False, True, False)}
    one = evaluation.summary(docs, gold, records).first()
    assert (one.gold, one.returned, one.recall_flagged, one.false_accepts, one.dropped, one.partial) == (2, 3, 0.5, 1, 1, 1)
    assert [tuple(r) for r in evaluation.false_positives(gold, records).collect()] == [("identifier:name:a", 1)]
    assert evaluation.summary(docs.limit(0), gold.limit(0), records.limit(0)).first().recall_flagged is None


def test_calls_and_terms(spark):
    rows = spark.createDataFrame([("genetic", ["lexicon:genetic"]), ("genetic", ["ner"]), ("none", []), (None, None), ("name", ["ner"])], "c string, s array<string>")
    assert [r.x for r in rows.select(questions.group_of(F.col("c"), F.col("s")).alias("x")).collect()] == ["shi_lexicon", "shi_other", "none", "none", "identifier"]
    texts = spark.createDataFrame([("has HIV infection",), ("has a cold",), (None,), ("husband hit her",)], "t string")
    assert [r.x for r in texts.select(questions.holds_sensitive_term(F.col("t")).alias("x")).collect()] == [True, False, False, True]


def brute_score(docs, gold, predicted, view):
    meets = lambda p, g: p[0] == g[0] and p[1] <= g[2] and g[1] <= p[2] and p[1] <= p[2] and g[1] <= g[2]
    text = dict(docs)
    gold, predicted = ([x for x in rows if x[0] in text] for rows in (gold, predicted))
    seen, shown = [g for g in gold if g[3] in view], [p for p in predicted if p[3] not in scoring.SENSITIVE]
    held = lambda g, ps: all(any(p[0] == g[0] and p[1] <= i <= p[2] for p in ps) for i in range(g[1], g[2] + 1) if text[g[0]][i - 1 : i].isalnum())
    hits = [any(meets(p, g) for p in shown) for g in seen]
    covered, auto = [held(g, shown) for g in seen], [held(g, [p for p in shown if p[4] in ("identifier", None)]) for g in seen]
    tp = [p for p in shown if any(meets(p, g) for g in seen)]
    fp = [p for p in shown if not any(meets(p, g) for g in gold)]
    share = lambda a, b: round(a / b, 4) if b else None
    r, q = (sum(hits) / len(seen) if seen else None), (len(tp) / (len(tp) + len(fp)) if tp or fp else None)
    missed = sorted((*g[:4], text[g[0]][g[1] - 1 : g[2]], h) for g, h, c in zip(seen, hits, covered) if not c)
    return (len(seen), share(sum(hits), len(seen)), share(sum(covered), len(seen)), share(sum(auto), len(seen)), share(len(tp), len(tp) + len(fp)), round(2 * r * q / (r + q), 4) if r and q else 0.0,
            len(tp), len(fp), sum(not any(g[0] == p[0] for g in gold) for p in fp)), missed


def test_scores_of_a_set_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    labels = ["name", "phone", "genetic", "date_other", None]
    docs = [(d, "".join(rng.choice("ab1 ,-é中") for _ in range(400))) for d in range(6)] + [(6, "")]
    spans = lambda n, few: [(rng.randrange(0, few), s := rng.randrange(1, 390), s + rng.randrange(-1, 14) * rng.randrange(1, 4), rng.choice(labels[:4])) for _ in range(n)]
    gold = [(*g[:2], max(g[1:3]), g[3]) for g in spans(60, 5)]
    gold += gold[:5] + [(99, 1, 4, "name")]
    predicted = [(*p, rng.choice(["identifier", "review", None])) for p in spans(150, 7)] + [(0, 1, 400, "name", "review"), (99, 1, 4, "name", None)]
    predicted = [(*p[:3], rng.choice(labels) if i % 9 == 0 else p[3], p[4]) for i, p in enumerate(predicted)]
    d = spark.createDataFrame(docs, "doc int, text string")
    g = spark.createDataFrame(gold, "doc int, span_start int, span_end int, label string")
    p = spark.createDataFrame(predicted, "doc int, span_start int, span_end int, label string, decision string")
    monkeypatch.setattr(intervals, "BIN", 32)
    for view in (scoring.IDENTIFIERS, ("phone",)):
        want, missed = brute_score(docs, gold, predicted, view)
        assert tuple(scoring.set_score(d, g, p, view).first()) == want
        got = sorted(tuple(r)[:6] for r in scoring.misses(d, g, p, view).collect() for _ in range(r.n))
        assert got == missed
    assert tuple(scoring.set_score(d, g.limit(0), p.limit(0)).first()) == (0, None, None, None, None, 0.0, 0, 0, 0)
    by_label = {r.label: r.n for r in scoring.label_scores(d, g, p).collect()}
    assert sum(by_label.values()) == brute_score(docs, gold, predicted, scoring.IDENTIFIERS)[0][0]


def test_interval_holds_the_error(spark):
    rows = spark.range(3000).select((F.col("id") % 300).alias("doc"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("p")).withColumn("y", F.pmod(F.xxhash64("doc", "p"), F.lit(100)) < 100 * F.least(F.lit(1.0), F.col("p") + 0.1))
    low, high = evaluation.ece_interval(rows, 300).first()
    assert low < 0.1 < high and high - low < 0.06
    assert evaluation.ece_interval(rows.limit(0), 10).first().low is None
