import re

import pytest
from pyspark.sql import functions as F

from spanlens.operators import mentions, names, propose, walks

VOCABULARY = names.Vocabulary()


def walked(spark, walk, cases):
    rows = spark.createDataFrame([*((i, t) for i, (t, _) in enumerate(cases)), (-1, None), (-2, "")], "row int, text string")
    got = {}
    for r in walk(rows).collect():
        assert cases[r.row][0][r.span_start - 1 : r.span_end] == r.match
        got.setdefault(r.row, set()).add(r.match)
    assert [(t, got.get(i, set()), want) for i, (t, want) in enumerate(cases) if got.get(i, set()) != want] == []


FIELDS = [
    ("MRN: BTC 22 118 406 seen", {"BTC 22 118 406"}), ("donation no. W0417 26 118203 X.", {"W0417 26 118203 X"}), ("Policy no.: HS-IP-7739 0021 45", {"HS-IP-7739 0021 45"}),
    ("NRIC ......... S 7709 506 C today", {"S 7709 506 C"}), ("Accession: CT.26.0914.00382", {"CT.26.0914.00382"}), ("case no. FC/OSM 1482/2026", {"FC/OSM 1482/2026"}),
    ("ID E16.2 noted", set()), ("MRN 12", set()), ("file pending", set()), ("MRN: ID 44021", {"ID 44021", "44021"}), ("sample 4402-118-\nnext", {"4402-118"}), ("ref AB 12 cd 345", set()),
    ("Case ABCDE 12345", set()), ("visit V12345 A/B/CD 7", {"V12345 A/B/CD 7"}), ("staff 12345 Ward 3", {"12345"}), ("IC 1.2.3.4.5", {"1.2.3.4.5"}), ("IC 1.2.34", set()),
]
CODES = [
    ("code OPD-PT-26-33091 and BIO-26-00918-A", {"OPD-PT-26-33091", "BIO-26-00918-A"}), ("FGS-0142 but Fgs-0142", {"FGS-0142"}), ("HF-017 no", set()), ("Reg. No. TCM-P1033", {"TCM-P1033"}),
    ("phone 91234567", set()), ("a/b-1234567", {"a/b-1234567"}), ("x:AB-12345", set()), ("MRN: 4402118", {"4402118"}), ("2026-0001", set()),
]
LOWER = [
    ("mister lim ah beng came", {"lim", "lim ah", "lim ah beng"}), ("doctor say hip fracture", set()), ("the GI doctor also wants", set()), ("mdm tan was seen", {"tan"}), ("dr. harpreet core will", {"harpreet", "harpreet core"}),
    ("Mr Lim", set()), ("xmr lim", set()), ("prof d'cruz-tan", {"d'cruz-tan"}),
]


@pytest.mark.parametrize("walk, cases", [(walks.field_values, FIELDS), (walks.codes, CODES), (walks.lower_names, LOWER)])
def test_walks(spark, walk, cases):
    walked(spark, walk, cases)


def spoken_of(text, held):
    """mentions() by looking for each word in turn."""
    out = set()
    inside = lambda s, e: any(a <= s and e <= b for a, b, _ in held)
    stop = lambda w: re.sub(r"'s\Z", "", w.lower().strip(".,")) in VOCABULARY.stop
    words = {m for _, _, m in held if not re.fullmatch(r"[\W_]*(?:\d{1,3}|[A-Za-z])[\W_]*", m) and not all(map(stop, m.split())) and not m == m.lower() != m.upper() and m.lower() not in VOCABULARY.kin}
    for s, _, m in held:
        cap = re.search(r"(?i:\b([a-z]+))[ \t]*[:：][ \t]*$", text[max(0, s - 31) : s - 1])
        if len(m.split()) > 1 and m == m.upper() != m.lower() and cap and cap.group(1).lower() in [*mentions.PEOPLE, *mentions.CAPTIONS]:
            words |= {p.title() for p in m.split() if len(p) > 2 and p.isalpha() and not stop(p) and not re.fullmatch(names.CONNECTOR, p) and p.lower() not in VOCABULARY.kin}
    for w in words:
        out |= {(m.start() + 1, m.end(), w, "shape:repeat") for m in re.finditer(rf"(?<![\w'’]){re.escape(w)}(?![\w'’])", text) if not inside(m.start() + 1, m.end())}
    legend = set()
    for m in re.finditer(r"\[([A-Z]{1,3})\]|\(([A-Z]{2,3})\)", text):
        ini = m.group(1) or m.group(2)
        for _, e, name in held:
            heads = iter(w[0].upper() for w in re.findall(r"[^\W\d_]+", name))
            if e <= m.start() and re.fullmatch(mentions.LEGEND_GAP, text[e : m.start()]) and all(c in heads for c in ini) and not stop(ini) and ini not in mentions.STAFF:
                legend.add(ini)
                out.add((m.start() + 2, m.end() - 1, ini, "shape:initials"))
    for ini in legend:
        rx = rf"(?<![\w/])({ini})(?!\w)" if len(ini) > 1 else rf"(?m)^[ \t]*({ini})[ \t]*:"
        out |= {(m.start(1) + 1, m.end(1), ini, "shape:initials") for m in re.finditer(rx, text)}
    return out


MENTIONED = [
    ("Dr Clara Yeo [CY] and wife Kamala [K], Benjamin Tan (M) (BT).\nCY: hello\nK: asked. Vitamin K.\n  K : again\nMinutes by BT/CY, xBT.", ["Clara Yeo", "Kamala", "Benjamin Tan"]),
    ("Child: NUR ALYA BINTE HASSAN   DOB 1 Jan 2021\n\nAlya fell, Hassan's bag. Binte. Nur-Alya NUR ALYA BINTE HASSAN", ["NUR ALYA BINTE HASSAN"]),
    ("Tan came. Tan Ah Kow left; Tan's; xTan Tan Ah Kow, Tan Ah Kowx", ["Tan", "Tan Ah Kow"]),
    ("a.b (c) x a.b (c) a.b (c)d", ["a.b (C)", "a.b (c)"]), ("Ma said. Ma. T T", ["Ma", "T"]), ("陈大文 and 陈大文。 陈大文x", ["陈大文"]), ("\U0001f600 Kai Wen, Kai Wen \U0001f600Kai Wen", ["Kai Wen"]),
    ("O'Neil O'Neil’s O'Neil. (ON) O'Neil (ON)", ["O'Neil"]), ("nothing", []), ("Lim Lim\nLim (a) [L]\nL: x", ["Lim"]), ("A\\E Q A\\E Q", ["A\\E Q"]),
]


def test_mentions_equal_a_search_word_by_word(spark):
    held = []
    for i, (text, words) in enumerate(MENTIONED):
        for w in words:
            m = re.search(re.escape(w), text)
            held += [(i, m.start() + 1, m.end(), w)] if m else []
    rows = spark.createDataFrame([*((i, t) for i, (t, _) in enumerate(MENTIONED)), (98, None), (None, "Kai")], "row int, text string")
    given = spark.createDataFrame([*held, (98, 1, 3, "Kai"), (None, 1, 3, "Kai")], "row int, span_start int, span_end int, match string")
    got = {}
    for r in mentions.mentions(rows, given).collect():
        got.setdefault(r.row, set()).add((r.span_start, r.span_end, r.match, r.source))
    want = {i: spoken_of(t, [h[1:] for h in held if h[0] == i]) for i, (t, _) in enumerate(MENTIONED)}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert {r[2] for r in want[0]} == {"CY", "K", "BT"} and (1, "Alya") in {(1, r[2]) for r in want[1]}


LISTS = [
    ("sons Amir, Zaki, Hadi, Farid, Omar and Yusof came", {"Amir", "Zaki", "Hadi", "Farid", "Omar", "Yusof"}), ("Checked: ABC/DEF/GHJ/KLM/NPQ/RST/UVW/XYZ", {"ABC", "DEF", "GHJ", "KLM", "NPQ", "RST", "UVW", "XYZ"}),
    ("Sign-out 13:05: LKW / BS / JA / MT / QA / WB / EC / RD\n", {"LKW", "BS", "JA", "MT", "QA", "WB", "EC", "RD"}), ("list: LKW / RN / KLY\n", set()), ("Verified: OK. Checked: RN/QLX", {"QLX"}),
    ("wife Siti, Monday and Aminah", {"Siti"}), ("received 05/09/25 - KX. Withdrawal", {"KX"}), ("Take 1 tab - bd.\n", set()), ("Reviewed - ok.\n", set()),
]


def test_lists_of_any_length(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LISTS)], "row int, text string")
    got = {}
    for r in names.name_proposals(rows).collect():
        assert LISTS[r.row][0][r.span_start - 1 : r.span_end] == r.match
        got.setdefault(r.row, set()).add(r.match)
    assert [(t, got.get(i, set()), want) for i, (t, want) in enumerate(LISTS) if got.get(i, set()) != want] == []


def test_codes_that_number_no_person_are_dropped(spark):
    texts = ["Approved under CIRB 2025/0001 last week", "Protocol no. AB-2025-0001 amended", "ref AB-2025-0001 amended", "lot 4402118", "lot 4402119", "CIRB 2025/2384"]
    spans = [(0, "2025/0001", ["shape:id"], None), (1, "AB-2025-0001", ["shape:id", "ner"], None), (2, "AB-2025-0001", ["shape:id"], None), (3, "4402118", ["rule:mrn", "shape:id"], "mrn"), (4, "4402119", ["shape:id"], "phone"), (5, "CIRB 2025/2384", ["shape:id"], None)]
    merged = [(k, texts[k].index(m) + 1, texts[k].index(m) + len(m), m, sources, t) for k, m, sources, t in spans]
    rows, merged = spark.createDataFrame([*enumerate(texts)], "row int, text string"), spark.createDataFrame(merged, "row int, span_start int, span_end int, match string, sources array<string>, type string")
    assert sorted(r.row for r in mentions.without_impersonal(rows, merged).collect()) == [2, 3, 4]


def test_terms_of_address_are_no_engine_names(spark):
    texts = ["Papa said so", "Dr Ma came", "Ma. Lourdes came", "ah ma IC", "Kai Wen"]
    spans = [(0, "Papa"), (1, "Ma"), (2, "Ma"), (3, "ah ma"), (4, "Kai Wen")]
    given = spark.createDataFrame([(k, texts[k].index(m) + 1, texts[k].index(m) + len(m), m, "name") for k, m in spans], "row int, span_start int, span_end int, match string, type string")
    rows = spark.createDataFrame([*enumerate(texts)], "row int, text string")
    assert sorted(r.row for r in mentions.without_kin(rows, given, "row", VOCABULARY).collect()) == [1, 2, 4]


def test_what_is_walked_to_and_swept_reaches_the_proposer(spark):
    text = "TIME      USER-ID   ROLE\n08:00:00  x_tanab   RN\nmister lim ah beng says ok. <Nurse>Q. Example</Nurse> Reg. No. TCM-P1033. Ramli saw Perth."
    rows = spark.createDataFrame([(1, text)], "row int, text string")
    got = propose.propose(rows, words=spark.createDataFrame([("perth",)], "word string")).collect()
    sources = {r.match: r.sources for r in got}
    assert "shape:handle" in sources["x_tanab"] and "shape:name" in sources["lim ah beng"] and "shape:name_column" in sources["Q. Example"] and sources["Ramli"] == ["shape:token"]
    assert "shape:id" in sources["TCM-P1033"] and "Perth" not in sources and "shape:id?" not in {s for r in got for s in r.sources}
    swept = [r for r in got if r.sources == ["shape:token"]]
    assert not [r for r in swept for o in got if o not in swept and o.span_start <= r.span_end and r.span_start <= o.span_end]


ENGINE = [
    ("seen at Eastshore GH Ward Meena today", "Eastshore GH Ward Meena", "Meena"), ("the Eastshore Hospital called", "Eastshore Hospital", None), ("Doktor yang merawat", "yang merawat", None), ("Beliau dan keluarga", "dan keluarga", None),
    ("Mr ng came", "ng", "ng"), ("அவர் என் மகன்", "என்", None), ("Positive Murphy sign on exam", "Murphy", None), ("Admitted to RSUD Sukamaju", "Sukamaju", None), ("Spoke to Kai Wen, stable", "Kai Wen", "Kai Wen"),
    ("Hougang Clinic Nurse Siti Aminah.", "Hougang Clinic Nurse Siti Aminah.", "Siti Aminah"), ("Kai Wen's Clinic", "Kai Wen's Clinic", None),
]


def test_names_of_an_engine_are_cut_and_dropped(spark):
    rows = spark.createDataFrame([(i, t, t.index(m) + 1, m) for i, (t, m, _) in enumerate(ENGINE)], "row int, text string, at int, match string")
    got = {r.row: r.n for r in rows.select("row", names.engine_name(F.col("text"), F.col("at"), F.col("match"), VOCABULARY).alias("n")).collect()}
    for i, (text, match, want) in enumerate(ENGINE):
        assert (got[i].match if got[i] else None) == want, (text, got[i])
        assert want is None or text[got[i].start - 1 :].startswith(want)
