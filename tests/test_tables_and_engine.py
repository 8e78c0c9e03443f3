from pyspark.sql import functions as F

from spanlens.operators import certain, engine, tables
from spanlens.plans.engine_queries import scripted

TABLE = 'Export\n"No","Full name","MRN"\n1,"Lim, Kai",4402118\n2,,4402119\n\nNo,Name,MRN\n1,Ong Bee,5501\nshort,line\n2,Tan Kow,5502'


def test_cells_take_the_header_above_in_their_block(spark):
    rows = spark.createDataFrame([(1, TABLE), (2, None), (3, "a|b|c\nd|e|f")], "row long, text string")
    got = sorted((r.row, r.line_no, r.header, r.value) for r in tables.table_cells(rows).collect())
    assert (1, 2, "MRN", "4402118") in got and (1, 3, "MRN", "4402119") in got and (1, 6, "Name", "Ong Bee") in got
    assert not [g for g in got if g[1] == 8]  # another shape lies between it and its header
    for r in tables.table_cells(rows.where("row = 1")).collect():
        assert TABLE[r.span_start - 1 : r.span_end] == r.value
    assert {r.value for r in tables.name_cells(rows.where("row = 1")).collect()} >= {"Ong Bee"}


CERTAIN = [
    ("IC S1234567D ok", "S1234567D", "national_id", "nric_checksum"), ("S 1234 567 D", "S 1234 567 D", "national_id", "nric_checksum"), ("he d. 1998", "1998", "date_of_death", "death_keyword"), ("G****262U", "G****262U", "national_id", "masked_nric"),
    ("WeChat ID linzq_92", "linzq_92", "other_id", "handle_keyword"), ("Singapore 560123", "560123", "postal_code", "postal_keyword"), ("12 Bedok North Ave 3, 560123", "560123", "postal_code", "postal_after_address"), ("MRN: 4402118", "4402118", "mrn", "id_keyword"),
    ("BB_TXN=XM-26-09-3381", "XM-26-09-3381", "other_id", "kv_id_key"), ("PAT_MRN=4402118", "4402118", "mrn", "kv_id_key"), ("Lab No AB-2611", "AB-2611", "other_id", "ref_keyword"), ("NRIC ending 412D", "412D", "national_id", "nric_tail"),
    ("account no. 250-03851-0", "250-03851-0", "other_id", "account_keyword"), ("see IMG_4410.JPG", "IMG_4410.JPG", "photo", "image_file"), ("nine one seven seven zero four two six", "nine one seven seven zero four two six", "phone", "spoken_phone"),
    ("ORDER    ENTERED   BY        ITEM\n7718230  22/09     lowjm     CT abdomen", "lowjm", "other_id", "login_column"), ("ORDER    ENTERED   BY        ITEM\n7718230  22/09     lowjm     abdomen", "abdomen", None, None),
    ("MSH|x\nPID|1||44021||TAN^MEI LING\n", "TAN", "name", "hl7_person"), ("PID|1||44021||TAN^MEI LING", "MEI LING", "name", "hl7_person"), ("PID|1||44021||TAN^MEI LING", "MEI", None, None), ("PV1|1|I|||||S123^LIM^KAI~S9^NG^WEI\r\n", "S9", "other_id", "hl7_person"),
    ("PLT 245000", "245000", None, None), ("a 412D", "412D", None, None),
]


def test_certain_spans(spark):
    rows = spark.createDataFrame([(i, t, t.index(s) + 1, t.index(s) + len(s)) for i, (t, s, _, _) in enumerate(CERTAIN)], "row int, text string, a int, b int")
    got = {r.row: (r.c.identifier, r.c.reason) if r.c else (None, None) for r in rows.select("row", certain.rule_certain(F.col("text"), F.col("a"), F.col("b")).alias("c")).collect()}
    assert [(c, got[i]) for i, c in enumerate(CERTAIN) if got[i] != (c[2], c[3])] == []


def test_engine_keeps_what_is_sure_and_drops_what_lies_inside(spark):
    rows = spark.createDataFrame([(1, "Pt S1234567D, mail a.b@x.example.com, MRN 4402118.", None), (2, "", None), (3, "12/03/1950", "DOB")], "row long, text string, column string")
    got = engine.scan(rows, scripted).collect()
    sure = {(r.row, r.match): r for r in got if r.fast_path}
    assert sure[1, "S1234567D"].identifier == "national_id" and sure[1, "a.b@x.example.com"].identifier == "email" and sure[3, "12/03/1950"].identifier == "dob"
    assert all(r.decision == "identifier" and r.confidence == certain.CERTAIN for r in sure.values())
    assert not [r for r in got if not r.fast_path for s in sure.values() if s.row == r.row and s.span_start <= r.span_start and r.span_end <= s.span_end]


def test_failed_answers_are_reviewed(spark):
    rows = spark.createDataFrame([(1, "ref 7734-2210-9 noted", None)], "row long, text string, column string")
    weak = lambda q: scripted(q).withColumn("prob", F.lit(0.001))
    got = engine.scan(rows, weak).collect()
    assert got and all(r.decision == "review" and r.confidence is None and "failed" in r.reasons for r in got)
