"""Tables pasted into text, and HL7 messages: cells with the header above them, people and codes by column or field.

Lines are exploded and stay with their text's key; the header above a cell is the last one in its block of
lines of one shape, by a window. Documents are the units of the windows, so work splits by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matching import unicode_rules

PIECES = "array<struct<at:int,value:string>>"
#: The first that splits a line into three cells is the line's; quotes protect all but the pipe.
DELIMITERS = ("\t", "|", ",", ";")
#: How far above a cell its header may stand.
REACH = 60

# Words of headers over people, over codes, and over the columns of a dataset; HL7 fields that hold people.
PEOPLE = [
    "name", "names", "patient", "pt", "staff", "user", "username", "clinician", "doctor", "dr", "nurse", "author", "caller", "nok", "carer", "caregiver", "informant", "witness",
    "officer", "member", "employee", "worker", "resident", "client", "attendee", "participant", "by", "sign", "signature", "sig", "initials", "initial", "checked", "verified",
    "dispensed", "scribe", "rn", "surgeon", "anaesthetist", "anesthetist", "scrub", "circulating", "assistant", "pharmacist", "therapist", "midwife", "vaccinator", "consultant",
    "registrar", "parent", "guardian", "mother", "father", "spouse", "kin", "init", "inits", "screener", "abstractor", "reviewer", "recorder", "interviewer", "coordinator",
    "collector", "approver", "requester", "reporter", "assessor", "rater", "observer", "investigator",
]
CODES = ["no", "id", "ref", "code", "number", "num", "nbr", "serial", "subject", "subj", "participant", "donor", "sample", "aliquot"]
DATASET = ["var", "variable", "field", "column", "col", "file", "dataset", "table", "item", "drug", "brand", "product", "test", "site", "ward", "unit"]
STAFF = ["PT", "OT", "ST", "DSA", "RN", "SSN", "SRN", "EN", "MO", "HO", "MSW", "SW", "APN", "NC", "CM"]
HL7_NAMES = ("PID-5", "PID-6", "PID-9", "NK1-2", "NK1-30", "GT1-3", "IN1-16", "PRD-2")
HL7_CLINICIANS = ("PV1-7", "PV1-8", "PV1-9", "PV1-17", "PV1-52", "ORC-10", "ORC-11", "ORC-12", "OBR-16", "OBR-28", "EVN-5", "PD1-4", "TXA-5", "TXA-9", "TXA-10", "TXA-11", "TXA-22", "ROL-4")


def pieces(array: str) -> str:
    """SQL for an array of strings, cut at one character each, as (at, value), at counting from 0."""
    return f"aggregate({array}, named_struct('at', 0, 'out', CAST(array() AS {PIECES})), (acc, x) -> named_struct('at', acc.at + char_length(x) + 1, 'out', concat(acc.out, array(named_struct('at', acc.at, 'value', x)))), acc -> acc.out)"


def lines(rows: DataFrame, key: str = "row") -> DataFrame:
    """key, line_no, line_at (0-based place of the line's first character), line."""
    cut = rows.where(F.col("text").isNotNull()).select(key, F.posexplode(F.expr(pieces("split(text, '\\n', -1)"))).alias("line_no", "p"))
    return cut.select(key, "line_no", F.col("p.at").alias("line_at"), F.col("p.value").alias("line"))


def _cells(delimiter: str) -> str:
    quoted = f"array_join(transform(split(line, '\"', -1), (p, i) -> IF(i % 2 = 1, replace(p, '{delimiter}', '\\u0001'), p)), '\"')"
    regex = "[|]" if delimiter == "|" else delimiter
    return f"split({'line' if delimiter == '|' else quoted}, '{regex}', -1)"


def _bare(value: Column) -> Column:
    """A cell's value without blanks and quotes around it."""
    return F.trim(F.btrim(F.trim(value), F.lit('"')))


def table_cells(rows: DataFrame, key: str = "row") -> DataFrame:
    """key, line_no, col, header, span_start, span_end, value: the filled cells of lines of three cells or more that stand under a header.

    A header is a line of three filled cells or more, all short labels without three digits in a row; it holds for the
    lines below it with as many cells, up to REACH of them."""
    each = lines(rows, key)
    sized = [f"IF(size({_cells(d)}) >= 3, named_struct('d', {i}, 'cells', {pieces(_cells(d))}), NULL)" for i, d in enumerate(DELIMITERS)]
    split = each.withColumn("t", F.expr(f"coalesce({', '.join(sized)})"))
    shaped = split.select(key, "line_no", "line_at", "t.d", "t.cells", F.coalesce(F.size("t.cells"), F.lit(1)).alias("n"))
    values = F.transform("cells", lambda c: F.regexp_replace(_bare(c["value"]), "\u0001", ","))
    label = lambda v: v.rlike(unicode_rules(r"\A[A-Za-z][\w /#()&'.-]{0,29}\z")) & ~v.rlike(r"[0-9]{3}")
    filled = F.filter("values", lambda v: v != "")
    head = shaped.withColumn("values", values).withColumn("header", F.when((F.col("n") >= 3) & (F.size(filled) >= 3) & F.forall(filled, label), F.col("values")))
    order = Window.partitionBy(key).orderBy("line_no")
    new = F.coalesce(~(F.struct("n", "d").eqNullSafe(F.lag(F.struct("n", "d")).over(order))), F.lit(True)).cast("int")
    blocks = head.withColumn("new", new).withColumn("block", F.sum("new").over(order))
    above = F.last("header", ignorenulls=True).over(Window.partitionBy(key, "block").orderBy("line_no").rowsBetween(-REACH, -1))
    under = blocks.withColumn("above", above).where("n >= 3 AND header IS NULL AND above IS NOT NULL")
    cells = under.select(key, "line_no", "line_at", "above", F.posexplode("cells").alias("col", "c"))
    value = F.regexp_replace(_bare(F.col("c.value")), "\u0001", ",")
    out = cells.withColumn("value", value).withColumn("raw", F.regexp_replace("c.value", "\u0001", ",")).where("value <> ''")
    return out.select(key, "line_no", "col", F.get("above", F.col("col")).alias("header"), F.expr("line_at + c.at + locate(value, raw)").alias("span_start"), F.expr("line_at + c.at + locate(value, raw) + char_length(value) - 1").alias("span_end"), "value")


def header_words(header: Column) -> Column:
    """Lower-case words of a header, also where they are run together in camel case."""
    return F.transform(F.regexp_extract_all(header, F.lit("[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), F.lit(0)), F.lower)


def _any(header: Column, words: list[str]) -> Column:
    return F.arrays_overlap(header_words(header), F.array(*map(F.lit, words)))


def name_cells(rows: DataFrame, key: str = "row") -> DataFrame:
    """Cells written like a name under a header of people, but for staff roles and columns about a dataset."""
    cells = table_cells(rows, key)
    like = F.col("value").rlike(r"\A[A-Za-z][A-Za-z .,'’_/-]{0,58}[A-Za-z.]\z") & ~F.col("value").isin(*STAFF)
    return cells.where(like & _any(F.col("header"), PEOPLE) & ~_any(F.col("header"), DATASET))


def id_cells(rows: DataFrame, key: str = "row") -> DataFrame:
    """Cells written like a code under a header of codes; a header that only numbers rows doesn't count."""
    v, h = F.col("value"), F.col("header")
    code = v.rlike(r"\A[A-Za-z0-9]+(?:[-/.][A-Za-z0-9]+)*\z") & v.rlike("[0-9]") & (v.rlike("[A-Za-z-]") | (F.char_length(F.regexp_replace(v, "[^0-9]", "")) >= 5)) & ~v.rlike(r"\A[0-9]{1,4}/[0-9]{1,2}/[0-9]{1,4}\z")
    numbers_rows = h.rlike(r"(?i)\A(?:no\.?|#|s/?n|sr)\z")
    return table_cells(rows, key).where(code & ~numbers_rows & (_any(h, CODES) | h.contains("#")))


def hl7_people(rows: DataFrame, key: str = "row") -> DataFrame:
    """key, span_start, span_end, value, identifier: names in the name fields of HL7 segments, and clinicians' names and ids."""
    segments = lines(rows, key).where(F.col("line").rlike(r"^[A-Z][A-Z0-9]{2}\|") & ~F.col("line").startswith("MSH")).withColumn("line", F.regexp_replace("line", r"\r\z", ""))
    fields = segments.select(key, "line_at", F.substring("line", 1, 3).alias("segment"), F.posexplode(F.expr(pieces("split(line, '[|]', -1)"))).alias("field", "f"))
    place = F.concat_ws("-", "segment", F.col("field").cast("string"))
    kept = fields.withColumn("kind", F.when(place.isin(*HL7_NAMES), "name").when(place.isin(*HL7_CLINICIANS), "clinician")).where("kind IS NOT NULL").select(key, "kind", (F.col("line_at") + F.col("f.at")).alias("field_at"), F.col("f.value").alias("value"))
    repeats = kept.select(key, "kind", "field_at", F.explode(F.expr(pieces("split(value, '~', -1)"))).alias("r")).select(key, "kind", F.expr("field_at + r.at").alias("rep_at"), F.col("r.value").alias("value"))
    parts = repeats.select(key, "kind", "rep_at", F.posexplode(F.expr(pieces("split(value, '[\\\\^]', -1)"))).alias("k", "c")).select(key, "kind", "k", F.expr("rep_at + c.at + 1").alias("span_start"), F.col("c.value").alias("value"))
    named = F.col("value").rlike(r"\A(?:[A-Za-z][A-Za-z '’.-]*[A-Za-z.]|[A-Za-z])\z")
    number = F.col("value").rlike(r"\A[A-Za-z0-9][A-Za-z0-9./-]*\z") & F.col("value").rlike("[0-9]")
    first = F.when(F.col("kind") == "name", 0).otherwise(1)
    identifier = F.when((F.col("kind") == "clinician") & (F.col("k") == 0), F.when(number, "other_id")).when(named & F.col("k").between(first, first + 2), "name")
    return parts.withColumn("identifier", identifier).where("identifier IS NOT NULL").select(key, "span_start", F.expr("span_start + char_length(value) - 1").alias("span_end"), "value", "identifier")


def hl7_component(text: Column, start: Column, end: Column) -> Column:
    """The identifier of the component of a person's HL7 field that the span is exactly; else null."""
    before = F.split(F.substring(text, F.lit(1), start - 1), "\n", -1)
    line = F.element_at(before, -1)
    rest = F.substring(text, end + 1, F.lit(2))
    fields = F.split(line, "[|]", -1)
    component = F.size(F.split(F.element_at(F.split(F.element_at(fields, -1), "~", -1), -1), r"\^", -1)) - 1
    value = F.substring(text, start, end - start + 1)
    place = F.concat(F.substring(line, 1, 3), F.lit("-"), (F.size(fields) - 1).cast("string"))
    segment = line.rlike(r"\A[A-Z][A-Z0-9]{2}[|]") & ~line.startswith("MSH")
    whole = line.rlike(r"[|~^]\z") & rest.rlike(r"\A(?:[|~^\n]|\r?\z|\r\n)") & ~value.rlike(r"[|~^\n]")
    named = value.rlike(r"\A(?:[A-Za-z][A-Za-z '’.-]*[A-Za-z.]|[A-Za-z])\z")
    number = value.rlike(r"\A[A-Za-z0-9][A-Za-z0-9./-]*\z") & value.rlike("[0-9]")
    person = F.when(place.isin(*HL7_NAMES) & component.between(0, 2) & named, "name")
    clinician = F.when(place.isin(*HL7_CLINICIANS), F.when((component == 0) & number, "other_id").when(component.between(1, 3) & named, "name"))
    return F.when(text.contains("|") & segment & whole, F.coalesce(person, clinician))
