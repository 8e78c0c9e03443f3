"""Judgments of candidate spans: option families, readout of answers, decisions and what may override them.

Answers are a table (candidate, order, position of each option, token, probability); where they come from
is the caller's. Everything after the model's first token is column arithmetic and two aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.matching import unicode_rules
from ..functions.validators import compact_date, digit_count, ocr_date, trimmed

# Labels, option families and the sources that are never dropped.
IDENTIFIERS = ("name", "national_id", "mrn", "case_visit", "address", "postal_code", "phone", "fax", "email", "dob", "date_of_death", "device", "biometric", "photo", "other_id")
SENSITIVE = ("hiv_sti", "mental_health", "substance_use", "genetic", "reproductive_sexual", "other_sensitive")
_DATES = ("dob", "date_of_death")
_CODES = ("national_id", "mrn", "case_visit", "phone", "fax", "postal_code", "email", "device", "other_id")
FAMILIES = {
    "date": (*_DATES, "none"),
    "code": (*_CODES, "none"),
    "text": ("name", "address", *SENSITIVE, "none"),
    "numeric": (*_CODES, *_DATES, "none"),
    "alnum": ("name", *_CODES, "address", *SENSITIVE, "none"),
    "fraction": (*_DATES, "none"),
    "all": (*IDENTIFIERS, *SENSITIVE, "none"),
}
NEVER_DROPPED = ("rule:nric", "rule:temp_ic", "rule:mrn", "rule:phone", "rule:email", "rule:case", "rule:passport", "rule:postal", "shape:slot", "shape:initials", "shape:name_column", "shape:id_column")
TYPE_LABELS = {
    "name": "name", "nric": "national_id", "fin": "national_id", "temp_ic": "national_id", "passport": "national_id", "mrn": "mrn", "case": "case_visit", "address": "address", "postal": "postal_code",
    "phone": "phone", "fax": "fax", "email": "email", "dob": "dob", "date": "dob", "date_of_death": "date_of_death", "serial": "device", "biometric": "biometric", "photo": "photo", "url": "other_id", "ip": "other_id",
    "account": "other_id", "vehicle": "other_id", "beneficiary": "other_id", "licence": "other_id", **{x: x for x in SENSITIVE},
}
DROP_BELOW, ACCEPT_AT, CATEGORY_AT, MIN_MASS, ROTATIONS = 0.05, 0.80, 0.60, 0.50, 4

_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
DATE_SHAPES = (
    r"^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}$",
    r"^\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2}$",
    rf"^\d{{1,2}}(?:st|nd|rd|th)?[ \-]{_MONTH}[ \-,]*\d{{2,4}}$",
    rf"^{_MONTH}[ \-]\d{{1,2}}(?:st|nd|rd|th)?[ \-,]*\d{{2,4}}$",
    r"^\d{4}[ \t]?年[ \t]?\d{1,2}[ \t]?月[ \t]?\d{1,2}[ \t]?日$",
)


def options_table(spark: SparkSession) -> DataFrame:
    """family, position, option in catalogue order."""
    rows = [(f, i, o) for f, options in FAMILIES.items() for i, o in enumerate(options)]
    return spark.createDataFrame(rows, "family string, position int, option string")


def labels_table(spark: SparkSession) -> DataFrame:
    """type, label, kind: what a span's type stands for."""
    return spark.createDataFrame([(t, l, "sensitive" if l in SENSITIVE else "identifier") for t, l in TYPE_LABELS.items()], "type string, label string, kind string")


def family_of(match: Column) -> Column:
    """The option family of a span by its shape."""
    s = F.trim(match)
    any_date = F.lit(False)
    for p in DATE_SHAPES:
        any_date = any_date | s.rlike("(?i)" + unicode_rules(p))
    return (
        F.when(any_date | ocr_date(s).isNotNull(), "date").when(s.rlike(r"^\d{1,3}/\d{1,3}\z"), "fraction")
        .when(s.contains("@") | s.rlike(r"(?i)^(?:https?://|www\.)"), "code").when(s.rlike(r"^\d{8}\z") & compact_date(s).isNotNull(), "numeric")
        .when(~s.rlike(r"\d"), "text").when(s.rlike("[A-Za-z]{3,}"), "alnum").when(s.rlike(r"\s"), "numeric").otherwise("code")
    )


DATE_COLUMN = r"(?i)date|dob|birth|death|died|_dt$|^dt_|time"
DATE_LEAD = r"(?i)(?:\b(?:on|dated?|since|until|till|DOB|born|birth|death|died)|\bD\.O\.B\.?)\s*:?\s*$"
YOB_LEAD = r"(?:(?<![\w/])[MF][ \t]*/[ \t]*|\b(?i:YOB|year[ \t]+of[ \t]+birth|born(?:[ \t]+in)?)[ \t]*:?[ \t]*)$"
YOB_COLUMN = r"\b(?i:YOB|year[ \t]+of[ \t]+birth|birth[ \t]*year)\b"


def left_of(text: Column, start: Column, width: int) -> Column:
    """Up to `width` characters before a 1-based start."""
    first = F.greatest(F.lit(1), start - width)
    return F.substring(text, first, start - first)


def family_in_context(text: Column, start: Column, end: Column, column: Column) -> Column:
    """family_of, but a year after a word of birth, and eight digits after a date word or alone in a date column, are dates."""
    m = F.trim(F.substring(text, start, end - start + 1))
    base, left, head = family_of(m), left_of(text, start, 24), F.coalesce(column, F.lit(""))
    born = m.rlike(r"^(?:19|20)\d{2}\z") & (left.rlike(YOB_LEAD) | head.rlike(YOB_COLUMN))
    cell = column.isNotNull() & (m == F.trim(text)) & head.rlike(DATE_COLUMN)
    dated = (base == "numeric") & m.rlike(r"^\d{8}\z") & (F.coalesce(cell, F.lit(False)) | left.rlike(DATE_LEAD))
    return F.when(born | dated, "date").otherwise(base)


def date_column_identifier(column: Column) -> Column:
    """date_of_death or dob for a header that names such dates, else null."""
    words = F.regexp_replace(column, "([a-z])([A-Z])", "$1 $2")
    named = lambda alternatives: words.rlike(rf"(?i)(?:^|[^a-z])(?:{alternatives})(?:[^a-z]|$)")
    return F.when(named("dod|death|died|deceased"), "date_of_death").when(named(r"dob|d\.o\.b|birth|born"), "dob")


def address_context(text: Column, start: Column, end: Column, category: Column) -> Column:
    """Struct (property_kind, property_type) that an address, or the line before a postal code, proves."""
    line = F.element_at(F.split(left_of(text, start, 120), "\n"), -1)
    s = F.when(category == "address", F.substring(text, start, end - start + 1)).otherwise(line)
    public, unit = s.rlike(r"(?i)\b(?:Blk|Block)\s*\d+[A-Za-z]?\b"), s.rlike(r"#\s?\d{1,3}-\d{1,5}\b")
    return F.struct(F.when(public, "hdb").otherwise("unknown").alias("property_kind"), F.when(public | unit, "non_landed").otherwise("unknown").alias("property_type"))


def context_window(text: Column, start: Column, end: Column, width: int = 160) -> Column:
    """The span in double brackets with up to `width` characters on either side; brackets of the text are broken up."""
    clean = lambda x: F.replace(F.replace(x, F.lit("[["), F.lit("[ [")), F.lit("]]"), F.lit("] ]"))
    size = F.char_length(text)
    lead = F.when(start - 1 - width > 0, "...").otherwise("")
    tail = F.when(end + width < size, "...").otherwise("")
    return F.concat(lead, clean(left_of(text, start, width)), F.lit("[["), clean(F.substring(text, start, end - start + 1)), F.lit("]]"), clean(F.substring(text, end + 1, F.lit(width))), tail)


def prompt_prefix(text: Column, start: Column, end: Column, column: Column, width: int = 160) -> Column:
    head = F.substring(F.regexp_replace(F.trim(column), r"\s+", " "), 1, 60)
    return F.concat(F.coalesce(F.concat(F.lit("Column: "), head, F.lit("\n")), F.lit("")), F.lit("Text:\n"), context_window(text, start, end, width), F.lit("\n\n"))


def rotations(n: Column, k: Column) -> Column:
    """Array of min(k, n) shifts of n options, evenly spaced, halves rounded to even."""
    many = F.greatest(F.lit(1), F.least(k, n))
    return F.transform(F.sequence(F.lit(0), many - 1), lambda j: F.bround(j.cast("double") * n / many, 0).cast("int"))


def order_rows(candidates: DataFrame, k: int = ROTATIONS) -> DataFrame:
    """candidates (with family) with order_idx, position and option: a row for each letter of each question."""
    sizes = F.create_map(*[F.lit(x) for f, o in FAMILIES.items() for x in (f, len(o))])
    catalogue = F.create_map(*[x for f, o in FAMILIES.items() for x in (F.lit(f), F.array(*map(F.lit, o)))])
    n = F.element_at(sizes, F.col("family"))
    asked = candidates.select("*", F.posexplode(rotations(n, F.lit(k))).alias("order_idx", "_shift"))
    shown = asked.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("position"))
    option = F.element_at(F.element_at(catalogue, F.col("family")), (F.col("position") + F.col("_shift")) % n + 1)
    return shown.withColumn("option", option).drop("_shift")


def option_places(candidates: DataFrame, k: int = ROTATIONS) -> DataFrame:
    """candidates (with family and label) with order_idx and position of the label in each order: order_rows where option = label, without the rows of all other options."""
    catalogue = F.create_map(*[x for f, o in FAMILIES.items() for x in (F.lit(f), F.array(*map(F.lit, o)))])
    placed = candidates.withColumn("_options", F.element_at(catalogue, F.col("family"))).withColumn("_at", F.array_position("_options", F.col("label"))).where("_at > 0")
    asked = placed.select("*", F.posexplode_outer(rotations(F.size("_options"), F.lit(k))).alias("order_idx", "_shift"))
    return asked.withColumn("position", F.pmod(F.col("_at") - 1 - F.col("_shift"), F.size("_options")).cast("int")).drop("_options", "_at", "_shift")


def letter_of(token: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(token), r"[).:]+$", ""))


def readout(shown: DataFrame, answers: DataFrame, min_mass: float = MIN_MASS) -> DataFrame:
    """candidate, option, prob, spread, min_mass, failed.

    shown: candidate, order_idx, position, option; answers: candidate, order_idx, token, prob. Variants of a letter
    add up; each order is scaled to one; a candidate fails, with null prob, if any order's letters hold under
    min_mass. prob is the mean over orders, spread the widest range of any option."""
    letters = answers.groupBy("candidate", "order_idx", letter_of(F.col("token")).alias("letter")).agg(F.sum("prob").alias("mass"))
    lettered = shown.withColumn("letter", F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("position") + 1, F.lit(1)))
    # A planner that takes exploded rows for as few as their source would send them whole to every executor: hence merge, and windows in place of joins.
    met = lettered.join(letters.hint("merge"), ["candidate", "order_idx", "letter"], "left").select("candidate", "order_idx", "option", F.coalesce("mass", F.lit(0.0)).alias("mass"))
    each = met.withColumn("total", F.sum("mass").over(Window.partitionBy("candidate", "order_idx"))).withColumn("share", F.try_divide(F.col("mass"), F.col("total")))
    options = each.groupBy("candidate", "option").agg(F.avg("share").alias("prob"), (F.max("share") - F.min("share")).alias("move"), F.min("total").alias("least"))
    own = Window.partitionBy("candidate")
    out = options.withColumns({"spread": F.max("move").over(own), "min_mass": F.min("least").over(own)}).withColumn("failed", F.col("min_mass") < min_mass)
    return out.select("candidate", "option", F.when(~F.col("failed"), F.col("prob")).alias("prob"), F.when(~F.col("failed"), F.col("spread")).alias("spread"), "min_mass", "failed")


def choice(options: DataFrame) -> DataFrame:
    """candidate, category, category_p, p_identifier, failed from readout rows: the likeliest option, the earlier in the catalogue on ties."""
    order = F.create_map(*[F.lit(x) for i, o in enumerate(FAMILIES["all"]) for x in (o, i)])
    rank = F.element_at(order, F.col("option"))
    best = F.max(F.struct(F.col("prob"), (-rank).alias("r"), F.col("option")))
    out = options.groupBy("candidate").agg(best.alias("b"), F.max(F.when(F.col("option") == "none", F.col("prob"))).alias("none"), F.max("failed").alias("failed"))
    return out.select("candidate", F.when(~F.col("failed"), F.col("b.option")).alias("category"), F.when(~F.col("failed"), F.col("b.prob")).alias("category_p"), F.round(1 - F.col("none"), 6).alias("p_identifier"), "failed")


def decide(conf: Column, category_p: Column, reasons: Column, drop_below: float = DROP_BELOW, accept_at: float = ACCEPT_AT, category_at: float = CATEGORY_AT) -> Column:
    """Struct (decision, reasons). Reasons given force a review; a review adds its own. A null confidence, a failed judgment, is reviewed."""
    none = F.size(reasons) == 0
    more = F.concat(
        reasons, F.when((conf >= drop_below) & (conf < accept_at), F.array(F.lit("uncertain"))).otherwise(F.array().cast("array<string>")),
        F.when(category_p < category_at, F.array(F.lit("category_uncertain"))).otherwise(F.array().cast("array<string>")),
    )
    verdict = lambda name, why: F.struct(F.lit(name).alias("decision"), why.alias("reasons"))
    return F.when(none & (conf < drop_below), verdict("not_identifier", reasons)).when(none & (conf >= accept_at) & (category_p >= category_at), verdict("identifier", reasons)).otherwise(verdict("review", more))


def fail_closed_source(sources: Column) -> Column:
    """The first source of an array that is never dropped without review, else null."""
    return F.get(F.filter(sources, lambda s: s.isin(*NEVER_DROPPED)), F.lit(0))


def cell_reason(match: Column, family: Column, column: Column, whole: Column, outlier: Column) -> Column:
    """Why a whole structured cell may not be dropped without review, else null."""
    m = trimmed(match)
    dated = (family == "date") | compact_date(m).isNotNull()
    reason = F.when(outlier, "column_outlier").when(dated, F.when(~column.rlike(DATE_COLUMN), "misplaced_date")).when(digit_count(m) >= 5, "cell_id_shape")
    return F.when(column.isNotNull() & (column != "") & whole, reason)


def overridden(decision: Column, category: Column, sources: Column, cell: Column) -> Column:
    """Struct (decision, reason): a drop becomes a review for a source that is never dropped or a cell reason;
    a span that only the token sweep found is kept as a name or an address alone."""
    source = fail_closed_source(sources)
    only_token = (F.size(sources) == 1) & (F.get(sources, F.lit(0)) == "shape:token")
    out = lambda d, r: F.struct(d.alias("decision"), r.cast("string").alias("reason"))
    dropped = decision == "not_identifier"
    return (
        F.when(dropped & cell.isNotNull(), out(F.lit("review"), cell)).when(dropped & source.isNotNull(), out(F.lit("review"), F.concat(F.lit("fail_closed:"), source)))
        .when(only_token & ~F.coalesce(category.isin("name", "address"), F.lit(False)), out(F.lit("not_identifier"), F.lit(None))).otherwise(out(decision, F.lit(None)))
    )
