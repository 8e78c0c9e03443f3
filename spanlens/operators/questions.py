"""What a judge may be asked beside the choice, and what rules and those answers add to a judgment: the wording of
questions, agreement with a yes or no, sensitivity, the role of a date, the kind of home an address names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import unicode_rules
from .judge import CATEGORY_AT, FAMILIES, SENSITIVE, address_context, rotations
from .propose import ASSAULT, lexicon_shapes

# Stems, the texts and order of options, the cue, and the sources that put a span where a person stands.
ANSWER_CUE = "Answer with one letter:"
STEMS = {
    "choice": 'In this text, what is "{span}"?',
    "personal": 'In this text, is "{span}" personal data about a specific person (a name, ID or record number, contact detail, address, birth or death date, or a sensitive health condition)?',
    "harm": 'In this text, how much harm could disclosing "{span}" do to the person it is about?',
    "home": "What kind of home is the address in this text?",
}
OPTION_TEXT = {
    "name": "person's name",
    "national_id": "NRIC / FIN / passport number",
    "mrn": "medical record number",
    "case_visit": "case or visit number",
    "address": "street address",
    "postal_code": "postal code",
    "phone": "phone number",
    "fax": "fax number",
    "email": "email address",
    "dob": "date of birth",
    "date_of_death": "date of death",
    "device": "device serial number",
    "biometric": "biometric",
    "photo": "photo",
    "other_id": "other ID (account, card, vehicle, licence, URL, IP)",
    "hiv_sti": "HIV or STI",
    "mental_health": "mental illness",
    "substance_use": "drug or alcohol use",
    "genetic": "genetic condition",
    "reproductive_sexual": "pregnancy or sexual health",
    "other_sensitive": "other sensitive condition",
}
NONE_TEXT = {
    "date": "other date (admission, visit, procedure, test, letter)",
    "code": "not personal (lab value, dose, code, ward/bed, duration like 3/7)",
    "numeric": "not personal (other date, lab value, dose, measurement)",
    "text": "not personal (ordinary words)",
    "alnum": "not personal (drug, test, ward/bed, measurement)",
    "fraction": "not personal (duration like 3/7, BP like 120/80, ratio or score)",
    "all": "not personal",
}
YES_NO = ("yes", "no")
HARM_LEVELS = ("none", "low", "moderate", "high")
HOMES = {
    "hdb": "a public housing (HDB) flat",
    "condo": "a private condominium or apartment",
    "landed": "a landed house (terrace, semi-detached or bungalow)",
    "unknown": "cannot tell from the text",
}
HOME_TYPE = {"hdb": "non_landed", "condo": "non_landed", "landed": "landed"}
PERSON_SLOTS = ("shape:initials", "shape:name_column", "shape:slot")

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def option_text(family: Column, option: Column) -> Column:
    """How an option is worded: that of none depends on the family; answers to the other questions stand for themselves."""
    return F.coalesce(F.when(option == "none", _lookup(NONE_TEXT, family)), _lookup(OPTION_TEXT | HOMES, option), option)


def span_text(match: Column) -> Column:
    """A span as a stem quotes it: on one line, with plain quotes inside."""
    return F.replace(F.replace(match, F.lit('"'), F.lit("'")), F.lit("\n"), F.lit(" "))


def question_text(shown: DataFrame) -> DataFrame:
    """candidate, order_idx, question of rows (candidate, order_idx, position, option, family, kind, match): the stem, a lettered line for each option, the cue."""
    line = F.concat(F.substr(F.lit(LETTERS), F.col("position") + 1, F.lit(1)), F.lit(") "), option_text(F.col("family"), F.col("option")))
    lines = F.array_sort(F.collect_list(F.struct("position", line.alias("line"))))
    stem = F.replace(_lookup(STEMS, F.first("kind")), F.lit("{span}"), span_text(F.first("match")))
    return shown.groupBy("candidate", "order_idx").agg(F.concat_ws("\n", stem, F.transform(lines, lambda x: x["line"]), F.lit(ANSWER_CUE)).alias("question"))


def _in_orders(candidates: DataFrame, orders: Column) -> DataFrame:
    asked = candidates.select("*", F.posexplode(orders).alias("order_idx", "_shown"))
    return asked.select("*", F.posexplode("_shown").alias("position", "option")).drop("_shown")


def both_ways(candidates: DataFrame, options: tuple[str, ...]) -> DataFrame:
    """candidates with order_idx, position and option: the options forward, then in reverse."""
    forward = F.array(*map(F.lit, options))
    return _in_orders(candidates, F.array(forward, F.reverse(forward)))


def every_turn(candidates: DataFrame, options: tuple[str, ...]) -> DataFrame:
    """candidates with order_idx, position and option: every cyclic shift of the options."""
    listed, n = F.array(*map(F.lit, options)), len(options)
    turned = F.transform(rotations(F.lit(n), F.lit(n)), lambda s: F.concat(F.slice(listed, s + 1, F.lit(n) - s), F.slice(listed, F.lit(1), s)))
    return _in_orders(candidates, turned)


def sensitivity(options: DataFrame) -> DataFrame:
    """candidate, sensitivity from readout rows of the question of harm: the mean level from 0 to 1, null where the answer failed."""
    level = F.array_position(F.array(*map(F.lit, HARM_LEVELS)), F.col("option")) - 1
    top = len(HARM_LEVELS) - 1
    return options.groupBy("candidate").agg(F.when(~F.max("failed"), F.round(F.sum(level * F.col("prob")) / top, 4)).alias("sensitivity"))


def disagreement(p_yes: Column, p_identifier: Column, disagree_at: float | None) -> Column:
    """Array of reasons for a review: the answer to yes or no lies disagree_at or more from the choice, or (p_yes null) failed. Empty where disagree_at is None."""
    none = F.array().cast("array<string>")
    if disagree_at is None:
        return none
    return F.when(p_yes.isNull(), F.array(F.lit("noul_failed"))).when(F.abs(p_yes - p_identifier) >= disagree_at, F.array(F.lit("choice_noul_disagree"))).otherwise(none)


def holds_sensitive_term(match: Column) -> Column:
    """Whether a span, or any text, holds a term of the sensitive-health lexicon; a null doesn't."""
    found = F.lit(False)
    for shape in (*lexicon_shapes(), ASSAULT):
        found = found | match.rlike("(?i)" + unicode_rules(shape.pattern))
    return F.coalesce(found, F.lit(False))


def name_in_slot(category: Column, type_: Column, sources: Column, match: Column) -> Column:
    """The category, but a name for a sensitive call on a span proposed as a name from where a person stands, without a term of the lexicon in it."""
    slot = F.arrays_overlap(sources, F.array(*map(F.lit, PERSON_SLOTS)))
    person = category.isin(*SENSITIVE) & (type_ == "name") & slot & ~holds_sensitive_term(match)
    return F.when(F.coalesce(person, F.lit(False)), "name").otherwise(category)


def group_of(category: Column, sources: Column) -> Column:
    """The call a judgment made, as calibrators by group know it: identifier, none, or a sensitive one that the lexicon (shi_lexicon) or only something else (shi_other) proposed."""
    lexicon = F.coalesce(F.exists(sources, lambda s: s.startswith("lexicon:")), F.lit(False))
    return F.when(category.isin(*SENSITIVE), F.when(lexicon, "shi_lexicon").otherwise("shi_other")).when(category != "none", "identifier").otherwise("none")


def date_role(category: Column, category_p: Column, family: Column, category_at: float = CATEGORY_AT) -> Column:
    """dob, date_of_death or other for a date, unknown where the choice was weak; null for what isn't judged a date."""
    named = category.isin(*[o for o in FAMILIES["date"] if o != "none"])
    role = F.when(named, category).when((family == "date") & (category == "none"), "other")
    return F.when(role.isNotNull(), F.when(category_p >= category_at, role).otherwise("unknown"))


def home_of(text: Column, start: Column, end: Column, p_address: Column, p_postal: Column, least: float = 0.2) -> Column:
    """Struct (property_kind, property_type) that the text proves, where an address or a postal code is likely enough; else null."""
    a, p = F.coalesce(p_address, F.lit(0.0)), F.coalesce(p_postal, F.lit(0.0))
    return F.when(a + p >= least, address_context(text, start, end, F.when(p > a, "postal_code").otherwise("address")))


def best_home(options: DataFrame) -> DataFrame:
    """candidate, home, home_p from readout rows of the question of homes; the earlier option on ties, null where the answer failed."""
    place = F.array_position(F.array(*map(F.lit, HOMES)), F.col("option"))
    best = F.max(F.struct("prob", -place, "option"))
    return options.groupBy("candidate").agg(best.alias("b"), F.max("failed").alias("failed")).select("candidate", F.when(~F.col("failed"), F.col("b.option")).alias("home"), F.col("b.prob").alias("home_p"))


def home_answered(proved: Column, home: Column, home_p: Column, category_at: float = CATEGORY_AT) -> Column:
    """What the text proves, completed by the answer where no kind is proved: a sure answer counts unless it contradicts the type that is."""
    of = _lookup(HOME_TYPE, home)
    fits = (proved["property_kind"] == "unknown") & (home_p >= category_at) & of.isNotNull() & ((proved["property_type"] == "unknown") | (proved["property_type"] == of))
    return F.when(F.coalesce(fits, F.lit(False)), F.struct(home.alias("property_kind"), of.alias("property_type"))).otherwise(proved)
