"""Checks and parsers of single values, as column expressions; null gives false or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
# Fixed values of the national check digit: weights, and letters by remainder for each series.
NRIC_WEIGHTS = (2, 7, 6, 5, 4, 3, 2)
NRIC_LETTERS = {"ST": "JZIHGFEDCBA", "FG": "XWUTRQPNMLK", "M": "KLJNPQRTUWX"}


def trimmed(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def digit_count(x: Column) -> Column:
    return F.char_length(digits_of(x))


def _digit(x: Column, at: int) -> Column:
    return F.substring(x, at, 1).try_cast("int")


def nric_valid(x: Column) -> Column:
    """Series letter, seven digits and the check letter that belongs to them, blanks around and case ignored."""
    s = F.upper(trimmed(x))
    total = sum((_digit(s, i + 2) * w for i, w in enumerate(NRIC_WEIGHTS)), F.lit(0))
    series = F.substring(s, 1, 1)
    rest = (total + F.when(series.isin("T", "G"), 4).when(series == "M", 3).otherwise(0)) % 11
    letter = (
        F.when(series.isin("S", "T"), F.substr(F.lit(NRIC_LETTERS["ST"]), rest + 1, F.lit(1)))
        .when(series.isin("F", "G"), F.substr(F.lit(NRIC_LETTERS["FG"]), rest + 1, F.lit(1)))
        .otherwise(F.substr(F.lit(NRIC_LETTERS["M"]), 11 - rest, F.lit(1)))
    )
    return F.coalesce(s.rlike(r"^[STFGM][0-9]{7}[A-Z]\z") & (F.substring(s, 9, 1) == letter), F.lit(False))


def date_of(year: Column, month: Column, day: Column) -> Column:
    """A calendar date from digit strings, or null."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def compact_date(x: Column) -> Column:
    """The date of eight digits, with an optional time after a blank or T: year first, then day first, then month first; years 1900 to 2100."""
    s = trimmed(x)
    part = lambda i, n: F.substring(s, i, n)
    orders = [date_of(part(1, 4), part(5, 2), part(7, 2)), date_of(part(5, 4), part(3, 2), part(1, 2)), date_of(part(5, 4), part(1, 2), part(3, 2))]
    tries = [F.when(F.year(d).between(1900, 2100), d) for d in orders]
    return F.when(s.rlike(r"^[0-9]{8}(?:[ T][0-9]{6})?\z"), F.coalesce(*tries))


def luhn(x: Column) -> Column:
    """The Luhn sum over the digits is a multiple of ten; fewer than twelve digits never pass."""
    d = F.reverse(digits_of(x))
    odd, even = F.regexp_replace(d, "(.)(.)", "$1"), F.regexp_replace(d, "(.)(.?)", "$2")
    ones = F.concat(odd, F.translate(even, "0123456789", "0246813579"))  # the digits of a doubled digit add up to these
    for v in range(10):  # as many signs as each digit is worth: plain functions, as a fold would be interpreted
        ones = F.replace(ones, F.lit(str(v)), F.lit("x" * v))
    return F.coalesce((F.char_length(d) >= 12) & (F.char_length(ones) % 10 == 0), F.lit(False))


def ip_valid(x: Column) -> Column:
    return F.coalesce(F.forall(F.split(x, r"\."), lambda o: o.try_cast("int").between(0, 255)), F.lit(False))


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def month_of(name: Column) -> Column:
    """Number of a month by its first three letters, as a string, or null."""
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3)))
    return F.when(at > 0, at.cast("string"))


def parse_date(x: Column) -> Column:
    """A date that is the whole value: eight digits, year first, day first (two-digit years from 50 on are of the 1900s), or with a month's name."""
    s = trimmed(x)
    got = lambda p, k: F.nullif(F.regexp_extract(s, p, k), F.lit(""))
    ymd = r"^([0-9]{4})[/.\-]([0-9]{1,2})[/.\-]([0-9]{1,2})\z"
    dmy = r"^([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{4}|[0-9]{2})\z"
    dmon = r"^([0-9]{1,2})(?:st|nd|rd|th)?[ \-]([A-Za-z]{3,9})[ \-,]*([0-9]{4})\z"
    mond = r"^([A-Za-z]{3,9})[ \-]([0-9]{1,2})(?:st|nd|rd|th)?[ \-,]*([0-9]{4})\z"
    short = got(dmy, 3)
    year = F.when(F.char_length(short) == 2, F.concat(F.when(short >= "50", "19").otherwise("20"), short)).otherwise(short)
    return F.coalesce(
        F.when(s.rlike(r"^[0-9]{8}\z"), compact_date(s)), date_of(got(ymd, 1), got(ymd, 2), got(ymd, 3)), date_of(year, got(dmy, 2), got(dmy, 1)),
        F.when(month_of(got(dmon, 2)).isNotNull(), date_of(got(dmon, 3), month_of(got(dmon, 2)), got(dmon, 1))),
        F.when(month_of(got(mond, 1)).isNotNull(), date_of(got(mond, 3), month_of(got(mond, 1)), got(mond, 2))),
    )


LOOK_ALIKES = ("lIOo", "1100")


def ocr_date(x: Column) -> Column:
    """A day-first date in which letters stand for digits, with those read as digits: at least one such letter and three digits; else null."""
    d = F.translate(x, *LOOK_ALIKES)
    part = lambda k: F.get(F.split(d, "[./-]"), F.lit(k)).try_cast("int")
    shape = x.rlike(r"^[0-9lIOo]{1,2}[./-][0-9lIOo]{1,2}[./-](?:[0-9lIOo]{4}|[0-9lIOo]{2})\z") & x.rlike("[lIOo]") & (digit_count(x) >= 3)
    return F.when(shape & part(0).between(1, 31) & part(1).between(1, 12), d)


DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def spoken_digits(x: Column) -> Column:
    """Digits of a number that is spelled out; plus gives +, double and triple repeat the next digit."""
    words = F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0))
    table = F.create_map(*[F.lit(v) for kv in DIGIT_WORDS.items() for v in kv])
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("times"))

    def step(acc: Column, w: Column) -> Column:
        digit = F.try_element_at(table, w)
        out = F.when(w == "plus", F.concat(acc["out"], F.lit("+"))).when(digit.isNotNull(), F.concat(acc["out"], F.repeat(digit, acc["times"]))).otherwise(acc["out"])
        times = F.when(w == "double", 2).when(w == "triple", 3).when(digit.isNotNull(), 1).otherwise(acc["times"])
        return F.struct(out.alias("out"), times.alias("times"))

    return F.aggregate(words, start, step, lambda acc: acc["out"])
