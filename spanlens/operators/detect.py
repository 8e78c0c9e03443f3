"""Rule detectors: a registry that generates column expressions, and what is done with their spans."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import ascii_rules, by_rule, found_by
from ..functions.validators import compact_date, ip_valid, luhn, nric_valid, trimmed

SPAN = "struct<start:int,end:int,match:string,type:string,identifier:string,detector:string,confidence:double>"
#: Confidence of a validated hit, what a failed validation takes off, and the least that a scan reports.
VALID, PENALTY, LEAST = 0.99, 0.4, 0.1


@dataclass(frozen=True)
class Detector:
    """pattern is written for ASCII and either case; validate maps a match to a boolean column; needs is a plain pattern that every
    match holds, looked for first; words: all matches start and end with a word character."""

    name: str
    type: str
    identifier: str
    pattern: str
    base: float
    validate: Callable[[Column], Column] | None = None
    needs: str | None = None
    words: bool = False


# Names, types, identifiers, shapes and base confidences of the shipped detectors, in order.
DETECTORS = (
    Detector("nric", "nric", "national_id", r"\b[STFGM][0-9]{7}[A-Z]\b", 0.6, nric_valid, needs="[0-9]{7}", words=True),
    Detector("temp_ic", "nric", "national_id", r"\b[XY][0-9]{7}(?:[0-9]{3})?[A-Z]\b", 0.8, needs="[0-9]{7}", words=True),
    Detector("email", "email", "email", r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", 0.97, needs="@"),
    Detector("phone", "phone", "phone", r"(?<![0-9])(?:\+?65[ -]?)?[3689][0-9]{3}[ -]?[0-9]{4}(?![0-9])", 0.7, needs="[0-9]{4}"),
    Detector("postal", "postal", "postal_code", r"\bSingapore\s+[0-9]{6}\b|\bS\(?[0-9]{6}\)?\b", 0.6, needs="[0-9]{6}"),
    Detector("date", "date", "dob", r"\b(?:[0-3]?[0-9][/-][0-1]?[0-9][/-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[/-][0-1]?[0-9][/-][0-3]?[0-9])\b", 0.75, needs="[/-]", words=True),
    Detector("date_compact", "date", "dob", r"\b[0-9]{8}(?:[ T][0-9]{6})?\b", 0.55, lambda m: compact_date(m).isNotNull(), needs="[0-9]{8}", words=True),
    Detector("url", "url", "other_id", r"\bhttps?://[^\s]+\b", 0.95, needs="://"),
    Detector("ip", "ip", "other_id", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 0.7, ip_valid, needs="[0-9][.][0-9]", words=True),
    Detector("passport", "passport", "national_id", r"\b[A-Z]{1,2}[0-9]{6,8}\b", 0.35, needs="[0-9]{6}", words=True),
    Detector("case", "case", "case_visit", r"\b[0-9]{10}[A-Z]\b", 0.7, needs="[0-9]{10}", words=True),
    Detector("mrn", "mrn", "mrn", r"\b[A-Z]{0,3}[0-9]{6,10}\b", 0.4, needs="[0-9]{6}", words=True),
    Detector("creditcard", "account", "other_id", r"\b(?:[0-9]{4}[ -]?){3}[0-9]{4}\b", 0.6, luhn, needs="[0-9]{4}", words=True),
)
POSTAL6 = Detector("postal6", "postal", "postal_code", r"\b[0-9]{6}\b", 0.5, needs="[0-9]{6}", words=True)


def detectors(postal6: bool = False, extra: Iterable[Detector] = ()) -> tuple[Detector, ...]:
    """The shipped detectors in order, then the bare postal code if wanted, then the caller's; a caller's detector takes the place of its namesake."""
    found = {d.name: d for d in DETECTORS}
    if postal6:
        found[POSTAL6.name] = POSTAL6
    found |= {d.name: d for d in extra}
    return tuple(found.values())


def confidence(d: Detector, match: Column, floor: bool) -> Column:
    """base, or by the validator's answer: VALID, else base less PENALTY, in scans never below LEAST."""
    if d.validate is None:
        return F.lit(d.base)
    failed = round(d.base - PENALTY, 10)
    return F.when(d.validate(match), F.lit(VALID)).otherwise(F.lit(max(LEAST, failed) if floor else failed))


def sought(dets: Iterable[Detector]) -> tuple:
    """Detectors as patterns of found_by."""
    return tuple((d.pattern, d.needs, None, True, True) for d in dets)  # Python's \\b with ASCII classes is matching.EDGE


def spans_of(text: str, dets: Iterable[Detector]) -> Column:
    """Array of the spans of detectors in the column named `text`, in the order of the detectors and then of the text."""
    dets = tuple(dets)
    return F.transform(found_by(text, sought(dets)), lambda m: span_of(m, dets))


def span_of(m: Column, dets: tuple[Detector, ...]) -> Column:
    """The span of a hit of found_by."""
    named = lambda f: [getattr(d, f) for d in dets]
    sure = by_rule(m["k"], named("base"), "double")
    for i, d in enumerate(dets):
        if d.validate is not None:
            sure = F.when(m["k"] == i, confidence(d, m["match"], True)).otherwise(sure)
    return F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match"), by_rule(m["k"], named("type"), "string").alias("type"), by_rule(m["k"], named("identifier"), "string").alias("identifier"),
        by_rule(m["k"], [f"rule:{d.name}" for d in dets], "string").alias("detector"), sure.alias("confidence"),
    )


def scan_text(rows: DataFrame, dets: Iterable[Detector] | None = None, text: str = "text") -> DataFrame:
    """All columns of rows but the text, with span: one row for each hit of each detector. No shuffle; texts go through Python in Arrow batches."""
    dets = detectors() if dets is None else tuple(dets)
    keys = [c for c in rows.columns if c != text]
    # No condition on the text, which the optimiser would put before texts are dealt, making each there. explode_outer: for a plain explode the optimiser computes the array once more, to see if it is empty.
    found = rows.select(*keys, F.explode_outer(found_by(text, sought(dets))).alias("span")).where("span IS NOT NULL")
    return found.select(*keys, span_of(F.col("span"), dets).alias("span"))


def flat(found: DataFrame) -> DataFrame:
    """span's fields as columns; start and end as span_start and span_end."""
    keys = [c for c in found.columns if c != "span"]
    return found.select(*keys, F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"), *[F.col(f"span.{f}").alias(f) for f in ("match", "type", "identifier", "detector", "confidence")])


def _greedy(spans: list[tuple[int, int, int]]) -> list[int]:
    """The numbers of spans (start, end, number), the best first, that overlap none kept before them."""
    if any(e < s for s, e, _ in spans):  # an empty span has no place among others
        kept = []
        for s, e, i in spans:
            if not any(s <= b and e >= a for a, b, _ in kept):
                kept.append((s, e, i))
        return [i for _, _, i in kept]
    starts, ends, out = [], [], []
    for s, e, i in spans:
        at = bisect_right(starts, e)
        if at and ends[at - 1] >= s:
            continue
        starts.insert(at, s)
        ends.insert(at, e)
        out.append(i)
    return out


def dedup_overlaps(spans: Column) -> Column:
    """Of an array of spans: the widest first, then the surest, each kept unless it overlaps one already kept.

    The order is stable. Greedy keeping isn't a join, since overlap isn't transitive; a text's spans are gone through in place, in Arrow batches."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    def kept(arrays):
        flat, sizes = arrays.flatten(), arrays.value_lengths().fill_null(0).to_numpy()
        start, end = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("start", "end"))
        sure = flat.field("confidence").fill_null(np.inf).to_numpy(zero_copy_only=False)
        order = np.lexsort((np.arange(len(flat)), -sure, start - end, np.repeat(np.arange(len(sizes)), sizes)))
        best = list(zip(start[order].tolist(), end[order].tolist(), order.tolist()))
        ends = np.cumsum(sizes).tolist()
        found = [_greedy(best[b - n : b]) for b, n in zip(ends, sizes.tolist())]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, flat.take(pa.array([i for x in found for i in x], pa.int64())), mask=arrays.is_null())

    kept.__annotations__ = {"arrays": pa.Array, "return": pa.Array}
    return arrow_udf(kept, f"array<{SPAN}>")(spans)


def classify_value(value: Column, dets: Iterable[Detector] | None = None) -> Column:
    """Map of detector name to confidence for the detectors whose pattern the whole trimmed value matches."""
    v = trimmed(value)
    dets = detectors() if dets is None else tuple(dets)
    hits = [F.when(v.rlike(ascii_rules(rf"\A(?:{d.pattern})\z")), F.struct(F.lit(d.name).alias("key"), confidence(d, v, False).alias("value"))) for d in dets]
    found = F.map_from_entries(F.filter(F.array(*hits), lambda h: h.isNotNull()))
    return F.when(v != "", found).otherwise(F.create_map().cast("map<string,double>"))
