"""All matches of a pattern with code-point offsets, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An ASCII word boundary: Java's own is Unicode-aware in part, and detectors are defined on ASCII.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

#: The same in front of, and behind, what only matches word characters.
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

MATCHES = "array<struct<start:int,end:int,match:string>>"


def ascii_rules(pattern: str, words: bool = False) -> str:
    r"""A pattern with \b written out for ASCII and letters in either case. words: what stands next to each \b is a word character, so that
    one look-around does; a \b is a start at the pattern's or an alternative's start."""
    if words:
        parts = pattern.split(r"\b")
        pattern = parts[0] + "".join((BEFORE if not a or a.endswith("|") else AFTER) + b for a, b in zip(parts, parts[1:]))
    return "(?i)" + pattern.replace(r"\b", EDGE)


def unicode_rules(pattern: str) -> str:
    r"""A pattern with Unicode classes and boundaries in which only \n ends a line."""
    return "(?Ud)" + pattern


def literal(s: str) -> str:
    """A string as a SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def all_matches(text: str, pattern: str, needs: str | None = None) -> Column:
    """Array of (start, end, match) over the column named `text`: start is 1-based, end inclusive, both in code points.
    Null text gives an empty array.

    Gaps between matches come from split, matches from regexp_extract_all; one pass adds up lengths. It is written as
    one SQL expression, since a scan builds dozens of them and each call to the JVM counts. needs: a plain pattern that
    any text with a match holds, which is cheaper to look for."""
    return F.expr(all_matches_sql(text, pattern, needs))


def all_matches_sql(text: str, pattern: str, needs: str | None = None) -> str:
    t, p, none = f"`{text}`", literal(pattern), f"CAST(array() AS {MATCHES})"
    hit = "named_struct('start', acc.at + x.gap + 1, 'end', acc.at + x.gap + char_length(x.hit), 'match', x.hit)"
    step = f"named_struct('at', acc.at + x.gap + coalesce(char_length(x.hit), 0), 'out', CASE WHEN x.hit IS NOT NULL THEN concat(acc.out, array({hit})) ELSE acc.out END)"
    pairs = f"zip_with(transform(split({t}, {p}, -1), g -> char_length(g)), regexp_extract_all({t}, {p}, 0), (g, h) -> named_struct('gap', g, 'hit', h))"
    gate = f"{t} RLIKE {literal(needs)} AND " if needs else ""
    return f"CASE WHEN {gate}{t} RLIKE {p} THEN aggregate({pairs}, named_struct('at', 0, 'out', {none}), (acc, x) -> {step}, acc -> acc.out) ELSE {none} END"


def one_of(word: Column, words: Sequence[str]) -> Column:
    """word.isin(*words), but words without commas are a single constant of the plan, not one for each."""
    plain, rest = [[w for w in words if ("," in w) == comma] for comma in (False, True)]
    if not plain:
        return word.isin(*rest)
    found = F.find_in_set(word, F.lit(",".join(plain))) > 0
    return found | word.isin(*rest) if rest else found


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once, however often body names it: a column that is named twice is written, and computed, twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def let(value: str, name: str, body: str) -> str:
    """SQL for body with name standing for value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def places_sql(lengths: str) -> str:
    """SQL for the sum of what comes before each element of an array of whole numbers. Sums run over blocks of the root of its size
    and inside them, so a long array costs its size times that root at most."""
    block = "CAST(floor(i / s.b) AS INT)"
    sums = "transform(sequence(0, greatest(0, CAST(floor((size(n) - 1) / b) AS INT))), k -> aggregate(slice(n, k * b + 1, b), 0, (a, x) -> a + x))"
    carried = f"aggregate({sums}, named_struct('at', 0, 'out', CAST(array() AS array<int>)), (acc, x) -> named_struct('at', acc.at + x, 'out', concat(acc.out, array(acc.at))), acc -> acc.out)"
    inside = f"transform(s.n, (x, i) -> s.c[{block}] + aggregate(slice(s.n, {block} * s.b + 1, i - {block} * s.b), 0, (a, y) -> a + y))"
    return let(lengths, "n", let("greatest(1, CAST(ceil(sqrt(size(n))) AS INT))", "b", let(f"named_struct('n', n, 'b', b, 'c', {carried})", "s", inside)))


def row_matches_sql(text: str, pattern: str, group: int = 0) -> str:
    """SQL for the matches of a pattern that is itself an expression, with offsets as in all_matches; group picks what `match` holds, the offsets being the whole match's."""
    hits, cut = f"regexp_extract_all({text}, {pattern}, 0)", f"split({text}, {pattern}, -1)"
    got = f"regexp_extract_all({text}, {pattern}, {group})"
    sized = f"transform({cut}, g -> char_length(g))"
    place = "s.at[i] + s.gaps[i]"
    each = f"transform(s.hits, (h, i) -> named_struct('start', {place} + 1, 'end', {place} + char_length(h), 'match', s.got[i]))"
    at = places_sql("zip_with(gaps, hits, (g, h) -> g + coalesce(char_length(h), 0))")
    found = let(sized, "gaps", let(hits, "hits", let(f"named_struct('gaps', gaps, 'hits', hits, 'got', {got}, 'at', {at})", "s", each)))
    return f"IF({text} RLIKE {pattern}, {found}, CAST(array() AS {MATCHES}))"


#: Classes as RE2 reads them, at least as wide as Java's and Python's with Unicode, and, for classes that are negated, at most as wide.
_WIDE = {"w": r"\pL\pM\pN\p{Pc}\p{Cf}", "d": r"\pN", "s": r"\s\x0b\x1c-\x1f\x{85}\pZ"}
#: Letters that either engine takes for i in either case, and RE2 doesn't.
_DOTTED_I = "[\u0130\u0131]"


def _class_end(pattern: str, i: int) -> int:
    """The place of the bracket that closes the class opened at i."""
    i += 2 if pattern[i + 1] == "^" else 1
    i += pattern[i] == "]"
    while pattern[i] != "]":
        i += 2 if pattern[i] == "\\" else 1
    return i


def _group_end(pattern: str, i: int) -> int:
    """The place behind the bracket that closes the group opened at i."""
    depth = 0
    while True:
        if pattern[i] == "[":
            i = _class_end(pattern, i)
        elif pattern[i] == "\\":
            i += 1
        else:
            depth += (pattern[i] == "(") - (pattern[i] == ")")
        i += 1
        if not depth:
            return i


@lru_cache(maxsize=512)
def relaxed(pattern: str, any_case: bool = False) -> str:
    r"""A pattern without look-around and other conditions on a place, for RE2: it is found in any text in which the pattern, as Java or Python reads it, has a match.
    It decides over a whole batch which texts need be read. Conditions only narrow a pattern, so one without them is found wherever it was."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            out.append("" if e in "bBAzZG" else f"[{_WIDE[e]}]" if e in _WIDE else c + e)
            i += 2
        elif c == "[":
            end = _class_end(pattern, i)
            body = pattern[i + 1 : end]
            negated = body.startswith("^")
            if negated and re.search(r"\\[WSD]", body):
                if re.search(r"\\[SD]", body):
                    raise ValueError(rf"no wider form of [{body}]")
                out.append(f"[{_WIDE['w']}]")  # what is no \W
            else:
                out.append("[" + re.sub(r"\\(.)|\[", lambda m: r"\[" if m[1] is None else m[0] if negated else _WIDE.get(m[1], m[0]), body) + "]")
            i = end + 1
        elif re.match(r"\(\?<?[=!]", pattern[i : i + 4]):
            i = _group_end(pattern, i)
        else:
            out.append("" if c in "^$" else c)
            i += 1
    plain = "".join(out)
    return f"(?i:{plain})|{_DOTTED_I}" if any_case else f"{plain}|{_DOTTED_I}" if "(?i" in plain else plain


def gate(pattern: str, any_case: bool = False) -> str | None:
    """relaxed, or None where RE2 can't read it: then every text is read."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if re.search(r"\{,\d", pattern):  # RE2 takes it for plain characters
        return None
    try:
        wide = relaxed(pattern, any_case)
        pc.match_substring_regex(pa.array([""]), wide)
    except (ValueError, IndexError):  # what pyarrow raises is a ValueError
        return None
    return wide


HITS = "array<struct<start:int,end:int,match:string,k:int>>"

#: A pattern of found_by: (pattern, what any text with a match holds or None, lead or None, whether letters match in either case, whether classes are ASCII's).
Sought = tuple[str, str | None, str | None, bool, bool]


@lru_cache(maxsize=64)
def _compiled(sought: tuple[Sought, ...]) -> list:
    """Of each pattern: the pattern, what decides over a batch which texts may match, the same for a single text where there is none, and the lead."""
    out = []
    for pattern, needs, lead, any_case, ascii_only in sought:
        flags = (re.IGNORECASE if any_case else 0) | (re.ASCII if ascii_only else 0)
        whole = pattern if lead is None else f"(?:{lead})(?:{pattern})"
        wide = gate(whole, any_case)
        out.append((re.compile(whole, flags), wide, re.compile(needs) if needs and wide is None else None, lead and re.compile(f"(?:{lead})", flags)))
    return out


def found_by(text: str, sought: tuple[Sought, ...]) -> Column:
    """Array of (start, end, match, k) over the column named `text`: the matches of every pattern, in the order of the patterns (k) and then of the
    text, with offsets as in all_matches. What a pattern's lead matches is cut off. Null text gives an empty array.

    For dozens of patterns over each text: Arrow finds in one pass over a batch which texts a pattern may match, and only those are read by
    the pattern itself; Spark's own functions read each text three times for each pattern."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.functions import arrow_udf

    def find(texts):
        strings = texts.to_pylist()
        at, starts, ends, matches, ks = [], [], [], [], []
        for k, (pattern, wide, needs, lead) in enumerate(_compiled(sought)):
            rows = range(len(strings)) if wide is None else pc.indices_nonzero(pc.match_substring_regex(texts, wide)).to_pylist()
            for i in rows:
                t = strings[i]
                if t and (needs is None or needs.search(t)):
                    for m in pattern.finditer(t):
                        a, b = m.span()
                        if lead is not None and (cut := lead.match(m.group())):
                            a += cut.end()
                        at.append(i)
                        starts.append(a + 1)
                        ends.append(b)
                        matches.append(t[a:b])
                        ks.append(k)
        places = np.asarray(at, np.int32)
        order = np.argsort(places, kind="stable")  # hits came by pattern; a text's own stay in that order
        hits = [pa.array(np.asarray(x, np.int32)[order]) for x in (starts, ends)] + [pa.array(matches, pa.string()).take(pa.array(order)), pa.array(np.asarray(ks, np.int32)[order])]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(places, minlength=len(strings)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(hits, names=["start", "end", "match", "k"]))

    find.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return arrow_udf(find, HITS)(F.col(text))


def by_rule(k: Column, values: list, kind: str) -> Column:
    """The k-th (from 0) of some constants."""
    return F.get(F.lit(values) if None not in values else F.array(*[F.lit(v).cast(kind) for v in values]), k)
