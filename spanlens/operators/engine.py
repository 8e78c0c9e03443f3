"""From texts to span records: propose, settle what is certain, ask about the rest, decide, resolve."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validators import parse_date
from ..sources.staging import Staging
from . import questions as q
from .calibration import Grouped, Identity, Isotonic, Temperature
from .certain import CERTAIN, column_certain, rule_certain
from .judge import ACCEPT_AT, CATEGORY_AT, DROP_BELOW, address_context, cell_reason, choice, decide, family_in_context, order_rows, overridden, readout
from .propose import propose
from .spans import date_outliers, fallback_identifier, outside, resolve

#: Gives answers (candidate, order_idx, token, prob) to questions (candidate, order_idx, position, option, kind, match, text).
Backend = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Judge:
    """Thresholds, the calibrator of p_identifier, and which questions are asked beside the choice.

    raw: decisions use p_identifier itself, and confidence alone is calibrated. disagree_at: how far the answer to
    yes or no may lie from the choice before a span is reviewed; None leaves it unused."""

    drop_below: float = DROP_BELOW
    accept_at: float = ACCEPT_AT
    category_at: float = CATEGORY_AT
    calibrator: Identity | Temperature | Isotonic | Grouped = Identity()
    raw: bool = False
    disagree_at: float | None = None
    ask_personal: bool = False
    ask_harm: bool = False
    ask_home: bool = False

    def confidence(self, p: Column, category: Column, sources: Column) -> Column:
        c = self.calibrator
        return c.column(p, q.group_of(category, sources)) if isinstance(c, Grouped) else c.column(p)


def calibrated(calibration: tuple, prompt: str, model: str | None = None, **settings) -> Judge:
    """A judge with what calibration.loads gave; an error where it was fitted for another prompt version or another model file."""
    calibrator, thresholds, meta = calibration
    if meta.get("prompt") != prompt:
        raise ValueError(f"fitted for prompt version {meta.get('prompt')!r}, not {prompt!r}")
    file = lambda path: str(path or "").replace("\\", "/").rsplit("/", 1)[-1]
    if model is not None and file(meta.get("model")) != file(model):
        raise ValueError(f"fitted for model {meta.get('model')!r}, not {model!r}")
    return Judge(drop_below=thresholds["drop_below"], accept_at=thresholds["accept_at"], calibrator=calibrator, raw=thresholds.get("space") == "raw", **settings)


def check_request(request: dict) -> dict:
    """The request, or an error before any work: a list of texts, a known kind, candidates for every text or for none."""
    if not isinstance(request.get("texts"), list):
        raise ValueError("a request needs a list of texts")
    if request.get("kind", "text") not in ("text", "cells"):
        raise ValueError(f"kind is text or cells, not {request['kind']!r}")
    if request.get("candidates") and len(request["candidates"]) != len(request["texts"]):
        raise ValueError("candidates need an entry for each text")
    return request


def _asked(candidates: DataFrame, shown: DataFrame, backend: Backend, stage: Staging) -> DataFrame:
    """readout of the answers to shown, each question being asked once."""
    answers = stage.write(backend(shown))
    return stage.write(readout(shown.select("candidate", "order_idx", "position", "option"), answers))


def judged(asked: DataFrame, backend: Backend, stage: Staging, judge: Judge) -> DataFrame:
    """asked (candidate, family, ...) with category, p_identifier, confidence, probs, decision, reasons, sensitivity and context. A failed answer is reviewed, never dropped."""
    options = _asked(asked, order_rows(asked.withColumn("kind", F.lit("choice"))), backend, stage)
    probs = options.groupBy("candidate").agg(F.map_from_entries(F.collect_list(F.struct("option", F.round("prob", 4).alias("prob")))).alias("probs"))
    likely = options.groupBy("candidate").agg(*[F.max(F.when(F.col("option") == o, F.col("prob"))).alias(f"_p_{o}") for o in ("address", "postal_code")])
    met = asked.join(choice(options), "candidate", "left").join(probs, "candidate", "left").join(likely, "candidate", "left")
    met = met.withColumn("category", q.name_in_slot(F.col("category"), F.col("type"), F.col("sources"), F.col("match")))
    where = [F.col(c) for c in ("text", "span_start", "span_end")]
    met = met.withColumn("home", q.home_of(*where, F.col("_p_address"), F.col("_p_postal_code")))
    none, p_yes = F.array().cast("array<string>"), F.lit(None).cast("double")
    if judge.ask_personal:
        yes = _asked(asked, q.both_ways(asked.withColumn("kind", F.lit("personal")), q.YES_NO), backend, stage)
        met, p_yes = met.join(yes.where("option = 'yes'").select("candidate", F.col("prob").alias("p_yes")), "candidate", "left"), F.col("p_yes")
    if judge.ask_harm:
        met = met.join(q.sensitivity(_asked(asked, q.both_ways(asked.withColumn("kind", F.lit("harm")), q.HARM_LEVELS), backend, stage)), "candidate", "left")
    if judge.ask_home:
        met = stage.write(met)
        unclear = met.where("home.property_kind = 'unknown'").select(asked.columns)
        homes = q.best_home(_asked(unclear, q.every_turn(unclear.withColumn("kind", F.lit("home")), tuple(q.HOMES)), backend, stage)).withColumnRenamed("home", "told")
        met = met.join(homes, "candidate", "left").withColumn("home", q.home_answered(F.col("home"), F.col("told"), F.col("home_p"), judge.category_at))
    failed = F.coalesce("failed", F.lit(True))
    reasons = F.when(failed, F.array(F.lit("failed"))).otherwise(q.disagreement(p_yes, F.col("p_identifier"), judge.disagree_at if judge.ask_personal else None))
    sure = met.withColumn("confidence", judge.confidence(F.col("p_identifier"), F.col("category"), F.col("sources")))
    first = sure.withColumn("d", decide(F.col("p_identifier" if judge.raw else "confidence"), F.col("category_p"), reasons, judge.drop_below, judge.accept_at, judge.category_at))
    cell = cell_reason(F.col("match"), F.col("family"), F.col("column"), F.trim("text") == F.col("match"), F.col("outlier"))
    final = first.withColumn("o", overridden(F.col("d.decision"), F.col("category"), F.col("sources"), cell))
    role = q.date_role(F.col("category"), F.col("category_p"), F.col("family"), judge.category_at)
    context = context_map(F.when(~failed, role), F.when(~failed, F.col("home")))
    more = F.when(F.col("o.reason").isNotNull(), F.array("o.reason")).otherwise(none)
    out = final.withColumn("decision", F.col("o.decision")).withColumn("reasons", F.concat("d.reasons", more)).withColumn("context", context)
    return out if judge.ask_harm else out.withColumn("sensitivity", F.lit(None).cast("double"))


def context_map(role: Column, home: Column) -> Column:
    """Map of date_role, property_kind and property_type as far as they are known, for the policy."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("date_role", role), ("property_kind", home["property_kind"]), ("property_type", home["property_type"]))])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def with_outliers(rows: DataFrame) -> DataFrame:
    """rows (row, text, column) with outlier: whether a cell's date lies far from those of its column."""
    cells = rows.where("column IS NOT NULL").select("row", "column", parse_date(F.trim("text")).alias("day"), (F.coalesce(F.trim("text"), F.lit("")) != "").alias("filled"))
    odd = date_outliers(cells).where("outlier").select("row", "outlier")
    return rows.join(odd, "row", "left").withColumn("outlier", F.coalesce("outlier", F.lit(False)))


def scan(rows: DataFrame, backend: Backend, judge: Judge = Judge(), include_dropped: bool = False, extra: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """Span records of rows (row, text, column): row, span_start, span_end, match, type, identifier, decision, confidence, reasons, sources, fast_path, sensitivity, context.

    Spans that code is sure of are accepted without a question, and candidates strictly inside them aren't asked
    about. A span inside another of equal or higher decision is left out; partial overlaps stay. A backend's failure
    is the job's failure: no row is skipped. extra: spans of the caller (row, span_start, span_end, type, source),
    from another engine for example; those outside their text are left out. words (word), a model's vocabulary, turns on the token sweep. Where dropped spans are included,
    they stay unresolved."""
    stage = Staging(rows.sparkSession, "engine")
    if extra is not None:
        within = F.col("span_start").between(1, F.col("span_end")) & (F.col("span_end") <= F.col("_size"))
        extra = extra.join(rows.select("row", F.char_length("text").alias("_size")), "row").where(within).drop("_size")
    found = stage.write(propose(rows.select("row", "text"), extra=extra, words=words))
    where = [F.col(c) for c in ("text", "span_start", "span_end")]
    certain = F.coalesce(rule_certain(*where), column_certain(*where, F.col("column")))
    known = stage.write(found.join(with_outliers(rows.select("row", "text", "column")), "row").select("*", certain.alias("sure"), family_in_context(*where, F.col("column")).alias("family")))
    none = F.lit(None)
    postal = F.when(F.col("sure.identifier") == "postal_code", address_context(*where, F.col("sure.identifier")))
    sure = known.where("sure IS NOT NULL").select(
        "row", "span_start", "span_end", "match", "type", F.col("sure.identifier").alias("identifier"), F.lit("identifier").alias("decision"), F.lit(CERTAIN).alias("confidence"),
        F.array().cast("array<string>").alias("reasons"), "sources", F.col("sure.reason").alias("fast_path"), none.cast("double").alias("sensitivity"), context_map(none.cast("string"), postal).alias("context"),
    )
    rest = outside(known.where("sure IS NULL"), sure).drop("sure")
    asked = stage.write(rest.withColumn("candidate", F.struct("row", "span_start", "span_end")))
    told = judged(asked, backend, stage, judge)
    category = F.when(F.col("category") != "none", F.col("category"))
    identifier = fallback_identifier(F.col("decision"), category, F.col("probs"), F.col("type"))
    answered = told.select(
        "row", "span_start", "span_end", "match", "type", F.when(F.col("decision") != "not_identifier", identifier).alias("identifier"), "decision", F.round("confidence", 4).alias("confidence"),
        "reasons", "sources", none.cast("string").alias("fast_path"), "sensitivity", "context",
    )
    every = stage.write(sure.unionByName(answered))
    kept = resolve(every.where("decision <> 'not_identifier'").withColumn("idx", F.lit(0))).drop("idx")  # intervals of a row differ, so idx never decides
    return kept.unionByName(every.where("decision = 'not_identifier'")) if include_dropped else kept
