"""Judged spans: what a record falls back to, which spans are covered by others, policy actions and odd dates."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .intervals import bin_of, dealt
from .judge import IDENTIFIERS, SENSITIVE, TYPE_LABELS

RANK = {"identifier": 2, "review": 1, "not_identifier": 0}


def fallback_identifier(decision: Column, identifier: Column, probs: Column, type_: Column) -> Column:
    """A review without an identifier takes its likeliest label, in catalogue order on ties, or without probabilities what its type stands for."""
    ranked = F.array(*[F.struct(F.try_element_at(probs, F.lit(l)).alias("p"), F.lit(-i).alias("r"), F.lit(l).alias("label")) for i, l in enumerate((*IDENTIFIERS, *SENSITIVE))])
    best = F.array_max(F.filter(ranked, lambda x: x["p"].isNotNull()))["label"]
    types = F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    return F.when((decision == "review") & identifier.isNull(), F.coalesce(best, F.try_element_at(types, type_), type_)).otherwise(identifier)


def resolve(spans: DataFrame, key: str = "row") -> DataFrame:
    """spans (key, idx, span_start, span_end, decision, ...) without those inside another span of the key that comes before them.

    Spans come in the order of decision, width, start and idx. Containment is transitive and ranks are ordered, so
    "inside a kept span" is "inside any earlier one": an anti-join on the key and the bin of positions that a span starts in,
    as what holds it touches that bin, too."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])
    place = lambda d: F.struct(-F.element_at(rank, d("decision")), -(d("span_end") - d("span_start")), d("span_start"), d("idx"))
    left = spans.withColumn("_place", place(F.col)).withColumn("_at", bin_of(F.col("span_start")))
    right = dealt(left.select(F.col(key).alias("_key"), F.col("span_start").alias("_start"), F.col("span_end").alias("_end"), F.col("_place").alias("_before")), "_start", "_end")
    covered = (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_bin")) & (F.col("_start") <= F.col("span_start")) & (F.col("span_end") <= F.col("_end")) & (F.col("_before") < F.col("_place"))
    return left.join(right, covered, "left_anti").drop("_place", "_at")


def outside(candidates: DataFrame, sure: DataFrame, key: str = "row") -> DataFrame:
    """candidates not strictly inside a span of sure: those need no question."""
    s = dealt(sure.select(F.col(key).alias("_key"), F.col("span_start").alias("_start"), F.col("span_end").alias("_end")), "_start", "_end")
    inside = (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_bin")) & (F.col("_start") <= F.col("span_start")) & (F.col("span_end") <= F.col("_end")) & (F.col("_end") - F.col("_start") > F.col("span_end") - F.col("span_start"))
    return candidates.withColumn("_at", bin_of(F.col("span_start"))).join(s, inside, "left_anti").drop("_at")


# --- policy ---

ACTIONS = ("flag", "generalize", "pseudonymize", "remove", "retain")


def policy_table(spark: SparkSession, policy: dict) -> DataFrame:
    """key, by, case, action, method, options of a checked policy: a leaf has neither by nor case; the case of the fallback of a `by` rule is null."""
    rows = []
    for key, rule in check_policy(policy)["rules"].items():
        leaves = [(None, rule)] if "by" not in rule else [*rule["cases"].items(), (None, rule["unknown"])]
        rows += [(key, rule.get("by"), case, leaf["action"], leaf.get("method"), leaf.get("options", [])) for case, leaf in leaves]
    return spark.createDataFrame(rows, "key string, by string, case string, action string, method string, options array<string>")


def check_policy(policy: dict) -> dict:
    """The policy, or an error: known actions, a method to generalize, options to flag, cases and a fallback for `by`."""
    rules = policy.get("rules") if isinstance(policy, dict) else None
    if not isinstance(rules, dict):
        raise ValueError("a policy needs rules")
    for key, rule in rules.items():
        if not isinstance(rule, dict):
            raise ValueError(f"{key}: not a rule")
        leaves = [rule]
        if "by" in rule:
            if not isinstance(rule.get("cases"), dict) or not rule["cases"] or "unknown" not in rule:
                raise ValueError(f"{key}: a rule with by needs cases and unknown")
            leaves = [*rule["cases"].values(), rule["unknown"]]
        for leaf in leaves:
            action = leaf.get("action") if isinstance(leaf, dict) else None
            options = leaf.get("options") if action == "flag" else ["retain"]
            if action not in ACTIONS or (action == "generalize" and not leaf.get("method")) or not isinstance(options, list) or not options or not set(options) <= set(ACTIONS) - {"flag"}:
                raise ValueError(f"{key}: bad action {leaf!r}")
    return policy


def load_policy(path: str | None = None, variable: str = "SPANLENS_POLICY", relative: str = "docs/private/policy.json", search_from: str = ".") -> dict:
    """The checked policy of a path, else of the file that an environment variable names, else of the nearest file of the relative path at or above a folder."""
    at = path or os.environ.get(variable)
    folder = os.path.abspath(search_from)
    while at is None:
        if os.path.isfile(os.path.join(folder, relative)):
            at = os.path.join(folder, relative)
        elif os.path.dirname(folder) == folder:
            break
        folder = os.path.dirname(folder)
    if at is None or not os.path.isfile(at):
        raise FileNotFoundError(f"no policy file: give a path or set {variable}")
    with open(at, encoding="utf-8") as f:
        return check_policy(json.load(f))


def resolve_policy(spans: DataFrame, policy: DataFrame) -> DataFrame:
    """spans (type, identifier, context map<string,string>, ...) with policy_key, action, method, options, needs_review.

    The type's rule comes before the identifier's. Without a rule, or where the context doesn't settle a case, a
    span is flagged or falls back, and is reviewed. A policy is a page of rules, so it is broadcast."""
    keys = F.broadcast(policy.select(F.col("key").alias("_k"), F.col("by").alias("_by")).distinct())
    by_type = keys.select(F.col("_k").alias("_kt"), F.col("_by").alias("_bt"))
    met = spans.join(by_type, F.col("type") == F.col("_kt"), "left").join(keys, F.col("identifier") == F.col("_k"), "left")
    chosen = met.withColumn("policy_key", F.coalesce("_kt", "_k")).withColumn("_of", F.when(F.col("_kt").isNotNull(), F.col("_bt")).otherwise(F.col("_by")))
    case = F.when(F.col("_of").isNotNull(), F.try_element_at("context", F.col("_of")))
    p = policy.select(*[F.col(c).alias(f"_p_{c}") for c in ("key", "case", "action", "method", "options")])
    exact, rest = F.broadcast(p.where("_p_case IS NOT NULL")), F.broadcast(p.where("_p_case IS NULL").select(*[F.col(c).alias(c.replace("_p_", "_r_")) for c in p.columns]))
    out = chosen.withColumn("_case", case).join(exact, (F.col("policy_key") == F.col("_p_key")) & (F.col("_case") == F.col("_p_case")), "left").join(rest, F.col("policy_key") == F.col("_r_key"), "left")
    hit = F.col("_p_key").isNotNull()
    pick = lambda c: F.when(hit, F.col(f"_p_{c}")).otherwise(F.col(f"_r_{c}"))
    action = F.coalesce(pick("action"), F.lit("flag"))
    every = F.array(*[F.lit(a) for a in ACTIONS if a != "flag"])
    review = F.col("policy_key").isNull() | (F.col("_of").isNotNull() & ~hit) | (action == "flag")
    return out.select(*spans.columns, "policy_key", action.alias("action"), pick("method").alias("method"), F.when(F.col("policy_key").isNull(), every).otherwise(pick("options")).alias("options"), review.alias("needs_review"))


# --- columns of dates ---


def date_outliers(cells: DataFrame, column: str = "column", day: str = "day", filled: str = "filled", min_dates: int = 8, min_share: float = 0.7, k: float = 3.0, min_gap: int = 730) -> DataFrame:
    """cells (column, day: parsed date or null, filled: the cell isn't blank, ...) with outlier.

    A column counts as one of dates with at least min_dates dates that make up min_share of its filled cells. A
    date is an outlier if it lies over k robust deviations, and over min_gap days, from the column's median. The two
    exact medians are aggregates over distinct days, which a calendar bounds."""
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    rows = cells.withColumn("_day", number)
    middle = rows.groupBy(column).agg(F.percentile("_day", F.lit(0.5)).alias("_median"), F.count("_day").alias("_dates"), F.count_if(filled).alias("_filled"))
    near = rows.join(middle, column)
    spread = near.groupBy(column).agg(F.percentile(F.abs(F.col("_day") - F.col("_median")), F.lit(0.5)).alias("_mad"))
    cut = F.greatest(F.col("_mad") * k * 1.4826, F.lit(float(min_gap)))
    dated = (F.col("_dates") >= min_dates) & (F.col("_dates") >= min_share * F.col("_filled"))
    flag = F.coalesce(dated & (F.abs(F.col("_day") - F.col("_median")) > cut), F.lit(False))
    return near.join(spread, column).select(*cells.columns, flag.alias("outlier"))


