"""Calibration metrics, calibrators and thresholds over rows of a probability p and an outcome y (boolean)."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running

#: Probabilities are clipped this far from 0 and 1 before a logarithm is taken.
CLIP = 1e-6
FORMAT = "spanlens.calibration.v1"
#: Steps of p between which running sums are carried on: a bounded table, whatever the number of rows.
STEPS = 1024


def checked(p: Column) -> Column:
    """p, or an error if it is no probability: a metric over bad input must not look like one over good input."""
    return F.when(p.between(0.0, 1.0), p).otherwise(F.raise_error(F.lit("probability out of range")).cast("double"))


def outcome(y: Column) -> Column:
    return y.cast("int").cast("double")


def reliability_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_p, mean_y for each of equal-width bins over [0, 1] that has rows."""
    at = F.least(F.floor(checked(F.col("p")) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(outcome(F.col("y"))).alias("mean_y"))


def ece(rows: DataFrame, bins: int = 10) -> DataFrame:
    """One row, ece: the mean gap between p and y in a bin, by the bins' shares of rows; null without rows."""
    return reliability_bins(rows, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("mean_y"))) / F.sum("n")).alias("ece"))


def brier(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(F.pow(F.col("p") - outcome(F.col("y")), 2)).alias("brier"))


def clipped(p: Column) -> Column:
    return F.least(F.lit(1 - CLIP), F.greatest(F.lit(CLIP), p))


def nll(rows: DataFrame) -> DataFrame:
    p = clipped(F.col("p"))
    return rows.agg(F.avg(-F.when(F.col("y").cast("boolean"), F.log(p)).otherwise(F.log(1 - p))).alias("nll"))


def by_score(rows: DataFrame) -> DataFrame:
    """p, n, pos with n_before and pos_before, the rows and positives at smaller p.

    Rows are first added up by p; running sums are taken inside steps of p, and steps are carried on over their
    own bounded table, so no task sees all scores."""
    step = F.least(F.floor(checked(F.col("p")) * STEPS), F.lit(STEPS - 1)).cast("int")
    sums = rows.groupBy("p").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("int")).alias("pos")).withColumn("step", step)
    carried = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = sums.groupBy("step").agg(F.sum("n").alias("sn"), F.sum("pos").alias("sp")).select("step", F.coalesce(F.sum("sn").over(carried), F.lit(0)).alias("n0"), F.coalesce(F.sum("sp").over(carried), F.lit(0)).alias("p0"))
    inside = Window.partitionBy("step").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    run = sums.withColumn("n1", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("p1", F.coalesce(F.sum("pos").over(inside), F.lit(0)))
    return run.join(F.broadcast(steps), "step").select("p", "n", "pos", (F.col("n0") + F.col("n1")).alias("n_before"), (F.col("p0") + F.col("p1")).alias("pos_before"))


def auroc(rows: DataFrame) -> DataFrame:
    """One row, auroc: the share of positive and negative pairs in order, ties for half; null if a class is absent."""
    s = by_score(rows)
    neg_before, neg = F.col("n_before") - F.col("pos_before"), F.col("n") - F.col("pos")
    return s.agg(F.try_divide(F.sum(F.col("pos") * (neg_before + neg / 2)), F.sum("pos") * (F.sum("n") - F.sum("pos"))).alias("auroc"))


# --- calibrators ---


@dataclass(frozen=True)
class Identity:
    def column(self, p: Column) -> Column:
        return p

    def to_dict(self) -> dict:
        return {"kind": "identity"}


@dataclass(frozen=True)
class Temperature:
    """The log odds divided by t."""

    t: float

    def column(self, p: Column) -> Column:
        q = clipped(p)
        return 1 / (1 + F.exp(-F.log(q / (1 - q)) / self.t))

    def to_dict(self) -> dict:
        return {"kind": "temperature", "t": self.t}


@dataclass(frozen=True)
class Isotonic:
    """A step function: xs are the blocks' upper edges, ys their rates; results stay `floor` away from 0 and 1.

    It is looked up at p rounded to `places` (None: as it is), and steps, unlike interpolation between points."""

    xs: tuple[float, ...]
    ys: tuple[float, ...]
    floor: float = 0.005
    places: int | None = 6

    def column(self, p: Column) -> Column:
        xs, ys = (F.array(*map(F.lit, v)) for v in (self.xs, self.ys))
        below = F.size(F.filter(xs, lambda x: x < (p if self.places is None else F.round(p, self.places))))
        return F.least(F.lit(1 - self.floor), F.greatest(F.lit(self.floor), F.element_at(ys, F.least(below, F.lit(len(self.ys) - 1)) + 1)))

    def to_dict(self) -> dict:
        return {"kind": "isotonic", "xs": list(self.xs), "ys": list(self.ys), "floor": self.floor}


@dataclass(frozen=True)
class Grouped:
    """A calibrator for each group and one for all other groups."""

    maps: dict[str, Identity | Temperature | Isotonic]
    default: Identity | Temperature | Isotonic

    def column(self, p: Column, group: Column) -> Column:
        out = self.default.column(p)
        for name, c in self.maps.items():
            out = F.when(group == name, c.column(p)).otherwise(out)
        return out

    def to_dict(self) -> dict:
        return {"kind": "grouped", "default": self.default.to_dict(), "groups": {k: c.to_dict() for k, c in self.maps.items()}}


def _points(rows: DataFrame, *keys: str) -> list[tuple]:
    """Rows added up by p rounded to six places: at most a million and one points for each group, which the fits need whole."""
    sums = rows.groupBy(*keys, F.round(checked(F.col("p")), 6).alias("p")).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("int")).alias("pos"))
    return sorted(tuple(r) for r in sums.collect())


def _temperature(points: list[tuple], low: float = 0.05, high: float = 20.0, halvings: int = 100) -> Temperature:
    """The temperature of least log loss. The loss is convex in the slope 1 / t, so its derivative, expected less observed log odds,
    changes sign once: the interval where it does is halved."""
    odds = []
    for p, n, k in points:
        p = min(1 - CLIP, max(CLIP, p))
        odds.append((math.log(p / (1 - p)), n, k))
    least, most = 1 / high, 1 / low
    for _ in range(halvings):
        slope = math.sqrt(least * most)
        if math.fsum(z * (n / (1 + math.exp(-slope * z)) - k) for z, n, k in odds) < 0:
            least = slope
        else:
            most = slope
    return Temperature(round(1 / math.sqrt(least * most), 6))


def _isotonic(points: list[tuple]) -> Isotonic:
    """Pool adjacent blocks while an earlier rate is at least the later one."""
    pooled: list[list[float]] = []
    for p, n, k in points:
        edge = p
        while pooled and pooled[-1][1] * n >= k * pooled[-1][2]:
            _, k0, n0 = pooled.pop()
            k, n = k + k0, n + n0
        pooled.append([edge, k, n])
    return Isotonic(tuple(round(e, 6) for e, _, _ in pooled), tuple(round(k / n, 6) for _, k, n in pooled))


_FITS = {"identity": lambda points: Identity(), "temperature": _temperature, "isotonic": _isotonic}


def fit(rows: DataFrame, kind: str):
    """A calibrator of a kind for rows (p, y); an error without rows."""
    points = _points(rows)
    if not points:
        raise ValueError("no data to fit")
    return _FITS[kind](points)


def fit_grouped(rows: DataFrame, kind: str = "isotonic", min_rows: int = 20) -> Grouped:
    """A calibrator for each group of rows (p, y, group) that has enough rows, the rest sharing one fitted on all."""
    groups: dict[str, list[tuple]] = {}
    total: dict[float, list[int]] = {}
    for g, p, n, k in _points(rows, "group"):
        groups.setdefault(g, []).append((p, n, k))
        sums = total.setdefault(p, [0, 0])
        sums[0] += n
        sums[1] += k
    if not total:
        raise ValueError("no data to fit")
    maps = {g: _FITS[kind](points) for g, points in groups.items() if sum(n for _, n, _ in points) >= min_rows}
    return Grouped(maps, _FITS[kind](sorted((p, n, k) for p, (n, k) in total.items())))


def from_dict(d: dict):
    kind = d.get("kind")
    if kind == "identity":
        return Identity()
    if kind == "temperature":
        return Temperature(float(d["t"]))
    if kind == "isotonic":
        xs, ys = [float(x) for x in d["xs"]], [float(y) for y in d["ys"]]
        if not xs or len(xs) != len(ys) or xs != sorted(xs) or ys != sorted(ys):
            raise ValueError("an isotonic calibrator needs sorted xs and ys of one length")
        return Isotonic(tuple(xs), tuple(ys), float(d.get("floor", 0.005)))
    if kind == "grouped":
        if "grouped" in [c.get("kind") for c in (d["default"], *d["groups"].values())]:
            raise ValueError("grouped calibrators do not nest")
        return Grouped({k: from_dict(c) for k, c in d["groups"].items()}, from_dict(d["default"]))
    raise ValueError(f"unknown calibrator kind {kind!r}")


def dumps(calibrator, thresholds: dict, meta: dict) -> str:
    return json.dumps({"format": FORMAT, "calibrator": calibrator.to_dict(), "thresholds": thresholds, "meta": meta}, indent=1)


def loads(text: str):
    """(calibrator, thresholds, meta); an error unless the format and the order of the thresholds are right."""
    d = json.loads(text)
    if d.get("format") != FORMAT:
        raise ValueError("not a calibration file")
    t = d["thresholds"]
    if not 0 <= t["drop_below"] <= t["accept_at"] <= 1:
        raise ValueError("thresholds must satisfy 0 <= drop_below <= accept_at <= 1")
    return from_dict(d["calibrator"]), t, d.get("meta", {})


# --- thresholds, folds, choice of a kind ---


def choose_thresholds(rows: DataFrame, recall: float = 0.98, precision: float = 0.98, max_drop: float = 0.05, min_accept: float = 0.5, min_support: int = 20) -> DataFrame:
    """One row: drop_below, accept_at, recall_at_drop, precision_at_accept.

    drop_below keeps `recall` of the positives, is never over max_drop and lies just under the positive it keeps.
    accept_at is the lowest score whose rows at or above it, min_support at least, are positive in `precision` of
    cases. With under min_support positives nothing is dropped and nothing accepted."""
    s = by_score(rows)
    totals = s.agg(F.sum("n").alias("rows"), F.coalesce(F.sum("pos"), F.lit(0)).alias("positives")).withColumn("spare", F.floor(F.col("positives") * (1 - recall) + 1e-9))
    all_of = s.crossJoin(F.broadcast(totals))  # totals is one row
    above, hits = F.col("rows") - F.col("n_before"), F.col("positives") - F.col("pos_before")
    good = (above >= min_support) & (F.col("p") >= min_accept) & (hits / above >= precision)
    cuts = all_of.agg(
        F.max("positives").alias("positives"), F.min(F.when(F.col("pos_before") + F.col("pos") > F.col("spare"), F.col("p"))).alias("cut"),
        F.min(F.when(good, F.struct(F.col("p").alias("p"), (hits / above).alias("precision")))).alias("best"),
    ).withColumn("drop", F.greatest(F.lit(0.0), F.least(F.coalesce("cut", F.lit(0.0)), F.lit(max_drop)) - 1e-6))
    few = F.coalesce(F.col("positives"), F.lit(0)) < min_support
    kept = s.crossJoin(F.broadcast(cuts.select("drop", F.col("positives").alias("of")))).agg(F.sum(F.when(F.col("p") >= F.col("drop"), F.col("pos"))).alias("kept"), F.max("of").alias("of"))
    recalled = F.try_divide(F.coalesce("kept", F.lit(0)), F.col("of"))
    return cuts.crossJoin(kept).select(
        F.when(few, 0.0).otherwise(F.round("drop", 6)).alias("drop_below"), F.when(few, 1.0).otherwise(F.coalesce(F.round("best.p", 6), F.lit(1.0))).alias("accept_at"),
        F.when(~few, F.round(recalled, 4)).alias("recall_at_drop"), F.when(~few, F.round("best.precision", 4)).alias("precision_at_accept"),
    )


def folds(rows: DataFrame, k: int, doc: str = "doc", order: str = "seq") -> DataFrame:
    """rows with fold: documents in the order they are first seen are dealt to k folds in turn."""
    first = rows.groupBy(doc).agg(F.min(order).alias("_first"))
    dealt = running(first, "_first", F.lit(1)).select(doc, (F.col("before") % k).cast("int").alias("fold"))
    return rows.join(dealt, doc)


def out_of_fold(rows: DataFrame, kind: str, k: int = 5) -> DataFrame:
    """rows (p, y, fold) with q, the score of a calibrator fitted on the other folds."""
    out = F.lit(None).cast("double")
    for i in range(k):
        rest = rows.where(F.col("fold") != i)
        out = F.when(F.col("fold") == i, fit(rest, kind).column(F.col("p"))).otherwise(out)
    return rows.withColumn("q", out)


def choose_kind(losses: dict[str, float], slack: float = 0.005) -> str:
    """The simplest kind whose loss is within slack of the best."""
    best = min(losses.values())
    return next(k for k in ("identity", "temperature", "isotonic") if k in losses and losses[k] <= best + slack)
