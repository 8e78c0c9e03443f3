"""Scores of predicted spans against gold spans, pooling of sets and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import pairs, split
from .judge import IDENTIFIERS, SENSITIVE
from .ranks import running

# The gate's labels and bounds, and the normal quantile of a 95 % interval.
DIRECT = ("name", "national_id", "mrn", "phone", "email", "case_visit", "fax", "address", "postal_code", "dob", "date_of_death")
GATE = {"direct_recall": 0.98, "precision": 0.90, "ece": 0.05, "f1": 0.889}
Z95 = 1.959964


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def shown(predicted: DataFrame) -> DataFrame:
    """Predictions that don't call a sensitive label."""
    return predicted.where(F.col("label").isNull() | ~F.col("label").isin(*SENSITIVE))


def gold_hits(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """gold (doc, span_start, span_end, label, ...) with hit: whether a prediction that is no sensitive label overlaps it."""
    yes, no = split(gold, shown(predicted), "doc")
    return yes.withColumn("hit", F.lit(True)).unionByName(no.withColumn("hit", F.lit(False)))


def _right_and_wrong(predicted: DataFrame, gold: DataFrame, view: tuple[str, ...]) -> DataFrame:
    """One row, tp and fp: predictions that overlap gold of the view, and those that overlap no gold at all."""
    tp, _ = split(predicted, gold.where(F.col("label").isin(*view)), "doc")
    _, fp = split(predicted, gold, "doc")
    return tp.agg(F.count("*").alias("tp")).crossJoin(fp.agg(F.count("*").alias("fp")))  # one row each


def _f1(recall: Column, precision: Column) -> Column:
    return F.when((recall > 0) & (precision > 0), 2 * precision * recall / (precision + recall)).otherwise(0.0)


def span_score(gold: DataFrame, predicted: DataFrame, view: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """One row: gold, hits, recall, tp, fp, precision, f1 of a view.

    Predictions of sensitive labels don't count. A prediction that overlaps gold of the view is a true positive, one
    that overlaps only other gold is neutral, any other is a false positive."""
    seen = gold_hits(gold.where(F.col("label").isin(*view)), predicted).agg(F.count("*").alias("gold"), F.count_if("hit").alias("hits"))
    one = seen.crossJoin(_right_and_wrong(shown(predicted), gold, view))
    recall, precision = ratio(F.col("hits"), F.col("gold")), ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return one.select("gold", "hits", F.round(recall, 4).alias("recall"), "tp", "fp", F.round(precision, 4).alias("precision"), F.round(_f1(recall, precision), 4).alias("f1"))


def per_label_recall(gold: DataFrame, predicted: DataFrame, view: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """label, n, hits, recall."""
    hits = gold_hits(gold.where(F.col("label").isin(*view)), predicted)
    return hits.groupBy("label").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits")).withColumn("recall", F.round(ratio(F.col("hits"), F.col("n")), 4))


def islands(spans: DataFrame, key: str = "doc") -> DataFrame:
    """key, start, end of the stretches that spans cover together: touching and overlapping ones are one."""
    order = Window.partitionBy(key).orderBy("span_start", "span_end")
    ended = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flat = spans.where("span_start <= span_end").select(key, "span_start", "span_end").distinct()
    numbered = flat.withColumn("new", F.coalesce((F.col("span_start") > ended + 1).cast("int"), F.lit(0))).withColumn("island", F.sum("new").over(order))
    return numbered.groupBy(key, "island").agg(F.min("span_start").alias("start"), F.max("span_end").alias("end")).drop("island")


def coverage(docs: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """gold with covered: every letter or digit of it lies in some prediction of the document. Gold of unknown documents is left out.

    What a span holds beside the stretches that predictions cover is looked at once for each different span."""
    held = islands(shown(predicted)).select(F.col("doc").alias("p_doc"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    spans = gold.select("doc", "span_start", "span_end").distinct()
    met = pairs(spans, held, ("doc", "p_doc"), ("span_start", "span_end", "p_start", "p_end"))
    listed = met.groupBy("doc", "span_start", "span_end").agg(F.array_sort(F.collect_list(F.struct("p_start", "p_end"))).alias("held"))
    texts = spans.join(docs.select("doc", "text"), "doc").join(listed, ["doc", "span_start", "span_end"], "left")
    piece = lambda at, end: F.substring(F.col("text"), at, F.greatest(end - at, F.lit(0)))
    none = F.array().cast(listed.schema["held"].dataType)
    start = F.struct(F.col("span_start").cast("int").alias("at"), F.lit("").alias("out"))
    step = lambda acc, h: F.struct((h["p_end"] + 1).cast("int").alias("at"), F.concat(acc["out"], piece(acc["at"], h["p_start"])).alias("out"))
    rest = F.aggregate(F.coalesce("held", none), start, step, lambda acc: F.concat(acc["out"], piece(acc["at"], F.col("span_end") + 1)))
    each = texts.select(F.col("doc").alias("d"), F.col("span_start").alias("s"), F.col("span_end").alias("e"), (~rest.rlike(r"(?U)[\p{L}\p{N}]")).alias("covered"))
    of = (F.col("doc") == F.col("d")) & (F.col("span_start") == F.col("s")) & (F.col("span_end") == F.col("e"))
    return gold.join(each, of).select("doc", "span_start", "span_end", "label", "covered")


def _outcomes(docs: DataFrame, gold: DataFrame, predicted: DataFrame, view: tuple[str, ...]) -> DataFrame:
    """Distinct gold of a view with n (how often it stands there), hit, covered and auto: covered by accepted predictions, all where predictions have no decision."""
    seen = gold.where(F.col("label").isin(*view)).groupBy("doc", "span_start", "span_end", "label").agg(F.count("*").alias("n"))
    accepted = predicted.where(F.coalesce("decision", F.lit("identifier")) == "identifier") if "decision" in predicted.columns else predicted
    keys = ["doc", "span_start", "span_end", "label"]
    hits = gold_hits(seen, predicted)
    for name, by in (("covered", predicted), ("auto", accepted)):
        hits = hits.join(coverage(docs, seen, by).withColumnRenamed("covered", name), keys)
    return hits


def set_score(docs: DataFrame, gold: DataFrame, predicted: DataFrame, view: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """One row: gold, recall, covered, auto_covered, precision, f1, tp, fp, fp_on_negative_notes of a view over docs (doc, text).

    A span is covered if every letter or digit of it lies in some prediction, and auto-covered if accepted ones (decision identifier or
    none given) do. Negative notes have no gold at all."""
    known = docs.select("doc")
    gold, predicted = gold.join(known, "doc", "left_semi"), predicted.join(known, "doc", "left_semi")
    n = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0))
    seen = _outcomes(docs, gold, predicted, view).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("gold"), n("hit").alias("hits"), n("covered").alias("c"), n("auto").alias("a"))
    p = shown(predicted)
    negative = split(p, gold, "doc")[1].join(gold.select("doc").distinct(), "doc", "left_anti").agg(F.count("*").alias("fp_on_negative_notes"))
    one = seen.crossJoin(_right_and_wrong(p, gold, view)).crossJoin(negative)  # one row each
    recall, precision = ratio(F.col("hits"), F.col("gold")), ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    rate = lambda c, name: F.round(ratio(F.col(c), F.col("gold")), 4).alias(name)
    return one.select("gold", rate("hits", "recall"), rate("c", "covered"), rate("a", "auto_covered"), F.round(precision, 4).alias("precision"), F.round(_f1(recall, precision), 4).alias("f1"), "tp", "fp", "fp_on_negative_notes")


def label_scores(docs: DataFrame, gold: DataFrame, predicted: DataFrame, view: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """label, n, recall, covered."""
    rate = lambda c: F.round(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)) / F.sum("n"), 4)
    return _outcomes(docs, gold, predicted, view).groupBy("label").agg(F.sum("n").alias("total"), rate("hit").alias("recall"), rate("covered").alias("covered")).select("label", F.col("total").alias("n"), "recall", "covered")


def misses(docs: DataFrame, gold: DataFrame, predicted: DataFrame, view: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """doc, span_start, span_end, label, match, overlapped, n: gold that isn't covered, and how often it stands there; overlapped tells whether a prediction touches it."""
    open_ = _outcomes(docs, gold, predicted, view).where("NOT covered").join(docs.select("doc", "text"), "doc")
    return open_.select("doc", "span_start", "span_end", "label", F.expr("substring(text, span_start, span_end - span_start + 1)").alias("match"), F.col("hit").alias("overlapped"), "n")


def score_sensitive(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: gold, recall, category_ok, precision, fp of the sensitive labels."""
    g, q = (df.where(F.col("label").isin(*SENSITIVE)) for df in (gold, predicted))
    same = lambda df: df.withColumn("_called", F.struct("doc", "label"))
    counts = [df.agg(F.count("*").alias(name)) for df, name in ((g, "gold"), (split(g, q, "doc")[0], "hits"), (split(same(g), same(q), "_called")[0], "rights"))]
    one = counts[0].crossJoin(counts[1]).crossJoin(counts[2]).crossJoin(_right_and_wrong(q, gold, SENSITIVE))  # one row each
    return one.select(
        "gold", F.round(ratio(F.col("hits"), F.col("gold")), 4).alias("recall"), F.round(ratio(F.col("rights"), F.col("gold")), 4).alias("category_ok"),
        F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 4).alias("precision"), "fp",
    )


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """Struct (low, high): the interval of a share of k in n, four places; null for n = 0."""
    p, d = k / n, 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.struct(F.round(F.greatest(F.lit(0.0), middle - half), 4).alias("low"), F.round(F.least(F.lit(1.0), middle + half), 4).alias("high")))


def pool(sets: DataFrame) -> DataFrame:
    """One row from counts of sets (gold, missed, gold_direct, missed_direct, tp, fp): counts are added up, shares aren't averaged."""
    s = sets.agg(*[F.sum(c).alias(c) for c in ("gold", "missed", "gold_direct", "missed_direct", "tp", "fp")])
    recall, direct = ratio(F.col("gold") - F.col("missed"), F.col("gold")), ratio(F.col("gold_direct") - F.col("missed_direct"), F.col("gold_direct"))
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return s.select("*", F.round(recall, 4).alias("recall"), F.round(direct, 4).alias("direct_recall"), F.round(precision, 4).alias("precision"), F.round(ratio(2 * recall * precision, recall + precision), 4).alias("f1"))


def gate(pooled: DataFrame) -> DataFrame:
    """check, result for direct_recall, precision, ece, f1 and overall. What has no figure is INCOMPLETE; FAIL outweighs it."""
    passed = {k: (F.col(k) <= b if k == "ece" else F.col(k) > b if k == "f1" else F.col(k) >= b) for k, b in GATE.items()}
    results = {k: F.when(F.col(k).isNull(), "INCOMPLETE").when(v, "PASS").otherwise("FAIL") for k, v in passed.items()}
    every = F.array(*results.values())
    overall = F.when(F.array_contains(every, "FAIL"), "FAIL").when(F.array_contains(every, "INCOMPLETE"), "INCOMPLETE").otherwise("PASS")
    rows = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("result")) for k, v in {**results, "overall": overall}.items()])
    return pooled.select(F.inline(rows))


def percentile_nearest(values: DataFrame, q: float, column: str = "value") -> DataFrame:
    """The nearest-rank percentile: the value at place ceil(q n), counted from 1."""
    return _at(values, column, F.greatest(F.ceil(F.col("n") * q), F.lit(1)))


def percentile_index(values: DataFrame, q: float, column: str = "value") -> DataFrame:
    """The value at index int(q n), counted from 0 and never past the last."""
    return _at(values, column, F.least(F.floor(F.col("n") * q) + 1, F.col("n")))


def _at(values: DataFrame, column: str, place: Column) -> DataFrame:
    """Values are first counted; the least whose running count reaches the place is taken. Null without values."""
    runs = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    reached = running(runs, column, F.col("c")).withColumn("reached", F.col("before") + F.col("c"))
    sought = reached.agg(F.sum("c").alias("n")).select(place.alias("place"))  # one row
    return reached.crossJoin(F.broadcast(sought)).agg(F.min(F.when(F.col("reached") >= F.col("place"), F.col(column))).alias(column))
