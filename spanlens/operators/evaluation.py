"""Evaluation of judged candidates and of returned records: calls, calibration by call, outcomes by document, replay, bootstrap.

Tables: docs (doc, text); gold (doc, span_start, span_end, label); judged candidates (doc, span_start, span_end, category,
confidence, fast_path, sources); records (doc, span_start, span_end, identifier, decision, ...). Offsets count from 1
and are inclusive. Overlaps are looked up in bins of positions, so a long document is no task of its own.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calibration import Grouped, Isotonic, fit_grouped, folds, outcome
from .intervals import pairs, split
from .judge import IDENTIFIERS, SENSITIVE, decide, rotations
from .questions import HOME_TYPE, group_of
from .scoring import DIRECT, ratio, shown

BINS = 10


def judged_candidates(gold: DataFrame, judged: DataFrame) -> DataFrame:
    """The candidates that calibration applies to, with correct and call. One that overlaps only gold of other labels is left out, and
    so is a failed judgment, which has no confidence. Repeated rows count each."""
    called = judged.where("confidence IS NOT NULL").withColumn("call", F.when(F.coalesce("fast_path", F.lit(False)), "fast_path").otherwise(group_of(F.col("category"), F.col("sources"))))
    right, _ = split(called, gold.where(F.col("label").isin(*IDENTIFIERS, *SENSITIVE)), "doc")
    _, alone = split(called, gold, "doc")
    return right.withColumn("correct", F.lit(True)).unionByName(alone.withColumn("correct", F.lit(False)))


def calibration_by_call(candidates: DataFrame, bins: int = BINS) -> DataFrame:
    """call (all among them), n, positives, ece: the calibration error over all candidates and over those of each call."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence").cast("double")))
    each = candidates.select(F.explode(F.array(F.lit("all"), "call")).alias("call"), p.alias("p"), outcome(F.col("correct")).alias("y"))
    binned = each.groupBy("call", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"))
    return binned.groupBy("call").agg(F.sum("n").alias("n"), F.sum("sy").cast("long").alias("positives"), F.round(F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n"), 4).alias("ece"))


def gold_outcomes(docs: DataFrame, gold: DataFrame, records: DataFrame) -> DataFrame:
    """gold with flagged, auto, partial, label_ok: whether one record that isn't dropped holds all its letters and digits, one that is
    accepted does, some only overlap, and one that holds it has its label. Repeated gold counts each."""
    shown = records.where("decision <> 'not_identifier'").select(F.col("doc").alias("r_doc"), F.col("span_start").alias("r_start"), F.col("span_end").alias("r_end"), "identifier", "decision")
    alnum, keys = r"(?U)[\p{L}\p{N}]", ["doc", "span_start", "span_end", "label"]
    placed = gold.select(*keys).distinct().join(docs.select("doc", "text"), "doc")
    m = F.substring(F.col("text"), F.col("span_start"), F.col("span_end") - F.col("span_start") + 1)
    some = m.rlike(alnum)
    before = F.char_length(F.regexp_extract(m, r"(?Us)\A[^\p{L}\p{N}]*", 0))
    after = F.char_length(F.regexp_extract(m, r"(?Us)[^\p{L}\p{N}]*\z", 0))
    placed = placed.withColumn("need_start", F.when(some, F.col("span_start") + before).otherwise(F.col("span_start"))).withColumn("need_end", F.when(some, F.col("span_end") - after).otherwise(F.col("span_end"))).drop("text")
    met = pairs(placed, shown, ("doc", "r_doc"), ("span_start", "span_end", "r_start", "r_end"))
    holds = (F.col("r_start") <= F.col("need_start")) & (F.col("need_end") <= F.col("r_end"))
    ever = lambda c: F.max(F.coalesce(c, F.lit(False)))
    found = met.groupBy(*keys).agg(ever(holds).alias("flagged"), ever(holds & (F.col("decision") == "identifier")).alias("auto"), F.lit(True).alias("seen"), ever(holds & (F.col("identifier") == F.col("label"))).alias("label_ok"))
    no = lambda c: F.coalesce(c, F.lit(False))
    whole = gold.join(docs.select("doc"), "doc", "left_semi").join(found, keys, "left")
    return whole.select(*keys, no("flagged").alias("flagged"), no("auto").alias("auto"), (no("seen") & ~no("flagged")).alias("partial"), no("label_ok").alias("label_ok"))


def record_outcomes(gold: DataFrame, records: DataFrame) -> DataFrame:
    """The records that aren't dropped, with gold: whether any gold overlaps them."""
    met, alone = split(records.where("decision <> 'not_identifier'"), gold, "doc")
    return met.withColumn("gold", F.lit(True)).unionByName(alone.withColumn("gold", F.lit(False)))


def summary(docs: DataFrame, gold: DataFrame, records: DataFrame, direct: tuple[str, ...] = DIRECT) -> DataFrame:
    """One row of counts and rates over all documents."""
    sizes = docs.agg(F.count("*").alias("docs"), F.sum(F.char_length("text")).alias("chars"))
    g = gold_outcomes(docs, gold, records).withColumn("direct", F.col("label").isin(*direct)).agg(
        F.count("*").alias("gold"), F.count_if("flagged").alias("flagged"), F.count_if("direct").alias("direct"), F.count_if(F.col("direct") & F.col("flagged")).alias("direct_flagged"),
        F.count_if("auto").alias("auto"), F.count_if(F.col("label_ok") & F.col("flagged")).alias("label_ok"), F.count_if("partial").alias("partial"))
    accepted, review = F.col("decision") == "identifier", F.col("decision") == "review"
    r = record_outcomes(gold, records).agg(
        F.count("*").alias("returned"), F.count_if("gold").alias("right"), F.count_if(accepted).alias("accepted"), F.count_if(accepted & F.col("gold")).alias("accepted_right"),
        F.count_if(review).alias("reviews"), F.count_if(review & ~F.col("gold")).alias("false_review"))
    dropped = records.agg(F.count_if(F.col("decision") == "not_identifier").alias("dropped"))
    one = sizes.crossJoin(g).crossJoin(r).crossJoin(dropped)  # four tables of one row
    rate = lambda a, b: F.round(ratio(F.col(a), F.col(b)), 4)
    out = one.select(
        "docs", "chars", "gold", "returned", rate("flagged", "gold").alias("recall_flagged"), rate("direct_flagged", "direct").alias("recall_flagged_direct"), rate("auto", "gold").alias("recall_auto"),
        rate("label_ok", "flagged").alias("label_accuracy_flagged"), "partial", rate("right", "returned").alias("precision_flagged"), rate("accepted_right", "accepted").alias("precision_auto"),
        (F.col("accepted") - F.col("accepted_right")).alias("false_accepts"), rate("reviews", "returned").alias("review_rate"), F.round(ratio(F.col("reviews") * 1000, F.col("chars")), 2).alias("review_per_1k_chars"),
        "false_review", "dropped",
    )
    p, q = F.col("precision_flagged"), F.col("recall_flagged")
    return out.withColumn("f1_flagged", F.when((p > 0) & (q > 0), F.round(2 * p * q / (p + q), 4)))


def per_label(docs: DataFrame, gold: DataFrame, records: DataFrame) -> DataFrame:
    """label, n, recall_flagged, recall_auto, label_ok."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 4).alias
    return gold_outcomes(docs, gold, records).groupBy("label").agg(F.count("*").alias("n"), share("flagged")("recall_flagged"), share("auto")("recall_auto"), share("label_ok")("label_ok"))


def false_positives(gold: DataFrame, records: DataFrame, top: int = 25) -> DataFrame:
    """kind (decision:identifier:sources), n: the most frequent kinds of records that no gold overlaps."""
    kind = F.concat_ws(":", "decision", F.coalesce("identifier", F.lit("None")), F.array_join("sources", "+"))
    return record_outcomes(gold, records).where("NOT gold").groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(top)


def score_more(docs: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: fp and fp_on_negative_notes, the predictions that overlap no gold, and those of them in documents that have none."""
    _, wrong = split(shown(predicted), gold, "doc")
    negative = wrong.join(gold.select(F.col("doc").alias("g_doc")).distinct(), F.col("doc") == F.col("g_doc"), "left").withColumn("negative", F.col("g_doc").isNull())
    return negative.join(docs.select("doc"), "doc", "left_semi").agg(F.count("*").alias("fp"), F.count_if("negative").alias("fp_on_negative_notes"))


def replay(judged: DataFrame, calibrated: Column, drop_below: float, accept_at: float, category_at: float) -> DataFrame:
    """judged (fast_path, decision, confidence, category_p, prior) with replayed: the decision under a calibrator and thresholds, without
    asking again. calibrated: a column over confidence. Fast-path decisions stay; a judgment without a probability is reviewed.
    prior: the reasons that force a review whatever the probability."""
    again = decide(calibrated, F.col("category_p"), F.coalesce("prior", F.array().cast("array<string>")), drop_below, accept_at, category_at)["decision"]
    return judged.withColumn("replayed", F.when(F.coalesce("fast_path", F.lit(False)), F.col("decision")).when(F.col("confidence").isNull(), "review").otherwise(again))


def decision_metrics(rows: DataFrame, direct: tuple[str, ...] = DIRECT) -> DataFrame:
    """One row from rows (is_pii, label, replayed): recall of what isn't dropped, of direct labels and of what is accepted, precision of what is
    accepted, share of decoys dropped, share reviewed."""
    kept, accepted = F.col("replayed") != "not_identifier", F.col("replayed") == "identifier"
    near = F.col("is_pii") & F.col("label").isin(*direct)
    c = rows.agg(
        F.count("*").alias("n"), F.count_if("is_pii").alias("gold"), F.count_if(F.col("is_pii") & kept).alias("kept"), F.count_if(near).alias("direct"), F.count_if(near & kept).alias("direct_kept"),
        F.count_if(F.col("is_pii") & accepted).alias("right"), F.count_if(accepted).alias("accepted"), F.count_if(~F.col("is_pii")).alias("decoys"), F.count_if(~F.col("is_pii") & ~kept).alias("decoys_dropped"),
        F.count_if(F.col("replayed") == "review").alias("reviews"))
    rate = lambda a, b, name: F.round(ratio(F.col(a), F.col(b)), 4).alias(name)
    return c.select("n", rate("kept", "gold", "recall_flagged"), rate("direct_kept", "direct", "recall_flagged_direct"), rate("right", "gold", "recall_auto"), rate("right", "accepted", "precision_auto"), rate("decoys_dropped", "decoys", "decoy_dropped"), rate("reviews", "n", "review_rate"))


def ece_interval(rows: DataFrame, reps: int = 2000, seed: int = 0, bins: int = BINS) -> DataFrame:
    """One row, low and high: the 95 % percentile interval of the calibration error of rows (doc, p, y), documents being drawn as wholes.

    Each document's bins are added up once; in each repetition it counts a Poisson number of times with mean one, from a hash of the
    document and the repetition, which is equal in the limit to drawing as many documents with replacement."""
    sums = rows.groupBy("doc", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("p") - outcome(F.col("y"))).alias("gap"))
    drawn = sums.select("doc", "bin", "n", "gap", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    u = F.xxhash64("doc", "rep", F.lit(seed)) / float(1 << 64) + 0.5
    bounds, chance, k = [], 0.36787944117144233, 0.36787944117144233
    for i in range(1, 10):
        bounds.append(chance)
        k /= i
        chance += k
    times = sum((F.when(u >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    per_bin = drawn.withColumn("times", times).where("times > 0").groupBy("rep", "bin").agg(F.sum(F.col("times") * F.col("gap")).alias("gap"), F.sum(F.col("times") * F.col("n")).alias("n"))
    errors = per_bin.groupBy("rep").agg((F.sum(F.abs("gap")) / F.sum("n")).alias("ece"))
    return errors.agg(F.round(F.percentile("ece", 0.025), 4).alias("low"), F.round(F.percentile("ece", 0.975), 4).alias("high"))


# --- the judge by itself: candidates of known truth, with the answers of every order ---


def order_bias(orders: DataFrame, k: int = 4) -> DataFrame:
    """One row from answers by order (candidate, order_idx, option, share: an option's share in that order): how often the likeliest option of the first order
    alone, and of k orders spread evenly, is another than that of all, the mean spread of a candidate's options, and how far p(none) moves.

    Ties, to twelve places, go to the option that comes first by name; the k orders are those of judge.rotations."""
    # Dealt once by candidate: the window and both groupings then find a candidate's answers together.
    n = F.size(F.collect_set("order_idx").over(Window.partitionBy("candidate")))
    each = orders.repartition("candidate").withColumn("n", n).withColumn("few", F.array_contains(rotations(F.col("n"), F.lit(k)), F.col("order_idx").cast("int")))
    options = each.groupBy("candidate", "option").agg(
        F.avg("share").alias("all"), F.max(F.when(F.col("order_idx") == 0, F.col("share"))).alias("one"), F.avg(F.when(F.col("few"), F.col("share"))).alias("few"), (F.max("share") - F.min("share")).alias("move"))
    best = lambda c: F.min(F.struct((-F.round(c, 12)).alias("p"), "option"))["option"]
    moved = lambda c: F.max(F.when(F.col("option") == "none", F.abs(F.col(c) - F.col("all"))))
    per = options.groupBy("candidate").agg(best("all").alias("all"), best("one").alias("one"), best("few").alias("few"), F.max("move").alias("spread"), moved("one").alias("d_one"), moved("few").alias("d_few"))
    rate = lambda c, name: F.round(ratio(F.count_if(F.col(c) != F.col("all")), F.count("*")), 4).alias(name)
    mean = lambda c, name: F.round(F.avg(c), 4).alias(name)
    return per.agg(F.count("*").alias("n"), mean("spread", "mean_choice_spread"), rate("one", "argmax_flip_single_order"), rate("few", "argmax_flip_4_rotations"), mean("d_one", "mean_abs_dp_none_single"), mean("d_few", "mean_abs_dp_none_4_rot"))


def judge_summary(rows: DataFrame, direct: tuple[str, ...] = IDENTIFIERS) -> DataFrame:
    """One row from judged candidates of known truth (is_pii, label, category, decision, confidence, fast_path): counts, and the shares that are flagged,
    accepted, dropped and reviewed. A judgment without confidence has failed. category_acc_gold is over all gold."""
    flagged, gold = F.col("decision") != "not_identifier", F.col("is_pii")
    near = gold & F.coalesce(F.col("label").isin(*direct), F.lit(False))
    c = rows.agg(
        F.count("*").alias("n"), F.count_if(gold).alias("n_gold"), F.count_if(~gold).alias("n_decoy"), F.count_if(F.col("confidence").isNull()).alias("n_failed"), F.count_if(F.coalesce("fast_path", F.lit(False))).alias("n_fast"),
        F.count_if(gold & flagged).alias("kept"), F.count_if(near).alias("direct"), F.count_if(near & flagged).alias("direct_kept"), F.count_if(gold & (F.col("decision") == "identifier")).alias("right"),
        F.count_if(F.col("decision") == "identifier").alias("accepted"), F.count_if(flagged).alias("flagged"), F.count_if(~gold & ~flagged).alias("dropped"), F.count_if(F.col("decision") == "review").alias("reviews"),
        F.count_if(gold & (F.col("category") == F.col("label"))).alias("named"))
    rate = lambda a, b, name: F.round(ratio(F.col(a), F.col(b)), 4).alias(name)
    return c.select(
        "n", "n_gold", "n_decoy", "n_failed", "n_fast", rate("kept", "n_gold", "recall_flagged"), rate("direct_kept", "direct", "recall_flagged_direct"), rate("right", "n_gold", "recall_auto"), rate("right", "accepted", "precision_auto"),
        rate("kept", "flagged", "precision_flagged"), rate("dropped", "n_decoy", "decoy_dropped"), rate("reviews", "n", "review_rate"), rate("named", "n_gold", "category_acc_gold"))


def judge_labels(rows: DataFrame) -> DataFrame:
    """label, n, flagged, category_ok of the gold candidates."""
    return rows.where("is_pii").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("decision") != "not_identifier").alias("flagged"), F.count_if(F.col("category") == F.col("label")).alias("category_ok"))


def review_reasons(rows: DataFrame) -> DataFrame:
    """kind (gold or decoy, and the reasons joined), n of the reviews; a review without reasons is an error's."""
    listed = F.when(F.size(F.coalesce("reasons", F.array().cast("array<string>"))) > 0, F.array_join("reasons", "+")).otherwise("error")
    return rows.where("decision = 'review'").groupBy(F.concat(F.when(F.col("is_pii"), "gold:").otherwise("decoy:"), listed).alias("kind")).agg(F.count("*").alias("n"))


def context_accuracy(rows: DataFrame) -> DataFrame:
    """One row: how often the role of a date and the kind and type of a home were told right, from rows (is_pii, type, role, property, label, date_role,
    property_kind, property_type, judged). role (dob, death or another) and property are the truth, the next three what was told. A date that identifies no one has the role other; a type that was not told is unknown."""
    role = F.when(F.col("is_pii"), F.when(F.col("role") == "dob", "dob").when(F.col("role") == "death", "date_of_death")).when(F.col("type") == "date", "other")
    dated = F.col("judged") & role.isNotNull() & F.col("date_role").isNotNull()
    home = F.col("label").isin("address", "postal_code") & F.col("property").isNotNull()
    told = F.coalesce("property_type", F.lit("unknown"))
    kinds = F.create_map(*[F.lit(x) for kv in HOME_TYPE.items() for x in kv])
    c = rows.agg(
        F.count_if(dated).alias("date_role_n"), F.count_if(dated & (F.col("date_role") == role)).alias("roles"), F.count_if(home).alias("property_n"), F.count_if(home & (F.col("property_kind") == F.col("property"))).alias("kinds"),
        F.count_if(home & (told == F.try_element_at(kinds, F.col("property")))).alias("types"), F.count_if(home & (told == "unknown")).alias("unknown"))
    rate = lambda a, b, name: F.round(ratio(a, F.col(b)), 4).alias(name)
    return c.select(
        "date_role_n", rate(F.col("roles"), "date_role_n", "date_role_acc"), "property_n", rate(F.col("kinds"), "property_n", "property_kind_acc"), rate(F.col("types"), "property_n", "property_type_acc"),
        rate(F.col("unknown"), "property_n", "property_type_unknown"), rate(F.col("property_n") - F.col("types") - F.col("unknown"), "property_n", "property_type_wrong"))


# --- refitting a calibrator on what a run has judged, behind a guard ---

#: How far a confidence that was kept to four places may lie from its replay, and half a unit of a probability kept to six.
KEPT, HALF = 1.01e-4, 5e-7


def replay_check(judged: DataFrame, calibrator, drop_below: float, accept_at: float, category_at: float) -> DataFrame:
    """One row: rows, changed, at_edges of judged (category, sources, p_identifier, category_p, confidence, decision, fast_path and, if kept, prior). changed counts model judgments whose decision or
    confidence a replay under the same calibrator doesn't give again; at_edges those whose confidence only differs because the probability, kept to six places, lies at a step."""
    rows = judged.where(~F.coalesce("fast_path", F.lit(False)) & F.col("p_identifier").isNotNull())
    group, p = group_of(F.col("category"), F.col("sources")), F.col("p_identifier")
    at = lambda x: calibrator.column(x, group) if isinstance(calibrator, Grouped) else calibrator.column(x)
    steps = calibrator
    if isinstance(calibrator, Grouped):
        steps = Grouped({g: replace(c, places=None) if isinstance(c, Isotonic) else c for g, c in calibrator.maps.items()}, replace(calibrator.default, places=None) if isinstance(calibrator.default, Isotonic) else calibrator.default)
    elif isinstance(calibrator, Isotonic):
        steps = replace(calibrator, places=None)
    unrounded = lambda x: steps.column(x, group) if isinstance(steps, Grouped) else steps.column(x)
    prior = F.col("prior") if "prior" in judged.columns else F.lit(None)
    again = decide(at(p), F.col("category_p"), F.coalesce(prior.cast("array<string>"), F.array().cast("array<string>")), drop_below, accept_at, category_at)["decision"]
    near = lambda x: F.abs(F.col("confidence") - F.round(x, 4)) <= KEPT
    other = again != F.col("decision")
    moved = ~near(at(p))
    edge = near(unrounded(p - HALF)) | near(unrounded(p)) | near(unrounded(p + HALF))
    return rows.agg(F.count("*").alias("rows"), F.count_if(other | (moved & ~edge)).alias("changed"), F.count_if(~other & moved & edge).alias("at_edges"))


def refit(judged: DataFrame, gold: DataFrame, base, thresholds: tuple[float, float, float], kind: str = "isotonic", min_rows: int = 30, k: int = 5) -> tuple:
    """(calibrator, report) fitted by call on judged (doc, span_start, span_end, ...) against gold (doc, span_start, span_end, label). report has one row for each call and all: n, and
    the calibration error before, and after out of fold. Nothing is fitted, and an error is raised, if replaying base changes any row: then what was judged was not judged so."""
    check = replay_check(judged, base, *thresholds).first()
    if check.changed:
        raise ValueError(f"replaying the calibration changed {check.changed} of {check.rows} judgments")
    rows = judged_candidates(gold, judged).where("call <> 'fast_path'").select("doc", F.struct("span_start", "span_end").alias("seq"), F.col("p_identifier").alias("p"), F.col("correct").alias("y"), F.col("call").alias("group"), "confidence")
    dealt = folds(rows.withColumn("_order", F.struct("doc", "seq")), k, "doc", "_order")
    fitted = [fit_grouped(dealt.where(F.col("fold") != f), kind, min_rows).column(F.col("p"), F.col("group")) for f in range(k)]
    after = F.coalesce(*[F.when(F.col("fold") == f, q) for f, q in enumerate(fitted)])
    each = dealt.select(F.explode(F.array(F.lit("all"), "group")).alias("call"), "y", F.col("confidence").alias("before"), after.alias("after"))
    bins = lambda c: each.groupBy("call", F.least(F.floor(F.col(c) * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col(c) - outcome(F.col("y"))).alias("gap"))
    error = lambda c: bins(c).groupBy("call").agg(F.sum("n").alias("n"), F.round(F.sum(F.abs("gap")) / F.sum("n"), 4).alias(f"ece_{c}"))
    return fit_grouped(rows, kind, min_rows), error("before").join(error("after").drop("n"), "call")
