"""Detection and mask metrics: one sort and running sums in place of loops over thresholds, conditional sums in place of masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchmill.functions.tiers import TIERS
from patchmill.storage import running_sums, same_keys

INF = float("inf")


def score_counts(df: DataFrame, *keys: str, score: str = "logit", label: str = "label") -> DataFrame:
    """One row for each distinct score of a group: numbers of positives and negatives. All curves run over this."""
    return df.groupBy(*keys, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))


def auroc(df: DataFrame, *keys: str, score: str = "logit", label: str = "label", ties: str = "strict") -> DataFrame:
    """(keys, auc): share of positive-negative pairs in the right order; tied pairs count 0 (strict) or a half; NaN where a class is absent."""
    c = score_counts(df, *keys, score=score, label=label)
    c = running_sums(c, list(keys), F.col("score").asc(), {"upto": "n"}).withColumn("below", F.col("upto") - F.col("n"))
    won = F.col("p") * (F.col("below") + (F.col("n") * 0.5 if ties == "half" else F.lit(0.0)))
    a = c.groupBy(*keys).agg(F.sum(won).alias("w"), F.sum("p").alias("P"), F.sum("n").alias("N"))
    return a.select(*keys, F.when((F.col("P") > 0) & (F.col("N") > 0), F.try_divide("w", F.col("P").cast("double") * F.col("N"))).otherwise(F.lit(float("nan"))).alias("auc"))


def operating_points(df: DataFrame, *keys: str, score: str = "logit", label: str = "label") -> DataFrame:
    """(keys, score, at_pos, tp, fp, P, N): positives at each distinct score, counts at or above it, and totals."""
    c = score_counts(df, *keys, score=score, label=label)
    c = running_sums(c, list(keys), F.col("score").desc(), {"tp": "p", "fp": "n"}, {"pos": "p", "neg": "n"})
    return c.select(*keys, "score", F.col("p").alias("at_pos"), "tp", "fp", F.col("pos").alias("P"), F.col("neg").alias("N"))


def _auc_of(o: DataFrame, *keys: str) -> DataFrame:
    """(keys, auc) of operating points; tied pairs count 0."""
    a = o.groupBy(*keys).agg(F.sum(F.col("at_pos") * (F.col("N") - F.col("fp"))).alias("w"), F.max("P").alias("P"), F.max("N").alias("N"))
    return a.select(*keys, F.when((F.col("P") > 0) & (F.col("N") > 0), F.try_divide("w", F.col("P").cast("double") * F.col("N"))).otherwise(F.lit(float("nan"))).alias("auc"))


def best_threshold(df: DataFrame, *keys: str, score: str = "logit", label: str = "label") -> DataFrame:
    """(keys, opt_threshold, opt_bal_acc, opt_tpr, opt_tnr): the smallest score of greatest balanced accuracy above 0.5; else 0, 0.5, 0, 1."""
    return _best_of(operating_points(df, *keys, score=score, label=label), *keys)


def _best_of(o: DataFrame, *keys: str) -> DataFrame:
    tpr, tnr = F.coalesce(F.try_divide(F.col("tp").cast("double"), "P"), F.lit(0.0)), F.coalesce(1 - F.try_divide(F.col("fp").cast("double"), "N"), F.lit(0.0))
    o = o.withColumns({"tpr": tpr, "tnr": tnr}).withColumn("ba", (F.col("tpr") + F.col("tnr")) / 2)
    best = o.groupBy(*keys).agg(F.max_by(F.struct("score", "ba", "tpr", "tnr"), F.struct("ba", -F.col("score"))).alias("b"))
    ok = F.col("b.ba") > 0.5
    pick = lambda f, other: F.when(ok, F.col(f"b.{f}")).otherwise(F.lit(other))
    return best.select(*keys, pick("score", 0.0).alias("opt_threshold"), pick("ba", 0.5).alias("opt_bal_acc"), pick("tpr", 0.0).alias("opt_tpr"), pick("tnr", 1.0).alias("opt_tnr"))


def quantiles(df: DataFrame, keys: list[str] | tuple[str, ...], value: str | Column, names: dict[str, float]) -> DataFrame:
    """(keys, names...): exact quantiles of a value within keys, interpolated between neighbours; keys without a value are left out, NULL keys are a group.

    Values are counted and summed up in order by running sums, so a key with very many values is spread over tasks.
    """
    v = F.col(value) if isinstance(value, str) else value
    c = df.select(*keys, v.cast("double").alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    c = running_sums(c, list(keys), F.col("_v").asc(), {"_upto": "_n"}, {"_all": "_n"})
    at = lambda i: F.max(F.when((F.col("_upto") - F.col("_n") <= i) & (i < F.col("_upto")), F.col("_v")))
    out = []
    for n, q in names.items():
        h = F.lit(float(q)) * (F.col("_all") - 1)
        out += [at(F.floor(h)).alias(f"_a_{n}"), at(F.ceil(h)).alias(f"_b_{n}"), F.max(h - F.floor(h)).alias(f"_f_{n}")]
    g = c.groupBy(*keys).agg(*out)
    return g.select(*keys, *[F.when(F.col(f"_a_{n}") == F.col(f"_b_{n}"), F.col(f"_a_{n}")).otherwise(F.col(f"_a_{n}") * (1 - F.col(f"_f_{n}")) + F.col(f"_b_{n}") * F.col(f"_f_{n}")).alias(n) for n in names])


def threshold_at_tnr(df: DataFrame, tnr: float, *keys: str, score: str = "logit", label: str = "label") -> DataFrame:
    """(keys, threshold, tpr, tnr): the quantile of negatives that leaves a share tnr below, +inf without negatives, and the rates there."""
    t = quantiles(df.where(F.col(label) == 0), keys, score, {"threshold": tnr})
    x = same_keys(keys, df, t, "left").withColumn("threshold", F.coalesce("threshold", F.lit(INF)))
    hit = F.col(score) >= F.col("threshold")
    return x.groupBy(*keys).agg(F.first("threshold").alias("threshold"), F.avg(F.when(F.col(label) == 1, hit.cast("double"))).alias("tpr"), F.avg(F.when(F.col(label) == 0, (~hit).cast("double"))).alias("tnr"))


def condition_metrics(df: DataFrame, *keys: str, targets: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """(keys, n_total, n_pos, n_neg, auc, opt_threshold, bal_acc, f1, tpr, tnr, tpr_at_tnr_<xx>): what a condition is compared by.

    Ties count a half in the area; f1 is that of the threshold of best balanced accuracy. All but the counts are NULL where a class is
    absent.
    """
    n = df.groupBy(*keys).agg(F.count("*").alias("n_total"), F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"))
    r = same_keys(keys, same_keys(keys, n, auroc(df, *keys, ties="half")), best_threshold(df, *keys).withColumnsRenamed({"opt_bal_acc": "bal_acc", "opt_tpr": "tpr", "opt_tnr": "tnr"}))
    hits, alarms = F.col("tpr") * F.col("n_pos"), (1 - F.col("tnr")) * F.col("n_neg")
    r = r.withColumn("f1", F.try_divide(2 * hits, hits + alarms + F.col("n_pos")))
    for t in targets:
        name = f"tpr_at_tnr_{round(t * 100):02d}"
        r = same_keys(keys, r, threshold_at_tnr(df, t, *keys).select(*keys, F.col("tpr").alias(name)), "left")
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    rest = [c for c in r.columns if c not in (*keys, "n_total", "n_pos", "n_neg")]
    return r.select(*keys, "n_total", "n_pos", "n_neg", *[F.when(both, F.col(c)).alias(c) for c in rest])


def spread(df: DataFrame, keys: list[str], measures: dict[str, str | Column]) -> DataFrame:
    """(keys, measure, n, mean, median, std, p1 ... p99): the distribution of each measure within keys; NULL and NaN are left out."""
    m = F.array(*[F.struct(F.lit(n).alias("measure"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("v")) for n, c in measures.items()])
    x = df.select(*keys, F.explode(m).alias("m")).select(*keys, "m.measure", "m.v").where("v is not null and not isnan(v)")
    return x.groupBy(*keys, "measure").agg(*stats("v"))


def image_metrics(df: DataFrame, *keys: str, prob: float = 0.5) -> DataFrame:
    """Counts, AUC, rates at a probability threshold and at the best logit threshold. Scores are counted and sorted once for both curves."""
    up = F.col("logit") >= F.lit(_logit(prob))
    r = df.groupBy(*keys).agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col("label") == 1).alias("n_splice"),
        F.count_if(F.col("label") == 0).alias("n_real"),
        F.coalesce(F.avg(F.when(F.col("label") == 1, up.cast("double"))), F.lit(0.0)).alias("tpr"),
        F.coalesce(F.avg(F.when(F.col("label") == 0, (~up).cast("double"))), F.lit(0.0)).alias("tnr"),
    ).withColumn("bal_acc", (F.col("tpr") + F.col("tnr")) / 2)
    o = operating_points(df, *keys)
    return same_keys(keys, same_keys(keys, r, _auc_of(o, *keys)), _best_of(o, *keys))


def _logit(p: float) -> float:
    import math

    return math.log(p / (1 - p))


def tier_rates(df: DataFrame, thresholds: DataFrame, tier: Column, *keys: str) -> DataFrame:
    """(keys, tier, n, tpr): positives by tier at each key's threshold; tiers without positives are there with n 0 and rate 0."""
    dim = thresholds.select(*keys, "threshold", F.explode(F.array(*[F.lit(t) for t in TIERS])).alias("tier"))
    hit = df.where("label = 1").withColumn("tier", tier).join(thresholds.select(*keys, "threshold"), list(keys))
    g = hit.groupBy(*keys, "tier").agg(F.count("*").alias("n"), F.avg((F.col("logit") >= F.col("threshold")).cast("double")).alias("tpr"))
    return dim.join(g, [*keys, "tier"], "left").select(*keys, "tier", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("tpr", F.lit(0.0)).alias("tpr"))


def f1_sweep(df: DataFrame, *keys: str, score: str = "score", label: str = "label", steps: int = 100) -> DataFrame:
    """(keys, best_f1, best_threshold, auprc): the first of steps + 1 even thresholds on [0, 1] of greatest F1 (score >= threshold), 0 and 0.5 where none is above 0, and the area under precision over recall by trapezoids.

    Scores are counted by step first, so the sweep runs over at most steps + 2 rows a key. A NULL score reaches no threshold.
    """
    step = 1.0 / steps
    at = lambda k: F.when(k == steps, 1.0).otherwise(k * F.lit(step))
    s = F.col(score)
    b = F.greatest(F.lit(-1.0), F.least(F.lit(float(steps)), F.floor(s * steps).cast("double")))
    b = F.when(s.isNull() | F.isnan(s), -1.0).otherwise(b)
    b = F.when((b < steps) & (at(b + 1) <= s), b + 1).when((b >= 0) & (at(b) > s), b - 1).otherwise(b)
    c = df.groupBy(*keys, b.cast("int").alias("b")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    grid = df.select(*keys).distinct().withColumn("b", F.explode(F.sequence(F.lit(-1), F.lit(steps))))
    c = same_keys([*keys, "b"], grid, c, "left").na.fill(0, ["p", "n"])
    order = Window.partitionBy(*keys).orderBy(F.desc("b"))
    down = order.rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("n").over(down), "P": F.sum("p").over(Window.partitionBy(*keys))}).where("b >= 0")
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P")), F.lit(0.0))
    one = F.lit(1).cast("long")
    c = c.withColumns({"f1": f1, "prec": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one), "rec": F.col("tp") / F.greatest(F.col("P"), one)})
    # recall falls as the threshold rises, so this order is that of recall
    c = c.withColumn("part", (F.col("rec") - F.lag("rec").over(order)) * (F.col("prec") + F.lag("prec").over(order)) / 2)
    best = c.groupBy(*keys).agg(F.max_by(F.struct("b", "f1"), F.struct("f1", -F.col("b"))).alias("m"), F.coalesce(F.sum("part"), F.lit(0.0)).alias("auprc"))
    return best.select(*keys, F.col("m.f1").alias("best_f1"), F.when(F.col("m.f1") > 0, at(F.col("m.b"))).otherwise(0.5).alias("best_threshold"), "auprc")


def mean(c: Column) -> Column:
    """The mean of c, NULLs left out. Values that a decimal of 20 places holds are summed without rounding, so no order of rows moves a mean off its tie; else Spark's own."""
    d = c.try_cast("decimal(38,20)")
    kept = F.when(d.cast("double") == c, d)
    return F.coalesce(F.when(F.count(kept) == F.count(c), F.try_divide(F.try_sum(kept).cast("double"), F.count(c))), F.avg(c))


def stats(c: str | Column, prefix: str = "") -> list[Column]:
    """n, mean, median, population deviation and exact percentiles of c, NULLs left out."""
    c = F.col(c) if isinstance(c, str) else c
    q = [("p1", 0.01), ("p5", 0.05), ("p25", 0.25), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)]
    return [F.count(c).alias(f"{prefix}n"), mean(c).alias(f"{prefix}mean"), F.median(c).alias(f"{prefix}median"), F.stddev_pop(c).alias(f"{prefix}std"), *[F.percentile(c, F.lit(p)).alias(prefix + n) for n, p in q]]


def mask_metrics(df: DataFrame, *keys: str, pred: str = "pred", gt: str = "gt", empty: float | None = None) -> DataFrame:
    """f1, iou, precision, recall and shares of two boolean columns by key.

    Where both are empty f1 and iou are ``empty`` if given, else 0, as every ratio with an empty denominator is.
    """
    p, g = F.col(pred), F.col(gt)
    s = df.groupBy(*keys).agg(F.count_if(p & g).alias("tp"), F.count_if(p).alias("np"), F.count_if(g).alias("ng"), F.count("*").alias("n"), F.avg((p == g).cast("double")).alias("pixel_acc"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, np_, ng, n = (F.col(x) for x in ("tp", "np", "ng", "n"))
    f1, iou = div(2 * tp, np_ + ng), div(tp, np_ + ng - tp)
    if empty is not None:
        none = (np_ == 0) & (ng == 0)
        f1, iou = F.when(none, empty).otherwise(f1), F.when(none, empty).otherwise(iou)
    return s.select(*keys, f1.alias("f1"), iou.alias("iou"), div(tp, np_).alias("prec"), div(tp, ng).alias("rec"), div(np_, n).alias("pred_frac"), div(ng, n).alias("gt_frac"), "pixel_acc")


def oracle_polarity(df: DataFrame, *keys: str, lab: str = "pred", gt: str = "gt") -> DataFrame:
    """(keys, f1, iou, flipped): the labels or their complement, whichever has the better (f1, iou); the labels where equal."""
    a = mask_metrics(df, *keys, pred=lab, gt=gt).select(*keys, F.struct("f1", "iou").alias("a"))
    b = mask_metrics(df.withColumn(lab, ~F.col(lab)), *keys, pred=lab, gt=gt).select(*keys, F.struct("f1", "iou").alias("b"))
    x = a.join(b, list(keys)).withColumn("flipped", F.col("b") > F.col("a"))
    return x.select(*keys, F.when(F.col("flipped"), F.col("b.f1")).otherwise(F.col("a.f1")).alias("f1"), F.when(F.col("flipped"), F.col("b.iou")).otherwise(F.col("a.iou")).alias("iou"), "flipped")


def top2(df: DataFrame, *keys: str, value: str) -> DataFrame:
    """(keys, full, max, top2, mean, n): the first value by window index, and aggregates; top2 is the mean of the two largest."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value)))
    x = df.withColumn("_r", r)
    return x.groupBy(*keys).agg(F.max(value).alias("max_logit"), F.avg(F.when(F.col("_r") <= 2, F.col(value))).alias("top2_logit"), F.avg(value).alias("mean_logit"), F.count("*").alias("n_windows"))


def robustness_table(metrics: DataFrame, key: str, baseline: str | None = None, values: tuple[str, ...] = ("auc",)) -> DataFrame:
    """metrics, one row for each condition, with the difference of values to the baseline condition, the first by name where none is given."""
    if baseline is None:
        baseline = metrics.agg(F.min(key)).first()[0]
    base = metrics.where(F.col(key) == baseline).select(*[F.col(v).alias(f"_{v}") for v in values])
    x = metrics.join(F.broadcast(base), how="left") if base.limit(2).count() == 1 else metrics.withColumns({f"_{v}": F.lit(None).cast("double") for v in values})
    return x.withColumns({f"d_{v}": F.col(v) - F.col(f"_{v}") for v in values}).drop(*[f"_{v}" for v in values])
