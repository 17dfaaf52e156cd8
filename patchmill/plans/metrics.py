"""Queries: detection metrics, calibration, mask metrics, localization reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from patchmill.functions.tiers import area_bucket, area_tier, size_bucket
from patchmill.operators import calibrate as C
from patchmill.operators import metrics as A
from patchmill.plans.bindings import LOC, MASKS, PATCHES, SCORES, loc, masks, patches, scores, table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, digits: int = 6, keep: tuple = ()):
    """Doubles rounded, so that sums in another order compare equal; NaN as NULL."""
    return df.select(*[F.round(F.when(~F.isnan(c), F.col(c)), digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def _sql_rounded(select: str, columns: dict[str, bool]) -> str:
    return "SELECT " + ", ".join(f"round(CASE WHEN isnan({c}) THEN NULL ELSE {c} END, 6) AS {c}" if r else c for c, r in columns.items()) + f" FROM ({select})"


# running sums over distinct scores of each tag
_CURVE = f"""WITH {SCORES}, cn AS (SELECT tag, logit AS score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM sc GROUP BY 1, 2),
  op AS (SELECT tag, score, p, n, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER (PARTITION BY tag) AS pp, sum(n) OVER (PARTITION BY tag) AS nn,
    coalesce(sum(n) OVER (PARTITION BY tag ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM cn
    WINDOW d AS (PARTITION BY tag ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  ba AS (SELECT *, tp / CAST(pp AS DOUBLE) AS tpr, 1 - fp / CAST(nn AS DOUBLE) AS tnr, (tp / CAST(pp AS DOUBLE) + (1 - fp / CAST(nn AS DOUBLE))) / 2 AS ba FROM op),
  bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ba DESC, score) AS rk FROM ba) WHERE rk = 1),
  au AS (SELECT tag, sum(p * below) / (CAST(sum(p) AS DOUBLE) * sum(n)) AS auc, sum(p * (below + n * 0.5e0)) / (CAST(sum(p) AS DOUBLE) * sum(n)) AS auc_half FROM op GROUP BY tag)"""


@query(_CURVE + " SELECT tag, round(auc, 6) AS auc FROM au")
def agg_auroc(spark, d):
    return rounded(A.auroc(scores(spark, d), "tag"))


@query(_CURVE + " SELECT tag, round(auc_half, 6) AS auc FROM au")
def agg_auroc_ties_half(spark, d):
    """The trapezoid area under the curve is the one that gives tied pairs a half."""
    return rounded(A.auroc(scores(spark, d), "tag", ties="half"))


@query(_CURVE + " SELECT tag, CASE WHEN ba > 0.5 THEN score ELSE 0 END AS opt_threshold, round(greatest(ba, 0.5e0), 6) AS opt_bal_acc, round(CASE WHEN ba > 0.5 THEN tpr ELSE 0 END, 6) AS opt_tpr, round(CASE WHEN ba > 0.5 THEN tnr ELSE 1 END, 6) AS opt_tnr FROM bt")
def cal_best_threshold(spark, d):
    return rounded(A.best_threshold(scores(spark, d), "tag"), keep=("opt_threshold",))


@query(_CURVE + """, m AS (SELECT tag, count(*) AS n_total, count(*) FILTER (label = 1) AS n_splice, count(*) FILTER (label = 0) AS n_real,
    avg(CASE WHEN label = 1 THEN CAST(logit >= 0 AS INT) END) AS tpr, avg(CASE WHEN label = 0 THEN CAST(logit < 0 AS INT) END) AS tnr FROM sc GROUP BY tag)
  SELECT tag, n_total, n_splice, n_real, round(m.tpr, 6) AS tpr, round(m.tnr, 6) AS tnr, round((m.tpr + m.tnr) / 2, 6) AS bal_acc, round(auc, 6) AS auc,
    round(CASE WHEN ba > 0.5 THEN score ELSE 0 END, 6) AS opt_threshold, round(greatest(ba, 0.5e0), 6) AS opt_bal_acc, round(CASE WHEN ba > 0.5 THEN bt.tpr ELSE 0 END, 6) AS opt_tpr, round(CASE WHEN ba > 0.5 THEN bt.tnr ELSE 1 END, 6) AS opt_tnr
  FROM m JOIN au USING (tag) JOIN bt USING (tag)""")
def agg_image_bce_metrics(spark, d):
    return rounded(A.image_metrics(scores(spark, d), "tag"))


_TNR = """, th AS (SELECT tag, quantile_cont(logit, {q}) FILTER (label = 0) AS threshold FROM sc GROUP BY tag)"""


@query("WITH " + SCORES + _TNR.format(q="0.95") + """ SELECT tag, round(any_value(threshold), 6) AS threshold, round(avg(CASE WHEN label = 1 THEN CAST(logit >= threshold AS INT) END), 6) AS tpr,
  round(avg(CASE WHEN label = 0 THEN CAST(logit < threshold AS INT) END), 6) AS tnr FROM sc JOIN th USING (tag) GROUP BY tag""")
def cal_threshold_at_tnr95(spark, d):
    return rounded(A.threshold_at_tnr(scores(spark, d), 0.95, "tag"))


@query("WITH " + SCORES + _TNR.format(q="0.99") + """ SELECT tag, round(any_value(threshold), 6) AS threshold, round(avg(CASE WHEN label = 1 THEN CAST(logit >= threshold AS INT) END), 6) AS tpr,
  round(avg(CASE WHEN label = 0 THEN CAST(logit < threshold AS INT) END), 6) AS tnr FROM sc JOIN th USING (tag) GROUP BY tag""")
def cal_threshold_at_tnr99(spark, d):
    return rounded(A.threshold_at_tnr(scores(spark, d), 0.99, "tag"))


@query("WITH " + SCORES + _TNR.format(q="0.95") + """, ti AS (SELECT unnest(['tiny', 'small', 'medium', 'large']) AS tier),
  x AS (SELECT tag, CASE WHEN area <= 0.05 THEN 'tiny' WHEN area < 0.15 THEN 'small' WHEN area < 0.30 THEN 'medium' ELSE 'large' END AS tier, CAST(logit >= threshold AS INT) AS hit FROM sc JOIN th USING (tag) WHERE label = 1)
  SELECT th.tag, ti.tier, count(hit) AS n, round(coalesce(avg(hit), 0), 6) AS tpr FROM th CROSS JOIN ti LEFT JOIN x ON x.tag = th.tag AND x.tier = ti.tier GROUP BY 1, 2""")
def agg_tier_rates(spark, d):
    s = scores(spark, d)
    t = A.threshold_at_tnr(s, 0.95, "tag").select("tag", "threshold")
    return rounded(A.tier_rates(s, t, area_tier("area"), "tag"))


@query("WITH " + SCORES + """, b AS (SELECT unnest(['small', 'medium', 'large']) AS bucket),
  x AS (SELECT tag, bucket, label, logit FROM sc CROSS JOIN b WHERE label = 0 UNION ALL SELECT tag, CASE WHEN area < 0.15 THEN 'small' WHEN area < 0.30 THEN 'medium' ELSE 'large' END, label, logit FROM sc WHERE label = 1),
  c AS (SELECT tag, bucket, logit, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM x GROUP BY 1, 2, 3),
  w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY tag, bucket ORDER BY logit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
  SELECT tag, bucket, round(sum(p * below) / (CAST(sum(p) AS DOUBLE) * sum(n)), 6) AS auc FROM w GROUP BY 1, 2""")
def agg_auroc_by_bucket(spark, d):
    """AUC of each size bucket's positives against all negatives."""
    s = scores(spark, d)
    b = s.where("label = 0").withColumn("bucket", F.explode(F.array(*[F.lit(x) for x in ("small", "medium", "large")])))
    return rounded(A.auroc(b.unionByName(s.where("label = 1").withColumn("bucket", size_bucket("area"))), "tag", "bucket"))


@query("WITH " + SCORES + """, g AS (SELECT k, CASE WHEN k = 100 THEN 1.0e0 ELSE k * 0.01e0 END AS t FROM (SELECT unnest(range(0, 101)) AS k)), x AS (SELECT tag, label, 1 / (1 + exp(-logit)) AS s FROM sc),
  c AS (SELECT tag, k, t, count(*) FILTER (label = 1 AND s >= t) AS tp, count(*) FILTER (s >= t) AS np, count(*) FILTER (label = 1) AS ng FROM x CROSS JOIN g GROUP BY 1, 2, 3),
  f AS (SELECT *, CASE WHEN np + ng = 0 THEN 0 ELSE 2.0e0 * tp / (np + ng) END AS f1, tp / CAST(greatest(np, 1) AS DOUBLE) AS prec, tp / CAST(greatest(ng, 1) AS DOUBLE) AS rec FROM c),
  a AS (SELECT tag, sum(part) AS auprc FROM (SELECT tag, (rec - lag(rec) OVER w) * (prec + lag(prec) OVER w) / 2 AS part FROM f WINDOW w AS (PARTITION BY tag ORDER BY k DESC)) GROUP BY tag)
  SELECT tag, round(f1, 6) AS best_f1, round(CASE WHEN f1 > 0 THEN t ELSE 0.5 END, 6) AS best_threshold, round(auprc, 6) AS auprc FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY f1 DESC, k) AS rk FROM f) JOIN a USING (tag) WHERE rk = 1""")
def cal_f1_sweep(spark, d):
    s = scores(spark, d).withColumn("score", 1 / (1 + F.exp(-F.col("logit"))))
    return rounded(A.f1_sweep(s, "tag"))


_WIN = "WITH wi AS (SELECT user_id AS image_id, event_id AS window_idx, (value - 50) / 25.0e0 AS logit FROM events WHERE value IS NOT NULL)"


def _windows(spark, d):
    return table(spark, d, "events").where("value is not null").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("window_idx"), ((F.col("value") - 50) / 25).alias("logit"))


@query(_WIN + """, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY logit DESC) AS rk FROM wi)
  SELECT image_id, round(max(logit), 6) AS max_logit, round(avg(logit) FILTER (rk <= 2), 6) AS top2_logit, round(avg(logit), 6) AS mean_logit, count(*) AS n_windows FROM r GROUP BY image_id""")
def agg_window_logits(spark, d):
    return rounded(A.top2(_windows(spark, d), "image_id", value="logit"))


_U = _WIN + """, r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY logit DESC) AS rk, row_number() OVER (PARTITION BY image_id ORDER BY window_idx) AS fr FROM wi),
  a AS (SELECT image_id, CASE WHEN image_id % 3 = 0 THEN 0 ELSE 1 END AS label, (image_id % 40) / 100.0e0 AS area, max(logit) FILTER (fr = 1) AS full_logit, max(logit) AS max_logit, avg(logit) FILTER (rk <= 2) AS top2_logit FROM r GROUP BY 1),
  u AS (SELECT 'full' AS method, label, area, full_logit AS v FROM a UNION ALL SELECT 'max', label, area, max_logit FROM a UNION ALL SELECT 'top2', label, area, top2_logit FROM a),
  cn AS (SELECT method, v, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM u GROUP BY 1, 2),
  op AS (SELECT *, sum(p) OVER d AS tp, sum(n) OVER d AS fp, sum(p) OVER (PARTITION BY method) AS pp, sum(n) OVER (PARTITION BY method) AS nn FROM cn WINDOW d AS (PARTITION BY method ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  au AS (SELECT method, sum(p * (nn - fp + n * 0.5e0)) / (CAST(max(pp) AS DOUBLE) * max(nn)) AS auc FROM op GROUP BY 1),
  bt AS (SELECT * FROM (SELECT *, tp / CAST(pp AS DOUBLE) AS tpr, 1 - fp / CAST(nn AS DOUBLE) AS tnr, row_number() OVER (PARTITION BY method ORDER BY (tp / CAST(pp AS DOUBLE) + (1 - fp / CAST(nn AS DOUBLE))) / 2 DESC, v) AS rk FROM op) WHERE rk = 1),
  t AS (SELECT method, quantile_cont(v, 0.95) FILTER (label = 0) AS t95, quantile_cont(v, 0.99) FILTER (label = 0) AS t99 FROM u GROUP BY 1)"""


def _window_scores(spark, d):
    """(method, label, area, logit): each image's score by its full view, its best window and its two best windows."""
    w = _windows(spark, d)
    first = w.groupBy("image_id").agg(F.min_by("logit", "window_idx").alias("full_logit"))
    x = A.top2(w, "image_id", value="logit").join(first, "image_id").withColumns({"label": F.when(F.col("image_id") % 3 == 0, 0).otherwise(1), "area": F.col("image_id") % 40 / 100})
    u = x.unpivot(["label", "area"], ["full_logit", "max_logit", "top2_logit"], "method", "logit")
    return u.withColumn("method", F.regexp_replace("method", "_logit", ""))


@query(_U + """, m AS (SELECT method, count(*) AS n_total, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, avg(CAST(v >= t95 AS INT)) FILTER (label = 1) AS tpr_at_tnr_95, avg(CAST(v >= t99 AS INT)) FILTER (label = 1) AS tpr_at_tnr_99 FROM u JOIN t USING (method) GROUP BY 1),
  x AS (SELECT m.*, auc, v AS opt_threshold, (tpr + tnr) / 2 AS bal_acc, 2 * tpr * n_pos / (tpr * n_pos + (1 - tnr) * n_neg + n_pos) AS f1, tpr, tnr FROM m JOIN au USING (method) JOIN bt USING (method)), b AS (SELECT * FROM x WHERE method = 'full')
  SELECT x.method, x.n_total, x.n_pos, x.n_neg, round(x.auc, 6) AS auc, round(x.opt_threshold, 6) AS opt_threshold, round(x.bal_acc, 6) AS bal_acc, round(x.f1, 6) AS f1, round(x.tpr, 6) AS tpr, round(x.tnr, 6) AS tnr, round(x.tpr_at_tnr_95, 6) AS tpr_at_tnr_95,
    round(x.tpr_at_tnr_99, 6) AS tpr_at_tnr_99, round(x.auc - b.auc, 6) AS d_auc, round(x.bal_acc - b.bal_acc, 6) AS d_bal_acc, round(x.tpr_at_tnr_95 - b.tpr_at_tnr_95, 6) AS d_tpr_at_tnr_95, round(x.tpr_at_tnr_99 - b.tpr_at_tnr_99, 6) AS d_tpr_at_tnr_99 FROM x CROSS JOIN b""")
def agg_sliding_window_report(spark, d):
    m = A.condition_metrics(_window_scores(spark, d), "method")
    return rounded(A.robustness_table(m, "method", "full", ("auc", "bal_acc", "tpr_at_tnr_95", "tpr_at_tnr_99")))


@query(_U + """ SELECT u.method, CASE WHEN area <= 0.05 THEN 'tiny' WHEN area < 0.15 THEN 'small' WHEN area < 0.30 THEN 'medium' ELSE 'large' END AS tier, count(*) AS n, round(avg(CAST(u.v >= bt.v AS INT)), 6) AS tpr FROM u JOIN bt USING (method) WHERE label = 1 GROUP BY 1, 2""")
def agg_sliding_window_tiers(spark, d):
    """Rates by size tier, each method at its own best threshold."""
    u = _window_scores(spark, d)
    t = A.best_threshold(u, "method").select("method", F.col("opt_threshold").alias("threshold"))
    return rounded(A.tier_rates(u, t, area_tier("area"), "method").where("n > 0"))


@query(_U + """, q AS (SELECT method, median(v) FILTER (label = 0) AS real_med, quantile_cont(v, 0.95) FILTER (label = 0) AS real_p95, quantile_cont(v, 0.99) FILTER (label = 0) AS real_p99, median(v) FILTER (label = 1) AS splice_med, quantile_cont(v, 0.05) FILTER (label = 1) AS splice_p5 FROM u GROUP BY 1), b AS (SELECT * FROM q WHERE method = 'full')
  SELECT q.method, round(q.real_med, 6) AS real_med, round(q.real_p95, 6) AS real_p95, round(q.real_p99, 6) AS real_p99, round(q.splice_med, 6) AS splice_med, round(q.splice_p5, 6) AS splice_p5, round(q.real_med - b.real_med, 6) AS d_real_med, round(q.splice_med - b.splice_med, 6) AS d_splice_med FROM q CROSS JOIN b""")
def agg_sliding_window_risk(spark, d):
    """How far scores of reals and of splices move from the full view to windows."""
    u = _window_scores(spark, d)
    r = A.quantiles(u.where("label = 0"), ["method"], "logit", {"real_med": 0.5, "real_p95": 0.95, "real_p99": 0.99}).join(A.quantiles(u.where("label = 1"), ["method"], "logit", {"splice_med": 0.5, "splice_p5": 0.05}), "method")
    return rounded(A.robustness_table(r, "method", "full", ("real_med", "splice_med")))


@query(_CURVE + """, n AS (SELECT tag, count(*) AS n_total, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, quantile_cont(logit, 0.95) FILTER (label = 0) AS t95, quantile_cont(logit, 0.99) FILTER (label = 0) AS t99 FROM sc GROUP BY tag),
  r AS (SELECT sc.tag, avg(CAST(logit >= t95 AS INT)) FILTER (label = 1) AS tpr_at_tnr_95, avg(CAST(logit >= t99 AS INT)) FILTER (label = 1) AS tpr_at_tnr_99 FROM sc JOIN n USING (tag) GROUP BY 1),
  x AS (SELECT n.tag, n_total, n_pos, n_neg, auc_half AS auc, CASE WHEN ba > 0.5 THEN score ELSE 0 END AS opt_threshold, greatest(ba, 0.5e0) AS bal_acc, CASE WHEN ba > 0.5 THEN bt.tpr ELSE 0 END AS tpr, CASE WHEN ba > 0.5 THEN bt.tnr ELSE 1 END AS tnr, tpr_at_tnr_95, tpr_at_tnr_99
    FROM n JOIN au USING (tag) JOIN bt USING (tag) JOIN r USING (tag)), y AS (SELECT *, 2 * tpr * n_pos / (tpr * n_pos + (1 - tnr) * n_neg + n_pos) AS f1 FROM x), b AS (SELECT * FROM y WHERE tag = (SELECT min(tag) FROM y))
  SELECT y.tag, y.n_total, y.n_pos, y.n_neg, round(y.auc, 6) AS auc, round(y.opt_threshold, 6) AS opt_threshold, round(y.bal_acc, 6) AS bal_acc, round(y.tpr, 6) AS tpr, round(y.tnr, 6) AS tnr, round(y.f1, 6) AS f1, round(y.tpr_at_tnr_95, 6) AS tpr_at_tnr_95, round(y.tpr_at_tnr_99, 6) AS tpr_at_tnr_99,
    round(y.auc - b.auc, 6) AS d_auc, round(y.bal_acc - b.bal_acc, 6) AS d_bal_acc, round(y.f1 - b.f1, 6) AS d_f1 FROM y CROSS JOIN b""")
def agg_robustness(spark, d):
    """Metrics of each condition against a baseline condition, the first tag by name."""
    return rounded(A.robustness_table(A.condition_metrics(scores(spark, d), "tag"), "tag", None, ("auc", "bal_acc", "f1")))


_MM = f"""WITH {MASKS}, s AS (SELECT image_id, count(*) FILTER (pred AND gt) AS tp, count(*) FILTER (pred) AS np, count(*) FILTER (gt) AS ng, count(*) AS n, avg(CAST(pred = gt AS INT)) AS acc FROM ma GROUP BY 1)"""


@query(_MM + """ SELECT image_id, round(CASE WHEN np + ng = 0 THEN 1 ELSE 2.0e0 * tp / (np + ng) END, 6) AS f1, round(CASE WHEN np + ng = 0 THEN 1 ELSE tp / CAST(np + ng - tp AS DOUBLE) END, 6) AS iou,
  round(CASE WHEN np = 0 THEN 0 ELSE tp / CAST(np AS DOUBLE) END, 6) AS prec, round(CASE WHEN ng = 0 THEN 0 ELSE tp / CAST(ng AS DOUBLE) END, 6) AS rec, round(np / CAST(n AS DOUBLE), 6) AS pred_frac, round(ng / CAST(n AS DOUBLE), 6) AS gt_frac, round(acc, 6) AS pixel_acc FROM s""")
def agg_mask_metrics(spark, d):
    return rounded(A.mask_metrics(masks(spark, d), "image_id", empty=1.0))


@query(f"""WITH {MASKS}, s AS (SELECT image_id, count(*) FILTER (pred AND gt) AS a, count(*) FILTER (pred) AS p, count(*) FILTER (gt) AS g, count(*) FILTER (NOT pred AND gt) AS b, count(*) FILTER (NOT pred) AS q FROM ma GROUP BY 1),
  v AS (SELECT image_id, CASE WHEN p + g = 0 THEN 0 ELSE 2.0e0 * a / (p + g) END AS fa, CASE WHEN p + g - a = 0 THEN 0 ELSE a / CAST(p + g - a AS DOUBLE) END AS ia,
    CASE WHEN q + g = 0 THEN 0 ELSE 2.0e0 * b / (q + g) END AS fb, CASE WHEN q + g - b = 0 THEN 0 ELSE b / CAST(q + g - b AS DOUBLE) END AS ib FROM s)
  SELECT image_id, round(CASE WHEN fb > fa OR (fb = fa AND ib > ia) THEN fb ELSE fa END, 6) AS f1, round(CASE WHEN fb > fa OR (fb = fa AND ib > ia) THEN ib ELSE ia END, 6) AS iou, (fb > fa OR (fb = fa AND ib > ia)) AS flipped FROM v""")
def agg_oracle_polarity(spark, d):
    return rounded(A.oracle_polarity(masks(spark, d), "image_id"))


_STATS = "count({c}) AS n, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, round(stddev_pop({c}), 6) AS std, " + ", ".join(f"round(quantile_cont({{c}}, {p}), 6) AS {n}" for n, p in (("p1", 0.01), ("p5", 0.05), ("p25", 0.25), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)))


@query(f"WITH {LOC} SELECT tag, {_STATS.format(c='iou_full')} FROM lo WHERE iou_full IS NOT NULL AND NOT isnan(iou_full) GROUP BY tag")
def agg_stats(spark, d):
    x = loc(spark, d).where("iou_full is not null and not isnan(iou_full)")
    return rounded(x.groupBy("tag").agg(*A.stats("iou_full")))


def _spread_sql(source: str, keys: str, measures: dict[str, str]) -> str:
    """SQL of spread over rows of source."""
    e = ", ".join(f"{{'m': '{n}', 'v': CAST({c} AS DOUBLE)}}" for n, c in measures.items())
    return f"SELECT {keys}, e.m AS measure, {_STATS.format(c='e.v')} FROM (SELECT {keys}, unnest([{e}]) AS e FROM {source}) WHERE e.v IS NOT NULL AND NOT isnan(e.v) GROUP BY ALL"


_MEASURES = ("f1", "iou", "prec", "rec", "pred_frac")
_GRID = (-2.0, -1.0, 0.0, 1.0, 2.0)
_OPT = 0.4
_FIN = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
_GATES = f"""WITH {LOC}, g AS (SELECT 'no_gate' AS gate, CAST(NULL AS DOUBLE) AS thr UNION ALL SELECT unnest({[f"{t:+.1f}" for t in _GRID]}), unnest({list(_GRID)}) UNION ALL SELECT 'opt', {_OPT}),
  m AS ({" UNION ALL ".join(f"SELECT bucket, bce_logit, '{k}' AS method, {', '.join(f'{c}_{k} AS {c}' for c in _MEASURES)}, {'swin_n_pass' if k == 'swin' else 'NULL'} AS swin_n_pass, {'CAST(swin_n_boundary > 0 AS INT)' if k == 'swin' else 'NULL'} AS swin_boundary FROM lo WHERE isfinite(f1_{k})" for k in ("full", "gap", "swin"))}),
  v AS (SELECT method, gate, bucket, thr IS NULL OR bce_logit IS NULL OR bce_logit >= thr AS pass, {", ".join(_MEASURES)}, swin_n_pass, swin_boundary FROM m CROSS JOIN g),
  w AS (SELECT method, gate, bucket, pass, {", ".join(f"CASE WHEN pass THEN {c} ELSE 0 END AS {c}" for c in _MEASURES)}, CASE WHEN pass THEN swin_n_pass WHEN method = 'swin' THEN 0 END AS swin_n_pass, CASE WHEN pass THEN swin_boundary WHEN method = 'swin' THEN 0 END AS swin_boundary FROM v)"""


@query(_GATES + " " + _spread_sql("w", "method, gate, bucket", {c: c for c in (*_MEASURES, "swin_n_pass", "swin_boundary")}))
def agg_threshold_sweep_report(spark, d):
    """method x gate (none, fixed thresholds, the calibrated one) x bucket x measure; rows gated out give 0, rows without a logit pass."""
    x = _gated(spark, d)
    return rounded(A.spread(x, ["method", "gate", "bucket"], {c: c for c in (*_MEASURES, "swin_n_pass", "swin_boundary")}))


@query(_GATES + " SELECT method, gate, bucket, count(*) AS n_total, count(*) FILTER (pass) AS n_pass FROM w GROUP BY 1, 2, 3")
def agg_threshold_sweep_counts(spark, d):
    return _gated(spark, d).groupBy("method", "gate", "bucket").agg(F.count("*").alias("n_total"), F.count_if("pass").alias("n_pass"))


def _gated(spark, d):
    swin = {"swin_n_pass": F.col("swin_n_pass").cast("double"), "swin_boundary": (F.col("swin_n_boundary") > 0).cast("double")}
    of = lambda k: F.struct(F.lit(k).alias("method"), _FIN(f"f1_{k}").alias("ok"), *[F.col(f"{c}_{k}").alias(c) for c in _MEASURES], *[(v if k == "swin" else F.lit(None).cast("double")).alias(n) for n, v in swin.items()])
    x = loc(spark, d).select("bucket", "bce_logit", F.explode(F.array(of("full"), of("gap"), of("swin"))).alias("m")).where("m.ok").select("bucket", "bce_logit", "m.*")
    gates = [("no_gate", None), *[(f"{t:+.1f}", t) for t in _GRID], ("opt", _OPT)]
    x = x.withColumn("g", F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.lit(t).cast("double").alias("thr")) for n, t in gates]))).select("*", "g.*")
    x = x.withColumn("pass", F.col("thr").isNull() | F.col("bce_logit").isNull() | (F.col("bce_logit") >= F.col("thr")))
    return x.withColumns({c: F.when(F.col("pass"), F.col(c)).otherwise(0.0) for c in _MEASURES} | {c: F.when(F.col("pass"), F.col(c)).when(F.col("method") == "swin", 0.0) for c in swin})


_PX = {f"{c}_px": f"{c}_full_px" for c in ("f1", "iou", "prec", "rec")}
_SHAPE = {c: c for c in ("pos_coh", "bg_coh", "cent_sep", "out_gap", "frac_outliers_mad", "frac_outliers_03", "frac_outliers_05", "sil_k2", "sil_k3", "sil_k4")}


@query(f"WITH {LOC} " + _spread_sql("lo WHERE isfinite(f1_full_px)", "bucket", _PX))
def agg_pixel_summary(spark, d):
    """Mask metrics at the size of pixels, without a gate, by bucket."""
    return rounded(A.spread(loc(spark, d).where(_FIN("f1_full_px")), ["bucket"], _PX))


@query(f"WITH {LOC} " + _spread_sql("lo", "bucket", _SHAPE))
def agg_representation(spark, d):
    """How embeddings of regions hold together and stand apart, by bucket."""
    return rounded(A.spread(loc(spark, d), ["bucket"], _SHAPE))


@query(f"""WITH {LOC}, b AS (SELECT unnest(['small', 'medium', 'large']) AS bucket), t AS (SELECT DISTINCT tag FROM lo)
  SELECT t.tag, b.bucket, count(sample_id) AS n, round(median(f1_full), 6) AS f1_med, round(median(iou_full), 6) AS iou_med, round(median(f1_full_px), 6) AS f1_px_med, round(median(iou_full_px), 6) AS iou_px_med
  FROM t CROSS JOIN b LEFT JOIN (SELECT * REPLACE (CASE WHEN isnan(f1_full) THEN NULL ELSE f1_full END AS f1_full, CASE WHEN isnan(iou_full) THEN NULL ELSE iou_full END AS iou_full, CASE WHEN isnan(f1_full_px) THEN NULL ELSE f1_full_px END AS f1_full_px, CASE WHEN isnan(iou_full_px) THEN NULL ELSE iou_full_px END AS iou_full_px) FROM lo) l
    ON l.tag IS NOT DISTINCT FROM t.tag AND l.bucket = b.bucket GROUP BY 1, 2""")
def agg_summarize_localization(spark, d):
    """Medians by tag and bucket; buckets without samples are there with n 0."""
    x = loc(spark, d)
    clean = {c: F.when(~F.isnan(c), F.col(c)) for c in ("f1_full", "iou_full", "f1_full_px", "iou_full_px")}
    dim = x.select("tag").distinct().withColumn("bucket", F.explode(F.array(*[F.lit(s) for s in ("small", "medium", "large")])))
    g = x.withColumns(clean).groupBy("tag", "bucket").agg(F.count("*").alias("n"), F.median("f1_full").alias("f1_med"), F.median("iou_full").alias("iou_med"), F.median("f1_full_px").alias("f1_px_med"), F.median("iou_full_px").alias("iou_px_med"))
    y = dim.alias("a").join(g.alias("g"), F.col("a.tag").eqNullSafe(F.col("g.tag")) & (F.col("a.bucket") == F.col("g.bucket")), "left")
    return rounded(y.select("a.tag", "a.bucket", F.coalesce("n", F.lit(0)).alias("n"), "f1_med", "iou_med", "f1_px_med", "iou_px_med"))


_SP = "kind IN ('imdsplice', 'casiasplice', 'aesplice') AND bce_logit IS NOT NULL AND isfinite(iou_full)"
_RE = "kind IN ('imdreal', 'indoorreal', 'casiareal') AND bce_logit IS NOT NULL"


@query(f"""WITH {LOC}, t AS (SELECT tag, quantile_cont(bce_logit, 0.95) AS t, list(bce_logit) AS ls FROM lo WHERE {_RE} GROUP BY tag), fp AS (SELECT lo.tag, count(*) FILTER (bce_logit >= t) AS n_fp FROM lo JOIN t USING (tag) WHERE {_RE} GROUP BY lo.tag),
  s AS (SELECT lo.tag, bucket, CASE WHEN bce_logit >= t THEN iou_full ELSE 0 END AS iou, bce_logit >= t AS hit FROM lo JOIN t USING (tag) WHERE {_SP}),
  z AS (SELECT tag, 'ALL+FP' AS bucket, iou, hit FROM s UNION ALL SELECT tag, bucket, iou, hit FROM s UNION ALL SELECT tag, 'ALL+FP', 0, false FROM fp, range(0, n_fp))
  SELECT tag, bucket, count(*) AS n, count(*) FILTER (hit) AS detected, round(median(iou), 6) AS iou_med, round(avg(iou), 6) AS iou_mean FROM z GROUP BY 1, 2""")
def agg_grounded_localization(spark, d):
    """Localization at the detector's 95 % specificity: misses give 0, false alarms give rows of 0 in ALL+FP."""
    x = loc(spark, d).where("bce_logit is not null")
    real = x.where(F.col("kind").isin("imdreal", "indoorreal", "casiareal"))
    t = real.groupBy("tag").agg(F.percentile("bce_logit", F.lit(0.95)).alias("t"))
    fp = real.join(t, "tag").where("bce_logit >= t").select("tag", F.lit("ALL+FP").alias("bucket"), F.lit(0.0).alias("iou"), F.lit(False).alias("hit"))
    s = x.where(F.col("kind").isin("imdsplice", "casiasplice", "aesplice") & F.col("iou_full").isNotNull() & ~F.isnan("iou_full")).join(t, "tag")
    s = s.select("tag", "bucket", F.when(F.col("bce_logit") >= F.col("t"), F.col("iou_full")).otherwise(0.0).alias("iou"), (F.col("bce_logit") >= F.col("t")).alias("hit"))
    z = s.withColumn("bucket", F.explode(F.array("bucket", F.lit("ALL+FP")))).unionByName(fp)
    return rounded(z.groupBy("tag", "bucket").agg(F.count("*").alias("n"), F.count_if("hit").alias("detected"), F.median("iou").alias("iou_med"), F.avg("iou").alias("iou_mean")))


_DEP = "isfinite(iou_full) AND isfinite(iou_full_deployed)"


@query(f"""WITH {LOC} SELECT bucket, count(*) AS n, round(median(iou_full), 6) AS oracle_med, round(median(iou_full_deployed), 6) AS deployed_med, round(median(iou_full - iou_full_deployed), 6) AS tax_med,
  round(avg(iou_full - iou_full_deployed), 6) AS tax_mean, round(avg(CASE WHEN polarity_agree THEN 1 ELSE 0 END), 6) AS agree_rate FROM lo WHERE {_DEP} GROUP BY bucket""")
def agg_oracle_tax(spark, d):
    x = loc(spark, d).where("iou_full is not null and not isnan(iou_full) and iou_full_deployed is not null and not isnan(iou_full_deployed)").withColumn("tax", F.col("iou_full") - F.col("iou_full_deployed"))
    return rounded(x.groupBy("bucket").agg(F.count("*").alias("n"), F.median("iou_full").alias("oracle_med"), F.median("iou_full_deployed").alias("deployed_med"), F.median("tax").alias("tax_med"), F.avg("tax").alias("tax_mean"), F.avg(F.when(F.col("polarity_agree"), 1.0).otherwise(0.0)).alias("agree_rate")))


@query(f"""WITH {LOC}, s AS (SELECT tag, bucket, bce_logit, iou_full FROM lo WHERE bce_logit IS NOT NULL AND isfinite(iou_full)), c AS (SELECT tag, coalesce(median(bce_logit) FILTER (bce_logit >= 0), 0) AS cut FROM s GROUP BY tag)
  SELECT bucket, CASE WHEN bce_logit < 0 THEN 'missed' WHEN bce_logit >= cut THEN 'confident' ELSE 'less' END AS tier, count(*) AS n, round(median(iou_full), 6) AS iou_med, round(quantile_cont(iou_full, 0.25), 6) AS iou_p25, round(avg(iou_full), 6) AS iou_mean
  FROM s JOIN c USING (tag) GROUP BY 1, 2""")
def agg_loc_by_confidence(spark, d):
    x = loc(spark, d).where("bce_logit is not null and iou_full is not null and not isnan(iou_full)")
    cut = x.groupBy("tag").agg(F.coalesce(F.median(F.when(F.col("bce_logit") >= 0, F.col("bce_logit"))), F.lit(0.0)).alias("cut"))
    tier = F.when(F.col("bce_logit") < 0, "missed").when(F.col("bce_logit") >= F.col("cut"), "confident").otherwise("less")
    return rounded(x.join(cut, "tag").groupBy("bucket", tier.alias("tier")).agg(F.count("*").alias("n"), F.median("iou_full").alias("iou_med"), F.percentile("iou_full", F.lit(0.25)).alias("iou_p25"), F.avg("iou_full").alias("iou_mean")))


_ZOOM = f"""WITH {LOC}, s AS (SELECT bucket, bce_logit, f1_full, iou_full, f1_swin AS f1_zoom, iou_swin AS iou_zoom, f1_gap AS f1_oracle, iou_gap AS iou_oracle, prec_full, rec_full, prec_swin AS prec_zoom, rec_swin AS rec_zoom FROM lo WHERE isfinite(iou_full) AND isfinite(iou_swin))"""


def _zoom(spark, d):
    """Samples with a second look; the window masks stand for it, and those of the gap rule for the oracle's."""
    x = loc(spark, d).where(_FIN("iou_full") & _FIN("iou_swin"))
    return x.select("bucket", "bce_logit", *[F.col(f"{m}_{k}").alias(f"{m}_{n}") for k, n in (("full", "full"), ("swin", "zoom"), ("gap", "oracle")) for m in ("f1", "iou")], "prec_full", "rec_full", F.col("prec_swin").alias("prec_zoom"), F.col("rec_swin").alias("rec_zoom"))


_VIEWS = {f"{m}_{n}": f"{m}_{n}" for n in ("full", "zoom", "oracle") for m in ("f1", "iou")}


@query(_ZOOM + " " + _spread_sql("s", "bucket", _VIEWS) + " UNION ALL SELECT 'ALL' AS bucket, * FROM (" + _spread_sql("(SELECT 0 AS one, * FROM s)", "one", _VIEWS).replace("SELECT one, e.m", "SELECT e.m", 1) + ")")
def agg_zoom_by_size(spark, d):
    """First look, second look and oracle by bucket, and all together."""
    x = _zoom(spark, d)
    return rounded(A.spread(x.withColumn("bucket", F.explode(F.array("bucket", F.lit("ALL")))), ["bucket"], _VIEWS))


@query(_ZOOM + """, c AS (SELECT coalesce(median(bce_logit) FILTER (bce_logit >= 0), 0) AS cut FROM s)
  SELECT bucket, CASE WHEN bce_logit < 0 THEN 'missed' WHEN bce_logit >= cut THEN 'confident' ELSE 'less' END AS tier, count(*) AS n, round(median(iou_zoom), 6) AS iou_med, round(quantile_cont(iou_zoom, 0.25), 6) AS iou_p25, round(avg(iou_zoom), 6) AS iou_mean
  FROM s CROSS JOIN c WHERE bce_logit IS NOT NULL GROUP BY 1, 2""")
def agg_zoom_confidence(spark, d):
    """Second looks by bucket and by how sure the detector is."""
    x = _zoom(spark, d).where("bce_logit is not null")
    q = A.quantiles(x.where("bce_logit >= 0"), [], "bce_logit", {"cut": 0.5}).first()
    cut = (q["cut"] if q else None) or 0.0
    tier = F.when(F.col("bce_logit") < 0, "missed").when(F.col("bce_logit") >= cut, "confident").otherwise("less")
    return rounded(x.groupBy("bucket", tier.alias("tier")).agg(F.count("*").alias("n"), F.median("iou_zoom").alias("iou_med"), F.percentile("iou_zoom", F.lit(0.25)).alias("iou_p25"), F.avg("iou_zoom").alias("iou_mean")))


@query(_ZOOM + """, q AS (SELECT quantile_cont(iou_full, 0.25) AS a, quantile_cont(iou_full, 0.5) AS b, quantile_cont(iou_full, 0.75) AS c FROM s)
  SELECT CASE WHEN iou_full <= a THEN 'q1' WHEN iou_full <= b THEN 'q2' WHEN iou_full <= c THEN 'q3' ELSE 'q4' END AS quartile, count(*) AS n, round(median(iou_full), 6) AS full_med, round(median(iou_zoom - iou_full), 6) AS d_zoom_med, round(avg(iou_zoom - iou_full), 6) AS d_zoom_mean,
  round(median(CASE WHEN isfinite(iou_oracle) THEN iou_oracle - iou_full END), 6) AS d_oracle_med, round(avg(CASE WHEN isfinite(iou_oracle) THEN iou_oracle - iou_full END), 6) AS d_oracle_mean FROM s CROSS JOIN q GROUP BY 1""")
def agg_zoom_quartiles(spark, d):
    """Gain of the second look and of the oracle by quartile of the first."""
    x = _zoom(spark, d)
    q = A.quantiles(x, [], "iou_full", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).first() or {"q1": 0.0, "q2": 0.0, "q3": 0.0}
    band = F.when(F.col("iou_full") <= q["q1"], "q1").when(F.col("iou_full") <= q["q2"], "q2").when(F.col("iou_full") <= q["q3"], "q3").otherwise("q4")
    zoom, oracle = F.col("iou_zoom") - F.col("iou_full"), F.when(_FIN("iou_oracle"), F.col("iou_oracle") - F.col("iou_full"))
    return rounded(x.groupBy(band.alias("quartile")).agg(F.count("*").alias("n"), F.median("iou_full").alias("full_med"), F.median(zoom).alias("d_zoom_med"), F.avg(zoom).alias("d_zoom_mean"), F.median(oracle).alias("d_oracle_med"), F.avg(oracle).alias("d_oracle_mean")))


_CF = ("f1", "iou", "prec", "rec")


@query(f"""WITH {LOC}, s AS (SELECT * FROM lo WHERE bucket IS NOT NULL AND isfinite(f1_full) AND isfinite(f1_swin)) SELECT coalesce(bucket, 'ALL') AS bucket, count(*) AS n, count(*) FILTER (coalesce(swin_n_pass, 0) > 0) AS fired, round(avg(coalesce(swin_n_pass, 0)), 6) AS mean_crops,
  {", ".join(f"round(median({c}_full), 6) AS coarse_{c}, round(avg({c}_full), 6) AS coarse_{c}_mean, round(median({c}_swin), 6) AS refine_{c}, round(avg({c}_swin), 6) AS refine_{c}_mean, round(median({c}_swin) - median({c}_full), 6) AS d_{c}" for c in _CF)} FROM s GROUP BY ROLLUP (bucket)""")
def agg_coarse_to_fine(spark, d):
    """Second look against the first by bucket, with the overall row."""
    x = loc(spark, d).where(F.col("bucket").isNotNull() & _FIN("f1_full") & _FIN("f1_swin"))
    own = []
    for c in _CF:
        a, b = F.col(f"{c}_full"), F.col(f"{c}_swin")
        own += [F.median(a).alias(f"coarse_{c}"), F.avg(a).alias(f"coarse_{c}_mean"), F.median(b).alias(f"refine_{c}"), F.avg(b).alias(f"refine_{c}_mean"), (F.median(b) - F.median(a)).alias(f"d_{c}")]
    crops = F.coalesce("swin_n_pass", F.lit(0))
    g = x.rollup("bucket").agg(F.count("*").alias("n"), F.count_if(crops > 0).alias("fired"), F.avg(crops).alias("mean_crops"), *own)
    return rounded(g.withColumn("bucket", F.coalesce("bucket", F.lit("ALL"))))


@query(f"""WITH {LOC} SELECT tag, best_k, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY tag) AS DOUBLE), 6) AS share FROM lo WHERE best_k IS NOT NULL GROUP BY tag, best_k""")
def agg_best_k_shares(spark, d):
    x = loc(spark, d).where("best_k is not null").groupBy("tag", "best_k").agg(F.count("*").alias("n"))
    return rounded(x.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("tag"))))


@query(f"""WITH {LOC}, m AS (SELECT tag, kind, median(iou_full) AS med, count(*) AS n FROM lo WHERE isfinite(iou_full) AND kind IS NOT NULL GROUP BY 1, 2) SELECT tag, round(sum(med * n) / sum(n), 6) AS metric, sum(n) AS n FROM m GROUP BY tag""")
def agg_weighted_medians(spark, d):
    """The stopping metric: cell medians weighted by cell size."""
    x = loc(spark, d).where("iou_full is not null and not isnan(iou_full) and kind is not null").groupBy("tag", "kind").agg(F.median("iou_full").alias("med"), F.count("*").alias("n"))
    return rounded(x.groupBy("tag").agg((F.sum(F.col("med") * F.col("n")) / F.sum("n")).alias("metric"), F.sum("n").alias("n")))


@query(f"""WITH RECURSIVE {LOC}, v AS (SELECT tag, row_number() OVER (PARTITION BY tag ORDER BY h) AS i, v FROM (SELECT tag, date_trunc('hour', logged_at) AS h, avg(iou_full) AS v FROM lo WHERE isfinite(iou_full) AND logged_at IS NOT NULL GROUP BY 1, 2)),
  r(tag, i, best, bad, stop) AS (SELECT DISTINCT tag, CAST(0 AS BIGINT), -1.0e0, 0, false FROM v UNION ALL SELECT r.tag, r.i + 1, CASE WHEN NOT stop AND v > best + 0.002e0 THEN v ELSE best END, CASE WHEN stop THEN bad WHEN v > best + 0.002e0 THEN 0 ELSE bad + 1 END,
    stop OR (NOT v > best + 0.002e0 AND bad + 1 >= 3) FROM r JOIN v ON v.tag IS NOT DISTINCT FROM r.tag AND v.i = r.i + 1)
  SELECT tag, CAST(i AS INT) AS epochs, round(best, 6) AS best, bad, stop FROM r QUALIFY row_number() OVER (PARTITION BY tag ORDER BY i DESC) = 1""")
def udf_early_stop(spark, d):
    """Best value and patience over the runs of a tag in order of time, as a fold over the ordered array of each tag (bounded by its hours)."""
    x = loc(spark, d).where("iou_full is not null and not isnan(iou_full) and logged_at is not null").groupBy("tag", F.date_trunc("hour", "logged_at").alias("h")).agg(F.avg("iou_full").alias("v"))
    a = x.groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "v"))), lambda s: s["v"]).alias("vs"))
    zero = F.struct(F.lit(-1.0).alias("best"), F.lit(0).alias("bad"), F.lit(False).alias("stop"))

    def step(s, v):
        better = v > s["best"] + 0.002
        return F.when(s["stop"], s).otherwise(F.struct(F.when(better, v).otherwise(s["best"]).alias("best"), F.when(better, 0).otherwise(s["bad"] + 1).alias("bad"), (~better & (s["bad"] + 1 >= 3)).alias("stop")))

    return rounded(a.select("tag", F.size("vs").alias("epochs"), F.aggregate("vs", zero, step).alias("s")).select("tag", "epochs", "s.best", "s.bad", "s.stop"))


@query(f"""WITH {PATCHES}, v AS (SELECT image_id, idx, attention AS v, lead(attention) OVER (PARTITION BY image_id ORDER BY attention) AS nx, row_number() OVER (PARTITION BY image_id ORDER BY attention) AS pos FROM pa),
  n AS (SELECT image_id, count(*) AS n, max(v) AS top FROM v GROUP BY 1), b AS (SELECT image_id, v, nx, row_number() OVER (PARTITION BY image_id ORDER BY coalesce(nx - v, -1) DESC, pos) AS rk FROM v)
  SELECT image_id, round(CASE WHEN n < 3 THEN top + 1 ELSE (v + nx) / 2 END, 6) AS threshold FROM b JOIN n USING (image_id) WHERE rk = 1""")
def cal_gap_threshold(spark, d):
    return rounded(C.gap_threshold(patches(spark, d), "image_id", "attention"))


@query(f"""WITH {PATCHES}, md AS (SELECT image_id, median(attention) AS m FROM pa GROUP BY 1), u AS (SELECT image_id, attention AS v FROM pa JOIN md USING (image_id) WHERE attention >= m),
  v AS (SELECT image_id, v, lead(v) OVER w AS nx, row_number() OVER w AS pos FROM u WINDOW w AS (PARTITION BY image_id ORDER BY v)),
  n AS (SELECT image_id, count(*) AS n, max(v) AS top FROM v GROUP BY 1), b AS (SELECT image_id, v, nx, row_number() OVER (PARTITION BY image_id ORDER BY coalesce(nx - v, -1) DESC, pos) AS rk FROM v),
  t AS (SELECT image_id, CASE WHEN n < 3 THEN top + 1 ELSE (v + nx) / 2 END AS threshold FROM b JOIN n USING (image_id) WHERE rk = 1)
  SELECT image_id, idx, attention >= threshold AS pred FROM pa JOIN t USING (image_id)""")
def cal_gap_prediction(spark, d):
    p = patches(spark, d)
    t = C.gap_threshold(p, "image_id", "attention", upper_half=True)
    return p.join(t, "image_id").select("image_id", "idx", (F.col("attention") >= F.col("threshold")).alias("pred"))


@query(f"""WITH {PATCHES}, v AS (SELECT image_id, attention AS v, row_number() OVER w AS i, sum(attention) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s, count(*) OVER a AS n, sum(attention) OVER a AS t, lead(attention) OVER w AS nx, max(attention) OVER a AS top
    FROM pa WINDOW w AS (PARTITION BY image_id ORDER BY attention), a AS (PARTITION BY image_id)),
  c AS (SELECT *, CASE WHEN nx IS NULL THEN -1 ELSE CAST(i AS DOUBLE) * (n - i) * pow(s / i - (t - s) / (n - i), 2) END AS score FROM v), b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(score, 9) DESC, i) AS rk FROM c)
  SELECT image_id, round(CASE WHEN n < 2 THEN top + 1 ELSE (v + nx) / 2 END, 6) AS threshold FROM b WHERE rk = 1""")
def cal_otsu_threshold(spark, d):
    return rounded(C.otsu_threshold(patches(spark, d), "image_id", "attention"))


@query(f"""WITH {LOC}, v AS (SELECT tag, area AS v FROM lo WHERE area IS NOT NULL), m AS (SELECT tag, median(v) AS m FROM v GROUP BY 1), a AS (SELECT tag, median(abs(v - m)) AS a FROM v JOIN m USING (tag) GROUP BY 1)
  SELECT tag, round(avg(CAST(v > m + 3 * greatest(a * 1.4826e0, 1e-6) AS INT)), 6) AS frac FROM v JOIN m USING (tag) JOIN a USING (tag) GROUP BY 1""")
def agg_mad_outliers(spark, d):
    return rounded(C.mad_outliers(loc(spark, d), "tag", "area"))


@query(f"""WITH {PATCHES}, md AS (SELECT image_id, median(attention) AS m FROM pa GROUP BY 1), e AS (SELECT image_id, unnest(z) / sqrt(list_dot_product(z, z)) AS x, unnest(range(0, len(z))) AS pos FROM pa JOIN md USING (image_id) WHERE attention <= m),
  s AS (SELECT image_id, pos, sum(x) AS s FROM e GROUP BY 1, 2), t AS (SELECT image_id, list(s ORDER BY pos) AS total FROM s GROUP BY 1)
  SELECT image_id, idx, round(1 - list_cosine_similarity(z, total), 6) AS score FROM pa JOIN t USING (image_id)""")
def cal_outlier_scores(spark, d):
    return rounded(C.outlier_scores(patches(spark, d)))


@query(f"""WITH {PATCHES}, w AS (SELECT image_id, attention AS v, lead(attention) OVER o AS nx, row_number() OVER o AS pos FROM pa WINDOW o AS (PARTITION BY image_id ORDER BY attention)),
  g AS (SELECT image_id, (v + nx) / 2 AS t FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY coalesce(nx - v, -1) DESC, pos) AS rk, count(*) OVER (PARTITION BY image_id) AS n FROM w) WHERE rk = 1 AND n > 2),
  e AS (SELECT image_id, unnest(z) / sqrt(list_dot_product(z, z)) AS x, unnest(range(0, len(z))) AS pos FROM pa LEFT JOIN g USING (image_id) WHERE t IS NULL OR attention < t), s AS (SELECT image_id, pos, sum(x) AS s FROM e GROUP BY 1, 2), t AS (SELECT image_id, list(s ORDER BY pos) AS total FROM s GROUP BY 1),
  sc AS (SELECT image_id, lab, 1 - list_cosine_similarity(z, total) AS score FROM pa JOIN t USING (image_id))
  SELECT image_id, round(median(score) FILTER (lab = 1) - median(score) FILTER (lab = 0), 6) AS out_gap FROM sc GROUP BY 1""")
def cal_outlier_gap(spark, d):
    """Outlier scores against the background below the widest gap of attention, as the difference of both sides' medians."""
    p = patches(spark, d)
    return rounded(C.outlier_gap(C.outlier_scores(p, "gap").join(p.select("image_id", "idx", "lab"), ["image_id", "idx"]), "image_id", "lab", "score"))


@query(f"""WITH {PATCHES} SELECT a.image_id, a.lab, count(DISTINCT a.idx) AS n, round(avg(list_dot_product(a.z, b.z)), 5) AS coherence FROM pa a JOIN pa b ON a.image_id = b.image_id AND a.lab = b.lab AND a.idx <> b.idx GROUP BY 1, 2""")
def agg_offdiagonal_similarity(spark, d):
    """Mean similarity of distinct patches by the length of their vector sum; the SQL takes all pairs."""
    return rounded(C.offdiagonal_similarity(patches(spark, d), "image_id", "lab").where("n > 1"), 5)


@query(f"""WITH {PATCHES}, e AS (SELECT image_id, lab, unnest(z) AS x, unnest(range(0, len(z))) AS pos FROM pa), s AS (SELECT image_id, lab, pos, sum(x) AS s FROM e GROUP BY 1, 2, 3), t AS (SELECT image_id, lab, list(s ORDER BY pos) AS v FROM s GROUP BY 1, 2)
  SELECT a.image_id, round(1 - list_cosine_similarity(a.v, b.v), 6) AS separation FROM t a JOIN t b ON a.image_id = b.image_id AND a.lab = 1 AND b.lab = 0""")
def agg_cluster_separation(spark, d):
    return rounded(C.cluster_separation(patches(spark, d), "image_id", "lab"))


@query(f"""WITH {SCORES}, g AS (SELECT unnest(range(-8, 9)) / 4.0e0 AS thr), s AS (SELECT tag, image_id % 50 AS img, logit, label = 1 AS gt FROM sc),
  i AS (SELECT tag, img, thr, count(*) FILTER (gt AND logit >= thr) AS tp, count(*) FILTER (logit >= thr) AS np, count(*) FILTER (gt) AS ng FROM s CROSS JOIN g GROUP BY 1, 2, 3)
  SELECT tag, img, round(max(CASE WHEN np + ng - tp = 0 THEN 0 ELSE tp / CAST(np + ng - tp AS DOUBLE) END), 6) AS best_iou FROM i GROUP BY 1, 2""")
def agg_patch_ceiling(spark, d):
    """Best IoU of thresholded patch logits over a grid of 17 thresholds; patches are counted by grid step before the sweep."""
    s = scores(spark, d).select("tag", (F.col("image_id") % 50).alias("img"), "logit", (F.col("label") == 1).alias("gt"))
    step = F.least(F.greatest(F.floor(F.col("logit") * 4), F.lit(-9)), F.lit(8)).cast("int")
    c = s.groupBy("tag", "img", step.alias("k")).agg(F.count_if("gt").alias("p"), F.count("*").alias("n"))
    grid = s.select("tag", "img").distinct().withColumn("k", F.explode(F.sequence(F.lit(-9), F.lit(8))))
    c = grid.join(c, ["tag", "img", "k"], "left").na.fill(0, ["p", "n"])
    down = Window.partitionBy("tag", "img").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"tp": F.sum("p").over(down), "np": F.sum("n").over(down), "ng": F.sum("p").over(Window.partitionBy("tag", "img"))}).where("k >= -8")
    iou = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("np") + F.col("ng") - F.col("tp")), F.lit(0.0))
    return rounded(c.groupBy("tag", "img").agg(F.max(iou).alias("best_iou")))
