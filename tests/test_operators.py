"""Hand-computed expectations of the operators on tiny frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchmill.errors import ConfigError, EvalError
from patchmill.functions.labels import label, label_or_unknown, path_plain
from patchmill.functions.tiers import area_bucket, area_tier, size_bucket
from patchmill.operators import calibrate as C
from patchmill.operators import cluster as K
from patchmill.operators import geometry as G
from patchmill.operators import losses as L
from patchmill.operators import manifest as M
from patchmill.operators import metrics as A
from patchmill.operators import sampling as S


def items(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "item_id long, source string, kind string, case_id string, img string")


def test_labels_and_paths(spark):
    r = spark.createDataFrame([(" Imd_2020\t",), (None,), ("",)], "s string").select(label("s"), label_or_unknown("s")).collect()
    assert [tuple(x) for x in r] == [("imd2020", "imd2020"), (None, "unknown"), ("", "")]
    p = spark.createDataFrame([("  \\a\\.\\b//c.png ",), ("./x/././y",), (None,)], "s string").select(path_plain("s")).collect()
    assert [x[0] for x in p] == ["/a/b/c.png", "x/y", None]


def test_tiers_at_their_edges(spark):
    a = [0.0, 0.05, 0.051, 0.149, 0.15, 0.299, 0.30, float("nan"), float("inf"), None]
    r = spark.createDataFrame([(x,) for x in a], "a double").select(area_tier("a"), size_bucket("a"), area_bucket("a")).collect()
    assert [x[0] for x in r] == ["tiny", "tiny", "small", "small", "medium", "medium", "large", "tiny", "tiny", "tiny"]
    assert [x[1] for x in r[7:]] == ["large"] * 3 and r[7][2] == "large"


@pytest.mark.parametrize("target,kinds,want", [(0.5, "rrs", [0.25, 0.25, 0.5]), (0.8, "rs", [0.2, 0.8]), (0.5, "rr", [1, 1]), (7, "rs", [0, 1])])
def test_class_weights(spark, target, kinds, want):
    df = items(spark, [("a", {"r": "imdreal", "s": "imdsplice"}[k], "c", str(i)) for i, k in enumerate(kinds)])
    got = [r["weight"] for r in S.class_weights(df, target).orderBy("item_id").collect()]
    assert got == pytest.approx(want)


def test_source_weights_fall_back_to_one(spark):
    df = items(spark, [("a", "imdsplice", "c", "1"), ("b", "imdsplice", "c", "2"), (None, "imdreal", "c", "3")])
    w = [r["weight"] for r in S.source_class_weights(df, {"a": 1}).orderBy("item_id").collect()]
    assert w == pytest.approx([0.5, 0, 0.5])
    assert [r["weight"] for r in S.source_class_weights(df.where("item_id < 2"), {}).collect()] == [1, 1]


def test_quotas():
    assert S.quotas([40, 20], 20) == [13, 7] or sum(S.quotas([40, 20], 20)) == 20
    assert S.quotas([5, 5], 0) == [5, 5] and S.quotas([3, 2], 9) == [3, 2]
    q = S.quotas([1000, 1, 1, 1], 10)
    assert q == [8, 1, 1, 1]  # one pass only: the sample itself is then cut to the cap
    assert S.quotas([1] * 5, 2) == [1] * 5


def test_stratified_cap_keeps_groups(spark):
    df = items(spark, [("a", "imdreal", str(i), f"x{i}") for i in range(40)] + [("b", None, str(i), f"y{i}") for i in range(20)])
    x = S.stratified_cap(df, 20).collect()
    assert len(x) == 20 and {r["source"] for r in x} == {"a", "b"}
    assert {r["item_id"] for r in x} == {r["item_id"] for r in S.stratified_cap(df.repartition(7), 20).collect()}


def test_hash_samples(spark):
    df = items(spark, [("a", "imdreal", str(i), f"x{i}") for i in range(20)])
    ids = lambda x: {r["item_id"] for r in x.collect()}
    assert len(ids(S.bottom_by_hash(df, 5, "s"))) == 5 and ids(S.bottom_by_hash(df, 5, "s")) != ids(S.bottom_by_hash(df, 5, "t"))
    assert len(ids(S.reals_at_rate(df, 0.5, "s"))) == 10 and len(ids(S.reals_at_rate(df, 0.0, "s"))) == 1
    assert len(ids(S.bottom_by_hash(df, 0, "s"))) == 0 and len(ids(S.bottom_by_hash(df, 0, "s", all_when_not_positive=True))) == 20
    sides = S.rank_split(df, "img", 0.25, "q").groupBy("side").count().collect()
    assert {r["side"]: r["count"] for r in sides} == {"train": 5, "val": 15}
    assert S.rank_split(df.limit(0), "img", 0.5, "q").count() == 0
    t, v = S.shuffle_split([f"k{i}" for i in range(20)], 0.1, 42)
    assert len(v) == 2 and not set(t) & set(v)


def test_draws_and_shards(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "id long, w double")
    d = S.weighted_draws(df, "id", "w", 3000, seed=1).toPandas()
    assert sorted(d["draw"]) == list(range(3000)) and (d["id"] % 3 != 0).all()
    assert abs((d["id"] % 3 == 2).mean() - 2 / 3) < 0.04
    two = S.weighted_draws(df.repartition(5), "id", "w", 3000, seed=1, per_part=7, replicas=7).toPandas()
    assert len(two) == 3003 and sorted(two["draw"]) == list(range(3003)) and two["shard"].value_counts().tolist() == [429] * 7 and abs((two["id"] % 3 == 2).mean() - 2 / 3) < 0.04
    assert sorted(map(tuple, two.values)) == sorted(map(tuple, S.weighted_draws(df, "id", "w", 3000, seed=1, per_part=7, replicas=7).toPandas().values))
    plan = S.loader_plan(df, "id", batch=4, replicas=2, seed=1).toPandas()
    assert len(plan) == 24 and plan["id"].is_unique and plan.groupby(["shard", "batch_no"]).size().eq(4).all()
    assert S.loader_plan(df, "id", batch=4, replicas=2, shuffle=False, drop_last=False).count() == 30
    assert S.loader_plan(df, "id", batch=5, epoch_size=20, weight="w").count() == 20
    cs = S.capped_subset(df.withColumn("img", F.col("id").cast("string")), 20, 0.1, "s")
    assert {r["split"]: r["count"] for r in cs.groupBy("split").count().collect()} == {"train": 18, "val": 2}
    sh = S.shards(df, ["id"], 4).collect()
    assert all(r["shard"] == r["id"] % 4 for r in sh)
    e = S.with_epoch_subset(df, "id", 10, 4, 1, 0).toPandas()
    assert len(e) == 12 and e["shard"].value_counts().tolist() == [3, 3, 3, 3]


def test_masks_and_conventions(spark):
    df = spark.createDataFrame([(1, True, True), (1, True, False), (1, False, False), (1, False, False), (2, False, False)], "k int, pred boolean, gt boolean")
    m = {r["k"]: r for r in A.mask_metrics(df, "k", empty=1.0).collect()}
    assert m[1]["f1"] == pytest.approx(2 / 3) and m[1]["iou"] == 0.5 and m[1]["prec"] == 0.5 and m[1]["rec"] == 1 and m[1]["gt_frac"] == 0.25
    assert m[2]["f1"] == 1 and {r["k"]: r["f1"] for r in A.mask_metrics(df, "k").collect()}[2] == 0
    o = A.oracle_polarity(df.where("k = 1").withColumn("pred", ~F.col("pred")), "k").first()
    assert o["flipped"] and o["f1"] == pytest.approx(2 / 3)


def test_detection(spark):
    df = spark.createDataFrame([("t", x, y, a) for x, y, a in zip([-3.0, -2.0, 2.0, 3.0], [0, 0, 1, 1], [0.0, 0.0, 0.04, 0.2], strict=True)], "tag string, logit double, label int, area double")
    m = A.image_metrics(df, "tag").first()
    assert m["bal_acc"] == 1 and m["auc"] == 1 and m["opt_threshold"] == 2.0
    t = A.tier_rates(df, A.best_threshold(df, "tag").select("tag", F.col("opt_threshold").alias("threshold")), area_tier("area"), "tag").collect()
    assert {r["tier"]: r["n"] for r in t} == {"tiny": 1, "small": 0, "medium": 1, "large": 0}
    one = df.where("label = 1")
    assert math.isnan(A.auroc(one, "tag").first()["auc"]) and A.threshold_at_tnr(one, 0.95, "tag").first()["threshold"] == math.inf
    tied = spark.createDataFrame([("t", 1.0, 0), ("t", 1.0, 1)], "tag string, logit double, label int")
    assert A.auroc(tied, "tag").first()["auc"] == 0 and A.auroc(tied, "tag", ties="half").first()["auc"] == 0.5
    w = spark.createDataFrame([(1, -1.0), (1, 5.0), (1, 3.0), (1, 0.0), (2, 2.5)], "i int, v double")
    assert {r["i"]: r["top2_logit"] for r in A.top2(w, "i", value="v").collect()} == {1: 4.0, 2: 2.5}


def test_calibrated_specificity(spark):
    df = spark.createDataFrame([("t", -3 + 2.5 * i / 199, 0) for i in range(200)] + [("t", 3.0, 1)] * 4, "tag string, logit double, label int")
    a, b = A.threshold_at_tnr(df, 0.95, "tag").first(), A.threshold_at_tnr(df, 0.99, "tag").first()
    assert abs(a["tnr"] - 0.95) < 0.02 and b["threshold"] >= a["threshold"] and a["tpr"] == 1


def test_gaps_and_otsu(spark):
    df = spark.createDataFrame([(1, v) for v in (0.0, 0.1, 0.2, 0.9, 1.0)] + [(2, 0.5), (2, 0.6)], "k int, v double")
    assert {r["k"]: round(r["threshold"], 6) for r in C.gap_threshold(df, "k", "v").collect()} == {1: 0.55, 2: 1.6}
    assert {r["k"]: round(r["threshold"], 6) for r in C.otsu_threshold(df, "k", "v").collect()}[1] == 0.55
    assert C.mad_outliers(df, "k", "v").count() == 2


def test_axis_positions_and_grids(spark):
    def starts(n, s, f):
        return spark.range(1).select(G.axis_starts(F.lit(n), F.lit(s), F.lit(max(1, round(s * f)))).alias("a")).first()["a"]

    assert starts(100, 50, 1.0) == [0, 50] and starts(100, 50, 0.5) == [0, 25, 50] and starts(50, 50, 1.0) == [0] and starts(100, 50, 0.3)[-1] == 50
    df = spark.createDataFrame([(1, 100, 100)], "image_id int, w int, h int")
    g = G.window_grid(df, 0.5, 1.0, 8)
    assert g.count() == 4 and len(G.grid_hash(g, "image_id").first()["hash"]) == 12
    assert G.capped_grid(df, 0.2, 0.5, 8, 4).count() <= 4
    b = G.square_expand(F.lit(90), F.lit(90), F.lit(5), F.lit(10), F.lit(100), F.lit(100))
    assert tuple(spark.range(1).select(*b).first()) == (88, 90, 10)


def test_boxes(spark):
    df = spark.createDataFrame([(1, r, c, 2 <= r <= 4 and 3 <= c <= 6) for r in range(10) for c in range(10)], "k int, r int, c int, m boolean")
    b = G.mask_boxes(df, "k", "m", 10).first()
    assert (b["r0"], b["c0"], b["r1"] - b["r0"] + 1, b["c1"] - b["c0"] + 1) == (2, 3, 3, 4) and (b["cy"], b["cx"]) == (3.0, 4.5)
    p = spark.createDataFrame([(5, 6, 5, 6, 256, 256)], "r0 int, r1 int, c0 int, c1 int, hh int, ww int")
    r = G.padded_box(p, 16, "hh", "ww", base=2, frac=0.15, least=8).first()
    assert (r["y1"] - r["y0"]) // 16 == 8 and r["x0"] >= 0


def test_covers_and_projection_equal_cells(spark):
    df = spark.createDataFrame([(1, 230, 470), (2, 448, 448), (3, 30, 28)], "image_id int, w int, h int")
    c = G.projected_cells(G.window_grid(df, 0.5, 0.5, 28), 28, 448).groupBy("w", "h", "ti", "tj").agg(F.count("*").alias("n"))
    want = {(r["w"], r["h"]): (r["p"], r["m"], r["s"]) for r in c.groupBy("w", "h").agg(F.count("*").alias("p"), F.max("n").alias("m"), F.sum("n").alias("s")).collect()}
    assert want == {(r["w"], r["h"]): (r["patches"], r["most"], r["cells"]) for r in G.footprints(df, 0.5, 0.5, 28, 448).collect()}
    win = spark.createDataFrame([(1, 0, 0, 448, 448, 448)], "win int, top int, left int, side int, w int, h int")
    cells = spark.createDataFrame([(1, 3, 5), (1, 0, 27), (2, 1, 1)], "win int, wi int, wj int")
    assert {(r["ti"], r["tj"]) for r in G.project_masks(win, cells, ["win"], "win", 28, 448).collect()} == {(3, 5), (0, 27)}


def test_running_sums_in_two_levels(spark, monkeypatch):
    from patchmill import storage

    df = spark.createDataFrame([("a", float(i % 97), i % 5) for i in range(97)] + [("b", 1.0, 2)], "k string, s double, v int")
    run = lambda: sorted(map(tuple, storage.running_sums(df, ["k"], F.col("s").desc(), {"r": "v"}, {"t": "v"}).select("k", "s", "v", "r", "t").collect()))
    one = run()
    monkeypatch.setattr(storage, "WINDOW_BYTES", 0)
    assert run() == one and one[-1] == ("b", 1.0, 2, 2, 2)


def test_intermediate_tables_can_be_cleaned(spark):
    import os

    from patchmill import storage

    ws = storage.Workspace(spark, "t")
    x = ws.cut(spark.range(3))
    assert x.count() == 3 and os.path.isdir(ws.root)
    storage.clean(spark)
    assert not os.path.isdir(ws.root)


def test_soft_labels(spark):
    x = spark.createDataFrame([(v,) for v in (0.0, 0.01, 0.04, 0.06)], "d double").select(*G.soft_labels(F.col("d"))).collect()
    assert [(r["label"], round(r["weight"], 6)) for r in x] == [(0, 1.0), (0, 0.0), (1, 0.5), (1, 1.0)]


def planted(spark, sizes, side=12, seed=0):
    """One image whose patches lie near planted directions, in runs."""
    rng = np.random.default_rng(seed)
    dirs = np.linalg.qr(rng.normal(size=(16, 16)))[0]
    rows, i = [], 0
    for d, n in enumerate(sizes):
        for _ in range(n):
            z = dirs[d] + 0.05 * rng.normal(size=16)
            rows.append((1, i, i // side, i % side, (z / np.linalg.norm(z)).tolist(), float(d), int(d > 0)))
            i += 1
    return spark.createDataFrame(rows, "image_id long, idx int, r int, c int, z array<double>, attention double, lab int")


def test_graph_decode_finds_regions_and_abstains(spark):
    p = planted(spark, [100, 24, 20])
    x = K.graph_decode(p, s_edge=0.5).toPandas()
    acc = x[x["accepted"]]
    assert acc["root"].nunique() == 2 and set(acc["idx"]) == set(range(100, 144))
    assert not K.graph_decode(planted(spark, [80]), s_edge=0.5).toPandas()["accepted"].any()
    assert K.graph_decode(planted(spark, [9]), s_edge=0.5).count() == 0
    with pytest.raises(Exception, match="unit length"):
        K.graph_decode(p.withColumn("z", F.transform("z", lambda v: v * 2))).collect()
    r = K.graph_report(p, s_edge=0.5).first()
    assert (r["patches"], r["accepted"], r["abstained"]) == (144, 2, False) and 90 < r["background_size"] <= 100
    assert K.graph_report(planted(spark, [9])).first()["abstained"]
    # attention on the largest region makes it the background that it would not be by size
    a = planted(spark, [80, 64]).withColumn("attention", F.when(F.col("lab") == 1, 0.0).otherwise(1.0))
    x = K.graph_decode(a, s_edge=0.5, by_attention=True).toPandas()
    got = set(x[x["accepted"]]["idx"])  # a patch that is in nobody's nearest stays alone
    assert got <= set(range(80)) and len(got) > 70


def test_decodes_by_spec(spark):
    p = planted(spark, [100, 44])
    region = set(range(100, 144))
    ids = lambda x: {r["idx"] for r in x.where("pred").collect()}
    assert ids(K.decoded(p, K.DecodeSpec(), deploy=True)) == region and ids(K.decoded(p, K.DecodeSpec(), deploy=True, attention=False)) == region
    assert ids(K.decoded(p, K.DecodeSpec())) in (region, set(range(100)))
    got = ids(K.decoded(p, K.DecodeSpec(method="graph")))
    assert got <= region and len(got) > 40 and K.decoded(planted(spark, [9]), K.DecodeSpec(method="graph")).count() == 9
    assert K.DecodeSpec(method="graph", radius=3).label() == "graph[s=0.38,k=10,r=3]" and K.DecodeSpec().label() == "kmeans"
    with pytest.raises(ConfigError):
        K.DecodeSpec(method="tree")
    two = p.unionByName(planted(spark, [144], seed=3).withColumn("image_id", F.lit(2).cast("long")))
    single = spark.createDataFrame([(1, False), (2, True)], "image_id long, single boolean")
    c = K.calibrate_graph(two, single).first()
    assert c["bal_acc"] == 1.0 and c["s_edge"] == pytest.approx(0.25) and (c["n_single"], c["n_two"]) == (1, 1)
    assert K.calibrate_graph(p.limit(0), single, fallback=0.4).first()["used_fallback"]
    with pytest.raises(EvalError):
        K.calibrate_graph(p.limit(0), single)
    x = {r["image_id"]: r for r in K.partitioned(two, 0.3).groupBy("image_id").agg(F.count_if("pred").alias("n"), F.bool_or("single").alias("single")).collect()}
    assert (x[1]["n"], x[1]["single"], x[2]["n"], x[2]["single"]) == (44, False, 0, True)
    z = {r["image_id"]: r["single"] for r in K.partitioned(two, 3.0, null=True).select("image_id", "single").distinct().collect()}
    assert z[1] is False


def test_localization_samples(spark):
    from patchmill.operators.localization import localization_samples, scores_of, upper_gap

    p = planted(spark, [100, 44]).withColumns({"gt": F.col("lab") == 1, "win": F.col("idx") > 90})
    two = p.unionByName(p.withColumns({"image_id": F.lit(2).cast("long"), "gt": F.lit(False)})).unionByName(p.withColumn("image_id", F.lit(3).cast("long")))
    images = spark.createDataFrame([(1, "imdsplice", 0.5), (2, "imdsplice", 0.5), (3, "imdreal", None)], "image_id long, kind string, logit double")
    r = localization_samples(two, images, "gt", swin="win").collect()
    assert [x["image_id"] for x in r] == [1]
    x = r[0]
    assert x["f1_full"] == x["iou_full_deployed"] == 1 and x["polarity_agree"] and x["best_k"] == 2 and x["bucket"] == "large" and x["f1_gap"] == 1 and 0.8 < x["f1_swin"] < 1
    assert x["pos_coh"] > 0.8 and x["bg_coh"] > 0.8 and x["cent_sep"] > 0.8 and x["out_gap"] > 0.5
    g = localization_samples(p, images, "gt", K.DecodeSpec(method="graph"), attention=False).first()
    assert g["f1_full"] > 0.95 and g["f1_swin"] is None
    assert scores_of(np.zeros(4, bool), np.zeros(4, bool)) == (0.0,) * 5 and not upper_gap(np.array([1.0, 2.0])).any()


def test_gate_sweep_derives_its_grid(spark):
    v = spark.createDataFrame([(0.1, True), (0.2, True), (0.5, False), (0.6, False), (None, True)], "s double, single boolean")
    g = K.gate_sweep(v, "s", "single").first()
    assert g["bal_acc"] == 1 and 0.2 < g["tau"] <= 0.5 and (g["n_single"], g["n_two"]) == (2, 2)
    one = K.gate_sweep(v.where("not single"), "s", "single").first()
    assert one["tpr"] == 1.0 and one["bal_acc"] == 1.0 and one["tau"] == pytest.approx(0.45)
    assert K.gate_sweep(v.limit(0), "s", "single", fallback=0.3).first()["tau"] == 0.3
    with pytest.raises(EvalError):
        K.gate_sweep(v.limit(0), "s", "single")
    assert K.class_gap(v, "s", "single").first()["gap_mean"] == pytest.approx(0.4)


def test_quantiles_and_sweeps(spark):
    rng = np.random.default_rng(0)
    rows = [(None if i % 3 == 0 else "t", float(x)) for i, x in enumerate(np.round(rng.normal(size=400), 2))] + [("t", None)]
    q = {r["k"]: r for r in A.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"a": 0.95, "b": 0.5, "c": 0.0}).collect()}
    for k in (None, "t"):
        v = [x for g, x in rows if g == k and x is not None]
        assert [q[k]["a"], q[k]["b"], q[k]["c"]] == pytest.approx(np.quantile(v, [0.95, 0.5, 0.0]).tolist())
    s, y = np.round(rng.random(200), 2), rng.integers(0, 2, 200)
    df = spark.createDataFrame([("t", float(a), int(b)) for a, b in zip(s, y, strict=True)] + [("none", 0.5, 0), ("none", None, 0)], "tag string, score double, label int")
    got = {r["tag"]: r for r in A.f1_sweep(df, "tag").collect()}
    t = np.linspace(0, 1, 101)
    hit = s[None] >= t[:, None]
    tp, np_ = (hit & (y == 1)).sum(1), hit.sum(1)
    f1, prec, rec = 2 * tp / (np_ + y.sum()), tp / np.maximum(np_, 1), tp / max(y.sum(), 1)
    assert got["t"]["best_f1"] == pytest.approx(f1.max()) and got["t"]["best_threshold"] == pytest.approx(t[f1.argmax()])
    assert got["t"]["auprc"] == pytest.approx(np.trapezoid(prec[::-1], rec[::-1]))
    assert (got["none"]["best_f1"], got["none"]["best_threshold"]) == (0.0, 0.5)
    m = A.condition_metrics(spark.createDataFrame([("a", 1.0, 1), ("a", 0.0, 0), ("b", 1.0, 1)], "tag string, logit double, label int"), "tag").collect()
    assert {r["tag"]: (r["auc"], r["f1"]) for r in m} == {"a": (1.0, 1.0), "b": (None, None)}
    r = A.robustness_table(spark.createDataFrame([("a", 0.9), ("b", 0.7)], "tag string, auc double"), "tag").collect()
    assert {x["tag"]: round(x["d_auc"], 6) for x in r} == {"a": 0.0, "b": -0.2}


def test_kmeans_and_silhouettes(spark):
    p = planted(spark, [60, 20])
    lab = K.kmeans_labels(p).toPandas().sort_values("idx")["cluster"].to_numpy()
    assert len(set(lab[:60])) == 1 and len(set(lab[60:])) == 1 and lab[0] != lab[-1]
    assert K.silhouettes(p, "lab").first()["silhouette"] > 0.8
    assert K.silhouettes(p.withColumn("lab", F.lit(0)), "lab").first()["silhouette"] == -1
    n = K.null_silhouettes(p, "lab").first()
    assert n["z"] > 3
    assert K.polarity(p, "lab").first()["positive"] == 1 and K.minority(p, "lab").first()["positive"] == 1


def angles(spark, degrees, labs):
    rows = [(1, i, 0, i, [math.cos(math.radians(a)), math.sin(math.radians(a))], 0.0, l) for i, (a, l) in enumerate(zip(degrees, labs, strict=True))]
    return spark.createDataFrame(rows, "image_id long, idx int, r int, c int, z array<double>, attention double, lab int")


def test_contrastive_identities(spark):
    dead = L.symmetric_contrastive(angles(spark, [20, -20, 160, 200], [1, 1, 0, 0]), "lab").first()
    assert dead["loss"] == 0
    r = L.symmetric_contrastive(angles(spark, [0, 0, 40, 40], [1, 1, 0, 0]), "lab").first()
    assert r["r"] == pytest.approx(math.cos(math.radians(40)) - 0.2) and r["a_in"] == 0
    h = L.hinge_contrastive(angles(spark, [0, 0, 90, 90], [1, 1, 0, 0]), "lab").first()
    assert h["loss"] == pytest.approx(0)


def test_bce_matches_numpy(spark):
    x, t = np.array([-700.0, -1.5, 0.0, 2.0, 700.0]), np.array([1, 0, 1, 1, 0])
    got = [r[0] for r in spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, t, strict=True)], "x double, t int").select(L.bce(F.col("x"), F.col("t"), 2.0)).collect()]
    want = 2 * t * np.logaddexp(0, -x) + (1 - t) * np.logaddexp(0, x)
    assert np.allclose(got, want)
    assert L.batch_loss(spark.createDataFrame([], "loss double")).first()["n_active"] == 0


def test_manifest_joins(spark):
    names = ["/d/casia/images/casia_a1_b1_x_real.png", "/d/casia/images/casia_a1_b1_x_fake.png", "/d/casia/masks/casia_a1_b1_x_mask.png", "/d/casia/images/casia_a2_b1_x_real.png", "/d/casia/images/casia_a2_b1_x_fake.png", "/d/casia/masks/casia_a2_b1_x_mask.png"]
    li = spark.createDataFrame([(p, p.rsplit("/", 1)[1], p.rsplit("/", 1)[1][:-4], ".png", 10) for p in names], "path string, name string, stem string, ext string, length long")
    side = spark.createDataFrame([("a1", "train"), ("b1", "train"), ("a2", "val")], "key string, side string")
    x = M.casia_triplets(li, side).collect()
    assert {(r["case_id"], r["kind"], r["split"]) for r in x} == {("casia_a1_b1_x", "imd_real", "train"), ("casia_a1_b1_x", "imd_splice", "train")}
    assert M.casia_triplets(li.limit(0), side).count() == 0
    f = spark.createDataFrame([("Flux-Fill 2",), ("sd",), (None,)], "m string")
    assert M.model_filter(f, "m", "fluxfill").count() == 1 and M.model_filter(f, "m", "zzz").count() == 3


def test_issues_and_counts(spark, tmp_path):
    x = items(spark, [("a", "imdsplice", "c", "/p"), (None, None, "c", "/q"), ("a", "imdsplice", "c", "/p"), ("a", "imdsplice", "c", "/p")]).withColumns({"mask": F.when(F.col("item_id") == 2, "/m").when(F.col("item_id") == 3, "/z"), "real_path": F.lit(None).cast("string"), "split": F.lit("train")})
    li = spark.createDataFrame([("/p", 10), ("/m", 5), ("/z", 0)], "path string, length long")
    seen = spark.createDataFrame([("/p", 40, 20, True, 9), ("/m", 40, 40, True, 0)], "path string, width int, height int, ok boolean, peak int")
    i = M.quality_issues(x, M.file_facts(li, seen))
    got = {(r["item_id"], r["code"]) for r in i.collect()}
    small = {(k, "DEGENERATE_SIZE") for k in (0, 2, 3)}
    assert got == small | {(0, "SPLICE_NO_MASK"), (1, "MISSING_IMG"), (2, "EMPTY_MASK"), (2, "MASK_SIZE_MISMATCH"), (3, "UNREADABLE_MASK")}
    c = {(r["source"], r["code"]): (r["n"], r["hard"]) for r in M.issue_counts(i).collect()}
    assert c["ALL", "DEGENERATE_SIZE"] == (3, False) and c["unknown", "MISSING_IMG"] == (1, True)
    assert tuple(M.issue_verdict(x, i).first()) == (4, 4, 4, 0, 1) and tuple(M.issue_verdict(x, i.limit(0)).first()) == (4, 0, 0, 0, 0)
    M.write_issue_report(x, i, f"{tmp_path}/r")
    r = spark.read.json(f"{tmp_path}/r").where("img = '/q'").first()
    assert r["issues"][0]["code"] == "MISSING_IMG" and r["split"] == "train"


def test_indexers_hold_out_whole_groups(spark):
    li = spark.createDataFrame([(f"/d/{k}/{i}_x_{e}.png",) for i in range(30) for k, e in (("glidefill/modified", "modified"), ("glidefill/original", "original"), ("glidefill/mask", "mask"))] + [(f"/d/anyedit/images/A{i}_{e}.png",) for i in range(20) for e in ("Real", "fake")] + [(f"/d/imd2020/c{i}/c{i}_{e}.png",) for i in range(10) for e in ("orig", "v0", "v0_mask")], "path string")
    name = F.substring_index("path", "/", -1)
    li = li.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lit(".png").alias("ext"), F.lit(9).alias("length"))
    for x, n in ((M.triplets(li, "glidefill", "/glidefill/modified/", "/glidefill/original/", "/glidefill/mask/"), 3), (M.imd_items(li), 1)):
        p = x.toPandas()
        assert p[p["split"] == "val"]["case_id"].nunique() == n and (p.groupby("case_id")["split"].nunique() == 1).all() and (p.groupby("case_id")["img"].count() == 2).all()
    assert M.anyedit_items(li).count() == 0  # the base keeps an ending that is not in lower case, so these do not pair
    assert M.bfree_items(li).count() == 0 and M.casia_triplets(li).count() == 0


def test_null_keys_are_a_group_on_both_ways(spark, tmp_path, monkeypatch):
    from patchmill import storage

    rows = [(None if i % 3 == 0 else "t", i % 7 / 7, i % 2) for i in range(600)]
    spark.createDataFrame(rows, "tag string, logit double, label int").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert storage.bytes_of(df) < storage.WINDOW_BYTES
    run = lambda: [sorted(map(str, f(df, "tag").collect())) for f in (A.auroc, A.best_threshold, A.image_metrics)]
    small = run()
    made = []
    monkeypatch.setattr(storage, "WINDOW_BYTES", 0)
    monkeypatch.setattr(storage.Workspace, "cut", lambda self, x, _f=storage.Workspace.cut: made.append(1) or _f(self, x))
    assert run() == small and len(made) == 3 and all(len(x) == 2 for x in small)


def test_means_do_not_depend_on_the_order_of_rows(spark):
    import random

    tied = [0.29, 0.88, 0.3, 0.8, 1.0, 0.55, 0.72, 0.41, 0.1, 0.7, 0.6, 0.27, 0.66] + [0.0] * 3
    rows = []
    for k in range(60):
        random.Random(k).shuffle(tied)
        rows += [(k, v) for v in tied]
    x = spark.createDataFrame(rows, "k int, v double").coalesce(1)
    want = sum(round(v * 100) for v in tied) / 100 / len(tied)
    assert {r["mean"] for r in A.spread(x, ["k"], {"v": "v"}).collect()} == {want}
    odd = spark.createDataFrame([(0, 1e-30), (0, 3e-30), (1, 1e300), (1, None), (2, float("inf"))], "k int, v double")
    assert {r["k"]: r["mean"] for r in A.spread(odd, ["k"], {"v": "v"}).collect()} == {0: 2e-30, 1: 1e300, 2: float("inf")}
