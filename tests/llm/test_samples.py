"""Samples: stable over epochs, proportional, mixed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("patchmill.llm")
from patchmill.llm.epochs import epoch_sample, picks_as_ledger, record_key  # noqa: E402
from patchmill.llm.mixing import SourceMix  # noqa: E402
from patchmill.llm.proportions import ProportionSample, balanced, pivotal, tilt  # noqa: E402


def _key():
    return record_key(["img", "case_id"], [F.lower("source")])


def _records(spark, n, epochs):
    return spark.range(n).select(F.col("id").alias("item_id"), F.concat(F.lit("p"), "id").alias("img"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("case_id"), F.lit("S").alias("source"), (F.col("id") % epochs).alias("batch"))


def test_stable_as_data_grows_and_in_any_order(spark):
    all_ = _records(spark, 4000, 4)
    rates = {0: 0.2, 1: 0.1, 2: 0.05, 3: 0.3}
    run = lambda x: {r["item_id"] for r in epoch_sample(x, "item_id", _key(), F.col("batch"), rates, seed=1).collect()}
    early, late = run(all_.where("batch < 2")), run(all_)
    assert early and early <= late
    assert late == run(all_.unionByName(all_).repartition(9))
    n = np.array([sum(1 for i in late if i % 4 == e) for e in range(4)]) / 1000
    assert (abs(n - [0.2, 0.1, 0.05, 0.3]) < 0.05).all()


def test_record_seen_again_later_keeps_its_epoch_and_prior_picks_stay(spark):
    a = _records(spark, 500, 1)
    again = a.withColumn("batch", F.lit(3))
    rates = {0: 0.0, 3: 1.0}
    assert epoch_sample(a.unionByName(again), "item_id", _key(), F.col("batch"), rates).count() == 0
    prior = a.where("item_id < 5").select(_key().alias("key")).unionByName(spark.createDataFrame([("gone",)], "key string"))
    got = epoch_sample(a, "item_id", _key(), F.col("batch"), rates, stored=picks_as_ledger(prior)).collect()
    assert sorted(r["item_id"] for r in got) == [0, 1, 2, 3, 4] and {r["by"] for r in got} == {"prior"}


def test_null_differs_from_text(spark):
    x = spark.createDataFrame([(1, None, "a"), (2, "null", "a"), (3, "", "a")], "i int, img string, case_id string").withColumn("source", F.lit("s"))
    assert x.select(_key().alias("k")).distinct().count() == 3
    assert epoch_sample(x.limit(0), "i", _key(), F.lit(0), {0: 1.0}).count() == 0


def test_tilt_reaches_targets_and_caps():
    n, t, cap = np.array([100.0, 1e9, 5, 0, 50]), np.array([10.0, 3e3, 50, 7, 0]), np.array([1.0, 1, 2, 1, 1])
    r, gap = tilt(np.full(5, 0.1), n, t, cap)
    assert np.allclose(r * n, [10, 3e3, 10, 0, 0]) and gap.tolist() == [0, 0, 40, 7, 0]


def test_balanced_keeps_the_total_under_floors_and_caps():
    want, least, most = np.array([60.0, 30, 10, 0]), np.array([0.0, 0, 25, 0]), np.array([100.0, 20, 30, 5])
    got = balanced(want, least, most, 100.0)
    assert np.allclose(got, [55, 20, 25, 0])
    assert np.allclose(balanced(want, least, most, 10.0), least) and np.allclose(balanced(want, least, most, 1e4), [100, 20, 30, 0])
    rng = np.random.default_rng(0)
    for _ in range(200):
        w, lo = rng.random(8) * 100, rng.random(8) * 5
        hi = lo + rng.random(8) * 200
        total = lo.sum() + rng.random() * (hi.sum() - lo.sum())
        g = balanced(w, lo, hi, total)
        assert abs(g.sum() - total) < 1e-6 * total and (g >= lo - 1e-9).all() and (g <= hi + 1e-9).all()
        free = (g > lo + 1e-9) & (g < hi - 1e-9)
        assert not free.any() or np.ptp(g[free] / w[free]) < 1e-6 * (g[free] / w[free]).max()
    assert len(balanced(*np.zeros((3, 0)), 5.0)) == 0


def test_pivotal_keeps_size_and_probabilities():
    rng = np.random.default_rng(0)
    p = np.array([0.2, 0.5, 0.8, 0.5, 1.0, 0.0])
    hits = np.zeros(6)
    for _ in range(4000):
        out, at, q = pivotal(p, rng)
        assert at == -1 and out.sum() == 3
        hits += out
    assert (abs(hits / 4000 - p) < 0.04).all()
    assert pivotal(np.array([]), rng)[1] == -1


def test_proportions_floors_gaps_and_stability(spark):
    rows = [(i, "a" if i % 10 else "b", "x") for i in range(3000)] + [(5000 + i, "c", "x") for i in range(4)] + [(None, "a", "x")]
    df = spark.createDataFrame(rows, "item_id long, source string, kind string").withColumns({"rate": F.lit(1), "part": F.lit(2), "id": F.lit(3)})
    t = spark.createDataFrame([(1, "a", "x", 0.5, 0, 0.2), (1, "b", "x", 0.499, 0, 0.2), (1, "c", "x", 0.001, 3, 0.2), (2, "c", "x", 1.0, 0, 0.5), (2, "z", "x", 0.0, 5, 0.5)], "request_id long, source string, kind string, target_share double, min_rows long, sample_frac double")
    run = lambda x: ProportionSample(x, t, "item_id", ["source", "kind"], per_task=200)
    s = run(df)
    d = s.draw().toPandas()
    n = d.groupby(["request_id", "source"]).size().to_dict()
    # the floor of c takes 2.4 records more than its share; a and b make room for them in proportion
    assert abs(n[1, "a"] - 299.2) <= 1 and n[1, "c"] == 3 and abs(n[1, "b"] - 298.6) <= 1 and n[2, "c"] == 4
    assert d.duplicated(["request_id", "item_id"]).sum() == 0
    short = {(r["request_id"], r["source"]) for r in s.report().where("short").collect()}
    assert short == {(2, "c"), (2, "z")}
    again = run(df.unionByName(df).repartition(5)).draw().toPandas()
    assert sorted(map(tuple, again[["request_id", "item_id"]].values)) == sorted(map(tuple, d[["request_id", "item_id"]].values))
    empty = run(df.limit(0))
    assert empty.draw().count() == 0 and empty.report().where("short").count() >= 1


def test_mix_shares_caps_and_empty(spark):
    rows = [(i, "big" if i % 4 else "small", 10 + i % 7) for i in range(2000)] + [(9000, None, 500), (9001, "big", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long").withColumns({"rate": F.lit(1), "h": F.lit(1), "cum": F.lit(1)})
    t = spark.createDataFrame([(1, "big", 0.5, 2, 0.5), (1, "small", 0.5, 3, 0.5), (2, "small", 1.0, 2, 2.0), (2, "none", 0.1, 2, 2.0)], "mix_id long, source string, target_share double, max_repeats int, size_frac double")
    m = SourceMix(docs, t)
    c = m.copies()
    r = {(x["mix_id"], x["source"]): x for x in m.report(c).collect()}
    for k in ((1, "big"), (1, "small")):
        assert abs(r[k]["reached"] - r[k]["due"]) <= 20 and not r[k]["short"]
    assert r[2, "small"]["short"] and r[2, "small"]["reached"] == 2 * r[2, "small"]["available"] and r[2, "none"]["short"]
    assert SourceMix(docs.limit(0), t).copies().count() == 0
