"""The ledger of first-seen epochs: kept over runs, with early rows gone or rates changed; NULL epochs do not move."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("patchmill.llm")
from patchmill.llm.epochs import Ledger, epoch_ledger, epoch_sample, picks_as_ledger  # noqa: E402


def _ids(df):
    return {r["i"] for r in df.collect()}


def test_null_epochs_do_not_move_with_rates(spark):
    x = spark.range(3000).select(F.col("id").alias("i"), F.md5(F.col("id").cast("string")).alias("k"), F.lit(None).cast("int").alias("b"))
    run = lambda rates: _ids(epoch_sample(x, "i", F.col("k"), F.col("b"), rates, seed=7))
    early, late = run({e: 0.04 for e in range(6)}), run({e: 0.04 for e in range(6)} | {e: 0.03 for e in range(6, 12)})
    assert early and early == late


def test_stored_ledger_keeps_epoch_and_rate(spark, tmp_path):
    x = spark.range(1000).select(F.col("id").alias("i"), F.md5(F.col("id").cast("string")).alias("k"), F.lit(0).alias("b"))
    args = ("i", F.col("k"), F.col("b"), {0: 0.3, 5: 0.01})
    first = epoch_ledger(x, *args[1:], 0.0)
    assert first.where("new").count() == 1000
    ledger = Ledger(spark, f"{tmp_path}/ledger")
    assert ledger.read().count() == 0
    for _ in range(2):  # a run that is repeated replaces itself
        ledger.append("first", first.where("new"))
    stored = ledger.read()
    assert stored.count() == 1000 and ledger.read(without="first").count() == 0
    # the first rows are gone; the records came again in epoch 5, with 500 more, and the rate of epoch 0 was lowered
    later = x.withColumn("b", F.lit(5)).where("i >= 100").unionByName(spark.range(1000, 1500).select(F.col("id").alias("i"), F.md5(F.col("id").cast("string")).alias("k"), F.lit(5).alias("b")))
    rates = {0: 0.0, 5: 0.01}
    old = {i for i in _ids(epoch_sample(x, *args, seed=1)) if i >= 100}
    got = _ids(epoch_sample(later, *args[:3], rates, stored=stored, seed=1))
    assert old and old == {i for i in got if i < 1000}
    grown = epoch_ledger(later, *args[1:3], rates, 0.0, stored=stored)
    assert grown.count() == 1500 and grown.where("new").count() == 500
    assert {(r["epoch"], r["rate"]) for r in grown.where("not new").collect()} == {(0, 0.3)} and {(r["epoch"], r["rate"]) for r in grown.where("new").collect()} == {(5, 0.01)}


def test_picks_stay_whatever_the_rates(spark):
    x = spark.range(500).select(F.col("id").alias("i"), F.md5(F.col("id").cast("string")).alias("k"), (F.col("id") % 3).cast("int").alias("b"))
    picks = picks_as_ledger(x.where("i < 20").select(F.col("k").alias("key")).unionByName(spark.createDataFrame([("gone",), (None,)], "key string")))
    got = epoch_sample(x, "i", F.col("k"), F.col("b"), {0: 0.1}, stored=picks, seed=3).collect()
    assert {r["i"] for r in got if r["by"] == "prior"} == set(range(20)) and all(r["u"] < r["rate"] for r in got)
    assert {r["i"] for r in epoch_sample(x, "i", F.col("k"), F.col("b"), {}, stored=picks, seed=9).collect()} == set(range(20))
