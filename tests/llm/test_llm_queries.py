"""Training-data queries against their SQL, and properties of those that SQL cannot express, on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

pytest.importorskip("patchmill.llm")
from patchmill.llm import queries as Q  # noqa: E402
from tests.helpers import same_rows, views  # noqa: E402

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, name):
    df = Q.QUERIES[name](spark, D)
    if name in Q.SQL:
        same_rows(df, views(D), Q.SQL[name])
    else:
        assert df.count() >= 0


def test_pictures_equal_a_plain_join(spark):
    """The overlap join finds just the pairs that agree in scene and role."""
    from patchmill.functions.labels import with_names

    got = {tuple(r) for r in Q.p1_found(spark, D).collect()}
    x = with_names(spark.read.parquet(f"{D}/items.parquet").dropDuplicates(["item_id"])).select("item_id", "split", "p_scene", "p_role").toPandas()
    t, e = x[x["split"] == "train"], x[x["split"].isin(["val", "test"])]
    m = t.merge(e, on=["p_scene", "p_role"])
    assert got == {(min(a, b), max(a, b)) for a, b in zip(m["item_id_x"], m["item_id_y"], strict=True)}


def test_rewritten_names_are_linked_as_near(spark):
    """Pictures of one scene and role are found through links between different shingle sets too."""
    from patchmill.llm.pictures import overlapping_pictures

    rows = [(1, "train", "imd2020_ab12", "/imd2020/ab12/ab12_lemon_tree_v0.png"), (2, "val", "ab12", "/imd2020/ab12/ab12_lmeon_treee_v0_copy.jpg"), (3, "test", "ab12", "/imd2020/ab12/ab12_lemon_tree_v1.png"), (4, "val", None, None), (5, "train", "", ""), (6, None, "ab12", "/imd2020/ab12/ab12_lemon_tree_v0.png")]
    df = spark.createDataFrame(rows, "item_id long, split string, case_id string, img string").withColumn("source", F.lit(None).cast("string"))
    p = overlapping_pictures(df.unionByName(df)).collect()
    assert {(r["id_e"], r["id_t"]) for r in p} == {(2, 1)} and p[0]["similarity"] >= 0.8 and p[0]["c_role_e"] == "v0"
    assert overlapping_pictures(df.limit(0)).count() == 0


def test_sample_sizes_follow_the_targets(spark):
    r = Q.p2_report(spark, D).toPandas()
    assert ((r["drawn"] - r["due"]).abs() < 1.0 + 1e-6).all()
    assert (r["due"] <= r["available"] + 1e-9).all() and (r["due"] >= r[["available", "min_rows"]].min(axis=1) - 1e-9).all()
    for _, g in r.groupby("request_id"):
        assert g["due"].sum() <= max(g["wanted"].sum(), g[["available", "min_rows"]].min(axis=1).sum()) + 1e-6
        if not g["short"].any():
            assert abs(g["due"].sum() - max(g["wanted"].sum(), g["min_rows"].sum())) < 1e-6


def test_splits_keep_components_together(spark):
    x = Q.p5_split(spark, D).toPandas()
    assert (x.groupby("component")["split"].nunique() == 1).all()
    assert x["item_id"].is_unique and set(x["split"]) <= {"train", "val", "test"}
    assert abs((x["split"] == "train").mean() - 0.7) < 0.05


def test_containers_hold_each_text_once(spark):
    x = Q.p7_containers(spark, D).toPandas()
    cap = {"short": 512, "long": 2048}
    full = x[x["container"].notna()].groupby(["limit_name", "container"])["tokens"].sum().reset_index()
    assert (full["tokens"] <= full["limit_name"].map(cap)).all()
    docs = spark.read.parquet(f"{D}/documents.parquet").count()
    assert x.groupby("limit_name")["doc_id"].nunique().eq(docs).all()
    assert (x.groupby(["limit_name", "doc_id"])["piece"].count() == x.groupby(["limit_name", "doc_id"])["pieces"].first()).all()


def test_mix_reaches_shares_within_the_caps(spark):
    x = Q.p8_report(spark, D).toPandas()
    ok = x[~x["short"] & (x["available"] > 0)]
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id").count()
    assert docs and (x["most_copies"] <= x["max_repeats"]).all()
    assert ((ok["reached"] - ok["assigned"]).abs() <= 0.5 * ok["available"].clip(lower=1)).all()
    for _, g in x.groupby("mix_id"):
        most = (g["max_repeats"] * g["available"]).sum()
        assert abs(g["assigned"].sum() - min(g["due"].sum(), most)) < 1e-6 * max(most, 1)


def test_subjects_between_one_and_three(spark):
    x = Q.p9_found(spark, D).toPandas()
    n = x.groupby("doc_id")["subject"].nunique()
    assert n.between(1, 3).all()
