"""Components against union-find; splits."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("patchmill.llm")
from patchmill.llm.related import related_components, split_groups  # noqa: E402


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([f"e{rng.randrange(150)}", None]) for _ in range(rng.randrange(4))]) for i in range(200)]
    rows += [(1000 + i, [f"chain{i}", f"chain{i + 1}"]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, e array<string>")
    got = {r["id"]: r["component"] for r in related_components(df.unionByName(df).repartition(5), "id", F.col("e")).collect()}
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for i, es in rows:
        for e in es:
            if e is not None:
                up[find(e)] = find(("r", i))
    want = {i: find(("r", i)) for i, _ in rows}
    pair = {}
    for i in want:
        assert pair.setdefault(want[i], got[i]) == got[i]
    assert len(set(pair.values())) == len(pair)


def test_hot_entity_nulls_and_empty(spark):
    df = spark.createDataFrame([(i, ["hot"]) for i in range(300)] + [(900, None), (901, [None]), (None, ["hot"])], "id long, e array<string>")
    c = related_components(df, "id", F.col("e")).toPandas().set_index("id")["component"]
    assert c.loc[0] == c.loc[299] and c.loc[900] != c.loc[901] and len(c) == 302
    assert related_components(df.limit(0), "id", F.col("e")).count() == 0


def test_split_shares_strata_and_stability(spark):
    rng = random.Random(2)
    rows, i = [], 0
    for g in range(800):
        for _ in range(1 + (400 if g == 0 else rng.randrange(6))):
            rows.append((i, [f"g{g}"], rng.choice(["a", "b", None])))
            i += 1
    df = spark.createDataFrame(rows, "id long, e array<string>, kind string").withColumns({"component": F.lit("x"), "split": F.lit("y"), "n": F.lit(1)})
    comp = related_components(df, "id", F.col("e"))
    run = lambda x, k: split_groups(x, comp, "id", F.col("kind"), {"train": 0.8, "val": 0.1, "test": 0.1}, groups_per_task=k)
    a = run(df, 100).toPandas().sort_values("id").reset_index(drop=True)
    assert a.equals(run(df.repartition(6), 100).toPandas().sort_values("id").reset_index(drop=True))
    assert (a.groupby("component")["split"].nunique() == 1).all()
    assert abs((a["split"] == "train").mean() - 0.8) < 0.02 and abs((a["split"] == "val").mean() - 0.1) < 0.02
    kinds = dict(zip([r[0] for r in rows], [r[2] or "unknown" for r in rows], strict=True))
    for k in ("a", "b", "unknown"):
        own = a[a["id"].map(kinds) == k]
        assert abs((own["split"] == "train").mean() - 0.8) < 0.05
    assert split_groups(df.limit(0), comp, "id", F.col("kind"), {"train": 1.0}).count() == 0
    with pytest.raises(ValueError):
        split_groups(df, comp, "id", F.col("kind"), {"train": -1.0})
