"""Score cutoffs that keep a target fraction of each group, by iterative refinement of histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchmill.storage import Workspace


def keep_cutoffs(df: DataFrame, fracs: DataFrame, id_col: str, group_cols: list[str], score_col: str, frac_on: str, bins: int = 1024, small: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """The cutoff of each group and the records it keeps: (report, kept).

    df has an id, group columns (NULL is a group of its own) and a score; rows of one id count once. fracs gives keep_frac for each
    value of the group column frac_on. A group's size counts all its ids, scored or not. The cutoff is one of the group's scores,
    infinite ones too, NULL and NaN never; it keeps scores >= cutoff, and of all such cutoffs the one is taken whose kept count
    divided by the size is nearest to keep_frac (of two equally near, the one that keeps more). Ties are kept or left together.
    A group without scores or without a fraction gets a NULL cutoff and keeps nothing; empty tables give empty results.

    Each round counts the scores of all groups into bins between the ends of their open ranges and goes on with the bin that
    holds the target rank. A bin whose least and greatest score agree is exact; ranges of at most ``small`` scores are
    finished by sorting just them. Other columns of df are ignored.
    """
    ws = Workspace(df.sparkSession, "cutoffs")
    g = [f"g{i}" for i in range(len(group_cols))]
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *[F.col(c).alias(a) for c, a in zip(group_cols, g, strict=True)], F.col(score_col).cast("double").alias("s")).dropDuplicates(["id"])
    rows = ws.cut(rows.withColumn("s", F.when(F.isnan("s"), None).otherwise(F.col("s"))).withColumn("gk", F.md5(F.to_json(F.struct(*g)))))
    on = g[group_cols.index(frac_on)]
    f = fracs.groupBy(F.col(frac_on).alias("f_on")).agg(F.max("keep_frac").alias("keep_frac"))
    inf = F.lit(float("inf"))
    finite = F.when(F.abs("s") < inf, F.col("s"))
    groups = rows.groupBy("gk").agg(*[F.first(c).alias(c) for c in g], F.count("*").alias("size"), F.count("s").alias("n_scored"), F.min("s").alias("least"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    groups = ws.cut(groups.join(f, F.col(on).eqNullSafe(F.col("f_on")), "left").drop("f_on").withColumn("want", F.col("keep_frac") * F.col("size")))
    # open: the groups in work; the range [lo, hi] of finite scores (a -inf or +inf score is a bin beside it), what lies above it.
    start = groups.where((F.col("n_scored") > 0) & F.col("want").isNotNull()).select("gk", "want", "lo", "hi", F.lit(None).cast("double").alias("rlo"), F.lit(None).cast("double").alias("rhi"), F.lit(0).cast("long").alias("above"), F.lit(None).cast("double").alias("next"))
    state, done = start, []
    while True:
        width = F.col("hi") / 2 - F.col("lo") / 2
        bin_ = F.when(F.col("s") == inf, bins).when(F.col("s") == -inf, -1).when(width <= 0, 0).otherwise(F.floor((F.col("s") / 2 - F.col("lo") / 2) / width * (bins - 1)))
        inside = rows.where("s is not null").join(state, "gk").where(F.col("rlo").isNull() | F.col("s").between(F.col("rlo"), F.col("rhi")))
        counts = inside.groupBy("gk", bin_.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("s").alias("mn"), F.max("s").alias("mx"), *[F.first(c).alias(c) for c in ("want", "above", "next")])
        down = Window.partitionBy("gk").orderBy(F.desc("bin"))
        c = counts.withColumn("cum", F.col("above") + F.sum("n").over(down)).withColumn("next", F.coalesce(F.lag("mn").over(down), "next")).withColumn("last", F.lead("bin").over(down).isNull())
        hit = c.where((F.col("cum") >= F.col("want")) | F.col("last")).withColumn("rk", F.row_number().over(down)).where("rk = 1")
        hit = ws.cut(hit.select("gk", "want", "n", "mn", "mx", "cum", (F.col("cum") - F.col("n")).alias("above"), "next"))
        done.append(hit.where("mn = mx").select("gk", "mn", "cum", "next", "above"))
        state = hit.where((F.col("mn") < F.col("mx")) & (F.col("n") > small)).select("gk", "want", F.col("mn").alias("lo"), F.col("mx").alias("hi"), F.col("mn").alias("rlo"), F.col("mx").alias("rhi"), "above", "next")
        rest = hit.where((F.col("mn") < F.col("mx")) & (F.col("n") <= small))
        v = rows.join(rest, "gk").where(F.col("s").between(F.col("mn"), F.col("mx"))).groupBy("gk", "s").agg(F.count("*").alias("k"), *[F.first(x).alias(x) for x in ("want", "above", "next")])
        down = Window.partitionBy("gk").orderBy(F.desc("s"))
        v = v.withColumn("cum", F.col("above") + F.sum("k").over(down)).withColumn("next", F.coalesce(F.lag("s").over(down), "next")).withColumn("last", F.lead("s").over(down).isNull())
        v = v.where((F.col("cum") >= F.col("want")) | F.col("last")).withColumn("rk", F.row_number().over(down)).where("rk = 1")
        done.append(v.select("gk", F.col("s").alias("mn"), "cum", "next", (F.col("cum") - F.col("k")).alias("above")))
        if state.isEmpty():
            break
    ends = done[0]
    for d in done[1:]:
        ends = ends.unionByName(d)
    r = groups.join(ends, "gk", "left")
    at = lambda n: F.abs(F.col(n) / F.col("size") - F.col("keep_frac"))
    higher = F.col("next").isNotNull() & (at("above") < at("cum"))
    r = r.withColumn("cutoff", F.when(higher, F.col("next")).otherwise(F.col("mn"))).withColumn("kept", F.coalesce(F.when(higher, F.col("above")).otherwise(F.col("cum")), F.lit(0)))
    r = ws.cut(r.select("gk", *[F.col(a).alias(c) for c, a in zip(group_cols, g, strict=True)], "size", "n_scored", "keep_frac", "cutoff", "kept"))
    kept = rows.join(r.where("cutoff is not null").select("gk", "cutoff"), "gk").where("s is not null and s >= cutoff").select(F.col("id").alias(id_col), *[F.col(a).alias(c) for c, a in zip(group_cols, g, strict=True)], F.col("s").alias(score_col))
    return r.drop("gk").withColumn("kept_frac", F.col("kept") / F.col("size")), kept
