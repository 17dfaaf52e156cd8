"""Deterministic samples, quotas, weights and shards over manifest rows."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchmill.errors import ConfigError
from patchmill.storage import Workspace, running_sums

SPLICE_KINDS = ("imdsplice", "casiasplice")
REAL_KINDS = ("imdreal", "casiareal", "indoorreal")


def is_splice(kind: str = "kind", kinds: tuple[str, ...] = SPLICE_KINDS) -> Column:
    return F.coalesce(F.col(kind).isin(*kinds), F.lit(False))


def is_real(kind: str = "kind", kinds: tuple[str, ...] = REAL_KINDS) -> Column:
    return F.coalesce(F.col(kind).isin(*kinds), F.lit(False))


def detection_label(kind: str = "kind") -> Column:
    """0 for real kinds, 1 for all others, NULL among them."""
    return F.when(is_real(kind), 0).otherwise(1)


def stable_key(*cols: str) -> Column:
    """MD5 of the fields joined by ``|``; a field that is there but NULL reads ``None``."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("None")) for c in cols or ("source", "kind", "case_id", "img")]))


def mix_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Rows by the columns, NULL as ``unknown``."""
    return df.groupBy(*[F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in cols]).agg(F.count("*").alias("n"))


def bottom_by_hash(df: DataFrame, n: int, seed: str, *, key: str = "img", all_when_not_positive: bool = False) -> DataFrame:
    """The n rows of least md5(seed|key); with all_when_not_positive, n <= 0 keeps everything, else nothing."""
    if n <= 0 and all_when_not_positive:
        return df
    h = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(key), F.lit(""))))
    return df.withColumn("_h", h).orderBy("_h", key, *[c for c in df.columns if c == "item_id"]).limit(max(n, 0)).drop("_h")


def hash_cut(df: DataFrame, h: str, want: int, most: int = 100_000) -> tuple[str, int]:
    """(prefix, rest): the want rows of least h are those whose h begins below prefix, and the rest first of those that begin with it.

    Found from counts by ever longer prefixes of three hexadecimal digits, until at most ``most`` rows share one: no task sorts all rows.
    """
    prefix, rest = "", want
    while True:
        k = len(prefix) + 3
        by = df.where(F.col(h).startswith(prefix)).groupBy(F.substring(h, 1, k).alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()  # 4096 rows at most
        for r in by:
            if r["n"] > rest:
                prefix = r["p"]
                break
            rest -= r["n"]
        else:
            return "~", 0  # all rows, as ~ comes after every digit
        if rest == 0 or r["n"] <= most or k >= 30:
            return prefix, rest


def least_by_hash(df: DataFrame, h: str, want: int, *ties: str) -> DataFrame:
    """The want rows of least h, ties by other columns."""
    if want <= 0:
        return df.limit(0)
    prefix, rest = hash_cut(df, h, want)
    head = F.substring(h, 1, len(prefix))
    below = df.where(head < prefix)
    if not rest:
        return below
    edge = df.where(head == prefix).withColumn("_r", F.row_number().over(Window.partitionBy(head).orderBy(h, *ties))).where(F.col("_r") <= rest).drop("_r")
    return below.unionByName(edge)


def reals_at_rate(df: DataFrame, rate: float, seed: str, *, key: str = "img") -> DataFrame:
    """A share of rows by hash, at least one; the count is rounded half to even."""
    n = df.count()
    x = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|reals|"), F.coalesce(F.col(key), F.lit("")))))
    return least_by_hash(x, "_h", max(1, round(n * rate)) if n else 0, key, *[c for c in df.columns if c == "item_id"]).drop("_h")


def holdout(df: DataFrame, key: str, frac: float, seed: str) -> DataFrame:
    """(key, side): the first floor(n * frac) distinct keys by md5(seed|key) are ``val``, the others ``train``."""
    return rank_split(df, key, frac, seed, first="val", then="train", whole=int)


def rank_split(df: DataFrame, key: str, frac: float, seed: str, *, first: str = "train", then: str = "val", whole: Callable[[float], int] = round) -> DataFrame:
    """(key, side): the first round(n * frac) distinct keys by md5(seed|key) are ``train``, the others ``val``; NULL keys have no side.

    Only keys that share the hash prefix at the cut are ranked.
    """
    ws = Workspace(df.sparkSession, "rank-split")
    k = ws.cut(df.select(F.col(key).alias("key")).where("key is not null").distinct().withColumn("h", F.md5(F.concat(F.lit(seed + "|"), F.col("key")))))
    prefix, rest = hash_cut(k, "h", whole(k.count() * frac))
    head = F.substring("h", 1, len(prefix))
    ranked = k.where(head == prefix).withColumn("rk", F.row_number().over(Window.partitionBy(head).orderBy("h", "key")))
    edge = ranked.select("key", F.when(F.col("rk") <= rest, first).otherwise(then).alias("side"))
    sure = k.where(head != prefix).select("key", F.when(head < prefix, first).otherwise(then).alias("side"))
    return sure.unionByName(edge).withColumnRenamed("key", key)


def shuffle_split(keys: list[str], val_frac: float, seed: int, *, most: int = 1_000_000) -> tuple[list[str], list[str]]:
    """(train, val) of a bounded list of keys by a seeded Mersenne shuffle of the sorted distinct keys, at least one of them in val."""
    if len(keys) > most:
        raise ConfigError(f"{len(keys)} keys are too many for the driver; use rank_split")
    ordered = sorted(set(keys))
    random.Random(seed).shuffle(ordered)
    n = max(1, int(len(ordered) * val_frac)) if ordered else 0
    return sorted(ordered[n:]), sorted(ordered[:n])


def quotas(counts: list[int], cap: int) -> list[int]:
    """How many of each group a stratified sample of cap takes.

    Every group gets the floor of its proportional part but at least 1 and at most all. Beyond cap, one pass from the least
    remainder up takes one from groups with more than one; below cap, groups from the greatest remainder down take all
    that they have room for. Groups must come in the order of their keys, which decides ties.
    """
    n = sum(counts)
    if cap <= 0 or n <= cap:
        return list(counts)
    exact = [cap * c / n for c in counts]
    q = [min(c, max(1, int(x))) for c, x in zip(counts, exact, strict=True)]
    rem = [x - int(x) for x in exact]
    order = sorted(range(len(counts)), key=lambda i: (rem[i], i))
    over = sum(q) - cap
    for i in order:
        if over <= 0:
            break
        if q[i] > 1:
            q[i] -= 1
            over -= 1
    short = cap - sum(q)
    for i in sorted(range(len(counts)), key=lambda i: (-rem[i], i)):
        if short <= 0:
            break
        more = min(counts[i] - q[i], short)
        q[i] += more
        short -= more
    return q


def stratified_cap(df: DataFrame, cap: int, groups: tuple[str, str] = ("source", "kind"), key: Column | None = None) -> DataFrame:
    """A sample of at most cap rows with all groups present, by the stable key within groups. The quota table has one row for each group."""
    g = [F.coalesce(F.col(c), F.lit("unknown")).alias(f"_g{i}") for i, c in enumerate(groups)]
    x = df.select("*", *g, (key if key is not None else stable_key()).alias("_k"))
    names = [f"_g{i}" for i in range(len(groups))]
    c = x.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).toPandas()
    q = quotas(c["n"].tolist(), cap)
    if c["n"].sum() <= cap or cap <= 0:
        return df
    table = df.sparkSession.createDataFrame(c[names].assign(quota=q), ", ".join(f"{n} string" for n in names) + ", quota long")
    # first within salted parts of each group, so that no task ever sorts a hot one
    order = ["_k", *[c for c in df.columns if c == "item_id"]]
    ranked = x.join(table, names).withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(64)))
    for by in ([*names, "_s"], names):
        ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r <= quota")
    return ranked.orderBy("_k").limit(cap).select(*df.columns)


def case_pairs(df: DataFrame, source: str, cases: int) -> DataFrame:
    """The first real and the first splice of each of the first ``cases`` cases of a source, cases by md5(source|case), rows by the stable key."""
    x = df.where(F.col("source") == source).withColumn("case_id", F.coalesce("case_id", F.lit("None")))
    chosen = x.select("case_id").distinct().withColumn("_h", F.md5(F.concat(F.lit(source + "|"), "case_id"))).orderBy("_h", "case_id").limit(max(cases, 0)).select("case_id")
    kind = F.when(F.col("kind") == "imdreal", "real").when(F.col("kind") == "imdsplice", "splice")
    y = x.join(chosen, "case_id").withColumn("_c", kind).where("_c is not null").withColumn("_k", stable_key())
    return y.withColumn("_r", F.row_number().over(Window.partitionBy("case_id", "_c").orderBy("_k", "item_id"))).where("_r = 1").drop("_c", "_k", "_r")


def first_per_source(df: DataFrame, singles: int, splices: int, sources: tuple[str, ...] = ("imd2020", "casia")) -> DataFrame:
    """Of each source the first singles (real kinds) and the first splices by the stable key."""
    side = F.when(F.col("kind").isin("imdreal", "indoorreal"), "single").when(F.col("kind") == "imdsplice", "splice")
    x = df.where(F.col("source").isin(*sources)).withColumn("_s", side).where("_s is not null").withColumn("_k", stable_key())
    r = F.row_number().over(Window.partitionBy("source", "_s").orderBy("_k", "item_id"))
    return x.withColumn("_r", r).where(F.col("_r") <= max(singles, splices, 0)).where(F.col("_r") <= F.when(F.col("_s") == "single", max(singles, 0)).otherwise(max(splices, 0))).drop("_s", "_k", "_r")


def class_weights(df: DataFrame, target: float = 0.5) -> DataFrame:
    """df with weight: each class's mass over its size; 1 for all where a class is absent. Class counts are a one-row aggregate, not a window over all rows."""
    t = min(1.0, max(0.0, target))
    n = df.agg(F.count_if(is_splice()).alias("ns"), F.count_if(~is_splice()).alias("nr")).first()
    if not n["ns"] or not n["nr"]:
        return df.withColumn("weight", F.lit(1.0))
    return df.withColumn("weight", F.when(is_splice(), F.lit(t / n["ns"])).otherwise(F.lit((1 - t) / n["nr"])))


def source_class_weights(df: DataFrame, fracs: dict[str, float], target: float = 0.5) -> DataFrame:
    """df with weight: splice mass shared out to sources by fracs (normalised; others get 0), real mass evenly; 1 for all where all would be 0."""
    t = min(1.0, max(0.0, target))
    total = sum(max(0.0, f) for f in fracs.values())
    f = {s: max(0.0, v) / total for s, v in fracs.items()} if total > 0 else {}
    share = F.lit(0.0)
    for s, v in f.items():
        share = F.when(F.col("_src") == s, F.lit(v)).otherwise(share)
    x = df.withColumn("_src", F.coalesce("source", F.lit("unknown"))).withColumn("_sp", is_splice())
    n = x.groupBy("_sp", F.when(F.col("_sp"), F.col("_src")).alias("_cell")).agg(F.count("*").alias("_n"))
    x = x.withColumn("_cell", F.when(F.col("_sp"), F.col("_src"))).alias("x").join(n.alias("n"), (F.col("x._sp") == F.col("n._sp")) & F.col("x._cell").eqNullSafe(F.col("n._cell"))).select("x.*", "_n")
    x = x.withColumn("weight", F.when(F.col("_sp"), F.lit(t) * share / F.col("_n")).otherwise(F.lit(1 - t) / F.col("_n")))
    if not (x.agg(F.max("weight")).first()[0] or 0) > 0:
        x = x.withColumn("weight", F.lit(1.0))
    return x.select(*df.columns, "weight")


def weighted_draws(df: DataFrame, id_col: str, weight: str, n: int, *, seed: int, epoch: int = 0, replicas: int = 1, per_part: int = 50_000) -> DataFrame:
    """(draw, id, shard): n draws with replacement in proportion to weight, the same for any order of rows; rows of weight 0 are never drawn.

    How many of the draws fall to each part of the rows (parts by hash, of some ``per_part`` rows) is one multinomial draw; each part
    then draws its own. Draws are numbered through the parts and dealt out to replicas in turn, the last round filled up from the head.
    """
    x = df.where(F.col(weight) > 0).select(F.col(id_col).alias("id"), F.col(weight).cast("double").alias("w"))
    parts = max(1, -(-x.count() // per_part))
    x = x.withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)))
    sums = x.groupBy("part").agg(F.sum("w").alias("s")).orderBy("part").toPandas()
    if not len(sums):
        raise ConfigError("weights must sum to more than 0")
    share = sums["s"].to_numpy() / sums["s"].sum()
    own = np.random.default_rng([seed, epoch]).multinomial(n, share)
    todo = pd.DataFrame({"part": sums["part"], "_n": own, "_at": np.cumsum(own) - own})
    id_type = df.schema[id_col].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        rng = np.random.default_rng([seed, epoch, 1 + int(key[0])])
        up = np.cumsum(pdf["w"].to_numpy())
        at = np.minimum(np.searchsorted(up, rng.random(int(pdf["_n"].iloc[0])) * up[-1], side="right"), len(up) - 1)
        return pd.DataFrame({"draw": np.arange(len(at)) + int(pdf["_at"].iloc[0]), "id": pdf["id"].to_numpy()[at]})

    table = df.sparkSession.createDataFrame(todo, "part long, _n long, _at long")
    d = x.join(F.broadcast(table), "part").groupBy("part").applyInPandas(run, f"draw long, id {id_type}")
    pad = -n % replicas
    if pad:
        d = d.withColumn("draw", F.explode(F.when(F.col("draw") < pad, F.array("draw", F.col("draw") + n)).otherwise(F.array("draw"))))
    return d.withColumn("shard", (F.col("draw") % replicas).cast("int"))


def shards(df: DataFrame, order: list[str], replicas: int) -> DataFrame:
    """df with shard: position in the given order modulo replicas, found from counts by range partition instead of one global window."""
    ws = Workspace(df.sparkSession, "shards")
    x = ws.cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    before = x.groupBy("_p").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = before.withColumn("_b", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    r = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return x.withColumn("_r", r).join(F.broadcast(before), "_p").withColumn("shard", ((F.col("_r") - 1 + F.col("_b")) % replicas).cast("int")).drop("_p", "_r", "_b")


def with_epoch_subset(df: DataFrame, id_col: str, cap: int, replicas: int, seed: int, epoch: int) -> DataFrame:
    """(id, shard, pos): cap rows in an order that changes with the epoch, dealt out to replicas; the head fills up the last round."""
    ws = Workspace(df.sparkSession, "epoch-subset")
    h = F.md5(F.concat(F.lit(f"{seed}|{epoch}|"), F.col(id_col).cast("string")))
    top = ws.cut(least_by_hash(df.select(F.col(id_col)).where(F.col(id_col).isNotNull()).withColumn("_h", h), "_h", cap, id_col).withColumn("_one", F.lit(1).cast("long")))
    n = top.count()
    x = running_sums(top, [], [F.col("_h").asc(), F.col(id_col).asc()], {"pos": "_one"}).withColumn("pos", F.col("pos") - 1)
    pad = -n % replicas
    if pad:
        x = x.withColumn("pos", F.explode(F.when(F.col("pos") < pad, F.array("pos", F.col("pos") + n)).otherwise(F.array("pos"))))
    return x.select(id_col, (F.col("pos") % replicas).cast("int").alias("shard"), "pos")


def loader_plan(df: DataFrame, id_col: str, *, batch: int, replicas: int = 1, epoch_size: int | None = None, weight: str | None = None, shuffle: bool = True, drop_last: bool = True, seed: int = 0, epoch: int = 0) -> DataFrame:
    """(id, shard, batch_no, place): which replica reads each record of an epoch, and where.

    With weight the epoch is drawn by weight, with replacement; else it is a random part of epoch_size rows or all of them; without
    shuffle all rows in the order of their ids, for evaluation. drop_last leaves out a last batch that is not full.
    """
    if batch < 1 or replicas < 1:
        raise ConfigError("batch and replicas must be at least 1")
    n = df.count()
    if weight:
        x = weighted_draws(df, id_col, weight, epoch_size or n, seed=seed, epoch=epoch, replicas=replicas).select(F.col("id").alias(id_col), "shard", F.col("draw").alias("pos"))
    elif shuffle:
        x = with_epoch_subset(df, id_col, min(epoch_size or n, n), replicas, seed, epoch)
    else:
        one = Workspace(df.sparkSession, "loader").cut(df.select(id_col).where(F.col(id_col).isNotNull()).withColumn("_one", F.lit(1).cast("long")))
        x = running_sums(one, [], F.col(id_col).asc(), {"pos": "_one"}).withColumn("pos", F.col("pos") - 1)
        x = x.select(id_col, (F.col("pos") % replicas).cast("int").alias("shard"), "pos")
    k = F.floor(F.col("pos") / replicas)
    x = x.select(id_col, "shard", F.floor(k / batch).cast("int").alias("batch_no"), (k % batch).cast("int").alias("place"))
    if not drop_last:
        return x
    full = x.groupBy("shard", "batch_no").agg(F.count("*").alias("_n")).where(F.col("_n") == batch).select("shard", "batch_no")
    return x.join(full, ["shard", "batch_no"], "left_semi").select(id_col, "shard", "batch_no", "place")


def capped_subset(df: DataFrame, cap: int | None, val_frac: float, seed: str, *, key: str = "img") -> DataFrame:
    """df with split: at most cap rows by hash (all where cap is None), of which a share, one row at least, is val."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key), F.lit(""))))
    x = df.withColumn("_h", h)
    x = Workspace(df.sparkSession, "subset").cut(x if cap is None else least_by_hash(x, "_h", cap, key))
    n = x.count()
    prefix, rest = hash_cut(x, "_h", max(1, int(n * val_frac)) if n else 0)
    head = F.substring("_h", 1, len(prefix))
    edge = x.where(head == prefix).withColumn("_r", F.row_number().over(Window.partitionBy(head).orderBy("_h", key)))
    edge = edge.withColumn("split", F.when(F.col("_r") <= rest, "val").otherwise("train")).drop("_r")
    return x.where(head != prefix).withColumn("split", F.when(head < prefix, "val").otherwise("train")).unionByName(edge).drop("_h")
