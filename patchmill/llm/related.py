"""Splits that keep related records together: minimum-label propagation over records and entities, then stratified assignment of groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchmill.errors import ConfigError
from patchmill.storage import Workspace

MOST_STRATA = 2000


def related_components(df: DataFrame, id_col: str, entities: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, component, carry...): the connected component of each record in the graph of records and entities.

    entities is an array expression; NULL elements are ignored, and a record without entities is a component of its own, named by its
    id. Rows of one id count once; a NULL id is dropped. Only distinct entity sets of two or more join anything, and of their
    entities those in several sets: the iteration runs over these alone, so an entity that a third of all rows share is one node with
    one label. Labels go from entity to set and back as minima, with a jump to the label's own label each round, until none changes;
    then each set, and what else it holds, takes its label. The minimum of an entity is built up by partial aggregation; nothing is
    collected.
    """
    ws = Workspace(df.sparkSession, "related")
    rows = df.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).select(F.col(id_col).alias("id"), entities.alias("e"), *[F.col(c).alias(f"c_{c}") for c in carry])
    rows = ws.cut(rows.withColumn("e", F.array_sort(F.array_distinct(F.filter("e", lambda x: x.isNotNull())))))
    sets = rows.where(F.size("e") > 1).select("e").distinct()
    # a set is named by its entities: a hash could make two sets one
    every = ws.cut(sets.select(F.md5(F.to_json("e")).alias("set"), F.explode("e").alias("entity")))
    links = ws.cut(every.join(every.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1"), "entity", "left_semi"))
    labels = ws.cut(links.groupBy("entity").agg(F.min("entity").alias("label")))
    while True:
        of_set = links.join(labels, "entity").groupBy("set").agg(F.min("label").alias("label"))
        near = links.join(of_set, "set").groupBy("entity").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("entity").alias("near"), F.col("label").alias("far"))
        new = near.join(jump, "near").select("entity", F.least("near", "far").alias("new"))
        step = ws.cut(labels.join(new, "entity").select("entity", F.least("label", "new").alias("label"), (F.col("new") < F.col("label")).alias("changed")))
        changed = not step.where("changed").isEmpty()
        ws.drop(labels)
        labels = step.drop("changed")
        if not changed:
            break
    of_set = every.join(labels, "entity", "left").groupBy("set").agg(F.coalesce(F.min("label"), F.min("entity")).alias("label"))
    known = every.join(of_set, "set").groupBy("entity").agg(F.min("label").alias("label"))
    first = rows.withColumn("entity", F.when(F.size("e") > 0, F.element_at("e", 1)))
    out = first.join(known, "entity", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("label", "entity", F.concat(F.lit("id:"), F.col("id").cast("string"))).alias("component"), *[F.col(f"c_{c}").alias(c) for c in carry])


def _assign(sizes: np.ndarray, target: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Split of each group, greatest first: where the squared deviation from target (splits x strata), over the target, stays least."""
    have = start.astype(float).copy()
    scale = 1 / np.maximum(target, 1.0)
    out = np.empty(len(sizes), dtype=np.int64)
    for i, x in enumerate(sizes):
        cost = ((2 * (have - target) * x + x * x) * scale).sum(1)
        room = (have.sum(1) - target.sum(1)) / max(target.sum(), 1.0)
        k = int(np.argmin(cost + 1e-9 * room))
        have[k] += x
        out[i] = k
    return out


def split_groups(df: DataFrame, components: DataFrame, id_col: str, stratum: Column, shares: dict[str, float], *, seed: int = 0, groups_per_task: int = 20_000) -> DataFrame:
    """(id, component, split): every component in one split, split sizes and the strata within them near their shares.

    shares are normalised. Groups larger than a thousandth of all records (at most a thousand of them) are placed first, in one
    task; the others are spread over tasks by a hash, each placing its groups greatest first against its part of what is then
    still due. A NULL stratum is a stratum ``unknown``; there may be 2,000 strata. The result depends on ids and seed, not on the order of rows.
    """
    ws = Workspace(df.sparkSession, "splits")
    names = list(shares)
    p = np.array([shares[n] for n in names], float)
    if (p < 0).any() or p.sum() <= 0:
        raise ValueError("shares must not be negative and must not all be 0")
    p = p / p.sum()
    rows = df.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).select(F.col(id_col).alias("id"), F.coalesce(stratum.cast("string"), F.lit("unknown")).alias("stratum")).join(components.select(F.col(id_col).alias("id"), "component"), "id")
    cells = ws.cut(rows.groupBy("component", "stratum").agg(F.count("*").alias("n")))
    totals = {r["stratum"]: r["n"] for r in cells.groupBy("stratum").agg(F.sum("n").alias("n")).limit(MOST_STRATA + 1).collect()}
    if len(totals) > MOST_STRATA:
        raise ConfigError(f"more than {MOST_STRATA} strata; choose a coarser stratum")
    strata = sorted(totals)
    total = sum(totals.values())
    if not total:
        return df.sparkSession.createDataFrame([], df.select(id_col).schema.add("component", "string").add("split", "string"))
    due = p[:, None] * np.array([totals[s] for s in strata], float)[None, :]
    at = {s: i for i, s in enumerate(strata)}

    def place(pdf: pd.DataFrame, target: np.ndarray) -> pd.DataFrame:
        wide = np.zeros((pdf["component"].nunique(), len(strata)))
        codes, keys = pd.factorize(pdf["component"], sort=True)
        np.add.at(wide, (codes, pdf["stratum"].map(at).to_numpy()), pdf["n"].to_numpy())
        order = np.lexsort((pd.util.hash_array(np.array([f"{seed}|{k}" for k in keys], dtype=object)), -wide.sum(1)))
        got = np.empty(len(keys), dtype=object)
        got[order] = np.array(names, dtype=object)[_assign(wide[order], target, np.zeros_like(target))]
        return pd.DataFrame({"component": keys, "split": got})

    sums = cells.groupBy("component").agg(F.sum("n").alias("size"), F.count("*").alias("k"))
    large = cells.join(sums.where(F.col("size") > total / 1000), "component", "left_semi")
    first = place(large.toPandas(), due)
    schema = "component string, split string"
    spark = df.sparkSession
    placed = spark.createDataFrame(first, schema)
    got = large.join(placed, "component").groupBy("split", "stratum").agg(F.sum("n").alias("n")).collect()
    for r in got:
        due[names.index(r["split"]), at[r["stratum"]]] -= r["n"]
    due = np.maximum(due, 0)
    rest = cells.join(sums.where(F.col("size") <= total / 1000).select("component"), "component", "left_semi")
    tasks = max(1, -(-sums.count() // groups_per_task))
    part = rest.withColumn("task", F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(tasks)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        # what is due of each stratum is shared out by what the task has of it
        own = np.zeros(len(strata))
        np.add.at(own, pdf["stratum"].map(at).to_numpy(), pdf["n"].to_numpy())
        share = due / np.maximum(due.sum(0), 1e-9)
        return place(pdf.drop(columns="task"), share * own)

    assigned = ws.cut(placed.unionByName(part.groupBy("task").applyInPandas(one, schema)))
    return rows.join(assigned, "component").select(F.col("id").alias(id_col), "component", "split")
