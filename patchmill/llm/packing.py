"""Filling containers of fixed capacity: minimum bin slack by a bitset subset-sum over the multiset of remaining lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchmill.errors import ConfigError
from patchmill.storage import Workspace

MOST_LIMITS = 1000


def fullest(lengths: list[int], counts: list[int], room: int) -> dict[int, int]:
    """The multiset of at most counts[i] of lengths[i] whose sum comes closest to room from below, as length -> count.

    One bit for each sum that can be reached; a length with c copies goes in as 1, 2, 4 ... of them, so that all counts up to c are
    reached in few shifts. The bitsets after each part are kept and walked backwards for the counts.
    """
    mask = (1 << (room + 1)) - 1
    reach = 1
    parts: list[tuple[int, int, int]] = []
    for x, c in zip(lengths, counts, strict=True):
        c = min(c, room // x) if x <= room else 0
        k = 1
        while c > 0:
            k = min(k, c)
            new = (reach | (reach << (k * x))) & mask
            if new != reach:
                parts.append((x, k, reach))
                reach = new
            c -= k
            k *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    out: dict[int, int] = {}
    for x, k, before in reversed(parts):
        if best and not before >> best & 1:
            out[x] = out.get(x, 0) + k
            best -= k * x
    return out


def fill(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item of a window, all lengths in 1..capacity: the longest item left, then the multiset that fills its container best.

    A filling is used again as often as what is left allows, so that windows of many equal lengths take few steps.
    """
    order = np.argsort(-lengths, kind="stable")
    at = {int(x): order[i:j].tolist() for x, i, j in _runs(lengths[order])}
    out = np.full(len(lengths), -1, dtype=np.int64)
    left = sorted(at, reverse=True)
    box = 0
    while left:
        longest = left[0]
        at_longest = len(at[longest])
        pick = fullest(left, [len(at[x]) - (x == longest) for x in left], capacity - longest)
        pick[longest] = pick.get(longest, 0) + 1
        times = max(1, min(len(at[x]) // k for x, k in pick.items())) if at_longest else 1
        for _ in range(times):
            for x, k in pick.items():
                for _ in range(k):
                    out[at[x].pop()] = box
            box += 1
        left = [x for x in left if at[x]]
    return out


def _runs(sorted_desc: np.ndarray):
    """(value, start, end) of the runs of equal values."""
    if not len(sorted_desc):
        return
    cut = np.flatnonzero(np.diff(sorted_desc)) + 1
    for i, j in zip([0, *cut], [*cut, len(sorted_desc)], strict=True):
        yield sorted_desc[i], int(i), int(j)


def pack(items: DataFrame, limits: DataFrame, *, seed: int = 0, window: int = 20_000) -> DataFrame:
    """(limit_name, doc_id, piece, pieces, start, tokens, container): each item in a container of each limit.

    items: doc_id (unique), tokens; limits: limit_name, capacity_tokens (at most a thousand; rows without a name or a positive
    capacity are left out). An item is whole unless it alone exceeds the capacity; then it is cut into full containers and one rest, which
    is packed like any other. Items without tokens (or NULL) get piece 1 with container NULL: they take no room. NULL ids are
    left out. Items are spread over windows of about ``window`` by a hash of their id, one task each; every window leaves one
    container that isn't full at most, so larger windows waste less and smaller ones run wider. The longest tasks are bounded by it.
    """
    ws = Workspace(items.sparkSession, "pack")
    rows = ws.cut(items.where("doc_id is not null").select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("size")).withColumn("h", F.xxhash64("doc_id", F.lit(seed))))
    n = rows.count()
    k = max(1, -(-n // window))
    lim = limits.where("limit_name is not null and capacity_tokens > 0").select("limit_name", F.col("capacity_tokens").cast("long").alias("cap")).distinct().limit(MOST_LIMITS + 1).collect()
    if len(lim) > MOST_LIMITS:
        raise ConfigError(f"more than {MOST_LIMITS} limits")
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("limit_name"), F.lit(b).cast("long").alias("cap")) for a, b in lim or [("", 0)]])).alias("l")
    x = rows.select("doc_id", "h", "size", each).select("l.*", "doc_id", "h", "size").where("cap > 0").withColumn("pieces", F.greatest(F.ceil(F.col("size") / F.col("cap")), F.lit(1)).cast("long"))
    x = x.select("limit_name", "cap", "doc_id", "h", "size", "pieces", F.explode(F.sequence(F.lit(1).cast("long"), "pieces")).alias("piece"))
    x = x.withColumn("start", (F.col("piece") - 1) * F.col("cap")).withColumn("tokens", F.least("cap", F.col("size") - F.col("start"))).drop("size")
    full = (F.col("tokens") == F.col("cap")) | (F.col("tokens") <= 0)
    alone = F.when(F.col("tokens") > 0, F.concat_ws("-", F.lit("f"), F.col("doc_id").cast("string"), F.col("piece").cast("string")))
    columns = ["limit_name", "doc_id", "piece", "pieces", "start", "tokens"]
    ready = x.where(full).select(*columns, alone.alias("container"))
    id_type = items.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id"], ignore_index=True)
        box = fill(pdf["tokens"].to_numpy(), int(pdf["cap"].iloc[0]))
        return pdf[columns].assign(container=[f"w{key[1]}-{b}" for b in box])

    open_ = x.where(~full).withColumn("win", F.pmod("h", F.lit(k)))
    packed = open_.groupBy("limit_name", "win").applyInPandas(run, f"limit_name string, doc_id {id_type}, piece long, pieces long, start long, tokens long, container string")
    return ready.unionByName(packed)


def pack_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Containers, tokens and unused share of each limit."""
    boxes = packed.where("container is not null").groupBy("limit_name", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("k"))
    s = boxes.groupBy("limit_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.sum("k").alias("pieces"), F.max("t").alias("fullest"))
    return s.join(limits.select("limit_name", "capacity_tokens").distinct(), "limit_name").withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
