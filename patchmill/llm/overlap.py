"""Same or near-same records across splits: exact prefix-filter join of two sides on rare shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchmill.storage import Workspace

SETS = "key binary, in_eval boolean, in_train boolean, o array<bigint>"


def grams(c: Column, q: int) -> Column:
    """Distinct runs of q characters of c with its ends marked; shorter texts are one gram; NULL stays NULL."""
    s = F.concat(F.lit("^"), c, F.lit("$"))
    n = F.greatest(F.length(s) - q + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, F.lit(q))))


def word_shingles(c: Column, n: int = 5) -> Column:
    """Distinct runs of n words of c; a text with fewer words is one shingle; NULL and wordless texts give an empty array."""
    w = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    k = F.greatest(F.size(w) - n + 1, F.lit(1))
    out = F.array_distinct(F.transform(F.sequence(F.lit(1), k), lambda i: F.array_join(F.slice(w, i, n), " ")))
    return F.when(F.coalesce(F.size(w), F.lit(0)) > 0, out).otherwise(F.array().cast("array<string>"))


def rare_first(sets: DataFrame, counts: np.ndarray) -> DataFrame:
    """sets (key, in_eval, in_train, h) with o, the shingles of h from rare to frequent by the counts of hash buckets, then by themselves.

    One sort of each Arrow batch by (set, count, shingle); counts is a table of fixed size that goes along with the kernel.
    """
    table = sets.sparkSession.sparkContext.broadcast(counts)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = table.value
        for b in parts:
            h = b.column(3)
            flat = h.flatten().to_numpy(zero_copy_only=False)
            off = np.concatenate([[0], np.cumsum(np.diff(h.offsets.to_numpy()))]).astype("int32")
            row = np.repeat(np.arange(len(h)), np.diff(off))
            order = np.lexsort((flat, of[flat % len(of)], row))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.ListArray.from_arrays(pa.array(off), pa.array(flat[order]))], ["key", "in_eval", "in_train", "o"])

    return sets.select("key", "in_eval", "in_train", "h").mapInArrow(run, SETS)


def prefix_filter_pairs(ws: Workspace, sets: DataFrame, corpus: DataFrame, threshold: float, buckets: int = 1 << 18) -> DataFrame:
    """Pairs of classes of equal sets, one with a record of the evaluation side and one of the training side, of Jaccard similarity >= threshold.

    sets: (key, in_eval, in_train, h array<long> of distinct hashed shingles, not empty), one row for each distinct set; corpus: h of
    all records. Shingles are ordered from rare to frequent over the corpus, by the counts of ``buckets`` hash buckets and then by themselves: one order
    for all sets, in a table whose size is fixed, so it may be broadcast. A set's prefix holds n - ceil(t n) + 1 shingles, and two
    sets of enough similarity share one there. Prefixes of evaluation sets are the index, those of training sets probe it; lengths and
    positions bound the overlap before the sets themselves are compared. Nothing is capped.
    """
    t = threshold
    df = corpus.select(F.explode("h").alias("g")).groupBy(F.pmod("g", F.lit(buckets)).cast("int").alias("b")).agg(F.count("*").alias("n"))
    seen = df.toPandas()  # at most ``buckets`` rows
    counts = np.zeros(buckets, dtype="int64")
    counts[seen["b"].to_numpy(dtype="int64")] = seen["n"].to_numpy(dtype="int64")
    full = ws.cut(rare_first(sets, counts))
    n = F.size("o")
    prefix = full.select("key", "in_eval", "in_train", n.alias("n"), F.posexplode(F.slice("o", F.lit(1), (n - F.ceil(n * F.lit(t) - 1e-9) + 1).cast("int"))).alias("pos", "g"))
    e = prefix.where("in_eval").select(F.col("key").alias("key_e"), F.col("n").alias("n_e"), F.col("pos").alias("pos_e"), "g")
    r = prefix.where("in_train").select(F.col("key").alias("key_t"), F.col("n").alias("n_t"), F.col("pos").alias("pos_t"), "g")
    need = F.ceil((F.col("n_e") + F.col("n_t")) * F.lit(t / (1 + t)) - 1e-9)
    cand = (
        e.join(r, "g")
        .where((F.col("n_t") >= F.col("n_e") * F.lit(t) - 1e-9) & (F.col("n_e") >= F.col("n_t") * F.lit(t) - 1e-9))
        .where(1 + F.least(F.col("n_e") - F.col("pos_e") - 1, F.col("n_t") - F.col("pos_t") - 1) >= need)
        .select("key_e", "key_t")
        .distinct()
    )
    cand = ws.cut(cand)
    sets_of = full.select("key", F.col("o").alias("s"))
    both = cand.join(sets_of.select(F.col("key").alias("key_e"), F.col("s").alias("s_e")), "key_e").join(sets_of.select(F.col("key").alias("key_t"), F.col("s").alias("s_t")), "key_t")
    shared = F.size(F.array_intersect("s_e", "s_t"))
    return both.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.size("s_e") + F.size("s_t") - F.col("shared"))).where(F.col("similarity") >= t - 1e-9).select("key_e", "key_t", "shared", "similarity")


def cross_split_overlap(df: DataFrame, id_col: str, split_col: str, shingles: Column, *, threshold: float = 0.8, train: tuple[str, ...] = ("train",), evaluation: tuple[str, ...] = ("val", "test"), carry: tuple[str, ...] = (), unique: bool = False) -> tuple[DataFrame, DataFrame]:
    """Overlaps between evaluation and training splits: (links between classes, membership of records).

    shingles is an expression that gives each record's distinct shingles. Records with equal shingle sets form a class, so copies
    are joined once, however many there are. links: (key_e, key_t, shared, similarity). members: (id, split, key, carry...).
    Records of the same id count once (unique says that they already do); a NULL id, a NULL split, a split of neither side, NULL or
    empty shingles take no part. Empty tables give empty results; columns besides those named are ignored, so their names cannot
    clash.
    """
    ws = Workspace(df.sparkSession, "overlap")
    sides = F.col(id_col).isNotNull() & F.col(split_col).isin(*train, *evaluation)
    rows = df.where(sides)
    rows = rows if unique else rows.dropDuplicates([id_col, split_col])
    rows = rows.select(F.col(id_col).alias("id"), F.col(split_col).alias("split"), F.sort_array(F.transform(shingles, lambda x: F.xxhash64(x))).alias("h"), *[F.col(c).alias(f"c_{c}") for c in carry])
    half = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
    rows = ws.cut(rows).where(F.size("h") > 0).withColumn("key", F.unhex(F.concat(half("h"), half(F.lit(1), "h"))))
    sets = rows.groupBy("key").agg(F.max(F.col("split").isin(*evaluation)).alias("in_eval"), F.max(F.col("split").isin(*train)).alias("in_train"), F.first("h").alias("h"))
    links = prefix_filter_pairs(ws, sets, rows, threshold)
    return ws.cut(links), rows.drop("h")


def overlap_pairs(links: DataFrame, members: DataFrame, *, train: tuple[str, ...] = ("train",), evaluation: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """All pairs of records behind the links: evaluation record and training record with what members carries of each."""
    own = [c for c in members.columns if c != "key"]
    e = members.where(F.col("split").isin(*evaluation)).select(F.col("key").alias("key_e"), *[F.col(c).alias(f"{c}_e") for c in own])
    t = members.where(F.col("split").isin(*train)).select(F.col("key").alias("key_t"), *[F.col(c).alias(f"{c}_t") for c in own])
    return links.join(e, "key_e").join(t, "key_t")


def overlap_report(pairs: DataFrame, source_col: str, *also: str) -> DataFrame:
    """Counts of overlapping records for each evaluation split and source (NULL counts as ``unknown``), and by what else is named."""
    return pairs.groupBy(F.col("split_e").alias("split"), F.coalesce(F.col(source_col), F.lit("unknown")).alias("source"), *also).agg(
        F.countDistinct("id_e").alias("n_eval_records"), F.countDistinct("id_t").alias("n_train_records"), F.count("*").alias("n_pairs")
    )
