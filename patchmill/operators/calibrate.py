"""Adaptive thresholds of the values of an image: gaps, Otsu, outliers, embedding outlier scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchmill.errors import ConfigError


def gap_threshold(df: DataFrame, key: str, value: str, *, upper_half: bool = False) -> DataFrame:
    """(key, threshold): the middle of the widest gap between neighbours in order (the first of equal ones).

    With fewer than three values the threshold is the greatest plus one, so nothing lies above. upper_half looks only at values at or above the
    median.
    """
    x = df.select(key, F.col(value).cast("double").alias("v")).where("v is not null")
    if upper_half:
        x = x.join(x.groupBy(key).agg(F.median("v").alias("m")), key).where("v >= m").drop("m")
    w = Window.partitionBy(key).orderBy("v")
    x = x.withColumns({"next": F.lead("v").over(w), "pos": F.row_number().over(w)})
    g = x.groupBy(key).agg(F.count("*").alias("n"), F.max("v").alias("top"), F.max_by(F.struct("v", "next"), F.struct(F.coalesce(F.col("next") - F.col("v"), F.lit(-1.0)), -F.col("pos"))).alias("b"))
    return g.select(key, F.when(F.col("n") < 3, F.col("top") + 1).otherwise((F.col("b.v") + F.col("b.next")) / 2).alias("threshold"))


def otsu_threshold(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, threshold): the cut of greatest variance between both sides, the middle of its neighbours; greatest plus one for fewer than two values."""
    x = df.select(key, F.col(value).cast("double").alias("v")).where("v is not null")
    w = Window.partitionBy(key).orderBy("v")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(key)
    x = x.withColumns({"i": F.row_number().over(w), "s": F.sum("v").over(run), "n": F.count("*").over(all_), "t": F.sum("v").over(all_), "next": F.lead("v").over(w), "top": F.max("v").over(all_)})
    i, n = F.col("i").cast("double"), F.col("n").cast("double")
    gap = F.col("s") / i - F.try_divide(F.col("t") - F.col("s"), n - i)
    x = x.withColumn("score", F.when(F.col("next").isNotNull(), i * (n - i) * gap * gap).otherwise(-1.0))
    b = x.groupBy(key).agg(F.first("n").alias("n"), F.first("top").alias("top"), F.max_by(F.struct("v", "next"), F.struct(F.round("score", 9), -F.col("i"))).alias("b"))
    return b.select(key, F.when(F.col("n") < 2, F.col("top") + 1).otherwise((F.col("b.v") + F.col("b.next")) / 2).alias("threshold"))


def mad_outliers(df: DataFrame, key: str, value: str, k: float = 3.0) -> DataFrame:
    """(key, frac): share of values above median + k * 1.4826 * MAD (at least 1e-6)."""
    x = df.select(key, F.col(value).cast("double").alias("v")).where("v is not null")
    m = x.groupBy(key).agg(F.median("v").alias("m"))
    y = x.join(m, key)
    a = y.groupBy(key).agg(F.median(F.abs(F.col("v") - F.col("m"))).alias("a"))
    y = y.join(a, key)
    return y.groupBy(key).agg(F.avg((F.col("v") > F.col("m") + k * F.greatest(F.col("a") * 1.4826, F.lit(1e-6))).cast("double")).alias("frac"))


def vector_mean(df: DataFrame, *keys: str, vec: str = "z") -> DataFrame:
    """(keys, n, total): sums of vectors, added up whole in partial aggregates; NULL vectors are left out."""
    m = Summarizer.metrics("sum", "count").summary(array_to_vector(vec)).alias("m")
    return df.where(F.col(vec).isNotNull()).groupBy(*keys).agg(m).select(*keys, F.col("m.count").alias("n"), vector_to_array("m.sum").alias("total"))


def dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def gap_of(values: np.ndarray) -> float:
    """The middle of the widest gap between neighbours in order; the greatest plus one for fewer than three values."""
    v = np.sort(values)
    if len(v) < 3:
        return float(v[-1] + 1) if len(v) else np.inf
    i = int(np.argmax(np.diff(v)))
    return float(v[i] + v[i + 1]) / 2


def outlier_scores(patches: DataFrame, mode: str = "median") -> DataFrame:
    """(image_id, idx, score): one minus the cosine to the mean of the image's background.

    The background are patches whose attention is at most its median or, in mode ``gap``, below its widest gap; all patches where
    there are none or any attention is missing.
    """
    if mode not in ("median", "gap"):
        raise ConfigError(f"unknown mode {mode!r}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, att = np.stack(pdf["z"].to_numpy()), pdf["attention"].to_numpy(dtype=float)
        z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        back = att < gap_of(att) if mode == "gap" else att <= np.median(att)
        mean = z[back].mean(0) if back.any() and not np.isnan(att).any() else z.mean(0)
        return pd.DataFrame({"image_id": pdf["image_id"], "idx": pdf["idx"], "score": 1 - z @ (mean / max(np.linalg.norm(mean), 1e-12))})

    return patches.select("image_id", "idx", "z", "attention").groupBy("image_id").applyInPandas(run, "image_id long, idx int, score double")


def outlier_gap(df: DataFrame, key: str, side: str, score: str) -> DataFrame:
    """(key, out_gap): median score of the side 1 less that of the side 0; NULL where a side is empty."""
    m = lambda v: F.median(F.when(F.col(side) == v, F.col(score)))
    return df.groupBy(key).agg((m(1) - m(0)).alias("out_gap"))


def offdiagonal_similarity(patches: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, coherence): mean cosine of distinct unit vectors, from the length of their sum; NaN for fewer than two."""
    s = vector_mean(patches, *keys)
    n = F.col("n").cast("double")
    return s.select(*keys, "n", F.when(F.col("n") > 1, (dot("total", "total") - n) / (n * (n - 1))).otherwise(F.lit(float("nan"))).alias("coherence"))


def cluster_separation(patches: DataFrame, key: str, side: str) -> DataFrame:
    """(key, separation): one minus the cosine between the mean vectors of both sides of a 0/1 column; images with one side only are left out."""
    s = vector_mean(patches, key, side)
    a, b = s.where(F.col(side) == 1).select(key, F.col("total").alias("a")), s.where(F.col(side) == 0).select(key, F.col("total").alias("b"))
    return a.join(b, key).select(key, (1 - dot("a", "b") / (F.sqrt(dot("a", "a")) * F.sqrt(dot("b", "b")))).alias("separation"))
