"""Forward values of training losses as aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchmill.operators.cluster import per_image, similarities


def bce(logit: Column, target: Column, pos_weight: float = 1.0) -> Column:
    """Binary cross entropy with logits, in the form that doesn't overflow."""
    t = target.cast("double")
    lw = 1 + (pos_weight - 1) * t
    return (1 - t) * logit + lw * (F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0)))


def image_losses(df: DataFrame, key: str, logit: str, target: str, *, weight: str | None = None, pos_weight: float = 1.0) -> DataFrame:
    """(key, loss, patches): each image's weighted mean over its patches, the weight sum at least 1."""
    w = F.least(F.greatest(F.col(weight), F.lit(0.0)), F.lit(1.0)) if weight else F.lit(1.0)
    return df.groupBy(key).agg((F.sum(bce(F.col(logit), F.col(target), pos_weight) * w) / F.greatest(F.sum(w), F.lit(1.0))).alias("loss"), F.count("*").alias("patches"))


def batch_loss(per_image: DataFrame, weight: Column | None = None) -> DataFrame:
    """One row: the mean of image losses, weighted with the weight sum at least 1."""
    w = weight if weight is not None else F.lit(1.0)
    return per_image.agg((F.sum(F.col("loss") * w) / F.greatest(F.sum(w), F.lit(1.0))).alias("loss"), F.count("*").alias("n_active"))


def consistency(df: DataFrame, clean: str, aug: str) -> DataFrame:
    """Mean squared difference of probabilities."""
    sig = lambda c: 1 / (1 + F.exp(-F.col(c)))
    return df.agg(F.avg(F.pow(sig(clean) - sig(aug), F.lit(2.0))).alias("loss"))


def symmetric_contrastive(p: DataFrame, lab: str, *, tau_pos: float = 0.55, tau_neg: float = 0.2, repel: float = 1.0, power: float = 0.5, norm_power: float = 1.0) -> DataFrame:
    """(image_id, a_in, a_out, r, loss): cohesion inside and outside the region and separation across it.

    A term is its violation sum over a blend of violating and all pairs (both at least 1); the two cohesions are weighted by a power of the
    region's share.
    """

    def fn(image, z, pdf):
        sim, m = similarities(z), pdf[lab].to_numpy() == 1
        other = ~np.eye(len(z), dtype=bool)

        def term(pairs: np.ndarray, v: np.ndarray) -> float:
            x = np.maximum(v[pairs & other], 0.0)
            return float(x.sum()) / (max((x > 0).sum(), 1) ** norm_power * max(len(x), 1) ** (1 - norm_power))

        a, b, r = term(np.outer(m, m), tau_pos - sim), term(np.outer(~m, ~m), tau_pos - sim), term(m[:, None] != m, sim - tau_neg)
        wi, wo = m.mean() ** power, (1 - m.mean()) ** power
        return pd.DataFrame([(image, a, b, r, (wi * a + wo * b) / max(wi + wo, 1e-6) + repel * r)], columns=["image_id", "a_in", "a_out", "r", "loss"])

    return per_image(p, fn, "image_id long, a_in double, a_out double, r double, loss double", lab)


def hinge_contrastive(p: DataFrame, lab: str, *, neg_margin: float = 0.3, repel: float = 1.0) -> DataFrame:
    """(image_id, attract, repel, loss): attraction to similarity 1 averaged over the regions that have pairs, repulsion above a margin across them."""

    def fn(image, z, pdf):
        sim, m = similarities(z), pdf[lab].to_numpy()
        other = ~np.eye(len(z), dtype=bool)
        pull, push = np.maximum(1 - sim, 0.0), np.maximum(sim - neg_margin, 0.0)
        own = [pull[np.outer(m == k, m == k) & other] for k in np.unique(m)]
        across = push[m[:, None] != m]
        a = float(np.mean([x.mean() for x in own if len(x)])) if any(len(x) for x in own) else 0.0
        r = float(across.mean()) if len(across) else 0.0
        return pd.DataFrame([(image, a, r, a + repel * r)], columns=["image_id", "attract", "repel", "loss"])

    return per_image(p, fn, "image_id long, attract double, repel double, loss double", lab)


def active_images(p: DataFrame, lab: str, active: DataFrame | None = None) -> DataFrame:
    """Patches of the images that take part in a contrastive loss: those that active (image_id) names, if given, and that have both labels."""
    both = p.groupBy("image_id").agg(F.countDistinct(lab).alias("n")).where("n > 1").select("image_id")
    x = p.join(both, "image_id", "left_semi")
    return x if active is None else x.join(active.select("image_id").distinct(), "image_id", "left_semi")


def loss_summary(per_image: DataFrame) -> DataFrame:
    """One row: the mean of each part of image losses and the number of images; 0 everywhere where there are none."""
    parts = [c for c in per_image.columns if c != "image_id"]
    return per_image.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in parts], F.count("*").alias("n_active"))
