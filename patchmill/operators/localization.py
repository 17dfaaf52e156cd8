"""Localization samples: how well each image's decoded patches meet its mask, and how its embeddings lie; the rows that the reports read."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchmill.functions.tiers import size_bucket
from patchmill.operators.calibrate import gap_of
from patchmill.operators.cluster import DecodeSpec, _chosen, graph_of, per_image, silhouette_of, spherical_kmeans

FIELDS = (
    ["area"] + [f"{m}_{k}" for k in ("full", "gap", "swin") for m in ("f1", "iou", "prec", "rec", "pred_frac")] + ["f1_full_deployed", "iou_full_deployed"]
    + ["pos_coh", "bg_coh", "cent_sep", "out_gap", "frac_outliers_mad", "frac_outliers_03", "frac_outliers_05", "sil_k2", "sil_k3", "sil_k4"]
)
SCHEMA = "image_id long, " + ", ".join(f"{f} double" for f in FIELDS) + ", polarity_agree boolean, best_k int"


def scores_of(pred: np.ndarray, gt: np.ndarray) -> tuple[float, float, float, float, float]:
    """(f1, iou, precision, recall, share) of a predicted mask; 0 where a denominator is."""
    tp, p, g = float((pred & gt).sum()), float(pred.sum()), float(gt.sum())
    over = lambda a, b: a / b if b else 0.0
    return over(2 * tp, p + g), over(tp, p + g - tp), over(tp, p), over(tp, g), over(p, len(pred))


def coherence(z: np.ndarray) -> float:
    """Mean cosine of distinct vectors, from the length of their sum; NaN for fewer than two."""
    n = len(z)
    return float((z.sum(0) @ z.sum(0) - n) / (n * (n - 1))) if n > 1 else float("nan")


def background_distance(z: np.ndarray, attention: np.ndarray | None) -> np.ndarray:
    """One minus the cosine to the mean of the patches whose attention is at most its median, of all patches without attention."""
    back = z if attention is None else z[attention <= np.median(attention)]
    mean = (back if len(back) else z).mean(0)
    return 1 - z @ (mean / max(np.linalg.norm(mean), 1e-12))


def upper_gap(score: np.ndarray) -> np.ndarray:
    """Scores above the widest gap of those at or above the median; none where that half has fewer than three."""
    upper = score[score >= np.median(score)]
    return score >= gap_of(upper) if len(upper) > 2 else np.zeros(len(score), bool)


def sample_of(z: np.ndarray, gt: np.ndarray, attention: np.ndarray | None, pdf: pd.DataFrame, spec: DecodeSpec, swin: np.ndarray | None) -> dict:
    """The fields of one image's sample."""
    z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    if spec.method == "graph":
        root, st, ok = graph_of(z, pdf, spec)
        lab = ok[np.searchsorted(st["root"], root)].astype(int)
    else:
        lab = spherical_kmeans(z, 2, spec.n_init)[0]
    sides = [scores_of(lab == 1, gt), scores_of(lab != 1, gt)]
    flip = sides[1][:2] > sides[0][:2]
    full = (lab != 1) if flip else (lab == 1)
    deployed = (lab == 1) if spec.method == "graph" else lab == _chosen(lab, attention)
    far = background_distance(z, attention)
    spread = 1.4826 * float(np.median(np.abs(far - np.median(far))))
    row = dict.fromkeys(FIELDS, np.nan) | {"area": float(gt.mean())}
    for k, pred in (("full", full), ("gap", upper_gap(far)), ("swin", swin)):
        if pred is not None:
            row |= {f"{m}_{k}": v for m, v in zip(("f1", "iou", "prec", "rec", "pred_frac"), scores_of(pred, gt), strict=True)}
    row["f1_full_deployed"], row["iou_full_deployed"] = scores_of(deployed, gt)[:2]
    row |= {"pos_coh": coherence(z[full]), "bg_coh": coherence(z[~full])}
    if full.any() and not full.all():
        a, b = z[full].sum(0), z[~full].sum(0)
        row |= {"cent_sep": float(1 - a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12)), "out_gap": float(np.median(far[full]) - np.median(far[~full]))}
    row |= {"frac_outliers_mad": float((far > np.median(far) + 3 * max(spread, 1e-6)).mean()), "frac_outliers_03": float((far > 0.3).mean()), "frac_outliers_05": float((far > 0.5).mean())}
    sil = [silhouette_of(z, lab), *(silhouette_of(z, spherical_kmeans(z, k)[0]) for k in (3, 4))]
    row |= {f"sil_k{k}": s for k, s in zip((2, 3, 4), sil, strict=True)}
    return row | {"polarity_agree": bool((deployed == full).all()), "best_k": 2 + int(np.argmax(sil))}


def localization_samples(p: DataFrame, images: DataFrame, gt: str, spec: DecodeSpec | None = None, *, swin: str | None = None, attention: bool = True, kinds: tuple[str, ...] = ("imdsplice", "casiasplice", "aesplice")) -> DataFrame:
    """One row for each image of a splice kind with any true patch: image_id, kind, bucket, bce_logit and FIELDS, polarity_agree, best_k.

    p: patches with a boolean column gt and, if named, one with the mask of windows; images: image_id, kind, logit. full takes the
    better of a partition and its complement, deployed the side that a decode would commit to, gap the patches far from the
    background. Fields that need what isn't there are NULL; images without patches give no row.
    """
    spec = spec or DecodeSpec()

    def fn(image, z, pdf):
        g = pdf[gt].to_numpy(dtype=bool)
        if not g.any():
            return pd.DataFrame({c: [] for c in ("image_id", *FIELDS, "polarity_agree", "best_k")})
        row = sample_of(z, g, pdf["attention"].to_numpy(dtype=float) if attention else None, pdf, spec, pdf[swin].to_numpy(dtype=bool) if swin else None)
        return pd.DataFrame([{"image_id": image, **row}])

    wanted = images.where(F.col("kind").isin(*kinds)).select("image_id", "kind", F.col("logit").alias("bce_logit"))
    x = per_image(p.join(wanted.select("image_id").distinct(), "image_id", "left_semi"), fn, SCHEMA, "r", "c", gt, *["attention"] * attention, *[swin] * bool(swin))
    x = x.select("image_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in FIELDS], "polarity_agree", "best_k")
    return x.join(wanted, "image_id").withColumn("bucket", size_bucket("area"))
