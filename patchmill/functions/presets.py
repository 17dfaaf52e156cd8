"""Strength presets of corruption chains and the corruptions of evaluation modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchmill.errors import ConfigError
from patchmill.functions.pixels import Corruption

# Fixed values: (family, probability, least, greatest parameter) of each step, in the order in which steps run.
PRESETS: dict[str, list[tuple[str, float, float, float]]] = {
    "light": [("jpeg", 0.25, 88, 98), ("gaussian", 0.15, 0.002, 0.015), ("resize", 0.20, 0.80, 0.98), ("blur", 0.0, 0.0, 1.0)],
    "medium": [("jpeg", 0.45, 60, 90), ("gaussian", 0.30, 0.002, 0.025), ("resize", 0.25, 0.65, 0.95), ("blur", 0.25, 0.2, 1.2)],
    "heavy": [("jpeg", 0.55, 40, 95), ("gaussian", 0.45, 0.005, 0.075), ("resize", 0.40, 0.45, 0.95), ("blur", 0.30, 0.2, 2.5)],
    "noise_moderate": [("jpeg", 0.50, 45, 95), ("gaussian", 0.60, 0.010, 0.110), ("poisson", 0.40, 24, 80), ("resize", 0.30, 0.55, 0.95), ("blur", 0.20, 0.2, 1.5)],
    "noise_aggressive": [("jpeg", 0.55, 40, 95), ("gaussian", 0.80, 0.020, 0.160), ("poisson", 0.60, 8, 48), ("resize", 0.35, 0.45, 0.95), ("blur", 0.25, 0.2, 2.0)],
}

# The corruption of each evaluation family.
EVALUATION: dict[str, dict] = {"jpeg": {"quality": 35}, "double_jpeg": {"q1": 82, "q2": 45}, "gaussian": {"std": 0.30}, "poisson": {"peak": 16.0}, "resize": {"scale": 0.55}}


def chain(name: str, without: tuple[str, ...] = ()) -> list[tuple[str, float, tuple[float, float]]]:
    """The steps of a preset as light_chain takes them."""
    if name not in PRESETS:
        raise ConfigError(f"unknown preset {name!r}; there are {sorted(PRESETS)}")
    return [(f, p, (lo, hi)) for f, p, lo, hi in PRESETS[name] if f not in without]


def evaluation_mode(mode: str | None) -> tuple[str, Corruption | None]:
    """(region, corruption) of a mode such as ``none``, ``global_jpeg`` or ``mask_gaussian``."""
    if not mode or mode == "none":
        return "global", None
    head, _, rest = mode.partition("_")
    region, family = (head, rest) if head in ("global", "mask") else ("global", mode)
    family = "gaussian" if family == "aggressive_mix" else family
    if family not in EVALUATION:
        raise ConfigError(f"unknown evaluation mode {mode!r}")
    return region, Corruption(family, EVALUATION[family])


def preset_table(spark: SparkSession) -> DataFrame:
    """(preset, step, family, probability, least, greatest)."""
    rows = [(n, i, f, float(p), float(lo), float(hi)) for n, steps in PRESETS.items() for i, (f, p, lo, hi) in enumerate(steps)]
    return spark.createDataFrame(rows, "preset string, step int, family string, probability double, least double, greatest double")


def between(a: str, b: str, share: float, presets: DataFrame) -> DataFrame:
    """(family, probability, least, greatest) a share of the way from one preset to another, for the families of both; whole numbers stay whole."""
    x = presets.where(F.col("preset") == a).alias("a").join(presets.where(F.col("preset") == b).alias("b"), "family")

    def mix(c: str):
        lo, hi = F.col(f"a.{c}"), F.col(f"b.{c}")
        v = lo + (hi - lo) * share
        return F.when((lo == F.floor(lo)) & (hi == F.floor(hi)) & (F.greatest(lo, hi) > 1), F.rint(v)).otherwise(v).alias(c)

    return x.select("family", *[mix(c) for c in ("probability", "least", "greatest")])
