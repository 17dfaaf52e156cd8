"""Patch graphs and clusters of an image: neighbours, components, decode gates, silhouettes, spherical k-means.

An image is a bounded grid of patches, so each is one call of a kernel with one matrix product; its pairs never become rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchmill.errors import ConfigError, DataError, EvalError

UNIT = 1e-3


def per_image(p: DataFrame, fn: Callable[[int, np.ndarray, pd.DataFrame], pd.DataFrame], schema: str, *cols: str) -> DataFrame:
    """fn(image_id, unit vectors, patches) of each image, its patches in the order of idx; one shuffle by image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        return fn(int(pdf["image_id"].iloc[0]), np.stack(pdf["z"].to_numpy()), pdf)

    return p.select("image_id", "idx", "z", *cols).groupBy("image_id").applyInPandas(run, schema)


def similarities(z: np.ndarray) -> np.ndarray:
    """Cosines of all pairs of unit vectors, to nine digits, so that ties do not hang on the order of sums."""
    return np.round(z @ z.T, 9)


def nearest_of(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, rank from 1): the k most similar others of each; ties by index."""
    n = len(sim)
    s = sim.copy()
    np.fill_diagonal(s, -np.inf)
    k = min(k, n - 1)
    if k < 1:
        return (np.zeros(0, dtype=int),) * 3
    least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    i, j = np.nonzero(s >= least)
    order = np.lexsort((j, -s[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, np.arange(n))
    rank = np.arange(len(i)) - first[i] + 1
    keep = rank <= k
    return i[keep], j[keep], rank[keep]


def mutual_of(sim: np.ndarray, k: int, s_edge: float, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of pairs that are in each other's k nearest, similar enough and, with near, close enough."""
    i, j, _ = nearest_of(sim, k)
    m = np.zeros(sim.shape, dtype=bool)
    m[i, j] = True
    m &= m.T & (sim >= s_edge)
    return np.nonzero(m if near is None else m & near)


def roots_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each one's component, by minimum labels with jumps."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def chebyshev(pdf: pd.DataFrame, radius: int | None) -> np.ndarray | None:
    if radius is None:
        return None
    r, c = pdf["r"].to_numpy(), pdf["c"].to_numpy()
    return np.maximum(abs(r[:, None] - r), abs(c[:, None] - c)) <= radius


def stats_of(z: np.ndarray, root: np.ndarray, attention: np.ndarray | None = None) -> pd.DataFrame:
    """(root, size, within, cross, background) of each component.

    within: mean cosine of distinct members, 1 for one; cross: that to the background; sums of unit vectors give both. The background
    is the largest component, of equal ones that of least root; with attention, of components that hold a fifth of all the one of
    least mean attention where there are two or more.
    """
    ids, at, size = np.unique(root, return_inverse=True, return_counts=True)
    total = np.zeros((len(ids), z.shape[1]))
    np.add.at(total, at, z)
    bg = int(np.lexsort((ids, -size))[0])
    if attention is not None:
        big = np.flatnonzero(size >= 0.2 * len(root))
        if len(big) >= 2:
            bg = int(big[np.argmin([attention[at == b].mean() for b in big])])
    n = size.astype(float)
    within = np.where(n > 1, ((total * total).sum(1) - n) / np.maximum(n * (n - 1), 1), 1.0)
    cross = (total @ total[bg]) / (n * n[bg])
    cross[bg] = np.nan
    return pd.DataFrame({"root": ids, "size": size, "within": within, "cross": cross, "background": np.arange(len(ids)) == bg})


def nearest(p: DataFrame, k: int) -> DataFrame:
    """(image_id, i, j, rk, sim): the k most similar patches of each; ties by index."""

    def fn(image, z, pdf):
        sim, idx = similarities(z), pdf["idx"].to_numpy()
        i, j, rk = nearest_of(sim, k)
        return pd.DataFrame({"image_id": image, "i": idx[i], "j": idx[j], "rk": rk, "sim": sim[i, j]})

    return per_image(p, fn, "image_id long, i int, j int, rk int, sim double")


def mutual_edges(p: DataFrame, k: int, s_edge: float, radius: int | None = None) -> DataFrame:
    """(image_id, i, j, sim): pairs that are in each other's k nearest, similar enough and, with radius, close enough on the grid."""

    def fn(image, z, pdf):
        sim, idx = similarities(z), pdf["idx"].to_numpy()
        i, j = mutual_of(sim, k, s_edge, chebyshev(pdf, radius))
        return pd.DataFrame({"image_id": image, "i": idx[i], "j": idx[j], "sim": sim[i, j]})

    return per_image(p, fn, "image_id long, i int, j int, sim double", "r", "c")


def components(p: DataFrame, k: int, s_edge: float, radius: int | None = None) -> DataFrame:
    """(image_id, idx, root): the least index of each patch's component in the graph of mutual edges."""

    def fn(image, z, pdf):
        idx = pdf["idx"].to_numpy()
        root = roots_of(len(z), *mutual_of(similarities(z), k, s_edge, chebyshev(pdf, radius)))
        return pd.DataFrame({"image_id": image, "idx": idx, "root": idx[root]})

    return per_image(p, fn, "image_id long, idx int, root int", "r", "c")


def component_stats(p: DataFrame, k: int, s_edge: float, radius: int | None = None) -> DataFrame:
    """(image_id, root, size, within, cross, background) of the components of each image."""

    def fn(image, z, pdf):
        idx = pdf["idx"].to_numpy()
        st = stats_of(z, roots_of(len(z), *mutual_of(similarities(z), k, s_edge, chebyshev(pdf, radius))))
        return st.assign(image_id=image, root=idx[st["root"]])[["image_id", "root", "size", "within", "cross", "background"]]

    return per_image(p, fn, "image_id long, root int, size long, within double, cross double, background boolean", "r", "c")


@dataclass(frozen=True)
class DecodeSpec:
    """How patches become a mask. Thresholds left out follow from tau_pos and tau_neg: the edge lies half-way, components must hold together as tau_pos and differ from the background as tau_neg says."""

    method: str = "kmeans"
    tau_pos: float = 0.55
    tau_neg: float = 0.20
    n_init: int = 4
    s_edge: float | None = None
    k: int = 10
    radius: int | None = None
    least: int = 4
    theta_w: float | None = None
    theta_x: float | None = None
    by_attention: bool = False
    min_patches: int = 16

    def __post_init__(self) -> None:
        if self.method not in ("kmeans", "graph"):
            raise ConfigError(f"unknown decode {self.method!r}")

    @property
    def edge(self) -> float:
        return (self.tau_pos + self.tau_neg) / 2 if self.s_edge is None else self.s_edge

    def accepts(self, st: pd.DataFrame) -> np.ndarray:
        w, x = self.tau_pos if self.theta_w is None else self.theta_w, self.tau_neg if self.theta_x is None else self.theta_x
        return (~st["background"] & (st["size"] >= self.least) & (st["within"] >= w) & (st["cross"] <= x)).to_numpy()

    def label(self) -> str:
        return "kmeans" if self.method == "kmeans" else f"graph[s={self.edge:.2f},k={self.k}" + (f",r={self.radius}" if self.radius is not None else "") + "]"


def check_unit(z: np.ndarray, image: int) -> None:
    if (abs(np.linalg.norm(z, axis=1) - 1) > UNIT).any():
        raise DataError(f"patch vectors of image {image} are not of unit length")


def graph_of(z: np.ndarray, pdf: pd.DataFrame, spec: DecodeSpec, sim: np.ndarray | None = None) -> tuple[np.ndarray, pd.DataFrame, np.ndarray]:
    """(root of each patch, statistics of components, verdict on each component) of one image."""
    sim = similarities(z) if sim is None else sim
    root = roots_of(len(z), *mutual_of(sim, spec.k, spec.edge, chebyshev(pdf, spec.radius)))
    st = stats_of(z, root, pdf["attention"].to_numpy() if spec.by_attention else None)
    return root, st, spec.accepts(st)


def graph_decode(p: DataFrame, spec: DecodeSpec | None = None, **how) -> DataFrame:
    """(image_id, idx, root, size, accepted, background): patches by component, with the verdict on it.

    Images of fewer than min_patches patches abstain: they have no rows. A vector that is not of unit length is an error.
    """
    spec = replace(spec or DecodeSpec(method="graph"), **how)

    def fn(image, z, pdf):
        check_unit(z, image)
        if len(z) < spec.min_patches:
            return pd.DataFrame({c: [] for c in ("image_id", "idx", "root", "size", "accepted", "background")})
        root, st, ok = graph_of(z, pdf, spec)
        at, idx = np.searchsorted(st["root"], root), pdf["idx"].to_numpy()
        return pd.DataFrame({"image_id": image, "idx": idx, "root": idx[root], "size": st["size"].to_numpy()[at], "accepted": ok[at], "background": st["background"].to_numpy()[at]})

    return per_image(p, fn, "image_id long, idx int, root int, size long, accepted boolean, background boolean", "r", "c", *["attention"] * spec.by_attention)


def graph_report(p: DataFrame, spec: DecodeSpec | None = None, **how) -> DataFrame:
    """(image_id, patches, components, background_size, accepted, abstained): one row for each image, those with too few patches among them."""
    spec = replace(spec or DecodeSpec(method="graph"), **how)

    def fn(image, z, pdf):
        check_unit(z, image)
        if len(z) < spec.min_patches:
            return pd.DataFrame([(image, len(z), 0, 0, 0, True)], columns=names)
        _, st, ok = graph_of(z, pdf, spec)
        return pd.DataFrame([(image, len(z), len(st), int(st.loc[st["background"], "size"].iloc[0]), int(ok.sum()), not ok.any())], columns=names)

    names = ["image_id", "patches", "components", "background_size", "accepted", "abstained"]
    return per_image(p, fn, "image_id long, patches int, components int, background_size long, accepted int, abstained boolean", "r", "c", *["attention"] * spec.by_attention)


def decoded(p: DataFrame, spec: DecodeSpec, *, deploy: bool = False, attention: bool = True) -> DataFrame:
    """(image_id, idx, pred): the patches of each image that its decode takes as the region; all false where it abstains.

    A graph's region are its accepted components. Of two clusters of k-means it is, deployed, the one of higher mean attention or,
    without attention, the smaller one (cluster 0 where equal); else simply cluster 1, for scores that take the better polarity.
    """

    def fn(image, z, pdf):
        if spec.method == "graph":
            check_unit(z, image)
            pred = np.zeros(len(z), dtype=bool)
            if len(z) >= spec.min_patches:
                root, st, ok = graph_of(z, pdf, spec)
                pred = ok[np.searchsorted(st["root"], root)]
        else:
            lab, _ = spherical_kmeans(z, 2, spec.n_init)
            pred = lab == (_chosen(lab, pdf["attention"].to_numpy() if attention else None) if deploy else 1)
        return pd.DataFrame({"image_id": image, "idx": pdf["idx"], "pred": pred})

    return per_image(p, fn, "image_id long, idx int, pred boolean", "r", "c", *["attention"] * (spec.by_attention or (deploy and attention)))


def _chosen(lab: np.ndarray, attention: np.ndarray | None) -> int:
    """0 or 1: the cluster of higher mean attention, or the smaller one; 0 where equal."""
    if attention is None:
        return 0 if (lab == 0).sum() <= (lab == 1).sum() else 1
    a = [attention[lab == c].mean() if (lab == c).any() else -np.inf for c in (0, 1)]
    return 0 if a[0] >= a[1] else 1


def abstentions(p: DataFrame, spec: DecodeSpec, edges: Iterable[float]) -> DataFrame:
    """(image_id, s_edge, abstained): whether each image's graph has no region, for each edge threshold; its cosines are worked out once."""
    grid = [float(s) for s in edges]

    def fn(image, z, pdf):
        check_unit(z, image)
        sim = similarities(z)
        gone = [len(z) < spec.min_patches or not graph_of(z, pdf, replace(spec, s_edge=s), sim)[2].any() for s in grid]
        return pd.DataFrame({"image_id": image, "s_edge": grid, "abstained": gone})

    return per_image(p, fn, "image_id long, s_edge double, abstained boolean", "r", "c", *["attention"] * spec.by_attention)


def calibrate_graph(p: DataFrame, single: DataFrame, spec: DecodeSpec | None = None, *, edges: list[float] | None = None, fallback: float | None = None) -> DataFrame:
    """(s_edge, bal_acc, tpr, tnr, n_single, n_two, used_fallback), one row: the first edge threshold of greatest balanced accuracy of abstaining on images of one class.

    single: image_id, single. 21 thresholds between tau_neg and tau_pos are tried where none are given. A class that is absent counts
    as 1. Without images the fallback is returned, or an error raised.
    """
    spec = replace(spec or DecodeSpec(), method="graph")
    grid = np.linspace(spec.tau_neg + 0.05, spec.tau_pos - 0.05, 21).tolist() if edges is None else edges
    x = abstentions(p, spec, grid).join(single.select("image_id", "single"), "image_id")
    return _best(x.select(F.col("s_edge").alias("t"), "single", F.col("abstained").alias("low")), "s_edge", fallback, "the calibration set is empty and there is no fallback")


def _best(x: DataFrame, name: str, fallback: float | None, missing: str) -> DataFrame:
    """The first threshold t of greatest balanced accuracy, where images with low count as single; rates of absent classes are 1."""
    rate = lambda c, hit: F.coalesce(F.avg(F.when(c, hit.cast("double"))), F.lit(1.0))
    s = F.col("single")
    r = x.groupBy("t").agg(rate(s, F.col("low")).alias("tpr"), rate(~s, ~F.col("low")).alias("tnr"), F.count_if(s).alias("n_single"), F.count_if(~s).alias("n_two")).withColumn("bal_acc", (F.col("tpr") + F.col("tnr")) * 0.5)
    b = r.agg(F.max_by(F.struct("t", "bal_acc", "tpr", "tnr", "n_single", "n_two"), F.struct("bal_acc", -F.col("t"))).alias("b")).where("b is not null")
    best = b.select(F.col("b.t").alias(name), "b.bal_acc", "b.tpr", "b.tnr", "b.n_single", "b.n_two", F.lit(False).alias("used_fallback"))
    if not best.isEmpty():
        return best
    if fallback is None:
        raise EvalError(missing)
    none = F.lit(float("nan"))
    return best.sparkSession.range(1).select(F.lit(float(fallback)).alias(name), none.alias("bal_acc"), none.alias("tpr"), none.alias("tnr"), F.lit(0).cast("long").alias("n_single"), F.lit(0).cast("long").alias("n_two"), F.lit(True).alias("used_fallback"))


def silhouette_of(z: np.ndarray, lab: np.ndarray) -> float:
    """Mean cosine silhouette, by sums of clusters; lone members score 0; -1 for fewer than two clusters."""
    ids, at, size = np.unique(lab, return_inverse=True, return_counts=True)
    if len(ids) < 2:
        return -1.0
    total = np.zeros((len(ids), z.shape[1]))
    np.add.at(total, at, z)
    near, rows = z @ total.T, np.arange(len(z))
    own = size[at]
    a = np.where(own > 1, (own - near[rows, at]) / np.maximum(own - 1, 1), 0.0)
    dist = 1 - near / size
    dist[rows, at] = np.inf
    b = dist.min(1)
    top = np.maximum(a, b)
    return float(np.where((own > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0).mean())


def silhouettes(p: DataFrame, lab: str) -> DataFrame:
    """(image_id, silhouette): silhouette_of a labelling of each image."""
    return per_image(p, lambda image, z, pdf: pd.DataFrame({"image_id": [image], "silhouette": [silhouette_of(z, pdf[lab].to_numpy())]}), "image_id long, silhouette double", lab)


def polarity(p: DataFrame, lab: str, attention: str = "attention") -> DataFrame:
    """(image_id, positive): the 0/1 label of higher mean attention; 0 where equal."""
    m = p.groupBy("image_id").agg(F.avg(F.when(F.col(lab) == 1, F.col(attention))).alias("a1"), F.avg(F.when(F.col(lab) == 0, F.col(attention))).alias("a0"))
    return m.select("image_id", F.when(F.col("a0").isNull() | (F.col("a1") > F.col("a0")), 1).otherwise(0).alias("positive"))


def minority(p: DataFrame, lab: str) -> DataFrame:
    """(image_id, positive): the smaller cluster; 0 where equal."""
    m = p.groupBy("image_id").agg(F.count_if(F.col(lab) == 1).alias("n1"), F.count_if(F.col(lab) == 0).alias("n0"))
    return m.select("image_id", F.when(F.col("n1") < F.col("n0"), 1).otherwise(0).alias("positive"))


def spherical_kmeans(z: np.ndarray, k: int = 2, restarts: int = 4, steps: int = 30, seed: int = 0) -> tuple[np.ndarray, float]:
    """(labels, inertia) of the best of several seeded runs on unit rows; a cluster that runs empty gets the worst-placed row."""
    z = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    n = len(z)
    if n <= k:
        return np.arange(n), 0.0
    best, least = np.zeros(n, dtype=int), np.inf
    for run in range(restarts):
        rng = np.random.default_rng(seed + run)
        cent = z[[rng.integers(n)]]
        while len(cent) < k:
            far = np.maximum(1 - (z @ cent.T).max(1), 0) ** 2
            p = far / far.sum() if far.sum() > 0 else np.full(n, 1 / n)
            cent = np.vstack([cent, z[rng.choice(n, p=p)]])
        lab = np.full(n, -1)
        for _ in range(steps):
            sim = z @ cent.T
            new = sim.argmax(1)
            for c in range(k):
                if not (new == c).any():
                    new[sim[np.arange(n), new].argmin()] = c
            if (new == lab).all():
                break
            lab = new
            cent = np.stack([z[lab == c].sum(0) for c in range(k)])
            cent = cent / np.maximum(np.linalg.norm(cent, axis=1, keepdims=True), 1e-12)
        cost = float((1 - (z * cent[lab]).sum(1)).sum())
        if cost < least - 1e-12:
            best, least = lab, cost
    return best, least


def kmeans_labels(p: DataFrame, k: int = 2, **how) -> DataFrame:
    """(image_id, idx, cluster, inertia) of each image's patches."""

    def fn(image, z, pdf):
        lab, cost = spherical_kmeans(z, k, **how)
        return pd.DataFrame({"image_id": image, "idx": pdf["idx"], "cluster": lab.astype("int32"), "inertia": cost})

    return per_image(p, fn, "image_id long, idx int, cluster int, inertia double")


def binary_silhouette(z: np.ndarray, m: np.ndarray) -> float:
    """Mean silhouette of a two-way partition; -1 where a side has fewer than two members."""
    return silhouette_of(z, m) if min(m.sum(), (~m).sum()) >= 2 else -1.0


def null_of(z: np.ndarray, m: np.ndarray, image: int, shuffles: int, seed: int) -> tuple[float, float, float, float]:
    """(observed, mean, deviation, z-score) of a partition's silhouette against random ones of the same sizes; the deviation is at least 1e-6."""
    rng = np.random.default_rng([seed, image])
    null = np.array([binary_silhouette(z, rng.permutation(m)) for _ in range(shuffles)])
    obs, mean, std = binary_silhouette(z, m), float(null.mean()), max(float(null.std()), 1e-6)
    return obs, mean, std, (obs - mean) / std


def null_silhouettes(p: DataFrame, lab: str, shuffles: int = 32, seed: int = 0) -> DataFrame:
    """(image_id, observed, null_mean, null_std, z) of a 0/1 labelling of each image."""
    names = ["image_id", "observed", "null_mean", "null_std", "z"]
    fn = lambda image, z, pdf: pd.DataFrame([(image, *null_of(z, pdf[lab].to_numpy() == 1, image, shuffles, seed))], columns=names)
    return per_image(p, fn, "image_id long, observed double, null_mean double, null_std double, z double", lab)


def partitioned(p: DataFrame, tau: float, *, null: bool = False, restarts: int = 4, shuffles: int = 32, seed: int = 0) -> DataFrame:
    """(image_id, idx, pred, score, single, smaller, larger): the smaller of two k-means clusters, or nothing where the gate calls the image single.

    The gate's score is the silhouette or, with null, its z-score against the image's own random partitions; below tau the image is
    single and no patch is taken.
    """

    def fn(image, z, pdf):
        m = spherical_kmeans(z, 2, restarts)[0] == 1
        n1, n0 = int(m.sum()), int((~m).sum())
        score = null_of(z, m, image, shuffles, seed)[3] if null else binary_silhouette(z, m)
        pred = (m if n1 < n0 else ~m) & (score >= tau)
        return pd.DataFrame({"image_id": image, "idx": pdf["idx"], "pred": pred, "score": score, "single": score < tau, "smaller": min(n0, n1), "larger": max(n0, n1)})

    return per_image(p, fn, "image_id long, idx int, pred boolean, score double, single boolean, smaller int, larger int")


def gate_grid(values: DataFrame, value: str, steps: int = 80) -> list[float]:
    """Even thresholds from just below the least value to just above the greatest, within -0.1 and 0.999."""
    lo, hi = values.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return []
    a, b = max(-0.10, lo - 0.05), min(0.999, hi + 0.05)
    b = b if b > a else min(0.999, a + 0.05)
    return np.linspace(a, b, steps + 1).tolist()


def gate_sweep(values: DataFrame, value: str, single: str, grid: list[float] | None = None, *, fallback: float | None = None) -> DataFrame:
    """(tau, bal_acc, tpr, tnr, n_single, n_two, used_fallback), one row: the first threshold of greatest balanced accuracy, where images below it count as single.

    The grid follows from the values where none is given. Images are counted by how many thresholds they reach, so the sweep runs over
    a row for each step. A class that is absent counts as 1; without images the fallback is returned, or an error raised.
    """
    grid = gate_grid(values, value) if grid is None else grid
    if not grid:
        return _best(values.sparkSession.createDataFrame([], "t double, single boolean, low boolean"), "tau", fallback, "the calibration set is empty and there is no fallback")
    taus = F.array(*[F.lit(float(t)) for t in sorted(grid)])
    reached = F.size(F.filter(taus, lambda t: t <= F.col(value)))
    c = values.where(F.col(value).isNotNull()).groupBy(F.col(single).alias("single"), reached.alias("k")).agg(F.count("*").alias("n"))
    down = Window.partitionBy("single").orderBy("k").rangeBetween(Window.unboundedPreceding, 0)
    c = c.withColumns({"upto": F.sum("n").over(down), "all": F.sum("n").over(Window.partitionBy("single"))})
    # of a class, those with k <= i are below threshold i
    t = values.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(sorted(grid))], "i int, t double")
    side = lambda s: t.join(c.where(F.col("single") == s), F.col("k") <= F.col("i"), "left").groupBy("t").agg(F.coalesce(F.max("upto"), F.lit(0)).alias("low"))
    n = {r["single"]: r["all"] for r in c.select("single", "all").distinct().collect()}
    one, two = n.get(True, 0), n.get(False, 0)
    if not one + two:
        return _best(values.sparkSession.createDataFrame([], "t double, single boolean, low boolean"), "tau", fallback, "the calibration set is empty and there is no fallback")
    x = side(True).join(side(False).withColumnRenamed("low", "low2"), "t")
    tpr = F.col("low").cast("double") / one if one else F.lit(1.0)
    tnr = (F.lit(two) - F.col("low2")).cast("double") / two if two else F.lit(1.0)
    x = x.select("t", tpr.alias("tpr"), tnr.alias("tnr")).withColumn("bal_acc", (F.col("tpr") + F.col("tnr")) * 0.5)
    b = x.agg(F.max_by(F.struct("t", "bal_acc", "tpr", "tnr"), F.struct("bal_acc", -F.col("t"))).alias("b"))
    return b.select(F.col("b.t").alias("tau"), "b.bal_acc", "b.tpr", "b.tnr", F.lit(one).cast("long").alias("n_single"), F.lit(two).cast("long").alias("n_two"), F.lit(False).alias("used_fallback"))


def class_gap(values: DataFrame, value: str, single: str) -> DataFrame:
    """One row: mean, median and deviation of a value over single and other images, and the difference of the means."""
    own = {"single": F.col(single), "two": ~F.col(single)}
    a = [f(F.when(c, F.col(value))).alias(f"{n}_{k}") for n, c in own.items() for k, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_pop))]
    return values.agg(*a).withColumn("gap_mean", F.col("two_mean") - F.col("single_mean"))
