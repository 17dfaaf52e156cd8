"""A sample of given category proportions: calibration by Newton steps on the exponential-tilting dual, drawn by the pivotal method."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchmill.storage import Workspace


def tilt(base: np.ndarray, moments: np.ndarray, targets: np.ndarray, cap: np.ndarray, steps: int = 100, tol: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(rates, gaps): rates base * exp(lambda) <= cap that bring each moment to its target, by Newton steps on the convex dual, and what of each target lies beyond its cap.

    The dual is sum(moments * base * exp(lambda)) - lambda . targets; a target beyond cap * moment ends at the cap, its dual at its
    bound, with a gap above 0; a target of 0 or a moment of 0 ends at rate 0. The first step is held back so that exp cannot run off.
    """
    live = (moments > 0) & (targets > 0)
    reach = np.minimum(targets, cap * moments)
    lam = np.zeros(len(base))
    for _ in range(steps):
        have = moments * base * np.exp(lam)
        step = np.where(live, (reach - have) / np.maximum(have, 1e-300), 0.0)
        step = np.clip(step, -2.0, 2.0)
        lam = np.clip(lam + step, -600.0, 600.0)
        if np.max(np.abs(step), initial=0.0) < tol:
            break
    return np.where(live, np.minimum(base * np.exp(lam), cap), 0.0), targets - reach


def balanced(want: np.ndarray, least: np.ndarray, most: np.ndarray, total: float) -> np.ndarray:
    """What each category gets: exp(mu) * want, but at least ``least`` and at most ``most``, with mu such that all together give total.

    Categories at a floor or a cap are fixed by that, the others keep their proportions. Where floors alone exceed total they are
    what is given, where all that there is falls short of it that. least must not be above most.
    """
    at = lambda mu: np.clip(want * np.exp(mu), least, most)
    if not len(want) or at(-600.0).sum() >= total:
        return at(-600.0)
    if at(600.0).sum() <= total:
        return at(600.0)
    lo, hi = -600.0, 600.0
    mu = 0.0
    for _ in range(200):
        got = at(mu)
        lo, hi = (mu, hi) if got.sum() < total else (lo, mu)
        free = got[(got > least) & (got < most)].sum()
        # a Newton step of the sum over mu, whose slope is what the free categories give; bisection where it leaves the bracket
        step = mu + (total - got.sum()) / free if free > 0 else np.inf
        new = step if lo < step < hi else (lo + hi) / 2
        if abs(new - mu) < 1e-14:
            break
        mu = new
    return at(mu)


def pivotal(p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int, float]:
    """One pass of the pivotal method over inclusion probabilities: (0/1 decisions, the undecided unit or -1, its probability)."""
    out = np.zeros(len(p), dtype=np.int8)
    u = rng.random(len(p))
    at, q = -1, 0.0
    for i, x in enumerate(p.tolist()):
        if x >= 1.0 - 1e-12:
            out[i] = 1
            continue
        if x <= 1e-12:
            continue
        if at < 0:
            at, q = i, x
            continue
        s = q + x
        if s < 1.0:
            if u[i] * s >= q:
                at = i
            q = s
        else:
            if u[i] * (2.0 - s) < 1.0 - x:
                out[at] = 1
                at = i
            else:
                out[i] = 1
            q = s - 1.0
        if q >= 1.0 - 1e-12:
            out[at] = 1
            at, q = -1, 0.0
        elif q <= 1e-12:
            at, q = -1, 0.0
    return out, at, q


class ProportionSample:
    """A sample for each request whose categories have given shares.

    df: an id and category columns (as labels; rows of one id count once, a NULL id is dropped). targets: request_id, the category
    columns in the same spelling, target_share, min_rows, sample_frac; repeated categories of a request add up. The sample of a request
    has sample_frac of all ids; a category is due its share of them, at least min_rows, at most all it has. Categories that a
    request doesn't name are not drawn. What floors add is taken from the others in proportion; what short categories lack is missing
    from the sample, as shares would be further from their targets otherwise, or with ``fill`` is given to the others. Only counts by category come to the driver, and of these just as many as targets names.
    """

    def __init__(self, df: DataFrame, targets: DataFrame, id_col: str, category: list[str], *, seed: int = 0, per_task: int = 50_000, fill: bool = False):
        self.ws = Workspace(df.sparkSession, "proportions")
        self.id, self.category, self.seed, self.per_task, self.fill = id_col, category, seed, per_task, fill
        self.rows = self.ws.cut(df.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).select(F.col(id_col).alias("id"), *category))
        self.counts = self.ws.cut(self.rows.groupBy(*category).agg(F.count("*").alias("available")))
        self.targets = targets
        t = targets.groupBy("request_id", *category).agg(F.sum("target_share").alias("target_share"), F.max("min_rows").alias("min_rows"), F.max("sample_frac").alias("sample_frac"))
        self.total = self.counts.agg(F.coalesce(F.sum("available"), F.lit(0))).first()[0]
        self.solved = t.join(self.counts, category, "left").withColumns({"available": F.coalesce("available", F.lit(0)), "total": F.lit(self.total)})

    def report(self) -> DataFrame:
        """Each row of targets with available, wanted (its share of the sample, unrounded), needed (at least min_rows), due (after the others made room), the calibrated rate and what it reaches.

        short: the dual of the category's own target ends at its bound, as it has fewer records than needed.
        """
        cat = self.category
        r = self.rates().assign(reached=lambda x: x["rate"] * x["available"])
        fields = ", ".join(f"{c} string" for c in cat)
        names = ["request_id", *cat, "available", "total", "due", "rate", "reached", "short"]
        solved = self.rows.sparkSession.createDataFrame(r[names], f"request_id long, {fields}, available long, total long, due double, rate double, reached double, short boolean")
        t = self.targets.join(solved, ["request_id", *cat], "left")
        t = t.withColumn("wanted", F.col("target_share") * F.col("sample_frac") * F.col("total"))
        return t.withColumn("needed", F.greatest(F.col("min_rows").cast("double"), F.col("wanted")))

    def rates(self) -> pd.DataFrame:
        """The inclusion probability of each category of each request, calibrated.

        First each category by itself, which tells the short ones; then floors and short categories are fixed and the others solved
        again, so that the sample keeps its size and they their proportions as far as that goes.
        """
        s = self.solved.orderBy("request_id", *self.category).toPandas()
        n, want = s["available"].to_numpy(float), (s["target_share"] * s["sample_frac"] * s["total"]).to_numpy(float)
        floor, one, base = s["min_rows"].fillna(0).to_numpy(float), np.ones(len(s)), s["sample_frac"].to_numpy(float).clip(1e-9)
        s["short"] = tilt(base, n, np.maximum(want, floor), one)[1] > 0
        s["due"] = 0.0
        for at in s.groupby("request_id").indices.values():
            most = n[at] if self.fill else np.minimum(n[at], np.maximum(want[at], floor[at]))
            s.loc[s.index[at], "due"] = balanced(want[at], np.minimum(floor[at], n[at]), most, want[at].sum())
        s["rate"] = tilt(base, n, s["due"].to_numpy(float), one)[0]
        return s

    def draw(self) -> DataFrame:
        """(request_id, id, category...): the sample, by the pivotal method in groups of bounded size whose last units meet again."""
        spark, cat, seed = self.rows.sparkSession, self.category, self.seed
        r = self.rates()
        r["parts"] = np.ceil(r["available"] / self.per_task).astype("int64").clip(lower=1)
        r = r[r["rate"] > 0]
        fields = ", ".join(f"{c} string" for c in cat)
        rates = spark.createDataFrame(r[["request_id", *cat, "rate", "parts"]], f"request_id long, {fields}, rate double, parts long")
        units = self.rows.join(rates, cat).withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts"))).drop("parts")
        schema = f"request_id long, id {self.rows.schema['id'].dataType.simpleString()}, {fields}, taken boolean, rate double"

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            import hashlib

            pdf = pdf.sort_values("id", ignore_index=True)
            rng = np.random.default_rng(int.from_bytes(hashlib.md5(repr((seed, *key)).encode()).digest()[:8], "big"))
            pdf = pdf.iloc[rng.permutation(len(pdf))]
            taken, at, q = pivotal(pdf["rate"].to_numpy(), rng)
            pdf = pdf.assign(taken=taken.astype(bool))
            if at >= 0:
                pdf.iloc[at, pdf.columns.get_loc("rate")] = q
                keep = pdf["taken"].to_numpy().copy()
                keep[at] = True
                pdf = pdf[keep]
            else:
                pdf = pdf[pdf["taken"]]
            return pdf[["request_id", "id", *cat, "taken", "rate"]]

        once = self.ws.cut(units.groupBy("request_id", *cat, "part").applyInPandas(run, schema))
        out, left, n = once.where("taken"), once.where("not taken"), int(r["parts"].sum())
        # the last units of the parts meet again, in groups of bounded size, until one group a request is left
        while True:
            groups = max(1, -(-n // self.per_task))
            part = F.pmod(F.xxhash64("id", F.lit(seed + n)), F.lit(groups))
            again = left.withColumn("part", part).groupBy("request_id", "part").applyInPandas(lambda key, pdf: run((*key, "last"), pdf), schema)
            if groups == 1:
                break
            again = self.ws.cut(again)
            out, left, n = out.unionByName(again.where("taken")), again.where("not taken"), groups * int(r["request_id"].nunique())
        u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("request_id").cast("string"))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
        out = out.unionByName(again.where(F.col("taken") | (u < F.col("rate"))))
        return out.select("request_id", F.col("id").alias(self.id), *cat)
