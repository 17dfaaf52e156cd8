"""Mixing sources to target shares of tokens: entropy balancing, then copies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patchmill.llm.proportions import balanced, tilt
from patchmill.storage import Workspace


class SourceMix:
    """Copies of documents so that each source gives its target share of a mix's tokens.

    docs: doc_id (unique), source (a label or NULL), tokens. targets: mix_id, source (label), target_share, max_repeats, size_frac.
    A mix is to have size_frac of all tokens, those of documents without source too; a source is due its share, at most max_repeats
    times what it has; what short sources lack is given to the others, so that a mix keeps its size, or with ``fill=False`` is missing. All documents of a source have the same tilted rate, so their token sum is all that the Newton steps need of
    them; it is summed up in partial aggregates. Sources a mix doesn't name give nothing. Repeated sources of a mix add up.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, *, seed: int = 0, per_part: int = 50_000, fill: bool = True):
        self.ws = Workspace(docs.sparkSession, "mixing")
        self.seed, self.per_part, self.fill = seed, per_part, fill
        self.docs = self.ws.cut(docs.where("doc_id is not null").select("doc_id", "source", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")))
        self.sums = self.ws.cut(self.docs.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("n_docs")))
        self.total = self.sums.agg(F.coalesce(F.sum("available"), F.lit(0))).first()[0]
        self.targets = targets
        t = targets.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.max("size_frac").alias("size_frac"))
        self.solved = t.join(self.sums, "source", "left").na.fill(0, ["available", "n_docs"]).withColumn("total", F.lit(self.total))

    def rates(self):
        """Rate (copies a document) of each source of each mix; one row for each row of targets comes to the driver, not more.

        First each source by itself, which tells the short ones; these stay at their cap, and the others are solved again for what is
        left of the mix's tokens.
        """
        s = self.solved.orderBy("mix_id", "source").toPandas()
        n = s["available"].to_numpy(float)
        s["due"] = s["target_share"] * s["size_frac"] * s["total"]
        due, cap, base = s["due"].to_numpy(float), s["max_repeats"].fillna(0).to_numpy(float), s["size_frac"].to_numpy(float).clip(1e-9)
        s["short"] = tilt(base, n, due, cap)[1] > 0
        s["assigned"] = 0.0
        for at in s.groupby("mix_id").indices.values():
            s.loc[s.index[at], "assigned"] = balanced(due[at], np.zeros(len(at)), cap[at] * n[at] if self.fill else np.minimum(due[at], cap[at] * n[at]), due[at].sum())
        s["rate"] = tilt(base, n, s["assigned"].to_numpy(float), cap)[0]
        return s

    def copies(self) -> DataFrame:
        """(mix_id, doc_id, source, tokens, copies): documents of one copy or more.

        The whole part of a rate goes to every document, the rest to documents in the order of a hash until their tokens are used up;
        documents are cut into parts of bounded size for that, each off by half a document at most.
        """
        r = self.rates()
        r = r[r["rate"] > 0]
        r = r.assign(parts=np.ceil(r["n_docs"] / self.per_part).astype("int64").clip(lower=1))
        rates = self.docs.sparkSession.createDataFrame(r[["mix_id", "source", "rate", "parts"]], "mix_id long, source string, rate double, parts long")
        h = F.xxhash64("doc_id", "mix_id", F.lit(self.seed))
        x = self.docs.join(rates, "source").withColumn("h", h).withColumn("part", F.pmod(F.col("h"), F.col("parts")))
        own = Window.partitionBy("mix_id", "source", "part")
        x = x.withColumn("cum", F.sum("tokens").over(own.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("tokens").over(own))
        whole = F.floor(F.col("rate") + 1e-9)
        extra = (F.col("cum") - F.col("tokens") / 2 < (F.col("rate") - whole) * F.col("all")) & (F.col("rate") - whole > 1e-9)
        return x.withColumn("copies", (whole + F.when(extra, 1).otherwise(0)).cast("int")).where("copies > 0").select("mix_id", "doc_id", "source", "tokens", "copies")

    def report(self, copies: DataFrame | None = None) -> DataFrame:
        """Each row of targets with available and due tokens, the balanced rate and, given copies, the share really reached.

        short: the dual of the source's own target ends at its bound, max_repeats. assigned: its tokens once short sources are fixed.
        """
        r = self.rates()
        solved = self.docs.sparkSession.createDataFrame(r[["mix_id", "source", "available", "total", "rate", "short", "assigned"]], "mix_id long, source string, available long, total long, rate double, short boolean, assigned double")
        t = self.targets.join(solved, ["mix_id", "source"], "left")
        t = t.withColumn("due", F.col("target_share") * F.col("size_frac") * F.col("total"))
        if copies is None:
            return t
        got = copies.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached"), F.max("copies").alias("most_copies"))
        all_ = Window.partitionBy("mix_id")
        return t.join(got, ["mix_id", "source"], "left").na.fill(0, ["reached", "most_copies"]).withColumn("reached_share", F.try_divide(F.col("reached").cast("double"), F.sum("reached").over(all_)))
