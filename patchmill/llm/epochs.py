"""A reproducible sample that stays as data grows: each record's first epoch and that epoch's rate are kept, a keyed random number decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PICKED = -1


def key_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed only: the first 52 bits of an MD5 in counter mode."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|0|"), key)), 1, 13), 16, 10).cast("double")
    return bits / F.lit(float(1 << 52))


def record_key(exact: list[str], labels: list[Column]) -> Column:
    """A key of a record's identifying fields: exact columns as they are, labels as given; NULL differs from every text."""
    return F.md5(F.to_json(F.struct(*[F.col(c).alias(f"e{i}") for i, c in enumerate(exact)], *[x.alias(f"l{i}") for i, x in enumerate(labels)]), {"ignoreNullFields": "false"}))


def epoch_ledger(df: DataFrame, key: Column, epoch: Column, rates: dict[int, float], default_rate: float, *, stored: DataFrame | None = None, null_epoch: int = 0) -> DataFrame:
    """(key, epoch, rate, new): the first epoch in which each record was seen, with the rate of that epoch, to be kept for later runs.

    stored: (key, epoch, rate) of earlier runs. Its keys keep their epoch and rate, whatever rows are at hand and whatever the rates
    are now, and stay in the ledger; the rows with ``new`` are to be appended to it. A record with NULL epochs only counts as of
    null_epoch, which does not move as epochs are added. Without stored, rates of epochs that are over must never change.
    """
    first = df.select(key.alias("key"), epoch.cast("int").alias("epoch")).groupBy("key").agg(F.coalesce(F.min("epoch"), F.lit(null_epoch)).alias("epoch"))
    rate = F.lit(default_rate)
    for e, r in rates.items():
        rate = F.when(F.col("epoch") == e, F.lit(float(r))).otherwise(rate)
    first = first.withColumn("rate", rate)
    if stored is None:
        return first.withColumn("new", F.lit(True))
    kept = stored.groupBy("key").agg(F.min(F.struct(F.col("epoch").cast("int").alias("epoch"), F.col("rate").cast("double").alias("rate"))).alias("s"))
    s = F.col("s")
    return first.join(kept, "key", "full").select("key", *[F.when(s.isNull(), F.col(c)).otherwise(s[c]).alias(c) for c in ("epoch", "rate")], s.isNull().alias("new"))


def picks_as_ledger(keys: DataFrame) -> DataFrame:
    """(key, epoch, rate) of records that were picked by hand or by a run without a ledger: an epoch before all others, with rate 1, so that any random number keeps them."""
    return keys.select("key").where("key is not null").distinct().select("key", F.lit(PICKED).alias("epoch"), F.lit(1.0).alias("rate"))


class Ledger:
    """A ledger kept as a folder of tables, one for each run; a run that is repeated replaces its own rows and reads those of the others only."""

    SCHEMA = "key string, epoch int, rate double"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, without: str | None = None) -> DataFrame:
        """(key, epoch, rate) of all runs but one; empty where there is none."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        runs = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        found = [f"{self.path}/{r}" for r in sorted(runs) if r.startswith("run=") and r != f"run={without}"]
        return self.spark.read.schema(self.SCHEMA).parquet(*found) if found else self.spark.createDataFrame([], self.SCHEMA)

    def append(self, run: str, rows: DataFrame) -> None:
        """Keep the rows of a run: those of epoch_ledger with ``new``."""
        rows.select("key", F.col("epoch").cast("int").alias("epoch"), F.col("rate").cast("double").alias("rate")).write.mode("overwrite").parquet(f"{self.path}/run={run}")


def epoch_sample(df: DataFrame, id_col: str, key: Column, epoch: Column, rates: dict[int, float], *, stored: DataFrame | None = None, default_rate: float = 0.0, seed: int = 0) -> DataFrame:
    """(id, key, epoch, rate, u, by): the records of the sample, one row for each id.

    A record is in the sample where its random number, keyed by its identifying fields, is below the rate of the epoch in which it
    was first seen. stored is the ledger of earlier runs (epoch_ledger over the same rows and with the same stored gives what to append
    to it), with earlier picks among it as picks_as_ledger makes them. So new batches add records and take none away, also where the
    early rows are gone or rates have changed; and neither order nor repetition nor partitioning of rows matters. by is
    ``prior`` for earlier picks, else ``rate``. Ids that are the same record are in or out together; a NULL id is dropped; ledger rows
    without a record are ignored.
    """
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), key.alias("key"), epoch.alias("epoch"))
    ledger = epoch_ledger(rows, F.col("key"), F.col("epoch"), rates, default_rate, stored=stored)
    picked = ledger.withColumn("u", key_uniform(F.col("key"), seed)).where(F.col("u") < F.col("rate"))
    ids = rows.select("id", "key").distinct()
    return ids.join(picked, "key").select(F.col("id").alias(id_col), "key", "epoch", "rate", "u", F.when(F.col("epoch") == PICKED, "prior").otherwise("rate").alias("by"))
