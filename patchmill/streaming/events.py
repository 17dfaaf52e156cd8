"""Streams of events: windows with watermarks, sessions, repeated deliveries, stateful stopping."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from patchmill.storage import Workspace


def event_stream(spark: SparkSession, d: str, name: str = "events") -> DataFrame:
    """A table of a folder as a stream of files."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    x = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")
    return x.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(df: DataFrame, mode: str) -> DataFrame:
    """Process all that is there, then return what the stream wrote; update mode keeps the last row of each key column ``key``."""
    spark = df.sparkSession
    root = Workspace(spark, "stream").root
    if mode == "append":
        q = df.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{root}/out")

    def sink(part: DataFrame, epoch: int) -> None:
        part.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{root}/out/_epoch_={epoch}")

    q = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_epoch", T.IntegerType())])).parquet(f"{root}/out/*")
    last = out.agg(F.max("_epoch").alias("_e"))
    return out.join(F.broadcast(last), F.col("_epoch") == F.col("_e")).select(*df.columns)


def window_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "3650 days") -> DataFrame:
    """(start, tag, n, total) by event-time window; rows later than the watermark are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    x = events.withWatermark("ts", late).groupBy(w.alias("w"), F.col("event_type").alias("tag")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return x.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "tag", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "3650 days") -> DataFrame:
    """(user_id, start, n): sessions of a user that end after a gap."""
    x = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return x.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def first_deliveries(events: DataFrame, key: str, late: str = "3650 days") -> DataFrame:
    """Each key once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def stopping(values: DataFrame, key: str, delta: float, patience: int) -> DataFrame:
    """(key, seen, best, bad, stopped): the state machine of early stopping over an unbounded stream of values, one row for each key and batch."""

    def step(k: tuple, parts, state: GroupState):
        seen, best, bad, stopped = state.get if state.exists else (0, float("-inf"), 0, False)
        for pdf in parts:
            for v in pdf.sort_values(["ts"])["value"]:
                seen += 1
                if stopped or pd.isna(v):
                    continue
                if v > best + delta:
                    best, bad = float(v), 0
                else:
                    bad += 1
                    stopped = bad >= patience
        state.update((seen, best, bad, stopped))
        yield pd.DataFrame([(k[0], seen, best, bad, stopped)], columns=[key, "seen", "best", "bad", "stopped"])

    t = values.schema[key].dataType.simpleString()
    return values.groupBy(key).applyInPandasWithState(step, f"{key} {t}, seen long, best double, bad long, stopped boolean", "seen long, best double, bad long, stopped boolean", "update", GroupStateTimeout.NoTimeout)


def appended_metrics(df: DataFrame, to: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for rows whose columns may grow: each batch is a folder of its own, so a batch that runs again replaces itself."""

    def sink(part: DataFrame, epoch: int) -> None:
        part.write.mode("overwrite").parquet(f"{to}/batch={epoch}")

    return sink


def read_metrics(spark: SparkSession, to: str) -> DataFrame:
    """All rows of appended_metrics with the columns of any batch, NULL where a batch lacks one."""
    return spark.read.option("mergeSchema", "true").parquet(to)
