"""Queries: streams run to their end, against SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchmill.plans.bindings import table
from patchmill.sources.files import run_summary
from patchmill.storage import Workspace
from patchmill.streaming.events import appended_metrics, event_stream, first_deliveries, read_metrics, run_to_end, sessions, stopping, window_counts

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS tag, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str_tumbling(spark, d):
    return run_to_end(window_counts(event_stream(spark, d), "1 hour"), "complete")


@query("SELECT time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE AS start, event_type AS tag, count(*) AS n, round(sum(value), 4) AS total FROM events CROSS JOIN (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def str_sliding(spark, d):
    return run_to_end(window_counts(event_stream(spark, d), "1 hour", "30 minutes"), "complete")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def str_sessions(spark, d):
    return run_to_end(sessions(event_stream(spark, d), "6 hours"), "complete")


@query("SELECT DISTINCT event_id FROM events")
def str_first_deliveries(spark, d):
    return run_to_end(first_deliveries(event_stream(spark, d), "event_id").select("event_id"), "append")


@query()
def str_stopping(spark, d):
    x = event_stream(spark, d).select(F.col("event_type").alias("tag"), "ts", "value")
    return run_to_end(stopping(x, "tag", 0.5, 25), "update")


@query("SELECT tag, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN bucket = 'small' THEN 1 ELSE 0 END) AS BIGINT) AS small FROM loc_samples WHERE tag IS NOT NULL GROUP BY tag")
def str_growing_metrics(spark, d):
    """A log of metrics whose columns grow from batch to batch, written by a stream's sink and read as one table."""
    x = table(spark, d, "loc_samples").where("tag is not null").groupBy("tag").agg(F.count("*").alias("n"), F.count_if(F.col("bucket") == "small").alias("small"))
    to = f"{Workspace(spark, 'metrics').root}/log"
    sink = appended_metrics(x, to)
    sink(x.select("tag", "n"), 0)
    sink(x.select("tag", "n", "small"), 1)
    sink(x.select("tag", "n", "small"), 1)
    return read_metrics(spark, to).groupBy("tag").agg(F.max("n").alias("n"), F.max("small").alias("small"))


@query("""SELECT tag AS name, CASE WHEN max(n_total) % 2 = 0 THEN 'done' ELSE 'failed' END AS status, '' AS exit_code, '' AS wall_seconds, CAST(max(n_total) AS VARCHAR) AS n_total, CASE WHEN max(n_real) % 2 = 0 OR tag = (SELECT min(tag) FROM image_bce_metrics) THEN CAST(max(n_real) AS VARCHAR) ELSE '' END AS n_real FROM image_bce_metrics WHERE tag IS NOT NULL GROUP BY tag""")
def udf_run_summary(spark, d):
    """A line for each run with the metrics that any of them has."""
    m = table(spark, d, "image_bce_metrics").where("tag is not null").groupBy(F.col("tag").alias("name")).agg(F.max("n_total").alias("n_total"), F.max("n_real").alias("n_real"))
    m = m.join(F.broadcast(m.agg(F.min("name").alias("first"))))  # one run at least has every metric
    runs = m.select("name", F.when(F.col("n_total") % 2 == 0, "done").otherwise("failed").alias("status"), F.lit(None).cast("string").alias("exit_code"), F.lit(None).cast("string").alias("wall_seconds"))
    rows = m.select("name", F.map_filter(F.create_map(F.lit("n_total"), F.col("n_total").cast("string"), F.lit("n_real"), F.when((F.col("n_real") % 2 == 0) | (F.col("name") == F.col("first")), F.col("n_real").cast("string"))), lambda k, v: v.isNotNull()).alias("row"))
    return run_summary(runs, rows)
