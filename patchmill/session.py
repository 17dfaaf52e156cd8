"""Session factory for local runs; on a cluster the given session is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "patchmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, ANSI mode and UTC; conf entries use ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    base |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in base.items():
        b = b.config(k, v)
    return b.getOrCreate()
