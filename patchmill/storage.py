"""Cutting lineage through tables written in the shared checkpoint folder.

A table written once and read back costs one pass; ``DataFrame.checkpoint`` would compute its plan
twice. The folder is the session's ``spark.checkpoint.dir``, which every executor can reach, so a
lost executor takes nothing with it. Only where it is unset on a local master (tests, one machine) a folder is made.
"""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchmill.errors import ConfigError


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one only where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ConfigError("spark.checkpoint.dir must name a folder that all executors can reach")
        where = tempfile.mkdtemp(prefix="patchmill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_roots: set[str] = set()
WINDOW_BYTES = 256 << 20


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables that this process has written; call it when results are written or no longer needed."""
    for root in [*_roots]:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _roots.discard(root)


class Workspace:
    """Intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _roots.add(self.root)

    @property
    def folder(self) -> str:
        """The folder as kernels open it: a plain path where it lies in a mounted file system, else its URI."""
        local = self.root.removeprefix("file:")
        return self.root if "://" in local else "/" + local.lstrip("/")

    def cut(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """Write df and read it back: later steps start from the files."""
        self.n += 1
        path = f"{self.root}/t{self.n}"
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def cut_all(self, *dfs: DataFrame) -> list[DataFrame]:
        """Write independent tables at the same time: their jobs share the cluster."""
        with ThreadPoolExecutor(len(dfs)) as pool:
            return list(pool.map(self.cut, dfs))

    def drop(self, df: DataFrame) -> None:
        """Delete the files of a table made by cut; nothing may read it any more."""
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles() if self.root.split("://")[-1] in p}:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bytes_of(df: DataFrame) -> int:
    """Size that the optimizer knows for df (exact for tables read from files)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def running_sums(df: DataFrame, keys: list[str], order: Column | list[Column], sums: dict[str, str], totals: dict[str, str] | None = None, *, window_bytes: int | None = None) -> DataFrame:
    """df with running sums of columns within keys along order (new name -> column), the row itself included, and totals of keys.

    Tables of less than ``window_bytes`` take one window. Larger ones are partitioned by ranges of (keys, order), summed up by
    partition, and each row adds what lies before its partition: a key with a third of all rows is spread over many tasks, and only
    one row a key and partition meets in the window over partitions. Both ways give the same rows: a NULL key is a group like any
    other. order must tell the rows of a key apart.
    """
    by = order if isinstance(order, list) else [order]
    run = lambda *cols: Window.partitionBy(*cols).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    totals = totals or {}
    if bytes_of(df) < (WINDOW_BYTES if window_bytes is None else window_bytes):
        return df.withColumns({n: F.sum(c).over(run(*keys)) for n, c in sums.items()} | {n: F.sum(c).over(Window.partitionBy(*keys)) for n, c in totals.items()})
    ws = Workspace(df.sparkSession, "running")
    x = ws.cut(df.repartitionByRange(*keys, *by).withColumn("_p", F.spark_partition_id()))
    need = sorted({*sums.values(), *totals.values()})
    part = x.groupBy(*keys, "_p").agg(*[F.sum(c).alias(f"_s_{c}") for c in need])
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumns({f"_b_{c}": F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)) for c in need} | {f"_t_{c}": F.sum(f"_s_{c}").over(Window.partitionBy(*keys)) for c in need})
    part = part.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_p").alias("_q"), *[f"_{k}_{c}" for k in "bt" for c in need])
    on = x["_p"] == part["_q"]
    for k in keys:
        on &= x[k].eqNullSafe(part[f"_k_{k}"])
    y = x.join(part, on).drop("_q", *[f"_k_{k}" for k in keys])
    y = y.withColumns({n: F.sum(c).over(run(*keys, "_p")) + F.col(f"_b_{c}") for n, c in sums.items()} | {n: F.col(f"_t_{c}") for n, c in totals.items()})
    return y.drop("_p", *[f"_{k}_{c}" for k in "bt" for c in need])


def same_keys(keys: list[str] | tuple[str, ...], a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """a joined with b on keys, where NULL equals NULL; the keys are those of a."""
    c = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[x for x in b.columns if x not in keys])
    on = F.lit(True)
    for k in keys:
        on &= a[k].eqNullSafe(c[f"_k_{k}"])
    return a.join(c, on, how).drop(*[f"_k_{k}" for k in keys])
