"""Listings, images, text and JSON manifests as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchmill.functions.labels import ZERO_WIDTH, path_plain
from patchmill.operators.manifest import VALID


def listing(spark: SparkSession, root: str, *, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, dir, name, stem, ext, mtime, length) of files; their content is never read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        r = r.option("pathGlobFilter", glob)
    p = F.regexp_replace("path", "^file:/+", "/")
    name = F.substring_index(p, "/", -1)
    return r.load(root).select(p.alias("path"), F.regexp_replace(p, "/[^/]*$", "").alias("dir"), name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("ext"), F.col("modificationTime").alias("mtime"), "length")


def images(spark: SparkSession, root: str) -> DataFrame:
    """(path, width, height, ok): decoded sizes; a file that cannot be decoded has ok false."""
    x = spark.read.format("image").option("dropInvalid", "false").load(root).select("image.*")
    return x.select(F.regexp_replace("origin", "^file:/+", "/").alias("path"), "width", "height", (F.col("height") > 0).alias("ok"))


def text_manifest(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(path,): lines of a text manifest without comments and blanks, NUL as a line end, relative ones under root, each once."""
    lines = spark.read.text(path).select(F.explode(F.split(F.regexp_replace("value", "\\x00", "\n"), "\n")).alias("p"))
    p = F.trim(F.regexp_replace("p", ZERO_WIDTH, ""))
    x = lines.select(p.alias("p")).where("p <> '' and not startswith(p, '#')")
    return x.select(F.when(F.col("p").startswith("/") | (F.lit(root) == ""), F.col("p")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "p")).alias("path")).distinct()


def json_queue(spark: SparkSession, path: str) -> DataFrame:
    """(name, module, args): entries of a JSON queue."""
    x = spark.read.schema("runs array<struct<name:string,module:string,args:map<string,string>>>").json(path, multiLine=True)
    return x.select(F.explode("runs").alias("r")).select("r.*")


def newest(li: DataFrame) -> DataFrame:
    """The path of latest time of each folder, the greater path where equal."""
    return li.groupBy("dir").agg(F.max(F.struct("mtime", "path")).alias("m")).select("dir", F.col("m.path").alias("path"), F.col("m.mtime").alias("mtime"))


def write_ids(df: DataFrame, col: str, path: str) -> None:
    df.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)


def indoor_manifest(spark: SparkSession, path: str, holdout: str) -> DataFrame:
    """Items of the pictures that a text manifest names, relative ones beside it; lines without a file or with another ending are left out, each file once."""
    base = path.rsplit("/", 1)[0] if "/" in path else "."
    named = text_manifest(spark, path, base).select(path_plain("path").alias("path")).distinct()
    there = named.mapInPandas(_existing, "path string")
    name = F.substring_index("path", "/", -1)
    li = there.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("ext"))
    return indoor_rows(li, holdout)


def _existing(parts):
    import os

    for pdf in parts:
        yield pdf[[os.path.isfile(p) for p in pdf["path"]]]


def indoor_rows(li: DataFrame, holdout: str) -> DataFrame:
    """(img, mask, kind, case_id, source, split) of listed pictures; those under a folder named holdout are val."""
    x = li.where(F.col("ext").isin(*VALID))
    split = F.when(F.array_contains(F.split("path", "/"), holdout), "val").otherwise("train")
    return x.select(F.col("path").alias("img"), F.lit(None).cast("string").alias("mask"), F.lit("indoor_real").alias("kind"), F.col("stem").alias("case_id"), F.lit("indoor_real").alias("source"), split.alias("split"))


def indoor_dataset(spark: SparkSession, root: str, holdout: str) -> DataFrame:
    """Items of a folder of pictures, a folder of scenes or a text manifest.

    Pictures that lie in root itself mean that all below it count. Else each folder in root is a scene: the pictures in its folder
    ``images`` count or, without one, those that lie in it; where that finds none, all below root count. A file that is a picture is
    one item of train.
    """
    f = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = f.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(f):
        return spark.createDataFrame([], "img string, mask string, kind string, case_id string, source string, split string")
    if fs.getFileStatus(f).isFile():
        if root.lower().endswith(VALID):
            return indoor_rows(listing(spark, root), "").withColumn("split", F.lit("train"))
        return indoor_manifest(spark, root, holdout)
    li = listing(spark, root).where(F.col("ext").isin(*VALID))
    here = root.removeprefix("file:").rstrip("/")
    if not li.where(F.col("dir") == here).isEmpty():
        return indoor_rows(li, holdout)
    rest = F.split(F.substring("path", len(here) + 2, 1 << 20), "/")
    x = li.withColumns({"_scene": rest[0], "_deep": F.size(rest), "_in": rest[1] == "images"})
    with_images = x.where((F.col("_deep") >= 3) & F.col("_in")).select("_scene").distinct().withColumn("_has", F.lit(True))
    x = x.join(F.broadcast(with_images), "_scene", "left").where(F.when(F.col("_has"), (F.col("_deep") == 3) & F.col("_in")).otherwise(F.col("_deep") == 2))
    own = x.select(*li.columns, "_scene")
    if own.isEmpty():
        return indoor_rows(li, holdout)
    return indoor_rows(own, holdout).withColumn("split", F.when(F.regexp_extract("img", "^" + _quoted(here) + "/([^/]+)/", 1) == holdout, "val").otherwise("train"))


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def named_folder(folders: list[str], *names: str) -> str | None:
    """The first folder, in order, that bears one of the names in any letter case, packed or not."""
    plain = lambda n: n.lower().rstrip("/\\").removesuffix(".zip")
    want = {plain(n) for n in names}
    return next((f for f in sorted(folders) if plain(f) in want), None)


def bfree_root(tree: dict[str, list[str]], root: str) -> str:
    """root, or the folder in it that has all parts of the dataset; tree lists the folders of each folder."""
    parts = (("coco_real_512",), ("sd2.1_inpainted_diffcat",), ("sd2.1_inpainted_samecat",), ("bbox",), ("masks", "mask"))
    whole = lambda d: all(named_folder(tree.get(d, []), *p) for p in parts)
    if whole(root):
        return root
    return next((d for c in sorted(tree.get(root, [])) if whole(d := f"{root.rstrip('/')}/{c}")), root)


def last_rows(spark: SparkSession, logs: DataFrame) -> DataFrame:
    """(dir, row): the last line of the newest file of each folder as a map of its header's names, of CSV logs whose columns differ; logs: path, dir, mtime."""

    def run(parts):
        import csv

        import pandas as pd

        for pdf in parts:
            rows = []
            for d, p in zip(pdf["dir"], pdf["path"], strict=True):
                try:
                    with open(p, newline="") as f:
                        all_ = list(csv.DictReader(f))
                except OSError:
                    all_ = []
                rows.append((d, {k: v or "" for k, v in all_[-1].items() if k} if all_ else {}))
            yield pd.DataFrame(rows, columns=["dir", "row"])

    return newest(logs).select("dir", "path").mapInPandas(run, "dir string, row map<string,string>")


def run_summary(runs: DataFrame, rows: DataFrame, fixed: tuple[str, ...] = ("name", "status", "exit_code", "wall_seconds")) -> DataFrame:
    """One line for each run: the fixed columns, then every metric that any run has, blank where a run lacks it.

    runs: the fixed columns; rows: name and row, a map. The metrics' names come to the driver, one for each.
    """
    x = runs.join(rows.select("name", "row"), "name", "left")
    names = [r["k"] for r in rows.select(F.explode(F.map_keys("row")).alias("k")).groupBy("k").agg(F.count("*")).orderBy("k").collect() if r["k"] not in fixed]
    return x.select(*[F.coalesce(F.col(c).cast("string"), F.lit("pending" if c == "status" else "")).alias(c) for c in fixed], *[F.coalesce(F.try_element_at("row", F.lit(n)), F.lit("")).alias(n) for n in names])


def log_tail(spark: SparkSession, path: str, n: int = 30) -> list[str]:
    """The last n lines of a text log: they are ranked by file position from the end, so only n lines come to the driver."""
    x = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    return [r["value"] for r in reversed(x.orderBy(F.desc("f"), F.desc("i")).limit(n).collect())]
