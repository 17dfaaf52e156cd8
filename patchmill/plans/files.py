"""Queries about files: too many small ones, and the plan that consolidates them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchmill.functions.labels import path_plain
from patchmill.operators.compaction import MB128, compaction_plan, concatenate, data_files, directory_report, manifest_plan
from patchmill.plans.bindings import path_sql
from patchmill.sources.files import listing
from patchmill.storage import Workspace


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Directories whose files, laid end to end, take far fewer outputs than they are files."""
    files = Workspace(spark, "p3").cut(data_files(spark.read.parquet(f"{d}/listing.parquet")))
    return directory_report(files).where("too_many").select("dir")


def p3_plan(spark: SparkSession, d: str) -> DataFrame:
    """Every img and mask of items once, with its place in an output file."""
    return manifest_plan(spark.read.parquet(f"{d}/items.parquet"), spark.read.parquet(f"{d}/listing.parquet"))


def p3_outputs(spark: SparkSession, d: str) -> DataFrame:
    """The output files of the plan, with their sizes."""
    p = p3_plan(spark, d).where("output is not null")
    return p.groupBy("output").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max(F.col("offset") + F.col("length")).alias("end"))


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each status: files of the plan, those planned twice, their bytes; and faults: places that don't follow one another, outputs that begin a target's bytes or more after their first file."""
    p = Workspace(spark, "checks").cut(p3_plan(spark, d))
    w = Window.partitionBy("output").orderBy("seq")
    p = p.withColumn("due", F.when(F.col("output").isNotNull(), F.coalesce(F.lag(F.col("offset") + F.col("length")).over(w), F.lit(0)))).withColumn("nth", F.row_number().over(w))
    bad = F.coalesce((F.col("due") != F.col("offset")) | (F.col("nth") != F.col("seq")) | (F.col("offset") >= MB128), F.lit(False))
    return p.groupBy("status").agg(F.count("*").alias("files"), (F.count("*") - F.countDistinct("file")).alias("twice"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"), F.count_if(bad).alias("faults"))


def p3_consolidated(spark: SparkSession, d: str) -> DataFrame:
    """The texts of documents written as many small files of lines, planned and joined byte by byte into few: lines, bytes and a checksum of what was there, and the files before and after that must be far fewer."""
    root = Workspace(spark, "small-files").folder
    line = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]", " ")
    docs = spark.read.parquet(f"{d}/documents.parquet").select(line.alias("value"), F.pmod(F.xxhash64("doc_id"), F.lit(200)).alias("bucket"))
    docs.repartition(200, "bucket").write.partitionBy("bucket").text(f"{root}/in")
    li = listing(spark, f"{root}/in").where("startswith(name, 'part-')").select("path", "length")
    files = li.select(path_plain("path").alias("file"), F.col("length")).withColumn("dir", F.regexp_replace("file", "/?[^/]*$", ""))
    dirs = files.groupBy("dir").agg(F.sum("length").alias("bytes")).withColumn("too_many", F.lit(True))
    depth = root.count("/")
    done = concatenate(compaction_plan(files, dirs, 8 << 20, small_dirs_by=depth + 1), f"{root}/out", "lines")
    n = done.agg(F.sum("n_files").alias("before"), F.count("*").alias("after"), F.sum("bytes").cast("long").alias("bytes"))
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "compact-*").text(f"{root}/out")
    sums = F.sum(F.conv(F.substring(F.md5("value"), 1, 8), 16, 10).cast("long"))
    x = text.agg(F.count("*").alias("lines"), sums.alias("checksum"))
    return x.join(n).select("lines", "bytes", "checksum", (F.col("before") >= 8 * F.col("after")).alias("far_fewer"))


QUERIES = {"p3_found": p3_found, "p3_plan": p3_plan, "p3_outputs": p3_outputs, "p3_checks": p3_checks, "p3_consolidated": p3_consolidated}
_FILE = path_sql("{c}")

SQL = {
    "p3_consolidated": r"""
        WITH l AS (SELECT regexp_replace(coalesce(text, ''), '[\r\n]', ' ', 'g') AS v FROM documents)
        SELECT count(*) AS lines, CAST(sum(strlen(v) + 1) AS BIGINT) AS bytes, CAST(sum(CAST('0x' || substr(md5(v), 1, 8) AS BIGINT)) AS BIGINT) AS checksum, true AS far_fewer FROM l""",
    "p3_checks": f"""
        WITH o AS (SELECT DISTINCT unnest([{_FILE.format(c="img")}, {_FILE.format(c="mask")}]) AS file FROM items),
        l AS (SELECT {_FILE.format(c="path")} AS file, max(length) AS length, true AS listed FROM listing GROUP BY 1)
        SELECT CASE WHEN listed IS NULL THEN 'unlisted' WHEN length > 0 THEN 'placed' WHEN length = 0 THEN 'empty' ELSE 'unknown length' END AS status, count(*) AS files, CAST(0 AS BIGINT) AS twice,
          CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS faults FROM o LEFT JOIN l USING (file) WHERE file <> '' GROUP BY 1""",
    "p3_found": r"""
        WITH f AS (
          SELECT regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(path, '^\s+|\s+$', '', 'g'), '\', '/'), '/+', '/', 'g'),
                   '/(\./)+', '/', 'g'), '^(\./)+', '') AS file, max(length) AS length
          FROM listing WHERE length > 0 GROUP BY 1),
        n AS (SELECT regexp_replace(file, '/?[^/]*$', '') AS dir, regexp_extract(file, '[^/]*$') AS name, length FROM f)
        SELECT dir FROM n
        WHERE NOT starts_with(name, '.') AND NOT starts_with(name, '_') AND regexp_matches(name, '(?i)(jpg|jpeg|png|webp|tif|bmp|tar)$')
        GROUP BY dir HAVING count(*) >= 8 * ceil(sum(length) / 134217728.0)"""
}
