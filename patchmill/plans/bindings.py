"""Engine inputs bound to the tables of a folder: the same rows as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchmill.functions.labels import label, path_plain


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def items(spark: SparkSession, d: str) -> DataFrame:
    """Manifest rows, one for each item_id, with source and kind in one spelling (``indoorreal``, ``imdsplice`` ...)."""
    x = table(spark, d, "items").dropDuplicates(["item_id"])
    return x.withColumns({"source": label("source"), "kind": label("kind")})


ITEMS = """it AS (SELECT item_id, any_value(img) AS img, any_value(mask) AS mask, any_value(regexp_replace(lower(kind), '[^a-z0-9]', '', 'g')) AS kind,
  any_value(case_id) AS case_id, any_value(regexp_replace(lower(source), '[^a-z0-9]', '', 'g')) AS source, any_value(real_path) AS real_path,
  any_value(bg_id) AS bg_id, any_value(fg_id) AS fg_id, any_value(variant) AS variant, any_value(split) AS split, any_value(extras) AS extras FROM items GROUP BY item_id)"""


def listing(spark: SparkSession, d: str) -> DataFrame:
    """Files once each: (path, name, stem, ext, length), by normalised path, with the greatest length listed for it; in any folder."""
    x = table(spark, d, "listing").select(path_plain("path").alias("path"), "length").where("path <> ''")
    x = x.groupBy("path").agg(F.max("length").alias("length"))
    name = F.substring_index("path", "/", -1)
    return x.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("ext"), "length")


def path_sql(c: str) -> str:
    """SQL of path_plain."""
    return rf"regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '\', '/'), '/+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '')"


LISTING = rf"""li AS (SELECT path, regexp_extract(path, '[^/]*$') AS name, regexp_replace(regexp_extract(path, '[^/]*$'), '\.[^.]*$', '') AS stem,
  lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\.[^.]+$')) AS ext, length
  FROM (SELECT {path_sql("path")} AS path, max(length) AS length FROM listing GROUP BY 1) WHERE path <> '')"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Image scores (tag, image_id, label, logit, area) from events: label 0 is real."""
    return table(spark, d, "events").select(
        F.col("event_type").alias("tag"),
        F.col("event_id").alias("image_id"),
        F.when(F.col("user_id") % 3 == 0, 0).otherwise(1).alias("label"),
        ((F.col("value") - 50) / 25).alias("logit"),
        ((F.col("event_id") % 100) / 100).alias("area"),
    ).where("logit is not null")


SCORES = """sc AS (SELECT event_type AS tag, event_id AS image_id, CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END AS label, (value - 50) / 25.0e0 AS logit,
  (event_id % 100) / 100.0e0 AS area FROM events WHERE value IS NOT NULL)"""


def loc(spark: SparkSession, d: str) -> DataFrame:
    """Localization samples, one for each sample_id; NaN and infinite logits count as absent."""
    x = table(spark, d, "loc_samples").dropDuplicates(["sample_id"])
    ok = F.col("bce_logit").isNotNull() & ~F.isnan("bce_logit") & (F.abs("bce_logit") < F.lit(float("inf")))
    return x.withColumn("kind", label("kind")).withColumn("bce_logit", F.when(ok, F.col("bce_logit")))


LOC = """lo AS (SELECT * REPLACE (CASE WHEN isfinite(bce_logit) THEN bce_logit END AS bce_logit, regexp_replace(lower(kind), '[^a-z0-9]', '', 'g') AS kind)
  FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at) AS rn_ FROM loc_samples) WHERE rn_ = 1)"""


def patches(spark: SparkSession, d: str, n: int = 49) -> DataFrame:
    """Patch embeddings (image_id, idx, r, c, z, attention): n consecutive vectors are an image of a square grid."""
    side = int(n**0.5)
    x = table(spark, d, "embeddings")
    idx = (F.col("vec_id") % n).cast("int")
    return x.select(
        F.floor(F.col("vec_id") / n).cast("long").alias("image_id"),
        idx.alias("idx"),
        F.floor(idx / side).cast("int").alias("r"),
        (idx % side).cast("int").alias("c"),
        F.transform("embedding", lambda v: v.cast("double")).alias("z"),
        (((F.col("vec_id") * 37) % 101) / 101).alias("attention"),
        (F.col("label") % 2).cast("int").alias("lab"),
    )


PATCHES = """pa AS (SELECT vec_id // 49 AS image_id, CAST(vec_id % 49 AS INT) AS idx, CAST((vec_id % 49) // 7 AS INT) AS r, CAST((vec_id % 49) % 7 AS INT) AS c,
  CAST(embedding AS DOUBLE[]) AS z, ((vec_id * 37) % 101) / 101.0e0 AS attention, CAST(label % 2 AS INT) AS lab FROM embeddings)"""


def masks(spark: SparkSession, d: str) -> DataFrame:
    """Predicted and true patches (image_id, r, c, pred, gt) on a 28 x 28 grid from lineitem."""
    x = table(spark, d, "lineitem")
    return x.groupBy((F.col("l_orderkey") % 200).alias("image_id"), (F.col("l_partkey") % 28).cast("int").alias("r"), (F.col("l_suppkey") % 28).cast("int").alias("c")).agg(
        F.bool_or(F.col("l_quantity") > 25).alias("pred"), F.bool_or(F.col("l_discount") >= 0.05).alias("gt"), F.sum("l_extendedprice").alias("weight")
    )


MASKS = """ma AS (SELECT l_orderkey % 200 AS image_id, CAST(l_partkey % 28 AS INT) AS r, CAST(l_suppkey % 28 AS INT) AS c, bool_or(l_quantity > 25) AS pred,
  bool_or(l_discount >= 0.05) AS gt, sum(l_extendedprice) AS weight FROM lineitem GROUP BY 1, 2, 3)"""


def sizes(spark: SparkSession, d: str) -> DataFrame:
    """Image sizes (image_id, w, h) from orders."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), (200 + F.col("o_custkey") % 300).cast("int").alias("w"), (200 + F.col("o_orderkey") % 300).cast("int").alias("h"))


SIZES = "sz AS (SELECT o_orderkey AS image_id, CAST(200 + o_custkey % 300 AS INT) AS w, CAST(200 + o_orderkey % 300 AS INT) AS h FROM orders)"
