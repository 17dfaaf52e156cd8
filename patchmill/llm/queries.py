"""Queries of the training-data operators over the whole tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchmill.functions.labels import label, label_or_unknown, path_plain, with_names
from patchmill.llm.cutoffs import keep_cutoffs
from patchmill.llm.epochs import Ledger, epoch_ledger, epoch_sample, picks_as_ledger, record_key
from patchmill.llm.mixing import SourceMix
from patchmill.llm.overlap import overlap_report
from patchmill.llm.packing import pack, pack_report
from patchmill.llm.pictures import overlapping_pictures, same_picture_pairs
from patchmill.llm.proportions import ProportionSample
from patchmill.llm.related import related_components, split_groups
from patchmill.llm.subjects import document_subjects
from patchmill.llm.tokens import word_tokens
from patchmill.storage import Workspace


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    p = same_picture_pairs(_t(spark, d, "items"))
    return p.select(F.least("id_e", "id_t").alias("item_id_a"), F.greatest("id_e", "id_t").alias("item_id_b")).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(same_picture_pairs(_t(spark, d, "items")), "c_source_e")


def p1_near(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps by split, source and similarity: 1 where both names are written alike, less where they are not."""
    p = overlapping_pictures(_t(spark, d, "items"))
    return overlap_report(p.withColumn("similarity", F.round("similarity", 3)), "c_source_e", "similarity")


def _proportions(spark: SparkSession, d: str) -> ProportionSample:
    items = _t(spark, d, "items").select("item_id", label_or_unknown("source").alias("source_l"), label_or_unknown("kind").alias("kind_l"))
    targets = _t(spark, d, "sample_targets").withColumns({"source_l": label_or_unknown("source"), "kind_l": label_or_unknown("kind")})
    return ProportionSample(items, targets, "item_id", ["source_l", "kind_l"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _proportions(spark, d).report().where("short").select("request_id", "source", "kind").distinct()


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return _proportions(spark, d).draw()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    s = _proportions(spark, d)
    got = s.draw().groupBy("request_id", "source_l", "kind_l").agg(F.count("*").alias("drawn"))
    return s.report().join(got, ["request_id", "source_l", "kind_l"], "left").na.fill(0, ["drawn"]).select("request_id", "source", "kind", "target_share", "min_rows", "available", "wanted", "needed", "due", "short", "drawn").withColumn("reached_share", F.try_divide(F.col("drawn").cast("double"), F.sum("drawn").over(Window.partitionBy("request_id")))).withColumn("gap", F.col("target_share") - F.col("reached_share"))


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each request: its categories, drawn records that are not distinct items of their category, and whether each category was drawn within one of what is due and that lies between its floor and what there is."""
    s = _proportions(spark, d)
    drawn = s.draw()
    wrong = drawn.join(s.rows.withColumnRenamed("id", "item_id"), ["item_id", *s.category], "left_anti").groupBy("request_id").agg(F.count("*").alias("w"))
    twice = drawn.groupBy("request_id", "item_id").agg(F.count("*").alias("n")).where("n > 1").groupBy("request_id").agg(F.count("*").alias("t"))
    got = drawn.groupBy("request_id", *s.category).agg(F.count("*").alias("drawn"))
    r = s.report().groupBy("request_id", *s.category).agg(F.max("due").alias("due"), F.max("available").alias("available"), F.max("min_rows").alias("min_rows")).join(got, ["request_id", *s.category], "left").na.fill(0, ["drawn"])
    c = r.groupBy("request_id").agg(F.count("*").alias("categories"), F.bool_and(F.abs(F.col("drawn") - F.col("due")) < 1 + 1e-6).alias("near_due"), F.bool_and((F.col("due") <= F.col("available") + 1e-6) & (F.col("due") >= F.least("available", "min_rows") - 1e-6)).alias("bounds_kept"))
    return c.join(wrong, "request_id", "left").join(twice, "request_id", "left").select("request_id", "categories", "near_due", "bounds_kept", (F.coalesce("w", F.lit(0)) + F.coalesce("t", F.lit(0))).alias("faults"))


def _cutoffs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, d, "loc_samples").select("sample_id", "tag", label_or_unknown("kind").alias("kind"), "bce_logit")
    fracs = _t(spark, d, "keep_targets").select(label_or_unknown("kind").alias("kind"), "keep_frac")
    return keep_cutoffs(rows, fracs, "sample_id", ["tag", "kind"], "bce_logit", "kind")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _cutoffs(spark, d)[1].select("sample_id")


def p4_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    latest = _t(spark, d, "image_bce_metrics").groupBy("tag").agg(F.max(F.struct("logged_at", "opt_threshold")).alias("m")).select("tag", F.col("m.opt_threshold").alias("opt_threshold"))
    return _cutoffs(spark, d)[0].join(latest, "tag", "left")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose scene lies in several splits: of the components of scenes as case_id and img tell them those that are torn, and of their scenes, as case_id tells them, those that are torn themselves."""
    x = with_names(_t(spark, d, "items").where("source is not null and case_id is not null and split is not null").dropDuplicates(["item_id"]).select("item_id", "img", "case_id", "source", "split"))
    of = lambda c: F.concat_ws("|", label("source"), c)
    told = F.when(F.col("p_img_scene").rlike("[0-9]"), of("p_img_scene"))  # words of a name are no scene
    x = x.select("item_id", "split", of("p_case_scene").alias("scene"), F.array(of("p_case_scene"), told).alias("e"))
    c = Workspace(spark, "scenes").cut(related_components(x, "item_id", F.col("e"), carry=("split", "scene")))
    torn = lambda k: c.groupBy(k).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a < b").select(k)
    return c.join(torn("component"), "component", "left_semi").join(torn("scene"), "scene", "left_semi").select("item_id")


def p5_split(spark: SparkSession, d: str) -> DataFrame:
    x = with_names(_t(spark, d, "items").dropDuplicates(["item_id"]).select("item_id", "img", "case_id", "source", "kind", "real_path"))
    # Folders and scene forms that tell the source where it is NULL.
    p = path_plain(F.lower("img"))
    told = F.when(F.col("p_scene").rlike(r"^[a-z]{3}\d+_[a-z]{3}\d+$"), "casia").when(F.col("p_scene").rlike(r"^h\d+_img_"), "indoorreal").when(F.col("p_role").rlike("^(anchor|diffcat|samecat)"), "bfree").when(F.col("p_role").rlike("^(real|fake)$"), "anyedit").when(F.col("p_role").rlike("^(original|modified)$"), "glidefill").when(F.col("p_role").rlike(r"^(orig|v\d+)$"), "imd2020").when(F.col("p_role").rlike("original_512|_(fr|sp)_"), "tgif2")
    scene = F.concat_ws("|", F.coalesce(label("source"), told, F.lit("unknown")), "p_scene")
    file = F.concat(F.lit("file|"), F.coalesce(path_plain("real_path"), path_plain("img")))
    x = x.withColumn("e", F.array(F.when(F.col("p_scene").isNotNull(), scene), file, F.concat(F.lit("file|"), path_plain("img")))).select("item_id", "kind", "e")
    return split_groups(x, related_components(x, "item_id", F.col("e")), "item_id", label_or_unknown("kind"), {"train": 0.7, "val": 0.15, "test": 0.15})


def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    """Records that got a split, components in several, and whether the shares of splits and of each kind within them lie near what was asked for."""
    x = p5_split(spark, d)
    due = F.when(F.col("split") == "train", 0.7).otherwise(0.15)
    kinds = x.join(_t(spark, d, "items").groupBy("item_id").agg(F.min(label_or_unknown("kind")).alias("kind")), "item_id")
    n = kinds.groupBy("split", "kind").agg(F.count("*").alias("n")).withColumns({"of_kind": F.sum("n").over(Window.partitionBy("kind")), "of_split": F.sum("n").over(Window.partitionBy("split")), "all": F.sum("n").over(Window.partitionBy(F.lit(0)))})
    near = n.agg(F.bool_and(F.abs(F.col("of_split") / F.col("all") - due) < 0.02).alias("splits_near"), F.bool_and((F.abs(F.col("n") / F.col("of_kind") - due) < 0.05) | (F.col("of_kind") < 0.05 * F.col("all"))).alias("kinds_near"))
    torn = x.groupBy("component").agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("torn"))
    return x.agg(F.count("*").alias("items"), F.countDistinct("item_id").alias("distinct_items")).join(torn).join(near)


def _epochs(spark: SparkSession, d: str) -> DataFrame:
    """The sample after three runs, each with the ledger of those before: earlier picks, the state at batch 5, all batches."""
    key = record_key(["img", "case_id"], [label("source"), label("kind")])
    x = _t(spark, d, "items").select("item_id", key.alias("key"), "batch_no")
    x = Workspace(spark, "epochs").cut(x)
    args = F.col("key"), F.col("batch_no")
    ledger = Ledger(spark, f"{Workspace(spark, 'ledger').root}/epochs")
    ledger.append("picks", picks_as_ledger(_t(spark, d, "prior_picks").select(key.alias("key"))))
    ledger.append("batch-05", epoch_ledger(x.where("batch_no <= 5"), *args, {e: 0.04 for e in range(6)}, 0.0, stored=ledger.read()).where("new"))
    return epoch_sample(x, "item_id", *args, {0: 0.04} | {e: 0.03 for e in range(1, 12)}, stored=ledger.read(), seed=7)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _epochs(spark, d).where("by = 'prior'").select("item_id")


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    return _epochs(spark, d).select("item_id", "key", "epoch", "rate", "by")


def _pack(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select("doc_id", word_tokens("text").alias("tokens"))
    return pack(docs, _t(spark, d, "pack_limits"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _pack(spark, d).where("pieces > 1").select("limit_name", "doc_id").distinct()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _pack(spark, d)


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each limit: texts, tokens, pieces, and faults: containers above their capacity, pieces that don't follow one another, whole texts that are cut."""
    x = Workspace(spark, "checks").cut(_pack(spark, d).join(_t(spark, d, "pack_limits").select("limit_name", "capacity_tokens").distinct(), "limit_name"))
    over = x.where("container is not null").groupBy("limit_name", "container").agg(F.sum("tokens").alias("t"), F.max("capacity_tokens").alias("c")).groupBy("limit_name").agg(F.count_if(F.col("t") > F.col("c")).alias("over"))
    w = Window.partitionBy("limit_name", "doc_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("due", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    s = x.groupBy("limit_name").agg(F.countDistinct("doc_id").alias("docs"), F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("pieces"), F.count_if((F.col("start") != F.col("due")) | ((F.col("tokens") < F.col("capacity_tokens")) & (F.col("piece") < F.col("pieces")))).alias("cut"))
    return s.join(over, "limit_name", "left").select("limit_name", "docs", "tokens", "pieces", (F.col("cut") + F.coalesce("over", F.lit(0))).alias("faults"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return pack_report(_pack(spark, d), _t(spark, d, "pack_limits"))


def _mix(spark: SparkSession, d: str) -> SourceMix:
    docs = _t(spark, d, "documents").select("doc_id", label("source").alias("source"), word_tokens("text").alias("tokens"))
    targets = _t(spark, d, "mix_targets").withColumnRenamed("source", "spelled").withColumn("source", label("spelled"))
    return SourceMix(docs, targets)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report().where("short").select("mix_id", F.col("spelled").alias("source")).distinct()


def p8_copies(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).copies()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    m = _mix(spark, d)
    return m.report(m.copies()).select("mix_id", F.col("spelled").alias("source"), "target_share", "max_repeats", "available", "due", "short", "assigned", "reached", "reached_share", "most_copies")


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each mix: its sources, those short, and faults: copies above the cap, and tokens that miss what is assigned by more than the longest document of each part."""
    m = _mix(spark, d)
    longest = m.docs.groupBy("source").agg(F.max("tokens").alias("longest"), F.ceil(F.count("*") / m.per_part).alias("parts"))
    r = m.report(m.copies()).join(longest, "source", "left")
    miss = F.abs(F.col("reached") - F.coalesce("assigned", F.lit(0.0))) > F.coalesce(F.col("longest") * F.col("parts"), F.lit(0)) + 1e-6 * F.col("total")
    return r.groupBy("mix_id").agg(F.count("*").alias("sources"), F.count_if("short").alias("short"), (F.count_if(F.col("most_copies") > F.col("max_repeats")) + F.count_if(miss)).alias("faults"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    names = [r["subject"] for r in _t(spark, d, "subjects").where("subject is not null").distinct().orderBy("subject").collect()]
    spelled = F.create_map(*[x for n in names for x in (label(F.lit(n)), F.lit(n))])
    seeds = _t(spark, d, "subject_labels").select("doc_id", F.try_element_at(spelled, label("subject")).alias("subject")).distinct()
    return document_subjects(_t(spark, d, "documents").select("doc_id", "text"), seeds, names, every=True)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    x = _subjects(spark, d).join(_t(spark, d, "documents").select("doc_id", word_tokens("text").alias("tokens")), "doc_id")
    return x.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.sum("share").alias("share_sum"))


QUERIES = {f.__name__: f for f in [p1_found, p1_report, p1_near, p2_found, p2_sample, p2_report, p2_checks, p4_found, p4_cutoffs, p5_found, p5_split, p5_checks, p6_found, p6_sample, p7_found, p7_containers, p7_checks, p7_report, p8_found, p8_copies, p8_checks, p8_report, p9_found, p9_composition]}

_SOURCES = "imd2020|casia|anyedit|glidefill|bfree|tgif2|indoor_real|indoorreal"
_PLAIN = r"""regexp_replace(regexp_replace(lower(trim(translate(regexp_replace({c}, '[\x{{AD}}\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '０１２３４５６７８９', '0123456789'))), '(%20|[\s\-_.])+', '_', 'g'), '^_+|_+$', '', 'g')"""


def _scene(c: str) -> str:
    """SQL for the scene that a case_id names."""
    w = f"regexp_replace({_PLAIN.format(c=c)}, '^({_SOURCES})_', '')"
    first = f"coalesce(nullif(regexp_extract({w}, '^([a-z]{{3}}[0-9]+_[a-z]{{3}}[0-9]+|h[0-9]+_img_[0-9]+)(_|$)', 1), ''), nullif(regexp_extract({w}, '^[^_]+'), ''))"
    return f"CASE WHEN regexp_matches({first}, '^[0-9]+$') THEN coalesce(nullif(ltrim({first}, '0'), ''), '0') ELSE {first} END"


_WORDS = """regexp_replace(regexp_replace({c}, '(%20|[\\s\\-_.])+', '_', 'g'), '^_+|_+$', '', 'g')"""
# scene and role of every item that has a split, step by step
_PICTURES = rf"""
  p0 AS (SELECT item_id, split, any_value(source) AS source, any_value(case_id) AS case_id, any_value(img) AS img FROM items WHERE split IS NOT NULL GROUP BY item_id, split),
  p1 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(lower(trim(translate(regexp_replace(img, '[\x{{AD}}\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g'), '０１２３４５６７８９', '0123456789'))), '^\s+|\s+$', '', 'g'), '\', '/'), '/+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '', 'g') AS path FROM p0),
  p2 AS (SELECT *, {_WORDS.format(c="regexp_extract(path, '[^/]*$')")} AS stem, {_WORDS.format(c="regexp_extract(path, '(?:^|/)(?:imd2020|tgif2/[a-z0-9_]+)/([^/]+)/[^/]+$', 1)")} AS folder,
    nullif(regexp_extract(path, '/(h[0-9]+)/[^/]*$', 1), '') AS house FROM p1),
  p3 AS (SELECT *, nullif(regexp_extract(stem, '^(img_[0-9]+)', 1), '') AS pic FROM p2),
  p4 AS (SELECT *, coalesce(house || '_' || pic, nullif(regexp_extract(stem, '(?:^|_)([a-z]{{3}}[0-9]{{6,}}_[a-z]{{3}}[0-9]{{3,}})_', 1), ''), nullif(folder, ''), nullif(regexp_extract(stem, '^[^_]+'), '')) AS told,
    coalesce(pic, nullif(regexp_extract(stem, '_([a-z0-9]+_(?:fr|sp)_[a-z0-9]+_v[0-9]+|original_512|original|modified|anchor|diffcat[0-9]+|samecat[0-9]+|real|fake|orig|v[0-9]+)(?:[_@(]|$)', 1), ''), 'img:' || img) AS role FROM p3),
  pic AS (SELECT item_id, split, source, role, coalesce({_scene("case_id")}, CASE WHEN regexp_matches(told, '^[0-9]+$') THEN coalesce(nullif(ltrim(told, '0'), ''), '0') ELSE told END) AS scene FROM p4),
  pairs AS (SELECT e.item_id AS id_e, t.item_id AS id_t, e.split, e.source FROM pic e JOIN pic t ON e.scene = t.scene AND e.role = t.role AND t.split = 'train' AND e.split IN ('val', 'test'))"""
_LABEL = "regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"
_UNKNOWN = "coalesce(" + _LABEL + ", 'unknown')"
_KEY = f"md5(to_json({{'e0': img, 'e1': case_id, 'l0': {_LABEL.format(c='source')}, 'l1': {_LABEL.format(c='kind')}}}))"
_TOKENS = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{0B}\x{1C}-\x{1F}]+'))"

SQL = {
    "p1_found": f"WITH {_PICTURES} SELECT DISTINCT least(id_e, id_t) AS item_id_a, greatest(id_e, id_t) AS item_id_b FROM pairs",
    "p1_report": f"""WITH {_PICTURES} SELECT split, coalesce({_LABEL.format(c="source")}, 'unknown') AS source, count(DISTINCT id_e) AS n_eval_records, count(DISTINCT id_t) AS n_train_records, count(*) AS n_pairs FROM pairs GROUP BY 1, 2""",
    "p4_cutoffs": f"""
        WITH r AS (SELECT sample_id, any_value(tag) AS tag, any_value({_UNKNOWN.format(c="kind")}) AS kind, any_value(CASE WHEN isnan(bce_logit) THEN NULL ELSE bce_logit END) AS s
          FROM loc_samples WHERE sample_id IS NOT NULL GROUP BY sample_id),
        f AS (SELECT {_UNKNOWN.format(c="kind")} AS kind, max(keep_frac) AS keep_frac FROM keep_targets GROUP BY 1),
        g AS (SELECT tag, kind, count(*) AS size, count(s) AS n_scored FROM r GROUP BY tag, kind),
        v AS (SELECT tag, kind, s, CAST(sum(count(*)) OVER (PARTITION BY tag, kind ORDER BY s DESC) AS BIGINT) AS kept FROM r WHERE s IS NOT NULL GROUP BY tag, kind, s),
        c AS (SELECT v.tag, v.kind, s, kept, row_number() OVER (PARTITION BY v.tag, v.kind ORDER BY abs(kept / size - keep_frac), s) AS rk
          FROM v JOIN g ON v.tag IS NOT DISTINCT FROM g.tag AND v.kind = g.kind JOIN f ON f.kind = v.kind),
        m AS (SELECT tag, max(struct_pack(logged_at := logged_at, opt_threshold := opt_threshold)).opt_threshold AS opt_threshold FROM image_bce_metrics GROUP BY tag)
        SELECT g.tag, g.kind, g.size, g.n_scored, f.keep_frac, c.s AS cutoff, coalesce(c.kept, 0) AS kept, coalesce(c.kept, 0) / g.size AS kept_frac, m.opt_threshold
        FROM g LEFT JOIN f ON f.kind = g.kind LEFT JOIN c ON c.rk = 1 AND c.tag IS NOT DISTINCT FROM g.tag AND c.kind = g.kind LEFT JOIN m ON m.tag = g.tag""",
    "p2_found": f"""
        WITH i AS (SELECT DISTINCT item_id, {_UNKNOWN.format(c="source")} AS s, {_UNKNOWN.format(c="kind")} AS k FROM items WHERE item_id IS NOT NULL),
        n AS (SELECT s, k, count(*) AS n FROM i GROUP BY s, k), t AS (SELECT count(*) AS total FROM i)
        SELECT DISTINCT request_id, r.source, r.kind FROM sample_targets r CROSS JOIN t
        LEFT JOIN n ON n.s = {_UNKNOWN.format(c="r.source")} AND n.k = {_UNKNOWN.format(c="r.kind")}
        WHERE coalesce(n.n, 0) < greatest(CAST(min_rows AS DOUBLE), target_share * sample_frac * total)""",
    "p4_found": f"""
        WITH r AS (SELECT sample_id, any_value(tag) AS tag, any_value({_UNKNOWN.format(c="kind")}) AS k, any_value(CASE WHEN isnan(bce_logit) THEN NULL ELSE bce_logit END) AS s
          FROM loc_samples WHERE sample_id IS NOT NULL GROUP BY sample_id),
        g AS (SELECT tag, k, count(*) AS size FROM r GROUP BY tag, k),
        v AS (SELECT tag, k, s, sum(count(*)) OVER (PARTITION BY tag, k ORDER BY s DESC) AS kept FROM r WHERE s IS NOT NULL GROUP BY tag, k, s),
        f AS (SELECT {_UNKNOWN.format(c="kind")} AS k, max(keep_frac) AS keep_frac FROM keep_targets GROUP BY 1),
        c AS (SELECT v.tag, v.k, s, row_number() OVER (PARTITION BY v.tag, v.k ORDER BY abs(kept / size - keep_frac), s) AS rk
          FROM v JOIN g ON v.tag IS NOT DISTINCT FROM g.tag AND v.k = g.k JOIN f ON f.k = v.k)
        SELECT sample_id FROM r JOIN c ON c.rk = 1 AND c.tag IS NOT DISTINCT FROM r.tag AND c.k = r.k WHERE r.s >= c.s""",
    "p5_found": f"""
        WITH i AS (SELECT item_id, any_value(split) AS split, any_value({_LABEL.format(c="source")} || '|' || {_scene("case_id")}) AS e
          FROM items WHERE source IS NOT NULL AND case_id IS NOT NULL AND split IS NOT NULL GROUP BY item_id),
        t AS (SELECT e FROM i GROUP BY e HAVING count(DISTINCT split) > 1)
        SELECT item_id FROM i SEMI JOIN t USING (e)""",
    "p6_found": f"""
        SELECT DISTINCT item_id FROM items i SEMI JOIN prior_picks p
          ON i.img IS NOT DISTINCT FROM p.img AND i.case_id IS NOT DISTINCT FROM p.case_id
          AND {_LABEL.format(c="i.source")} IS NOT DISTINCT FROM {_LABEL.format(c="p.source")} AND {_LABEL.format(c="i.kind")} IS NOT DISTINCT FROM {_LABEL.format(c="p.kind")}""",
    "p6_sample": f"""
        WITH k AS (SELECT item_id, batch_no, {_KEY} AS key FROM items WHERE item_id IS NOT NULL), p AS (SELECT DISTINCT {_KEY} AS key FROM prior_picks),
        f AS (SELECT key, coalesce(min(batch_no), 0) AS epoch FROM k GROUP BY key),
        l AS (SELECT f.key, CAST(CASE WHEN p.key IS NULL THEN epoch ELSE -1 END AS INT) AS epoch, CASE WHEN p.key IS NOT NULL THEN 1.0e0 WHEN epoch <= 5 THEN 0.04e0 ELSE 0.03e0 END AS rate FROM f LEFT JOIN p ON p.key = f.key),
        s AS (SELECT *, CAST(('0x' || substr(md5('7|0|' || key), 1, 13)) AS BIGINT) / 4503599627370496.0e0 AS u FROM l)
        SELECT DISTINCT item_id, s.key, s.epoch, rate, CASE WHEN s.epoch = -1 THEN 'prior' ELSE 'rate' END AS by FROM k JOIN s ON s.key = k.key WHERE u < rate""",
    "p2_checks": "SELECT request_id, count(DISTINCT (regexp_replace(lower(coalesce(source, 'unknown')), '[^a-z0-9]', '', 'g'), regexp_replace(lower(coalesce(kind, 'unknown')), '[^a-z0-9]', '', 'g'))) AS categories, true AS near_due, true AS bounds_kept, CAST(0 AS BIGINT) AS faults FROM sample_targets GROUP BY request_id",
    "p5_checks": "SELECT count(DISTINCT item_id) AS items, count(DISTINCT item_id) AS distinct_items, CAST(0 AS BIGINT) AS torn, true AS splits_near, true AS kinds_near FROM items",
    "p7_checks": f"""
        WITH n AS (SELECT limit_name, doc_id, capacity_tokens AS c, {_TOKENS} AS t FROM documents CROSS JOIN (SELECT DISTINCT limit_name, capacity_tokens FROM pack_limits))
        SELECT limit_name, count(*) AS docs, CAST(sum(coalesce(t, 0)) AS BIGINT) AS tokens, CAST(sum(greatest(1, ceil(coalesce(t, 0) / c))) AS BIGINT) AS pieces, CAST(0 AS BIGINT) AS faults FROM n GROUP BY limit_name""",
    "p8_checks": f"""
        WITH t AS (SELECT {_LABEL.format(c="source")} AS s, sum({_TOKENS}) AS n FROM documents GROUP BY 1), a AS (SELECT sum(n) AS total FROM t)
        SELECT mix_id, count(*) AS sources, count(*) FILTER (max_repeats * coalesce(t.n, 0) < target_share * size_frac * total) AS short, CAST(0 AS BIGINT) AS faults
        FROM mix_targets m CROSS JOIN a LEFT JOIN t ON t.s = {_LABEL.format(c="m.source")} GROUP BY mix_id""",
    "p7_found": f"""
        SELECT limit_name, doc_id FROM documents CROSS JOIN pack_limits WHERE {_TOKENS} > capacity_tokens""",
    "p8_found": f"""
        WITH t AS (SELECT {_LABEL.format(c="source")} AS s, sum({_TOKENS}) AS n FROM documents GROUP BY 1), a AS (SELECT sum(n) AS total FROM t)
        SELECT DISTINCT mix_id, m.source FROM mix_targets m CROSS JOIN a LEFT JOIN t ON t.s = {_LABEL.format(c="m.source")}
        WHERE max_repeats * coalesce(t.n, 0) < target_share * size_frac * total""",
}
