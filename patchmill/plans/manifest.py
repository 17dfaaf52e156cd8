"""Queries: manifests, filters, quality checks, samples, weights and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchmill.operators import manifest as M
from patchmill.operators import sampling as S
from patchmill.plans.bindings import ITEMS, LISTING, LOC, items, listing, loc, path_sql

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SPL = "coalesce(kind IN ('imdsplice','casiasplice'), false)"
_REAL = "coalesce(kind IN ('imdreal','casiareal','indoorreal'), false)"
_KEY = "md5(coalesce(source,'None') || '|' || coalesce(kind,'None') || '|' || coalesce(case_id,'None') || '|' || coalesce(img,'None'))"


@query(f"WITH {ITEMS} SELECT item_id, {_SPL} AS splice, {_REAL} AS real, CAST(CASE WHEN {_REAL} THEN 0 ELSE 1 END AS INT) AS label FROM it")
def flt_kinds(spark, d):
    return items(spark, d).select("item_id", S.is_splice().alias("splice"), S.is_real().alias("real"), S.detection_label().alias("label"))


@query(f"WITH {ITEMS} SELECT item_id, img FROM it WHERE coalesce(source, '') = 'casia'")
def flt_items_for_source(spark, d):
    return items(spark, d).where(F.coalesce("source", F.lit("")) == "casia").select("item_id", "img")


@query(f"WITH {LISTING} SELECT path, ext FROM li WHERE ext IN ('.jpg','.jpeg','.png','.bmp','.webp','.tif')")
def flt_valid_images(spark, d):
    return M.valid_images(listing(spark, d)).select("path", "ext")


@query(f"""WITH {LOC} SELECT sample_id,
  CASE WHEN area IS NULL OR NOT isfinite(area) OR area <= 0.05 THEN 'tiny' WHEN area < 0.15 THEN 'small' WHEN area < 0.30 THEN 'medium' ELSE 'large' END AS tier4,
  CASE WHEN area < 0.15 THEN 'small' WHEN area < 0.30 THEN 'medium' ELSE 'large' END AS bucket3,
  CASE WHEN area <= 0.05 THEN 'tiny' WHEN area < 0.15 THEN 'small' WHEN area < 0.30 THEN 'medium' ELSE 'large' END AS bucket4 FROM lo""")
def flt_area_tiers(spark, d):
    from patchmill.functions.tiers import area_bucket, area_tier, size_bucket

    return loc(spark, d).select("sample_id", area_tier("area").alias("tier4"), size_bucket("area").alias("bucket3"), area_bucket("area").alias("bucket4"))


_TG = f"""WITH {ITEMS}, tg AS (SELECT item_id, img, mask, extras['tgif_model'] AS model, extras['tgif_type'] AS type, extras['tgif_mask_type'] AS mt, extras['tgif_coco_id'] AS coco,
  extras['tgif_category'] AS category, TRY_CAST(extras['tgif_var_id'] AS INT) AS var FROM it WHERE source = 'tgif2' AND extras IS NOT NULL)"""


def _tgif(spark, d):
    e = lambda k: F.try_element_at("extras", F.lit(k))
    return items(spark, d).where("source = 'tgif2' and extras is not null").select("item_id", "img", "mask", e("tgif_model").alias("model"), e("tgif_type").alias("type"), e("tgif_mask_type").alias("mt"), e("tgif_coco_id").alias("coco"), e("tgif_category").alias("category"), F.expr("try_cast(try_element_at(extras, 'tgif_var_id') as int)").alias("var"))


@query(_TG + " SELECT item_id, model FROM tg WHERE contains(regexp_replace(lower(model), '[^a-z]', '', 'g'), 'fluxfill')")
def flt_model_filter(spark, d):
    return M.model_filter(_tgif(spark, d), "model", "Flux-Fill").select("item_id", "model")


@query(_TG + " SELECT item_id, model FROM tg")
def flt_model_filter_fallback(spark, d):
    return M.model_filter(_tgif(spark, d), "model", "nosuchmodel").select("item_id", "model")


@query(_TG + " SELECT coalesce(type, 'NA') AS type, CASE WHEN mt = 'random' THEN 'random' ELSE 'semantic' END AS family, count(*) AS n FROM tg GROUP BY 1, 2")
def flt_cells(spark, d):
    return _tgif(spark, d).groupBy(F.coalesce("type", F.lit("NA")).alias("type"), M.mask_family(F.col("mt")).alias("family")).agg(F.count("*").alias("n"))


@query(_TG + """ SELECT type, model, mt, count(*) AS n FROM tg GROUP BY GROUPING SETS ((type), (model), (mt), (model, type, mt))""")
def agg_grouping_sets(spark, d):
    return _tgif(spark, d).groupingSets([["type"], ["model"], ["mt"], ["model", "type", "mt"]], "type", "model", "mt").agg(F.count("*").alias("n"))


@query(_TG + """ SELECT coco AS scene, category, model, type, img, split_part(mt || '_' || var, '_', 1) AS mask_type, CASE WHEN mt = 'random' THEN 'random' ELSE 'semantic' END AS family, var AS variation_id, mask
  FROM tg WHERE model IS NOT NULL AND coco IS NOT NULL AND mt IS NOT NULL AND var IS NOT NULL""")
def src_nested_index(spark, d):
    """The nested JSON index is built from the manifest, one document for each scene, and read again."""
    t = _tgif(spark, d).where("model is not null and coco is not null and mt is not null and var is not null").withColumn("used", F.concat_ws("_", "mt", "var"))
    masks = t.where("mask is not null").select("coco", "used", "mask").groupBy("coco", "used").agg(F.max("mask").alias("mask")).groupBy("coco").agg(F.map_from_entries(F.collect_list(F.struct("used", "mask"))).alias("masks"))
    man = t.groupBy("coco").agg(F.max("category").alias("category"), F.collect_list(F.struct("type", "model", F.col("img").alias("fake_path"), F.col("used").alias("mask_used"), F.col("var").alias("variation_id"))).alias("manipulations"))
    doc = man.join(masks, "coco", "left").select(F.to_json(F.create_map(F.col("coco"), F.struct("category", F.lit(None).cast("string").alias("original_512"), "masks", "manipulations"))).alias("json"))
    x = M.nested_index(doc)
    kind = M.mask_type(F.col("mask_used"))
    return x.select("scene", "category", "model", "type", "img", kind.alias("mask_type"), M.mask_family(kind).alias("family"), "variation_id", "mask")


_OK = "ext IN ('.jpg','.jpeg','.png','.bmp','.webp','.tif')"


def _held(keys: str, key: str, name: str, seed: str = "42") -> str:
    """CTE name(key, split): the first tenth of the keys by hash is held out."""
    return f"{name} AS (SELECT {key}, CASE WHEN row_number() OVER (ORDER BY md5('{seed}|' || {key}), {key}) <= floor(count(*) OVER () * 0.1e0) THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT {key} FROM {keys} WHERE {key} IS NOT NULL))"


def _part(where: str, as_: str, base: str) -> str:
    return f"(SELECT {base} AS base, max(struct_pack(n := name, p := path)).p AS {as_} FROM li WHERE {_OK} AND {where} GROUP BY 1)"


_BASE = "regexp_replace(stem, '_(modified|original|orig|mask|fake|real|inpainted|gt)$', '')"
_IMD = f"""im AS (SELECT *, split_part(path, '/', -2) AS case_id FROM li WHERE {_OK} AND contains(path, '/imd2020/')), {_held("im", "case_id", "im_s")},
  im_o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY name, path) AS rk FROM im WHERE contains(stem, '_orig')),
  im_m AS (SELECT case_id, regexp_replace(stem, '_mask$', '') AS stem, path AS mask FROM im WHERE ends_with(name, '_mask.png')),
  im_r AS (SELECT r.*, im_s.split FROM (SELECT path AS img, CAST(NULL AS VARCHAR) AS mask, 'imd_real' AS kind, case_id, 'imd2020' AS source FROM im_o WHERE rk = 1
    UNION ALL SELECT im.path, im_m.mask, 'imd_splice', im.case_id, 'imd2020' FROM im JOIN im_m ON im.case_id = im_m.case_id AND im.stem = im_m.stem
    WHERE NOT contains(im.stem, '_orig') AND NOT ends_with(im.stem, '_mask') AND im.case_id IN (SELECT case_id FROM im_o)) r JOIN im_s ON im_s.case_id = r.case_id)"""
_CASIA = f"""ca AS (SELECT r.base, r.real, f.fake, m.mask, nullif(regexp_extract(r.base, '^casia_([^_]*)_(.*)$', 1), '') AS bg_id,
    regexp_extract(nullif(regexp_extract(r.base, '^casia_([^_]*)_(.*)$', 2), ''), '^[^_]+') AS fg_id
  FROM {_part("contains(path, '/casia/images/') AND ends_with(stem, '_real')", "real", _BASE)} r JOIN {_part("contains(path, '/casia/images/') AND ends_with(stem, '_fake')", "fake", _BASE)} f USING (base)
  JOIN {_part("contains(path, '/casia/masks/') AND ends_with(stem, '_mask')", "mask", _BASE)} m USING (base)), ca_k AS (SELECT * FROM ca WHERE bg_id <> '' AND fg_id <> ''),
  {_held("ca_k", "bg_id", "ca_b", "42|bg_id")}, {_held("ca_k", "fg_id", "ca_f", "42|fg_id")},
  ca_t AS (SELECT ca.*, ca_b.split FROM ca JOIN ca_b USING (bg_id) JOIN ca_f USING (fg_id) WHERE ca_b.split = ca_f.split),
  ca_r AS (SELECT real AS img, CAST(NULL AS VARCHAR) AS mask, 'imd_real' AS kind, base AS case_id, 'casia' AS source, bg_id, fg_id, split FROM ca_t
    UNION ALL SELECT fake, mask, 'imd_splice', base, 'casia', bg_id, fg_id, split FROM ca_t)"""
_GLIDE = f"""gl AS (SELECT m.base, m.m, o.o, k.k FROM {_part("contains(path, '/glidefill/modified/')", "m", _BASE)} m JOIN {_part("contains(path, '/glidefill/original/')", "o", _BASE)} o USING (base)
  JOIN {_part("contains(path, '/glidefill/mask/')", "k", _BASE)} k USING (base)), {_held("gl", "base", "gl_s")},
  gl_r AS (SELECT o AS img, CAST(NULL AS VARCHAR) AS mask, 'imd_real' AS kind, CAST(NULL AS VARCHAR) AS real_path, 'glidefill_' || base AS case_id, 'glidefill' AS source, split FROM gl JOIN gl_s USING (base)
    UNION ALL SELECT m, k, 'casia_splice', o, 'glidefill_' || base, 'glidefill', split FROM gl JOIN gl_s USING (base))"""
_ANY = f"""an AS (SELECT r.base, r.real, f.fake, m.mask FROM {_part("contains(path, '/anyedit/images/') AND regexp_matches(lower(stem), '_(real|original)$')", "real", _BASE)} r
  JOIN {_part("contains(path, '/anyedit/images/') AND regexp_matches(lower(stem), '_(fake|modified)$')", "fake", _BASE)} f USING (base) LEFT JOIN {_part("contains(path, '/anyedit/masks/')", "mask", _BASE)} m USING (base)), {_held("an", "base", "an_s")},
  an_r AS (SELECT real AS img, CAST(NULL AS VARCHAR) AS mask, 'imd_real' AS kind, CAST(NULL AS VARCHAR) AS real_path, 'anyedit_' || base AS case_id, 'anyedit' AS source, split FROM an JOIN an_s USING (base)
    UNION ALL SELECT fake, mask, 'casia_splice', NULL, 'anyedit_' || base, 'anyedit', split FROM an JOIN an_s USING (base))"""
_BFREE = rf"""bf_a AS {_part("contains(path, '/bfree/anchor/')", "anchor", "regexp_replace(lower(stem), '_anchor$', '')")},
  bf_b AS {_part("contains(path, '/bfree/bbox/')", "box", "regexp_replace(lower(stem), '_mask$', '')")}, bf_x AS {_part("contains(path, '/bfree/exact/')", "exact", "regexp_replace(lower(stem), '_mask$', '')")},
  bf_e AS (SELECT regexp_replace(lower(stem), '_(diffcat|samecat)\d+$', '') AS base, lower(stem) AS edit, regexp_extract(path, '/bfree/(diffcat|samecat)/', 1) AS variant, path AS fake
    FROM li WHERE {_OK} AND regexp_matches(path, '/bfree/(diffcat|samecat)/')),
  bf AS (SELECT bf_e.*, anchor, box, exact FROM bf_e JOIN bf_a ON bf_e.base = bf_a.base LEFT JOIN bf_b ON bf_b.base = bf_e.edit LEFT JOIN bf_x ON bf_x.base = bf_e.edit), {_held("bf", "base", "bf_s")},
  bf_r AS (SELECT 'bfree_' || base || '_' || variant AS case_id, variant, fake AS img, coalesce(CASE WHEN variant = 'diffcat' THEN box END, exact) AS mask, 'casia_splice' AS kind, anchor AS real_path, split, 'bfree' AS source FROM bf JOIN bf_s USING (base)
    UNION ALL SELECT DISTINCT 'bfree_' || base, CAST(NULL AS VARCHAR), anchor, CAST(NULL AS VARCHAR), 'imd_real', CAST(NULL AS VARCHAR), split, 'bfree' FROM bf JOIN bf_s USING (base))"""
_INDOOR = f"""in_r AS (SELECT path AS img, CAST(NULL AS VARCHAR) AS mask, 'indoor_real' AS kind, stem AS case_id, 'indoor_real' AS source, CASE WHEN contains(path, '/h000002/') THEN 'val' ELSE 'train' END AS split FROM li WHERE {_OK} AND contains(path, '/indoor/'))"""


@query(f"WITH {LISTING}, {_INDOOR} SELECT * FROM in_r")
def src_indoor(spark, d):
    return M.indoor_items(listing(spark, d), "h000002")


@query(f"WITH {LISTING}, {_IMD} SELECT * FROM im_r")
def src_imd(spark, d):
    return M.imd_items(listing(spark, d))


@query(f"WITH {LISTING}, {_CASIA} SELECT * FROM ca_r")
def src_casia(spark, d):
    return M.casia_triplets(listing(spark, d))


_GLIDE_DIRS = ("glidefill", "/glidefill/modified/", "/glidefill/original/", "/glidefill/mask/")


@query(f"WITH {LISTING}, {_GLIDE} SELECT * FROM gl_r")
def src_triplets(spark, d):
    return M.triplets(listing(spark, d), *_GLIDE_DIRS)


@query(f"""WITH {LISTING} SELECT m.base, m.img FROM {_part("contains(path, '/glidefill/modified/')", "img", _BASE)} m
  WHERE base NOT IN (SELECT o.base FROM {_part("contains(path, '/glidefill/original/')", "o", _BASE)} o JOIN {_part("contains(path, '/glidefill/mask/')", "k", _BASE)} k USING (base))""")
def src_unmatched(spark, d):
    return M.unmatched(listing(spark, d), *_GLIDE_DIRS[1:])


@query(f"WITH {LISTING}, {_ANY} SELECT * FROM an_r")
def src_anyedit(spark, d):
    return M.anyedit_items(listing(spark, d))


@query(f"WITH {LISTING}, {_BFREE} SELECT * FROM bf_r")
def src_bfree(spark, d):
    return M.bfree_items(listing(spark, d))


_BOTH = ("casia", "glidefill", "anyedit", "bfree", "tgif2")  # sources that go to both splits; imd2020 trains only, indoor_real validates only


@query(f"""WITH {LISTING}, {ITEMS}, {_IMD}, {_CASIA}, {_GLIDE}, {_ANY}, {_BFREE}, {_INDOOR},
  u AS (SELECT source, kind, split FROM im_r UNION ALL SELECT source, kind, split FROM ca_r UNION ALL SELECT source, kind, split FROM gl_r UNION ALL SELECT source, kind, split FROM an_r
    UNION ALL SELECT source, kind, split FROM bf_r UNION ALL SELECT source, kind, split FROM in_r UNION ALL SELECT source, kind, split FROM it WHERE source = 'tgif2')
  SELECT source, kind, CASE WHEN source = 'imd2020' THEN 'train' WHEN source = 'indoor_real' THEN 'val' ELSE split END AS to_split, count(*) AS n FROM u GROUP BY 1, 2, 3""")
def src_union_routed(spark, d):
    """The manifest of all seven sources, each routed to the splits that its flags name, counted."""
    li = listing(spark, d)
    frames = [M.imd_items(li), M.casia_triplets(li), M.triplets(li, *_GLIDE_DIRS), M.anyedit_items(li), M.bfree_items(li), M.indoor_items(li, "h000002"), items(spark, d).where("source = 'tgif2'").select("img", "mask", "kind", "case_id", "source", "variant", "split")]
    u = M.union_sources(*frames)
    return u.groupBy("source", "kind", M.route_split([*_BOTH, "imd2020"], [*_BOTH, "indoor_real"]).alias("to_split")).agg(F.count("*").alias("n"))


_ISSUES = f"""WITH {ITEMS}, {LISTING}, f AS (SELECT path, coalesce(length, 1) > 0 AS ok FROM li),
  x AS (SELECT it.*, a.ok AS i, b.ok AS m, c.ok AS r FROM it LEFT JOIN f a ON a.path = {path_sql("it.img")} LEFT JOIN f b ON b.path = {path_sql("it.mask")} LEFT JOIN f c ON c.path = {path_sql("it.real_path")}),
  q AS (SELECT item_id, source, 'MISSING_IMG' AS code, img AS detail FROM x WHERE i IS NULL
  UNION ALL SELECT item_id, source, 'UNREADABLE_IMG', img FROM x WHERE NOT i
  UNION ALL SELECT item_id, source, 'SPLICE_NO_MASK', coalesce(kind, '') FROM x WHERE {_SPL} AND coalesce(mask, '') = ''
  UNION ALL SELECT item_id, source, 'MISSING_MASK', mask FROM x WHERE mask <> '' AND m IS NULL
  UNION ALL SELECT item_id, source, 'UNREADABLE_MASK', mask FROM x WHERE NOT m
  UNION ALL SELECT item_id, source, 'MISSING_REALPATH', real_path FROM x WHERE real_path <> '' AND r IS NULL
  UNION ALL SELECT item_id, source, 'UNREADABLE_REALPATH', real_path FROM x WHERE NOT r)"""


def _issues(spark, d):
    return M.quality_issues(items(spark, d), M.file_facts(listing(spark, d)))


@query(_ISSUES + " SELECT item_id, coalesce(source, 'unknown') AS source, code, detail FROM q")
def src_quality_issues(spark, d):
    return _issues(spark, d)


@query(_ISSUES + """ SELECT CASE WHEN GROUPING(s) = 1 THEN 'ALL' ELSE s END AS source, code, count(*) AS n, true AS hard
  FROM (SELECT coalesce(source, 'unknown') AS s, code FROM q) GROUP BY GROUPING SETS ((code), (s, code))""")
def src_quality_counts(spark, d):
    return M.issue_counts(_issues(spark, d))


@query(_ISSUES + """, n AS (SELECT count(DISTINCT item_id) AS flagged FROM q) SELECT (SELECT count(*) FROM it) AS checked, flagged, flagged AS hard, CAST(0 AS BIGINT) AS soft_only, CAST(CASE WHEN flagged > 0 THEN 1 ELSE 0 END AS INT) AS exit_status FROM n""")
def src_quality_verdict(spark, d):
    return M.issue_verdict(items(spark, d), _issues(spark, d))


@query(f"WITH {ITEMS} SELECT item_id, {_KEY} AS key FROM it")
def smp_stable_key(spark, d):
    return items(spark, d).select("item_id", S.stable_key().alias("key"))


@query(f"WITH {ITEMS} SELECT coalesce(source, 'unknown') AS source, coalesce(kind, 'unknown') AS kind, count(*) AS n FROM it GROUP BY 1, 2")
def agg_mix_counts(spark, d):
    return S.mix_counts(items(spark, d), "source", "kind")


@query(f"WITH {ITEMS} SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM it GROUP BY 1")
def agg_source_counts(spark, d):
    return S.mix_counts(items(spark, d), "source")


@query(f"WITH {ITEMS} SELECT item_id FROM it ORDER BY md5('swin|' || img), img, item_id LIMIT 200")
def smp_bottom_by_hash(spark, d):
    return S.bottom_by_hash(items(spark, d), 200, "swin").select("item_id")


@query(f"""WITH {ITEMS}, r AS (SELECT * FROM it WHERE {_REAL}), n AS (SELECT greatest(1, CAST(round_even(count(*) * 0.1, 0) AS BIGINT)) AS n FROM r)
  SELECT item_id FROM (SELECT item_id, row_number() OVER (ORDER BY md5('base|reals|' || img), img, item_id) AS rk FROM r) CROSS JOIN n WHERE rk <= n""")
def smp_reals_at_rate(spark, d):
    return S.reals_at_rate(items(spark, d).where(S.is_real()), 0.1, "base").select("item_id")


@query(_TG + """, k AS (SELECT DISTINCT coco FROM tg WHERE coco IS NOT NULL), r AS (SELECT coco, row_number() OVER (ORDER BY md5('half|' || coco), coco) AS rk, count(*) OVER () AS n FROM k)
  SELECT coco, CASE WHEN rk <= round_even(n * 0.5, 0) THEN 'train' ELSE 'val' END AS side FROM r""")
def smp_rank_split(spark, d):
    return S.rank_split(_tgif(spark, d), "coco", 0.5, "half")


@query(f"""WITH {ITEMS}, c AS (SELECT DISTINCT source, coalesce(case_id, 'None') AS case_id FROM it WHERE source IN ('casia')), t AS (SELECT case_id FROM c ORDER BY md5('casia|' || case_id), case_id LIMIT 40),
  r AS (SELECT item_id, kind, row_number() OVER (PARTITION BY coalesce(case_id, 'None'), kind ORDER BY {_KEY}, item_id) AS rk FROM it WHERE source = 'casia' AND coalesce(case_id, 'None') IN (SELECT case_id FROM t) AND kind IN ('imdreal', 'imdsplice'))
  SELECT item_id FROM r WHERE rk = 1""")
def smp_case_pairs(spark, d):
    return S.case_pairs(items(spark, d), "casia", 40).select("item_id")


@query(f"""WITH {ITEMS}, r AS (SELECT item_id, source, CASE WHEN kind IN ('imdreal','indoorreal') THEN 'single' WHEN kind = 'imdsplice' THEN 'splice' END AS s, {_KEY} AS k FROM it WHERE source IN ('imd2020', 'casia')),
  n AS (SELECT *, row_number() OVER (PARTITION BY source, s ORDER BY k, item_id) AS rk FROM r WHERE s IS NOT NULL) SELECT item_id FROM n WHERE rk <= CASE WHEN s = 'single' THEN 30 ELSE 20 END""")
def smp_first_per_source(spark, d):
    return S.first_per_source(items(spark, d), 30, 20).select("item_id")


@query(f"""WITH {ITEMS}, x AS (SELECT item_id, source, kind, coalesce(source, 'unknown') AS s, coalesce(kind, 'unknown') AS k, {_KEY} AS key FROM it),
  g AS (SELECT s, k, count(*) AS n, 300.0e0 * count(*) / sum(count(*)) OVER () AS exact, row_number() OVER (ORDER BY s, k) AS idx FROM x GROUP BY s, k),
  a AS (SELECT *, least(n, greatest(1, floor(exact))) AS q, exact - floor(exact) AS rem FROM g),
  b AS (SELECT *, sum(q) OVER () - 300 AS over_, row_number() OVER (PARTITION BY q > 1 ORDER BY rem, idx) AS place FROM a),
  c AS (SELECT *, q - CASE WHEN q > 1 AND place <= over_ THEN 1 ELSE 0 END AS q1 FROM b),
  e AS (SELECT *, 300 - sum(q1) OVER () AS short_, coalesce(sum(n - q1) OVER (ORDER BY rem DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM c),
  f AS (SELECT s, k, q1 + greatest(0, least(n - q1, short_ - taken)) AS quota FROM e),
  r AS (SELECT x.*, quota, row_number() OVER (PARTITION BY x.s, x.k ORDER BY key, item_id) AS rk FROM x JOIN f ON f.s = x.s AND f.k = x.k)
  SELECT item_id, source, kind FROM r WHERE rk <= quota ORDER BY key LIMIT 300""")
def smp_stratified_cap(spark, d):
    return S.stratified_cap(items(spark, d), 300).select("item_id", "source", "kind")


@query(f"""WITH {ITEMS}, n AS (SELECT count(*) FILTER ({_SPL}) AS s, count(*) FILTER (NOT {_SPL}) AS r FROM it)
  SELECT item_id, CASE WHEN s = 0 OR r = 0 THEN 1.0e0 WHEN {_SPL} THEN 0.6e0 / s ELSE (1 - 0.6e0) / r END AS weight FROM it CROSS JOIN n""")
def smp_class_weights(spark, d):
    return S.class_weights(items(spark, d), 0.6).select("item_id", "weight")


@query(f"""WITH {ITEMS}, x AS (SELECT item_id, {_SPL} AS sp, coalesce(source, 'unknown') AS src FROM it), n AS (SELECT sp, CASE WHEN sp THEN src END AS cell, count(*) AS n FROM x GROUP BY 1, 2)
  SELECT item_id, CASE WHEN x.sp THEN 0.5e0 * CASE src WHEN 'casia' THEN 0.5e0 WHEN 'imd2020' THEN 0.3e0 WHEN 'tgif2' THEN 0.2e0 ELSE 0 END / n ELSE 0.5e0 / n END AS weight
  FROM x JOIN n ON x.sp = n.sp AND n.cell IS NOT DISTINCT FROM CASE WHEN x.sp THEN src END""")
def smp_source_class_weights(spark, d):
    return S.source_class_weights(items(spark, d), {"casia": 5, "imd2020": 3, "tgif2": 2}).select("item_id", "weight")


@query()
def smp_weighted_draws(spark, d):
    return S.weighted_draws(S.class_weights(items(spark, d)), "item_id", "weight", 2000, seed=3, replicas=3)


@query(f"""WITH {ITEMS} SELECT CAST(2001 AS BIGINT) AS rows, CAST(2001 AS BIGINT) AS draws, CAST(3 AS BIGINT) AS shards, CAST(0 AS BIGINT) AS strangers, true AS classes_even""")
def smp_weighted_checks(spark, d):
    """An epoch of weighted draws: its rows, numbers and shards, ids that are no item, and whether both classes have about half."""
    x = items(spark, d)
    w = S.weighted_draws(S.class_weights(x), "item_id", "weight", 2000, seed=3, replicas=3)
    y = w.join(x.select(F.col("item_id").alias("id"), S.is_splice().alias("s")), "id", "left")
    return y.agg(F.count("*").alias("rows"), F.countDistinct("draw").alias("draws"), F.countDistinct("shard").alias("shards"), F.count_if(F.col("s").isNull()).alias("strangers"), (F.abs(F.avg(F.col("s").cast("double")) - 0.5) < 0.05).alias("classes_even"))


@query(f"WITH {ITEMS} SELECT item_id, CAST((row_number() OVER (ORDER BY item_id) - 1) % 8 AS INT) AS shard FROM it")
def smp_shards(spark, d):
    return S.shards(items(spark, d).select("item_id"), ["item_id"], 8)


_EPOCH = "WITH h AS (SELECT item_id, md5('11|2|' || item_id) AS h FROM (SELECT DISTINCT item_id FROM items WHERE item_id IS NOT NULL)), r AS (SELECT item_id, row_number() OVER (ORDER BY h, item_id) - 1 AS pos, count(*) OVER () AS n FROM h)"


@query(_EPOCH + """, t AS (SELECT item_id, pos, least(n, 1001) AS n FROM r WHERE pos < 1001), p AS (SELECT item_id, pos FROM t UNION ALL SELECT item_id, pos + n FROM t WHERE pos < (4 - n % 4) % 4)
  SELECT item_id, CAST(pos % 4 AS INT) AS shard, pos FROM p""")
def smp_epoch_subset(spark, d):
    return S.with_epoch_subset(items(spark, d), "item_id", 1001, 4, 11, 2)


@query(_EPOCH + """, p AS (SELECT item_id, pos FROM r UNION ALL SELECT item_id, pos + n FROM r WHERE pos < (4 - n % 4) % 4), b AS (SELECT item_id, CAST(pos % 4 AS INT) AS shard, CAST((pos // 4) // 32 AS INT) AS batch_no, CAST((pos // 4) % 32 AS INT) AS place FROM p)
  SELECT item_id, shard, batch_no, place FROM (SELECT *, count(*) OVER (PARTITION BY shard, batch_no) AS k FROM b) WHERE k = 32""")
def smp_loader_plan(spark, d):
    """Batches of 32 for four replicas over all items in the order of an epoch."""
    return S.loader_plan(items(spark, d), "item_id", batch=32, replicas=4, seed=11, epoch=2)


@query(f"""WITH {ITEMS}, h AS (SELECT item_id, md5('cap|' || coalesce(img, '')) AS h, img FROM it WHERE {_REAL}), r AS (SELECT item_id, row_number() OVER (ORDER BY h, img) AS rk FROM h), t AS (SELECT *, count(*) OVER () AS n FROM r WHERE rk <= 500)
  SELECT item_id, CASE WHEN rk <= greatest(1, floor(n * 0.1e0)) THEN 'val' ELSE 'train' END AS split FROM t""")
def smp_capped_subset(spark, d):
    return S.capped_subset(items(spark, d).where(S.is_real()), 500, 0.1, "cap").select("item_id", "split")


@query(f"""WITH {ITEMS} SELECT item_id, CAST(('0x' || substr(md5(coalesce(img, '')), 1, 8)) AS BIGINT) AS seed, regexp_replace(regexp_replace(coalesce(case_id, ''), '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe FROM it""")
def udf_stable_seed(spark, d):
    """A seed from the first 8 hexadecimal digits of an MD5, and a name safe for files."""
    seed = F.conv(F.substring(F.md5(F.coalesce("img", F.lit(""))), 1, 8), 16, 10).cast("bigint")
    safe = F.regexp_replace(F.regexp_replace(F.coalesce("case_id", F.lit("")), "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return items(spark, d).select("item_id", seed.alias("seed"), safe.alias("safe"))


@query(f"""WITH {ITEMS}, q AS (SELECT DISTINCT source FROM it WHERE source IS NOT NULL), done AS (SELECT DISTINCT source FROM it WHERE split = 'test' AND kind = 'indoorreal')
  SELECT source FROM q WHERE source NOT IN (SELECT source FROM done WHERE source IS NOT NULL)""")
def dst_queue_minus_done(spark, d):
    """Queue entries without a finished marker."""
    x = items(spark, d)
    return x.select("source").where("source is not null").distinct().join(x.where("split = 'test' and kind = 'indoorreal'").select("source").distinct(), "source", "left_anti")


@query(f"""WITH {ITEMS} SELECT case_id, min_by(img, item_id) AS first_wins, max_by(img, item_id) AS last_wins FROM it WHERE case_id IS NOT NULL GROUP BY case_id""")
def dst_merge_ranks(spark, d):
    """Merging of keyed parts: the first or the last one wins."""
    return items(spark, d).where("case_id is not null").groupBy("case_id").agg(F.min_by("img", "item_id").alias("first_wins"), F.max_by("img", "item_id").alias("last_wins"))
