"""Queries: windows and boxes, patch graphs and clusters, losses, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchmill.functions.presets import between, preset_table
from patchmill.operators import cluster as K
from patchmill.operators import geometry as G
from patchmill.operators import losses as L
from patchmill.operators.localization import localization_samples
from patchmill.operators.metrics import mask_metrics
from patchmill.plans.bindings import LOC, MASKS, PATCHES, SCORES, SIZES, loc, masks, patches, scores, sizes
from patchmill.plans.metrics import rounded

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_STARTS = "list_sort(list_distinct(list_concat(range(0, greatest({n} - {s}, 0) + 1, greatest({st}, 1)), [greatest({n} - {s}, 0)])))"


def _grid_sql(scale: str, stride: str) -> str:
    side = f"least(greatest(28, CAST(round_even(least(w, h) * {scale}, 0) AS INT)), least(w, h))"
    return f"""gr AS (SELECT image_id, w, h, side, unnest(tops) AS top, lefts FROM (SELECT *, {_STARTS.format(n='h', s='side', st='st')} AS tops, {_STARTS.format(n='w', s='side', st='st')} AS lefts
      FROM (SELECT *, CAST(round_even(side * {stride}, 0) AS INT) AS st FROM (SELECT image_id, w, h, {side} AS side FROM sz)))),
      wg AS (SELECT image_id, w, h, side, CAST(top AS INT) AS top, CAST(unnest(lefts) AS INT) AS "left" FROM gr)"""


@query(f'WITH {SIZES}, {_grid_sql("0.7e0", "0.5e0")} SELECT image_id, side, top, "left" FROM wg')
def geo_window_grid(spark, d):
    return G.window_grid(sizes(spark, d), 0.7, 0.5, 28).select("image_id", "side", "top", "left")


@query(f"""WITH {SIZES}, {_grid_sql("0.5e0", "0.5e0")} SELECT image_id, CAST(count(*) AS INT) AS windows, substr(md5(string_agg(top || ',' || "left" || ',' || side || ';', '' ORDER BY top, "left")), 1, 12) AS hash FROM wg GROUP BY image_id""")
def geo_grid_hash(spark, d):
    return G.grid_hash(G.window_grid(sizes(spark, d), 0.5, 0.5, 28), "image_id")


@query()
def geo_capped_grid(spark, d):
    return G.capped_grid(sizes(spark, d), 0.3, 0.5, 28, 8).groupBy("image_id").agg(F.count("*").alias("windows"), F.min("top").alias("top"), F.max("left").alias("left"))


def _scaled(square: bool) -> str:
    if square:
        dims = "least(greatest(1, CAST(round_even(least(w, h) * scale, 0) AS INT)), least(w, h))"
        size, st = f"{dims} AS wh, {dims} AS ww", "CAST(round_even({x} * 0.5e0, 0) AS INT)"
    else:
        size, st = "greatest(1, CAST(trunc(h * scale) AS INT)) AS wh, greatest(1, CAST(trunc(w * scale) AS INT)) AS ww", "CAST(trunc({x} * 0.5e0) AS INT)"
    return f"""WITH {SIZES}, s AS (SELECT image_id, w, h, scale, {size} FROM sz CROSS JOIN (SELECT unnest([0.7e0, 0.5e0]) AS scale)),
      t AS (SELECT image_id, scale, wh, ww, unnest({_STARTS.format(n='h', s='wh', st=st.format(x='wh'))}) AS top, {_STARTS.format(n='w', s='ww', st=st.format(x='ww'))} AS ls FROM s)
      SELECT image_id, scale, wh, ww, CAST(top AS INT) AS top, CAST(unnest(ls) AS INT) AS "left" FROM t"""


@query(_scaled(False))
def geo_crop_windows(spark, d):
    return G.scaled_windows(sizes(spark, d), [1.0, 0.7, 0.5], 0.5, square=False).select("image_id", "scale", "wh", "ww", "top", "left")


@query(_scaled(True))
def geo_square_windows(spark, d):
    return G.scaled_windows(sizes(spark, d), [1.0, 0.7, 0.5], 0.5, square=True).select("image_id", "scale", "wh", "ww", "top", "left")


@query(f"""WITH {SIZES}, b AS (SELECT *, CAST(image_id % 97 AS INT) AS t, CAST(image_id % 89 AS INT) AS l, CAST(10 + image_id % 150 AS INT) AS bh, CAST(10 + image_id % 170 AS INT) AS bw FROM sz),
  s AS (SELECT *, least(greatest(bh, bw), h, w) AS side FROM b)
  SELECT image_id, CAST(least(greatest(t - floor((side - bh) / 2.0e0), 0), greatest(h - side, 0)) AS INT) AS top, CAST(least(greatest(l - floor((side - bw) / 2.0e0), 0), greatest(w - side, 0)) AS INT) AS "left", side FROM s""")
def geo_square_expand(spark, d):
    m = lambda k, a=0: (a + F.col("image_id") % k).cast("int")
    return sizes(spark, d).select("image_id", *G.square_expand(m(97), m(89), m(150, 10), m(170, 10), F.col("h"), F.col("w")))


@query(f"""WITH {SIZES}, s AS (SELECT image_id, w, h, h * ((image_id % 11) / 10.0e0) AS cy, w * ((image_id % 7) / 6.0e0) AS cx, greatest(8, least(CAST(round_even(sqrt(least(greatest((image_id % 13) / 20.0e0, 1e-6), 1) * h * w), 0) AS INT), h, w)) AS side FROM sz)
  SELECT image_id, CAST(least(greatest(round_even(cy - side / 2.0e0, 0), 0), greatest(h - side, 0)) AS INT) AS top, CAST(least(greatest(round_even(cx - side / 2.0e0, 0), 0), greatest(w - side, 0)) AS INT) AS "left", side FROM s""")
def geo_centered_square(spark, d):
    i = F.col("image_id")
    return sizes(spark, d).select("image_id", *G.centered_square(F.col("h") * (i % 11 / 10), F.col("w") * (i % 7 / 6), i % 13 / 20, F.col("h"), F.col("w")))


_BOX = f"""WITH {MASKS}, bx AS (SELECT image_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1, avg(r) AS cy, avg(c) AS cx, count(*) AS n FROM ma WHERE pred AND gt AND weight > 95000 GROUP BY 1)"""


def _boxes(spark, d):
    """Boxes of the patches that are predicted, true and heavy."""
    return G.mask_boxes(masks(spark, d).withColumn("m", F.col("pred") & F.col("gt") & (F.col("weight") > 95000)), "image_id", "m", 28)


@query(_BOX + " SELECT image_id, r0, r1, c0, c1, round(cy, 6) AS cy, round(cx, 6) AS cx, n FROM bx")
def geo_mask_boxes(spark, d):
    return rounded(_boxes(spark, d))


@query(_BOX + """, p AS (SELECT image_id, CAST(round_even(r0 * 300 / 28.0e0, 0) AS INT) AS a, CAST(round_even((r1 + 1) * 300 / 28.0e0, 0) AS INT) AS b, CAST(round_even(c0 * 400 / 28.0e0, 0) AS INT) AS c, CAST(round_even((c1 + 1) * 400 / 28.0e0, 0) AS INT) AS e FROM bx),
  q AS (SELECT image_id, greatest(0, least(a, 299)) AS top, greatest(0, least(c, 399)) AS "left", b, e FROM p) SELECT image_id, top, "left", greatest(top + 1, least(b, 300)) - top AS bh, greatest("left" + 1, least(e, 400)) - "left" AS bw FROM q""")
def geo_patch_box_pixels(spark, d):
    return _boxes(spark, d).select("image_id", *G.patches_to_pixels_box(F.col("r0"), F.col("r1"), F.col("c0"), F.col("c1"), F.lit(300), F.lit(400), 28))


_AX = """CASE WHEN least(27, {b} + pad) - greatest(0, {a} - pad) + 1 < 8 THEN (CASE WHEN least(27, greatest(0, CAST(round_even(({a} + {b}) * 0.5e0, 0) AS INT) - 4) + 7) = 27 THEN 20 ELSE greatest(0, CAST(round_even(({a} + {b}) * 0.5e0, 0) AS INT) - 4) END) ELSE greatest(0, {a} - pad) END AS {p}0,
  CASE WHEN least(27, {b} + pad) - greatest(0, {a} - pad) + 1 < 8 THEN least(27, greatest(0, CAST(round_even(({a} + {b}) * 0.5e0, 0) AS INT) - 4) + 7) ELSE least(27, {b} + pad) END AS {p}1"""


@query(_BOX + f""", g AS (SELECT *, greatest(2, CAST(ceil(28 * 0.15e0 / greatest(greatest(r1 - r0, c1 - c0) + 1, 1)) AS INT)) AS pad FROM bx), v AS (SELECT image_id, {_AX.format(a='r0', b='r1', p='p')}, {_AX.format(a='c0', b='c1', p='q')} FROM g)
  SELECT image_id, CAST(trunc(q0 * 448 / 28.0e0) AS INT) AS x0, CAST(trunc(p0 * 448 / 28.0e0) AS INT) AS y0, CAST(trunc((q1 + 1) * 448 / 28.0e0) AS INT) AS x1, CAST(trunc((p1 + 1) * 448 / 28.0e0) AS INT) AS y1 FROM v""")
def geo_padded_box(spark, d):
    b = _boxes(spark, d).withColumns({"hh": F.lit(448), "ww": F.lit(448)})
    return G.padded_box(b, 28, "hh", "ww").select("image_id", "x0", "y0", "x1", "y1")


# windows of each distinct image size, and the target patches whose centre lies in them
_CELLS = f"""WITH {SIZES.replace("o_orderkey AS image_id", "any_value(o_orderkey) AS image_id").replace("FROM orders)", "FROM orders GROUP BY w, h)")}, {_grid_sql("0.5e0", "1.0e0")},
  t AS (SELECT wg.*, CAST(ti AS INT) AS ti, CAST(unnest(range(CAST(greatest(0, floor("left" * 448 / CAST(w AS DOUBLE) / 16)) AS INT), CAST(least(28, ceil(("left" + side) * 448 / CAST(w AS DOUBLE) / 16)) AS INT))) AS INT) AS tj
    FROM (SELECT wg.*, unnest(range(CAST(greatest(0, floor(top * 448 / CAST(h AS DOUBLE) / 16)) AS INT), CAST(least(28, ceil((top + side) * 448 / CAST(h AS DOUBLE) / 16)) AS INT))) AS ti FROM wg) wg),
  v AS (SELECT *, CAST(trunc(((ti + 0.5e0) * 16 * h / 448 - top) / (side / 28.0e0)) AS INT) AS wi, CAST(trunc(((tj + 0.5e0) * 16 * w / 448 - "left") / (side / 28.0e0)) AS INT) AS wj FROM t),
  im AS (SELECT o_orderkey AS image_id, CAST(200 + o_custkey % 300 AS INT) AS w, CAST(200 + o_orderkey % 300 AS INT) AS h FROM orders)"""


def _by_size(spark, d, how):
    """how(windows of the distinct sizes) gives rows by (w, h); images take those of their size, so that geometry is worked out once for each size."""
    im = sizes(spark, d)
    w = G.window_grid(im.select("w", "h").distinct(), 0.5, 1.0, 28)
    return im.join(how(w), ["w", "h"], "left").drop("w", "h")


@query(_CELLS + """, c AS (SELECT w, h, ti, tj, count(*) AS n FROM v WHERE wi BETWEEN 0 AND 27 AND wj BETWEEN 0 AND 27 GROUP BY 1, 2, 3, 4), s AS (SELECT w, h, count(*) AS patches, max(n) AS most, sum(n) AS cells FROM c GROUP BY 1, 2)
  SELECT image_id, patches, most, cells FROM im LEFT JOIN s USING (w, h)""")
def geo_footprints(spark, d):
    """How windows cover the patches of each image."""
    return G.footprints(sizes(spark, d), 0.5, 1.0, 28, 448).select("image_id", "patches", "most", "cells")


@query(_CELLS + """, c AS (SELECT DISTINCT w, h, ti, tj FROM v WHERE (w + top + "left") % 3 <> 0 AND wi BETWEEN 0 AND 27 AND wj BETWEEN 0 AND 27 AND (wi * 7 + wj * 3 + top) % 5 = 0),
  s AS (SELECT w, h, count(*) AS patches, CAST(sum(ti * 28 + tj) AS BIGINT) AS places FROM c GROUP BY 1, 2) SELECT image_id, patches, places FROM im LEFT JOIN s USING (w, h)""")
def geo_tile_masks(spark, d):
    """Masks of the windows that pass a gate, projected on the image's patches and joined by OR."""

    def how(w):
        # five masks, shared by the windows: cells are written once for each mask
        w = w.where("(w + top + left) % 3 <> 0").withColumn("win", F.col("top") % 5)
        grid = F.sequence(F.lit(0), F.lit(27))
        cells = spark.range(5).select(F.col("id").cast("int").alias("win"), F.explode(grid).alias("wi")).select("win", "wi", F.explode(grid).alias("wj")).where("(wi * 7 + wj * 3 + win) % 5 = 0")
        return G.project_masks(w, cells, ["w", "h"], "win", 28, 448).groupBy("w", "h").agg(F.count("*").alias("patches"), F.sum(F.col("ti") * 28 + F.col("tj")).cast("long").alias("places"))

    return _by_size(spark, d, how)


_MS = f"""WITH {SIZES}, w AS (SELECT image_id % 500 AS image_id, image_id AS win, CAST(image_id % 200 AS INT) AS top, CAST(image_id % 170 AS INT) AS "left", CAST(100 + image_id % 148 AS INT) AS wh, CAST(60 + image_id % 180 AS INT) AS ww, (image_id % 21 - 10) / 10.0e0 AS logit FROM sz),
  k AS (SELECT unnest(range(0, 28)) AS i), c AS (SELECT win, a.i AS wi, b.i AS wj, top + floor(a.i * wh / 28.0e0) AS y0, top + floor((a.i + 1) * wh / 28.0e0) AS y1, "left" + floor(b.i * ww / 28.0e0) AS x0, "left" + floor((b.i + 1) * ww / 28.0e0) AS x1, image_id
    FROM w, k a, k b WHERE logit > 0.2 AND (a.i * 5 + b.i * 3 + win) % 11 = 0),
  p AS (SELECT DISTINCT image_id, t.i AS ti, u.i AS tj FROM c, k t, k u WHERE y1 > y0 AND x1 > x0 AND t.i * 16 < y1 AND (t.i + 1) * 16 > y0 AND u.i * 16 < x1 AND (u.i + 1) * 16 > x0)"""


@query(_MS + " SELECT image_id, count(*) AS patches, CAST(sum(ti * 28 + tj) AS BIGINT) AS places FROM p GROUP BY 1")
def geo_multi_scale_masks(spark, d):
    """Masks of windows of any size whose score passes the gate, by OR over pixels and down to patches."""
    i = F.col("image_id")
    w = sizes(spark, d).select((i % 500).alias("image_id"), i.alias("win"), (i % 200).cast("int").alias("top"), (i % 170).cast("int").alias("left"), (100 + i % 148).cast("int").alias("wh"), (60 + i % 180).cast("int").alias("ww"), ((i % 21 - 10) / 10).alias("logit"))
    grid = F.sequence(F.lit(0), F.lit(27))
    cells = w.select("win", F.explode(grid).alias("wi")).select("win", "wi", F.explode(grid).alias("wj")).where("(wi * 5 + wj * 3 + win) % 11 = 0")
    return G.multi_scale_masks(w, cells, ["image_id"], 28, 448, 0.2).groupBy("image_id").agg(F.count("*").alias("patches"), F.sum(F.col("ti") * 28 + F.col("tj")).cast("long").alias("places"))


def _pad_sql(n: int, least: int, a: str, b: str, p: str) -> str:
    grown = f"greatest(0, CAST(round_even(({a} + {b}) * 0.5e0, 0) AS INT) - {least // 2})"
    small = f"least({n - 1}, {b} + pad) - greatest(0, {a} - pad) + 1 < {least}"
    end = f"least({n - 1}, {grown} + {least - 1})"
    return f"CASE WHEN {small} THEN (CASE WHEN {end} = {n - 1} THEN greatest(0, {end} - {least - 1}) ELSE {grown} END) ELSE greatest(0, {a} - pad) END AS {p}0, CASE WHEN {small} THEN {end} ELSE least({n - 1}, {b} + pad) END AS {p}1"


@query(f"""WITH {PATCHES}, v AS (SELECT image_id, attention AS v, lead(attention) OVER w AS nx, row_number() OVER w AS pos FROM pa WINDOW w AS (PARTITION BY image_id ORDER BY attention)),
  t AS (SELECT image_id, CASE WHEN n < 3 THEN top + 1 ELSE (v + nx) / 2 END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY coalesce(nx - v, -1) DESC, pos) AS rk, count(*) OVER (PARTITION BY image_id) AS n, max(v) OVER (PARTITION BY image_id) AS top FROM v) WHERE rk = 1),
  b AS (SELECT image_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM pa JOIN t USING (image_id) WHERE attention >= threshold GROUP BY 1),
  g AS (SELECT *, greatest(1, CAST(ceil(7 * 0.15e0 / greatest(greatest(r1 - r0, c1 - c0) + 1, 1)) AS INT)) AS pad FROM b), x AS (SELECT image_id, {_pad_sql(7, 3, 'r0', 'r1', 'p')}, {_pad_sql(7, 3, 'c0', 'c1', 'q')} FROM g)
  SELECT image_id, CAST(trunc(q0 * 400 / 7.0e0) AS INT) AS x0, CAST(trunc(p0 * 300 / 7.0e0) AS INT) AS y0, CAST(trunc((q1 + 1) * 400 / 7.0e0) AS INT) AS x1, CAST(trunc((p1 + 1) * 300 / 7.0e0) AS INT) AS y1 FROM x""")
def geo_attention_boxes(spark, d):
    """Zoom boxes around the patches above the widest gap of attention."""
    from patchmill.operators.calibrate import gap_threshold

    p = patches(spark, d).withColumns({"hh": F.lit(300), "ww": F.lit(400)})
    return G.attention_boxes(p, gap_threshold(p, "image_id", "attention"), 7, "hh", "ww", base=1, least=3)


@query(f"""WITH {PATCHES}, p5 AS (SELECT * FROM pa WHERE c < 5), m AS (SELECT image_id, count(*) FILTER (lab = 1) AS n1, count(*) AS n FROM p5 GROUP BY 1), b AS (SELECT image_id, min(r) AS a, max(r) + 1 AS b, min(c) AS c, max(c) + 1 AS d, count(*) / CAST(any_value(n) AS DOUBLE) AS share FROM p5 JOIN m USING (image_id) WHERE (lab = 1) = (2 * n1 <= n) GROUP BY 1),
  g AS (SELECT *, greatest(1, CAST(round_even((b - a) * 0.25e0, 0) AS INT)) AS dr, greatest(1, CAST(round_even((d - c) * 0.25e0, 0) AS INT)) AS dc FROM b)
  SELECT image_id, greatest(0, a - dr) AS r0, least(7, b + dr) AS r1, greatest(0, c - dc) AS c0, least(7, d + dc) AS c1, round(share, 6) AS share FROM g""")
def geo_minority_boxes(spark, d):
    return rounded(G.minority_boxes(patches(spark, d).where("c < 5"), "lab", 7, 0.25))


@query(f"""WITH {MASKS} SELECT image_id, r // 4 AS pr, c // 4 AS pc, round(avg(CAST(gt AS INT)), 6) AS density, avg(CAST(gt AS INT)) > 0.15 AS hard, CAST(CASE WHEN avg(CAST(gt AS INT)) >= 0.45 THEN 1 ELSE 0 END AS INT) AS label,
  round(CASE WHEN avg(CAST(gt AS INT)) = 0 THEN 1 WHEN avg(CAST(gt AS INT)) >= 0.8 THEN 1 WHEN avg(CAST(gt AS INT)) >= 0.45 THEN (avg(CAST(gt AS INT)) - 0.45e0) / (0.8e0 - 0.45e0) ELSE 0 END, 6) AS weight FROM ma GROUP BY 1, 2, 3""")
def geo_patch_labels(spark, d):
    x = G.patch_density(masks(spark, d).withColumn("v", F.col("gt").cast("double")), "image_id", 4, "v")
    return rounded(x.select("image_id", "pr", "pc", "density", (F.col("density") > 0.15).alias("hard"), *G.soft_labels(F.col("density"), 0.45, 0.8)))


@query(f"""WITH {MASKS} SELECT image_id, count(*) * 16 AS pixels, min(r * 4) AS y0, max(r * 4 + 3) AS y1, min(c * 4) AS x0, max(c * 4 + 3) AS x1 FROM ma WHERE pred AND gt GROUP BY 1""")
def geo_patches_to_pixels(spark, d):
    p = G.pixels_of_patches(masks(spark, d).where("pred and gt").select("image_id", "r", "c"), 4)
    return p.groupBy("image_id").agg(F.count("*").alias("pixels"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


_PAIRS = f"""WITH RECURSIVE {PATCHES}, pr AS (SELECT a.image_id, a.idx AS i, b.idx AS j, round(list_dot_product(a.z, b.z), 9) AS sim, greatest(abs(a.r - b.r), abs(a.c - b.c)) AS cheb FROM pa a JOIN pa b ON a.image_id = b.image_id AND a.idx <> b.idx),
  kn AS (SELECT *, row_number() OVER (PARTITION BY image_id, i ORDER BY sim DESC, j) AS rk FROM pr), ed AS (SELECT a.image_id, a.i, a.j, a.sim FROM (SELECT * FROM kn WHERE rk <= 10) a JOIN (SELECT * FROM kn WHERE rk <= 10) b ON a.image_id = b.image_id AND a.i = b.j AND a.j = b.i WHERE a.sim >= 0.2),
  rc(image_id, idx, root) AS (SELECT image_id, idx, idx FROM pa UNION SELECT ed.image_id, ed.i, rc.root FROM ed JOIN rc ON ed.image_id = rc.image_id AND ed.j = rc.idx),
  cp AS (SELECT image_id, idx, min(root) AS root FROM rc GROUP BY 1, 2)"""


@query(_PAIRS + " SELECT image_id, i, j, CAST(rk AS INT) AS rk FROM kn WHERE rk <= 5")
def clu_nearest(spark, d):
    return K.nearest(patches(spark, d), 5).select("image_id", "i", "j", "rk")


@query(_PAIRS + " SELECT image_id, i, j, round(sim, 6) AS sim FROM ed")
def clu_mutual_edges(spark, d):
    return rounded(K.mutual_edges(patches(spark, d), 10, 0.2))


@query(_PAIRS + " SELECT ed.image_id, i, j FROM ed JOIN (SELECT image_id, i AS i2, j AS j2 FROM pr WHERE cheb <= 2) c ON c.image_id = ed.image_id AND c.i2 = i AND c.j2 = j")
def clu_edges_in_radius(spark, d):
    return K.mutual_edges(patches(spark, d), 10, 0.2, 2).select("image_id", "i", "j")


@query(_PAIRS + " SELECT image_id, idx, root FROM cp")
def clu_components(spark, d):
    return K.components(patches(spark, d), 10, 0.2)


@query(_PAIRS + """, s AS (SELECT image_id, root, count(*) AS size FROM cp GROUP BY 1, 2), bg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY size DESC, root) AS rk FROM s) WHERE rk = 1),
  wi AS (SELECT a.image_id, a.root, avg(sim) AS within FROM pr JOIN cp a ON a.image_id = pr.image_id AND a.idx = pr.i JOIN cp b ON b.image_id = pr.image_id AND b.idx = pr.j AND a.root = b.root GROUP BY 1, 2),
  cr AS (SELECT a.image_id, a.root, avg(sim) AS crossing FROM pr JOIN cp a ON a.image_id = pr.image_id AND a.idx = pr.i JOIN cp b ON b.image_id = pr.image_id AND b.idx = pr.j JOIN bg ON bg.image_id = b.image_id AND bg.root = b.root WHERE a.root <> b.root GROUP BY 1, 2)
  SELECT s.image_id, s.root, s.size, round(coalesce(within, 1), 5) AS within, round(crossing, 5) AS "cross", s.root = bg.root AS background FROM s JOIN bg ON bg.image_id = s.image_id LEFT JOIN wi ON wi.image_id = s.image_id AND wi.root = s.root LEFT JOIN cr ON cr.image_id = s.image_id AND cr.root = s.root""")
def clu_component_stats(spark, d):
    return rounded(K.component_stats(patches(spark, d), 10, 0.2), 5)


@query(_PAIRS + """, s AS (SELECT image_id, root, count(*) AS size FROM cp GROUP BY 1, 2), bg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY size DESC, root) AS rk FROM s) WHERE rk = 1),
  m AS (SELECT a.image_id, a.root, avg(sim) FILTER (b.root = a.root) AS within, avg(sim) FILTER (b.root = bg.root AND a.root <> bg.root) AS crossing FROM pr JOIN cp a ON a.image_id = pr.image_id AND a.idx = pr.i JOIN cp b ON b.image_id = pr.image_id AND b.idx = pr.j
    JOIN bg ON bg.image_id = pr.image_id GROUP BY 1, 2), big AS (SELECT image_id FROM pa GROUP BY 1 HAVING count(*) >= 16)
  SELECT cp.image_id, cp.idx, cp.root, s.size, s.root <> bg.root AND s.size >= 4 AND coalesce(within, 1) >= 0.05 AND coalesce(crossing, 1) <= 0.1 AS accepted, s.root = bg.root AS background
  FROM cp SEMI JOIN big ON big.image_id = cp.image_id JOIN s ON s.image_id = cp.image_id AND s.root = cp.root JOIN bg ON bg.image_id = cp.image_id JOIN m ON m.image_id = cp.image_id AND m.root = cp.root""")
def clu_graph_decode(spark, d):
    return K.graph_decode(patches(spark, d), s_edge=0.2, theta_w=0.05, theta_x=0.1)


_SIL = f"""WITH {PATCHES}, ds AS (SELECT a.image_id, a.idx, a.lab AS own, b.lab, avg(1 - list_dot_product(a.z, b.z)) AS d FROM pa a JOIN pa b ON a.image_id = b.image_id AND a.idx <> b.idx GROUP BY 1, 2, 3, 4),
  ab AS (SELECT image_id, idx, max(d) FILTER (lab = own) AS a, min(d) FILTER (lab <> own) AS b FROM ds GROUP BY 1, 2)"""


@query(_SIL + " SELECT image_id, round(coalesce(avg(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), -1), 5) AS silhouette FROM ab GROUP BY 1")
def clu_silhouettes(spark, d):
    return rounded(K.silhouettes(patches(spark, d), "lab"), 5)


@query(f"WITH {PATCHES} SELECT image_id, CAST(CASE WHEN avg(attention) FILTER (lab = 0) IS NULL OR avg(attention) FILTER (lab = 1) > avg(attention) FILTER (lab = 0) THEN 1 ELSE 0 END AS INT) AS positive FROM pa GROUP BY 1")
def clu_polarity(spark, d):
    return K.polarity(patches(spark, d), "lab")


@query(f"WITH {PATCHES} SELECT image_id, CAST(CASE WHEN count(*) FILTER (lab = 1) < count(*) FILTER (lab = 0) THEN 1 ELSE 0 END AS INT) AS positive FROM pa GROUP BY 1")
def clu_minority(spark, d):
    return K.minority(patches(spark, d), "lab")


@query()
def clu_decode_sweep(spark, d):
    """Decoded masks against labels for each value of a knob: medians, means, images without a region, wins over k-means."""
    p = patches(spark, d)
    gt = p.select("image_id", "idx", (F.col("lab") == 1).alias("gt"))
    scored = lambda x: mask_metrics(x.join(gt, ["image_id", "idx"]), "image_id", empty=1.0)
    base = scored(K.decoded(p, K.DecodeSpec(), deploy=True, attention=False)).select("image_id", F.col("iou").alias("base"))
    knobs = [{"s_edge": s} for s in (0.15, 0.20, 0.25)] + [{"k": k} for k in (5, 15)] + [{"radius": r} for r in (2, 4)] + [{"theta_x": 0.05}, {"by_attention": True}]
    out = None
    for knob in knobs:
        spec = K.DecodeSpec(method="graph", **({"s_edge": 0.2, "theta_w": 0.05, "theta_x": 0.1} | knob))
        m = scored(K.decoded(p, spec, deploy=True)).join(base, "image_id").withColumn("knob", F.lit(",".join(f"{k}={v}" for k, v in knob.items())))
        out = m if out is None else out.unionByName(m)
    g = out.groupBy("knob").agg(F.count("*").alias("n"), F.median("iou").alias("iou_med"), F.avg("iou").alias("iou_mean"), F.count_if(F.col("pred_frac") == 0).alias("abstained"), F.count_if(F.col("iou") > F.col("base")).alias("wins"), F.count_if(F.col("iou") == F.col("base")).alias("draws"))
    return rounded(g)


def _single(p):
    return p.select("image_id").distinct().withColumn("single", F.col("image_id") % 2 == 0)


_SPEC = K.DecodeSpec(method="graph", tau_pos=0.35, tau_neg=0.05, theta_w=0.05, theta_x=0.1)
_EDGES = [0.12, 0.2, 0.28]


@query(_PAIRS.replace("WHERE a.sim >= 0.2", "WHERE true") + f""", se AS (SELECT unnest({_EDGES}) AS s), eg AS (SELECT s, image_id, i, j FROM ed CROSS JOIN se WHERE sim >= s),
  rr(s, image_id, idx, root) AS (SELECT s, image_id, idx, idx FROM pa CROSS JOIN se UNION SELECT eg.s, eg.image_id, eg.i, rr.root FROM eg JOIN rr ON eg.s = rr.s AND eg.image_id = rr.image_id AND eg.j = rr.idx),
  cc AS (SELECT s, image_id, idx, min(root) AS root FROM rr GROUP BY 1, 2, 3), sz AS (SELECT s, image_id, root, count(*) AS size FROM cc GROUP BY 1, 2, 3),
  bg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, image_id ORDER BY size DESC, root) AS rk FROM sz) WHERE rk = 1),
  m AS (SELECT a.s, a.image_id, a.root, avg(sim) FILTER (b.root = a.root) AS within, avg(sim) FILTER (b.root = bg.root AND a.root <> bg.root) AS crossing FROM pr JOIN cc a ON a.image_id = pr.image_id AND a.idx = pr.i
    JOIN cc b ON b.s = a.s AND b.image_id = pr.image_id AND b.idx = pr.j JOIN bg ON bg.s = a.s AND bg.image_id = pr.image_id GROUP BY 1, 2, 3),
  ok AS (SELECT s, image_id, bool_or(sz.size >= 4 AND sz.root <> bg.root AND coalesce(within, 1) >= 0.05 AND coalesce(crossing, 1) <= 0.1) AS found FROM sz JOIN bg USING (s, image_id) JOIN m ON m.s = sz.s AND m.image_id = sz.image_id AND m.root = sz.root GROUP BY 1, 2),
  ab AS (SELECT se.s, p.image_id, NOT coalesce(found, false) OR n < 16 AS abstained FROM (SELECT image_id, count(*) AS n FROM pa GROUP BY 1) p CROSS JOIN se LEFT JOIN ok ON ok.s = se.s AND ok.image_id = p.image_id),
  r AS (SELECT s, coalesce(avg(CAST(abstained AS INT)) FILTER (image_id % 2 = 0), 1) AS tpr, coalesce(avg(CAST(NOT abstained AS INT)) FILTER (image_id % 2 <> 0), 1) AS tnr, count(*) FILTER (image_id % 2 = 0) AS n_single, count(*) FILTER (image_id % 2 <> 0) AS n_two FROM ab GROUP BY s)
  SELECT round(s, 6) AS s_edge, round((tpr + tnr) * 0.5, 6) AS bal_acc, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr, n_single, n_two, false AS used_fallback FROM r ORDER BY (tpr + tnr) * 0.5 DESC, s LIMIT 1""")
def cal_graph_edge(spark, d):
    """The edge threshold at which abstaining tells images of one class best, of three."""
    p = patches(spark, d)
    return rounded(K.calibrate_graph(p, _single(p), _SPEC, edges=_EDGES))


@query()
def cal_graph_edge_grid(spark, d):
    """As cal_graph_edge, of the 21 thresholds that follow from the decode's own limits."""
    p = patches(spark, d)
    return rounded(K.calibrate_graph(p, _single(p), _SPEC))


@query("WITH RECURSIVE " + _PAIRS.removeprefix("WITH RECURSIVE ") + """, s AS (SELECT image_id, root, count(*) AS size FROM cp GROUP BY 1, 2) SELECT image_id, CAST(sum(size) AS INT) AS patches, CAST(CASE WHEN sum(size) < 16 THEN 0 ELSE count(*) END AS INT) AS components, CASE WHEN sum(size) < 16 THEN 0 ELSE max(size) END AS background_size FROM s GROUP BY 1""")
def clu_graph_report(spark, d):
    return K.graph_report(patches(spark, d), s_edge=0.2, theta_w=0.05, theta_x=0.1).drop("accepted", "abstained")


@query()
def clu_partitioned(spark, d):
    """Regions by k-means behind the silhouette gate, one row for each image."""
    x = K.partitioned(patches(spark, d), 0.01)
    return rounded(x.groupBy("image_id").agg(F.count_if("pred").alias("taken"), F.max("score").alias("score"), F.bool_or("single").alias("single"), F.max("smaller").alias("smaller")))


@query()
def clu_partitioned_null(spark, d):
    """As clu_partitioned, behind the gate on z-scores against each image's own random partitions."""
    x = K.partitioned(patches(spark, d), 1.5, null=True)
    return rounded(x.groupBy("image_id").agg(F.count_if("pred").alias("taken"), F.max("score").alias("score"), F.bool_or("single").alias("single"), F.max("smaller").alias("smaller")))


@query()
def cal_null_gate(spark, d):
    """The gate on z-scores against each image's own null."""
    s = K.null_silhouettes(patches(spark, d), "lab").withColumn("single", F.col("image_id") % 2 == 0)
    return rounded(K.gate_sweep(s, "z", "single", [i / 20 for i in range(81)], fallback=2.0))


@query()
def clu_kmeans(spark, d):
    return rounded(K.kmeans_labels(patches(spark, d)))


@query()
def clu_kmeans_mask_metrics(spark, d):
    """Decoded masks of the smaller cluster against the labels."""
    p = patches(spark, d)
    lab = K.kmeans_labels(p).withColumn("lab2", F.col("cluster"))
    pos = K.minority(lab, "lab2")
    x = lab.join(pos, "image_id").join(p.select("image_id", "idx", (F.col("lab") == 1).alias("gt")), ["image_id", "idx"]).withColumn("pred", F.col("cluster") == F.col("positive"))
    return rounded(mask_metrics(x, "image_id"))


@query()
def clu_null_gate(spark, d):
    return rounded(K.null_silhouettes(patches(spark, d), "lab"))


_SILS = _SIL + """, s AS (SELECT image_id, round(coalesce(avg(CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), -1), 9) AS v, image_id % 2 = 0 AS single FROM ab GROUP BY 1)"""


@query(_SILS + """, l AS (SELECT greatest(-0.10e0, min(v) - 0.05e0) AS lo, least(0.999e0, max(v) + 0.05e0) AS hi FROM s), h AS (SELECT lo, CASE WHEN hi > lo THEN hi ELSE least(0.999e0, lo + 0.05e0) END AS hi FROM l),
  g AS (SELECT CASE WHEN k = 80 THEN hi ELSE lo + k * ((hi - lo) / 80) END AS tau FROM h CROSS JOIN (SELECT unnest(range(0, 81)) AS k)),
  r AS (SELECT tau, coalesce(count(*) FILTER (single AND v < tau) / nullif(CAST(count(*) FILTER (single) AS DOUBLE), 0), 1) AS tpr, coalesce(count(*) FILTER (NOT single AND v >= tau) / nullif(CAST(count(*) FILTER (NOT single) AS DOUBLE), 0), 1) AS tnr,
    count(*) FILTER (single) AS n_single, count(*) FILTER (NOT single) AS n_two FROM s CROSS JOIN g GROUP BY tau)
  SELECT round(tau, 6) AS tau, round((tpr + tnr) * 0.5, 6) AS bal_acc, round(tpr, 6) AS tpr, round(tnr, 6) AS tnr, n_single, n_two, false AS used_fallback FROM r ORDER BY (tpr + tnr) * 0.5 DESC, tau LIMIT 1""")
def cal_silhouette_gate(spark, d):
    s = rounded(K.silhouettes(patches(spark, d), "lab"), 9).withColumn("single", F.col("image_id") % 2 == 0)
    return rounded(K.gate_sweep(s, "silhouette", "single"))


@query(_SILS + """ SELECT round(avg(v) FILTER (single), 5) AS single_mean, round(median(v) FILTER (single), 5) AS single_median, round(stddev_pop(v) FILTER (single), 5) AS single_std, round(avg(v) FILTER (NOT single), 5) AS two_mean,
  round(median(v) FILTER (NOT single), 5) AS two_median, round(stddev_pop(v) FILTER (NOT single), 5) AS two_std, round(avg(v) FILTER (NOT single) - avg(v) FILTER (single), 5) AS gap_mean FROM s""")
def cal_class_gap(spark, d):
    s = K.silhouettes(patches(spark, d), "lab").withColumn("single", F.col("image_id") % 2 == 0)
    return rounded(K.class_gap(s, "silhouette", "single"), 5)


@query()
def agg_localization_samples(spark, d):
    """Samples of each image with a label, from its patches."""
    p = patches(spark, d).withColumns({"gt": F.col("lab") == 1, "win": (F.col("idx") % 3 == 0)})
    images = p.select("image_id").distinct().select("image_id", F.lit("imdsplice").alias("kind"), (F.col("image_id") / 10).alias("logit"))
    return rounded(localization_samples(p, images, "gt", swin="win"))


@query(f"""WITH {PATCHES}, s AS (SELECT image_id, count(*) AS n, count(*) FILTER (lab = 1) AS g, count(*) FILTER (idx % 3 = 0) AS w, count(*) FILTER (lab = 1 AND idx % 3 = 0) AS tp FROM pa GROUP BY 1)
  SELECT image_id, round(g / CAST(n AS DOUBLE), 6) AS area, round(2.0e0 * tp / (w + g), 6) AS f1_swin, round(tp / CAST(w + g - tp AS DOUBLE), 6) AS iou_swin, round(w / CAST(n AS DOUBLE), 6) AS pred_frac_swin, round(image_id / 10.0e0, 6) AS bce_logit,
    CASE WHEN g / CAST(n AS DOUBLE) < 0.15 THEN 'small' WHEN g / CAST(n AS DOUBLE) < 0.30 THEN 'medium' ELSE 'large' END AS bucket, true AS sound FROM s WHERE g > 0""")
def agg_localization_checks(spark, d):
    """The fields of samples that do not hang on a clustering, and whether the others keep their bounds."""
    x = agg_localization_samples(spark, d)
    sound = (F.col("f1_full") >= F.col("f1_full_deployed")) & (F.col("iou_full") <= F.col("f1_full")) & F.col("best_k").between(2, 4) & (F.greatest("sil_k2", "sil_k3", "sil_k4") == F.element_at(F.array("sil_k2", "sil_k3", "sil_k4"), F.col("best_k") - 1)) & F.col("cent_sep").between(0, 2)
    return x.select("image_id", "area", "f1_swin", "iou_swin", "pred_frac_swin", "bce_logit", "bucket", sound.alias("sound"))


_BCE = "((1 - t) * l + (1 + 2 * t) * (ln(1 + exp(-abs(l))) + greatest(-l, 0)))"


@query(f"""WITH {SCORES}, x AS (SELECT tag, logit AS l, CAST(label AS DOUBLE) AS t FROM sc), i AS (SELECT tag, sum({_BCE}) / greatest(count(*), 1) AS loss, count(*) AS patches FROM x GROUP BY tag) SELECT tag, round(loss, 6) AS loss, patches FROM i""")
def los_bce_per_image(spark, d):
    return rounded(L.image_losses(scores(spark, d), "tag", "logit", "label", pos_weight=3.0))


@query(f"""WITH {SCORES}, x AS (SELECT tag, logit AS l, CAST(label AS DOUBLE) AS t, least(greatest(area * 2, 0), 1) AS w FROM sc), i AS (SELECT tag, sum({_BCE} * w) / greatest(sum(w), 1) AS loss FROM x GROUP BY tag) SELECT round(sum(loss) / greatest(count(*), 1), 6) AS loss, count(*) AS n_active FROM i""")
def los_patch_bce(spark, d):
    s = scores(spark, d).withColumn("w", F.col("area") * 2)
    return rounded(L.batch_loss(L.image_losses(s, "tag", "logit", "label", weight="w", pos_weight=3.0)))


@query(f"WITH {SCORES} SELECT round(avg(pow(1 / (1 + exp(-logit)) - 1 / (1 + exp(-logit * 0.9e0)), 2)), 6) AS loss FROM sc")
def los_consistency(spark, d):
    return rounded(L.consistency(scores(spark, d).withColumn("aug", F.col("logit") * 0.9), "logit", "aug"))


_CP = f"""WITH {PATCHES}, pr AS (SELECT a.image_id, a.lab AS li, b.lab AS lj, round(list_dot_product(a.z, b.z), 9) AS sim FROM pa a JOIN pa b ON a.image_id = b.image_id AND a.idx <> b.idx), sh AS (SELECT image_id, avg(CAST(lab = 1 AS INT)) AS p FROM pa GROUP BY 1)"""


@query(_CP + """, t AS (SELECT image_id, sum(CASE WHEN li = 1 AND lj = 1 THEN greatest(0.55e0 - sim, 0) ELSE 0 END) / greatest(count(*) FILTER (li = 1 AND lj = 1 AND sim < 0.55), 1) AS a_in,
  sum(CASE WHEN li = 0 AND lj = 0 THEN greatest(0.55e0 - sim, 0) ELSE 0 END) / greatest(count(*) FILTER (li = 0 AND lj = 0 AND sim < 0.55), 1) AS a_out, sum(CASE WHEN li <> lj THEN greatest(sim - 0.2e0, 0) ELSE 0 END) / greatest(count(*) FILTER (li <> lj AND sim > 0.2), 1) AS r FROM pr GROUP BY 1)
  SELECT image_id, round(a_in, 6) AS a_in, round(a_out, 6) AS a_out, round(r, 6) AS r, round((sqrt(p) * a_in + sqrt(1 - p) * a_out) / greatest(sqrt(p) + sqrt(1 - p), 1e-6) + r, 6) AS loss FROM t JOIN sh USING (image_id)""")
def los_symmetric_contrastive(spark, d):
    return rounded(L.symmetric_contrastive(patches(spark, d), "lab"))


@query(_CP + """, g AS (SELECT image_id, li, avg(greatest(1 - sim, 0)) AS m FROM pr WHERE li = lj GROUP BY 1, 2), a AS (SELECT image_id, avg(m) AS attract FROM g GROUP BY 1), b AS (SELECT image_id, avg(greatest(sim - 0.3e0, 0)) AS repel FROM pr WHERE li <> lj GROUP BY 1)
  SELECT image_id, round(coalesce(attract, 0), 6) AS attract, round(coalesce(repel, 0), 6) AS repel, round(coalesce(attract, 0) + coalesce(repel, 0), 6) AS loss FROM a FULL JOIN b USING (image_id)""")
def los_hinge_contrastive(spark, d):
    return rounded(L.hinge_contrastive(patches(spark, d), "lab"))


@query(_CP + """, o AS (SELECT image_id FROM pa WHERE image_id % 3 <> 0 GROUP BY 1 HAVING count(DISTINCT lab) > 1), g AS (SELECT image_id, li, avg(greatest(1 - sim, 0)) AS m FROM pr WHERE li = lj GROUP BY 1, 2), a AS (SELECT image_id, avg(m) AS attract FROM g GROUP BY 1),
  b AS (SELECT image_id, avg(greatest(sim - 0.3e0, 0)) AS repel FROM pr WHERE li <> lj GROUP BY 1), x AS (SELECT coalesce(attract, 0) AS attract, coalesce(repel, 0) AS repel FROM o LEFT JOIN a USING (image_id) LEFT JOIN b USING (image_id))
  SELECT round(avg(attract), 6) AS attract, round(avg(repel), 6) AS repel, round(avg(attract + repel), 6) AS loss, count(*) AS n_active FROM x""")
def los_selective_hinge(spark, d):
    """The loss of a batch: the mean over active images that have both labels."""
    p = patches(spark, d)
    active = p.where("image_id % 3 <> 0").select("image_id")
    return rounded(L.loss_summary(L.hinge_contrastive(L.active_images(p, "lab", active), "lab")))


@query(f"WITH {PATCHES} SELECT image_id, round(1 - avg(list_cosine_similarity(z, list_reverse(z))), 6) AS loss FROM pa GROUP BY 1")
def los_invariance(spark, d):
    """One minus the mean cosine of two views; the second view here is the vector read backwards."""
    from patchmill.operators.calibrate import dot

    p = patches(spark, d).withColumn("z2", F.reverse("z"))
    return rounded(p.groupBy("image_id").agg((1 - F.avg(dot("z", "z2") / (F.sqrt(dot("z", "z")) * F.sqrt(dot("z2", "z2"))))).alias("loss")))


@query(f"""WITH {SCORES}, m AS (SELECT tag, max(logit) AS mx FROM sc GROUP BY 1), e AS (SELECT tag, image_id, exp(logit - mx) AS e FROM sc JOIN m USING (tag)) SELECT tag, round(sum(e * e) / pow(sum(e), 2), 9) AS focus FROM e GROUP BY tag""")
def los_attention_softmax(spark, d):
    """Softmax attention within a group, summed up as its concentration."""
    s = scores(spark, d)
    m = s.groupBy("tag").agg(F.max("logit").alias("mx"))
    e = s.join(m, "tag").withColumn("e", F.exp(F.col("logit") - F.col("mx")))
    return rounded(e.groupBy("tag").agg((F.sum(F.col("e") * F.col("e")) / F.pow(F.sum("e"), F.lit(2.0))).alias("focus")), 9)


@query(f"""WITH {LOC} SELECT sample_id, round(greatest(0, least(1, (100 - CAST(35 + sample_id % 70 AS DOUBLE)) / 65)), 6) AS sev_jpeg, round(greatest(0, least(1, (sample_id % 40) / 100.0e0 / 0.3e0)), 6) AS sev_noise,
  CAST(round_even(35 + (100 - 35) * ((sample_id % 11) / 10.0e0), 0) AS INT) AS quality, round(0.002e0 + 0.013e0 * ((sample_id % 11) / 10.0e0), 6) AS std FROM lo""")
def pix_severity(spark, d):
    """Severities of corruptions, and corruption strengths between presets: integers stay integers."""
    i = F.col("sample_id")
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    s = i % 11 / 10
    return rounded(loc(spark, d).select("sample_id", unit((100 - (35 + i % 70).cast("double")) / 65).alias("sev_jpeg"), unit(i % 40 / 100 / 0.3).alias("sev_noise"), F.rint(35 + 65 * s).cast("int").alias("quality"), (0.002 + 0.013 * s).alias("std")))


@query("SELECT * FROM (VALUES ('jpeg', 0.4e0, 64.0e0, 96.0e0), ('gaussian', 0.3e0, 0.0035e0, 0.045e0), ('resize', 0.3e0, 0.625e0, 0.965e0), ('blur', 0.15e0, 0.1e0, 1.75e0)) t(family, probability, least, greatest)")
def pix_presets_between(spark, d):
    return rounded(between("light", "heavy", 0.5, preset_table(spark)))


@query(f"""WITH {LOC} SELECT sample_id, CASE WHEN f1_full IS NULL THEN '' WHEN isnan(f1_full) THEN 'nan' ELSE printf('%.4f', f1_full) END AS f1, CASE WHEN iou_full IS NULL THEN '' WHEN isnan(iou_full) THEN 'nan' ELSE printf('%.3f', iou_full) END AS iou_rate FROM lo""")
def udf_metric_text(spark, d):
    """Metrics as text: three decimals for rates, four for others."""
    text = lambda c, k: F.when(F.col(c).isNull(), "").when(F.isnan(c), "nan").otherwise(F.format_string(f"%.{k}f", c))
    return loc(spark, d).select("sample_id", text("f1_full", 4).alias("f1"), text("iou_full", 3).alias("iou_rate"))


@query(f"""WITH {SCORES}, v AS (SELECT image_id, least(greatest(area, 0), 1) AS v FROM sc) SELECT image_id, round(least(greatest(1.5e0 - abs(4 * v - 3), 0), 1), 6) AS r, round(least(greatest(1.5e0 - abs(4 * v - 2), 0), 1), 6) AS g, round(least(greatest(1.5e0 - abs(4 * v - 1), 0), 1), 6) AS b FROM v""")
def udf_jet_colours(spark, d):
    """A piecewise linear colour map of [0, 1]."""
    v = F.least(F.greatest(F.col("area"), F.lit(0.0)), F.lit(1.0))
    ch = lambda k: F.least(F.greatest(1.5 - F.abs(4 * v - k), F.lit(0.0)), F.lit(1.0))
    return rounded(scores(spark, d).select("image_id", ch(3).alias("r"), ch(2).alias("g"), ch(1).alias("b")))


@query(f"""WITH {LOC} SELECT sample_id, 'graph[s=' || printf('%.2f', (sample_id % 50) / 100.0e0) || ',k=' || (5 + sample_id % 10) || CASE WHEN sample_id % 2 = 0 THEN ',r=' || (sample_id % 5) ELSE '' END || ']' AS label FROM lo""")
def udf_decode_labels(spark, d):
    i = F.col("sample_id")
    return loc(spark, d).select("sample_id", F.concat(F.lit("graph[s="), F.format_string("%.2f", i % 50 / 100), F.lit(",k="), (5 + i % 10).cast("string"), F.when(i % 2 == 0, F.concat(F.lit(",r="), (i % 5).cast("string"))).otherwise(""), F.lit("]")).alias("label"))
