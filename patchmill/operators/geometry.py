"""Windows, boxes and projections between pixel and patch grids, in built-in expressions: no image is materialised."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _i(c: Column) -> Column:
    return c.cast("int")


def rint(c: Column) -> Column:
    """Nearest integer, halves to even."""
    return _i(F.rint(c))


def axis_starts(length: Column, side: Column, stride: Column) -> Column:
    """Start positions along an axis, the last flush with the edge."""
    end = F.greatest(length - side, F.lit(0))
    return F.array_sort(F.array_union(F.sequence(F.lit(0), end, F.greatest(stride, F.lit(1))), F.array(end)))


def window_grid(df: DataFrame, scale: float, stride_frac: float, patches: int) -> DataFrame:
    """(df, top, left, side): square windows of each image (w, h); the side is scale times the shorter edge, at least patches, at most that edge."""
    short = F.least("w", "h")
    x = df.withColumn("side", F.least(F.greatest(F.lit(patches), rint(short * scale)), short))
    stride = rint(F.col("side") * stride_frac)
    x = x.withColumns({"tops": axis_starts(F.col("h"), F.col("side"), stride), "lefts": axis_starts(F.col("w"), F.col("side"), stride)})
    return x.withColumn("top", F.explode("tops")).withColumn("left", F.explode("lefts")).drop("tops", "lefts")


def _capped_starts(w: int, h: int, scale: float, stride_frac: float, patches: int, most: int) -> tuple[int, list[int], list[int]]:
    """(side, tops, lefts) of a window grid, thinned evenly along the longer axis until at most ``most`` windows are left."""
    side = min(max(patches, round(min(w, h) * scale)), min(w, h))
    stride = max(1, round(side * stride_frac))
    tops, lefts = (sorted({*range(0, max(n - side, 0) + 1, stride), max(n - side, 0)}) for n in (h, w))
    while len(tops) * len(lefts) > most and max(len(tops), len(lefts)) > 1:
        long_, other = (lefts, tops) if len(lefts) >= len(tops) else (tops, lefts)
        keep = max(1, most // len(other))
        at = [round(i * (len(long_) - 1) / (keep - 1)) if keep > 1 else 0 for i in range(keep)]
        long_[:] = sorted({long_[i] for i in at})
    return side, tops, lefts


def capped_grid(df: DataFrame, scale: float, stride_frac: float, patches: int, most: int) -> DataFrame:
    """As window_grid, thinned until at most ``most`` windows of each image are left. Sizes repeat, so each distinct one is worked out once."""
    own = df.select("w", "h").distinct()

    def run(parts):
        for pdf in parts:
            rows = [(w, h, *_capped_starts(int(w), int(h), scale, stride_frac, patches, most)) for w, h in zip(pdf["w"], pdf["h"], strict=True)]
            yield pd.DataFrame(rows, columns=["w", "h", "side", "tops", "lefts"])

    grid = own.mapInPandas(run, "w int, h int, side int, tops array<int>, lefts array<int>")
    return df.join(grid, ["w", "h"]).withColumn("top", F.explode("tops")).withColumn("left", F.explode("lefts")).drop("tops", "lefts")


def grid_hash(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, windows, hash): 12 digits of the MD5 of ``top,left,side;`` in order."""
    a = F.array_sort(F.collect_list(F.struct("top", "left", "side")))
    x = df.groupBy(*keys).agg(a.alias("a"))
    s = F.array_join(F.transform("a", lambda w: F.concat(w["top"].cast("string"), F.lit(","), w["left"].cast("string"), F.lit(","), w["side"].cast("string"), F.lit(";"))), "")
    return x.select(*keys, F.size("a").alias("windows"), F.substring(F.md5(s), 1, 12).alias("hash"))


def scaled_windows(df: DataFrame, scales: list[float], stride_frac: float, *, square: bool) -> DataFrame:
    """(df, scale, top, left, wh, ww): windows at several scales below 1; aspect-preserving sizes are cut off to whole pixels, square ones rounded."""
    x = df.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales if s < 1.0])))
    if square:
        short = F.least("w", "h")
        side = F.least(F.greatest(F.lit(1), rint(short * F.col("scale"))), short)
        x = x.withColumns({"wh": side, "ww": side})
        sh, sw = rint(F.col("wh") * stride_frac), rint(F.col("ww") * stride_frac)
    else:
        x = x.withColumns({"wh": F.greatest(F.lit(1), _i(F.col("h") * F.col("scale"))), "ww": F.greatest(F.lit(1), _i(F.col("w") * F.col("scale")))})
        sh, sw = _i(F.col("wh") * stride_frac), _i(F.col("ww") * stride_frac)
    x = x.withColumns({"tops": axis_starts(F.col("h"), F.col("wh"), sh), "lefts": axis_starts(F.col("w"), F.col("ww"), sw)})
    return x.withColumn("top", F.explode("tops")).withColumn("left", F.explode("lefts")).drop("tops", "lefts")


def square_expand(top: Column, left: Column, h: Column, w: Column, hh: Column, ww: Column) -> list[Column]:
    """(top, left, side) of the square around a box, shifted to lie inside the image."""
    side = F.least(F.greatest(h, w), hh, ww)
    place = lambda at, size, full: F.least(F.greatest(at - _i(F.floor((side - size) / 2)), F.lit(0)), F.greatest(full - side, F.lit(0)))
    return [place(top, h, hh).alias("top"), place(left, w, ww).alias("left"), side.alias("side")]


def centered_square(cy: Column, cx: Column, area: Column, hh: Column, ww: Column) -> list[Column]:
    """(top, left, side) of a square of an area share (within 1e-6 and 1) around a point, side at least 8, inside the image."""
    a = F.least(F.greatest(area, F.lit(1e-6)), F.lit(1.0))
    side = F.greatest(F.lit(8), F.least(rint(F.sqrt(a * hh * ww)), hh, ww))
    place = lambda c, full: F.least(F.greatest(rint(c - side / 2), F.lit(0)), F.greatest(full - side, F.lit(0)))
    return [place(cy, hh).alias("top"), place(cx, ww).alias("left"), side.alias("side")]


def mask_boxes(df: DataFrame, key: str, mask: str, side: int) -> DataFrame:
    """(key, r0, r1, c0, c1, cy, cx, n): tight box and centre of mass of the cells where mask is true; images without any are left out."""
    x = df.where(mask)
    return x.groupBy(key).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.avg("r").alias("cy"), F.avg("c").alias("cx"), F.count("*").alias("n"))


def patches_to_pixels_box(r0: Column, r1: Column, c0: Column, c1: Column, hh: Column, ww: Column, n: int) -> list[Column]:
    """(top, left, h, w) in pixels of a box of patches, at least one pixel, inside the image."""
    a, b = rint(r0 * hh / n), rint((r1 + 1) * hh / n)
    c, e = rint(c0 * ww / n), rint((c1 + 1) * ww / n)
    top, left = F.greatest(F.lit(0), F.least(a, hh - 1)), F.greatest(F.lit(0), F.least(c, ww - 1))
    return [top.alias("top"), left.alias("left"), (F.greatest(top + 1, F.least(b, hh)) - top).alias("bh"), (F.greatest(left + 1, F.least(e, ww)) - left).alias("bw")]


def padded_box(df: DataFrame, n: int, hh: str, ww: str, *, base: int = 2, frac: float = 0.15, least: int = 8) -> DataFrame:
    """df (r0, r1, c0, c1) with x0, y0, x1, y1: the box padded more the smaller it is, grown to a least size, in pixels; NULL below two pixels."""
    pad = F.greatest(F.lit(base), _i(F.ceil(F.lit(n * frac) / F.greatest(F.greatest(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")) + 1, F.lit(1)))))

    def axis(a: str, b: str) -> tuple[Column, Column]:
        lo, hi = F.greatest(F.lit(0), F.col(a) - F.col("_pad")), F.least(F.lit(n - 1), F.col(b) + F.col("_pad"))
        g0 = F.greatest(F.lit(0), rint((F.col(a) + F.col(b)) * 0.5) - least // 2)
        g1 = F.least(F.lit(n - 1), g0 + least - 1)
        small = hi - lo + 1 < least
        return F.when(small, F.when(g1 == n - 1, F.greatest(F.lit(0), g1 - least + 1)).otherwise(g0)).otherwise(lo), F.when(small, g1).otherwise(hi)

    (p0, p1), (q0, q1) = axis("r0", "r1"), axis("c0", "c1")
    x = df.withColumn("_pad", pad).withColumns({"_p0": p0, "_p1": p1, "_q0": q0, "_q1": q1})
    x = x.withColumns({
        "x0": F.greatest(F.lit(0), _i(F.col("_q0") * F.col(ww) / n)), "x1": F.least(F.col(ww), _i((F.col("_q1") + 1) * F.col(ww) / n)),
        "y0": F.greatest(F.lit(0), _i(F.col("_p0") * F.col(hh) / n)), "y1": F.least(F.col(hh), _i((F.col("_p1") + 1) * F.col(hh) / n)),
    })
    ok = (F.col("x1") - F.col("x0") >= 2) & (F.col("y1") - F.col("y0") >= 2)
    return x.withColumns({c: F.when(ok, F.col(c)) for c in ("x0", "y0", "x1", "y1")}).drop("_pad", "_p0", "_p1", "_q0", "_q1")


def projected_cells(windows: DataFrame, n: int, target: int) -> DataFrame:
    """(windows, ti, tj, wi, wj): the target patches whose centre falls into a window, with the window's own patch there.

    Only the rows and columns a window spans are expanded; offsets are cut off towards zero.
    """
    size = target // n
    span = lambda at, full: (F.greatest(F.lit(0), _i(F.floor(at * target / full / size))), F.least(F.lit(n), _i(F.ceil((at + F.col("side")) * target / full / size))))
    (t0, t1), (l0, l1) = span(F.col("top"), F.col("h")), span(F.col("left"), F.col("w"))
    x = windows.withColumns({"_t0": t0, "_t1": t1, "_l0": l0, "_l1": l1}).where("_t1 > _t0 and _l1 > _l0")
    x = x.withColumn("ti", F.explode(F.sequence("_t0", F.col("_t1") - 1))).withColumn("tj", F.explode(F.sequence("_l0", F.col("_l1") - 1)))
    own = F.col("side") / n
    x = x.withColumns({"wi": _i(((F.col("ti") + 0.5) * size * F.col("h") / target - F.col("top")) / own), "wj": _i(((F.col("tj") + 0.5) * size * F.col("w") / target - F.col("left")) / own)})
    return x.where(F.col("wi").between(0, n - 1) & F.col("wj").between(0, n - 1)).drop("_t0", "_t1", "_l0", "_l1")


def project_masks(windows: DataFrame, cells: DataFrame, keys: list[str], window: str, n: int, target: int) -> DataFrame:
    """(keys, ti, tj): target patches hit by a true cell (window, wi, wj) of any window; the OR of all windows of an image."""
    p = projected_cells(windows, n, target).select(*keys, window, "wi", "wj", "ti", "tj")
    return p.join(cells, [window, "wi", "wj"], "left_semi").select(*keys, "ti", "tj").distinct()


def axis_cover(df: DataFrame, stride_frac: float, n: int, target: int) -> DataFrame:
    """(length, side, hit, most, sum) of axes (length, side): patches of the target grid that windows along the axis cover, and how often."""
    x = df.select("length", "side").distinct()
    x = x.withColumn("at", F.explode(axis_starts(F.col("length"), F.col("side"), rint(F.col("side") * stride_frac))))
    size, full = target // n, F.col("length")
    lo, hi = F.greatest(F.lit(0), _i(F.floor(F.col("at") * target / full / size))), F.least(F.lit(n), _i(F.ceil((F.col("at") + F.col("side")) * target / full / size)))
    x = x.withColumns({"lo": lo, "hi": hi}).where("hi > lo").withColumn("t", F.explode(F.sequence("lo", F.col("hi") - 1)))
    own = _i(((F.col("t") + 0.5) * size * full / target - F.col("at")) / (F.col("side") / n))
    c = x.where(own.between(0, n - 1)).groupBy("length", "side", "t").agg(F.count("*").alias("k"))
    return c.groupBy("length", "side").agg(F.count("*").alias("hit"), F.max("k").alias("most"), F.sum("k").alias("sum"))


def footprints(df: DataFrame, scale: float, stride_frac: float, n: int, target: int) -> DataFrame:
    """df (w, h) with patches, most, cells: how the windows of each image cover the target grid.

    A grid of windows is the product of its rows and columns, so its footprint is the product of both axes' covers and no cell is
    built. Axes repeat far more often than sizes: each (length, side) is worked out once, for rows and columns alike.
    """
    short = F.least("w", "h")
    x = df.withColumn("_side", F.least(F.greatest(F.lit(n), rint(short * scale)), short))
    axes = x.select(F.explode(F.array("w", "h")).alias("length"), F.col("_side").alias("side")).distinct()
    c = axis_cover(axes, stride_frac, n, target)
    for k in ("h", "w"):
        own = c.select(F.col("length").alias(k), F.col("side").alias("_side"), *[F.col(v).alias(f"_{k}_{v}") for v in ("hit", "most", "sum")])
        x = x.join(own, [k, "_side"], "left")
    both = lambda v: F.col(f"_h_{v}") * F.col(f"_w_{v}")
    return x.select(*df.columns, both("hit").alias("patches"), both("most").alias("most"), both("sum").alias("cells"))


def patch_density(pixels: DataFrame, key: str, size: int, value: str) -> DataFrame:
    """(key, pr, pc, density): mean of value over squares of size pixels."""
    return pixels.groupBy(key, _i(F.floor(F.col("r") / size)).alias("pr"), _i(F.floor(F.col("c") / size)).alias("pc")).agg(F.avg(value).alias("density"))


def soft_labels(density: Column, low: float = 0.02, high: float = 0.06) -> list[Column]:
    """(label, weight): cells grazed by the mask are ignored, then labelled with a weight that rises to 1."""
    w = F.when(density == 0, 1.0).when(density >= high, 1.0).when(density >= low, (density - low) / (high - low)).otherwise(0.0)
    return [F.when(density >= low, 1).otherwise(0).alias("label"), w.alias("weight")]


def pixels_of_patches(cells: DataFrame, size: int) -> DataFrame:
    """Each patch's pixels: the cell replicated size x size times."""
    off = F.sequence(F.lit(0), F.lit(size - 1))
    return cells.withColumn("dy", F.explode(off)).withColumn("dx", F.explode(off)).withColumns({"y": F.col("r") * size + F.col("dy"), "x": F.col("c") * size + F.col("dx")}).drop("dy", "dx")


def multi_scale_masks(windows: DataFrame, cells: DataFrame, keys: list[str], n: int, side: int, gate: float | None = None, logit: str = "logit") -> DataFrame:
    """(keys, ti, tj): patches of a picture of side x side that any true cell of any window touches.

    windows: keys, win, top, left, wh, ww in pixels of the picture; cells: win, wi, wj of the true cells of its n x n mask. A cell covers
    whole pixels of its window, and a patch is taken where one of its pixels is covered, so no pixel is built: both are ranges. With
    gate only windows whose logit is above it count; a NULL logit is not.
    """
    w = windows if gate is None else windows.where(F.col(logit) > gate)
    x = w.join(cells.select("win", "wi", "wj").distinct(), "win")
    cut = lambda at, size, k: F.col(at) + _i(F.floor(k * F.col(size) / n))
    x = x.withColumns({"_a": cut("top", "wh", F.col("wi")), "_b": cut("top", "wh", F.col("wi") + 1), "_c": cut("left", "ww", F.col("wj")), "_d": cut("left", "ww", F.col("wj") + 1)}).where("_b > _a and _d > _c")
    patch = side // n
    x = x.withColumn("ti", F.explode(F.sequence(_i(F.floor(F.col("_a") / patch)), _i(F.floor((F.col("_b") - 1) / patch)))))
    x = x.withColumn("tj", F.explode(F.sequence(_i(F.floor(F.col("_c") / patch)), _i(F.floor((F.col("_d") - 1) / patch)))))
    return x.select(*keys, "ti", "tj").where(F.col("ti").between(0, n - 1) & F.col("tj").between(0, n - 1)).distinct()


def attention_boxes(patches: DataFrame, thresholds: DataFrame, n: int, hh: str, ww: str, **how) -> DataFrame:
    """(image_id, x0, y0, x1, y1): the box of the patches whose attention reaches the image's threshold, padded and in pixels; images without any are left out.

    patches: image_id, r, c, attention, and the picture's height and width in the columns hh and ww.
    """
    hot = patches.join(thresholds.select("image_id", "threshold"), "image_id").withColumn("_hot", F.col("attention") >= F.col("threshold"))
    size = patches.groupBy("image_id").agg(F.first(hh).alias(hh), F.first(ww).alias(ww))
    return padded_box(mask_boxes(hot, "image_id", "_hot", n).join(size, "image_id"), n, hh, ww, **how).select("image_id", "x0", "y0", "x1", "y1")


def minority_boxes(patches: DataFrame, lab: str, n: int, pad: float) -> DataFrame:
    """(image_id, r0, r1, c0, c1, share): the box of the smaller of two clusters (1 where equal), ends exclusive, padded by a share of its sides."""
    m = patches.groupBy("image_id").agg(F.count_if(F.col(lab) == 1).alias("_n1"), F.count("*").alias("_n"))
    x = patches.join(m, "image_id").where((F.col(lab) == 1) == (2 * F.col("_n1") <= F.col("_n")))
    b = x.groupBy("image_id").agg(F.min("r").alias("a"), (F.max("r") + 1).alias("b"), F.min("c").alias("c"), (F.max("c") + 1).alias("d"), (F.count("*") / F.first("_n")).alias("share"))
    grow = lambda lo, hi: F.greatest(F.lit(1), rint((F.col(hi) - F.col(lo)) * pad))
    least, most = lambda v: F.greatest(F.lit(0), v), lambda v: F.least(F.lit(n), v)
    return b.select("image_id", least(F.col("a") - grow("a", "b")).alias("r0"), most(F.col("b") + grow("a", "b")).alias("r1"), least(F.col("c") - grow("c", "d")).alias("c0"), most(F.col("d") + grow("c", "d")).alias("c1"), "share")
