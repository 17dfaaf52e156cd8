"""Pixel kernels, sample assembly, run bookkeeping, file sources."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchmill.errors import ConfigError, DataError
from patchmill.functions import pixels as P
from patchmill.operators import samples as X
from patchmill.operators.samples import build_samples, zoom_regions
from patchmill.storage import Workspace
from patchmill.sources import files as S
from patchmill.sources import runs as R


def rng(i=0):
    return np.random.default_rng(i)


def test_blob_area_and_checks():
    for i in range(20):
        m = P.blob_mask(128, rng(i), P.Blob(area=(0.1, 0.1001)))
        assert abs((m >= 0.5).mean() - 0.1) < 0.005 and m.min() >= 0 and m.max() <= 1
    with pytest.raises(ConfigError):
        P.Blob(area=(0.5, 0.2))


def test_blend_and_shapes():
    a, b = np.zeros((4, 4, 3), np.uint8), np.full((4, 4, 3), 200, np.uint8)
    m = np.zeros((4, 4))
    m[0] = 1
    assert P.blend(a, b, m)[0].min() == 200 and P.blend(a, b, m)[1:].max() == 0
    with pytest.raises(DataError):
        P.blend(a, b, np.zeros((3, 4)))


def test_resize_identity_and_nearest():
    x = rng().integers(0, 256, (9, 7, 3), dtype=np.uint8)
    assert (P.resize(x, (9, 7)) == x).all() and (P.resize(x, (9, 7), nearest=True) == x).all()
    assert (P.resize(np.eye(2), (4, 4), nearest=True) == np.kron(np.eye(2), np.ones((2, 2)))).all()


def test_corruptions_and_severity():
    x = np.full((32, 32, 3), 128, np.uint8)
    for f in ("gaussian", "poisson", "resize", "blur", "clean"):
        c = P.draw_corruption(rng(1), (f,))
        y = c.apply(x, rng(2))
        assert y.shape == x.shape and y.dtype == np.uint8 and 0 <= c.op()["severity"] <= 1
        assert (y == c.apply(x, rng(2))).all()
    assert P.ramp(35, 35, 100) == 1 and P.ramp(100, 35, 100) == 0
    with pytest.raises(KeyError):
        P.Corruption("fog").apply(x, rng())
    d = P.draw_distinct(rng(3), 3, ("gaussian", "resize"))
    assert len({(c.family, *c.params.values()) for c in d}) == 3


def test_degradation_facts():
    seen = set()
    for i in range(60):
        out, spot, f, ops = P.degradation_example(np.full((48, 48, 3), 90, np.uint8), rng(i), families=("gaussian", "resize"))
        seen.add(f["variant"])
        assert out.shape == (48, 48, 3)
        assert (f["target_family"] == "none") == (f["is_global_negative"] == 1) == (not spot.any())
        assert len(ops) == (f["dominant_family"] != "clean") + (f["target_family"] not in ("clean", "none"))
    assert seen == set(P.VARIANTS)


def test_presets_and_modes():
    from patchmill.functions.presets import PRESETS, chain, evaluation_mode

    out, ops = P.light_chain(np.full((24, 24, 3), 120, np.uint8), rng(1), chain("noise_aggressive", without=("jpeg",)))
    assert out.shape == (24, 24, 3) and all(0 <= o["severity"] <= 1 for o in ops) and len(PRESETS) == 5
    assert evaluation_mode(None) == ("global", None) and evaluation_mode("mask_aggressive_mix")[0] == "mask"
    assert evaluation_mode("mask_double_jpeg")[1].params == {"q1": 82, "q2": 45} and evaluation_mode("resize")[0] == "global"
    for bad in ("fog", "mask_fog"):
        with pytest.raises(ConfigError):
            evaluation_mode(bad)
    with pytest.raises(ConfigError):
        chain("none")


def test_hot_regions():
    att = np.zeros((16, 16))
    att[2:4, 2:4], att[10:12, 10:12] = 1.0, 2.0
    hot = att > 0
    assert P.zoom_boxes(att, hot) == [(10, 11, 10, 11), (2, 3, 2, 3)]
    assert P.zoom_boxes(att, hot, most=1) == [(10, 11, 10, 11)]
    assert P.zoom_boxes(att, np.zeros_like(hot)) == []
    many = np.zeros((16, 16))
    for k, (r, c) in enumerate([(0, 0), (0, 8), (8, 0), (8, 8)]):
        many[r : r + 2, c : c + 2] = k + 1
    assert [b[:1] + b[2:3] for b in P.zoom_boxes(many, many > 0)] == [(8, 8), (8, 0), (0, 8)]
    arm = np.zeros((8, 8))
    arm[2, 2:4], arm[2, 4:7], arm[6, 6] = 20, 3, 3
    h = P.hysteresis(arm)
    assert h[2, 2:7].all() and not h[6, 6]


def test_crops():
    m = np.zeros((100, 140), bool)
    assert P.oracle_crop(m, rng()) is None
    m[40:50, 60:75] = True
    for i in range(30):
        t, l, s, cover = P.oracle_crop(m, rng(i))
        assert t <= 40 and l <= 60 and t + s >= 50 and l + s >= 75 and 0 <= t <= 100 - s and 0 <= l <= 140 - s and 0.09 < cover < 0.7
    assert P.paired_crop(m, rng(), least=2.0)[3] is False and P.paired_crop(m, rng(), least=0.0)[3] is True


def test_overlays():
    assert P.heat(np.arange(4).reshape(2, 2), (4, 4)).shape == (4, 4, 3)
    t = P.tint(np.zeros((4, 4, 3), np.uint8), np.array([[0, 1], [1, 0]]), {1: (255, 0, 0)}, 1.0)
    assert t[0, 3, 0] == 255 and t[0, 0].max() == 0


def _written(spark, folder):
    kinds = ["imdsplice", "casiasplice", "imdreal", "indoorreal", "casiareal", "aesplice", None, "other"]
    x = spark.createDataFrame([(i, f"i{i}", f"m{i}" if kinds[i % 8] in ("imdsplice", "casiasplice") else None, kinds[i % 8], "c", "s") for i in range(64)], "item_id long, img string, mask string, kind string, case_id string, source string")
    return Workspace(spark, "t").cut(X.write_pictures(x, str(folder)))


def test_samples_come_from_files_and_do_not_depend_on_order(spark, tmp_path):
    x = _written(spark, tmp_path)
    a = build_samples(x, tasks=3).orderBy("item_id").collect()
    assert a == build_samples(x.repartition(5), tasks=2).orderBy("item_id").collect()
    assert build_samples(x.limit(0)).count() == 0
    by = {}
    for r in a:
        by.setdefault((r["kind"], r["status"]), []).append(r)
    assert len(by[None, "unknown kind"]) == 8 and all(r["splice_loss_weight"] == 0 for r in by["other", "unknown kind"])
    splices = by["imdsplice", "ok"] + by["casiasplice", "ok"]
    assert all(r["supervised"] == (r["crop_mode"] != "fallback" and np.mean(r["splice_labels"]) >= 0.02) for r in splices) and any(r["supervised"] for r in splices)
    assert all(sum(r["splice_labels"]) == 0 and not r["supervised"] for r in by["imdreal", "ok"] + by["aesplice", "ok"])
    assert any(r["degrade_supervised"] and sum(r["degrade_labels"]) for r in by["aesplice", "ok"]) and all(r["invariance_active"] for r in by["imdreal", "ok"])
    assert {r["variant"] for r in splices} <= {"splice_negative", "splice_mask_corrupt", *P.VARIANTS}


def test_pictures_lie_on_the_disk_for_some_items_at_a_time(spark, tmp_path):
    x = _written(spark, tmp_path).select(*X.ITEM[:-1])

    def kernel(pdf, root):
        import os

        import pandas as pd

        there = sum(len(f) for _, _, f in os.walk(root))
        return pd.DataFrame({"item_id": pdf["item_id"], "root": root, "there": there, "named": pdf[["img", "mask", "ae_recon"]].notna().sum().sum()})

    got = X.on_pictures(x, kernel, "item_id long, root string, there long, named long", at_once=5, tasks=2).collect()
    assert sorted(r["item_id"] for r in got) == list(range(64)) and all(r["there"] == r["named"] <= 10 for r in got)
    assert not any(os.path.exists(r["root"]) for r in got)
    names = x.withColumn("mask", F.when(F.col("mask").isNotNull(), "m"))
    facts = lambda df: sorted((r["path"].removeprefix(f"{tmp_path}/"), *r[1:]) for r in df.collect())
    files = _written(spark, tmp_path).select(F.explode(F.array("img", "mask")).alias("path")).where("path is not null")
    assert facts(X.on_pictures(names, X.facts_kernel, X.FACTS, at_once=5)) == facts(X.decoded_facts(files))
    a, b = (sorted(map(str, X.on_pictures(x.repartition(n), X.sample_kernel(), X.SAMPLE, at_once=k, tasks=n).collect())) for n, k in ((2, 5), (5, 64)))
    assert a == b and len(a) == 64


def test_pictures_as_bytes_are_those_of_files(spark, tmp_path):
    x = _written(spark, tmp_path).select(*X.ITEM[:-1])

    def kernel(pdf, files):
        import pandas as pd

        held = {n for c in ("img", "mask", "ae_recon") for n in pdf[c].dropna()}
        return pd.DataFrame({"item_id": pdf["item_id"], "bytes": isinstance(files, dict) and set(files) == held, "n": len(held)})

    got = X.on_pictures(x, kernel, "item_id long, bytes boolean, n int", at_once=5, tasks=2, on_disk=False).collect()
    assert sorted(r["item_id"] for r in got) == list(range(64)) and all(r["bytes"] and r["n"] <= 15 for r in got)
    a, b = (sorted(map(str, X.on_pictures(x, X.facts_kernel, X.FACTS, on_disk=d).collect())) for d in (True, False))
    assert a == b and len(a) == 64 + x.where("mask is not null").count()
    import pandas as pd

    bad = X.facts_kernel(pd.DataFrame({"img": ["a", "b"], "mask": [None, "c"]}), {"a": b"no picture", "c": P.png_bytes(np.zeros((3, 5), np.uint8), 0)})
    assert bad[["path", "ok"]].values.tolist() == [["a", False], ["b", False], ["c", True]] and bad["width"][2] == 5


def test_blobs_and_pictures_drawn_at_once():
    for i in range(400):
        b = P.Blob(area=[(0.05, 0.25), (0.1, 0.4), (0.45, 0.8)][i % 3], lobes=3 * (i % 20 == 0), amplitude=0.2)
        a, c = rng(i), rng(i)
        assert (P.blob_cells(48 + i % 17, a, b) == (P.blob_mask(48 + i % 17, c, b) >= 0.5)).all() and a.random() == c.random()
    x = rng(1).integers(0, 256, (5, 6, 7, 3), dtype=np.uint8)
    assert (P.resize_each(x, (48, 20)) == np.stack([P.resize(v, (48, 20)) for v in x])).all() and P.resize_each(x * 0 + 255, (9, 9)).min() == 255


def _bytes_of_items():
    import pandas as pd

    kinds = ["imdsplice", "casiasplice", "imdreal", "indoorreal", "casiareal", "aesplice", None, "other"]
    x = pd.DataFrame([(i, None, "" if i % 8 < 2 and i % 16 < 10 else None, kinds[i % 8], "c", "s") for i in range(128)], columns=X.ITEM[:-1])
    some, pictures = X._drawn(x, 48)
    return some, {n: P.png_bytes(a, 0) for n, a in pictures}


@pytest.mark.parametrize("how", [{}, {"light": "noise_aggressive", "soft": True}, {"whole_corrupt": 0.9, "families": ("poisson", "gaussian")}, {"train": False, "degrade": False, "eval_mode": "mask_poisson"}])
def test_samples_are_the_same_whichever_columns_are_asked_for(how):
    x, files = _bytes_of_items()
    whole = X.sample_kernel(X.Recipe(**how), keep_pixels=True)(x, files)
    for cols in ([c for c in X.NAMES if c != "pixels"], ["status", "crop_mode", "variant", "target_family", "crop_coverage", "noise_severity"], ["noise_family"], ["mean_change"], ["applied_ops"], ["kind", "status", "supervised", "splice_loss_weight"]):
        part = X.sample_kernel(X.Recipe(**how), columns=cols)(x, files)
        assert list(part) == list(cols) and str(part.to_dict("list")) == str(whole[cols].to_dict("list")), cols
    assert whole["pixels"].notna().sum() == 96 and X.sample_schema(("status", "applied_ops")) == f"status string, applied_ops {X.OPS}" and X.sample_schema(X.NAMES) == X.SAMPLE


def test_pictures_that_no_column_needs_are_not_worked_out(monkeypatch):
    from dataclasses import replace

    x, files = _bytes_of_items()
    runs = []
    for n, f in [*P.FAMILIES.items()]:
        monkeypatch.setitem(P.FAMILIES, n, f if f.noise else replace(f, run=lambda a, g, f=f, **p: (runs.append(1), f.run(a, g, **p))[1]))
    recipe = X.Recipe(families=("jpeg", "resize"), light="light")
    X.sample_kernel(recipe, columns=["status", "variant"])(x, files)
    assert not runs
    X.sample_kernel(recipe, columns=["mean_change"])(x, files)
    assert len(runs) >= 64
    missing = X.sample_kernel(recipe, columns=["status"])(x, {n: b for n, b in files.items() if not n.endswith("/3_img.png")} | {"02/2_img.png": b"no picture"})
    assert [missing["status"][i] for i in (2, 3, 4)] == ["unreadable", "unreadable", "ok"]


@pytest.mark.parametrize("name", ["pix_sample_mix", "pix_samples", "pix_file_facts", "pix_sample_status"])
def test_queries_leave_no_pictures_and_no_samples_behind(spark, name):
    from patchmill.plans.pixels import QUERIES

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    files = lambda: {f for _, _, fs in os.walk(shared) for f in fs if f.endswith((".png", ".parquet"))}
    before = files()
    once, again = (sorted(map(str, QUERIES[name](spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert once == again and once and files() == before


def test_samples_of_broken_files_and_modes(spark, tmp_path):
    x = _written(spark, tmp_path)
    rows = {r["item_id"]: r for r in x.collect()}
    open(rows[0]["img"], "wb").write(b"no picture")
    open(rows[1]["mask"], "wb").write(P.png_bytes(np.zeros((48, 48), np.uint8)))
    open(rows[8]["mask"], "wb").write(P.png_bytes(np.zeros((40, 48), np.uint8)))
    got = {r["item_id"]: r for r in build_samples(x.withColumn("img", F.when(F.col("item_id") != 2, F.col("img")))).collect()}
    assert [got[i]["status"] for i in (0, 1, 2, 8)] == ["unreadable", "dropped", "unreadable", "unreadable"]
    e = {r["item_id"]: r for r in build_samples(x, X.Recipe(train=False, degrade=False, eval_mode="mask_gaussian")).collect()}
    assert e[9]["crop_mode"] == "resize" and e[9]["noise_region"] == "mask" and e[9]["degrade_labels"] == e[9]["splice_labels"] and e[3]["whole_image_aug"]
    p = build_samples(x.where("item_id = 9"), X.Recipe(train=False, degrade=False), keep_pixels=True).first()["pixels"]
    assert (P.png_pixels(bytes(p)) == P.fit(P.read_pixels(rows[9]["img"]), P.Grid(64, 8))).all()
    band = [r["crop_coverage"] for r in build_samples(x.where("kind = 'casiasplice' and item_id > 1"), X.Recipe(cover_band=(0.1, 0.4))).collect()]
    assert all(0.05 < v < 0.6 for v in band)
    with pytest.raises(ConfigError):
        X.Recipe(scale_mix=[((0.5, 0.2), 1)])
    t = X.crop_telemetry(build_samples(x)).collect()
    assert sum(r["n"] for r in t) == 64
    from patchmill.operators.sampling import loader_plan

    b = X.batches(build_samples(x), loader_plan(x, "item_id", batch=8, replicas=2, seed=1), "item_id").collect()
    assert len(b) == 8 and all(r["n"] == len(r["item_id"]) <= 8 for r in b)


def test_masks_are_refitted_and_tiers_read(spark, tmp_path):
    x = _written(spark, tmp_path)
    rows = {r["item_id"]: r for r in x.collect()}
    odd = np.zeros((24, 24), np.uint8)
    odd[:12] = 255
    open(rows[0]["mask"], "wb").write(P.png_bytes(odd))
    open(rows[1]["img"], "wb").write(b"")
    files = x.select(F.explode(F.array("img", "mask")).alias("path")).where("path is not null")
    facts = Workspace(spark, "t").cut(X.decoded_facts(files))
    ready = Workspace(spark, "t").cut(X.prepared(x, facts, f"{tmp_path}/cache"))
    assert ready.count() == 63 and ready.where("mask_was is not null").count() == 1
    assert [r["written"] for r in X.fix_masks(ready).collect()] == [True] and [r["written"] for r in X.fix_masks(ready).collect()] == [False]
    m = P.read_pixels(ready.where("item_id = 0").first()["mask"])
    assert m.shape == (48, 48) and (m[:24] == 255).all() and (m[24:] == 0).all()
    areas = X.mask_areas(ready)
    t = {r["item_id"]: r["area_tier"] for r in X.with_area_tier(ready, areas).collect()}
    assert t[0] == "large" and t[2] == "real" and t[6] == "tiny"


def test_png_and_jpeg_round_trips():
    g = rng(5)
    for shape in ((7, 5), (9, 4, 3), (1, 1), (33, 64, 3)):
        a = g.integers(0, 256, shape, dtype=np.uint8)
        assert (P.png_pixels(P.png_bytes(a)) == a).all()
    a = g.integers(0, 256, (6, 5, 3), dtype=np.uint8)
    up, lines = np.zeros(15, int), []
    for y, kind in enumerate((0, 1, 2, 3, 4, 1)):  # every way in which lines may be coded
        x = a[y].ravel().astype(int)
        left, corner = np.concatenate([[0] * 3, x[:-3]]), np.concatenate([[0] * 3, up[:-3]])
        d = np.stack([abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)])
        guess = np.choose(d.argmin(0), [left, up, corner])
        lines.append(bytes([kind]) + bytes(((x - [np.zeros(15, int), left, up, (left + up) // 2, guess][kind]) % 256).astype(np.uint8)))
        up = x
    import struct
    import zlib

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = P.PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert (P.png_pixels(png) == a).all()
    for bad in (b"", b"abc", png[:-20], png[:40], png.replace(b"IDAT", b"IDAX")):
        with pytest.raises(DataError):
            P.png_pixels(bad)
    smooth = P.resize(g.integers(0, 256, (4, 4, 3), dtype=np.uint8), (50, 47))
    err = [float(np.abs(P.jpeg(smooth, g, q).astype(int) - smooth).mean()) for q in (95, 60, 20)]
    assert err[0] < 4 and err[0] <= err[1] <= err[2] and P.jpeg(smooth, g, 35).shape == smooth.shape
    flat = np.full((16, 16, 3), 128, np.uint8)
    assert np.abs(P.jpeg(flat, g, 35).astype(int) - 128).max() <= 1


def test_grids_crops_and_places():
    with pytest.raises(ConfigError):
        P.Grid(100, 8)
    assert (P.Grid(64, 8).per_side, P.Grid(64, 8).patches) == (8, 64) and P.square_grid(49) == (7, 7) and P.square_grid(50) is None and P.square_grid(0) is None
    img = np.arange(60 * 40 * 3).reshape(60, 40, 3).astype(np.uint8)
    assert P.centre_crop(img, P.Grid(32, 8)).shape == (32, 32, 3)
    for i in range(50):
        t, l, h, w = P.random_window(60, 40, rng(i), (0.2, 0.9))
        assert 0 <= t <= 60 - h and 0 <= l <= 40 - w and h * w <= 0.95 * 2400
    assert P.random_window(10, 1000, rng(0), (0.9, 1.0)) == (0, 493, 10, 13)
    m = np.zeros((50, 60), bool)
    m[10:20, 30:40] = True
    assert P.natural_crop(np.zeros((5, 5), bool), 0.2, rng()) is None
    for i in range(30):
        t, l, s, cover = P.natural_crop(m, 0.25, rng(i))
        assert s == 20 and m[t : t + s, l : l + s].any() and cover == pytest.approx(m[t : t + s, l : l + s].mean())
    p = P.place(np.array([[True, False], [False, True]]), (2, 1, 6, 5), 8, 8)
    assert p.sum() == 8 and p[1:3, 2:4].all() and p[3:5, 4:6].all()
    lab = np.zeros((6, 6), int)
    lab[2, 3] = 1
    assert P.minority_box(lab, 6, 0.5) == ((1, 4, 2, 5), pytest.approx(1 / 36)) and P.minority_box(np.zeros((6, 6)), 6, 0.5) == (None, 0.0)
    fine = P.place_fine(np.ones(16), (1, 3, 0, 2), P.Grid(32, 8))
    assert fine.sum() == 256 and fine[8:24, :16].all()
    a, b, ops = P.invariance_pair(img, rng(2), ("gaussian", "resize"))
    assert (a == img).all() and not (b == img).all() and len(ops) == 2

def test_zoom_regions_of_patches(spark):
    x = spark.createDataFrame([(1, r, c, 5.0 if r < 2 and c < 2 else 0.0) for r in range(7) for c in range(7)], "image_id long, r int, c int, attention double")
    r = zoom_regions(x).first()
    assert (r["rank"], r["r0"], r["c0"]) == (0, 0, 0) and r["r1"] >= 1 and r["c1"] >= 1


def test_queue(tmp_path):
    q = tmp_path / "q.json"
    q.write_text(json.dumps({"base_args": {"a": 1, "r": "{run_root}/x"}, "runs": [{"name": "n1", "module": "m", "args": {"a": 2, "l": [1, 2], "f": True, "g": False}}, {"name": "n2", "module": "m"}]}))
    d = R.load_queue(str(q))
    args = R.merged_args(d["runs"][0], d["base_args"], "/root")
    assert args["a"] == 2 and args["r"] == "/root/x" and args["checkpoint_root"] == "/root/n1"
    assert R.command_line({"a": 2, "l": [1, 2], "f": True, "g": False, "n": None}) == ["--a", "2", "--l", "1", "2", "--f"]
    R.write_marker(str(tmp_path / "done/n1.json"), {"exit_code": 0})
    assert R.to_run(d, str(tmp_path / "done")) == ["n2"] and R.to_run(d, str(tmp_path / "done"), {"n1"}) == ["n1", "n2"]
    with pytest.raises(ConfigError):
        R.to_run(d, str(tmp_path), {"zz"})
    for bad in ("{}", '{"runs": []}', '{"runs": [{"name": "a", "module": "m"}, {"name": "a", "module": ""}]}', '{"runs": [3]}'):
        q.write_text(bad)
        with pytest.raises(ConfigError):
            R.load_queue(str(q))
    q.write_text("{")
    with pytest.raises(DataError):
        R.load_queue(str(q))


def test_metric_log_and_run_dir(tmp_path):
    log = R.MetricLog(str(tmp_path / "m.csv"))
    assert log.last() == {}
    log.append(epoch=1, a=0.5)
    log.append(epoch=2, b=None)
    log.append(epoch=3, a=1)
    assert log.last() == {"epoch": "3", "a": "1", "b": ""} and (tmp_path / "m.csv").read_text().splitlines()[1] == "1,0.5,"
    d = R.run_dir(str(tmp_path), "my run!", stamp="s")
    assert d.root.name == "my_run_s" and json.loads(d.manifest.read_text())["name"] == "my run!" and R.run_dir(str(tmp_path), "my run!", stamp="s") == d
    assert R.find_latest(str(tmp_path)) is None
    for i, n in enumerate(("a.pt", "b.ckpt")):
        (tmp_path / n).write_text("")
        os.utime(tmp_path / n, (i, i))
    assert R.find_latest(str(tmp_path)).endswith("b.ckpt")
    assert R.metric_row("[x]", n=3, f1=0.5, fp_rate=0.25, ok=True, z=float("nan")) == "[x] n=3 f1=0.5000 fp_rate=0.250 ok=true z=nan"
    assert R.first_given(None, "", "b") == "b" and R.safe_name("//") == "run"


def test_file_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.PNG").write_bytes(b"123")
    (tmp_path / "a/y.txt").write_bytes(b"# no\nrel/p.png\n\n/abs/q.png\x00/abs/q.png\n")
    li = {r["name"]: r for r in S.listing(spark, str(tmp_path)).collect()}
    assert li["x.PNG"]["ext"] == ".png" and li["x.PNG"]["length"] == 3 and li["x.PNG"]["path"] == str(tmp_path / "a/x.PNG")
    assert {r["path"] for r in S.text_manifest(spark, str(tmp_path / "a/y.txt"), "/r").collect()} == {"/r/rel/p.png", "/abs/q.png"}
    assert S.newest(S.listing(spark, str(tmp_path))).count() == 1
    img = S.images(spark, str(tmp_path / "a/x.PNG")).first()
    assert img["ok"] is False
    (tmp_path / "q.json").write_text('{"runs": [{"name": "n", "module": "m", "args": {"k": "1"}}]}')
    assert S.json_queue(spark, str(tmp_path / "q.json")).first()["args"] == {"k": "1"}
    S.write_ids(spark.range(3), "id", str(tmp_path / "ids"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "ids")).collect()) == ["0", "1", "2"]


def test_streams_forget_late_rows_and_stop(spark, tmp_path):
    from patchmill.streaming.events import run_to_end, stopping, window_counts

    spark.createDataFrame([("a", f"2026-01-01 00:{m:02d}:00", float(v)) for m, v in enumerate([1, 5, 5, 5, 9])], "event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "e.parquet"))
    s = spark.readStream.schema("event_type string, ts timestamp, value double").parquet(str(tmp_path / "e.parquet"))
    assert sum(r["n"] for r in run_to_end(window_counts(s, "1 hour"), "complete").collect()) == 5
    r = run_to_end(stopping(s.select("event_type", "ts", "value"), "event_type", 0.1, 2), "update").first()
    assert (r["seen"], r["best"], r["stopped"]) == (5, 5.0, True)


def test_indoor_layouts_and_manifests(spark, tmp_path):
    def put(*names):
        for n in names:
            p = tmp_path / n
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(b"x")

    got = lambda root: {(r["img"].removeprefix(str(tmp_path) + "/"), r["split"]) for r in S.indoor_dataset(spark, str(tmp_path / root), "h2").collect()}
    put("a/h1/images/p.png", "a/h1/q.png", "a/h2/r.JPG", "a/h2/deep/s.png", "a/h3/t.txt")
    assert got("a") == {("a/h1/images/p.png", "train"), ("a/h2/r.JPG", "val")}
    put("b/p.png", "b/x/h2/q.png")
    assert got("b") == {("b/p.png", "train"), ("b/x/h2/q.png", "val")}
    put("c/x/y/z/p.png")
    assert got("c") == {("c/x/y/z/p.png", "train")} and got("gone") == set() and got("b/p.png") == {("b/p.png", "train")}
    (tmp_path / "m.txt").write_text(f"# list\na/h1/q.png\na/h1/q.png\na/h3/t.txt\nnone.png\n{tmp_path}/a/h2/r.JPG\n")
    assert got("m.txt") == {("a/h1/q.png", "train"), ("a/h2/r.JPG", "val")}
    tree = {"/d": ["B-Free", "other"], "/d/B-Free": ["COCO_real_512", "SD2.1_inpainted_diffcat.zip", "sd2.1_inpainted_samecat", "BBox", "mask"]}
    assert S.bfree_root(tree, "/d") == "/d/B-Free" and S.bfree_root(tree, "/x") == "/x" and S.named_folder(tree["/d/B-Free"], "bbox") == "BBox" and S.named_folder([], "a") is None


def test_summaries_of_runs(spark, tmp_path):
    for n, rows in (("r1", "epoch,f1\n1,0.1\n2,0.2\n"), ("r2", "epoch,iou,status\n1,0.5,x\n")):
        (tmp_path / n).mkdir()
        (tmp_path / n / "metrics.csv").write_text(rows)
    last = S.last_rows(spark, S.listing(spark, str(tmp_path), glob="*.csv")).withColumn("name", F.substring_index("dir", "/", -1))
    runs = spark.createDataFrame([("r1", "done", 0, 1.5), ("r2", "failed", 1, 2.0), ("r3", None, None, None)], "name string, status string, exit_code int, wall_seconds double")
    x = S.run_summary(runs, last)
    assert x.columns == ["name", "status", "exit_code", "wall_seconds", "epoch", "f1", "iou"]
    assert {r["name"]: (r["status"], r["epoch"], r["f1"], r["iou"]) for r in x.collect()} == {"r1": ("done", "2", "0.2", ""), "r2": ("failed", "1", "", "0.5"), "r3": ("pending", "", "", "")}
    (tmp_path / "log.txt").write_text("\n".join(f"l{i}" for i in range(100)))
    assert S.log_tail(spark, str(tmp_path / "log.txt"), 3) == ["l97", "l98", "l99"]


def test_queue_is_run_and_marked(tmp_path):
    q = {"runs": [{"name": "a", "module": "m", "args": {"code": 0}}, {"name": "b", "module": "m", "args": {"code": 3}}, {"name": "c", "module": "m"}], "base_args": {}}
    cmd = lambda m, a: ["sh", "-c", f"echo {' '.join(a)}; exit {a[a.index('--code') + 1] if '--code' in a else 0}"]
    got = R.run_queue(q, str(tmp_path), stop_on_failure=True, command=cmd)
    assert [(r["name"], r["status"]) for r in got] == [("a", "done"), ("b", "failed"), ("c", "pending")] and "--code 0" in (tmp_path / "a/output.log").read_text()
    got = R.run_queue(q, str(tmp_path), command=cmd)
    assert [r["status"] for r in got] == ["skipped", "failed", "done"] and got[0]["exit_code"] == 0
    assert R.run_queue(q, str(tmp_path), force={"a"}, command=cmd)[0]["status"] == "done"


def test_settings_paths_and_lines(tmp_path):
    p = R.data_paths({"imd_root": "/a", "casia_root": ""}, {"casia_root": "/d", "tgif_root": "~/t"}, {"CASIA_ROOT": "/e"})
    assert p.paths["imd_root"] == "/a" and p.paths["casia_root"] == "/e" and p.origin["casia_root"] == "environment" and p.paths["tgif_root"].endswith("/t") and p.paths["bfree_root"] is None
    assert p.need("imd_root") == ["/a"]
    with pytest.raises(ConfigError):
        p.need("bfree_root")
    assert R.RunConfig.of({"side": "64", "patch": 8}).side == 64
    for bad in ({"side": 65, "patch": 8}, {"zz": 1}, {"val_frac": 2}, {"side": "x"}):
        with pytest.raises(ConfigError):
            R.RunConfig.of(bad)
    seen = []
    log = R.RunLog(str(tmp_path / "l/run.log"), seen.append)
    log.warn("[data]", "no root")
    log.metrics("[eval]", f1=0.5)
    with pytest.raises(ValueError):
        log.line("no tag")
    assert seen == ["[data] WARN: no root", "[eval] f1=0.5000"] and (tmp_path / "l/run.log").read_text().splitlines() == seen
    assert R.commit_of(str(tmp_path)) == "nogit" and R.percentile_line({n: 0.5 for n in ("p1", "p5", "p25", "median", "p75", "p95", "p99", "mean")}).startswith("p1=0.5000 p5=")
    d = R.run_dir_beside(str(tmp_path / "ck/mine"), stamp="s")
    assert d.checkpoints.name == "mine" and d.root.name == "mine_s"
