"""Small files: the plan's properties, and byte-level concatenation as an exact round trip."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from patchmill.operators.compaction import compaction_plan, concatenate, data_files, directory_report, laid_out, manifest_plan


def _listing(spark, rows):
    return spark.createDataFrame(rows, "path string, length long").withColumns({"dir": F.lit("wrong"), "file": F.lit(1), "output": F.lit(2)})


def test_data_files_normalise_and_filter(spark):
    rows = [(" /a//b/./x.JPG ", 5), ("\\a\\b\\x.JPG", 9), ("/a/b/.hid.png", 5), ("/a/b/_t.png", 5), ("/a/b/z.png", 0), ("/a/b/z2.png", None), ("/a/b/y.part", 3), ("/a/b/c.tar", 7), (None, 4), ("top.png", 2), ("", 3), ("./q.webp", 1)]
    got = {r["file"]: (r["dir"], r["length"]) for r in data_files(_listing(spark, rows)).collect()}
    assert got == {"/a/b/x.JPG": ("/a/b", 9), "/a/b/c.tar": ("/a/b", 7), "top.png": ("", 2), "q.webp": ("", 1)}


def test_plan_holds_each_file_once_and_reaches_the_target(spark):
    rng = random.Random(0)
    rows = [(f"/d/s{i % 3 and 1}/f{i}.png", rng.randint(1, 200)) for i in range(3000)] + [("/d/one/big.tar", 50_000)] + [(f"/e/x{i}/a.png", 3) for i in range(40)]
    files = data_files(_listing(spark, rows + rows[:100]))
    rep = directory_report(files, target=1000)
    plan = compaction_plan(files, rep, target=1000).toPandas()
    taken = {r["dir"] for r in rep.where("too_many").collect()}
    assert taken and "/d/one" not in taken
    want = {p for p, _ in rows if p.rsplit("/", 1)[0] in taken}
    assert set(plan["file"]) == want and plan["file"].is_unique
    out = plan.groupby("output")["length"].sum()
    assert out.max() < 1000 + 200 and out.median() > 900
    for _, g in plan.sort_values("seq").groupby("output"):
        assert (g["offset"].to_numpy() == g["length"].cumsum().shift(fill_value=0).to_numpy()).all()


def test_empty_tables(spark):
    files = data_files(_listing(spark, [("/a/x.png", 1)]).limit(0))
    assert compaction_plan(files, directory_report(files)).count() == 0


def test_manifest_plan_keeps_missing_files(spark):
    items = spark.createDataFrame([("/a/x.png", "/a/m.png"), ("/a//x.png", None), ("/a/gone.png", "/a/m.png"), (None, None)], "img string, mask string")
    p = {r["file"]: (r["role"], r["output"]) for r in manifest_plan(items, _listing(spark, [("/a/x.png", 10), ("/a/m.png", 5)])).collect()}
    assert set(p) == {"/a/x.png", "/a/m.png", "/a/gone.png"} and p["/a/gone.png"][1] is None and p["/a/x.png"][1] and p["/a/m.png"][0] == "mask"


def _plan(spark, paths):
    import os

    return spark.createDataFrame([(str(p), os.path.getsize(p), "out/all", i) for i, p in enumerate(paths)], "file string, length long, output string, seq int")


def test_lines_round_trip(spark, tmp_path):
    parts = [b"h\na\nb\n", b"h\nc", b"h\n", "h\nü\n".encode() * 1]
    paths = []
    for i, b in enumerate(parts):
        (p := tmp_path / f"{i}.csv").write_bytes(b)
        paths.append(p)
    r = concatenate(_plan(spark, paths), str(tmp_path), "lines", header=True, chunk=2).first()
    got = (tmp_path / "out/all").read_bytes()
    assert got == "h\na\nb\nc\nü\n".encode() and r["bytes"] == len(got) and r["crc32"] == zlib.crc32(got) and r["n_files"] == 4
    assert not list((tmp_path / "out").glob("*.part"))


def test_zstd_frames_round_trip(spark, tmp_path):
    zstd = pytest.importorskip("zstandard")
    data = [b"", b"x" * 500_000, bytes(random.Random(1).randbytes(300_000)), b"tail\n"]
    paths = []
    for i, b in enumerate(data):
        c = zstd.ZstdCompressor(write_checksum=i % 2 == 0, write_content_size=i != 1)
        (p := tmp_path / f"{i}.zst").write_bytes(c.compress(b))
        paths.append(p)
    concatenate(_plan(spark, paths), str(tmp_path), "zstd").collect()
    with open(tmp_path / "out/all", "rb") as f:
        assert zstd.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(data)
    paths[1].write_bytes(paths[1].read_bytes()[:-3])
    with pytest.raises(Exception, match="frame|byte"):
        concatenate(_plan(spark, paths), str(tmp_path), "zstd").collect()


def test_changed_length_is_an_error(spark, tmp_path):
    (p := tmp_path / "a.png").write_bytes(b"12345")
    plan = _plan(spark, [p])
    p.write_bytes(b"123")
    with pytest.raises(Exception, match="plan says"):
        concatenate(plan, str(tmp_path), "blob").collect()
    with pytest.raises(ValueError):
        concatenate(plan, str(tmp_path), "zip")


def test_tiny_files_are_spread_over_tasks_and_fill_outputs(spark, tmp_path):
    """A directory of very many tiny files is laid out by ranges of names, each task a bounded part, and its outputs reach the target."""
    spark.range(300_000).select(F.format_string("/d/hot/f%07d.png", "id").alias("file"), F.lit(100).cast("long").alias("length"), F.lit("/d/hot").alias("dir")).write.parquet(f"{tmp_path}/t")
    files = spark.read.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else these few bytes are one task again
    x = laid_out(files, "dir", 1_000_000, window_bytes=0)
    most = x.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most < 300_000 / 2
    assert sorted(map(tuple, laid_out(files.where("file < '/d/hot/f0000500'"), "dir", 1000, window_bytes=1 << 40).collect())) == sorted(map(tuple, laid_out(files.where("file < '/d/hot/f0000500'"), "dir", 1000, window_bytes=0).collect()))
    r = directory_report(files, 1_000_000).first()
    assert (r["n_files"], r["bytes"], r["due_files"], r["too_many"]) == (300_000, 30_000_000, 30, True)
    o = compaction_plan(files, directory_report(files, 1_000_000), 1_000_000).groupBy("output").agg(F.count("*").alias("n"), F.max("seq").alias("s"), F.max("offset").alias("o")).collect()
    assert len(o) == 30 and {(r["n"], r["s"], r["o"]) for r in o} == {(10_000, 10_000, 999_900)}


def test_outputs_of_very_many_files_are_written_in_parts(spark, tmp_path):
    paths = []
    for i in range(7):
        (p := tmp_path / f"{i}.txt").write_bytes(f"line {i}".encode() * i + b"\n" * (i % 2))
        paths.append(p)
    plan = _plan(spark, paths).withColumn("seq", F.col("seq") + 1)
    one = concatenate(plan, f"file://{tmp_path}/a", "lines").first()
    two = concatenate(plan, str(tmp_path / "b"), "lines", most_files=2, chunk=3).collect()
    assert len(two) == 1 and (two[0]["n_files"], two[0]["bytes"], two[0]["sha256"], two[0]["crc32"]) == (7, one["bytes"], one["sha256"], one["crc32"])
    assert [p.name for p in (tmp_path / "b" / "out").iterdir()] == ["all"] and (tmp_path / "a/out/all").read_bytes() == (tmp_path / "b/out/all").read_bytes()
