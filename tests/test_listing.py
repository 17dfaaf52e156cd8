"""The listing binding takes each file once, however and wherever its path is written; the manifest is compared with it by normalised paths."""

import os

import pytest

from patchmill.operators import manifest as M
from patchmill.plans import manifest as P
from patchmill.plans.bindings import listing, path_sql
from tests.helpers import same_rows, views

D = "/root/testdata/sf0.001"


def test_listing_holds_every_file_once(spark, tmp_path):
    rows = [("/data/a//x y.JPG ", 0), ("\\data\\a\\x y.JPG", 9), ("/mnt/pool2/./b/z.png", None), ("/mnt/pool2/b/z.png", 7), ("/srv/keep/_SUCCESS", 0), (None, 3), (" ", 4)]
    spark.createDataFrame(rows, "path string, length long").write.parquet(f"{tmp_path}/listing.parquet")
    got = {r["path"]: (r["name"], r["stem"], r["ext"], r["length"]) for r in listing(spark, str(tmp_path)).collect()}
    assert got == {"/data/a/x y.JPG": ("x y.JPG", "x y", ".jpg", 9), "/mnt/pool2/b/z.png": ("z.png", "z", ".png", 7), "/srv/keep/_SUCCESS": ("_SUCCESS", "_SUCCESS", "", 0)}


def test_quality_issues_compare_normalised_paths(spark):
    x = spark.createDataFrame([(1, "casia", "imdsplice", "/p//a.png", "\\m\\a.png", " /r/./a.png", "train"), (2, "casia", "imdreal", "/gone//a.png", None, None, "train")], "item_id int, source string, kind string, img string, mask string, real_path string, split string")
    li = spark.createDataFrame([("/p/a.png", 100), ("/m/a.png", 0), ("/r/a.png", 100)], "path string, length long")
    got = {(r["item_id"], r["code"], r["detail"]) for r in M.quality_issues(x, M.file_facts(li)).collect()}
    assert got == {(1, "UNREADABLE_MASK", "\\m\\a.png"), (2, "MISSING_IMG", "/gone//a.png")}


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_tables_by_normalised_paths(spark):
    con, p = views(D), path_sql("path")
    li = f"(SELECT {p} AS path, max(length) AS length FROM listing WHERE {p} <> '' GROUP BY 1)"
    same_rows(listing(spark, D).select("path", "length"), con, f"SELECT path, length FROM {li}")
    same_rows(
        P.src_quality_issues(spark, D).where("code in ('MISSING_IMG', 'UNREADABLE_IMG')").select("item_id", "code"), con,
        f"SELECT DISTINCT item_id, CASE WHEN li.path IS NULL THEN 'MISSING_IMG' ELSE 'UNREADABLE_IMG' END AS code FROM items LEFT JOIN {li} li ON li.path = {path_sql('img')} WHERE li.path IS NULL OR length = 0",
    )
