"""The plan over a manifest places empty files and tells why others have no place."""

from patchmill.operators.compaction import concatenate, manifest_plan
from patchmill.storage import Workspace


def test_empty_unknown_and_unlisted_files_differ(spark, tmp_path):
    d = str(tmp_path)
    for n, b in (("a.png", b"12345"), ("b.png", b""), ("_c.gif", b"123")):
        (tmp_path / n).write_bytes(b)
    items = spark.createDataFrame([(f"{d}/a.png", f"{d}//b.png"), (f"{d}/_c.gif", f"{d}/n.png"), (f"{d}/gone.png", None)], "img string, mask string")
    li = spark.createDataFrame([(f"{d}/a.png", 5), (f"{d}/b.png", 0), (f"{d}/./b.png", None), (f"{d}/_c.gif", 3), (f"{d}/n.png", None)], "path string, length long")
    p = Workspace(spark, "t").cut(manifest_plan(items, li))
    got = {r["file"].rsplit("/", 1)[1]: (r["role"], r["length"], r["output"] is not None, r["status"]) for r in p.collect()}
    assert got == {"a.png": ("img", 5, True, "placed"), "b.png": ("mask", 0, True, "empty"), "_c.gif": ("img", 3, True, "placed"), "n.png": ("mask", None, False, "unknown length"), "gone.png": ("img", None, False, "unlisted")}
    assert p.count() == 5
    r = concatenate(p, d).collect()
    assert [(x["n_files"], x["bytes"]) for x in r] == [(3, 8)]
