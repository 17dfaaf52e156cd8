"""Prefix-filter join against brute force; edge cases."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("patchmill.llm")
from patchmill.functions.labels import with_names  # noqa: E402
from patchmill.llm.overlap import cross_split_overlap, overlap_pairs, overlap_report, word_shingles  # noqa: E402


def _texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows, base = [], [[rng.choice(words) for _ in range(rng.randint(3, 40))] for _ in range(12)]
    for i in range(160):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, rng.choice(["train", "train", "val", "test", None]), " ".join(t)))
    return rows


def _sets(text):
    w = text.split()
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_equals_brute_force(spark, threshold):
    rows = _texts(3)
    df = spark.createDataFrame(rows, "id long, split string, text string")
    links, members = cross_split_overlap(df, "id", "split", word_shingles(F.col("text")), threshold=threshold)
    got = {(r["id_e"], r["id_t"]) for r in overlap_pairs(links, members).collect()}
    want = set()
    for i, s, a in rows:
        for j, t, b in rows:
            if s in ("val", "test") and t == "train":
                x, y = _sets(a), _sets(b)
                if len(x & y) / len(x | y) >= threshold - 1e-9:
                    want.add((i, j))
    assert got == want and want


def test_order_and_repetition_do_not_matter(spark):
    rows = _texts(4)
    df = spark.createDataFrame(rows, "id long, split string, text string")
    run = lambda x: sorted((r["id_e"], r["id_t"]) for r in overlap_pairs(*cross_split_overlap(x, "id", "split", word_shingles(F.col("text")))).collect())
    assert run(df) == run(df.unionByName(df).repartition(7))


def test_nulls_empty_texts_clashing_names_and_no_rows(spark):
    rows = [(1, "train", "a b c d e f"), (2, "val", "a b c d e f"), (3, "val", ""), (4, "train", ""), (5, None, "a b c d e f"), (None, "val", "a b c d e f"), (6, "val", None), (7, "other", "a b c d e f"), (8, "test", "x " * 20000)]
    df = spark.createDataFrame(rows, "id long, split string, text string").withColumns({"key": F.lit(1), "n": F.lit(2), "h": F.lit(3), "shingles": F.lit(4)})
    links, members = cross_split_overlap(df, "id", "split", word_shingles(F.col("text")))
    pairs = overlap_pairs(links, members)
    assert [(r["id_e"], r["id_t"]) for r in pairs.collect()] == [(2, 1)]
    links, members = cross_split_overlap(df.limit(0), "id", "split", word_shingles(F.col("text")))
    assert overlap_pairs(links, members).count() == 0


def test_report_counts_by_split_and_source(spark):
    df = spark.createDataFrame([(1, "train", "a b", "s"), (2, "val", "a b", None), (3, "val", "a b", "s")], "id long, split string, text string, source string")
    r = {(x["split"], x["source"]): (x["n_eval_records"], x["n_pairs"]) for x in overlap_report(overlap_pairs(*cross_split_overlap(df, "id", "split", word_shingles(F.col("text")), carry=("source",))), "c_source_e").collect()}
    assert r == {("val", "unknown"): (1, 1), ("val", "s"): (1, 1)}


def test_names_of_pictures(spark):
    rows = [
        ("/data/forensics/tgif2/fakes/115/115_a_b_sdpaint_fr_random_v0.png", "115_sdpaint_fr_random_v0", "115", "sdpaint_fr_random_v0"),
        ("\\data\\forensics\\indoor\\h000059\\IMG.9827.tif", None, "h000059_img_9827", "img_9827"),
        ("/mnt/x/export_1/a_b_real_kopie_1024x768.jpg", "ＣＡＳＩＡ_arc1234567_txt00012", "arc1234567_txt00012", "real"),
        ("/data/imd2020/1yhhyj7c/./1yhehyj7c_q_t_orig@2x.jpeg", None, "1yhhyj7c", "orig"),
        ("/x/000001022_l_q_FAKE (1).jpg.png", "any​edit  01022", "1022", "fake"),
        ("/x/nothing.png", None, "nothing", None),
        (None, None, None, None),
        ("", "", None, None),
    ]
    got = with_names(spark.createDataFrame([(a, b) for a, b, _, _ in rows], "img string, case_id string")).collect()
    assert [(r["p_scene"], r["p_role"]) for r in got] == [(c, d) for _, _, c, d in rows]
