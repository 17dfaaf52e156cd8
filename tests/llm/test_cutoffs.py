"""Cutoffs by histogram refinement against sorting."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("patchmill.llm")
from patchmill.llm.cutoffs import keep_cutoffs  # noqa: E402

INF = float("inf")


def brute(scores, size, frac):
    s = [x for x in scores if x is not None and not math.isnan(x)]
    if not s or frac is None:
        return None, 0
    return min(((abs(sum(v >= c for v in s) / size - frac), c, sum(v >= c for v in s)) for c in sorted(set(s))), key=lambda t: (t[0], t[1]))[1:]


def run(spark, rows, fracs, **how):
    df = spark.createDataFrame(rows, "id long, tag string, kind string, s double")
    return keep_cutoffs(df, spark.createDataFrame(fracs, "kind string, keep_frac double"), "id", ["tag", "kind"], "s", "kind", **how)


@pytest.mark.parametrize("bins,small", [(4, 1), (1024, 50_000), (3, 5)])
def test_equals_sorting(spark, bins, small):
    rng = random.Random(5)
    rows, fracs = [], [("a", 0.37), ("b", 0.9), ("c", 0.0101), (None, 0.5)]
    for i in range(900):
        v = rng.choice([None, float("nan"), INF, -INF, round(rng.gauss(0, 1), 1), rng.gauss(0, 100), 1e300, -1e300, 1e-300, 0.0])
        rows.append((i, rng.choice(["t", "u", None]), rng.choice(["a", "b", "c", "d", None]), v))
    report, kept = run(spark, rows + rows[:50], fracs, bins=bins, small=small)
    got = {(r["tag"], r["kind"]): (r["cutoff"], r["kept"]) for r in report.collect()}
    ids = sorted(r["id"] for r in kept.collect())
    want_ids = []
    for t, k in {(r[1], r[2]) for r in rows}:
        own = [r for r in rows if (r[1], r[2]) == (t, k)]
        c, n = brute([r[3] for r in own], len(own), dict(fracs).get(k))
        assert got[t, k] == (c, n)
        if c is not None:
            want_ids += [r[0] for r in own if r[3] is not None and not math.isnan(r[3]) and r[3] >= c]
    assert ids == sorted(want_ids)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=True, allow_infinity=True), min_size=1, max_size=40), st.floats(0, 1))
def test_any_scores(spark, scores, frac):
    report, _ = run(spark, [(i, "t", "a", s) for i, s in enumerate(scores)], [("a", frac)], bins=4, small=1)
    r = report.first()
    assert (r["cutoff"], r["kept"]) == brute(scores, len(scores), frac)


def test_empty_table_and_no_target(spark):
    report, kept = run(spark, [(1, "t", "a", 1.0)], [("b", 0.5)])
    assert report.first()["cutoff"] is None and kept.count() == 0
    df = spark.createDataFrame([], "id long, tag string, kind string, s double")
    report, kept = keep_cutoffs(df, spark.createDataFrame([("b", 0.5)], "kind string, keep_frac double"), "id", ["tag", "kind"], "s", "kind")
    assert report.count() == 0 and kept.count() == 0
