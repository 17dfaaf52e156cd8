"""Container filling against exhaustive search; token counts against Python."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("patchmill.llm")
from patchmill.llm.packing import fill, fullest, pack, pack_report  # noqa: E402
from patchmill.llm.tokens import bpe_tokens, word_tokens  # noqa: E402


def test_fullest_equals_exhaustive_search():
    rng = random.Random(0)
    for _ in range(200):
        lengths = rng.sample(range(1, 15), rng.randint(1, 5))
        counts, room = [rng.randint(0, 3) for _ in lengths], rng.randint(0, 40)
        pick = fullest(lengths, counts, room)
        best = max(s for c in itertools.product(*[range(k + 1) for k in counts]) if (s := sum(a * b for a, b in zip(c, lengths, strict=True))) <= room)
        assert sum(x * k for x, k in pick.items()) == best
        assert all(k <= counts[lengths.index(x)] for x, k in pick.items())


def test_fill_is_tight_and_whole():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 101, 3000)
    box = fill(x, 100)
    sums = np.bincount(box, weights=x)
    assert (box >= 0).all() and sums.max() <= 100 and len(sums) <= np.ceil(x.sum() / 100) * 1.01
    assert len(fill(np.array([], dtype=int), 10)) == 0


def test_pack_edges(spark):
    rows = [(1, 5), (2, 10), (3, 0), (4, None), (5, 27), (None, 3)] + [(100 + i, 5) for i in range(30)]
    items = spark.createDataFrame(rows, "doc_id long, tokens long").withColumns({"h": F.lit(1), "size": F.lit(2), "container": F.lit(3)})
    lim = spark.createDataFrame([("ten", 10), ("bad", 0), (None, 5)], "limit_name string, capacity_tokens long")
    x = pack(items, lim, window=10).toPandas()
    five = x[x["doc_id"] == 5].sort_values("piece")
    assert five["tokens"].tolist() == [10, 10, 7] and five["start"].tolist() == [0, 10, 20]
    assert x[x["doc_id"].isin([3, 4])]["container"].isna().all()
    assert x.groupby("container")["tokens"].sum().max() <= 10
    assert sorted(map(tuple, x[["doc_id", "piece"]].values)) == sorted(map(tuple, pack(items.repartition(6), lim, window=10).toPandas()[["doc_id", "piece"]].values))
    assert pack(items.limit(0), lim).count() == 0
    assert pack_report(pack(items, lim), lim).first()["fullest"] == 10


def test_word_tokens_equal_python(spark):
    texts = ["", None, "a b", "don't stop_it!! 12,5 €", "ein Überfluß – ja…", "x y​z", "名前 こんにちは。", "\t\n  ", "a" * 100000, "rle 1 2 3 [eval] step=5529"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(word_tokens("t")).collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]+", t)) if t else 0 for t in texts]


def test_bpe_tokens_of_a_public_vocabulary(spark):
    P = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([("hello world",), (None,), ("",)], "t string")
    n = [r[0] for r in df.select(bpe_tokens("t", P.path("byte_bpe_50k.tiktoken"), P.PATTERN)).collect()]
    assert n == [2, 0, 0]
