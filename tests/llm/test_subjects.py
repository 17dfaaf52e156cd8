"""Subjects of documents made of statements whose subjects are known."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("patchmill.llm")
from patchmill.llm import subjects as S  # noqa: E402
from patchmill.llm.subjects import _hash, document_subjects, statement_terms  # noqa: E402

NOUNS = {s: [f"{s}noun{c}" for c in "abcdefghijkl"] for s in ("law", "food", "sport")}


def corpus(n, seed):
    rng = random.Random(seed)
    docs, truth, seeds = [], [], []
    for i in range(n):
        own = rng.sample(list(NOUNS), rng.choice([1, 1, 2]))
        s = [f"the mask covers {rng.choice(NOUNS[k])} next to {rng.choice(NOUNS[k])}" for k in own for _ in range(4)] + [rng.choice(["still open", "nothing else here", "checked twice"]) for _ in range(2)]
        if rng.random() < 0.5:
            other = rng.choice([k for k in NOUNS if k not in own])
            s.append(f"somebody named folder {rng.choice(NOUNS[other])}")
        rng.shuffle(s)
        docs.append((i, ". ".join(s) + "."))
        truth += [(i, k) for k in own]
        if i % 6 == 0:
            seeds += [(i, k) for k in own]
    return docs, truth, seeds


def test_subjects_are_found_and_passing_mentions_are_not(spark):
    docs, truth, seeds = corpus(300, 1)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("x"))
    got = {(r["doc_id"], r["subject"]) for r in document_subjects(d, spark.createDataFrame(seeds, "doc_id long, subject string"), sorted(NOUNS)).collect()}
    want = set(truth)
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97


def test_statements_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "123 456"), (4, "Ein Satz.Noch einer! <p class=x>Und</p>\nmehr"), (5, "wort " * 50000), (6, "#8abc9def the code 12abc"), (7, "a < b und c. tables, table; Tables"), (None, "abc"), (8, "<b " + "x" * 5000 + ">nur")]
    h = lambda *w: sorted(_hash(x) for x in w)
    got = {r["doc_id"]: [sorted(t) for t in r["terms"]] for r in statement_terms(spark.createDataFrame(rows, "doc_id long, text string"), step=2).collect()}
    assert got.pop(5) == [h("wort")] * 6250
    assert got == {1: [], 2: [], 3: [], 4: [h("ein", "satz"), h("noch", "einer"), h("und"), h("mehr")], 6: [h("the", "code")], 7: [h("und"), h("table")], 8: [h("nur")]}
    assert statement_terms(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lookups_and_joins_give_the_same_rows(spark, monkeypatch):
    docs, _, seeds = corpus(120, 5)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(seeds, "doc_id long, subject string")
    run = lambda: sorted((r["doc_id"], r["n_statements"], r["counts"], [round(x, 9) for x in r["soft"]]) for r in S.subject_shares(d, lab, sorted(NOUNS)).collect())
    small = run()
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    assert run() == small and len(small) == 120


def test_no_seeds_no_documents(spark):
    d = spark.createDataFrame([(1, "one two three. four five six."), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    got = document_subjects(d, none, ["a", "b"]).collect()
    assert [(r["doc_id"], r["subject"]) for r in got] == [(1, "a")]
    assert document_subjects(d.limit(0), none, ["a"]).count() == 0
    with pytest.raises(ValueError):
        document_subjects(d, none, [])
