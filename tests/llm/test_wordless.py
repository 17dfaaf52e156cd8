"""Documents without words have subjects too."""

import os

import pytest
from pyspark.sql import functions as F

pytest.importorskip("patchmill.llm")
from patchmill.llm.queries import p9_composition, p9_found  # noqa: E402


def test_documents_without_words_have_subjects(spark, tmp_path):
    d = str(tmp_path)
    docs = [(i, "the verdict of the court. the judge and the court." if i < 30 else "the soup of the kitchen. the cook and the soup.", "s") for i in range(40)] + [(100, "123 456 7.8", "s"), (101, None, "s"), (102, "", "s"), (103, "ab c1", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(os.path.join(d, "documents.parquet"))
    spark.createDataFrame([("law",), ("food",)], "subject string").write.parquet(os.path.join(d, "subjects.parquet"))
    seeds = [(i, "Law") for i in range(10)] + [(i, "food") for i in range(30, 35)] + [(103, "FOOD")]
    spark.createDataFrame(seeds, "doc_id long, subject string").write.parquet(os.path.join(d, "subject_labels.parquet"))
    got = {(r["doc_id"], r["subject"]) for r in p9_found(spark, d).collect()}
    assert {x for x in got if x[0] >= 100} == {(100, "law"), (101, "law"), (102, "law"), (103, "food")}
    assert {i for i, _ in got} == {i for i, _, _ in docs}
    assert p9_composition(spark, d).agg(F.sum("documents")).first()[0] == len(got)
