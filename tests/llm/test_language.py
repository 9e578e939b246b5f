"""String-kernel language identification: held-out accuracy and defined results."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import language
from tessera.llm.queries import op1_language

SAMPLE = {"aa": "the cat and the dog went over the hill", "bb": "el gato y el perro cruzan la colina", "cc": "кошка и собака идут через холм"}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = op1_language(spark, d).where("held_out").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert len(rows) > 150
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_every_row_once_and_type(spark, sf):
    got = op1_language(spark, sf)
    assert got.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    ids = sorted(r.doc_id for r in got.collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())


def test_defined_results(spark):
    learn = spark.createDataFrame([(i, f"{t} {i % 7 * 'x'}", k) for i, (k, t) in enumerate(list(SAMPLE.items()) * 8)], "doc_id long, text string, lang string")
    model = language.train(learn)
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, SAMPLE["bb"]), (4, SAMPLE["bb"]), (None, SAMPLE["cc"]), (6, "the hill " * 400_000)]
    docs = spark.createDataFrame([(i, t, "zz", 1.0) for i, t in odd], "doc_id long, text string, lang_pred string, score double")
    rows = language.predict(docs, model).collect()
    by = sorted(((r.doc_id, r.lang_pred) for r in rows), key=repr)
    assert by == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "bb"), (4, "bb"), (None, "cc"), (6, "aa")], key=repr)
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language.predict(docs.limit(0), model).count() == 0
    nothing = language.train(learn.limit(0))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def test_scores_equal_the_kernel_expansion(monkeypatch):
    """The folded matrix gives what the kernel with the landmarks and the regression in their span give, written out."""
    p = language.Presence()
    texts = [(k, f"{t} {w}") for k, t in SAMPLE.items() for w in ("ab", "cde", "fg", "hij klm", "n")]
    rows = [(k, p(t)[0].astype(np.int64)) for k, t in texts]
    monkeypatch.setattr(language, "SLICE", 64)
    model = language.fit(rows, landmarks=2)
    kernel = lambda a, b: len(set(a) & set(b)) / np.sqrt(len(a) * len(b))
    landmarks = [x for k in SAMPLE for x in [r for lang, r in rows if lang == k][:2]]
    g = np.array([[kernel(a, b) for b in landmarks] for a in landmarks])
    c = np.array([[kernel(a, b) for b in landmarks] for _, a in rows])
    y = np.array([[1.0 if lang == k else -1.0 for k in SAMPLE] for lang, _ in rows])
    # ridge regression on Nystroem features c g^-1/2 is, in coefficients of the landmarks: (c'c + ridge g) beta = c'y
    beta = np.linalg.solve(c.T @ c + language.RIDGE * len(rows) / len(SAMPLE) * g, c.T @ y)
    asked = [t for _, t in texts] + ["the dog", "el perro cruza", "собака"]
    want = np.array([[kernel(p(t)[0], b) for b in landmarks] for t in asked]) @ beta
    labels, scores = model.predict(asked, p)
    assert labels == [list(SAMPLE)[i] for i in want.argmax(axis=1)]
    assert np.allclose(scores, np.clip((want.max(axis=1) + 1) / 2, 0, 1), atol=1e-4)


def test_any_number_of_languages(spark):
    """All languages are learned, and the matrices keep their bound."""
    learn = spark.createDataFrame([(i, " ".join(f"{chr(0x4E00 + 3 * (i % 700))}{chr(0x4E01 + 3 * (i % 700))}{w}" for w in "abc"), f"l{i % 700}") for i in range(2800)], "doc_id long, text string, lang string")
    model = language.train(learn)
    assert len(model.languages) == 700 and model.bits < language.BITS and model.weights.size <= 1 << language.CELLS_BITS
    rows = language.predict(learn.where("doc_id < 700"), model, lang=F.col("lang")).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert language.bits_for(1) == language.bits_for(256) == 18 and language.bits_for(500) == 17


def test_clashing_columns_of_the_stage(spark):
    docs = spark.createDataFrame([(1, SAMPLE["aa"], "aa", 3.0, "x"), (2, "12", "aa", 1.0, "y")], "doc_id long, text string, lang string, score double, lang_pred string")
    model = language.train(docs)
    kept = language.accepted(docs, model, {})
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_inputs_are_text_only(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(docs)
    one = {(r.doc_id): (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    other = {(r.doc_id): (r.lang_pred, r.score) for r in language.predict(docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("y")), model).collect()}
    assert one == other
