"""The corpus pipeline: each stage's decisions against its operator and brute force."""

import random

import corpus_pipeline as cp
import pytest

from tessera.llm.queries import QUERIES

from .test_neardup import brute
from .test_packing import check_packed


@pytest.fixture(scope="module")
def stages(spark):
    """Name -> (input, output) of each stage, written as run() does."""
    from tessera.llm.shared import staged

    d = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, f in cp.STAGES:
        made = staged(f(spark, docs, d), f"test-{name}")
        out[name] = (docs, made)
        docs = made
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_names_and_columns(stages):
    assert list(stages) == ["language_id", "quality", "line_dedup", "near_dedup", "packing"]
    for name, (docs, made) in stages.items():
        if name != "packing":
            assert made.columns == list(cp.COLUMNS) and set(ids(made)) <= set(ids(docs))


def test_language_rejects_only_text_without_language(spark, stages):
    docs, made = stages["language_id"]
    gone = set(ids(docs)) - set(ids(made))
    assert len(gone) < 0.1 * docs.count()
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "123 456", "en", "s", 7)], docs.schema)
    kept = ids(cp.language_stage(spark, docs.unionByName(odd), "/root/testdata/sf0.001"))
    assert not {10**6, 10**6 + 1} & set(kept)


def test_language_rejects_noise_and_unlearned_languages(spark):
    r = random.Random(4)
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "оеаинтсрвлкмдпуяыьгзбчйхжшю", "αεηιοςτνρσκλμπυ", "".join(map(chr, range(0x3041, 0x3097)))]
    odd = [" ".join("".join(r.choice(x) for _ in range(r.randrange(3, 9))) for _ in range(n)) for x in alphabets for n in (20, 100, 800)]
    clean = docs.where("lang is not null and text is not null").orderBy("n_chars").limit(300)
    more = spark.createDataFrame([(10**9 + i, x, None, "s", len(x)) for i, x in enumerate(odd)], docs.schema)
    kept = set(ids(cp.language_stage(spark, docs.unionByName(more), d)))
    assert not {i for i in kept if i >= 10**9}
    short = ids(clean)
    assert sum(i in kept for i in short) >= 0.99 * len(short)


def test_quality_keeps_labelled_good(spark, stages):
    docs, made = stages["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/../sf0.001/labels.parquet").collect()}
    good = [i for i in ids(docs) if labels.get(i) == 1]
    kept = set(ids(made))
    assert sum(i in kept for i in good) >= 0.95 * len(good)


def test_near_dedup_against_brute_force(stages):
    docs, made = stages["near_dedup"]
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert ids(made) == sorted(i for i, (_, c) in want.items() if i == c)


def test_packing_holds_all(stages):
    docs, made = stages["packing"]
    assert set(ids(made)) == set(ids(docs))
    check_packed(made.collect(), 2048)


def test_run(spark, stages):
    made = cp.run(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, made.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, stages["packing"][1].select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_all_ten_operators_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}
