"""Quality trees: held-out accuracy, traversal, defined results."""

import numpy as np

from tessera.llm import quality
from tessera.llm.queries import op8_quality


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        ranks[s == v] = ranks[s == v].mean()
    n1 = y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = op8_quality(spark, d)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.where("held_out").join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id").where("quality is not null").collect()
    y, s = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    assert len(rows) > 500 and auc(y, s) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.9


def walk(trees, x):
    total = trees.base
    for t in range(len(trees.feature)):
        node = 0
        while node < trees.feature.shape[1]:
            node = 2 * node + 1 + int(x[trees.feature[t, node]] > trees.threshold[t, node])
        total += trees.value[t, node - trees.feature.shape[1]]
    return 1 / (1 + np.exp(-total))


def test_first_split_against_all_splits():
    """One tree of depth one takes the split of greatest gain among all thresholds between bins, and its leaves' steps."""
    r = np.random.default_rng(4)
    x = np.round(r.normal(size=(300, 4)), 1)
    y = (x[:, 2] + 0.3 * r.normal(size=300) > 0.4).astype(float)
    trees = quality.fit(x, y, trees=1, depth=1, rate=0.5, bins=10_000, l2=1.0, least=10)
    g, h = y - y.mean(), y.mean() * (1 - y.mean())
    gain, best = -1.0, None
    for j in range(4):
        for t in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= t
            if 10 <= left.sum() <= 290:
                own = sum(g[m].sum() ** 2 / (h * m.sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h * 300 + 1)
                if own > gain:
                    gain, best = own, (j, left)
    assert trees.feature[0, 0] == best[0] and ((x[:, best[0]] <= trees.threshold[0, 0]) == best[1]).all()
    want = [0.5 * g[m].sum() / (h * m.sum() + 1) for m in (best[1], ~best[1])]
    assert np.allclose(trees.value[0], want)


def test_clashing_columns_of_the_stage(spark):
    docs = spark.createDataFrame([(i, "A fair sentence stands here. Another one follows." if i % 2 else "|| ## 12 ||", 1.0, "s", 7) for i in range(60)], "doc_id long, text string, score double, stats string, quality int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    kept = quality.keep_accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.collect()} == {1}


def test_arrays_walk_like_nodes():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.fit(x, y, trees=30, depth=3)
    s = trees.score(x)
    assert np.allclose(s, [walk(trees, row) for row in x]) and auc(y, s) > 0.98


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, "A good sentence is here. Another one follows."), (3, "A good sentence is here. Another one follows."), (None, "x"), (5, "word " * 400_000)]
    docs = spark.createDataFrame([(i, t, 9.0, "q") for i, t in rows], "doc_id long, text string, score double, stats string")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted((i for i, _ in rows), key=repr)
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got}) == 1  # only label 1 is known
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_keep_accepted_agrees_with_scores(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    usable = labels.where("doc_id % 5 <> 0")
    want = {r.doc_id for r in quality.classify(docs, usable).where("predicted = 1").collect()}
    kept = quality.keep_accepted(docs, usable)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
