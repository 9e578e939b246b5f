"""SuperMinHash near-duplicates against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest

from tessera.llm import neardup
from tessera.llm.queries import NEARDUP_SQL, op3_neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, words):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())


def brute(rows, words, percent):
    """component by doc_id, over distinct (doc_id, text)."""
    sets = [(i, shingles(t, words)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def check(got, want):
    rows = got.collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    check(op3_neardup(spark, sf), brute(docs, 3, 85))


def test_sql_against_brute_force(sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    docs = con.execute("SELECT doc_id, text FROM documents").fetchall()
    got = {i: (n, c) for i, n, c, _ in con.execute(NEARDUP_SQL).fetchall()}
    assert got == brute(docs, 3, 85)


def planted(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for g in range(6):
        base = [r.choice(words) for _ in range(r.choice([30, 60, 200]))]
        for _ in range(r.choice([2, 5, 40])):
            t = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 40)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((n, " ".join(t)))
            n += 1
    chain = [r.choice(words) for _ in range(100)]
    for _ in range(30):  # neighbours alike, ends not
        chain = chain[3:] + [r.choice(words) for _ in range(3)]
        rows.append((n, " ".join(chain)))
        n += 1
    rows += [(n + k, " ".join(r.choice(words) for _ in range(50))) for k in range(60)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_planted_groups(spark, words, percent):
    rows = planted()
    check(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), words, percent), brute(rows, words, percent))


def test_distributed_star_rounds(spark):
    rows = planted(2)
    check(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, local_links=0), brute(rows, 3, 85))


def test_defined_results(spark):
    long = " ".join(f"t{i % 5000}" for i in range(600_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (6, "one two three"), (7, long), (8, long + " end"), (8, long + " end"), (9, "Ä b c"), (10, "ä b c"), (None, "one two")]
    docs = spark.createDataFrame([(i, t, True, 5) for i, t in rows], "doc_id long, text string, kept boolean, key int")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 3, 85).collect()]
    n = 5000
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, n, 7), (8, n + 1, 7), (8, n + 1, 7), (9, 1, 9), (10, 1, 10), (None, 1, 4)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_signature_places_estimate_similarity():
    """Each element ranks once at every level in another place; agreement follows the similarity."""
    e = np.random.default_rng(0).integers(0, 2**64, 1200, dtype=np.uint64)
    places = np.stack([neardup.place(e[:50], k) for k in range(neardup.PLACES)])
    assert all(sorted(places[:, i]) == list(range(neardup.PLACES)) for i in range(50))
    a, b = np.sort(e[:1000]), np.sort(e[200:])
    s = neardup.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]))
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.15
    assert (s != 0xFFFFFFFF).all()


@pytest.mark.parametrize("limit", [neardup.BROADCAST_IDS, -1])
def test_keep_one(spark, limit):
    t = " ".join(f"a{i}" for i in range(40))
    rows = [(5, t, "x"), (3, t, "y"), (9, "other words stand here now", "z"), (9, "other words stand here now", "z"), (7, None, "n"), (8, "", "e"), (None, t, "o")]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string"), broadcast_ids=limit)
    assert sorted(((r.doc_id, r.lang) for r in kept.collect()), key=repr) == [(3, "y"), (7, "n"), (8, "e"), (9, "z"), (None, "o")]
