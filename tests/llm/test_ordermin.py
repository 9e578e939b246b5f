"""Order min-hash fingerprints against a definition in plain Python."""

import hashlib
import re

import xxhash

from tessera.llm import ordermin
from tessera.llm.queries import op9_fingerprints

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(values):
    """Hash of longs (Python ints) and ints (as one-tuples), each with the one before as seed; None is passed over."""
    h = 42
    for v in values:
        if v is not None:
            raw = v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else signed(v & MASK).to_bytes(8, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, h)
    return signed(h)


def signature(text):
    words = re.findall(r"[^ \t\n\x0b\f\r]{1,8}", text)
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    low, seen, items = ordermin.POSITION, {}, []
    for j in range(len(h)):
        kmer = chain([h[j], h[j + 1] if j + 1 < len(h) else None]) >> 28
        n = seen[kmer] = seen.get(kmer, -1) + 1
        items.append(((chain([kmer, (n,)]) if n else kmer << 28) & ~low | j))
    items.sort()
    out = []
    for q in range(ordermin.PLACES if items else 0):
        point = (q - ordermin.PLACES // 2) << 58
        ring = [x for x in items if x >= point] + [x for x in items if x < point]
        a, b = ring[0], ring[1 % len(ring)]
        first, second = (a, b) if a & low <= b & low else (b, a)
        out.append(chain([first >> 28, second >> 28]) >> 40 & 0xFFFFFF)
    return "".join(f"{v:06x}" for v in out or [0] * ordermin.PLACES)


def alike(a, b):
    return sum(a[i : i + 6] == b[i : i + 6] for i in range(0, len(a), 6)) / ordermin.PLACES


def brute(rows):
    rows = sorted(rows)
    out = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        f, g, n = signature(t), signature(edited), signature(nxt)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g, alike(f, g), alike(f, n))
    return out


def test_query_against_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = op9_fingerprints(spark, sf).collect()
    want = brute([tuple(r) for r in docs])
    assert len(got) == len(want)
    for r in got:
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == want[r.doc_id], r.doc_id


def test_buckets_change_nothing(spark, sf, monkeypatch):
    monkeypatch.setattr(ordermin, "BUCKET_ROWS", 7)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    assert {r.doc_id: (r.edited_sha256, r.near_next) for r in ordermin.fingerprints(docs).collect()} == {k: (v[1], v[5]) for k, v in want.items()}


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "one"), (6, "ab 😀😀 cd"), (7, "word " * 60_000 + "end"), (8, "word " * 60_000 + "end"), (9, "a b " * 5000)]
    docs = spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, n_chars int, _bucket string").repartition(3)
    got = {r.doc_id: r for r in ordermin.fingerprints(docs).collect()}
    want = brute(rows)
    for i, r in got.items():
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == want[i], i
    assert got[1].fingerprint == got[2].fingerprint == "0" * 6 * ordermin.PLACES and got[7].near_next == 1.0
    assert ordermin.fingerprints(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c d")], "doc_id long, text string")
    assert ordermin.fingerprints(odd).count() == 3


def test_no_python_on_the_main_path(spark, sf):
    plan = op9_fingerprints(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_likeness_falls_with_edits():
    import random

    r = random.Random(4)
    words = [f"w{r.randrange(3000)}" for _ in range(600)]
    base = signature(" ".join(words))
    last = 1.0
    for edits in (3, 30, 150):
        w = list(words)
        for i in r.sample(range(600), edits):
            w[i] = f"x{i}"
        now = alike(base, signature(" ".join(w)))
        assert now <= last
        last = now
    moved = words[300:] + words[:300]
    assert alike(base, signature(" ".join(moved))) < 0.8
