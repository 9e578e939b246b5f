"""Packing: the tokenizer's own ids, gapless sequences, few of them."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing
from tessera.llm.queries import op4_packing, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
ODD = ["", " ", "Hello, WORLD! it's 3.14 don't", "a b c", "İstanbul ß ﬁ é ñ", "中文 字符 日本語テスト", "\x00\x1c\x1f x", "😀😀 a😀b", "a" * 5000, "(x)'s ''s we've 'RE", "<|endoftext|> <|startoftext|>", "٣٤ x² ½", "l'été d'un", "\t\r\n\x0b\x0c\x85 z"]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def ids_of(tok, t):
    return tok.encode(t, add_special_tokens=False).ids


def test_odd_texts_get_the_tokenizers_ids(tok):
    mine = packing.ChunkTokenizer(PATH)
    for t in ODD:
        assert np.frombuffer(mine.ids([t])[0], dtype="<u4").tolist() == ids_of(tok, t), t


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from("aäßé'’!.,-_09 \n\t")), max_size=40))
def test_any_text_gets_the_tokenizers_ids(t):
    mine, tok = packing.tokenizer(PATH), Tokenizer.from_file(PATH) if not hasattr(test_any_text_gets_the_tokenizers_ids, "tok") else test_any_text_gets_the_tokenizers_ids.tok
    test_any_text_gets_the_tokenizers_ids.tok = tok
    assert np.frombuffer(mine.ids([t])[0], dtype="<u4").tolist() == ids_of(tok, t)


def check_packed(rows, capacity):
    """Every sequence gapless from 0 and not above the capacity."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_round_trip(spark, sf, tok):
    rows = op4_packing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = []
    for d in docs:
        raw = np.array([*ids_of(tok, d.text or ""), 0], dtype="<u4")
        want += [(d.doc_id, k, 2048 * k, len(p := raw[2048 * k : 2048 * (k + 1)]), zlib.crc32(p.tobytes())) for k in range(-(-len(raw) // 2048))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    used = check_packed(rows, 2048)
    assert used <= -(-sum(r.length for r in rows) // 2048) + max(2, used // 100)


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (4, "word " * 300_000)]
    docs = spark.createDataFrame([(i, t, 1, "l") for i, t in rows], "doc_id long, text string, length int, sequence_id string")
    got = packing.pack_documents(docs, PATH).collect()
    check_packed(got, 2048)
    assert sorted(((r.doc_id, r.piece, r.length) for r in got if r.doc_id != 4), key=repr) == sorted([(1, 0, 1), (2, 0, 1), (3, 0, 4), (3, 0, 4), (None, 0, 2)], key=repr)
    assert sum(r.length for r in got if r.doc_id == 4) == 300_001
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_ids_column(spark, tok):
    docs = spark.createDataFrame([(1, "hello there " * 100)], "doc_id long, text string")
    parts = packing.pieces(docs, PATH, capacity=64, with_ids=True).orderBy("piece").collect()
    assert [i for p in parts for i in p.ids] == [*ids_of(tok, "hello there " * 100), 0]


def test_plans_against_exact_minimum():
    """Small programs against exhaustive search."""
    import functools

    def least(items, capacity):
        @functools.cache
        def go(rest, room):
            if not rest:
                return 0
            best = 99
            for i in range(len(rest)):
                if i and rest[i] == rest[i - 1]:
                    continue
                left = rest[:i] + rest[i + 1 :]
                best = min(best, go(left, room - rest[i]) if rest[i] <= room else 1 + go(left, capacity - rest[i]))
            return best

        return go(tuple(sorted(items)), 0)

    for seed in range(12):
        items = np.random.default_rng(seed).integers(1, 10, 8).tolist()
        hist = {s: items.count(s) for s in set(items)}
        groups, _ = packing.plan_sequences(hist, 10)
        assert sorted(s for g, k in groups for s in g * k) == sorted(items) and all(sum(g) <= 10 for g, _ in groups)
        assert sum(k for _, k in groups) <= least(items, 10) + 1


def test_configuration_program_helps():
    """Where best fit alone wastes, the rounded program comes near the bound."""
    hist = {1024 - 340: 3000, 341: 3000, 1023: 3000}
    groups, _ = packing.plan_sequences(hist, 2048)
    total = sum(s * n for s, n in hist.items())
    assert sum(k for _, k in groups) <= 1.03 * total / 2048


def test_knapsack_prices():
    """For every length the best configuration that holds it, against enumeration."""
    w = np.zeros(11)
    w[[3, 5, 7]] = [2.0, 4.0, 5.0]
    best, reach, last = packing.knapsack(w, 10)
    value = lambda c: sum(w[s] for s in c if s)
    every = [(3,) * a + (5,) * b + (7,) * c for a in range(4) for b in range(3) for c in range(2) if 3 * a + 5 * b + 7 * c <= 10]
    assert best[10] == max(map(value, every)) == 8.0
    for s, row in zip((3, 5, 7), packing.configurations(np.array([3, 5, 7]), 10, reach, last), strict=True):
        assert s in row and sum(row) <= 10 and value(row) == max(value(c) for c in every if s in c)


def histogram_of(spark, d):
    return {r["length"]: r["count"] for r in packing.pieces(spark.read.parquet(f"/root/testdata/{d}/documents.parquet"), PATH).groupBy("length").count().collect()}


@pytest.mark.parametrize("times", [1, 100])
def test_sequences_come_from_configurations(spark, times):
    """The programs give most sequences, and there are hardly more than the tokens need."""
    hist = {s: times * n for s, n in histogram_of(spark, "sf0.01").items()}
    groups, n = packing.plan_sequences(hist)
    made, all_ = sum(k for _, k in groups[:n]), sum(k for _, k in groups)
    assert made >= 0.8 * all_
    assert all_ <= 1.01 * -(-sum(s * k for s, k in hist.items()) // 2048)
    left = dict(hist)
    for g, k in groups:
        for s in g:
            left[s] -= k
    assert not any(left.values())


def test_program_is_a_cover_near_its_bound():
    """Where volume is no bound (every sequence wastes a third), duality gives one, and the program comes near it."""
    counts = np.zeros(301, dtype=np.int64)
    counts[[101, 99, 200]] = [900, 40, 300]
    cover, bound = packing.configuration_program(counts, 300, rounds=400)
    for s in np.flatnonzero(counts):
        assert sum(x * c.count(s) for c, x in cover.items()) >= counts[s] - 1e-6
    assert all(sum(c) <= 300 for c in cover) and bound - 1e-6 <= sum(cover.values()) <= 1.03 * bound
    assert bound > 1.05 * (np.arange(301) * counts).sum() / 300
