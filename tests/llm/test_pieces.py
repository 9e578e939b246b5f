"""Sampled segmentations: round trips, distinctness, brute force on small lattices."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pieces
from tessera.llm.queries import op6_pieces, tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary(PATH)


def all_segmentations(v, text):
    """(pieces, log weight) of every segmentation of one unit."""
    if not text:
        return [((), 0.0)]
    out = []
    for n in range(1, min(len(text), v.longest) + 1):
        i = v.sp.piece_to_id(text[:n])
        own = np.flatnonzero(v.ids == i)
        if v.sp.id_to_piece(i) == text[:n] and len(own):
            out += [((i, *rest), float(v.weights[own[0]]) + w) for rest, w in all_segmentations(v, text[n:])]
        elif n == 1:
            raw = text[0].encode()
            out += [((*v.byte[list(raw)].tolist(), *rest), v.byte_weight * len(raw) + w) for rest, w in all_segmentations(v, text[1:])]
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from(" ▁\nabcthe")), max_size=30))
def test_round_trip(text):
    v = pieces.vocabulary(PATH)
    found = pieces.Sampler(v, 4)([text], ["7"])[0]
    assert len({x[0].tobytes() for x in found}) == len(found) >= 1
    for ids, log_p, inclusion in found:
        assert v.decode(ids.tolist()) == text
        assert log_p <= 1e-6 and 0 <= inclusion <= 1
    assert v.decode(v.encode(text)) == text or "▁" in text or text.strip() != text


def test_library_decodes_the_same(vocabulary):
    for text in ("hello world", "Ünïcode – and 中文 字!", "two  blanks\nand a line"):
        for ids, _, _ in pieces.Sampler(vocabulary, 3)([text], ["1"])[0]:
            assert vocabulary.sp.decode(ids.tolist()) == text


def test_log_probabilities_against_enumeration(vocabulary):
    text = "there 中x"
    units = pieces.UNITS.findall(vocabulary.normal(text))
    options = []
    for u in units:
        found = all_segmentations(vocabulary, u)
        z = np.logaddexp.reduce([w for _, w in found])
        options.append([(p, w - z) for p, w in found])
    want = {sum((p for p, _ in c), ()): sum(w for _, w in c) for c in itertools.product(*options)}
    for n in range(20):
        for ids, log_p, _ in pieces.Sampler(vocabulary, 3)([text], [str(n)])[0]:
            assert abs(want[tuple(ids.tolist())] - log_p) < 1e-4


def test_small_lattices_are_emptied(vocabulary):
    """A text with few segmentations gives each once, all with certainty."""
    want = {p for p, _ in all_segmentations(vocabulary, "▁at")}
    found = pieces.Sampler(vocabulary, 50)(["at"], ["3"])[0]
    assert {tuple(x[0].tolist()) for x in found} <= want and len(found) >= 2
    assert pieces.Sampler(vocabulary, 3)([""], ["3"])[0][0][0].tolist() == []


@pytest.mark.parametrize("text", ["of", "in", "to", "of the is"])
def test_rare_alternatives_are_sampled(vocabulary, text):
    """A second segmentation is found however little mass it has, with the right probability."""
    units = pieces.UNITS.findall(vocabulary.normal(text))
    options = [all_segmentations(vocabulary, u) for u in units]
    z = sum(np.logaddexp.reduce([w for _, w in o]) for o in options)
    want = {sum((p for p, _ in c), ()): sum(w for _, w in c) - z for c in itertools.product(*options)}
    asked = min(len(want), 4)
    for n in range(20):
        found = pieces.Sampler(vocabulary, asked)([text], [str(n)])[0]
        assert len({x[0].tobytes() for x in found}) == len(found) == asked
        assert all(abs(want[tuple(ids.tolist())] - log_p) < 1e-4 for ids, log_p, _ in found)
    every = pieces.Sampler(vocabulary, len(want) + 1)([text], ["1"])[0] if len(units) == 1 else []
    assert {tuple(x[0].tolist()) for x in every} == (set(want) if every else set())


def test_samples_follow_the_distribution(vocabulary):
    """First samples have the model's probabilities; pairs those of draws without replacement."""
    text = "ther"
    options = all_segmentations(vocabulary, "▁ther")
    z = np.logaddexp.reduce([w for _, w in options])
    p = {s: math.exp(w - z) for s, w in options}
    n = 6000
    sampler = pieces.Sampler(vocabulary, 2, seed=5)
    found = sampler([text] * n, [str(i) for i in range(n)])
    first = Counter(tuple(f[0][0].tolist()) for f in found)
    second = Counter(tuple(f[1][0].tolist()) for f in found)
    for s, q in p.items():
        assert abs(first[s] / n - q) < 0.03
        without = sum(r * q / (1 - r) for t, r in p.items() if t != s)
        assert abs(second[s] / n - without) < 0.04


def test_inclusion_scores(vocabulary):
    """Weighting samples by their inclusion probabilities counts segmentations without bias."""
    options = all_segmentations(vocabulary, "▁thing")
    n = 4000
    found = pieces.Sampler(vocabulary, 3, seed=2)(["thing"] * n, [str(i) for i in range(n)])
    p = dict.fromkeys((tuple(s) for s, _ in options), 0.0)
    z = np.logaddexp.reduce([w for _, w in options])
    for f in found:
        for ids, log_p, inclusion in f:
            p[tuple(ids.tolist())] += math.exp(log_p) / inclusion / n
    for s, w in options:
        if math.exp(w - z) > 0.02:
            assert abs(p[tuple(s)] - math.exp(w - z)) < 0.15 * math.exp(w - z) + 0.01


def test_query(spark, sf):
    rows = op6_pieces(spark, sf).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows} == docs and all(r.decodes for r in rows)
    per = Counter(r.doc_id for r in rows)
    assert len({(r.doc_id, r.ids_crc32) for r in rows}) == len(rows) and max(per.values()) == 2
    again = op6_pieces(spark, sf).collect()
    assert sorted(rows) == sorted(again)


def test_query_returns_the_pieces(spark, sf):
    v = pieces.vocabulary(PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op6_pieces(spark, sf).limit(40).collect():
        assert len(r.ids) == r.n_pieces and v.decode(r.ids) == texts[r.doc_id]


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, "the cat"), (3, "the cat"), (None, "the cat"), (4, "word " * 200_000)]
    docs = spark.createDataFrame([(i, t, "c", 2) for i, t in rows], "doc_id long, text string, sample string, ids int")
    got = pieces.sample_segmentations(docs, PATH).collect()
    assert all(r.decodes for r in got) and [r.n_pieces for r in got if r.doc_id in (1, 2)] == [0, 0]
    three = sorted((r.sample, r.ids) for r in got if r.doc_id == 3)
    assert three[0] == three[1] and three[2] == three[3]
    assert pieces.sample_segmentations(docs.limit(0), PATH).count() == 0


def test_cache_limit_changes_nothing(monkeypatch, vocabulary):
    texts = [f"some words {i} and other{i} things" for i in range(200)]
    keys = [str(i) for i in range(200)]

    def run():
        s = pieces.Sampler(vocabulary, 2)
        return [[(x[0].tolist(), round(x[1], 4)) for x in f] for i in range(0, 200, 20) for f in s(texts[i : i + 20], keys[i : i + 20])]

    one = run()
    monkeypatch.setattr(pieces, "CACHE_CHARS", 50)
    assert run() == one


def test_no_draw_falls_after_the_last_piece(vocabulary):
    """Choices are 1 from the last piece on, also where single precision sums to less."""
    words = [f"▁{a}{b}{c}ing" for a in "abcdefgh" for b in "aeiourt" for c in "lmnprst"] + ["▁字中x", "▁ЖЖa"]
    for width in {len(w) for w in words}:
        own = [w for w in words if len(w) == width]
        lattice = pieces.Lattices(vocabulary, width)
        lattice.add(own)
        valid = lattice.ids[: len(own), 1:] != lattice.NONE
        last = lattice.most - 1 - valid[:, :, ::-1].argmax(axis=2)
        at = np.take_along_axis(lattice.cumulative[: len(own), 1:], last[:, :, None], axis=2)
        assert (at == 1).all()
