"""Best-fit packing of tokenised documents into fixed-length sequences.

The plan is made on the length histogram, which has at most ``capacity`` rows
however large the corpus is.  A configuration linear program (columns: multisets of
lengths that fit; cover every length's demand with the fewest sequences) is solved by multiplicative
weights: each round prices configurations with an unbounded-knapsack dynamic program, which gives for every
length the best configuration that holds it; those that are nearly as good as the best of all are used
together, and lengths lose weight as they are served.  The best price bounds the optimum from below, and
the program ends once its cover is near that bound.  The solution is rounded as far as demand remains,
what is left is a program of its own, and the last few lengths are packed best-fit decreasing.  The result is a
table of intervals (length, rank range -> sequence range, offset), so that every piece finds
its place from its rank among the pieces of equal length.

Defined results: null and empty texts are one piece holding only the end id; repeated rows
are separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_schema, small_batches, staged

CAPACITY = 2048
#: Chunks kept per worker; the cache is emptied beyond it, so memory stays bounded.
CACHE_CHUNKS = 800_000
#: Pieces that one rank-numbering group holds, about, and groups besides one for each length at most.
RANK_GROUP, RANK_GROUPS = 256, 100_000
#: Rounds of a program at most, its distance from the bound, and how far from the best price a configuration may be.
ROUNDS, NEAR, CHOICE = 100, 0.02, 0.002
#: Programs in a row at most, and the fill that configurations need in order to be taken.
PROGRAMS, FULL = 8, 0.9985
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Chunks(dict):
    """Ids of white-space separated chunks, computed when first asked for."""

    #: A word of letters, or one with marks after it, none an apostrophe.
    WORD = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, tok):
        super().__init__()
        import tiktoken

        self.tok = tok
        self.piece = None
        vocab = tok.get_vocab()
        order = [t for t in sorted(vocab, key=vocab.get) if not t.startswith("<|")]
        back = {chr(c): b for b, c in byte_letters().items()}
        # merged ids ascend with merge rank and the end of a word is a suffix: a byte that UTF-8 lacks stands for it
        if [vocab[t] for t in order] == list(range(len(order))) and sum(t.endswith("</w>") for t in order[:512]) == 256:
            ranks = {bytes(back[c] for c in t.removesuffix("</w>")) + b"\xff" * t.endswith("</w>"): vocab[t] for t in order}
            if len(ranks) == len(order):
                self.piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, chunk: str) -> bytes:
        m = self.WORD.fullmatch(chunk)
        if m and self.piece and (chunk.isascii() or m[1].isalpha() and len(m[1].lower()) == len(m[1]) and unicodedata.is_normalized("NFC", chunk)):
            found = array("I", self.piece("".join(map(str.lower, m[1])).encode() + b"\xff")).tobytes()
            if m[2]:
                found += self.marks(m[2])
        else:
            found = whole(self.tok, [chunk])[0]
        self[chunk] = found
        return found

    def marks(self, run: str) -> bytes:
        if (found := self.get(run)) is None:
            found = self[run] = whole(self.tok, [run])[0]
        return found


def byte_letters() -> dict[int, int]:
    """The code point that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


def whole(tok, texts: list[str]) -> list[bytes]:
    return [np.array(e.ids, dtype="<u4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


class ChunkTokenizer:
    """Token ids of whole texts, through a cache of white-space separated chunks.

    Valid for tokenizers that lower-case, never join characters across white space and
    split letters from marks, as ``word_bpe_49k.json`` does; each chunk's ids then don't depend
    on its neighbours.  Texts with separators on which Python and the tokenizer's regular
    expression disagree are encoded whole.
    """

    ODD = re.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.cache = Chunks(self.tok)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.cache) > CACHE_CHUNKS:
            self.cache.clear()
        odd, get = self.ODD.search, self.cache.__getitem__
        return [whole(self.tok, [t])[0] if odd(t) else b"".join(map(get, t.split())) for t in texts]


_tokenizers: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts, append ``end_id`` and cut what exceeds ``capacity``.

    With ``with_ids`` each row also carries its ids as ``ids array<int>``.
    """
    small_batches(docs.sparkSession)
    ddl = PIECES + (", ids array<int>" if with_ids else "")
    schema = arrow_schema(ddl)
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        tok = tokenizer(tokenizer_path)
        for batch in batches:
            out = {name: [] for name in schema.names}
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, raw in zip(batch.column(0).to_pylist(), tok.ids(texts), strict=True):
                raw += tail
                for k in range(-(-len(raw) // (4 * capacity))):
                    part = raw[4 * capacity * k : 4 * capacity * (k + 1)]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(k * capacity)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)


def knapsack(prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unbounded knapsack over lengths 1..capacity: for every capacity the best value, the least capacity that reaches
    it (0: none), and the length that is added there last."""
    best, reach, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64), np.zeros(capacity + 1, dtype=np.int64)
    sizes = np.flatnonzero(prices > 0)
    if len(sizes) == 0:
        return best, reach, last
    own, fits = prices[sizes], np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        value = best[c - sizes[: fits[c]]]
        value += own[: fits[c]]
        k = value.argmax()
        if value[k] > best[c - 1]:
            best[c], reach[c], last[c] = value[k], c, sizes[k]
        else:
            best[c], reach[c] = best[c - 1], reach[c - 1]
    return best, reach, last


def configurations(sizes: np.ndarray, capacity: int, reach: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each length the best configuration that holds it, as a row of lengths, longest first, filled up with 0."""
    out, room = [sizes], capacity - sizes
    while (reach[room] > 0).any():
        out.append(last[reach[room]])
        room = reach[room] - out[-1]
    return np.sort(np.stack(out, axis=1), axis=1)[:, ::-1]


def configuration_program(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], float]:
    """A fractional cover of ``counts`` (configuration -> sequences) by multiplicative weights, and a bound.

    Weights start as volumes.  Each round's configurations are used in proportion to the weights of the lengths that they
    were priced for, as often as serves one length in full; the cover is scaled in the end so that the least served
    length is.  By duality no cover has fewer sequences than the bound.
    """
    sizes = np.flatnonzero(counts)
    demand = counts[sizes].astype(float)
    index = np.full(capacity + 1, len(sizes))
    index[sizes] = np.arange(len(sizes))
    w = sizes * demand / (sizes * demand).sum()
    bound, total, served = float((sizes * demand).sum() / capacity), 0.0, np.zeros(len(sizes))
    used: dict[tuple[int, ...], float] = defaultdict(float)
    for _ in range(rounds):
        prices = np.zeros(capacity + 1)
        prices[sizes] = w / demand
        best, reach, last = knapsack(prices, capacity)
        bound = max(bound, 1 / best[capacity])
        good = np.flatnonzero(prices[sizes] + best[capacity - sizes] >= (1 - CHOICE) * best[capacity])
        rows, share = configurations(sizes[good], capacity, reach, last), w[good] / w[good].sum()
        gain = np.bincount(index[rows].ravel(), np.repeat(share, rows.shape[1]), len(sizes) + 1)[:-1] / demand
        step = 1 / gain.max()
        for row, x in zip(rows.tolist(), (share * step).tolist(), strict=True):
            used[tuple(row)] += x
        served += step * gain
        total += step
        w = w * np.exp(-step * gain)
        w /= w.sum()
        if served.min() > 0 and total / served.min() <= (1 + NEAR) * bound:
            break
    # a length that no round has served (rare) is left to the next program
    scale = served.min() if served.min() > 0 else float(np.median(served))
    cover: dict[tuple[int, ...], float] = defaultdict(float)
    for row, x in used.items():  # rows of several rounds are filled up to different lengths
        cover[tuple(s for s in row if s)] += x / scale
    return dict(cover), bound


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: groups of equal sequences as (lengths, how many)."""
    groups: dict[int, list] = defaultdict(list)  # room left -> groups
    room = np.zeros(capacity + 1, dtype=np.int64)
    for s in np.flatnonzero(counts)[::-1]:
        s, n = int(s), int(counts[s])
        while n:
            fits = np.flatnonzero(room[s:])
            if len(fits) == 0:
                m = min(capacity // s, n)
                g, k = (s,) * m, n // m
                groups[capacity - s * m].append((g, k))
                room[capacity - s * m] += k
                n -= k * m
                continue
            r = s + int(fits[0])
            g, k = groups[r].pop()
            m = min(r // s, n)
            j = min(k, n // m)
            if j < k:
                groups[r].append((g, k - j))
            room[r] -= j
            groups[r - s * m].append((g + (s,) * m, j))
            room[r - s * m] += j
            n -= j * m
    return [x for gs in groups.values() for x in gs]


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """Groups of equal sequences (lengths, how many) that hold the histogram, and how many groups the programs gave.

    A program's configurations are taken from the most used on: as often as the program says, rounded, at least once,
    as far as demand remains.  What is left goes through the next program until that is little.
    """
    rest = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in histogram.items():
        rest[s] = n
    places, taken = np.arange(capacity + 1), 0
    volume = int((places * rest).sum())
    groups: list[tuple[tuple[int, ...], int]] = []
    for _ in range(PROGRAMS):
        if not rest.any():
            break
        took = 0
        for conf, x in sorted(configuration_program(rest, capacity, rounds)[0].items(), key=lambda p: (-p[1], p[0])):
            k = min(max(round(x), 1), *(int(rest[s]) // conf.count(s) for s in set(conf)))
            if k and sum(conf) >= FULL * capacity:
                groups.append((conf, k))
                took += k
                for s in conf:
                    rest[s] -= k
        taken += took
        if took < 0.01 * taken or (places * rest).sum() < 0.02 * volume:
            break
    return groups + best_fit(rest, capacity), len(groups)


def intervals(groups: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first ranks, first sequences and offsets of the runs that take its pieces in order of rank."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    first = 0
    for lengths, k in groups:
        offset = 0
        for s in lengths:
            runs[s].append((taken[s], first, offset))
            taken[s] += k
            offset += s
        first += k
    return {s: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for s, r in runs.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Give every row of ``parts`` (staged; doc_id, piece, start, length, ...) its sequence_id and offset.

    The histogram (at most ``capacity`` rows) and the runs made from it are all that the
    driver sees; runs are at most those of the configurations and are broadcast.  Ranks are
    numbered inside salted groups of a length, more for a more common one, so that no length is a hot key.
    """
    hist = {int(r["length"]): r["count"] for r in parts.groupBy("length").count().collect()}
    runs = parts.sparkSession.sparkContext.broadcast(intervals(plan_sequences(hist, capacity, rounds)[0]))
    group = max(RANK_GROUP, sum(hist.values()) // RANK_GROUPS)
    salts = F.array(*[F.lit(max(1, -(-hist.get(s, 0) // group))) for s in range(capacity + 1)])
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(salts, F.col("length").cast("int"))))
    sizes = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = (
        salted.withColumn("_n", F.row_number().over(order) - 1)
        .join(sizes, ["length", "_salt"])
        .withColumn("_rank", F.col("_before") + F.col("_n"))
        .select(*parts.columns, "_rank")
    )
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    schema = arrow_schema(ddl)

    def place(batches):
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = b.column(b.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for s in np.unique(length):
                at = np.flatnonzero(length == s)
                r0, s0, o = runs.value[int(s)]
                k = np.searchsorted(r0, rank[at], side="right") - 1
                seq[at] = s0[k] + rank[at] - r0[k]
                off[at] = o[k]
            cols = [b.column(i) for i, n in enumerate(b.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(off)], schema=schema)

    return ranked.mapInArrow(place, ddl)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack whole documents; one row per piece."""
    return pack(staged(pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
