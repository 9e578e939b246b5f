"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

A document's set is its distinct word shingles.  Each element draws one rank for every
signature place from a permutation of its own, so the ranks of an element are
correlated and signatures vary less than with independent hashes; levels of ranks are
drawn for a batch of documents together and stop for a document as soon as its largest minimum
is below the level (early stopping).

Documents of one set are one class; only classes are compared.  Bands of the signature give
candidates.  In every bucket each class is first compared with two of the bucket's classes only, so a
large group costs twice as many comparisons as it has members.  Components follow from the
confirmed links; after that, classes of buckets that still hold several components are all
compared unless an exact bound rules a pair out, so no link that banding can see is lost.  Every
link is confirmed on full sets.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; shorter
texts than one shingle count as one shingle of all their words; repeated rows are copies of
each other; rows without doc_id get the component of documents with their set (null if there are none)
and are compared with no other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import GOLD, arrow_schema, mix64, salted_join, scratch, small_batches, staged

PLACES = 128
#: Bands and rows by the least similarity in per cent: the chance to miss a pair at the threshold is below 1e-6.
BANDS = ((85, 25, 5), (80, 32, 4), (0, 64, 2))
#: Bytes that are hashed at once.
STEP = 1 << 22
#: Ids that are broadcast at most; more are joined by shuffle.
BROADCAST_IDS = 500_000
#: Links that one task contracts at most; more go through distributed star rounds.
LOCAL_LINKS = 2_000_000

_rng = np.random.default_rng(20240229)
TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
TABLE[65:91] = TABLE[97:123]
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
K1, K2, K3 = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        with np.errstate(over="ignore"):
            x = np.full(max(n, 1 << 16), np.uint64(base))
            x[0] = 1
            _powers[base] = np.cumprod(x)
    return _powers[base][:n]


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of a byte array, A-Z taken as a-z."""
    word = ~SEPARATOR[raw]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(TABLE[raw] * powers(BASE, len(raw)))])
        return start, mix64((total[end] - total[start]) * powers(INVERSE, len(raw))[start] + (end - start).astype(np.uint64) * GOLD)


def blocks(raw: np.ndarray):
    """Pieces of about ``STEP`` bytes that end between words, with their places."""
    i = 0
    while i < len(raw):
        j = min(i + STEP, len(raw))
        while j < len(raw) and not SEPARATOR[raw[j]]:
            j += 1
        yield i, raw[i:j]
        i = j


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, sorted within each, and the bounds of each text's."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
    lengths = np.array([len(p) + 1 for p in parts])
    ends = np.cumsum(lengths)
    found = [(i + s, h) for i, b in blocks(raw) for s, h in [word_hashes(b)]]
    start = np.concatenate([f[0] for f in found]) if found else np.zeros(0, dtype=np.int64)
    h = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.uint64)
    bounds = np.concatenate([[0], np.searchsorted(start, ends)])
    sets = []
    with np.errstate(over="ignore"):
        k = [np.uint64(1)]
        for _ in range(words - 1):
            k.append(k[-1] * K1 + K2)
        n = len(h)
        rolled = np.zeros(max(0, n - words + 1), dtype=np.uint64)
        for j in range(words):
            rolled += h[j : j + len(rolled)] * (k[j] | np.uint64(1))
        rolled = mix64(rolled)
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            if z - a >= words:
                x = np.sort(rolled[a : z - words + 1])
                sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
            elif z > a:
                x = np.uint64(z - a) * K3
                for j in range(z - a):
                    x = x + h[a + j] * (k[j] | np.uint64(1))
                sets.append(mix64(np.array([x])))
            else:
                sets.append(np.zeros(0, dtype=np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def place(e: np.ndarray, level: int) -> np.ndarray:
    """The place that element ``e`` ranks at ``level``: a permutation of the places for each element."""
    mask = np.uint32(PLACES - 1)
    low = e.astype(np.uint32)
    high = (e >> np.uint64(32)).astype(np.uint32)
    x = (np.uint32(level) ^ low) & mask
    x = (x * (low >> np.uint32(7) | np.uint32(1))) & mask
    x ^= x >> np.uint32(3)
    x = (x * (high | np.uint32(1)) + (high >> np.uint32(8))) & mask
    x ^= x >> np.uint32(4)
    return (x * (low >> np.uint32(16) | np.uint32(1)) + (high >> np.uint32(18))) & mask


def signatures(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SuperMinHash signatures, documents x places, rank level in the high bits."""
    docs = len(bounds) - 1
    sig = np.full((docs, PLACES), 0xFFFFFFFF, dtype=np.uint32)
    flat = sig.reshape(-1)
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    e = elements
    for level in range(PLACES):
        if len(e) == 0:
            break
        with np.errstate(over="ignore"):
            r = (mix64(e + np.uint64(level + 1) * GOLD) >> np.uint64(39)).astype(np.uint32)
        np.minimum.at(flat, doc * PLACES + place(e, level), (np.uint32(level) << np.uint32(25)) | r)
        more = sig.max(axis=1) >= np.uint32((level + 1) << 25) if level + 1 < PLACES else np.zeros(docs, dtype=bool)
        if not more.all():
            keep = more[doc]
            e, doc = e[keep], doc[keep]
    return sig


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.broadcast_to(np.arange(bands, dtype=np.uint64) * K3, x.shape[:2])
        for j in range(rows):
            h = mix64(h * K1 + x[:, :, j] + GOLD)
    return h.astype(np.int64)


def set_keys(elements: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits of each set, whatever its order."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix64(elements * k + GOLD))]) for k in (K1, K2)]
        one, two = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
        return [a.tobytes() + b.tobytes() for a, b in zip(mix64(one), mix64(two + np.diff(bounds).astype(np.uint64)), strict=True)]


def in_steps(texts: list[str | None]):
    """Slices of about ``STEP`` characters, so that long texts are hashed alone."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > STEP:
            yield a, i
            a, size = i, 0
        size += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def sign(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key of the set, its size and its band hashes."""
    small_batches(docs.sparkSession)
    ddl = "doc_id long, key binary, n_shingles long, bands array<long>"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in in_steps(texts):
                elements, bounds = shingle_sets(texts[i:j], words)
                h = band_hashes(signatures(elements, bounds), bands, rows)
                offsets = np.arange(j - i + 1, dtype=np.int32) * bands
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(set_keys(elements, bounds), pa.binary()), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.reshape(-1)))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """key and ``shingles array<long>`` of the documents whose id is in ``ids`` (doc_id, staged)."""
    small_batches(docs.sparkSession)
    few = ids.count() <= BROADCAST_IDS
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    ddl = "key binary, shingles array<long>"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in in_steps(texts):
                elements, bounds = shingle_sets(texts[i:j], words)
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(elements, bounds), pa.binary()), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(elements.astype(np.int64)))], schema=schema)

    return picked.mapInArrow(run, ddl)


def union_find(pairs) -> dict:
    """Root (the least member) of every node of ``pairs``."""
    up: dict = {}

    def root(x):
        r = x
        while up.setdefault(r, r) != r:
            r = up[r]
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def contract(links: DataFrame) -> DataFrame:
    """Each partition's links (a, b) as stars around its components' least members."""
    schema = arrow_schema("a binary, b binary")

    def run(batches):
        roots = union_find(p for x in batches for p in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True))
        rows = [(x, r) for x, r in roots.items() if x != r]
        for i in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows[i : i + 50_000], strict=True)], schema=schema)

    return links.select("a", "b").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """node and root (least node of its component) for every node of ``links`` that is not a root.

    Partitions first contract their own links by union-find.  While more than ``local_links`` remain,
    large-star and small-star rounds run over all of them, staged each round, until
    nothing changes; fewer are contracted in one task.
    """
    small_batches(links.sparkSession)
    now = staged(contract(links), "links")
    if now.count() <= local_links:
        return contract(now.coalesce(1)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = staged(small, "small-star")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    The first class of a bucket may be in many pairs; it is the last key joined, with one row on its other
    side, so a skewed partition can be split.
    """
    joined = (
        pairs.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
        .join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
        .withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
    )
    return joined.where(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def possible_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``open_`` (key, n, root), of different roots, that exact bounds don't rule out.

    Shingles are ordered from rare to common among the open classes.  Two sets that are similar
    enough share one of their first n - ceil(n * percent / 100) + 1 shingles (prefix filter), and
    what they can share after the places of the first one in common is enough (positional filter).
    """
    shingles = sets.join(open_, "key").select("key", "n", "root", F.explode("shingles").alias("x"))
    common = shingles.groupBy("x").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ordered = shingles.join(common, "x").groupBy("key", "n", "root").agg(F.sort_array(F.collect_list(F.struct("c", "x"))).alias("s"))
    ordered = ordered.withColumn("own", F.col("n") - F.size("s"))  # shingles that no other has come first
    first = F.expr(f"slice(s, 1, cast(greatest(0, n - ceil(n * {percent} / 100) + 1 - own) as int))")
    rows = ordered.select("key", "n", "root", "own", F.posexplode(first).alias("i", "f")).select("key", "n", "root", "own", (F.col("own") + F.col("i")).alias("i"), F.col("f.x").alias("x"))
    one = rows.select("x", *[F.col(c).alias(f"{c}1") for c in ("key", "n", "root", "own", "i")])
    most = F.least(F.col("n") - F.greatest("i", "own"), F.col("n1") - F.greatest("i1", "own1"))
    enough = most * 100 >= (F.col("n") + F.col("n1") - most) * percent
    pairs = rows.join(one, "x").where((F.col("key1") < F.col("key")) & (F.col("root1") != F.col("root")) & enough)
    return pairs.select(F.col("key1").alias("a"), F.col("key").alias("b")).distinct()


def link_classes(docs: DataFrame, signed: DataFrame, words: int, percent: int, local_links: int = LOCAL_LINKS) -> DataFrame:
    """node and root of every linked class of ``signed`` (staged).

    First every class of a bucket is compared with two classes of it.  Classes of buckets that then still
    hold several components are open; their pairs in different components are compared unless
    exact bounds rule them out.
    """
    with scratch(docs.sparkSession) as keep:
        classes = signed.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        rows = staged(classes.where("rep is not null").select("key", "rep", "n", F.explode("bands").alias("bucket")), "bands")
        order = F.struct(F.xxhash64("key", "bucket"), "key", "n")
        first = staged(rows.groupBy("bucket").agg(F.min(order).alias("f"), F.max(order).alias("g"), F.count(F.lit(1)).alias("_count")).where("f.key <> g.key"), "hubs")
        members = salted_join(rows, first.select("bucket", F.array("f", "g").alias("hubs"), "_count"), "bucket", rows.count(), F.xxhash64("key"))
        members = staged(members.select("bucket", "key", "rep", "n", "hubs"), "members")
        ids = staged(members.select(F.col("rep").alias("doc_id")).distinct(), "ids")
        sets = staged(full_sets(docs, ids, words).join(members.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "sets")
        alike = F.least("n", "n1") * 100 >= F.greatest("n", "n1") * percent
        hubs = members.select("key", "n", F.explode("hubs").alias("h")).select("key", "n", F.col("h.key").alias("key1"), F.col("h.n").alias("n1"))
        checked = staged(hubs.where((F.col("key") != F.col("key1")) & alike).select(F.greatest("key1", "key").alias("b"), F.least("key", "key1").alias("a")).distinct(), "pairs")
        links = staged(confirmed(checked, sets, percent), "confirmed")
        roots = staged(components(links, local_links), "roots")
        now = members.join(roots, members["key"] == roots["node"], "left").select("bucket", "key", "n", F.coalesce("root", "key").alias("root"))
        several = staged(now.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("_count")).where("lo <> hi").select("bucket", "_count"), "several")
        now = staged(salted_join(now, several, "bucket", members.count(), F.xxhash64("key"), "left_semi").select("key", "n", "root").distinct(), "open")
        pairs = possible_pairs(now, sets, percent)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(checked, ["a", "b"], "left_anti")
        more = staged(confirmed(pairs, sets, percent), "confirmed")
        return keep(staged(components(links.unionByName(more), local_links), "roots"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, local_links: int = LOCAL_LINKS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the document that names its component) of every row."""
    with scratch(docs.sparkSession) as keep:
        bands, rows = next((b, r) for p, b, r in BANDS if percent >= p)
        signed = keep(staged(sign(docs, words, bands, rows), "signed"))
        roots = link_classes(docs, signed, words, percent, local_links)
        own = signed.where("n_shingles > 0").select("doc_id", "key", "n_shingles")
        named = own.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_count")).join(roots, F.col("key") == F.col("node"), "left").select("key", "rep", "root", "_count")
        # a component's name is the least id of its classes; roots themselves are not in ``roots``
        groups = roots.groupBy("root").count().select("root")
        in_group = named.join(groups.select(F.col("root").alias("own_root")), F.col("key") == F.col("own_root"), "left").withColumn("group", F.coalesce("root", "own_root"))
        # classes of no group are alone; they stay out of the join, where they would be one key
        in_group = staged(in_group.select("key", "rep", "group", F.col("_count").alias("_rows")), "in-group")
        linked, alone = in_group.where("group is not null"), in_group.where("group is null").select("key", F.col("rep").alias("component_id"), F.col("_rows").alias("_count"))
        names = staged(linked.groupBy("group").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("_count")), "names")
        linked = salted_join(linked, names, "group", in_group.count(), F.xxhash64("key")).select("key", "component_id", F.col("_rows").alias("_count"))
        of_class = keep(staged(alone.unionByName(linked), "classes"))
        full = salted_join(own, of_class, "key", signed.count(), F.xxhash64("doc_id")).select("doc_id", "n_shingles", "component_id")
        empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The rows of ``docs`` (all columns) without all but one of each group of near-duplicates.

    The document with the smallest id stays; of repeated rows of that id one stays; rows without
    doc_id stay.  Rows are joined to the ids that go or repeat, so what is kept is whole: up to
    ``broadcast_ids`` ids go to all tasks and no text is shuffled, more are joined by shuffle, once.
    """
    with scratch(docs.sparkSession) as keep:
        marked = staged(near_duplicates(docs, words, percent), "marked")
        flags = keep(staged(_flags(marked), "flags"))
    joined = docs.join(F.broadcast(flags) if flags.count() <= broadcast_ids else flags, "doc_id", "left")
    rest = joined.where("_twice is null").select(*docs.columns)
    if flags.where("_twice").isEmpty():
        return rest
    return rest.unionByName(joined.where("_twice").select(*docs.columns).dropDuplicates(["doc_id"]))


def _flags(marked: DataFrame) -> DataFrame:
    """Ids that go (``_twice`` false) and ids that stay but stand on several rows (true)."""
    gone = marked.where("not kept and doc_id is not null").select("doc_id").distinct().withColumn("_twice", F.lit(False))
    twice = marked.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id", F.lit(True).alias("_twice"))
    return gone.unionByName(twice)
