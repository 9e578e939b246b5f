"""Language identification by string kernels.

The kernel counts the character n-grams (n = 1 to 3, hashed into at most 2^18 places) that two texts
share, by presence, normalised by the geometric mean of their own counts.  Landmarks
(a few texts per language) give a Nyström feature map; one-versus-rest kernel ridge
regression is solved in that space.  Feature map and weights fold into one matrix from
n-grams to languages, so a batch of texts is scored by one matrix product.

The classifier is fitted on a bounded sample: about ``per_language`` rows per language, ``ROWS`` in all,
chosen by a hash of the id; every language is learned.  With very many languages there are fewer rows and landmarks of each
(one at least) and fewer places, so that the matrices keep their bound; they are worked through in slices of places.
Prediction reads every whole text.

Whether a text is in a learned language at all is told by evidence: how many of its n-grams the language's
landmarks hold, and the margin to the second-best language.  Both bounds are the least that labelled rows
of that language and at least that size show (n-grams of a second landmark, half the margin).

Defined results: null texts and texts without a letter are ``und`` with score 0; if nothing
can be learned from, all are; repeated rows are predicted each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, small_batches

BITS = 18
PER_LANGUAGE = 250
LANDMARKS = 40
RIDGE = 1e-2
#: Rows and landmarks in all, and cells of the matrix from places to languages, at most (but one row of each language).
ROWS, LANDMARK_ROWS, CELLS_BITS = 50_000, 2_000, 26
#: Places that are worked through at once in fitting.
SLICE = 1 << 13
#: Languages whose shares of the sample are broadcast at most; more are joined by shuffle.
BROADCAST_LANGUAGES = 100_000
UND = "und"
#: Code points whose n-grams are hashed at once.
STEP = 1 << 20

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0."""
    if not _letters:
        _letters.append(np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), dtype=np.uint32, count=0x110000))
    return _letters[0]


def grams(text: str, bits: int = BITS) -> list[np.ndarray]:
    """Hashes of the 1- to 3-grams of the text, in pieces; runs of other characters count as blanks."""
    out = []
    codes = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    for i in range(0, len(codes), STEP):
        c = codes[i : i + STEP + 2]
        a = c * np.uint32(0x9E3779B1)
        shift = np.uint32(32 - bits)
        out.append(a >> shift)
        if len(c) > 1:
            b = (a[:-1] ^ (c[1:] + np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
            out.append(b >> shift)
            if len(c) > 2:
                out.append(((b[:-1] ^ (c[2:] + np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)) >> shift)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Presence:
    """A reusable presence table over the hash places."""

    def __init__(self, bits: int = BITS):
        self.bits, self.table = bits, np.zeros(1 << bits, dtype=bool)

    def __call__(self, text: str, places: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """Presence at ``places`` (without: the places present), and how many there are."""
        found = grams(text, self.bits)
        for g in found:
            self.table[g] = True
        n = int(np.count_nonzero(self.table))
        row = np.flatnonzero(self.table) if places is None else self.table[places]
        for g in found:
            self.table[g] = False
        return row, n


@dataclass
class LanguageModel:
    languages: list[str]
    places: np.ndarray
    weights: np.ndarray  # places x languages
    held: np.ndarray  # places x languages: landmarks with the place, 2 at most
    bits: int = BITS

    def predict(self, texts: list[str | None], presence: Presence) -> tuple[list[str], np.ndarray]:
        return self.evidence(texts, presence, 0)[:2]

    def evidence(self, texts: list[str | None], presence: Presence, landmarks: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Labels, scores, and of each text: the share of its n-grams in as many ``landmarks`` of its language (0: not
        counted), the margin to the next language, the number of its n-grams."""
        labels, scores = [UND] * len(texts), np.zeros(len(texts))
        cover, margin, size = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        at = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        if at:
            x = np.zeros((len(at), len(self.places)), dtype=np.float32)
            norm = np.ones(len(at))
            for k, i in enumerate(at):
                x[k], n = presence(texts[i], self.places)
                norm[k] = np.sqrt(max(n, 1))
            f = (x @ self.weights) / norm[:, None]
            best = f.argmax(axis=1)
            scores[at] = np.clip((f[np.arange(len(at)), best] + 1) / 2, 0, 1)
            for i, b in zip(at, best, strict=True):
                labels[i] = self.languages[b]
            if landmarks:
                size[at] = np.rint(norm**2)
                cover[at] = (x @ (self.held >= landmarks).astype(np.float32))[np.arange(len(at)), best] / size[at]
                top = np.sort(f, axis=1)
                margin[at] = top[:, -1] - top[:, -2] if f.shape[1] > 1 else np.inf
        return labels, scores, cover, margin, size


def bits_for(languages: int) -> int:
    """Bits of the hash places, so that places x languages stays within the bound."""
    return max(8, min(BITS, CELLS_BITS - max(0, languages - 1).bit_length()))


def fit(rows: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE, bits: int = BITS) -> LanguageModel:
    """Fit on (language, places present, sorted); the first ``landmarks`` rows of each language are the landmarks."""
    rows = [(lang, p) for lang, p in rows if len(p)]
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return LanguageModel([], np.zeros(0, dtype=np.int64), np.zeros((0, 0), dtype=np.float32), np.zeros((0, 0), dtype=np.uint8), bits)
    number = {lang: i for i, lang in enumerate(languages)}
    landmarks = max(1, min(landmarks, LANDMARK_ROWS // len(languages)))
    seen: dict[str, int] = {}
    chosen, of = [], []
    for lang, p in rows:
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] <= landmarks:
            chosen.append(p)
            of.append(number[lang])
    present = np.zeros(1 << bits, dtype=bool)
    for p in chosen:
        present[p] = True
    places = np.flatnonzero(present)
    slices = [(i, min(i + SLICE, len(places))) for i in range(0, len(places), SLICE)]

    def cells(texts: list[np.ndarray], a: int, z: int) -> np.ndarray:
        """Presence of the places a to z in each text, divided by its norm."""
        out = np.zeros((len(texts), z - a), dtype=np.float32)
        for k, p in enumerate(texts):
            own = p[np.searchsorted(p, places[a]) : np.searchsorted(p, places[z - 1], side="right")]
            at = np.searchsorted(places[a:z], own)
            at = at[(at < z - a) & (places[a:z][np.minimum(at, z - a - 1)] == own)]
            out[k, at] = 1 / np.sqrt(len(p))
        return out

    texts, m = [p for _, p in rows], len(chosen)
    kernel, x = np.zeros((m, m)), np.zeros((len(rows), m))
    held = np.zeros((len(places), len(languages)), dtype=np.uint8)
    for a, z in slices:
        own = cells(chosen, a, z)
        kernel += own @ own.T
        for i in range(0, len(texts), 1024):
            x[i : i + 1024] += cells(texts[i : i + 1024], a, z) @ own.T
        for k, lang in enumerate(of):
            held[a:z, lang] = np.minimum(held[a:z, lang] + (own[k] > 0), 2)
    w, v = np.linalg.eigh(kernel)
    root = v[:, w > 1e-8 * w.max()] / np.sqrt(w[w > 1e-8 * w.max()])
    phi = x @ root
    y = np.full((len(rows), len(languages)), -1.0)
    y[np.arange(len(rows)), [number[lang] for lang, _ in rows]] = 1.0
    # rows weigh so that every language counts alike
    share = np.array([1 / seen[lang] for lang, _ in rows]) * len(rows) / len(languages)
    alpha = np.linalg.solve(phi.T @ (phi * share[:, None]) + ridge * len(rows) / len(languages) * np.eye(phi.shape[1]), phi.T @ (y * share[:, None]))
    beta, weights = (root @ alpha).astype(np.float32), np.zeros((len(places), len(languages)), dtype=np.float32)
    for a, z in slices:
        weights[a:z] = cells(chosen, a, z).T @ beta
    return LanguageModel(languages, places, weights, held, bits)


def sample_by_hash(df: DataFrame, key: str, of: str, counts: list, per_value: int) -> DataFrame:
    """About ``per_value`` rows of each value of ``of`` (at least one is expected of each), by a hash of ``key``."""
    if not counts:
        return df.limit(0)
    bounds = df.sparkSession.createDataFrame([(r[of], int(min(1.0, per_value / r["count"]) * (1 << 30))) for r in counts], f"`{of}` string, _bound long")
    place = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 30))
    return df.join(F.broadcast(bounds) if len(counts) <= BROADCAST_LANGUAGES else bounds, of).where(place < F.col("_bound"))


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> LanguageModel:
    """Fit on rows (doc_id, text, lang) with a language; texts become places on the executors."""
    small_batches(labelled.sparkSession)
    known = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = known.groupBy("lang").count().collect()
    chosen = sample_by_hash(known, "doc_id", "lang", counts, max(1, min(per_language, ROWS // max(1, len(counts)))))
    bits = bits_for(len(counts))
    ddl = "doc_id long, lang string, places array<int>"
    schema = arrow_schema(ddl)

    def run(batches):
        presence = Presence(bits)
        for b in batches:
            places = [presence(t or "")[0].astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(places, pa.list_(pa.int32()))], schema=schema)

    rows = chosen.select("doc_id", "text", "lang").mapInArrow(run, ddl).toArrow()
    found = sorted(zip(rows["doc_id"].to_pylist(), rows["lang"].to_pylist(), (np.array(p.values if p.is_valid else [], dtype=np.int64) for p in rows["places"]), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1], len(r[2])))
    return fit([(lang, p) for _, lang, p in found], landmarks, bits=bits)


def predict(docs: DataFrame, model: LanguageModel, **extra: Column) -> DataFrame:
    """doc_id, the ``extra`` columns, lang_pred and score of every row of ``docs``."""
    small_batches(docs.sparkSession)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c.alias(n) for n, c in extra.items()])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "text") + ", lang_pred string, score double"
    schema = arrow_schema(ddl)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        presence = Presence(held.value.bits)
        for b in batches:
            labels, scores = held.value.predict(b.column(1).to_pylist(), presence)
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != 1] + [pa.array(labels, pa.string()), pa.array(scores)], schema=schema)

    return picked.mapInArrow(run, ddl)


def size_class(size: int) -> int:
    """Texts of a class have less than twice the n-grams of each other."""
    return int(size).bit_length()


def calibrate(labelled: DataFrame, model: LanguageModel) -> dict[str, list[tuple[int, float, float]]]:
    """For each language by size class the least cover and margin of all rightly named rows of that size or more.

    Cover counts n-grams of two landmarks or more, so that a row that is a landmark does not vouch for itself.
    """
    small_batches(labelled.sparkSession)
    picked = labelled.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    ddl = "lang string, class int, cover double, margin double"
    schema = arrow_schema(ddl)
    shipped = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        presence = Presence(shipped.value.bits)
        for b in batches:
            labels, _, cover, margin, size = shipped.value.evidence(b.column(0).to_pylist(), presence, 2)
            rows = [(a, size_class(n), c, m) for a, lang, c, m, n in zip(labels, b.column(1).to_pylist(), cover, margin, size, strict=True) if a == lang and n]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    out: dict[str, list[tuple[int, float, float]]] = {}
    for r in sorted(picked.mapInArrow(run, ddl).groupBy("lang", "class").agg(F.min("cover").alias("c"), F.min("margin").alias("m")).collect(), key=lambda r: (r["lang"], -r["class"])):
        own = out.setdefault(r["lang"], [])
        c, m = (min(r[k], own[-1][i]) if own else r[k] for i, k in ((1, "c"), (2, "m")))
        own.append((r["class"], c, m))
    return out


def evident(bounds: dict[str, list[tuple[int, float, float]]], label: str, cover: float, margin: float, size: int) -> bool:
    """Whether a text shows as much evidence for its language as labelled texts; any does if there are none."""
    if label == UND:
        return False
    own = bounds.get(label)
    if not own:
        return True
    n = size_class(size)
    # the largest class not above the text's, else the smallest
    _, c, m = next((b for b in own if b[0] <= n), own[-1])
    return bool(cover >= c and margin >= m / 2)


def accepted(docs: DataFrame, model: LanguageModel, bounds: dict[str, list[tuple[int, float, float]]]) -> DataFrame:
    """The rows of ``docs`` (all columns, with text) that are evidently in a learned language."""
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")
    shipped = docs.sparkSession.sparkContext.broadcast((model, bounds))

    def run(batches):
        known, least = shipped.value
        presence = Presence(known.bits)
        for b in batches:
            labels, _, cover, margin, size = known.evidence(b.column(place).to_pylist(), presence, 1)
            yield b.filter(pa.array([evident(least, *x) for x in zip(labels, cover, margin, size, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
