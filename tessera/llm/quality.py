"""Quality classification: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed once on the executors.  Trees are grown on
binned statistics (quantile bins, logistic loss, depth-wise splits by gain) from a bounded
sample of labelled rows, then flattened into arrays of a complete binary tree, so that a batch
of documents walks all trees together in numpy.

Defined results: null texts count as empty and get a score as well; labels that are null are not
learned from; without both labels the score is the share of label 1 (0.5 if there are none);
repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_schema, small_batches, staged

#: Labelled rows that the trees are fitted on, about, chosen by a hash of the id.
SAMPLE = 20_000
THRESHOLD = 0.3
FEATURES = (
    "chars words word_length lines line_length short_lines repeated_lines unique_words repeats_previous upper digit space stop other_mark symbol pipe control non_ascii "
    "entropy top_byte last_stop capital_words"
).split()


def _classes() -> np.ndarray:
    byte = np.arange(256)
    text = [chr(b) if b < 128 else "" for b in byte]
    rows = [[c.isupper() for c in text], [c.isdigit() for c in text], [c.isspace() for c in text], [c in ".?" and c != "" for c in text], [c in ",;:'\"()-" and c != "" for c in text], [c in "#$%&*@^~_=+<>/\\{}[]!`" and c != "" for c in text], [c == "|" for c in text], [c != "" and ord(c) < 32 and not c.isspace() for c in text], byte >= 192]
    return np.array(rows, dtype=float).T


CLASSES = _classes()


def statistics(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) / n
    words, lines = text.split(), text.split("\n")
    nw = max(len(words), 1)
    p = hist[hist > 0]
    entropy = float(-(p * np.log2(p)).sum()) if len(p) else 0.0
    full = [x for x in lines if x.strip()]
    nl = max(len(full), 1)
    return [
        np.log1p(len(text)), np.log1p(len(words)), len(text) / nw, np.log1p(len(full)), np.log1p(len(text) / nl),
        sum(len(x) < 30 for x in full) / nl, 1 - len(set(full)) / nl if full else 0.0, len(set(words)) / nw,
        sum(map(operator.eq, words, words[1:])) / nw, *(hist @ CLASSES), entropy, float(np.delete(hist, 32).max()) if raw else 0.0,
        sum(x.rstrip()[-1:] in ".!?" for x in full) / nl if full else 0.0, sum(map(str.istitle, words)) / nw,
    ]


@dataclass
class Trees:
    """Complete binary trees in arrays: for each tree and inner node a feature and threshold, for each leaf a value."""

    base: float
    depth: int
    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2^depth

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.feature) == 0 or len(x) == 0:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        t = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
        total = self.value[t, node - (2**self.depth - 1)].sum(axis=1) + self.base
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, l2: float = 1.0, least: int = 10) -> Trees:
    """Grow trees by second-order gain on per-feature histograms."""
    if len(y) == 0 or y.min() == y.max():
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Trees(float(np.log(mean / (1 - mean))), depth, np.zeros((0, 2**depth - 1), dtype=np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    f = np.full(len(y), base)
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for d in range(depth):
            first, k = 2**d - 1, 2**d
            at = node - first
            best = np.full(k, 1e-6)
            for j, e in enumerate(edges):
                if len(e) == 0:
                    continue
                m = len(e) + 1
                flat = at * m + binned[:, j]
                hg, hh, hn = (np.bincount(flat, w, k * m).reshape(k, m).cumsum(axis=1) for w in (g, h, None))
                gl, hl, nl = hg[:, :-1], hh[:, :-1], hn[:, :-1]
                gt, ht, nt = hg[:, -1:], hh[:, -1:], hn[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(nl < least) | (nt - nl < least)] = -1
                i = gain.argmax(axis=1)
                top = gain[np.arange(k), i]
                better = top > best
                best[better] = top[better]
                feature[t, first : first + k][better] = j
                threshold[t, first : first + k][better] = e[i[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        f += value[t, leaf]
    return Trees(base, depth, feature, threshold, value)


def document_statistics(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id (and text) with the statistics of the whole text as ``stats array<float>``."""
    small_batches(docs.sparkSession)
    ddl = "doc_id long, stats array<float>"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            stats = [np.array(statistics(t or ""), dtype=np.float32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(stats, pa.list_(pa.float32()))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)


def train(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fit on ``labels`` (doc_id, quality) joined to ``stats``; about ``sample`` labelled rows by a hash of the id."""
    usable = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).cast("int").alias("_y"))
    n = usable.count()
    if n > sample:
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    rows = stats.join(F.broadcast(usable), "doc_id").select("doc_id", "_y", "stats").toPandas()
    rows = rows.assign(_k=rows["stats"].map(tuple)).sort_values(["doc_id", "_y", "_k"])
    x = np.array(rows["stats"].tolist(), dtype=np.float32).reshape(len(rows), len(FEATURES))
    return fit(x, rows["_y"].to_numpy(dtype=float))


def score(stats: DataFrame, model: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on) of every row of ``stats``."""
    small_batches(stats.sparkSession)
    held = stats.sparkSession.sparkContext.broadcast(model)
    ddl = "doc_id long, score double, predicted int"
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), dtype=np.float32).reshape(b.num_rows, len(FEATURES))
            s = held.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=schema)

    return stats.select("doc_id", "stats").mapInArrow(run, ddl)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Train on ``labels`` and score every row of ``docs``; texts are read once."""
    stats = staged(document_statistics(docs), "stats")
    return score(stats, train(stats, labels, sample), threshold)


def learnable(labels: DataFrame, held_out: Column) -> DataFrame:
    return labels.where(~F.coalesce(held_out, F.lit(False)))


def keep_accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` (all columns) whose whole text the classifier accepts.

    Scoring goes along with the row, so no text is shuffled; statistics for training are computed
    only for the bounded sample of labelled documents.
    """
    small_batches(docs.sparkSession)
    usable = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    n = usable.count()
    if n > sample:
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    labelled = docs.join(F.broadcast(usable.select("doc_id").distinct()), "doc_id", "left_semi")
    model = train(document_statistics(labelled), usable, sample)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = arrow_schema(ddl := ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            x = np.array([statistics(t or "") for t in b.column(at).to_pylist()], dtype=np.float32).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays(b.columns, schema=schema).filter(pa.array(held.value.score(x) >= threshold))

    return docs.mapInArrow(run, ddl)
