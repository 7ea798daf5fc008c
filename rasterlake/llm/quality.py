"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of whole texts are taken by numpy over Arrow buffers, a batch at a
time: shares of kinds of characters, word lengths, repeated words and lines.  The
trees are trained on the driver over at most ``TRAIN_ROWS`` labelled documents
(chosen by a hash of doc_id) on 8-bit bins of each statistic, and flattened into
arrays (feature, bin limit and leaf value by tree and node), which each task
walks for a whole batch at once.

Edge cases.  Null and empty texts have all statistics zero and get a score like
any other.  Labels that are null or of no document are left out; several labels
of one document: their mean counts.  Without any training label, or with one
class only, the score is that class's share (0.5 if there is none).  Null
doc_ids fall into fold 0.  Repeated rows get equal scores.  Very long texts are
measured whole.  Ties: of splits with equal gain the first feature and lowest bin
wins, so equal data give equal trees.  Other columns are not read for scores, so
their names cannot clash.  No rows: none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, buffers, fold, id_and_text, slices, trimmed, words

#: Most labelled documents that a fit reads.
TRAIN_ROWS = 16_000
SLICE_BYTES = 1_000_000
_MARKS = b"!*%&$#|.,;:?-\"'<>{}=/\\_()[]@+~"


def _sum(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Count of true flags by row."""
    c = np.concatenate([[0], np.cumsum(flags)])
    return (c[ends] - c[np.concatenate([[0], ends[:-1]])]).astype(np.float64)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of float32 statistics for each text."""
    parts = [_statistics(part) for _, part in slices(texts, SLICE_BYTES)]
    return np.concatenate(parts) if parts else np.zeros((0, N_STATISTICS), np.float32)


def _statistics(texts: pa.Array) -> np.ndarray:
    raw, offsets = buffers(texts)
    ends, n = offsets[1:], len(texts)
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    kinds = np.zeros(256, np.uint8)
    kinds[97:123], kinds[65:91], kinds[48:58], kinds[[32, 9]], kinds[[10, 13]], kinds[128:] = 1, 2, 3, 4, 5, 6
    for i, c in enumerate(_MARKS):
        kinds[c] = 7 + i
    row = np.repeat(np.arange(n), np.diff(offsets))
    width = 7 + len(_MARKS)
    counts = np.bincount(row * width + kinds[raw], minlength=n * width).reshape(n, width).astype(np.float64)
    share = counts / size[:, None]
    marks = counts[:, 7:].sum(axis=1)
    codes, wends, names = words(texts)
    wstart = np.concatenate([[0], wends[:-1]])
    nw = (wends - wstart).astype(np.float64)
    nw1 = np.maximum(nw, 1)
    wlen = np.diff(np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1])
    wl = wlen[codes] if len(codes) else np.zeros(0, np.int64)
    wrow = np.repeat(np.arange(n), (wends - wstart))
    pair = np.sort(wrow * max(1, len(names)) + codes)
    new = np.concatenate([[True], pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, bool)
    distinct = np.bincount((pair[new] // max(1, len(names))).astype(np.int64), minlength=n).astype(np.float64)
    at = np.flatnonzero(new)
    often = np.zeros(n)
    if len(at):
        np.maximum.at(often, pair[at] // len(names), np.diff(np.concatenate([at, [len(pair)]])))
    same = np.zeros(len(codes), bool)
    if len(codes) > 1:
        same[1:] = (codes[1:] == codes[:-1]) & (wrow[1:] == wrow[:-1])
    lines = counts[:, 5] + 1
    columns = [
        np.log1p(size), np.log1p(nw), share[:, 1], share[:, 2], share[:, 3], share[:, 4], share[:, 5], share[:, 6], marks / size,
        np.bincount(wrow, weights=wl, minlength=n) / nw1, _sum(wl <= 2, wends) / nw1, _sum(wl >= 16, wends) / nw1,
        distinct / nw1, often / nw1, _sum(same, wends) / nw1, np.log1p(lines), nw / lines, np.log1p(counts[:, 2]),
        *(counts[:, 7 + i] / nw1 for i in range(len(_MARKS))),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


N_STATISTICS = 18 + len(_MARKS)


class Trees:
    """Complete binary trees in flat arrays: node i has children 2i+1 and 2i+2; the last level is the leaves."""

    def __init__(self, feature: np.ndarray, limit: np.ndarray, leaf: np.ndarray, base: float):
        self.feature, self.limit, self.leaf, self.base = feature, limit, leaf, base

    def score(self, x: np.ndarray) -> np.ndarray:
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for f, l, v in zip(self.feature, self.limit, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > l[at])
            raw += v[at - (len(v) - 1)]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 3.0, l2: float = 2.0) -> Trees:
    """Boosting on the logistic loss; every level of a tree takes one histogram of gradients over (node, feature, bin)."""
    none = Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)), 0.0)
    if len(y) == 0:
        return none
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    none.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return none
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    raw, inner = np.full(n, none.base), (1 << depth) - 1
    features, limits, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        f, l, at = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = (1 << level) - 1, 1 << level
            place = ((at - first)[:, None] * d + np.arange(d)) * bins + binned
            gs = np.bincount(place.ravel(), np.repeat(g, d), nodes * d * bins).reshape(nodes, d, bins).cumsum(axis=2)
            hs = np.bincount(place.ravel(), np.repeat(h, d), nodes * d * bins).reshape(nodes, d, bins).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < least) | (ht - hs < least)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for k in range(nodes):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    f[first + k], l[first + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > l[at])
        at -= inner
        v = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        raw += v[at]
        features.append(f)
        limits.append(l)
        leaves.append(v)
    return Trees(np.array(features), np.array(limits), np.array(leaves), none.base)


@trimmed
def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([r.tobytes() for r in raw], pa.binary())], names=["label", "statistics"])


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int, seed: str) -> DataFrame:
    """At most so many labelled training documents, chosen by hash: doc_id, text, label (the mean of a document's labels)."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg(label).alias("label"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    there = known.count()
    if there > most:  # first by a hash range a little wider than needed: the exact limit then orders few rows
        known = known.filter(place < int((1 << 30) * min(1.0, (most + 6 * most**0.5) / there)))
    chosen = known.orderBy(place, "doc_id").limit(most)
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id")  # at most `most` rows of 16 bytes


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Trees:
    rows = labelled(docs, labels, "quality", 5, 0, most, "quality").mapInArrow(_taken, "label double, statistics binary").toPandas()
    x = np.frombuffer(b"".join(rows["statistics"]), np.float32).reshape(-1, N_STATISTICS)
    raw = rows["label"].to_numpy(float)
    order = np.lexsort((raw, *x.T[::-1])) if len(raw) else np.zeros(0, np.int64)  # independent of the order of arrival
    return fit(x[order], raw[order])


@trimmed
def _scored(batches: Iterator[pa.RecordBatch], trees: Trees, name: str = "score") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        i = batch.schema.get_field_index("text")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(trees.score(statistics(batch.column(i))))], names=[*batch.schema.names, name])


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    trees = train(docs, labels)
    out = id_and_text(docs).mapInArrow(lambda it: _scored(it, trees), "doc_id bigint, text string, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows that the classifier does not reject, with the columns they came with."""
    trees = train(docs, labels)
    bounded_batches(docs.sparkSession)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", __quality double"
    return docs.mapInArrow(lambda it: _scored(it, trees, "__quality"), schema).filter(F.col("__quality") >= threshold).select(*docs.columns)
