"""Hard negatives by product quantisation with stored residual norms, exact in the end.

Vectors are cut into sub-vectors of ``SUB`` components.  For each length of vectors
one task fits 256 centroids for every sub-space to a bounded sample (``SAMPLE``
vectors of ``SAMPLE_BYTES`` together at most); every row is then indexed: a byte of
code for each sub-space, and the norm of what its centroids leave over.  The score
of a query and a row is the product of the query with the row's centroids, plus or
minus ``|query| * residual norm`` and what rounding can do, so both ends of that
interval are rigorous.  The upper ends of a block of queries and a step of rows are
one matrix product, in single precision unless the numbers are too large.  Only rows
whose interval can still matter are scored exactly, in integers.

First pass: for each anchor the best rows of its own label.  A row matters if its
upper end reaches the k-th best score so far or the k-th highest lower end.  Second
pass: each (anchor, positive) opens a window of scores, and of the rows with other
labels those matter whose interval meets the window above what the window already
holds.  A task goes through its shards one at a time and carries what it has found,
so each (anchor or window, task) gives at most k rows; a ranking by key merges them.

Rows of a shard lie by label, so the first pass multiplies each anchor with rows of
its own label only.  Anchors travel in blocks to the shards, a chunk of blocks of at
most ``CHUNK_BYTES`` (summed and checked) at a time; shards are shuffled once, when they
are indexed, by length and a hash, so that all cores have some of them.  Each chunk's rows are a
table, so a lost executor costs at most one chunk.  Work grows as anchors times
rows, by definition.

Edge cases.  A row takes no part if its vec_id or label or vector is null, if the
vector is empty, or if a component is null or not finite (before or after scaling).
Vectors of different lengths do not meet.  Rows, not ids, are anchors, positives and
negatives: of repeated rows each is one of its own, and they are each other's
positives.  Ties go to the smaller vec_id.  Fewer than asked for: all; none: no
rows.  A positive with a negative score has an empty window.  Scores outside the
range of a long are held at its ends.  A shard holds one vector at least, however
long.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, new_folder, trimmed, written

#: Components of a sub-vector, centroids of a sub-space, and the bounds of the sample that they are fitted to.
SUB, CENTROIDS, SAMPLE, SAMPLE_BYTES, ROUNDS = 2, 256, 4096, 8_000_000, 6
SHARD_BYTES, BLOCK_BYTES, CHUNK_BYTES, STEP_ROWS, STEP_QUERIES = 4_000_000, 4_000_000, 16_000_000, 4096, 256
#: Components up to this keep single precision from overflowing; rows of a step, as one part in so many, that an anchor may have scored without narrowing first.
_SINGLE, _FEW = 1e15, 16
_LONG = (-(1 << 63), (1 << 63) - 1)
#: Whole numbers up to this are exact as doubles, and so are their sums.
_EXACT = float(1 << 53)
_ROWS = "dims bigint, ids binary, uids binary, labels binary, vectors binary"
_INDEX = _ROWS + ", codes binary, residuals binary, centroids binary"
_ASKED = "dims bigint, uid bigint, vec_id bigint, label bigint, vector binary"
_BLOCK = "b_dims bigint, block bigint, b_uids binary, b_ids binary, b_labels binary, b_vectors binary, b_windows binary, b_counts binary"
_FOUND = "uid bigint, anchor_id bigint, other bigint, positive_id bigint, positive_score bigint, found bigint, found_id bigint, score bigint"
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if v and isinstance(v[0], bytes) else pa.int64()) for v in columns.values()], names=list(columns))


def _longs(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.int64)


@trimmed
def shards_of(batches: Iterator[pa.RecordBatch], scale: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of (vec_id, label, v array<double>, part) as blobs of whole components, one length each; uids number the rows."""
    held: dict[int, list[tuple[np.ndarray, ...]]] = {}
    seen = 0

    def blobs(d: int) -> Iterator[pa.RecordBatch]:
        ids, uids, labels, v = (np.concatenate(c) for c in zip(*held.pop(d)))
        order = np.argsort(labels, kind="stable")
        ids, uids, labels, v = ids[order], uids[order], labels[order], v[order]
        rows = max(1, size // (8 * d))
        for k in range(0, len(ids), rows):
            at = slice(k, k + rows)
            yield _batch({"dims": [d], "ids": [ids[at].tobytes()], "uids": [uids[at].tobytes()], "labels": [labels[at].tobytes()], "vectors": [v[at].tobytes()]})

    for batch in batches:
        if not len(batch):
            continue
        lists, ids, labels = batch.column("v"), batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        bounds = lists.offsets.to_numpy()
        with np.errstate(over="ignore"):
            flat = np.floor(lists.values.to_numpy() * float(scale))
        uids = (batch.column("part")[0].as_py() << 40) + seen + np.arange(len(batch))
        seen += len(batch)
        length = np.diff(bounds)
        for d in np.unique(length).tolist():
            at = np.flatnonzero(length == d)
            v = flat[bounds[at][:, None] + np.arange(d)[None, :]]
            whole = np.isfinite(v).all(axis=1)
            held.setdefault(d, []).append((ids[at[whole]], uids[at[whole]], labels[at[whole]], v[whole]))
            if sum(p[3].nbytes for p in held[d]) >= size:
                yield from blobs(d)
    for d in list(held):
        yield from blobs(d)


def parts(v: np.ndarray) -> np.ndarray:
    """(rows, components) as (sub-spaces, rows, SUB), the last sub-space filled with zeros."""
    rows, d = v.shape
    m = -(-d // SUB)
    wide = np.zeros((rows, m * SUB))
    wide[:, :d] = v
    return np.ascontiguousarray(wide.reshape(rows, m, SUB).transpose(1, 0, 2))


def nearest(p: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The index of the nearest centroid for each row of one sub-space."""
    out = np.empty(len(p), np.uint8)
    half = (centroids**2).sum(axis=1) / 2
    for a in range(0, len(p), STEP_ROWS):
        out[a : a + STEP_ROWS] = np.argmax(p[a : a + STEP_ROWS] @ centroids.T - half, axis=1)
    return out


def fitted(v: np.ndarray) -> np.ndarray:
    """Centroids (sub-spaces, CENTROIDS, SUB) of a sample, by Lloyd's rounds from rows spread evenly over it."""
    out = []
    for p in parts(v):
        c = p[np.linspace(0, len(p) - 1, CENTROIDS).astype(int)].copy()
        for _ in range(ROUNDS):
            code = nearest(p, c)
            n = np.bincount(code, minlength=CENTROIDS)
            sums = np.stack([np.bincount(code, p[:, j], CENTROIDS) for j in range(SUB)], axis=1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        out.append(c)
    return np.stack(out)


@trimmed
def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes and residual norms beside the vectors of each shard; small components take two bytes."""
    for batch in batches:
        for row in batch.to_pylist():
            p = parts(np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dims"]))
            c = np.frombuffer(row["centroids"], np.float64).reshape(-1, CENTROIDS, SUB)
            codes = np.stack([nearest(x, y) for x, y in zip(p, c)])
            with np.errstate(over="ignore", invalid="ignore"):
                left = np.sqrt(((p - np.stack([y[k] for k, y in zip(codes, c)])) ** 2).sum(axis=(0, 2)))
            v = np.frombuffer(row["vectors"], np.float64)
            if np.abs(v).max(initial=0) < 1 << 15:
                row["vectors"] = v.astype(np.int16).tobytes()
            yield _batch({k: [v] for k, v in row.items() if k != "centroids"} | {"codes": [codes.tobytes()], "residuals": [left.tobytes()], "centroids": [row["centroids"]]})


@trimmed
def asked_of(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, vectors = _longs(row["ids"]), np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dims"])
            at = np.flatnonzero(ids % every == 0)
            if len(at):
                yield _batch({"dims": [row["dims"]] * len(at), "uid": _longs(row["uids"])[at].tolist(), "vec_id": ids[at].tolist(), "label": _longs(row["labels"])[at].tolist(), "vector": [vectors[i].tobytes() for i in at]})


@trimmed
def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of one length with their windows (positive uid, id, score; none in the first pass) as blobs."""
    held: dict[int, list[dict]] = {}
    made = 0

    def block(d: int) -> pa.RecordBatch:
        nonlocal made
        rows = held.pop(d)
        made += 1
        blob = lambda k: [np.array([r[k] for r in rows], np.int64).tobytes()]
        windows = [np.array([[w["other"], w["id"], w["score"]] for w in r["windows"] or []], np.int64).reshape(-1, 3) for r in rows]
        columns = {"b_dims": [d], "block": [(rows[0]["part"] << 32) + made], "b_uids": blob("uid"), "b_ids": blob("vec_id"), "b_labels": blob("label")}
        return _batch(columns | {"b_vectors": [b"".join(r["vector"] for r in rows)], "b_windows": [np.concatenate(windows).tobytes()], "b_counts": [np.array([len(w) for w in windows], np.int64).tobytes()]})

    for batch in batches:
        for row in batch.to_pylist():
            d = row["dims"]
            held.setdefault(d, []).append(row)
            if len(held[d]) * 8 * d >= BLOCK_BYTES:
                yield block(d)
    for d in list(held):
        yield block(d)


class Best:
    """The k best (score, id) of each key so far, best first."""

    def __init__(self, keys: int, k: int):
        self.k = k
        self.rows: list[list[tuple[int, int, int]]] = [[] for _ in range(keys)]
        self.need = np.full(keys, -np.inf)

    def add(self, i: int, scores: list[int], ids: list[int], uids: list[int]) -> None:
        self.rows[i] = sorted([*self.rows[i], *((-s, v, u) for s, v, u in zip(scores, ids, uids))])[: self.k]
        if len(self.rows[i]) == self.k:
            self.need[i] = -self.rows[i][-1][0]
            if abs(self.need[i]) >= _EXACT:  # a double rounds what is as large as this
                self.need[i] = np.nextafter(self.need[i], -np.inf)


def exact(q: np.ndarray, v: np.ndarray) -> list[int]:
    """Integer inner products; Python's integers where doubles would round."""
    if float(np.abs(q) @ np.abs(v).max(axis=0)) < _EXACT:
        return [int(s) for s in v @ q]
    whole = [int(x) for x in q]
    return [min(max(sum(a * int(b) for a, b in zip(whole, row)), _LONG[0]), _LONG[1]) for row in v]


class Block:
    """A block of anchors and what they have found so far."""

    def __init__(self, row: dict, k: int, bounds: tuple[int, int] | None):
        self.uids, self.ids, self.labels = _longs(row["b_uids"]), _longs(row["b_ids"]), _longs(row["b_labels"])
        self.q = np.frombuffer(row["b_vectors"], np.float64).reshape(-1, row["b_dims"])
        self.bounds, self.windows = bounds, _longs(row["b_windows"]).reshape(-1, 3)
        self.first = np.concatenate([[0], np.cumsum(_longs(row["b_counts"]))])
        self.best = Best(len(self.windows) if bounds else len(self.uids), k)
        self.met = self.scored = 0
        self.need, self.top = self.best.need, np.full(len(self.uids), np.inf)
        if bounds:  # whole scores of a window: low% to high% of the positive's
            self.low = [-(-bounds[0] * s // 100) for s in self.windows[:, 2].tolist()]
            self.high = [bounds[1] * s // 100 for s in self.windows[:, 2].tolist()]
            self.open = [[j for j in range(self.first[i], self.first[i + 1]) if self.low[j] <= self.high[j]] for i in range(len(self.uids))]
            self.need = np.full(len(self.uids), np.inf)
            for i, keys in enumerate(self.open):
                self.top[i] = np.nextafter(float(max((self.high[j] for j in keys), default=_LONG[0])), np.inf)
                self._lowered(i)
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((self.q**2).sum(axis=1))
        asked = np.array([i for i in range(len(self.uids)) if not bounds or self.open[i]], np.int64)
        asked = asked[np.argsort(self.labels[asked], kind="stable")]
        cuts = np.flatnonzero(np.diff(self.labels[asked])) + 1
        #: Anchors that go through the rows together: those of one label for rows of their own, all for rows of others.
        self.groups = np.split(asked, [] if bounds else cuts) if len(asked) else []

    def _lowered(self, i: int) -> None:
        """The least score that any window of an anchor still takes."""
        least = min((max(self.low[j], self.best.need[j]) for j in self.open[i]), default=np.inf)
        self.need[i] = np.nextafter(float(least), -np.inf)

    def search(self, row: dict) -> None:
        ids, uids, labels = _longs(row["ids"]), _longs(row["uids"]), _longs(row["labels"])
        n, d = len(ids), row["dims"]
        v = np.frombuffer(row["vectors"], np.int16 if len(row["vectors"]) == 2 * n * d else np.float64).reshape(n, d)
        codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, n)
        left = np.frombuffer(row["residuals"], np.float64).reshape(-1, n)
        centroids = np.frombuffer(row["centroids"], np.float64).reshape(-1, CENTROIDS, SUB)
        if (labels[1:] < labels[:-1]).any():
            order = np.argsort(labels, kind="stable")
            ids, uids, labels, v, codes, left = ids[order], uids[order], labels[order], v[order], codes[:, order], left[:, order]
        with np.errstate(over="ignore", invalid="ignore"):
            about = np.concatenate([c[k] for c, k in zip(centroids, codes)], axis=1)[:, :d]
            left = np.sqrt((left**2).sum(axis=0))
            left = left + (d + 8) * 2.0**-22 * (left + np.sqrt((about**2).sum(axis=1)))  # rounding of the products, in single precision too
            longest = float(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)) * float(self.norms.max(initial=0))
        large = not all(np.abs(x).max(initial=0) < _SINGLE for x in (about, left, self.norms))
        kind = np.float64 if large else np.float32
        rows = np.concatenate([about, left[:, None]], axis=1).astype(kind)
        for group in self.groups:
            own = self.labels[group[0]]
            lo, hi = (0, n) if self.bounds else (int(np.searchsorted(labels, own, side)) for side in ("left", "right"))
            for a in range(0, len(group), STEP_QUERIES):
                at = group[a : a + STEP_QUERIES]
                asked = np.concatenate([self.q[at], self.norms[at, None]], axis=1).astype(kind)
                for b in range(lo, hi, STEP_ROWS):
                    part = slice(b, min(b + STEP_ROWS, hi))
                    with np.errstate(over="ignore", invalid="ignore"):
                        high = asked @ rows[part].T
                    if large:
                        high[~np.isfinite(high)] = np.inf
                    self._step(at, asked, high, rows[part, -1], ids[part], uids[part], labels[part], v[part], longest < _EXACT)

    def _step(self, at: np.ndarray, asked: np.ndarray, high: np.ndarray, left: np.ndarray, ids, uids, labels, v, safe: bool) -> None:
        """Anchors ``at`` against some rows, given upper ends: few rows of an anchor are scored at once, of many the intervals are narrowed first."""
        if self.bounds:  # rows of an anchor's own label are out
            starts = [0, *(np.flatnonzero(np.diff(self.labels[at])) + 1).tolist(), len(at)]
            for x, y in zip(starts, starts[1:]):
                own = np.searchsorted(labels, self.labels[at[x]]), np.searchsorted(labels, self.labels[at[x]], "right")
                high[x:y, own[0] : own[1]] = -np.inf
                self.met += (y - x) * (len(ids) - int(own[1] - own[0]))
        else:
            self.met += high.size
        need = np.nextafter(self.need[at].astype(high.dtype), high.dtype.type(-np.inf))
        i, r = np.divmod(np.flatnonzero(high >= need[:, None]), len(ids))
        if not len(i):
            return
        top = high[i, r].astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            low = top - 2 * asked[i, -1].astype(np.float64) * left[r]
        low[~np.isfinite(top) | np.isnan(low)] = -np.inf
        keep = (low <= self.top[at[i]]) & (labels[r] != self.labels[at[i]] if self.bounds else uids[r] != self.uids[at[i]])
        i, r, low, top = i[keep], r[keep], low[keep], top[keep]
        many = np.bincount(i, minlength=len(at)) > (len(ids) // _FEW if safe else 0)
        for x in np.flatnonzero(many).tolist():
            k = slice(*np.searchsorted(i, [x, x + 1]))
            step = self._negatives if self.bounds else self._positives
            step(int(at[x]), low[k], top[k], ids[r[k]], uids[r[k]], labels[r[k]], v[r[k]])
        few = ~many[i]
        i, r = i[few], r[few]
        for a in range(0, len(i), STEP_ROWS):
            x, y = i[a : a + STEP_ROWS], r[a : a + STEP_ROWS]
            scores = np.einsum("ij,ij->i", self.q[at[x]], v[y].astype(np.float64))  # whole numbers below 2 ** 53
            self.scored += len(x)
            keep = np.flatnonzero((scores >= self.need[at[x]]) & (scores <= self.top[at[x]]))
            x, y, scores = x[keep], y[keep], scores[keep]
            for place in np.unique(x).tolist():
                k = slice(*np.searchsorted(x, [place, place + 1]))
                self._put(int(at[place]), [int(s) for s in scores[k]], ids[y[k]].tolist(), uids[y[k]].tolist())

    def _put(self, i: int, scores: list[int], ids: list[int], uids: list[int]) -> None:
        """Whole scores of an anchor to its windows, or to its positives."""
        if not self.bounds:
            self.best.add(i, scores, ids, uids)
            return
        for j in self.open[i]:
            least = max(self.low[j], self.best.need[j])
            rows = [x for x in zip(scores, ids, uids) if least <= x[0] <= self.high[j]]
            if rows:
                self.best.add(j, *map(list, zip(*rows)))
        self._lowered(i)

    def _take(self, key: int, i: int, at: np.ndarray, ids: np.ndarray, uids: np.ndarray, v: np.ndarray, low: int = _LONG[0], high: int = _LONG[1]) -> None:
        self.scored += len(at)
        if len(at):
            rows = [(s, n, u) for s, n, u in zip(exact(self.q[i], v[at].astype(np.float64)), ids[at].tolist(), uids[at].tolist()) if low <= s <= high]
            if rows:
                self.best.add(key, *map(list, zip(*rows)))

    def _at_least(self, low: np.ndarray, need: float) -> float:
        """The k-th highest of lower ends that are certain, if that is more."""
        k = self.best.k
        return need if len(low) < k else max(need, float(np.partition(low, len(low) - k)[len(low) - k]))

    def _positives(self, i: int, low, high, ids, uids, labels, v) -> None:
        self._take(i, i, np.flatnonzero(high >= self._at_least(low, self.best.need[i])), ids, uids, v)

    def _negatives(self, i: int, low, high, ids, uids, labels, v) -> None:
        for j in self.open[i]:
            a, b = self.low[j], self.high[j]
            other = np.flatnonzero((low <= b) & (high >= max(a, self.best.need[j])))
            if len(other):
                need = self._at_least(low[other][(low[other] >= a) & (high[other] <= b)], self.best.need[j])
                self._take(j, i, other[high[other] >= need], ids, uids, v, a, b)
        self._lowered(i)

    def found(self) -> Iterator[tuple]:
        for i in range(len(self.uids)):
            anchor = (int(self.uids[i]), int(self.ids[i]))
            keys = [(j, tuple(map(int, self.windows[j]))) for j in range(self.first[i], self.first[i + 1])] if self.bounds else [(i, (0, 0, 0))]
            for key, window in keys:
                yield from ((*anchor, *window, u, n, -s) for s, n, u in self.best.rows[key])


def _searcher(k: int, bounds: tuple[int, int] | None):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Block] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] not in blocks:
                    blocks[row["block"]] = Block(row, k, bounds)
                blocks[row["block"]].search(row)
        for block in blocks.values():
            rows = list(block.found())
            if rows:
                yield _batch(dict(zip(_FOUND_NAMES, map(list, zip(*rows)))))

    return run


def searched(index: DataFrame, asked: DataFrame, k: int, bounds: tuple[int, int] | None) -> DataFrame:
    """The k best for each anchor, or for each of its windows, over all shards."""
    spark = index.sparkSession
    blocks = written(asked.withColumn("part", F.spark_partition_id().cast("bigint")).mapInArrow(blocks_of, _BLOCK), "blocks")
    size = F.length("b_vectors") + 5 * F.length("b_uids") + F.length("b_windows")
    total = blocks.agg(F.sum(size)).first()[0] or 0
    chunks = max(1, -(-2 * total // CHUNK_BYTES))
    number = lambda: F.pmod(F.xxhash64("block"), F.lit(chunks))
    largest = blocks.agg(F.max(size)).first()[0] or 0
    while chunks < total and (blocks.groupBy(number()).agg(F.sum(size).alias("s")).agg(F.max("s")).first()[0] or 0) > max(CHUNK_BYTES, largest):
        chunks *= 2
    folder = new_folder(spark, "found")
    spark.createDataFrame([], _FOUND).write.parquet(f"{folder}/chunk=-1")
    for c in range(chunks):
        chunk = F.broadcast(blocks.filter(number() == c))  # at most CHUNK_BYTES, or one block
        pairs = index.join(chunk, index["dims"] == chunk["b_dims"]).drop("b_dims")
        pairs = pairs.withColumn("b_dims", F.col("dims"))
        pairs.mapInArrow(_searcher(k, bounds), _FOUND).write.parquet(f"{folder}/chunk={c}")
    found = spark.read.schema(_FOUND).parquet(folder)
    rank = F.row_number().over(Window.partitionBy("uid", "other").orderBy(F.desc("score"), "found_id", "found"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """Hard negatives of rows whose vec_id is divisible by ``every``: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Negatives have scores of ``low`` to ``high`` per cent of the positive's.
    """
    bounded_batches(vectors.sparkSession)
    x = F.col("embedding")
    whole = x.isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    rows = vectors.filter(whole).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.transform(x, lambda e: e.cast("double")).alias("v"), F.spark_partition_id().cast("bigint").alias("part")).filter(F.size("v") > 0)
    shards = written(rows.mapInArrow(lambda it: shards_of(it, scale, SHARD_BYTES), _ROWS), "shards")
    # Shards of one length are most or all of the table: a hash beside the length deals them out, and centroids follow to where they are needed.
    dealt = shards.withColumn("deal", F.pmod(F.xxhash64("uids"), F.lit(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    fits = dealt.select("dims", "deal").distinct().join(written(centroids(rows, scale), "centroids"), "dims")
    index = written(dealt.join(fits, ["dims", "deal"]).select(*shards.columns, F.lit(b"").alias("codes"), F.lit(b"").alias("residuals"), "centroids").mapInArrow(indexed, _INDEX), "index")
    asked = written(shards.mapInArrow(lambda it: asked_of(it, every), _ASKED), "anchors")
    empty = "cast(null as array<struct<other: bigint, id: bigint, score: bigint>>)"
    own = written(searched(index, asked.withColumn("windows", F.expr(empty)), positives, None), "positives")
    windows = own.groupBy("uid").agg(F.collect_list(F.struct(F.col("found").alias("other"), F.col("found_id").alias("id"), "score")).alias("windows"))  # at most ``positives`` rows each
    found = searched(index, asked.join(windows, "uid").select(*asked.columns, "windows"), negatives, (low, high))
    return found.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def centroids(rows: DataFrame, scale: int) -> DataFrame:
    """(dims, centroids) fitted to the rows of smallest hash of each length, at most SAMPLE rows and SAMPLE_BYTES of them."""

    def fit(group: pa.Table) -> pa.Table:
        d = group.column("dims")[0].as_py()
        with np.errstate(over="ignore"):
            v = np.floor(np.array(group.column("v").to_pylist(), np.float64) * float(scale))
        v = v[np.isfinite(v).all(axis=1)]
        v = v if len(v) else np.zeros((1, d))
        return pa.table({"dims": [d], "centroids": pa.array([fitted(v[np.lexsort(v.T[::-1])]).tobytes()], pa.binary())})

    sized = rows.select(F.size("v").cast("bigint").alias("dims"), "v", F.xxhash64("vec_id", "v").alias("h"))
    rank = F.row_number().over(Window.partitionBy("dims").orderBy("h"))
    sample = sized.withColumn("rank", rank).filter((F.col("rank") <= SAMPLE) & ((F.col("rank") == 1) | (F.col("rank") * F.col("dims") * 8 <= SAMPLE_BYTES)))
    return sample.select("dims", "v").groupBy("dims").applyInArrow(fit, "dims bigint, centroids binary")


#: The same rows by scoring every pair; labels are changed where vec_id is divisible by 7, as the query does.
MINE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, o.r AS o, o.vec_id AS other_id, a.label = o.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, o.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v o ON a.r <> o.r AND len(a.v) = len(o.v)
  WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.o ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
         s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM n WHERE rank <= 5
"""
