"""Exact top-k by inner product: MaxScore over dimension postings, shards merged.

A vector's dimension is a term.  Within a shard a term's contribution to a query,
``q * x``, is at least ``q * low`` (or ``q * high`` for q < 0) and at most |q| times
the spread of its values above that: the term's score bound.  Terms are split, by
those bounds in rising order, into a non-essential prefix, whose bounds together
cannot lift a vector to the query's threshold, and the essential rest.  The
essential postings of a run of vectors are traversed; non-essential terms are
probed from the largest bound down, only for vectors that can still reach the
threshold with all bounds left.  The threshold is the k-th best score so far, and
the comparison is "not below", so ties are never lost.  Queries with few or no
non-essential terms are traversed together, as one matrix product.

Vectors are packed into shards of at most ``SHARD_BYTES`` once, in the shared
folder.  Queries go out in blocks of at most ``BLOCK_BYTES``, which travel with the
function: a shard is never shuffled, a task goes through its shards one at a time
and carries each query's best hits, and so its threshold, from shard to shard.
Before a block meets all shards it meets one, whose k-th best scores are the
thresholds that every task starts from.  Each (query, task) gives at most k rows; a
window by query row merges them.  Each block's hits are a table, so a lost executor
costs at most one block.

Edge cases.  A vector that is null or empty or holds a null or non-finite
component (before or after scaling) takes no part, as query or candidate; vectors
of different lengths do not meet.  Ties go to the smaller vec_id.  Fewer than k
candidates: all.  A query is a row: of rows with equal vec_ids each is a query of
its own and a candidate of the others.  Scores are exact integers at any size of
components; those outside the range of a long are held at its ends and then tie.
Null vec_ids take no part.  Very long vectors: a shard holds one at least.  No
rows: none.  Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, new_folder, trimmed, written

SHARD_BYTES, BLOCK_BYTES, STEP_ROWS, STEP_QUERIES = 4_000_000, 4_000_000, 4096, 512
#: Share of the terms that must be non-essential for them to be probed apart; with fewer a query is traversed whole.
APART = 0.25
#: Non-essential terms probed at once.
PROBED = 8
_COLUMNS = ("ids", "uids", "vectors")
_BLOB = "dims bigint, shard bigint, ids binary, uids binary, vectors binary"
_BLOB_ARROW = pa.schema([("dims", pa.int64()), ("shard", pa.int64()), *((n, pa.binary()) for n in _COLUMNS)])
_QUERY = "dims bigint, uid bigint, vec_id bigint, vector binary"
_HITS = "uid bigint, query_id bigint, vec_id bigint, score bigint"
_LONG = (-(1 << 63), (1 << 63) - 1)
#: Whole numbers up to this are exact as doubles, and so are their sums.
_EXACT = float(1 << 53)


@trimmed
def packed(batches: Iterator[pa.RecordBatch], scale: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows of (vec_id, v array<double>, part) as blobs of at most so many bytes of vectors of one length; uids number the rows."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    seen = shards = 0

    def blobs(d: int) -> Iterator[pa.RecordBatch]:
        nonlocal shards
        columns = [np.concatenate(c) for c in zip(*held.pop(d))]
        rows = max(1, size // (8 * d))
        for k in range(0, len(columns[0]), rows):
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([base + shards]), *(pa.array([c[k : k + rows].tobytes()], pa.binary()) for c in columns)], schema=_BLOB_ARROW)
            shards += 1

    base = 0
    for batch in batches:
        if not len(batch):
            continue
        base = batch.column("part")[0].as_py() << 40
        lists, ids = batch.column("v"), batch.column("vec_id").to_numpy()
        bounds = lists.offsets.to_numpy()
        with np.errstate(over="ignore"):
            flat = np.floor(lists.values.to_numpy() * float(scale))
        length, uids = np.diff(bounds), base + seen + np.arange(len(batch))
        seen += len(batch)
        for d in np.unique(length).tolist():
            at = np.flatnonzero(length == d)
            v = flat[bounds[at][:, None] + np.arange(d)[None, :]]
            whole = np.isfinite(v).all(axis=1)
            held.setdefault(d, []).append((ids[at[whole]], uids[at[whole]], v[whole]))
            if sum(p[2].nbytes for p in held[d]) >= size:
                yield from blobs(d)
    for d in list(held):
        yield from blobs(d)


@trimmed
def queries_of(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, uids, vectors = _arrays(row)
            m = ids % every == 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(m.sum()), row["dims"])), pa.array(uids[m]), pa.array(ids[m]), pa.array([v.tobytes() for v in vectors[m]], pa.binary())], names=["dims", "uid", "vec_id", "vector"])


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["uids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dims"])


class Block:
    """A block of queries with the best hits of each so far."""

    def __init__(self, vectors: np.ndarray, uids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.q, self.uids, self.k = vectors, uids, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in uids]  # (score, vec_id), best first
        self.need = np.full(len(uids), -np.inf) if floor is None else floor.copy()
        self.probed = self.left_out = 0

    def add(self, i: int, scores: list[int], ids: list[int]) -> None:
        self.best[i] = sorted([*self.best[i], *zip(scores, ids)], key=lambda x: (-x[0], x[1]))[: self.k]
        if len(self.best[i]) == self.k:
            self.need[i] = max(self.need[i], self.best[i][-1][0])

    def search(self, ids: np.ndarray, uids: np.ndarray, vectors: np.ndarray) -> None:
        """One shard."""
        if float((np.abs(self.q) @ np.abs(vectors).max(axis=0)).max(initial=0.0)) >= _EXACT:
            self._search_large(ids, uids, vectors)
            return
        lists = np.ascontiguousarray(vectors.T)
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        bounds = np.abs(self.q) * (high - low)
        order = np.argsort(bounds, axis=1, kind="stable")
        below = np.cumsum(np.take_along_axis(bounds, order, axis=1), axis=1)
        least = np.where(self.q > 0, self.q * low, self.q * high)
        base = least.sum(axis=1)
        for a in range(0, len(ids), STEP_ROWS):
            block = lists[:, a : a + STEP_ROWS]
            # bounds of order[:split] sum to less than what is needed above the base
            split = (below < (self.need - base)[:, None]).sum(axis=1)
            apart = split > APART * lists.shape[0]
            together = np.flatnonzero(~apart)
            for k in range(0, len(together), STEP_QUERIES):
                own = together[k : k + STEP_QUERIES]
                scores = self.q[own] @ block
                for j in np.flatnonzero(scores.max(axis=1) >= self.need[own]).tolist():
                    self._take(int(own[j]), scores[j], np.arange(block.shape[1]), ids[a:], uids[a:])
            for i in np.flatnonzero(apart).tolist():
                self._probe(i, int(split[i]), block, order[i], below[i], least[i], ids[a:], uids[a:])

    def _take(self, i: int, scores: np.ndarray, at: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        mine = (scores >= self.need[i]) & (uids[at] != self.uids[i])
        at, scores = at[mine], scores[mine]
        top = np.lexsort((ids[at], -scores))[: self.k]
        if len(top):
            self.add(i, [int(x) for x in scores[top]], ids[at[top]].tolist())

    def _probe(self, i: int, split: int, block: np.ndarray, order: np.ndarray, below: np.ndarray, least: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        essential, q = order[split:], self.q[i]
        part = q[essential] @ block[essential] + least[order[:split]].sum()
        live = np.arange(block.shape[1])
        for p in range(split, 0, -PROBED):  # the largest bounds first, a few terms at a time
            keep = part + below[p - 1] >= self.need[i]
            if np.count_nonzero(keep) < 0.8 * len(live):  # dropping rows costs a copy
                live, part = live[keep], part[keep]
            self.probed += len(live) * min(p, PROBED)
            if not len(live):
                break
            terms = order[max(0, p - PROBED) : p]
            part = part + (q[terms] @ (block[terms] if len(live) == block.shape[1] else block[terms[:, None], live]) - least[terms].sum())
        self.left_out += block.shape[1] - len(live)
        if len(live):
            self._take(i, part, live, ids, uids)

    def _search_large(self, ids: np.ndarray, uids: np.ndarray, vectors: np.ndarray) -> None:
        """Whole numbers of any size, a row at a time."""
        rows = [[int(x) for x in v] for v in vectors]
        for i, q in enumerate([int(x) for x in v] for v in self.q):
            for v, vec, uid in zip(rows, ids.tolist(), uids.tolist()):
                score = min(max(sum(x * y for x, y in zip(q, v)), _LONG[0]), _LONG[1])
                full = len(self.best[i]) == self.k  # self.need is a double, and rounds what is as large as this
                if uid != self.uids[i] and not (full and score < self.best[i][-1][0]):
                    self.add(i, [score], [vec])


def _searcher(vectors: np.ndarray, uids: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray | None):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(vectors, uids, k, floor)
        for batch in batches:
            for row in batch.to_pylist():
                block.search(*_arrays(row))
        out = [(int(uids[i]), int(query_ids[i]), vec, score) for i, best in enumerate(block.best) for score, vec in best]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["uid", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score of its k best other rows."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    x = F.col("embedding")
    whole = x.isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    rows = vectors.filter(whole).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda e: e.cast("double")).alias("v"), F.spark_partition_id().cast("bigint").alias("part")).filter(F.size("v") > 0)
    shards = written(rows.mapInArrow(lambda it: packed(it, scale, SHARD_BYTES), _BLOB), "shards")
    asked = written(shards.mapInArrow(lambda it: queries_of(it, every), _QUERY), "queries")
    folder = new_folder(spark, "hits")
    spark.createDataFrame([], _HITS).write.parquet(f"{folder}/block=-1")
    n = 0
    for kind in asked.groupBy("dims").agg(F.count("*").alias("n")).orderBy("dims").collect():  # one row a length
        d, blocks = kind["dims"], -(-kind["n"] * 8 * kind["dims"] // BLOCK_BYTES)
        own = shards.filter(F.col("dims") == d)
        for b in range(blocks):
            part = asked.filter((F.col("dims") == d) & (F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b)).toArrow()
            q = np.frombuffer(b"".join(part.column("vector").to_pylist()), np.float64).reshape(-1, d)
            if not len(q):
                continue
            uids, ids = part.column("uid").to_numpy(), part.column("vec_id").to_numpy()
            first = own.orderBy("shard").select("shard").first()["shard"]
            found = own.filter(F.col("shard") == first).mapInArrow(_searcher(q, uids, ids, k, None), _HITS)
            kth = {r["uid"]: r["s"] for r in found.groupBy("uid").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") == k).collect()}  # rows of one block
            floor = np.array([kth.get(u, -np.inf) for u in uids.tolist()], np.float64)
            floor = np.where(np.abs(floor) < _EXACT, floor, -np.inf)
            own.mapInArrow(_searcher(q, uids, ids, k, floor), _HITS).write.parquet(f"{folder}/block={n}")
            n += 1
    hits = spark.read.schema(_HITS).parquet(folder)
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id"))
    return hits.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


TOP_K_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r
  WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
