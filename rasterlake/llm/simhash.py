"""SimHash near-duplicates: BK-trees over shards of fingerprints, then connected components.

A text's fingerprint comes from XXH64 hashes of its word shingles.  A shard's
fingerprints form a BK-tree: every fingerprint is a node, and a node's children are
keyed by their integer Hamming distance to it.  A search starts at the root and
follows only edges whose key lies within the radius of its own distance.  Trees are
flat arrays, and all searches of a shard go down together, a level at a time.

Two link rules share the trees:

``near_duplicates``: fingerprints of at most ``radius`` differing bits are linked.
    The 64 bits are cut into ``radius + m`` blocks, of which such a pair agrees in m
    at least, so each choice of m blocks gives one shard key.  Key width follows from
    the number of distinct fingerprints: a shard holds about ``SHARD`` of them.
``similar_documents``: texts whose sets of shingles have a Jaccard similarity of 0.8
    or more are linked.  Shards are bands of minimum hashes (``shingles``), the radius
    is ``WIDE``, and what the trees find is decided by the sets themselves.  The first
    round takes ``FIRST`` bands; the second takes the others, and only pairs that the
    first left in different components.

A shard with too many members for one tree is dealt to cells of two parts each, a
tree of one part searched by the other, so no task holds more than two parts.  Trees
are not broadcast: together they hold every document's fingerprint, which must not
pass through the driver (figures in the README); each is built in the task that holds
its cell.  A task reports a spanning set of links, never all pairs.  Components come
from one task while the links, which are counted, are few, and beyond that from
hooking and pointer jumping, each step a table in the shared folder; only counts
reach the driver.

Edge cases.  Null and empty texts, and texts of white space: fingerprint zero and the
empty set, linked like any other.  Fewer words than a shingle: the whole sequence is
one shingle.  Repeated rows and equal doc_ids: each row is reported.  Null doc_ids:
reported, never a component_id unless the component has no other.  Very long texts
are hashed whole.  Ties do not occur: links have no order.  No rows: none.  Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import gathered, id_and_text, trimmed, written
from .shingles import majority, shingle_hashes

BITS = 64
#: Members of a shard that are aimed at, and members or shingles of one part of a cell at most (or one text).
SHARD, PART_ROWS, PART_SHINGLES = 512, 4096, 2_000_000
#: Links held before they are reduced to a spanning set; shingle hashes turned into bits at once; (query, node) pairs of one level.
HELD_LINKS, HASHES, FRONTIER = 1_000_000, 50_000, 1_000_000
#: Differing bits within which a pair at similarity 0.8 lies: missed with probability 1e-5 for sets of five, below 1e-6 for larger ones.
WIDE = 26
FIRST = 4
#: Rows up to which a list of large shards or wanted texts is broadcast (16 bytes a row); beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Links that one task joins (16 bytes each).
ONE_TASK_LINKS = 1_000_000


def fingerprint(text: bytes, width: int = 3) -> int:
    """64 bits: a bit is 1 if set in over half of the shingles' hashes."""
    hashes = np.array(shingle_hashes(text, width), np.uint64)
    return int(majority(hashes, np.array([len(hashes)]))[0])


@trimmed
def fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes: list[int] = []
        sizes: list[int] = []
        parts = []
        for text in batch.column("text"):
            own = shingle_hashes(text.as_buffer().to_pybytes(), width)
            hashes += own
            sizes.append(len(own))
            if len(hashes) > HASHES:
                parts.append(majority(np.array(hashes, np.uint64), np.array(sizes)))
                hashes, sizes = [], []
        parts.append(majority(np.array(hashes, np.uint64), np.array(sizes, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), pa.array(np.concatenate(parts).view(np.int64))], names=["doc_id", "row_hash", "fp"])


# -- trees ----------------------------------------------------------------------


class BKTree:
    """Every value is a node; edges are sorted by (parent, Hamming distance of the child to it)."""

    def __init__(self, values: np.ndarray):
        """values: distinct; the first is the root, and of the values below an edge the first is the child."""
        self.values, self.visited, self.depth = values, 0, 0
        parents, keys, children = [], [], []
        rest, above = np.arange(1, len(values)), np.zeros(max(0, len(values) - 1), np.int64)
        while len(rest):  # one level: `above` is the deepest node so far on the way to each value
            far = np.bitwise_count(values[rest] ^ values[above]).astype(np.int64)
            edge = above * (BITS + 1) + far
            order = np.argsort(edge, kind="stable")
            first = np.concatenate([[True], edge[order][1:] != edge[order][:-1]])
            child = rest[order][first]
            parents.append(above[order][first])
            keys.append(far[order][first])
            children.append(child)
            below = child[np.cumsum(first) - 1]
            rest, above = rest[order][~first], below[~first]
            self.depth += 1
        none = np.zeros(0, np.int64)
        edges = np.concatenate([none, *parents]) * (BITS + 1) + np.concatenate([none, *keys])
        order = np.argsort(edges, kind="stable")
        self.edges, self.children = edges[order], np.concatenate([none, *children])[order]

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place of query, place of value, distance) within the radius, in parts."""
        step = max(1, FRONTIER // max(1, len(self.values)))
        for start in range(0, len(queries) if len(self.values) else 0, step):
            q = np.arange(start, min(start + step, len(queries)))
            node = np.zeros(len(q), np.int64)
            while len(q):
                self.visited += len(q)
                far = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                hit = far <= radius
                if hit.any():
                    yield q[hit], node[hit], far[hit]
                low = np.searchsorted(self.edges, node * (BITS + 1) + np.maximum(far - radius, 0))
                n = np.searchsorted(self.edges, node * (BITS + 1) + np.minimum(far + radius, BITS), "right") - low
                at = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
                q, node = np.repeat(q, n), self.children[at]


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest place that links reach."""
    low = np.arange(n)
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            return low
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]


# -- cells ----------------------------------------------------------------------


def bounded_join(left: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join with a written table, which is broadcast up to BROADCAST_ROWS rows and shuffled beyond."""
    return left.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, key, how)


def in_cells(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows with ``shard`` and ``key`` dealt by cell: cell, side (0: in the tree, 1: asks it, 2: both), and their other columns.

    sizes: shard, n, weight.  A shard of one part is one cell; of p parts, every two
    parts and every part with itself are one.
    """
    parts = F.greatest(F.ceil(F.col("n") / PART_ROWS), F.ceil(F.col("weight") / PART_SHINGLES), F.lit(1)).cast("int")
    large = gathered(sizes.select("shard", parts.alias("parts")).filter("parts > 1"), "large")
    marked = bounded_join(rows, large, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts")).cast("int")
    dealt = marked.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return dealt.withColumn("cell", cell).withColumn("side", side.cast("int")).drop("own", "other", "parts")


def by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition("cell").sortWithinPartitions("cell")


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one cell after the other; rows come sorted by cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cell = batch.column("cell").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])).tolist()
        for a, b in zip(cut, [*cut[1:], len(batch)]):
            if held and held[-1].column("cell")[0].as_py() != cell[a]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def found_in(cell: pa.RecordBatch, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, place) of rows of a cell whose fingerprints are within the radius; each pair at least once."""
    fp, side = cell.column("fp").to_numpy().view(np.uint64), cell.column("side").to_numpy()
    inside, asks = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    values, group = np.unique(fp[inside], return_inverse=True)
    values_order = np.argsort(group, kind="stable")
    begin = np.searchsorted(group[values_order], np.arange(len(values) + 1))
    for q, v, _ in BKTree(values).search(fp[asks], radius):
        n = begin[v + 1] - begin[v]
        at = np.arange(int(n.sum())) + np.repeat(begin[v] - (np.cumsum(n) - n), n)
        a, b = asks[np.repeat(q, n)], inside[values_order[at]]
        m = (a < b) if len(inside) == len(fp) else a != b
        yield a[m], b[m]


@trimmed
def link_cells(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(u, v): each fingerprint of a cell with the smallest of its part of the cell."""
    for cell in cells(batches):
        fp, low = cell.column("fp").to_numpy(), np.arange(len(cell))
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for x, y in found_in(cell, radius) if len(cell) > 1 else ():
            a.append(x)
            b.append(y)
            if sum(map(len, a)) > HELD_LINKS:
                low, a, b = spanning(len(low), np.concatenate([*a, np.arange(len(low))]), np.concatenate([*b, low])), [], []
        if a:
            low = spanning(len(low), np.concatenate([*a, np.arange(len(low))]), np.concatenate([*b, low]))
        m = low != np.arange(len(low))
        if m.any():
            yield pa.RecordBatch.from_arrays([pa.array(fp[m]), pa.array(fp[low[m]])], names=["u", "v"])


# -- components -------------------------------------------------------------------


@trimmed
def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, p): every end of the links of one task with the smallest end that they reach."""
    parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not any(len(u) for u, _ in parts):
        return
    u, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    ends, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    low = spanning(len(ends), at[: len(u)], at[len(u) :])
    yield pa.RecordBatch.from_arrays([pa.array(ends), pa.array(ends[low])], names=["u", "p"])


def components(links: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(u, p): for every end of a link (u, v) the smallest end that links reach.

    Up to ``one_task`` links, which are counted, one task joins them; beyond, rounds of
    hooking and pointer jumping do.
    """
    links = gathered(links, "links")
    if links.count() <= one_task:
        return written(links.coalesce(1).mapInArrow(united, "u bigint, p bigint"), "low")
    ends = links.select("u", F.col("v").alias("o")).unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("o")))
    low = gathered(ends.groupBy("u").agg(F.min("o").alias("o")).select("u", F.least("u", "o").alias("p")), "low")
    while True:
        at_u = low.select("u", F.col("p").alias("pu"))
        at_v = low.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        apart = links.join(at_u, "u").join(at_v, "v").filter("pu <> pv")
        hook = gathered(apart.groupBy(F.greatest("pu", "pv").alias("u")).agg(F.min(F.least("pu", "pv")).alias("h")), "hook")
        if hook.isEmpty():
            return low
        low = gathered(low.join(hook, "u", "left").select("u", F.least("p", F.coalesce("h", "p")).alias("p")), "low")
        for _ in range(2):
            to = low.select(F.col("u").alias("p"), F.col("p").alias("q"))
            low = gathered(low.join(to, "p", "left").select("u", F.coalesce("q", "p").alias("p")), "low")


def shard_keys(count: int, radius: int) -> list[Column]:
    """One key for each choice of m of ``radius + m`` blocks of the column ``fp``; as wide as count asks."""
    wanted = max(0, (max(1, count) // SHARD).bit_length())
    m = 1
    while m < 4 and m * (BITS // (radius + m)) < wanted:
        m += 1
    blocks = radius + m
    edges = [BITS * j // blocks for j in range(blocks + 1)]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), m)):
        key, left = F.lit(0).cast("bigint"), wanted
        for j, i in enumerate(chosen):  # an even share of the wanted bits from each block
            take = min(edges[i + 1] - edges[i], -(-left // (m - j)))
            key = F.shiftleft(key, take).bitwiseOR(F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << take) - 1)))
            left -= take
        keys.append(F.xxhash64(F.lit(k), key))
    return keys


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    source = id_and_text(docs).select("doc_id", F.lit(0).cast("bigint").alias("row_hash"), F.col("text").cast("binary").alias("text"))
    table = written(source.mapInArrow(lambda it: fingerprints(it, width), "doc_id bigint, row_hash bigint, fp bigint"), "fingerprints")
    distinct = gathered(table.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    rows = distinct.select(F.col("fp").alias("key"), "fp", F.explode(F.array(*shard_keys(distinct.count(), radius))).alias("shard"))
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).withColumn("weight", F.lit(0))
    links = by_cell(in_cells(rows, sizes).select("cell", "side", "fp")).mapInArrow(lambda it: link_cells(it, radius), "u bigint, v bigint")
    low = components(links)
    rooted = distinct.join(low.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "rep", F.coalesce("p", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return table.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- the shingle rule -----------------------------------------------------------------


@trimmed
def undecided(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """The rows of cells that a pair of different roots within the radius needs."""
    for cell in cells(batches):
        root, needed = cell.column("root").to_numpy(), np.zeros(len(cell), bool)
        if len(cell) > 1 and (root != root[0]).any():
            for a, b in found_in(cell, radius):
                apart = root[a] != root[b]
                needed[a[apart]] = True
                needed[b[apart]] = True
            yield cell.filter(pa.array(needed))


@trimmed
def similar_in_cells(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """(u, v) of a spanning set of the pairs whose sets are similar enough; rows: cell, side, sk, fp, root, hashes."""
    for cell in cells(batches):
        sk, root = cell.column("sk").to_numpy(), cell.column("root").to_numpy()
        sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in cell.column("hashes")]
        size = np.array([len(s) for s in sets])
        partners = np.zeros((len(cell), len(cell)), bool)
        for a, b in found_in(cell, radius):
            partners[a, b] = partners[b, a] = True
        low = np.unique(root, return_inverse=True)[1]
        us: list[int] = []
        vs: list[int] = []
        for i in range(len(cell)):
            near = np.flatnonzero(partners[i] & (low != low[i]))
            near = near[shingles.sizes_allow(size[near], size[i])]
            for k in range(0, len(near), 256):
                at = near[k : k + 256]
                at = at[low[at] != low[i]]
                like = at[shingles.similar_to(sets[i], [sets[j] for j in at])] if len(at) else at
                for j in like.tolist():
                    us.append(int(sk[i]))
                    vs.append(int(sk[j]))
                    low[low == low[j]] = low[i]
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def similar_documents(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row per document: doc_id, row_hash (xxhash64 of the text), root (a number of the component), component_id."""
    source = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("row_hash"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id bigint, row_hash bigint, sk bigint, n int, fp bigint, bands array<bigint>"
    same = [F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "fp", "bands"))]
    texts_of = source.mapInArrow(lambda it: shingles.signed_sets(it, width), schema)
    table = gathered(texts_of.groupBy("sk", "row_hash").agg(*same), "sets")
    same[0] = F.min("rep").alias("rep")
    distinct = gathered(table.groupBy("sk").agg(F.min("row_hash").alias("row_hash"), *same), "distinct")

    def linked(first: int, end: int, rooted: Callable[[DataFrame], DataFrame]) -> DataFrame:
        banded = distinct.select("sk", F.explode(F.slice("bands", first + 1, end - first)).alias("band"), F.col("n").alias("w"))
        # bands of the same sets are one shard
        groups = banded.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("sk")).alias("mark"), F.sum("w").alias("weight")).filter("n > 1")
        groups = groups.select("band", F.xxhash64("n", "mark").alias("shard"), "n", "weight")
        groups = gathered(groups, "groups")
        members = banded.join(groups.select("band", "shard"), "band").select("shard", "sk").distinct()
        rows = rooted(members.join(distinct.select("sk", "fp"), "sk")).withColumn("key", F.col("sk"))
        dealt = in_cells(rows, groups.drop("band").dropDuplicates(["shard"])).select("cell", "side", "sk", "fp", "root")
        needed = gathered(by_cell(dealt).mapInArrow(lambda it: undecided(it, WIDE), "cell bigint, side int, sk bigint, fp bigint, root bigint"), "undecided")
        wanted = needed.select("sk").distinct().join(distinct.select("sk", "row_hash"), "sk")
        texts = bounded_join(source.select("row_hash", "text"), gathered(wanted, "wanted"), "row_hash")
        own = gathered(texts.mapInArrow(lambda it: shingles.sets_of(it, width), "sk bigint, hashes binary").dropDuplicates(["sk"]), "shingles")
        return by_cell(needed.join(own, "sk").select("cell", "side", "sk", "fp", "root", "hashes")).mapInArrow(lambda it: similar_in_cells(it, WIDE), "u bigint, v bigint")

    low = components(linked(0, FIRST, lambda rows: rows.withColumn("root", F.col("sk"))))
    more = linked(FIRST, shingles.BANDS, lambda rows: rows.join(low.select(F.col("u").alias("sk"), "p"), "sk", "left").withColumn("root", F.coalesce("p", "sk")))
    low = components(more.unionByName(low.select("u", F.col("p").alias("v"))))
    named = distinct.join(low.select(F.col("u").alias("sk"), "p"), "sk", "left").select("sk", "rep", F.coalesce("p", "sk").alias("root"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.drop("rep").join(smallest, "root")
    by_text = table.select("row_hash", "sk").join(named, "sk")
    return source.select("doc_id", "row_hash").join(by_text, "row_hash").select("doc_id", "row_hash", "root", "component_id")
