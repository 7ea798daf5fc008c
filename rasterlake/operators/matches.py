"""Longest matches inside frames: for each place, where the pixels that follow stood before.

Candidates are the ``chain`` last places with the same pixel, so a pixel that is
everywhere costs no more than any other.  How far two places agree is read from ranks:
rank j of a place numbers the run of 2^j pixels that begins there, equal runs alike,
each from pairs of the ranks before it.  Walking the ranks down from the longest gives
the common length of any two places in twelve steps, for all places at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST, CHAIN = 4, 4095, 64


def run_ranks(pixels: np.ndarray, most: int) -> list[np.ndarray]:
    """rank[j][i] numbers pixels[i : i + 2^j]; runs over the end have numbers of their own."""
    n = len(pixels)
    ranks = [np.unique(pixels, return_inverse=True)[1].astype(np.int64)]
    span = 1
    while 2 * span <= min(most, n):
        last = ranks[-1]
        pair = last[: n - span] * (n + 1) + last[span:]
        rank = np.empty(n, np.int64)
        rank[: n - span] = np.unique(pair, return_inverse=True)[1]
        rank[n - 2 * span + 1 :] = n + np.arange(2 * span - 1)  # shorter than 2 * span: equal to nothing
        ranks.append(rank)
        span *= 2
    return ranks


def longest(pixels: np.ndarray, least: int = LEAST, most: int = MOST, chain: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """(length, distance) for each place, 0 and 0 where nothing of ``least`` pixels stood before; of equals the nearest."""
    n = len(pixels)
    length, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return length, distance
    ranks = run_ranks(pixels, most)
    order = np.lexsort((np.arange(n), ranks[0]))
    nth = np.empty(n, np.int64)  # how many places with the same pixel come before
    new = np.concatenate([[True], ranks[0][order][1:] != ranks[0][order][:-1]])
    starts = np.flatnonzero(new)
    nth[order] = np.arange(n) - np.repeat(starts, np.diff(np.concatenate([starts, [n]])))
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    for k in range(1, min(chain, int(nth.max(initial=0))) + 1):
        at = np.flatnonzero(nth >= k)
        at = at[np.minimum(most, n - at) > length[at]]  # a longer match is possible
        before = order[where[at] - k]
        common = np.zeros(len(at), np.int64)
        for j in range(len(ranks) - 1, -1, -1):
            i = at + common
            inside = np.flatnonzero(i < n)
            same = inside[ranks[j][i[inside]] == ranks[j][before[inside] + common[inside]]]
            common[same] += 1 << j
        common = np.minimum(common, most)
        better = common > length[at]
        length[at[better]], distance[at[better]] = common[better], (at - before)[better]
    none = length < least
    length[none], distance[none] = 0, 0
    return length, distance


def longest_matches(frames: DataFrame, least: int = LEAST, most: int = MOST, chain: int = CHAIN) -> DataFrame:
    """(picture_id, place, length, distance) for each pixel of frames (picture_id, argb), in row-major order.

    A frame is one task's work, as matches reach back over all of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                pixels = batch.column("argb")[i].values
                if pixels is None:
                    continue
                size, back = longest(pixels.to_numpy(zero_copy_only=False), least, most, chain)
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("picture_id")[i], len(size)), pa.array(np.arange(len(size), dtype=np.int32)), pa.array(size.astype(np.int32)), pa.array(back.astype(np.int32))], names=["picture_id", "place", "length", "distance"])

    return frames.select("picture_id", "argb").mapInArrow(run, "picture_id bigint, place int, length int, distance int")


def tokens(matches: DataFrame) -> DataFrame:
    """The greedy walk over matches: (picture_id, place, length, distance) of the places where a literal (length 1, distance 0) or a match begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out, i = [], 0
                cells = sorted((c["place"], c["length"], c["distance"]) for c in r["cells"])
                while i < len(cells):
                    place, length, distance = cells[i]
                    out.append((place, max(1, length), distance))
                    i += max(1, length)
                yield pa.RecordBatch.from_arrays([pa.array([r["picture_id"]] * len(out), pa.int64()), *(pa.array(c, pa.int32()) for c in zip(*out))], names=["picture_id", "place", "length", "distance"])

    rows = matches.groupBy("picture_id").agg(F.collect_list(F.struct("place", "length", "distance")).alias("cells"))
    return rows.mapInArrow(run, "picture_id bigint, place int, length int, distance int")
