"""Sets of word shingles: hashes, fingerprints of sets, bands of minimum hashes, exact similarity.

A text is the set of XXH64 hashes of its word shingles.  Two sets are similar if
their Jaccard similarity is at least ``LEAST`` / ``MOST`` = 0.8, which is decided in
whole numbers.  ``BANDS`` bands of ``ROWS`` minima each: a pair at 0.8 shares no band
with probability 3e-6, above it with less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .common import trimmed

SEED = 42
LEAST, MOST = 4, 5
BANDS, ROWS = 32, 5
MINIMA = BANDS * ROWS
#: Hashes held before their minima are taken, texts whose sets are sent at once.
HASHES, SENT = 100_000, 200
_R = np.random.default_rng(5)
_XOR, _TIMES = _R.integers(0, 1 << 32, MINIMA, dtype=np.uint32), _R.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _R.integers(0, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: bytes, width: int) -> list[int]:
    found = text.lower().split()  # bytes: only A-Z change, and only space and \x09-\x0D split
    h = xxhash.xxh64_intdigest
    if len(found) <= width:
        return [h(b" ".join(found), SEED)] if found else []
    if width == 3:
        return [h(b"%b %b %b" % t, SEED) for t in zip(found, found[1:], found[2:])]
    return [h(b" ".join(t), SEED) for t in zip(*(found[i:] for i in range(width)))]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A fingerprint of each run of hashes: bits set in over half of them; zero for an empty run."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > sizes[full, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_set(text: bytes, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def minima(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(sets, MINIMA) least hash of each set, none empty, under each function."""
    starts = np.cumsum(sizes) - sizes
    low, out = (hashes >> np.uint64(32)).astype(np.uint32), np.empty((len(sizes), MINIMA), np.uint32)
    for k in range(MINIMA):
        out[:, k] = np.minimum.reduceat((low ^ _XOR[k]) * _TIMES[k], starts)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(_BAND[:, ROWS], (len(least), BANDS)).copy()
    for j in range(ROWS):
        h = (h ^ least[:, j::ROWS].astype(np.uint64)) * _BAND[:, j]
        h ^= h >> np.uint64(31)
    return h


@trimmed
def signed_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, row_hash, hash of the set, its size, its fingerprint, band keys; none for the empty set)."""
    for batch in batches:
        sets: list[np.ndarray] = []
        first = held = 0
        for i, text in enumerate(batch.column("text")):
            sets.append(shingle_set(text.as_buffer().to_pybytes(), width))
            held += len(sets[-1])
            if held > HASHES or i + 1 == len(batch):
                sizes = np.array([len(s) for s in sets])
                full, joined = np.flatnonzero(sizes), np.concatenate(sets)
                keys = band_keys(minima(joined, sizes[full])) if len(full) else np.zeros((0, BANDS), np.uint64)
                ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(n).slice(first, len(sets)) for n in ("doc_id", "row_hash")),
                        pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)),
                        pa.array(sizes.astype(np.int32)),
                        pa.array(_in_steps(joined, sizes).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64))),
                    ],
                    names=["doc_id", "row_hash", "sk", "n", "fp", "bands"],
                )
                sets, first, held = [], i + 1, 0


def _in_steps(hashes: np.ndarray, sizes: np.ndarray, most: int = 50_000) -> np.ndarray:
    """``majority`` of a few runs at a time: the bits of a hash take 64 bytes."""
    ends, out, i = np.cumsum(sizes), [], 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        out.append(majority(hashes[ends[i] - sizes[i] : ends[j - 1]], sizes[i:j]))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


@trimmed
def sets_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, len(batch), SENT):
            part = batch.slice(k, SENT)
            yield pa.RecordBatch.from_arrays([part.column("sk"), pa.array([shingle_set(t.as_buffer().to_pybytes(), width).tobytes() for t in part.column("text")], pa.binary())], names=["sk", "hashes"])


def sizes_allow(size: np.ndarray, other: int) -> np.ndarray:
    return MOST * np.minimum(size, other) >= LEAST * np.maximum(size, other)


def similar_to(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the others, sorted like own and not empty, are similar to it."""
    size = np.array([len(x) for x in others])
    joined = np.concatenate(others)
    shared = np.add.reduceat(own[np.minimum(np.searchsorted(own, joined), len(own) - 1)] == joined, np.cumsum(size) - size, dtype=np.int64)
    return MOST * shared >= LEAST * (size + len(own) - shared)
