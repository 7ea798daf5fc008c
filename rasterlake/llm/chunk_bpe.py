"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last ``SPAN`` bytes cuts each text into chunks where the
hash has ``CUT_BITS`` zero bits, so equal passages are cut alike wherever they
stand.  Of a run of texts every distinct chunk is encoded once; chunks of earlier
runs are found again in the worker's chunk store, which is bounded by bytes and
keeps two generations.  A chunk's encoding is the ids of the units (runs between
spaces) inside it, with its first and last unit left open.

A cut can fall inside a unit, so joins are repaired: the open ends on both sides
of a cut are joined and re-encoded together with whole units on either side, and the
result is compared with the ids that the two chunks hold for those units.  From
the outside inwards, units must agree with what the chunks hold, ``apart`` of them
on either side; what lies between is taken from the re-encoding and replaces what
the chunks hold there.  If fewer agree, the window grows and is encoded again, and
past the ends of the chunks the whole text is encoded.  ``apart`` is one more than
the spaces in the longest added token, so a token over a cut cannot be missed.

Decoding maps ids to their pieces and joins them with one space, as the library
does for a tokenizer file without a decoder; a file with one is given to the
library.

Texts never leave their task: sharing chunks between workers would shuffle the
whole corpus once to save the repeated part of it (see the README).

Edge cases.  Null and empty texts: no ids, empty text.  Very long texts: many
chunks.  Repeated rows: encoded once, reported each.  Null doc_ids: kept as null.
Ties do not occur.  No rows: none.  Other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_strings, buffers, id_and_text, slices, trimmed
from .wordbpe import UnitEncoder, encoder

SPAN, CUT_BITS, LEAST_CHUNK = 16, 9, 64
#: Joins kept by their window.
MEMO_JOINS = 50_000
STORE_BYTES, SLICE_BYTES = 24_000_000, 2_000_000
_MULTIPLIER = 0x9E3779B97F4A7C15


def cut_points(raw: np.ndarray) -> np.ndarray:
    """Places before which the text is cut: the hash of the SPAN bytes before has CUT_BITS zero bits, and a character starts there."""
    h, m = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), _MULTIPLIER
    width = 1
    while width < SPAN:  # doubling: the hash of 2w bytes from two hashes of w bytes
        up = h.copy()
        up[width:] += h[:-width] * np.uint64(m)
        h, m, width = up, m * m & 0xFFFFFFFFFFFFFFFF, 2 * width
    at = np.flatnonzero((h[SPAN - 1 : -1] >> np.uint64(64 - CUT_BITS)) == 0) + SPAN
    return at[(raw[at] & 0xC0) != 0x80]


def chunk_edges(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of texts and the cuts in them, without cuts less than LEAST_CHUNK bytes behind the last one."""
    cuts = cut_points(raw) if len(raw) > SPAN else np.zeros(0, np.int64)
    begins = offsets[np.searchsorted(offsets, cuts, "right") - 1] if len(cuts) else cuts
    kept, last, text = [], 0, -1
    for c, start in zip(cuts.tolist(), begins.tolist()):
        if start != text:
            last, text = start, start
        if c - last >= LEAST_CHUNK:
            kept.append(c)
            last = c
    return np.union1d(offsets, np.array(kept, np.int64)).astype(np.int64)


class ChunkStore:
    """Chunk text -> (head, ids between, tail); bounded, two generations."""

    def __init__(self, most: int = STORE_BYTES):
        self.most, self.size, self.new, self.old = most, 0, {}, {}

    def get(self, chunk: str):
        found = self.new.get(chunk)
        return found if found is not None else self.old.get(chunk)

    def put(self, chunk: str, value: tuple) -> None:
        self.size += 8 * len(chunk)
        if self.size > self.most:
            self.old, self.new, self.size = self.new, {}, 8 * len(chunk)
        self.new[chunk] = value


class ChunkEncoder:
    def __init__(self, path: str):
        self.units: UnitEncoder = encoder(path)
        if not self.units.words:
            raise ValueError("chunk reuse is for vocabularies that drop white space")
        self.store = ChunkStore()
        self.repairs = self.widened = self.wholes = self.reused = self.encoded = 0
        self.spaced = [m for m in self.units.special_marks if " " in m]
        self.apart = 1 + max((m.count(" ") for m in self.units.special_marks), default=0)
        self._joins: dict[tuple, tuple | None] = {}
        with open(path) as f:
            spec = json.load(f)
        self.plain_decoder = spec.get("decoder") is None
        pieces = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = [b""] * (max(pieces.values()) + 1)
        for token, i in pieces.items():
            self.pieces[i] = token.encode()
        self.joined = [b" " + p for p in self.pieces]

    # -- encoding ----------------------------------------------------------

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray] = []
        for _, part in slices(texts, SLICE_BYTES):
            out += self._encode_slice(part)
        return out

    def _encode_slice(self, texts: pa.Array) -> list[np.ndarray]:
        raw, offsets = buffers(texts)
        edges = chunk_edges(raw, offsets)
        coded = as_strings(raw, edges).dictionary_encode()
        codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        found = [self.store.get(n) for n in names]
        missing = [i for i, f in enumerate(found) if f is None]
        self.reused += len(codes) - len(missing)
        self.encoded += len(missing)
        for i, value in zip(missing, self._new_chunks([names[i] for i in missing])):
            found[i] = value
            self.store.put(names[i], value)
        firsts = np.searchsorted(edges, offsets)
        return [self._text(texts, d, [found[c] for c in codes[a:b]], [names[c] for c in codes[a:b]]) for d, (a, b) in enumerate(zip(firsts[:-1], firsts[1:]))]

    def _new_chunks(self, chunks: list[str]) -> list[tuple[str, np.ndarray | None, str]]:
        """(head, ids between, tail); a chunk without a space is all head and has no between."""
        split, middle = [], []
        for c in chunks:
            a = c.find(" ")
            if a < 0:
                split.append((c, ""))
                middle.append("")
            else:
                b = c.rfind(" ")
                split.append((c[:a], c[b + 1 :]))
                middle.append(c[a + 1 : b] if b > a else "")
        ids, ends = self.units.encode(pa.array(middle, pa.large_string()))
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        parts = [ids[x:y] for x, y in zip(begins, ends)]
        for i, m in enumerate(middle):
            if self.spaced and any(t in m for t in self.spaced):  # a token over spaces: not a matter of units
                parts[i] = np.frombuffer(self.units.encode_unit(m), "<u4")
        return [(h, x if " " in c else None, t) for c, (h, t), x in zip(chunks, split, parts)]

    def _text(self, texts: pa.Array, d: int, parts: list[tuple], names: list[str]) -> np.ndarray:
        """Ids of a text from its chunks, joins repaired."""
        out: list[np.ndarray] = []
        open_end, before = "", None  # text since the last space, the chunk that it began in
        for name, (head, between, tail) in zip(names, parts):
            if between is None:
                open_end += head
                continue
            if not self._join(out, open_end, head, before, (name, between)):
                return self._whole(texts[d].as_py())
            open_end, before = tail, (name, between)
        if not self._join(out, open_end, "", before, None):
            return self._whole(texts[d].as_py())
        return np.concatenate(out)

    def _whole(self, text: str) -> np.ndarray:
        self.wholes += 1
        return np.frombuffer(self.units.encode_unit(text), "<u4")

    def _unit(self, u: str) -> bytes:
        got = self.units._memo.get(u)
        return self.units._unit(u, "") if got is None else got

    def _join(self, out: list[np.ndarray], a: str, b: str, left: tuple | None, right: tuple | None) -> bool:
        """Add the ids across a cut and those of the right chunk to ``out``, whose last are the left chunk's; False if no window agrees."""
        if not b and right is None and not (a and self.spaced):  # the end of the text
            out.append(np.frombuffer(self._unit(a), "<u4") if a else np.zeros(0, np.uint32))
            return True
        if left is None and not self.spaced:  # the first unit: nothing before it
            out += [np.frombuffer(self._unit(a + b), "<u4") if a or b else np.zeros(0, np.uint32), right[1]]
            return True
        self.repairs += 1
        lunits = left[0].split(" ")[1:-1] if left else []
        runits = right[0].split(" ")[1:-1] if right else []
        reach = self.apart
        while True:
            x, y = lunits[max(0, len(lunits) - reach) :], runits[:reach]
            got = self._window(tuple(x), a + b, tuple(y), out[-1] if left else None, right[1] if right else None)
            if got is not None:
                ids, less_left, less_right = got
                if less_left:
                    out[-1] = out[-1][: len(out[-1]) - less_left]
                out.append(ids)
                if right:
                    out.append(right[1][less_right:])
                return True
            if reach >= max(len(lunits), len(runits)):
                return False
            self.widened += 1
            reach *= 2

    def _window(self, x: tuple, unit: str, y: tuple, held_left: np.ndarray | None, held_right: np.ndarray | None) -> tuple | None:
        """(ids, ids less of the left chunk, of the right) if enough outer units of a window agree with the ids that the chunks hold."""
        key = (x, unit, y)
        z = self._joins.get(key)
        if z is None:
            z = np.frombuffer(self.units.encode_unit(" ".join([*x, unit, *y])), "<u4")
            if len(self._joins) >= MEMO_JOINS:
                self._joins.clear()
            self._joins[key] = z
        lx, ly = [len(self._unit(u)) // 4 for u in x], [len(self._unit(u)) // 4 for u in y]
        nx, ny = sum(lx), sum(ly)
        if (held_left is not None and nx > len(held_left)) or (held_right is not None and ny > len(held_right)):
            return None
        p = self._agreed(z, held_left[len(held_left) - nx :] if held_left is not None else z[:0], lx)
        s = self._agreed(z[::-1], held_right[:ny][::-1] if held_right is not None else z[:0], ly[::-1])
        if (held_left is not None and p[0] < self.apart) or (held_right is not None and s[0] < self.apart) or p[1] + s[1] > len(z):
            return None
        return z[p[1] : len(z) - s[1]], nx - p[1], ny - s[1]

    @staticmethod
    def _agreed(z: np.ndarray, held: np.ndarray, sizes: list[int]) -> tuple[int, int]:
        """(units, ids) from the outside that are the same in both."""
        n = min(len(z), len(held))
        differ = np.flatnonzero(z[:n] != held[:n])
        same, units, ids = int(differ[0]) if len(differ) else n, 0, 0
        for size in sizes:
            if ids + size > same:
                break
            units, ids = units + 1, ids + size
        return units, ids

    # -- decoding ----------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """The library's decode(ids, skip_special_tokens=False), as UTF-8."""
        if not self.plain_decoder:
            return self.units.library.decode(ids.tolist(), skip_special_tokens=False).encode()
        if not len(ids):
            return b""
        pieces = self.joined
        return b"".join([pieces[i] for i in ids.tolist()])[1:]


_CODERS: dict[str, ChunkEncoder] = {}


def coder(path: str) -> ChunkEncoder:
    if path not in _CODERS:
        _CODERS[path] = ChunkEncoder(path)
    return _CODERS[path]


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    @trimmed
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer)
        names = [str(i) for i in range(len(c.pieces))]
        for batch in batches:
            ids = c.encode(batch.column("text"))
            sha = [hashlib.sha256(" ".join([names[i] for i in x.tolist()]).encode()).hexdigest() for x in ids]
            back = [hashlib.sha256(c.decode(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(sha), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(coded, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
