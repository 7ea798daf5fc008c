"""Language-model scores: an add-one unigram base and a hashed maximum-entropy model.

Tokens are words (runs other than space and \\x09-\\x0D, A-Z lower-cased), then one
end per text.  All counts come from all training texts.

The model.  Words fall into ``CLASSES * MEMBERS`` buckets: the end and the most
frequent words have their own, the others share buckets by a hash of their last
two bytes.  P(word | history) = P(class | history) * P(bucket | class, history) *
P(word | bucket, previous word).  The first two are softmaxes over sums of weights
of hashed features: previous bucket, two skip features (buckets two and three
back), the hashed pair of the previous two, and for buckets within a class the
classes one and two back.  Classes come from halving the buckets along the main
direction of what they stand next to.  The third is a softmax too: the log of an
add-one unigram of the bucket's words, with one share for unseen words, plus a
weight for each pair of a hashed previous word and a frequent word.  Only pairs met
in training have weights, so its divisor needs only those of one previous word and
bucket, and is exact.

Training.  Texts are read twice: once for word counts, once to turn them into
bucket sequences, which are kept as a table.  Over that table run one pass for
bucket pairs, whose counts start the weights, and ``ROUNDS`` rounds of gradient
updates, each over another share of the training texts, all of them in the end:
every task makes minibatch updates over its rows, and the changes are averaged by
tokens, block by block, through a shuffle.  The driver holds one model (under
1 MB) and one table of bucket pairs (4 MB).

The weights of word pairs grow with the corpus and are never in one place.  The
tokens of shared buckets go to blocks by previous word and bucket, as hashes of 8
bytes, packed; there are more blocks with more training tokens.  A block has all
that its weights rest on: it fits them by gradient updates and sends back what its
tokens add, summed for each text.  The most frequent words have buckets of their own
and take no part, so a pair holds at most 1 in ``OWN`` of all tokens, words of over
``WORD_BYTES`` bytes excepted; previous words of any frequency are spread by bucket.

Word counts meet the texts in two ways: the ``FREQUENT`` most frequent words go to
the tasks (a bounded list), all others are joined by word.

Edge cases.  Null and empty texts: the end alone.  No training texts: N = V = 0,
the base score is 0 a token and the model is uniform.  Null doc_ids fall into
fold 0 and so are training texts.  Repeated rows each count and each get a row.
Very long texts are scored whole.  Ties: buckets with equal places along a direction
are halved by their numbers.  No rows: none.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, id_and_text, slices, trimmed, words, written

CLASSES, MEMBERS, PAIRS = 16, 64, 2048
BUCKETS = CLASSES * MEMBERS
#: Buckets of one word each, the end's included; the rest are shared.
OWN = 512
FREQUENT, ROUNDS, SLICE_BYTES, STEP_TOKENS = 50_000, 2, 2_000_000, 16_384
#: Longest word of the list of frequent words, which goes to the driver and the tasks.
WORD_BYTES = 64
START = BUCKETS  # stands before the first word
#: Training tokens a block of word pairs stands for, training texts a part of their sums; fewest of both; pseudo-tokens of the unigram in the fit; gradient updates.
BLOCK_TOKENS, PART_TEXTS, LEAST_BLOCKS, PRIOR, UPDATES = 2_000_000, 20_000, 16, 4.0, 16
#: Place of all words outside the list of frequent words, in a packed pair.
RARE = 65_535
_ROW = "doc_id bigint, uid bigint, text_key bigint, held_out boolean, n_tokens bigint, freq_log double, freq_known bigint, buckets binary, rare array<struct<word:string,tf:bigint>>"


# -- words and buckets --------------------------------------------------------


def _shared_bucket(names: pa.Array) -> np.ndarray:
    """Bucket by the last two bytes of a word."""
    offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    raw = np.frombuffer(names.buffers()[2], np.uint8) if names.buffers()[2] is not None else np.zeros(0, np.uint8)
    if not len(raw):
        return np.full(len(names), OWN)
    size = np.diff(offsets)
    a = np.where(size > 0, raw[np.maximum(offsets[1:] - 1, 0)], 0).astype(np.int64)
    b = np.where(size > 1, raw[np.maximum(offsets[1:] - 2, 0)], 0).astype(np.int64)
    return OWN + (a * 257 + b * 65_537) % 8191 % (BUCKETS - OWN)


class Vocabulary:
    """The frequent words with their counts, most frequent first; the first OWN - 1 have buckets 1 and up, the end bucket 0."""

    def __init__(self, names: list[str], counts: list[int], ends: int):
        self.names, self.counts, self.ends = pa.array(names, pa.large_string()), np.array([*counts, 0], np.int64), ends

    def look_up(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place in the list or -1, bucket) of each word."""
        at = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        return at, np.where((at >= 0) & (at < OWN - 1), at + 1, _shared_bucket(names))

    def own_counts(self) -> np.ndarray:
        """Counts of the words with their own buckets."""
        out = np.zeros(OWN, np.int64)
        out[0] = self.ends
        n = min(OWN - 1, len(self.names))
        out[1 : 1 + n] = self.counts[:n]
        return out


@trimmed
def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, count) of each run of texts; the end is the empty word."""
    for batch in batches:
        for _, part in slices(batch.column("text"), 2 * SLICE_BYTES):
            codes, ends, names = words(part)
            n = np.bincount(codes, minlength=len(names))
            full = np.flatnonzero(n)
            found = names.take(pa.array(full)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([found, pa.array([""], pa.string())]), pa.array(np.append(n[full], len(ends)))], names=["word", "c"])


@trimmed
def sequences(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """One row per text: bucket sequence, what its frequent words add, and its other words with their counts."""
    logs = np.log10(vocabulary.counts + 1.0)
    seen = 0
    for batch in batches:
        for first, part in slices(batch.column("text"), SLICE_BYTES):
            codes, ends, names = words(part)
            n = len(part)
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            at, bucket = vocabulary.look_up(names)
            at, doc = at[codes], np.repeat(np.arange(n), ends - begins)
            known = at >= 0
            freq_log = np.bincount(doc[known], weights=logs[at[known]], minlength=n) + np.log10(vocabulary.ends + 1.0)
            freq_known = np.bincount(doc[known], minlength=n) + int(vocabulary.ends > 0)
            order, tf = np.unique(doc[~known] * max(1, len(names)) + codes[~known], return_counts=True)
            rdoc, rcode = np.divmod(order, max(1, len(names)))
            rare = pa.StructArray.from_arrays([names.take(pa.array(rcode)).cast(pa.string()), pa.array(tf.astype(np.int64))], names=["word", "tf"])
            rends = np.concatenate([[0], np.cumsum(np.bincount(rdoc, minlength=n))]).astype(np.int32)
            seq = np.insert(bucket[codes], ends, 0).astype("<u2")
            bounds = (np.concatenate([[0], ends + np.arange(1, n + 1)]) * 2).astype(np.int64)
            blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(seq.tobytes())]).cast(pa.binary())
            part_id = batch.column("part")[0].as_py()
            rows = slice(first, first + n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(first, n), pa.array((part_id << 40) + seen + np.arange(n)), batch.column("text_key").slice(first, n), batch.column("held_out").slice(rows.start, n), pa.array((ends - begins + 1).astype(np.int64)), pa.array(freq_log), pa.array(freq_known.astype(np.int64)), blobs, pa.ListArray.from_arrays(pa.array(rends), rare)],
                names=["doc_id", "uid", "text_key", "held_out", "n_tokens", "freq_log", "freq_known", "buckets", "rare"],
            )
            seen += n


# -- weights of word pairs ----------------------------------------------------------


def word_hashes(names: pa.Array) -> np.ndarray:
    """39 bits of a polynomial hash of each word's bytes."""
    offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    size = np.diff(offsets)
    out = np.zeros(len(names), np.uint64)
    if size.sum():
        raw = np.frombuffer(names.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
        powers = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
        full = np.flatnonzero(size)
        place = np.arange(len(raw)) - np.repeat(offsets[:-1] - offsets[0], size)
        out[full] = np.add.reduceat((raw + np.uint64(1)) * powers[place], (offsets[:-1] - offsets[0])[full])
    out ^= out >> np.uint64(32)
    return (out * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(25)


@trimmed
def word_pairs(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, blocks: int) -> Iterator[pa.RecordBatch]:
    """Tokens of shared buckets by block: pairs (previous word 39 bits, bucket 9, place 16), tokens of each text, and the texts' keys."""
    for batch in batches:
        for first, part in slices(batch.column("text"), SLICE_BYTES):
            codes, ends, names = words(part)
            at, bucket = vocabulary.look_up(names)
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            before = np.zeros(len(codes), np.uint64)
            before[1:] = word_hashes(names)[codes[:-1]]
            before[begins[ends > begins]] = 0
            # the part of a pair that the word alone decides
            own = (np.maximum(bucket - OWN, 0).astype(np.uint64) << np.uint64(16)) | np.where(at < 0, RARE, at).astype(np.uint64)
            chosen = np.flatnonzero((bucket >= OWN)[codes])
            pairs = (before[chosen] << np.uint64(25)) | own[codes[chosen]]
            block = (((pairs >> np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(blocks)
            order = np.argsort(block.astype(np.min_scalar_type(blocks)), kind="stable")
            block, pairs = block[order].astype(np.int64), pairs[order]
            doc = np.repeat(np.arange(len(part)), ends - begins)[chosen][order]
            keys = batch.column("text_key").slice(first, len(part)).to_numpy()
            runs = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])])) if len(doc) else np.zeros(0, np.int64)
            sizes = np.diff(np.concatenate([runs, [len(doc)]])).astype("<u4")
            present, cuts = np.unique(block, return_index=True)
            cuts = np.append(cuts, len(block))
            at_run = np.searchsorted(runs, cuts)
            run_keys = keys[doc[runs]]
            packed = [(pairs[i:j].tobytes(), sizes[k:m].tobytes(), run_keys[k:m].tobytes()) for i, j, k, m in zip(cuts[:-1], cuts[1:], at_run[:-1], at_run[1:])]
            if packed:
                yield pa.RecordBatch.from_arrays([pa.array(present), *(pa.array(c, pa.binary()) for c in zip(*packed))], names=["block", "pairs", "sizes", "keys"])


def pair_gains(pairs: np.ndarray, training: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pair of each token, log10 of P(word | bucket, previous word) / P(word | bucket) of each distinct pair).

    ``shares`` is P(word | bucket) by place.  The weights maximise the likelihood of
    the training tokens and of ``PRIOR`` tokens of the unigram for each previous word
    and bucket.
    """
    distinct, of = np.unique(pairs, return_inverse=True)
    count = np.bincount(of, weights=training, minlength=len(distinct))
    group = np.cumsum(np.concatenate([[0], (distinct[1:] >> np.uint64(16)) != (distinct[:-1] >> np.uint64(16))])).astype(np.int64)
    place = (distinct & np.uint64(RARE)).astype(np.int64)
    met = np.flatnonzero((place != RARE) & (count > 0))
    groups = int(group[-1]) + 1 if len(group) else 0
    total = np.bincount(group, weights=count, minlength=groups) + PRIOR
    share, at = shares[place[met]], group[met]
    wanted = (count[met] + PRIOR * share) / total[at]
    weight = np.zeros(len(met))
    # what is left for the words without a weight, before and after
    others, wanted_others = (1 - np.bincount(at, weights=x, minlength=groups) for x in (share, wanted))
    for _ in range(UPDATES):
        raised = share * np.exp(weight)
        divisor = others + np.bincount(at, weights=raised, minlength=groups)
        p, rest = raised / divisor[at], others / divisor
        # the gradient times the inverse of the softmax's curvature, each part at most one either way
        weight += (wanted - p) / np.maximum(wanted, p) - ((wanted_others - rest) / np.maximum(wanted_others, rest))[at]
    divisor = 1 + np.bincount(at, weights=share * np.expm1(weight), minlength=groups)
    gain = -np.log10(divisor)[group]
    gain[met] += weight / np.log(10)
    return of, gain


def _fitted(shares: np.ndarray, parts: int):
    def run(table: pa.Table) -> pa.Table:
        """What the tokens of one block add to each text, packed by parts of the texts; copies of a text are one entry."""
        joined = {n: np.frombuffer(b"".join(table.column(n).to_pylist()), t) for n, t in (("pairs", np.uint64), ("sizes", np.uint32), ("keys", np.int64))}
        sizes, keys = joined["sizes"], joined["keys"]
        of, gain = pair_gains(joined["pairs"], np.repeat((keys & 1) == 0, sizes), shares)
        begins = np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64)
        texts, text, copies = np.unique(keys, return_inverse=True, return_counts=True)
        value = np.bincount(text, weights=np.add.reduceat(gain[of], begins), minlength=len(texts)) / copies
        part = ((texts.view(np.uint64) >> np.uint64(1)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        texts, value = texts[order], value[order].astype(np.float32)
        present, cuts = np.unique(part[order], return_index=True)
        spans = list(zip(cuts, np.append(cuts[1:], len(texts))))
        packed = [pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (texts, value)]
        return pa.table({"part": present, "keys": packed[0], "gains": packed[1]})

    return run


def added(table: pa.Table) -> pa.Table:
    """Sum over all blocks for each text of one part."""
    keys, gains = (np.frombuffer(b"".join(table.column(n).to_pylist()), t) for n, t in (("keys", np.int64), ("gains", np.float32)))
    texts, text = np.unique(keys, return_inverse=True)
    return pa.table({"text_key": texts, "gain": np.bincount(text, weights=gains, minlength=len(texts))})


# -- the model ------------------------------------------------------------------


class Context:
    """Bucket of each token of a run of texts and the buckets before it."""

    def __init__(self, column: pa.Array):
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2
        self.ends = np.cumsum(sizes)
        self.seq = np.frombuffer(b"".join(column.to_pylist()), "<u2").astype(np.int64)
        place = np.arange(len(self.seq)) - np.repeat(self.ends - sizes, sizes)
        self.back = []
        for k in (1, 2, 3):
            b = np.full(len(self.seq), START)
            b[k:] = np.where(place[k:] >= k, self.seq[:-k], START)
            self.back.append(b)
        self.pair = (self.back[0] * 1031 + self.back[1] * 7) % PAIRS


class Model:
    """Weights; ``of_class`` and ``member`` place a bucket, ``bucket`` is their inverse; START is of class CLASSES."""

    NAMES = ("c0", "c1", "c2", "c3", "cp", "m0", "m1", "m2")

    def __init__(self, of_class: np.ndarray, member: np.ndarray, weights: dict[str, np.ndarray]):
        self.of_class, self.member, self.w = of_class, member, weights

    @staticmethod
    def shapes() -> dict[str, tuple[int, ...]]:
        back, side = (BUCKETS + 1, CLASSES), (CLASSES + 1, CLASSES, MEMBERS)
        return {"c0": (CLASSES,), "c1": back, "c2": back, "c3": back, "cp": (PAIRS, CLASSES), "m0": (CLASSES, MEMBERS), "m1": side, "m2": side}

    @classmethod
    def start(cls, pairs: np.ndarray) -> Model:
        """Classes and first weights from counts of (bucket before, bucket)."""
        of_class, member = _classes(pairs)
        w = {k: np.zeros(s, np.float32) for k, s in cls.shapes().items()}
        total = pairs.sum()
        if total > 0:
            by_class = np.zeros((BUCKETS + 1, CLASSES))
            np.add.at(by_class.T, of_class[:BUCKETS], pairs.T)
            p = (by_class.sum(axis=0) + 1) / (total + CLASSES)
            lift = np.log((by_class + 20 * p) / (by_class.sum(axis=1, keepdims=True) + 20)) - np.log(p)
            w["c0"] = np.log(p)
            w["c1"], w["c2"], w["c3"] = 0.4 * lift, 0.3 * lift, 0.3 * lift
            side = np.zeros((CLASSES + 1, BUCKETS))
            np.add.at(side, of_class, pairs)
            placed = np.zeros((CLASSES + 1, CLASSES, MEMBERS))
            placed[:, of_class[:BUCKETS], member] = side
            m = placed.sum(axis=0) + 1
            m = m / m.sum(axis=1, keepdims=True)
            n = placed.sum(axis=2, keepdims=True)
            lift = np.log((placed + 200 * m) / (n + 200)) - np.log(m)
            w["m0"] = np.log(m)
            w["m1"], w["m2"] = 0.5 * lift, 0.3 * lift
        return cls(of_class, member, {k: v.astype(np.float32) for k, v in w.items()})

    def class_logits(self, x: Context, at: slice) -> np.ndarray:
        w = self.w
        return w["c0"] + w["c1"][x.back[0][at]] + w["c2"][x.back[1][at]] + w["c3"][x.back[2][at]] + w["cp"][x.pair[at]]

    def member_logits(self, c: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        w = self.w
        return (w["m0"][c] + w["m1"][:, c])[one] + w["m2"][:, c][two]

    def log_probability(self, x: Context) -> np.ndarray:
        """log10 P(bucket | history) of each token."""
        out = np.empty(len(x.seq))
        for k in range(0, len(x.seq), STEP_TOKENS):
            at = slice(k, k + STEP_TOKENS)
            z = self.class_logits(x, at)
            cls, mem = self.of_class[x.seq[at]], self.member[x.seq[at]]
            got = z[np.arange(len(z)), cls] - _log_sum(z)
            one, two = self.of_class[x.back[0][at]], self.of_class[x.back[1][at]]
            order = np.argsort(cls.astype(np.uint8), kind="stable")
            cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1))
            for c in range(CLASSES):
                own = order[cuts[c] : cuts[c + 1]]
                if len(own):
                    y = self.member_logits(c, one[own], two[own])
                    got[own] += y[np.arange(len(own)), mem[own]] - _log_sum(y)
            out[at] = got
        return out / np.log(10)

    def update(self, x: Context, rate: float = 0.5) -> None:
        """Minibatch gradient steps over all tokens; each feature's row moves by its mean gradient, damped for rare rows."""
        w = self.w
        for k in range(0, len(x.seq), STEP_TOKENS):
            at = slice(k, k + STEP_TOKENS)
            cls, mem = self.of_class[x.seq[at]], self.member[x.seq[at]]
            g = -_softmax(self.class_logits(x, at))
            g[np.arange(len(g)), cls] += 1
            w["c0"] += rate * g.mean(axis=0)
            for name, rows in zip(("c1", "c2", "c3", "cp"), (*x.back, x.pair)):
                _step(w[name], rows[at], g, rate / 4)
            one, two = self.of_class[x.back[0][at]], self.of_class[x.back[1][at]]
            order = np.argsort(cls.astype(np.uint8), kind="stable")
            cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1))
            for c in range(CLASSES):
                own = order[cuts[c] : cuts[c + 1]]
                if len(own):
                    h = -_softmax(self.member_logits(c, one[own], two[own]))
                    h[np.arange(len(own)), mem[own]] += 1
                    w["m0"][c] += rate * h.sum(axis=0) / (len(own) + 200)
                    for name, rows in (("m1", one[own]), ("m2", two[own])):
                        _step(w[name][:, c], rows, h, rate / 2)


def _log_sum(z: np.ndarray) -> np.ndarray:
    top = z.max(axis=1)
    return top + np.log(np.exp(z - top[:, None]).sum(axis=1))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _step(table: np.ndarray, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    sorted_rows = rows[order]
    at = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
    n = np.diff(np.concatenate([at, [len(rows)]]))
    table[sorted_rows[at]] += rate * np.add.reduceat(g[order], at, axis=0) / (n + 20)[:, None].astype(np.float32)


def _classes(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CLASSES equal parts of the buckets, by halving along the main direction of their neighbours' distribution."""
    before, after = pairs[:BUCKETS].T + 1e-3, pairs[:BUCKETS] + 1e-3
    profile = np.sqrt(np.concatenate([before / before.sum(axis=1, keepdims=True), after / after.sum(axis=1, keepdims=True)], axis=1))
    groups = [np.arange(BUCKETS)]
    while len(groups) < CLASSES:
        halves = []
        for g in groups:
            x = profile[g] - profile[g].mean(axis=0)
            v = np.ones(len(g)) + np.arange(len(g)) / len(g)
            gram = x @ x.T
            for _ in range(30):  # power iteration
                v = gram @ v
                v /= np.linalg.norm(v) + 1e-12
            order = np.lexsort((g, v))
            halves += [np.sort(g[order[: len(g) // 2]]), np.sort(g[order[len(g) // 2 :]])]
        groups = halves
    of_class, member = np.full(BUCKETS + 1, CLASSES), np.zeros(BUCKETS, np.int64)
    for c, g in enumerate(groups):
        of_class[g], member[g] = c, np.arange(len(g))
    return of_class, member


# -- passes over the table of sequences --------------------------------------------

_BLOCK = "block bigint, weight double, content binary"


@trimmed
def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BUCKETS + 1) * BUCKETS, np.float32)
    for batch in batches:
        x = Context(batch.column("buckets"))
        total += np.bincount(x.back[0] * BUCKETS + x.seq, minlength=len(total)).astype(np.float32)
    if total.any():
        rows = total.reshape(BUCKETS + 1, BUCKETS)
        yield _blocks([rows[k : k + 64].tobytes() for k in range(0, BUCKETS + 1, 64)], 1.0)


def _blocks(parts: list[bytes], weight: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int64()), pa.array([weight] * len(parts)), pa.array(parts, pa.binary())], names=["block", "weight", "content"])


def summed(key: tuple, table: pa.Table) -> pa.Table:
    """Weighted sum of the contents of one block, and the sum of weights."""
    total, weight = None, 0.0
    for w, x in zip(table.column("weight").to_pylist(), table.column("content")):
        v = np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) * w
        total, weight = (v if total is None else total + v), weight + w
    return pa.table({"block": [key[0].as_py()], "weight": [weight], "content": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _gathered(rows: DataFrame) -> list:
    """The blocks, summed in two steps: neighbours first, so no task holds the parts of all tasks."""
    near = rows.withColumn("near", F.expr("spark_partition_id() div 64")).groupBy("block", "near").applyInArrow(summed, _BLOCK)
    # a block summed by `summed` is weighted already
    return near.withColumn("w", F.col("weight")).withColumn("weight", F.lit(1.0)).groupBy("block").applyInArrow(_second, _BLOCK).orderBy("block").collect()


def _second(key: tuple, table: pa.Table) -> pa.Table:
    out = summed(key, table)
    return out.set_column(1, "weight", pa.array([float(sum(table.column("w").to_pylist()))]))


def train(table: DataFrame) -> Model:
    """One model from the sequences of the training texts."""
    rows = table.filter(~F.col("held_out"))
    got = _gathered(rows.select("buckets").mapInArrow(pair_counts, _BLOCK))
    pairs = np.zeros((BUCKETS + 1, BUCKETS)) if not got else np.frombuffer(b"".join(r["content"] for r in got), np.float32).reshape(BUCKETS + 1, BUCKETS).astype(np.float64)
    model = Model.start(pairs)
    for k in range(ROUNDS if got else 0):
        share = rows.filter(F.pmod(F.xxhash64("uid"), F.lit(ROUNDS)) == k).select("buckets")
        changes = _gathered(share.mapInArrow(_updater(model, 0.5 / (1 + k)), _BLOCK))
        if not changes:
            continue
        flat = np.frombuffer(b"".join(r["content"] for r in changes), np.float32) / changes[0]["weight"]
        at = 0
        for n, shape in Model.shapes().items():
            size = int(np.prod(shape))
            model.w[n] = model.w[n] + flat[at : at + size].reshape(shape)
            at += size
    return model


def _updater(model: Model, rate: float):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens = Model(model.of_class, model.member, {k: v.copy() for k, v in model.w.items()}), 0
        for batch in batches:
            for k in range(0, len(batch), 1000):
                x = Context(batch.column("buckets").slice(k, 1000))
                own.update(x, rate)
                tokens += len(x.seq)
        if tokens:
            flat = np.concatenate([(own.w[n] - model.w[n]).ravel() for n in Model.NAMES]).astype(np.float32)
            yield _blocks([flat[k : k + 16_384].tobytes() for k in range(0, len(flat), 16_384)], float(tokens))

    return run


def _scorer(model: Model, less: np.ndarray):
    """less: by bucket, log10 of what divides (count + 1) of a word within its bucket."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "uid", "text_key", "held_out", "n_tokens", "freq_log", "freq_known"]
        for batch in batches:
            parts = []
            for k in range(0, len(batch), 500):
                x = Context(batch.column("buckets").slice(k, 500))
                value = model.log_probability(x) - less[x.seq]
                parts.append(np.add.reduceat(value, np.concatenate([[0], x.ends[:-1]])))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[*names, "model_log"])

    return run


@trimmed
def _bucket_totals(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column("word").cast(pa.large_string())
        _, bucket = vocabulary.look_up(names)
        c = batch.column("c").to_numpy()
        c = np.where(pc.equal(names, "").to_numpy(zero_copy_only=False), 0, c)  # the end has its own
        n, v = np.bincount(bucket, weights=c, minlength=BUCKETS).astype(np.int64), np.bincount(bucket, weights=c > 0, minlength=BUCKETS).astype(np.int64)
        full = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(n[full]), pa.array(v[full])], names=["bucket", "n", "v"])


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> list:
    """Up to ``most`` of the most frequent words, by falling count.

    A count's grade is its logarithm in steps of 1/64; the words of the highest
    grades that fit are taken.  So the driver gets a few thousand grades and then
    the words themselves, and no task sends a top list of its own.
    """
    graded = counts.filter((F.col("word") != "") & (F.col("c") > 0) & (F.octet_length("word") <= WORD_BYTES)).withColumn("grade", F.floor(F.log2("c") * 64).cast("int"))
    cut, taken = None, 0
    for r in sorted(graded.groupBy("grade").count().collect(), key=lambda r: -r["grade"]):
        taken += r["count"]
        if taken > most:
            break
        cut = r["grade"]
    if cut is None:
        return []
    return sorted(graded.filter(F.col("grade") >= cut).select("word", "c").collect(), key=lambda r: (-r["c"], r["word"]))


def score(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    source = id_and_text(docs).withColumn("held_out", fold(F.col("doc_id"), folds) == held)
    # equal texts of the same side share a key: what word pairs add depends on the text alone
    source = source.withColumn("text_key", F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("held_out").cast("bigint")))
    counts = source.filter(~F.col("held_out")).select("text").mapInArrow(count_words, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    counts = written(counts, "word-counts")
    total, kinds, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == "", F.col("c"))), F.lit(0))).first()
    top = frequent_words(counts)
    vocabulary = Vocabulary([r["word"] for r in top], [r["c"] for r in top], ends)
    table = written(source.withColumn("part", F.spark_partition_id().cast("bigint")).mapInArrow(lambda it: sequences(it, vocabulary), _ROW), "sequences")
    model = train(table)
    shared = counts.mapInArrow(lambda it: _bucket_totals(it, vocabulary), "bucket bigint, n bigint, v bigint").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    less = np.zeros(BUCKETS)
    for r in shared:
        less[r["bucket"]] = np.log10(r["n"] + r["v"] + 1)
    less[:OWN] = np.log10(vocabulary.own_counts() + 1.0)
    shares = (vocabulary.counts[:-1] + 1) / 10 ** less[vocabulary.look_up(vocabulary.names)[1]]
    blocks = max(LEAST_BLOCKS, total // BLOCK_TOKENS)
    packed = source.select("text", "text_key").mapInArrow(lambda it: word_pairs(it, vocabulary, blocks), "block bigint, pairs binary, sizes binary, keys binary")
    gains = packed.groupBy("block").applyInArrow(_fitted(shares, max(LEAST_BLOCKS, ends // PART_TEXTS)), "part bigint, keys binary, gains binary")
    gains = gains.groupBy("part").applyInArrow(added, "text_key bigint, gain double")
    scored = table.drop("rare", "buckets").columns
    scored = table.select(*scored, "buckets").mapInArrow(_scorer(model, less), "doc_id bigint, uid bigint, text_key bigint, held_out boolean, n_tokens bigint, freq_log double, freq_known bigint, model_log double")
    rare = table.select("uid", F.explode("rare").alias("r")).select("uid", F.col("r.word").alias("word"), F.col("r.tf").alias("tf"))
    others = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(r["word"],) for r in top] or [("",)], "word string")), "word", "left_anti")
    met = rare.join(others, "word").groupBy("uid").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum("tf").alias("rare_known"))
    out = scored.join(met, "uid", "left").join(gains, "text_key", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("freq_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("freq_log") + rare_log - F.col("n_tokens") * float(np.log10(total + kinds + 1))).alias("base_score"),
        (F.col("model_log") + F.col("freq_log") + rare_log + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
