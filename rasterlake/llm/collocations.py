"""Phrase collocations by Suffix-sigma: truncated suffixes, sorted reverse-lexicographically, all prefixes counted at once.

1.  A pass counts words by language, which gives n, and finds the *hot* prefixes of
    suffixes: those with more occurrences than a shard should hold.  Each task reports
    what makes up more than 1 in 40,000 of its text; sums of those miss at most that
    share, so every prefix above the limit is found, and at most 40,000 of each length.
2.  Every word occurrence starts a suffix of its piece, truncated to ``longest``
    words.  A task counts equal suffixes of about 8 MB of text and sends them, once
    each with their number, to the shard of (language, first word).
3.  A shard merges what it gets into one reverse-lexicographic order, so that a phrase
    and all that begin with it stand together, the longer ones first.  Walking down, a
    stack holds the current suffix; a level is popped, and its count is whole, where
    the next suffix shares fewer words than that.  The levels are popped for all rows
    at once: level d ends where the common prefix with the next row is below d.
4.  Phrases above the threshold become a table; parts are joined to candidates, and
    candidates to the longer ones that contain them, by words.

A hot prefix, of whatever length, is split over shards by its next word, so a shard is
that of the shortest prefix that is not hot.  Counts of hot prefixes, and of no others,
are sums of shards, taken by a grouping before the threshold.  Equal suffixes are counted before the shuffle, so
a line or passage that is everywhere costs one entry a task.  The rank within a
language is limited before it is shuffled.

Edge cases.  Null texts are empty: no words.  Null languages are ``und``; that and a
language of the name are one.  Pieces without words, repeated separators and very
long texts are nothing special; repeated rows count as often as they occur.  Ties
follow the contract: cuts to the shorter first part, phrases to the larger count, then
bytes.  Counts are longs and products decimals.  No rows: none.  Other columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_strings, bounded_batches, buffers, trimmed, words, written
from .substring_dedup import of_one, packed, unpacked

FLUSH_BYTES, SHARD_WORDS, HOT = 8_000_000, 400_000, 20_000
_HEAVY = "lang string, prefix bigint, n bigint"
_SENT = "shard bigint, rows bigint, n_words bigint, n_bytes bigint, lengths binary, bytes binary, codes binary, counts binary"
_PHRASES = "lang string, phrase string, size int, n bigint"
_MIX = np.uint64(0x9E3779B97F4A7C15)

_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91] += 32
_KIND[9] = 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_KIND[_BREAK] = 32


def pieces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(code of each word, whether it follows the word before in one piece, distinct words, words of each row)."""
    raw, offsets = buffers(texts)
    plain = _KIND[raw]
    codes, ends, distinct = words(as_strings(plain, offsets), lower=False)
    inside = plain != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < len(raw)]
    begins[rows] = inside[rows]
    at = np.flatnonzero(begins)
    n = np.diff(ends, prepend=0)
    piece, row = np.cumsum(_BREAK[raw], dtype=np.int64)[at], np.repeat(np.arange(len(n)), n)
    follows = np.zeros(len(codes), bool)
    follows[1:] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
    return codes, follows, distinct, n


def flushed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(languages, texts) of about FLUSH_BYTES."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= FLUSH_BYTES:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    table = pa.Table.from_batches(held)
    return table.column("lang").combine_chunks(), table.column("text").cast(pa.large_string()).combine_chunks()


def hashes(strings: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(s) for s in strings.cast(pa.large_binary()).to_pylist()], np.uint64)


def prefixes(lang: np.ndarray, words: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of (language, first word), (language, first two words) and so on."""
    out, h = [], lang
    for w in words:
        h = (h ^ w) * _MIX
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


def split_after(found: list[np.ndarray], hot: np.ndarray) -> list[np.ndarray]:
    """Whether a prefix, and with it all shorter ones, is hot, for each length."""
    out, all_hot = [], np.ones(len(found[0]), bool)
    for p in found:
        all_hot = all_hot & np.isin(p, hot) if len(hot) else np.zeros(len(p), bool)
        out.append(all_hot)
    return out


def suffixes(langs: pa.Array, texts: pa.Array, longest: int) -> tuple[pa.Array, pa.Array, list[np.ndarray]]:
    """(languages, words, columns of codes: language and up to ``longest`` words, -1 for none) of all suffixes of pieces."""
    codes, follows, distinct, n = pieces(texts)
    lang = langs.dictionary_encode()
    columns = [np.repeat(lang.indices.to_numpy(), n), codes]
    whole = np.ones(len(codes), bool)
    for k in range(1, longest):
        whole[: len(codes) - k] &= follows[k:]
        whole[max(len(codes) - k, 0) :] = False
        columns.append(np.where(whole, np.concatenate([codes[k:], np.zeros(min(k, len(codes)), codes.dtype)]), -1))
    return lang.dictionary, distinct, columns


def _heavy(longest: int):
    @trimmed
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in flushed(batches):
            names, distinct, columns = suffixes(langs, texts, longest)
            count = np.bincount(columns[0], minlength=len(names))
            yield pa.RecordBatch.from_arrays([names, pa.nulls(len(names), pa.int64()), pa.array(count)], names=["lang", "prefix", "n"])
            h = np.append(hashes(distinct), np.uint64(0))
            found = prefixes(hashes(names)[columns[0]], [h[c] for c in columns[1:]])
            for k, p in enumerate(found[: longest - 1]):
                values, n = np.unique(p[columns[k + 1] >= 0], return_counts=True)
                values, n = (x[n > len(columns[0]) / (2 * HOT)] for x in (values, n))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n)], names=["lang", "prefix", "n"])

    return report


def counted(columns: list[np.ndarray], weights: np.ndarray | None, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of codes below ``base`` (-1: none) in reverse-lexicographic order: (order, whether it is the first of equal rows, counts of those)."""
    keys = []
    for a in range(0, len(columns), 2):
        pair = columns[a : a + 2]
        keys.append(sum((c.astype(np.int64) + 1) * (base + 1) ** (len(pair) - 1 - i) for i, c in enumerate(pair)))
    order = np.lexsort([-k for k in reversed(keys)])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    at = np.flatnonzero(new)
    n = np.diff(np.concatenate([at, [len(order)]])) if weights is None else np.add.reduceat(weights[order], at) if len(at) else np.zeros(0, np.int64)
    return order, new, n


def _sender(shards: int, longest: int, hot: np.ndarray):
    @trimmed
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in flushed(batches):
            names, distinct, columns = suffixes(langs, texts, longest)
            if not len(columns[0]):
                continue
            order, new, counts = counted(columns, None, max(len(distinct), len(names)))
            columns = [c[order[new]] for c in columns]
            h = np.append(hashes(distinct), np.uint64(0))
            found = prefixes(hashes(names)[columns[0]], [h[c] for c in columns[1:]])
            shard = found[0]
            for split, long in zip(split_after(found, hot), found[1:]):
                shard = np.where(split, long, shard)
            shard = (shard >> np.uint64(16)) % np.uint64(shards)
            by = np.argsort(shard, kind="stable")
            bounds = np.flatnonzero(np.concatenate([[True], shard[by][1:] != shard[by][:-1]]))
            strings = pa.concat_arrays([distinct.cast(pa.large_binary()), names.cast(pa.large_binary())])
            columns[0] = columns[0] + len(distinct)
            for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(by)]):
                own = by[a:b]
                used, local = np.unique(np.stack([c[own] for c in columns]), return_inverse=True)
                none = int(len(used) and used[0] < 0)
                raw, offsets = buffers(strings.take(pa.array(used[none:])))
                local = (local.reshape(-1) + (1 - none)).astype(np.uint32)  # 0: no word
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array([int(x)]) for x in (shard[own[0]], b - a, len(used) - none, len(raw))),
                        *(pa.array([x], pa.binary()) for x in (packed(np.diff(offsets)), pa.compress(raw.tobytes(), codec="zstd", asbytes=True), packed(local), packed(counts[own].astype(np.int64)))),
                    ],
                    names=[c.split()[0] for c in _SENT.split(", ")],
                )

    return send


def _counter(longest: int, least: int, hot: np.ndarray):
    def count(table: pa.Table) -> pa.Table:
        strings, codes, counts, base = [], [], [], 0
        for r in table.to_pylist():
            lengths = unpacked(r["lengths"], r["n_words"], np.int64)
            raw = np.frombuffer(pa.decompress(r["bytes"], decompressed_size=r["n_bytes"], codec="zstd"), np.uint8)
            strings.append(as_strings(raw, np.concatenate([[0], np.cumsum(lengths)])).cast(pa.large_binary()))
            local = unpacked(r["codes"], r["rows"] * (longest + 1), np.uint32).astype(np.int64).reshape(longest + 1, -1)
            codes.append(np.where(local > 0, local - 1 + base, -1))
            counts.append(unpacked(r["counts"], r["rows"], np.int64))
            base += r["n_words"]
        coded = pa.concat_arrays(strings).dictionary_encode()
        distinct = coded.dictionary
        rank = np.empty(len(distinct) + 1, np.int64)
        by = pc.array_sort_indices(distinct).to_numpy()
        rank[by], rank[-1] = np.arange(len(by)), -1
        of = np.append(rank[coded.indices.to_numpy()], -1)
        columns = [of[c] for c in np.concatenate(codes, axis=1)]
        order, new, n = counted(columns, np.concatenate(counts), len(distinct))
        columns = [c[order[new]] for c in columns]
        h = np.append(hashes(distinct)[by] if len(hot) else np.zeros(len(by), np.uint64), np.uint64(0))
        partial = split_after(prefixes(h[columns[0]], [h[c] for c in columns[1:]]), hot)
        words = distinct.take(pa.array(by)).cast(pa.large_string())
        out, fresh = [], np.zeros(len(n), bool)
        fresh[:1] = True
        fresh[1:] = columns[0][1:] != columns[0][:-1]
        for d in range(1, longest + 1):
            fresh[1:] |= columns[d][1:] != columns[d][:-1]  # where level d is pushed anew; the level before it is popped
            at = np.flatnonzero(fresh)
            total = np.add.reduceat(n, at) if len(at) else n
            keep = (columns[d][at] >= 0) & ((total >= least) | partial[d - 1][at])
            at = at[keep]
            phrase = pc.binary_join_element_wise(*(words.take(pa.array(c[at])) for c in columns[1 : d + 1]), pa.scalar(" ", pa.large_string()))
            out.append(pa.table([words.take(pa.array(columns[0][at])).cast(pa.string()), phrase.cast(pa.string()), pa.array(np.full(len(at), d, np.int32)), pa.array(total[keep])], names=["lang", "phrase", "size", "n"]))
        return pa.concat_tables(out).combine_chunks()

    return of_one(count)


def _big(x):
    return F.col(x).cast("decimal(20,0)") if isinstance(x, str) else F.lit(x).cast("decimal(10,0)")


def mine(docs: DataFrame, longest: int = 4, least: int = 30, scale: int = 2_000_000, covered: int = 80, first: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's ``first`` phrases: lang, rank, phrase, a, l, r, n, score."""
    bounded_batches(docs.sparkSession)
    read = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    heavy = written(read.mapInArrow(_heavy(longest), _HEAVY).groupBy("lang", "prefix").agg(F.sum("n").alias("n")), "prefixes")
    sizes = heavy.filter("prefix is null and n > 0").select("lang", "n")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    limit = max(SHARD_WORDS, total // HOT) - total / (2 * HOT)
    hot = np.array([r["prefix"] for r in heavy.filter(F.col("prefix").isNotNull() & (F.col("n") > limit)).select("prefix").collect()], np.int64).view(np.uint64)  # at most 2 * HOT of each length
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, total // SHARD_WORDS)
    sent = read.mapInArrow(_sender(shards, longest, hot), _SENT)
    found = sent.groupBy("shard").applyInArrow(_counter(longest, least, hot), _PHRASES)
    phrases = written(found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrases")
    return ranked(phrases, sizes, scale, covered, first)


def ranked(phrases: DataFrame, sizes: DataFrame, scale: int, covered: int, first: int) -> DataFrame:
    """Scores of the lowest cut, without phrases that a longer one covers."""
    w = F.split("phrase", " ")
    candidates = phrases.filter("size >= 2").withColumnRenamed("n", "a")
    part = lambda start, size: F.array_join(F.slice(w, start, size), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    of = lambda part, count: phrases.select("lang", F.col("phrase").alias(part), F.col("n").alias(count))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr(f"cast(cast({scale} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = candidates.filter("size >= 3").select("lang", F.col("a").alias("longer"), "size", w.alias("w"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "longer", F.explode(F.expr("transform(sequence(1, size - m + 1), i -> array_join(slice(w, i, m), ' '))")).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = F.coalesce(_big(100) * _big("longer") >= _big(covered) * _big("a"), F.lit(False))
    left = best.join(longer, ["lang", "phrase"], "left").filter(~held).join(sizes, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    out = left.withColumn("rank", rank).filter(F.col("rank") <= first)
    return out.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


#: The same phrases by listing all of them.
PHRASES_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, m, w[i : i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m))),
f AS (SELECT lang, m, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS a FROM g GROUP BY lang, m, array_to_string(g, ' ')),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m >= 2 AND a >= 30),
k AS (SELECT lang, phrase, g, a, m, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.a, k.k, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * k.a // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.g[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.g[k.k + 1:k.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(g[i : i + m2 - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT lang, g, a, m2, unnest(range(1, m - m2 + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m2) WHERE m2 < m) GROUP BY 1, 2),
o AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE NOT coalesce(CAST(100 AS HUGEINT) * longer >= CAST(80 AS HUGEINT) * a, false)),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang))
SELECT * FROM r WHERE rank <= 2000
"""
