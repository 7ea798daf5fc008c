"""Repeated passages, hard negatives and collocations on small tables with every odd case, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from rasterlake.llm import collocations, hard_negatives, substring_dedup

SCHEMA = "doc_id bigint, text string, lang string, block bigint, part string, range int, size string, n int, word string, phrase string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, 7, "p", 1, "s", 2, "w", "q") for i, t, g in rows], SCHEMA)


# -- repeated passages ------------------------------------------------------------------


def without_repeats(rows, size):
    """Rows of (doc_id, text) in stored order, which ranks rows of equal ids."""
    words = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    seen, gone = set(), [[False] * len(w) for w in words]
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i)):
        for a in range(len(words[i]) - size + 1):
            window = tuple(words[i][a : a + size])
            if window in seen:
                gone[i][a : a + size] = [True] * size
            seen.add(window)
    return [(rows[i][0], len(w), sum(g), " ".join(x for x, y in zip(w, g) if not y)) for i, (w, g) in enumerate(zip(words, gone))]


def passages():
    r = np.random.default_rng(5)
    some = lambda n, v=400: " ".join(f"w{k}" for k in r.integers(0, v, n))
    shared, long = some(30), some(9)
    rows = [(i, some(int(r.integers(0, 60))) + " " + (shared if i % 3 == 0 else "") + "\t\n" + some(5)) for i in range(40)]
    rows += [(50 - i, some(12, 3) + f" {long} " + some(12, 3)) for i in range(30)]
    rows += [(i, t) for i, t in enumerate([None, "", " \t\r\n", "a " * 4000, "ab c d e f", "A b c d e", "a b c d e", "a\x1cb c d e f é 日本", "a\x1cb c d e f é 日本"], 200)]
    return rows + [(300, some(40)), (None, shared), (None, shared), (None, None), (-5, shared + " é"), (2**40, shared)]


@pytest.mark.parametrize("size", [1, 4, 5, 20])
def test_passages_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 700)
    monkeypatch.setattr(substring_dedup, "RANGE_WINDOWS", 300)
    rows = passages()
    rows += [rows[-6], rows[0]]  # repeated rows
    got = substring_dedup.without_repeats(frame(spark, [(i, t, "en") for i, t in rows]).coalesce(1), size)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == Counter(without_repeats(rows, size))


def test_passages_intervals_and_digest(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words[10:35]) + " y z " + " ".join(words[:22])), (3, " ".join(words))]
    got = substring_dedup.without_repeats(frame(spark, [(i, t, "en") for i, t in rows]), 20)
    spans = {r.doc_id: [(s.start, s.end) for s in r.removed] for r in got.collect()}
    assert spans == {1: [], 2: [(1, 26), (28, 50)], 3: [(0, 50)]}
    digests = {r.doc_id: r.kept_sha256 for r in substring_dedup.digest(got).collect()}
    assert digests[3] == hashlib.sha256(b"").hexdigest() and digests[2] == hashlib.sha256(b"x y z").hexdigest()
    assert substring_dedup.without_repeats(frame(spark, []), 20).count() == 0


def test_texts_are_not_shuffled(spark):
    got = substring_dedup.without_repeats(frame(spark, [(1, "a b c", "en")]), 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and not re.search(r"Exchange hashpartitioning\(block[^\n]*\n[^\n]*text", plan)


def test_hashes_are_polynomials():
    w = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    for size in (1, 2, 3, 7, 20, 50):
        want = []
        for i in range(len(w) - size + 1):
            h = 0
            for x in w[i : i + size].tolist():
                h = (h * 12345677 + x) % 2**64
            want.append(h)
        assert substring_dedup.rolled(w, size, 12345677).tolist() == want
    assert len(substring_dedup.rolled(w, 51, 3)) == 0


# -- hard negatives ---------------------------------------------------------------------


def hard(rows, every, low=80, high=100, k=5):
    rows = [(v, [int(np.floor(256 * np.float64(np.float32(x)))) for x in e], g) for v, e, g in rows if v is not None and g is not None and e and all(x is not None and np.isfinite(x) for x in e)]
    score = lambda a, b: sum(x * y for x, y in zip(a[1], b[1]))
    out = []
    for i, a in enumerate(rows):
        if a[0] % every:
            continue
        met = [(-score(a, b), b[0], j) for j, b in enumerate(rows) if j != i and len(b[1]) == len(a[1])]
        own = sorted(m for m in met if rows[m[2]][2] == a[2])[:k]
        for p, pid, _ in own:
            fit = sorted((s, n) for s, n, j in met if rows[j][2] != a[2] and low * -p <= 100 * -s <= high * -p)[:k]
            out += [(a[0], pid, rank, n, -p, -s) for rank, (s, n) in enumerate(fit, 1)]
    return sorted(out)


VECTORS = "vec_id bigint, embedding array<float>, label int, dims int, codes string, block int, rank int"


def vectors():
    r = np.random.default_rng(9)
    base = r.normal(0, 0.3, (12, 7))
    rows = [(int(i), (base[i % 12] + r.normal(0, 0.05, 7)).astype(np.float32).tolist(), int(i % 4)) for i in range(400)]
    rows += [(int(1000 + i), r.normal(0, 1, 3).astype(np.float32).tolist(), int(i % 2)) for i in range(30)]
    rows += [(2000 + i, [0.5, 0.25], i % 2) for i in range(40)]  # one vector very often: ties
    rows += [(2000, [0.5, 0.25], 0), (10, rows[10][1], 2), (None, [1.0], 1), (5, None, 1), (15, [1.0] * 7, None), (20, [], 1), (25, [float("nan")] * 7, 1), (30, [None] * 7, 1), (35, [float("inf")] * 7, 1)]
    return rows


@pytest.mark.parametrize("every", [5, 50])
def test_hard_negatives_against_brute_force(spark, monkeypatch, every):
    monkeypatch.setattr(hard_negatives, "SHARD_BYTES", 2000)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 500)
    rows = vectors()
    df = spark.createDataFrame([(v, e, g, 1, "c", 2, 3) for v, e, g in rows], VECTORS).repartition(3)
    got = hard_negatives.mine(df, every=every)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == hard(rows, every)


def test_hard_negatives_without_rows(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    one = spark.createDataFrame([(100, [1.0], 1, 1, "c", 2, 3)], VECTORS)
    assert hard_negatives.mine(one).count() == 0


def test_bounds_hold_and_filter():
    """Every score lies in its interval, and most rows are never scored exactly."""
    r = np.random.default_rng(2)
    v = np.floor(r.normal(0, 32, (3000, 16)))
    c = hard_negatives.fitted(v[:1000])
    p = hard_negatives.parts(v)
    codes = np.stack([hard_negatives.nearest(x, y) for x, y in zip(p, c)])
    left = np.sqrt(((p - np.stack([y[k] for k, y in zip(codes, c)])) ** 2).sum(axis=2))
    blob = lambda x, t: np.asarray(x, t).tobytes()
    row = {"dims": 16, "ids": blob(range(3000), np.int64), "uids": blob(range(3000), np.int64), "labels": blob(np.arange(3000) % 3, np.int64), "vectors": v.tobytes(), "codes": codes.tobytes(), "residuals": left.tobytes(), "centroids": c.tobytes()}
    asked = {"b_dims": 16, "b_uids": blob([0, 1], np.int64), "b_ids": blob([0, 1], np.int64), "b_labels": blob([0, 1], np.int64), "b_vectors": v[:2].tobytes(), "b_windows": b"", "b_counts": blob([0, 0], np.int64)}
    block = hard_negatives.Block(asked, 5, None)
    ends = []
    block._positives = lambda i, low, high, ids, *_: ends.append((i, ids, low, high))
    block.search(row)
    assert len(ends) == 2 and all(((low <= v[ids] @ v[i]) & (v[ids] @ v[i] <= high)).all() for i, ids, low, high in ends)
    block = hard_negatives.Block(asked, 5, None)
    block.search(row)
    scores = v @ v[0]
    want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i % 3 == 0 and i)[:5]
    assert [(s, n) for s, n, _ in block.best.rows[0]] == want and block.scored < 0.2 * block.met


def test_large_components_stay_exact():
    q, v = np.array([2.0**40, 3.0]), np.array([[2.0**30, 1.0], [2.0**13, 1.0]])
    assert hard_negatives.exact(q, v) == [min(2**70 + 3, 2**63 - 1), 2**53 + 3]


def test_hard_negatives_of_large_numbers(spark):
    """Scores above 2 ** 53, and components above what single precision holds."""
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.integers(-(1 << 20), 1 << 20, 3)], i % 3) for i in range(60)]
    small = [(i, [float(x) / 256 for x in r.integers(-1, 2, 3)], i % 2) for i in range(59)] + [(100, [2.0**53, 0.0, 0.0], 0)]
    for table in (rows, small):
        got = hard_negatives.mine(spark.createDataFrame([(v, e, g, 1, "c", 2, 3) for v, e, g in table], VECTORS), every=10)
        assert sorted(map(tuple, got.collect())) == hard(table, 10)


def test_shards_of_one_length_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SHARD_BYTES", 2000)
    seen, searched = [], hard_negatives.searched
    monkeypatch.setattr(hard_negatives, "searched", lambda index, *a: seen.append(index.select(F.input_file_name()).distinct().count()) or searched(index, *a))
    rows = [(i, np.random.default_rng(i).normal(0, 0.3, 8).tolist(), i % 4, 1, "c", 2, 3) for i in range(600)]
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(3), every=50)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert min(seen) > 1


def test_windows_take_rows_in_bulk(monkeypatch):
    """Two-byte vectors by label: windows hold what brute force finds, and few anchors are taken one by one."""
    r = np.random.default_rng(5)
    v, labels = np.floor(r.normal(0, 32, (20000, 16))), np.sort(r.integers(0, 4, 20000))
    c = hard_negatives.fitted(v[:2000])
    blob = lambda x, t: np.asarray(x, t).tobytes()
    row = {"dims": 16, "ids": blob(range(20000), np.int64), "uids": blob(range(20000), np.int64), "labels": blob(labels, np.int64), "vectors": v.tobytes(), "centroids": c.tobytes()}
    batch = hard_negatives._batch({k: [x] for k, x in row.items()})
    row = next(hard_negatives.indexed([batch])).to_pylist()[0]
    assert len(row["vectors"]) == 2 * v.size
    anchors = r.permutation(np.arange(0, 20000, 500)).tolist()
    scores = v[anchors] @ v.T
    windows = [(0, 0, int(np.sort(s)[-20])) for s in scores]
    asked = {"b_dims": 16, "b_uids": blob(anchors, np.int64), "b_ids": blob(anchors, np.int64), "b_labels": blob(labels[anchors], np.int64), "b_vectors": v[anchors].tobytes(), "b_windows": blob(windows, np.int64), "b_counts": blob([1] * len(anchors), np.int64)}
    block = hard_negatives.Block(asked, 5, (80, 100))
    single, step = [], block._negatives
    monkeypatch.setattr(block, "_negatives", lambda i, *a: single.append(i) or step(i, *a))
    block.search(row)
    for i, a in enumerate(anchors):
        fit = sorted((-int(s), n) for n, s in enumerate(scores[i]) if labels[n] != labels[a] and 80 * windows[i][2] <= 100 * s <= 100 * windows[i][2])[:5]
        assert [(s, n) for s, n, _ in block.best.rows[i]] == fit
    assert len(single) < len(anchors)


# -- collocations -----------------------------------------------------------------------


def phrases(rows, least, first, longest=4):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cand = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        covered = defaultdict(int)
        for g, a in cand.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    covered[g[i : i + m]] = max(covered[g[i : i + m]], a)
        kept = []
        for g, a in cand.items():
            if 100 * covered[g] >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:first], 1)]
    return sorted(out)


def sentences():
    r = np.random.default_rng(4)
    words = ["the", "The", "of", "new", "york", "city", "é", "日本", "a-b", "x\x1cy", "São", "it's"]
    rows = []
    for i in range(300):
        t = "".join(str(r.choice(words, p=[0.3] + [0.7 / 11] * 11)) + str(r.choice([" ", "  ", "\t", ", ", ".", "\n", "\r\n", "! ? "], p=[0.7] + [0.3 / 7] * 7)) for _ in range(int(r.integers(0, 60))))
        rows.append((i, t + "New York City hall", ["en", "de", None, "und", "zh hans"][i % 5]))
    rows += [(1, None, "en"), (2, "", "en"), (3, " ,.;\n", "xx"), (None, "the the the the the", "en"), (5, "word " * 5000, "en"), (5, "word " * 5000, "en")]
    return rows


@pytest.mark.parametrize("hot", [False, True])
def test_collocations_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(collocations, "FLUSH_BYTES", 3000)
    monkeypatch.setattr(collocations, "SHARD_WORDS", 40 if hot else 10**6)
    rows = sentences()
    got = collocations.mine(frame(spark, rows).repartition(4), least=5, first=50)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases(rows, 5, 50)


def test_collocations_without_rows(spark):
    assert collocations.mine(frame(spark, [])).count() == 0
    assert collocations.mine(frame(spark, [(1, "one word, only", "en"), (2, None, None)])).count() == 0


def test_collocation_scores_do_not_overflow(spark):
    big = 4 * 10**18
    table = spark.createDataFrame([("en", "a", 1, big + 7), ("en", "b", 1, big + 9), ("en", "a b", 2, big), ("en", "a b c", 3, big * 4 // 5), ("en", "c", 1, big)], "lang string, phrase string, size int, n bigint")
    table = table.union(spark.createDataFrame([("en", "b c", 2, big * 4 // 5)], table.schema))
    rows = {r.phrase: r for r in collocations.ranked(table, spark.createDataFrame([("en", 9)], "lang string, n bigint"), 2_000_000, 80, 10).collect()}
    assert set(rows) == {"a b c"} and rows["a b c"].score == 2_000_000 * (big * 4 // 5) // (2 * big)


def test_pieces_and_suffix_counts():
    codes, follows, distinct, n = collocations.pieces(pa.array(["A b.c", "", " b", "c\td"], pa.large_string()))
    assert [distinct[c].as_py() for c in codes] == ["a", "b", "c", "b", "c", "d"] and n.tolist() == [3, 0, 1, 2]
    assert follows.tolist() == [False, True, False, False, False, True]
    order, new, count = collocations.counted([np.array([0, 0, 0, 0]), np.array([1, 1, 1, 1]), np.array([2, -1, 2, 3])], None, 5)
    assert count.tolist() == [1, 2, 1] and [[2, -1, 2, 3][i] for i in order] == [3, 2, 2, -1]
