"""The quality classifier against plain versions: statistics a text at a time, trees a node at a time, splits by trying all."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_operators import ODD, SCHEMA, odd_rows

from rasterlake.llm import quality

MARKS = "!*%&$#|.,;:?-\"'<>{}=/\\_()[]@+~"


def plain_statistics(text):
    raw = (text or "").encode()
    size = max(1, len(raw))
    kinds = Counter("upper" if 65 <= b <= 90 else "digit" if 48 <= b <= 57 else "blank" if b in (32, 9) else "line" if b in (10, 13) else "wide" if b >= 128 else chr(b) if chr(b) in MARKS else "lower" if 97 <= b <= 122 else "other" for b in raw)
    words = re.findall(rb"[^\x20\x09-\x0d]+", bytes(b + 32 if 65 <= b <= 90 else b for b in raw))
    n = max(1, len(words))
    counts = Counter(words)
    lines = kinds["line"] + 1
    marks = sum(kinds[m] for m in MARKS)
    share = lambda k: kinds[k] / size
    return [
        math.log1p(size), math.log1p(len(words)), share("lower"), share("upper"), share("digit"), share("blank"), share("line"), share("wide"), marks / size,
        sum(map(len, words)) / n, sum(len(w) <= 2 for w in words) / n, sum(len(w) >= 16 for w in words) / n,
        len(counts) / n, max(counts.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n, math.log1p(lines), len(words) / lines, math.log1p(kinds["upper"]),
        *(kinds[m] / n for m in MARKS),
    ]


def plain_score(trees, x):
    total = trees.base
    for feature, limit, leaf in zip(trees.feature, trees.limit, trees.leaf):
        at = 0
        while at < len(feature):
            at = 2 * at + (2 if x[feature[at]] > limit[at] else 1)
        total += leaf[at - len(feature)]
    return 1 / (1 + math.exp(-total))


TEXTS = [*ODD, "word word WORD  x", "a\nb\r\n\nc", "{}[]<>()!?--__", "ABC 123 é", "sixteencharacters sixteencharacter fifteencharacte", "end \x0b\x0c of"]


@pytest.mark.parametrize("size", [50, 1_000_000])
def test_statistics(monkeypatch, size):
    monkeypatch.setattr(quality, "SLICE_BYTES", size)
    got = quality.statistics(pa.array(TEXTS))
    want = np.array([plain_statistics(t) for t in TEXTS])
    assert got.shape == (len(TEXTS), quality.N_STATISTICS) and np.allclose(got, want, rtol=1e-6, atol=1e-7)


def test_scores_are_those_of_a_plain_walk(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    trees = quality.train(docs, labels)
    assert len(trees.feature) == 80
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.score(docs, labels).collect():
        x = np.array(plain_statistics(texts[r.doc_id]), np.float32)
        near = np.array([quality.statistics(pa.array([texts[r.doc_id]]))[0]])
        assert np.allclose(x, near[0], rtol=1e-6, atol=1e-7)
        want = plain_score(trees, near[0])  # the limits are cut at float32 values, so the walk takes those
        assert abs(r.score - want) < 1e-9 and r.predicted == int(want >= 0.3)


def test_scores_of_odd_texts(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    trees = quality.train(docs, labels)
    odd = spark.createDataFrame(odd_rows(), SCHEMA)
    got = [r.score for r in odd.select("doc_id", "text").coalesce(1).mapInArrow(lambda it: quality._scored(it, trees), "doc_id bigint, text string, score double").collect()]
    assert np.allclose(got, [plain_score(trees, x) for x in quality.statistics(pa.array([t for _, t, *_ in odd_rows()]))])


def test_the_first_split_is_the_best_of_all():
    """One tree of depth one: the split, its leaves and its gain by trying every feature and every cut."""
    r = np.random.default_rng(8)
    x = np.round(r.normal(0, 1, (300, 4)), 2).astype(np.float32)
    y = (x[:, 2] + 0.3 * r.normal(0, 1, 300) > 0.4).astype(float)
    t = quality.fit(x, y, trees=1, depth=1, rate=1.0, bins=16, least=3.0, l2=2.0)
    p = y.mean()
    assert abs(t.base - math.log(p / (1 - p))) < 1e-12
    g, h = y - p, np.full(300, p * (1 - p))
    best = (0.0, None, None)
    for j in range(4):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1])).astype(np.float32):
            left = x[:, j] <= cut
            a, b = (g[left].sum(), h[left].sum()), (g[~left].sum(), h[~left].sum())
            if min(a[1], b[1]) >= 3.0:
                gain = a[0] ** 2 / (a[1] + 2) + b[0] ** 2 / (b[1] + 2) - g.sum() ** 2 / (h.sum() + 2)
                if gain > best[0] + 1e-12:
                    best = (gain, j, cut)
    assert (t.feature[0, 0], t.limit[0, 0]) == best[1:]
    left = x[:, best[1]] <= best[2]
    assert np.allclose(t.leaf[0], [g[left].sum() / (h[left].sum() + 2), g[~left].sum() / (h[~left].sum() + 2)])
