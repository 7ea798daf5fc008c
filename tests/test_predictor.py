"""The predictor search over all modes, against a plain version."""

import random

from rasterlake.operators import stencils as T
from rasterlake.plans import catalog

SIDE, TILE = 8, 4


def pictures():
    """Pictures that differ in what predicts them best: noise, ramps, opaque black with dots, diagonals."""
    r = random.Random(3)
    out = {}
    for i in range(12):
        def pixel(x, y, i=i):
            if i % 4 == 0:
                return tuple(r.randrange(256) for _ in "argb")
            if i % 4 == 1:
                return (255, (x * 9 + y * i) % 256, (x * y * 3) % 256, (y * 17) % 256)
            if i % 4 == 2:
                return (255, 0, 0, 0) if r.random() < 0.7 else (255, r.randrange(256), 0, 9)
            return (255, (x + y) * 11 % 256, (x - y) * 13 % 256, r.randrange(4))

        out[i] = {(x, y): pixel(x, y) for y in range(SIDE) for x in range(SIDE)}
    return out


def guess(p, x, y, mode):
    if (x, y) == (0, 0):
        return (255, 0, 0, 0)
    if y == 0:
        return p[x - 1, y]
    if x == 0:
        return p[x, y - 1]
    left, top, corner = p[x - 1, y], p[x, y - 1], p[x - 1, y - 1]
    right = p[x + 1, y - 1] if x < SIDE - 1 else p[0, y]

    def half(a, b):
        return tuple((u + v) // 2 for u, v in zip(a, b))

    def clamp(v):
        return max(0, min(255, v))

    if mode == 11:
        a, b = sum(abs(u - v) for u, v in zip(top, corner)), sum(abs(u - v) for u, v in zip(left, corner))
        return left if a < b else top
    return {
        0: (255, 0, 0, 0), 1: left, 2: top, 3: right, 4: corner, 5: half(half(left, right), top), 6: half(left, corner), 7: half(left, top),
        8: half(corner, top), 9: half(top, right), 10: half(half(left, corner), half(top, right)),
        12: tuple(clamp(l + t - c) for l, t, c in zip(left, top, corner)),
        13: tuple(clamp(m + int((m - c) / 2)) for m, c in zip(half(left, top), corner)),
    }[mode]


def plain(ims):
    out = set()
    for i, p in ims.items():
        for ty in range(SIDE // TILE):
            for tx in range(SIDE // TILE):
                costs = []
                for mode in range(14):
                    cost = 0
                    for y in range(ty * TILE, (ty + 1) * TILE):
                        for x in range(tx * TILE, (tx + 1) * TILE):
                            for v, g in zip(p[x, y], guess(p, x, y, mode)):
                                d = (v - g) % 256
                                cost += abs(d - 256 if d > 127 else d)
                    costs.append((cost, mode))
                cost, mode = min(costs)
                out.add((i, tx, ty, mode, cost))
    return out


def test_search_over_all_modes_equals_a_plain_version(spark, sf_dir, monkeypatch):
    ims = pictures()
    px = spark.createDataFrame([(i, x, y, *c) for i, p in ims.items() for (x, y), c in p.items()], "picture_id bigint, x int, y int, a int, r int, g int, b int")
    want = plain(ims)
    assert len({m for *_, m, _ in want} - {1, 2, 4, 11}) > 2
    monkeypatch.setattr(catalog, "pixels", lambda spark, d: px)
    assert {tuple(r) for r in catalog.queries()["predictor_search"](spark, sf_dir).collect()} == want
