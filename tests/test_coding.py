"""Motion, prediction, coefficients and statistics against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.functions import lossy
from rasterlake.operators import coefficients as K
from rasterlake.operators import motion as M
from rasterlake.operators import planes as N


def texture(h, w, seed=0):
    r = np.random.default_rng(seed)
    rough = r.integers(0, 256, (h // 4 + 8, w // 4 + 8))
    y, x = np.mgrid[0:h, 0:w] / 4
    i, j = y.astype(int), x.astype(int)
    fy, fx = y - i, x - j
    return (rough[i, j] * (1 - fy) * (1 - fx) + rough[i + 1, j] * fy * (1 - fx) + rough[i, j + 1] * (1 - fy) * fx + rough[i + 1, j + 1] * fy * fx).astype(np.uint8)


def all_offsets(block, ref, x, y, radius):
    h, w = block.shape
    best = (int(np.abs(ref[y : y + h, x : x + w].astype(int) - block).sum()), 0, 0)
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            if 0 <= y + dy <= ref.shape[0] - h and 0 <= x + dx <= ref.shape[1] - w:
                sad = int(np.abs(ref[y + dy : y + dy + h, x + dx : x + dx + w].astype(int) - block).sum())
                if sad < best[0]:
                    best = (sad, dx, dy)
    return best


@pytest.mark.parametrize("w,h", [(16, 16), (16, 8), (8, 16), (8, 8), (4, 4), (5, 3)])
def test_best_offset_is_that_of_all_offsets(w, h):
    r = np.random.default_rng(w * h)
    for ref in (texture(48, 64), r.integers(0, 3, (48, 64)).astype(np.uint8), np.zeros((48, 64), np.uint8), np.tile(r.integers(0, 256, (8, 8)), (6, 8)).astype(np.uint8)):
        held = M.Reference(ref, [])
        for x, y in [(0, 0), (64 - w, 48 - h), (20, 17), (33, 9)]:
            block = np.clip(np.roll(ref, (2, -3), (0, 1))[y : y + h, x : x + w].astype(int) + r.integers(-2, 3, (h, w)), 0, 255)
            dx, dy, sad, offsets, compared = M.best_offset(block, held, x, y, 7)
            assert (sad, dx, dy) == all_offsets(block, ref, x, y, 7)
            assert 1 <= compared <= offsets


def test_most_offsets_are_never_compared():
    ref = texture(64, 64)
    now = np.roll(ref, (3, 5), (0, 1)).astype(int)
    rows = [M.best_offset(now[y : y + 16, x : x + 16], M.Reference(ref, []), x, y, 16) for y in (16, 32) for x in (16, 32)]
    assert all(r[:3] == (-5, -3, 0) for r in rows)
    assert sum(r[4] for r in rows) < 0.05 * sum(r[3] for r in rows)


def plain_taps(ref, x, y, w, h, fx, fy):
    at = lambda j, i: int(ref[min(max(j, 0), ref.shape[0] - 1), min(max(i, 0), ref.shape[1] - 1)])
    clip = lambda t: min(255, max(0, (t + 64) >> 7))
    across = [[clip(sum(N.SIX_TAPS[fx][k] * at(y - 2 + j, x + i + k - 2) for k in range(6))) for i in range(w)] for j in range(h + 5)]
    return [[clip(sum(N.SIX_TAPS[fy][k] * across[j + k][i] for k in range(6))) for i in range(w)] for j in range(h)]


def test_six_taps():
    ref = np.random.default_rng(1).integers(0, 256, (9, 11)).astype(np.uint8)
    assert all(sum(t) == 128 for t in N.SIX_TAPS)
    for x, y, fx, fy in itertools.product((-3, 0, 7), (-3, 2, 8), (0, 1, 4, 6), (0, 3, 7)):
        assert N.sub_sample(ref, x, y, 4, 3, fx, fy).tolist() == plain_taps(ref, x, y, 4, 3, fx, fy)
    assert (N.sub_sample(ref, 0, 0, 11, 9, 0, 0) == ref).all()


def test_refinement_follows_halves_then_quarters():
    ref, r = texture(48, 48, 3), np.random.default_rng(4)
    chroma = [texture(24, 24, k).astype(np.uint8) for k in (5, 6)]
    held = M.Reference(ref, chroma)
    moved = 0
    for x, y, fx, fy in [(16, 16, 4, 4), (16, 16, 2, 6), (0, 0, 4, 0), (32, 32, 0, 0), (16, 32, 6, 2)]:
        block = N.sub_sample(ref, x, y, 16, 16, fx, fy)
        own = [c[y // 2 : y // 2 + 8, x // 2 : x // 2 + 8].astype(int) for c in chroma]
        row, col, sse = M.refined(block, own, held, x, y, 0, 0)
        error = lambda a, b: M._squared(block, own, held, x, y, a, b)  # noqa: B023, E731
        halves = min((error(a, b), (a, b) != (0, 0), a, b) for a in (-2, 0, 2) for b in (-2, 0, 2))
        want = (halves[0], halves[2], halves[3])
        if halves[1]:
            want = min([(error(halves[2] + a, halves[3] + b), (a, b) != (0, 0), halves[2] + a, halves[3] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)])
            want = (want[0], want[2], want[3])
        assert (sse, row, col) == want
        moved += (row, col) != (0, 0)
    assert moved >= 2


def test_vectors_of_frames_and_their_parts(spark):
    a = texture(40, 40, 7)  # not a multiple of 16
    b = np.roll(a, (2, 1), (0, 1))
    c = np.random.default_rng(8).integers(0, 256, (40, 40)).astype(np.uint8)
    rows = [(1, k, 40, 40, bytearray(f.tobytes())) for k, f in enumerate((a, b, c))] + [(1, 3, 8, 8, bytearray(64)), (2, 1, 40, 40, bytearray(a.tobytes())), (3, 0, 0, 0, bytearray(b"")), (3, 1, 0, 0, bytearray(b""))]
    df = spark.createDataFrame(rows, "picture_id bigint, frame_idx int, width int, height int, luma binary")
    got = M.vectors(df).collect()
    whole = {(r.frame_idx, r.tx, r.ty): r for r in got if r.split is None}
    assert set(whole) == {(k, i, j) for k in (1, 2) for i in range(3) for j in range(3)}
    r = whole[1, 1, 1]
    assert (r.mv_row, r.mv_col, r.sad, r.sse) == (-8, -4, 0, 0) and r.compared < r.offsets
    parts = [r for r in got if r.split is not None]
    busy = {k for k, r in whole.items() if r.sse >= 16_384}
    assert {(r.frame_idx, r.tx, r.ty) for r in parts} == busy and len(parts) == 24 * len(busy) and busy
    ref, own = np.pad(b, [(0, 8), (0, 8)], mode="edge"), np.pad(c, [(0, 8), (0, 8)], mode="edge").astype(int)
    for r in [x for x in parts if x.frame_idx == 2 and x.tx == 1 and x.ty == 1 and x.split in (0, 2)]:
        across, down = M.SPLITS[r.split]
        w, h = 16 // across, 16 // down
        x, y = 16 + r.slot % across * w, 16 + r.slot // across * h
        assert r.sad == all_offsets(own[y : y + h, x : x + w], ref, x, y, 16)[0]


# -- coefficients ---------------------------------------------------------------------

PROBS = {(b, c, n): 40 + (n * 37 + c * 50 + b * 13) % 200 for b in range(8) for c in range(3) for n in range(11)}


def decisions(levels, ctx, first):
    """(band, ctx, node, bit) of a block, walking it once."""
    last = max([n for n in range(first, 16) if levels[n]], default=first - 1)
    out, n = [], first
    ask = True
    while n < 16:
        band = K.BANDS[n]
        if ask:
            out.append((band, ctx, 0, int(n <= last)))
            if n > last:
                break
        v = abs(levels[n])
        out += [(band, ctx, k, b) for k, b in K.PATHS[K.token_of(v)]]
        ctx, ask, n = min(v, 2), v > 0, n + 1
    return out


def plain_cost(levels, ctx, first):
    total = sum(K.bit_cost(bit, PROBS[b, c, n]) for b, c, n, bit in decisions(levels, ctx, first))
    return total + sum(K.fixed_costs()[abs(v)] for v in levels[first:])


def some_blocks(n, seed, size=60):
    r = random.Random(seed)
    return [[int(r.gauss(0, size / (1 + k))) if r.random() < 0.8 else 0 for k in range(16)] for _ in range(n)]


def test_steps_of_quantisers():
    assert len(lossy.DC_STEPS) == len(lossy.AC_STEPS) == 128 and sorted(lossy.DC_STEPS) == list(lossy.DC_STEPS)


def test_fixed_costs():
    costs = K.fixed_costs()
    assert costs[:5] == [0, 256, 256, 256, 256] and len(costs) == 2048
    assert costs[5] == 256 + K.bit_cost(0, 159) and costs[6] == 256 + K.bit_cost(1, 159)
    assert costs[67] == 256 + sum(K.bit_cost(0, p) for p in K.EXTRA_BITS[67])


@pytest.mark.parametrize("first", [0, 1])
def test_residual_cost_and_branches(spark, first):
    blocks = some_blocks(40, first, 9) + [[0] * 16, [0] * 15 + [1], [5] * 16, [2047, -66, 67, 35, 34, 19, 18, 11, 10, 7, 6, 5, 4, 3, 2, 1]]
    rows = [(i, 0, 0, 2, first, i % 3, b) for i, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "picture_id int, tx int, ty int, type int, first int, ctx int, levels array<int>")
    table = K.CostTable(PROBS)
    got = {r.picture_id: r.cost for r in df.select("picture_id", K.residual_cost(F.col("levels"), F.col("ctx"), first, table).alias("cost")).collect()}
    assert got == {i: plain_cost(b, i % 3, first) for i, b in enumerate(blocks)}
    want = {}
    for i, b in enumerate(blocks):
        for band, c, node, bit in decisions(b, i % 3, first):
            want.setdefault((2, band, c, node), [0, 0])[bit] += 1
    assert {(r.type, r.band, r.ctx, r.node): [r.n0, r.n1] for r in K.branch_counts(df).collect()} == want


def test_adaptation_never_costs_more(spark):
    counts = spark.createDataFrame([(0, 1, 2, 3, 1000, 10), (0, 1, 2, 4, 2, 1), (0, 1, 2, 5, 64, 64), (0, 1, 2, 6, 0, 500), (0, 1, 2, 7, 500, 0), (0, 1, 2, 8, 0, 0)], "type int, band int, ctx int, node int, n0 bigint, n1 bigint")
    current = spark.createDataFrame([(0, 1, 2, n, 128, 250) for n in range(11)], "type int, band int, ctx int, node int, prob int, flag int")
    got = {r.node: (r.new_prob, r.updated) for r in K.adapted(counts, current).collect()}
    assert got == {3: (253, True), 4: (128, False), 5: (128, False), 6: (1, True), 7: (255, True), 8: (128, False)}


def choices(block, ctx, first, dc, ac, weight, kind):
    """Every choice of the quotient or one more, and of the end: the least score."""
    steps = [dc] + [ac] * 15
    cells = []
    for n in range(first, 16):
        j = K.ZIGZAG[n]
        q = steps[j]
        size = abs(block[j]) + (K.SHARPENING[j] * q >> 11 if kind == "light" else 0)
        low, most = (min(2047, (size * ((1 << 17) // q) + r) >> 17) for r in (0, 1 << 16))
        cells.append([(v, K.WEIGHTS[j] * ((size - v * q) ** 2 - size**2)) for v in (low, low + 1) if v <= most])
    limit = ac * ac // 4
    last = max([n for n in range(first, 16) if block[K.ZIGZAG[n]] ** 2 > limit], default=first - 1)
    last = min(15, last + 1)
    best = K.bit_cost(0, PROBS[K.BANDS[first], ctx, 0]) * weight
    for end in range(first, last + 1):
        for picked in itertools.product(*cells[: end - first + 1]):
            if picked[-1][0]:
                levels = [0] * first + [v for v, _ in picked] + [0] * (15 - end)
                best = min(best, plain_cost(levels, ctx, first) * weight + 256 * sum(e for _, e in picked))
    return best


@pytest.mark.parametrize("kind,first,weight", [("light", 0, 40), ("means", 0, 7), ("colour", 1, 150)])
def test_trellis_is_the_best_of_all_choices(spark, kind, first, weight):
    blocks = some_blocks(2, first + weight, 150) + [[0] * 16, [3] * 16, [-40] * 16]
    df = spark.createDataFrame([(i, i % 3, b) for i, b in enumerate(blocks)], "i int, ctx int, block array<int>")
    best = K.trellis(F.col("block"), F.col("ctx"), first, K.CostTable(PROBS), 24, 30, weight, kind)
    for r in df.select("i", best.alias("t")).collect():
        block = blocks[r.i]
        assert r.t.score == choices(block, r.i % 3, first, 24, 30, weight, kind), r.i
        steps = [24] + [30] * 15
        score = plain_cost(r.t.levels, r.i % 3, first) * weight
        for n in range(first, max([n for n in range(16) if r.t.levels[n]], default=-1) + 1):
            j = K.ZIGZAG[n]
            size = abs(block[j]) + (K.SHARPENING[j] * steps[j] >> 11 if kind == "light" else 0)
            score += 256 * K.WEIGHTS[j] * ((size - abs(r.t.levels[n]) * steps[j]) ** 2 - size**2)
            assert r.t.levels[n] * block[j] >= 0
        assert score == r.t.score


@pytest.mark.parametrize("kind", ["light", "means", "colour"])
def test_quantisers(spark, kind):
    blocks = some_blocks(20, 3, 300) + [[4000] * 16, [-4000] * 16]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "i int, block array<int>")
    for r in df.select("i", K.quantised(F.col("block"), 4, 5, kind).alias("q"), K.restored(K.quantised(F.col("block"), 4, 5, kind), 4, 5).alias("back")).collect():
        for n, j in enumerate(K.ZIGZAG):
            q, c = (4, 5)[j > 0], blocks[r.i][j]
            size = abs(c) + (K.SHARPENING[j] * q >> 11 if kind == "light" else 0)
            want = min(2047, (size * ((1 << 17) // q) + (K.ROUNDING[kind][j > 0] << 9)) >> 17)
            assert r.q[n] == (want if c >= 0 else -want) and r.back[j] == r.q[n] * q


# -- loop filter ----------------------------------------------------------------------


def scan_order(plane, levels, inner, size, sharpness, simple):
    """One block after the other, line by line, with plain numbers."""
    p = [[int(v) for v in row] for row in plane]
    clip = lambda v, a, b: min(b, max(a, v))

    def line(at, limit, interior, high, kind):
        s = [p[j][i] for j, i in at]
        n = len(s) // 2
        p1, p0, q0, q1 = s[n - 2 : n + 2]
        if 4 * abs(p0 - q0) + abs(p1 - q1) > 2 * limit + 1:
            return
        if not simple and any(abs(s[k] - s[k + 1]) > interior for k in (0, 1, 2, 4, 5, 6)):
            return
        if simple or abs(p1 - p0) > high or abs(q1 - q0) > high:
            a = 3 * (q0 - p0) + clip(p1 - q1, -128, 127)
            new = {n - 1: p0 + clip((a + 3) >> 3, -16, 15), n: q0 - clip((a + 4) >> 3, -16, 15)}
        elif kind == "edge":
            a = clip(3 * (q0 - p0) + clip(p1 - q1, -128, 127), -128, 127)
            new = {}
            for k, w in enumerate((27, 18, 9)):
                new |= {n - 1 - k: s[n - 1 - k] + ((w * a + 63) >> 7), n + k: s[n + k] - ((w * a + 63) >> 7)}
        else:
            a = 3 * (q0 - p0)
            one, two = clip((a + 4) >> 3, -16, 15), clip((a + 3) >> 3, -16, 15)
            new = {n - 2: p1 + ((one + 1) >> 1), n - 1: p0 + two, n: q0 - one, n + 1: q1 - ((one + 1) >> 1)}
        for k, v in new.items():
            p[at[k][0]][at[k][1]] = clip(v, 0, 255)

    reach = 2 if simple else 4
    for by in range(levels.shape[0]):
        for bx in range(levels.shape[1]):
            level = int(levels[by, bx])
            if not level:
                continue
            interior = level
            if sharpness:
                interior = min(level >> (2 if sharpness > 4 else 1), 9 - sharpness)
            interior = max(1, interior)
            limit, high = 2 * level + interior, 2 if level >= 40 else 1 if level >= 15 else 0
            for turned in (False, True):
                for offset in range(0, size, 4):
                    if (offset == 0 and not (by if turned else bx)) or (offset and not inner[by, bx]):
                        continue
                    for k in range(size):
                        y, x = by * size + (offset if turned else k), bx * size + (k if turned else offset)
                        at = [(y + d, x) if turned else (y, x + d) for d in range(-reach, reach)]
                        line(at, limit + (0 if offset else 4), interior, high, "inner" if offset else "edge")
    return p


@pytest.mark.parametrize("size,sharpness,simple", [(16, 0, False), (8, 3, False), (16, 6, False), (16, 0, True)])
def test_loop_filter_is_that_in_scan_order(size, sharpness, simple):
    from rasterlake.operators import deblock

    r = np.random.default_rng(size + sharpness)
    for rows, columns in ((1, 1), (3, 4), (4, 2), (1, 5)):
        plane = np.clip(texture(rows * size, columns * size, rows) // 4 + r.integers(0, 9, (rows * size, columns * size)) + 40 * ((np.indices((rows * size, columns * size)) // size).sum(axis=0) % 2 == 0) // 4, 0, 255).astype(np.uint8)
        levels, inner = r.choice([0, 5, 14, 15, 30, 40, 63], (rows, columns)), r.integers(0, 2, (rows, columns))
        assert deblock.filtered(plane, levels, inner, size, sharpness, simple).tolist() == scan_order(plane, levels, inner, size, sharpness, simple)


def test_loop_filter_of_frames(spark):
    from rasterlake.operators import deblock

    luma, cb, cr = (np.clip(texture(n, n, k) // 3 + 40, 0, 255).astype(np.uint8) for n, k in ((40, 1), (20, 2), (20, 3)))
    planes = spark.createDataFrame([(1, 40, 40, *(bytearray(p.tobytes()) for p in (luma, cb, cr))), (2, 40, 40, *(bytearray(p.tobytes()) for p in (luma, cb, cr)))], "picture_id bigint, width int, height int, luma binary, cb binary, cr binary")
    blocks = spark.createDataFrame([(1, x, y, 20 + 9 * x, x == y) for x in range(3) for y in range(3) if (x, y) != (1, 1)], "picture_id bigint, tx int, ty int, level int, inner boolean")
    got = {r.picture_id: r for r in deblock.deblocked(deblock.with_levels(planes, blocks, 3, 3)).collect()}
    levels, inner = np.array([[20, 29, 38], [20, 0, 38], [20, 29, 38]]), np.eye(3, dtype=int)
    inner[1, 1] = 0
    for n, p, size in (("luma", luma, 16), ("cb", cb, 8), ("cr", cr, 8)):
        wide = np.pad(p, [(0, 3 * size - p.shape[0])] * 2, mode="edge")
        want = np.array(scan_order(wide, levels, inner, size, 0, False), np.uint8)[: p.shape[0], : p.shape[1]]
        assert got[1][n] == want.tobytes() and got[2][n] == p.tobytes() and want.tobytes() != p.tobytes()
    simple = deblock.deblocked(deblock.with_levels(planes, blocks, 3, 3), simple=True).filter("picture_id = 1").first()
    assert simple.cb == cb.tobytes() and simple.luma != luma.tobytes()


# -- matches --------------------------------------------------------------------------


def chain_search(pixels, least, most, chain):
    out = []
    for i in range(len(pixels)):
        best = (0, 0)
        for c in [j for j in range(i - 1, -1, -1) if pixels[j] == pixels[i]][:chain]:
            n = 0
            while n < most and i + n < len(pixels) and pixels[c + n] == pixels[i + n]:
                n += 1
            if n > best[0]:
                best = (n, i - c)
        out.append(best if best[0] >= least else (0, 0))
    return out


@pytest.mark.parametrize("least,most,chain", [(4, 4095, 64), (1, 7, 3), (4, 16, 64), (2, 1, 1)])
def test_longest_matches_by_chains(least, most, chain):
    from rasterlake.operators import matches

    r = np.random.default_rng(least + most)
    for pixels in ([], [5], [1] * 200, r.integers(0, 2, 300), np.tile(r.integers(-9, 9, 17), 9), r.integers(0, 1000, 80), np.concatenate([[1, 2, 3, 4, 5], r.integers(0, 9, 70), [1, 2, 3, 4, 5]])):
        pixels = np.asarray(pixels, np.int32)
        length, distance = matches.longest(pixels, least, most, chain)
        assert list(zip(length.tolist(), distance.tolist())) == chain_search(pixels.tolist(), least, most, chain)


def test_match_tokens_cover_the_frame(spark):
    from rasterlake.operators import matches

    pixels = np.tile(np.random.default_rng(3).integers(0, 3, 40), 3).astype(np.int32)
    df = spark.createDataFrame([(1, pixels.tolist()), (2, []), (3, None), (4, [7])], "picture_id bigint, argb array<int>")
    rows = sorted(map(tuple, matches.tokens(matches.longest_matches(df)).collect()))
    assert [r for r in rows if r[0] == 4] == [(4, 0, 1, 0)] and {r[0] for r in rows} == {1, 4}
    back = []
    for _, place, length, distance in [r for r in rows if r[0] == 1]:
        assert place == len(back)
        for _ in range(length):
            back.append(back[-distance] if distance else int(pixels[place]))
    assert back == pixels.tolist()


def test_up_sampling_keeps_flat_planes_and_odd_sizes():
    for w, h in ((1, 1), (2, 1), (1, 4), (5, 3), (6, 4)):
        flat = np.full(((h + 1) // 2, (w + 1) // 2), 77, np.uint8)
        assert (N.up_sampled(flat, w, h) == 77).all() and N.up_sampled(flat, w, h).shape == (h, w)
    c = np.array([[0, 160], [80, 240]], np.uint8)
    assert N.up_sampled(c, 4, 4).tolist()[0] == [0, 40, 120, 160]
