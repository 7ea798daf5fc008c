"""Paths against plain versions, and plans of operators that must not shuffle or carry more than they need."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from rasterlake.operators import paths as H
from rasterlake.operators import pixels as P
from rasterlake.operators import stencils as T
from rasterlake.operators import summaries as S
from rasterlake.operators import timeline as L
from rasterlake.plans.inputs import animation, pixels

SCHEMA = "id int, seg int, kind string, xs array<double>, ys array<double>"


def some_path(r):
    out, n = [], 0
    for _ in range(r.randint(1, 3)):
        point = lambda k: ([float(r.randint(-20, 40)) for _ in range(k)], [float(r.randint(-20, 40)) for _ in range(k)])
        out.append((n, "M", *point(1)))
        n += 1
        for _ in range(r.randint(1, 4)):
            kind = r.choice("LLQC")
            out.append((n, kind, *point({"L": 1, "Q": 2, "C": 3}[kind])))
            n += 1
        if r.random() < 0.7:
            out.append((n, "Z", [], []))
            n += 1
            if r.random() < 0.3:  # goes on from where the sub-path began
                out.append((n, "L", *point(1)))
                n += 1
    return out


def walked(path, parts):
    """Lists of points of each sub-path; ``parts`` gives how many lines a curve becomes."""
    subs, at, begun = [], (0.0, 0.0), (0.0, 0.0)
    for _, kind, xs, ys in path:
        points = list(zip(xs, ys))
        if kind == "M":
            at = begun = points[-1]
            subs.append([at])
        elif kind == "Z":
            subs[-1].append(begun)
            at = begun
        else:
            ps = [at, *points]
            n = 1 if kind == "L" else parts(kind, ps)
            d = len(ps) - 1
            for i in range(1, n + 1):
                t = i / n
                subs[-1].append(tuple(sum(math.comb(d, k) * t**k * (1 - t) ** (d - k) * p[a] for k, p in enumerate(ps)) for a in (0, 1)))
            at = points[-1]
    return subs


def flat_parts(kind, ps):
    bends = [math.hypot(*(ps[j][a] - 2 * ps[j + 1][a] + ps[j + 2][a] for a in (0, 1))) for j in range(len(ps) - 2)]
    bend = max(bends) * (0.25 if kind == "Q" else 0.75)
    n = 1
    while bend > 1.0 + 1e-9 and n < 1024:
        n, bend = n * 2, bend / 4
    return n


@pytest.fixture(scope="module")
def shapes():
    r = random.Random(11)
    return {i: some_path(r) for i in range(60)}


@pytest.fixture(scope="module")
def segments(spark, shapes):
    return spark.createDataFrame([(i, *s) for i, p in shapes.items() for s in p], SCHEMA).repartition(3)


def test_flattened_paths_stay_near(spark, shapes, segments):
    rows = H.flattened(segments, ["id"]).orderBy("id", "seg", "step").collect()
    for i, path in shapes.items():
        want = [p for sub in walked(path, flat_parts) for p in zip(sub, sub[1:])]
        got = [((r.xa, r.ya), (r.xb, r.yb)) for r in rows if r.id == i]
        assert len(got) == len(want)
        for (a, b), (c, d) in zip(got, want):
            assert math.dist(a, c) < 1e-6 and math.dist(b, d) < 1e-6


def plain_hit(subs, x, y, w, h):
    if w <= 0 or h <= 0:
        return False
    winding, mx, my = 0, x + w / 2, y + h / 2
    for sub in subs:
        ring = [*sub, sub[0]]
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            t0, t1, ok = 0.0, 1.0, True
            for p, q in ((-(bx - ax), ax - x), (bx - ax, x + w - ax), (-(by - ay), ay - y), (by - ay, y + h - ay)):
                if p == 0:
                    ok &= q > 0
                elif p < 0:
                    t0 = max(t0, q / p)
                else:
                    t1 = min(t1, q / p)
            if ok and t0 < t1:  # part of the edge lies inside
                return True
            turn = (bx - ax) * (my - ay) - (by - ay) * (mx - ax)
            winding += 1 if ay <= my < by and turn > 0 else -1 if by <= my < ay and turn < 0 else 0
    return winding != 0


def test_hits_against_clipping(spark, shapes, segments):
    r = random.Random(3)
    rects = [(i, k, float(r.randint(-25, 40)), float(r.randint(-25, 40)), float(r.randint(0, 9)), float(r.randint(0, 9))) for i in shapes for k in range(12)]
    rects += [(999, 0, 0.0, 0.0, 5.0, 5.0)]  # no such shape
    df = spark.createDataFrame(rects, "id int, rect int, x double, y double, w double, h double")
    got = {(q.id, q.rect): q.hit for q in H.hits(segments, df, ["id"]).collect()}
    assert len(got) == len(rects) and not got[999, 0]
    for i, k, x, y, w, h in rects[:-1]:
        assert got[i, k] == plain_hit(walked(shapes[i], flat_parts), x, y, w, h), (i, k)
    assert 0.1 < sum(got.values()) / len(got) < 0.9


def test_drawn_paths_touch_their_points(spark, shapes, segments):
    rows = {}
    for q in H.draw_path(segments, ["id"]).collect():
        rows.setdefault(q.id, set()).add((q.x, q.y))
    for i, path in shapes.items():
        steps = lambda kind, ps: max({"Q": 8, "C": 12}[kind], int(math.dist(ps[0], ps[-1]) / 2))
        for sub in walked(path, steps):
            assert {(math.floor(x + 0.5), math.floor(y + 0.5)) for x, y in sub[1:]} <= rows[i]


# -- plans ----------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_of_one_picture_share_a_shuffle(spark, sf_dir):
    for df in (T.near_lossless(pixels(spark, sf_dir), 20, 8, 8, least=0), T.predicted_residual(pixels(spark, sf_dir), 10)):
        assert len(re.findall(r"Exchange ", plan(df))) == 1


def test_runs_are_not_filtered_sequences(spark, sf_dir):
    assert "filter(sequence" not in plan(P.resize_nearest(pixels(spark, sf_dir), 8, 8, 5, 13))
    assert "filter(sequence" not in plan(S.mask_downsample(pixels(spark, sf_dir).select(*P.KEYS), 8, 8, 5, 13))


def test_few_colours_are_gathered(spark, sf_dir):
    text = plan(S.sorted_palette(pixels(spark, sf_dir), 40))
    assert "WindowGroupLimit" in text and "collect_set" not in text


def test_instants_meet_frames_by_bucket(spark, sf_dir):
    instants = animation(spark, sf_dir).select("picture_id", F.col("frame_idx").alias("elapsed_ms"))
    text = plan(L.frame_at(animation(spark, sf_dir), instants))
    assert "schedule" not in text and "BroadcastNestedLoop" not in text and "Cartesian" not in text and re.search(r"Join \[[^\]]*picture_id[^\]]*, bucket", text)


def test_bilinear_shuffles_pixels_once(spark, sf_dir):
    text = plan(P.resize_bilinear(pixels(spark, sf_dir), 8, 8, 5, 11))
    assert len(re.findall(r"Exchange hashpartitioning\(picture_id", text)) == 1 and "Python" not in text


def test_edges_of_blocks_meet_in_one_grouping(spark, sf_dir):
    from rasterlake.operators import intra

    text = plan(intra.edges(intra.squares(pixels(spark, sf_dir), 4, v=F.col("r")), 4, "v"))
    assert "Join" not in text and len(re.findall(r"Exchange hashpartitioning", text)) == 2


def test_large_palettes_are_refused(spark):
    colors = spark.createDataFrame([(1, 2, 3)], "r int, g int, b int")
    palette = spark.range(257).selectExpr("cast(id as int) slot", "cast(id % 256 as int) r", "0 g", "0 b")
    assert S.nearest_slot(colors, palette.limit(256)).count() == 1
    with pytest.raises(Exception, match="at most 256"):
        S.nearest_slot(colors, palette).collect()
