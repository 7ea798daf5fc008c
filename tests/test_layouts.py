"""Edge cases of layouts, masks and block transforms."""

import numpy as np
from pyspark.sql import functions as F

from rasterlake.functions import layouts as Y
from rasterlake.functions import lossy as V
from rasterlake.operators import blocks as B
from rasterlake.operators import masks as M


def test_short_bytes_and_unknown_indexes_are_null(spark):
    one = spark.range(1).select(F.unhex(F.lit("0102030405")).alias("c"), F.expr("array(-1, 0)").alias("p"))
    assert tuple(one.select(*Y.bytes_bgr(F.col("c"), F.lit(0)).named()).first()) == (255, 3, 2, 1)
    assert tuple(one.select(*Y.bytes_bgr(F.col("c"), F.lit(1)).named()).first()) == (255, None, 5, 4)
    assert tuple(one.select(*Y.bytes_abgr(F.col("c"), F.lit(0)).named()).first()) == (1, 4, 3, 2)
    assert tuple(one.select(*Y.indexed(F.lit(1), F.col("p")).named()).first()) == (0, 0, 0, 0)
    assert tuple(one.select(*Y.indexed(F.lit(2), F.col("p")).named()).first()) == (None,) * 4
    assert tuple(one.select(V.ac_step(F.lit(128)), V.filter_level(F.lit(0)), V.filter_level(F.lit(127))).first()) == (None, 0, 63)


def test_masks(spark):
    px = spark.createDataFrame([(1, x, 0, 255, x, x, x) for x in range(3)], "picture_id bigint, x int, y int, a int, r int, g int, b int")
    none = px.filter("false").select("picture_id", "x", "y")
    places = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (1, 3, 0), (1, -1, 0), (1, 2, 1), (2, 0, 0)], "picture_id bigint, x int, y int")
    marks = M.mark(none, places, 3, 1)
    assert sorted(map(tuple, marks.collect())) == [(1, 0, 0), (2, 0, 0)]
    attached = M.attach(M.attach(px, places), none)
    assert [r.marked for r in attached.collect()] == [False] * 3
    assert sorted((r.x, r.marked) for r in M.enable(M.attach(px, marks)).collect()) == [(0, True), (1, False), (2, False)]
    assert M.clear(attached).columns == px.columns


def test_transforms_undo_each_other(spark):
    r = np.random.default_rng(3)
    rows = [(k, r.integers(-255, 256, 16).tolist()) for k in range(200)]
    table = spark.createDataFrame(rows, "id int, v array<int>")
    got = table.select("v", B.inverse_dct(B.forward_dct(F.col("v"))).alias("d"), B.inverse_wht(B.forward_wht(F.col("v"))).alias("w")).collect()
    assert max(np.abs(np.subtract(x.v, x.d)).max() for x in got) <= 2
    assert max(np.abs(np.subtract(x.v, x.w)).max() for x in got) <= 1


def test_blocks_fill_missing_pixels(spark):
    px = spark.createDataFrame([(1, 5, 2, 9)], "picture_id bigint, x int, y int, r int")
    row = B.gathered(px, F.col("r")).first()
    assert (row.tx, row.ty, row.block) == (1, 0, [0] * 9 + [9] + [0] * 6)
