"""Every registered raster query against its SQL."""

import pytest

from conftest import rows_of
from rasterlake.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(name, spark, duck, sf_dir):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(name, spark, sf_dir):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


#: Queries whose whole plan is to stay on the JVM, by the beginnings of their names.
JVM_SIDE = (
    "px_", "blend_", "blit_", "diff_", "geo_", "lerp", "canvas_over", "near_lossless", "predictor_", "tile_", "mask_downsample", "frame_at_time", "palette_bits", "palette_nearest", "color_cap",
    "intra_small", "token_", "quantise_", "motion_vote", "path_", "draw_line", "draw_fill_polygon", "luma_histogram", "opaque_bounds", "forward_", "inverse_",
)


def test_no_python_in_pixel_plans(spark, sf_dir):
    names = [n for n in catalog.queries() if n.startswith(JVM_SIDE)]
    assert len(names) > 60
    for name in names:
        plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "InArrow", "Cartesian")), name


def test_jpeg_error_sends_no_pixels_through_the_driver(spark, sf_dir):
    plan = catalog.queries()["jpeg_error"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "picture_id" in plan


def test_paired_frames_equal_paired_pixels(spark):
    """Repeated places, places outside and pictures of one side only."""
    from rasterlake.operators import pixels as P

    px = spark.createDataFrame([(k, x, y, 255, x, y, k) for k in (1, 2) for x in range(3) for y in range(3)] + [(1, 0, 0, 1, 2, 3, 4), (1, -1, 1, 1, 1, 1, 1)], "picture_id bigint, x int, y int, a int, r int, g int, b int")
    frames = spark.createDataFrame([(1, 2, 2, [-1, 5, -16777216, 7]), (3, 1, 1, [9])], "picture_id bigint, width int, height int, argb array<int>")
    want, got = P.paired(px, P.to_pixels(frames)), P.paired_frames(px, frames)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() == 5
