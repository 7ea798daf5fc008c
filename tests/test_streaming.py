import numpy as np
from pyspark.sql import functions as F

from rasterlake.sources import plain
from rasterlake.sources.model import Frame, Picture
from rasterlake.streaming import sessions

SCHEMA = "picture_id bigint, frame_idx int, width int, height int, argb array<int>, ts timestamp, delay_ms int"


def _land(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{name}")


def test_delta_stream_keeps_the_last_frame(spark, tmp_path):
    import datetime as dt

    base = np.zeros(64, np.int32)
    one = base.copy()
    one[27] = 5
    t = dt.datetime(2024, 1, 1)
    _land(spark, tmp_path, [(1, 0, 8, 8, base.tolist(), t, 10), (1, 1, 8, 8, one.tolist(), t, 10)], "a")
    _land(spark, tmp_path, [(1, 2, 8, 8, one.tolist(), t, 10), (1, 3, 8, 8, base.tolist(), t, 10)], "b")
    frames = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = sessions.delta_stream(frames).writeStream.format("memory").queryName("deltas").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/_c").start()
    q.awaitTermination(120)
    got = {r.frame_idx: (r.x, r.y, r.width, r.height, r.keyframe) for r in spark.table("deltas").collect()}
    assert got == {0: (0, 0, 8, 8, True), 1: (2, 2, 2, 2, False), 2: (0, 0, 1, 1, False), 3: (2, 2, 2, 2, False)}


def test_windows_count_frames(spark, tmp_path):
    import datetime as dt

    rows = [(k % 2, k, 1, 1, [0], dt.datetime(2024, 1, 1, 0, 0, k), 5) for k in range(20)]
    _land(spark, tmp_path, rows, "a")
    frames = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    q = sessions.frames_per_window(frames, "ts", "10 seconds", "5 seconds").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/_c").start()
    q.awaitTermination(120)
    assert sorted((r.frames, r.shown_ms) for r in spark.table("windows").collect()) == [(5, 25)] * 4


def test_watched_folder_decodes_and_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.qoi").write_bytes(plain.write_qoi(Picture([Frame(np.full((2, 3), 0xFF010203, np.uint32))])))
    (tmp_path / "in" / "b.bin").write_bytes(b"no picture")
    q = sessions.watch_folder(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("landed").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/_c").start()
    q.awaitTermination(120)
    rows = spark.table("landed").collect()
    assert sorted((r.width or 0) for r in rows) == [0, 3] and sum(r.error is not None for r in rows) == 1


def test_composed_clears_and_blends(spark):
    rows = [
        (1, 0, 2, 1, 0, 0, 10, "RESTORE_TO_BACKGROUND", "SOURCE", [-1, -1]),
        (1, 1, 1, 1, 1, 0, 10, "NONE", "OVER", [-0x80000000 + 0x00FF0000]),
    ]
    frames = spark.createDataFrame(rows, "picture_id bigint, frame_idx int, width int, height int, offset_x int, offset_y int, delay_ms int, disposal string, blend string, argb array<int>")
    got = {r.frame_idx: [v & 0xFFFFFFFF for v in r.argb] for r in sessions.composed(frames, 2, 1).collect()}
    assert got == {0: [0xFFFFFFFF, 0xFFFFFFFF], 1: [0, 0x80FF0000]}


def test_vectors_of_colour_math(spark):
    from rasterlake.functions import color as C

    p, q = C.Argb.literal(0xFFC8C8C8), C.Argb.literal(0xFF202020)
    row = spark.range(1).select(
        C.blend(p, p, "multiply").r.alias("m"), C.blend(p, q, "quadratic_add").r.alias("q"),
        C.blend(C.Argb.literal(0xFF646464), C.Argb.literal(0xFF646464), "overlay").r.alias("o"), C.blend(C.Argb.literal(0xFF9C9C9C), C.Argb.literal(0xFF9C9C9C), "overlay").r.alias("o2"),
        C.unsigned(C.invert(C.Argb.literal(0x80112233)).packed()).alias("i"), C.multiply_alpha(C.Argb.literal(0xFF112233), 0.5).a.alias("a"),
        F.lit(1),
    ).first()
    assert (row.m, row.q, row.o, row.o2, row.i, row.a) == (157, 189, 78, 178, 0x80EEDDCC, 128)
