"""Frames in time: delays, the frame at an instant, changes between frames, the canvas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.color import Argb, f32, idiv, lerp, over, pack


def _by_frame() -> WindowSpec:
    return Window.partitionBy("picture_id").orderBy("frame_idx")


def total_duration(frames: DataFrame) -> DataFrame:
    return frames.groupBy("picture_id").agg(F.sum("delay_ms").cast("bigint").alias("total_ms"), F.count("*").alias("frames"))


def quantized_delays(frames: DataFrame, minimum: int) -> DataFrame:
    """Delays in hundredths that keep the running total on time; none is below the minimum (1 exact, 2 playable).

    Closed form of the carry: emitted_i = m*i + max(0, max_{j<=i}(B_j - m*j)), B the rounded running total.
    """
    i = F.row_number().over(_by_frame())
    due = F.floor(F.sum("delay_ms").over(_by_frame()) / 10.0 + 0.5).cast("bigint")
    rows = frames.withColumn("i", i).withColumn("due", due)
    emitted = F.col("i") * minimum + F.greatest(F.lit(0), F.max(F.col("due") - F.col("i") * minimum).over(_by_frame()))
    rows = rows.withColumn("emitted", emitted)
    return rows.select("picture_id", "frame_idx", (F.col("emitted") - F.lag("emitted", 1, 0).over(_by_frame())).cast("bigint").alias("delay_cs"))


def frame_at(frames: DataFrame, instants: DataFrame, interpolate: bool = False) -> DataFrame:
    """(picture_id, elapsed_ms) -> frame_idx, next_idx and share of the next frame (null if not between two).

    A picture's time is cut into as many buckets as it has frames.  A frame goes to the
    buckets it lies in, two on average at most, and an instant to its own: they meet by
    an equi-join on (picture, bucket), so neither carries a schedule, and the instants
    of one picture are dealt out by bucket.
    """
    stop = F.sum("delay_ms").over(_by_frame())
    rows = frames.select("picture_id", "frame_idx", "delay_ms", stop.alias("stop"), F.lead("frame_idx").over(_by_frame()).alias("after"))
    totals = rows.groupBy("picture_id").agg(F.sum("delay_ms").alias("total"), F.count("*").alias("n"), F.min("frame_idx").alias("first"))
    width = F.greatest(F.lit(1), F.expr("total div n")).cast("bigint")
    totals = totals.withColumn("width", width)
    bucket = lambda t: F.greatest(F.lit(0), F.call_function("div", t, F.col("width"))).cast("bigint")
    shown = rows.filter("delay_ms > 0").join(totals.select("picture_id", "width"), "picture_id").withColumn("start", F.col("stop") - F.col("delay_ms"))
    shown = shown.select("picture_id", "frame_idx", "delay_ms", "start", "stop", "after", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("stop") - 1))).alias("bucket"))
    met = instants.select("picture_id", "elapsed_ms").join(totals, "picture_id").withColumn("t", F.when(F.col("total") > 0, F.col("elapsed_ms") % F.when(F.col("total") > 0, F.col("total"))))
    met = met.withColumn("bucket", bucket(F.col("t"))).alias("i")
    hit = (F.col("i.picture_id") == F.col("s.picture_id")) & (F.col("i.bucket") == F.col("s.bucket")) & (F.col("t") < F.col("stop")) & ((F.col("t") >= F.col("start")) | (F.col("start") == 0))
    met = met.join(shown.alias("s"), hit, "left")
    here = F.coalesce(F.col("frame_idx"), F.col("first"))
    if not interpolate:
        return met.select("i.picture_id", "elapsed_ms", here.alias("frame_idx"))
    span = F.col("t") - F.col("start")
    share = span / F.col("delay_ms").cast("double")
    after = F.coalesce("after", "first")
    whole = F.col("frame_idx").isNull() | (F.col("n") == 1) | (span <= 0)
    return met.select(
        "i.picture_id",
        "elapsed_ms",
        F.when(~whole & (share >= 0.999), after).otherwise(here).alias("frame_idx"),
        F.when(~whole & (share < 0.999), after).alias("next_idx"),
        F.when(~whole & (share < 0.999), share).alias("share"),
    )


def interpolated(at: DataFrame, px: DataFrame) -> DataFrame:
    """Pixels of each instant: of its frame, or mixed with the next."""
    first = at.join(px, ["picture_id", "frame_idx"])
    second = px.select("picture_id", F.col("frame_idx").alias("next_idx"), "x", "y", *(F.col(c).alias(f"n{c}") for c in "argb"))
    both = first.join(second, ["picture_id", "next_idx", "x", "y"], "left")
    p, q = Argb.of(), Argb.of("n")
    mixed = lerp(p, q, f32(F.col("share")))
    return both.select("picture_id", "elapsed_ms", "x", "y", *(F.when(F.col("na").isNull(), u).otherwise(m).cast("int").alias(n) for u, m, n in zip(p, mixed, "argb")))


def keyframe_interval(option: Column, frames: Column) -> Column:
    """-1 asks for a default: 30 for long animations, else none."""
    return F.when(option != -1, option).otherwise(F.when(frames > 60, 30).otherwise(0))


def is_keyframe(frame_idx: Column, every: Column) -> Column:
    return (frame_idx == 0) | ((every > 0) & (frame_idx % F.when(every > 0, every) == 0))


def frame_flags(disposal: Column, blend: Column) -> Column:
    return F.when(disposal == "RESTORE_TO_BACKGROUND", 1).otherwise(0).bitwiseOR(F.when(blend == "SOURCE", 2).otherwise(0))


def changed_boxes(px: DataFrame) -> DataFrame:
    """Box of pixels that differ from the frame before, its corner moved to even places; a 1x1 box where none does."""
    w = Window.partitionBy("picture_id", "x", "y").orderBy("frame_idx")
    p = pack(*Argb.of())
    rows = px.select("picture_id", "frame_idx", "x", "y", p.alias("p"), F.lag(p).over(w).alias("before"))
    x, y = (F.when(F.col("p") != F.col("before"), F.col(c)) for c in "xy")
    boxes = rows.filter(F.col("before").isNotNull()).groupBy("picture_id", "frame_idx").agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))
    even = {c: F.coalesce(F.col(f"{c}0") - F.col(f"{c}0") % 2, F.lit(0)) for c in "xy"}
    size = [F.coalesce(F.col(f"{c}1") - even[c] + 1, F.lit(1)).alias(n) for c, n in (("x", "width"), ("y", "height"))]
    return boxes.select("picture_id", "frame_idx", even["x"].alias("x"), even["y"].alias("y"), *size, F.col("x0").isNotNull().alias("changed"))


def canvas_source(px: DataFrame, grid: DataFrame) -> DataFrame:
    """Frames laid on a canvas by plain copy: at each place the last frame that has a pixel there."""
    w = Window.partitionBy("picture_id", "x", "y").orderBy("frame_idx")
    rows = grid.join(px, ["picture_id", "frame_idx", "x", "y"], "left")
    last = [F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0)).cast("int").alias(c) for c in "argb"]
    return rows.select("picture_id", "frame_idx", "x", "y", *last)


def canvas_over(px: DataFrame, background: int = 0) -> DataFrame:
    """Last canvas after all frames are laid over each other with alpha, in order of frame_idx.

    Truncation makes the step non-associative, so each place folds its frames in order.
    """
    steps = px.groupBy("picture_id", "x", "y").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "a", "r", "g", "b"))).alias("steps"))
    start = F.struct(*(c.cast("int").alias(n) for c, n in zip(Argb.literal(background), "argb")))

    def step(acc: Column, s: Column) -> Column:
        out = over(Argb(*(s[c] for c in "argb")), Argb(*(acc[c] for c in "argb")))
        return F.struct(*(c.cast("int").alias(n) for c, n in zip(out, "argb")))

    return steps.select("picture_id", "x", "y", F.aggregate("steps", start, step).alias("p")).select("picture_id", "x", "y", "p.a", "p.r", "p.g", "p.b")


def fit_geometry(sizes: DataFrame, fit: str = "contain", upscale: bool = False, width: int = 0, height: int = 0) -> DataFrame:
    """(picture_id, frame_idx, width, height) -> canvas size and the place and size of the drawn frame.

    Without a size the canvas is the smallest frame width by the smallest height.
    """
    w = Window.partitionBy("picture_id")
    cw = F.lit(width) if width > 0 else F.min("width").over(w)
    ch = F.lit(height) if height > 0 else F.min("height").over(w)
    rows = sizes.withColumn("canvas_w", cw).withColumn("canvas_h", ch)
    sw, sh = F.col("width"), F.col("height")
    cw, ch = F.col("canvas_w"), F.col("canvas_h")
    copied = (sw == cw) & (sh == ch) if fit != "cover" else F.lit(False)
    if fit == "stretch":
        dw, dh = (cw, ch) if upscale else (F.least(cw, sw), F.least(ch, sh))
    else:
        pick = F.greatest if fit == "cover" else F.least
        scale = pick(cw / sw.cast("double"), ch / sh.cast("double"))
        scale = scale if upscale else F.least(F.lit(1.0), scale)
        dw, dh = (F.greatest(F.lit(1), F.floor(s * scale + 0.5).cast("int")) for s in (sw, sh))
    rows = rows.withColumn("draw_w", dw.cast("int")).withColumn("draw_h", dh.cast("int"))
    return rows.select("picture_id", "frame_idx", "canvas_w", "canvas_h", "draw_w", "draw_h", idiv(cw - F.col("draw_w"), 2).alias("draw_x"), idiv(ch - F.col("draw_h"), 2).alias("draw_y"), copied.alias("copied"))


def runs(px: DataFrame, *keys: str) -> DataFrame:
    """Maximal runs of equal neighbours along each row of pixels."""
    keys = keys or ("picture_id", "y")
    w = Window.partitionBy(*keys).orderBy("x")
    p = pack(*Argb.of())
    rows = px.select(*keys, "x", p.alias("p"))
    fresh = F.lag("p").over(w).isNull() | (F.lag("p").over(w) != F.col("p"))
    rows = rows.withColumn("run", F.sum(fresh.cast("int")).over(w))
    return rows.groupBy(*keys, "run").agg(F.min("x").alias("start"), F.count("*").alias("length")).drop("run")


def parsed_disposal(value: Column) -> Column:
    """Disposal of a wire number 0-3 or a name in either spelling; NONE for all else."""
    names = ["NONE", "DO_NOT_DISPOSE", "RESTORE_TO_BACKGROUND", "RESTORE_TO_PREVIOUS"]
    name = F.upper(F.trim(value.cast("string")))
    number = F.create_map(*(F.lit(v) for i, n in enumerate(names) for v in (str(i), n)))
    spelled = F.create_map(*(F.lit(v) for n in names for v in (n, n)))
    plain = F.replace(name, F.lit("RESTORETO"), F.lit("RESTORE_TO_"))
    plain = F.when(plain == "DONOTDISPOSE", "DO_NOT_DISPOSE").otherwise(plain)
    return F.coalesce(number[name], spelled[plain], F.lit("NONE"))


def parsed_blend(value: Column) -> Column:
    """Blend of a wire number: 1 is OVER, all else SOURCE."""
    return F.when(value == 1, "OVER").otherwise("SOURCE")


def first_frames(frames: DataFrame) -> DataFrame:
    return frames.filter("frame_idx = 0")


def appended(frames: DataFrame, more: DataFrame) -> DataFrame:
    """More frames after the last of each animation, in their own order."""
    last = frames.groupBy("picture_id").agg(F.max("frame_idx").alias("last"))
    moved = more.join(last, "picture_id", "left").withColumn("frame_idx", (F.col("frame_idx") + F.coalesce(F.col("last") + 1, F.lit(0))).cast("int"))
    return frames.unionByName(moved.drop("last"))
