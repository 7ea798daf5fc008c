"""Where pixels come from and how they change shape.

``pixels`` rows are (picture_id, x, y, a, r, g, b); ``frames`` rows hold one
row-major array of packed colours.  A pixel that has no row is transparent black.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.color import Argb, blend, f32, idiv, pack

KEYS = ("picture_id", "x", "y")


def colored(px: DataFrame, f, *keep: str) -> DataFrame:
    """Each pixel's colour replaced by f of it."""
    return px.select(*(keep or KEYS), *f(Argb.of()).named())


# -- shape conversion ------------------------------------------------------------


def blank(spark: SparkSession, picture_id: int, width: int, height: int, argb: int = 0) -> DataFrame:
    cells = spark.range(height).select(F.col("id").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    return cells.select(F.lit(picture_id).cast("bigint").alias("picture_id"), "x", "y", *Argb.literal(argb).named())


def to_frames(px: DataFrame, width: int, height: int, *keys: str) -> DataFrame:
    """One row per picture with its colours in row-major order, laid out in one pass.

    Gaps are transparent, pixels outside are left out, and of several at one place the
    one with the largest packed colour stays.
    """
    import numpy as np
    import pyarrow as pa

    keys = keys or ("picture_id",)
    cell = F.struct((F.col("y") * width + F.col("x")).cast("int").alias("k"), pack(*Argb.of()).cast("int").alias("v"))
    rows = px.groupBy(*keys).agg(F.collect_list(F.when(contains(F.col("x"), F.col("y"), width, height), cell)).alias("cells"))

    def laid(batches):
        for batch in batches:
            cells = batch.column("cells")
            ends = cells.offsets.to_numpy().astype(np.int64)
            k, v = (cells.values.field(n).to_numpy() for n in "kv")
            for i in range(len(batch)):
                at, colors, out = k[ends[i] : ends[i + 1]], v[ends[i] : ends[i + 1]], np.zeros(width * height, np.int32)
                order = np.lexsort((colors, at))
                out[at[order]] = colors[order]
                sizes = [pa.array([n], pa.int32()) for n in (width, height)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in keys), *sizes, pa.array([out], pa.list_(pa.int32()))], names=[*keys, "width", "height", "argb"])

    kinds = dict(px.dtypes)
    return rows.mapInArrow(laid, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", width int, height int, argb array<int>")


def to_pixels(frames: DataFrame, *keys: str) -> DataFrame:
    keys = keys or ("picture_id",)
    rows = frames.select(*keys, "width", F.posexplode("argb").alias("i", "p"))
    return rows.select(*keys, (F.col("i") % F.col("width")).alias("x"), idiv(F.col("i"), F.col("width")).alias("y"), *Argb.unpacked(F.col("p")).named())


# -- point and region access --------------------------------------------------------


def region(px: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    return px.filter(F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1))


def contains(x: Column, y: Column, w: int, h: int) -> Column:
    return (x >= 0) & (y >= 0) & (x < w) & (y < h)


def put(px: DataFrame, changes: DataFrame) -> DataFrame:
    """Overwrite: changes win over px; of several changes to one pixel that with the largest ``ord`` wins."""
    last = changes.groupBy(*KEYS).agg(F.max_by(F.struct("a", "r", "g", "b"), "ord").alias("n"))
    joined = px.join(last, list(KEYS), "full")
    return joined.select(*KEYS, *(F.coalesce(F.col(f"n.{c}"), F.col(c)).cast("int").alias(c) for c in "argb"))


def crop(px: DataFrame, x: int, y: int, w: int, h: int, width: int, height: int) -> DataFrame:
    if w < 0 or h < 0 or x < 0 or y < 0 or x + w > width or y + h > height:
        raise ValueError(f"crop ({x},{y},{w},{h}) leaves {width}x{height}")
    return region(px, x, y, w, h).select("picture_id", (F.col("x") - x).alias("x"), (F.col("y") - y).alias("y"), "a", "r", "g", "b")


def moved(px: DataFrame, x: Column, y: Column) -> DataFrame:
    return px.select("picture_id", x.cast("int").alias("x"), y.cast("int").alias("y"), "a", "r", "g", "b")


def flip_horizontal(px: DataFrame, w: int, h: int) -> DataFrame:
    return moved(px, F.lit(w - 1) - F.col("x"), F.col("y"))


def flip_vertical(px: DataFrame, w: int, h: int) -> DataFrame:
    return moved(px, F.col("x"), F.lit(h - 1) - F.col("y"))


def rotate90(px: DataFrame, w: int, h: int) -> DataFrame:
    return moved(px, F.lit(h - 1) - F.col("y"), F.col("x"))


def rotate180(px: DataFrame, w: int, h: int) -> DataFrame:
    return moved(px, F.lit(w - 1) - F.col("x"), F.lit(h - 1) - F.col("y"))


def rotate270(px: DataFrame, w: int, h: int) -> DataFrame:
    return moved(px, F.col("y"), F.lit(w - 1) - F.col("x"))


def fill_rect(px: DataFrame, x: int, y: int, w: int, h: int, argb: int) -> DataFrame:
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return px.select(*KEYS, *(F.when(inside, v).otherwise(o).cast("int").alias(n) for v, o, n in zip(Argb.literal(argb), Argb.of(), "argb")))


def opaque_bounds(px: DataFrame, *keys: str) -> DataFrame:
    """Tightest box of pixels that are not clear; zeros where there is none."""
    keys = keys or ("picture_id",)
    x, y = (F.when(F.col("a") != 0, F.col(c)) for c in "xy")
    boxes = px.groupBy(*keys).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    zero = F.lit(0)
    size = [F.coalesce(F.col(b) - F.col(a) + 1, zero).alias(n) for a, b, n in (("x0", "x1", "width"), ("y0", "y1", "height"))]
    return boxes.select(*keys, F.coalesce("x0", zero).alias("x"), F.coalesce("y0", zero).alias("y"), *size)


def trim(px: DataFrame) -> DataFrame:
    """Crop to the opaque bounds; a picture without opaque pixels stays as it is."""
    w = Window.partitionBy("picture_id")
    x, y = (F.when(F.col("a") != 0, F.col(c)) for c in "xy")
    boxed = px.withColumns({"x0": F.min(x).over(w), "x1": F.max(x).over(w), "y0": F.min(y).over(w), "y1": F.max(y).over(w)})
    inside = F.col("x0").isNull() | (F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return moved(boxed.filter(inside), F.col("x") - F.coalesce("x0", F.lit(0)), F.col("y") - F.coalesce("y0", F.lit(0)))


# -- resampling ----------------------------------------------------------------------


def _targets(px: DataFrame, size: int, was: int, axis: str) -> Column:
    """All target places that take their value from this source place: a run, whose ends are closed forms; null if there is none."""
    s = F.col(axis)
    first, after = (idiv(p * size + was - 1, was) for p in (s, s + 1))
    return F.when(first < after, F.sequence(first, after - 1))


def resize_nearest(px: DataFrame, width: int, height: int, w: int, h: int) -> DataFrame:
    """Every source pixel is sent to the targets that read it: no join, no shuffle."""
    if w <= 0 or h <= 0:
        raise ValueError("sizes must be positive")
    rows = px.withColumn("tx", F.explode(_targets(px, w, width, "x"))).withColumn("ty", F.explode(_targets(px, h, height, "y")))
    return moved(rows, F.col("tx"), F.col("ty"))


def in_order(px: DataFrame, width: int, height: int) -> DataFrame:
    """(picture_id, argb): colours in row-major order, on the JVM; gaps are clear, of several at one place the largest colour stays."""
    cell = F.struct((F.col("y") * width + F.col("x")).cast("int").alias("k"), pack(*Argb.of()).cast("int").alias("v"))
    inside = F.when(contains(F.col("x"), F.col("y"), width, height), cell)
    rows = px.groupBy("picture_id").agg(F.array_sort(F.collect_list(inside)).alias("cells"))
    last = F.filter("cells", lambda c, i: F.coalesce(F.get("cells", i + 1)["k"] != c["k"], F.lit(True)))
    rows = rows.select("picture_id", F.map_from_entries(last).alias("at"))
    every = F.sequence(F.lit(0), F.lit(width * height - 1))
    return rows.select("picture_id", F.transform(every, lambda k: F.coalesce(F.element_at("at", k), F.lit(0))).alias("argb"))


def resize_bilinear(px: DataFrame, width: int, height: int, w: int, h: int) -> DataFrame:
    """Half-pixel centres, four taps, truncated: each target gathers its taps from the picture's colours in order.

    Pixels are shuffled once, by picture; a picture without pixels has no targets.
    """
    if width < 2 or height < 2:
        raise ValueError("bilinear needs two pixels each way")

    def place(t: Column, size: int, was: int) -> tuple[Column, Column]:
        """(lower tap, share of the upper one) of a target place."""
        at = ((((f32(t) + f32(0.5)) * f32(was)) / f32(size)).cast("float") - f32(0.5)).cast("float")
        low = F.floor(at).cast("int")
        return F.least(F.lit(was - 2), F.greatest(F.lit(0), low)), (at - f32(low)).cast("float")

    def table(size: int, was: int) -> Column:
        low, part = place(F.col("id"), size, was)
        return F.struct(F.col("id").cast("int").alias("t"), low.alias("low"), part.alias("part"))

    def axis(n: str, size: int, was: int) -> DataFrame:
        return px.sparkSession.range(size).select(table(size, was).alias(n))

    # one row for each target column and row: their size is the picture's, not the data's
    grid = axis("ty", h, height).join(F.broadcast(axis("tx", w, width))).agg(F.collect_list(F.struct("tx", "ty")).alias("grid"))
    rows = in_order(px, width, height).join(F.broadcast(grid)).select("picture_id", "argb", F.explode("grid").alias("g")).select("picture_id", "argb", "g.*")
    x, y = F.col("tx.part"), F.col("ty.part")
    first = F.col("ty.low") * width + F.col("tx.low")
    rows = rows.select("picture_id", F.col("tx.t").alias("x"), F.col("ty.t").alias("y"), x.alias("px"), y.alias("py"), *(F.get("argb", first + d).alias(f"t{k}") for k, d in enumerate((0, 1, width, width + 1))))
    side = lambda part, upper: F.col(part) if upper else (f32(1) - F.col(part)).cast("float")
    weights = [(side("px", k % 2) * side("py", k // 2)).cast("float") for k in range(4)]
    taps = [Argb.unpacked(F.col(f"t{k}")) for k in range(4)]

    def total(c: str) -> Column:
        out = f32(0)
        for tap, weight in zip(taps, weights):
            out = (out + (f32(getattr(tap, c)) * weight).cast("float")).cast("float")
        return out

    return rows.select("picture_id", "x", "y", *(F.least(F.lit(255), F.greatest(F.lit(0), total(c).cast("int"))).alias(c) for c in "argb"))


# -- compositing -------------------------------------------------------------------------


def checkerboard(x: Column, y: Column, argb0: int = 0xFF202024, argb1: int = 0xFF181820, cell: int = 8) -> Argb:
    if cell < 1:
        raise ValueError("cells are at least one pixel")
    even = (idiv(x, cell) + idiv(y, cell)) % 2 == 0
    return Argb(*(F.when(even, p).otherwise(q) for p, q in zip(Argb.literal(argb0), Argb.literal(argb1))))


def over_background(px: DataFrame, background) -> DataFrame:
    """Each pixel over a background that is an expression of (x, y): no join."""
    bg = background(F.col("x"), F.col("y"))
    return px.select(*KEYS, *blend(Argb.of(), bg).named())


def _blitted(mode: str, opaque_source: bool) -> list[Column]:
    s, d = Argb.of("s"), Argb.of("d")
    copied = mode == "normal" and opaque_source
    out = s if copied else blend(s, d, mode)
    hit = F.col("sa").isNotNull() if copied else F.col("sa").isNotNull() & (F.col("sa") != 0)
    return [F.when(hit, o).otherwise(t).cast("int").alias(n) for o, t, n in zip(out, d, "argb")]


def blit(target: DataFrame, source: DataFrame, dx: int = 0, dy: int = 0, mode: str = "normal", opaque_source: bool = False) -> DataFrame:
    """Source pixels over target pixels at an offset; clear source pixels are skipped whatever the mode."""
    s = source.select("picture_id", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), *(F.col(c).alias(f"s{c}") for c in "argb"))
    t = target.select(*KEYS, *(F.col(c).alias(f"d{c}") for c in "argb"))
    return t.join(s, list(KEYS), "left").select(*KEYS, *_blitted(mode, opaque_source))


def blit_scaled(target: DataFrame, source: DataFrame, dx: int, dy: int, dw: int, dh: int, width: int, height: int) -> DataFrame:
    """Nearest-scaled source over the target."""
    return blit(target, resize_nearest(source, width, height, dw, dh), dx, dy)


def paired(first: DataFrame, second: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of two pictures side by side: sa..sb of the first, da..db of the second."""
    s = first.select(*KEYS, *(F.col(c).alias(f"s{c}") for c in "argb"))
    d = second.select(*KEYS, *(F.col(c).alias(f"d{c}") for c in "argb"))
    return s.join(d, list(KEYS), how)


def paired_frames(first: DataFrame, frames: DataFrame) -> DataFrame:
    """``paired`` with frames (picture_id, width, height, argb) as the second: each pixel looks its place up in the frame.

    Both sides are shuffled by picture: sizes behind Python are guesses, and a guess too low would send every pixel through the driver.
    """
    s = first.select(*KEYS, *(F.col(c).alias(f"s{c}") for c in "argb"))
    met = s.join(frames.select("picture_id", "width", "height", "argb").hint("merge"), "picture_id")
    inside = met.filter(contains(F.col("x"), F.col("y"), F.col("width"), F.col("height")))
    color = Argb.unpacked(F.get("argb", (F.col("y") * F.col("width") + F.col("x")).cast("int")))
    return inside.select(*KEYS, *(f"s{c}" for c in "argb"), *(v.alias(f"d{c}") for c, v in zip("argb", color)))
