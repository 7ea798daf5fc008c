"""Aggregates over pixels: histograms, palettes, tiles, masks, errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quantise
from ..functions.color import Argb, idiv, pack, quick_luma, unsigned


def color_histogram(px: DataFrame, width: int) -> DataFrame:
    """(picture_id, rgb, n, first_seen) of pixels that are not clear."""
    rgb = unsigned(pack(F.lit(0), F.col("r"), F.col("g"), F.col("b")))
    seen = px.filter("a <> 0").groupBy("picture_id", rgb.alias("rgb"))
    return seen.agg(F.count("*").alias("n"), F.min(F.col("y") * width + F.col("x")).alias("first_seen"))


def exact_palette(px: DataFrame, width: int, transparent_slot: int | None = None, most: int = 256) -> DataFrame:
    """Colours by first appearance, for pictures with few enough; a reserved slot is left free."""
    room = most - (transparent_slot is not None)
    found = color_histogram(px, width)
    slot = F.row_number().over(Window.partitionBy("picture_id").orderBy("first_seen")) - 1
    if transparent_slot is not None:
        slot = F.when(slot >= transparent_slot, slot + 1).otherwise(slot)
    fits = F.count("*").over(Window.partitionBy("picture_id")) <= room
    return found.select("picture_id", slot.alias("slot"), "rgb", "n", fits.alias("fits")).filter("fits").drop("fits")


def sorted_palette(px: DataFrame, most: int = 256) -> DataFrame:
    """Distinct packed colours in signed order; null where there are more than ``most``.

    Distinct colours come first, and no more than ``most`` + 1 of a picture are gathered.
    """
    colors = px.select("picture_id", pack(*Argb.of()).alias("c")).distinct()
    few = capped_colors(colors, most).groupBy("picture_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return colors.groupBy("picture_id").agg(F.count("*").cast("int").alias("n")).join(few, "picture_id").select("picture_id", "n", F.when(F.col("n") <= most, F.col("c")).alias("palette"))


def capped_colors(colors: DataFrame, most: int = 256) -> DataFrame:
    """The ``most`` + 1 least of each picture's distinct colours: enough to see that there are too many."""
    rank = F.row_number().over(Window.partitionBy("picture_id").orderBy("c"))
    return colors.withColumn("rank", rank).filter(F.col("rank") <= most + 1).drop("rank")


def color_cap(px: DataFrame, most: int = 256) -> DataFrame:
    """(picture_id, n, fits): distinct packed colours, counted up to ``most`` + 1."""
    few = capped_colors(px.select("picture_id", pack(*Argb.of()).alias("c")).distinct(), most)
    return few.groupBy("picture_id").agg(F.count("*").cast("int").alias("n")).withColumn("fits", F.col("n") <= most)


def nearest_slot(colors: DataFrame, palette: DataFrame) -> DataFrame:
    """For each distinct (r, g, b) the palette slot at the least squared distance, the first of equals.

    The palette has at most 256 entries (more are an error), so it is folded into one array that goes
    along with each row; the search is a scan of that array, not a join of rows.
    """
    entries = palette.limit(257).agg(F.array_sort(F.collect_list(F.struct("slot", F.col("r").alias("pr"), F.col("g").alias("pg"), F.col("b").alias("pb")))).alias("entries"))
    few = F.when(F.size("entries") <= 256, F.col("entries")).otherwise(F.raise_error(F.lit("a palette has at most 256 entries")))
    rows = colors.select("r", "g", "b").distinct().join(F.broadcast(entries.select(few.alias("entries"))))  # one row

    def far(e: Column) -> Column:
        d = [F.col(c) - e[f"p{c}"] for c in "rgb"]
        return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]

    best = F.array_min(F.transform("entries", lambda e: F.struct(far(e).alias("distance"), e["slot"].alias("slot"))))
    return rows.select("r", "g", "b", best["slot"].alias("slot"), best["distance"].alias("distance"))


def median_cut(histogram: DataFrame, capacity: int = 256) -> DataFrame:
    """(picture_id, slot, r, g, b): see ``quantise.median_cut``; colours come in the order of their first pixels."""
    import numpy as np
    import pandas as pd

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first_seen", kind="stable")
        rgb = rows["rgb"].to_numpy()
        colors = np.stack([rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255], axis=1)
        weight = rows["n"].to_numpy()
        means = quantise.median_cut(colors.astype(np.int64), weight, capacity)
        return pd.DataFrame({"picture_id": rows["picture_id"].iloc[0], "slot": np.arange(len(means)), **{c: [int(m[i]) for m in means] for i, c in enumerate("rgb")}})

    return histogram.groupBy("picture_id").applyInPandas(cut, "picture_id bigint, slot int, r int, g int, b int")


def palette_deltas(palette: DataFrame) -> DataFrame:
    """Each channel minus that of the slot before, modulo 256."""
    w = Window.partitionBy("picture_id").orderBy("slot")
    return palette.select("picture_id", "slot", *(((F.col(c) - F.lag(c, 1, 0).over(w) + 256) % 256).alias(c) for c in "argb"))


def palette_bits(n: Column) -> Column:
    return F.when(n <= 2, 1).when(n <= 4, 2).when(n <= 16, 4).otherwise(8)


def packed_indices(indexed: DataFrame, bits: int) -> DataFrame:
    """Palette indices (picture_id, x, y, slot) packed into bytes, lowest bits first."""
    per = 8 // bits
    value = F.sum(F.call_function("shiftleft", F.col("slot"), (F.col("x") % per) * bits)).cast("int")
    return indexed.groupBy("picture_id", "y", idiv(F.col("x"), per).alias("x")).agg(value.alias("packed"))


def mask_downsample(marks: DataFrame, width: int, height: int, w: int, h: int) -> DataFrame:
    """Marked cells of a smaller grid: a cell is marked if any pixel of its box is.

    Each mark is sent to the boxes it lies in, a run whose ends are closed forms.
    """

    def boxes(axis: str, was: int, size: int) -> Column:
        p = F.col(axis)
        # boxes that begin at or before p, from the first that ends behind it or begins on it
        last = F.least(F.lit(size - 1), idiv((p + 1) * size - 1, was))
        first = F.least(idiv((p + 1) * size + was - 1, was) - 1, idiv(p * size + was - 1, was))
        return F.when(first <= last, F.sequence(first, last))

    rows = marks.withColumn("ox", F.explode(boxes("x", width, w))).withColumn("oy", F.explode(boxes("y", height, h)))
    return rows.select("picture_id", F.col("ox").alias("x"), F.col("oy").alias("y")).distinct()


def tile_variance(px: DataFrame, tile: int = 16) -> DataFrame:
    """Scaled variance of the quick luma by tile: sum of squares less the squared sum over the count."""
    y = quick_luma(Argb.of()).cast("bigint")
    tiles = px.groupBy("picture_id", idiv(F.col("x"), tile).alias("tx"), idiv(F.col("y"), tile).alias("ty"))
    sums = tiles.agg(F.sum(y).alias("s"), F.sum(y * y).alias("q"), F.count("*").alias("n"))
    return sums.select("picture_id", "tx", "ty", F.expr("cast(q - (s * s) div n as int)").alias("variance"))


def tile_segments(variances: DataFrame, gate: int = 400) -> DataFrame:
    """Quartile segment 0-3 of each tile; 0 where the picture is too flat to split.

    A picture's cuts are one row, made once and joined to its tiles.
    """
    v = F.col("variance")
    ordered = variances.groupBy("picture_id").agg(F.array_sort(F.collect_list(v)).alias("o"), (F.max(v) - F.min(v) < gate).alias("flat"))
    cut = lambda k: F.element_at("o", F.expr(f"cast(size(o) * {k} div 4 + 1 as int)")).alias(f"c{k}")
    rows = variances.join(ordered.select("picture_id", "flat", cut(1), cut(2), cut(3)), "picture_id")
    segment = F.when(F.col("flat"), 0).when(v < F.col("c1"), 0).when(v < F.col("c2"), 1).when(v < F.col("c3"), 2).otherwise(3)
    return rows.select("picture_id", "tx", "ty", "variance", segment.alias("segment"))


def block_errors(pairs: DataFrame, size: int = 16) -> DataFrame:
    """Sums of absolute and squared differences of each block of two aligned pictures."""
    s, d = Argb.of("s"), Argb.of("d")
    delta = [(x - y).cast("bigint") for x, y in zip(s, d)]
    total = lambda f: F.sum(sum((f(x) for x in delta[1:]), F.lit(0)))
    blocks = pairs.groupBy("picture_id", idiv(F.col("x"), size).alias("bx"), idiv(F.col("y"), size).alias("by"))
    return blocks.agg(total(F.abs).alias("sad"), total(lambda x: x * x).alias("sse"))


def cross_color_fit(px: DataFrame, tile: int) -> DataFrame:
    """Least-squares multipliers of each tile, in 1/32: red and blue from green, then what is left of blue from red.

    Channels count as signed bytes, as the transform does; results are clamped to a signed byte.
    """
    from ..functions.color import signed_byte

    r, g, b = (signed_byte(F.col(c)).cast("bigint") for c in "rgb")
    rows = px.select("picture_id", idiv(F.col("x"), tile).alias("tx"), idiv(F.col("y"), tile).alias("ty"), r.alias("r"), g.alias("g"), b.alias("b"))
    keys = ["picture_id", "tx", "ty"]

    def fit(top: Column, bottom: Column) -> Column:
        value = F.floor(top * 32.0 / F.when(bottom != 0, bottom) + 0.5)
        return F.coalesce(F.least(F.lit(127), F.greatest(F.lit(-128), value)), F.lit(0)).cast("int")

    total = lambda e: F.sum(F.expr(e))
    sums = rows.groupBy(*keys).agg(total("g * g").alias("gg"), total("g * r").alias("gr"), total("g * b").alias("gb"), total("r * r").alias("rr"), total("r * b").alias("rb"))
    green = sums.withColumn("green_to_red", fit(F.col("gr"), F.col("gg"))).withColumn("green_to_blue", fit(F.col("gb"), F.col("gg")))
    left = F.col("rb") - F.col("green_to_blue") * F.col("gr") / 32.0
    return green.select(*keys, "green_to_red", "green_to_blue", fit(left, F.col("rr")).alias("red_to_blue"))


def largest_entry(entries: DataFrame) -> DataFrame:
    """(file, ord, width, height), a size of 0 meaning 256 -> the entry with the largest area, the first of equals."""
    w, h = (F.when(F.col(c) == 0, 256).otherwise(F.col(c)) for c in ("width", "height"))
    best = F.max_by(F.struct("ord", w.alias("width"), h.alias("height")), F.struct((w * h).alias("area"), (-F.col("ord")).alias("first")))
    return entries.groupBy("file").agg(best.alias("b")).select("file", "b.*")
