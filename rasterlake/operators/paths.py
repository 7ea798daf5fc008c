"""Paths of lines and curves as rows of segments: drawn, flattened, filled, and met with rectangles.

``segments`` rows are (keys..., seg, kind, xs, ys): seg orders a shape's segments; kind is M
(move), L (line), Q (quadratic), C (cubic) or Z (close); xs and ys are arrays of the
points that a segment names, its end last (Z: none).  Coordinates are doubles.
"""

from __future__ import annotations

from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .drawing import draw_line, fill_polygon

#: Steps of a drawn curve: half the distance of its ends, and at least so many.
_LEAST_STEPS = {"Q": 8, "C": 12}
_MOST_HALVINGS = 10


def _near(v: Column) -> Column:
    """The nearest whole number, halves up."""
    return F.floor(v + 0.5).cast("int")


def placed(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with where they begin (x0, y0), where they end (x1, y1) and the number of their sub-path."""
    w = Window.partitionBy(*keys).orderBy("seg")
    end = lambda c: F.element_at(c, -1).cast("double")
    moves = F.when(F.col("kind") == "M", F.struct(end("xs").alias("x"), end("ys").alias("y")))
    rows = segments.withColumns({"_begun": F.last(moves, ignorenulls=True).over(w), "sub": F.sum((F.col("kind") == "M").cast("int")).over(w).cast("int")})
    rows = rows.withColumn("_end", F.when(F.col("kind") == "Z", F.col("_begun")).otherwise(F.struct(end("xs").alias("x"), end("ys").alias("y"))))
    before = F.lag("_end").over(w)
    start = F.coalesce(before, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    rows = rows.withColumn("_from", start)
    return rows.select(*keys, "seg", "kind", "sub", "xs", "ys", F.col("_from.x").alias("x0"), F.col("_from.y").alias("y0"), F.col("_end.x").alias("x1"), F.col("_end.y").alias("y1"))


def _along(kind: str, t: Column, axis: str) -> Column:
    """A coordinate of a segment at t from 0 to 1."""
    controls = {"L": 0, "Q": 1, "C": 2}[kind]
    degree = controls + 1
    points = [F.col(f"{axis}0"), *(F.col(f"{axis}s")[k].cast("double") for k in range(controls)), F.col(f"{axis}1")]
    u = F.lit(1.0) - t
    terms = [reduce(lambda a, b: a * b, [t] * k + [u] * (degree - k), F.lit(float(comb(degree, k)))) * p for k, p in enumerate(points)]
    return reduce(lambda a, b: a + b, terms)


def _chain(rows: DataFrame, keys: list[str], kind: str, steps: Column) -> DataFrame:
    """(keys..., seg, sub, step, xa, ya, xb, yb): a kind of segment as a chain of lines."""
    at = lambda i, name: [_along(kind, i.cast("double") / F.col("_steps"), a).alias(f"{a}{name}") for a in "xy"]
    rows = rows.withColumn("_steps", steps.cast("int")).withColumn("step", F.explode(F.sequence(F.lit(1), F.col("_steps"))))
    return rows.select(*keys, "seg", "sub", "step", *at(F.col("step") - 1, "a"), *at(F.col("step"), "b"))


def _lines(rows: DataFrame, keys: list[str], steps: dict[str, Column]) -> DataFrame:
    straight = rows.filter(F.col("kind").isin("L", "Z")).select(*keys, "seg", "sub", F.lit(1).alias("step"), F.col("x0").alias("xa"), F.col("y0").alias("ya"), F.col("x1").alias("xb"), F.col("y1").alias("yb"))
    return reduce(DataFrame.unionByName, [_chain(rows.filter(F.col("kind") == k), keys, k, n) for k, n in steps.items()], straight)


def draw_path(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys..., x, y) of all lines and curves; ends of lines are rounded."""
    far = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    steps = {k: F.greatest(F.lit(n), F.floor(far / 2)) for k, n in _LEAST_STEPS.items()}
    lines = _lines(placed(segments, keys), keys, steps)
    ends = lines.select(*keys, *(_near(F.col(c)).alias(c) for c in ("xa", "ya", "xb", "yb")))
    return draw_line(ends, keys, F.col("xa"), F.col("ya"), F.col("xb"), F.col("yb")).distinct()


def _halvings(bend: Column, flatness: float) -> Column:
    """Parts, a power of two, of a curve whose greatest distance from its chord is ``bend``; each halving quarters it."""
    return F.pow(F.lit(2), F.least(F.lit(_MOST_HALVINGS), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(bend, F.lit(1e-9)) / flatness) / 2))))


def flattened(segments: DataFrame, keys: list[str], flatness: float = 1.0) -> DataFrame:
    """(keys..., seg, sub, step, xa, ya, xb, yb): the path as lines that stay within ``flatness`` of it, closing ones included.

    A curve is cut into a power of two of equal parts of t, at most 1,024.
    """
    second = lambda a, p, q, r: F.abs(p - 2 * q + r)  # noqa: ARG005, E731
    control = lambda a, k: F.col(f"{a}s")[k].cast("double")
    quad = F.hypot(*(second(a, F.col(f"{a}0"), control(a, 0), F.col(f"{a}1")) for a in "xy")) / 4
    cubic = F.greatest(F.hypot(*(second(a, F.col(f"{a}0"), control(a, 0), control(a, 1)) for a in "xy")), F.hypot(*(second(a, control(a, 0), control(a, 1), F.col(f"{a}1")) for a in "xy"))) * 0.75
    return _lines(placed(segments, keys), keys, {"Q": _halvings(quad, flatness), "C": _halvings(cubic, flatness)})


def fill_path(segments: DataFrame, keys: list[str], flatness: float = 1.0) -> DataFrame:
    """Pixels of the flattened path filled even-odd; all sub-paths are strung together as one polygon, in order, and closing lines add no points."""
    lines = flattened(segments, keys, flatness)
    drawn = segments.filter(F.col("kind").isin("L", "Q", "C")).select(*keys, "seg")
    ends = lines.join(drawn, [*keys, "seg"]).select(*keys, "seg", "step", F.col("xb").alias("x"), F.col("yb").alias("y"))
    moves = segments.filter("kind = 'M'").select(*keys, "seg", F.lit(0).alias("step"), F.element_at("xs", -1).cast("double").alias("x"), F.element_at("ys", -1).cast("double").alias("y"))
    point = F.struct("seg", "step", _near(F.col("x")).alias("x"), _near(F.col("y")).alias("y"))
    rows = moves.unionByName(ends).groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("p"))
    return fill_polygon(rows.select(*keys, F.col("p.x").alias("_xs"), F.col("p.y").alias("_ys")), keys, "_xs", "_ys")


def hits(segments: DataFrame, rectangles: DataFrame, keys: list[str], flatness: float = 1.0) -> DataFrame:
    """(keys..., rect, hit): whether a shape's inside, by the non-zero rule, meets the inside of a rectangle (keys..., rect, x, y, w, h).

    Sub-paths count as closed.  An edge that passes through the rectangle is a hit;
    else the rectangle lies wholly inside or outside, and the turns of the edges around its middle
    tell which.  Empty rectangles are never hit.
    """
    lines = flattened(segments, keys, flatness).select(*keys, "sub", "seg", "step", "xa", "ya", "xb", "yb")
    w = Window.partitionBy(*keys, "sub").orderBy("seg", "step")
    whole = Window.partitionBy(*keys, "sub")
    tail = lines.withColumns({"_n": F.row_number().over(w), "_all": F.count("*").over(whole), "_x": F.first("xa").over(w), "_y": F.first("ya").over(w)}).filter("_n = _all")
    back = tail.select(*keys, F.col("xb").alias("xa"), F.col("yb").alias("ya"), F.col("_x").alias("xb"), F.col("_y").alias("yb"))
    edges = lines.select(*keys, "xa", "ya", "xb", "yb").unionByName(back)
    met = rectangles.join(edges, keys, "left")
    left, right, top, bottom = F.col("x"), F.col("x") + F.col("w"), F.col("y"), F.col("y") + F.col("h")
    dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
    side = lambda px, py: F.signum(dx * (py - F.col("ya")) - dy * (px - F.col("xa")))
    corners = [side(px, py) for px in (left, right) for py in (top, bottom)]
    apart = (F.greatest("xa", "xb") <= left) | (F.least("xa", "xb") >= right) | (F.greatest("ya", "yb") <= top) | (F.least("ya", "yb") >= bottom)
    one_side = (F.least(*corners) >= 0) | (F.greatest(*corners) <= 0)
    through = ~apart & ~one_side
    mx, my = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    turn = side(mx, my)
    winding = F.when((F.col("ya") <= my) & (F.col("yb") > my) & (turn > 0), 1).when((F.col("ya") > my) & (F.col("yb") <= my) & (turn < 0), -1).otherwise(0)
    rows = met.groupBy(*keys, "rect", "w", "h").agg(F.coalesce(F.bool_or(through), F.lit(False)).alias("t"), F.sum(winding).alias("n"))
    return rows.select(*keys, "rect", ((F.col("w") > 0) & (F.col("h") > 0) & (F.col("t") | (F.coalesce("n", F.lit(0)) != 0))).alias("hit"))
