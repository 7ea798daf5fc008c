"""Drawing as row generators: each shape row becomes the pixels it covers.

Shapes are columns of a DataFrame; every function returns the input's ``keys``
columns with one row per pixel (x, y).  Pixels then go over a picture through
``pixels.put``, where the largest ``ord`` wins.  All shapes are expressions and
``explode``: no shape is walked pixel by pixel.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import idiv


def _range(low: Column, size: Column) -> Column:
    """low, low + 1, ... (size values; none if size is not positive)."""
    return F.when(size > 0, F.sequence(low, low + size - 1)).otherwise(F.array().cast("array<int>"))


def _c(x: Column | int | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast("int")


def _rounded(x: Column) -> Column:
    return F.floor(x + 0.5).cast("int")


def fill_rect(shapes: DataFrame, keys: list[str], x, y, w, h) -> DataFrame:
    rows = shapes.select(*keys, F.explode(_range(_c(y), _c(h))).alias("y"), _range(_c(x), _c(w)).alias("xs"))
    return rows.select(*keys, F.explode("xs").alias("x"), "y")


def draw_rect(shapes: DataFrame, keys: list[str], x, y, w, h) -> DataFrame:
    """Outline; a pixel wider and higher than the size says."""
    x, y, w, h = map(_c, (x, y, w, h))
    one = F.lit(1)
    edges = F.array(*(F.struct(a.alias("x"), b.alias("y"), c.alias("w"), d.alias("h")) for a, b, c, d in ((x, y, w + 1, one), (x, y + h, w + 1, one), (x, y, one, h + 1), (x + w, y, one, h + 1))))
    rows = shapes.select(*keys, F.explode(edges).alias("e"))
    return fill_rect(rows, keys, F.col("e.x"), F.col("e.y"), F.col("e.w"), F.col("e.h")).distinct()


def line_points(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Array of (x, y): a step a pixel along the longer side, the other side rounded, halves toward the start."""
    dx, dy = F.abs(x2 - x1), F.abs(y2 - y1)
    n = F.greatest(dx, dy)
    safe = F.greatest(n, F.lit(1))

    def along(i: Column, a: Column, d: Column, to: Column) -> Column:
        steps = F.when(d == n, i).otherwise(F.ceil((i * d * 2 + n) / (safe * 2).cast("double")) - 1)
        return (a + F.when(to < a, -steps).otherwise(steps)).cast("int")

    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(along(i, x1, dx, x2).alias("x"), along(i, y1, dy, y2).alias("y")))


def _exploded(shapes: DataFrame, keys: list[str], points: Column) -> DataFrame:
    rows = shapes.select(*keys, F.explode(points).alias("p"))
    return rows.select(*keys, "p.x", "p.y").distinct()


def draw_line(shapes: DataFrame, keys: list[str], x1, y1, x2, y2) -> DataFrame:
    return _exploded(shapes, keys, line_points(*map(_c, (x1, y1, x2, y2))))


def draw_polyline(shapes: DataFrame, keys: list[str], xs: str, ys: str, closed: bool = False) -> DataFrame:
    """Lines through the points of two arrays, back to the first if closed."""
    n = F.size(xs)
    last = n if closed else n - 1
    pairs = F.transform(_range(F.lit(0), last), lambda i: F.struct(F.col(xs)[i].alias("a"), F.col(ys)[i].alias("b"), F.col(xs)[(i + 1) % n].alias("c"), F.col(ys)[(i + 1) % n].alias("d")))
    rows = shapes.select(*keys, F.explode(pairs).alias("l"))
    return draw_line(rows, keys, F.col("l.a"), F.col("l.b"), F.col("l.c"), F.col("l.d"))


def _half_width(rx: Column, ry: Column, dy: Column) -> Column:
    part = dy.cast("double") * dy / (ry.cast("double") * ry)
    return _rounded(rx * F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - part)))


def _oval(x, y, w, h) -> tuple[Column, Column, Column, Column]:
    x, y, w, h = map(_c, (x, y, w, h))
    return x + idiv(w, 2), y + idiv(h, 2), idiv(w, 2), idiv(h, 2)


def fill_oval(shapes: DataFrame, keys: list[str], x, y, w, h) -> DataFrame:
    """Spans of rounded half width; a flat oval is its centre pixel."""
    cx, cy, rx, ry = _oval(x, y, w, h)
    flat = (rx <= 0) | (ry <= 0)
    rows = shapes.select(*keys, cx.alias("_cx"), cy.alias("_cy"), rx.alias("_rx"), F.explode(F.when(flat, F.array(F.lit(0))).otherwise(F.sequence(-ry, ry))).alias("_d"), flat.alias("_flat"), ry.alias("_ry"))
    half = F.when(F.col("_flat"), F.lit(0)).otherwise(_half_width(F.col("_rx"), F.greatest("_ry", F.lit(1)), F.col("_d")))
    rows = rows.select(*keys, F.explode(F.sequence(F.col("_cx") - half, F.col("_cx") + half)).alias("x"), (F.col("_cy") + F.col("_d")).alias("y"))
    return rows


def draw_oval(shapes: DataFrame, keys: list[str], x, y, w, h) -> DataFrame:
    """Outline: in each column and each row the pixels nearest to the curve, where the curve runs along it."""
    cx, cy, rx, ry = _oval(x, y, w, h)
    flat = (rx <= 0) | (ry <= 0)
    one = F.lit(1)
    sx, sy = F.greatest(rx, one), F.greatest(ry, one)

    def corners(dx: Column, dy: Column) -> Column:
        return F.array(*(F.struct((cx + a * dx).cast("int").alias("x"), (cy + b * dy).cast("int").alias("y")) for a in (1, -1) for b in (1, -1)))

    def by_column(d: Column) -> Column:
        e = _half_width(sy, sx, d)
        return F.when(d * sy * sy <= e * sx * sx, corners(d, e)).otherwise(F.array().cast("array<struct<x:int,y:int>>"))

    def by_row(d: Column) -> Column:
        e = _half_width(sx, sy, d)
        return F.when(e * sy * sy >= d * sx * sx, corners(e, d)).otherwise(F.array().cast("array<struct<x:int,y:int>>"))

    points = F.concat(F.flatten(F.transform(F.sequence(F.lit(0), sx), by_column)), F.flatten(F.transform(F.sequence(F.lit(0), sy), by_row)))
    return _exploded(shapes, keys, F.when(flat, F.array(F.struct(cx.alias("x"), cy.alias("y")))).otherwise(points))


def _corner_rows(x, y, w, h, aw, ah) -> tuple:
    x, y, w, h, aw, ah = map(_c, (x, y, w, h, aw, ah))
    return x, y, w, h, idiv(aw, 2), idiv(ah, 2)


def fill_round_rect(shapes: DataFrame, keys: list[str], x, y, w, h, arc_w, arc_h) -> DataFrame:
    """Rows of the body, shortened where they pass through the rounded corners."""
    x, y, w, h, rx, ry = _corner_rows(x, y, w, h, arc_w, arc_h)
    rows = shapes.select(*keys, x.alias("_x"), y.alias("_y"), w.alias("_w"), h.alias("_h"), rx.alias("_rx"), ry.alias("_ry"), F.explode(_range(F.lit(0), h + 1)).alias("_d"))
    into = F.greatest(F.col("_ry") - F.col("_d"), F.col("_d") - (F.col("_h") - F.col("_ry")), F.lit(0))
    cut = F.when(into > 0, F.col("_rx") - _half_width(F.col("_rx"), F.greatest("_ry", F.lit(1)), into)).otherwise(F.lit(0))
    return rows.select(*keys, F.explode(_range(F.col("_x") + cut, F.col("_w") + 1 - cut * 2)).alias("x"), (F.col("_y") + F.col("_d")).alias("y"))


def draw_round_rect(shapes: DataFrame, keys: list[str], x, y, w, h, arc_w, arc_h) -> DataFrame:
    """Four straight edges and four quarter ovals."""
    x, y, w, h, rx, ry = _corner_rows(x, y, w, h, arc_w, arc_h)
    one = F.lit(1)
    edges = F.array(*(F.struct(a.alias("x"), b.alias("y"), c.alias("w"), d.alias("h")) for a, b, c, d in ((x + rx, y, w - rx * 2 + 1, one), (x + rx, y + h, w - rx * 2 + 1, one), (x, y + ry, one, h - ry * 2 + 1), (x + w, y + ry, one, h - ry * 2 + 1))))
    straight = fill_rect(shapes.select(*keys, F.explode(edges).alias("e")), keys, F.col("e.x"), F.col("e.y"), F.col("e.w"), F.col("e.h"))
    extra = {"_l": x + rx, "_r": x + w - rx, "_t": y + ry, "_b": y + h - ry, "_rx": rx, "_ry": ry}
    oval = draw_oval(shapes.select(*keys, *(v.alias(k) for k, v in extra.items())).filter("_rx > 0 AND _ry > 0"), [*keys, *extra], -F.col("_rx"), -F.col("_ry"), F.col("_rx") * 2, F.col("_ry") * 2)
    bent = oval.select(*keys, (F.col("x") + F.when(F.col("x") < 0, F.col("_l")).otherwise(F.col("_r"))).alias("x"), (F.col("y") + F.when(F.col("y") < 0, F.col("_t")).otherwise(F.col("_b"))).alias("y"))
    return straight.select(*keys, "x", "y").unionByName(bent).distinct()


def fill_arc(shapes: DataFrame, keys: list[str], x, y, w, h, start, extent) -> DataFrame:
    """The pixels of the oval whose angle, counter-clockwise from the right, lies in the range."""
    cx, cy, rx, ry = _oval(x, y, w, h)
    a, e = F.radians(_c(start).cast("double")), F.radians(_c(extent).cast("double"))
    turn = 2 * 3.141592653589793
    low, high = F.when(e < 0, a + e).otherwise(a), F.when(e < 0, a).otherwise(a + e)
    wrapped = [((v % turn) + turn) % turn for v in (low, high)]
    held = {"_ax": cx, "_ay": cy, "_arx": rx, "_ary": ry, "_low": wrapped[0], "_high": wrapped[1]}
    rows = shapes.select(*keys, *(v.alias(k) for k, v in held.items())).filter("_arx > 0 AND _ary > 0")
    rows = fill_oval(rows, [*keys, *held], F.col("_ax") - F.col("_arx"), F.col("_ay") - F.col("_ary"), F.col("_arx") * 2, F.col("_ary") * 2)
    angle = F.atan2((F.col("_ay") - F.col("y")).cast("double"), (F.col("x") - F.col("_ax")).cast("double"))
    angle = F.when(angle < 0, angle + turn).otherwise(angle)
    inside = F.when(F.col("_low") <= F.col("_high"), (angle >= F.col("_low")) & (angle <= F.col("_high"))).otherwise((angle >= F.col("_low")) | (angle <= F.col("_high")))
    return rows.filter(inside).select(*keys, "x", "y")


def draw_arc(shapes: DataFrame, keys: list[str], x, y, w, h, start, extent) -> DataFrame:
    """Points at two steps a degree, at least 36 steps."""
    cx, cy, rx, ry = _oval(x, y, w, h)
    a, e = _c(start), _c(extent)
    steps = F.greatest(F.lit(36), F.abs(e) * 2)

    def point(i: Column) -> Column:
        # a falling arc is stepped from its end, downwards
        t = F.radians(F.when(e < 0, a + e).otherwise(a).cast("double")) + i * (F.radians(e.cast("double")) / steps)
        return F.struct((cx + _rounded(rx * F.cos(t))).alias("x"), (cy - _rounded(ry * F.sin(t))).alias("y"))

    rows = shapes.filter((rx > 0) & (ry > 0))
    return _exploded(rows, keys, F.transform(F.sequence(F.lit(0), steps), point))


def fill_polygon(shapes: DataFrame, keys: list[str], xs: str, ys: str) -> DataFrame:
    """Even-odd filling by scanlines; an edge counts on rows above its lower end, up to and with its upper."""
    n = F.size(xs)
    rows = shapes.filter(n >= 3).select(*keys, xs, ys, F.explode(F.sequence(F.array_min(ys), F.array_max(ys))).alias("y"))

    def crossing(i: Column) -> Column:
        j = (i + n - 1) % n
        xi, yi, xj, yj, y = F.col(xs)[i], F.col(ys)[i], F.col(xs)[j], F.col(ys)[j], F.col("y")
        hit = ((yi < y) & (yj >= y)) | ((yj < y) & (yi >= y))
        return F.when(hit, xi + idiv((y - yi) * (xj - xi), F.when(yj != yi, yj - yi)))

    nodes = F.array_sort(F.filter(F.transform(F.sequence(F.lit(0), n - 1), crossing), lambda v: v.isNotNull()))
    rows = rows.select(*keys, "y", nodes.alias("nodes"))
    spans = F.flatten(F.transform(_range(F.lit(0), idiv(F.size("nodes"), 2)), lambda k: F.sequence(F.col("nodes")[k * 2], F.col("nodes")[k * 2 + 1])))
    return rows.select(*keys, F.explode(F.array_distinct(spans)).alias("x"), "y")


def _curve(shapes: DataFrame, keys: list[str], points: list[tuple[str, str]], least: int) -> DataFrame:
    """A Bezier curve of any degree as a chain of lines; steps follow the distance of its ends."""
    from math import comb

    degree = len(points) - 1
    (x0, y0), (x1, y1) = points[0], points[-1]
    far = F.sqrt((F.col(x1) - F.col(x0)) * (F.col(x1) - F.col(x0)) + (F.col(y1) - F.col(y0)) * (F.col(y1) - F.col(y0)).cast("double"))
    steps = F.greatest(F.lit(least), F.floor(far / 2).cast("int"))

    def at(axis: int):
        def value(i: Column) -> Column:
            t = i.cast("double") / steps
            u = F.lit(1.0) - t
            terms = [F.lit(float(comb(degree, k))) * reduce(lambda a, b: a * b, [t] * k + [u] * (degree - k), F.lit(1.0)) * F.col(p[axis]) for k, p in enumerate(points)]
            return _rounded(reduce(lambda a, b: a + b, terms))

        return F.transform(F.sequence(F.lit(0), steps), value)

    rows = shapes.select(*keys, at(0).alias("_xs"), at(1).alias("_ys"))
    return draw_polyline(rows, keys, "_xs", "_ys")


def draw_quad(shapes: DataFrame, keys: list[str], *points: tuple[str, str]) -> DataFrame:
    return _curve(shapes, keys, list(points), 8)


def draw_cubic(shapes: DataFrame, keys: list[str], *points: tuple[str, str]) -> DataFrame:
    return _curve(shapes, keys, list(points), 12)


def copy_area(px: DataFrame, x: int, y: int, w: int, h: int, dx: int, dy: int, width: int, height: int) -> DataFrame:
    """Changes for ``pixels.put``: the area again at an offset; places outside the picture count as clear."""
    # each picture makes the places of the area itself
    cells = px.select("picture_id").distinct().select("picture_id", F.explode(F.sequence(F.lit(0), F.lit(w * h - 1))).alias("id"))
    grid = cells.select("picture_id", (F.col("id") % w + x).cast("int").alias("sx"), (F.expr(f"id div {w}") + y).cast("int").alias("sy"))
    grid = grid.filter(F.col("sx").between(-dx, width - 1 - dx) & F.col("sy").between(-dy, height - 1 - dy))
    source = px.select("picture_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "a", "r", "g", "b")
    rows = grid.join(source, ["picture_id", "sx", "sy"], "left")
    return rows.select("picture_id", (F.col("sx") + dx).alias("x"), (F.col("sy") + dy).alias("y"), *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in "argb"), F.lit(0).alias("ord"))


def draw_affine(target: DataFrame, source: DataFrame, matrix: tuple[float, float, float, float, float, float], width: int, height: int, mode: str = "normal") -> DataFrame:
    """Source through an affine map (x' = ax + cy + e, y' = bx + dy + f), sampled at the nearest pixel by the inverse map."""
    from .pixels import blit

    a, b, c, d, e, f = matrix
    det = a * d - b * c
    if det == 0:
        raise ValueError("the map cannot be inverted")
    t = target.select("picture_id", "x", "y")
    u, v = F.col("x") - F.lit(e), F.col("y") - F.lit(f)
    sx, sy = F.floor((u * d - v * c) / det).cast("int"), F.floor((v * a - u * b) / det).cast("int")
    wanted = t.select("picture_id", "x", "y", sx.alias("sx"), sy.alias("sy")).filter(F.col("sx").between(0, width - 1) & F.col("sy").between(0, height - 1))
    moved = wanted.join(source.select("picture_id", F.col("x").alias("sx"), F.col("y").alias("sy"), "a", "r", "g", "b"), ["picture_id", "sx", "sy"]).drop("sx", "sy")
    return blit(target, moved, 0, 0, mode)


def text(*_args) -> DataFrame:
    raise NotImplementedError("text is not drawn here")
