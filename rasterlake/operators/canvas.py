"""A drawing surface with a pen: calls are collected as shape rows and laid over a picture in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import Argb
from . import drawing as D
from . import pixels as P


class Canvas:
    """Only the translation of the transform moves what is drawn; a clip is kept but not applied."""

    def __init__(self, spark: SparkSession, width: int, height: int, argb: int = 0, base: DataFrame | None = None):
        self.spark, self.width, self.height = spark, width, height
        self.base = base if base is not None else P.blank(spark, 0, width, height, argb)
        self.pen, self.paper, self.at, self.clip = 0xFF000000, 0xFFFFFFFF, (0, 0), None
        self._calls: list[DataFrame] = []

    def color(self, argb: int) -> Canvas:
        self.pen = argb
        return self

    def background(self, argb: int) -> Canvas:
        self.paper = argb
        return self

    def translate(self, dx: int, dy: int) -> Canvas:
        self.at = (self.at[0] + dx, self.at[1] + dy)
        return self

    def clip_rect(self, x: int, y: int, w: int, h: int) -> Canvas:
        if self.clip:
            a, b, c, d = self.clip
            x, y, r, s = max(a, x), max(b, y), min(a + c, x + w), min(b + d, y + h)
            w, h = max(0, r - x), max(0, s - y)
        self.clip = (x, y, w, h)
        return self

    def _add(self, points: DataFrame, argb: int | None = None) -> Canvas:
        cells = points.select("x", "y").filter(P.contains(F.col("x"), F.col("y"), self.width, self.height))
        colored = cells.select("x", "y", *Argb.literal(self.pen if argb is None else argb).named(), F.lit(len(self._calls)).alias("ord"))
        self._calls.append(colored)
        return self

    def _one(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(0).alias("k"))

    def _shape(self, f, x: int, y: int, *rest: int, argb: int | None = None) -> Canvas:
        return self._add(f(self._one(), ["k"], x + self.at[0], y + self.at[1], *rest), argb)

    def fill_rect(self, x: int, y: int, w: int, h: int) -> Canvas:
        return self._shape(D.fill_rect, x, y, w, h)

    def clear_rect(self, x: int, y: int, w: int, h: int) -> Canvas:
        return self._shape(D.fill_rect, x, y, w, h, argb=self.paper)

    def draw_rect(self, x: int, y: int, w: int, h: int) -> Canvas:
        return self._shape(D.draw_rect, x, y, w, h)

    def fill_round_rect(self, x: int, y: int, w: int, h: int, arc_w: int, arc_h: int) -> Canvas:
        return self._shape(D.fill_round_rect, x, y, w, h, arc_w, arc_h)

    def draw_round_rect(self, x: int, y: int, w: int, h: int, arc_w: int, arc_h: int) -> Canvas:
        return self._shape(D.draw_round_rect, x, y, w, h, arc_w, arc_h)

    def fill_oval(self, x: int, y: int, w: int, h: int) -> Canvas:
        return self._shape(D.fill_oval, x, y, w, h)

    def draw_oval(self, x: int, y: int, w: int, h: int) -> Canvas:
        return self._shape(D.draw_oval, x, y, w, h)

    def fill_arc(self, x: int, y: int, w: int, h: int, start: int, extent: int) -> Canvas:
        return self._shape(D.fill_arc, x, y, w, h, start, extent)

    def draw_arc(self, x: int, y: int, w: int, h: int, start: int, extent: int) -> Canvas:
        return self._shape(D.draw_arc, x, y, w, h, start, extent)

    def draw_line(self, x1: int, y1: int, x2: int, y2: int) -> Canvas:
        dx, dy = self.at
        return self._add(D.draw_line(self._one(), ["k"], x1 + dx, y1 + dy, x2 + dx, y2 + dy))

    def _points(self, points: list[tuple[int, int]]) -> DataFrame:
        xs, ys = (F.array(*(F.lit(p[i] + self.at[i]) for p in points)) for i in (0, 1))
        return self._one().select("k", xs.alias("xs"), ys.alias("ys"))

    def draw_polyline(self, points: list[tuple[int, int]], closed: bool = False) -> Canvas:
        return self._add(D.draw_polyline(self._points(points), ["k"], "xs", "ys", closed)) if len(points) > 1 else self

    def fill_polygon(self, points: list[tuple[int, int]]) -> Canvas:
        return self._add(D.fill_polygon(self._points(points), ["k"], "xs", "ys"))

    def draw_text(self, *_args) -> Canvas:
        raise NotImplementedError("text is not drawn here")

    def pixels(self) -> DataFrame:
        """The picture with all calls laid over it: the last call on a pixel wins."""
        if not self._calls:
            return self.base
        changes = reduce(DataFrame.unionByName, self._calls)
        # every picture gets the same drawing: the last colour of each place, met by the picture's pixels at that place
        last = changes.groupBy("x", "y").agg(F.max_by(F.struct("a", "r", "g", "b"), "ord").alias("n"))
        joined = self.base.join(last, ["x", "y"], "left")
        return joined.select("picture_id", "x", "y", *(F.coalesce(F.col(f"n.{c}"), F.col(c)).cast("int").alias(c) for c in "argb"))
