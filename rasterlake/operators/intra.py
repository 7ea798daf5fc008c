"""Prediction of a block from what stands above and to the left of it, and the choice of a mode.

Each block sends its lower row and right column to the blocks that see them; one
grouping by block brings them together.  Modes are an array beside the block, and the
choice is the least of (score, mode), so the first of equals wins.

Context are the pixels of the source, not those of a reconstruction.  Without a block
above, its pixels count as 127, without one to the left as 129, without one above
left as 128; pixels above to the right that do not exist repeat the last one above.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import idiv
from .coefficients import BIT_COSTS, bit_cost

#: Cost of each whole-block mode (mean, vertical, horizontal, slope) for light and colour, in 1/256 bit.
LIGHT_COSTS, COLOUR_COSTS = (663, 919, 872, 919), (302, 984, 439, 642)
#: What a cost counts against 256 times the squared error.
LIGHT_WEIGHT, COLOUR_WEIGHT = 106, 120
#: The modes of 4x4 blocks, in order: mean, slope, vertical, horizontal, and six diagonals.
SMALL_MODES = ("mean", "slope", "vertical", "horizontal", "down_right", "vertical_right", "down_left", "vertical_left", "horizontal_down", "horizontal_up")
#: Probabilities at the nodes of the tree of small modes, and the (node, decision) way to each mode.
SMALL_PROBS = (120, 90, 79, 133, 87, 85, 80, 111, 151)
SMALL_PATHS = (
    ((0, 0),),
    ((0, 1), (1, 0)),
    ((0, 1), (1, 1), (2, 0)),
    ((0, 1), (1, 1), (2, 1), (3, 0), (4, 0)),
    ((0, 1), (1, 1), (2, 1), (3, 0), (4, 1), (5, 0)),
    ((0, 1), (1, 1), (2, 1), (3, 0), (4, 1), (5, 1)),
    ((0, 1), (1, 1), (2, 1), (3, 1), (6, 0)),
    ((0, 1), (1, 1), (2, 1), (3, 1), (6, 1), (7, 0)),
    ((0, 1), (1, 1), (2, 1), (3, 1), (6, 1), (7, 1), (8, 0)),
    ((0, 1), (1, 1), (2, 1), (3, 1), (6, 1), (7, 1), (8, 1)),
)


def small_costs(probs: Sequence[int] = SMALL_PROBS, costs: Sequence[int] = BIT_COSTS) -> list[int]:
    return [sum(bit_cost(b, probs[n], costs) for n, b in path) for path in SMALL_PATHS]


def squares(px: DataFrame, size: int, **values: Column) -> DataFrame:
    """(picture_id, tx, ty, and an array for each value, row by row) of each square; a missing pixel is 0, of several the largest stays."""
    place = (F.col("y") % size * size + F.col("x") % size).cast("int")
    cell = F.struct(place.alias("k"), *(v.cast("int").alias(n) for n, v in values.items()))
    rows = px.groupBy("picture_id", idiv(F.col("x"), size).alias("tx"), idiv(F.col("y"), size).alias("ty")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    last = F.filter("cells", lambda c, i: F.coalesce(F.get("cells", i + 1)["k"] != c["k"], F.lit(True)))
    rows = rows.select("picture_id", "tx", "ty", F.map_from_entries(F.transform(last, lambda c: F.struct(c["k"], c))).alias("at"))

    def laid(n: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.coalesce(F.element_at("at", k)[n], F.lit(0)))

    return rows.select("picture_id", "tx", "ty", *(laid(n).alias(n) for n in values))


def edges(blocks: DataFrame, size: int, *names: str) -> DataFrame:
    """Blocks with, for each named array n: n_top, n_right (above to the right), n_left and n_corner; null where there is no block."""
    row = lambda n: F.slice(n, size * (size - 1) + 1, size)
    column = lambda n: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda y: F.get(n, (y + 1) * size - 1))

    def sent(dx: int, dy: int, kind: str, value) -> Column:
        fields = [value(n).alias(n) for n in names]
        return F.struct((F.col("tx") + dx).alias("tx"), (F.col("ty") + dy).alias("ty"), F.lit(kind).alias("kind"), *fields)

    parts = [sent(0, 0, "", F.col), sent(0, 1, "top", row), sent(-1, 1, "right", row), sent(1, 0, "left", column), sent(1, 1, "corner", lambda n: F.array(F.get(n, size * size - 1)))]
    rows = blocks.select("picture_id", F.explode(F.array(*parts)).alias("s")).select("picture_id", "s.*")
    of = lambda kind, n: F.max(F.when(F.col("kind") == kind, F.col(n)))
    met = rows.groupBy("picture_id", "tx", "ty").agg(*(of(k, n).alias(f"{n}_{k}" if k else n) for n in names for k in ("", "top", "right", "left", "corner")))
    return met.filter(F.col(names[0]).isNotNull()).withColumns({f"{n}_corner": F.get(f"{n}_corner", 0) for n in names})


def _clip(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v))


def whole_predictions(n: str, size: int) -> Column:
    """The four whole-block predictions of an array with its edges, as an array of arrays."""
    top, left = F.col(f"{n}_top"), F.col(f"{n}_left")
    total = lambda a: F.coalesce(F.aggregate(a, F.lit(0), lambda s, v: s + v), F.lit(0))
    count = (top.isNotNull().cast("int") + left.isNotNull().cast("int")) * size
    mean = F.when(count > 0, idiv(total(top) + total(left) + idiv(count, 2), F.greatest(count, F.lit(1)))).otherwise(128)
    above = F.coalesce(top, F.array_repeat(F.lit(127), size))
    beside = F.coalesce(left, F.array_repeat(F.lit(129), size))
    corner = F.coalesce(F.col(f"{n}_corner"), F.lit(128))
    slope = F.flatten(F.transform(beside, lambda b: F.transform(above, lambda a: _clip(a + b - corner))))
    return F.array(F.array_repeat(mean, size * size), F.flatten(F.array_repeat(above, size)), F.flatten(F.transform(beside, lambda b: F.array_repeat(b, size))), slope)


def _small_cell(mode: str, x: int, y: int) -> tuple[int, int]:
    """(taps, place on the edge) of a cell of a directional mode.

    The edge runs from the lowest pixel on the left (0) up to the corner (4) and on
    to the right (12).  Two taps are the mean of a place and the next, three the
    weighted mean around it, one the place itself.
    """
    if mode == "vertical":
        return 3, 5 + x
    if mode == "horizontal":
        return 3, 3 - y
    if mode == "down_left":
        return 3, 6 + x + y
    if mode == "down_right":
        return 3, 4 + x - y
    if mode == "vertical_left":
        return (2, 5 + x + y // 2) if y % 2 == 0 else (3, 6 + x + y // 2)
    if mode == "vertical_right":
        back = x - y // 2
        return (3, 5 - y) if back < 0 else (2, 4 + back) if y % 2 == 0 else (3, 4 + back)
    if mode == "horizontal_down":
        down = y - x // 2
        return (3, 3 + x) if down < 0 else (2, 3 - down) if x % 2 == 0 else (3, 4 - down)
    along = x + 2 * y  # horizontal_up
    return (1, 0) if along > 5 else (2, 2 - along // 2) if along % 2 == 0 else (3, 2 - along // 2)


def small_predictions(n: str) -> Column:
    """The ten predictions of a 4x4 array with its edges, as an array of arrays."""
    left = F.coalesce(F.col(f"{n}_left"), F.array_repeat(F.lit(129), 4))
    top, corner = F.col(f"{n}_top"), F.coalesce(F.col(f"{n}_corner"), F.lit(128))
    right = F.coalesce(F.col(f"{n}_right"), F.array_repeat(F.get(top, 3), 4))
    above = F.coalesce(F.concat(top, right), F.array_repeat(F.lit(127), 8))
    edge = F.concat(F.reverse(left), F.array(corner), above)

    def of(e: Column) -> Column:
        at = lambda k: e[min(max(k, 0), 12)]
        taps = {1: lambda k: at(k), 2: lambda k: F.shiftright(at(k) + at(k + 1) + 1, 1), 3: lambda k: F.shiftright(at(k - 1) + 2 * at(k) + at(k + 1) + 2, 2)}
        cells = [(x, y) for y in range(4) for x in range(4)]
        mean = F.shiftright(sum((e[k] for k in (0, 1, 2, 3, 5, 6, 7, 8)), F.lit(4)), 3)
        out = [F.array_repeat(mean, 16), F.array(*(_clip(e[5 + x] + e[3 - y] - e[4]) for x, y in cells))]
        for mode in SMALL_MODES[2:]:
            places = [_small_cell(mode, x, y) for x, y in cells]
            out.append(F.array(*(taps[t](k) for t, k in places)))
        return F.array(*out)

    return F.transform(F.array(edge), of)[0]


def chosen(blocks: DataFrame, predictions: dict[str, Column], costs: Sequence[int], weight: int) -> DataFrame:
    """(picture_id, tx, ty, mode, score, and n_residual for each array n) by 256 times the squared error plus weighted cost."""
    rows = blocks.select("picture_id", "tx", "ty", *predictions, *(p.alias(f"{n}_all") for n, p in predictions.items()))

    def error(n: str, m: Column) -> Column:
        square = F.zip_with(F.col(n), F.get(f"{n}_all", m), lambda a, b: ((a - b) * (a - b)).cast("bigint"))
        return F.aggregate(square, F.lit(0).cast("bigint"), lambda s, v: s + v)

    modes = F.sequence(F.lit(0), F.lit(len(costs) - 1))
    score = lambda m: sum((error(n, m) for n in predictions), F.lit(0).cast("bigint")) * 256 + F.get(F.array(*(F.lit(c * weight) for c in costs)), m)
    rows = rows.withColumn("best", F.array_min(F.transform(modes, lambda m: F.struct(score(m).alias("score"), m.alias("mode")))))
    residual = lambda n: F.zip_with(F.col(n), F.get(f"{n}_all", F.col("best.mode")), lambda a, b: a - b)
    return rows.select("picture_id", "tx", "ty", "best.mode", "best.score", *(residual(n).alias(f"{n}_residual") for n in predictions))


def small_modes(px: DataFrame, value: Column, weight: int, costs: Sequence[int] | None = None) -> DataFrame:
    """Best of the ten modes of each 4x4 square; modes cost what the tree of modes says, whatever the neighbours chose."""
    blocks = edges(squares(px, 4, v=value), 4, "v")
    return chosen(blocks, {"v": small_predictions("v")}, costs or small_costs(), weight)


def whole_modes(px: DataFrame, size: int, costs: Sequence[int] = LIGHT_COSTS, weight: int = LIGHT_WEIGHT, **values: Column) -> DataFrame:
    """Best of the four modes of each square; several values share one mode."""
    blocks = edges(squares(px, size, **values), size, *values)
    return chosen(blocks, {n: whole_predictions(n, size) for n in values}, costs, weight)
