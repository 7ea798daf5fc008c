"""Coefficient blocks: quantisers, token statistics, their cost, and the trellis.

``blocks`` rows hold 16 numbers, row by row as coefficients or in zigzag order as
levels.  A level's tokens are yes-or-no decisions at the nodes of a fixed tree, each
with a probability by (type, band, context, node); costs are in 1/256 bit.

A decision's context is the level before it, which stands in the same row.  So blocks
become tokens by one explode; equal tokens are counted first, and only those counts
(a few thousand rows at any size) are spread to the nodes they pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Place of the n-th coefficient in zigzag order; band of each position.
ZIGZAG = (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)
BANDS = (0, 1, 2, 3, 6, 4, 5, 6, 6, 6, 6, 6, 6, 6, 6, 7)
#: Fixed values, row by row: weight of a coefficient's error, and how much it is sharpened (in 1/2048 of its step; light only).
WEIGHTS = (30, 27, 19, 11, 27, 24, 17, 10, 19, 17, 12, 8, 11, 10, 8, 6)
SHARPENING = (0, 30, 60, 90, 30, 60, 90, 90, 60, 90, 90, 90, 90, 90, 90, 90)
#: Rounding of quantisers in 1/256 of a step (first coefficient, others), for light, light's means and colour.
ROUNDING = {"light": (96, 110), "means": (96, 108), "colour": (110, 115)}
#: Probabilities of the extra bits of tokens that stand for several levels, by the least level of each.
EXTRA_BITS = {5: (159,), 7: (165, 145), 11: (173, 148, 140), 19: (176, 155, 140, 135), 35: (180, 157, 141, 134, 130), 67: (254, 254, 243, 230, 196, 177, 153, 140, 133, 130, 129)}
#: Fixed values: (node, decision) that a token passes after it is known that the block goes on, by the token's least level.
PATHS = {
    0: ((1, 0),),
    1: ((1, 1), (2, 0)),
    2: ((1, 1), (2, 1), (3, 0), (4, 0)),
    3: ((1, 1), (2, 1), (3, 0), (4, 1), (5, 0)),
    4: ((1, 1), (2, 1), (3, 0), (4, 1), (5, 1)),
    5: ((1, 1), (2, 1), (3, 1), (6, 0), (7, 0)),
    7: ((1, 1), (2, 1), (3, 1), (6, 0), (7, 1)),
    11: ((1, 1), (2, 1), (3, 1), (6, 1), (8, 0), (9, 0)),
    19: ((1, 1), (2, 1), (3, 1), (6, 1), (8, 0), (9, 1)),
    35: ((1, 1), (2, 1), (3, 1), (6, 1), (8, 1), (10, 0)),
    67: ((1, 1), (2, 1), (3, 1), (6, 1), (8, 1), (10, 1)),
}
LARGEST, NODES, CONTEXTS, SHIFT, ERROR_WEIGHT = 2047, 11, 3, 17, 256
_UNREACHED = (1 << 55) - 1

#: Cost of a decision that has probability p/256, for p from 0 to 255: the nearest whole number of 1/256 bits, at most 7 bits.
BIT_COSTS = tuple(min(1792, round(-256 * math.log2(max(p, 1) / 256))) for p in range(256))


def bit_cost(bit: int, p: int, costs: Sequence[int] = BIT_COSTS) -> int:
    return costs[255 - p] if bit else costs[p]


def token_of(level: int) -> int:
    """The least level of the token that stands for a level."""
    return max(t for t in PATHS if t <= level)


# -- quantisers -----------------------------------------------------------------------


def _at(values: Sequence[int], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index)


def _numbers(values: Sequence[int]) -> Column:
    """A long table as one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _steps(dc: int, ac: int) -> list[int]:
    return [dc] + [ac] * 15


def quantised(block: Column, dc: int, ac: int, kind: str = "light") -> Column:
    """Levels in zigzag order of a block of coefficients."""

    def level(n: int) -> Column:
        j = ZIGZAG[n]
        q = _steps(dc, ac)[j]
        rounding = ROUNDING[kind][j > 0] << (SHIFT - 8)
        more = SHARPENING[j] * q >> 11 if kind == "light" else 0
        c = F.get(block, j).cast("bigint")
        size = F.least(F.shiftright((F.abs(c) + more) * ((1 << SHIFT) // q) + rounding, SHIFT), F.lit(LARGEST))
        return F.when(c < 0, -size).otherwise(size).cast("int")

    return F.array(*(level(n) for n in range(16)))


def restored(levels: Column, dc: int, ac: int) -> Column:
    """Coefficients, row by row, of levels in zigzag order."""
    return F.array(*((F.get(levels, ZIGZAG.index(j)) * _steps(dc, ac)[j]).cast("int") for j in range(16)))


# -- token statistics -----------------------------------------------------------------


def contexts(blocks: DataFrame, levels: str = "levels") -> DataFrame:
    """``ctx`` of each block of a grid (picture_id, tx, ty): how many of its left and upper neighbours hold anything."""
    full = F.exists(levels, lambda v: v != 0).cast("int")
    at = ["picture_id", "tx", "ty"]
    own = blocks.select(*at, full.alias("full"))
    left = own.select("picture_id", (F.col("tx") + 1).alias("tx"), "ty", F.col("full").alias("left_full"))
    up = own.select("picture_id", "tx", (F.col("ty") + 1).alias("ty"), F.col("full").alias("up_full"))
    out = blocks.join(left, at, "left").join(up, at, "left")
    return out.withColumn("ctx", F.coalesce("left_full", F.lit(0)) + F.coalesce("up_full", F.lit(0))).drop("left_full", "up_full")


def token_counts(blocks: DataFrame, *keys: str) -> DataFrame:
    """(keys..., type, band, ctx, checked, token, n) of blocks (keys..., type, first, ctx, levels).

    ``token`` is the least level of its kind, -1 for the end of a block; ``checked`` says
    whether the end could have come there: not after a zero.
    """
    size = F.transform("levels", lambda v, n: F.when(n >= F.col("first"), F.abs(v)).otherwise(0))
    rows = blocks.select(*keys, "type", "first", "ctx", size.alias("size"))
    last = F.array_max(F.transform("size", lambda v, n: F.when(v > 0, n).otherwise(-1)))
    rows = rows.withColumn("last", F.greatest(last, F.col("first") - 1))

    def token(n: Column) -> Column:
        v, before = F.get("size", n), F.get("size", n - 1)
        start = n == F.col("first")
        kind = F.when(n > F.col("last"), -1)
        for least in sorted(PATHS, reverse=True):
            kind = kind.when(v >= least, least)
        ctx = F.when(start, F.col("ctx")).otherwise(F.least(before, F.lit(2)))
        return F.struct(_at(BANDS, n).alias("band"), ctx.cast("int").alias("ctx"), (start | (before > 0)).alias("checked"), kind.alias("token"))

    places = F.sequence(F.col("first"), F.least(F.col("last") + 1, F.lit(15)))
    rows = rows.select(*keys, "type", F.explode(F.transform(places, token)).alias("t")).select(*keys, "type", "t.*")
    return rows.groupBy(*keys, "type", "band", "ctx", "checked", "token").agg(F.count("*").alias("n"))


def branch_counts(blocks: DataFrame, *keys: str) -> DataFrame:
    """(keys..., type, band, ctx, node, n0, n1): how often each decision went either way."""
    counts = token_counts(blocks, *keys)
    kinds = F.when(F.col("token") == -1, F.array(_decision(0, 0)))
    for token, path in PATHS.items():
        kinds = kinds.when(F.col("token") == token, F.concat(F.when(F.col("checked"), F.array(_decision(0, 1))).otherwise(F.array().cast("array<struct<node:int,bit:int>>")), F.array(*(_decision(*d) for d in path))))
    rows = counts.select(*keys, "type", "band", "ctx", "n", F.explode(kinds).alias("d"))
    of = lambda bit: F.coalesce(F.sum(F.when(F.col("d.bit") == bit, F.col("n"))), F.lit(0)).alias(f"n{bit}")
    return rows.groupBy(*keys, "type", "band", "ctx", F.col("d.node").alias("node")).agg(of(0), of(1))


def _decision(node: int, bit: int) -> Column:
    return F.struct(F.lit(node).alias("node"), F.lit(bit).alias("bit"))


def _cost(bit: int, p: Column, costs: Sequence[int]) -> Column:
    return _at(costs, 255 - p if bit else p).cast("bigint")


def adapted(counts: DataFrame, current: DataFrame, costs: Sequence[int] = BIT_COSTS, least: int = 4) -> DataFrame:
    """For each node of ``counts``, whether its probability is worth sending anew.

    ``current`` rows are (type, band, ctx, node, prob, flag): flag is the probability that
    nothing changes.  The new probability is the observed share of 0, rounded, from 1 to
    255.  It is sent if ``least`` decisions were seen, it differs, and the decisions at
    the old one plus the flag cost more than at the new one plus the flag and 8 bits.
    """
    total = F.col("n0") + F.col("n1")
    rows = counts.join(current, ["type", "band", "ctx", "node"])
    seen = F.greatest(F.lit(1), F.least(F.lit(255), F.expr("(n0 * 256 + (n0 + n1) div 2) div greatest(n0 + n1, 1)"))).cast("int")
    rows = rows.withColumn("seen", seen)
    at = lambda p: F.col("n0") * _cost(0, F.col(p), costs) + F.col("n1") * _cost(1, F.col(p), costs)
    rows = rows.withColumn("keep_cost", at("prob") + _cost(0, F.col("flag"), costs)).withColumn("update_cost", at("seen") + _cost(1, F.col("flag"), costs) + 8 * 256)
    rows = rows.withColumn("updated", (total >= least) & (F.col("seen") != F.col("prob")) & (F.col("update_cost") < F.col("keep_cost")))
    new = F.when(F.col("updated"), F.col("seen")).otherwise(F.col("prob"))
    keep = [c for c in counts.columns if c not in ("n0", "n1")]
    return rows.select(*keep, "n0", "n1", "prob", new.alias("new_prob"), "updated", at("prob").alias("old_bits"), (F.when(F.col("updated"), F.col("update_cost")).otherwise(F.col("keep_cost"))).alias("new_bits"))


# -- cost tables ----------------------------------------------------------------------


def fixed_costs(costs: Sequence[int] = BIT_COSTS) -> list[int]:
    """Cost of the sign and the extra bits of each level."""
    out = [0]
    for level in range(1, LARGEST + 1):
        least = token_of(level)
        extra = EXTRA_BITS.get(least, ())
        bits = [level - least >> (len(extra) - 1 - k) & 1 for k in range(len(extra))]
        out.append(256 + sum(bit_cost(b, p, costs) for b, p in zip(bits, extra)))
    return out


def level_costs(probs: dict[tuple[int, int, int], int], costs: Sequence[int] = BIT_COSTS) -> list[list[int]]:
    """Cost of the decisions of levels 0 to 67 at each (position, context), in that order; ``probs`` is by (band, ctx, node)."""
    out = []
    for n in range(16):
        for ctx in range(CONTEXTS):
            p = [probs[BANDS[n], ctx, k] for k in range(NODES)]
            go = bit_cost(1, p[0], costs) if ctx else 0  # after a zero the end is not asked for; at the start the caller adds it
            out.append([go + sum(bit_cost(b, p[k], costs) for k, b in PATHS[token_of(v)]) for v in range(68)])
    return out


class CostTable:
    """A type's costs as columns; ``probs`` are its 264 probabilities."""

    def __init__(self, probs: dict[tuple[int, int, int], int], costs: Sequence[int] = BIT_COSTS):
        self.levels = level_costs(probs, costs)
        self.fixed = fixed_costs(costs)
        self.end = [[bit_cost(0, probs[BANDS[n], c, 0], costs) for c in range(CONTEXTS)] for n in range(16)]
        self.go = [[bit_cost(1, probs[BANDS[n], c, 0], costs) for c in range(CONTEXTS)] for n in range(16)]

    def level(self, n: Column, ctx: Column, level: Column) -> Column:
        at = (n * CONTEXTS + ctx) * 68 + F.least(level, F.lit(67))
        return F.get(_numbers([c for row in self.levels for c in row]), at.cast("int")) + F.get(_numbers(self.fixed), level.cast("int"))

    def ended(self, n: Column, ctx: Column) -> Column:
        """Cost of the end at position n; nothing after the last one."""
        return F.coalesce(_at([c for row in self.end for c in row], (n * CONTEXTS + ctx).cast("int")), F.lit(0))

    def begun(self, first: int, ctx: Column) -> Column:
        """What a block that is not empty costs at the start, beside its levels."""
        return F.when(ctx == 0, self.go[first][0]).otherwise(0)


def _bound(value: Column, f) -> Column:
    return F.transform(F.array(value), f)[0]


def residual_cost(levels: Column, ctx: Column, first: int, table: CostTable) -> Column:
    """Cost of the tokens, signs and extra bits of a block of levels in zigzag order."""
    last = F.array_max(F.transform(levels, lambda v, n: F.when((v != 0) & (n >= first), n).otherwise(-1)))

    def cost(last: Column) -> Column:
        def one(n: Column) -> Column:
            before = F.when(n == first, ctx).otherwise(F.least(F.abs(F.get(levels, n - 1)), F.lit(2)))
            return table.level(n, before, F.abs(F.get(levels, n))).cast("bigint")

        total = F.aggregate(F.transform(F.sequence(F.lit(first), last), one), F.lit(0).cast("bigint"), lambda a, b: a + b)
        end = table.ended(last + 1, F.least(F.abs(F.get(levels, last)), F.lit(2)))
        return F.when(last < first, table.ended(F.lit(first), ctx)).otherwise(table.begun(first, ctx) + total + end)

    return _bound(last, cost)


# -- trellis --------------------------------------------------------------------------


def trellis(block: Column, ctx: Column, first: int, table: CostTable, dc: int, ac: int, weight: int, kind: str = "light") -> Column:
    """(levels in zigzag order, score): the cheapest choice of the quotient or one more at each coefficient, and of the end.

    The score is cost times ``weight`` plus 256 times the weighted error against zeros.
    A fold over the positions holds, for both choices at the last one, the best score,
    its context and its levels, and the best block that ends so far.  Of equals the
    smaller level, and the earlier end, stays.
    """
    steps = _steps(dc, ac)
    inverse = [(1 << SHIFT) // q for q in steps]
    sharper = [s * q >> 11 if kind == "light" else 0 for s, q in zip(SHARPENING, steps)]

    def coefficient(n: int) -> Column:
        j = ZIGZAG[n]
        size = (F.abs(F.get(block, j)) + sharper[j]).cast("bigint")
        least = lambda rounding: F.least(F.shiftright(size * inverse[j] + rounding, SHIFT), F.lit(LARGEST).cast("bigint"))
        return F.struct(F.lit(n).alias("n"), size.alias("size"), F.lit(steps[j]).alias("step"), F.lit(WEIGHTS[j]).alias("weight"), least(0).alias("low"), least(1 << (SHIFT - 1)).alias("most"))

    limit = steps[1] * steps[1] // 4
    last = F.array_max(F.array(*(F.when(F.get(block, ZIGZAG[n]).cast("bigint") * F.get(block, ZIGZAG[n]) > limit, n).otherwise(first - 1) for n in range(first, 16))))
    places = F.slice(F.array(*(coefficient(n) for n in range(16))), first + 1, F.least(last + 1, F.lit(15)) - first + 1)
    nothing = F.array().cast("array<int>")
    node = lambda score, ctx, path: F.struct(score.cast("bigint").alias("score"), ctx.cast("int").alias("ctx"), path.alias("path"))
    start = node(table.begun(first, ctx) * weight, ctx, nothing)
    begin = F.struct(start.alias("a"), start.alias("b"), node(table.ended(F.lit(first), ctx) * weight, ctx, nothing).alias("best"))

    def step(held: Column, x: Column) -> Column:
        def choice(more: int) -> Column:
            level = x["low"] + more

            def reach(prior: str) -> Column:
                return held[prior]["score"] + table.level(x["n"], held[prior]["ctx"], level) * F.lit(weight)

            missed = x["size"] - level * x["step"]
            error = (missed * missed - x["size"] * x["size"]) * x["weight"] * ERROR_WEIGHT
            ctx = F.least(level, F.lit(2))

            def better(two: Column) -> Column:
                return node(F.least(two["a"], two["b"]) + error, ctx, F.concat(F.when(two["b"] < two["a"], held["b"]["path"]).otherwise(held["a"]["path"]), F.array(level.cast("int"))))

            found = _bound(F.struct(reach("a").alias("a"), reach("b").alias("b")), better)
            return F.when(level <= x["most"], found).otherwise(node(F.lit(_UNREACHED), ctx, nothing))

        def ended(best: Column, n: Column) -> Column:
            level = F.get(n["path"], F.size(n["path"]) - 1)
            total = n["score"] + table.ended(x["n"] + 1, n["ctx"]) * weight
            return F.when((level != 0) & (n["score"] < best["score"]) & (total < best["score"]), node(total, n["ctx"], n["path"])).otherwise(best)

        def settle(two: Column) -> Column:
            return _bound(ended(held["best"], two["a"]), lambda best: F.struct(two["a"].alias("a"), two["b"].alias("b"), ended(best, two["b"]).alias("best")))

        return _bound(F.struct(choice(0).alias("a"), choice(1).alias("b")), settle)

    def signed(best: Column) -> Column:
        level = lambda n: F.coalesce(F.get(best["path"], n - first) if n >= first else F.lit(None).cast("int"), F.lit(0))
        cells = [F.when(F.get(block, ZIGZAG[n]) < 0, -level(n)).otherwise(level(n)).cast("int") for n in range(16)]
        return F.struct(F.array(*cells).alias("levels"), best["score"].alias("score"))

    return F.aggregate(places, begin, step, lambda held: _bound(held["best"], signed))
