"""Queries of the block coding operators: motion, prediction, quantisers and statistics, each with SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import coefficients as K
from ..operators import deblock as Z
from ..operators import intra as I
from ..operators import matches as X
from ..operators import motion as M
from ..operators import paths as H
from ..operators import pixels as P
from ..operators import planes as N
from .inputs import FILM, PX, film, pixels, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def add(name: str, build: Query, sql: str | None = None) -> None:
    _QUERIES[name] = build
    if sql:
        _SQL[name] = sql


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- motion ---------------------------------------------------------------------------

_FRAME = ("picture_id", "frame_idx")


def _film_planes(spark: SparkSession, d: str) -> DataFrame:
    return N.to_planes(film(spark, d), 32, 32, *_FRAME, luma=F.col("r"))


def _whole(size: int, radius: int) -> Query:
    def build(spark: SparkSession, d: str) -> DataFrame:
        found = M.vectors(_film_planes(spark, d), size, radius, fine=False)
        return found.select(*_FRAME, "tx", "ty", F.expr("mv_col div 4").cast("int").alias("dx"), F.expr("mv_row div 4").cast("int").alias("dy"), "sad", "offsets")

    return build


def _whole_sql(size: int, radius: int) -> str:
    return f"""WITH {FILM},
o AS (SELECT CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy FROM (SELECT unnest(range({-radius}, {radius + 1})) AS dx), (SELECT unnest(range({-radius}, {radius + 1})) AS dy)),
t AS (SELECT CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, dx, dy FROM (SELECT unnest(range({32 // size})) AS tx), (SELECT unnest(range({32 // size})) AS ty), o
  WHERE tx * {size} + dx BETWEEN 0 AND {32 - size} AND ty * {size} + dy BETWEEN 0 AND {32 - size}),
c AS (SELECT picture_id, frame_idx, list(r ORDER BY y, x) AS v FROM film GROUP BY ALL),
i AS (SELECT CAST(i % {size} AS INTEGER) AS i, CAST(i // {size} AS INTEGER) AS j FROM (SELECT unnest(range({size * size})) AS i)),
s AS (SELECT n.picture_id, n.frame_idx, tx, ty, dx, dy, CAST(sum(abs(n.v[(ty * {size} + j) * 32 + tx * {size} + i + 1] - p.v[(ty * {size} + j + dy) * 32 + tx * {size} + i + dx + 1])) AS BIGINT) AS sad
  FROM c n JOIN c p ON p.picture_id = n.picture_id AND p.frame_idx = n.frame_idx - 1, t, i GROUP BY ALL)
SELECT *, CAST(count(*) OVER (PARTITION BY picture_id, frame_idx, tx, ty) AS INTEGER) AS offsets FROM s
QUALIFY row_number() OVER (PARTITION BY picture_id, frame_idx, tx, ty ORDER BY sad, dx <> 0 OR dy <> 0, dy, dx) = 1"""


for _size, _radius in ((16, 16), (8, 5)):
    add(f"motion_whole_{_size}", _whole(_size, _radius), _whole_sql(_size, _radius))


def _all_planes(spark: SparkSession, d: str) -> DataFrame:
    """Light as it is; colour differences of every second place."""
    px = film(spark, d)
    small = px.filter((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)).withColumns({c: F.expr(f"{c} div 2").cast("int") for c in "xy"})
    chroma = N.to_planes(small, 16, 16, *_FRAME, cb=F.col("g"), cr=F.col("b"))
    return N.to_planes(px, 32, 32, *_FRAME, luma=F.col("r")).join(chroma.select(*_FRAME, "cb", "cr"), [*_FRAME])


add("motion_fine", lambda spark, d: M.vectors(_all_planes(spark, d), 16, 16, True, 16_384).drop("compared"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """Pixels as blocks with small vectors: red and green as vector, blue as reference frame."""
    small = lambda c: (F.col(c) % 3 - 1).cast("int")
    return pixels(spark, d).select("picture_id", F.lit(0).alias("frame_idx"), F.col("x").alias("tx"), F.col("y").alias("ty"), small("r").alias("mv_row"), small("g").alias("mv_col"), (F.col("b") % 4).alias("ref"))


def _vote_sql() -> str:
    near = {"a": "o.tx = n.tx AND o.ty = n.ty - 1", "l": "o.tx = n.tx - 1 AND o.ty = n.ty", "c": "o.tx = n.tx - 1 AND o.ty = n.ty - 1"}
    joins = " ".join(f"LEFT JOIN b {k} ON {k}.picture_id = n.picture_id AND {k}.ref > 0 AND {cond.replace('o.', k + '.')}" for k, cond in near.items())
    turned = ", ".join(f"CASE WHEN {k}.ref IS NULL THEN NULL WHEN ({k}.ref = 2) <> (n.ref = 2) THEN [-{k}.mr, -{k}.mc] ELSE [{k}.mr, {k}.mc] END AS {k}" for k in near)
    walk = ""
    state = "SELECT *, [0, 0] AS last, 0 AS top, [0, 0, 0, 0] AS cnt, [[0, 0], [0, 0], [0, 0], [0, 0]] AS mv FROM t"
    for k, (name, w) in enumerate((("a", 2), ("l", 2), ("c", 1))):
        slot = f"CASE WHEN {name} IS NULL THEN NULL WHEN {name} = [0, 0] THEN 0 WHEN {name} = last THEN top ELSE top + 1 END"
        walk += f", w{k} AS (SELECT *, {slot} AS s FROM ({state}))"
        state = f"""SELECT * EXCLUDE (s, last, top, cnt, mv), CASE WHEN s > 0 THEN {name} ELSE last END AS last, greatest(top, coalesce(s, 0)) AS top,
list_transform(cnt, lambda v, i: v + CASE WHEN i = s + 1 THEN {w} ELSE 0 END) AS cnt, list_transform(mv, lambda v, i: CASE WHEN s > 0 AND i = s + 1 THEN {name} ELSE v END) AS mv FROM w{k}"""
    return f"""WITH {PX}, b AS (SELECT picture_id, x AS tx, y AS ty, r % 3 - 1 AS mr, g % 3 - 1 AS mc, b % 4 AS ref FROM px),
t AS (SELECT n.picture_id, n.tx, n.ty, {turned} FROM b n {joins}){walk},
e AS ({state}),
f AS (SELECT *, cnt[1] AS n0, cnt[2] + CASE WHEN cnt[4] > 0 AND mv[4] = mv[2] THEN 1 ELSE 0 END AS n1, cnt[3] AS n2 FROM e),
h AS (SELECT *, n2 > n1 AS sw, CASE WHEN n2 > n1 THEN mv[3] ELSE mv[2] END AS m1, CASE WHEN n2 > n1 THEN mv[2] ELSE mv[3] END AS m2 FROM f)
SELECT picture_id, 0 AS frame_idx, tx, ty, m1[1] AS nearest_row, m1[2] AS nearest_col, m2[1] AS near_row, m2[2] AS near_col,
CASE WHEN greatest(n1, n2) >= n0 THEN m1[1] ELSE 0 END AS best_row, CASE WHEN greatest(n1, n2) >= n0 THEN m1[2] ELSE 0 END AS best_col,
n0 AS zero_votes, greatest(n1, n2) AS nearest_votes, least(n1, n2) AS near_votes FROM h"""


add("motion_vote", lambda spark, d: M.neighbour_vote(_grid(spark, d), golden_bias=True), _vote_sql())


def _tap_sql(taps: tuple[int, ...], source: str, axis: str) -> str:
    keep = "y" if axis == "x" else "x"
    at = lambda k: f"greatest(0, least(7, {axis} + {k - 2})) + 1"
    total = " + ".join(f"{t} * vs[{at(k)}]" for k, t in enumerate(taps))
    return f"""(SELECT picture_id, x, y, CAST(greatest(0, least(255, ({total} + 64) >> 7)) AS INTEGER) AS v
FROM {source} JOIN (SELECT picture_id, {keep}, list(v ORDER BY {axis}) AS vs FROM {source} GROUP BY picture_id, {keep}) USING (picture_id, {keep}))"""


for _name, _dx, _dy in (("half", 4, 4), ("mixed", 3, 6), ("whole", 0, 0)):
    add(
        f"sub_sample_{_name}",
        lambda spark, d, dx=_dx, dy=_dy: N.to_samples(N.shifted(N.to_planes(pixels(spark, d), 8, 8, v=F.col("r")), dx, dy, "v"), "v"),
        f"WITH {PX}, s0 AS (SELECT picture_id, x, y, r AS v FROM px), s1 AS {_tap_sql(N.SIX_TAPS[_dx], 's0', 'x')}, s2 AS {_tap_sql(N.SIX_TAPS[_dy], 's1', 'y')} SELECT * FROM s2",
    )


# -- token statistics and the trellis ---------------------------------------------------


def _flat(px: DataFrame) -> DataFrame:
    """Frames as pictures of their own."""
    return px.withColumn("picture_id", F.col("picture_id") * 1000 + F.col("frame_idx"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the film's red against its middle, as levels of twelve in zigzag order."""
    blocks = B.gathered(_flat(film(spark, d)), F.col("r") - 128)
    level = lambda j: F.expr(f"cast(block[{j}] div 12 as int)")
    kind = ((F.col("tx") + F.col("ty")) % 4).cast("int")
    rows = blocks.select("picture_id", "tx", "ty", kind.alias("type"), F.array(*map(level, K.ZIGZAG)).alias("levels"))
    return K.contexts(rows).withColumn("first", (F.col("type") == 0).cast("int"))


_LEVELS = f"""{FILM},
b0 AS (SELECT picture_id * 1000 + frame_idx AS picture_id, x // 4 AS tx, y // 4 AS ty, list(CAST(trunc((r - 128) / 12) AS INTEGER) ORDER BY y % 4, x % 4) AS b FROM f1 GROUP BY ALL),
b1 AS (SELECT picture_id, tx, ty, CAST((tx + ty) % 4 AS INTEGER) AS type, list_transform({list(K.ZIGZAG)}, lambda j: b[j + 1]) AS l, len(list_filter(b, lambda v: v <> 0)) > 0 AS f FROM b0),
b2 AS (SELECT b1.*, CAST(b1.type = 0 AS INTEGER) AS first, CAST(coalesce(u.f, false) AS INTEGER) + CAST(coalesce(s.f, false) AS INTEGER) AS ctx FROM b1
  LEFT JOIN b1 u ON u.picture_id = b1.picture_id AND u.tx = b1.tx AND u.ty = b1.ty - 1 LEFT JOIN b1 s ON s.picture_id = b1.picture_id AND s.tx = b1.tx - 1 AND s.ty = b1.ty),
b3 AS (SELECT *, coalesce(list_max(list_filter(range(first, 16), lambda n: l[n + 1] <> 0)), first - 1) AS last FROM b2),
b4 AS (SELECT *, unnest(range(first, least(last + 1, 15) + 1)) AS n FROM b3),
b5 AS (SELECT *, abs(l[n + 1]) AS v, n = first OR l[n] <> 0 AS checked, CASE WHEN n = first THEN ctx ELSE least(abs(l[n]), 2) END AS c, {list(K.BANDS)}[n + 1] AS band FROM b4),
tk(node, lo, hi, bit) AS (VALUES (1, 0, 0, 0), (1, 1, 9999, 1), (2, 1, 1, 0), (2, 2, 9999, 1), (3, 2, 4, 0), (3, 5, 9999, 1), (4, 2, 2, 0), (4, 3, 4, 1), (5, 3, 3, 0), (5, 4, 4, 1),
  (6, 5, 10, 0), (6, 11, 9999, 1), (7, 5, 6, 0), (7, 7, 10, 1), (8, 11, 34, 0), (8, 35, 9999, 1), (9, 11, 18, 0), (9, 19, 34, 1), (10, 35, 66, 0), (10, 67, 9999, 1)),
dc AS (SELECT b5.*, node, bit FROM b5 JOIN tk ON n <= last AND v BETWEEN lo AND hi UNION ALL SELECT b5.*, 0 AS node, CAST(n <= last AS INTEGER) AS bit FROM b5 WHERE checked),
bc AS (SELECT type, CAST(band AS INTEGER) AS band, CAST(c AS INTEGER) AS ctx, node, count(*) FILTER (bit = 0) AS n0, count(*) FILTER (bit = 1) AS n1 FROM dc GROUP BY ALL)"""

add("token_branches", lambda spark, d: K.branch_counts(_levels(spark, d)), f"WITH {_LEVELS} SELECT * FROM bc")


def _rule(band: Column, ctx: Column, node: Column) -> tuple[Column, Column]:
    """Probabilities by a rule, as a frame before could have left them: (of 0, of no change)."""
    return 96 + (node * 37 + ctx * 11 + band * 5) % 120, 180 + (node + band) % 70


_RULE_SQL = ("96 + (node * 37 + {c} * 11 + band * 5) % 120", "180 + (node + band) % 70")


def _current(spark: SparkSession) -> DataFrame:
    """The fixed number of nodes: 4 types, 8 bands, 3 contexts, 11 nodes."""
    k = spark.range(4 * 8 * K.CONTEXTS * K.NODES).withColumn("id", F.col("id").cast("int"))
    at = lambda size, count: F.expr(f"cast(id div {size} % {count} as int)")
    rows = k.select(at(264, 4).alias("type"), at(33, 8).alias("band"), at(11, 3).alias("ctx"), at(1, 11).alias("node"))
    prob, flag = _rule(F.col("band"), F.col("ctx"), F.col("node"))
    return rows.withColumns({"prob": prob.cast("int"), "flag": flag.cast("int")})


def _bits(bit: str, p: str) -> str:
    q = f"(CASE WHEN {bit} = 1 THEN 255 - ({p}) ELSE {p} END)"
    return f"CAST(least(1792, round(-256 * log2(greatest({q}, 1) / 256.0))) AS BIGINT)"


def _adapted_sql() -> str:
    prob, flag = (r.format(c="ctx") for r in _RULE_SQL)
    at = lambda p: f"n0 * {_bits('0', p)} + n1 * {_bits('1', p)}"
    return f"""WITH {_LEVELS},
p AS (SELECT *, CAST({prob} AS INTEGER) AS prob, {flag} AS flag, CAST(greatest(1, least(255, (n0 * 256 + (n0 + n1) // 2) // greatest(n0 + n1, 1))) AS INTEGER) AS seen FROM bc),
k AS (SELECT *, {at('prob')} AS old_bits, {at('prob')} + {_bits('0', 'flag')} AS keep, {at('seen')} + {_bits('1', 'flag')} + 2048 AS send FROM p),
u AS (SELECT *, n0 + n1 >= 4 AND seen <> prob AND send < keep AS updated FROM k)
SELECT type, band, ctx, node, n0, n1, prob, CASE WHEN updated THEN seen ELSE prob END AS new_prob, updated, old_bits, CASE WHEN updated THEN send ELSE keep END AS new_bits FROM u"""


add("token_adaptation", lambda spark, d: K.adapted(K.branch_counts(_levels(spark, d)), _current(spark)), _adapted_sql())


def _ruled() -> dict[tuple[int, int, int], int]:
    return {(b, c, n): 96 + (n * 37 + c * 11 + b * 5) % 120 for b in range(8) for c in range(K.CONTEXTS) for n in range(K.NODES)}


def _block_cost(spark: SparkSession, d: str) -> DataFrame:
    rows = _levels(spark, d)
    cost = F.when(F.col("first") == 1, K.residual_cost(F.col("levels"), F.col("ctx"), 1, table := K.CostTable(_ruled()))).otherwise(K.residual_cost(F.col("levels"), F.col("ctx"), 0, table))
    return rows.select("picture_id", "tx", "ty", cost.alias("cost"))


def _block_cost_sql() -> str:
    extra = ", ".join(f"({least}, {next((t for t in sorted(K.PATHS) if t > least), 9999) - 1}, {k}, {len(ps)}, {p})" for least, ps in K.EXTRA_BITS.items() for k, p in enumerate(ps))
    return f"""WITH {_LEVELS}, ex(lo, hi, k, m, p) AS (VALUES {extra}),
c AS (SELECT picture_id, tx, ty, {_bits('bit', _RULE_SQL[0].format(c='c'))} AS cost FROM dc
  UNION ALL SELECT picture_id, tx, ty, 256 FROM b5 WHERE v > 0
  UNION ALL SELECT picture_id, tx, ty, {_bits('((v - lo) >> (m - 1 - k)) % 2', 'p')} FROM b5 JOIN ex ON v BETWEEN lo AND hi)
SELECT picture_id, tx, ty, CAST(sum(cost) AS BIGINT) AS cost FROM c GROUP BY ALL"""


add("token_block_cost", _block_cost, _block_cost_sql())


def _coefficients(spark: SparkSession, d: str) -> DataFrame:
    blocks = B.gathered(_flat(film(spark, d)), F.col("r") - 128)
    return blocks.select("picture_id", "tx", "ty", B.forward_dct(F.col("block")).alias("block"))


def _text(levels: Column) -> Column:
    return F.array_join(levels.cast("array<string>"), ",")


_ROUND = [f"({j}, {K.SHARPENING[j] * (28 if j == 0 else 33) >> 11}, {(1 << 17) // (28 if j == 0 else 33)}, {(96 if j == 0 else 110) << 9}, {n})" for n, j in enumerate(K.ZIGZAG)]
add(
    "quantise_light",
    lambda spark, d: B.gathered(pixels(spark, d), (F.col("r") - 128) * 9).select("picture_id", "tx", "ty", _text(K.quantised(F.col("block"), 28, 33)).alias("levels"), _text(K.restored(K.quantised(F.col("block"), 28, 33), 28, 33)).alias("restored")),
    f"""WITH {PX}, q(j, more, inv, half, n) AS (VALUES {', '.join(_ROUND)}),
s AS (SELECT picture_id, x // 4 AS tx, y // 4 AS ty, y % 4 * 4 + x % 4 AS j, (r - 128) * 9 AS v FROM px),
l AS (SELECT s.*, q.n, CAST(sign(v) AS INTEGER) * least(2047, ((abs(v) + more) * inv + half) >> 17) AS level FROM s JOIN q USING (j))
SELECT picture_id, tx, ty, string_agg(level, ',' ORDER BY n) AS levels, string_agg(level * CASE WHEN j = 0 THEN 28 ELSE 33 END, ',' ORDER BY j) AS restored FROM l GROUP BY ALL""",
)


def _trellis(spark: SparkSession, d: str) -> DataFrame:
    """Levels by the trellis under the probabilities that the plain levels ask for."""
    plain = _coefficients(spark, d).select("picture_id", "tx", "ty", F.lit(3).alias("type"), F.lit(0).alias("first"), K.quantised(F.col("block"), 28, 33).alias("levels"), "block")
    rows = K.contexts(plain)
    found = K.adapted(K.branch_counts(rows), _current(spark)).select("band", "ctx", "node", "new_prob").collect()  # at most 264 nodes of one type
    probs = _ruled() | {(r["band"], r["ctx"], r["node"]): r["new_prob"] for r in found}
    best = K.trellis(F.col("block"), F.col("ctx"), 0, K.CostTable(probs), 28, 33, 40)
    return rows.select("picture_id", "tx", "ty", best.alias("t")).select("picture_id", "tx", "ty", _text(F.col("t.levels")).alias("levels"), F.col("t.score").alias("score"))


add("trellis_light", _trellis)


# -- prediction inside a frame ----------------------------------------------------------


def _film_full(spark: SparkSession, d: str) -> DataFrame:
    """The film with its empty places as zeros, frames as pictures."""
    planes = N.to_planes(_flat(film(spark, d)), 32, 32, r=F.col("r"), g=F.col("g"), b=F.col("b"))
    parts = [N.to_samples(planes, c).withColumnRenamed("v", c) for c in "rgb"]
    return parts[0].join(parts[1], ["picture_id", "x", "y"]).join(parts[2], ["picture_id", "x", "y"])


def _residual_text(df: DataFrame, *names: str) -> DataFrame:
    return df.select("picture_id", "tx", "ty", "mode", "score", *(_text(F.col(f"{n}_residual")).alias(f"{n}_residual") for n in names))


#: The directional modes cell by cell: A to H above, P the corner, I to L to the left; two letters are their mean, three their weighted mean.
_CELLS = {
    2: "PAB ABC BCD CDE PAB ABC BCD CDE PAB ABC BCD CDE PAB ABC BCD CDE",
    3: "PIJ PIJ PIJ PIJ IJK IJK IJK IJK JKL JKL JKL JKL KLL KLL KLL KLL",
    4: "IPA PAB ABC BCD PIJ IPA PAB ABC IJK PIJ IPA PAB JKL IJK PIJ IPA",
    5: "PA AB BC CD IPA PAB ABC BCD JIP PA AB BC KJI IPA PAB ABC",
    6: "ABC BCD CDE DEF BCD CDE DEF EFG CDE DEF EFG FGH DEF EFG FGH GHH",
    7: "AB BC CD DE ABC BCD CDE DEF BC CD DE EF BCD CDE DEF EFG",
    8: "IP IPA PAB ABC JI JIP IP IPA KJ KJI JI JIP LK LKJ KJ KJI",
    9: "IJ IJK JK JKL JK JKL KL KLL KL KLL L L L L L L",
}


def _cell_sql(letters: str) -> str:
    if len(letters) == 1:
        return f"p{letters}"
    if len(letters) == 2:
        return f"(p{letters[0]} + p{letters[1]} + 1) >> 1"
    return f"(p{letters[0]} + 2 * p{letters[1]} + p{letters[2]} + 2) >> 2"


def _small_sql(weight: int) -> str:
    at = lambda y, x: f"v[({y}) * 8 + ({x}) + 1]"
    above = [f"CASE WHEN ty = 0 THEN 127 ELSE {at('ty * 4 - 1', f'least(tx * 4 + {i}, 7)')} END AS p{c}" for i, c in enumerate("ABCDEFGH")]
    left = [f"CASE WHEN tx = 0 THEN 129 ELSE {at(f'ty * 4 + {i}', 'tx * 4 - 1')} END AS p{c}" for i, c in enumerate("IJKL")]
    own = "[" + ", ".join(at(f"ty * 4 + {k // 4}", f"tx * 4 + {k % 4}") for k in range(16)) + "]"
    modes = {0: ["(4 + pA + pB + pC + pD + pI + pJ + pK + pL) >> 3"] * 16, 1: [f"greatest(0, least(255, p{a} + p{b} - pP))" for b in "IJKL" for a in "ABCD"]}
    modes |= {m: [_cell_sql(c) for c in cells.split()] for m, cells in _CELLS.items()}
    guess = " UNION ALL ".join(f"SELECT picture_id, tx, ty, own, {m} AS mode, [{', '.join(cells)}] AS p FROM e" for m, cells in modes.items())
    return f"""WITH {PX}, c AS (SELECT picture_id, list(r ORDER BY y, x) AS v FROM px GROUP BY ALL),
e AS (SELECT picture_id, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, {own} AS own, {', '.join(above + left)}, CASE WHEN tx = 0 OR ty = 0 THEN 128 ELSE {at('ty * 4 - 1', 'tx * 4 - 1')} END AS pP
  FROM c, (SELECT unnest([0, 1]) AS tx), (SELECT unnest([0, 1]) AS ty)),
g AS ({guess}),
s AS (SELECT *, list_transform(list_zip(own, p), lambda z: z[1] - z[2]) AS d, {I.small_costs()}[mode + 1] * {weight} AS extra FROM g),
t AS (SELECT *, CAST(256 * list_sum(list_transform(d, lambda v: v * v)) + extra AS BIGINT) AS score FROM s)
SELECT picture_id, tx, ty, mode, score, array_to_string(d, ',') AS v_residual FROM t QUALIFY row_number() OVER (PARTITION BY picture_id, tx, ty ORDER BY score, mode) = 1"""


add("intra_small", lambda spark, d: _residual_text(I.small_modes(pixels(spark, d), F.col("r"), 40), "v"), _small_sql(40))


def _whole_modes_sql(size: int, names: dict[str, str], costs: tuple[int, ...], weight: int) -> str:
    n, parts, errors, texts = 32 // size, [], [], []
    for k, c in names.items():
        at = lambda y, x, c=c: f"{c}[({y}) * 32 + ({x}) + 1]"
        top, left = f"list_transform(range({size}), lambda i: {at(f'ty * {size} - 1', f'tx * {size} + i')})", f"list_transform(range({size}), lambda i: {at(f'ty * {size} + i', f'tx * {size} - 1')})"
        parts += [
            f"list_transform(range({size * size}), lambda i: {at(f'ty * {size} + i // {size}', f'tx * {size} + i % {size}')}) AS {k}",
            f"CASE WHEN ty = 0 THEN list_transform(range({size}), lambda i: 127) ELSE {top} END AS {k}t",
            f"CASE WHEN tx = 0 THEN list_transform(range({size}), lambda i: 129) ELSE {left} END AS {k}l",
            f"CASE WHEN tx = 0 OR ty = 0 THEN 128 ELSE {at(f'ty * {size} - 1', f'tx * {size} - 1')} END AS {k}c",
        ]
        mean = f"CASE WHEN tx = 0 AND ty = 0 THEN 128 WHEN tx = 0 THEN (list_sum({k}t) + {size // 2}) // {size} WHEN ty = 0 THEN (list_sum({k}l) + {size // 2}) // {size} ELSE (list_sum({k}t) + list_sum({k}l) + {size}) // {2 * size} END"
        cell = f"CASE mode WHEN 0 THEN {mean} WHEN 1 THEN {k}t[i % {size} + 1] WHEN 2 THEN {k}l[i // {size} + 1] ELSE greatest(0, least(255, {k}t[i % {size} + 1] + {k}l[i // {size} + 1] - {k}c)) END"
        errors.append(f"list_transform(range({size * size}), lambda i: CAST({k}[i + 1] - ({cell}) AS INTEGER)) AS {k}d")
        texts.append(f"array_to_string({k}d, ',') AS {k}_residual")
    total = " + ".join(f"list_sum(list_transform({k}d, lambda v: CAST(v AS BIGINT) * v))" for k in names)
    return f"""WITH {FILM}, c AS (SELECT picture_id * 1000 + frame_idx AS picture_id, {', '.join(f'list({c} ORDER BY y, x) AS {c}' for c in set(names.values()))} FROM film GROUP BY ALL),
e AS (SELECT picture_id, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty, {', '.join(parts)} FROM c, (SELECT unnest(range({n})) AS tx), (SELECT unnest(range({n})) AS ty)),
s AS (SELECT *, {', '.join(errors)} FROM e, (SELECT unnest([0, 1, 2, 3]) AS mode)),
t AS (SELECT *, CAST(256 * ({total}) + {list(costs)}[mode + 1] * {weight} AS BIGINT) AS score FROM s)
SELECT picture_id, tx, ty, mode, score, {', '.join(texts)} FROM t QUALIFY row_number() OVER (PARTITION BY picture_id, tx, ty ORDER BY score, mode) = 1"""


add("intra_light", lambda spark, d: _residual_text(I.whole_modes(_film_full(spark, d), 16, v=F.col("r")), "v"), _whole_modes_sql(16, {"v": "r"}, I.LIGHT_COSTS, I.LIGHT_WEIGHT))
add(
    "intra_colour",
    lambda spark, d: _residual_text(I.whole_modes(_film_full(spark, d), 8, I.COLOUR_COSTS, I.COLOUR_WEIGHT, cb=F.col("g"), cr=F.col("b")), "cb", "cr"),
    _whole_modes_sql(8, {"cb": "g", "cr": "b"}, I.COLOUR_COSTS, I.COLOUR_WEIGHT),
)


# -- planes, matches and the loop filter --------------------------------------------------


def _half_planes(spark: SparkSession, d: str) -> DataFrame:
    """Each picture as the half-size plane of one of 15 x 16."""
    return N.to_planes(pixels(spark, d), 8, 8, v=F.col("g")).withColumns({"width": F.lit(15), "height": F.lit(16)})


def _up_sql() -> str:
    at = lambda y, x: f"v[({y}) * 8 + ({x}) + 1]"
    return f"""WITH {PX}, c AS (SELECT picture_id, list(g ORDER BY y, x) AS v FROM px GROUP BY ALL),
p AS (SELECT *, CAST(i % 15 AS INTEGER) AS x, CAST(i // 15 AS INTEGER) AS y FROM c, (SELECT unnest(range(240)) AS i)),
k AS (SELECT *, x // 2 + x % 2 AS xr, (x + 1) // 2 - 1 AS xl, least(7, y // 2 + y % 2) AS yb, greatest(0, (y + 1) // 2 - 1) AS yt FROM p),
n AS (SELECT *, CASE WHEN x % 2 = 0 THEN xr ELSE xl END AS xn, CASE WHEN x % 2 = 0 THEN xl ELSE xr END AS xo, CASE WHEN y % 2 = 0 THEN yb ELSE yt END AS yn, CASE WHEN y % 2 = 0 THEN yt ELSE yb END AS yo FROM k)
SELECT picture_id, x, y, CAST(CASE WHEN x = 0 THEN (3 * {at('yn', 'xn')} + {at('yo', 'xn')} + 2) >> 2
  ELSE ((({at('yn', 'xn')} + {at('yo', 'xo')} + 3 * ({at('yo', 'xn')} + {at('yn', 'xo')}) + 8) >> 3) + {at('yn', 'xn')}) >> 1 END AS INTEGER) AS v FROM n"""


add("chroma_up_sampled", lambda spark, d: N.to_samples(N.full_size(_half_planes(spark, d), "v"), "v"), _up_sql())


def _coarse(spark: SparkSession, d: str) -> DataFrame:
    """Frames of four colours, so that runs repeat."""
    px = pixels(spark, d).withColumns({"a": F.lit(255), "r": F.expr("r div 64").cast("int"), "g": F.lit(0), "b": F.lit(0)})
    return P.to_frames(px, 8, 8)


_MATCHES = f"""{PX}, c AS (SELECT picture_id, list(r // 64 ORDER BY y, x) AS v FROM px GROUP BY ALL),
p AS (SELECT picture_id, v, CAST(unnest(range(64)) AS INTEGER) AS place FROM c),
q AS (SELECT *, CAST(unnest(range(1, place + 1)) AS INTEGER) AS distance FROM p),
l AS (SELECT picture_id, place, distance, CAST(coalesce(list_position(list_transform(range(place, 64), lambda i: v[i + 1] = v[i - distance + 1]), false) - 1, 64 - place) AS INTEGER) AS length FROM q),
b AS (SELECT * FROM l WHERE length >= 4 QUALIFY row_number() OVER (PARTITION BY picture_id, place ORDER BY length DESC, distance) = 1)"""

add(
    "longest_match",
    lambda spark, d: X.longest_matches(_coarse(spark, d)),
    f"WITH {_MATCHES} SELECT picture_id, place, coalesce(b.length, 0) AS length, coalesce(b.distance, 0) AS distance FROM p LEFT JOIN b USING (picture_id, place)",
)
add(
    "longest_match_tokens",
    lambda spark, d: X.tokens(X.longest_matches(_coarse(spark, d))),
    f"""WITH RECURSIVE {_MATCHES}, m AS (SELECT picture_id, place, coalesce(b.length, 1) AS length, coalesce(b.distance, 0) AS distance FROM p LEFT JOIN b USING (picture_id, place)),
t AS (SELECT * FROM m WHERE place = 0 UNION ALL SELECT m.* FROM t JOIN m ON m.picture_id = t.picture_id AND m.place = t.place + t.length) SELECT * FROM t""",
)


def _deblocked(simple: bool) -> Query:
    def build(spark: SparkSession, d: str) -> DataFrame:
        px = _flat(film(spark, d))
        blocks = px.select("picture_id", F.expr("x div 16").cast("int").alias("tx"), F.expr("y div 16").cast("int").alias("ty")).distinct()
        level = Z.block_level(F.lit(24), (F.col("picture_id") % 5 * 6).cast("int"), F.when(F.col("tx") == F.col("ty"), 8).otherwise(-4))
        blocks = blocks.select("picture_id", "tx", "ty", level.alias("level"), (F.col("tx") != F.col("ty")).alias("inner"))
        planes = N.to_planes(px, 32, 32, luma=F.expr("100 + r div 8"))
        return N.to_samples(Z.deblocked(Z.with_levels(planes, blocks, 2, 2), 2, simple), "luma")

    return build


add("loop_filter_normal", _deblocked(False))
add("loop_filter_simple", _deblocked(True))


# -- paths ------------------------------------------------------------------------------

#: The segments of each supplier's shape: (kind, points as SQL over k = s_suppkey).
_PATH = (
    ("M", [("k % 7", "k % 5")]),
    ("L", [("20 + k % 11", "k % 3")]),
    ("Q", [("40", "4 + k % 13"), ("24 + k % 5", "24")]),
    ("C", [("12", "40 + k % 9"), ("4 - k % 17", "20"), ("k % 4", "16 + k % 8")]),
    ("Z", []),
    ("M", [("8 + k % 6", "8")]),
    ("L", [("16", "8 + k % 10")]),
    ("L", [("8", "16")]),
    ("Z", []),
)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    doubles = lambda values: f"cast(array({', '.join(values)}) as array<double>)"
    parts = [f"struct({i} as seg, '{kind}' as kind, {doubles([p[0] for p in points])} as xs, {doubles([p[1] for p in points])} as ys)" for i, (kind, points) in enumerate(_PATH)]
    return k.select(F.col("k").alias("picture_id"), F.explode(F.expr(f"array({', '.join(parts)})")).alias("s")).select("picture_id", "s.*")


def _flat_sql() -> str:
    """Points (picture_id, seg, step, x, y) of the flattened shapes, moves as step 0 and without closing lines."""
    parts, here = [], ("0", "0")
    for i, (kind, points) in enumerate(_PATH):
        if kind == "Z":
            here = next(p[-1] for k, p in reversed(_PATH[:i]) if k == "M")
            continue
        if kind in "ML":
            parts.append(f"SELECT k, {i} AS seg, {int(kind == 'L')} AS step, CAST({points[-1][0]} AS DOUBLE) AS x, CAST({points[-1][1]} AS DOUBLE) AS y FROM s")
        else:
            (x, y), ps = here, points
            bends = [(x, y), *ps]
            gaps = [f"sqrt(power({bends[j][0]} - 2 * ({bends[j + 1][0]}) + {bends[j + 2][0]}, 2.0) + power({bends[j][1]} - 2 * ({bends[j + 1][1]}) + {bends[j + 2][1]}, 2.0))" for j in range(len(bends) - 2)]
            bend = f"greatest({', '.join(gaps)}) * {0.25 if kind == 'Q' else 0.75}" if len(gaps) > 1 else f"{gaps[0]} * 0.25"
            n = f"CAST(power(2, least(10, greatest(0, ceil(log2(greatest({bend}, 1e-9)) / 2)))) AS INTEGER)"
            weights = ("(1 - t) * (1 - t)", "2 * t * (1 - t)", "t * t") if kind == "Q" else ("(1 - t) * (1 - t) * (1 - t)", "3 * t * (1 - t) * (1 - t)", "3 * t * t * (1 - t)", "t * t * t")
            at = lambda axis, w=weights, b=bends: " + ".join(f"{c} * ({p[axis]})" for c, p in zip(w, b))
            parts.append(f"SELECT k, {i} AS seg, step, {at(0)} AS x, {at(1)} AS y FROM (SELECT k, n, step, CAST(step AS DOUBLE) / n AS t FROM (SELECT k, {n} AS n, CAST(unnest(range(1, {n} + 1)) AS INTEGER) AS step FROM s))")
        here = points[-1]
    return "s AS (SELECT s_suppkey AS k FROM supplier), f AS (" + " UNION ALL ".join(parts) + ")"


add(
    "path_flattened",
    lambda spark, d: H.flattened(_segments(spark, d), ["picture_id"]).filter("seg NOT IN (4, 8)").select("picture_id", "seg", "step", F.floor(F.col("xb") + 0.5).cast("int").alias("x"), F.floor(F.col("yb") + 0.5).cast("int").alias("y")),
    f"WITH {_flat_sql()} SELECT k AS picture_id, seg, step, CAST(floor(x + 0.5) AS INTEGER) AS x, CAST(floor(y + 0.5) AS INTEGER) AS y FROM f WHERE step > 0",
)
add(
    "path_fill",
    lambda spark, d: H.fill_path(_segments(spark, d), ["picture_id"]),
    f"""WITH {_flat_sql()}, p AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY seg, step) AS i, count(*) OVER (PARTITION BY k) AS n, CAST(floor(x + 0.5) AS INTEGER) AS x, CAST(floor(y + 0.5) AS INTEGER) AS y FROM f),
e AS (SELECT a.k, a.x AS xi, a.y AS yi, b.x AS xj, b.y AS yj FROM p a JOIN p b ON a.k = b.k AND b.i = CASE WHEN a.i = 1 THEN a.n ELSE a.i - 1 END),
h AS (SELECT k, CAST(unnest(range(CAST(min(y) AS BIGINT), max(y) + 1)) AS INTEGER) AS y FROM p GROUP BY k),
c AS (SELECT h.k, h.y, xi + CAST(trunc((h.y - yi) * (xj - xi) / CAST(yj - yi AS DOUBLE)) AS INTEGER) AS x FROM h JOIN e ON h.k = e.k AND (yi < h.y AND yj >= h.y OR yj < h.y AND yi >= h.y)),
r AS (SELECT k, y, x, row_number() OVER (PARTITION BY k, y ORDER BY x) AS i FROM c),
q AS (SELECT a.k, a.y, unnest(range(CAST(a.x AS BIGINT), b.x + 1)) AS x FROM r a JOIN r b ON a.k = b.k AND a.y = b.y AND a.i % 2 = 1 AND b.i = a.i + 1)
SELECT DISTINCT k AS picture_id, CAST(x AS INTEGER) AS x, y FROM q""",
)


def walk_sql(ctes: str) -> str:
    """Pixels of the lines of a table ln (picture_id, x, y, x2, y2), each walked by its error term."""
    return f"""WITH RECURSIVE {ctes}, s0 AS (SELECT picture_id, x, y, x2, y2, abs(x2 - x) AS dx, abs(y2 - y) AS dy, CASE WHEN x < x2 THEN 1 ELSE -1 END AS sx, CASE WHEN y < y2 THEN 1 ELSE -1 END AS sy FROM ln),
b AS (SELECT picture_id, x, y, x2, y2, dx, dy, sx, sy, dx - dy AS err FROM s0 UNION
  SELECT picture_id, CASE WHEN 2 * err > -dy THEN x + sx ELSE x END, CASE WHEN 2 * err < dx THEN y + sy ELSE y END, x2, y2, dx, dy, sx, sy,
    err - CASE WHEN 2 * err > -dy THEN dy ELSE 0 END + CASE WHEN 2 * err < dx THEN dx ELSE 0 END FROM b WHERE x <> x2 OR y <> y2)
SELECT DISTINCT picture_id, x, y FROM b"""


def _draw_sql() -> str:
    lines, here, begun = [], ("0", "0"), ("0", "0")
    whole = lambda v: f"CAST(floor(CAST({v} AS DOUBLE) + 0.5) AS INTEGER)"
    for kind, points in _PATH:
        end = begun if kind == "Z" else points[-1]
        if kind in "LZ":
            lines.append(f"SELECT k AS picture_id, {', '.join(f'{whole(v)} AS {n}' for v, n in zip((*here, *end), ('x', 'y', 'x2', 'y2')))} FROM s")
        elif kind in "QC":
            bends = [here, *points]
            d = len(bends) - 1
            n = f"CAST(greatest({8 if kind == 'Q' else 12}, floor(sqrt(power({end[0]} - ({here[0]}), 2.0) + power({end[1]} - ({here[1]}), 2.0)) / 2)) AS INTEGER)"

            def at(axis: int, t: str) -> str:
                u = f"(CAST(1.0 AS DOUBLE) - {t})"
                return whole(" + ".join(f"{' * '.join([f'CAST({comb(d, k)} AS DOUBLE)', *[t] * k, *[u] * (d - k)])} * CAST({p[axis]} AS DOUBLE)" for k, p in enumerate(bends)))  # noqa: B023

            cells = ", ".join(f"{at(axis, t)} AS {name}" for t, suffix in (("ta", ""), ("tb", "2")) for axis, name in ((0, "x" + suffix), (1, "y" + suffix)))
            lines.append(f"SELECT k AS picture_id, {cells} FROM (SELECT k, CAST(i - 1 AS DOUBLE) / n AS ta, CAST(i AS DOUBLE) / n AS tb FROM (SELECT k, {n} AS n, unnest(range(1, {n} + 1)) AS i FROM s))")
        here, begun = end, end if kind == "M" else begun
    return walk_sql("s AS (SELECT s_suppkey AS k FROM supplier), ln AS (" + " UNION ALL ".join(lines) + ")")


add("path_draw", lambda spark, d: H.draw_path(_segments(spark, d), ["picture_id"]), _draw_sql())


_RECTANGLES = ((0, 0.0, 0.0, 3.0, 3.0), (1, 30.0, 30.0, 8.0, 8.0), (2, 10.0, 10.0, 2.0, 2.0), (3, 12.0, 12.0, 0.0, 4.0), (4, -9.0, -9.0, 90.0, 90.0), (5, 20.0, 20.0, 6.0, 5.0))


def _rectangles(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "supplier").select(F.col("s_suppkey").alias("picture_id"))
    parts = [f"struct({r} as rect, {x}D as x, {y}D as y, {w}D as w, {h}D as h)" for r, x, y, w, h in _RECTANGLES]
    return k.select("picture_id", F.explode(F.expr(f"array({', '.join(parts)})")).alias("r")).select("picture_id", "r.*")


def _hits_sql() -> str:
    corner = lambda px, py: f"sign((xb - xa) * ({py} - ya) - (yb - ya) * ({px} - xa))"
    corners = ", ".join(corner(px, py) for px in ("x", "x + w") for py in ("y", "y + h"))
    turn = corner("x + w / 2", "y + h / 2")
    return f"""WITH {_flat_sql()}, p AS (SELECT k, seg > 4 AS sub, x, y, row_number() OVER (PARTITION BY k, seg > 4 ORDER BY seg, step) AS i, count(*) OVER (PARTITION BY k, seg > 4) AS n FROM f),
e AS (SELECT a.k, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM p a JOIN p b ON a.k = b.k AND a.sub = b.sub AND b.i = a.i % a.n + 1),
r(rect, x, y, w, h) AS (VALUES {', '.join(map(str, _RECTANGLES))}),
m AS (SELECT e.k, r.rect, w, h, NOT (greatest(xa, xb) <= x OR least(xa, xb) >= x + w OR greatest(ya, yb) <= y OR least(ya, yb) >= y + h) AND least({corners}) < 0 AND greatest({corners}) > 0 AS t,
  CASE WHEN ya <= y + h / 2 AND yb > y + h / 2 AND {turn} > 0 THEN 1 WHEN ya > y + h / 2 AND yb <= y + h / 2 AND {turn} < 0 THEN -1 ELSE 0 END AS z FROM e, r)
SELECT k AS picture_id, rect, w > 0 AND h > 0 AND (bool_or(t) OR sum(z) <> 0) AS hit FROM m GROUP BY k, rect, w, h"""


add("path_hits", lambda spark, d: H.hits(_segments(spark, d), _rectangles(spark, d), ["picture_id"]), _hits_sql())
