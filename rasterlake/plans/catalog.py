"""Registered queries of the raster operators and their SQL counterparts.

Each entry is a builder over the derived pictures of ``inputs`` and, where SQL can
say it, the same result in SQL text written on its own.
"""

from __future__ import annotations

from collections.abc import Callable
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import layouts as Y
from ..functions import lossy as V
from ..functions.diff import DIFFS
from ..operators import blocks as B
from ..operators import drawing as D
from ..operators import masks as M
from ..operators import pixels as P
from ..operators import stencils as T
from ..operators import summaries as S
from ..operators import timeline as L
from ..sources import registry as R
from . import coding
from .inputs import ANIM, CLIP, PAIR, PX, SPARSE, animation, clip, pixels, side, sparse, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def add(name: str, build: Query, sql: str | None = None) -> None:
    _QUERIES[name] = build
    if sql:
        _SQL[name] = sql


def queries() -> dict[str, Query]:
    return _QUERIES | coding.queries()


def oracle_sql() -> dict[str, str]:
    return _SQL | coding.oracle_sql()


def _fl(x: str | float) -> str:
    return f"CAST({x} AS FLOAT)"


def _rnd(x: str) -> str:
    return f"CAST(floor(CAST({x} AS DOUBLE) + 0.5) AS INTEGER)"


def _colors(a: str, r: str, g: str, b: str, source: str = "px", keys: str = "picture_id, x, y") -> str:
    return f"SELECT {keys}, " + ", ".join(f"CAST({e} AS INTEGER) AS {n}" for e, n in zip((a, r, g, b), "argb")) + f" FROM {source}"


def _each(f, source: str = "px", a: str = "a") -> str:
    return f"WITH {PX} " + _colors(a, *(f(c) for c in "rgb"), source=source)


def _add_color(name: str, f, sql: str) -> None:
    add(name, lambda spark, d: P.colored(pixels(spark, d), f), sql)


# -- scalar colour math ---------------------------------------------------------------

_LUMA = f"{_fl(0.299)} * {_fl('r')} + {_fl(0.587)} * {_fl('g')} + {_fl(0.114)} * {_fl('b')}"
_PACK = "(({a}) * 16777216 + ({r}) * 65536 + ({g}) * 256 + ({b}))"
_PACKED = _PACK.format(a="CAST(a AS BIGINT)", r="r", g="g", b="b")

_gray = f"greatest(0, least(255, {_rnd(_LUMA)}))"
_add_color("px_grayscale", C.grayscale, f"WITH {PX} " + _colors("a", _gray, _gray, _gray))
_add_color("px_invert", C.invert, _each(lambda c: f"255 - {c}"))
_add_color("px_multiply_alpha", lambda p: C.multiply_alpha(p, 0.5), _each(lambda c: c, a=_rnd(f"{_fl('a')} * {_fl(0.5)}")))
_add_color("px_premultiply", C.premultiply, _each(lambda c: f"({c} * a + 127) // 255"))
_add_color("px_unpremultiply", C.unpremultiply, _each(lambda c: f"CASE WHEN a IN (0, 255) THEN {c} ELSE least(255, {c} * 255 // a) END"))
_TINT = {"r": 0xC8, "g": 0x40, "b": 0xA0}
_add_color("px_tint", lambda p: C.tint(p, 0xFFC840A0), _each(lambda c: f"CASE WHEN a = 0 THEN {c} ELSE ({c} * {_TINT[c]} + 127) // 255 END"))
_add_color("px_subtract_green", C.subtract_green, f"WITH {PX} " + _colors("a", "(r - g + 256) % 256", "g", "(b - g + 256) % 256"))
_add_color("px_add_green", lambda p: C.add_green(C.subtract_green(p)), f"WITH {PX} " + _colors("a", "r", "g", "b"))
_BG = {"r": 0x20, "g": 0x30, "b": 0x40}
_add_color("px_flatten", lambda p: C.flatten(p, 0x203040, True), _each(lambda c: f"CASE WHEN a < 128 THEN 0 WHEN a = 255 THEN {c} ELSE ({c} * a + {_BG[c]} * (255 - a)) // 255 END", a="CASE WHEN a < 128 THEN 0 ELSE 255 END"))
_add_color("px_flatten_opaque", lambda p: C.flatten(p, 0x203040, False), _each(lambda c: f"({c} * a + {_BG[c]} * (255 - a)) // 255", a="255"))


def _signed(c: str) -> str:
    return f"CASE WHEN {c} > 127 THEN {c} - 256 ELSE {c} END"


_add_color(
    "px_color_transform",
    lambda p: C.color_transform(p, 23, -41, 77),
    f"WITH {PX}, q AS (SELECT *, {_signed('r')} AS r1, {_signed('g')} AS g1 FROM px) "
    + _colors("a", "(r - CAST(floor(23 * g1 / 32.0) AS INTEGER) + 512) % 256", "g", "(b - CAST(floor(-41 * g1 / 32.0) AS INTEGER) - CAST(floor(77 * r1 / 32.0) AS INTEGER) + 1024) % 256", "q"),
)
_add_color("px_color_transform_back", lambda p: C.color_transform(C.color_transform(p, 23, -41, 77), 23, -41, 77, inverse=True), f"WITH {PX} " + _colors("a", "r", "g", "b"))


def _snapped(c: str, bits: int) -> str:
    biased = f"({c} + {((1 << bits) - 1) >> 1} + ({c} >> {bits}) % 2)"
    return f"CASE WHEN {biased} > 255 THEN 255 ELSE {biased} // {1 << bits} * {1 << bits} END"


for _bits in (1, 3, 5):
    _add_color(f"px_snap_{_bits}", lambda p, b=_bits: C.Argb(*(C.snap(c, b) for c in p)), f"WITH {PX} " + _colors(*(_snapped(c, _bits) for c in "argb")))

add(
    "px_pack",
    lambda spark, d: pixels(spark, d).select(*P.KEYS, C.unsigned(C.pack(*C.Argb.of())).alias("argb"), C.unsigned(C.with_alpha(C.pack(*C.Argb.of()), F.lit(128))).alias("half")),
    f"WITH {PX} SELECT picture_id, x, y, {_PACKED} AS argb, {_PACK.format(a='CAST(128 AS BIGINT)', r='r', g='g', b='b')} AS half FROM px",
)
add("px_unpack", lambda spark, d: pixels(spark, d).select(*P.KEYS, *C.Argb.unpacked(C.pack(*C.Argb.of())).named()), f"WITH {PX} " + _colors("a", "r", "g", "b"))
add(
    "px_lumas",
    lambda spark, d: pixels(spark, d).select(*P.KEYS, C.luma(C.Argb.of()).cast("double").alias("weighted"), C.plain_luma(C.Argb.of()).cast("double").alias("plain"), C.print_luma(C.Argb.of()).alias("printed"), C.quick_luma(C.Argb.of()).alias("quick")),
    f"WITH {PX} SELECT picture_id, x, y, CAST(CAST(({_LUMA}) AS FLOAT) * CAST({_fl('a')} / {_fl(255)} AS FLOAT) AS DOUBLE) AS weighted, CAST({_LUMA} AS DOUBLE) AS plain, (299 * r + 587 * g + 114 * b + 500) // 1000 AS printed, (r + 2 * g + b) // 4 AS quick FROM px",
)


def _hsv_sql() -> str:
    h = f"CAST({_fl('r * 3 - 200')} AS FLOAT)"
    cte = f"""q AS (SELECT *, CAST((((({h} % {_fl(360)}) + {_fl(360)}) % {_fl(360)}) / {_fl(60)}) AS FLOAT) AS h, CAST({_fl('g')} / {_fl(255)} AS FLOAT) AS s, CAST({_fl('b')} / {_fl(255)} AS FLOAT) AS v FROM px),
q2 AS (SELECT *, CAST(v * s AS FLOAT) AS c FROM q), q3 AS (SELECT *, CAST(c * ({_fl(1)} - abs((h % {_fl(2)}) - {_fl(1)})) AS FLOAT) AS k, CAST(v - c AS FLOAT) AS m, CAST(floor(h) AS INTEGER) AS t FROM q2)"""
    z = _fl(0)

    def ch(*at: str) -> str:
        return _rnd(f"CAST((CASE t WHEN 0 THEN {at[0]} WHEN 1 THEN {at[1]} WHEN 2 THEN {at[2]} WHEN 3 THEN {at[3]} WHEN 4 THEN {at[4]} ELSE {at[5]} END + m) * {_fl(255)} AS FLOAT)")

    return f"WITH {PX}, {cte} " + _colors("255", ch("c", "k", z, z, "k", "c"), ch("k", "c", "c", "k", z, z), ch(z, z, "k", "c", "c", "k"), "q3")


_add_color("px_hsv", lambda p: C.hsv(p.r * 3 - 200, C.f32(p.g) / C.f32(255), C.f32(p.b) / C.f32(255)), _hsv_sql())
add(
    "px_ycbcr",
    lambda spark, d: pixels(spark, d).select(*P.KEYS, *(c.cast("int").alias(n) for c, n in zip(C.to_ycbcr(C.Argb.of()), ("luma", "cb", "cr")))),
    f"""WITH {PX} SELECT picture_id, x, y, CAST(greatest(0, least(255, floor((66 * r + 129 * g + 25 * b + 128) / 256.0) + 16)) AS INTEGER) AS luma,
CAST(greatest(0, least(255, floor((-38 * r - 74 * g + 112 * b + 128) / 256.0) + 128)) AS INTEGER) AS cb,
CAST(greatest(0, least(255, floor((112 * r - 94 * g - 18 * b + 128) / 256.0) + 128)) AS INTEGER) AS cr FROM px""",
)
add(
    "px_chroma_plane",
    lambda spark, d: pixels(spark, d).filter((F.col("x") % 2 == 0) & (F.col("y") % 2 == 0)).select("picture_id", C.idiv(F.col("x"), 2).alias("x"), C.idiv(F.col("y"), 2).alias("y"), *(c.cast("int").alias(n) for c, n in zip(C.to_ycbcr(C.Argb.of())[1:], ("cb", "cr")))),
    f"""WITH {PX} SELECT picture_id, x // 2 AS x, y // 2 AS y,
CAST(greatest(0, least(255, floor((-38 * r - 74 * g + 112 * b + 128) / 256.0) + 128)) AS INTEGER) AS cb,
CAST(greatest(0, least(255, floor((112 * r - 94 * g - 18 * b + 128) / 256.0) + 128)) AS INTEGER) AS cr FROM px WHERE x % 2 = 0 AND y % 2 = 0""",
)


def _sat(e: str) -> str:
    return f"greatest(0, least(255, floor(({e}) / 256.0)))"


_add_color("px_from_ycbcr", lambda p: C.from_ycbcr(p.r, p.g, p.b), f"WITH {PX} " + _colors("255", _sat("298 * (r - 16) + 409 * (b - 128) + 128"), _sat("298 * (r - 16) - 100 * (g - 128) - 208 * (b - 128) + 128"), _sat("298 * (r - 16) + 516 * (g - 128) + 128")))
add(
    "px_cache_slot",
    lambda spark, d: pixels(spark, d).select(*P.KEYS, C.cache_slot(C.pack(*C.Argb.of()), 10).alias("slot")),
    f"WITH {PX} SELECT picture_id, x, y, CAST((CAST({_PACKED} AS HUGEINT) * 506832829 % 4294967296) // 4194304 AS INTEGER) AS slot FROM px",
)
add(
    "px_prefix_code",
    lambda spark, d: table(spark, d, "lineitem").select((F.col("l_partkey") + F.col("l_linenumber")).cast("int").alias("v")).distinct().select("v", *(c.cast("int").alias(n) for c, n in zip(C.prefix_code(F.col("v")), ("symbol", "extra_bits", "extra_value")))),
    """WITH d AS (SELECT DISTINCT CAST(l_partkey + l_linenumber AS INTEGER) AS v FROM lineitem),
h AS (SELECT v, CASE WHEN v < 5 THEN 2 ELSE CAST(floor(log2(v - 1)) AS INTEGER) END AS hb FROM d)
SELECT v, CAST(CASE WHEN v < 5 THEN v - 1 ELSE 2 * hb + ((v - 1) >> (hb - 1)) % 2 END AS INTEGER) AS symbol, CAST(CASE WHEN v < 5 THEN 0 ELSE hb - 1 END AS INTEGER) AS extra_bits,
CAST(CASE WHEN v < 5 THEN 0 ELSE (v - 1) % (1 << (hb - 1)) END AS INTEGER) AS extra_value FROM h""",
)
add(
    "px_scale_sample",
    lambda spark, d: pixels(spark, d).select(*P.KEYS, C.scale_sample(F.col("r") * 3, 1023).alias("narrow"), C.scale_sample(F.col("g"), 100).alias("wide")),
    f"WITH {PX} SELECT picture_id, x, y, least(255, r * 3 * 255 // 1023) AS narrow, least(255, g * 255 // 100) AS wide FROM px",
)
add(
    "px_quality_index",
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", C.quality_index((F.col("o_orderkey") % 101) / 100.0).alias("qi")),
    f"SELECT o_orderkey, greatest(0, least(127, CAST(trunc(CAST(({_fl(1)} - CAST((o_orderkey % 101) / 100.0 AS FLOAT)) * {_fl(127)} + {_fl(0.5)} AS FLOAT)) AS INTEGER))) AS qi FROM orders",
)

# -- blends and differences ---------------------------------------------------------------

_SA = f"CAST({_fl('sa')} / {_fl(255)} AS FLOAT)"
_RS = f"CAST({_fl(1)} - {_SA} AS FLOAT)"


def _if_seen(e: str, n: str, opaque: str | None = None) -> str:
    whole = f" WHEN sa = 255 THEN {opaque}" if opaque else ""
    return f"CASE WHEN sa = 0 THEN d{n}{whole} ELSE {e} END"


_BLEND_SQL = {
    "normal": lambda n: _if_seen(_rnd(f"CAST({_fl('sa')} + {_fl('da')} * {_RS} AS FLOAT)") if n == "a" else _rnd(f"CAST({_fl('s' + n)} * {_SA} + {_fl('d' + n)} * {_RS} AS FLOAT)"), n, f"s{n}"),
    "replace": lambda n: f"s{n}",
    "add": lambda n: _if_seen("least(255, da + sa)" if n == "a" else "least(255, d%s + %s)" % (n, _rnd(f"CAST({_fl('s' + n)} * {_SA} AS FLOAT)")), n),
    "multiply": lambda n: "da" if n == "a" else _if_seen(f"(s{n} * d{n} + 127) // 255", n),
    "overlay": lambda n: "da" if n == "a" else _if_seen(f"CASE WHEN d{n} < 128 THEN (2 * s{n} * d{n} + 127) // 255 ELSE 255 - (2 * (255 - s{n}) * (255 - d{n}) + 127) // 255 END", n),
    "quadratic_add": lambda n: "da" if n == "a" else _if_seen(f"least(255, (s{n} * s{n} + 127) // 255 + d{n})", n),
}
for _mode in C.BLENDS:
    add(
        f"blend_{_mode}",
        lambda spark, d, m=_mode: P.paired(side(spark, d, 0), side(spark, d, 1)).select(*P.KEYS, *C.blend(C.Argb.of("s"), C.Argb.of("d"), m).named()),
        f"WITH {PAIR} " + _colors(*(_BLEND_SQL[_mode](n) for n in "argb"), source="pr"),
    )
    # the source lies three right and two up; clear source pixels never count, whatever the mode
    add(
        f"blit_{_mode}",
        lambda spark, d, m=_mode: P.blit(side(spark, d, 1), side(spark, d, 0), 3, -2, m),
        f"WITH {PAIR}, bl AS (SELECT d0.*, sa, sr, sg, sb FROM d0 LEFT JOIN s0 ON d0.picture_id = s0.picture_id AND d0.x = s0.x + 3 AND d0.y = s0.y - 2) "
        + _colors(*(f"CASE WHEN sa IS NULL OR sa = 0 THEN d{n} ELSE {_BLEND_SQL[_mode](n)} END" for n in "argb"), source="bl"),
    )
add(
    "blit_opaque_copy",
    lambda spark, d: P.blit(side(spark, d, 1), side(spark, d, 0), -1, 1, opaque_source=True),
    f"WITH {PAIR} SELECT d0.picture_id, d0.x, d0.y, coalesce(sa, da) AS a, coalesce(sr, dr) AS r, coalesce(sg, dg) AS g, coalesce(sb, db) AS b FROM d0 LEFT JOIN s0 ON d0.picture_id = s0.picture_id AND d0.x = s0.x - 1 AND d0.y = s0.y + 1",
)
add(
    "blit_scaled",
    lambda spark, d: P.blit_scaled(side(spark, d, 1), side(spark, d, 0), 1, 2, 5, 11, 8, 8),
    f"WITH {PAIR}, g AS (SELECT CAST(t.tx AS INTEGER) AS tx, CAST(u.ty AS INTEGER) AS ty FROM range(5) t(tx), range(11) u(ty)), "
    "sc AS (SELECT picture_id, tx + 1 AS x, ty + 2 AS y, sa, sr, sg, sb FROM s0 JOIN g ON s0.x = tx * 8 // 5 AND s0.y = ty * 8 // 11), bl AS (SELECT * FROM d0 LEFT JOIN sc USING (picture_id, x, y)) "
    + _colors(*(f"CASE WHEN sa IS NULL OR sa = 0 THEN d{n} ELSE {_BLEND_SQL['normal'](n)} END" for n in "argb"), source="bl"),
)


def _tinted(n: str) -> str:
    return n if n == "a" else f"CASE WHEN a = 0 THEN {n} ELSE ({n} * {_TINT[n]} + 127) // 255 END"


add(
    "blit_tinted",
    lambda spark, d: P.blit(side(spark, d, 1), P.colored(side(spark, d, 0), lambda p: C.tint(p, 0xFFC840A0)), 0, 0, "add"),
    f"WITH {PX}, s0 AS (SELECT picture_id // 2 AS picture_id, x, y, " + ", ".join(f"{_tinted(n)} AS s{n}" for n in "argb") + " FROM px WHERE picture_id % 2 = 0), "
    "d0 AS (SELECT picture_id // 2 AS picture_id, x, y, a AS da, r AS dr, g AS dg, b AS db FROM px WHERE picture_id % 2 = 1), bl AS (SELECT * FROM d0 LEFT JOIN s0 USING (picture_id, x, y)) "
    + _colors(*(f"CASE WHEN sa IS NULL OR sa = 0 THEN d{n} ELSE {_BLEND_SQL['add'](n)} END" for n in "argb"), source="bl"),
)
add(
    "lerp",
    lambda spark, d: P.paired(side(spark, d, 0), side(spark, d, 1)).select(*P.KEYS, *C.lerp(C.Argb.of("s"), C.Argb.of("d"), 0.3).named()),
    f"WITH {PAIR} " + _colors(*(_rnd(f"CAST({_fl('s' + n)} * CAST({_fl(1)} - {_fl(0.3)} AS FLOAT) + {_fl('d' + n)} * {_fl(0.3)} AS FLOAT)") for n in "argb"), source="pr"),
)


def _diff_sql(out: list[str], covered: bool = True, before: str = "") -> str:
    head = "CASE " + before + ("WHEN sa = 0 AND da = 0 THEN {0} " if covered else "") + "WHEN (sa = 0) <> (da = 0) THEN {1} ELSE {2} END"
    return _colors(*(head.format(0, m, o) for m, o in zip((255, 255, 0, 255), out)), source="pr")


def _near(a: str, b: str) -> str:
    return f"least(255, abs({a} - {b}) * 4)"


_W = {n: [f"({s}{n} * {s}a + 255 * (255 - {s}a) + 127) // 255" for s in "sd"] for n in "rgb"}
_lm = [" + ".join(f"{_fl(w)} * {_fl(s + n)}" for w, n in zip((0.299, 0.587, 0.114), "rgb")) for s in "sd"]
_DL = f"CAST(CAST({_lm[0]} AS FLOAT) - CAST({_lm[1]} AS FLOAT) AS FLOAT)"
_MG = f"CAST(trunc(least({_fl(127)}, abs({_DL}) * {_fl(2)})) AS INTEGER)"
_same_white = " AND ".join(f"{a} = {b}" for a, b in _W.values())
_DIFF_SQL = {
    "absolute": _diff_sql(["255", *(f"CASE WHEN sa = da AND sr = dr AND sg = dg AND sb = db THEN 16 ELSE {_near('s' + n, 'd' + n)} END" for n in "rgb")]),
    "over_white": _diff_sql(["255", *(_near(*_W[n]) for n in "rgb")], False, f"WHEN {_same_white} THEN 0 "),
    "signed_luma": _diff_sql(["255", f"CASE WHEN {_DL} >= 0 THEN 128 + {_MG} ELSE 128 - {_MG} // 2 END", f"128 - {_MG} // 2", f"CASE WHEN {_DL} >= 0 THEN 128 - {_MG} // 2 ELSE 128 + {_MG} END"]),
    "signed_rgb": _diff_sql(["255", *(f"greatest(0, least(255, 128 + 2 * (s{n} - d{n})))" for n in "rgb")]),
}
for _mode, _sql in _DIFF_SQL.items():
    add(f"diff_{_mode}", lambda spark, d, m=_mode: P.paired(side(spark, d, 0), side(spark, d, 1)).select(*P.KEYS, *DIFFS[m](C.Argb.of("s"), C.Argb.of("d")).named()), f"WITH {PAIR} {_sql}")
add(
    "diff_coverage",
    lambda spark, d: P.paired(side(spark, d, 0).filter("r % 5 <> 0"), side(spark, d, 1).filter("r % 7 <> 0"), "full").select(*P.KEYS, *DIFFS["coverage"](C.Argb.of("s"), C.Argb.of("d")).named()),
    f"WITH {PAIR}, pr2 AS (SELECT picture_id, x, y, coalesce(sa, 0) AS sa, coalesce(da, 0) AS da FROM (SELECT * FROM s0 WHERE sr % 5 <> 0) FULL JOIN (SELECT * FROM d0 WHERE dr % 7 <> 0) USING (picture_id, x, y)) "
    + _colors(*(f"CASE WHEN sa = 0 AND da = 0 THEN 0 WHEN sa > 0 AND da > 0 THEN {b} WHEN sa > 0 THEN {m} ELSE {c} END" for b, m, c in ((255, 255, 255), (0x30, 255, 0), (0x30, 0, 255), (0x34, 255, 255))), source="pr2"),
)

# -- geometry ---------------------------------------------------------------------------------


def _add_move(name: str, build, x: str, y: str, where: str = "") -> None:
    add(name, lambda spark, d: build(pixels(spark, d)), f"WITH {PX} SELECT picture_id, {x} AS x, {y} AS y, a, r, g, b FROM px {where}")


_add_move("geo_crop", lambda px: P.crop(px, 2, 1, 4, 5, 8, 8), "x - 2", "y - 1", "WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 5")
_add_move("geo_row", lambda px: px.filter("y = 3"), "x", "y", "WHERE y = 3")
_add_move("geo_pixel", lambda px: px.filter("x = 2 AND y = 5"), "x", "y", "WHERE x = 2 AND y = 5")
_add_move("geo_region", lambda px: P.region(px, 1, 2, 3, 3), "x", "y", "WHERE x BETWEEN 1 AND 3 AND y BETWEEN 2 AND 4")
_add_move("geo_flip_h", lambda px: P.flip_horizontal(px, 8, 8), "7 - x", "y")
_add_move("geo_flip_v", lambda px: P.flip_vertical(px, 8, 8), "x", "7 - y")
_add_move("geo_rot90", lambda px: P.rotate90(px, 8, 8), "7 - y", "x")
_add_move("geo_rot180", lambda px: P.rotate180(px, 8, 8), "7 - x", "7 - y")
_add_move("geo_rot270", lambda px: P.rotate270(px, 8, 8), "y", "7 - x")
add(
    "geo_resize_nearest",
    lambda spark, d: P.resize_nearest(pixels(spark, d), 8, 8, 5, 13),
    f"WITH {PX}, g AS (SELECT CAST(t.tx AS INTEGER) AS tx, CAST(u.ty AS INTEGER) AS ty FROM range(5) t(tx), range(13) u(ty)) SELECT picture_id, tx AS x, ty AS y, a, r, g, b FROM px JOIN (SELECT tx, ty FROM g) k ON x = tx * 8 // 5 AND y = ty * 8 // 13",
)


def _bilinear_sql(w: int, h: int) -> str:
    def axis(n: str, size: int) -> str:
        at = f"CAST(CAST(CAST(({_fl('t')} + {_fl(0.5)}) * {_fl(8)} AS FLOAT) / {_fl(size)} AS FLOAT) - {_fl(0.5)} AS FLOAT)"
        return f"{n} AS (SELECT CAST(t AS INTEGER) AS t, least(6, greatest(0, CAST(floor({at}) AS INTEGER))) AS s, CAST({at} - {_fl(f'floor({at})')} AS FLOAT) AS f FROM range({size}) r(t))"

    one = _fl(1)

    def mix(c: str) -> str:
        taps = [f"{_fl(f'p{k}.{c}')} * CAST({wx} * {wy} AS FLOAT)" for k, (wx, wy) in {"00": (f"({one} - ax.f)", f"({one} - ay.f)"), "10": ("ax.f", f"({one} - ay.f)"), "01": (f"({one} - ax.f)", "ay.f"), "11": ("ax.f", "ay.f")}.items()]
        return f"greatest(0, least(255, CAST(trunc({' + '.join(taps)}) AS INTEGER)))"

    joins = " ".join(f"JOIN px p{i}{j} ON p{i}{j}.picture_id = p00.picture_id AND p{i}{j}.x = ax.s + {i} AND p{i}{j}.y = ay.s + {j}" for i, j in ((1, 0), (0, 1), (1, 1)))
    return f"WITH {PX}, {axis('ax', w)}, {axis('ay', h)} SELECT p00.picture_id, ax.t AS x, ay.t AS y, " + ", ".join(f"{mix(c)} AS {c}" for c in "argb") + f" FROM ax CROSS JOIN ay JOIN px p00 ON p00.x = ax.s AND p00.y = ay.s {joins}"


add("geo_resize_bilinear", lambda spark, d: P.resize_bilinear(pixels(spark, d), 8, 8, 5, 11), _bilinear_sql(5, 11))
add(
    "geo_trim",
    lambda spark, d: P.trim(pixels(spark, d).withColumn("a", F.when((F.col("x") < F.col("picture_id") % 4) | (F.col("y") > 6), 0).otherwise(F.col("a")))),
    f"WITH {PX}, q AS (SELECT picture_id, x, y, CASE WHEN x < picture_id % 4 OR y > 6 THEN 0 ELSE a END AS a, r, g, b FROM px), "
    "bx AS (SELECT picture_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM q WHERE a <> 0 GROUP BY picture_id) "
    "SELECT picture_id, x - coalesce(x0, 0) AS x, y - coalesce(y0, 0) AS y, a, r, g, b FROM q LEFT JOIN bx USING (picture_id) WHERE x0 IS NULL OR (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)",
)
add("fill_rect", lambda spark, d: P.fill_rect(pixels(spark, d), -2, 3, 5, 9, 0x80102030), f"WITH {PX} " + _colors(*(f"CASE WHEN x <= 2 AND y >= 3 THEN {v} ELSE {c} END" for c, v in zip("argb", (0x80, 0x10, 0x20, 0x30)))))
add("fill", lambda spark, d: P.colored(pixels(spark, d), lambda p: C.Argb.literal(0x7F010203)), f"WITH {PX} " + _colors("127", "1", "2", "3"))
add(
    "put_pixels",
    lambda spark, d: P.put(side(spark, d, 0), side(spark, d, 1).filter("r % 4 = 0").withColumn("ord", F.col("r"))),
    f"WITH {PAIR} SELECT picture_id, x, y, " + ", ".join(f"CASE WHEN dr % 4 = 0 THEN d{n} ELSE s{n} END AS {n}" for n in "argb") + " FROM pr",
)
add(
    "frames_round_trip",
    lambda spark, d: P.to_pixels(P.to_frames(pixels(spark, d).filter("r % 3 <> 0"), 8, 8)),
    f"WITH {PX}, k AS (SELECT DISTINCT picture_id FROM px WHERE r % 3 <> 0) " + _colors(*(f"CASE WHEN r % 3 <> 0 THEN {c} ELSE 0 END" for c in "argb"), source="px JOIN k USING (picture_id)"),
)
for _name, _cell in (("bg_checkerboard", 2), ("bg_checkerboard_default", 8)):
    add(
        _name,
        lambda spark, d, c=_cell: P.over_background(pixels(spark, d), lambda x, y: P.checkerboard(x, y, cell=c)),
        f"WITH {PX}, pr AS (SELECT picture_id, x, y, a AS sa, r AS sr, g AS sg, b AS sb, 255 AS da, " + ", ".join(f"CASE WHEN (x // {_cell} + y // {_cell}) % 2 = 0 THEN {p} ELSE {q} END AS d{n}" for n, p, q in (("r", 0x20, 0x18), ("g", 0x20, 0x18), ("b", 0x24, 0x20))) + " FROM px) "
        + _colors(*(_BLEND_SQL["normal"](n) for n in "argb"), source="pr"),
    )
add(
    "bg_solid",
    lambda spark, d: P.over_background(pixels(spark, d), lambda x, y: C.Argb.literal(0xFF336699)),
    f"WITH {PX}, pr AS (SELECT picture_id, x, y, a AS sa, r AS sr, g AS sg, b AS sb, 255 AS da, 51 AS dr, 102 AS dg, 153 AS db FROM px) " + _colors(*(_BLEND_SQL["normal"](n) for n in "argb"), source="pr"),
)
add(
    "luma_histogram",
    lambda spark, d: P.colored(P.over_background(pixels(spark, d), lambda x, y: P.checkerboard(x, y, cell=2)), C.grayscale).groupBy("picture_id", F.col("r").alias("level")).agg(F.count("*").alias("n")),
    f"WITH {PX}, pr AS (SELECT picture_id, x, y, a AS sa, r AS sr, g AS sg, b AS sb, 255 AS da, " + ", ".join(f"CASE WHEN (x // 2 + y // 2) % 2 = 0 THEN {p} ELSE {q} END AS d{n}" for n, p, q in (("r", 0x20, 0x18), ("g", 0x20, 0x18), ("b", 0x24, 0x20))) + " FROM px), bl AS ("
    + _colors(*(_BLEND_SQL["normal"](n) for n in "argb"), source="pr") + f") SELECT picture_id, {_gray} AS level, count(*) AS n FROM bl GROUP BY 1, 2",
)

# -- aggregates ---------------------------------------------------------------------------------

_BOUNDS = "SELECT picture_id, coalesce(min(x) FILTER (a <> 0), 0) AS x, coalesce(min(y) FILTER (a <> 0), 0) AS y, coalesce(max(x) FILTER (a <> 0) - min(x) FILTER (a <> 0) + 1, 0) AS width, coalesce(max(y) FILTER (a <> 0) - min(y) FILTER (a <> 0) + 1, 0) AS height FROM {} GROUP BY picture_id"
add("opaque_bounds", lambda spark, d: P.opaque_bounds(pixels(spark, d)), f"WITH {PX} " + _BOUNDS.format("px"))
add("opaque_bounds_sparse", lambda spark, d: P.opaque_bounds(sparse(spark, d)), f"WITH {SPARSE} " + _BOUNDS.format("ln"))
_HIST = f"SELECT picture_id, CAST(r * 65536 + g * 256 + b AS BIGINT) AS rgb, count(*) AS n, min(y * 8 + x) AS first_seen FROM px WHERE a <> 0 GROUP BY 1, 2"
add("color_histogram", lambda spark, d: S.color_histogram(pixels(spark, d), 8), f"WITH {PX} {_HIST}")
add("palette_exact", lambda spark, d: S.exact_palette(pixels(spark, d), 8), f"WITH {PX}, h AS ({_HIST}) SELECT picture_id, CAST(row_number() OVER (PARTITION BY picture_id ORDER BY first_seen) - 1 AS INTEGER) AS slot, rgb, n FROM h QUALIFY count(*) OVER (PARTITION BY picture_id) <= 256")
add(
    "palette_exact_reserved",
    lambda spark, d: S.exact_palette(pixels(spark, d), 8, transparent_slot=5, most=40),
    f"WITH {PX}, h AS ({_HIST}), k AS (SELECT picture_id, CAST(row_number() OVER (PARTITION BY picture_id ORDER BY first_seen) - 1 AS INTEGER) AS slot, rgb, n FROM h QUALIFY count(*) OVER (PARTITION BY picture_id) <= 39) SELECT picture_id, CASE WHEN slot >= 5 THEN slot + 1 ELSE slot END AS slot, rgb, n FROM k",
)
_SIGNED = f"CASE WHEN {_PACKED} > 2147483647 THEN {_PACKED} - 4294967296 ELSE {_PACKED} END"
add(
    "palette_sorted",
    lambda spark, d: S.sorted_palette(pixels(spark, d), 40).select("picture_id", "n", F.array_join(F.transform("palette", lambda c: c.cast("string")), ",").alias("palette")),
    f"WITH {PX}, k AS (SELECT DISTINCT picture_id, {_SIGNED} AS c FROM px) SELECT picture_id, CAST(count(*) AS INTEGER) AS n, CASE WHEN count(*) <= 40 THEN string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) END AS palette FROM k GROUP BY picture_id",
)


def _palette(spark: SparkSession) -> DataFrame:
    return spark.range(0, 64).select(F.col("id").cast("int").alias("slot"), *((F.col("id") * k % 256).cast("int").alias(c) for c, k in zip("rgb", (37, 91, 53))))


add(
    "palette_nearest",
    lambda spark, d: S.nearest_slot(pixels(spark, d), _palette(spark)),
    f"WITH {PX}, pal AS (SELECT CAST(i AS INTEGER) AS slot, CAST(i * 37 % 256 AS INTEGER) AS pr, CAST(i * 91 % 256 AS INTEGER) AS pg, CAST(i * 53 % 256 AS INTEGER) AS pb FROM range(64) t(i)), k AS (SELECT DISTINCT r, g, b FROM px), "
    "j AS (SELECT r, g, b, slot, (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb) AS distance FROM k CROSS JOIN pal) SELECT r, g, b, slot, distance FROM j QUALIFY row_number() OVER (PARTITION BY r, g, b ORDER BY distance, slot) = 1",
)
add("palette_median_cut", lambda spark, d: S.median_cut(S.color_histogram(pixels(spark, d), 8), 16))
add(
    "palette_delta",
    lambda spark, d: S.palette_deltas(S.exact_palette(pixels(spark, d), 8).select("picture_id", "slot", *C.Argb.unpacked((F.col("rgb") - 16777216).cast("int")).named())),
    f"WITH {PX}, h AS ({_HIST}), k AS (SELECT picture_id, CAST(row_number() OVER (PARTITION BY picture_id ORDER BY first_seen) - 1 AS INTEGER) AS slot, 255 AS a, rgb // 65536 AS r, rgb // 256 % 256 AS g, rgb % 256 AS b FROM h) SELECT picture_id, slot, "
    + ", ".join(f"CAST(({c} - coalesce(lag({c}) OVER (PARTITION BY picture_id ORDER BY slot), 0) + 256) % 256 AS INTEGER) AS {c}" for c in "argb") + " FROM k",
)
add(
    "palette_pack",
    lambda spark, d: S.packed_indices(pixels(spark, d).withColumn("slot", F.col("r") % 4), 2),
    f"WITH {PX} SELECT picture_id, y, x // 4 AS x, CAST(sum((r % 4) << (x % 4 * 2)) AS INTEGER) AS packed FROM px GROUP BY 1, 2, 3",
)
add("color_cap", lambda spark, d: S.color_cap(pixels(spark, d), 40), f"WITH {PX} SELECT picture_id, CAST(least(41, count(DISTINCT {_PACKED})) AS INTEGER) AS n, count(DISTINCT {_PACKED}) <= 40 AS fits FROM px GROUP BY picture_id")
add("palette_bits", lambda spark, d: S.sorted_palette(pixels(spark, d)).select("picture_id", S.palette_bits(F.col("n")).alias("bits")), f"WITH {PX} SELECT picture_id, CASE WHEN count(DISTINCT {_PACKED}) <= 2 THEN 1 WHEN count(DISTINCT {_PACKED}) <= 4 THEN 2 WHEN count(DISTINCT {_PACKED}) <= 16 THEN 4 ELSE 8 END AS bits FROM px GROUP BY 1")
for _w, _h in ((3, 5), (13, 20)):
    add(
        f"mask_downsample_{_w}x{_h}",
        lambda spark, d, w=_w, h=_h: S.mask_downsample(pixels(spark, d).filter("r % 9 = 0").select(*P.KEYS), 8, 8, w, h),
        f"WITH {PX}, gx AS (SELECT CAST(i AS INTEGER) AS o, CAST(i * 8 // {_w} AS INTEGER) AS lo, CAST(greatest(i * 8 // {_w} + 1, (i + 1) * 8 // {_w}) AS INTEGER) AS hi FROM range({_w}) t(i)), gy AS (SELECT CAST(i AS INTEGER) AS o, CAST(i * 8 // {_h} AS INTEGER) AS lo, CAST(greatest(i * 8 // {_h} + 1, (i + 1) * 8 // {_h}) AS INTEGER) AS hi FROM range({_h}) t(i)) "
        "SELECT DISTINCT picture_id, gx.o AS x, gy.o AS y FROM px JOIN gx ON x >= gx.lo AND x < gx.hi JOIN gy ON y >= gy.lo AND y < gy.hi WHERE r % 9 = 0",
    )
_VAR = "SELECT picture_id, x // 4 AS tx, y // 4 AS ty, CAST(sum(((r + 2 * g + b) // 4) * ((r + 2 * g + b) // 4)) - (sum((r + 2 * g + b) // 4) * sum((r + 2 * g + b) // 4)) // count(*) AS INTEGER) AS variance FROM px GROUP BY 1, 2, 3"
add("tile_variance", lambda spark, d: S.tile_variance(pixels(spark, d), 4), f"WITH {PX} {_VAR}")
add(
    "tile_segments",
    lambda spark, d: S.tile_segments(S.tile_variance(pixels(spark, d), 2)),
    f"WITH {PX}, v AS ({_VAR.replace('// 4 AS t', '// 2 AS t')}), k AS (SELECT picture_id, list(variance ORDER BY variance) AS o, max(variance) - min(variance) AS spread FROM v GROUP BY 1) "
    "SELECT picture_id, tx, ty, variance, CASE WHEN spread < 400 THEN 0 WHEN variance < o[len(o) // 4 + 1] THEN 0 WHEN variance < o[len(o) * 2 // 4 + 1] THEN 1 WHEN variance < o[len(o) * 3 // 4 + 1] THEN 2 ELSE 3 END AS segment FROM v JOIN k USING (picture_id)",
)
add(
    "block_errors",
    lambda spark, d: S.block_errors(P.paired(side(spark, d, 0), side(spark, d, 1)), 4),
    f"WITH {PAIR} SELECT picture_id, x // 4 AS bx, y // 4 AS by, CAST(sum(abs(sr - dr) + abs(sg - dg) + abs(sb - db)) AS BIGINT) AS sad, CAST(sum((sr - dr) * (sr - dr) + (sg - dg) * (sg - dg) + (sb - db) * (sb - db)) AS BIGINT) AS sse FROM pr GROUP BY 1, 2, 3",
)
add(
    "buffer_equality",
    lambda spark, d: P.paired(side(spark, d, 0), side(spark, d, 1), "full").groupBy("picture_id").agg(F.coalesce(F.every(F.expr("sa <=> da AND sr <=> dr AND sg <=> dg AND sb <=> db")), F.lit(True)).alias("equal")),
    f"WITH {PAIR} SELECT picture_id, bool_and(sa IS NOT DISTINCT FROM da AND sr IS NOT DISTINCT FROM dr AND sg IS NOT DISTINCT FROM dg AND sb IS NOT DISTINCT FROM db) AS equal FROM s0 FULL JOIN d0 USING (picture_id, x, y) GROUP BY 1",
)

# -- time ------------------------------------------------------------------------------------------

add("total_duration", lambda spark, d: L.total_duration(animation(spark, d)), f"WITH {ANIM} SELECT picture_id, CAST(sum(delay_ms) AS BIGINT) AS total_ms, count(*) AS frames FROM fr GROUP BY 1")


def _delays_sql(m: int) -> str:
    return f"""WITH {ANIM}, b AS (SELECT *, frame_idx + 1 AS i, CAST(floor(sum(delay_ms) OVER (PARTITION BY picture_id ORDER BY frame_idx) / 10.0 + 0.5) AS BIGINT) AS due FROM fr),
e AS (SELECT *, {m} * i + greatest(0, max(due - {m} * i) OVER (PARTITION BY picture_id ORDER BY frame_idx)) AS emitted FROM b)
SELECT picture_id, frame_idx, CAST(emitted - lag(emitted, 1, 0) OVER (PARTITION BY picture_id ORDER BY frame_idx) AS BIGINT) AS delay_cs FROM e"""


add("gif_delays_playable", lambda spark, d: L.quantized_delays(animation(spark, d), 2), _delays_sql(2))
add("gif_delays_exact", lambda spark, d: L.quantized_delays(animation(spark, d), 1), _delays_sql(1))


def _instants(spark: SparkSession, d: str) -> DataFrame:
    return animation(spark, d).select("picture_id", (F.col("frame_idx") * 57 + 13).cast("bigint").alias("elapsed_ms"))


_AT = f"""WITH {ANIM}, t AS (SELECT picture_id, CAST(frame_idx * 57 + 13 AS BIGINT) AS elapsed_ms FROM fr),
c AS (SELECT *, sum(delay_ms) OVER (PARTITION BY picture_id ORDER BY frame_idx) AS stop, sum(delay_ms) OVER (PARTITION BY picture_id) AS total, count(*) OVER (PARTITION BY picture_id) AS n,
  lead(frame_idx, 1, 0) OVER (PARTITION BY picture_id ORDER BY frame_idx) AS after FROM fr),
j AS (SELECT t.picture_id, elapsed_ms, frame_idx, delay_ms, stop, total, n, after, elapsed_ms % total AS m FROM t JOIN c USING (picture_id) WHERE total > 0 AND delay_ms > 0 AND elapsed_ms % total < stop AND elapsed_ms % total >= stop - delay_ms),
z AS (SELECT t.picture_id, elapsed_ms FROM t JOIN (SELECT picture_id FROM fr GROUP BY 1 HAVING sum(delay_ms) <= 0) USING (picture_id))"""
add("frame_at_time", lambda spark, d: L.frame_at(animation(spark, d), _instants(spark, d)), f"{_AT} SELECT picture_id, elapsed_ms, frame_idx FROM j UNION ALL SELECT picture_id, elapsed_ms, 0 FROM z")
_MID = "n > 1 AND m > stop - delay_ms"
_SHARE = "CAST(m - (stop - delay_ms) AS DOUBLE) / delay_ms"
add(
    "frame_at_time_lerp",
    lambda spark, d: L.frame_at(animation(spark, d), _instants(spark, d), True),
    f"{_AT} SELECT picture_id, elapsed_ms, CASE WHEN {_MID} AND {_SHARE} >= 0.999 THEN after ELSE frame_idx END AS frame_idx, CASE WHEN {_MID} AND {_SHARE} < 0.999 THEN after END AS next_idx, CASE WHEN {_MID} AND {_SHARE} < 0.999 THEN {_SHARE} END AS share FROM j UNION ALL SELECT picture_id, elapsed_ms, 0, NULL, NULL FROM z",
)
add(
    "keyframes",
    lambda spark, d: animation(spark, d).withColumn("k", L.keyframe_interval(F.when(F.col("picture_id") % 3 == 0, 4).otherwise(-1), F.count("*").over(P.Window.partitionBy("picture_id")))).select("picture_id", "frame_idx", F.coalesce(L.is_keyframe(F.col("frame_idx"), F.col("k")), F.lit(False)).alias("keyframe")),
    f"WITH {ANIM}, k AS (SELECT *, CASE WHEN picture_id % 3 = 0 THEN 4 WHEN count(*) OVER (PARTITION BY picture_id) > 60 THEN 30 ELSE 0 END AS k FROM fr) SELECT picture_id, frame_idx, frame_idx = 0 OR (k > 0 AND frame_idx % CASE WHEN k > 0 THEN k ELSE 1 END = 0) AS keyframe FROM k",
)
add(
    "change_box",
    lambda spark, d: L.changed_boxes(clip(spark, d)),
    f"WITH {CLIP}, k AS (SELECT picture_id, frame_idx, x, y, {_PACKED} AS p, lag({_PACKED}) OVER (PARTITION BY picture_id, x, y ORDER BY frame_idx) AS q FROM cl), b AS (SELECT picture_id, frame_idx, min(x) FILTER (p <> q) AS x0, max(x) FILTER (p <> q) AS x1, min(y) FILTER (p <> q) AS y0, max(y) FILTER (p <> q) AS y1 FROM k WHERE q IS NOT NULL GROUP BY 1, 2) "
    "SELECT picture_id, frame_idx, coalesce(x0 - x0 % 2, 0) AS x, coalesce(y0 - y0 % 2, 0) AS y, coalesce(x1 - (x0 - x0 % 2) + 1, 1) AS width, coalesce(y1 - (y0 - y0 % 2) + 1, 1) AS height, x0 IS NOT NULL AS changed FROM b",
)
add(
    "canvas_source",
    lambda spark, d: L.canvas_source(clip(spark, d).filter("r % 3 = 0"), clip(spark, d).select("picture_id", "frame_idx", "x", "y")),
    f"WITH {CLIP} SELECT picture_id, frame_idx, x, y, " + ", ".join(f"coalesce(last_value(CASE WHEN r % 3 = 0 THEN {c} END IGNORE NULLS) OVER w, 0) AS {c}" for c in "argb") + " FROM cl WINDOW w AS (PARTITION BY picture_id, x, y ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)


def _over_sql() -> str:
    keep, cut = "(ca * (255 - k.a) // 255)", "greatest(1, k.a + ca * (255 - k.a) // 255)"

    def ch(n: str) -> str:
        mix = f"k.a + {keep}" if n == "a" else f"(k.{n} * k.a + c{n} * ca * (255 - k.a) // 255) // {cut}"
        return f"CASE WHEN k.a = 255 THEN k.{n} WHEN k.a = 0 THEN c{n} ELSE {mix} END"

    return f"""WITH RECURSIVE {CLIP}, k AS (SELECT * FROM cl),
f AS (SELECT picture_id, x, y, -1 AS frame_idx, 0 AS ca, 0 AS cr, 0 AS cg, 0 AS cb FROM cl WHERE frame_idx = 0
  UNION ALL SELECT f.picture_id, f.x, f.y, k.frame_idx, {", ".join(ch(n) for n in "argb")} FROM f JOIN k ON k.picture_id = f.picture_id AND k.x = f.x AND k.y = f.y AND k.frame_idx = f.frame_idx + 1)
SELECT picture_id, x, y, ca AS a, cr AS r, cg AS g, cb AS b FROM f QUALIFY row_number() OVER (PARTITION BY picture_id, x, y ORDER BY frame_idx DESC) = 1"""


add("canvas_over", lambda spark, d: L.canvas_over(clip(spark, d)), _over_sql())


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return animation(spark, d).select("picture_id", "frame_idx", (F.col("delay_ms") + 20).alias("width"), (F.col("frame_idx") % 17 + 9).alias("height"))


def _fit_sql(fit: str, upscale: bool, w: int, h: int) -> str:
    size = [str(n) if n else f"min({c}) OVER (PARTITION BY picture_id)" for n, c in ((w, "width"), (h, "height"))]
    pick = "greatest" if fit == "cover" else "least"
    scale = f"{pick}(CAST(canvas_w AS DOUBLE) / width, CAST(canvas_h AS DOUBLE) / height)"
    scale = scale if upscale else f"least(1.0::DOUBLE, {scale})"
    if fit == "stretch":
        dw, dh = ("canvas_w", "canvas_h") if upscale else ("least(canvas_w, width)", "least(canvas_h, height)")
    else:
        dw, dh = (f"greatest(1, CAST(floor({s} * {scale} + 0.5) AS INTEGER))" for s in ("width", "height"))
    copied = "width = canvas_w AND height = canvas_h" if fit != "cover" else "false"
    return f"""WITH {ANIM}, z AS (SELECT picture_id, frame_idx, delay_ms + 20 AS width, frame_idx % 17 + 9 AS height FROM fr),
c AS (SELECT *, {size[0]} AS canvas_w, {size[1]} AS canvas_h FROM z), q AS (SELECT *, {dw} AS draw_w, {dh} AS draw_h, {copied} AS copied FROM c)
SELECT picture_id, frame_idx, canvas_w, canvas_h, draw_w, draw_h, CAST(trunc((canvas_w - draw_w) / 2.0) AS INTEGER) AS draw_x, CAST(trunc((canvas_h - draw_h) / 2.0) AS INTEGER) AS draw_y, copied FROM q"""


for _n, _a in {"contain": ("contain", False, 0, 0), "contain_up": ("contain", True, 64, 48), "cover": ("cover", True, 30, 30), "stretch": ("stretch", False, 32, 16)}.items():
    add(f"normalize_{_n}", lambda spark, d, a=_a: L.fit_geometry(_sizes(spark, d), *a), _fit_sql(*_a))
_RUNS = "WITH {0}, k AS (SELECT picture_id, y, x, {1} AS p, lag({1}) OVER (PARTITION BY picture_id, y ORDER BY x) AS q FROM {2}), g AS (SELECT *, sum(CASE WHEN q IS NULL OR p <> q THEN 1 ELSE 0 END) OVER (PARTITION BY picture_id, y ORDER BY x) AS run FROM k) SELECT picture_id, y, min(x) AS start, count(*) AS length FROM g GROUP BY picture_id, y, run"
add("rle_runs", lambda spark, d: L.runs(P.colored(pixels(spark, d), lambda p: C.Argb(*(C.idiv(c, 64) for c in p)))), _RUNS.format(PX.replace("px AS (SELECT", "p1 AS (SELECT") + ", px AS (SELECT picture_id, x, y, a // 64 AS a, r // 64 AS r, g // 64 AS g, b // 64 AS b FROM p1)", _PACKED, "px"))

# -- stencils ----------------------------------------------------------------------------------------


def _near_lossless_sql(bits: int) -> str:
    def near(n: str) -> str:
        return " AND ".join(f"abs(c.{k} - {n}.{k}) < {1 << bits}" for k in "argb")

    keep = "l.x IS NULL OR r.x IS NULL OR u.x IS NULL OR d.x IS NULL OR (" + " AND ".join(near(n) for n in "lrud") + ")"
    joins = " ".join(f"LEFT JOIN px {n} ON {n}.picture_id = c.picture_id AND {n}.x = c.x + {i} AND {n}.y = c.y + {j}" for n, i, j in (("l", -1, 0), ("r", 1, 0), ("u", 0, -1), ("d", 0, 1)))
    return f"WITH {PX} SELECT c.picture_id, c.x, c.y, " + ", ".join(f"CAST(CASE WHEN {keep} THEN c.{k} ELSE {_snapped('c.' + k, bits)} END AS INTEGER) AS {k}" for k in "argb") + f" FROM px c {joins}"


add("near_lossless_pass", lambda spark, d: T.near_lossless_pass(pixels(spark, d), 3, 8, 8), _near_lossless_sql(3))
add("near_lossless_driver", lambda spark, d: T.near_lossless(pixels(spark, d), 85, 8, 8, least=0), _near_lossless_sql(1))
add("near_lossless_bypass", lambda spark, d: T.near_lossless(pixels(spark, d), 20, 8, 8), f"WITH {PX} " + _colors("a", "r", "g", "b"))


def _predictor_sql(mode: int) -> str:
    joins = " ".join(f"LEFT JOIN px {n} ON {n}.picture_id = c.picture_id AND {n}.x = c.x + {i} AND {n}.y = c.y + {j}" for n, i, j in (("l", -1, 0), ("t", 0, -1), ("z", -1, -1), ("w", 1, -1)))
    joins += " LEFT JOIN px f ON f.picture_id = c.picture_id AND f.x = 0 AND f.y = c.y"
    left = " + ".join(f"abs(t.{k} - z.{k})" for k in "argb")
    top = " + ".join(f"abs(l.{k} - z.{k})" for k in "argb")

    def guess(k: str) -> str:
        tr = f"coalesce(w.{k}, f.{k})"
        return {0: "255" if k == "a" else "0", 5: f"((l.{k} + {tr}) // 2 + t.{k}) // 2", 6: f"(l.{k} + z.{k}) // 2", 8: f"(z.{k} + t.{k}) // 2", 9: f"(t.{k} + {tr}) // 2", 10: f"((l.{k} + z.{k}) // 2 + (t.{k} + {tr}) // 2) // 2",
            13: f"greatest(0, least(255, (l.{k} + t.{k}) // 2 + CAST(trunc(((l.{k} + t.{k}) // 2 - z.{k}) / 2.0) AS INTEGER)))", 1: f"l.{k}", 2: f"t.{k}", 3: f"coalesce(w.{k}, f.{k})", 4: f"z.{k}", 7: f"(l.{k} + t.{k}) // 2", 11: f"CASE WHEN {left} < {top} THEN l.{k} ELSE t.{k} END", 12: f"greatest(0, least(255, l.{k} + t.{k} - z.{k}))"}[mode]

    def out(k: str) -> str:
        first = 255 if k == "a" else 0
        return f"CAST((c.{k} - CASE WHEN c.x = 0 AND c.y = 0 THEN {first} WHEN c.y = 0 THEN l.{k} WHEN c.x = 0 THEN t.{k} ELSE {guess(k)} END + 256) % 256 AS INTEGER) AS {k}"

    return f"WITH {PX} SELECT c.picture_id, c.x, c.y, {', '.join(out(k) for k in 'argb')} FROM px c {joins}"


for _m in range(14):
    add(f"predictor_{_m}", lambda spark, d, m=_m: T.predicted_residual(pixels(spark, d), m), _predictor_sql(_m))
add("fxaa", lambda spark, d: T.fxaa(P.to_frames(pixels(spark, d), 8, 8)))


def _bicubic_taps(axis: str, size: int) -> str:
    """For each target place of a side of 8 at another size, the four places it takes from and their weights."""
    t = "abs(place - (base + k))"
    cubic = f"CASE WHEN {t} <= 1 THEN 1.5 * {t} * {t} * {t} - 2.5 * {t} * {t} + 1 WHEN {t} < 2 THEN -0.5 * {t} * {t} * {t} + 2.5 * {t} * {t} - 4 * {t} + 2 ELSE 0 END"
    return f"SELECT CAST(i AS INTEGER) AS t{axis}, greatest(0, least(7, base + k)) AS {axis}, {cubic} AS w{axis} FROM (SELECT i, k, place, CAST(floor(place) AS INTEGER) AS base FROM (SELECT i, (i + CAST(0.5 AS DOUBLE)) * 8 / {size} - 0.5 AS place FROM range({size}) r(i)), (SELECT unnest([-1, 0, 1, 2]) AS k))"


def _bicubic_sql(cte: str, source: str, keys: str, w: int, h: int) -> str:
    """CTEs of which the last, bc (keys, x, y, colours), is the source at another size."""
    out = ", ".join(f"CAST(greatest(0, least(255, floor(sum({c} * wx * wy) + 0.5 + 1e-9))) AS INTEGER) AS {c}" for c in "argb")
    return f"{cte}, kx AS ({_bicubic_taps('x', w)}), ky AS ({_bicubic_taps('y', h)}), bc AS (SELECT {keys}, tx AS x, ty AS y, {out} FROM {source} JOIN kx USING (x) JOIN ky USING (y) GROUP BY {keys}, tx, ty)"


def _clip_frames(spark: SparkSession, d: str) -> DataFrame:
    return P.to_frames(clip(spark, d), 8, 8, "picture_id", "frame_idx").withColumn("delay_ms", F.lit(40))


_ON_CANVAS = ", ".join(f"coalesce({c}, {v}) AS {c}" for c, v in zip("argb", (255, 32, 48, 64)))
add(
    "normalize_drawing",
    lambda spark, d: P.to_pixels(T.normalize_frames(_clip_frames(spark, d), "contain", True, 11, 14, 0xFF203040), "picture_id", "frame_idx"),
    f"""WITH {_bicubic_sql(CLIP, 'cl', 'picture_id, frame_idx', 11, 11)},
cv AS (SELECT picture_id, frame_idx, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM (SELECT DISTINCT picture_id, frame_idx FROM cl), range(11) p(x), range(14) q(y))
SELECT cv.picture_id, cv.frame_idx, cv.x, cv.y, {_ON_CANVAS} FROM cv LEFT JOIN bc ON bc.picture_id = cv.picture_id AND bc.frame_idx = cv.frame_idx AND bc.x = cv.x AND bc.y = cv.y - 1""",
)
add("resize_bicubic", lambda spark, d: P.to_pixels(T.resize_bicubic(P.to_frames(pixels(spark, d), 8, 8), 5, 12)), f"WITH {_bicubic_sql(PX, 'px', 'picture_id', 5, 12)} SELECT * FROM bc")

# -- drawing -----------------------------------------------------------------------------------------


def _shapes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    cols = {"x": k % 23, "y": k % 19, "w": k % 13 + 1, "h": k % 7 + 1, "x2": k * 7 % 29, "y2": k * 5 % 31}
    return table(spark, d, "customer").select(k.alias("picture_id"), *(v.cast("int").alias(n) for n, v in cols.items()))


_SHAPES = "sh AS (SELECT c_custkey AS picture_id, CAST(c_custkey % 23 AS INTEGER) AS x, CAST(c_custkey % 19 AS INTEGER) AS y, CAST(c_custkey % 13 + 1 AS INTEGER) AS w, CAST(c_custkey % 7 + 1 AS INTEGER) AS h, CAST(c_custkey * 7 % 29 AS INTEGER) AS x2, CAST(c_custkey * 5 % 31 AS INTEGER) AS y2 FROM customer), n AS (SELECT CAST(i AS INTEGER) AS i FROM range(-40, 80) t(i))"
add("draw_fill_rect", lambda spark, d: D.fill_rect(_shapes(spark, d), ["picture_id"], "x", "y", "w", "h"), f"WITH {_SHAPES} SELECT picture_id, x + p.i AS x, y + q.i AS y FROM sh JOIN n p ON p.i >= 0 AND p.i < w JOIN n q ON q.i >= 0 AND q.i < h")
add(
    "draw_rect",
    lambda spark, d: D.draw_rect(_shapes(spark, d), ["picture_id"], "x", "y", "w", "h"),
    f"WITH {_SHAPES} SELECT picture_id, x + p.i AS x, y + q.i AS y FROM sh JOIN n p ON p.i >= 0 AND p.i <= w JOIN n q ON q.i >= 0 AND q.i <= h WHERE p.i IN (0, w) OR q.i IN (0, h)",
)
add(
    "draw_line",
    lambda spark, d: D.draw_line(_shapes(spark, d), ["picture_id"], "x", "y", "x2", "y2"),
    f"""WITH RECURSIVE {_SHAPES}, s AS (SELECT picture_id, x, y, x2, y2, abs(x2 - x) AS dx, abs(y2 - y) AS dy, CASE WHEN x < x2 THEN 1 ELSE -1 END AS sx, CASE WHEN y < y2 THEN 1 ELSE -1 END AS sy FROM sh),
b AS (SELECT picture_id, x, y, x2, y2, dx, dy, sx, sy, dx - dy AS err FROM s UNION ALL
  SELECT picture_id, CASE WHEN 2 * err > -dy THEN x + sx ELSE x END, CASE WHEN 2 * err < dx THEN y + sy ELSE y END, x2, y2, dx, dy, sx, sy,
    err - CASE WHEN 2 * err > -dy THEN dy ELSE 0 END + CASE WHEN 2 * err < dx THEN dx ELSE 0 END FROM b WHERE x <> x2 OR y <> y2)
SELECT picture_id, x, y FROM b""",
)
add(
    "draw_fill_oval",
    lambda spark, d: D.fill_oval(_shapes(spark, d), ["picture_id"], "x", "y", "x2", "y2"),
    f"""WITH {_SHAPES}, o AS (SELECT picture_id, x + x2 // 2 AS cx, y + y2 // 2 AS cy, x2 // 2 AS rx, y2 // 2 AS ry FROM sh),
r AS (SELECT picture_id, cx, cy + i AS y, CASE WHEN rx = 0 OR ry = 0 THEN 0 ELSE CAST(floor(rx * sqrt(greatest(0.0::DOUBLE, 1.0::DOUBLE - CAST(i AS DOUBLE) * i / (CAST(greatest(ry, 1) AS DOUBLE) * greatest(ry, 1)))) + 0.5) AS INTEGER) END AS half
  FROM o JOIN n ON abs(i) <= CASE WHEN rx = 0 OR ry = 0 THEN 0 ELSE ry END)
SELECT picture_id, cx + i AS x, y FROM r JOIN n ON abs(i) <= half""",
)


def _walk_sql(lines: str) -> str:
    return coding.walk_sql(f"{_SHAPES}, {lines}")


def _curve_sql(points: list[tuple[str, str]], least: int) -> str:
    degree = len(points) - 1

    def at(axis: int) -> str:
        one = "CAST(1.0 AS DOUBLE)"
        terms = [f"CAST({comb(degree, k)} AS DOUBLE) * ({' * '.join([one, *['t'] * k, *['u'] * (degree - k)])}) * {p[axis]}" for k, p in enumerate(points)]
        return f"CAST(floor({' + '.join(terms)} + 0.5) AS INTEGER)"

    (x0, y0), (x1, y1) = points[0], points[-1]
    steps = f"greatest({least}, CAST(floor(sqrt(CAST(({x1} - {x0}) * ({x1} - {x0}) + ({y1} - {y0}) * ({y1} - {y0}) AS DOUBLE)) / 2) AS INTEGER))"
    return _walk_sql(f"""st AS (SELECT *, {steps} AS steps FROM sh), tt AS (SELECT st.*, i, CAST(i AS DOUBLE) / steps AS t, 1.0::DOUBLE - CAST(i AS DOUBLE) / steps AS u FROM st JOIN n ON i BETWEEN 0 AND steps),
pt AS (SELECT picture_id, i, {at(0)} AS px, {at(1)} AS py FROM tt), ln AS (SELECT a.picture_id, a.px AS x, a.py AS y, b.px AS x2, b.py AS y2 FROM pt a JOIN pt b ON a.picture_id = b.picture_id AND b.i = a.i + 1)""")


def _half_sql(rx: str, ry: str, d: str) -> str:
    return f"CAST(floor(({rx}) * sqrt(greatest(CAST(0 AS DOUBLE), CAST(1 AS DOUBLE) - CAST({d} AS DOUBLE) * ({d}) / (CAST({ry} AS DOUBLE) * ({ry})))) + 0.5) AS INTEGER)"


def _rim_sql(source: str, keys: str) -> str:
    """Offsets (dx, dy) of an oval's rim from its middle: by column where it is flat, by row where it is steep."""
    return f"""SELECT {keys}, a * i AS dx, b * e AS dy FROM (SELECT s.*, i, {_half_sql('greatest(ry, 1)', 'greatest(rx, 1)', 'i')} AS e FROM {source} s JOIN n ON i BETWEEN 0 AND greatest(rx, 1)), (VALUES (1), (-1)) p(a), (VALUES (1), (-1)) q(b)
  WHERE i * greatest(ry, 1) * greatest(ry, 1) <= e * greatest(rx, 1) * greatest(rx, 1)
UNION SELECT {keys}, a * e, b * i FROM (SELECT s.*, i, {_half_sql('greatest(rx, 1)', 'greatest(ry, 1)', 'i')} AS e FROM {source} s JOIN n ON i BETWEEN 0 AND greatest(ry, 1)), (VALUES (1), (-1)) p(a), (VALUES (1), (-1)) q(b)
  WHERE e * greatest(ry, 1) * greatest(ry, 1) >= i * greatest(rx, 1) * greatest(rx, 1)"""


_OVALS = "o AS (SELECT picture_id, x + x2 // 2 AS cx, y + y2 // 2 AS cy, x2 // 2 AS rx, y2 // 2 AS ry FROM sh)"
_ROUND = "o AS (SELECT picture_id, x, y, x2 AS w0, y2 AS h0, w // 2 AS rx, h // 2 AS ry FROM sh)"
_SHAPE_SQL = {
    "draw_polygon": _walk_sql("ln AS (SELECT picture_id, x, y, x2, y2 FROM sh UNION ALL SELECT picture_id, x2, y2, w, h FROM sh UNION ALL SELECT picture_id, w, h, x, y FROM sh)"),
    "draw_quad": _curve_sql([("x", "y"), ("w", "y2"), ("x2", "h")], 8),
    "draw_cubic": _curve_sql([("x", "y"), ("w", "y2"), ("x2", "h"), ("y2", "x")], 12),
    "draw_oval": f"""WITH {_SHAPES}, {_OVALS}, big AS (SELECT * FROM o WHERE rx > 0 AND ry > 0), rim AS ({_rim_sql('big', 'picture_id, cx, cy')})
SELECT picture_id, cx AS x, cy AS y FROM o WHERE rx <= 0 OR ry <= 0 UNION SELECT picture_id, cx + dx, cy + dy FROM rim""",
    "draw_fill_round_rect": f"""WITH {_SHAPES}, {_ROUND}, r AS (SELECT o.*, i AS d, greatest(ry - i, i - (h0 - ry), 0) AS m FROM o JOIN n ON i BETWEEN 0 AND h0),
c AS (SELECT *, CASE WHEN m > 0 THEN rx - {_half_sql('rx', 'greatest(ry, 1)', 'm')} ELSE 0 END AS cut FROM r)
SELECT picture_id, x + cut + i AS x, y + d AS y FROM c JOIN n ON i >= 0 AND i < w0 + 1 - 2 * cut""",
    "draw_round_rect": f"""WITH {_SHAPES}, {_ROUND}, big AS (SELECT * FROM o WHERE rx > 0 AND ry > 0), rim AS ({_rim_sql('big', 'picture_id, x, y, w0, h0, rx, ry')})
SELECT picture_id, x + rx + i AS x, y AS y FROM o JOIN n ON i >= 0 AND i < w0 - 2 * rx + 1 UNION SELECT picture_id, x + rx + i, y + h0 FROM o JOIN n ON i >= 0 AND i < w0 - 2 * rx + 1
UNION SELECT picture_id, x, y + ry + i FROM o JOIN n ON i >= 0 AND i < h0 - 2 * ry + 1 UNION SELECT picture_id, x + w0, y + ry + i FROM o JOIN n ON i >= 0 AND i < h0 - 2 * ry + 1
UNION SELECT picture_id, dx + CASE WHEN dx < 0 THEN x + rx ELSE x + w0 - rx END, dy + CASE WHEN dy < 0 THEN y + ry ELSE y + h0 - ry END FROM rim""",
}
for _n, _f in {
    "draw_oval": lambda s: D.draw_oval(s, ["picture_id"], "x", "y", "x2", "y2"),
    "draw_fill_round_rect": lambda s: D.fill_round_rect(s, ["picture_id"], "x", "y", "x2", "y2", "w", "h"),
    "draw_round_rect": lambda s: D.draw_round_rect(s, ["picture_id"], "x", "y", "x2", "y2", "w", "h"),
    "draw_fill_arc": lambda s: D.fill_arc(s, ["picture_id"], "x", "y", "x2", "y2", F.col("x") * 11, F.col("y") * 13 - 90),
    "draw_arc": lambda s: D.draw_arc(s, ["picture_id"], "x", "y", "x2", "y2", F.col("x") * 11, F.col("y") * 13 - 90),
    "draw_quad": lambda s: D.draw_quad(s, ["picture_id"], ("x", "y"), ("w", "y2"), ("x2", "h")),
    "draw_cubic": lambda s: D.draw_cubic(s, ["picture_id"], ("x", "y"), ("w", "y2"), ("x2", "h"), ("y2", "x")),
    "draw_polygon": lambda s: D.draw_polyline(s.select("picture_id", F.array("x", "x2", "w").alias("xs"), F.array("y", "y2", "h").alias("ys")), ["picture_id"], "xs", "ys", True),
}.items():
    add(_n, lambda spark, d, f=_f: f(_shapes(spark, d)), _SHAPE_SQL.get(_n))
add(
    "draw_fill_polygon",
    lambda spark, d: D.fill_polygon(_shapes(spark, d).select("picture_id", F.array("x", "x2", "w").alias("xs"), F.array("y", "y2", "h").alias("ys")), ["picture_id"], "xs", "ys"),
    f"""WITH {_SHAPES}, e AS (SELECT picture_id, unnest([x, x2, w]) AS xi, unnest([y, y2, h]) AS yi, unnest([w, x, x2]) AS xj, unnest([h, y, y2]) AS yj FROM sh),
c AS (SELECT picture_id, i AS y, xi + CAST(trunc((i - yi) * (xj - xi) / CAST(yj - yi AS DOUBLE)) AS INTEGER) AS x, row_number() OVER (PARTITION BY picture_id, i ORDER BY xi + CAST(trunc((i - yi) * (xj - xi) / CAST(yj - yi AS DOUBLE)) AS INTEGER)) AS k
  FROM e JOIN n ON yi <> yj AND ((yi < i AND yj >= i) OR (yj < i AND yi >= i)))
SELECT DISTINCT a.picture_id, n.i AS x, a.y FROM c a JOIN c b ON a.picture_id = b.picture_id AND a.y = b.y AND b.k = a.k + 1 AND a.k % 2 = 1 JOIN n ON n.i BETWEEN a.x AND b.x""",
)
add(
    "draw_copy_area",
    lambda spark, d: P.put(pixels(spark, d), D.copy_area(pixels(spark, d), 1, 2, 4, 3, 2, 3, 8, 8)),
    f"WITH {PX} SELECT c.picture_id, c.x, c.y, " + ", ".join(f"CASE WHEN c.x BETWEEN 3 AND 6 AND c.y BETWEEN 5 AND 7 THEN coalesce(s.{k}, 0) ELSE c.{k} END AS {k}" for k in "argb") + " FROM px c LEFT JOIN px s ON s.picture_id = c.picture_id AND s.x = c.x - 2 AND s.y = c.y - 3",
)
add(
    "draw_affine",
    lambda spark, d: D.draw_affine(side(spark, d, 1), side(spark, d, 0), (0.0, 2.0, -2.0, 0.0, 7.0, 0.0), 8, 8),
    f"WITH {PAIR}, bl AS (SELECT d0.*, sa, sr, sg, sb FROM d0 LEFT JOIN s0 ON d0.picture_id = s0.picture_id AND s0.x = CAST(floor(d0.y / 2.0) AS INTEGER) AND s0.y = CAST(floor((7 - d0.x) / 2.0) AS INTEGER)) "
    + _colors(*(f"CASE WHEN sa IS NULL OR sa = 0 THEN d{n} ELSE {_BLEND_SQL['normal'](n)} END" for n in "argb"), source="bl"),
)

# -- files -----------------------------------------------------------------------------------------------


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("path"), F.col("text").cast("binary").alias("content"))
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("path"), F.col("html").cast("binary").alias("content"))
    marks = ["FFD8FF", "89504E47", "424D", "474946", "52494646000000005745425041", "49492A00", "4D4D002A", "00000100", "716F6966", "5034", "5037"]
    made = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("path"), F.unhex(F.element_at(F.array(*map(F.lit, marks)), (F.col("s_suppkey") % len(marks) + 1).cast("int"))).alias("content"))
    return docs.unionByName(pages).unionByName(made)


add(
    "detect_format",
    lambda spark, d: _blobs(spark, d).select("path", R.format_of(F.col("content")).alias("format")),
    """WITH m AS (SELECT ['FFD8FF', '89504E47', '424D', '474946', '52494646000000005745425041', '49492A00', '4D4D002A', '00000100', '716F6966', '5034', '5037'] AS l),
b AS (SELECT 'd' || doc_id AS path, hex(encode(text)) AS h FROM documents UNION ALL SELECT 'p' || page_id, hex(encode(html)) FROM pages UNION ALL SELECT 's' || s_suppkey, l[s_suppkey % 11 + 1] FROM supplier, m)
SELECT path, CASE WHEN h LIKE 'FFD8FF%' THEN 'JPEG' WHEN h LIKE '89504E47%' THEN 'PNG' WHEN h LIKE '424D%' THEN 'BMP' WHEN h LIKE '474946%' THEN 'GIF' WHEN h LIKE '52494646________57454250%' THEN 'WEBP'
  WHEN h LIKE '49492A00%' OR h LIKE '4D4D002A%' THEN 'TIFF' WHEN h LIKE '00000100%' THEN 'ICO' WHEN h LIKE '%54525545564953494F4E2D5846494C452E00' AND len(h) >= 52 THEN 'TGA' WHEN h LIKE '716F6966%' THEN 'QOI'
  WHEN h[1:4] IN ('5031', '5032', '5033', '5034', '5035', '5036') THEN 'PNM' END AS format FROM b""",
)
add("base64_round_trip", lambda spark, d: table(spark, d, "documents").select("doc_id", F.regexp_replace(F.base64(F.col("text").cast("binary")), "[\\r\\n]", "").alias("t")).select("doc_id", F.md5("t").alias("md5"), F.unbase64("t").cast("string").alias("text")), "SELECT doc_id, md5(to_base64(encode(text))) AS md5, text FROM documents")


def _through(format: str, opaque: bool = False, **options) -> Query:
    """Encode every picture, decode the files, and give the pixels."""

    def build(spark: SparkSession, d: str) -> DataFrame:
        px = pixels(spark, d)
        px = px.withColumn("a", F.lit(255)) if opaque else px
        frames = P.to_frames(px, 8, 8).withColumn("has_alpha", F.lit(not opaque))
        files = R.encode_frames(frames, format, **options).select(F.col("picture_id").cast("string").alias("path"), "content")
        back = R.decode_files(files).select(F.col("path").cast("bigint").alias("picture_id"), "width", "argb")
        return P.to_pixels(back)

    return build


_SAME, _SOLID = f"WITH {PX} " + _colors("a", "r", "g", "b"), f"WITH {PX} " + _colors("255", "r", "g", "b")
for _format in ("png", "qoi", "tga", "tiff", "ico", "webp"):
    add(f"{_format}_round_trip", _through(_format), _SAME)
for _packing in ("none", "lzw", "packbits"):
    add(f"tiff_{_packing}_round_trip", _through("tiff", compression=_packing), _SAME)
add("tga_raw_round_trip", _through("tga", True, rle=False), _SOLID)
add("bmp_round_trip", _through("bmp", True), _SOLID)
add("pnm_round_trip", _through("pnm", True), _SOLID)
add("pnm_plain_round_trip", _through("pnm", True, ascii=True), _SOLID)
_GRAY = "(r * 299 + g * 587 + b * 114 + 500) // 1000"
add("pgm_round_trip", _through("pnm", True, variant="pgm"), f"WITH {PX} " + _colors("255", _GRAY, _GRAY, _GRAY))
_BIT = f"CASE WHEN {_GRAY} < 128 THEN 0 ELSE 255 END"
add("pbm_round_trip", _through("pnm", True, variant="pbm"), f"WITH {PX} " + _colors("255", _BIT, _BIT, _BIT))
add("gif_round_trip", _through("gif", True, transparent=False), _SOLID)


def _clip_frames(spark: SparkSession, d: str) -> DataFrame:
    return P.to_frames(clip(spark, d), 8, 8, "picture_id", "frame_idx").withColumn("delay_ms", (F.col("frame_idx") % 5 * 10 + 20).cast("int"))


def _animated(format: str, **options) -> Query:
    def build(spark: SparkSession, d: str) -> DataFrame:
        files = R.encode_frames(_clip_frames(spark, d), format, **options).select(F.col("picture_id").cast("string").alias("path"), "content")
        return R.decode_files(files).select(F.col("path").cast("bigint").alias("picture_id"), "frame_idx", "delay_ms", "argb", "width")

    return lambda spark, d: P.to_pixels(build(spark, d), "picture_id", "frame_idx", "delay_ms")


add("webp_animation_round_trip", _animated("webp"), f"WITH {CLIP} SELECT picture_id, frame_idx, frame_idx % 5 * 10 + 20 AS delay_ms, x, y, a, r, g, b FROM cl")
add("tiff_pages_round_trip", _animated("tiff"), f"WITH {CLIP} SELECT picture_id, frame_idx, 100 AS delay_ms, x, y, a, r, g, b FROM cl")
add(
    "pnm_text",
    lambda spark, d: pixels(spark, d).groupBy("picture_id", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "r", "g", "b"))), lambda p: F.concat_ws(" ", p["r"], p["g"], p["b"])), " ").alias("line")),
    f"WITH {PX} SELECT picture_id, y, string_agg(r || ' ' || g || ' ' || b, ' ' ORDER BY x) AS line FROM px GROUP BY 1, 2",
)

# -- the rest --------------------------------------------------------------------------------------------



def _search_sql(modes: tuple[int, ...]) -> str:
    residuals = ", ".join(f"r{m} AS ({_predictor_sql(m)[len('WITH ') + len(PX) :]})" for m in modes)
    every = " UNION ALL ".join(f"SELECT {m} AS mode, * FROM r{m}" for m in modes)
    cost = " + ".join(f"abs(CASE WHEN {c} > 127 THEN {c} - 256 ELSE {c} END)" for c in "argb")
    return (
        f"WITH {PX}, {residuals}, a AS ({every}), s AS (SELECT picture_id, x // 4 AS tx, y // 4 AS ty, mode, CAST(sum({cost}) AS BIGINT) AS score FROM a GROUP BY 1, 2, 3, 4) "
        "SELECT picture_id, tx, ty, mode, score FROM s QUALIFY row_number() OVER (PARTITION BY picture_id, tx, ty ORDER BY score, mode) = 1"
    )


for _n, _modes in (("predictor_best", (1, 2, 4, 11)), ("predictor_search", tuple(range(14)))):
    add(_n, lambda spark, d, m=_modes: T.predictor_scores(pixels(spark, d), m, 4), _search_sql(_modes))
_SB = {c: f"CAST(CASE WHEN {c} > 127 THEN {c} - 256 ELSE {c} END AS BIGINT)" for c in "rgb"}


def _fit(top: str, bottom: str) -> str:
    return f"CAST(coalesce(greatest(-128, least(127, floor(({top}) * 32.0::DOUBLE / nullif({bottom}, 0) + 0.5))), 0) AS INTEGER)"


add(
    "cross_color_fit",
    lambda spark, d: S.cross_color_fit(pixels(spark, d), 4),
    f"WITH {PX}, q AS (SELECT picture_id, x // 4 AS tx, y // 4 AS ty, {_SB['r']} AS r, {_SB['g']} AS g, {_SB['b']} AS b FROM px), s AS (SELECT picture_id, tx, ty, sum(g * g) AS gg, sum(g * r) AS gr, sum(g * b) AS gb, sum(r * r) AS rr, sum(r * b) AS rb FROM q GROUP BY 1, 2, 3), "
    f"k AS (SELECT *, {_fit('CAST(gr AS DOUBLE)', 'gg')} AS green_to_red, {_fit('CAST(gb AS DOUBLE)', 'gg')} AS green_to_blue FROM s) SELECT picture_id, tx, ty, green_to_red, green_to_blue, {_fit('CAST(rb AS DOUBLE) - green_to_blue * CAST(gr AS DOUBLE) / 32.0::DOUBLE', 'rr')} AS red_to_blue FROM k",
)
add(
    "icon_entry",
    lambda spark, d: S.largest_entry(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.row_number().over(P.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("ord"), (F.col("l_partkey") % 5 * 16).cast("int").alias("width"), (F.col("l_suppkey") % 4 * 16).cast("int").alias("height"))),
    "WITH e AS (SELECT l_orderkey AS file, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS ord, CAST(l_partkey % 5 * 16 AS INTEGER) AS w0, CAST(l_suppkey % 4 * 16 AS INTEGER) AS h0 FROM lineitem), "
    "k AS (SELECT file, ord, CASE WHEN w0 = 0 THEN 256 ELSE w0 END AS width, CASE WHEN h0 = 0 THEN 256 ELSE h0 END AS height FROM e) SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY file ORDER BY width * height DESC, ord) = 1",
)
_KINDS = "['0', '1', '2', '3', 'none', 'doNotDispose', 'restoreToBackgroundColor', 'RESTORE_TO_PREVIOUS', '7', 'odd']"
add(
    "frame_enums",
    lambda spark, d: table(spark, d, "supplier").select("s_suppkey", F.element_at(F.expr("array" + _KINDS.replace("[", "(").replace("]", ")")), (F.col("s_suppkey") % 10 + 1).cast("int")).alias("v")).select("s_suppkey", L.parsed_disposal(F.col("v")).alias("disposal"), L.parsed_blend(F.col("s_suppkey") % 3).alias("blend"), L.frame_flags(L.parsed_disposal(F.col("v")), L.parsed_blend(F.col("s_suppkey") % 3)).alias("flags")),
    f"WITH k AS (SELECT s_suppkey, ({_KINDS})[s_suppkey % 10 + 1] AS v FROM supplier), p AS (SELECT s_suppkey, CASE WHEN v IN ('1', 'doNotDispose') THEN 'DO_NOT_DISPOSE' WHEN v = '2' THEN 'RESTORE_TO_BACKGROUND' WHEN v IN ('3', 'RESTORE_TO_PREVIOUS') THEN 'RESTORE_TO_PREVIOUS' ELSE 'NONE' END AS disposal, CASE WHEN s_suppkey % 3 = 1 THEN 'OVER' ELSE 'SOURCE' END AS blend FROM k) "
    "SELECT s_suppkey, disposal, blend, CASE WHEN disposal = 'RESTORE_TO_BACKGROUND' THEN 1 ELSE 0 END + CASE WHEN blend = 'SOURCE' THEN 2 ELSE 0 END AS flags FROM p",
)
add("first_frame", lambda spark, d: L.first_frames(clip(spark, d)), f"WITH {CLIP} SELECT * FROM cl WHERE frame_idx = 0")
add(
    "append_frames",
    lambda spark, d: L.appended(animation(spark, d), animation(spark, d).filter("picture_id % 2 = 0 AND frame_idx < 3")),
    f"WITH {ANIM}, l AS (SELECT picture_id, max(frame_idx) AS last FROM fr GROUP BY 1) SELECT * FROM fr UNION ALL SELECT picture_id, CAST(frame_idx + last + 1 AS INTEGER), delay_ms FROM fr JOIN l USING (picture_id) WHERE picture_id % 2 = 0 AND frame_idx < 3",
)


def _seen(spark: SparkSession, d: str, k: int) -> DataFrame:
    return side(spark, d, k).filter("a <> 0").select(*P.KEYS)


_OPAQUE = "sp AS (SELECT picture_id, x, y FROM s0 WHERE sa <> 0), dp AS (SELECT picture_id, x, y FROM d0 WHERE da <> 0)"
for _n, _op in {"only_first": ("exceptAll", "EXCEPT"), "both": ("intersect", "INTERSECT")}.items():
    add(f"coverage_{_n}", lambda spark, d, o=_op[0]: getattr(_seen(spark, d, 0), o)(_seen(spark, d, 1)), f"WITH {PAIR}, {_OPAQUE} SELECT * FROM sp {_op[1]} SELECT * FROM dp")
for _n, _how, _not in (("inside", "left_semi", ""), ("outside", "left_anti", "NOT ")):
    add(
        f"mask_{_n}",
        lambda spark, d, h=_how: side(spark, d, 0).join(_seen(spark, d, 1), list(P.KEYS), h),
        f"WITH {PAIR}, {_OPAQUE} SELECT picture_id, x, y, sa AS a, sr AS r, sg AS g, sb AS b FROM s0 WHERE {_not}EXISTS (SELECT 1 FROM dp WHERE dp.picture_id = s0.picture_id AND dp.x = s0.x AND dp.y = s0.y)",
    )


def _webp_chunks(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.webp import chunk_rows

    files = R.encode_frames(_clip_frames(spark, d), "webp").select(F.col("picture_id").cast("string").alias("path"), "content")
    return chunk_rows(files).select("path", "ord", "kind")


add(
    "webp_chunks",
    _webp_chunks,
    f"WITH {CLIP}, n AS (SELECT picture_id, count(DISTINCT frame_idx) AS k FROM cl GROUP BY 1), o AS (SELECT CAST(picture_id AS VARCHAR) AS path, CAST(unnest(range(k + 2)) AS INTEGER) AS ord FROM n) SELECT path, ord, CASE ord WHEN 0 THEN 'VP8X' WHEN 1 THEN 'ANIM' ELSE 'ANMF' END AS kind FROM o",
)


def _jpeg_error(spark: SparkSession, d: str) -> DataFrame:
    """Mean squared error of each picture after a trip through JPEG."""
    px = pixels(spark, d).withColumn("a", F.lit(255))
    files = R.encode_frames(P.to_frames(px, 8, 8).withColumn("has_alpha", F.lit(False)), "jpeg", quality=0.95, halve=False).select(F.col("picture_id").cast("string").alias("path"), "content")
    back = R.decode_files(files).select(F.col("path").cast("bigint").alias("picture_id"), "width", "height", "argb")
    errors = S.block_errors(P.paired_frames(px, back), 8)
    return errors.select("picture_id", (F.col("sse") / 192).alias("mse"))


add("jpeg_error", _jpeg_error)


# -- layouts, masks, blocks of the lossy format ------------------------------------------------------------

_RGB = "CAST(r AS BIGINT) * 65536 + g * 256 + b"


def _unpacked(f: Callable[[], C.Argb]) -> Query:
    return lambda spark, d: pixels(spark, d).select(*P.KEYS, *f().named())


add("unpack_int_rgb", _unpacked(lambda: Y.int_rgb(C.pack(*C.Argb.of()))), f"WITH {PX} " + _colors("255", "r", "g", "b"))
add("unpack_int_bgr", _unpacked(lambda: Y.int_bgr(C.pack(*C.Argb.of()))), f"WITH {PX} " + _colors("255", "b", "g", "r"))
add("unpack_gray", _unpacked(lambda: Y.gray(F.col("g"))), f"WITH {PX} " + _colors("255", "g", "g", "g"))
add("unpack_gray_alpha", _unpacked(lambda: Y.gray(F.col("b"), F.col("a"))), f"WITH {PX} " + _colors("a", "b", "b", "b"))
add(
    "unpack_indexed",
    _unpacked(lambda: Y.indexed(F.col("g") % 5, F.expr("array(0, -1, -8355712, 2130706687, 305419896)"))),
    f"WITH {PX}, q AS (SELECT picture_id, x, y, ([0, 4294967295, 4286611584, 2130706687, 305419896])[g % 5 + 1] AS c FROM px) " + _colors("c // 16777216", "c // 65536 % 256", "c // 256 % 256", "c % 256", "q"),
)


def _bands(order: str, f: Callable[[Column, Column], C.Argb]) -> Query:
    def build(spark: SparkSession, d: str) -> DataFrame:
        """Pictures as bytes in this order of bands, and back."""
        place = (F.col("y") * 8 + F.col("x")).alias("place")
        cell = F.concat(*(F.lpad(F.hex(c), 2, "0") for c in order))
        rows = pixels(spark, d).groupBy("picture_id").agg(F.array_sort(F.collect_list(F.struct(place, cell.alias("cell")))).alias("cells"))
        packed = rows.select("picture_id", F.unhex(F.array_join(F.transform("cells", lambda c: c["cell"]), "")).alias("content"))
        spots = packed.select("picture_id", "content", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("place"))
        return spots.select("picture_id", (F.col("place") % 8).alias("x"), C.idiv(F.col("place"), 8).alias("y"), *f(F.col("content"), F.col("place")).named())

    return build


add("unpack_bytes_abgr", _bands("abgr", Y.bytes_abgr), f"WITH {PX} " + _colors("a", "r", "g", "b"))
add("unpack_bytes_bgr", _bands("bgr", Y.bytes_bgr), f"WITH {PX} " + _colors("255", "r", "g", "b"))

_MARKED = "SELECT picture_id, x, y FROM px WHERE r % 9 = 0"
add(
    "mask_mark",
    lambda spark, d: M.mark(pixels(spark, d).filter("r % 9 = 0"), pixels(spark, d).filter("g % 5 = 0").withColumn("x", F.col("x") + 3).withColumn("y", F.col("y") - 2), 8, 8),
    f"WITH {PX} {_MARKED} UNION SELECT picture_id, x + 3, y - 2 FROM px WHERE g % 5 = 0 AND x < 5 AND y > 1",
)
add(
    "mask_attach",
    lambda spark, d: M.attach(M.enable(pixels(spark, d)), pixels(spark, d).filter("r % 9 = 0")),
    f"WITH {PX} " + _colors("a", "r", "g", "b").replace(" FROM px", ", r % 9 = 0 AS marked FROM px"),
)
add("mask_clear", lambda spark, d: M.clear(M.attach(pixels(spark, d), pixels(spark, d).filter("r % 9 = 0"))), f"WITH {PX} " + _colors("a", "r", "g", "b"))

add(
    "filter_level",
    lambda spark, d: table(spark, d, "part").select("p_partkey", V.ac_step(F.col("p_partkey") % 128).alias("step"), V.filter_level(F.col("p_partkey") % 128).alias("level")),
    f"WITH q AS (SELECT p_partkey, ({list(V.AC_STEPS)})[p_partkey % 128 + 1] AS step FROM part), v AS (SELECT *, least(63, least(63, step // 4) * 300 // 256) AS k FROM q) SELECT p_partkey, step, CASE WHEN k < 2 THEN 0 ELSE k END AS level FROM v",
)


def _block_pass(source: str, down: bool, terms: list[str]) -> str:
    """Four values along a row (or down a column) of each block, and four new ones from them."""
    at, line = ("i", "j") if down else ("j", "i")
    picked = ", ".join(f"max(v) FILTER ({at} = {k}) AS {n}" for k, n in enumerate("pqrs"))
    return f"SELECT picture_id, tx, ty, {line}, unnest(range(4)) AS {at}, unnest([{', '.join(f'CAST({t} AS BIGINT)' for t in terms)}]) AS v FROM (SELECT picture_id, tx, ty, {line}, {picked} FROM {source} GROUP BY ALL)"


def _down(x: str, bits: int) -> str:
    return f"floor(({x}) / {1 << bits}.0)"


def _forward(scale: Callable[[str], str], bits: int, second: int, last: int, extra: str = "") -> list[str]:
    return [scale("p + q + r + s"), _down(f"(q - r) * 2217 + (p - s) * 5352 + {second}", bits) + extra, scale("p - q - r + s"), _down(f"(p - s) * 2217 - (q - r) * 5352 + {last}", bits)]


def _inverse(p: str, bits: int) -> list[str]:
    m = {c: f"({_down(f'{c} * 20091', 16)} + {c})" for c in "qs"}
    n = {c: _down(f"{c} * 35468", 16) for c in "qs"}
    return [_down(t, bits) for t in (f"{p} + r + {m['q']} + {n['s']}", f"{p} - r + {n['q']} - {m['s']}", f"{p} - r - {n['q']} + {m['s']}", f"{p} + r - {m['q']} - {n['s']}")]


def _signs(p: str, bits: int) -> list[str]:
    return [_down(f"{p} {x} q {y} r {z} s", bits) for x, y, z in ("+++", "+--", "--+", "-+-")]


for _n, _f, _v, _one, _two in (
    ("forward_dct", B.forward_dct, "r - 128", (False, _forward(lambda t: f"({t}) * 8", 9, 1812, 937)), (True, _forward(lambda t: _down(f"{t} + 7", 4), 16, 12_000, 51_000, " + CASE WHEN p <> s THEN 1 ELSE 0 END"))),
    ("inverse_dct", B.inverse_dct, "(r - 128) * 5", (True, _inverse("p", 0)), (False, _inverse("(p + 4)", 3))),
    ("forward_wht", B.forward_wht, "r - 128", (False, _signs("p", 0)), (True, _signs("p", 1))),
    ("inverse_wht", B.inverse_wht, "(r - 128) * 5", (True, _signs("p", 0)), (False, _signs("p + 3", 3))),
):
    add(
        f"block_{_n}",
        lambda spark, d, f=_f, v=_v: B.gathered(pixels(spark, d), F.expr(v)).select("picture_id", "tx", "ty", F.posexplode(f(F.col("block"))).alias("place", "v")),
        f"WITH {PX}, b0 AS (SELECT picture_id, x // 4 AS tx, y // 4 AS ty, y % 4 AS i, x % 4 AS j, CAST({_v} AS BIGINT) AS v FROM px), b1 AS ({_block_pass('b0', *_one)}), b2 AS ({_block_pass('b1', *_two)}) "
        "SELECT picture_id, tx, ty, CAST(i * 4 + j AS INTEGER) AS place, CAST(v AS INTEGER) AS v FROM b2",
    )
