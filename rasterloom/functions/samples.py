"""Sample arithmetic as column expressions: truncated quotients, greys, HSV."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The weights of red, green and blue in a grey.
GREY = (0.222, 0.707, 0.071)


def quotient(a: Column, b: Column | int) -> Column:
    """a / b truncated toward zero; null where b is zero. Operands stay under 2^53."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.when(b != 0, (a.cast("double") / b.cast("double")).cast("long"))


def clamp(c: Column, top: int = 255) -> Column:
    return F.least(F.greatest(c, F.lit(0)), F.lit(top)).cast("int")


def grey(r: Column, g: Column, b: Column, rounded: bool = False) -> Column:
    total = r * GREY[0] + g * GREY[1] + b * GREY[2]
    return (total + 0.5 if rounded else total).cast("int")


def _turn(r: Column, g: Column, b: Column, v: Column, span: Column) -> Column:
    """Degrees from -60 to 300."""
    cr, cg, cb = ((v - c) / span for c in (r, g, b))
    return F.when(r == v, cb - cg).when(g == v, F.lit(2.0) + cr - cb).otherwise(F.lit(4.0) + cg - cr) * 60.0


def _hue(r: Column, g: Column, b: Column, v: Column, low: Column) -> Column:
    """Degrees; defined where v > low."""
    h = _turn(r, g, b, v, F.when(v > low, (v - low).cast("double")))
    return F.when(h < 0, h + 360).otherwise(h)


def rgb_to_hsv8(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Each from 0 to 255, truncated."""
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    s = F.when(v == 0, F.lit(0.0)).otherwise((v - low) * 255.0 / F.when(v > 0, v))
    return F.when(s == 0, F.lit(0)).otherwise((_hue(r, g, b, v, low) * 255 / 360.0).cast("int")).cast("int"), s.cast("int"), v.cast("int")


def _sextant8(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column, Column]:
    hh = h / 255.0 * 6
    i = hh.cast("int")
    f = hh - i
    return i, *((0.5 + v * (255 - x) / 255).cast("int") for x in (s * 1.0, s * f, s * (1 - f)))


def _picked8(i: Column, s: Column, v: Column, m: Column, n: Column, k: Column) -> tuple[Column, Column, Column]:
    v = v.cast("int")
    pick = lambda *c: reduce(lambda out, each: out.when(i == each[0], each[1]), enumerate(c), F.when(s == 0, v)).otherwise(F.lit(0))
    return pick(v, n, m, m, k, v), pick(k, v, v, n, m, m), pick(m, m, k, v, v, n)


def hsv_to_rgb8(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    i, m, n, k = _sextant8(h, s, v)
    return _picked8(i, s, v, m, n, k)


def with_hsv8(px: DataFrame, sides: dict[str, list[Column]]) -> DataFrame:
    """Columns {side}h, {side}s and {side}v of the colours of each side, step by step and without nulls, so that the generated
    code stays small enough for the JVM to compile. A missing colour is black."""
    px = px.withColumns({f"{p}{k}": F.coalesce(c, F.lit(0)) for p, colours in sides.items() for k, c in enumerate(colours)})
    sides = {p: [F.col(f"{p}{k}") for k in range(3)] for p in sides}
    px = px.withColumns({f"{p}v": F.greatest(*c) for p, c in sides.items()} | {f"{p}span": F.greatest(*c) - F.least(*c) for p, c in sides.items()})
    one = lambda name: F.greatest(F.col(name), F.lit(1)).cast("double")
    px = px.withColumns({f"{p}turn": _turn(*c, F.col(f"{p}v"), one(f"{p}span")) for p, c in sides.items()})
    turned = lambda name: F.col(name) + F.when(F.col(name) < 0, 360.0).otherwise(0.0)
    return px.withColumns({f"{p}h": (turned(f"{p}turn") * 255 / 360.0).cast("int") for p in sides} | {f"{p}s": (F.col(f"{p}span") * 255.0 / one(f"{p}v")).cast("int") for p in sides})


def with_rgb8(px: DataFrame, h: Column, s: Column, v: Column, names: list[str]) -> DataFrame:
    """As hsv_to_rgb8, into columns, step by step."""
    parts = ("_sextant", "_low", "_down", "_up")
    px = px.withColumns(dict(zip(parts, _sextant8(h, s, v), strict=True)))
    i, *rest = map(F.col, parts)
    return px.withColumns(dict(zip(names, _picked8(i, s, v, *rest), strict=True)))


def rgb_to_hsvf(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Each from 0 to 1."""
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    s = F.when(v < 1e-10, F.lit(0.0)).otherwise((v - low) / F.when(v > 0, v))
    return F.when(s < 1e-10, F.lit(0.0)).otherwise(_hue(r, g, b, v, low) / 360.0), s, v


def hsv_to_rgbf(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    hh = F.pmod(h, F.lit(1.0)) * 6
    i = F.floor(hh).cast("int")
    f = hh - i
    m, n, k = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    pick = lambda *c: F.when(s < 1e-10, v).otherwise(F.element_at(F.array(*c), i + 1))
    return pick(v, n, m, m, k, v), pick(k, v, v, n, m, m), pick(m, m, k, v, v, n)
