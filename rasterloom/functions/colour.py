"""Colours from text and back, of single values and of columns, and by hue in degrees."""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sixteen basic names. Larger tables are read from rgb.txt or palette files.
NAMES = {
    "black": (0, 0, 0), "silver": (192, 192, 192), "gray": (128, 128, 128), "white": (255, 255, 255), "maroon": (128, 0, 0), "red": (255, 0, 0), "purple": (128, 0, 128), "fuchsia": (255, 0, 255),
    "green": (0, 128, 0), "lime": (0, 255, 0), "olive": (128, 128, 0), "yellow": (255, 255, 0), "navy": (0, 0, 128), "blue": (0, 0, 255), "teal": (0, 128, 128), "aqua": (0, 255, 255),
}


def read_names(lines: list[str]) -> dict[str, tuple[int, int, int]]:
    """Names of an rgb.txt or a GIMP palette: rows of three numbers and a name, # and ! begin remarks."""
    out = {}
    for line in lines:
        m = re.match(r"\s*(\d+)\s+(\d+)\s+(\d+)\s+(\S.*?)\s*$", line)
        if m and not line.startswith(("#", "!")):
            out[m[4].lower()] = tuple(int(m[k]) for k in (1, 2, 3))
    return out


def parse(text: str, names: dict[str, tuple[int, int, int]] | None = None) -> tuple[int, int, int, int]:
    """(r, g, b, a) of #rgb, #rrggbb, #rrggbbaa (with or without #), rgb(), rgba() or a name."""
    t = text.strip().lower()
    if m := re.fullmatch(r"#?([0-9a-f]{6})([0-9a-f]{2})?", t):
        v = bytes.fromhex(m[1] + (m[2] or "ff"))
        return tuple(v)
    if m := re.fullmatch(r"#([0-9a-f])([0-9a-f])([0-9a-f])", t):
        return (*(int(c, 16) * 17 for c in m.groups()), 255)
    if m := re.fullmatch(r"rgba?\(([^)]*)\)", t):
        parts = [p for p in re.split(r"[\s,/]+", m[1].strip()) if p]
        if len(parts) in (3, 4):
            value = lambda p: min(255, max(0, ceil(float(p[:-1]) * 255 / 100) if p.endswith("%") else ceil(float(p))))
            alpha = 255 if len(parts) == 3 else min(255, ceil((float(parts[3][:-1]) / 100 if parts[3].endswith("%") else float(parts[3])) * 255))
            return (*map(value, parts[:3]), alpha)
    found = (names or {}).get(t) or NAMES.get(t)
    if found is None:
        raise ValueError(f"no colour named {text}")
    return (*found, 255)


def as_css(c: tuple[int, ...]) -> str:
    """rgb(), or rgba() with the shortest of tenths, percents and tenths of a percent that read back as the alpha."""
    if len(c) < 4 or c[3] == 255:
        return f"rgb({c[0]}, {c[1]}, {c[2]})"
    mille = c[3] * 1000 // 255
    reads = lambda share, of: -(-share * 255 // of) == c[3]
    alpha = f"{mille // 100 / 10:g}" if reads(mille // 100, 10) else f"{mille // 10}%" if reads(mille // 10, 100) else f"{mille / 10:g}%"
    return f"rgba({c[0]}, {c[1]}, {c[2]}, {alpha})"


def css(r: Column, g: Column, b: Column, a: Column) -> Column:
    """as_css over columns of whole numbers from 0 to 255."""
    mille = F.floor(a * 1000 / F.lit(255.0)).cast("int")
    tenth, percent = F.floor(mille / 100).cast("int"), F.floor(mille / 10).cast("int")
    reads = lambda share, of: F.ceil(share * 255 / F.lit(of)) == a
    digits = mille % 10
    alpha = F.when(reads(tenth, 10), F.when(tenth == 0, F.lit("0")).otherwise(F.concat(F.lit("0."), tenth.cast("string"))))
    alpha = alpha.when(reads(percent, 100) | (digits == 0), F.concat(percent.cast("string"), F.lit("%"))).otherwise(F.concat(percent.cast("string"), F.lit("."), digits.cast("string"), F.lit("%")))
    text = F.concat_ws(", ", *(c.cast("string") for c in (r, g, b)))
    return F.when(a == 255, F.concat(F.lit("rgb("), text, F.lit(")"))).otherwise(F.concat(F.lit("rgba("), text, F.lit(", "), alpha, F.lit(")")))


_NUMBER, _GAP = r"(\d+(?:\.\d*)?%?)", " *[, ] *"
FUNCTION = rf"^rgba?\( *{_NUMBER}{_GAP}{_NUMBER}{_GAP}{_NUMBER}(?: *[/,] *((?:\.\d+|\d+(?:\.\d*)?)%?))? *\)$"


def parsed(text: Column, names: dict[str, tuple[int, int, int]] | None = None) -> Column:
    """struct(r, g, b, a) of what parse takes; null where a text is none of these. Tables of many names are better joined
    on the lower-cased text."""
    t = F.lower(F.trim(text))
    part = lambda pattern, k: F.regexp_extract(t, pattern, k)

    def share(p: Column, whole: float) -> Column:
        number = F.regexp_replace(p, "%", "").try_cast("double")
        return F.least(F.lit(255), F.ceil(F.when(p.endswith("%"), number * 255 / 100).otherwise(number * whole)).cast("int"))

    def struct(*values: Column) -> Column:
        return F.struct(*(v.cast("int").alias(n) for n, v in zip("rgba", values, strict=True)))

    byte = lambda x: F.conv(x, 16, 10).try_cast("int")
    long_, short = r"^#?([0-9a-f]{2})([0-9a-f]{2})([0-9a-f]{2})([0-9a-f]{2})?$", "^#([0-9a-f])([0-9a-f])([0-9a-f])$"
    alpha, last = part(FUNCTION, 4), part(long_, 4)
    known = F.create_map(*(F.lit(v) if isinstance(v, str) else struct(*map(F.lit, (*v, 255))) for item in ({**NAMES, **(names or {})}).items() for v in item))
    found = F.when(t.rlike(FUNCTION), struct(*(share(part(FUNCTION, k), 1.0) for k in (1, 2, 3)), F.when(alpha == "", F.lit(255)).otherwise(share(alpha, 255.0))))
    found = found.when(t.rlike(long_), struct(*(byte(part(long_, k)) for k in (1, 2, 3)), F.when(last == "", F.lit(255)).otherwise(byte(last))))
    return found.when(t.rlike(short), struct(*(byte(part(short, k)) * 17 for k in (1, 2, 3)), F.lit(255))).otherwise(F.try_element_at(known, t))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in whole degrees, saturation and value from 0 to 1, of samples from 0 to 255."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.greatest(top - low, F.lit(1)).cast("double")
    turn = lambda p, q: (p - q) / span * 60
    h = F.when(top == low, F.lit(0)).when(r == top, F.pmod(turn(g, b).cast("int"), F.lit(360))).when(g == top, (turn(b, r) + 120).cast("int")).otherwise((turn(r, g) + 240).cast("int"))
    return h, F.when(top == 0, F.lit(0.0)).otherwise(1 - low / F.greatest(top, F.lit(1)).cast("double")), top / F.lit(255.0)


def from_hsv(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Whole samples from 0 to 255 of a hue in degrees (whole turns don't count), a saturation and a value from 0 to 1."""
    h = F.when(h >= 360, (h.cast("long") % 360).cast("double")).when(h < 0, h + 360.0).otherwise(h.cast("double")) / 60.0
    i, s, v = h.cast("int"), F.least(s, F.lit(1.0)), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255
    f = h - i
    m, n, k = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))

    def pick(*sextants: Column) -> Column:
        out = F.when(s <= 0, v)
        for at, c in enumerate(sextants):
            out = out.when(i == at, c)
        return out.cast("int")

    return pick(v, n, m, m, k, v), pick(k, v, v, n, m, m), pick(m, m, k, v, v, n)


def equals(a: tuple[int, ...], b: tuple[int, ...], ignore_alpha: bool = False) -> bool:
    return a[:3] == b[:3] and (ignore_alpha or (a[3:] or (255,)) == (b[3:] or (255,)))


def to_float(c: tuple[int, ...]) -> tuple[float, ...]:
    return tuple(v / 255 for v in c)


def to_8bit(c: tuple[float, ...]) -> tuple[int, ...]:
    return tuple(min(255, max(0, int(v * 255 + 0.5))) for v in c)
