"""Image fonts: glyphs are rectangles of a sheet, a stack with alpha whose first image is used.

A string becomes a table of glyphs with their places; the sheet's pixels learn their glyph from the metrics and meet the
table by it; what lands on one pixel is laid over it in the string's order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.samples import quotient
from rasterloom.model import KEYS, Raster

FIELDS = ("Image_spec", "Font_size", "Global_ascent", "Global_descent")


@dataclass(frozen=True)
class Glyph:
    """left and top are inclusive, right and bottom exclusive; shift moves the glyph, forward the pen."""

    left: int
    right: int
    top: int
    bottom: int
    shift: int
    forward: int


@dataclass(frozen=True)
class Bounds:
    neg_width: int
    global_descent: int
    pos_width: int
    global_ascent: int
    descent: int
    ascent: int
    advance_width: int
    right_bearing: int


@dataclass(frozen=True)
class ImageFont:
    glyphs: dict[int, Glyph]
    ascent: int
    descent: int
    size: int = 0
    image: str = ""

    @classmethod
    def parse(cls, lines: list[str]) -> ImageFont:
        """A font file: ``name = value`` lines, FM_ and a code for a glyph's six numbers; # begins a comment."""
        fields, glyphs = {}, {}
        for line in lines:
            m = re.match(r"\s*([^#\s=]+)\s*=\s*(.+?)\s*$", line)
            if m and m[1] in FIELDS:
                fields[m[1]] = m[2]
            elif m and re.fullmatch(r"FM_\d+", m[1]) and re.fullmatch(r"-?\d+(?:\s+-?\d+){5}", m[2]):
                glyphs[int(m[1][3:])] = Glyph(*map(int, m[2].split()))
        if missing := [f for f in FIELDS if f not in fields]:
            raise ValueError(f"a font needs {', '.join(missing)}")
        return cls(glyphs, int(fields["Global_ascent"]), int(fields["Global_descent"]), int(fields["Font_size"]), fields["Image_spec"])

    def placed(self, text: str, x: int, y: int) -> list[tuple[int, int, int, int]]:
        """(order, code, left, top) of each known byte's glyph, for a pen that begins at x on the baseline y."""
        out = []
        for k, code in enumerate(text.encode()):
            if code in self.glyphs:
                out.append((k, code, x + self.glyphs[code].shift, y - self.ascent))
                x += self.glyphs[code].forward
        return out

    def bounds(self, text: str) -> Bounds:
        """The pen's way, the ink's ends beside it, and how far the tallest and deepest glyphs reach from the baseline."""
        placed = self.placed(text, 0, 0)
        if not placed:
            return Bounds(0, self.descent, 0, self.ascent, 0, 0, 0, 0)
        used = [self.glyphs[code] for _, code, *_ in placed]
        advance, (*_, last_left, _) = sum(g.forward for g in used), placed[-1]
        ink = last_left + used[-1].right - used[-1].left
        return Bounds(min(0, placed[0][2]), self.descent, max(advance, ink), self.ascent, self.ascent - max(g.bottom - g.top for g in used), self.ascent, advance, advance - ink)


def glyph_pixels(font: ImageFont, sheet: Raster) -> DataFrame:
    """(code, dx, dy, channels): the sheet's pixels by glyph; a glyph's table row is found by its rectangle."""
    spark = sheet.px.sparkSession
    metrics = spark.createDataFrame([(code, g.left, g.right, g.top, g.bottom) for code, g in font.glyphs.items()], "code int, _l int, _r int, _t int, _b int")
    inside = (F.col("x") >= F.col("_l")) & (F.col("x") < F.col("_r")) & (F.col("y") >= F.col("_t")) & (F.col("y") < F.col("_b"))
    first = sheet.px.where(F.col("image_id") == 0)
    # 256 glyphs at most
    return first.join(F.broadcast(metrics), inside).select("code", (F.col("x") - F.col("_l")).alias("dx"), (F.col("y") - F.col("_t")).alias("dy"), *(F.col(n).alias(f"s_{n}") for n in sheet.names))


def draw(r: Raster, text: str, x: int, y: int, font: ImageFont, sheet: Raster) -> Raster:
    """The string's glyphs laid over every image of a stack without alpha, in order."""
    if not sheet.has_alpha or r.has_alpha or sheet.channels != r.channels + 1:
        raise ValueError("the sheet has the image's channels and alpha, the image none")
    placed = r.px.sparkSession.createDataFrame(font.placed(text, x, y), "k int, code int, _x int, _y int")
    ink = glyph_pixels(font, sheet).join(placed, "code")
    ink = ink.select((F.col("_x") + F.col("dx")).alias("x"), (F.col("_y") + F.col("dy")).alias("y"), F.struct("k", *(f"s_{n}" for n in sheet.names)).alias("s")).where(F.col("x").between(0, r.width - 1) & F.col("y").between(0, r.height - 1))
    layers = ink.groupBy("y", "x").agg(F.array_sort(F.collect_list("s")).alias("_layers"))
    alpha = f"s_{sheet.names[-1]}"

    def laid(n: str) -> Column:
        over = lambda old, s: quotient(s[alpha] * s[f"s_{n}"] + (255 - s[alpha]) * old, 255).cast("int")
        return F.when(F.col("_layers").isNull(), F.col(n)).otherwise(F.aggregate("_layers", F.col(n).cast("int"), over))

    return r.with_px(r.px.join(layers, ["y", "x"], "left").select(*KEYS, *r.names, "_layers")).project({n: laid(n) for n in r.names})
