"""Text by a font of fixed metrics: boxes for glyphs, bounding boxes, alignment and word wrap. There is no glyph rasteriser."""

from __future__ import annotations

from dataclasses import dataclass

from rasterloom.model import Raster
from rasterloom.operators.draw import box_filled


@dataclass(frozen=True)
class BoundingBox:
    neg_width: int
    descent: int
    advance: int
    ascent: int

    @property
    def height(self) -> int:
        return self.ascent - self.descent


@dataclass(frozen=True)
class BlockFont:
    """Every glyph is half as wide as the size; three tenths of the size lie below the line."""

    size: int = 16

    def bounds(self, text: str) -> BoundingBox:
        below = int(self.size * 0.3 + 0.5)
        return BoundingBox(0, -below, int(self.size * 0.5 + 0.5) * len(text), self.size - below)


def wrap(text: str, font: BlockFont, width: int, height: int | None = None) -> tuple[list[str], int]:
    """Lines no wider than width, filled greedily; a longer word is split. Also how many lines fit into height."""
    lines: list[str] = []
    for part in text.split("\n"):
        line = ""
        for word in part.split(" "):
            tried = f"{line} {word}" if line else word
            if font.bounds(tried).advance <= width:
                line = tried
                continue
            if line:
                lines.append(line)
            line = word
            while font.bounds(line).advance > width and len(line) > 1:
                fits = max(1, width // max(1, font.bounds("x").advance))
                lines.append(line[:fits])
                line = line[fits:]
        lines.append(line)
    return lines, len(lines) if height is None else min(len(lines), height // max(1, font.bounds("").height))


def align(x: int, y: int, box: BoundingBox, halign: str = "left", valign: str = "baseline") -> tuple[int, int]:
    """Where the text starts and its baseline."""
    left = {"left": x, "start": x, "center": x - box.advance // 2, "right": x - box.advance, "end": x - box.advance}[halign]
    base = {"baseline": y, "top": y + box.ascent, "bottom": y + box.descent, "center": y + (box.ascent + box.descent) // 2}[valign]
    return left, base


def draw(r: Raster, text: str, x: int, y: int, font: BlockFont, colour: tuple[int, ...], halign: str = "left", valign: str = "baseline") -> Raster:
    left, base = align(x, y, font.bounds(text), halign, valign)
    step = font.bounds("x").advance
    for k, ch in enumerate(text):
        if not ch.isspace():
            r = box_filled(r, left + k * step, base - font.bounds("x").ascent + 1, left + (k + 1) * step - 2, base, colour)
    return r
