"""Operators on single pixels: each is one projection, so chains of them collapse into one stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import tags
from rasterloom.functions.samples import clamp, grey, quotient
from rasterloom.model import Raster


def contrast(r: Raster, intensity: float) -> Raster:
    """Every channel, alpha included, times a float32 intensity, truncated and capped; a negative intensity changes nothing."""
    if intensity < 0:
        return r
    k = F.lit(intensity).cast("float").cast("double")
    return r.map_all(lambda c: F.least(F.lit(1.0), c * k) if r.bits == "double" else F.least(F.lit(int(r.top)), (c * k).cast("int")))


def hardinvert(r: Raster, every: bool = False) -> Raster:
    """The largest sample less each colour, and with every each alpha, too."""
    return (r.map_all if every else r.map_colour)(lambda c: F.lit(r.top) - c)


def noise(r: Raster, amount: float, per_sample: bool = False, seed: int = 0) -> Raster:
    """A uniform difference within +-amount, the same for all channels of a pixel or not."""
    shift = lambda k: (F.rand(seed + k) * 2 - 1) * amount
    same = r.px.withColumn("_d", shift(0))
    return r.with_px(same).project({n: clamp((F.col(n) + (shift(1 + k) if per_sample else F.col("_d"))).cast("int")) for k, n in enumerate(r.names)})


def postlevels(r: Raster, levels: int) -> Raster:
    """Posterise to a number of levels, in float32."""
    step = int(256 / levels)
    return r.map_all(lambda c: clamp((c.cast("float") / F.lit(255.0).cast("float") * F.lit(levels).cast("float")).cast("int") * step))


def lin_stretch(r: Raster, a: int, b: int) -> Raster:
    return r.map_all(lambda c: clamp(quotient((c - a) * 255, b - a)))


def flines(r: Raster) -> Raster:
    """Darken rows toward the middle of the screen, even and odd ones from opposite ends."""
    y, h = F.col("y"), float(r.height)
    share = F.when(y % 2 == 0, y / F.lit(h)).otherwise((F.lit(h) - y) / F.lit(h)).cast("float")
    factor = (F.lit(1.2).cast("float") - F.lit(0.8).cast("float") * share).cast("float")
    return r.map_colour(lambda c: clamp((c.cast("float") * factor).cast("int")))


def map_lut(r: Raster, tables: dict[str, list[int]]) -> Raster:
    """256-entry tables by channel ("all", "red", "green", "blue", "alpha"); tables of another length are ignored."""
    index = {"red": 0, "green": 1, "blue": 2, "alpha": 3}
    chosen: dict[str, Column] = {}
    for k, n in enumerate(r.names):
        table = tables.get("all") or next((t for name, t in tables.items() if index.get(name) == k), None)
        if table and len(table) == 256:
            chosen[n] = F.element_at(F.array(*(F.lit(min(255, max(0, int(v)))) for v in table)), F.col(n) + 1)
    return r.project(chosen)


PRESETS = {
    "grey": [[0.222, 0.707, 0.071]], "gray": [[0.222, 0.707, 0.071]], "red": [[1]], "green": [[0, 1]], "blue": [[0, 0, 1]], "channel0": [[1]], "channel1": [[0, 1]], "channel2": [[0, 0, 1]],
    "noalpha": [[1, 0, 0], [0, 1, 0], [0, 0, 1]], "rgb": [[1], [1], [1]],
}


def preset(r: Raster, name: str) -> list[list[float]]:
    """The matrix of a named conversion for a stack's channel count."""
    n = r.channels
    if name == "alpha":
        return [[0] * (n - 1) + [1]] if r.has_alpha else [[0] * n + [1]]
    if name == "addalpha":
        colours = n - r.has_alpha
        return [[float(i == j) for j in range(n)] for i in range(colours)] + [[0] * (n - 1) + [1] if r.has_alpha else [0] * n + [1]]
    if name in ("grey", "gray", "noalpha") and n <= 2:
        return [[1]]
    if name not in PRESETS:
        raise ValueError(f"unknown conversion {name}")
    return PRESETS[name]


def convert(r: Raster, matrix: list[list[float]] | str) -> Raster:
    """Each new channel a linear combination of the old ones; a further column counts the largest sample. Truncated, clamped."""
    rows = preset(r, matrix) if isinstance(matrix, str) else matrix
    if not 1 <= len(rows) <= 4:
        raise ValueError("a conversion makes 1 to 4 channels")
    out = {}
    for k, row in enumerate(rows):
        # a row that copies one channel stays a plain column
        plain = [i for i, v in enumerate(row[: r.channels]) if v]
        if len(plain) == 1 and row[plain[0]] == 1 and not any(row[r.channels :]):
            out[f"c{k}"] = F.col(f"c{plain[0]}")
            continue
        total = F.lit(float(row[r.channels] * r.top) if len(row) > r.channels else 0.0)
        for i, v in enumerate(row[: r.channels]):
            if v:
                total = F.col(f"c{i}") * F.lit(float(v)) + total
        out[f"c{k}"] = r.sample(total)
    return r.project(out, channels=len(rows))


def adapt(r: Raster, channels: int) -> Raster:
    """Implicit coercion between channel counts: greys are rounded, missing alpha is full, dropped alpha composes on black."""
    have = r.channels
    if have == channels:
        return r
    names = r.colour_names
    colours = [F.col(n) for n in names]
    alpha = F.col(r.names[-1]) if r.has_alpha else None
    if alpha is not None and channels in (1, 3):
        colours = [F.lit(0) + quotient(c * alpha, int(r.top)).cast("int") for c in colours]
    if channels <= 2 and len(colours) == 3:
        colours = [grey(*colours, rounded=True)]
    elif channels >= 3 and len(colours) == 1:
        colours = colours * 3
    if channels in (2, 4):
        colours = [*colours, alpha if alpha is not None else F.lit(int(r.top))]
    return r.project({f"c{k}": c for k, c in enumerate(colours)}, channels=channels)


def flatten(r: Raster, background: tuple[int, int, int] = (0, 0, 0)) -> Raster:
    """Alpha removed by composing on a background: (c * a + bg * (top - a)) / top."""
    if not r.has_alpha:
        return r
    names, top = r.colour_names, int(r.top)
    back = background if len(names) == 3 else (int(0.222 * background[0] + 0.707 * background[1] + 0.071 * background[2] + 0.5),)
    a = F.col(r.names[-1])
    return r.project({n: quotient(F.col(n) * a + F.lit(back[k]) * (F.lit(top) - a), top).cast("int") for k, n in enumerate(names)}, channels=r.channels - 1)


def flatten_tagged(r: Raster, heads: DataFrame) -> Raster:
    """As flatten, each image on the background that its tags (image_id, tags) name; black where they name none."""
    if not r.has_alpha:
        return r
    names, top = r.colour_names, int(r.top)
    back = tags.background(F.col("tags"))
    scale = F.lit(top // 255)
    parts = [back[n] * scale for n in "rgb"] if len(names) == 3 else [grey(back["r"], back["g"], back["b"], rounded=True) * scale]
    px = r.px.join(heads.select("image_id", *(c.alias(f"_b{k}") for k, c in enumerate(parts))), "image_id", "left")
    a = F.col(r.names[-1])
    return r.with_px(px).project({n: quotient(F.col(n) * a + F.coalesce(F.col(f"_b{k}"), F.lit(0)) * (F.lit(top) - a), top).cast("int") for k, n in enumerate(names)}, channels=r.channels - 1)


def border(r: Raster, colour: tuple[int, ...]) -> Raster:
    edge = F.col("x").isin(0, r.width - 1) | F.col("y").isin(0, r.height - 1)
    return r.project({n: F.when(edge, F.lit(colour[k])).otherwise(F.col(n)) for k, n in enumerate(r.names)})
