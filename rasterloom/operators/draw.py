"""Drawing. Shapes are predicates or coverages over (x, y), or small tables of rows or places that are joined."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, comb, cos, floor, fmod, inf, pi, sin, sqrt

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.samples import quotient
from rasterloom.model import KEYS, Raster
from rasterloom.operators import regions, spans, sweep
from rasterloom.operators.joins import compose


def _x() -> Column:
    return F.col("x")


def _y() -> Column:
    return F.col("y")


def _where(r: Raster, inside: Column, colour: tuple[int, ...]) -> Raster:
    return r.project({n: F.when(inside, F.lit(colour[k])).otherwise(F.col(n)) for k, n in enumerate(r.names)})


def box(r: Raster, x1: int, y1: int, x2: int, y2: int, colour: tuple[int, ...]) -> Raster:
    """Outline, corners included."""
    inside = _x().between(x1, x2) & _y().between(y1, y2)
    return _where(r, inside & (_x().isin(x1, x2) | _y().isin(y1, y2)), colour)


def box_filled(r: Raster, x1: int, y1: int, x2: int, y2: int, colour: tuple[int, ...]) -> Raster:
    return _where(r, _x().between(x1, x2) & _y().between(y1, y2), colour)


def box_fill(r: Raster, x1: int, y1: int, x2: int, y2: int, painted: Raster, mode: str = "none") -> Raster:
    """A box filled with what another stack (of the same size, say a fill) has there. The result has the places that both have."""
    x1, y1, x2, y2 = max(0, x1), max(0, y1), min(r.width - 1, x2), min(r.height - 1, y2)
    return compose(r, painted, x1, y1, mode, src_box=(x1, y1, x2 + 1, y2 + 1), common=True)


def _axes(x1: int, y1: int, x2: int, y2: int) -> tuple[bool, int, int, int, int, int]:
    """Whether y is a line's longer axis, its first and last place on that axis, the first on the other, the two spans (the
    second with its sign). Ties go to y."""
    steep = not abs(x2 - x1) > abs(y2 - y1)
    (a1, b1), (a2, b2) = sorted([(y1, x1), (y2, x2)] if steep else [(x1, y1), (x2, y2)], key=lambda p: p[0])
    return steep, a1, a2, b1, a2 - a1, b2 - b1


def line(r: Raster, x1: int, y1: int, x2: int, y2: int, colour: tuple[int, ...], endpoint: bool = True) -> Raster:
    """The pixels nearest to the line along its longer axis; a tie goes on in the line's direction. Without endpoint the
    last pixel on that axis is left out."""
    steep, a1, a2, b1, da, db = _axes(x1, y1, x2, y2)
    a, b = (_y(), _x()) if steep else (_x(), _y())
    if da == 0:
        return _where(r, (_x() == x1) & (_y() == y1) & F.lit(endpoint), colour)
    step = F.floor((2 * abs(db) * (a - a1) + da) / F.lit(2 * da)).cast("int")
    return _where(r, a.between(a1, a2 if endpoint else a2 - 1) & (b == (step if db >= 0 else -step) + b1), colour)


def line_dda(r: Raster, x1: int, y1: int, x2: int, y2: int, colour: tuple[int, ...]) -> Raster:
    """One pixel for each x from x1 to x2, at the rounded y."""
    if x1 == x2:
        return _where(r, (_x() == x1) & (_y() == y1), colour)
    near = (F.lit(float(y1)) + (_x() - x1) / F.lit(float(x2 - x1)) * F.lit(float(y2 - y1)) + 0.5).cast("int")
    return _where(r, _x().between(x1, x2) & (_y() == near), colour)


#: (x, y, a, b): the sample there becomes trunc(a * old + b * new).
Write = tuple[int, int, float, float]


def soft_line(x1: int, y1: int, x2: int, y2: int, endpoint: bool = True) -> list[Write]:
    """The writes of an anti-aliased line: at each place of the longer axis two pixels share the colour."""
    steep, a1, a2, b1, da, db = _axes(x1, y1, x2, y2)
    way, db = (1 if db >= 0 else -1), abs(db)
    out: list[Write] = []
    put = lambda a, b, *shares: out.append((b, a, *shares) if steep else (a, b, *shares))
    for k in range(da - 1):
        done = db * k // da
        share = max(0.0, (da * (done + 1) - db * (k + 1)) / da) if db else 1.0
        if not steep:
            share = float(np.float32(share))
        put(a1 + 1 + k, b1 + way * done, 1 - share, share)
        put(a1 + 1 + k, b1 + way * (done + 1), share, 1 - share)
    ends = [(a1, b1), (a2, b1 + way * db)]
    for a, b in ends if endpoint else ends[:1] if da else []:
        put(a, b, 0.0, 1.0)
    return out


def stroke(r: Raster, writes: list[Write], colour: tuple[int, ...]) -> Raster:
    """Writes in order. Each touched place has a list of them, folded over its sample; the places (about as many as a curve
    is long) are joined, all others stay."""
    places: dict[tuple[int, int], list[tuple[float, float]]] = {}
    for x, y, a, b in writes:
        if 0 <= x < r.width and 0 <= y < r.height:
            places.setdefault((x, y), []).append((a, b))
    if not places:
        return r
    table = r.px.sparkSession.createDataFrame([(x, y, w) for (x, y), w in places.items()], "x int, y int, _w array<struct<a:double,b:double>>")
    px = r.px.join(F.broadcast(table), ["y", "x"], "left")

    def drawn(n: str, value: int) -> Column:
        return F.aggregate("_w", F.col(n).cast("int"), lambda old, w: (w["a"] * old + w["b"] * F.lit(float(value))).cast("int"))

    return r.with_px(px).project({n: F.coalesce(drawn(n, colour[k]), F.col(n)) for k, n in enumerate(r.names)})


def line_aa(r: Raster, x1: int, y1: int, x2: int, y2: int, colour: tuple[int, ...], endpoint: bool = True) -> Raster:
    return stroke(r, soft_line(x1, y1, x2, y2, endpoint), colour)


def polyline(r: Raster, points: list[tuple[int, int]], colour: tuple[int, ...], aa: bool = False) -> Raster:
    pieces = list(zip(points, points[1:], strict=False))
    if aa:
        return stroke(r, [w for p, q in pieces for w in soft_line(*p, *q)], colour)
    for p, q in pieces:
        r = line(r, *p, *q, colour)
    return r


#: Growth of a curve's parameter from piece to piece.
CURVE_STEP = 0.005


def curve_points(points: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """Places on a Bezier curve, the parameter growing by additions from 0 to 1 at most."""
    n, t, out = len(points) - 1, 0.0, []
    while t <= 1:
        shares = [comb(n, k) * t**k * (1 - t) ** (n - k) for k in range(n + 1)]
        out.append(tuple(int(0.5 + sum(s * p[axis] for s, p in zip(shares, points, strict=True))) for axis in (0, 1)))
        t += CURVE_STEP
    return out


def bezier(r: Raster, points: list[tuple[float, float]], colour: tuple[int, ...]) -> Raster:
    """Short anti-aliased lines between the places."""
    return polyline(r, curve_points(points), colour, aa=True)


#: Degrees between the places of a rim.
RIM_STEP = 0.01


def _spoke(x1: int, y1: int, x2: int, y2: int) -> Iterator[tuple[int, int]]:
    """A place for each step of a radius' longer axis, the other coordinate growing by additions."""
    flat = abs(y2 - y1) <= abs(x2 - x1) and x1 != x2
    (a1, b1), (a2, b2) = sorted([(x1, y1), (x2, y2)] if flat else [(y1, x1), (y2, x2)], key=lambda p: p[0])
    slope = (y2 - y1) / (x2 - x1) if x1 != x2 else inf
    grow, at = slope if flat else 1 / slope if slope else 0.0, float(b1)
    for a in range(a1, a2 + 1):
        yield (a, int(at + 0.5)) if flat else (int(at + 0.5), a)
        at += grow


def sector_rows(cx: int, cy: int, radius: float, d1: float, d2: float) -> list[tuple[int, int, int]]:
    """A pie's spans (y, x1, x2): in each row all from the least to the largest of the rounded places of its rim and its two
    radii. d1 > d2 goes through 360 and is two pies."""
    if d1 > d2:
        return sector_rows(cx, cy, radius, d1, 360) + sector_rows(cx, cy, radius, 0, d2)
    d1, d2 = float(np.float32(d1)), float(np.float32(d2))
    rim = lambda d: (int(cx + 0.5 + radius * cos(d * pi / 180.0)), int(cy + 0.5 + radius * sin(d * pi / 180.0)))
    # sums one after another, as many as a full turn has steps
    places = [rim(d) for d in np.add.accumulate(np.r_[d1, np.full(int((d2 - d1) / RIM_STEP) + 2, RIM_STEP)]).tolist() if d <= d2]
    ends: dict[int, tuple[int, int]] = {}
    for x, y in (*places, *_spoke(cx, cy, *rim(d1)), *_spoke(cx, cy, *rim(d2))):
        low, high = ends.get(y, (x, x))
        ends[y] = min(low, x), max(high, x)
    return [(y, low, high + 1) for y, (low, high) in sorted(ends.items())]


def arc(r: Raster, cx: int, cy: int, radius: float, d1: float, d2: float, colour: tuple[int, ...]) -> Raster:
    """A filled pie from d1 to d2 degrees (clockwise from the right, as y grows downward)."""
    return spans.paint(r, spans.made(r.px.sparkSession, sector_rows(cx, cy, radius, d1, d2)), colour)


#: Where a place of the first eighth of a circle, (along, across) from the middle, goes in each eighth, and where that lies on
#: a way round of length 8: at a quarter's start, or before or after it by the place's distance across.
EIGHTHS = [(1, 1, False, 0, 1), (1, 1, True, 2, -1), (-1, 1, True, 2, 1), (-1, 1, False, 4, -1), (-1, -1, False, 4, 1), (-1, -1, True, 6, -1), (1, -1, True, 6, 1), (1, -1, False, 8, -1)]


def eighth(radius: int) -> list[tuple[int, int]]:
    """(along, across) of the places of an eighth of a circle after its first one: across grows by one, along shrinks where the
    error of x * x + y * y isn't negative."""
    along, across, error, out = radius, 0, 1 - radius, []
    while across < along:
        if error >= 0:
            along -= 1
            error -= 2 * along
        across += 1
        error += 2 * across + 1
        out.append((along, across))
    return out


def soft_eighth(radius: int) -> list[tuple[int, int, int, bool]]:
    """(along, across, alpha, inner): at each step two places share the colour by how far the rim is from the outer one."""
    along, across, before, out = radius, 0, 0.0, []
    while along > across + 1:
        across += 1
        exact = sqrt(radius * radius - across * across)
        gap = ceil(exact) - exact
        along -= gap < before
        share = int(gap * 255 + 0.5)
        out += [(along, across, 255 - share, False)] * (share < 255) + [(along - 1, across, share, True)] * (share > 0 and along > across)
        before = gap
    return out


def _ways(radius: int, d1: float, d2: float) -> list[tuple[int, int]]:
    """The parts of the way round (of length 8 * (radius + 1)) that an arc takes."""
    scale = radius + 1

    def way(angle: float) -> int:
        quarter = int((angle + 45) / 90)
        rest = angle - 90 * quarter
        return int(scale * ((0 if quarter == 4 and rest > 0 else 2 * quarter) + sin(rest * pi / 180)))

    a, b = (way(fmod(d + 360 * floor((359 - d) / 360) if d < 0 else d, 360)) for d in (d1, d2))
    return [(0, b), (a, 8 * scale)] if b < a else [(a, b)]


def outline(radius: int, d1: float = 0, d2: float = 361, soft: bool = False) -> list[tuple[int, int, int]]:
    """(dx, dy, alpha) of an arc's outline, in the order of writing. Eighths meet in one place, which is written once, but for
    the inner one of an arc."""
    if radius < 0 or radius == 0 and (soft or d2 - d1 < 360):
        raise ValueError("a circle's radius isn't negative, nor zero for an arc or a soft one")
    scale = radius + 1
    whole = d1 + 360 <= d2
    ways = [(0, 8 * scale)] if whole else _ways(radius, d1, d2)
    steps = soft_eighth(radius) if soft else [(*p, 255, False) for p in eighth(radius)]
    out: list[tuple[int, int, int]] = []
    for start, end in ways:
        out += [(x * radius, y * radius, 255) for x, y, k in ((1, 0, 0), (0, 1, 2), (-1, 0, 4), (0, -1, 6)) if (start <= k * scale <= end if k else start == 0)]
        for along, across, alpha, inner in steps:
            for sx, sy, turned, base, sign in EIGHTHS:
                if start <= base * scale + sign * across <= end and not (turned and along == across and (whole or not inner)):
                    out.append((sx * across, sy * along, alpha) if turned else (sx * along, sy * across, alpha))
    return out


def dab(r: Raster, places: list[tuple[int, int, int]], colour: tuple[int, ...]) -> Raster:
    """The colour written at each place (x, y, alpha) in order; with an alpha channel, over what is there. The places, about as
    many as an outline is long, are joined; all other pixels stay."""
    held: dict[tuple[int, int], list[int]] = {}
    for x, y, alpha in places:
        if alpha and 0 <= x < r.width and 0 <= y < r.height:
            held.setdefault((x, y), []).append(alpha)
    if not held:
        return r
    table = r.px.sparkSession.createDataFrame([(x, y, a) for (x, y), a in held.items()], "x int, y int, _a array<int>")
    values = dict(zip(r.names, colour, strict=False))

    def written(old: Column, alpha: Column) -> Column:
        if not r.has_alpha:
            return F.struct(*(quotient(old[n] * (255 - alpha) + values[n] * alpha, 255).cast("int").alias(n) for n in r.names))
        top = r.names[-1]
        left = (255 - alpha) * old[top]
        both = alpha + quotient(left, 255)
        mixed = [F.when(alpha == 255, F.lit(values[n])).otherwise(quotient(alpha * values[n] + quotient(left * old[n], 255), both)).cast("int").alias(n) for n in r.colour_names]
        return F.struct(*mixed, both.cast("int").alias(top))

    first = F.struct(*(F.col(n).cast("int").alias(n) for n in r.names))
    px = r.px.join(F.broadcast(table), ["y", "x"], "left").withColumn("_new", F.when(F.col("_a").isNotNull(), F.aggregate("_a", first, written)))
    return r.with_px(px).project({n: F.coalesce(F.col("_new")[n], F.col(n)) for n in r.names})


def arc_outline(r: Raster, cx: int, cy: int, radius: int, d1: float, d2: float, colour: tuple[int, ...], soft: bool = False) -> Raster:
    """An arc's rim from d1 to d2 degrees, one pixel wide or anti-aliased; a range of 360 or more is a circle."""
    if soft:
        return dab(r, [(cx + x, cy + y, a) for x, y, a in outline(radius, d1, d2, True)], colour)
    return stroke(r, [(cx + x, cy + y, 0.0, 1.0) for x, y, _ in dict.fromkeys(outline(radius, d1, d2))], colour)


def circle(r: Raster, cx: int, cy: int, radius: int, colour: tuple[int, ...], filled: bool = True, soft: bool = False) -> Raster:
    """A disc, or its outline."""
    if radius < 0:
        raise ValueError("a circle's radius isn't negative")
    return arc(r, cx, cy, radius, 0, 361, colour) if filled else arc_outline(r, cx, cy, radius, 0, 361, colour, soft)


def _inside(px: Column, py: Column, contours: list[list[tuple[float, float]]], rule: str) -> Column:
    total = F.lit(0)
    for points in contours:
        if len(points) < 3:
            raise ValueError("a contour has three points at least")
        for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
            if ay == by:
                continue
            cross = F.lit(float(ax)) + (py - float(ay)) * ((bx - ax) / (by - ay))
            hit = py.between(min(ay, by), max(ay, by)) & (py < max(ay, by)) & (px < cross)
            total = total + F.when(hit, F.lit(1 if by > ay or rule == "evenodd" else -1)).otherwise(0)
    return total % 2 != 0 if rule == "evenodd" else total != 0


def polygon(r: Raster, contours: list[list[tuple[float, float]]], colour: tuple[int, ...], rule: str = "evenodd") -> Raster:
    """The pixels whose middle lies inside, by the even-odd or nonzero rule; sweep.polygon is the anti-aliased kind."""
    return _where(r, _inside(_x() + 0.5, _y() + 0.5, contours, rule), colour)


def circle_aa(r: Raster, cx: float, cy: float, radius: float, colour: tuple[int, ...]) -> Raster:
    """Filled. Coverage comes from sixteen lines in each row, whose ends are cut to sixteenths of a pixel; the frame's last
    row takes no part."""
    reach = ceil(radius)
    rows = _y().between(max(0, floor(cy) - reach), min(r.height - 1, ceil(cy) + reach) - 1)
    # the sixteen lines' ends by row, a table no longer than the frame is high
    ends = []
    for y in range(max(0, floor(cy) - reach), min(r.height, ceil(cy) + reach + 1)):
        lines = [sqrt(float(radius * radius) - dy * dy) for dy in (y + ((sub + 1) / 16 - cy) for sub in range(16)) if dy * dy < radius * radius]
        ends.append((y, [(int(0.5 + (float(cx) - half) * 16.0), int(0.5 + (float(cx) + half) * 16.0)) for half in lines]))
    table = r.px.sparkSession.createDataFrame(ends, "y int, _ends array<struct<a:int,b:int>>")
    here = _x() * 16
    covered = F.aggregate("_ends", F.lit(0), lambda n, e: n + F.greatest(F.least(e["b"], here + 16) - F.greatest(e["a"], here), F.lit(0)))
    near = F.col("_ends").isNotNull() & _x().between(floor(cx) - reach - 1, ceil(cx) + reach + 1)
    px = r.px.join(F.broadcast(table), "y", "left").withColumn("_share", F.when(rows & near, F.floor(covered * 255 / F.lit(256)).cast("int")).otherwise(F.lit(0)))
    share = F.col("_share")
    return r.with_px(px).project({n: quotient(F.col(n) * (F.lit(255) - share) + F.lit(colour[k]) * share, 255).cast("int") for k, n in enumerate(r.names)})


def soft_sector(cx: float, cy: float, radius: float, d1: float, d2: float) -> list[tuple[float, float]]:
    """The corners of a pie: its middle and places of its rim, about one for each pixel of a whole circle's length, 8 to 360."""
    d1 = fmod(d1, 360)
    d2 = 360.0 if d1 == 0 and d2 >= 360 else fmod(d2, 360)
    first, last = d1 * pi / 180, (d2 + 360 * (d2 < d1)) * pi / 180
    step = 2 * pi / min(360, max(8, int(2 * pi * radius)))
    # sums one after another, as many as a full turn has steps
    between = [a for a in np.add.accumulate(np.r_[first, np.full(int((last - first) / step) + 2, step)]).tolist() if a < last]
    return [(float(cx), float(cy)), *((cx + radius * cos(a), cy + radius * sin(a)) for a in (first, *between, last))]


def arc_aa(r: Raster, cx: float, cy: float, radius: float, d1: float, d2: float, colour: tuple[int, ...]) -> Raster:
    """An anti-aliased pie from d1 to d2 degrees; 0 to 361 is a disc."""
    return circle_aa(r, cx, cy, radius, colour) if (d1, d2) == (0, 361) else sweep.polygon(r, [soft_sector(cx, cy, radius, d1, d2)], colour)


def pixel_alpha(r: Raster, x: int, y: int, colour: tuple[int, ...], alpha: int) -> Raster:
    here = (_x() == x) & (_y() == y)
    return r.project({n: F.when(here, quotient(F.col(n) * (255 - alpha) + F.lit(colour[k] * alpha), 255).cast("int")).otherwise(F.col(n)) for k, n in enumerate(r.names)})


def flood_fill(r: Raster, x: int, y: int, colour: tuple[int, ...], border: tuple[int, ...] | None = None) -> Raster:
    """The region around a place takes a colour: what has the place's own colour, or all up to a border's."""
    if not (0 <= x < r.width and 0 <= y < r.height):
        raise ValueError("the place lies outside the image")
    alike = lambda values: reduce(lambda a, b: a & b, (F.col(n) == v for n, v in zip(r.names, values, strict=False)))
    if border is not None:
        found = regions.region(r, ~alike(border), x, y)
    else:
        seed = r.px.where((_x() == x) & (_y() == y)).select("image_id", *(F.col(n).alias(f"_{n}") for n in r.names))
        found = regions.region(r.with_px(r.px.join(seed, "image_id")), alike([F.col(f"_{n}") for n in r.names]), x, y)
    px = r.px.join(found.withColumn("_in", F.lit(True)), KEYS, "left")
    return r.with_px(px).project({n: F.when(F.col("_in"), F.lit(colour[k])).otherwise(F.col(n)) for k, n in enumerate(r.names)})
