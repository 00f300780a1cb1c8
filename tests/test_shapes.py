"""Circles, arcs and their outlines by plain loops from their definitions; palettes' box candidates by full search."""

import random
from math import ceil, cos, fmod, floor, pi, sin, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.model import KEYS, blank
from rasterloom.operators import draw, quantize, spans


def array(r):
    out = np.zeros((r.height, r.width, r.channels))
    for x in r.px.select(*KEYS, *r.names).collect():
        out[x.y, x.x] = x[3:]
    return out


def pie(cx, cy, r, d1, d2):
    """The places of a filled pie: rows between the extremes of a rim of single places and two drawn radii."""
    if d1 > d2:
        return pie(cx, cy, r, d1, 360) | pie(cx, cy, r, 0, d2)
    rows = {}

    def touch(x, y):
        rows.setdefault(y, []).append(x)

    def radius_to(x, y):
        run, rise = x - cx, y - cy
        if run and abs(rise / run) <= 1:
            slope, at = rise / run, float(cy if cx < x else y)
            for px in range(min(cx, x), max(cx, x) + 1):
                touch(px, int(at + 0.5))
                at += slope
        else:
            slope = 1 / (rise / run) if run and rise else 0.0
            at = float(cx if cy <= y else x)
            for py in range(min(cy, y), max(cy, y) + 1):
                touch(int(at + 0.5), py)
                at += slope

    f = d1
    while f <= d2:
        touch(int(cx + 0.5 + r * cos(f * pi / 180.0)), int(cy + 0.5 + r * sin(f * pi / 180.0)))
        f += 0.01
    for d in (d1, d2):
        radius_to(int(cx + 0.5 + r * cos(d * pi / 180.0)), int(cy + 0.5 + r * sin(d * pi / 180.0)))
    return {(x, y) for y, xs in rows.items() for x in range(min(xs), max(xs) + 1)}


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 8, 9, 12, 15, 16, 23, 40, 77, 120])
def test_pies(radius):
    for d1, d2 in ((0, 361), (300, 60), (10, 10), (45, 135), (90, 270), (200, 199), (0, 90), (12.5, 33.25)):
        got = draw.sector_rows(150, 140, radius, d1, d2)
        assert {(x, y) for y, a, b in got for x in range(a, b)} == pie(150, 140, radius, d1, d2), (radius, d1, d2)


def ring(r):
    """The midpoint circle: a step down wherever the next place's middle lies outside."""
    got, x, y = {(r, 0), (-r, 0), (0, r), (0, -r)}, 0, r
    error = 1 - r
    while x < y:
        if error >= 0:
            y -= 1
            error += -2 * y
        x += 1
        error += 2 * x + 1
        got |= {(a * s, b * t) for a, b in ((x, y), (y, x)) for s in (1, -1) for t in (1, -1)}
    return got


@pytest.mark.parametrize("radius", [*range(0, 121, 1)])
def test_rings(radius):
    got = draw.outline(radius)
    assert {(x, y) for x, y, _ in got} == ring(radius) and all(a == 255 for *_, a in got)


def part(r, d1, d2):
    """Ranges of the way round, a quarter being 2 (r + 1) long and inside a half quarter as long as the sine."""
    def way(d):
        d = fmod(d + 360 * floor((-d + 359) / 360) if d < 0 else d, 360)
        q = int((d + 45) / 90)
        rest = d - 90 * q
        if q == 4 and rest > 0:
            q = 0
        return int((r + 1) * (2 * q + sin(rest * pi / 180)))

    a, b = way(d1), way(d2)
    return [(0, b), (a, 8 * (r + 1))] if b < a else [(a, b)]


@pytest.mark.parametrize("radius", [2, 3, 7, 12, 19, 31, 64, 101])
def test_parts_of_rings(radius):
    n = radius + 1
    for d1, d2 in ((0, 90), (45, 100), (200, 80), (-30, 30), (10, 350), (315, 45), (180, 180)):
        for soft in (False, True):
            got = draw.outline(radius, d1, d2, soft)
            for x, y, _ in got:
                # from the quarter line a place is near, or, about the half quarter, from the one on its other side
                lines = {True: 0 if x > 0 else 4, False: 2 if y > 0 else 6}
                near = [abs(x) >= abs(y)] + [abs(x) < abs(y)] * (abs(abs(x) - abs(y)) <= 1)
                ways = {(lines[k] * n + {0: y, 2: -x, 4: -y, 6: x}[lines[k]]) % (8 * n) for k in near} | ({8 * n} if (x, y) == (radius, 0) else set())
                assert any(a <= w <= b for a, b in part(radius, d1, d2) for w in ways), (radius, d1, d2, x, y)
            whole = {(x, y) for x, y, _ in draw.outline(radius, 0, 361, soft)}
            assert {(x, y) for x, y, _ in got} <= whole and (d2 - d1 != 340 or len(got) > len(whole) * 0.8)
    with pytest.raises(ValueError, match="zero"):
        draw.outline(0, 10, 20)


@pytest.mark.parametrize("radius", [1, 2, 3, 6, 12, 23, 30])
def test_soft_rings(spark, radius):
    """Written one after another into an array, as the outer and the inner place of each step share the colour."""
    size, middle, colour = 70, 34, (200, 100, 50)
    want = np.full((size, size, 3), 30)

    def put(x, y, alpha):
        if alpha and 0 <= middle + x < size and 0 <= middle + y < size:
            old = want[middle + y, middle + x]
            want[middle + y, middle + x] = [(int(o) * (255 - alpha) + c * alpha) // 255 for o, c in zip(old, colour, strict=True)]

    for x, y in ((radius, 0), (-radius, 0), (0, radius), (0, -radius)):
        put(x, y, 255)
    i, j, before = radius, 0, 0.0
    while i > j + 1:
        j += 1
        d = ceil(sqrt(radius * radius - j * j)) - sqrt(radius * radius - j * j)
        share = int(d * 255 + 0.5)
        i -= d < before
        for a, alpha in ((i, 255 - share), (i - 1, share if i > j else 0)):
            for x, y in ((a, j), (j, a)) if a != j else ((a, j),):
                for s in (1, -1):
                    for t in (1, -1):
                        put(s * x, t * y, alpha)
        before = d
    got = array(draw.circle(blank(spark, size, size, colour=(30, 30, 30)), middle, middle, radius, colour, filled=False, soft=True))
    assert (got == want).all()


def test_dabs_over_alpha(spark):
    got = array(draw.dab(blank(spark, 3, 1, 4, colour=(10, 20, 30, 100)), [(0, 0, 128), (0, 0, 64), (1, 0, 255), (2, 0, 0), (7, 0, 9)], (200, 100, 50)))
    old = [10, 20, 30, 100]
    for a in (128, 64):
        top = a + (255 - a) * old[3] // 255
        old = [(a * v + (255 - a) * o * old[3] // 255) // top for v, o in zip((200, 100, 50), old[:3], strict=True)] + [top]
    assert got[0].tolist() == [old, [200, 100, 50, 255], [10, 20, 30, 100]]


def test_spans(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 3), rnd.randint(-3, 12), rnd.randint(-3, 14)) for _ in range(40)]
    got = spans.paint(blank(spark, 10, 5, 1, images=2), spans.made(spark, rows), (1,))
    want = [[int(any(y == r and a <= x < b for r, a, b in rows)) for x in range(10)] for y in range(5)]
    assert array(got).astype(int)[..., 0].tolist() == want
    back = sorted((r.y, r.x1, r.x2) for r in spans.runs(got).where("c0 = 1 and image_id = 1").collect())
    assert back == sorted((r.y, r.x1, r.x2) for r in spans.union(spans.clip(spans.made(spark, rows), 10, 5)).collect())
    assert spans.runs(blank(spark, 9, 2)).count() == 2


def test_median_cut_by_hand(spark):
    """Greys of two steps: 3 of 0, 1 of 8, 4 of 255; the widest box is cut where half its pixels are reached."""
    r = blank(spark, 8, 1, 1)
    r = r.project({"c0": F.when(F.col("x") < 3, 0).when(F.col("x") < 4, 8).otherwise(255)})
    assert quantize.median_cut(r, 9) == [(0, 0, 0), (8, 8, 8), (255, 255, 255)]
    assert quantize.median_cut(r, 2) == [(2, 2, 2), (255, 255, 255)]
    assert quantize.median_cut(r, 3) == [(0, 0, 0), (255, 255, 255), (8, 8, 8)]


def test_box_candidates(spark):
    rnd = random.Random(9)
    palette = [tuple(rnd.randint(0, 255) for _ in range(3)) for _ in range(200)] + [(7, 7, 7), (7, 7, 7)]
    held = dict(quantize.box_candidates(palette))
    assert all(held.values()) and sum(map(len, held.values())) < 512 * len(palette) / 3
    for _ in range(3000):
        c = tuple(rnd.randint(0, 255) for _ in range(3))
        far = lambda p: sum((a - b) ** 2 for a, b in zip(p, c, strict=True))  # noqa: E731, B023
        got = min(held[c[0] // 32 * 64 + c[1] // 32 * 8 + c[2] // 32], key=lambda e: (far(e[1:]), e[0]))
        assert got[0] == min(range(len(palette)), key=lambda k: (far(palette[k]), k))
    r = blank(spark, 16, 16).project({"c0": F.col("x") * 16, "c1": F.col("y") * 15, "c2": (F.col("x") * 7 + F.col("y")) % 256})
    got, image = array(quantize.closest(r, palette)), array(r)
    for y in range(16):
        for x in range(16):
            assert got[y, x, 0] == min(range(len(palette)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(palette[k], image[y, x], strict=True)), k))


def test_soft_disc(spark):
    """Sixteen lines a row, cut to sixteenths of a pixel; nothing beside the disc changes."""
    got = array(draw.circle_aa(blank(spark, 40, 40, 1), 20.5, 18.25, 9.0, (255,)))[..., 0]
    for y in range(40):
        lines = [sqrt(81 - d * d) for d in (y + (s + 1) / 16 - 18.25 for s in range(16)) if d * d < 81]
        for x in range(40):
            n = sum(max(0, min(int(0.5 + (20.5 + h) * 16), 16 * x + 16) - max(int(0.5 + (20.5 - h) * 16), 16 * x)) for h in lines)
            assert got[y, x] == n * 255 // 256 and (n == 0 or abs(x - 20.5) < 11)


@pytest.mark.parametrize("kind", ["colour", "border"])
def test_floods(spark, kind):
    """Mazes with dead ends and spirals, against a plain search; images whose place is closed, or of a colour of its own."""
    rnd = random.Random(4)
    size = 24
    rows = [(k, y, x, int(rnd.random() < (0.25, 0.4, 0.5)[k])) for k in range(3) for y in range(size) for x in range(size)]
    spiral = [[0] * size for _ in range(size)]
    x, y, dx, dy = 0, 0, 1, 0
    for n in (size - 1, *[k for k in range(size - 1, 0, -2) for _ in (0, 1)]):
        for _ in range(n):
            spiral[y][x] = 1
            x, y = x + dx, y + dy
        dx, dy = -dy, dx
    rows += [(3, y, x, spiral[y][x]) for y in range(size) for x in range(size)]
    r = blank(spark, size, size, 1, images=4).with_px(spark.createDataFrame(rows, "image_id long, y int, x int, c0 int"))
    at = (5, 7)
    out = {(p.image_id, p.y, p.x): p.c0 for p in draw.flood_fill(r, *at, (9,), (1,) if kind == "border" else None).px.collect()}
    value = {p[:3]: p[3] for p in rows}
    for k in range(4):
        seed = value[k, at[1], at[0]]
        open_ = {(y, x) for (i, y, x), v in value.items() if i == k and (v != 1 if kind == "border" else v == seed)}
        reached, todo = set(), [(at[1], at[0])]
        while todo:
            y, x = todo.pop()
            if (y, x) in open_ and (y, x) not in reached:
                reached.add((y, x))
                todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        assert all(out[k, y, x] == (9 if (y, x) in reached else value[k, y, x]) for y in range(size) for x in range(size)), k
    with pytest.raises(ValueError, match="outside"):
        draw.flood_fill(r, 24, 0, (9,))


def test_counts_that_stop(spark):
    from rasterloom.operators import aggregates

    r = blank(spark, 20, 20, 1, images=3).project({"c0": F.when(F.col("image_id") == 0, 5).when(F.col("image_id") == 1, F.col("x") % 4).otherwise(F.col("x") * 11)})
    assert sorted(map(tuple, aggregates.colour_count(r, 4).collect())) == [(0, 1), (1, 4), (2, None)]
    assert sorted(map(tuple, aggregates.colour_usage(r, 4).collect())) == [(0, 5, 400), *((1, k, 100) for k in range(4))]
    held = [b.num_rows for b in aggregates._first_colours(["c0"], 4)(r.px.select("image_id", "c0").toArrow().to_batches())]
    assert sum(held) == 1 + 4 + 5


def test_image_fonts(spark):
    from rasterloom.operators import glyphs

    font = glyphs.ImageFont.parse(["# a font", "Image_spec = foo.png", "Font_size  = 12", "Global_ascent = 3", "Global_descent = -2", "FM_65 = 0 2 0 2 0 1 ", "FM_66 = 2 4 0 3 1 3", "FM_x = 1"])
    assert font.glyphs[66] == glyphs.Glyph(2, 4, 0, 3, 1, 3) and (font.size, font.image) == (12, "foo.png")
    assert font.bounds("AB") == glyphs.Bounds(0, -2, 4, 3, 0, 3, 4, 0) and font.bounds("BA?") == glyphs.Bounds(0, -2, 5, 3, 0, 3, 4, -1) and font.bounds("").advance_width == 0
    with pytest.raises(ValueError, match="Global_ascent"):
        glyphs.ImageFont.parse(["Image_spec = a", "Font_size = 1", "Global_descent = 0"])
    sheet = blank(spark, 4, 3, 2).project({"c0": F.col("x") * 20 + F.col("y"), "c1": F.when(F.col("x") < 2, 128).otherwise(255)})
    got = array(glyphs.draw(blank(spark, 7, 4, 1, colour=(100,)), "AAB", 1, 3, font, sheet))[..., 0].astype(int).tolist()
    want = [[100] * 7 for _ in range(4)]
    x = 1
    for g, s in ((font.glyphs[65], 128), (font.glyphs[65], 128), (font.glyphs[66], 255)):  # the two first overlap
        for dy in range(g.bottom - g.top):
            for dx in range(g.right - g.left):
                if dy < 4 and x + g.shift + dx < 7:
                    want[dy][x + g.shift + dx] = (s * ((g.left + dx) * 20 + dy) + (255 - s) * want[dy][x + g.shift + dx]) // 255
        x += g.forward
    assert got == want
