"""Anti-aliased polygons against a plain sweep written from the definition, and by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.model import KEYS, blank
from rasterloom.operators import draw, sweep


def cut(a, b):
    """Whole division toward zero."""
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


class Edge:
    def __init__(self, p, q):
        (self.x1, self.y1), (self.x2, self.y2) = p, q
        self.top, self.low, self.way = min(p[1], q[1]), max(p[1], q[1]), 1 if p[1] < q[1] else -1
        self.rises = (q[0] - p[0]) * (q[1] - p[1]) < 0

    def at_y(self, y):
        return cut((y - self.y1) * self.x2 + (self.y2 - y) * self.x1, self.y2 - self.y1)

    def at_x(self, x):
        return cut((x - self.x1) * self.y2 + (self.x2 - x) * self.y1, self.x2 - self.x1)

    def right_of(self, px, lo, hi):
        a, b = 16 * px, 16 * px + 16
        upright = self.x1 == self.x2
        left = not upright and lo <= self.at_x(a) <= hi
        right = not upright and lo <= self.at_x(b) <= hi
        if left and right:
            return int(16 * ((2.0 * hi - self.at_x(a) - self.at_x(b)) if self.rises else (self.at_x(a) + self.at_x(b) - 2.0 * lo)) / 2)
        if left:
            wide, high = (self.at_y(lo) - a, self.at_x(a) - lo) if self.rises else (self.at_y(hi) - a, hi - self.at_x(a))
            return int(16 * (hi - lo) - wide * high / 2.0)
        if right:
            wide, high = (b - self.at_y(hi), hi - self.at_x(b)) if self.rises else (b - self.at_y(lo), self.at_x(b) - lo)
            return int(wide * high / 2.0)
        return int((hi - lo) * (2 * b - self.at_y(lo) - self.at_y(hi)) / 2.0)


def swept(contours, w, h, rule):
    whole = [[(int(x * 16), int(y * 16)) for x, y in ring] for ring in contours]
    lines = [Edge(p, q) for ring in whole for p, q in zip(ring, ring[1:] + ring[:1], strict=True) if p[1] != q[1]]
    heights = sorted({y for ring in whole for _, y in ring})
    total = np.zeros((h, w), int)
    for y0, y1 in zip(heights, heights[1:], strict=False):
        met = sorted((e for e in lines if e.low > y0 and e.top < y1), key=lambda e: e.at_y(cut(y0 + y1, 2)))
        pairs = []
        if rule == "evenodd":
            pairs = [(met[k], met[k + 1]) for k in range(0, len(met) - 1, 2)]
        else:
            open_, first = 0, None
            for e in met:
                first = e if open_ == 0 else first
                open_ += e.way
                if open_ == 0:
                    pairs.append((first, e))
        least, most = max([0, *(e.top for e in met)]), min([16 * h, *(e.low for e in met)])
        for y in range(max(cut(y0, 16), 0), min(cut(y1 + 15, 16), h)):
            lo, hi = max(least, 16 * y), min(most, 16 * y + 16)
            for left, right in pairs:
                ls, rs = sorted((left.at_y(lo), left.at_y(hi))), sorted((right.at_y(lo), right.at_y(hi)))
                for x in range(max(cut(ls[0], 16), 0), min(cut(rs[1] - 1, 16), w - 1) + 1):
                    total[y, x] += left.right_of(x, lo, hi) if cut(ls[1] - 1, 16) >= x else 16 * (hi - lo)
                    total[y, x] -= right.right_of(x, lo, hi) if cut(rs[0], 16) <= x else 0
    return np.clip(total, 0, 255)


def shares(spark, points, w, h, rule):
    out = np.zeros((h, w), int)
    for run in sweep.coverage(points, w, h, rule).collect():
        assert 0 <= run.x1 < run.x2 <= w and not out[run.y, run.x1 : run.x2].any()
        out[run.y, run.x1 : run.x2] = run.share
    return out


SHAPES = {
    "quad": [[(5, 5), (55, 10), (40, 45), (10, 40)]],
    "thin": [[(1.3, 2.2), (60.9, 3.1), (60.1, 3.4)], [(3, 20), (3.5, 48), (3.9, 20)]],
    "hole": [[(5, 5), (55, 5), (55, 45), (5, 45)], [(20.5, 15.25), (20.5, 30.5), (35.75, 30.5), (35.75, 15.25)]],
    "level": [[(10, 10), (20, 10), (20, 20), (30, 20), (30, 30), (10, 30)]],
    "beyond": [[(-20, -13.7), (90.2, 12), (30, 80.4), (-5, 33.3)]],
    "away": [[(-20, -20), (-10, -20), (-15, -3)]],
    "star": [[(32, 2), (45, 46), (8, 18), (56, 18), (19, 46)]],
    "ended": [[(4, 4), (20, 40), (40, 4)], [(22, 10.3), (30, 12.6), (60, 10.4), (50, 49)]],
}


@pytest.mark.parametrize("rule", ["evenodd", "nonzero"])
def test_shapes(spark, rule):
    for name, shape in SHAPES.items():
        assert (shares(spark, sweep.made(spark, shape), 64, 50, rule) == swept(shape, 64, 50, rule)).all(), name


def test_random_shapes_by_image(spark):
    """Each image has a shape of its own, with rings that cross themselves and each other."""
    rnd = random.Random(11)
    shapes = [[[(round(rnd.uniform(-9, 40), 2), round(rnd.uniform(-9, 40), 2)) for _ in range(rnd.randint(3, 8))] for _ in range(rnd.randint(1, 3))] for _ in range(40)]
    rows = [(k, ring, at, float(x), float(y)) for k, shape in enumerate(shapes) for ring, points in enumerate(shape) for at, (x, y) in enumerate(points)]
    points = spark.createDataFrame(rows, "image_id long, ring int, at int, x double, y double")
    for rule in ("evenodd", "nonzero"):
        out = np.zeros((len(shapes), 30, 32), int)
        for run in sweep.coverage(points, 32, 30, rule).collect():
            out[run.image_id, run.y, run.x1 : run.x2] = run.share
        for k, shape in enumerate(shapes):
            assert (out[k] == swept(shape, 32, 30, rule)).all(), (rule, k)


def plain_pie(cx, cy, radius, d1, d2):
    """From the middle to the rim and along it, by steps of one pixel or a degree at least and an eighth turn at most."""
    d1, d2 = math.fmod(d1, 360), 360 if d1 % 360 == 0 and d2 >= 360 else math.fmod(d2, 360)
    at, end = math.radians(1) * d1, math.radians(1) * (d2 if d2 >= d1 else d2 + 360)
    steps = int(2 * math.pi * radius)
    out = [(cx, cy), (cx + radius * math.cos(at), cy + radius * math.sin(at))]
    while at < end:
        out.append((cx + radius * math.cos(at), cy + radius * math.sin(at)))
        at += 2 * math.pi / (360 if steps > 360 else 8 if steps < 8 else steps)
    return [*out, (cx + radius * math.cos(end), cy + radius * math.sin(end))]


@pytest.mark.parametrize("pie", [(30.3, 25.1, 17.5, 20, 250), (20, 20, 30, 300, 45), (32, 25, 0.9, 10, 200), (32, 25, 80, 0, 90), (10, 10, 9, 0, 400), (31, 22, 12, 725, 30)])
def test_soft_pies(spark, pie):
    want = swept([plain_pie(*pie)], 64, 50, "evenodd") / 255.0
    assert np.allclose(draw.soft_sector(*pie), plain_pie(*pie), atol=1e-9)
    got = {(p.y, p.x): p.c0 for p in draw.arc_aa(blank(spark, 64, 50, 1, colour=(40,)), *pie, (200,)).px.collect()}
    assert len(got) == 3200 and want.any()
    assert all(v == int(want[k] * 200 + (1 - want[k]) * 40) for k, v in got.items())


def test_soft_pie_of_all_is_a_disc(spark):
    r = blank(spark, 20, 20, 1)
    rows = lambda r: sorted(map(tuple, r.px.select(*KEYS, "c0").collect()))
    assert rows(draw.arc_aa(r, 9.5, 9.5, 6, 0, 361, (9,))) == rows(draw.circle_aa(r, 9.5, 9.5, 6, (9,)))


def test_painted_by_hand(spark):
    """A box from 1.5 to 3 by 1 to 2.25: half a pixel, a whole one, and a quarter of their heights below."""
    r = sweep.polygon(blank(spark, 5, 4, 2, colour=(100, 0)), [[(1.5, 1), (3, 1), (3, 2.25), (1.5, 2.25)]], (200, 255))
    got = {(p.y, p.x): (p.c0, p.c1) for p in r.px.select(*KEYS, "c0", "c1").collect()}
    want = {(1, 1): 128, (1, 2): 255, (2, 1): 32, (2, 2): 64}
    mixed = {k: (int(s / 255.0 * 200 + (1 - s / 255.0) * 100), int(s / 255.0 * 255 + (1 - s / 255.0) * 0)) for k, s in want.items()}
    assert {k: v for k, v in got.items() if v != (100, 0)} == mixed and len(got) == 20


def test_each_image_its_shape(spark):
    points = sweep.made(spark, [[(0, 0), (2, 0), (2, 2), (0, 2)]]).withColumn("image_id", F.lit(1).cast("long"))
    r = sweep.polygon(blank(spark, 3, 3, 1, images=3), points, (9,))
    assert sorted((p.image_id, p.y, p.x) for p in r.px.where("c0 = 9").collect()) == [(1, y, x) for y in (0, 1) for x in (0, 1)]
    assert r.px.count() == 27


def test_refusals(spark):
    with pytest.raises(ValueError, match="three points"):
        sweep.made(spark, [[(0, 0), (1, 1)]])
    with pytest.raises(ValueError, match="a contour"):
        sweep.made(spark, [])
    with pytest.raises(ValueError, match="no rule"):
        sweep.coverage(sweep.made(spark, SHAPES["quad"]), 9, 9, "odd")
