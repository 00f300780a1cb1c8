"""Lines, curves, turns with alpha, canned transforms and views against plain loops."""

from math import atan2, cos, floor, hypot, pi, sin

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.model import KEYS, Raster, blank
from rasterloom.operators import draw, fills, geometry, joins
from rasterloom.plans import expression
from rasterloom.sources import codecs, images


def array(r):
    out = np.zeros((r.height, r.width, r.channels), float)
    for row in r.px.select(*KEYS, *r.names).collect():
        out[row.y, row.x] = row[3:]
    return out


def sample(spark, w=13, h=9, channels=4):
    r = blank(spark, w, h, channels)
    return r.project({n: (F.col("x") * (17 + 5 * k) + F.col("y") * (31 - 7 * k) + k * 40) % 256 for k, n in enumerate(r.names)})


def test_lines(spark):
    lit = lambda r: {(x, y) for y, x in zip(*np.nonzero(array(r)[:, :, 0]), strict=True)}
    got = lit(draw.line(blank(spark, 12, 12, 1), 0, 10, 8, 6, (1,)))
    assert {(1, 9), (3, 8), (5, 7), (7, 6), (0, 10), (8, 6)} <= got and len(got) == 9
    assert lit(draw.line(blank(spark, 12, 12, 1), 8, 6, 0, 10, (1,), endpoint=False)) == got - {(8, 6)}
    assert lit(draw.line(blank(spark, 5, 5, 1), 2, 2, 2, 2, (1,))) == {(2, 2)} and not lit(draw.line(blank(spark, 5, 5, 1), 2, 2, 2, 2, (1,), endpoint=False))
    assert lit(draw.line(blank(spark, 5, 5, 1), 1, 4, 4, 1, (1,))) == {(1, 4), (2, 3), (3, 2), (4, 1)}


def plain_soft_line(image, x1, y1, x2, y2, value):
    """Pixel by pixel, with a running error."""
    steep = abs(y2 - y1) >= abs(x2 - x1)
    a1, b1, a2, b2 = (y1, x1, y2, x2) if steep else (x1, y1, x2, y2)
    if a1 > a2:
        a1, b1, a2, b2 = a2, b2, a1, b1
    da, db, way, b, error = a2 - a1, abs(b2 - b1), 1 if b2 >= b1 else -1, b1, 2 * abs(b2 - b1) - 2 * (a2 - a1)
    at = lambda a, b: (a, b) if steep else (b, a)
    for a in range(a1, a2 - 1):
        t = max(0.0, -error / (2 * da)) if db else 1.0
        t = t if steep else float(np.float32(t))
        for place, (old, new) in ((at(a + 1, b), (1 - t, t)), (at(a + 1, b + way), (t, 1 - t))):
            if 0 <= place[0] < image.shape[0] and 0 <= place[1] < image.shape[1]:
                image[place] = int(old * image[place] + new * value)
        if error >= 0:
            b, error = b + way, error - 2 * da
        error += 2 * db
    image[y1, x1] = image[y2, x2] = value


@pytest.mark.parametrize("ends", [(1, 1, 14, 6), (14, 2, 1, 9), (3, 1, 7, 13), (8, 13, 2, 0), (2, 5, 12, 5), (5, 2, 5, 12), (1, 1, 9, 9)])
def test_soft_lines(spark, ends):
    r = sample(spark, 16, 15, 1)
    want = array(r)[:, :, 0]
    plain_soft_line(want, *ends, 200)
    assert (array(draw.line_aa(r, *ends, (200,)))[:, :, 0] == want).all()


def test_bezier(spark):
    points, r = [(1, 1), (7, 18), (18, 2)], sample(spark, 20, 20, 1)
    want, places = array(r)[:, :, 0], draw.curve_points(points)
    assert len(places) in (200, 201) and places[0] == (1, 1)
    for a, b in zip(places, places[1:], strict=False):
        plain_soft_line(want, *a, *b, 90)
    assert (array(draw.bezier(r, points, (90,)))[:, :, 0] == want).all()


def mixed(before, after, share, alpha):
    if share == 0:
        return before
    if not alpha:
        return [int((1 - share) * a + share * b + 0.5) for a, b in zip(before, after, strict=True)]
    cover = int((1 - share) * before[-1] + share * after[-1])
    if not cover:
        return [0] * (len(before) - 1) + [0]
    p, q = before[-1] / 255, after[-1] / 255
    return [min(255, int(((1 - share) * a * p + share * b * q) / (p * (1 - share) + q * share) + 0.5)) for a, b in zip(before[:-1], after[:-1], strict=True)] + [cover]


@pytest.mark.parametrize("channels", [1, 4])
def test_matrix(spark, channels):
    r, back = sample(spark, 13, 9, channels), (9, 80, 70, 60)[-channels:]
    source, m = array(r), geometry.Matrix2d((0.8, 0.3, -0.7, -0.25, 0.9, 1.4, 0.01, -0.02, 1.1))
    got = array(geometry.matrix_transform(r, m, 11, 10, back))
    for y in range(10):
        for x in range(11):
            z = x * m[6] + y * m[7] + m[8]
            sx, sy = (x * m[0] + y * m[1] + m[2]) / z, (x * m[3] + y * m[4] + m[5]) / z
            want = list(back)
            if -1 <= sx < 13 and -1 <= sy < 9:
                pick = lambda i, j: list(source[j, i]) if 0 <= i < 13 and 0 <= j < 9 else list(back)
                bx, by = floor(sx), floor(sy)
                rows = [mixed(pick(bx, by + j), pick(bx + 1, by + j), sx - bx, channels == 4) for j in (0, 1)]
                want = mixed(*rows, sy - by, channels == 4)
            assert list(got[y, x]) == want, (x, y)


def test_canned(spark):
    r = sample(spark, 20, 16, 3)
    source, cx, cy = array(r), 10, 8

    def pixel(x, y):
        x, y = int(x), int(y)  # toward zero
        return source[y, x] if 0 <= x < 20 and 0 <= y < 16 else np.zeros(3)

    def ripple(x, y):
        d, a = hypot(x - cx, y - cy), atan2(y - cy, x - cx)
        s = sin(d / 5)
        return np.clip(np.trunc(pixel(cx + cos(a) * (s * 10 + d), cy + sin(a) * (s * 10 + d)) * ((s + 20) / 21)), 0, 255)

    def diagonal(x, y):
        s = sin((x + y) / 5)
        return np.clip(np.trunc(pixel(x + s * 3, y + s * 3) * ((s + 20) / 21)), 0, 255)

    def twisted(x, y):
        d, a = hypot(x - cx, y - cy), atan2(y - cy, x - cx)
        return pixel(cx + cos(a + d / 2.5) * d, cy + sin(a + d / 2.5) * d)

    for name, f in (("circleripple", ripple), ("diagripple", diagonal), ("twist", twisted)):
        got = array(expression.canned(name, r))
        same = sum((got[y, x] == f(x, y)).all() for y in range(16) for x in range(20))
        assert same >= 314, name  # sines may round apart at a pixel's edge
    arms = array(expression.canned("spiral", r))
    for x, y in ((15, 8), (3, 4), (10, 1), (12, 13)):
        d, a = hypot(x - cx, y - cy), atan2(y - cy, x - cx)
        assert abs(arms[y, x].max() - 255 * (sin((d / 10 + a) % (2 * pi)) + 1) / 2) <= 1.01


def test_patterns_and_views(spark):
    assert fills.HATCHES["vline1"] == (1,) * 8 and fills.HATCHES["slash2"] == (0x11, 0x22, 0x44, 0x88) * 2 and fills.HATCHES["grid2"] == (0xFF, 0x88, 0x88, 0x88) * 2 and fills.HATCHES["dots16"] == (0xAA, 0) * 4
    assert len(fills.HATCHES) == 32
    r, mask = sample(spark, 13, 9, 1), sample(spark, 6, 5, 1).map_all(lambda c: c % 2)
    view = joins.View(r, 3, 2, 6, 5, mask).view(1, 1, 9, 9)
    assert (view.width, view.height, view.left, view.top) == (5, 4, 4, 3)
    got, old, open_ = array(view.write(blank(spark, 9, 9, 1, colour=(7,)))), array(r), array(mask)
    for y in range(9):
        for x in range(13):
            inside = 4 <= x < 9 and 3 <= y < 7 and open_[y - 2, x - 3, 0]
            assert got[y, x, 0] == (7 if inside else old[y, x, 0])
    with pytest.raises(ValueError):
        joins.get_samples(r, 0, [1])
    heads = spark.createDataFrame([(1, 1, 1), (5, 5, 3), (6, 1, 1), (1, 1, 5), (0, 1, 1)], "w int, h int, c int")
    assert [x[0] for x in heads.select(images.within(codecs.Limits(5, 5, 60), F.col("w"), F.col("h"), F.col("c"))).collect()] == [True, False, False, False, False]
    assert isinstance(view.read(), Raster)


def test_gradient_samples_find_their_shape_once(spark):
    """A sample's distance stands in the plan once, not once for each comparison and channel that uses it."""
    got = fills.fountain(blank(spark, 4, 4), 1, 1, 3, 3, "radial", "triangle", samples="random", points=5, seed=3)
    assert got.px._jdf.queryExecution().optimizedPlan().toString().upper().count("SQRT") == 1
