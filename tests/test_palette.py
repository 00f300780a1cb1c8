"""Paletted images: what the definitions say, by hand and by plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import tags
from rasterloom.model import Raster, blank
from rasterloom.operators import draw, joins, palette, point, quantize

HEADS = "image_id long, palette array<struct<r:int,g:int,b:int>>, capacity int"


def heads(p, *columns):
    return p.heads.orderBy("image_id").select(*columns).collect()


def test_a_new_image_grows_to_its_capacity(spark):
    p = palette.create(spark, 3, 2, capacity=4, images=2)
    assert {tuple(x)[3:] for x in p.px.collect()} == {(0, None)} and p.px.count() == 12
    assert {tuple(x)[3:] for x in palette.expand(p).px.collect()} == {(0, 0, 0)}
    p = palette.add_colours(p, [(9, 8, 7), (1, 1, 1), (9, 8, 7)])
    assert heads(p, "added", palette.colour_count(), palette.max_colours()) == [(0, 3, 4)] * 2
    full = palette.add_colours(p, [(2, 2, 2), (3, 3, 3)])
    assert heads(full, "added", palette.colour_count()) == [(-1, 3)] * 2
    assert heads(p, palette.find_colour((9, 8, 7)), palette.find_colour((9, 8, 6))) == [(0, None)] * 2
    p = palette.set_colours(p, 1, [(5, 5, 5), (6, 6, 6)])
    assert heads(p, palette.get_colours(1, 2)) == [([(5, 5, 5), (6, 6, 6)],)] * 2
    assert heads(p, palette.get_colours(2, 2)) == [(None,)] * 2
    for start, more in ((2, [(0, 0, 0)] * 2), (-1, [(0, 0, 0)]), (0, [])):
        assert heads(palette.set_colours(p, start, more), "palette") == heads(p, "palette")
    for wrong in (0, 257):
        with pytest.raises(ValueError):
            palette.create(spark, 1, 1, capacity=wrong)
    with pytest.raises(ValueError):
        palette.get_colours(0, 0)


def test_writes_keep_or_lose_the_palette(spark):
    p = palette.add_colours(palette.create(spark, 2, 1, images=3), [(0, 0, 0), (255, 0, 0)])
    rows = [(0, 0, 1, 1, 255, 0, 0), (1, 0, 1, 1, 7, 7, 7), (1, 0, 1, 2, 255, 0, 0), (2, 0, 5, 1, 7, 7, 7), (2, 3, 0, 1, 7, 7, 7)]
    got = palette.set_pixels(p, spark.createDataFrame(rows, "image_id long, y int, x int, seq int, r int, g int, b int"))
    assert heads(got, palette.colour_count()) == [(2,), (-1,), (2,)]
    assert [tuple(x) for x in got.px.orderBy("image_id", "x").select("image_id", "x", "i").collect()] == [(0, 0, 0), (0, 1, 1), (1, 0, None), (1, 1, None), (2, 0, 0), (2, 1, 0)]
    assert [tuple(x) for x in palette.expand(got).px.orderBy("image_id", "x").select("c0", "c1").collect()] == [(0, 0), (255, 0), (0, 0), (255, 0), (0, 0), (0, 0)]
    again = palette.set_indexes(got, spark.createDataFrame([(0, 0, 0, 1, 1), (0, 0, 0, 2, 9), (1, 0, 0, 1, 1), (2, 4, 4, 1, 1)], "image_id long, y int, x int, seq int, i int"))
    assert [x.i for x in again.px.orderBy("image_id", "x").collect()] == [9, 1, None, None, 0, 0]
    assert [x.i for x in palette.get_indexes(again, 0).orderBy("image_id", "x").collect()] == [9, 1, 0, 0]
    assert palette.expand(again).px.where("image_id = 0 and x = 0").first().c0 == 0  # beyond the palette


def test_exact_palettes(spark):
    r = draw.box_filled(blank(spark, 4, 4), 1, 1, 2, 2, (3, 2, 1))
    assert heads(palette.exact(r, 2), "palette") == [([(0, 0, 0), (3, 2, 1)],)]
    one = palette.exact(r, 1)
    assert heads(one, palette.colour_count(), palette.max_colours()) == [(-1, -1)]
    for p in (palette.exact(r, 2), one):
        assert palette.expand(p).px.exceptAll(r.px).count() == 0 and palette.expand(p).px.count() == 16
    assert palette.expand(palette.exact(r.with_px(r.px.where("false")))).px.count() == 0


def test_black_and_white(spark):
    white, black = (255, 255, 255), (0, 0, 0)
    for k, (colours, want) in enumerate([([white, black], True), ([black, white], False), ([white, white], None), ([white], None), ([black, white, black], None), (None, None)]):
        assert spark.createDataFrame([(k, colours, 256)], HEADS).select(palette.zero_is_white()).first()[0] is want


def test_masked_channels_and_tagged_backgrounds(spark):
    a, b = blank(spark, 1, 1, 4, colour=(1, 2, 3, 4)), blank(spark, 1, 1, 4, colour=(5, 6, 7, 8))
    assert tuple(joins.masked_channels(a, b, 0b1010).px.first())[3:] == (1, 6, 3, 8)
    assert tuple(joins.masked_channels(a, b, 0).px.first())[3:] == (1, 2, 3, 4)
    clear = blank(spark, 1, 1, 4, images=3)
    kept = spark.createDataFrame([(0, [("i_background", "color(10,20,30)")]), (1, [("i_background", "pink"), ("other", "color(1,2,3)")]), (2, None)], f"image_id long, tags array<struct<name:string,data:string>>")
    got = point.flatten_tagged(clear, kept).px.orderBy("image_id").collect()
    assert [tuple(x)[3:] for x in got] == [(10, 20, 30), (0, 0, 0), (0, 0, 0)]
    grey = point.flatten_tagged(blank(spark, 1, 1, 2), kept.where("image_id = 0"))
    assert grey.channels == 1 and grey.px.first().c0 == int(10 * 0.222 + 20 * 0.707 + 30 * 0.071 + 0.5)
    assert point.flatten_tagged(Raster(a.px.drop("c3"), 1, 1, 3), kept).channels == 3


@pytest.mark.parametrize("kind", ["floyd", "jarvis", "stucki"])
def test_diffused_alpha(spark, kind):
    """By fractions owed to each place, kept in a dictionary."""
    rnd, w, h = random.Random(5), 9, 7
    alpha = {(y, x): rnd.randrange(256) for y in range(h) for x in range(w)}
    r = Raster(spark.createDataFrame([(0, y, x, 0, a) for (y, x), a in alpha.items()], "image_id long, y int, x int, c0 int, c1 int").repartition(3), w, h, 2)
    matrix, origin = quantize.DIFFUSION[kind]
    share, owed, want = sum(map(sum, matrix)), {}, {}
    for y, x in sorted(alpha):
        debt = owed.get((y, x), 0)
        a = max(0, min(255, alpha[y, x] - (abs(debt) // share) * (1 if debt > 0 else -1)))
        want[y, x] = a < 128
        for j, row in enumerate(matrix):
            for i, v in enumerate(row):
                owed[y + j, x + i - origin] = owed.get((y + j, x + i - origin), 0) + ((0 if a < 128 else 255) - a) * v
    assert {(p.y, p.x): p._t for p in quantize.diffused_alpha(r, kind).collect()} == want
    got = quantize.to_paletted(r, [(0, 0, 0)], transparency="errdiff").px.where(F.col("c0") == 1).count()
    assert kind != "floyd" or got == sum(want.values())
