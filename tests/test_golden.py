"""Hand-computed cases and properties."""

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import colour, tags
from rasterloom.model import Raster, blank, to_bits
from rasterloom.operators import aggregates, draw, fills, geometry, joins, point, procedural, quantize, spans, stencil, text
from rasterloom.plans import assembler, expression, registry


def one(spark, *c, bits="8"):
    return blank(spark, 1, 1, len(c), bits, colour=c)


def only(r):
    got = r.px.collect()
    assert len({tuple(x[n] for n in r.names) for x in got}) == 1
    return tuple(got[0][n] for n in r.names)


def grid(r, n="c0"):
    out = [[None] * r.width for _ in range(r.height)]
    for p in r.px.where("image_id = 0").collect():
        out[p.y][p.x] = p[n]
    return out


def areas(spark):
    r = draw.box_filled(blank(spark, 50, 50), 25, 0, 49, 49, (0, 0, 255))
    return draw.box_filled(r, 0, 25, 49, 49, (255, 0, 0))


def test_colour_counts(spark):
    r = areas(spark)
    assert aggregates.colour_usage_counts(r).first().counts == [625, 625, 1250]
    assert aggregates.colour_count(r).first().colours == 3 and aggregates.colour_count(r, 2).first().colours is None
    grey = {x.c0: x.n for x in aggregates.colour_usage(point.convert(r, "grey")).collect()}
    assert grey == {0: 625, 0x12: 625, 0x38: 1250}


def test_autolevels(spark):
    r = draw.box_filled(blank(spark, 10, 10, colour=(0x40,) * 3), 5, 0, 9, 9, (0xC0,) * 3)
    for f in (aggregates.autolevels, aggregates.autolevels_skew):
        assert grid(f(r))[0] == [0] * 5 + [255] * 5


def test_point_operators(spark):
    assert only(point.hardinvert(one(spark, 0, 0, 0x10, 0xC0))) == (0xFF, 0xFF, 0xEF, 0xC0)
    assert only(point.hardinvert(one(spark, 0, 0, 0x10, 0xC0), True)) == (0xFF, 0xFF, 0xEF, 0x3F)
    assert only(point.hardinvert(one(spark, 0.0, 0.0, 0.125, 0.75, bits="double"))) == (1, 1, 0.875, 0.75)
    assert only(point.convert(one(spark, 0, 0, 0), [[0, 0, 0, 1]])) == (255,)
    assert only(point.contrast(one(spark, 100, 200, 3), -1)) == (100, 200, 3)
    assert only(to_bits(to_bits(one(spark, 7, 200, 255), "16"), "8")) == (7, 200, 255)
    assert only(to_bits(one(spark, 0, 51, 255), "double")) == (0, 0.2, 1)
    with pytest.raises(ValueError, match="at least one coefficient"):
        stencil.conv(one(spark, 1, 1, 1), [])
    with pytest.raises(ValueError, match="sum of coefficients is zero"):
        stencil.conv(one(spark, 1, 1, 1), [1, -1])


@pytest.mark.parametrize(("source", "opacity", "want"), [((0, 255, 0, 128), 1, (0, 128, 127)), ((255, 0, 0, 85), 1, (85, 0, 170)), ((255, 0, 0, 255), 0.5, (128, 0, 127)), ((0, 255, 0, 128), 0.5, (0, 64, 191)), ((255, 0, 0, 85), 0.5, (42, 0, 213))])
def test_compose(spark, source, opacity, want):
    assert only(joins.compose(one(spark, 0, 0, 255), one(spark, *source), opacity=opacity)) == want


def test_compose_double_and_errors(spark):
    got = only(joins.compose(one(spark, 0.0, 0.0, 1.0, bits="double"), one(spark, 0.0, 1.0, 0.0, 0.5, bits="double")))
    assert got == (0, 0.5, 0.5)
    with pytest.raises(ValueError, match="opacity"):
        joins.compose(one(spark, 0, 0, 0), one(spark, 1, 1, 1), opacity=0)
    with pytest.raises(ValueError, match="unknown combine mode"):
        joins.compose(one(spark, 0, 0, 0), one(spark, 1, 1, 1), mode="x")


def test_trim(spark):
    r = draw.box_filled(blank(spark, 200, 400, 4), 11, 23, 161, 257, (255, 255, 255, 255))
    assert tuple(geometry.trim_rect(r, alpha=0).first())[1:] == (11, 23, 38, 142)
    assert tuple(geometry.trim_rect(geometry.rotate90(r, 90), alpha=0).first())[1:] == (142, 11, 23, 38)
    r = draw.box_filled(blank(spark, 200, 300, 3, colour=(255, 0, 0)), 31, 42, 116, 251, (0, 0, 255))
    red = [((255, 0, 0), (255, 0, 0))]
    assert tuple(geometry.trim_rect(r, red).first())[1:] == (31, 42, 83, 48)
    assert tuple(geometry.trim_rect(draw.box_filled(r, 16, 8, 18, 10, (0, 255, 0)), red).first())[1:] == (16, 8, 83, 48)
    assert geometry.trim_rect(blank(spark, 5, 5), [((0, 0, 0), (0, 0, 0))]).first().left == 5


@pytest.mark.parametrize(
    ("pixel", "text_", "want"),
    [
        ((0x7F, 0, 0), "120 1.0\n0 0 getp1 value\nhsv", (0, 127, 0)), ((0x7F, 0, 0), "0 0 getp1 hue\n1.0 1.0 hsv", (255, 0, 0)), ((0x7F, 0, 0), "120 0 0 getp1 sat 1.0 hsv", (0, 255, 0)), ((0x40, 0x60, 0xA0), "0 0 getp1 !p @p red 2 * @p green 32 + @p blue 32 - rgb", (128, 128, 128)),
        ((0x80, 0x60, 0x40), "0 0 getp1 !p @p red 2 / @p green 32 uminus add @p blue rgb", (64, 64, 64)), ((0x40, 8, 0x7F), "0 0 getp1 !p @p red 0.5 pow @p green 2 pow @p blue 32 mod rgb", (8, 64, 31)), ((0x20, 0x21, 0x22), "0 0 getp1 4 *", (128, 132, 136)), ((0x40, 0x40, 0x40), "0 0 getp1 1 2 3 rgb +", (65, 66, 67)),
        ((0x41, 0x42, 0x43), "0 0 getp1 3 2 1 rgb -", (62, 64, 66)), ((0, 0, 0), "0 100 120 10 distance !d @d @d @d rgb", (150, 150, 150)), ((0, 0, 0), "50.75 int 2 * !i @i @i @i rgb", (100, 100, 100)), ((0, 1, 0), "0 0 getp1 !p @p red 0 128 if @p green 0 128 if 0 rgb", (128, 0, 0)),
    ],
)
def test_opcodes(spark, pixel, text_, want):
    assert only(expression.transform2([one(spark, *pixel)], postfix=text_)) == want


def test_expressions(spark):
    r = expression.transform2([], postfix="0 0 255 x y + w h + 2 - / 255 * rgba", channels=4, grid=blank(spark, 50, 50, 4))
    alpha = grid(r, "c3")
    assert alpha[0][0] == 0 and alpha[49][49] == 255
    with pytest.raises(expression.ExpressionError, match="not enough images"):
        expression.transform2([one(spark, 0, 0, 0)], postfix="x y getp2")
    for bad in ("x", "x +", "1 2", "nosuch", "x y getp1 sin", "@q"):
        with pytest.raises(expression.ExpressionError):
            expression.transform2([one(spark, 0, 0, 0)], postfix=bad)
    for bad in ("return 1", "x = ;", "return rgb(1,2", "return nosuch(1);", "y y"):
        with pytest.raises(expression.ExpressionError):
            expression.transform2([one(spark, 0, 0, 0)], infix=bad)
    a = expression.parse_infix("return rgb(2 ** 3 ** 2, -x + 1, 2 * (3 + 4));")
    assert repr(a) == "rgb(pow(2.0, pow(3.0, 2.0)), add(uminus(x), 1.0), 14.0)"
    tree = expression.parse_postfix("x 3 + y getp1 x 3 + y getp1 +")
    assert tree.args[0] == tree.args[1]
    r = expression.transform2([blank(spark, 4, 4)], postfix="x 3 + y getp1 x 3 + y getp1 +")
    assert r.px._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_assembled(spark):
    r = blank(spark, 4, 3)
    got = grid(assembler.assembled(r, "var i:n ; var p:p\nagain: i = add i 1\nvar t:n\nt = lt i x ; jumpnz t again\np = rgb i y 7 ; ret p"))
    assert got == [[1, 1, 2, 3]] * 3
    for bad in ("jump nowhere", "q = add 1 2", "var a:z", "var a:n ; var a:n", "var a:n ; a = add b 1"):
        with pytest.raises(expression.ExpressionError):
            assembler.Program(bad)
    with pytest.raises(expression.ExpressionError, match="50 steps"):
        assembler.Program("here: jump here").run(50, x=__import__("numpy").zeros(2))


def test_geometry_properties(spark):
    r = expression.transform2([], postfix="x 9 * y 5 * x y + rgb", grid=blank(spark, 7, 5))
    same = lambda a, b: all(grid(a, n) == grid(b, n) for n in a.names)
    for d in ("h", "v", "hv"):
        assert same(geometry.flip(geometry.flip(r, d), d), r)
    turned = r
    for _ in range(4):
        turned = geometry.rotate90(turned, 90)
    assert same(turned, r) and same(geometry.rotate90(geometry.rotate90(r, 90), 270), r)
    assert same(geometry.crop(r, 0, 0, 7, 5), r) and same(geometry.matrix_transform(r, geometry.Matrix2d.identity()), r)
    assert same(geometry.scale_mixing(r, 7, 5), r) and same(geometry.rotate(r, 0), r)
    flat = blank(spark, 8, 6, colour=(10, 20, 30))
    for s in (0.5, 1.7):
        assert only(geometry.scale(flat, s, s)) == (10, 20, 30)
    assert only(stencil.gaussian(flat, 1.2)) == (10, 20, 30) and only(stencil.conv(flat, [1, 2, 1])) == (10, 20, 30)
    with pytest.raises(ValueError, match="no content"):
        geometry.crop(r, left=9)
    assert geometry.scale_calculate(100, 50, xpixels=200, ypixels=50, kind="min") == (1, 1, 100, 50)
    m = geometry.Matrix2d.rotate(0.3, (3, 4)) * geometry.Matrix2d.rotate(-0.3, (3, 4))
    assert m.close(geometry.Matrix2d.identity())


def test_scale_sizes():
    c = geometry.scale_calculate
    assert c(100, 50) == (0.5, 0.5, 50, 25) and c(100, 50, 2, ypixels=100) == (2, 2, 200, 100) and c(100, 50, 3, xpixels=50) == (0.5, 0.5, 50, 25)
    assert c(100, 50, xpixels=50, ypixels=50) == (1, 1, 100, 50) and c(100, 50, xpixels=50, ypixels=50, kind="min")[2:] == (50, 25) and c(100, 50, xpixels=50, ypixels=50, kind="nonprop") == (0.5, 1, 50, 50)
    assert c(100, 50, xscalefactor=0.3)[:2] == (0.3, 0.3) and c(100, 50, 2, yscalefactor=0.3)[:2] == (2, 0.3) and c(3, 1, xscalefactor=0.5, yscalefactor=0.1) == (0.5, 0.1, 2, 1)
    assert c(100, 50, constrain=lambda w, h: 20 / max(w, h)) == (0.2, 0.2, 20, 10)
    for bad in ({"kind": "most"}, {"constrain": lambda w, h: 0}):
        with pytest.raises(ValueError):
            c(100, 50, **bad)


def test_matrices():
    m = geometry.Matrix2d
    at = lambda a, x, y: tuple(round(a[3 * k] * x + a[3 * k + 1] * y + a[3 * k + 2], 9) for k in (0, 1))
    assert at(m.reflect("x"), 3, 2) == (3, -2) and at(m.reflect("y"), 3, 2) == (-3, 2)
    assert at(m.reflect(radians=0.7853981633974483), 3, 2) == (-2, -3) and at(m.scale(2, 3, (10, 20)), -10, -20) == (-10, -20) and at(m.rotate(1.5707963267948966, (1, 1)), 2, 1) == (1, 2)
    for bad in ({}, {"axis": "z"}):
        with pytest.raises(ValueError):
            m.reflect(**bad)


def test_histogram_counts_all(spark):
    r = expression.transform2([], postfix="x y 3 rgb", grid=blank(spark, 9, 4, images=2))
    assert {x[0] for x in aggregates.histogram(r).groupBy("image_id", "channel").agg(F.sum("n").alias("n")).select("n").collect()} == {36}


def test_drawing(spark):
    r = draw.circle(blank(spark, 9, 9, 1), 4, 4, 3, (1,))
    assert ["".join(map(str, row)) for row in grid(r)][1:8] == ["001111100", "011111110", "011111110", "011111110", "011111110", "011111110", "001111100"]
    assert grid(draw.line(blank(spark, 5, 1, 1), 0, 0, 4, 0, (1,), endpoint=False)) == [[1, 1, 1, 1, 0]]
    ring = draw.polygon(blank(spark, 9, 9, 1), [[(1, 1), (8, 1), (8, 8), (1, 8)], [(3, 3), (6, 3), (6, 6), (3, 6)]], (1,))
    assert sum(map(sum, grid(ring))) == 49 - 9
    same = draw.polygon(blank(spark, 9, 9, 1), [[(1, 1), (8, 1), (8, 8), (1, 8)], [(3, 3), (6, 3), (6, 6), (3, 6)]], (1,), "nonzero")
    assert sum(map(sum, grid(same))) == 49
    filled = draw.flood_fill(draw.box(blank(spark, 9, 9, 1), 2, 2, 6, 6, (5,)), 4, 4, (9,))
    assert sum(v == 9 for row in grid(filled) for v in row) == 9
    held = spans.made(spark, [(0, -5, 2), (0, 8, 12), (0, 3, 6), (0, 2, 8), (1, 0, 2), (1, 8, 12), (1, 3, 6), (2, 4, 4)])
    assert sorted(map(tuple, spans.union(held).collect())) == [(0, -5, 12), (1, 0, 2), (1, 3, 6), (1, 8, 12)]
    with pytest.raises(ValueError, match="negative"):
        draw.circle(r, 1, 1, -1, (1,))


def test_fills(spark):
    r = blank(spark, 11, 1, 4)
    assert grid(fills.fountain(r, 0, 0, 10, 0))[0] == [int(k / 10 * 255 + 0.5) for k in range(11)]
    assert grid(fills.hatch(blank(spark, 4, 2, 1), "check1x1", (1,), (0,))) == [[1, 0, 1, 0], [0, 1, 0, 1]]
    with pytest.raises(ValueError):
        fills.shape("linear", 1, 1, 1, 1)
    good = ["GIMP Gradient", "Name: x", "1", "0 0.5 1 0 0 0 1 1 1 1 1 2 1"]
    assert fills.read_gimp_gradient(good)[0].curve == "sine"
    for bad in (["x"], good[:2], [*good[:3], "0 1"], [*good[:2], "2", good[3]]):
        with pytest.raises(ValueError):
            fills.read_gimp_gradient(bad)
    assert only(fills.nearest_colour(blank(spark, 5, 5, colour=(9, 8, 7)), [(0, 0), (4, 4)])) == (9, 8, 7)


def test_palettes(spark):
    assert len(quantize.fixed_palette("webmap")) == 216 and quantize.fixed_palette("gray4") == [(0,) * 3, (85,) * 3, (170,) * 3, (255,) * 3]
    r = areas(spark)
    assert sorted(quantize.median_cut(r, 8)) == [(0, 0, 0), (0, 0, 255), (255, 0, 0)] and len(quantize.median_cut(r, 2)) == 2
    pal = [(0, 0, 0), (255, 0, 0), (0, 0, 255)]
    back = quantize.expand(quantize.closest(r, pal), pal)
    assert aggregates.colour_usage_counts(back).first().counts == [625, 625, 1250]
    half = quantize.error_diffusion(blank(spark, 16, 16, 1, colour=(128,)), [(0, 0, 0), (255, 255, 255)])
    assert abs(sum(map(sum, grid(half))) - 128) <= 8
    with pytest.raises(ValueError):
        quantize.error_diffusion(r, pal, ([[0, 0]], 1))
    assert quantize.common_palette([[(1, 1, 1)], [(2, 2, 2), (1, 1, 1)]]) == [(1, 1, 1), (2, 2, 2)]
    for name in quantize.ORDERED:
        assert sorted(v for row in quantize.ordered_map(name) for v in row) == [4 * k for k in range(64)], name
    with pytest.raises(ValueError, match="dot9"):
        quantize.ordered_map("dot9")


def test_registry(spark):
    r = one(spark, 10, 20, 30)
    assert only(registry.apply(r, "hardinvert")) == (245, 235, 225)
    with pytest.raises(ValueError, match="no such filter"):
        registry.apply(r, "nope")
    with pytest.raises(ValueError, match="needs intensity"):
        registry.apply(r, "contrast")
    registry.register_filter("twice", lambda r, k: point.convert(r, [[k, 0, 0]]), ("k",))
    assert only(registry.apply(r, "twice", k=2)) == (20,)
    with pytest.raises(ValueError, match="already"):
        registry.register_filter("twice", lambda r: r)
    registry.FILTERS.pop("twice")


def test_colours():
    assert colour.parse("#f80") == (255, 136, 0, 255) and colour.parse("102030") == (16, 32, 48, 255) and colour.parse("#10203040") == (16, 32, 48, 64)
    assert colour.parse("rgb(10%, 20, 30)") == (26, 20, 30, 255) and colour.parse("rgba(1,2,3,0.5)") == (1, 2, 3, 128) and colour.parse(" Navy ") == (0, 0, 128, 255)
    assert colour.parse("ivory", colour.read_names(["! remark", "255 255 240\t\tIvory"])) == (255, 255, 240, 255)
    assert colour.as_css((1, 2, 3)) == "rgb(1, 2, 3)" and colour.equals((1, 2, 3, 4), (1, 2, 3, 5), True) and colour.to_8bit(colour.to_float((1, 200, 255))) == (1, 200, 255)
    with pytest.raises(ValueError):
        colour.parse("nothing")


def test_colour_columns(spark):
    texts = ["#f80", "102030", "#10203040", "rgb(10%, 20, 30)", "rgba(1,2,3,0.5)", "rgba( 1 2 3 / .25 )", "rgb(255.0 0 300)", " Navy ", "ivory", "nothing", "#12", "rgb(1,2)", "", None]
    got = [r.c and tuple(r.c) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(colour.parsed(F.col("t"), {"ivory": (255, 255, 240)}).alias("c")).collect()]
    assert got == [(255, 136, 0, 255), (16, 32, 48, 255), (16, 32, 48, 64), (26, 20, 30, 255), (1, 2, 3, 128), (1, 2, 3, 64), (255, 0, 255, 255), (0, 0, 128, 255), (255, 255, 240, 255), None, None, None, None, None]
    d = spark.range(256).select(F.col("id").cast("int").alias("a"))
    for a, text_ in d.select("a", colour.css(F.lit(1), F.lit(2), F.lit(3), F.col("a"))).collect():
        assert text_ == colour.as_css((1, 2, 3, a)) and colour.parse(text_) == (1, 2, 3, a)
    assert [colour.as_css((0, 0, 0, a)) for a in (0, 128, 64, 3, 1)] == ["rgba(0, 0, 0, 0)", "rgba(0, 0, 0, 0.5)", "rgba(0, 0, 0, 25%)", "rgba(0, 0, 0, 1%)", "rgba(0, 0, 0, 0.3%)"]
    rgb = spark.createDataFrame([(255, 0, 0), (255, 0, 128), (0, 255, 0), (10, 20, 30), (0, 0, 0), (7, 7, 7)], "r int, g int, b int")
    rows = [tuple(r) for r in rgb.select(*colour.hsv(*map(F.col, "rgb"))).collect()]
    assert rows == [(0, 1.0, 1.0), (330, 1.0, 1.0), (120, 1.0, 1.0), (210, 1 - 10 / 30, 30 / 255), (0, 0.0, 0.0), (0, 0.0, 7 / 255)]
    hsv = spark.createDataFrame([(120.0, 0.5, 1.0), (480.9, 0.5, 1.0), (-60.0, 1.0, 1.0), (7.0, 0.0, 0.5), (7.0, 2.0, -1.0)], "h double, s double, v double")
    assert [tuple(r) for r in hsv.select(*colour.from_hsv(*map(F.col, "hsv"))).collect()] == [(127, 255, 127), (127, 255, 127), (255, 0, 255), (127, 127, 127), (0, 0, 0)]


def test_tags(spark):
    d = spark.range(1).select(F.array().cast(tags.KIND).alias("t"))
    d = d.select(tags.add(tags.add(tags.add(F.col("t"), "a", 1), "a", "x7"), "c", "color(1,2,3)").alias("t"))
    got = d.select(tags.find(F.col("t"), "a").alias("all"), tags.get_int(F.col("t"), "a").alias("n"), tags.get_colour(F.col("t"), "c").alias("c"), tags.find(tags.put(F.col("t"), "a", 5), "a").alias("put"), F.size(tags.delete(F.col("t"), "a")).alias("left"), tags.get(F.col("t"), "none").alias("none")).first()
    assert (got["all"], got.n, tuple(got.c), got.put, got.left, got.none) == (["1", "x7"], 1, (1, 2, 3, 255), ["5"], 1, None)


def test_text(spark):
    font = text.BlockFont(10)
    assert font.bounds("abc").advance == 15 and font.bounds("").height == 10
    assert text.wrap("one two three fourteenletters", font, 40) == (["one two", "three", "fourteen", "letters"], 4)
    assert text.align(50, 50, font.bounds("ab"), "center", "top") == (45, 57)
    assert sum(map(sum, grid(text.draw(blank(spark, 20, 20, 1), "i", 2, 15, font, (1,))))) == 4 * 7


def test_pixels_in_and_out(spark):
    r = blank(spark, 3, 2, 1)
    updates = spark.createDataFrame([(0, 1, 2, 1, 5), (0, 1, 2, 2, 6), (0, 9, 9, 3, 7)], "image_id long, y int, x int, seq int, c0 int")
    assert grid(joins.set_pixels(r, updates)) == [[0, 0, 0], [0, 0, 6]]
    with pytest.raises(ValueError, match="channels"):
        Raster(r.px, 3, 2, 5)
    with pytest.raises(ValueError, match="different number"):
        joins.difference(r, blank(spark, 3, 2, 3))
    assert only(procedural.by_place(blank(spark, 2, 2, 1), lambda x, y: [x * 0 + 3])) == (3,)


def test_unknown_transparency_is_an_error(spark):
    r = Raster(spark.createDataFrame([(0, 0, 0, 1, 2, 3, 4)], "image_id long, y int, x int, c0 int, c1 int, c2 int, c3 int"), 1, 1, 4, "8")
    with pytest.raises(ValueError):
        quantize.to_paletted(r, [(0, 0, 0)], transparency="sieve")
