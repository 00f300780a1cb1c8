"""Anti-aliased polygons by sweeping their edges, on a grid of sixteenths of a pixel.

A shape is a relation (ring, at, x, y), with image_id where images have shapes of their own. Between two heights at which
points lie, the same edges are crossed in the same order: a band. Edges meet bands by the numbers of heights, bands meet rows
by a sequence, and each pair of edges leaves the pixels that an edge passes through as single values and all between them
as two steps, which a running sum along the row turns into runs of equal coverage. The work follows crossings, not pixels
times edges.

A band's rows reach as far as all its edges do, which can be past the band, where a point belongs to ended edges only: such
rows are counted for both bands. Edges that meet where a band is measured go by their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.model import Raster
from rasterloom.operators.spans import shared

Contours = list[list[tuple[float, float]]]


def made(spark: SparkSession, contours: Contours) -> DataFrame:
    """The points of rings, which are closed by themselves."""
    if not contours:
        raise ValueError("a polygon has a contour at least")
    if any(len(points) < 3 for points in contours):
        raise ValueError("a contour has three points at least")
    return spark.createDataFrame([(ring, at, float(x), float(y)) for ring, points in enumerate(contours) for at, (x, y) in enumerate(points)], "ring int, at int, x double, y double")


def _image_of(df: DataFrame) -> list[str]:
    return ["image_id"] if "image_id" in df.columns else []


def edges(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges (edge, x1, y1, x2, y2) that aren't level, in sixteenths, and the heights (height, y, below) at which points
    lie, in order."""
    image = _image_of(points)
    at = points.select(*image, "ring", "at", *((F.col(n) * 16).cast("long").alias(f"{n}1") for n in "xy"))
    ring = Window.partitionBy(*image, "ring").orderBy("at")
    ends = {f"{n}2": F.coalesce(F.lead(f"{n}1").over(ring), F.first(f"{n}1").over(ring)) for n in "xy"}
    sides = at.withColumns(ends).where("y1 <> y2").withColumn("edge", F.struct("ring", "at")).drop("ring", "at")
    order = Window.partitionBy(*image).orderBy("y")
    heights = at.select(*image, F.col("y1").alias("y")).distinct()
    return sides, heights.select("*", F.row_number().over(order).alias("height"), F.lead("y").over(order).alias("below"))


def slices(points: DataFrame, rule: str = "evenodd") -> DataFrame:
    """(height, y0, y1, least, most, l, r): the pairs of edges that a band is filled between, by the even-odd or the nonzero
    rule, the band's ends and those that all its edges share."""
    if rule not in ("evenodd", "nonzero"):
        raise ValueError(f"no rule {rule!r}")
    image = _image_of(points)
    sides, heights = edges(points)
    number = lambda name, as_: heights.select(*image, F.col("y").alias(name), F.col("height").alias(as_))
    sides = sides.withColumns({"top": F.least("y1", "y2"), "low": F.greatest("y1", "y2")})
    sides = sides.join(number("top", "_from"), [*image, "top"]).join(number("low", "_to"), [*image, "low"])
    crossed = sides.withColumn("height", F.explode(F.expr("sequence(_from, _to - 1)")))
    crossed = crossed.join(heights.select(*image, "height", F.col("y").alias("y0"), F.col("below").alias("y1_")), [*image, "height"])
    middle = crossed.withColumn("_y", F.expr("(y0 + y1_) div 2")).withColumn("_x", F.expr("((_y - y1) * x2 + (y2 - _y) * x1) div (y2 - y1)"))
    band = Window.partitionBy(*image, "height")
    order = band.orderBy("_x", "edge")
    way = F.when(F.col("y1") < F.col("y2"), 1).otherwise(-1)
    ranked = middle.select(
        *image, "height", "y0", F.col("y1_").alias("y1"), F.max("top").over(band).alias("least"), F.min("low").over(band).alias("most"), way.alias("way"),
        F.row_number().over(order).alias("nth"), F.sum(way).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"), F.struct("x1", F.col("y1").alias("y1"), "x2", "y2").alias("line"),
    )
    if rule == "evenodd":
        pair = F.expr("(nth - 1) div 2")
    else:  # a pair begins where nothing is open, and ends where all is closed again
        pair = F.sum(F.when(F.col("sum") == F.col("way"), 1).otherwise(0)).over(band.orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    closed = F.count(F.lit(1)) == 2 if rule == "evenodd" else F.sum("way") == 0
    pairs = ranked.withColumn("_pair", pair).groupBy(*image, "height", "y0", "y1", "least", "most", "_pair")
    return pairs.agg(F.min_by("line", "nth").alias("l"), F.max_by("line", "nth").alias("r"), closed.alias("_closed")).where("_closed").drop("_pair", "_closed")


def _at_y(line: str, y: str) -> str:
    return f"((({y}) - {line}.y1) * {line}.x2 + ({line}.y2 - ({y})) * {line}.x1) div ({line}.y2 - {line}.y1)"


def _at_x(line: str, x: str) -> str:
    return f"((({x}) - {line}.x1) * {line}.y2 + ({line}.x2 - ({x})) * {line}.y1) div nullif({line}.x2 - {line}.x1, 0)"


def _right_of(line: str, x: str) -> str:
    """The area, in 256ths, of pixel x between heights lo and hi that lies right of an edge through it: by which of the
    pixel's sides the edge passes through, and whether it rises to the right."""
    left, right = f"({_at_x(line, f'{x} * 16')})", f"({_at_x(line, f'{x} * 16 + 16')})"
    top, low, in_left, in_right = f"({_at_y(line, 'lo')})", f"({_at_y(line, 'hi')})", f"coalesce({left} between lo and hi, false)", f"coalesce({right} between lo and hi, false)"
    rises = f"sign({line}.x2 - {line}.x1) <> sign({line}.y2 - {line}.y1)"
    start = f"{x} * 16"
    return f"""case
        when {in_left} and {in_right} then 8 * if({rises}, 2 * hi - {left} - {right}, {left} + {right} - 2 * lo)
        when {in_left} then cast(16 * (hi - lo) - if({rises}, ({top} - {start}) * ({left} - lo), ({low} - {start}) * (hi - {left})) / 2.0D as long)
        when {in_right} then if({rises}, ({start} + 16 - {low}) * (hi - {right}), ({start} + 16 - {top}) * ({right} - lo)) div 2
        else ((hi - lo) * (2 * ({start} + 16) - {top} - {low})) div 2 end"""


def coverage(points: DataFrame, width: int, height: int, rule: str = "evenodd") -> DataFrame:
    """(y, x1, x2, share), with image_id where the points have it: disjoint runs of a width x height image and their coverage
    from 1 to 255."""
    image = _image_of(points)
    rows = slices(points, rule).withColumns({"_first": F.expr("greatest(y0 div 16, 0)"), "_last": F.expr(f"least((y1 + 15) div 16, {height}) - 1")}).where("_first <= _last")
    rows = rows.select("*", F.explode(F.expr("sequence(_first, _last)")).alias("y"))
    rows = rows.withColumns({"lo": F.expr("greatest(least, 0, y * 16)"), "hi": F.expr(f"least(most, {height * 16}, y * 16 + 16)")})
    ends = {f"{side}{name}": F.expr(f"{f}({_at_y(side, 'lo')}, {_at_y(side, 'hi')})") for side in "lr" for name, f in (("a", "least"), ("b", "greatest"))}
    rows = rows.withColumns(ends).withColumns({"_start": F.expr("greatest(la div 16, 0)"), "_stop": F.expr(f"least((rb - 1) div 16, {width - 1})")}).where("_start <= _stop")
    rows = rows.withColumns({"_soft": F.expr("least(_stop, (lb - 1) div 16)"), "_full": F.expr("greatest(_start, (lb - 1) div 16 + 1)"), "_end": F.expr("greatest(_start, ra div 16)")})
    none = "cast(array() as array<struct<x:bigint,one:bigint,step:bigint>>)"
    single = lambda a, b, value: f"if({a} <= {b}, transform(sequence({a}, {b}), x -> struct(x as x, cast({value} as bigint) as one, 0L as step)), {none})"
    steps = f"if(_full <= _stop, array(struct(_full as x, 0L as one, 16 * (hi - lo) as step), struct(_stop + 1 as x, 0L as one, -16 * (hi - lo) as step)), {none})"
    found = rows.select(*image, "y", F.explode(F.concat(F.expr(single("_start", "_soft", _right_of("l", "x"))), F.expr(single("_end", "_stop", f"-({_right_of('r', 'x')})")), F.expr(steps))).alias("_e"))
    found = found.groupBy(*image, "y", F.col("_e.x").alias("x")).agg(F.sum("_e.one").alias("one"), F.sum("_e.step").alias("step"))
    row = Window.partitionBy(*image, "y").orderBy("x")
    found = found.withColumns({"_level": F.sum("step").over(row.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.coalesce(F.lead("x").over(row), F.col("x") + 1)})
    runs = F.array(F.struct(F.col("x").alias("x1"), (F.col("x") + 1).alias("x2"), (F.col("one") + F.col("_level")).alias("share")), F.struct((F.col("x") + 1).alias("x1"), F.col("_next").alias("x2"), F.col("_level").alias("share")))
    found = found.select(*image, "y", F.inline(runs)).where("x1 < x2 and share > 0")
    return found.select(*image, *(F.col(n).cast("int").alias(n) for n in ("y", "x1", "x2")), F.least("share", F.lit(255)).cast("int").alias("share"))


def polygon(r: Raster, shape: Contours | DataFrame, colour: tuple[int, ...], rule: str = "evenodd") -> Raster:
    """A shape filled with a colour, all channels mixed by coverage; contours hold for all images of a stack."""
    points = shape if isinstance(shape, DataFrame) else made(r.px.sparkSession, shape)
    share = F.col("_share") / F.lit(255.0)
    return r.with_px(shared(r, coverage(points, r.width, r.height, rule))).project({n: (share * F.lit(float(colour[k])) + (1.0 - share) * F.col(n)).cast("int") for k, n in enumerate(r.names)})
