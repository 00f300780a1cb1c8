"""The registered queries: one for each operator, over stacks made from the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import model
from rasterloom.functions import colour, samples, tags
from rasterloom.functions.blend import MODES
from rasterloom.model import KEYS, Raster
from rasterloom.operators import aggregates, draw, fills, geometry, glyphs, joins, palette, point, procedural, quantize, spans, stencil, sweep, text
from rasterloom.plans import assembler, expression, registry
from rasterloom.sources import codecs, images

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The stacks in SQL: p has three channels, a a fourth; t and ta are turned by half.
BASE = """with e as (select vec_id // 50 as image_id, (vec_id % 50)::int as y, embedding as v from embeddings),
g as (select image_id, y, unnest(range(64))::int as x, v from e),
p as (select image_id, y, x, trunc((v[x + 1]::double + 1) * 127.5)::int as c0, trunc((v[(x + 1) % 64 + 1]::double + 1) * 127.5)::int as c1, trunc((v[(x + 2) % 64 + 1]::double + 1) * 127.5)::int as c2 from g),
a as (select *, least(255, greatest(0, (c0 * 5 + x * 3 + y * 7) % 300 - 20))::int as c3 from p),
t as (select image_id, 49 - y as y, 63 - x as x, c0, c1, c2 from p),
ta as (select image_id, 49 - y as y, 63 - x as x, c0, c1, c2, c3 from a)"""


def each(text: str, n: int = 3) -> str:
    """The text for each channel: @ stands for its number."""
    return ", ".join(f"{text.replace('@', str(k))} as c{k}" for k in range(n))


def select(body: str, tables: str = "p", more: str = "") -> str:
    return f"{BASE}{', ' + more if more else ''} select image_id, y, x, {body} from {tables}"


def query(name: str, sql: str | None = None, channels: int = 3):
    def keep(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            got = f(model.from_embeddings(spark, folder, channels))
            return got.px.select(*KEYS, *got.names) if isinstance(got, Raster) else got

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def add(name: str, f, sql: str | None = None, channels: int = 3) -> None:
    query(name, sql, channels)(f)


# Conversions and point filters

add("convert_grey_usage", lambda r: aggregates.colour_usage(point.convert(r, "grey")).select("image_id", "c0", "n"), f"{BASE} select image_id, trunc(c0 * 0.222::double + c1 * 0.707::double + c2 * 0.071::double)::int as c0, count(*) as n from p group by 1, 2")
add("contrast", lambda r: point.contrast(r, 1.3), select(each("least(255, trunc(c@ * (1.3::float)::double))::int")))
add("hardinvert", lambda r: point.hardinvert(r), select(each("255 - c@") + ", c3", "a"), 4)
add("hardinvertall", lambda r: point.hardinvert(r, every=True), select(each("255 - c@", 4), "a"), 4)
add("postlevels", lambda r: point.postlevels(r, 10), select(each("greatest(0, least(255, trunc(c@::float / 255::float * 10::float)::int * 25))")))
add("lin_stretch", lambda r: point.lin_stretch(r, 60, 190), select(each("greatest(0, least(255, trunc((c@ - 60) * 255 / 130)::int))")))
add("flines", lambda r: point.flines(r), select(each("greatest(0, least(255, trunc(c@::float * (1.2::float - 0.8::float * (case when y % 2 = 0 then y::double / 50 else (50.0::double - y) / 50 end)::float))::int))")))
add("map_lut", lambda r: point.map_lut(r, {"red": [(v * v) // 255 for v in range(256)], "blue": [255 - v for v in range(256)]}), select("c0 * c0 // 255 as c0, c1, 255 - c2 as c2"))
add("convert_matrix", lambda r: point.convert(r, [[0.5, 0.25, 0.25, 0.1], [0, 1, 0], [-0.5, 0, 1.2]]), select("greatest(0, least(255, trunc(c2 * 0.25::double + (c1 * 0.25::double + (c0 * 0.5::double + 25.5::double)))::int)) as c0, c1, greatest(0, least(255, trunc(c2 * 1.2::double + (c0 * (-0.5)::double))::int)) as c2"))
add("convert_addalpha", lambda r: point.convert(r, "addalpha"), select("c0, c1, c2, 255 as c3"))
add("convert_alpha", lambda r: point.convert(r, "alpha"), select("c3 as c0", "a"), 4)
add("adapt_to_grey", lambda r: point.adapt(r, 1), select("trunc(trunc(c0 * c3 / 255) * 0.222::double + trunc(c1 * c3 / 255) * 0.707::double + trunc(c2 * c3 / 255) * 0.071::double + 0.5)::int as c0", "a"), 4)
add("flatten", lambda r: point.flatten(r, (10, 200, 90)), select(", ".join(f"trunc((c{k} * c3 + {v} * (255 - c3)) / 255)::int as c{k}" for k, v in enumerate((10, 200, 90))), "a"), 4)
add("border", lambda r: point.border(r, (1, 2, 3)), select(each("case when x in (0, 63) or y in (0, 49) then @ + 1 else c@ end")))
add("noise", lambda r: point.noise(r, 12.0, seed=3))
add("to_16_and_back", lambda r: model.to_bits(model.to_bits(r, "16"), "8"), select("c0, c1, c2"))
add("to_double", lambda r: model.to_bits(r, "double").map_all(lambda c: F.round(c, 6)), select(each("round(c@ / 255, 6)")))

# Places

add("crop", lambda r: geometry.crop(r, left=5, top=7, width=40, height=30), f"{BASE} select image_id, y - 7 as y, x - 5 as x, c0, c1, c2 from p where x between 5 and 44 and y between 7 and 36")
add("crop_middle", lambda r: geometry.crop(r, width=31, height=20), f"{BASE} select image_id, y - 15 as y, x - 17 as x, c0, c1, c2 from p where x between 17 and 47 and y between 15 and 34")
add("trim_rect", lambda r: geometry.trim_rect(_framed(r), [((0, 0, 0), (0, 0, 0))]),
    f"{BASE}, f as (select image_id, y, x, case when x between 11 and 30 and y between 23 and 40 then c0 else 0 end as c0 from p), n as (select * from f where c0 <> 0) select i.image_id, coalesce(min(x), 64)::int as \"left\", coalesce(min(y), 0)::int as top, coalesce(63 - max(x), 0)::int as \"right\", coalesce(49 - max(y), 0)::int as bottom from (select distinct image_id from p) i left join n using (image_id) group by 1")


def _framed(r: Raster) -> Raster:
    inside = F.col("x").between(11, 30) & F.col("y").between(23, 40) & (F.col("c0") != 0)
    return r.project({n: F.when(inside, F.col("c0")).otherwise(0) for n in r.names})


for _d, _x, _y in (("h", "63 - x", "y"), ("v", "x", "49 - y"), ("hv", "63 - x", "49 - y")):
    add(f"flip_{_d}", lambda r, d=_d: geometry.flip(r, d), f"{BASE} select image_id, {_y} as y, {_x} as x, c0, c1, c2 from p")
for _d, _x, _y in ((90, "49 - y", "x"), (180, "63 - x", "49 - y"), (270, "y", "63 - x")):
    add(f"rotate{_d}", lambda r, d=_d: geometry.rotate90(r, d), f"{BASE} select image_id, {_y} as y, {_x} as x, c0, c1, c2 from p")
add("scale_nn", lambda r: geometry.scale_nearest(r, 0.5, 2.0), f"{BASE}, o as (select unnest(range(32))::int as ox), q as (select unnest(range(100))::int as oy) select image_id, oy as y, ox as x, c0, c1, c2 from o, q, p where p.x = trunc(ox / 0.5)::int and p.y = trunc(oy / 2.0)::int")
add("scale_to_pixels", lambda r: geometry.scale_to(r, "preview", xpixels=40, ypixels=70, kind="min"), f"{BASE}, o as (select unnest(range(40))::int as ox), q as (select unnest(range(31))::int as oy) select image_id, oy as y, ox as x, c0, c1, c2 from o, q, p where p.x = trunc(ox / 0.625)::int and p.y = trunc(oy / 0.625)::int")
add("scale_mixing", lambda r: geometry.scale_mixing(r, 32, 25), f"{BASE} select image_id, y // 2 as y, x // 2 as x, {each('least(255, floor(sum(c@) / 4 + 0.5))::int')} from p group by 1, y // 2, x // 2")


def _windowed(x: str) -> str:
    """A windowed sine at a distance, in single precision."""
    turn = f"(pi() * ({x})::float)::float"
    return f"case when abs({x}) >= 2 then 0::float when ({x}) = 0 then 1::float else (sin({turn}::double) / {turn}::double * sin(({turn} / 2)::float::double) / ({turn} / 2)::float::double)::float end"


def _halved_sql(axis: str, table: str, name: str, names: str, alpha: bool = False) -> str:
    """An axis halved: sources go by whole places of the old one, so that all sums have the same eight weights, taken as
    pairs after and before the middle from near to far on one side and far to near on the other."""
    other, size = ("y", 64) if axis == "x" else ("x", 50)
    far = range(4)
    weights = {d: _windowed(f"{d} / 2.0") for d in range(5)}
    total = " + ".join(f"({weights[3 - k]})::double + ({weights[k + 1]})::double" for k in far)
    weight = {d: f"(({w})::double / (({total}) / 2))::float" for d, w in weights.items()}
    steps = [(f"least({size - 1}, 2 * o + {k + 1})", k + 1) if late else (f"greatest(0, 2 * o - {3 - k})", 3 - k) for k in far for late in (True, False)]
    ch = len(names.split())

    def summed(k: int) -> str:
        value = "0::float"
        for place, d in steps:
            term = f"w{d} * (s{k}[{place} + 1])::float"
            if alpha and k < ch - 1:
                term = f"({term} * (s{ch - 1}[{place} + 1])::float / 255::float)"
            value = f"({value} + {term})"
        return f"{value} / 2::float as v{k}"

    whole = lambda v: f"greatest(0, least(255, trunc(({v})::double + 0.5::double)))::int"
    if alpha:
        last = f"v{ch - 1}"
        done = ", ".join(f"case when {whole(last)} > 0 then {whole(f'v{k} * 255::float / {last}')} else 0 end as c{k}" for k in range(ch - 1)) + f", {whole(last)} as c{ch - 1}"
    else:
        done = ", ".join(f"{whole(f'v{k}')} as c{k}" for k in range(ch))
    lists = ", ".join(f"list(c{k} order by {axis}) as s{k}" for k in range(ch))
    return f"{name} as (select image_id, {other}, o as {axis}, {done} from (select image_id, {other}, o, {', '.join(map(summed, range(ch)))} from (select image_id, {other}, {lists} from {table} group by 1, 2), (select unnest(range({size // 2}))::int as o), (select {', '.join(f'{w} as w{d}' for d, w in weight.items())})))"


add("scale_lanczos", lambda r: Raster(geometry.scale(r, 0.5, 0.5).px, 32, 25), f"{BASE}, {_halved_sql('x', 'p', 'hx', 'c0 c1 c2')}, {_halved_sql('y', 'hx', 'hy', 'c0 c1 c2')} select image_id, y, x, c0, c1, c2 from hy")
add("scale_lanczos_alpha", lambda r: geometry.scale(r, 0.5, 0.5), f"{BASE}, {_halved_sql('x', 'a', 'hx', 'c0 c1 c2 c3', True)}, {_halved_sql('y', 'hx', 'hy', 'c0 c1 c2 c3', True)} select image_id, y, x, c0, c1, c2, c3 from hy", 4)


def _mixed_sql(m: tuple[float, ...], w: int, h: int) -> str:
    """A 3 x 3 matrix without perspective, over p: up to four pixels around a place, rows first, rounded twice."""
    place = lambda k: f"ox * {float(m[k])!r}::double + oy * {float(m[k + 1])!r}::double + {float(m[k + 2])!r}::double"
    grid = f"o as (select image_id, oy, ox, {place(0)} as sx, {place(3)} as sy from (select distinct image_id from p), (select unnest(range({w}))::int as ox), (select unnest(range({h}))::int as oy)), n as (select image_id, oy, ox, sx >= -1 and sx < 64 and sy >= -1 and sy < 50 as near, floor(sx)::int as bx, floor(sy)::int as \"by\", sx - floor(sx) as dx, sy - floor(sy) as dy from o)"
    corners = [(i, j) for j in (0, 1) for i in (0, 1)]
    joins = " ".join(f"left join p q{i}{j} on q{i}{j}.image_id = n.image_id and q{i}{j}.x = n.bx + {i} and q{i}{j}.y = n.\"by\" + {j}" for i, j in corners)
    got = ", ".join(f"coalesce(q{i}{j}.c{k}, 0) as c{k}_{i}{j}" for k in range(3) for i, j in corners)
    row = lambda k, j: f"case when dx = 0 then c{k}_0{j} else trunc((1 - dx) * c{k}_0{j} + dx * c{k}_1{j} + 0.5::double)::int end as c{k}_{j}"
    rows = ", ".join(row(k, j) for k in range(3) for j in (0, 1))
    return f"{BASE}, {grid}, found as (select n.*, {got} from n {joins}), mixed as (select *, {rows} from found) select image_id, oy as y, ox as x, " + ", ".join(f"case when not near then 0 when dy = 0 then c{k}_0 else trunc((1 - dy) * c{k}_0 + dy * c{k}_1 + 0.5::double)::int end as c{k}" for k in range(3)) + " from mixed"


_SHEARED = geometry.Matrix2d.translate(3, -2.25) * geometry.Matrix2d.shear(0.5, 0)
add("matrix_transform", lambda r: geometry.matrix_transform(r, _SHEARED), _mixed_sql(_SHEARED, 64, 50))
add("matrix_transform_alpha", lambda r: geometry.matrix_transform(r, _SHEARED, background=(10, 20, 30, 40)), None, 4)
_MIRRORED = geometry.Matrix2d.translate(30, 40) * geometry.Matrix2d.reflect(radians=0.3) * geometry.Matrix2d.scale(0.8, 1.1, (2, 3))
add("matrix_reflect", lambda r: geometry.matrix_transform(r, _MIRRORED), _mixed_sql(_MIRRORED, 64, 50))
add("rotate_angle", lambda r: geometry.rotate(r, 30), _mixed_sql(*geometry.rotation(64, 50, 30)))

# Neighbourhoods


def _conv_sql(coefficients: tuple[float, ...]) -> str:
    m, total = len(coefficients) // 2, sum(coefficients)

    def one(axis: str, table: str, name: str) -> str:
        other = "y" if axis == "x" else "x"
        parts = []
        for k in range(3):
            taps = [f"coalesce({'lag' if i < m else 'lead'}(c{k}, {abs(i - m)}) over w, {'first' if i < m else 'last'}_value(c{k}) over (partition by image_id, {other} order by {axis} rows between unbounded preceding and unbounded following)) * {c}::double" if i != m else f"c{k} * {c}::double" for i, c in enumerate(coefficients)]
            parts.append(f"greatest(0, least(255, trunc(({' + '.join(taps)}) / {total}::double)::int)) as c{k}")
        return f"{name} as (select image_id, y, x, {', '.join(parts)} from {table} window w as (partition by image_id, {other} order by {axis}))"

    return f"{BASE}, {one('x', 'p', 'cx')}, {one('y', 'cx', 'cy')} select image_id, y, x, c0, c1, c2 from cy"


def _gauss_sql(sigma_x: float, sigma_y: float, last: str = "") -> str:
    def one(axis: str, sigma: float, table: str, name: str) -> str:
        weights = geometry.gaussian_weights(sigma, "8")
        m, (other, size), parts = len(weights) // 2, ("y", 64) if axis == "x" else ("x", 50), []
        for k in range(3):
            tap = lambda i, k=k: f"c{k}" if i == m else f"{'lag' if i < m else 'lead'}(c{k}, {abs(i - m)}) over w"
            value = " + ".join(f"coalesce(({tap(i)}) * {w!r}::double, 0)" for i, w in enumerate(weights))
            mass = " + ".join(f"case when {axis} + {i - m} between 0 and {size - 1} then {w!r}::double else 0::double end" for i, w in enumerate(weights))
            parts.append(f"greatest(0, least(255, trunc(({value}) / ({mass}) + 0.5)::int)) as c{k}")
        return f"{name} as (select image_id, y, x, {', '.join(parts)} from {table} window w as (partition by image_id, {other} order by {axis}))"

    table, passes = "p", []
    for axis, sigma in (("x", sigma_x), ("y", sigma_y)):
        if sigma:
            passes.append(one(axis, sigma, table, f"g{axis}"))
            table = f"g{axis}"
    return f"{BASE}, {', '.join(passes)} {last or f'select image_id, y, x, c0, c1, c2 from {table}'}"


add("conv", lambda r: stencil.conv(r, [0.1, 0.2, 0.4, 0.2, 0.1]), _conv_sql((0.1, 0.2, 0.4, 0.2, 0.1)))
add("gaussian", lambda r: stencil.gaussian(r, 1.5), _gauss_sql(1.5, 1.5))
add("unsharpmask", lambda r: stencil.unsharp_mask(r, 1.5, 1.0), _gauss_sql(1.5, 1.5, f"select p.image_id, p.y, p.x, {each('greatest(0, least(255, 2 * p.c@ - gy.c@))')} from p join gy using (image_id, y, x)"))
add("mosaic", lambda r: stencil.mosaic(r, 8), f"{BASE}, m as (select image_id, y // 8 as ty, x // 8 as tx, {each('trunc((sum(c@) / 64)::float)::int')} from p group by 1, 2, 3) select p.image_id, y, x, {each('m.c@')} from p join m on p.image_id = m.image_id and y // 8 = ty and x // 8 = tx")
_FAR = repr((44.0**2 + 35.0**2) ** 0.5) + "::double"
add("bumpmap", lambda r: stencil.bumpmap(r, model.turned(r), 0, 20, 15, 2), f"{BASE}, s as (select image_id, y, x, (coalesce(lead(c0, 2) over wx, 0) - coalesce(lag(c0, 2) over wx, 0) + 128)::double as gx, (coalesce(lead(c0, 2) over wy, 0) - coalesce(lag(c0, 2) over wy, 0) + 128)::double as gy, abs(x - 20) / {_FAR} as tx, abs(y - 15) / {_FAR} as ty from t window wx as (partition by image_id, y order by x), wy as (partition by image_id, x order by y)), z as (select image_id, y, x, least(2, greatest(0, 1 - sqrt(tx * tx + ty * ty) * (sqrt(gx * gx + gy * gy) / {_FAR}))) as z from s) select p.image_id, p.y, p.x, {each('case when p.x between 1 and 62 and p.y between 1 and 48 then trunc((c@ * z)::float)::int else 0 end')} from p join z using (image_id, y, x)")
add("bumpmap_complex", lambda r: stencil.bumpmap_complex(r, model.turned(r), 0, (-1.0, -1.0, -2.0), 0.3, 0.6, 0.4, 8.0))
add("haar", lambda r: stencil.haar(r), f"{BASE}, h1 as (select image_id, y, x // 2 as k, {', '.join(f'max(case when x % 2 = {q} then c{k} end) as a{k}{q}' for k in range(3) for q in (0, 1))} from p group by 1, 2, 3), r1 as (select image_id, y, k as x, {', '.join(f'(a{k}0 + a{k}1) // 2 as c{k}' for k in range(3))} from h1 union all select image_id, y, k + 32, {', '.join(f'(255 + a{k}0 - a{k}1) // 2' for k in range(3))} from h1), h2 as (select image_id, x, y // 2 as k, {', '.join(f'max(case when y % 2 = {q} then c{k} end) as a{k}{q}' for k in range(3) for q in (0, 1))} from r1 group by 1, 2, 3) select image_id, k::int as y, x::int as x, {', '.join(f'((a{k}0 + a{k}1) // 2)::int as c{k}' for k in range(3))} from h2 union all select image_id, (k + 25)::int, x::int, {', '.join(f'((255 + a{k}0 - a{k}1) // 2)::int' for k in range(3))} from h2")

# Levels and counts

add("autolevels", lambda r: aggregates.autolevels(r, 0.1, 0.1), f"{BASE}, l as (select image_id, trunc(c0 * 0.222::double + c1 * 0.707::double + c2 * 0.071::double + 0.5)::int as b from p), i as (select distinct image_id from p), h as (select i.image_id, bin, count(b) as n from i cross join (select unnest(range(256))::int as bin) left join l on l.image_id = i.image_id and l.b = bin group by 1, 2), c as (select image_id, bin, sum(n) over (partition by image_id order by bin) - n as lower_, sum(n) over (partition by image_id order by bin desc) - n as upper_, sum(n) over (partition by image_id) as total from h), m as (select image_id, coalesce(max(case when lower_ < total * (0.1::float)::double then bin end), 0) as lo, coalesce(min(case when upper_ < total * (0.1::float)::double then bin end), 255) as hi from c group by 1) select p.image_id, y, x, {each('case when hi = lo then c@ else greatest(0, least(255, trunc((c@ - lo) * 255 / (hi - lo))::int)) end')} from p join m using (image_id)")
_SKEW = ", ".join(f"m{k} as (select image_id, coalesce(min(case when up >= total * (0.1::float)::double then bin end), 0) as lo{k}, coalesce(max(case when down >= total * (0.1::float)::double then bin end), 255) as hi{k} from (select image_id, bin, sum(n) over (partition by image_id order by bin) as up, sum(n) over (partition by image_id order by bin desc) as down, sum(n) over (partition by image_id) as total from (select image_id, c{k} as bin, count(*) as n from p group by 1, 2)) group by 1)" for k in range(3))
add("autolevels_skew", lambda r: aggregates.autolevels_skew(r, 0.1, 0.1), f"{BASE}, {_SKEW} select p.image_id, y, x, {each('case when hi@ = lo@ then c@ else greatest(0, least(255, trunc((c@ - lo@) * 255 / (hi@ - lo@))::int)) end')} from p join m0 using (image_id) join m1 using (image_id) join m2 using (image_id)")
add("colorcount", lambda r: aggregates.colour_count(r), f"{BASE} select image_id, count(*) as colours from (select distinct image_id, c0, c1, c2 from p) group by 1")
add("colorcount_limit", lambda r: aggregates.colour_count(r, 100), f"{BASE} select image_id, case when count(*) <= 100 then count(*) end as colours from (select distinct image_id, c0, c1, c2 from p) group by 1")
add("colorusagehash_maxcolors", lambda r: aggregates.colour_usage(point.convert(r, "grey").map_all(lambda c: (c / 16).cast("int")), 8), f"{BASE}, gr as (select image_id, trunc(c0 * 0.222::double + c1 * 0.707::double + c2 * 0.071::double)::int // 16 as c0 from p) select image_id, c0, count(*) as n from gr where image_id in (select image_id from gr group by 1 having count(distinct c0) <= 8) group by 1, 2")
add("colorusagehash", lambda r: aggregates.colour_usage(r), f"{BASE} select image_id, c0, c1, c2, count(*) as n from p group by 1, 2, 3, 4")
add("colorusage", lambda r: aggregates.colour_usage_counts(point.convert(r, "grey")).select("image_id", F.concat_ws(",", F.col("counts").cast("array<string>")).alias("counts")), f"{BASE} select image_id, string_agg(n::varchar, ',' order by n) as counts from (select image_id, trunc(c0 * 0.222::double + c1 * 0.707::double + c2 * 0.071::double) as v, count(*) as n from p group by 1, 2) group by 1")
add("count_color", lambda r: aggregates.count_colour(point.convert(r, "grey"), (127,)), f"{BASE} select image_id, sum(case when trunc(c0 * 0.222::double + c1 * 0.707::double + c2 * 0.071::double) = 127 then 1 else 0 end)::bigint as n from p group by 1")
add("histogram", lambda r: aggregates.histogram(r), f"{BASE} select image_id, channel::int as channel, bin, count(*) as n from (select image_id, 0 as channel, c0 as bin from p union all select image_id, 1, c1 from p union all select image_id, 2, c2 from p) group by 1, 2, 3")

# Two stacks

add("paste", lambda r: joins.paste(r, model.turned(r), 10, -5), f"{BASE} select p.image_id, p.y, p.x, {each('coalesce(t.c@, p.c@)')} from p left join t on p.image_id = t.image_id and t.x = p.x - 10 and t.y = p.y + 5")
add("copyto_trans", lambda r: joins.paste_transparent(point.convert(r, "grey"), point.convert(model.turned(r), "grey"), (127,), 3, 4), f"{BASE}, pg as (select image_id, y, x, trunc(c0 * 0.222::double + c1 * 0.707::double + c2 * 0.071::double)::int as c0 from p), tg as (select image_id, y, x, trunc(c0 * 0.222::double + c1 * 0.707::double + c2 * 0.071::double)::int as c0 from t) select pg.image_id, pg.y, pg.x, case when tg.c0 is not null and tg.c0 <> 127 then tg.c0 else pg.c0 end as c0 from pg left join tg on pg.image_id = tg.image_id and tg.x = pg.x - 3 and tg.y = pg.y - 4")
_ON = "on {d}.image_id = ta.image_id and ta.x = {d}.x - 6 and ta.y = {d}.y - 3"
add("rubthrough", lambda r: joins.rubthrough(Raster(r.px.drop("c3"), r.width, r.height, 3), model.turned(r), 6, 3), f"{BASE} select p.image_id, p.y, p.x, {each('case when ta.c0 is null then p.c@ else trunc((ta.c3 * ta.c@ + (255 - ta.c3) * p.c@) / 255)::int end')} from p left join ta {_ON.format(d='p')}", 4)
add("rubthrough_alpha", lambda r: joins.rubthrough(r, model.turned(r), 6, 3), f"{BASE}, j as (select a.*, ta.c0 as s0, ta.c1 as s1, ta.c2 as s2, ta.c3 as sa, ta.c3 + trunc((255 - ta.c3) * a.c3 / 255)::int as da from a left join ta {_ON.format(d='a')}) select image_id, y, x, {each('case when coalesce(sa, 0) = 0 then c@ else least(255, trunc((sa * s@ + trunc((255 - sa) * c@ * c3 / 255)) / da)::int) end')}, case when coalesce(sa, 0) = 0 then c3 else da end as c3 from j", 4)

# each mode over a destination without alpha: d@ and s@ are the colours, a the source's alpha
_PLAIN = {
    "none": "s@", "normal": "case when a = 255 then s@ else trunc((s@ * a + d@ * (255 - a)) / 255) end", "multiply": "trunc((trunc(a * s@ * d@ / 255) + d@ * (255 - a)) / 255)", "add": "least(255, d@ + trunc(s@ * a / 255))", "subtract": "greatest(0, d@ - trunc(s@ * a / 255))",
    "diff": "trunc((s@ * a + d@ * 255 - trunc(2 * least(s@ * a * 255::bigint, d@ * 255::bigint * a) / 255)) / 255)",
    "lighten": "trunc((greatest(s@ * a * 255::bigint, d@ * 255::bigint * a) + (s@ * a + d@ * 255) * 255::bigint - s@ * a * 255::bigint - d@ * 255::bigint * a) / 65025)",
    "darken": "trunc((least(s@ * a * 255::bigint, d@ * 255::bigint * a) + (s@ * a + d@ * 255) * 255::bigint - s@ * a * 255::bigint - d@ * 255::bigint * a) / 65025)",
}
_JOINED = f"j as (select p.image_id, p.y, p.x, p.c0 as d0, p.c1 as d1, p.c2 as d2, ta.c0 as s0, ta.c1 as s1, ta.c2 as s2, ta.c3 as a from p left join ta {_ON.format(d='p')})"


def _hsv_sql(table: str, prefix: str, names: tuple[str, str, str], out: str) -> str:
    """A table with 8-bit HSV figures of three columns added."""
    r, g, b = names
    v, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    hue = f"(case when {r} = {v} then ({v} - {b}) / ({v} - {low})::double - ({v} - {g}) / ({v} - {low})::double when {g} = {v} then 2 + ({v} - {r}) / ({v} - {low})::double - ({v} - {b}) / ({v} - {low})::double else 4 + ({v} - {g}) / ({v} - {low})::double - ({v} - {r}) / ({v} - {low})::double end * 60.0::double)"
    return f"{out} as (select *, case when {v} > {low} then trunc((case when {hue} < 0 then {hue} + 360 else {hue} end) * 255 / 360)::int else 0 end as {prefix}h, case when {v} = 0 then 0 else trunc(({v} - {low}) * 255 / {v})::int end as {prefix}s, {v} as {prefix}v from {table})"


def _rgb_sql(h: str, s: str, v: str) -> list[str]:
    hh = f"({h} / 255 * 6)"
    i, f = f"trunc({hh})::int", f"({hh} - trunc({hh}))"
    m, n, k = (f"trunc(0.5::double + {v} * (255 - {x}) / 255)::int" for x in (f"{s}::double", f"{s} * {f}", f"{s} * (1 - {f})"))
    rows = ([v, n, m, m, k, v, "0"], [k, v, v, n, m, m, "0"], [m, m, k, v, v, n, "0"])
    return [f"case when {s} = 0 then {v} else case {i} " + " ".join(f"when {q} then {c}" for q, c in enumerate(row)) + " end end" for row in rows]


_HSV = f"{_hsv_sql('j', 's', ('s0', 's1', 's2'), 'j1')}, {_hsv_sql('j1', 'd', ('d0', 'd1', 'd2'), 'j2')}"
_TAKES = {"saturation": ("dh", "ss", "dv"), "value": ("dh", "ds", "sv"), "color": ("sh", "ss", "dv")}


def _plain_mode_sql(mode: str) -> str:
    if mode in _PLAIN:
        zero = "d@" if mode != "none" else "s@"
        return f"{BASE}, {_JOINED} select image_id, y, x, {each(f'case when a is null then d@ when a = 0 then {zero} else ({_PLAIN[mode]})::int end')} from j"
    if mode == "hue":
        made, alpha = [f"case when ss <> 0 and a <> 0 and ds <> 0 then {c} else {d} end" for c, d in zip(_rgb_sql("sh", "ds", "dv"), ("dh", "ds", "dv"), strict=True)], "case when ss <> 0 and a <> 0 and ds <> 0 then a else 0 end"
    else:
        made, alpha = _rgb_sql(*_TAKES[mode]), "a"
    blend = ", ".join(f"case when a is null then d{k} when ea = 0 then d{k} when ea = 255 then m{k} else trunc((m{k} * ea + d{k} * (255 - ea)) / 255)::int end as c{k}" for k in range(3))
    return f"{BASE}, {_JOINED}, {_HSV}, j3 as (select *, {', '.join(f'{c} as m{k}' for k, c in enumerate(made))}, {alpha} as ea from j2) select image_id, y, x, {blend} from j3"


def _compose(mode: str, opacity: float = 1.0):
    return lambda r: joins.compose(Raster(r.px.drop("c3"), r.width, r.height, 3), model.turned(r), 6, 3, mode, opacity)


for _mode in MODES:
    add(f"compose_{_mode}", _compose(_mode), None if _mode == "dissolve" else _plain_mode_sql(_mode), 4)

# each mode over a destination with alpha: da is its alpha, n the new one
_ALPHA = {
    "normal": ("a + trunc((255 - a) * da / 255)::int", "case when a = 255 then s@ else trunc((a * s@ + trunc((255 - a) * d@ * da / 255)) / n)::int end"),
    "multiply": ("a + da - trunc(a * da / 255)::int", "trunc(trunc((trunc(s@ * a * d@ / 255) * da + s@ * a * (255 - da) + d@ * da * (255 - a)) / 255) / n)::int"),
    "add": ("least(255, a + da)", "least(255, trunc((d@ * da + s@ * a) / n)::int)"), "subtract": ("least(255, a + da)", "greatest(0, trunc((d@ * da - s@ * a) / n)::int)"),
    "diff": ("a + da - trunc(a * da / 255)::int", "trunc((s@ * a + d@ * da - trunc(2 * least(s@ * a * da::bigint, d@ * da * a::bigint) / 255)) / n)::int"),
    "lighten": ("a + da - trunc(a * da / 255)::int", "trunc((greatest(s@ * a * da::bigint, d@ * da * a::bigint) + (s@ * a + d@ * da) * 255::bigint - s@ * a * da::bigint - d@ * da * a::bigint) / (255 * n))::int"),
    "darken": ("a + da - trunc(a * da / 255)::int", "trunc((least(s@ * a * da::bigint, d@ * da * a::bigint) + (s@ * a + d@ * da) * 255::bigint - s@ * a * da::bigint - d@ * da * a::bigint) / (255 * n))::int"),
}
_JOINED_A = f"j as (select a.image_id, a.y, a.x, a.c0 as d0, a.c1 as d1, a.c2 as d2, a.c3 as da, ta.c0 as s0, ta.c1 as s1, ta.c2 as s2, ta.c3 as a from a left join ta {_ON.format(d='a')})"
for _mode, (_n, _c) in _ALPHA.items():
    add(f"compose_alpha_{_mode}", lambda r, m=_mode: joins.compose(r, model.turned(r), 6, 3, m), f"{BASE}, {_JOINED_A}, k as (select *, {_n} as n from j) select image_id, y, x, {each(f'case when coalesce(a, 0) = 0 then d@ else {_c} end')}, case when coalesce(a, 0) = 0 then da else n end as c3 from k", 4)
add("compose_opacity", _compose("normal", 0.5), f"{BASE}, {_JOINED}, o as (select * replace (trunc(a * 128 / 255)::int as a) from j) select image_id, y, x, {each('case when a is null then d@ when a = 255 then s@ else trunc((s@ * a + d@ * (255 - a)) / 255)::int end')} from o", 4)
add("compose_mask", lambda r: joins.compose(Raster(r.px.drop("c3"), 64, 50, 3), model.turned(r), 0, 0, "normal", 1.0, mask=point.convert(r, "alpha")), f"{BASE}, j as (select p.image_id, p.y, p.x, p.c0 as d0, p.c1 as d1, p.c2 as d2, ta.c0 as s0, ta.c1 as s1, ta.c2 as s2, case when a.c3 = 255 then ta.c3 else trunc(ta.c3 * a.c3 / 255)::int end as a from p join ta using (image_id, y, x) join a using (image_id, y, x)) select image_id, y, x, {each('case when a = 255 then s@ else trunc((s@ * a + d@ * (255 - a)) / 255)::int end')} from j", 4)
add("watermark", lambda r: joins.watermark(r, model.turned(r), 10, 10, 40), f"{BASE} select p.image_id, p.y, p.x, {each('case when t.c0 is null then p.c@ else greatest(0, least(255, p.c@ + trunc((t.c0 - 128) * 40 / 128)::int)) end')} from p left join t on p.image_id = t.image_id and t.x = p.x - 10 and t.y = p.y - 10")
add("difference", lambda r: joins.difference(r, model.turned(r), 10), f"{BASE}, j as (select p.*, t.c0 as s0, t.c1 as s1, t.c2 as s2, abs(t.c0 - p.c0) > 10 or abs(t.c1 - p.c1) > 10 or abs(t.c2 - p.c2) > 10 as d from p join t using (image_id, y, x)) select image_id, y, x, {each('case when d then s@ else 0 end')}, case when d then 255 else 0 end as c3 from j")
add("rgb_difference", lambda r: joins.rgb_difference(r, model.turned(r)), f"{BASE} select image_id, y, x, {each('abs(p.c@ - t.c@)')} from p join t using (image_id, y, x)")
add("combine_channels", lambda r: joins.combine_channels([(r, 2), (model.turned(r), 0), (r, 1)]), f"{BASE} select image_id, y, x, p.c2 as c0, t.c0 as c1, p.c1 as c2 from p join t using (image_id, y, x)")
add("img_diff", lambda r: joins.img_diff(r, model.turned(r)), f"{BASE} select image_id, sum((p.c0 - t.c0) * (p.c0 - t.c0) + (p.c1 - t.c1) * (p.c1 - t.c1) + (p.c2 - t.c2) * (p.c2 - t.c2))::double as distance from p join t using (image_id, y, x) group by 1")
add("img_samef", lambda r: joins.img_same(r, r.project({"c1": F.col("c1") + (F.col("image_id") % 2).cast("int") * 2}), 1), f"{BASE} select image_id, image_id % 2 = 0 as same from p group by 1")
add("setpixel", lambda r: joins.set_pixels(r, r.px.where("x % 9 = 0 and y % 5 = 0").select(*KEYS, F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).select("*", (F.col("seq") * 10).alias("c0"), F.lit(7).alias("c1"), F.col("x").alias("c2"))), select("case when x % 9 = 0 and y % 5 = 0 then 20 else c0 end as c0, case when x % 9 = 0 and y % 5 = 0 then 7 else c1 end as c1, case when x % 9 = 0 and y % 5 = 0 then x else c2 end as c2"))
add("getpixel", lambda r: joins.get_pixels(r, r.px.where("x < 3 and y < 3").select("image_id", (F.col("y") * 20).alias("y"), (F.col("x") * 40).alias("x"))), f"{BASE}, q as (select image_id, y * 20 as y, x * 40 as x from p where x < 3 and y < 3) select q.image_id, q.y, q.x, c0, c1, c2 from q left join p using (image_id, y, x)")
add("getscanline", lambda r: joins.get_scanline(r, 7, 3, 21), f"{BASE} select image_id, y, x, c0, c1, c2 from p where y = 7 and x between 3 and 20")
add("getsamples", lambda r: joins.get_samples(r, 2, [2, 0, 2]), f"{BASE} select image_id, y, x, c2 as s0, c0 as s1, c2 as s2 from p where y = 2")
add("masked_update", lambda r: joins.masked_update(Raster(r.px.drop("c3"), 64, 50, 3), Raster(model.turned(r).px.drop("c3"), 64, 50, 3), point.convert(r, "alpha"), 8, 8), f"{BASE} select p.image_id, p.y, p.x, {each('case when t.c0 is not null and coalesce(a.c3, 0) <> 0 then t.c@ else p.c@ end')} from p left join t on p.image_id = t.image_id and t.x = p.x - 8 and t.y = p.y - 8 left join a on p.image_id = a.image_id and a.x = p.x - 8 and a.y = p.y - 8", 4)

# Colour figures

add("rgb_to_hsv", lambda r: r.px.select(*KEYS, *(c.alias(n) for c, n in zip(samples.rgb_to_hsv8(F.col("c0"), F.col("c1"), F.col("c2")), ("h", "s", "v"), strict=True))), f"{BASE}, {_hsv_sql('p', '', ('c0', 'c1', 'c2'), 'q')} select image_id, y, x, h, s, v from q")
add("hsv_to_rgb", lambda r: r.project(dict(zip(r.names, samples.hsv_to_rgb8(F.col("c0"), F.col("c1"), F.col("c2")), strict=True))), select(", ".join(f"({c})::int as c{k}" for k, c in enumerate(_rgb_sql("c0", "c1", "c2")))))

# Pixel expressions: an operator's value, cut to a sample, is red; green and blue hold the place

_CUT = "greatest(0, least(255, trunc({})::int))"
_OPS = {
    "add": ("@r x +", "c0 + x"), "subtract": ("@r x -", "c0 - x"), "mult": ("@r 0.5 *", "c0 * 0.5::double"), "div": ("@r x 1 + /", "c0 / (x + 1)::double"), "mod": ("@r 7 x + %", "c0 % (x + 7)"), "pow": ("@r 16 / 2 **", "(c0 / 16) ** 2"), "uminus": ("@r uminus 255 +", "255 - c0"),
    "sin": ("x 7 / sin 100 * 128.5 +", "sin(x * (1.0::double / 7)) * 100 + 128.5::double"), "cos": ("x 7 / cos 100 * 128.5 +", "cos(x * (1.0::double / 7)) * 100 + 128.5::double"), "atan2": ("@r @g atan2 100 *", "atan2(c0, c1) * 100"), "sqrt": ("@r 0.3 + sqrt 9 *", "sqrt(c0 + 0.3::double) * 9"), "distance": ("x y 5.3 7.1 distance 3 *", "sqrt((x - 5.3::double) * (x - 5.3::double) + (y - 7.1::double) * (y - 7.1::double)) * 3"),
    "value": ("@p value 254.5 *", "greatest(c0, c1, c2) / 255 * 254.5::double"), "sat": ("@p sat 254.9 *", "case when greatest(c0, c1, c2) = 0 then 0 else (greatest(c0, c1, c2) - least(c0, c1, c2)) / greatest(c0, c1, c2)::double * 254.9::double end"),
    "red": ("@p red", "c0"), "green": ("@p green", "c1"), "blue": ("@p blue", "c2"), "alpha": ("@p alpha", "255"), "int": ("@r 7 / int", "trunc(c0 * (1.0::double / 7) + 0.0)"), "if": ("x 30 gt @r @g if", "case when x > 30 then c0 else c1 end"), "le": ("@r @g le 200 *", "case when c0 <= c1 + (c0 + c1) * 0.001::double then 200 else 0 end"), "lt": ("@r @g lt 200 *", "case when c0 < c1 then 200 else 0 end"),
    "ge": ("@r @g ge 200 *", "case when c0 >= c1 - (c0 + c1) * 0.001::double then 200 else 0 end"), "gt": ("@r @g gt 200 *", "case when c0 > c1 then 200 else 0 end"), "eq": ("@r @g eq 200 *", "case when abs(c0 - c1) <= (c0 + c1) * 0.001::double then 200 else 0 end"), "ne": ("@r @g ne 200 *", "case when abs(c0 - c1) > (c0 + c1) * 0.001::double then 200 else 0 end"),
    "and": ("x 10 gt y 10 gt and 90 *", "case when x > 10 and y > 10 then 90 else 0 end"), "or": ("x 10 gt y 10 gt or 90 *", "case when x > 10 or y > 10 then 90 else 0 end"), "not": ("x 10 gt not 90 *", "case when x > 10 then 0 else 90 end"), "abs": ("@r @g - abs", "abs(c0 - c1)"), "log": ("@r 1.5 + log 40 *", "ln(c0 + 1.5::double) * 40"), "exp": ("@r 60 / exp 10 *", "exp(c0 * (1.0::double / 60)) * 10"), "det": ("x y 2 3 det 100 +", "x * 3 - y * 2 + 100"), "set": ("@r set", "c0"),
}
_OPS["div"] = ("@r x 1 + div", "c0 / (x + 1)::double")
for _op in ("sin", "cos", "int", "exp"):
    _OPS[_op] = (_OPS[_op][0], _OPS[_op][1].replace("x * (1.0::double / 7)", "x / 7::double").replace("c0 * (1.0::double / 7) + 0.0", "c0 / 7::double").replace("c0 * (1.0::double / 60)", "c0 / 60::double"))


def _expr(text: str, **more):
    return lambda r: expression.transform2([r], postfix=text, **more)


for _op, (_rpn, _value) in _OPS.items():
    add(f"transform2_{_op}", _expr(f"x y getp1 !p @p red !r @p green !g {_rpn} y x rgb"), select(f"{_CUT.format(_value)} as c0, y as c1, x as c2"))
add("transform2_rgba", _expr("x y getp1 !p @p red @p green @p blue x 4 * rgba", channels=4), select("c0, c1, c2, least(255, x * 4) as c3"))
add("transform2_addp", _expr("x y getp1 x y 3 rgb +"), select("least(255, c0 + x) as c0, least(255, c1 + y) as c1, least(255, c2 + 3) as c2"))
add("transform2_subtractp", _expr("x y getp1 x y 3 rgb -"), select("greatest(0, c0 - x) as c0, greatest(0, c1 - y) as c1, greatest(0, c2 - 3) as c2"))
add("transform2_multp", _expr("x y getp1 1.5 *"), select(each("least(255, trunc(c@ * 1.5::double)::int)")))
add("transform2_ifp", _expr("x y gt x y getp1 y x 9 rgb ifp"), select("case when x > y then c0 else y end as c0, case when x > y then c1 else x end as c1, case when x > y then c2 else 9 end as c2"))
add("transform2_hue", _expr("x y getp1 hue 2 / y x rgb"), f"{BASE}, q as (select *, greatest(c0, c1, c2) as v, least(c0, c1, c2) as l from p), h as (select *, case when v = l then 0 else (case when c0 = v then (v - c2) / (v - l)::double - (v - c1) / (v - l)::double when c1 = v then 2 + (v - c0) / (v - l)::double - (v - c2) / (v - l)::double else 4 + (v - c1) / (v - l)::double - (v - c0) / (v - l)::double end) * 60 end as h from q) select image_id, y, x, greatest(0, least(255, trunc((case when h < 0 then h + 360 else h end) / 2)::int)) as c0, y as c1, x as c2 from h")
add("transform2_hsv", _expr("x 5 * 0.5 y 50 / hsv"), f"{BASE}, h as (select image_id, y, x, x * 5 / 60::double as hh, y / 50::double * 255 as v from p), f as (select *, trunc(hh)::int as i, hh - trunc(hh) as f, v * 0.5::double as m from h), k as (select *, v * (1 - 0.5::double * f) as n, v * (1 - 0.5::double * (1 - f)) as k from f) select image_id, y, x, trunc(case i when 0 then v when 1 then n when 2 then m when 3 then m when 4 then k else v end)::int as c0, trunc(case i when 0 then k when 1 then v when 2 then v when 3 then n when 4 then m else m end)::int as c1, trunc(case i when 0 then m when 1 then m when 2 then k when 3 then v when 4 then v else n end)::int as c2 from k")
add("transform2_getp1", _expr("x 3 + y 2 - getp1"), f"{BASE} select o.image_id, o.y, o.x, {each('coalesce(q.c@, 0)')} from p o left join p q on q.image_id = o.image_id and q.x = o.x + 3 and q.y = o.y - 2")
add("transform2_getp2", lambda r: expression.transform2([r, model.turned(r)], infix="a = getp1(x, y); b = getp2(y, x); return if(x > y, a, b);".replace("if(x", "ifp(x")), f"{BASE} select o.image_id, o.y, o.x, {each('case when o.x > o.y then o.c@ else coalesce(q.c@, 0) end')} from p o left join t q on q.image_id = o.image_id and q.x = o.y and q.y = o.x")
add("transform2_getp3", lambda r: expression.transform2([r, r, model.turned(r)], infix="return getp3(x, y) * 0.5 + getp1(x, y);"), f"{BASE} select image_id, y, x, {each('least(255, trunc(t.c@ * 0.5::double)::int + p.c@)')} from p join t using (image_id, y, x)")
add("transform2_infix", lambda r: expression.transform2([r], infix="# a comment\np = getp1(x, y);\nv = (red(p) + green(p) * 2) / 4 - -x ** 2 / 100;\nreturn rgb(v, 255 - y, x);"), select(f"{_CUT.format('(c0 + c1 * 2) / 4 + (x ** 2) / 100')} as c0, 255 - y as c1, x as c2"))
for _name in expression.CANNED:
    add(f"transform2_{_name}", lambda r, n=_name: expression.canned(n, r))

# Fills and drawing


def _fill_sql(v: str, repeat: str = "none") -> str:
    w = {"none": f"least(1, greatest(0, {v}))", "sawtooth": f"case when {v} < 0 then 0 else {v} % 1 end", "triangle": f"case when {v} < 0 then 0 when {v} % 2 > 1 then 2 - {v} % 2 else {v} % 2 end", "saw_both": f"({v} - floor({v}))", "tri_both": f"case when {v} - 2 * floor({v} / 2) > 1 then 2 - ({v} - 2 * floor({v} / 2)) else {v} - 2 * floor({v} / 2) end"}[repeat]
    return select(", ".join(f"greatest(0, least(255, trunc((({a}::double + ({b}::double - {a}::double) * w)) * 255 + 0.5)::int)) as c{k}" for k, (a, b) in enumerate(((0.1, 0.9), (0.8, 0.2), (0.0, 1.0)))) + ", 255 as c3", "f", f"f as (select *, {w} as w from (select *, ({v})::double as vv from p))")


_SEG = [fills.Segment(c0=(0.1, 0.8, 0.0, 1.0), c1=(0.9, 0.2, 1.0, 1.0))]
_SHAPES = {
    "linear": "((x - 5) * 40 + (y - 3) * 30) / 2500::double", "bilinear": "abs((x - 5) * 40 + (y - 3) * 30) / 2500::double", "radial": "sqrt(((x - 5) * (x - 5) + (y - 3) * (y - 3))::double) / 50", "radial_square": "greatest(abs((x - 5) * 0.8::double + (y - 3) * 0.6::double), abs((y - 3) * 0.8::double - (x - 5) * 0.6::double)) / 50",
}
for _shape, _v in _SHAPES.items():
    add(f"fountain_{_shape}", lambda r, s=_shape: fills.fountain(r, 5, 3, 45, 33, s, "none", _SEG), _fill_sql(_v))
for _repeat in ("sawtooth", "triangle", "saw_both", "tri_both"):
    add(f"fountain_linear_{_repeat}", lambda r, k=_repeat: fills.fountain(r, 21, 17, 33, 26, "linear", k, _SEG), _fill_sql("((x - 21) * 12 + (y - 17) * 9) / 225::double", _repeat))
for _shape in ("revolution", "conical"):
    add(f"fountain_{_shape}", lambda r, s=_shape: fills.fountain(r, 5, 3, 45, 33, s, "none", _SEG))
_WORK = "case when v < 0.3 then (v - 0.0::double) / 0.3::double / 2 else 0.5::double + (v - 0.3::double) / 0.7::double / 2 end"
_CURVES = {"linear": "w", "sphereup": "sqrt(1.0::double - (1 - w) * (1 - w))", "spheredown": "1 - sqrt(1.0::double - w * w)"}


def _curve_sql(curve: str) -> str:
    return select(", ".join(f"greatest(0, least(255, trunc(t * 255 + 0.5)::int)) as c{k}" for k in range(3)) + ", 255 as c3", "t", f"l as (select image_id, y, x, least(1, greatest(0, (x * 63::double + y * 49::double) / 6370::double)) as v from p), w as (select *, {_WORK} as w from l), t as (select image_id, y, x, {_CURVES[curve]} as t from w)".replace("t as (", "curved as (")).replace("from t", "from curved") if curve in _CURVES else None


for _curve in ("linear", "sine", "sphereup", "spheredown"):
    add(f"fountain_curve_{_curve}", lambda r, c=_curve: fills.fountain(r, 0, 0, 63, 49, "linear", "none", [fills.Segment(curve=c, middle=0.3)]), _curve_sql(_curve))
for _colour in ("hueup", "huedown"):
    add(f"fountain_colour_{_colour}", lambda r, c=_colour: fills.fountain(r, 0, 0, 63, 0, "linear", "none", [fills.Segment(c0=(1.0, 0.2, 0.1, 1.0), c1=(0.1, 0.3, 1.0, 1.0), colour=c)]))
_BITS = lambda rows, dx=0, dy=0: f"(list_value({', '.join(map(str, rows))}))[(y + {dy}) % 8 + 1] // (list_value(128, 64, 32, 16, 8, 4, 2, 1))[(x + {dx}) % 8 + 1] % 2 = 1"
for _name, _on in (("check2x2", "((x + 1) // 2) % 2 = (y // 2) % 2"), ("vline2", "(x + 1) % 4 = 3"), ("slash1", "(x + 1 + y) % 8 = 7"), ("slosh2", "(x + 1) % 4 = y % 4"), ("grid4", "(x + 1) % 2 = 0 or y % 2 = 0"), ("dots4", "(x + 1) % 4 = 0 and y % 4 = 0"), ("weave", _BITS((0x55, 0xFD, 0x05, 0xFD, 0x55, 0xDF, 0x50, 0xDF), 1)), ("tile_L", _BITS((0xFF, 0x84, 0x84, 0x9C, 0x94, 0x9C, 0x90, 0x90), 1))):
    add("hatch" if _name == "check2x2" else f"hatch_{_name}", lambda r, n=_name: fills.hatch(r, n, (1, 2, 3), (9, 8, 7), 1, 0), select(", ".join(f"case when {_on} then {a} else {b} end as c{k}" for k, (a, b) in enumerate(((1, 9), (2, 8), (3, 7))))))
add("image_fill", lambda r: fills.image_fill(r, geometry.crop(r, width=10, height=8, left=0, top=0), 3, 0), f"{BASE} select o.image_id, o.y, o.x, {each('q.c@')} from p o join p q on q.image_id = o.image_id and q.x = (o.x + (o.y // 8) * 3) % 10 and q.y = o.y % 8")
add("opacity_fill", lambda r: fills.opacity_fill(Raster(r.px.drop("c3"), 64, 50, 3), model.turned(r), 0.5), f"{BASE}, j as (select p.*, t.c0 as s0, t.c1 as s1, t.c2 as s2, trunc(t.c3 * 0.5::double + 0.5)::int as a from p join ta t using (image_id, y, x)) select image_id, y, x, {each('case when a = 0 then c@ else trunc((s@ * a + c@ * (255 - a)) / 255)::int end')} from j", 4)
add("solid_fill", lambda r: fills.solid(r, (1, 2, 3, 255)), select("1 as c0, 2 as c1, 3 as c2"))
_POINTS, _TINTS = [(0, 0), (63, 10), (20, 49)], [(255, 0, 0), (0, 255, 30), (10, 20, 255)]
_APART = ", ".join(f"sqrt((x - {a}::double) * (x - {a}::double) + (y - {b}::double) * (y - {b}::double)) as d{k}" for k, (a, b) in enumerate(_POINTS))
add("gradgen", lambda r: fills.gradgen(r, _POINTS, _TINTS), select(", ".join("greatest(0, least(255, " + " + ".join(f"trunc({float(c[k])}::double * ((d0 + d1 + d2 - d{j}) / (d0 + d1 + d2) / 2.0::double))::int" for j, c in enumerate(_TINTS)) + f")) as c{k}" for k in range(3)), "d", f"d as (select *, {_APART} from p)"))
add("nearest_color", lambda r: fills.nearest_colour(r, [(5, 5), (50, 10), (30, 40)], 1), f"{BASE}, d as (select *, (x - 5) ** 2 + (y - 5) ** 2 as d0, (x - 50) ** 2 + (y - 10) ** 2 as d1, (x - 30) ** 2 + (y - 40) ** 2 as d2 from p), o as (select *, case when d0 <= d1 and d0 <= d2 then 0 when d1 <= d2 then 1 else 2 end as o from d) select image_id, y, x, {each('trunc(avg(c@) over (partition by image_id, o))::int')} from o")
add("box", lambda r: draw.box(r, 4, 5, 40, 30, (9, 8, 7)), select(", ".join(f"case when x between 4 and 40 and y between 5 and 30 and (x in (4, 40) or y in (5, 30)) then {v} else c{k} end as c{k}" for k, v in enumerate((9, 8, 7)))))
add("box_filled", lambda r: draw.box_filled(r, -4, 5, 40, 99, (9, 8, 7)), select(", ".join(f"case when x <= 40 and y >= 5 then {v} else c{k} end as c{k}" for k, v in enumerate((9, 8, 7)))))
add("box_fill", lambda r: draw.box_fill(r, 10, 10, 30, 30, model.turned(r)), f"{BASE} select p.image_id, p.y, p.x, {each('case when p.x between 10 and 30 and p.y between 10 and 30 then t.c@ else p.c@ end')} from p join t using (image_id, y, x)")
def _line_sql(y: str, low: int, high: int, axes: tuple[str, str] = ("x", "y")) -> str:
    return select(", ".join(f"case when {axes[0]} between {low} and {high} and {axes[1]} = {y} then {k + 1} else c{k} end as c{k}" for k in range(3)))


add("line", lambda r: draw.line(r, 2, 3, 60, 40, (1, 2, 3)), _line_sql("3 + (2 * 37 * (x - 2) + 58) // 116", 2, 60))
add("line_rising", lambda r: draw.line(r, 0, 10, 8, 6, (1, 2, 3)), _line_sql("10 - (2 * 4 * x + 8) // 16", 0, 8))
add("line_steep", lambda r: draw.line(r, 30, 45, 9, 3, (1, 2, 3), endpoint=False), _line_sql("9 + (2 * 21 * (y - 3) + 42) // 84", 3, 44, ("y", "x")))
add("line_dda", lambda r: draw.line_dda(r, 3, 5, 60, 41, (1, 2, 3)), _line_sql("trunc(5::double + (x - 3) / 57::double * 36 + 0.5)::int", 3, 60))
_DONE, _TOWARD = "31 * (x - 6) // 50", "(50 * (31 * (x - 6) // 50 + 1) - 31 * (x - 5)) / 50::double"
add("line_aa", lambda r: draw.line_aa(r, 5, 4, 55, 35, (200, 100, 50)), select(", ".join(f"case when (x = 5 and y = 4) or (x = 55 and y = 35) then {v} when x between 6 and 54 and y = 4 + {_DONE} then trunc((1 - t) * c{k} + t * {v})::int when x between 6 and 54 and y = 5 + {_DONE} then trunc(t * c{k} + (1 - t) * {v})::int else c{k} end as c{k}" for k, v in enumerate((200, 100, 50))), "l", f"l as (select *, greatest(0, {_TOWARD})::float::double as t from p)"))


def _sector_sql(cx: int, cy: int, radius: int, pies: list[tuple[float, float]]) -> str:
    """A table s (y, low, high): for each pie and row the least and largest of the rounded places on its rim, at every
    hundredth of a degree, and on its two radii, a place for each step of the longer axis."""
    angles = ", ".join(f"({k}, {d}::double, {a}::double, {b}::double)" for k, (a, b) in enumerate(pies) for d in (a, b))
    place = lambda d: f"trunc({cx} + 0.5::double + {radius} * cos({d} * pi() / 180))::int as x, trunc({cy} + 0.5::double + {radius} * sin({d} * pi() / 180))::int as y"
    return f"""v as (select * from (values {angles}) v(part, d, a, b)), rim as (select part, {place('d')} from (select distinct part, a + k * 0.01::double as d, b from v, (select unnest(range(36102)) as k)) where d <= b),
sp as (select part, x, y, abs(y - {cy}) <= abs(x - {cx}) and x <> {cx} as flat from (select part, {place('d')} from v)),
sq as (select part, flat, case when flat then least({cx}, x) else least({cy}, y) end as a1, case when flat then greatest({cx}, x) else greatest({cy}, y) end as a2, case when flat and {cx} <= x or not flat and {cy} > y then (case when flat then {cy} else x end) when flat then y else {cx} end as b1, case when flat then (y - {cy}) / (x - {cx})::double else coalesce((x - {cx}) / nullif(y - {cy}, 0)::double, 0) end as g from sp),
sr as (select part, flat, a1 + k as u, trunc(b1 + k * g + 0.5::double)::int as w from sq, (select unnest(range({radius + 2})) as k) where a1 + k <= a2),
s as (select part, y, min(x) as low, max(x) as high from (select part, x, y from rim union all select part, case when flat then u else w end, case when flat then w else u end from sr) group by 1, 2)"""


def _painted(where: str, more: str) -> str:
    return select(", ".join(f"case when {where} then {k + 1} else c{k} end as c{k}" for k in range(3)), "p", more)


_IN_SECTOR = "exists (select 1 from s where s.y = p.y and p.x between s.low and s.high)"
add("circle", lambda r: draw.circle(r, 30, 25, 12, (1, 2, 3)), _painted(_IN_SECTOR, _sector_sql(30, 25, 12, [(0, 361)])))
add("circle_clipped", lambda r: draw.circle(r, 52, 30, 27, (1, 2, 3)), _painted(_IN_SECTOR, _sector_sql(52, 30, 27, [(0, 361)])))
add("arc", lambda r: draw.arc(r, 30, 25, 15, 300, 60, (1, 2, 3)), _painted(_IN_SECTOR, _sector_sql(30, 25, 15, [(300, 360), (0, 60)])))
add("arc_wide", lambda r: draw.arc(r, 28, 24, 19, 35, 250, (1, 2, 3)), _painted(_IN_SECTOR, _sector_sql(28, 24, 19, [(35, 250)])))


def _outline_sql(cx: int, cy: int, radius: int, low: int = 0, high: int | None = None) -> str:
    """The eighth of a circle that keeps the error of x * x + y * y small, step by step, and its seven images; of a place's way
    round, 8 * (radius + 1) long, a part."""
    n = radius + 1
    images = [("a", "b", "b"), ("b", "a", f"{2 * n} - b"), ("-b", "a", f"{2 * n} + b"), ("-a", "b", f"{4 * n} - b"), ("-a", "-b", f"{4 * n} + b"), ("-b", "-a", f"{6 * n} - b"), ("b", "-a", f"{6 * n} + b"), ("a", "-b", f"{8 * n} - b")]
    eighths = " union all ".join(f"select {x} as dx, {y} as dy, {w} as way from st" for x, y, w in images)
    axes = ", ".join(f"({x * radius}, {y * radius}, {k * n})" for x, y, k in ((1, 0, 0), (0, 1, 2), (-1, 0, 4), (0, -1, 6)))
    steps = f"st as (select {radius} as a, 0 as b, {1 - radius} as e union all select a - (e >= 0)::int, b + 1, e - case when e >= 0 then 2 * (a - 1) else 0 end + 2 * (b + 1) + 1 from st where b < a)"
    rim = f"rim as (select distinct {cx} + dx as x, {cy} + dy as y from (select dx, dy, way from ({eighths}) where way not in (0, {2 * n}, {4 * n}, {6 * n}, {8 * n}) union all select * from (values {axes}) t(dx, dy, way)) where way between {low} and {8 * n if high is None else high})"
    return _painted("exists (select 1 from rim where rim.x = p.x and rim.y = p.y)", f"{steps}, {rim}").replace("with e as", "with recursive e as", 1)


add("circle_outline", lambda r: draw.circle(r, 30, 25, 12, (1, 2, 3), filled=False), _outline_sql(30, 25, 12))
add("circle_outline_clipped", lambda r: draw.circle(r, 40, 20, 23, (1, 2, 3), filled=False), _outline_sql(40, 20, 23))
# the way to 44 degrees, and to 226, which is 46 before the fourth quarter's end: quarters and a sine
add("arc_outline", lambda r: draw.arc_outline(r, 30, 25, 19, 44, 226, (1, 2, 3)), _outline_sql(30, 25, 19, int(20 * 0.6946583704589973), int(20 * (6 - 0.6946583704589973))))
add("circle_outline_aa", lambda r: draw.circle(r, 30, 25, 12, (200, 100, 50), filled=False, soft=True))
add("arc_outline_aa", lambda r: draw.arc_outline(r, 30, 25, 20, 200, 80, (200, 100, 50, 255), soft=True), None, 4)

_BRIGHT = "case when c0 >= 150 then 2 when c0 >= 105 then 1 else 0 end"


def _levels(r: Raster) -> Raster:
    return r.project({"c0": F.when(F.col("c0") >= 150, 2).when(F.col("c0") >= 105, 1).otherwise(0)}, channels=1)


def _bright_spans(r: Raster):
    """Spans of bright runs, and the same ones moved to the right by two."""
    found = spans.runs(_levels(r)).where("c0 = 2").select("image_id", "y", "x1", "x2")
    return found.unionByName(found.select("image_id", "y", (F.col("x1") + 2).alias("x1"), (F.col("x2") + 2).alias("x2")))


_RUNS = f"lv as (select image_id, y, x, {_BRIGHT} as c0 from p), nw as (select *, case when c0 = lag(c0) over (partition by image_id, y order by x) then 0 else 1 end as n from lv), ru as (select image_id, y, min(x) as x1, max(x) + 1 as x2, c0 from (select *, sum(n) over (partition by image_id, y order by x) as run from nw) group by image_id, y, run, c0)"
_ISLANDS = f"{_RUNS}, br as (select image_id, y, x1, x2 from ru where c0 = 2 union all select image_id, y, x1 + 2, x2 + 2 from ru where c0 = 2), gp as (select *, case when x1 <= max(x2) over (partition by image_id, y order by x1, x2 rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from br), il as (select image_id, y, min(x1) as x1, max(x2) as x2 from (select *, sum(n) over (partition by image_id, y order by x1, x2 rows unbounded preceding) as k from gp) group by image_id, y, k)"
add("row_runs", lambda r: spans.runs(_levels(r)), f"{BASE}, {_RUNS} select image_id, y, x1, x2, c0 from ru")
add("span_union", lambda r: spans.union(_bright_spans(r)), f"{BASE}, {_ISLANDS} select image_id, y, x1, x2 from il")
add("span_fill", lambda r: spans.paint(r, _bright_spans(r), (9, F.col("c2"), 7)), select("case when b then 9 else c0 end as c0, case when b then c2 else c1 end as c1, case when b then 7 else c2 end as c2", "q", f"{_ISLANDS}, q as (select p.*, il.x1 is not null as b from p left join il on il.image_id = p.image_id and il.y = p.y and p.x >= il.x1 and p.x < il.x2)"))
_REACH = [f"case when (y + {(s + 1) / 16 - 25.5}::double) ** 2 < 81 then sqrt(81::double - (y + {(s + 1) / 16 - 25.5}::double) * (y + {(s + 1) / 16 - 25.5}::double)) end" for s in range(16)]
_HITS = " + ".join(f"case when {h} is null then 0 else greatest(0, least(trunc(0.5::double + (30.5::double + {h}) * 16)::int, x * 16 + 16) - greatest(trunc(0.5::double + (30.5::double - {h}) * 16)::int, x * 16)) end" for h in _REACH)
add("circle_aa", lambda r: draw.circle_aa(r, 30.5, 25.5, 9.0, (200, 100, 50)), select(", ".join(f"trunc((c{k} * (255 - s) + {v} * s) / 255)::int as c{k}" for k, v in enumerate((200, 100, 50))), "q", f"q as (select *, case when y between 16 and 34 then ({_HITS}) * 255 // 256 else 0 end as s from p)"))
_RINGS = [[(5, 5), (55, 10), (40, 45), (10, 40)], [(20, 15), (35, 15), (35, 30), (20, 30)]]


def _crossings(rings: list[list[tuple[int, int]]], signed: bool) -> str:
    """How often a ray to the right of a pixel's middle crosses the rings."""
    sides = [(a, b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if a[1] != b[1]]
    return " + ".join(f"case when y + 0.5::double >= {min(a[1], b[1])} and y + 0.5::double < {max(a[1], b[1])} and x + 0.5::double < {float(a[0])}::double + (y + 0.5::double - {float(a[1])}::double) * {(b[0] - a[0]) / (b[1] - a[1])!r}::double then {1 if b[1] > a[1] or not signed else -1} else 0 end" for a, b in sides)


add("polygon", lambda r: draw.polygon(r, _RINGS, (1, 2, 3)), select(", ".join(f"case when n % 2 <> 0 then {k + 1} else c{k} end as c{k}" for k in range(3)), "q", f"q as (select *, {_crossings(_RINGS, False)} as n from p)"))
add("polygon_nonzero", lambda r: draw.polygon(r, _RINGS, (1, 2, 3), "nonzero"), select(", ".join(f"case when n <> 0 then {k + 1} else c{k} end as c{k}" for k in range(3)), "q", f"q as (select *, {_crossings(_RINGS, True)} as n from p)"))


def _swept_sql(rings: list[list[tuple[float, float]]], nonzero: bool, colour: tuple[int, ...]) -> str:
    """Coverage of a polygon over p: each pair of edges of a band adds, row by row and pixel by pixel, what lies right of its
    left edge and takes away what lies right of its right one."""
    whole = [[(int(x * 16), int(y * 16)) for x, y in ring] for ring in rings]
    lines = [(*p, *q) for ring in whole for p, q in zip(ring, ring[1:] + ring[:1], strict=True) if p[1] != q[1]]
    heights = sorted({y for ring in whole for _, y in ring})
    div = lambda a, b: f"trunc(({a}) / ({b}))::bigint"
    at_y = lambda s, y: div(f"({y} - {s}y1) * {s}x2 + ({s}y2 - {y}) * {s}x1", f"{s}y2 - {s}y1")
    at_x = lambda s, x: div(f"({x} - {s}x1) * {s}y2 + ({s}x2 - {x}) * {s}y1", f"nullif({s}x2 - {s}x1, 0)")
    edges = ", ".join(f"({k}, {', '.join(map(str, e))})" for k, e in enumerate(lines))
    bands = ", ".join(f"({a}, {b})" for a, b in zip(heights, heights[1:], strict=False))
    met = f"e0 as (select * from (values {edges}) e0(n, x1, y1, x2, y2)), bd as (select * from (values {bands}) bd(b0, b1)), met as (select *, {at_y('', '(b0 + b1) // 2')} as mx, case when y1 < y2 then 1 else -1 end as way, least(y1, y2) as tp, greatest(y1, y2) as lw from e0, bd where greatest(y1, y2) > b0 and least(y1, y2) < b1)"
    nth = "nth as (select *, row_number() over (partition by b0 order by mx, n) as k, sum(way) over (partition by b0 order by mx, n rows between unbounded preceding and current row) as open, max(tp) over (partition by b0) as least_, min(lw) over (partition by b0) as most_ from met)"
    number = "sum(case when open = way then 1 else 0 end) over (partition by b0 order by k rows between unbounded preceding and current row)" if nonzero else "(k - 1) // 2"
    pairs = f"pr as (select b0, b1, pair, {', '.join(f'arg_min({c}, k) as l{c}, arg_max({c}, k) as r{c}' for c in ('x1', 'y1', 'x2', 'y2'))}, any_value(least_) as least_, any_value(most_) as most_ from (select *, {number} as pair from nth) group by b0, b1, pair having {'sum(way) = 0' if nonzero else 'count(*) = 2'})"
    rows = "rw as (select pr.*, y, greatest(least_, 0, y * 16) as lo, least(most_, 800, y * 16 + 16) as hi from pr, (select unnest(range(50))::int as y) where y >= trunc(b0 / 16) and y < trunc((b1 + 15) / 16))"
    ends = f"ed as (select *, {', '.join(f'{f}({at_y(s, 'lo')}, {at_y(s, 'hi')}) as {s}{n}' for s in 'lr' for f, n in (('least', 'a'), ('greatest', 'b')))} from rw)"
    cells = "cl as (select ed.*, x, x * 16 as u, x * 16 + 16 as v from ed, (select unnest(range(64))::int as x) where x >= greatest(trunc(la / 16), 0) and x <= trunc((rb - 1) / 16))"

    def area(s: str) -> str:
        left, right, top, low, rises = at_x(s, "u"), at_x(s, "v"), at_y(s, "lo"), at_y(s, "hi"), f"({s}x2 - {s}x1) * ({s}y2 - {s}y1) < 0"
        through_left, through_right = f"coalesce({left} between lo and hi, false)", f"coalesce({right} between lo and hi, false)"
        both = f"8 * (case when {rises} then 2 * hi - {left} - {right} else {left} + {right} - 2 * lo end)"
        one_left = f"trunc(16 * (hi - lo) - (case when {rises} then ({top} - u) * ({left} - lo) else ({low} - u) * (hi - {left}) end) / 2.0::double)"
        one_right = f"trunc((case when {rises} then (v - {low}) * (hi - {right}) else (v - {top}) * ({right} - lo) end) / 2.0::double)"
        return f"case when {through_left} and {through_right} then {both} when {through_left} then {one_left} when {through_right} then {one_right} else trunc((hi - lo) * (2 * v - {top} - {low}) / 2.0::double) end"

    total = f"sw as (select y, x, least(255, greatest(0, sum((case when trunc((lb - 1) / 16) >= x then {area('l')} else 16 * (hi - lo) end) - (case when trunc(ra / 16) <= x then {area('r')} else 0 end)))) / 255.0::double as s from cl group by y, x)"
    mixed = ", ".join(f"trunc(coalesce(s, 0) * {float(v)!r}::double + (1.0::double - coalesce(s, 0)) * c{k})::int as c{k}" for k, v in enumerate(colour))
    return f"{BASE}, {met}, {nth}, {pairs}, {rows}, {ends}, {cells}, {total} select image_id, p.y, p.x, {mixed} from p left join sw on sw.y = p.y and sw.x = p.x"


_STAR = [[(32, 2), (45, 46), (8, 18), (56, 18), (19, 46)], [(-5, 30.3), (70.5, 33), (30, 60)]]
_QUAD = [[(5, 5), (55, 10), (40, 45), (10, 40)]]
for _name, _shape, _rule in (("polygon_aa", _QUAD, "nonzero"), ("polygon_aa_star", _STAR, "evenodd"), ("polygon_aa_star_nonzero", _STAR, "nonzero")):
    add(_name, lambda r, s=_shape, u=_rule: sweep.polygon(r, s, (1, 2, 3), u), _swept_sql(_shape, _rule == "nonzero", (1, 2, 3)))

for _name, _pie in (("arc_aa", (30.5, 25.25, 17.5, 20, 250)), ("arc_aa_over_zero", (20, 20, 30, 300, 45))):
    add(_name, lambda r, a=_pie: draw.arc_aa(r, *a, (1, 2, 3)), _swept_sql([draw.soft_sector(*_pie)], False, (1, 2, 3)))


def _own_shapes(r: Raster) -> DataFrame:
    """A triangle of each image's own: its corners follow the samples of three of its pixels."""
    corners = F.col("y").isin(0) & F.col("x").isin(3, 4, 5)
    place = {"x": F.col("c0") % 60 + F.col("c1") / 256, "y": F.col("c2") % 45 + F.col("c1") / 512}
    return r.px.where(corners).select("image_id", F.lit(0).alias("ring"), (F.col("x") - 3).alias("at"), *(place[n].cast("double").alias(n) for n in "xy"))


add("polygon_aa_by_image", lambda r: sweep.polygon(r, _own_shapes(r), (200, 100, 50)))
add("bezier", lambda r: draw.bezier(r, [(2, 2), (30, 60), (60, 4)], (1, 2, 3)))
add("flood_fill", lambda r: draw.flood_fill(draw.box(r, 10, 10, 40, 40, (0, 0, 0)), 20, 20, (1, 2, 3), border=(0, 0, 0)), select(", ".join(f"case when x between 11 and 39 and y between 11 and 39 then {k + 1} when x between 10 and 40 and y between 10 and 40 then 0 else c{k} end as c{k}" for k in range(3))))

_OPEN = f"op as (select image_id, y, x, {_BRIGHT} as v from p), rg as (select image_id, y, x, v from op where image_id < 3 and y = 25 and x = 30 union select op.image_id, op.y, op.x, op.v from rg join op on op.image_id = rg.image_id and op.v = rg.v and abs(op.x - rg.x) + abs(op.y - rg.y) = 1)"
add("flood_fill_colour", lambda r: draw.flood_fill(_levels(r.with_px(r.px.where("image_id < 3"))), 30, 25, (9,)), f"{BASE}, {_OPEN} select op.image_id, op.y, op.x, case when rg.x is not null then 9 else op.v end as c0 from op left join rg using (image_id, y, x) where op.image_id < 3".replace("with e as", "with recursive e as", 1))

# Gradients over several places of a pixel, and laid over an image


def _several_sql(places: list[tuple[str, str]], last: str = "") -> str:
    """A linear gradient from (5, 5) to (50, 40), black to white, the mean over places of each pixel."""
    v = [f"least(1::double, greatest(0::double, ((x + {dx} - 5::double) * 45 + (y + {dy} - 5::double) * 35) / {float(45 * 45 + 35 * 35)!r}::double))" for dx, dy in places]
    mean = f"(({' + '.join(v)}) / {len(v)}::double)"
    return select(last or f"{each(f'trunc({mean} * 255 + 0.5)::int')}, 255 as c3", "p") if not last else f"{BASE}, q as (select *, trunc({mean} * 255 + 0.5)::int as s from p) select image_id, y, x, {last} from q"


_GRID = [(f"({-0.5 + 0.5 / 3!r}::double + {1 / 3!r}::double * {a})", f"({-0.5 + 0.5 / 3!r}::double + {1 / 3!r}::double * {b})") for a in range(3) for b in range(3)]
_ROUND = [(f"0.3::double * cos({k} * pi() / 3)", f"0.3::double * sin({k} * pi() / 3)") for k in range(6)]
add("fountain_grid_samples", lambda r: fills.fountain(r, 5, 5, 50, 40, samples="grid", points=9), _several_sql(_GRID))
add("fountain_circle_samples", lambda r: fills.fountain(r, 5, 5, 50, 40, samples="circle", points=6), _several_sql(_ROUND))
add("fountain_random_samples", lambda r: fills.fountain(r, 5, 5, 50, 40, "radial", "triangle", samples="random", points=5, seed=3))
add("fountain_combine", lambda r: fills.fountain_over(r, 5, 5, 50, 40, "add", samples="grid", points=9), _several_sql(_GRID, each("least(255, c@ + s)")))

# Image fonts: glyphs are rectangles of the first image

_FONT = glyphs.ImageFont({97: glyphs.Glyph(3, 9, 2, 12, 1, 8), 98: glyphs.Glyph(20, 27, 5, 17, 0, 7), 99: glyphs.Glyph(40, 44, 30, 38, -2, 6)}, 9, -3)
_TYPED = "m as (select * from (values (97, 3, 9, 2, 12), (98, 20, 27, 5, 17), (99, 40, 44, 30, 38)) m(code, l, r, t, b)), w as (select * from (values (97, 6, 11), (98, 13, 11), (97, 21, 11), (98, 28, 11), (99, 33, 11)) w(code, px, py)), k as (select px + a.x - l as x, py + a.y - t as y, a.c0 as s0, a.c1 as s1, a.c2 as s2, a.c3 as s3 from a join m on a.image_id = 0 and a.x >= l and a.x < r and a.y >= t and a.y < b join w using (code))"
add("text_image_font", lambda r: glyphs.draw(Raster(r.px.drop("c3"), r.width, r.height, 3), "ab?ab", 5, 20, _FONT, r), f"{BASE}, {_TYPED.replace(', (99, 33, 11)', '')} select p.image_id, p.y, p.x, {each('case when s3 is null then p.c@ else trunc((s3 * s@ + (255 - s3) * p.c@) / 255)::int end')} from p left join k using (y, x)", 4)

# Palettes

add("pal_web", lambda r: quantize.expand(quantize.closest(r, quantize.fixed_palette("webmap")), quantize.fixed_palette("webmap")), select(each("(c@ + 25) // 51 * 51")))
add("pal_gray16", lambda r: quantize.closest(point.convert(r, "grey"), quantize.fixed_palette("gray16")), select("((trunc(c0 * 0.222::double + c1 * 0.707::double + c2 * 0.071::double)::int + 8) // 17) as c0"))
_PAL = [(0, 0, 0), (255, 255, 255), (128, 130, 120), (90, 140, 160), (160, 120, 90)]
_D = [f"(c0 - {a}) ** 2 + (c1 - {b}) ** 2 + (c2 - {c}) ** 2" for a, b, c in _PAL]
add("quant_closest", lambda r: quantize.closest(r, _PAL), select("case " + " ".join(f"when d{k} = least(d0, d1, d2, d3, d4) then {k}" for k in range(5)) + " end as c0", "q", "q as (select *, " + ", ".join(f"{d} as d{k}" for k, d in enumerate(_D)) + " from p)"))
add("quant_mediancut", lambda r: r.px.sparkSession.createDataFrame([(k, *c) for k, c in enumerate(quantize.median_cut(r, 16))], "idx int, c0 int, c1 int, c2 int"))
add("quant_errdiff", lambda r: quantize.error_diffusion(r, _PAL))
add("quant_perturb", lambda r: quantize.perturbed(r, _PAL, 8.0, 2))
add("quant_transparent_threshold", lambda r: quantize.to_paletted(r, _PAL, transparency="threshold"), select("case when c3 < 128 then 5 else case " + " ".join(f"when d{k} = least(d0, d1, d2, d3, d4) then {k}" for k in range(5)) + " end end as c0", "q", "q as (select *, " + ", ".join(f"{d} as d{k}" for k, d in enumerate(_D)) + " from a)"), 4)
add("quant_bins", lambda r: quantize.colour_bins(r), f"{BASE} select c0 // 8 * 255 // 31 as c0, c1 // 8 * 255 // 31 as c1, c2 // 8 * 255 // 31 as c2, count(*) as n from p group by 1, 2, 3")
for _name in quantize.ORDERED:
    _MAP = ", ".join(str(v) for row in quantize.ordered_map(_name) for v in row)
    add("quant_ordered" if _name == "tiny" else f"quant_ordered_{_name}", lambda r, t=_name: quantize.to_paletted(r, _PAL, transparency="ordered", table=t), select(f"case when c3 < (list_value({_MAP}))[(y % 8) * 8 + x % 8 + 1] then 5 else case " + " ".join(f"when d{k} = least(d0, d1, d2, d3, d4) then {k}" for k in range(5)) + " end end as c0", "q", "q as (select *, " + ", ".join(f"{d} as d{k}" for k, d in enumerate(_D)) + " from a)"), 4)
_MANY = [((k * 37) % 256, (k * 91 + 13) % 256, (k * 53 + 7) % 256) for k in range(60)]
add("quant_closest_boxes", lambda r: quantize.closest(r, _MANY), select("list_position(d, list_min(d))::int - 1 as c0", "q", "q as (select *, [" + ", ".join(f"(c0 - {a}) ** 2 + (c1 - {b}) ** 2 + (c2 - {c}) ** 2" for a, b, c in _MANY) + "] as d from p)"))

_GREYS = [(v, v, v) for v in range(16, 256, 32)]
_NEAR = f"fx as (select * from (values {', '.join(f'({k}, {a}, {b}, {c})' for k, (a, b, c) in enumerate([(0, 0, 0), *_GREYS]))}) fx(i, r, g, b)), co as (select image_id, c0, c1, c2, count(*) as n from p group by 1, 2, 3, 4), ne as (select image_id, c0, c1, c2, n, arg_min(i, ((c0 - r) ** 2 + (c1 - g) ** 2 + (c2 - b) ** 2) * 1000 + i) as i from co, fx group by 1, 2, 3, 4, 5), mo as (select image_id, i, {', '.join(f'trunc(sum(c{k} * n) / sum(n))::int as c{k}' for k in range(3))} from ne where i > 0 group by 1, 2 union all select distinct image_id, 0, 0, 0, 0 from p)"
add("quant_local_means_round", lambda r: quantize.local_means(r, 9, [(0, 0, 0)], each=True, start=_GREYS, rounds=1), f"{BASE}, {_NEAR} select image_id, (row_number() over (partition by image_id order by i) - 1)::int as idx, c0, c1, c2 from mo")
add("quant_local_means", lambda r: quantize.local_means(r, 32))
add("quant_local_means_by_image", lambda r: quantize.local_means(r, 16, [(0, 0, 0), (255, 255, 255)], each=True))

# Files


def _tripped(kind: str):
    def f(r: Raster) -> DataFrame:
        files = images.encoded(r, kind).select(F.col("image_id").cast("string").alias("path"), "content")
        px = images.pixels(images.scanlines(files, kind), F.col("path").cast("long"))
        return px.select(*KEYS, *r.names)

    return f


for _kind in ("pnm", "bmp", "tga", "png", "sgi", "tiff"):
    add(f"file_{_kind}", _tripped(_kind), select("c0, c1, c2"))
for _kind in ("tga", "png", "sgi", "tiff", "ico", "cur"):
    add(f"file_{_kind}_alpha", _tripped(_kind), select("c0, c1, c2, c3", "a"), 4)
add("probe_format", lambda r: images.probe_format(images.encoded(r, "png").select(F.col("image_id").cast("string").alias("path"), "content")), f"{BASE} select image_id::varchar as path, 'png' as format from p group by 1")


def _guess(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    path = F.concat("url", F.element_at(F.array(*(F.lit(x) for x in (".PNG", ".jpeg", ".ppm", ".xyz", ""))), (F.col("page_id") % 5 + 1).cast("int")))
    return pages.select("page_id", images.guess_type(path).alias("type"))


QUERIES["guess_type"] = _guess
SQL["guess_type"] = "select page_id, case page_id % 5 when 0 then 'png' when 1 then 'jpeg' when 2 then 'pnm' when 3 then 'xyz' else case when regexp_matches(url, '\\.[A-Za-z0-9]{2,}$') then lower(regexp_extract(url, '\\.([A-Za-z0-9]{2,})$', 1)) end end as \"type\" from pages"


def _limits(spark: SparkSession, folder: str) -> DataFrame:
    """Headers made from the parts table, and whether each would be let in: 40 wide, 30 high, 3000 bytes at most."""
    limits = codecs.Limits(40, 30, 3000)
    w, h, c = (F.col("p_partkey") % 50).cast("int"), (F.col("p_size") % 40).cast("int"), (F.col("p_partkey") % 4 + 1).cast("int")
    heads = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", w.alias("w"), h.alias("h"), c.alias("c"))
    return heads.select("p_partkey", images.within(limits, F.col("w"), F.col("h"), F.col("c")).alias("fits"))


QUERIES["file_limits"] = _limits
SQL["file_limits"] = "with h as (select p_partkey, (p_partkey % 50)::int as w, (p_size % 40)::int as h, (p_partkey % 4 + 1)::int as c from part) select p_partkey, w >= 1 and h >= 1 and w <= 40 and h <= 30 and w * h * c <= 3000 as fits from h"


# Tags: an array of structs in the header row


def _tags(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    return orders.groupBy(F.col("o_custkey").alias("image_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("string").alias("data")))).alias("tags"))


def _tags_find(spark: SparkSession, folder: str) -> DataFrame:
    found = tags.find(F.col("tags"), "1-URGENT")
    return _tags(spark, folder).select("image_id", F.size(found).alias("n"), tags.get(F.col("tags"), "1-URGENT").alias("first"))


def _tags_delete(spark: SparkSession, folder: str) -> DataFrame:
    left = tags.delete(F.col("tags"), "1-URGENT")
    return _tags(spark, folder).select("image_id", F.size(left).alias("n"), (F.size("tags") - F.size(left)).alias("removed"))


QUERIES |= {"tags_find": _tags_find, "tags_delete": _tags_delete}
SQL["tags_find"] = "select o_custkey as image_id, count(*) filter (o_orderpriority = '1-URGENT')::int as n, min(o_orderkey::varchar) filter (o_orderpriority = '1-URGENT') as \"first\" from orders group by 1"
SQL["tags_delete"] = "select o_custkey as image_id, count(*) filter (o_orderpriority <> '1-URGENT')::int as n, count(*) filter (o_orderpriority = '1-URGENT')::int as removed from orders group by 1"


# Pictures from places, and filters by name

add("turbnoise", lambda r: procedural.turbnoise(r, 1.0, 2.0, 10.0))
add("radnoise", lambda r: procedural.radnoise(r, 30, 25, 0.3, 2.0))
add("mandelbrot", lambda r: procedural.mandelbrot(r, -2.5, -1.5, 1.0, 1.5))
add("transform2_mandel", lambda r: assembler.mandel(r, maxcount=20))
add("transform2_julia", lambda r: assembler.julia(r, maxcount=20))
add("filter_by_name", lambda r: registry.apply(registry.apply(r, "hardinvert"), "contrast", intensity=0.5), select(each("trunc((255 - c@) * 0.5::double)::int")))
add("text_boxes", lambda r: text.draw(r, "ab c", 5, 30, text.BlockFont(10), (1, 2, 3)), select(", ".join(f"case when y between 24 and 30 and (x between 5 and 8 or x between 10 and 13 or x between 20 and 23) then {k + 1} else c{k} end as c{k}" for k in range(3))))
_VIEW = lambda r: joins.View(Raster(r.px.drop("c3"), 64, 50, 3), 20, 15, 40, 30, point.convert(r, "alpha"))
add("masked_view", lambda r: _VIEW(r).view(5, 4, 20, 12).read(), f"{BASE} select image_id, y - 19 as y, x - 25 as x, c0, c1, c2 from p where x between 25 and 44 and y between 19 and 30", 4)
add("masked_view_write", lambda r: _VIEW(r).view(5, 4, 20, 12).write(Raster(model.turned(r).px.drop("c3"), 64, 50, 3)), f"{BASE} select p.image_id, p.y, p.x, {each('case when p.x between 25 and 44 and p.y between 19 and 30 and a.c3 <> 0 then t.c@ else p.c@ end')} from p left join t on p.image_id = t.image_id and t.x = p.x - 25 and t.y = p.y - 19 left join a on p.image_id = a.image_id and a.x = p.x - 20 and a.y = p.y - 15", 4)
add("transform_legacy", lambda r: expression.transform(r, "x 2 *", "y 1 +"), f"{BASE} select o.image_id, o.y, o.x, {each('coalesce(q.c@, 0)')} from p o left join p q on q.image_id = o.image_id and q.x = o.x * 2 and q.y = o.y + 1")
add("scale_x", lambda r: geometry.scale_axis(r, "x", 0.5), f"{BASE}, {_halved_sql('x', 'p', 'hx', 'c0 c1 c2')} select image_id, y, x, c0, c1, c2 from hx")
add("scale_y", lambda r: geometry.scale_axis(r, "y", 1.5))
add("gaussian2", lambda r: stencil.gaussian2(r, 0, 2.0), _gauss_sql(0, 2.0))
add("gaussian2_both", lambda r: stencil.gaussian2(r, 1.0, 2.5), _gauss_sql(1.0, 2.5))
add("pal_expand", lambda r: quantize.expand(quantize.closest(r, _PAL), _PAL), select(", ".join("case " + " ".join(f"when d{k} = least(d0, d1, d2, d3, d4) then {_PAL[k][c]}" for k in range(5)) + f" end as c{c}" for c in range(3)), "q", "q as (select *, " + ", ".join(f"{d} as d{k}" for k, d in enumerate(_D)) + " from p)"))


def _tags_int(spark: SparkSession, folder: str) -> DataFrame:
    made = tags.put(tags.add(F.array().cast(tags.KIND), "i_lines", F.col("p_size")), "brand", F.col("p_brand"))
    parts = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", made.alias("t"))
    return parts.select("p_partkey", tags.get_int(F.col("t"), "i_lines").alias("lines"), tags.get_int(F.col("t"), "brand").alias("brand"), F.size("t").alias("n"))


QUERIES["tags_int"] = _tags_int
SQL["tags_int"] = "select p_partkey, p_size::bigint as lines, 0::bigint as brand, 2 as n from part"

# Palettes of their own: the images in steps of 85, of which those of up to 40 colours are paletted

_STEPPED = f"{BASE}, s as (select image_id, y, x, {each('c@ // 86 * 85')} from p), u as (select distinct image_id, c0, c1, c2 from s), n as (select image_id, count(*) as n from u group by 1)"


def _stepped(r: Raster) -> palette.Paletted:
    return palette.exact(r.map_colour(lambda c: (c / 86).cast("int") * 85), 40)


def _written(r: Raster) -> DataFrame:
    """A row of each image gets the colours of another row; in images of odd numbers one pixel gets a colour of its own."""
    p = _stepped(r)
    row = r.map_colour(lambda c: (c / 86).cast("int") * 85).px.where("y = 9")
    own = (F.col("image_id") % 2 == 1) & (F.col("x") == 7)
    updates = row.select("image_id", F.lit(3).alias("y"), "x", F.lit(1).alias("seq"), *(F.when(own, F.lit(k + 1)).otherwise(F.col(n)).alias(a) for k, (n, a) in enumerate(zip(r.names, "rgb", strict=True))))
    got = palette.set_pixels(p, updates)
    return palette.expand(got).px.join(got.heads.select("image_id", F.col("palette").isNull().alias("direct")), "image_id")


def _colours(r: Raster) -> DataFrame:
    heads = palette.add_colours(_stepped(r), [(1, 2, 3), (4, 5, 6), (7, 8, 9)]).heads
    third = palette.get_colours(2)[0]
    return heads.select("image_id", "added", palette.colour_count().alias("n"), palette.max_colours().alias("most"), third["r"].alias("r"), third["g"].alias("g"), third["b"].alias("b"), palette.find_colour((85, 85, 85)).alias("found"))


def _monochrome(r: Raster) -> DataFrame:
    """Black and white, white first in images of even numbers, with a third colour in every third image."""
    p = palette.exact(r.project({n: F.when(F.col("c0") < 128, 0).when((F.col("image_id") % 3 == 2) & (F.col("y") == 0), 60).otherwise(255) for n in r.names}))
    p = palette.set_colours(p, 0, [(255, 255, 255), (0, 0, 0)], (F.col("image_id") % 2 == 0) & (palette.colour_count() == 2))
    return p.heads.select("image_id", palette.colour_count().alias("n"), palette.zero_is_white().alias("zero_is_white"))


add("palette_expand", lambda r: palette.expand(_stepped(r)), f"{_STEPPED} select * from s")
add("palette_set_pixels", _written, f"{_STEPPED} select s.image_id, s.y, s.x, {each('case when s.y <> 3 then s.c@ when s.image_id % 2 = 1 and s.x = 7 then @ + 1 else o.c@ end')}, n > 40 or s.image_id % 2 = 1 as direct from s join n using (image_id) join s o on o.image_id = s.image_id and o.x = s.x and o.y = 9")
add("palette_colours", _colours, f"""{_STEPPED}, k as (select *, (row_number() over (partition by image_id order by c0, c1, c2) - 1)::int as i, n from u join n using (image_id) where n <= 40), h as (select image_id, max(n) as n, {', '.join(f'max(c{k}) filter (i = 2) as {a}' for k, a in enumerate('rgb'))}, max(i) filter (c0 = 85 and c1 = 85 and c2 = 85) as found from k group by 1)
select n.image_id, (case when h.n <= 37 then h.n else -1 end)::int as added, coalesce(case when h.n <= 37 then h.n + 3 else h.n end, -1)::int as n, (case when h.n is null then -1 else 40 end)::int as most, case when h.n = 2 then 1 else r end as r, case when h.n = 2 then 2 else g end as g, case when h.n = 2 then 3 else b end as b, found from n left join h using (image_id)""")
add("palette_monochrome", _monochrome, f"{BASE}, m as (select image_id, case when c0 < 128 then 0 when image_id % 3 = 2 and y = 0 then 60 else 255 end as c from p), d as (select image_id, count(distinct c)::int as n, min(c) as lo, max(c) as hi from m group by 1) select image_id, n, case when n = 2 and lo = 0 and hi = 255 then image_id % 2 = 0 when n = 2 and image_id % 2 = 0 then true end as zero_is_white from d")
add("palette_indexes", lambda r: palette.get_indexes(_stepped(r), 4, 10, 30), f"{_STEPPED}, k as (select u.*, (row_number() over (partition by image_id order by c0, c1, c2) - 1)::int as i from u join n using (image_id) where n <= 40) select image_id, y, x, i from s join k using (image_id, c0, c1, c2) where y = 4 and x between 10 and 29")
add("channel_mask", lambda r: joins.masked_channels(r, model.turned(r), 0b101), f"{BASE} select p.image_id, p.y, p.x, t.c0, p.c1, t.c2 from p join t using (image_id, y, x)")


def _tagged(r: Raster) -> DataFrame:
    head = r.px.groupBy("image_id").agg(F.lit(1).alias("_one"))
    tagged = tags.add(F.array().cast(tags.KIND), "i_background", F.concat(F.lit("color("), F.col("image_id") % 256, F.lit(",90,200,10)")))
    heads = head.select("image_id", F.when(F.col("image_id") % 2 == 1, tagged).alias("tags"))
    return point.flatten_tagged(r, heads)


add("flatten_tagged", _tagged, select(", ".join(f"trunc((c{k} * c3 + (case when image_id % 2 = 1 then {v} else 0 end) * (255 - c3)) / 255)::int as c{k}" for k, v in enumerate(("image_id % 256", "90", "200"))), "a"), 4)
add("quant_transparent_errdiff", lambda r: quantize.to_paletted(r, quantize.fixed_palette("gray4"), transparency="errdiff"), None, 4)


def _tags_typed(spark: SparkSession, folder: str) -> DataFrame:
    """Tags by name and by code: a float, one of five digits, a colour, and one that is deleted by its place."""
    made = tags.add(tags.add(tags.add(_untagged(), "gone", "x"), 7, F.col("p_size")), 7, "again")
    made = tags.put_colour(tags.put_float(tags.put_float(made, "price", F.col("p_retailprice")), 9, F.col("p_retailprice") / 7, 5), "tint", F.col("p_size"), F.col("p_partkey") % 256, 3)
    parts = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", tags.delete_at(made, 0).alias("t"))
    t = F.col("t")
    columns = {
        "n": F.size("t"), "price": tags.get_float(t, "price"), "seventh": tags.get_float(t, 9), "first": tags.get(t, 7), "both": F.size(tags.find(t, 7)), "left": F.size(tags.delete(t, 7)),
        "green": tags.get_colour(t, "tint")["g"], "gone": tags.get(t, "gone").isNull(), "text": tags.get(t, "tint"),
    }
    return parts.select("p_partkey", *(c.alias(n) for n, c in columns.items()))


def _untagged():
    return F.lit(None).cast(tags.KIND)


QUERIES["tags_typed"] = _tags_typed
SQL["tags_typed"] = "select p_partkey, 5 as n, p_retailprice::double as price, printf('%.4e', p_retailprice::double / 7)::double as seventh, p_size::varchar as \"first\", 2 as \"both\", 3 as \"left\", (p_partkey % 256)::int as green, true as gone, 'color(' || p_size || ',' || (p_partkey % 256) || ',3,255)' as \"text\" from part"


# Rows and samples written, colours as text and by hue

add("setscanline", lambda r: joins.set_scanline(r, 11, 40, r.px.where("y = 3").select("image_id", F.col("x").alias("at"), *r.names)), f"{BASE} select p.image_id, p.y, p.x, {each('case when p.y = 11 and p.x >= 40 then q.c@ else p.c@ end')} from p left join p q on q.image_id = p.image_id and q.y = 3 and q.x = p.x - 40")
add("setsamples", lambda r: joins.set_scanline(r, 11, -9, r.px.where("y = 3").select("image_id", F.col("x").alias("at"), F.col("c0").alias("c2"), F.col("c1").alias("c0")), [2, 0]), f"{BASE} select p.image_id, p.y, p.x, case when q.c0 is not null then q.c1 else p.c0 end as c0, p.c1, case when q.c0 is not null then q.c0 else p.c2 end as c2 from p left join p q on p.y = 11 and q.image_id = p.image_id and q.y = 3 and q.x = p.x + 9")
_TURN = {a: f"({p} - {q}) / (mx - mn)::double * 60" for a, p, q in (("r", "c1", "c2"), ("g", "c2", "c0"), ("b", "c0", "c1"))}
_DEGREES = f"dg as (select *, case when mx = mn then 0 when c0 = mx then (trunc({_TURN['r']})::int + 360) % 360 when c1 = mx then trunc({_TURN['g']} + 120)::int else trunc({_TURN['b']} + 240)::int end as h, case when mx = 0 then 0::double else 1 - mn / mx::double end as s, mx / 255.0::double as v from (select *, greatest(c0, c1, c2) as mx, least(c0, c1, c2) as mn from p))"


def _from_degrees(sextants: str) -> str:
    """Of the letters m, n, k and v that which the hue's sextant, which starts at h // 60, takes."""
    return f"trunc(case when s <= 0 then w when false then 0 {' '.join(f'when h // 60 = {i} then {x}' for i, x in enumerate(sextants.replace('v', 'w')))} end)::int"


add("colour_hsv", lambda r: r.px.select(*KEYS, *(c.alias(n) for n, c in zip("hsv", colour.hsv(*map(F.col, r.names)), strict=True))), f"{BASE}, {_DEGREES} select image_id, y, x, h, s, v from dg")
add("colour_from_hsv", lambda r: r.project(dict(zip(r.names, colour.from_hsv(F.col("c0") * 3 - 100, F.col("c1") / 250, F.col("c2") / 255), strict=True))), f"""{BASE}, q0 as (select image_id, y, x, case when c0 * 3 - 100 >= 360 then (c0 * 3 - 100) % 360 when c0 * 3 < 100 then c0 * 3 + 260 else c0 * 3 - 100 end as h, least(1, c1 / 250::double) as s, c2 / 255::double * 255 as w from p),
q as (select *, w * (1 - s) as m, w * (1 - s * (h / 60.0::double - h // 60)) as n, w * (1 - s * (1 - (h / 60.0::double - h // 60))) as k from q0) select image_id, y, x, {_from_degrees('vnmmkv')} as c0, {_from_degrees('kvvnmm')} as c1, {_from_degrees('mmkvvn')} as c2 from q""")
_READS = "ceil({} * 255 / {}::double) = c3"
_CSS_ALPHA = f"case when {_READS.format('(c3 * 1000 // 255 // 100)', 10)} then case when c3 * 1000 // 255 < 100 then '0' else '0.' || (c3 * 1000 // 255 // 100) end when {_READS.format('(c3 * 1000 // 255 // 10)', 100)} or c3 * 1000 // 255 % 10 = 0 then (c3 * 1000 // 255 // 10) || '%' else (c3 * 1000 // 255 // 10) || '.' || (c3 * 1000 // 255 % 10) || '%' end"
add("colour_css", lambda r: r.px.select(*KEYS, colour.css(*map(F.col, r.names)).alias("css")), f"{BASE} select image_id, y, x, case when c3 = 255 then format('rgb({{}}, {{}}, {{}})', c0, c1, c2) else format('rgba({{}}, {{}}, {{}}, {{}})', c0, c1, c2, {_CSS_ALPHA}) end as css from a", 4)
add("colour_round_trip", lambda r: r.px.select(*KEYS, colour.parsed(colour.css(*map(F.col, r.names))).alias("_c")).select(*KEYS, *(F.col(f"_c.{c}").alias(n) for c, n in zip("rgba", r.names, strict=True))), select(each("c@", 4), "a"), 4)


def _colour_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Colours written in seven ways by the number of a part."""
    keys = spark.read.parquet(f"{folder}/part.parquet").selectExpr("p_partkey", "cast(p_partkey % 256 as int) as r", "cast(p_partkey * 7 % 256 as int) as g", "cast(p_partkey * 13 % 256 as int) as b")
    ways = ["format_string('#%02x%02x%02x', r, g, b)", "format_string('%02X%02X%02X%02X', r, g, b, r)", "format_string(' #%x%x%x', r % 16, g % 16, b % 16)", "format_string('rgb(%d, %d,%d)', r, g, b)", "format_string('rgba(%d %d %d / %d%%)', r, g, b, r % 100)", "format_string('rgb( %d.5%% %d%%,%d )', r % 100, g % 100, b)", "element_at(array('Navy', 'teal ', 'nothing'), r % 3 + 1)"]
    text_ = F.expr(f"element_at(array({', '.join(ways)}), cast(p_partkey % 7 + 1 as int))")
    return keys.select("p_partkey", colour.parsed(text_).alias("c")).select("p_partkey", *(F.col(f"c.{n}").alias(n) for n in "rgba"))


QUERIES["colour_parse"] = _colour_parse


def _way(*values: str) -> str:
    return f"case p_partkey % 7 {' '.join(f'when {k} then {v}' for k, v in enumerate(values))} end"


_NAMED = [f"[{', '.join(map(str, v))}, null][r0 % 3 + 1]" for v in ((0, 0), (0, 128), (128, 128), (255, 255))]
_PER_CENT = "ceil({} * 255 / 100.0::double)::int"
SQL["colour_parse"] = f"""with k as (select p_partkey, p_partkey % 256 as r0, p_partkey * 7 % 256 as g0, p_partkey * 13 % 256 as b0 from part) select p_partkey, {_way('r0', 'r0', 'r0 % 16 * 17', 'r0', 'r0', _PER_CENT.format('(r0 % 100 + 0.5::double)'), _NAMED[0])}::int as r,
{_way('g0', 'g0', 'g0 % 16 * 17', 'g0', 'g0', _PER_CENT.format('(g0 % 100)'), _NAMED[1])}::int as g, {_way('b0', 'b0', 'b0 % 16 * 17', 'b0', 'b0', 'b0', _NAMED[2])}::int as b, {_way('255', 'r0', '255', '255', _PER_CENT.format('(r0 % 100)'), '255', _NAMED[3])}::int as a from k"""
