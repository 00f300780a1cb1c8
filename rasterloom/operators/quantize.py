"""Palettes: fixed ones by rule, median cut from a histogram of 15-bit colours, local means, and translation to palette indexes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rasterloom.model import KEYS, Raster
from rasterloom.sources.scratch import stored

Colour = tuple[int, int, int]


def fixed_palette(name: str) -> list[Colour]:
    """mono, gray, gray4, gray16 or webmap."""
    if name == "webmap":
        return [(51 * r, 51 * g, 51 * b) for r in range(6) for g in range(6) for b in range(6)]
    steps = {"mono": 2, "gray": 256, "gray4": 4, "gray16": 16}
    if name not in steps:
        raise ValueError(f"unknown palette {name}")
    return [(k * 255 // (steps[name] - 1),) * 3 for k in range(steps[name])]


def common_palette(palettes: list[list[Colour]], most: int = 256) -> list[Colour] | None:
    """The union in order of first use, or None if it is too large."""
    found = list(dict.fromkeys(c for p in palettes for c in p))
    return found if len(found) <= most else None


def colour_bins(r: Raster) -> DataFrame:
    """(c0, c1, c2, n): the stack's pixels by the upper five bits of each channel (greys by their first), as colours spread
    from 0 to 255; at most 32,768 rows."""
    names = [r.names[0]] * 3 if r.channels <= 2 else r.colour_names
    return r.px.groupBy(*(F.expr(f"cast({n} div 8 * 255 div 31 as int)").alias(f"c{k}") for k, n in enumerate(names))).agg(F.count(F.lit(1)).alias("n"))


def median_cut(r: Raster, size: int) -> list[Colour]:
    """A palette for all images of the stack. The box with the widest channel, the first of equals, is cut where about half
    its pixels are reached; colours are the boxes' means. At most 32,768 bins reach the driver, whatever the data."""
    bins = np.array(sorted((b.c0, b.c1, b.c2, b.n) for b in colour_bins(r).collect()), np.int64).reshape(-1, 4)
    if len(bins) < size:
        return [tuple(map(int, b[:3])) for b in bins]
    channels, boxes = 1 if r.channels <= 2 else 3, [bins]
    while len(boxes) < size:
        widths = [np.ptp(b[:, :channels], axis=0) if len(b) > 1 else np.full(channels, -1) for b in boxes]
        k, channel = divmod(int(np.argmax(widths)), channels)
        if len(boxes[k]) < 2:
            break
        box = boxes[k][np.argsort(boxes[k][:, channel], kind="stable")]
        total = np.cumsum(box[:, 3])
        at = min(int(np.searchsorted(total, int(total[-1]) // 2)) + 1, len(box) - 1)
        boxes[k] = box[:at]
        boxes.append(box[at:])
    return [tuple(int(v) // int(b[:, 3].sum()) for v in (b[:, :3] * b[:, 3:]).sum(0)) for b in boxes]


def _samples(r: Raster) -> list[Column]:
    names = r.colour_names
    return [F.col(n) for n in (names * 3 if len(names) == 1 else names)]


def nearest_index(colours: list[Column], palette: list[Colour]) -> Column:
    """The palette entry at least squared distance, the first on ties."""
    return _nearest(colours, F.array(*(F.struct(F.lit(k).alias("i"), *(F.lit(v).alias(n) for n, v in zip("rgb", c, strict=True))) for k, c in enumerate(palette))))


def _nearest(colours: list[Column], entries: Column) -> Column:
    square = lambda c: c * c
    return F.array_min(F.transform(entries, lambda p: F.struct((square(colours[0] - p["r"]) + square(colours[1] - p["g"]) + square(colours[2] - p["b"])).alias("d"), p["i"].alias("i"))))["i"]


#: Colour space is cut into 512 boxes of so many values a side; a palette of more than FEW entries is searched by box.
BOX, FEW = 32, 16


def box_candidates(palette: list[Colour]) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """For each box the entries (index, r, g, b) that are nearest to some colour in it: those no farther from its nearest
    colour than some entry is from its farthest."""
    entries, low = np.array(palette, np.int64), BOX * np.stack(np.unravel_index(np.arange(512), (8, 8, 8)), 1)[:, None]
    gap = np.maximum(0, np.maximum(low - entries, entries - (low + BOX - 1)))
    reach = np.maximum(np.abs(entries - low), np.abs(entries - (low + BOX - 1)))
    near = (gap**2).sum(2) <= (reach**2).sum(2).min(1)[:, None]
    return [(k, [(i, *palette[i]) for i in np.flatnonzero(near[k]).tolist()]) for k in range(512)]


def nearest(r: Raster, colours: list[Column], palette: list[Colour]) -> Raster:
    """One channel of indexes of the nearest entries: over all of a small palette, or over the candidates of the colour's box,
    from a table of 512 rows."""
    if len(palette) <= FEW:
        return r.project({"c0": nearest_index(colours, palette).cast("int")}, channels=1)
    table = r.px.sparkSession.createDataFrame(box_candidates(palette), "_box int, _entries array<struct<i:int,r:int,g:int,b:int>>")
    box = sum(F.floor(c / BOX) * w for c, w in zip(colours, (64, 8, 1), strict=True)).cast("int")
    px = r.px.select(*KEYS, *(c.alias(f"_{k}") for k, c in enumerate(colours)), box.alias("_box")).join(F.broadcast(table), "_box")
    return r.with_px(px).project({"c0": _nearest([F.col(f"_{k}") for k in range(3)], F.col("_entries")).cast("int")}, channels=1)


def closest(r: Raster, palette: list[Colour]) -> Raster:
    """One channel of palette indexes."""
    return nearest(r, _samples(r), palette)


def perturbed(r: Raster, palette: list[Colour], amount: float, seed: int = 0) -> Raster:
    shifted = [F.least(F.greatest((c + (F.randn(seed + k) * amount)).cast("int"), F.lit(0)), F.lit(255)) for k, c in enumerate(_samples(r))]
    return nearest(r, shifted, palette)


def expand(r: Raster, palette: list[Colour]) -> Raster:
    """Indexes back to colours; beyond the palette is black."""
    part = lambda k: F.coalesce(F.get(F.array(*(F.lit(c[k]) for c in palette)), F.col("c0")), F.lit(0))
    return r.project({f"c{k}": part(k) for k in range(3)}, channels=3)


# Weights by place; the star is the pixel that is left and to the right of it come the next ones.
DIFFUSION = {
    "floyd": ([[0, 0, 7], [3, 5, 1]], 1), "jarvis": ([[0, 0, 0, 7, 5], [3, 5, 7, 5, 3], [1, 3, 5, 3, 1]], 2), "stucki": ([[0, 0, 0, 8, 4], [2, 4, 8, 4, 2], [1, 2, 4, 2, 1]], 2),
}


def error_diffusion(r: Raster, palette: list[Colour], kind: str | tuple[list[list[int]], int] = "floyd") -> Raster:
    """A recurrence along an image's rows, left to right: each image is one group, bounded by its size. What falls on a place
    without a pixel is lost, as outside."""
    weights, origin = DIFFUSION[kind] if isinstance(kind, str) else kind
    total = sum(map(sum, weights))
    if total == 0 or any(w < 0 for row in weights for w in row):
        raise ValueError("weights aren't negative, nor all zero")
    names, w, h, pal = r.colour_names, r.width, r.height, np.array(palette, np.int64)
    taps = [(dy, dx - origin, v) for dy, row in enumerate(weights) for dx, v in enumerate(row) if v]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y", "x"], ignore_index=True)
        pixels = group[names * 3 if len(names) == 1 else names].to_numpy(np.int64)
        debt, out = np.zeros((h, w, 3), np.int64), np.zeros(len(group), np.int32)
        for i, (y, x) in enumerate(zip(group["y"].tolist(), group["x"].tolist(), strict=True)):
            want = np.clip(pixels[i] + debt[y, x], 0, 255)
            k = int(((pal - want) ** 2).sum(1).argmin())
            out[i], error = k, want - pal[k]
            for dy, dx, v in taps:
                if y + dy < h and 0 <= x + dx < w:
                    debt[y + dy, x + dx] += np.trunc(error * v / total).astype(np.int64)
        return pd.DataFrame({"image_id": group["image_id"], "y": group["y"], "x": group["x"], "c0": out})

    px = r.px.select(*KEYS, *r.names).groupBy("image_id").applyInPandas(run, "image_id long, y int, x int, c0 int")
    return Raster(px, w, h, 1, "8")


# Thresholds by place, eight rows of eight.
ORDERED = {
    "random": """ 48  72 196 252 180  92 108  52
228 176  64   8 236  40  20 164
120 128  84 116  24  28 172 220
 68   0 188 124 184 224 192 104
132 100 240 200 152 160 244  44
 96 204 144  16 140  56 232 216
208   4  76 212 136 248  80 168
156  88  32 112 148  12  36  60""",
    "dot8": """240 232 200 136 140 192 228 248
220 148 100  76  80 104 152 212
180 116  56  32  36  60 120 176
156  64  28   0   8  44  88 160
128  92  24  12   4  40  68 132
184  96  48  20  16  52 108 188
216 144 112  72  84 124 164 224
244 236 196 168 172 204 208 252""",
    "dot4": """196  72 104 220 200  80 112 224
 76   4  24 136  84   8  32 144
108  28  52 168 116  36  56 176
216 140 172 244 228 148 180 248
204  92 124 236 192  68  96 208
 88  12  44 156  64   0  16 128
120  40  60 188 100  20  48 160
232 152 184 252 212 132 164 240""",
    "hline": """160 164 168 172 176 180 184 188
128 132 136 140 144 148 152 156
 32  36  40  44  48  52  56  60
  0   4   8  12  16  20  24  28
 64  68  72  76  80  84  88  92
 96 100 104 108 112 116 120 124
192 196 200 204 208 212 216 220
224 228 232 236 240 244 248 252""",
    "vline": """180 100  40  12  44 104 184 232
204 148  60  16  64 128 208 224
212 144  76   8  80 132 216 244
160 112  68  20  84 108 172 236
176  96  72  28  88 152 188 228
200 124  92   0  32 116 164 240
168 120  36  24  48 136 192 248
196 140  52   4  56 156 220 252""",
    "slashline": """248 232 224 192 140  92  52  28
240 220 196 144 108  60  12  64
216 180 148 116  76  20  80 128
204 152 104  44  16  72 100 160
164  96  68  24  56 112 168 176
124  40   8  36  88 136 184 212
 84   4  32 120 156 188 228 236
  0  48 132 172 200 208 244 252""",
    "backline": """  0  32 116 172 184 216 236 252
 56   8  72 132 136 200 228 240
100  36  12  40  92 144 204 220
168 120  60  16  44  96 156 176
180 164 112  48  28  52 128 148
208 192 152  88  84  20  64 104
232 224 196 140 108  68  24  76
248 244 212 188 160 124  80   4""",
    "tiny": """  0 128  32 192   8 136  40 200
224  64 160 112 232  72 168 120
 48 144  16 208  56 152  24 216
176  96 240  80 184 104 248  88
 12 140  44 204   4 132  36 196
236  76 172 124 228  68 164 116
 60 156  28 220  52 148  20 212
188 108 252  92 180 100 244  84""",
}


def ordered_map(name: str = "tiny") -> list[list[int]]:
    if name not in ORDERED:
        raise ValueError(f"no threshold map {name!r}")
    return [[int(v) for v in row.split()] for row in ORDERED[name].splitlines()]


def transparent(r: Raster, how: str = "threshold", threshold: int = 128, table: list[list[int]] | str = "tiny") -> Column:
    """Whether a pixel takes the transparent index: by a threshold, or by an 8 x 8 map of thresholds (a name, or rows)."""
    a = F.col(r.names[-1])
    if how == "threshold":
        return a < threshold
    if how != "ordered":
        raise ValueError(f"no transparency method {how!r}")
    flat = [v for row in (ordered_map(table) if isinstance(table, str) else table) for v in row]
    if len(flat) != 64:
        raise ValueError("a threshold map has eight rows of eight")
    return a < F.element_at(F.array(*map(F.lit, flat)), (F.col("y") % 8) * 8 + F.col("x") % 8 + 1)


def diffused_alpha(r: Raster, kind: str = "floyd") -> DataFrame:
    """(image_id, y, x, _t): _t says that a pixel is transparent. What an alpha is off its black or white (under 128 or not) is
    spread by weight to the pixels after it, summed whole and divided when one's turn comes; one group an image, as above."""
    weights, origin = DIFFUSION[kind]
    total, w, h, name = sum(map(sum, weights)), r.width, r.height, r.names[-1]
    taps = [(dy, dx - origin, v) for dy, row in enumerate(weights) for dx, v in enumerate(row) if v]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["y", "x"], ignore_index=True)
        owed, gone = np.zeros((h + 3, w + 6), np.int64).tolist(), []
        for y, x, alpha in zip(group["y"].tolist(), group["x"].tolist(), group[name].tolist(), strict=True):
            value = min(255, max(0, alpha - int(owed[y][x + 3] / total)))
            gone.append(value < 128)
            off = (0 if gone[-1] else 255) - value
            for dy, dx, v in taps:
                owed[y + dy][x + 3 + dx] += off * v
        return pd.DataFrame({"image_id": group["image_id"], "y": group["y"], "x": group["x"], "_t": gone})

    return r.px.select(*KEYS, name).groupBy("image_id").applyInPandas(run, "image_id long, y int, x int, _t boolean")


def to_paletted(r: Raster, palette: list[Colour], how: str = "closest", transparency: str | None = None, table: list[list[int]] | str = "tiny") -> Raster:
    """Indexes, and with transparency the index after the palette's last where a pixel is transparent."""
    base = error_diffusion(r, palette) if how == "errdiff" else closest(r, palette)
    if transparency is None or not r.has_alpha:
        return base
    gone = diffused_alpha(r) if transparency == "errdiff" else r.px.select(*KEYS, transparent(r, transparency, table=table).alias("_t"))
    return base.with_px(base.px.join(gone, KEYS)).project({"c0": F.when(F.col("_t"), F.lit(len(palette))).otherwise(F.col("c0"))})


# A palette by local means. Colours are counted first, so that rounds run over distinct ones.


def _seeded(*of: str | int, below: int) -> str:
    return f"cast(pmod(xxhash64({', '.join(map(str, of))}), {below}) as int)"


def _coloured(r: Raster, each: bool) -> DataFrame:
    """(image_id, c0, c1, c2, n, box): each colour with its pixels, and its box of 512; image_id is 0 for a whole stack."""
    names = ([r.names[0]] * 3) if r.channels <= 2 else r.colour_names
    found = r.px.groupBy((F.col("image_id") if each else F.lit(0)).cast("long").alias("image_id"), *(F.col(n).alias(f"c{k}") for k, n in enumerate(names))).agg(F.count(F.lit(1)).alias("n"))
    return found.withColumn("box", F.expr(f"cast(c0 div {BOX} * 64 + c1 div {BOX} * 8 + c2 div {BOX} as int)"))


def first_means(colours: DataFrame, places: int, seed: int = 0) -> DataFrame:
    """(image_id, place, r, g, b): where means begin. A place goes to the box with the most pixels, whose standing is divided
    by the square of its next place's number; a lone one is the box's middle, others are drawn within the box."""
    boxes = colours.groupBy("image_id", "box").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("image_id").orderBy(F.desc("standing"), "box", "turn")
    turns = boxes.select("image_id", "box", F.explode(F.sequence(F.lit(1), F.lit(places))).alias("turn"), "n").withColumn("standing", F.expr("n div (turn * turn)"))
    taken = turns.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= places)
    taken = taken.withColumn("lone", F.count(F.lit(1)).over(Window.partitionBy("image_id", "box")) == 1)
    low = {"r": f"box div 64 * {BOX}", "g": f"box div 8 % 8 * {BOX}", "b": f"box % 8 * {BOX}"}
    value = lambda k, n: F.expr(f"cast({low[n]} + if(lone, 15, 6 + {_seeded(seed, 'box', 'turn', k, below=25)}) as int)").alias(n)
    return taken.select("image_id", "place", *(value(k, n) for k, n in enumerate("rgb")))


def means_round(colours: DataFrame, state: DataFrame, round_: int = 0, seed: int = 0, whole: bool = False) -> DataFrame:
    """One round over a palette held as (image_id, entries), entries being structs (i, r, g, b, fixed, used): each colour
    goes to its nearest entry, the first on ties, among its box's candidates; an entry becomes the cut mean of its pixels, one
    without pixels a colour that is drawn. Fixed entries stay. whole says that there is one palette: 512 boxes at most, so that no
    colours need to move to theirs."""
    low = [F.expr(f"{t} * {BOX}") for t in ("box div 64", "box div 8 % 8", "box % 8")]
    gap = lambda e, n, k: F.greatest(F.lit(0), low[k] - e[n], e[n] - low[k] - (BOX - 1))
    reach = lambda e, n, k: F.greatest(F.abs(e[n] - low[k]), F.abs(e[n] - low[k] - (BOX - 1)))
    square = lambda f, e: sum((f(e, n, k) * f(e, n, k) for k, n in enumerate("rgb")), F.lit(0))
    boxes = colours.select("image_id", "box").distinct().join(state, "image_id")
    # the limit is a variable of the outer function, so that it is found once a box and not once an entry
    limit = F.array(F.array_min(F.transform("entries", lambda e: square(reach, e))))
    boxes = boxes.select("image_id", "box", F.get(F.transform(limit, lambda most: F.filter("entries", lambda e: square(gap, e) <= most)), F.lit(0)).alias("_near"))
    # distance and number in one long, so that no entry needs a row of its own
    ranked = F.array_min(F.transform("_near", lambda e: sum(((F.col(f"c{k}") - e[n]) * (F.col(f"c{k}") - e[n]) for k, n in enumerate("rgb")), F.lit(0)).cast("long") * 256 + e["i"]))
    # never null, or else the join below would find it twice to tell
    ranked = F.coalesce(ranked, F.lit(-1).cast("long"))
    taken = colours.join(F.broadcast(boxes) if whole else boxes, ["image_id", "box"]).withColumn("i", (ranked % 256).cast("int"))
    sums = taken.groupBy("image_id", "i").agg(*(F.expr(f"cast(sum(c{k} * n) div sum(n) as int)").alias(f"m{k}") for k in range(3)))
    old = state.select("image_id", F.explode("entries").alias("e")).withColumn("i", F.col("e.i"))
    drawn = lambda k: F.expr(_seeded(seed, round_, "i", k, below=256))
    new = [F.when(F.col("e.fixed"), F.col(f"e.{n}")).otherwise(F.coalesce(f"m{k}", drawn(k))).alias(n) for k, n in enumerate("rgb")]
    entry = F.struct("i", *new, F.col("e.fixed").alias("fixed"), F.col("m0").isNotNull().alias("used"))
    moved = old.join(sums, ["image_id", "i"], "left").select("image_id", entry.alias("e"))
    return moved.groupBy("image_id").agg(F.array_sort(F.collect_list("e")).alias("entries"))


def local_means(r: Raster, size: int, fixed: list[Colour] | None = None, each: bool = False, start: list[Colour] | None = None, rounds: int = 3, seed: int = 0) -> DataFrame:
    """([image_id,] idx, c0, c1, c2): a palette of at most size colours, the fixed ones first, for the whole stack or each
    image. Means begin at start, or in the boxes with the most pixels; entries that end without pixels are left out."""
    fixed = fixed or []
    if not max(1, len(fixed)) <= size <= 256:
        raise ValueError("a palette has 1 to 256 colours, no fewer than its fixed ones")
    if start is not None and len(start) != size - len(fixed):
        raise ValueError("start has a colour for each place that isn't fixed")
    # counted colours are small, but each meets many entries: they are spread over all cores whatever their size
    parts = max(2 * r.px.sparkSession.sparkContext.defaultParallelism, int(r.px.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    colours = stored(_coloured(r, each).repartition(parts), "colours")
    flags = lambda held: [F.lit(held).alias("fixed"), F.lit(held).alias("used")]
    given = [(k, *c, True) for k, c in enumerate(fixed)] + [(len(fixed) + k, *c, False) for k, c in enumerate(start or [])]
    entries = colours.select("image_id").distinct().select("image_id", F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("i", "r", "g", "b", "fixed"), g, strict=True)), F.lit(g[4]).alias("used")) for g in given)))) if given else None
    if start is None and size > len(fixed):
        begun = first_means(colours, size - len(fixed), seed).select("image_id", (F.col("place") + len(fixed) - 1).alias("i"), "r", "g", "b", *flags(False))
        entries = begun if entries is None else entries.unionByName(begun)
    state = stored(entries.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("i", "r", "g", "b", "fixed", "used"))).alias("entries")), "means")
    for k in range(rounds):
        state = stored(means_round(colours, state, k, seed, whole=not each), "means")
    kept = F.filter("entries", lambda e: e["fixed"] | e["used"])
    return state.select("image_id", F.posexplode(kept).alias("idx", "e")).select(*(["image_id"] if each else []), "idx", *(F.col(f"e.{n}").alias(f"c{k}") for k, n in enumerate("rgb")))
