"""Pixels made from their places by numpy: lattice noise, escape times, and assembled programs with loops. Rows come in Arrow
batches and leave in the same order; nothing is gathered."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from rasterloom.model import KEYS, Raster


def by_place(r: Raster, f: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> Raster:
    """f(x, y) -> a whole sample array for each channel."""
    names = r.names
    keys = list(KEYS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = f(batch.column(2).to_numpy().astype(np.int64), batch.column(1).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c.astype(np.int32)) for c in made)], [*keys, *names])

    schema = ", ".join(["image_id long, y int, x int", *(f"{n} int" for n in names)])
    return r.with_px(r.px.select("image_id", "y", "x").mapInArrow(run, schema))


def saturate(v: np.ndarray) -> np.ndarray:
    return np.clip(np.trunc(v), 0, 255)


def lattice(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer noise from -1 to 1; 64-bit arithmetic wraps around."""
    with np.errstate(over="ignore"):
        n = x + y * 57
        n = (n << 13) ^ n
        return 1.0 - ((n * (n * n * 15731 + 789221) + 1376312589) & 0x7FFFFFFF) / 1073741824.0


def smooth(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    near = {(i, j): lattice(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)}
    corners = sum(near[i, j] for i in (-1, 1) for j in (-1, 1))
    sides = near[-1, 0] + near[1, 0] + near[0, -1] + near[0, 1]
    return corners / 16 + sides / 8 + near[0, 0] / 4


def between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    ix, iy = np.trunc(x).astype(np.int64), np.trunc(y).astype(np.int64)
    blend = lambda a, b, t: a + (b - a) * (1 - np.cos(t * np.pi)) / 2
    rows = [blend(smooth(ix, iy + k), smooth(ix + 1, iy + k), x - ix) for k in (0, 1)]
    return blend(rows[0], rows[1], y - iy)


def perlin(x: np.ndarray, y: np.ndarray, octaves: int = 5) -> np.ndarray:
    x, y = x.astype(np.float32).astype(np.float64), y.astype(np.float32).astype(np.float64)
    return sum(between(x * 2.0 * k, y * 2.0 * k) * np.pi for k in range(octaves)).astype(np.float32)


def turbnoise(r: Raster, xo: float, yo: float, scale: float) -> Raster:
    n = r.channels

    def f(x, y):
        u, v = xo + x / scale, yo + y / scale
        return [saturate(120 * (1 + np.sin(u + perlin(u, v))))] * n

    return by_place(r, f)


def radnoise(r: Raster, xo: float, yo: float, rscale: float, ascale: float) -> Raster:
    n = r.channels

    def f(x, y):
        dx, dy = x - xo + 0.5, y - yo + 0.5
        return [saturate(128 + 100 * perlin((np.pi + np.arctan2(dy, dx)) * ascale, rscale * np.hypot(dx, dy) + 1.2))] * n

    return by_place(r, f)


def escape(cx: np.ndarray, cy: np.ndarray, most: int) -> np.ndarray:
    """Steps until |z|^2 > 10, 0 where that takes most."""
    zx, zy, steps = cx.copy(), cy.copy(), np.ones(cx.shape, np.int64)
    open_ = zx * zx + zy * zy <= 10
    for _ in range(most - 1):
        if not open_.any():
            break
        zx[open_], zy[open_] = zx[open_] ** 2 - zy[open_] ** 2 + cx[open_], 2 * zx[open_] * zy[open_] + cy[open_]
        steps[open_] += 1
        open_ &= zx * zx + zy * zy <= 10
    return np.where(steps >= most, 0, steps)


def mandelbrot(r: Raster, minx: float, miny: float, maxx: float, maxy: float, most: int = 256, seed: int = 0) -> Raster:
    palette = np.random.default_rng(seed).integers(0, 256, (256, r.channels))
    palette[0] = 0
    width, height = r.width, r.height

    def f(x, y):
        n = escape(minx + x * (maxx - minx) / width, miny + y * (maxy - miny) / height, most)
        return list(palette[n % 256].T)

    return by_place(r, f)
