"""Palettes by local means against a plain loop."""

import random
from collections import Counter

import pytest

from rasterloom.model import Raster
from rasterloom.operators import quantize


def stack(spark, images, w=16, h=12, channels=3, seed=5):
    rnd = random.Random(seed)
    rows = []
    for k in range(images):
        lumps = [[rnd.randint(20, 235) for _ in range(channels)] for _ in range(5)]
        for y in range(h):
            for x in range(w):
                rows.append((k, y, x, *(max(0, min(255, v + rnd.randint(-20, 20))) for v in rnd.choice(lumps))))
    kind = "image_id long, y int, x int, " + ", ".join(f"c{k} int" for k in range(channels))
    return Raster(spark.createDataFrame(rows, kind), w, h, channels), rows


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def moved(pixels, entries, held):
    """One round: the mean of the pixels nearest to each entry, or None where there are none."""
    near = [[] for _ in entries]
    for p in pixels:
        near[min(range(len(entries)), key=lambda k: (apart(entries[k], p), k))].append(p)
    return [(e if k < held else tuple(sum(p[c] for p in got) // len(got) for c in range(3)) if got else None, bool(got)) for k, (e, got) in enumerate(zip(entries, near, strict=True))]


def found(frame, image=None):
    return [tuple(p[f"c{k}"] for k in range(3)) for p in sorted(frame.collect(), key=lambda p: p.idx) if image is None or p.image_id == image]


def entries_of(state):
    return {s.image_id: [tuple(e[1:4]) for e in s.entries] for s in state.collect()}


@pytest.mark.parametrize("each", [False, True])
def test_three_rounds(spark, each):
    r, rows = stack(spark, 3)
    fixed, start = [(0, 0, 0), (200, 30, 90)], [(40, 40, 40), (40, 40, 40), (128, 128, 128), (220, 90, 10), (10, 200, 250), (90, 160, 70)]
    got = quantize.local_means(r, 8, fixed, each, start)
    drawn_ones = 0
    for image in range(3) if each else [None]:
        pixels, entries = [p[3:] for p in rows if image in (None, p[0])], fixed + start
        for k in range(3):
            after = moved(pixels, entries, 2)
            drawn = spark.sql("select " + ", ".join(quantize._seeded(0, k, f"cast({i} as int)", c, below=256) for i in range(8) for c in range(3))).first()
            drawn_ones += sum(e is None for e, _ in after)
            entries = [e if e is not None else tuple(drawn[3 * i : 3 * i + 3]) for i, (e, _) in enumerate(after)]
        want = [e for i, (e, (_, used)) in enumerate(zip(entries, after, strict=True)) if i < 2 or used]
        assert found(got, image) == want
    assert drawn_ones  # the second (40, 40, 40) has no pixels in the first round


def test_start_by_boxes(spark):
    """Places by standing: 16 * 12 pixels of three boxes; a box of one place begins in its middle."""
    r, _ = stack(spark, 1)
    colours = quantize._coloured(r, False)
    sizes = Counter()
    for c in colours.collect():
        assert c.box == c.c0 // 32 * 64 + c.c1 // 32 * 8 + c.c2 // 32
        sizes[c.box] += c.n
    assert sum(sizes.values()) == 16 * 12
    standing, turn, want = dict(sizes), Counter(), []
    for _ in range(9):
        box = min(standing, key=lambda b: (-standing[b], b))
        turn[box] += 1
        want.append(box)
        standing[box] = sizes[box] // (turn[box] + 1) ** 2
    places = quantize.first_means(colours, 9).collect()
    got = Counter(p.r // 32 * 64 + p.g // 32 * 8 + p.b // 32 for p in places)
    assert got == Counter(want) and [p.place for p in sorted(places)] == list(range(1, 10))
    for p in places:
        box = p.r // 32 * 64 + p.g // 32 * 8 + p.b // 32
        assert (p.r % 32, p.g % 32, p.b % 32) == (15, 15, 15) if got[box] == 1 else all(6 <= v % 32 <= 30 for v in (p.r, p.g, p.b))


def test_by_hand(spark):
    """Two lumps of greys: means are cut, an unused place goes, fixed colours stay though unused."""
    rows = [(0, 0, x, v) for x, v in enumerate([10, 11, 13, 200, 203, 203])]
    r = Raster(spark.createDataFrame(rows, "image_id long, y int, x int, c0 int"), 6, 1, 1)
    assert found(quantize.local_means(r, 3, [(255, 0, 0)], start=[(0, 0, 0), (255, 255, 255)], rounds=1)) == [(255, 0, 0), (11, 11, 11), (202, 202, 202)]
    assert found(quantize.local_means(r, 3, start=[(0, 0, 0), (255, 255, 255), (255, 255, 0)], rounds=1)) == [(11, 11, 11), (202, 202, 202)]
    assert found(quantize.local_means(r, 2)) == [(11, 11, 11), (202, 202, 202)]
    assert found(quantize.local_means(r, 1, [(1, 2, 3)])) == [(1, 2, 3)]
    assert quantize.local_means(r.with_px(r.px.where("false")), 4).count() == 0


def test_means_are_close(spark):
    """With as many places as lumps, most pixels lie within their lump's spread of an entry."""
    r, rows = stack(spark, 1, seed=8)
    palette = found(quantize.local_means(r, 16))
    assert 5 <= len(palette) <= 16
    mean = sum(min(apart(p[3:], e) for e in palette) for p in rows) / len(rows)
    assert mean < 3 * 20**2
    with pytest.raises(ValueError, match="1 to 256"):
        quantize.local_means(r, 257)
    with pytest.raises(ValueError, match="start has"):
        quantize.local_means(r, 3, start=[(1, 1, 1)])
