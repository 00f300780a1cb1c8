import numpy as np
import pytest

from rasterloom.llm import embeddings as e

SCHEMA = "vec_id long, embedding array<float>, label int, key string"


def brute(rows):
    ids = [r[0] for r in rows]
    vec = []
    for r in rows:
        x = np.array([np.nan if v is None else v for v in r[1]], float) if r[1] is not None else np.zeros(0)
        vec.append(x if len(x) and np.isfinite(x).all() and x.any() and r[2] is not None else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and vec[i] is not None and vec[j] is not None and rows[i][2] == rows[j][2] and len(vec[i]) == len(vec[j]) and vec[i] @ vec[j] / np.sqrt((vec[i] @ vec[i]) * (vec[j] @ vec[j])) >= e.COSINE] for i in range(n)]
    part = list(range(n))
    for _ in range(n):
        new = [min([part[i], *(part[j] for j in near[i])]) for i in range(n)]
        if new == part:
            break
        part = new
    low = {}
    for i, p in enumerate(part):
        if ids[i] is not None:
            low[p] = min(low.get(p, ids[i]), ids[i])
    return sorted(((ids[i], len(near[i]), low.get(part[i]), ids[i] is not None and ids[i] == low.get(part[i])) for i in range(n)), key=str)


def fixture(width=64):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(40):
        base = rng.normal(size=width)
        for _ in range(rng.integers(1, 8)):
            rows.append((len(rows), (base + rng.normal(size=width) * rng.choice([0, 0.05, 0.1, 0.12, 0.2])).astype(np.float32).tolist(), int(c % 3), "x"))
    rows += [(1000 + i, rows[5][1], rows[5][2], "x") for i in range(30)]
    v = rows[0][1]
    rows += [(2000, None, 0, "x"), (2001, [0.0] * width, 0, "x"), (2002, [*v[:-1], float("nan")], 0, "x"), (2003, [*v[:-1], None], 0, "x"), (2004, [*v[:-1], float("inf")], 0, "x"), (2005, [], 0, "x"), (2006, v, None, "x"), (2007, v[:-1], 0, "x"), (2008, [2 * x for x in v], 0, "x"), (None, v, 0, "x"), (0, v, 0, "x"), (None, [1.0] + [0.0] * (width - 1), 7, "x")]
    return rows


@pytest.mark.parametrize("block", [e.BLOCK, 3])
def test_against_brute_force(spark, block):
    rows = fixture()
    got = e.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_odd_width_and_empty(spark):
    rows = fixture(5)
    assert sorted(map(tuple, e.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)
    assert e.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_at_the_limit():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = e.COSINE * a + np.sqrt(1 - e.COSINE**2) * b
    x, y = e.codes(a), e.codes(b)
    met = ((x == y[:, :, :1]).any(2) | (y == x[:, :, :1]).any(2)).any(1)
    assert met.mean() >= 0.999


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(7, 16))
    h = e.hadamard(x)
    assert np.allclose((h**2).sum(1), 16 * (x**2).sum(1)) and np.allclose(e.hadamard(h), 16 * x)
