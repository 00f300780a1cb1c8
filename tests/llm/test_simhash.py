import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from rasterloom.llm import simhash
from rasterloom.llm.common import whole_groups
from rasterloom.llm.components import components, forest


def brute_fp(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", raw) if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def brute_components(prints, distance=3):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if bin(prints[i] ^ prints[j]).count("1") <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def texts():
    rnd = random.Random(5)
    words = [f"w{i}É" for i in range(300)]
    base = [" ".join(rnd.choices(words, k=rnd.choice([1, 2, 3, 40, 400, 900]))) for _ in range(40)]
    near = [b.replace("w1", "W1").replace(" ", "\t\n", 3) for b in base] + [b + " extra" for b in base] + [b.replace("w2É", "w3É", 1) for b in base]
    return [*base, *near, *base[:9], "", None, "  \n", "UPPER lower", "x" * 200_000, "one two " * 30_000]


def test_against_brute_force(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts())]
    got = sorted(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)).collect())
    prints = [brute_fp(t) for _, t, _ in rows]
    assert [r.fps[0] & (2**64 - 1) for r in got] == prints
    assert [r.component_id for r in got] == brute_components(prints)


@pytest.mark.parametrize("hot", [simhash.HOT, 5, 0])
@pytest.mark.parametrize("distance", [2, 3])
def test_links_lose_nothing(spark, hot, distance):
    rnd = random.Random(1)
    prints = set()
    for _ in range(60):
        x = rnd.getrandbits(64)
        for _ in range(6):
            prints.add(x)
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << b
    prints = sorted(prints)
    rows = [(i, [p - 2**64 if p >= 2**63 else p]) for i, p in enumerate(prints)]
    found = {r.node: r.component for r in components(simhash.link(spark.createDataFrame(rows, "rep long, fps array<long>"), distance, hot)).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == brute_components(prints, distance)


def test_whole_groups_keep_rows_and_order():
    rnd = random.Random(2)
    values = sorted(rnd.choices(range(-9, 9), weights=[40] + [1] * 17, k=500))
    batches = [pa.RecordBatch.from_arrays([pa.array(values[a : a + 7], pa.int64())], ["g"]) for a in range(0, 500, 7)]
    for most in (1, 20, 100, 10_000):
        parts = [t.column("g").to_pylist() for t in whole_groups(batches, "g", most)]
        assert sum(parts, []) == values
        assert all(a[-1] < b[0] for a, b in zip(parts, parts[1:]))
    assert list(whole_groups([], "g")) == []


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, (2, 5000)).astype(np.uint64)
    bound = np.bitwise_count(simhash.thermometer(a) ^ simhash.thermometer(b))
    count = lambda x: np.stack([(x >> np.uint64(2 * s)) & np.uint64(3) for s in range(32)])
    ones = lambda x: np.bitwise_count(count(x)).astype(int)
    assert (bound == np.abs(ones(a) - ones(b)).sum(0)).all() and (bound <= np.bitwise_count(a ^ b)).all()


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (None, "q r s"), (None, ""), (3, None)], schema)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got if r.fps == [0]) == [("3", 3), ("None", 3)]
    assert sorted(str(r.component_id) for r in got if r.fps != [0]) == ["7", "7", "None"]


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2000 + i) for i in range(50)]
    v, u = forest(*np.array(edges).T)
    local = dict(zip(v.tolist(), u.tolist(), strict=True))
    spread = {r.node: r.component for r in components(spark.createDataFrame(edges, "v long, u long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {k: c for k, c in label.items() if k != c} == local == spread


def test_several_tables(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(2000)]
    rows, groups = [], 30
    for g in range(groups):
        base = rnd.choices(words, k=400)
        rows.append((g, " ".join(base)))
        for c in range(2):
            near = list(base)
            for at in rnd.sample(range(400), 2):
                near[at] = rnd.choice(words)
            rows.append((100 + 2 * g + c, " ".join(near)))
    rows += [(500 + i, " ".join(rnd.choices(words, k=400))) for i in range(60)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5, tables=12).collect()}
    assert all(got[i] == i for i in range(groups)) and all(got[500 + i] == 500 + i for i in range(60))
    assert sum(got[100 + i] == i // 2 for i in range(2 * groups)) >= 2 * groups - 1


def test_rows_that_share_an_id(spark):
    """Rows are nodes: by brute force over the rows' fingerprints, whatever ids they have."""
    rnd = random.Random(11)
    t, u, w = (" ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(200)) for _ in range(3))
    rows = [(3, t + " end"), (5, t), (5, u), (9, t), (9, w), (11, w), (2, u), (None, w), (5, t)]
    prints = [brute_fp(x) for _, x in rows]
    part = brute_components(prints)
    want = [(i, min(rows[k][0] for k in range(len(rows)) if part[k] == part[n] and rows[k][0] is not None)) for n, (i, _) in enumerate(rows)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(want, key=str)
