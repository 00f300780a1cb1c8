import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rasterloom.llm import lines

DOCS = "doc_id long, text string, keep string, _doc string, H string"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))


def brute(rows, code_points=40, documents=5):
    """rows (doc_id, text) -> what is kept of each, in order."""
    held = defaultdict(set)
    rank = lambda i: (i is not None, i or 0)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= code_points:
                held[key(x)].add(rank(i))
    gone = lambda i, x: len(held.get(key(x), ())) >= documents and rank(i) != max(held[key(x)])
    return [[x for x in (t or "").split("\n") if not gone(i, x)] for i, t, *_ in rows]


def rows():
    rnd = random.Random(4)
    pool = [" ".join(rnd.choices(["alpha", "Beta", "gamma", "délta", "ß", "漢字"], k=rnd.randint(4, 12))) for _ in range(40)]
    common = "This line stands in every third document of all"
    made = []
    for i in range(400):
        got = [rnd.choice(["", "  ", "\t\x0b"]) + rnd.choice([x, x.upper()]) + rnd.choice(["", " ", "\r"]) for x in rnd.choices(pool, k=rnd.randint(0, 5))]
        got += [common] * (i % 3 == 0) + [f"only here {i} " * 4] * (i % 2)
        rnd.shuffle(got)
        made.append((i * 7 % 400, "\n".join(got)))
    made += [(None, None), (None, "x\n" + common), (None, common), (401, ""), (402, "\n\n"), (403, "\n".join([common] * 30_000)), (404, "w" * 300_000 + "\n" + common)]
    made += [(12, common + "\nother"), (13, common), (13, common)]
    return [(i, t, "k", "d", "h") for i, t in made]


@pytest.mark.parametrize("run", [1 << 20, 50])
def test_against_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(lines, "RUN_LINES", run)
    for parts in (1, 5):
        docs = spark.createDataFrame(rows(), DOCS).repartition(parts)
        got = lines.remove(docs)
        assert got.columns == docs.columns
        want = sorted(((r[0], r[1] and "\n".join(k), *r[2:]) for r, k in zip(rows(), brute(rows()), strict=True)), key=str)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_one_hash_spans_partitions(spark):
    """Few documents a run and many ranges, so that a common key's rows lie in several partitions."""
    same = "a line of more than forty code points in all documents"
    docs = [(i, f"{same}\n{same} {i % 7}\nshort") for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(60)
        got = {r.doc_id: r.text for r in lines.remove(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: "\n".join(k) for (i, _), k in zip(docs, brute(docs), strict=True)}


def test_streams_in_small_batches():
    import pyarrow as pa

    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randint(1, 40)
        table = sorted(((rnd.choice([1, 2, 3]), 0, rnd.randint(0, 9), rnd.randint(0, 1)) for _ in range(n)), key=lambda r: (r[0], r[1], -r[2], r[3]))
        names = ["h", "g", "doc", "text_hash"]
        whole = pa.table({k: np.array([r[j] for r in table], np.int64) for j, k in enumerate(names)} | {"many": [False] * n, "places": [b"\0\0\0\0"] * n})
        out = [r for b in lines._streamed(3)(iter(whole.to_batches(rnd.randint(1, 9)))) for r in b.to_pylist()]
        first, last = table[0][0], table[-1][0]
        for h in {r[0] for r in table}:
            docs = {r[2] for r in table if r[0] == h}
            gone = sorted(r["doc"] for r in out if r["h"] == h and not r["edge"])
            edge = [r for r in out if r["h"] == h and r["edge"]]
            if h == first:
                assert not gone and len(edge) == sum(r[0] == h for r in table)
            else:
                assert gone == (sorted(r[2] for r in table if r[0] == h and r[2] != max(docs)) if len(docs) >= 3 else [])
                if h == last:
                    assert len(edge) == 1 and edge[0]["many"] and edge[0]["doc"] == max(docs) if len(docs) >= 3 else len(edge) == sum(r[0] == h for r in table)


def test_bitmaps(spark):
    same = "a line of more than forty code points in all documents"
    docs = spark.createDataFrame([(i, f"x\n{same}\ny") for i in range(6)], "doc_id long, text string")
    got = {r.doc: r for r in lines.bitmaps(docs).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and all(r.n_dropped == 1 for r in got.values())
    assert zlib.decompress(got[2].keep) == b"\xa0" or np.unpackbits(np.frombuffer(zlib.decompress(got[2].keep), np.uint8))[:2].tolist() == [1, 0]
    assert lines.kept_text(f"x\n{same}\ny", got[2].keep) == ("x\ny", 3, 1)


def test_query(spark, tmp_path):
    spark.createDataFrame(rows(), DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = [(r[0], (r[1] or "").count("\n") + 1, (r[1] or "").count("\n") + 1 - len(k), hashlib.sha256("\n".join(k).encode()).hexdigest()) for r, k in zip(rows(), brute(rows()), strict=True)]
    assert sorted(map(tuple, lines.op11_lines(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
