import hashlib
import random
import re
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from rasterloom.llm import resample
from rasterloom.llm.common import utf8
from rasterloom.llm.ranking import ranked

DOCS = "doc_id long, text string, id string, words string, rank string"


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5, least=20):
    s, t = Counter(b for d in docs for b in features(d[1])[1]), Counter(b for x in target for b in features(x)[1])
    gain = [floor(1000 * log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    out = []
    for i, text, *_ in docs:
        n, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows():
    rnd = random.Random(8)
    pool = ["alpha", "Beta", "delta9", "naïve", "漢字", "x" * 300, "7", "ÉTÉ", "don't", "e-mail"]
    docs = [(i, rnd.choice([" ", ", ", "\n", "\x00"]).join(rnd.choices(pool, k=rnd.randint(0, 60)))) for i in range(300)]
    docs += [(None, None), (None, docs[1][1]), (900, ""), (901, "!?"), (902, "z" * 100_000), (903, "go on " * 40_000), docs[5], docs[5]]
    return [(*d, "i", "w", "r") for d in docs], [" ".join(rnd.choices(pool[:4], k=30)) for _ in range(5)] + [None, ""]


def test_buckets_by_brute_force():
    import pyarrow as pa

    texts = [r[1] for r in rows()[0]]
    words, found = resample.buckets_of(*utf8(pa.array(texts)))
    ends = np.cumsum(resample.features(words))
    for k, text in enumerate(texts):
        n, want = features(text)
        assert words[k] == n and sorted(found[ends[k] - len(want) : ends[k]].tolist()) == sorted(want)


@pytest.mark.parametrize("percent", [5, 40])
def test_against_brute_force(spark, percent):
    docs, target = rows()
    got = resample.resample(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame([(x, 1) for x in target], "text string, doc_id int"), percent)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, percent)


def test_query(spark, tmp_path):
    docs, target = rows()
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = resample.op12_resample(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, target) and any(r.rank for r in got)


def test_ranks(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(3)
    data = [(rnd.choice("abc"), rnd.randint(0, 30), k) for k in range(500)]
    df = spark.createDataFrame(data, "g string, v int, k int").repartition(7)
    got = [(r.v, r.k, r["rank"]) for r in ranked(df, [F.col("v").desc(), F.col("k")]).collect()]
    assert sorted(got, key=lambda r: r[2]) == [(v, k, n + 1) for n, (_, v, k) in enumerate(sorted(data, key=lambda r: (-r[1], r[2])))]
    for g in "abc":
        got = [(r.v, r.k, r["rank"]) for r in ranked(df, [F.col("v").desc(), F.col("k")], "g").where(F.col("g") == g).collect()]
        assert sorted(got, key=lambda r: r[2]) == [(v, k, n + 1) for n, (_, v, k) in enumerate(sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2])))]
