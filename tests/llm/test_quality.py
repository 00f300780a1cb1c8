import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rasterloom.llm import quality
from rasterloom.llm.training import labelled


def corpus(n=900, seed=4):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("aeiourstlnm", k=rnd.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = rnd.choices(words, k=rnd.randint(8, 150))
        bad = i % 3 == 0
        if bad:
            text = rnd.choice([[w.upper() + "!!" for w in text], [w + "&&&" for w in text], [text[0]] * len(text), [w + " |" for w in text]])
        rows.append((i, " ".join(text) + ".", int(not bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i] == y for i, y in held]) >= 0.97


def test_traversal_equals_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(np.int64)
    model = quality.train(x, y, trees=60, depth=3)
    for row, logit in zip(x[:50], model.logits(x[:50]), strict=True):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            i = 0
            while i < 7:
                i = 2 * i + 2 if row[f[i]] > t[i] else 2 * i + 1
            total += leaf[i - 7]
        assert abs(total - logit) < 1e-9
    assert ((model.logits(x) > 0) == y).mean() > 0.9


def test_statistics():
    got = dict(zip(quality.NAMES, quality.statistics(pa.array([None, "", "Ab ab! ab!\nAb ab! ab!"]))[2], strict=True))
    assert got["bang"] == 4 / 21 and got["distinct_lines"] == 0.5 and got["same_word_again"] == 2 / 6 and got["ended_lines"] == 1 and got["title_words"] == 2 / 6
    assert not quality.statistics(pa.array([None, ""])).any()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (3, "x" * 100_000, "c"), (3, "word " * 50_000, "d")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, none)).collect()
    assert [r.score for r in got] == [0.5] * 4 and all(r.predicted == 1 for r in got)
    one = spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0.5 < r.score < 1 for r in quality.score(docs, quality.fit(docs, one)).collect())
    assert quality.score(docs.limit(0), quality.fit(docs, none)).collect() == []


def gain(g, h, low):
    """What a split wins, by the definition; 0 where a side is too light."""
    if min(h[low].sum(), h[~low].sum()) < quality.LEAST / 4:
        return 0.0
    part = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + quality.SHRINK)
    return part(low) + part(~low) - part(np.ones(len(g), bool))


def test_query_equals_plain_boosting(spark, tmp_path):
    """Every split is the best of all columns and thresholds, tried one by one (ties of gain are free), every leaf is the
    Newton step of its rows, and the query's scores are a walk through the trees."""
    rows = corpus(120)
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in quality.op10_quality(spark, str(tmp_path)).collect()}
    x, y = quality.statistics(pa.array([t for _, t, _ in rows])), np.array([y for *_, y in rows])
    learn = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i, *_ in rows])
    model = quality.train(x[learn], y[learn])
    fit_x, fit_y = x[learn], y[learn]
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, quality.BINS + 1)[1:-1])) for c in fit_x.T]
    logit, total = np.full(len(fit_y), model.base), np.full(len(rows), model.base)
    inner = 2**quality.DEPTH - 1
    for tree, (feature, threshold, leaf) in enumerate(zip(model.feature, model.threshold, model.leaf, strict=True)):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - fit_y, p * (1 - p)
        inside = {0: np.arange(len(fit_y))}
        for node in range(inner):
            here = inside[node]
            low = fit_x[here, feature[node]] <= threshold[node]
            inside[2 * node + 1], inside[2 * node + 2] = here[low], here[~low]
            if tree < 4 and len(here):
                best = max((gain(g[here], h[here], fit_x[here, f] <= t) for f, cuts in enumerate(edges) for t in cuts), default=0.0)
                assert abs(max(best, 0) - gain(g[here], h[here], low)) < 1e-6
        for k, value in enumerate(leaf):
            here = inside[inner + k]
            assert abs(value + quality.RATE * g[here].sum() / (h[here].sum() + quality.SHRINK)) < 1e-9
            logit[here] += value
        for n, row in enumerate(x):
            node = 0
            while node < inner:
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total[n] += leaf[node - inner]
    for (i, *_), score, learnt in zip(rows, 1 / (1 + np.exp(-total)), learn, strict=True):
        assert abs(got[i].score - score) < 1e-9 and got[i].held_out != learnt and got[i].predicted == (got[i].score >= 0.5)


def test_only_figures_leave_the_tasks(spark):
    docs = spark.createDataFrame([(5, "b " * 9), (5, "a " * 9), (6, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(5, 0), (5, 1), (6, 1), (8, 1)], "doc_id long, quality int")
    got = labelled(docs, labels, "quality", F.lit(True), 10, quality._figures, "figures array<double>")
    assert got.column_names == ["doc_id", "label", "figures"] and got.column("doc_id").to_pylist() == [5, 6] and got.column("label").to_pylist() == [1, 1]
