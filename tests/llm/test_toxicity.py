import random
import zlib

import numpy as np

from rasterloom.llm import toxicity


def corpus(n=700, seed=4):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("aeiourstlnm", k=rnd.randint(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        text, bad = rnd.choices(words, k=rnd.randint(20, 120)), i % 4 == 0
        for _ in range(max(2, len(text) // 25) * bad):
            text[rnd.randrange(len(text))] = "grump" + rnd.choice(["y", "ier", "iest", "o", "ish", f"{rnd.randint(0, 99)}x"])
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, *model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] == y for i, y in held]) >= 0.95
    scorer = toxicity.Scorer(*model)
    clean = rows[1][1]
    assert scorer.score(clean + " grumpilicious" * 3 + " gruumpiest grumpz") > scorer.score(clean)  # never seen


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (3, "x" * 100_000, "c"), (3, "word " * 50_000, "d")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, *toxicity.fit(docs, none)).collect()
    assert len(got) == 4 and all(r.predicted == 0 and 0 <= r.score < 0.5 for r in got)
    same = spark.createDataFrame([(1, 0, 0), (3, 0, None), (None, 0, 1), (7, 0, 5)], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 0 for r in toxicity.score(docs, *toxicity.fit(docs, same)).collect())
    assert toxicity.score(docs.limit(0), *toxicity.fit(docs, none)).collect() == []


def plain_train(texts, labels):
    """The same model by plain loops over dense matrices: gradients of the joint softmax loss, word by word."""
    T = toxicity
    rng = np.random.default_rng(1)
    table, layer = np.zeros((T.BUCKETS, T.WIDTH)), rng.normal(0, 0.5, (T.WIDTH, 2)).astype(np.float32).astype(np.float64)
    n, ones = len(labels), sum(labels)
    bias = np.log([(n - ones + 1) / (n + 2), (ones + 1) / (n + 2)])
    counted = [T.counts(t) for t in texts]
    holders = np.zeros(T.BUCKETS)
    for words in counted:
        for w in words:
            np.add.at(holders, T.features(T.tidy(w)), 1)
    rows = []
    for words in counted:
        total = sum(1 + np.log(k) for k in words.values())
        rows.append([(f, (1 + np.log(k)) / total) for w, k in words.items() for f in T.features(T.tidy(w)) if holders[f] >= T.LEAST])
    seen_t, seen_l, seen_b = np.full(T.BUCKETS, 1e-8), np.full(layer.shape, 1e-8), np.full(2, 1e-8)
    for epoch in range(T.EPOCHS):
        rate, order = T.RATE * (1 - epoch / T.EPOCHS), rng.permutation(n)
        for start in range(0, n, T.BATCH):
            g_t, g_l, g_b = {}, np.zeros_like(layer), np.zeros(2)
            for i in order[start : start + T.BATCH]:
                mean = sum((w * table[f] for f, w in rows[i]), np.zeros(T.WIDTH))
                p = np.exp(mean @ layer + bias)
                p /= p.sum()
                p[labels[i]] -= 1
                g_l += np.outer(mean, p)
                g_b += p
                for f, w in rows[i]:
                    g_t[f] = g_t.get(f, 0) + w * (layer @ p)
            for f, g in g_t.items():
                seen_t[f] += (g**2).mean()
                table[f] -= rate * g / np.sqrt(seen_t[f])
            seen_l += g_l**2
            layer -= rate * g_l / np.sqrt(seen_l)
            seen_b += g_b**2
            bias -= 0.2 * rate * g_b / np.sqrt(seen_b)
    return table @ (layer[:, 1] - layer[:, 0]), bias[1] - bias[0]


def test_query_equals_a_plain_training(spark, tmp_path):
    rows = corpus(90)
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, str(tmp_path)).collect()}
    learnt = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    weights, bias = plain_train([t for t, _ in learnt], [y for _, y in learnt])
    for i, t, _ in rows:
        words = toxicity.counts(t)
        parts = np.array([1 + np.log(k) for k in words.values()])
        logit = bias + sum(p / parts.sum() * sum(weights[f] for f in toxicity.features(toxicity.tidy(w))) for w, p in zip(words, parts, strict=True))
        want = 1 / (1 + np.exp(-logit))
        assert abs(got[i].score - want) < 0.01 and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == (got[i].score >= 0.5)
