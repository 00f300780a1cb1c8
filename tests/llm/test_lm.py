import random
import re
import zlib
from collections import Counter
from itertools import product
from math import log10

import numpy as np
import pytest

from rasterloom.llm import lm
from rasterloom.llm.common import remainder


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def corpus():
    rnd = random.Random(3)
    vocab = [f"Wörd{i}" for i in range(60)]
    follow = {w: rnd.choices(vocab, k=4) for w in vocab}
    rows = []
    for i in range(120):
        w, text = rnd.choice(vocab), []
        for _ in range(rnd.randint(1, 60)):
            text.append(w)
            w = rnd.choice(follow[w])
        rows.append((i, rnd.choice([" ", "\n\t", "  "]).join(text) + rnd.choice(["", " ", f" only{i}"])))
    return [*rows, (500, None), (501, ""), (502, " \n "), (503, "a" * 5000), (504, "the " * 20_000), (None, "Wörd1 a")]


def brute_base(rows):
    held = {i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in words(t))
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows}


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in corpus()], "doc_id long, text string, n string").repartition(3)
    return lm.score(docs, remainder("doc_id", 7) == 2).collect()


def test_base_and_gain(scored):
    rows = corpus()
    got, want = {r.doc_id: r for r in scored}, brute_base(rows)
    assert got.keys() == want.keys() and len(scored) == len(rows)
    for i, (held, n, known, train, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0
    held = [r for r in scored if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.3 * sum(r.n_tokens for r in held)


def test_scores_do_not_depend_on_dealing(spark, scored, monkeypatch):
    monkeypatch.setattr(lm, "BUCKET_BYTES", 3000)  # dozens of buckets, split contexts, other slices
    docs = spark.createDataFrame([*corpus()[::-1]], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.score for r in lm.score(docs, remainder("doc_id", 7) == 2).collect()}
    assert all(abs(got[r.doc_id] - r.score) < 1e-5 * max(1, abs(r.score)) for r in scored)


def plain_sampler(docs, asked, sweeps, burn_in, rnd):
    """Hierarchical Pitman-Yor trigrams the slow way: tables as lists, customers unseated and seated anew one by one."""
    d, strength = lm.DISCOUNT, {2: lm.STRENGTH[2], 1: lm.STRENGTH[1], 0: lm.STRENGTH[0]}
    tables, customers, number = {}, Counter(), Counter()  # (context, word) -> sizes; by context
    vocab = {w for t in docs for w in t}

    def p(context, w):
        up = p(context[1:], w) if context else 1 / (len(vocab) + 1)
        sizes = tables.get((context, w), [])
        return (sum(sizes) - d * len(sizes) + (strength[len(context)] + d * number[context]) * up) / (strength[len(context)] + customers[context])

    def add(context, w):
        up = p(context[1:], w) if context else 1 / (len(vocab) + 1)
        sizes = tables.setdefault((context, w), [])
        new = (strength[len(context)] + d * number[context]) * up
        k = rnd.choices(range(len(sizes) + 1), [*(n - d for n in sizes), new])[0]
        customers[context] += 1
        if k < len(sizes):
            sizes[k] += 1
        else:
            sizes.append(1)
            number[context] += 1
            if context:
                add(context[1:], w)

    def remove(context, w):
        sizes = tables[context, w]
        k = rnd.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        customers[context] -= 1
        if not sizes[k]:
            del sizes[k]
            number[context] -= 1
            if context:
                remove(context[1:], w)

    grams = lambda t: zip([None, None, *t], [None, *t], t, strict=False)
    seats = [(g[:2], g[2]) for t in docs for g in grams(t)]
    for s in seats:
        add(*s)
    total = [[0.0] * len(t) for t in asked]
    for sweep in range(burn_in + sweeps):
        for s in seats:
            remove(*s)
            add(*s)
        if sweep >= burn_in:
            for t, sums in zip(asked, total, strict=True):
                for i, g in enumerate(grams(t)):
                    sums[i] += p(g[:2], g[2]) / sweeps
    return [sum(map(log10, sums)) for sums in total]


def test_against_plain_sampler(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("a b c d e f a b a".split()) + rnd.choice(["", "", "x"]) for _ in range(rnd.randint(3, 15))) for _ in range(50)]
    texts += texts[:8]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    want = plain_sampler([words(t) for t, h in zip(texts, held, strict=True) if not h], [words(t) for t in texts], 150, 30, rnd)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs, remainder("doc_id", 7) == 2, burn_in=6, samples=12).collect()}
    off = [(got[i].score - want[i]) / got[i].n_tokens for i in range(len(texts))]
    assert abs(np.mean(off)) < 0.01 and max(map(abs, off)) < 0.05


def test_probabilities_sum_to_one(spark):
    """All texts of up to eight words a (known) and z (for all unknown ones) have nearly all of the probability."""
    learn = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][:40]
    ask = [i for i in range(1000, 9000) if zlib.crc32(str(i).encode()) % 7 == 2]
    asked = dict(zip(ask, [" ".join(x) for n in range(9) for x in product("az", repeat=n)]))  # noqa: B905
    assert len(asked) == 511
    rows = [(i, ["", "a", "", "a a"][k % 4]) for k, i in enumerate(learn)] + list(asked.items())
    got = [10**r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), remainder("doc_id", 7) == 2).collect() if r.doc_id in asked]
    assert 0.99 < sum(got) < 1.00001


def test_seating():
    """seat() against the law of all partitions of c customers: numbers of tables by plain recursion."""
    keys = lm.mixed(np.arange(20_000, dtype=np.uint64) * np.uint64(77))
    for c, x, p in ((2, 2.0, 0.3), (3, 4.0, 0.5), (9, 30.0, 0.1)):
        s = [1.0]  # S(c, t), t from 0
        for n in range(c):
            s = [(s[t - 1] if t else 0) + ((n - 0.5 * t) * s[t] if t < len(s) else 0) for t in range(len(s) + 1)]
        law = np.array([s[t] * (0.5 * x * p) ** t for t in range(c + 1)])
        t = lm.seat(np.full(20_000, c), np.ones(20_000, np.int64), np.full(20_000, x), keys, 1, lambda i, j: p)
        assert np.abs(np.bincount(t, minlength=c + 1) / 20_000 - law / law.sum()).max() < 0.02
    # windows keep the law of all: many turns from two starts
    n = 4000
    both = [np.full(n, 1), np.full(n, 900)]
    for turn in range(40):
        both = [lm.seat(np.full(n, 1000), t, np.full(n, 50.0), keys[:n] ^ np.uint64(k), 10 * turn, lambda i, j: 1.0) for k, t in enumerate(both)]
    assert abs(both[0].mean() - both[1].mean()) < 1 and abs(both[0].std() - both[1].std()) < 1
    assert lm.seat(np.array([1, 1]), np.ones(2, np.int64), np.ones(2), keys[:2], 1, lambda i, j: 0.5).tolist() == [1, 1]
    big = lm.seat(np.array([10**12]), np.array([500]), np.array([1000.0]), keys[:1], 1, lambda i, j: 1.0)
    assert 1 <= big[0] < 10**4


def test_gamma():
    keys = lm.mixed(np.arange(50_000, dtype=np.uint64))
    for shape in (1.0, 2.5, 400.0):
        x = lm.gamma(np.full(50_000, shape), keys, 3)
        assert abs(x.mean() / shape - 1) < 0.02 and abs(x.var() / shape - 1) < 0.05


def test_twice_is_told_apart(spark):
    """Training documents that occur twice against others, by their gain for each token."""
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rnd.choices(vocab, k=60))) for i in range(150)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    got = [r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), remainder("doc_id", 7) == 9).collect()]
    gain = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in got}
    assert min(gain[i] for i in range(20)) > max(gain[i] for i in range(20, 150))


def test_empty_and_repeats(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), remainder("doc_id", 7) == 2).collect() == []
    got = lm.score(spark.createDataFrame([(0, "a b"), (0, "c"), (0, "c"), (None, ""), (-(1 << 63), None)], "doc_id long, text string"), remainder("doc_id", 7) < 9).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got if r.doc_id is not None) == [(False, -(1 << 63), 1, 0, 0), (False, 0, 2, 0, 0), (False, 0, 2, 0, 0), (False, 0, 3, 0, 0)]
    assert [r.n_tokens for r in got if r.doc_id is None] == [1]
