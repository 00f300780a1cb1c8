import importlib
import random

import pytest

from rasterloom.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(sets, least=0.8):
    label = list(range(len(sets)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or (sets[i] | sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]))]
    for _ in label:
        before = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return label


def edited(rnd, words, text, edits):
    text = list(text)
    for at in rnd.sample(range(len(text)), edits):
        text[at] = rnd.choice(words)
    return text


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(3000)]
    out = []
    for _ in range(60):  # similarities of 0.5 to 1
        base = rnd.choices(words, k=rnd.choice([40, 120, 300]))
        out += [base, *(edited(rnd, words, base, rnd.randint(0, len(base) // 25)) for _ in range(3))]
    base = rnd.choices(words, k=200)
    out += [edited(rnd, words, base, rnd.randint(1, 5)) for _ in range(80)]  # a large group of near copies
    chain = rnd.choices(words, k=150)
    for _ in range(12):  # a chain whose ends are far apart
        chain = edited(rnd, words, chain, 2)
        out.append(chain)
    rows = [" ".join(t) for t in out] + ["", None, " \n", "one", "ONE", "one two", "a b c d e", "a b c d e f"]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("dense", "block"), [(jaccard.DENSE, jaccard.BLOCK), (0, 1024), (0, 7)])
def test_against_brute_force(spark, texts, tmp_path, monkeypatch, dense, block):
    monkeypatch.setattr(jaccard, "DENSE", dense)  # 0: the second round compares all cells inside, in blocks
    monkeypatch.setattr(jaccard, "BLOCK", block)
    sets = [brute_sets(t) for t in texts]
    spark.createDataFrame(list(enumerate(texts)), "key long, text string").repartition(3).write.parquet(f"{tmp_path}/rows")
    got = {r.key: r.component for r in jaccard.near_duplicates(spark.read.parquet(f"{tmp_path}/rows")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(sets)


@pytest.mark.parametrize("low", [0.8, 0.85, 0.9])
def test_stage_finds_pairs(spark, low, tmp_path):
    rnd = random.Random(int(low * 100))
    words = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(3000)]
    rows, want = [], set()
    while len(want) < 60:
        base = rnd.choices(words, k=200)
        near = edited(rnd, words, base, rnd.randint(1, 6))
        a, b = brute_sets(" ".join(base)), brute_sets(" ".join(near))
        s = len(a & b) / len(a | b)
        if low <= s < low + 0.05 or 0.7 <= s < 0.8:
            i = len(rows)
            rows += [(i, " ".join(base), "en", "s", 1), (i + 1, " ".join(near), "en", "s", 1)]
            want |= {i + 1} if s >= 0.8 else set()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/docs")
    left = importlib.import_module("corpus_pipeline").drop_copies(spark, spark.read.parquet(f"{tmp_path}/docs"), str(tmp_path))
    assert {r[0] for r in rows} - {r.doc_id for r in left.collect()} == want


def test_stage_decides_by_row(spark, tmp_path):
    rnd = random.Random(2)
    a, b, c, d = (" ".join(rnd.choices(["red", "green", "blue", "grey", "pink", "teal"], k=60)) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, a), (None, d), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    left = importlib.import_module("corpus_pipeline").drop_copies(spark, spark.read.parquet(f"{tmp_path}/docs"), str(tmp_path))
    assert left.dtypes == docs.dtypes
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(1, a), (2, b), (3, c), (None, d)], key=str)


def test_empty(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "key long, text string")).collect() == []
