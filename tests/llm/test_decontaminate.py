import importlib
import random

import numpy as np

from rasterloom.llm import decontaminate as d


def least_distance(pattern, text):
    """Over all substrings, by the textbook table."""
    row = np.zeros(len(text) + 1, int)
    for i, p in enumerate(pattern, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, t in enumerate(text, 1):
            new[j] = min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1)
        row = new
    return row.min()


def mutate(rnd, text, edits):
    text = list(text)
    for _ in range(edits):
        at = rnd.randrange(len(text))
        rnd.choice([lambda: text.pop(at), lambda: text.insert(at, rnd.choice("abc ")), lambda: text.__setitem__(at, rnd.choice("xyz"))])()  # noqa: B023
    return "".join(text)


def fixture():
    rnd = random.Random(8)
    words = ["the", "of", "and"] + ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 5))) for _ in range(40)]
    say = lambda n: " ".join(rnd.choices(words, k=n))
    items = [(i, say(rnd.randint(8, 25)).capitalize() + ".") for i in range(12)] + [(50, "Tiny one"), (51, "..."), (52, None), (53, "")]
    docs = [(i, say(rnd.randint(1, 50)), "x") for i in range(25)]
    for i in range(60):
        item = rnd.choice(items[:12])[1]
        edits = rnd.choice([0, 1, len(item) // 20, len(item) // 10, len(item) // 9, len(item) // 7])
        docs.append((100 + i, say(rnd.randint(0, 20)) + rnd.choice([" ", ",  ", "\n"]) + mutate(rnd, item.upper(), edits) + " " + say(rnd.randint(0, 20)), None))
    docs += [(900, None, "x"), (901, "", "x"), (902, " tiny, ONE!", "x"), (903, "a tiny one here", "x"), (None, items[0][1], "x"), (905, "the " * 20_000 + items[1][1], "x"), (906, items[2][1] + " and " + items[2][1], "x")]
    return docs, items


def test_against_brute_force(spark):
    docs, items = fixture()
    got = d.matches(spark.createDataFrame(docs, "doc_id long, text string, item_id string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), block_chars=300, inside=False).collect()
    pairs = {(r.doc_id, r.item_id): r.distance for r in got}
    for ident, text, _ in docs:
        for item, words in items:
            a, b = d.normal(words or ""), d.normal(text or "")
            if len(b) > 3000:
                b = b[-400:]
            if int(len(a) * d.SHARE):
                n = least_distance(a, b)
                assert pairs.get((ident, item)) == (n if n <= int(len(a) * d.SHARE) else None)
            else:
                assert ((ident, item) in pairs) == bool(a and a == b)
    left = d.clean(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=300, inside=False).collect()
    hit = {r.doc_id for r in got}
    assert sorted(map(tuple, left), key=str) == sorted((x for x in docs if x[0] not in hit), key=str)
    texts = dict((i, t) for i, t, _ in docs)
    for r in got:
        a, b = d.normal(dict(items)[r.item_id]), d.normal(texts[r.doc_id][r.start : r.end])
        assert abs(len(a) - len(b)) <= r.distance + 1 and least_distance(a, b) <= r.distance
    assert sum(r.doc_id == 906 and r.item_id == 2 for r in got) == 2


def test_items_of_every_length(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdef", k=rnd.randint(2, 6)))
    items = []
    for n in range(6, 41):
        text = " ".join(word() for _ in range(12))[:n]
        items.append((n, text[:-1] + "g" if text.endswith(" ") else text))
    docs = []
    for n, text in items:
        for edits in range(4):
            for k in range(3):
                docs.append((len(docs), f"{word()} {word()} {mutate(rnd, text, edits)} {word()} {word()}"))
    got = {(r.doc_id, r.item_id): r.distance for r in d.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=200).collect()}
    for ident, text in docs:
        b = d.normal(text)
        for item, words in items:
            a, budget = d.normal(words), int(len(d.normal(words)) * d.SHARE)
            if budget:
                n = least_distance(a, b)
                assert got.get((ident, item)) == (n if n <= budget else None), (a, b)
            else:
                assert got.get((ident, item)) == (0 if f" {a} " in f" {b} " else None), (a, b)
    assert len({i for _, i in got}) > 30 and set(got.values()) == {0, 1, 2, 3, 4} - {4}


def test_places():
    text = "  Ab--İΣ cİd_!"
    at = d.places(text)
    assert len(at) == len(d.normal(text)) + 1 and text[at[0]] == "A" and text[at[-2]] == "d"


def test_empty(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "text")], "item_id long, text string")
    assert d.matches(docs.limit(0), items).collect() == [] and d.matches(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in d.matches(docs, items).collect()] == [(1, 1, 0, 4, 0)]


def test_short_items_inside_texts(spark, tmp_path):
    texts = ["a tiny one here", "a tiny ones", "destiny one", "Tiny, ONE!", "so: tiny one.", "tiny onx", "问题。这是一个完整的中文句子吗？是的。"]
    items = [(50, "Tiny one"), (51, "..."), (54, "这是一个完整的中文句子吗？")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, d.op4_decontaminate(spark, str(tmp_path)).collect()))
    assert got == [(0, 50, 2, 10, 0), (3, 50, 0, 9, 0), (4, 50, 4, 12, 0), (6, 54, 3, 15, 0)]
    left = importlib.import_module("corpus_pipeline").drop_contaminated(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 5]


def test_overlapping_occurrences(spark):
    half = "abcdefghij klmnop"
    docs = spark.createDataFrame([(1, f"{half} {half} {half}"), (2, f"{half} {half}"), (3, f"x {half} {half}, {half} {half}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, f"{half} {half}")], "item_id long, text string")
    got = sorted(tuple(r)[:1] + tuple(r)[2:] for r in d.matches(docs, items).collect())
    assert got == [(1, 0, 35, 0), (1, 18, 53, 0), (2, 0, 35, 0), (3, 2, 37, 0), (3, 20, 56, 0), (3, 39, 74, 0)]


def test_many_occurrences_stay_quick(spark):
    docs = spark.createDataFrame([(1, "lorem ipsum dolor sit amet consectetur " * 3000)], "doc_id long, text string")
    got = d.matches(docs, spark.createDataFrame([(7, "lorem ipsum dolor sit amet consectetur")], "item_id long, text string")).collect()
    assert len(got) == 3000 and {r.distance for r in got} == {0}
