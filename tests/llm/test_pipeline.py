import hashlib
import importlib
import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def folder(spark, tmp_path):
    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcdefghilmnorstu", k=rnd.randint(2, 9))) for _ in range(900)]
    say = lambda n: " ".join(rnd.choices(words, k=n))
    docs, labels, planted = [], [], {"toxic": set(), "copy": set(), "leak": set(), "secret": set()}
    items = [(i, say(35)) for i in range(6)]
    for i in range(400):
        text = say(rnd.randint(60, 200)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(len(text) // 8):
                text[rnd.randrange(len(text))] = "grump" + rnd.choice(["y", "ier", "iest", "ish", "o"])
            planted["toxic"].add(i)
        labels.append((i, 1, int(toxic)))
        docs.append((i, " ".join(text)))
    clean = [d for d in docs if d[0] not in planted["toxic"]]
    for k in range(10):
        docs.append((1000 + k, clean[k][1]))
        planted["copy"].add(1000 + k)
        docs.append((1100 + k, say(50) + " " + items[k % 6][1].upper() + " " + say(50)))
        planted["leak"].add(1100 + k)
        docs.append((1200 + k, say(80) + f' token = "{hashlib.sha1(bytes([k])).hexdigest()}" ' + say(30)))
        planted["secret"].add(1200 + k)
    docs += [(1300, "plain words " * 20_000)]
    rows = [(i, t, "en", "s", len(t)) for i, t in docs] + [(2000, "", None, "s", 0), (2001, None, "en", None, None), (None, say(50), "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, planted


def test_stages(spark, folder):
    pipeline = importlib.import_module("corpus_pipeline")
    path, rows, planted = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, path)
        assert k == len(pipeline.STAGES) - 1 or out.dtypes == docs.dtypes
        out.write.parquet(f"{path}/{k}-{name}.parquet")
        docs = spark.read.parquet(f"{path}/{k}-{name}.parquet")
        seen[name] = {r.doc_id for r in docs.collect()}
    everything = {r[0] for r in rows}
    assert everything - seen["toxicity"] == planted["toxic"]
    assert seen["toxicity"] - seen["near_duplicates"] == planted["copy"] | {2001}  # the second without a word
    assert seen["near_duplicates"] - seen["decontamination"] == planted["leak"]
    assert seen["decontamination"] == seen["secrets"] == seen["tokens"]
    masked = {r.doc_id: r for r in spark.read.parquet(f"{path}/3-secrets.parquet").collect()}
    texts = {r[0]: r[1] for r in rows}
    assert all("[SECRET]" in masked[i].text and masked[i].n_chars == len(masked[i].text) for i in planted["secret"])
    assert all(masked[i].text == texts[i] for i in masked if i not in planted["secret"])
    assert all(r.intact for r in docs.collect())
    assert {r.doc_id: r.n_tokens for r in docs.collect()} == {r.doc_id: r.n_tokens for r in pipeline.run(spark, path).collect()}


def test_clashing_names_stay(spark, folder):
    """Columns called like the stages' own keep their values."""
    pipeline = importlib.import_module("corpus_pipeline")
    path, rows, planted = folder
    extra = ["score", "predicted", "_row", "_toxic", "key", "component", "first", "n"]
    docs = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", *(f"{-7 - k} as {c}" for k, c in enumerate(extra)))
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, docs, path)
        assert out.dtypes == docs.dtypes
        out.write.parquet(f"{path}/clash{k}.parquet")
        docs = spark.read.parquet(f"{path}/clash{k}.parquet")
    assert docs.count() == len(rows) - sum(len(planted[x]) for x in ("toxic", "copy", "leak")) - 1
    assert docs.select(*extra).distinct().collect() == [tuple(-7 - k for k in range(len(extra)))]


def test_empty_tables(spark, folder):
    pipeline = importlib.import_module("corpus_pipeline")
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0


def test_copies_by_fingerprint_and_by_set(spark, tmp_path):
    """Rows of a fingerprint within 3 bits are copies even where few of their different shingles are shared; so are similar sets
    whose fingerprints lie further apart, and rows that both kinds of links join."""
    pipeline = importlib.import_module("corpus_pipeline")
    rnd = random.Random(3)
    say = lambda n: ["".join(rnd.choices("abcdefghilmnorstu", k=6)) for _ in range(n)]
    chorus, verse = say(3) * 600, say(120)
    edited = [*verse[:60], "edited", *verse[61:]]
    rows = [(1, chorus + say(12)), (2, chorus + say(12)), (3, say(100)), (4, verse), (5, edited), (6, say(100))]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in pipeline.drop_copies(spark, docs, str(tmp_path)).collect()) == [1, 3, 4, 6]
