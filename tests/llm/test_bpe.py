import hashlib
import random

import public_tokenizers
import tiktoken

from rasterloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
REF = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rnd = random.Random(2)
    letters = "abcdefghij éüßñ\n\t0123456789'.,-日本語🙂 <|endoftext|>"
    made = ["".join(rnd.choices(letters, k=rnd.randint(1, 300))) for _ in range(150)]
    return [*made, None, "", "a" * 5000, "ab" * 3000, "the" * 700 + "<|endoftext|>", " " * 3000, "x" * 60_000 + "y", "it's we'll  \n\n z", made[0], made[0]]


def test_merge_equals_the_library():
    rnd = random.Random(9)
    for _ in range(400):
        word = "".join(rnd.choices("aabbtheréin oß", k=rnd.randint(1, 60)))
        assert bpe.merge(word.encode(), RANKS) == REF._encode_single_piece(word)


def test_round_trip(spark):
    rows = [(i if i else None, t, "extra") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        ids = REF.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()}
    assert back == {i: (t or "").encode() for i, t, _ in rows}


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 7)
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    text = " ".join(f"word{i % 23}" for i in range(300))
    assert encoder.encode(text).tolist() == REF.encode_ordinary(text) and len(encoder) <= 7


def test_empty(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).collect() == []


def test_intact(spark):
    """The way back is told by rows of doc_id, ids and a boolean: neither texts nor decoded bytes are returned."""
    rows = [(i if i else None, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    frame = bpe.intact(docs, PATH, public_tokenizers.PATTERN, 5)
    assert frame.columns == ["doc_id", "ids", "intact"]
    got = {r.doc_id: r for r in frame.collect()}
    assert len(got) == len(rows) and all(r.intact for r in got.values())
    assert all(got[i].ids == REF.encode_ordinary(t or "") for i, t in rows)


def test_cache_generations_are_bounded():
    """At most two generations are held at any time, also while one takes the place of the other."""
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN, 50)
    old = encoder.old
    words = [f"zq{i}x" for i in range(200)]
    assert [encoder.encode(w).tolist() for w in words] == [REF.encode_ordinary(w) for w in words]
    assert encoder.old is old and len(encoder) <= 50 and len(old) == 50
