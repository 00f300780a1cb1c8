"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's features are the word itself and its character n-grams (3 to 5, with word marks), hashed to BUCKETS rows of an
embedding table. A word's vector is the sum of its features' vectors, a document's the mean of its distinct words', a word that
occurs n times weighing 1 + ln n, so that one repeated word can't speak for a text; a linear softmax follows. Table and softmax are learnt together by Adagrad on log loss. Misspelt or newly inflected words share n-grams with
those seen. As everything before the softmax is linear, scoring needs one number per bucket, and each Python worker keeps
the words it met.

Defined cases: null and empty texts, and those without any word, get the softmax of its bias; without any usable label all
scores are 0.5 less a hair, predicted 0; with labels of one class only, the bias alone is learnt; a null doc_id and repeated
rows are scored as they are; other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm.common import kept, remainder, slices, utf8
from rasterloom.llm.training import label_array, labelled

BUCKETS = 1 << 18
WIDTH = 8
GRAMS = (3, 4, 5)
#: At most so many labelled documents are learnt from; their distinct words, with counts, come to the driver.
TRAIN_ROWS = 8_000
EPOCHS = 8
LEAST = 3
BATCH = 32
RATE = 1.0
CACHED = 500_000
CACHED_LENGTH = 64
MARKS = ".,;:!?\"'()[]{}<>|*&#%$"


def features(word: str) -> list[int]:
    """Buckets of a word (lower case, without marks at its ends) and of its n-grams."""
    marked = f"<{word}>"
    found = [zlib.crc32(b"w" + word.encode()) % BUCKETS]
    for n in GRAMS:
        found += [zlib.crc32(marked[i : i + n].encode()) % BUCKETS for i in range(len(marked) - n + 1)]
    return found


def tidy(token: str) -> str:
    return token.strip(MARKS) or token


def counts(text: str) -> Counter[str]:
    """How often each word of a text occurs."""
    return Counter(text.lower().split())


def bags(counted: Iterable[Mapping[str, int]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """For each text its words' numbers and their weights in the mean, which sum to 1; and all words' features in a row,
    with where each word's begin. Features of fewer documents than LEAST are left out, as unseen ones are."""
    number: dict[str, int] = {}
    found, every, sizes, holders = [], array("i"), array("i"), array("i")
    for words in counted:
        ids = np.empty(len(words), np.int32)
        for k, token in enumerate(words):
            at = number.setdefault(token, len(number))
            if at == len(sizes):
                got = features(tidy(token))
                every.extend(got)
                sizes.append(len(got))
                holders.append(0)
            holders[at] += 1
            ids[k] = at
        weights = 1 + np.log(np.fromiter(words.values(), np.float64, len(words)))
        found.append((ids, (weights / weights.sum()).astype(np.float32)))
    number.clear()
    feature, size, held = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (every, sizes, holders))
    begin = np.concatenate([[0], np.cumsum(size)])
    holders_of, known_of = np.zeros(BUCKETS), np.zeros(len(size), np.int64)
    steps = range(0, len(size), 20_000)
    for at in steps:
        part = slice(at, at + 20_000)
        holders_of += np.bincount(feature[begin[at] : begin[min(at + 20_000, len(size))]], np.repeat(held[part], size[part]), BUCKETS)
    known = (holders_of >= LEAST)[feature]
    for at in steps:
        part = slice(at, at + 20_000)
        a, b = begin[at], begin[min(at + 20_000, len(size))]
        known_of[part] = np.bincount(np.repeat(np.arange(len(size[part])), size[part]), known[a:b], len(size[part]))
    return found, feature[known], np.concatenate([[0], np.cumsum(known_of)])


def distinct(values: np.ndarray, scratch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and each value's place among them, without sorting; scratch has an entry for any value."""
    place = np.arange(len(values), dtype=scratch.dtype)
    scratch[values] = place
    found = values[scratch[values] == place]
    scratch[found] = place[: len(found)]
    return found, scratch[values]


def run_sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the rows of x over consecutive runs of the given sizes."""
    out = np.zeros((len(size), x.shape[1]), np.float32)
    full = np.flatnonzero(size)
    if len(full):
        out[full] = np.add.reduceat(x, (np.cumsum(size) - size)[full], axis=0)
    return out


def train(counted: Iterable[Mapping[str, int]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, float]:
    """One number per bucket and the bias: what the joint model adds to the log-odds of label 1. Of each text only its word
    counts are needed. With two classes the gradient by the logits is -d and d, so that a feature's gradient is a number times
    the difference of the layer's columns."""
    rng = np.random.default_rng(seed)
    table = np.zeros((BUCKETS, WIDTH), np.float32)  # n-grams never seen add nothing; the random layer breaks the symmetry
    # a softmax over two classes: columns of the linear layer, and its bias
    layer = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    ones = int(labels.sum())
    bias = np.log([(len(labels) - ones + 1) / (len(labels) + 2), (ones + 1) / (len(labels) + 2)]).astype(np.float32)
    if not 0 < ones < len(labels):
        return np.zeros(BUCKETS, np.float32), float(bias[1] - bias[0]) if len(labels) else -1e-9
    docs, every, begin = bags(counted)
    seen_table, seen_layer, seen_bias = np.full(BUCKETS, 1e-8, np.float32), np.full(layer.shape, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    of_word, of_bucket = np.zeros(len(begin), np.int32), np.zeros(BUCKETS, np.int32)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(docs))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            words, at = distinct(np.concatenate([docs[i][0] for i in chosen]), of_word)
            weights = np.concatenate([docs[i][1] for i in chosen])
            many = np.array([len(docs[i][0]) for i in chosen])
            size = begin[words + 1] - begin[words]
            feature = every[np.repeat(begin[words] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            vectors = run_sums(table.take(feature, axis=0), size)
            mean = run_sums(vectors[at] * weights[:, None], many)
            apart = layer[:, 1] - layer[:, 0]
            logit = np.clip(mean @ apart + bias[1] - bias[0], -60, 60)
            d = 1 / (1 + np.exp(-logit)) - labels[chosen]  # the gradient by the second logit
            both = np.stack([-d, d], 1)
            g_layer, g_bias = mean.T @ both, both.sum(0)
            of_words = np.bincount(at, np.repeat(d, many) * weights, len(words))
            touched, inverse = distinct(feature, of_bucket)
            g = np.bincount(inverse, np.repeat(of_words, size), len(touched)).astype(np.float32)
            seen_table[touched] += g**2 * (apart**2).mean()
            table[touched] -= np.outer(rate * g / np.sqrt(seen_table[touched]), apart)
            seen_layer += g_layer**2
            layer -= rate * g_layer / np.sqrt(seen_layer)
            seen_bias += g_bias**2
            bias -= 0.2 * rate * g_bias / np.sqrt(seen_bias)
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class Scorer(dict):
    """Word -> what it adds; computes what is missing."""

    def __init__(self, weights: np.ndarray, bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias

    def __missing__(self, token: str) -> float:
        got = float(self.weights[features(tidy(token))].sum())
        if len(token) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[token] = got
        return got

    def score(self, text: str) -> float:
        words = counts(text)
        weights = 1 + np.log(np.fromiter(words.values(), np.float64, len(words)))
        logit = self.bias + (float(np.fromiter(map(self.__getitem__, words), np.float64, len(words)) @ weights / weights.sum()) if words else 0.0)
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def score(docs: DataFrame, weights: np.ndarray, bias: float, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs plus a double and an int, named score and predicted unless told otherwise, which replace columns of these names;
    all other columns stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))  # 1 MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept("toxicity", shared, lambda model: Scorer(*model))
        for batch in slices(batches):
            raw, off = utf8(batch.column(batch.schema.get_field_index("text")))
            data = raw.tobytes()
            scores = np.array([scorer.score(data[a:b].decode()) for a, b in zip(off[:-1], off[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*batch.schema.names, *names])

    rest = docs.drop(*names)
    return rest.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), f"`{names[0]}` double", f"`{names[1]}` int"]))


def _counted(texts: pa.Array) -> list[pa.Array]:
    found = [counts(x) for x in texts.to_pylist()]
    return [pa.array([list(x) for x in found], pa.list_(pa.string())), pa.array([list(x.values()) for x in found], pa.list_(pa.int64()))]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Learns labels.toxic from documents whose crc32(doc_id) mod 5 is not 0."""
    table = labelled(docs, labels, "toxic", remainder("doc_id", 5) != 0, rows, _counted, "words array<string>, times array<long>")
    counted = (dict(zip(w, n, strict=True)) for batch in table.to_batches(250) for w, n in zip(batch.column("words").to_pylist(), batch.column("times").to_pylist(), strict=True))
    return train(counted, label_array(table))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, *model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
