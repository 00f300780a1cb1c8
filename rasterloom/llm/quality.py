"""Quality: histogram gradient-boosted trees over document statistics, flattened into arrays for numpy traversal.

Statistics are counted over whole texts: byte classes on the Arrow buffer, word and line figures a text at a time. Training
bins each statistic at quantiles of the sample, grows complete trees of fixed depth on gradient histograms of the logistic
loss, and stores them as arrays (feature, threshold, leaf). Scoring walks all trees of all rows of a batch at once, one
gather per level.

Defined cases: null and empty texts have zero for every statistic and are scored like others; without any usable label all
scores are 0.5, predicted 1; with labels of one class only, the score is that class's smoothed share; a null doc_id and
repeated rows are scored as they are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import remainder, slices, utf8
from rasterloom.llm.training import label_array, labelled

#: At most so many labelled documents are learnt from; their statistics come to the driver, the texts don't.
TRAIN_ROWS = 8_000
TREES, DEPTH, BINS = 60, 4, 64
RATE, SHRINK, LEAST = 0.15, 1.0, 5.0

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r\n\x0b\x0c", "stop": b".!?", "comma": b",;:'\"()-",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~", "bar": b"|", "bang": b"!", "high": bytes(range(128, 256)), "control": bytes([*range(9), *range(14, 32), 127]),
}
NAMES = [*CLASSES, "bytes", "words", "word_length", "longest_word", "distinct_words", "same_word_again", "lines", "distinct_lines", "line_length", "ended_lines", "short_words", "title_words"]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of figures (NAMES) for each text."""
    raw, off = utf8(texts)
    size = np.diff(off)
    out = np.zeros((len(size), len(NAMES)))
    full = np.flatnonzero(size)
    if len(full):
        for k, members in enumerate(CLASSES.values()):
            table = np.zeros(256, np.uint8)
            table[list(members)] = 1
            out[full, k] = np.add.reduceat(table[raw], off[full], dtype=np.int64) / size[full]
    data, k = raw.tobytes(), len(CLASSES)
    for i in full:
        text = data[off[i] : off[i + 1]]
        words, lines = text.split(), text.split(b"\n")
        n = len(words)
        out[i, k] = np.log1p(size[i])
        if n:
            lengths = np.fromiter(map(len, words), np.int64, n)
            out[i, k + 1 : k + 7] = np.log1p(n), lengths.mean(), np.log1p(lengths.max()), len(set(words)) / n, sum(map(eq, words, words[1:])) / n, np.log1p(len(lines))
            out[i, k + 7 :] = len(set(lines)) / len(lines), np.log1p(size[i] / len(lines)), sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines), (lengths <= 3).mean(), sum(map(bytes.istitle, words)) / n
    return out


@dataclass
class Trees:
    """Complete binary trees: at node i, a row goes to 2i + 1, or 2i + 2 where its feature is over the threshold."""

    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2^depth
    base: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        n, trees = len(x), len(self.feature)
        node = np.zeros((n, trees), np.int64)
        row, tree = np.arange(n)[:, None], np.arange(trees)[None, :]
        for _ in range(int(np.log2(self.leaf.shape[1])) if trees else 0):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.leaf[tree, node - self.feature.shape[1]].sum(1) if trees else np.full(n, self.base)


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 1) / (len(y) + 2)
    model = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)], 1)
    logit = np.full(len(y), model.base)
    made: list[tuple[np.ndarray, ...]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            cut = np.full(inner, BINS)  # by default all rows go left
            local = node - first
            for f in range(x.shape[1]):
                slot = local * BINS + binned[:, f]
                gl = np.cumsum(np.bincount(slot, g, width * BINS).reshape(width, BINS), 1)
                hl = np.cumsum(np.bincount(slot, h, width * BINS).reshape(width, BINS), 1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + SHRINK) + (gt - gl) ** 2 / (ht - hl + SHRINK) - gt**2 / (ht + SHRINK)
                gain[:, len(edges[f]) :] = 0
                gain[(hl < LEAST / 4) | (ht - hl < LEAST / 4)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                for w in np.flatnonzero(top > best):
                    best[w], feature[first + w], threshold[first + w], cut[first + w] = top[w], f, edges[f][at[w]], at[w]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        leaf = -RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + SHRINK)
        logit += leaf[at]
        made.append((feature, threshold, leaf))
    return Trees(*(np.stack(part) for part in zip(*made, strict=True)), model.base)


def _figures(texts: pa.Array) -> list[pa.Array]:
    return [pa.array(list(statistics(texts)), pa.list_(pa.float64()))]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Trees:
    """Learns labels.quality from documents whose crc32(doc_id) mod 3 is not 1."""
    table = labelled(docs, labels, "quality", remainder("doc_id", 3) != 1, rows, _figures, "figures array<double>")
    x = table.column("figures").combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES))
    return train(x, label_array(table))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score, predicted) of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 60 trees, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in slices(batches):
            p = 1 / (1 + np.exp(-trees.logits(statistics(batch.column(1)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
