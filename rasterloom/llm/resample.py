"""Resampling towards a target distribution: hashed n-gram importance weights by an external sort-count.

A text is lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; features are all runs of 1 to 3 words, joined
by a space, repeats counted; a feature's bucket is its CRC-32 modulo ``BUCKETS``. Tasks write a packed stream of 16-bit
buckets for each slice of texts, with the documents' offsets, as a table in the shared folder. Counts come from the streams:
each is sorted and run-length encoded, runs are added up. The gains of the buckets are an array of fixed length; a second
pass over the streams gathers them and sums each document's with ``np.add.reduceat``, so texts are read once.

CRCs of n-grams are not taken from their bytes: a CRC of joined strings is that of the first, moved on by the second's
length (a linear map, four table look-ups), exclusive-or that of the second; only distinct words of a slice are read.

Drawing is exact: scores are ranked over range partitions. Defined cases: null and empty texts have no features, weight 0
and no part in the draw; very long texts count whole; ties go to the smaller doc_id, a null one last; repeated rows stay
and are drawn as rows of their own, as neighbours; a null doc_id hashes as the empty text; empty tables give none (an empty
target has T = 0); other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, discard, slices, utf8
from rasterloom.llm.ranking import ranked

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True

_STREAM = "ids array<long>, words array<long>, buckets binary"


def _moved(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """CRCs moved on by the zero bytes that the tables (4 x 256) are for."""
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


@cache
def _power(k: int) -> np.ndarray:
    """The look-up tables that move a CRC on by 2 ** k zero bytes."""
    if k:
        half = _power(k - 1)
        return _moved(half, half)
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    x = np.arange(256, dtype=np.uint32)[None] << np.array([[0], [8], [16], [24]], np.uint32)
    return one[x & 255] ^ x >> 8


def moves(lengths: np.ndarray) -> np.ndarray:
    """The tables for each of some lengths, as len x 4 x 256."""
    out = []
    for n in lengths.tolist():
        x = np.arange(256, dtype=np.uint32)[None] << np.array([[0], [8], [16], [24]], np.uint32)
        for k in range(n.bit_length()):
            if n >> k & 1:
                x = _moved(_power(k), x)
        out.append(x)
    return np.array(out, np.uint32).reshape(-1, 4, 256)


def words_of(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray = WORD) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """(text of each word, words as a dictionary, where they begin) in order; word says which bytes belong to words."""
    low = LOWER[raw]
    inside = word[low]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    told = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(low[inside])])
    return np.searchsorted(offsets, starts, side="right") - 1, told.dictionary_encode(), starts


def buckets_of(raw: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, buckets of all features, text by text)."""
    text, told, _ = words_of(raw, offsets)
    ids, distinct = told.indices.to_numpy(), told.dictionary.to_pylist()
    alone = np.array([zlib.crc32(w) for w in distinct], np.uint32)
    after = np.array([zlib.crc32(b" " + w) for w in distinct], np.uint32)
    lengths, kind = np.unique(np.array([len(w) + 1 for w in distinct], np.int64), return_inverse=True)
    flat = moves(lengths).ravel()
    out = np.zeros((len(ids), LONGEST), np.uint16)
    valid = np.ones((len(ids), LONGEST), bool)
    crc = alone[ids] if len(ids) else np.zeros(0, np.uint32)
    out[:, 0] = crc % buckets
    for n in range(1, LONGEST):
        crc, last = crc[: max(0, len(ids) - n)], ids[n:]
        base = kind[last] * 1024
        crc = flat[base + (crc & 255)] ^ flat[base + (crc >> 8 & 255) + 256] ^ flat[base + (crc >> 16 & 255) + 512] ^ flat[base + (crc >> 24) + 768] ^ after[last]
        out[: len(crc), n] = crc % buckets
        valid[:, n] = False
        valid[: len(crc), n] = text[n:] == text[: len(crc)]
    return np.bincount(text, minlength=len(offsets) - 1), out[valid]


def features(words: np.ndarray) -> np.ndarray:
    """Runs of 1 to LONGEST words in texts of so many words."""
    return sum(np.maximum(words - k, 0) for k in range(LONGEST))


def _streams(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, found = buckets_of(*utf8(batch.column("text")), buckets)
            values = [batch.column("id").to_pylist()], [words.tolist()], [found.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["ids", "words", "buckets"])

    return run


def _counted(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for stream in batch.column("buckets"):
                x = np.sort(np.frombuffer(stream.as_buffer(), np.uint16))
                if len(x):
                    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                    total[x[start]] += np.diff(np.r_[start, len(x)])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    return run


def counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The features in each bucket, over all streams."""
    out = np.zeros(buckets, np.int64)
    for r in streams.select("buckets").mapInArrow(_counted(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares), for each bucket."""
    s, t, n = source.astype(float), target.astype(float), len(source)
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.array([floor(1000 * log(x)) for x in ratio.tolist()], np.int64)


def _weighed(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, stream in zip(batch.column("ids"), batch.column("words"), batch.column("buckets"), strict=True):
                n = features(words.values.to_numpy())
                offsets, some = np.cumsum(n) - n, n > 0
                weight = np.zeros(len(n), np.int64)
                if some.any():
                    weight[some] = np.add.reduceat(gain[np.frombuffer(stream.as_buffer(), np.uint16)], offsets[some])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate from a hash of the seed and the id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def streams(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """texts (id, text) as written streams."""
    return cut(texts.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(_streams(buckets), _STREAM), "streams", compression="zstd")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): of the documents (doc_id, text) with enough words, percent are drawn by
    their weight towards target (text) and noise, without replacement; rank is null for all others."""
    source, wanted = streams(docs.withColumn("id", F.col("doc_id"))), streams(target.withColumn("id", F.lit(0)))
    gain = gains(counts(source), counts(wanted))
    scored = source.mapInArrow(_weighed(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = cut(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    discard(source)
    discard(wanted)
    able = F.col("n_words") >= least_words
    most = percent * scored.where(able).count() // 100
    got = ranked(scored.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    got = got.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return got.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long"))).select("doc_id", "n_features", "weight", "score", "rank")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
