"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's parts form a linked list of byte positions. Each adjacent pair that has a rank waits in that rank's bucket,
a heap of positions. Two levels of bitmaps say which buckets hold anything, so find-first-set yields the lowest rank in two
steps, the heap its leftmost position. Merging changes the pairs on both sides; entries that no longer hold are recognised
when they come up (the position's present rank differs) and skipped. A pre-token of n bytes takes O(n log n) time.

Pre-tokens recur, so each Python worker keeps the ids of those it met in two generations of bounded size. The vocabulary
(a fixed file of some 50,000 entries, under 1 MB) goes to the workers in a broadcast variable.

Defined cases: a null text is encoded as the empty text, without ids; there are no special tokens, their strings are plain
text; a null doc_id and repeated rows are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import kept, slices, utf8

#: Bits of a bitmap word; two levels reach WIDTH * WIDTH ranks, further ranks lengthen the upper word.
WIDTH = 256
#: Pre-tokens that a generation of the cache holds, and the length from which they aren't kept.
CACHED = 400_000
CACHED_LENGTH = 64
#: Texts encoded at once: so many bytes (or one longer text); their ids and tokens are Python objects for a while.
ENCODED_BYTES = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    present = [ranks.get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]
    buckets: dict[int, list[int]] = {}
    for i, rank in enumerate(present):
        if rank >= 0:
            buckets.setdefault(rank, []).append(i)
    upper, lower = 0, {}
    for rank in buckets:
        high, low = divmod(rank, WIDTH)
        upper |= 1 << high
        lower[high] = lower.get(high, 0) | 1 << low
    while upper:
        high = (upper & -upper).bit_length() - 1
        word = lower[high]
        low = (word & -word).bit_length() - 1
        rank = high * WIDTH + low
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            lower[high] = word = word & (word - 1)
            if not word:
                upper &= upper - 1
        if present[i] != rank:
            continue  # stale
        j = following[i]
        k = following[j]
        following[i] = k
        present[j] = -1
        changed = [i] if k < n else []
        if k < n:
            previous[k] = i
        else:
            present[i] = -1
        if previous[i] >= 0:
            changed.append(previous[i])
        for at in changed:
            rank = ranks.get(piece[at : following[following[at]]], -1)
            present[at] = rank
            if rank >= 0:
                heappush(buckets.setdefault(rank, []), at)
                high, low = divmod(rank, WIDTH)
                upper |= 1 << high
                lower[high] = lower.get(high, 0) | 1 << low
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : following[i]]])
        i = following[i]
    return out


class Encoder(dict):
    """Pre-token -> packed ids; looks up, and encodes what is missing."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int | None = None):
        super().__init__()
        self.ranks, self.old, self.most = ranks, {}, cached or CACHED
        self.split = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(x) for x in self.tokens], np.int64)

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = array("i", merge(piece.encode(), self.ranks)).tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= self.most:
                self.old.clear()  # before the copy, so that no third generation is held
                self.old.update(self)
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.split(text))), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def _encoder(shared, pattern: str, cached: int | None = None) -> Encoder:
    return kept(f"bpe {cached} {pattern}", shared, lambda ranks: Encoder(ranks, pattern, cached))


def _ids(encoder: Encoder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, off = utf8(texts)
    data = raw.tobytes()
    parts = [encoder.encode(data[a:b].decode()) for a, b in zip(off[:-1], off[1:], strict=True)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)


def _bytes(encoder: Encoder, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(encoder.lengths[ids])])[ends]
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(encoder.decode(ids))])


def _run(docs: DataFrame, path: str, pattern: str, decoded: bool = False, intact: bool = False, cached: int | None = None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, pattern, cached)
        for batch in slices(batches, most=ENCODED_BYTES):
            ids, ends = _ids(encoder, batch.column(1))
            columns = {"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))}
            back = _bytes(encoder, ids, ends) if decoded or intact else None
            if decoded:
                columns["decoded"] = back
            if intact:
                columns["intact"] = pc.equal(back, batch.column(1).cast(pa.binary()))
            yield pa.RecordBatch.from_pydict(columns)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * decoded + ", intact boolean" * intact)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, ids)."""
    return _run(docs, path, pattern)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, decoded), the bytes; null ids decode to no bytes. An id outside the vocabulary is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, "")
        for batch in batches:
            lists = [np.array(x or [], np.int32) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoder.decode(x) for x in lists], pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, ids, decoded): encoded, and decoded again from the ids, in one pass."""
    return _run(docs, path, pattern, decoded=True)


def intact(docs: DataFrame, path: str, pattern: str, cached: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, ids, intact): whether the ids decode to the text. Told where they are decoded, so that
    neither the text nor the decoded bytes go back to the JVM. cached: pre-tokens that a generation of the cache holds."""
    return _run(docs, path, pattern, intact=True, cached=cached)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the round trip."""
    return round_trip(docs, path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
