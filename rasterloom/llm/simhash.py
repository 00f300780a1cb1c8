"""SimHash near-duplicates: segment-popcount embedding, grid range-join under Manhattan distance, exact verification.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to its per-segment bit counts. The Manhattan distance of
two count vectors never exceeds the Hamming distance of the fingerprints. In thermometer code (each segment's bits sorted)
it is again a bit count: ``popcount(T(a) ^ T(b))``. The grid is the pigeonhole's: with 2d groups of segments, vectors
within distance d agree on d whole groups at least, so each vector is dealt to C(2d, d) cells, one for each choice of d
groups. Inside a cell, members are ordered by their total bit count and only compared while totals differ by d or less; the
Manhattan bound comes first and the Hamming distance decides.

Only distinct fingerprints take part, and tasks hand on spanning forests instead of links. Cells are told by some 22 bits on
average. One with more than HOT members is split by further segments: its members are dealt anew, by segments of one bit (whose
counts are the bits) in 4d groups of which 3d agree. Such a cell is told by 48 of 64 bits at d = 3, so that whatever the data
it has 65,536 members at most.

Defined cases: a null or wordless text has fingerprint zero, which is linked like any other; fewer words than a shingle are
one shingle; a null doc_id keeps its row and its fingerprint and never names a component unless a whole component has no id;
repeated rows stay; rows that share a doc_id are rows of their own; very long texts count whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, give_back, slices, utf8, whole_groups
from rasterloom.llm.components import components, forest

SEED = 42
DISTANCE = 3
SEGMENTS = 32
#: A cell with more distinct fingerprints is split by segments of one bit.
HOT = 20_000
#: Links held by a task before it hands on their forest.
HELD = 2_000_000
ONES = np.uint64(0x5555555555555555)


def shingle_hashes(raw: bytes, words: int) -> list[int]:
    """XXH64 of each shingle of a text (UTF-8), in order, repeats included."""
    parts = raw.lower().split()
    if not parts:
        return []
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), SEED)]
    joined = b" ".join(parts)
    starts = [0]
    starts += (np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)).tolist()
    pieces = [joined[a:b] for a, b in zip(starts, [x - 1 for x in starts[words:]], strict=False)]
    return list(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)))


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each run of hashes (ends: cumulative counts), the bits set in over half of its hashes."""
    starts = np.concatenate([[0], ends[:-1]])
    counts = ends - starts
    out = np.zeros(len(ends), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # blocks of at most 255 hashes of one run: per-byte sums of single bits don't overflow
    blocks = -(-counts[full] // 255)
    first = np.cumsum(blocks) - blocks
    inner = np.arange(blocks.sum()) - np.repeat(first, blocks)
    cuts = np.repeat(starts[full], blocks) + 255 * inner
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, cuts)
        per = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        set_ = 2 * per > counts[full][:, None]
        for lane in range(8):
            out[full] |= set_[:, lane].astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def remixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """Other hashes of the same shingles, made from the first ones; table 0 is these themselves."""
    if not table:
        return hashes
    x = hashes + np.uint64(table * 0x9E3779B97F4A7C15 & 2**64 - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint_batch(texts: pa.Array, words: int, tables: int = 1) -> np.ndarray:
    """A row for each text, a fingerprint for each table."""
    raw, off = utf8(texts)
    data = raw.tobytes()
    hashes, ends, n = [], np.zeros(len(off) - 1, np.int64), 0
    for i in range(len(off) - 1):
        got = np.array(shingle_hashes(data[off[i] : off[i + 1]], words), np.uint64)
        hashes.append(got)
        n += len(got)
        ends[i] = n
    all_ = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return np.stack([majority(remixed(all_, t), ends) for t in range(tables)], 1)


def fingerprints(docs: DataFrame, words: int = 3, tables: int = 1) -> DataFrame:
    """(doc_id, fps): 64-bit fingerprints as signed longs. The first is the plain one, the others take other hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = fingerprint_batch(batch.column(1), words, tables).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, tables, dtype=np.int32)), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "fps"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fps array<long>")


def thermometer(x: np.ndarray) -> np.ndarray:
    """Each two-bit segment's bits sorted: the segment's bit count in unary."""
    high = (x >> np.uint64(1)) & ONES
    low = x & ONES
    return (high | low) | ((high & low) << np.uint64(1))


def masks(distance: int = DISTANCE, fine: bool = False) -> list[np.uint64]:
    """Of 2 * distance groups of segments, every choice of distance groups, as a mask of their bits; or, with segments of one
    bit, of 4 * distance groups every choice of 3 * distance."""
    groups, agreeing, wide = (4 * distance, 3 * distance, 1) if fine else (2 * distance, distance, 2)
    segments = 64 // wide
    bits = [sum((1 << wide) - 1 << (wide * s) for s in range(segments) if s * groups // segments == g) for g in range(groups)]
    return [np.uint64(sum(bits[g] for g in chosen)) for chosen in combinations(range(groups), agreeing)]


def _cells(distance: int, fine: bool = False):
    chosen = masks(distance, fine)
    odd = np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, fp, table = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            bits = fp.view(np.uint64)
            t = bits if fine else thermometer(bits)
            salt = table.to_numpy().astype(np.uint64) * np.uint64(len(chosen))
            for k, mask in enumerate(chosen):
                cell = (t & mask) * odd
                cell ^= cell >> np.uint64(29)
                cell = (cell + salt + np.uint64(k + 1)) * odd
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), rep, pa.array(fp), table], ["cell", "rep", "fp", "t"])

    return run


def close_pairs(cell: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of one cell within distance bits, in parts."""
    total = np.bitwise_count(fp).astype(np.int64)
    order = np.lexsort((total, cell))
    cell, fp, total = cell[order], fp[order], total[order]
    t = thermometer(fp)
    here = np.arange(len(cell))
    step = 0
    while len(here):
        step += 1
        here = here[here + step < len(cell)]
        there = here + step
        here = here[(cell[here] == cell[there]) & (total[there] - total[here] <= distance)]
        there = here + step
        bound = np.bitwise_count(t[here] ^ t[there]) <= distance  # Manhattan distance of the bit counts
        a, b = here[bound], there[bound]
        exact = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        if exact.any():
            yield order[a[exact]], order[b[exact]]


def _link(distance: int):
    """Rows in order of cell -> forests of the links, cell by cell."""

    def contracted(ends: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        v, u = forest(np.concatenate([x for x, _ in ends]), np.concatenate([y for _, y in ends]))
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(u)], ["v", "u"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for part in whole_groups(batches, "cell"):
            cell, rep, fp = (part.column(k).to_numpy() for k in ("cell", "rep", "fp"))
            for a, b in close_pairs(cell, fp.view(np.uint64), distance):
                ends.append((rep[a], rep[b]))
                count += len(a)
                if count > HELD:
                    yield contracted(ends)
                    ends, count = [], 0
        if ends:
            yield contracted(ends)
        give_back()

    return run


def link(nodes: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """nodes (rep, fps) -> edges (v, u) over rep with the same components as all links have, a link being a pair that is
    within distance in some table."""
    spark, kind = nodes.sparkSession, "cell long, rep long, fp long, t int"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = nodes.select("rep", F.posexplode("fps").alias("t", "fp")).select("rep", "fp", "t").mapInArrow(_cells(distance), kind)
    crowded = cut(dealt.groupBy("cell").count().where(F.col("count") > hot).select("cell"), "crowded")
    linked = lambda rows: rows.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_link(distance), "v long, u long")
    if not crowded.limit(1).count():
        return linked(dealt)
    dealt = cut(dealt, "dealt")
    many = dealt.join(crowded, "cell", "left_semi").select("rep", "fp", "t").distinct().mapInArrow(_cells(distance, fine=True), kind)
    return linked(dealt.join(crowded, "cell", "left_anti").unionByName(many))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = DISTANCE, tables: int = 1) -> DataFrame:
    """(doc_id, fps, component_id) for every row of docs. A row reaches the rows that its own fingerprint links, whatever ids
    they have; rows of one doc_id with different texts may lie in different components. With several tables, independent
    fingerprints of the same shingles, a pair is linked where any of them is within distance: similar texts are found more
    surely, and others no more often than by chance (about 4e-15 for a pair and table)."""
    prints = cut(fingerprints(docs, words, tables), "prints")
    # numbers of the written classes, so that they stay the same
    classes = cut(prints.groupBy("fps").agg(F.min("doc_id").alias("id")), "classes")
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "nodes")
    found = components(link(classes, distance))
    classes = cut(classes.join(found, F.col("rep") == F.col("node"), "left").select("fps", "id", F.coalesce("component", "rep").alias("class")), "linked")
    least = cut(classes.groupBy("class").agg(F.min("id").alias("component_id")), "least")
    return prints.join(classes.join(least, "class").select("fps", "component_id"), "fps").select("doc_id", "fps", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")
