"""Near-duplicates by the Jaccard similarity of shingle sets: what operator 5 runs where similar texts are asked for, not
close fingerprints. MinHash bands propose pairs, the exact sets decide.

A SimHash can't do this alone: at a similarity of 0.8 two fingerprints differ in 9.7 of 64 bits on average (the angle of two
such sets is 27 degrees), and a grid for 17 bits has too many cells; within 3 bits less than one pair in a hundred is found.

A text's distinct shingle hashes are its set; texts of equal sets are one class (told by count and two 64-bit sums). Each class
has the low bytes of WIDE minima. BANDS bands of WIDTH minima put it into a cell each: two sets of similarity s meet in a
cell with 1 - (1 - s^WIDTH)^BANDS, 99.997 % at 0.8, and surely at 1. Inside a cell, pairs of fitting sizes with LOW equal
bytes or more of the first BANDS * WIDTH are candidates (a pair at 0.8 has fewer once in half a million); before any set is
fetched they must have NEAR equal bytes of all (fewer once in three million).

First each class proposes its likeliest partner and its first likely one; these are verified on the sets and joined to
components. Then all candidates that still lie in two components are verified: the pairs of a cell go as rows up to DENSE for
each member; beyond that the cell's members are fetched with their sets instead, in blocks of at most BLOCK, and compared
block against block, which hands on links only. Either way every candidate is decided by its sets.

Defined cases: wordless and null texts have the empty set and are one class; fewer words than a shingle are one shingle; an
empty table gives an empty result; a very long text is hashed whole, its set passes as one row; ties of likeliness go to the
first found; repeated texts are one class; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, discard, give_back, slices, utf8
from rasterloom.llm.components import components
from rasterloom.llm.simhash import remixed, shingle_hashes

#: Least similarity of a link, as a fraction.
LEAST = (4, 5)
BANDS, WIDTH = 20, 4
#: Equal bytes of a candidate's sketches, and of a likely one's.
LOW, LIKELY = 46, 64
#: Minima whose low bytes are kept, and how many of two sets' must be equal.
WIDE, NEAR = 256, 173
#: Pairs for each member that a cell hands on as rows, and members of a block of a fuller cell.
DENSE, BLOCK = 2, 1024
_RND = np.random.default_rng(5)
XORS = _RND.integers(0, 2**63, WIDE).astype(np.uint64)
ODDS = _RND.integers(0, 2**63, WIDE).astype(np.uint64) * np.uint64(2) + np.uint64(1)
NODE = "key long, n int, sum long, mixed long, cells array<long>, wide binary"
#: Of wide, the bytes of the minima that make the cells.
SKETCH = f"substring(wide, 1, {BANDS * WIDTH})"


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(raw, words), np.uint64))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row for each set (none empty), a minimum for each hash function."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    return np.stack([np.minimum.reduceat((values ^ x) * a, starts) for x, a in zip(XORS, ODDS, strict=True)], 1)


def band_cells(mins: np.ndarray) -> np.ndarray:
    out = np.zeros((len(mins), BANDS), np.uint64)
    for k in range(WIDTH):
        out = remixed(out ^ mins[:, k : BANDS * WIDTH : WIDTH], k + 1)
    return remixed(out + np.arange(BANDS, dtype=np.uint64), WIDTH + 1)


def _nodes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, off = utf8(batch.column(1))
            data = raw.tobytes()
            sets = [shingle_set(data[off[i] : off[i + 1]], words) for i in range(batch.num_rows)]
            size = np.array([len(s) for s in sets], np.int32)
            sums = np.array([s.sum() if len(s) else 0 for s in sets], np.uint64)
            mixed = np.array([remixed(s, 1).sum() if len(s) else 0 for s in sets], np.uint64)
            full = size > 0
            cells, wide = np.zeros((len(sets), BANDS), np.uint64), np.zeros((len(sets), WIDE), np.uint8)
            if full.any():
                mins = minima([s for s in sets if len(s)])
                cells[full], wide[full] = band_cells(mins), mins.astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, BANDS, dtype=np.int32)), pa.array(cells.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(sums.view(np.int64)), pa.array(mixed.view(np.int64)), lists, pa.array([s.tobytes() for s in wide], pa.binary())],
                ["key", "n", "sum", "mixed", "cells", "wide"],
            )

    return run


def cell_pairs(cell: np.ndarray, size: np.ndarray, sketch: np.ndarray, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions and equal bytes of the candidates of one cell, in parts; no position is twice on one side of a part.
    With groups, only those between two groups."""
    order = np.lexsort((size, cell))
    cell, size, sketch = cell[order], size[order].astype(np.int64), sketch[order]
    here, step = np.arange(len(cell)), 0
    while len(here):
        step += 1
        here = here[here + step < len(cell)]
        there = here + step
        here = here[(cell[here] == cell[there]) & (size[here] * LEAST[1] >= size[there] * LEAST[0])]
        open_ = here if group is None else here[group[order[here]] != group[order[here + step]]]
        for at in range(0, len(open_), 100_000):
            a = open_[at : at + 100_000]
            b = a + step
            equal = np.count_nonzero(sketch[a] == sketch[b], axis=1)
            near = equal >= LOW
            if near.any():
                yield order[a[near]], order[b[near]], equal[near]


def _pairs(grouped: bool):
    """(cell, v, u): each member's proposals; or, with groups, candidates between them, and (cell, v, v) for the members of a
    cell that has too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        cell, rep, size = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(3))
        sketch = np.frombuffer(b"".join(x for b in held for x in b.column(3).to_pylist()), np.uint8).reshape(-1, BANDS * WIDTH)
        group = np.concatenate([b.column(4).to_numpy() for b in held]) if grouped else None
        held.clear()

        def out(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["cell", "v", "u"])

        if grouped:
            names, number, members = np.unique(cell, return_inverse=True, return_counts=True)
            count, most, met = np.zeros(len(names), np.int64), DENSE * members, np.zeros(len(cell), bool)
            for a, b, _ in cell_pairs(cell, size, sketch, group):
                met[a] = met[b] = True
                room = count[number[a]] < most[number[a]]  # over by one part of a cell's pairs at most
                count += np.bincount(number[a], minlength=len(names))
                if room.any():
                    yield out(cell[a[room]], rep[a[room]], rep[b[room]])
            full = np.flatnonzero(met & (count > most)[number])
            if len(full):
                yield out(cell[full], rep[full], rep[full])
        else:
            best, partner, first = np.zeros(len(cell), np.int64), rep.copy(), rep.copy()
            for a, b, equal in cell_pairs(cell, size, sketch):
                for x, y in ((a, b), (b, a)):
                    more = equal > best[x]
                    best[x[more]], partner[x[more]] = equal[more], rep[y[more]]
                    likely = (equal >= LIKELY) & (rep[y] < first[x])
                    first[x[likely]] = rep[y[likely]]
            ends = np.concatenate([rep, rep]), np.concatenate([partner, first])
            other = ends[0] != ends[1]
            if other.any():
                yield out(np.concatenate([cell, cell])[other], ends[0][other], ends[1][other])
        del cell, rep, size, sketch
        give_back()

    return run


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, WIDE) for k in (2, 3))
        yield batch.select(["v", "u"]).filter(pa.array(np.count_nonzero(a == b, axis=1) >= NEAR))


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (v, u), those whose wide sketches agree; written."""
    end = lambda k, name: nodes.select(F.col("rep").alias(k), F.col("wide").alias(name))
    both = pairs.join(end("v", "a"), "v").join(end("u", "b"), "u").select("v", "u", "a", "b")
    return cut(both.mapInArrow(_close, "v long, u long"), "likely")


def _group_links(members: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Links of one group of members, between sides and groups, each where the two first meet."""
    wide = np.frombuffer(b"".join(m["wide"] for m in members), np.uint8).reshape(-1, WIDE)
    size, rep, side, group = (np.array([m[k] for m in members]) for k in ("n", "rep", "side", "group"))
    cells, here = np.array([m["cells"] for m in members]), members[0]["cell"]
    sets = [np.array(m["set"]) for m in members]
    v, u = [], []
    for i in range(len(members) - 1):
        j = np.arange(i + 1, len(members))
        low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        j = j[(low * LEAST[1] >= high * LEAST[0]) & (group[i] != group[j]) & ((side[i] == 0) | (side[i] != side[j]))]
        j = j[np.count_nonzero(wide[i] == wide[j], axis=1) >= NEAR]
        if len(j):
            same = cells[i] == cells[j]
            j = j[cells[i][same.argmax(1)] == here]
        for k in j:
            both = np.intersect1d(sets[i], sets[k], assume_unique=True).size
            if both * LEAST[1] >= LEAST[0] * (len(sets[i]) + len(sets[k]) - both):
                v.append(max(rep[i], rep[k]))
                u.append(min(rep[i], rep[k]))
    return np.array(v, np.int64), np.array(u, np.int64)


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (cell, block pair): one group at a time."""
    held: list[dict] = []

    def done() -> pa.RecordBatch:
        v, u = _group_links(held)
        return pa.RecordBatch.from_arrays([pa.array(v), pa.array(u)], ["v", "u"])

    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["cell"], row["pair"]) != (held[0]["cell"], held[0]["pair"]):
                yield done()
                held = []
            held.append(row)
    if held:
        yield done()
    give_back()


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        a, b = batch.column(2), batch.column(3)
        for i in range(batch.num_rows):
            x, y = a[i].values.to_numpy(), b[i].values.to_numpy()
            both = np.intersect1d(x, y, assume_unique=True).size
            keep[i] = both * LEAST[1] >= LEAST[0] * (len(x) + len(y) - both)
        yield batch.select(["v", "u"]).filter(pa.array(keep))


def _sets(docs: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """(key, set) of some keys; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, off = utf8(batch.column(1))
            data = raw.tobytes()
            sets = [shingle_set(data[off[i] : off[i + 1]], words).view(np.int64) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["key", "set"])

    return cut(docs.join(keys, "key", "left_semi").select("key", "text").mapInArrow(run, "key long, set array<long>"), "sets")


def _ends(pairs: DataFrame, name: str) -> DataFrame:
    return pairs.select(F.col("v").alias(name)).union(pairs.select("u")).distinct()


def _verified(docs: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """Of pairs (v, u), a written table, those whose sets are similar; written too."""
    sets = _sets(docs, _ends(pairs, "key"), words)
    both = pairs.join(sets.select(F.col("key").alias("v"), F.col("set").alias("a")), "v").join(sets.select(F.col("key").alias("u"), F.col("set").alias("b")), "u")
    found = cut(both.select("v", "u", "a", "b").mapInArrow(_similar, "v long, u long"), "links")
    discard(sets)
    return found


def _dense_links(docs: DataFrame, full: DataFrame, nodes: DataFrame, known: DataFrame, words: int, parts: int) -> DataFrame:
    """Links inside the cells of full (cell, rep), a written table; written too."""
    sets = _sets(docs, full.select(F.col("rep").alias("key")).distinct(), words)
    counted = full.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = full.join(counted, "cell").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    placed = placed.select("cell", "rep", (low.cast("long") * F.col("blocks") + high).alias("pair"), F.when(low == high, 0).when(F.col("mine") == low, 1).otherwise(2).alias("side"))
    whole = nodes.join(sets.withColumnRenamed("key", "rep"), "rep").join(known, "rep")
    rows = placed.join(whole, "rep").select("cell", "pair", "side", "rep", "n", "group", "cells", "wide", "set")
    found = cut(rows.repartition(parts, "cell", "pair").sortWithinPartitions("cell", "pair").mapInArrow(_inside, "v long, u long"), "links")
    discard(sets)
    return found


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """docs (key long, text), a written table whose keys are distinct -> (key, component) for every row: the least key of
    those that links join."""
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    docs = docs.select("key", F.col("text").cast("string").alias("text"))
    prints = cut(docs.mapInArrow(_nodes(words), NODE), "prints")
    same = ["n", "sum", "mixed"]
    classes = cut(prints.groupBy(same).agg(F.min("key").alias("rep")), "classes")
    nodes = prints.join(classes.select(F.col("rep").alias("key")), "key", "left_semi").where("n > 0").select(F.col("key").alias("rep"), "n", "cells", "wide")
    kind, cell, sketch = "cell long, v long, u long", F.explode("cells").alias("cell"), F.expr(SKETCH).alias("sketch")
    dealt = nodes.select(cell, "rep", "n", sketch).repartition(parts, "cell")
    pairs = cut(dealt.mapInArrow(_pairs(False), kind).select("v", "u").distinct(), "pairs")
    likely = _likely(pairs, nodes)
    found = cut(components(_verified(docs, likely, words)), "found")
    known = cut(_ends(pairs, "rep").join(found, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("group")), "known")
    open_ = nodes.join(known, "rep").select(cell, "rep", "n", sketch, "group").repartition(parts, "cell")
    rest = cut(open_.mapInArrow(_pairs(True), kind), "rest")
    more = _likely(rest.where("v <> u").select("v", "u").distinct().join(pairs, ["v", "u"], "left_anti"), nodes)
    full = cut(rest.where("v = u").select("cell", F.col("v").alias("rep")).distinct(), "full")
    links = [found.select(F.col("node").alias("v"), F.col("component").alias("u"))]
    if more.limit(1).count():
        links.append(_verified(docs, more, words))
    if full.limit(1).count():
        links.append(_dense_links(docs, full, nodes, known, words, parts))
    for table in (pairs, likely, rest, more):
        discard(table)
    if len(links) > 1:
        found = components(reduce(DataFrame.union, links))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("component", "rep").alias("component"))
    return prints.select("key", *same).join(named, same).select("key", "component")
