"""Line dedup: range-partitioned line hashes, streamed in order of document and place; keep bitmaps instead of text.

A text is split at ``\\n``. A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of at
least ``code_points`` code points found in at least ``documents`` documents lose all their lines but those of the largest
doc_id that holds them.

Tasks hash the keys of their texts (128 bits). Within a run of texts they settle what they can: of a key that enough of the
run's documents hold, only the largest document is still open, all others surely lose it; so a run sends at most
``documents`` - 1 rows of a key on, however common it is. Open rows are range-partitioned by hash, documents from the
largest down, and streamed: the first document of a hash keeps its lines, the others' go once enough are seen. Ranges are
cut by hash and document, so that one hash may span partitions; the hashes at partitions' ends, two for each, are settled
afterwards by a count of their documents. What goes comes back as a compressed bitmap for each document that loses lines;
texts are joined with the bitmaps once.

Defined cases: a null or empty text is one empty line (``remove`` leaves it null); very long texts and lines count whole; a key repeated within a
document counts once, and goes or stays there as one; rows that share a doc_id are one document to the counts and keep or
lose lines alike; a null doc_id is one document, smaller than all others; a document that loses all lines keeps an empty
text; repeated rows stay; an empty table gives none; other columns, whatever their names, are ignored (``remove`` keeps
them).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, fresh, slices

CODE_POINTS, DOCUMENTS = 40, 5
#: Lines whose hashes a task holds and compares at once.
RUN_LINES = 1 << 20
#: Stands for a null doc_id, in tables of numbers only.
NONE = -(1 << 63)
BLANKS = " \t\n\x0b\x0c\r"

_ROWS = "h long, g long, doc long, text_hash long, open boolean, many boolean, places binary"


def row_key(doc: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """A row's document as a number, and a hash that tells texts of one document apart."""
    return F.coalesce(F.col(f"`{doc}`").cast("long"), F.lit(NONE)), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _hashes(keys: pa.Array) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(digest(k) for k in keys.cast(pa.large_binary()).to_pylist()), ">i8").reshape(-1, 2).astype(np.int64)


def long_lines(texts: pa.Array, code_points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, 128-bit hash) of each line with a key long enough."""
    split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    keys = pc.ascii_trim(split.flatten(), characters=BLANKS)
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)).astype(np.int64)
    at = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), code_points).to_numpy(zero_copy_only=False))
    row = np.searchsorted(ends, at, side="right")
    begin = np.concatenate([[0], ends[:-1]])
    told = pc.dictionary_encode(pc.ascii_lower(keys.take(pa.array(at))))
    distinct = _hashes(told.dictionary)
    return row, at - begin[row], distinct[told.indices.to_numpy()] if len(at) else np.zeros((0, 2), np.int64)


def _settled(h: np.ndarray, doc: np.ndarray, text: np.ndarray, place: np.ndarray, documents: int) -> Iterator[pa.RecordBatch]:
    """A run's lines -> rows of _ROWS: a row for each hash and text, open or surely gone."""
    order = np.lexsort((place, text, ~doc, h[:, 1], h[:, 0]))
    h, doc, text, place = h[order], doc[order], text[order], place[order].astype(np.uint32)
    new_key = np.r_[True, (h[1:] != h[:-1]).any(1)]
    new_doc = new_key | np.r_[True, doc[1:] != doc[:-1]]
    new_row = new_doc | np.r_[True, text[1:] != text[:-1]]
    key = np.cumsum(new_key) - 1
    held = np.bincount(key[new_doc])
    nth = np.cumsum(new_doc) - 1
    largest = nth == nth[np.flatnonzero(new_key)][key]
    start = np.flatnonzero(new_row)
    many = held[key[start]] >= documents
    # places that repeat come from repeated rows
    ends, raw = np.r_[start[1:], len(place)], place.tobytes()
    packed = [np.unique(place[a:b]).tobytes() if b - a > 1 else raw[4 * a : 4 * b] for a, b in zip(start.tolist(), ends.tolist(), strict=True)]
    columns = [h[start, 0], h[start, 1], doc[start], text[start], ~many | largest[start], many]
    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(packed, pa.binary())], names=[x.split()[0] for x in _ROWS.split(", ")])


def _dealt(code_points: int, documents: int, run_lines: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in slices(batches):
            row, place, h = long_lines(batch.column("text"), code_points)
            if len(row):
                held.append((h, batch.column("doc").to_numpy()[row], batch.column("text_hash").to_numpy()[row], place))
                count += len(row)
            if count >= run_lines:
                yield from _settled(*map(np.concatenate, zip(*held, strict=True)), documents)
                held, count = [], 0
        if count:
            yield from _settled(*map(np.concatenate, zip(*held, strict=True)), documents)

    return run


def _streamed(documents: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition's rows in order -> rows that go, and (edge) what its ends leave open: all rows of its first hash, which may
    have begun before; of its last hash the rows so far while few documents hold it, or its first row alone."""

    def out(table: pa.Table, edge: bool, many: bool = False) -> Iterator[pa.RecordBatch]:
        if table.num_rows:
            if many:
                table = table.set_column(table.schema.get_field_index("many"), "many", pa.array([True] * table.num_rows))
            yield from table.append_column("edge", pa.array(np.full(table.num_rows, edge))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front: tuple[int, int] | None = None
        open_: pa.Table | None = None  # rows of the last hash, while too few documents hold it
        lead: pa.Table | None = None  # the first row of the last hash, once enough do
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if open_ is not None:
                table = pa.concat_tables([open_, table])
            h, g, doc, many = (table.column(n).to_numpy() for n in ("h", "g", "doc", "many"))
            front = front or (h[0], g[0])
            new_key = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
            key, start = np.cumsum(new_key) - 1, np.flatnonzero(new_key)
            held = np.bincount(key[new_key | np.r_[True, doc[1:] != doc[:-1]]])
            sure, largest = (held >= documents) | (np.bincount(key, many) > 0), doc[start]
            goes_on = lead is not None and (lead["h"][0].as_py(), lead["g"][0].as_py()) == (h[0], g[0])
            if goes_on:
                sure[0], largest[0] = True, lead["doc"][0].as_py()
            at_front = (h == front[0]) & (g == front[1])
            yield from out(table.filter(pa.array(at_front)), True)
            yield from out(table.filter(pa.array(~at_front & sure[key] & (doc != largest[key]))), False)
            if at_front[-1]:
                open_ = lead = None
            elif sure[-1]:
                open_, lead = None, lead if goes_on and key[-1] == 0 else table.slice(start[-1], 1)
            else:
                open_, lead = table.slice(start[-1]), None
        for rest in (x for x in (open_, lead) if x is not None):
            yield from out(rest, True, rest is lead)

    return run


def bitmaps(docs: DataFrame, code_points: int = CODE_POINTS, documents: int = DOCUMENTS) -> DataFrame:
    """(doc long, text_hash long, keep binary, n_dropped long) for each document that loses lines, by row_key; keep is a
    compressed bitmap with a bit for each line up to the last that goes, set where it stays; all later ones stay."""
    spark = docs.sparkSession
    doc, text_hash = row_key()
    rows = cut(docs.select(doc.alias("doc"), text_hash.alias("text_hash"), "text").mapInArrow(_dealt(code_points, documents, RUN_LINES), _ROWS), "lines")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    order = ["h", "g", F.col("doc").desc(), "text_hash"]
    ranged = rows.where("open").drop("open").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    streamed = cut(ranged.mapInArrow(_streamed(documents), ", ".join(x for x in _ROWS.split(", ") if not x.startswith("open")) + ", edge boolean"), "streamed")
    # two hashes a partition at most
    edges = streamed.where("edge")
    sure = edges.groupBy("h", "g", "doc").agg(F.max("many").alias("many")).groupBy("h", "g").agg(F.max("doc").alias("largest"), (F.max("many") | (F.count(F.lit(1)) >= documents)).alias("sure")).where("sure")
    late = edges.join(F.broadcast(sure), ["h", "g"]).where("doc <> largest")
    gone = [x.select("doc", "text_hash", "places") for x in (rows.where("not open"), streamed.where("not edge"), late)]
    gone = gone[0].unionByName(gone[1]).unionByName(gone[2])
    return gone.groupBy("doc", "text_hash").agg(F.collect_set("places").alias("places")).mapInArrow(_packed, "doc long, text_hash long, keep binary, n_dropped long")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, dropped = [], []
        for places in batch.column("places").to_pylist():
            at = np.frombuffer(b"".join(places), np.uint32)
            bits = np.ones((int(at.max()) // 8 + 1) * 8, bool)
            bits[at] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 6))
            dropped.append(int(len(bits) - bits.sum()))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text_hash"), pa.array(keep, pa.binary()), pa.array(dropped, pa.int64())], names=["doc", "text_hash", "keep", "n_dropped"])


def kept_text(text: str, keep: bytes | None) -> tuple[str, int, int]:
    """What a bitmap leaves of a text, its lines before, and how many went."""
    if keep is None:
        return text, text.count("\n") + 1, 0
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).tolist()
    left = [x for k, x in enumerate(lines) if k >= len(bits) or bits[k]]
    return "\n".join(left), len(lines), len(lines) - len(left)


def _applied(names: tuple[str, str], out: Callable[[pa.RecordBatch, list], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names[0]):
            yield out(batch, [kept_text(t or "", k) for t, k in zip(batch.column(names[0]).to_pylist(), batch.column(names[1]).to_pylist(), strict=True)])

    return run


def joined(docs: DataFrame, found: DataFrame, keep: str) -> DataFrame:
    """docs with their bitmaps as a further column, null for documents that lose nothing."""
    doc, text_hash = row_key()
    names = fresh(docs, "_doc"), fresh(docs, "_text_hash")
    found = found.select(F.col("doc").alias(names[0]), F.col("text_hash").alias(names[1]), F.col("keep").alias(keep))
    return docs.withColumns({names[0]: doc, names[1]: text_hash}).join(found, list(names), "left").drop(*names)


def remove(docs: DataFrame, code_points: int = CODE_POINTS, documents: int = DOCUMENTS) -> DataFrame:
    """docs with repeated lines taken out of text; all other columns as they are."""
    keep, names = fresh(docs, "_keep"), docs.columns

    def out(batch: pa.RecordBatch, done: list) -> pa.RecordBatch:
        left = pa.array([d[0] for d in done], pa.string(), mask=batch.column("text").is_null().to_numpy(zero_copy_only=False))
        columns = [left if n == "text" else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return joined(docs, bitmaps(docs, code_points, documents), keep).mapInArrow(_applied(("text", keep), out), docs.schema)


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def out(batch: pa.RecordBatch, done: list) -> pa.RecordBatch:
        columns = [batch.column(0), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([hashlib.sha256(d[0].encode()).hexdigest() for d in done], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined(docs, bitmaps(docs), "keep").mapInArrow(_applied(("text", "keep"), out), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string")


ORACLE_SQL = r"""with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
lines as (select doc_id, unnest(l) as line, unnest(range(len(l))) as place from split),
keyed as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
often as (select k, max(doc_id) as largest from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
told as (select keyed.*, largest is not null and doc_id <> largest as gone from keyed left join often using (k))
select doc_id, count(*)::bigint as n_lines, sum(gone::int)::bigint as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256 from told group by doc_id"""
