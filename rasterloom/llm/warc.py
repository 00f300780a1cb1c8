"""WARC: archives written through Spark's own writer and read back by boundary-chain verification.

Writing: every page becomes one record. Of the records whose payloads are equal and of ``least`` bytes or more, the one
with the smallest id is a ``response`` and the others are ``revisit`` records without payload that name it; all other
records are responses. Only ids, digests and lengths are shuffled to find that out. Record bytes leave through the text
sink, whose files are plain concatenations of the records.

Reading: the text source splits the files at the magic ``WARC/1.1\\r\\n``, so every candidate record starts a row, and so
does every magic inside a payload. Tasks emit candidate-to-successor offsets; each split contracts its own pointers by
pointer jumping, splits of one file are linked by the same doubling over the pointers that leave them, and only what is
reachable from the file's start is a record. Payloads that hold the magic are put together from their fragments.

Defined cases: a null html is an empty payload; a null url is an empty header field; a null page_id is written as ``-``
and read back as null, and is never what a revisit refers to (equal payloads without any id are all responses); repeated
rows are records of their own, and all rows with a group's smallest id are responses; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, scratch_path

MAGIC = "WARC/1.1\r\n"
#: Shorter payloads are never told as copies.
LEAST = 100
#: A new archive file begins after so many records.
RECORDS_PER_FILE = 2_000
#: Revisit decisions (about 100 bytes each) up to this count are broadcast; more go by a shuffled join.
BROADCAST_ROWS = 200_000


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages with payload, digest, payload_bytes and refers_to (set for revisits)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    keys = rows.where(F.col("payload_bytes") >= least).select("page_id", "digest")
    groups = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
    copies = cut(keys.join(groups, "digest").where("page_id is null or page_id <> refers_to").select("page_id", "digest", "refers_to").distinct(), "copies")
    copies = copies.select(F.col("page_id").alias("copy_id"), F.col("digest").alias("copy_digest"), "refers_to")
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    return rows.join(copies, F.col("page_id").eqNullSafe(F.col("copy_id")) & (F.col("digest") == F.col("copy_digest")), "left")


def write_archives(pages: DataFrame, path: str, least: int = LEAST, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes one record a page into uncompressed archives under path."""
    rows = plan_records(pages, least)
    copy = F.col("refers_to").isNotNull()
    clean = F.regexp_replace("url", r"[\r\n]", " ")
    ident = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(copy, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), ident("page_id"),
        F.lit(">\r\nWARC-Target-URI: "), clean,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(copy, F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), ident("refers_to"), F.lit(">\r\nWARC-Profile: identical-payload-digest"))).otherwise(""),
        F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.lit("\r\nContent-Length: "), F.when(copy, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string"),
        F.lit("\r\n\r\n"),
    )
    # the record ends in CRLF CRLF; its last LF is the sink's line separator
    body = F.when(copy, F.lit("").cast("binary")).otherwise(F.col("payload"))
    record = F.concat(head.cast("binary"), body, F.lit("\r\n\r").cast("binary")).cast("string")
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", records_per_file).text(path)


FIELDS = "file string, split long, at long, size long, next long, page_id long, kind string, digest string, payload_bytes long, refers_to long, url string, computed string"


def _ident(value: bytes | None) -> int | None:
    text = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(text) if text.lstrip(b"-").isdigit() else None


def parse(fragment: bytes) -> dict | None:
    """A candidate's header fields and the length that it claims, or None where no header follows the magic."""
    end = fragment.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = dict(line.split(b": ", 1) for line in fragment[:end].split(b"\r\n") if b": " in line)
    length = fields.get(b"Content-Length", b"")
    if not length.isdigit():
        return None
    return {"fields": fields, "payload": end + 4, "length": int(length), "claims": len(MAGIC) + end + 4 + int(length) + 4}


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Offsets count from the split's first row; at -1 a split tells only its size (rows before the first magic)."""
    here: tuple[str, int] | None = None
    at = 0
    names = [x.split()[0] for x in FIELDS.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in FIELDS.split(", ")]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for file, split, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (file, split) != here:
                here, at = (file, split), 0
            raw = value.as_buffer().to_pybytes()
            size = len(raw) + len(MAGIC)
            found = parse(raw)
            row: list = [file, split, at, size, -1, None, None, None, None, None, None, None]
            if found:
                fields, body = found["fields"], raw[found["payload"] : found["payload"] + found["length"]]
                row[4] = at + found["claims"]
                row[5], row[6], row[9] = _ident(fields.get(b"WARC-Record-ID")), fields.get(b"WARC-Type", b"").decode(errors="replace"), _ident(fields.get(b"WARC-Refers-To"))
                row[7] = fields.get(b"WARC-Payload-Digest", b"").decode(errors="replace").removeprefix("sha256:")
                told = fields.get(b"X-Payload-Length", b"")
                row[8], row[10] = int(told) if told.isdigit() else found["length"], fields.get(b"WARC-Target-URI", b"").decode(errors="replace")
                if len(body) == found["length"]:
                    row[11] = hashlib.sha256(body).hexdigest()
            for column, x in zip(out, row, strict=True):
                column.append(x)
            at += size
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)


def jump(at: np.ndarray, following: np.ndarray, end: int) -> np.ndarray:
    """Each candidate's first offset at or beyond end on its chain, by pointer doubling; -1 where the chain breaks."""
    n = len(at)
    slot = np.searchsorted(at, following)
    inside = following < end
    good = inside & (slot < n)
    good[good] = at[slot[good]] == following[good]
    pointer = np.where(good, slot, np.arange(n))
    leaves = np.where(~inside, following, -1)
    for _ in range(max(1, n).bit_length()):
        pointer = pointer[pointer]
    return leaves[pointer]


def reached(at: np.ndarray, following: np.ndarray, entry: int) -> np.ndarray:
    """Which candidates lie on the chain that starts at entry: marks spread along pointers that double each round."""
    n = len(at)
    slot = np.searchsorted(at, following)
    good = slot < n
    good[good] = at[slot[good]] == following[good]
    pointer = np.append(np.where(good, slot, n), n)
    mark = np.zeros(n + 1, bool)
    mark[:n] = at == entry
    for _ in range(max(1, n).bit_length()):
        mark[pointer[mark]] = True
        pointer = pointer[pointer]
    return mark[:n]


def _exits(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("at")
    at = group["at"].to_numpy(np.int64)
    leaves = jump(at, group["next"].to_numpy(np.int64), int(group["stop"].iloc[0]))
    return pd.DataFrame({"file": group["file"], "split": group["split"], "at": at, "leaves": leaves})


def _on_chain(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("at")
    keep = reached(group["at"].to_numpy(np.int64), group["next"].to_numpy(np.int64), int(group["entry"].iloc[0]))
    return group.loc[keep, ["file", "at", "next"]]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per verified record: file, at, page_id, kind, digest, payload_bytes, refers_to, url, computed (the digest of
    the payload as read; null for revisits)."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    fragments = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))
    found = cut(fragments.mapInArrow(_candidates, FIELDS), "candidates")
    # where each split begins in its file: the first row of a file (before the first magic) has no magic of its own
    splits = found.groupBy("file", "split").agg(F.sum("size").alias("size"))
    before = splits.alias("a").join(splits.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("b.split") < F.col("a.split")), "left")
    base = before.groupBy("a.file", "a.split").agg(F.coalesce(F.sum("b.size"), F.lit(0)).alias("base"), F.first("a.size").alias("own"))
    # a row's magic stands before it, and the file's first row has none: all offsets move back by one magic
    shift = F.col("base") - F.lit(len(MAGIC))
    placed = found.join(base, ["file", "split"]).withColumns({"stop": shift + F.col("own"), "next": F.when(F.col("next") >= 0, F.col("next") + shift).otherwise(F.lit(-1)), "at": F.col("at") + shift})
    links = cut(placed.where("kind is not null").select("file", "split", "at", "next", "stop"), "links")
    entries = links.where("at = 0").select("file", "split", F.col("at").alias("entry"))
    if links.where("next >= stop").join(links.select("file", F.col("at").alias("next")), ["file", "next"], "left_semi").limit(1).count():
        entries = _entries(links)
    chain = links.join(entries, ["file", "split"]).groupBy("file", "split").applyInPandas(_on_chain, "file string, at long, next long")
    records = placed.drop("next").join(chain, ["file", "at"])
    records = cut(records.select("file", "at", "next", "page_id", "kind", "digest", "payload_bytes", "refers_to", "url", "computed"), "records")
    broken = records.where("computed is null")
    if not broken.limit(1).count():
        return records
    return _mended(records, broken, fragments, base)


def _entries(links: DataFrame) -> DataFrame:
    """For each split the offset at which its file's chain enters it: pointer doubling over the pointers between splits."""
    exits = links.groupBy("file", "split").applyInPandas(_exits, "file string, split long, at long, leaves long")
    wanted = exits.select("file", F.col("leaves").alias("at")).distinct()
    starts = exits.where("at = 0").select("file", "at")
    nodes = cut(exits.join(wanted.unionByName(starts).distinct(), ["file", "at"], "left_semi"), "nodes")
    mark, pointer = cut(nodes.where("at = 0").select("file", "at"), "mark"), nodes.select("file", "at", F.col("leaves").alias("to"))
    while True:
        more = mark.join(pointer, ["file", "at"]).select("file", F.col("to").alias("at")).join(nodes.select("file", "at"), ["file", "at"], "left_semi")
        grown = cut(mark.unionByName(more).distinct(), "mark")
        if grown.count() == mark.count():
            break
        mark = grown
        pointer = cut(pointer.alias("a").join(pointer.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.at"))).select("a.file", "a.at", "b.to"), "pointer")
    return mark.join(nodes.select("file", "at", "split"), ["file", "at"]).select("file", "split", F.col("at").alias("entry"))


def _offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, at = None, 0
    for batch in batches:
        places = []
        for file, split, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (file, split) != here:
                here, at = (file, split), 0
            places.append(at)
            at += len(value.as_buffer()) + len(MAGIC)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], ["file", "split", "value", "rel"])


def _mended(records: DataFrame, broken: DataFrame, fragments: DataFrame, base: DataFrame) -> DataFrame:
    """Digests of payloads that hold the magic: their fragments are found by file and whole page of offsets, and joined."""
    page = 1 << 20
    spans = broken.select("file", F.col("at").alias("start"), "next").withColumn("page", F.explode(F.sequence(F.floor(F.col("start") / page), F.floor(F.col("next") / page))))
    placed = fragments.mapInArrow(_offsets, "file string, split long, value binary, rel long").join(base, ["file", "split"]).select("file", (F.col("rel") + F.col("base") - F.lit(len(MAGIC))).alias("at"), "value").withColumn("page", F.floor(F.col("at") / page))
    parts = placed.join(spans, ["file", "page"]).where("at >= start and at < next").groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pieces in batch.column(2).to_pylist():
                raw = MAGIC.encode().join(x["value"] for x in pieces)
                got = parse(raw)
                out.append(hashlib.sha256(raw[got["payload"] : got["payload"] + got["length"]]).hexdigest() if got else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["file", "at", "mended"])

    mended = parts.mapInArrow(whole, "file string, at long, mended string")
    return records.join(mended, ["file", "at"], "left").withColumn("computed", F.coalesce("computed", "mended")).drop("mended")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    revisit = F.col("kind") == "revisit"
    return read_archives(spark, path).select(
        "page_id", "payload_bytes", F.when(revisit, F.col("digest")).otherwise(F.col("computed")).alias("payload_digest"), F.col("kind").alias("record_type"), F.when(revisit, F.col("refers_to")).alias("refers_to")
    )


ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, ''))) n from pages),
q as (select page_id, n, sha256(h) d, min(page_id) over (partition by h) f from p)
select page_id, cast(n as bigint) payload_bytes, d payload_digest,
  case when n >= 100 and f <> page_id then 'revisit' else 'response' end record_type,
  case when n >= 100 and f <> page_id then f end refers_to
from q
"""
