"""A bounded, stated sample of labelled documents for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import slices


def labelled(docs: DataFrame, labels: DataFrame, column: str, learn: Column, rows: int, figures: Callable[[pa.Array], list[pa.Array]], kinds: str) -> pa.Table:
    """(doc_id, label, and what figures makes of the whole text, of types kinds) of at most rows documents, those of the
    smallest xxhash64(doc_id) where learn (over doc_id) holds; of several texts with one doc_id that of the smallest hash.
    Labels other than 0 and 1 don't count; a document with contradicting labels has the larger. Tasks read the texts; only
    their figures come to the driver, one row a document, in order of doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    found = found.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = figures(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "label", *(x.split()[0] for x in kinds.split(", "))])

    return found.mapInArrow(run, f"doc_id long, label int, {kinds}").toArrow().sort_by("doc_id")


def label_array(table: pa.Table) -> np.ndarray:
    return table.column("label").to_numpy().astype(np.int64)
