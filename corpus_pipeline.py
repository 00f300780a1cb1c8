"""The corpus pipeline: five stages over documents, each a call of one operator.

toxicity drops the documents that the classifier rejects; near_duplicates keeps one row of each group that links
join (a link: SimHash fingerprints of operator 5 at 3 or fewer differing bits, or sets of five-word shingles with a Jaccard
similarity of 0.8 or more); decontamination drops the documents that
hold a benchmark item; secrets masks secrets in the texts; tokens encodes what is left and checks the way back.
Copies are told by row: of a group the row of the least doc_id stays, one without a doc_id only where no row of it has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, decontaminate, jaccard, secrets, simhash, toxicity
from rasterloom.llm.common import cut
from rasterloom.llm.components import components

#: Pre-tokens that a generation of the tokens stage's cache holds: fewer than operator 3's, as executors still hold what the stages
#: before took.
CACHED = 100_000


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs hasn't, whatever the case."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier of operator 6, learnt from them and labels, doesn't take for toxic. Null, empty and
    wordless texts get the bias alone and stay unless most labels are toxic; very long texts are read whole; a score of just
    0.5 goes; repeated rows share their fate; an empty table stays empty; columns called like the model's own keep their
    values."""
    model, names = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), (fresh(docs, "_toxic_score"), fresh(docs, "_toxic"))
    return toxicity.score(docs, *model, names).where(F.col(names[1]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: rows that the SimHash fingerprints of operator 5 link (three words, 3 bits), and
    those with similar sets of five-word shingles (0.8), most of which are too far apart for it. That of the least doc_id stays,
    one without an id only where all are; of equal ids the first in the written table. Null, empty and wordless texts are one
    group; very long texts count whole; repeated rows are copies; an empty table stays empty; other columns, whatever their
    names, are kept. Each row learns its group's first from a table of groups of two or more, joined by group, whose rows
    hold two numbers each, so that Spark can split a large group."""
    row = fresh(docs, "_row")
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    by_print = simhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("v"), F.col("component_id").alias("u"))
    by_set = jaccard.near_duplicates(rows.select(F.col(row).alias("key"), "text"), words=5).select(F.col("key").alias("v"), F.col("component").alias("u"))
    linked = components(by_print.unionByName(by_set))
    ids = rows.select(F.col(row).alias("key"), F.col("doc_id").alias("id"))
    found = cut(ids.join(linked, F.col("key") == F.col("node"), "left").select("key", "id", F.coalesce("component", "key").alias("component")), "found")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "key"))["key"].alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = cut(found.join(first, "component").where("key <> first").select(F.col("key").alias(row)), "copies")
    return rows.join(copies, row, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text holds no benchmark item (operator 4). Null and empty texts hold none; very long texts are searched
    whole; items without letters or digits match nothing; repeated rows share their fate; with an empty benchmark all rows
    stay; other columns are kept."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets (operator 7) masked in text and n_chars counted anew where that changed it. Null and empty texts stay;
    very long texts are scanned whole; of overlapping findings the surer rule's is masked; repeated rows are masked alike; an
    empty table stays empty; other columns are kept."""
    return secrets.redact(docs, secrets.fit(words=secrets.common_words(docs)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, intact) of every row (operator 3); intact says that the ids decode to the text. A null text has
    no ids, as an empty one; very long texts are encoded whole; repeated rows and null ids stay; other columns go."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.intact(docs, path, pattern, CACHED).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "intact")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", tokens),
]
#: Training, components and BPE aren't SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
