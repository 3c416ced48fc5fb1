"""A corpus pipeline: toxicity, near duplicates, secrets, mixing, packing; each stage's decisions hold for the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``. Any column may be null, ids too, and rows and ids may
repeat: stages tell rows apart by a hash of all columns, never by ids alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import jaccard_join, mixing, packing, queries, secret_scan, toxicity
from lumenfold.plans.tables import cut

#: Pieces of documents that a sequence holds at most, so that few of its tokens follow a boundary.
SEQUENCE_DOCUMENTS = 16
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def row_key() -> Column:
    """The same for equal rows only; nulls count, which the hash alone passes over."""
    return F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores 0.5 or more go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model, keep=COLUMNS[1:]).filter("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, that of the smallest id, nulls last; a row without words is like equal rows only."""
    rows = docs.select(*COLUMNS).withColumn("_key", row_key())
    linked = jaccard_join.link(rows, n=5, percent=80, doc_id="_key").select(F.col("doc_id").alias("_key"), "component_id")
    ids = rows.select("_key", "doc_id").distinct()
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))
    first = linked.join(ids, "_key").groupBy("component_id").agg(least.alias("least")).select("least._key")
    return rows.join(first, "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every find is replaced by a mark; all documents stay."""
    found = secret_scan.scan(docs, keep=["text", "lang", "source"])
    text = secret_scan.masked(F.coalesce("text", F.lit("")), F.col("spans"))
    clean = found.withColumn("text", F.when(F.col("text").isNotNull(), text))
    return clean.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row comes as often as the mix takes it; equal rows come as often as it takes them together."""
    rows = docs.select(*COLUMNS).withColumn("_key", row_key())
    mixed = mixing.mix(rows.drop("doc_id").withColumnRenamed("_key", "doc_id"))
    copies = mixed.filter("copies > 0").groupBy(F.col("doc_id").alias("_key")).agg(F.sum("copies").alias("copies"))
    repeated = rows.dropDuplicates(["_key"]).join(copies, "_key")
    return repeated.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 1024 tokens, of ``SEQUENCE_DOCUMENTS`` documents at most."""
    return packing.pack_documents(docs, capacity=1024, documents=SEQUENCE_DOCUMENTS, weights=(1.0, 0.1, 0.1), **queries.tokenizer())


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack)]

#: The first stage is a trained model and the fourth draws copies, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
