"""A corpus pipeline over documents: each stage is one operator, and the next stage reads what it kept.

Stages: toxic documents go; of equal texts one stays; of near-duplicates one
stays; secrets are replaced in the texts; the rest is packed into sequences of
token ids. Empty input tables pass through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import minhash, packing, queries, secret_scan, toxicity, trie_dedup
from graphloom.llm.common import ensure_checkpoint_dir, read_table


#: Rows in a batch that goes to Python: a stage carries whole rows beside the texts it reads, so its batches hold each text twice.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(key))
    if held <= 0 or held > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def whole_row(docs: DataFrame) -> Column:
    """All columns in one struct, so none can clash with a column of an operator."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole_row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = queries.toxicity_model(spark, docs, sf_dir)
    return toxicity.score(docs, model, "doc_id", "text", whole_row(docs)).filter("predicted = 0").select("whole_row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return trie_dedup.exact_groups(docs, "doc_id", "text", whole_row(docs)).filter("kept").select("whole_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return minhash.near_classes(docs, "doc_id", "text", whole_row(docs)).filter("kept").select("whole_row.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = secret_scan.learn(docs, "doc_id", "text")
    found = secret_scan.scan(docs, model, "doc_id", "text", whole_row(docs))
    text = secret_scan.redact(F.col("whole_row.text"), F.col("spans"))
    clean = found.select(F.col("whole_row").withField("text", text).alias("whole_row")).select("whole_row.*")
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(docs, queries.BYTE_TOKENIZER, "doc_id", "text")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL cannot express the learned and sampled stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents of sf_dir. Each stage's rows are written to the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
