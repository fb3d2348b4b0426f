"""The corpus pipeline: five stages over the documents, each written as Parquet and read by the next.

Quality, near copies, personal data, the mixture's order, tokens. Every stage takes (spark, docs, sf_dir) and
works on all rows it gets; all but the last return the columns of the documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm import bpe, jaccard, mixing, pii, quality
from tenderlake.llm.common import cut, free_name
from tenderlake.session import delete, passing, scratch_path

# Near copies: five-word shingles, a similarity of 0.8.
WORDS, PERCENT = 5, 80
MOST_BROADCAST = 100_000
ROWS_PER_BATCH = 1_000
TOKENIZER = "byte_bpe_50k.json"


def small_batches(spark: SparkSession) -> None:
    """Texts are large rows: Python gets this many at a time, in this and all later stages of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    small_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, out="quality_score_").where(
        F.col("quality_score_") >= quality.THRESHOLD
    ).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, once.

    Documents without an id belong to no group and stay. Rows of one id with different texts are documents of
    their own: each is judged by its text, and in a group they go before the others. Rows with one id and text
    stay once, the smallest by its other columns.
    """
    small_batches(spark)
    key, several = free_name(docs, "row_key_", "several_texts_")
    named = docs.where("doc_id is not null")
    print_of = F.xxhash64("text", F.col("text").isNull())
    ids = cut(
        named.groupBy("doc_id")
        .agg(F.min(print_of).alias("low"), F.max(print_of).alias("high"))
        .where("low <> high")
        .select("doc_id", F.lit(True).alias(several))
    )
    # Such ids are rare; a table of many meets the documents by an ordinary join.
    few = ids.count() <= MOST_BROADCAST
    own = -F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.col("text").isNull()), 1) - 1
    keyed = named.join(F.broadcast(ids) if few else ids, "doc_id", "left").withColumn(
        key, F.when(F.col(several), own).otherwise(F.col("doc_id"))
    )
    found = jaccard.jaccard_components(keyed.select(key, "text"), doc_id=key, words=WORDS, percent=PERCENT)
    gone = found.where(F.col("component_id") != F.col(key)).select(key).distinct()
    columns = ["doc_id", *(c for c in docs.columns if c != "doc_id")]
    once = keyed.join(gone, key, "left_anti").groupBy(key).agg(F.min(F.struct(columns)).alias("row"))
    return once.select("row.*").select(docs.columns).union(docs.where("doc_id is null"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` follows the text."""
    found = pii.find_personal_data(docs, out="pii_spans_")
    return (
        pii.redact(found, spans="pii_spans_")
        .withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
        .select(docs.columns)
    )


def in_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, rows and files in the order that mixes the sources to their target weights."""
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return mixing.in_mixture_order(mixing.mix(docs), docs.columns, files)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, packed in four bytes each, in the mixture's order; and whether they decode to it."""
    small_batches(spark)
    documents = docs.select("doc_id", "source", "text")
    return bpe.encode_decode(documents, public_tokenizers.path(TOKENIZER)).select(
        "doc_id",
        "source",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("PII", without_personal_data),
    ("mixing sources to target weights", in_mixture),
    ("BPE encoding and decoding", tokens),
]

# The quality stage is a learned model: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder, and deleted once the
    next stage is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage-" + "".join(c if c.isalnum() else "-" for c in name))
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
