"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm import bpe, html, infill, jaccard, mixing, neighbours, packing, periods, pii, quality, topk, toxicity, urls

TOKENIZER = "byte_bpe_50k.json"
WORD_TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, folder, "embeddings"))


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    encoded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), path).drop("text")
    return bpe.decode(encoded, path).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(documents).drop("text")


def op5_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_products(table(spark, folder, "embeddings"))


def op6_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"), words=3, percent=90)


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html.main_text(pages).select("page_id", "url", "text", "n_chars")


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, folder, "documents").select("doc_id", "text"))
    digest = "concat_ws(',', transform({}, x -> concat_ws(':', x.kind, x.start, x.end)))"
    base = "filter(spans, x -> x.base)"
    return found.select(
        "doc_id",
        *(
            F.expr(f"cast(size(filter({base}, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
            for kind in pii.KINDS
        ),
        F.sha2(F.expr(digest.format(base)).cast("binary"), 256).alias("base_sha256"),
        F.expr(digest.format("spans")).alias("spans"),
    )


def op10_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(table(spark, folder, "pages"))


def op11_infill(spark: SparkSession, folder: str) -> DataFrame:
    return infill.fill_in_middle(table(spark, folder, "documents")).drop("output")


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    found = packing.pieces(table(spark, folder, "documents"), public_tokenizers.path(WORD_TOKENIZER))
    return packing.pack(found.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def planted(words: list[bytes], crc: int | None) -> list[bytes]:
    """One text in ten with its end replaced by a repetition, by the checksum of its id."""
    if crc is None or crc % 10 or not words:
        return words
    g, n = crc // 10, len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    part = words[start : start + period]
    return words[:start] + (part * -(-(n - start) // period))[: n - start]


def op13_periods(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periods.find_runs(documents.withColumn("crc", crc), also=["crc"], rewrite=planted)
    best = found.withColumn("best", periods.steepest(F.col("runs")))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, F.concat(r.period, F.lit("\n")))))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{name}").alias(name) for name in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_quality": op1_quality,
    "op2_neighbours": op2_neighbours,
    "op3_bpe": op3_bpe,
    "op4_mixing": op4_mixing,
    "op5_topk": op5_topk,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_html": op8_html,
    "op9_pii": op9_pii,
    "op10_urls": op10_urls,
    "op11_infill": op11_infill,
    "op12_packing": op12_packing,
    "op13_periods": op13_periods,
}

ORACLES = {
    "op4_mixing": mixing.ORACLE_SQL,
    "op5_topk": topk.ORACLE_SQL,
    "op11_infill": infill.ORACLE_SQL,
}
