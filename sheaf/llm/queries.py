"""One query for each operator over its whole table, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import quality, toxicity
from sheaf.llm.decontaminate import contamination
from sheaf.llm.exact_dedup import duplicate_groups
from sheaf.llm.labels import held_out
from sheaf.llm.licences import scanned
from sheaf.llm.main_text import extracted
from sheaf.llm.ngram_join import near_duplicates
from sheaf.llm.pieces import PieceModel, encoded
from sheaf.llm.pii import pseudonymised
from sheaf.llm.substring_dedup import remove_repeated


#: The vocabulary file is read on the driver and never copied.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


#: For these queries alone: a real key is a secret that the caller passes.
DEMO_KEY = b"example key of the registered query"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str, key: bytes = DEMO_KEY) -> DataFrame:
    rows = pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    return rows.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), F.transform("pii", lambda x: x["kind"]).alias("kinds"), "pii")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), into="c")
    items = F.col("c.items")
    return rows.select(
        "doc_id", "c.n_words", "c.n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), (F.col("c.n_hit") > 0).alias("contaminated"),
    )


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=90)
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeated(table(spark, sf_dir, "documents"), window=35)
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _predictions(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _predictions(toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"))), toxicity.THRESHOLD)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _predictions(quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels"))), quality.THRESHOLD)


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    rows = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), PieceModel.load(model))
    return rows.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", "round_trip")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    return rows.select("doc_id", names.alias("license_ids"), F.size("licenses").cast("long").alias("n_places"), "licenses")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = duplicate_groups(table(spark, sf_dir, "documents"), keep="max")
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_pii_pseudonyms": op1_pii_pseudonyms, "op2_html_extraction": op2_html_extraction, "op3_decontamination": op3_decontamination, "op4_ngram_jaccard": op4_ngram_jaccard, "op5_substring_dedup": op5_substring_dedup, "op6_sentencepiece": op6_sentencepiece, "op7_license_scan": op7_license_scan, "op8_toxicity": op8_toxicity, "op9_exact_dedup": op9_exact_dedup, "op10_quality": op10_quality}
