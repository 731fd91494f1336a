"""The queries opN_<name>: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, fm, jaccard, lm, mixing, pii, repeats, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document by a factorisation machine."""
    return fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", 5, 0)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose five-word shingle sets overlap by 75 % or more."""
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents: a row for each document and item."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of embeddings of one label with cosines of 0.98 or more."""
    return embeddings.classes(table(spark, sf_dir, "embeddings"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page's url."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of each document against the rest of the corpus."""
    df = lm.score(table(spark, sf_dir, "documents"))
    return df.withColumns({"log_score": F.round("log_score", 4), "perplexity": F.round("perplexity", 1)})


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", mixing.size().alias("size"))
    return mixing.copies(sized, sized=True).select("doc_id", "size", "source_size", "target", "taken")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document."""
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document by a factorisation machine."""
    return fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", 4, 2)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the 100-byte strings that occur earlier."""
    return repeats.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
