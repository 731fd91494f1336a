"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage works on all that its predecessor kept. All but the last return the columns of documents; the last
returns them with ``copy``, the number of a document's copy in the mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, fm, graph, jaccard, mixing, pii

#: A document stays if its quality score is at least this, as op1 predicts.
QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good. Rows with a null id are scored by their texts like others."""
    machine = fm.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", ~fm.fold(5, 0))
    return fm.keep(docs, machine, QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id.

    Where ids repeat or are null, rows are numbered first, in order of id, null last, and of text, so that each stands by its own
    text: of copies under one id, or under none, one stays too. Texts without words are copies of nothing and all stay.
    """
    own = "doc_id"
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        own, ordered = "_row", docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text")
        docs = graph.written(ordered.withColumn(own, F.monotonically_increasing_id()))
    kept = jaccard.classes(docs, own).where("doc_id = component_id").select(F.col("doc_id").alias("_id"))
    return docs.join(kept, F.col(own) == F.col("_id"), "left_semi").drop("_row")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Each row stands by its own text, whatever its id; null and empty texts stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars to match; no row goes, whatever its id, and null texts stay null."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as its source's target asks. Null sources are one source; null texts have no words; rows of one id are ranked by their hash."""
    return mixing.mix(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminated), ("PII", redacted), ("mixing sources to target weights", mixed)]

#: The classifier is not SQL-expressible; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each returns is written below the checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{graph.folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
