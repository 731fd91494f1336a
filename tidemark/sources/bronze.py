"""Replayable ingest: files of a source folder into append-only tables, each file once.

The paths of files that went in are a property of the table and commit with its rows, so a run that dies leaves neither.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import payload_hash
from tidemark.session import small_frame
from tidemark.sources.tables import Catalog

META = "_source_file string, _ingested_at timestamp_ntz, _batch_id string, _payload_hash string"


def batch_id(now: datetime) -> str:
    return f"{now:%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"


def source_files(spark: SparkSession, folder: str) -> list[str]:
    """Parquet files of a folder in order of name, listed by Spark's file system; none if the folder is empty or missing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(x.getPath().toString() for x in fs.listStatus(path) if x.getPath().getName().endswith(".parquet"))


def enrich(spark: SparkSession, files: list[str], schema: T.StructType, root: str, now: datetime, batch: str) -> DataFrame:
    """Rows of files as schema, with their file's path below root, the run's clock and batch, and a hash of the columns that
    their file has: files are grouped by their own columns, of which footers tell, and missing columns are null."""
    by: dict[tuple[str, ...], list[str]] = {}
    for f in files:
        by.setdefault(tuple(spark.read.parquet(f).columns), []).append(f)
    out = None
    for names, group in by.items():
        have = T.StructType([f for f in (schema[c] for c in names if c in schema.names)])
        df = spark.read.schema(have).parquet(*group)
        df = df.select("*", F.regexp_replace(F.col("_metadata.file_path"), r"^.*?" + _quoted(root) + "/?", "").alias("_source_file"), F.lit(now).cast("timestamp_ntz").alias("_ingested_at"), F.lit(batch).alias("_batch_id"), payload_hash(df).alias("_payload_hash"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    want = T.StructType(schema.fields + T._parse_datatype_string(META).fields)
    if out is None:
        return small_frame(spark, [], want)
    return out.select(*(F.col(f.name).cast(f.dataType) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want.fields))


def _quoted(root: str) -> str:
    return "".join("\\" + c if c in r"\.+*?()[]{}|^$" else c for c in root.split(":", 1)[-1].rstrip("/"))


def ingest(catalog: Catalog, root: str, schemas: dict[str, T.StructType], entities: list[str] | None = None, now: datetime | None = None) -> dict[str, int]:
    """Append each entity's new files to bronze.<entity>; returns the number of files for each. One clock and batch serve the run."""
    if unknown := set(entities or ()) - schemas.keys():
        raise ValueError(f"unknown entities: {', '.join(sorted(unknown))}")
    now = now or datetime.now(UTC).replace(tzinfo=None)
    batch, done = batch_id(now), {}
    for name in entities or schemas:
        table = f"bronze.{name}"
        before = catalog.properties(table).get("processed_files", []) if catalog.exists(table) else []
        fresh = [f for f in source_files(catalog.spark, f"{root}/{name}") if f.rsplit("/", 1)[-1] not in before]
        if fresh:
            df = enrich(catalog.spark, fresh, schemas[name], root, now, batch)
            catalog.append(table, df, f"ingest {batch} into {table}", {"processed_files": sorted([*before, *(f.rsplit("/", 1)[-1] for f in fresh)])})
        done[name] = len(fresh)
    return done
