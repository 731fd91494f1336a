"""A streaming front end for ingest: files that arrive in a folder, each once, until none is left."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import payload_hash
from tidemark.sources.bronze import batch_id
from tidemark.sources.tables import Catalog


def drain(catalog: Catalog, folder: str, schema: T.StructType, table: str, checkpoint: str) -> None:
    """Append what is new in folder to a table and stop. The checkpoint knows which files went in; there is no event-time
    watermark, so rows that are late are not dropped. A batch that is tried again is recognised by its number and not added twice."""

    def add(df, number: int) -> None:
        if catalog.exists(table) and catalog.properties(table).get("stream_batch", -1) >= number:
            return
        now = datetime.now(UTC).replace(tzinfo=None)
        rows = df.select("*", F.lit(now).cast("timestamp_ntz").alias("_ingested_at"), F.lit(batch_id(now)).alias("_batch_id"), payload_hash(df, schema.names).alias("_payload_hash"))
        catalog.append(table, rows, f"stream batch {number} into {table}", {"stream_batch": number})

    stream = catalog.spark.readStream.schema(schema).parquet(folder).select("*", F.col("_metadata.file_path").alias("_source_file"))
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
