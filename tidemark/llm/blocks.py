"""Packed exchanges: arrays travel between tasks as one binary value per (chunk, bucket), not as rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64


def batch(schema: pa.Schema, *columns: object) -> pa.RecordBatch:
    """A record batch of columns given as arrays or lists."""
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def column(x: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """A numeric column as numpy values."""
    return np.asarray(x.column(name).to_numpy(zero_copy_only=False) if isinstance(x, pa.RecordBatch) else x.column(name).to_numpy())


def together(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Rows of equal keys side by side in one partition, so that a task can stream through groups."""
    return df.repartition(parts, *keys).sortWithinPartitions(*keys)


def groups(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) for each run of equal keys; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([column(b, c) for c in keys])
        cut = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            key = tuple(k[:, s].tolist())
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(s, e - s))
    if held:
        yield last, pa.Table.from_batches(held)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, a checkpointed frame of a few numbers a row, for the build side of a join: broadcast if it is counted to
    have at most ``rows`` rows, and otherwise shuffled with a hash table per partition."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("shuffle_hash")


#: Bytes of input behind a partition of an exchange, and behind a bucket, that is what a task holds at a time, at most, about.
PART, BUCKET = 256 << 20, 32 << 20


def spread(df: DataFrame) -> tuple[int, int]:
    """(partitions, buckets) for packed exchanges of df: by the session's shuffle partitions, and more where df's files are
    estimated to be large, so that what one task holds doesn't grow with the input. Results don't depend on them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 56:  # unknown
        size = 0
    parts = max(parts, min(-(-size // PART), 1 << 20))
    return parts, max(4 * parts, min(-(-size // BUCKET), 1 << 24))


def split(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, parts of the arrays) for each bucket that occurs, in stable order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cut = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(order)]])
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        at = order[s:e]
        yield int(sorted_[s]), [a[at] for a in arrays]


def scatter(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, from its high bits."""
    return ((hashes >> U64(40)) % U64(buckets)).astype(np.int32)
