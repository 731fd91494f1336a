"""Embedding near-duplicates: int8 tile products with error bounds, and double precision where they leave doubt.

Vectors of one label and length are dealt into blocks; each pair of blocks is a task that multiplies tiles of
int8 codes. A unit vector u with code s*q and error |u - s*q| = e satisfies |u.v - s*t*(q.r)| <= e + (1 + e) f,
so a pair whose bound stays below the threshold cannot link; all others are computed again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .graph import Forest, checkpoint, components, width

#: Vectors in a side of a task, and in a side of a tile.
BLOCK, TILE = 4096, 1024
PAIRS = 1 << 16


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, scale, error) of the rows of x taken as unit vectors; q holds whole numbers from -127 to 127."""
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None])
    error = np.sqrt(((u - q * scale[:, None]) ** 2).sum(axis=1))
    return q.astype(np.int8), scale, error


def links(x: np.ndarray, side: np.ndarray, low: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) in parts: pairs i < j of rows, on different sides if there are two, with cosine >= low in double precision."""
    x = x / np.abs(x).max(axis=1)[:, None]  # neither norms nor products leave the range of doubles
    norm = np.sqrt((x * x).sum(axis=1))
    q, scale, error = codes(x)
    # codes stay int8; a tile's own are widened to multiply, and sums of products stay whole numbers in single precision up to 2**24
    wide = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    n, two = len(x), bool((side != side[0]).any())
    order = np.argsort(side, kind="stable")
    first = int((side == side[order[0]]).sum()) if two else 0
    rows = [(a, min(a + TILE, first if two else n)) for a in range(0, first if two else n, TILE)]
    for a, b in rows:
        for c in range(first if two else a, n, TILE):
            i, j = order[a:b], order[c : min(c + TILE, n)]
            top = (q[i].astype(wide) @ q[j].T.astype(wide)) * scale[i][:, None] * scale[j] + error[i][:, None] + (1 + error[i])[:, None] * error[j]
            y, z = np.nonzero(top >= low - 1e-6)
            y, z = i[y], j[z]
            if not two:
                keep = y < z
                y, z = y[keep], z[keep]
            for s in range(0, len(y), PAIRS):
                p, r = y[s : s + PAIRS], z[s : s + PAIRS]
                ok = (x[p] * x[r]).sum(axis=1) / (norm[p] * norm[r]) >= low
                if ok.any():
                    yield p[ok], r[ok]


def _tiles(low: float):
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("own", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lo, hi), rows in blocks.groups(batches, "part", "lo", "hi"):
            side = blocks.column(rows, "block")
            n = len(side)
            if n < 2 or (lo != hi and (side == side[0]).all()):
                continue
            ids, many, own = blocks.column(rows, "rep"), blocks.column(rows, "many"), blocks.column(rows, "own")
            flat = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            forest, count, a, b = Forest(n), np.zeros(n, np.int64), [], []
            for p, r in links(flat.reshape(n, -1), side, low):
                count += np.bincount(p, weights=many[r], minlength=n).astype(np.int64) + np.bincount(r, weights=many[p], minlength=n).astype(np.int64)
                roots = np.array([forest.root(i) for i in range(n)]) if len(p) > n else None
                at = np.flatnonzero(roots[p] != roots[r]) if roots is not None else range(len(p))
                for t in at:
                    if forest.join(int(p[t]), int(r[t])):
                        a.append(ids[p[t]])
                        b.append(ids[r[t]])
            has = np.flatnonzero(count)
            yield blocks.batch(schema, np.concatenate([np.zeros(len(has), np.int32), np.ones(len(a), np.int32)]), np.concatenate([ids[has], np.array(a, np.int64)]), np.concatenate([count[has], np.array(b, np.int64)]), np.concatenate([own[has], np.zeros(len(a), np.int64)]))

    return run, "kind int, a long, b long, own long"


def classes(vectors: DataFrame, low: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding, label).

    Vectors of one label link if their cosine in double precision is low or more. Vectors that are null, empty, all zero, or hold null or
    non-finite components, and those with a null label or vec_id, link with nothing; vectors of different lengths
    never link. Equal vectors collapse to one before tiles are made and all count as links of one another; rows
    that share a vec_id are vectors of their own but one node of the graph. A row without links is its own
    component; with a null vec_id its component and kept are null. Other columns are not read.
    """
    spark = vectors.sparkSession
    parts = width(spark)
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    good = F.expr("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    sound = base.where(good)
    own = checkpoint(sound.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")).withColumns({"part": F.xxhash64("label", F.size("embedding")), "own": F.xxhash64("label", "embedding")}))
    size = own.groupBy("part").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("blocks"))
    cells = own.join(blocks.small(checkpoint(size)), "part").withColumn("block", F.expr("cast(pmod(xxhash64(own), blocks) as int)"))
    cells = cells.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("part", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "own", "many", "embedding")
    out = checkpoint(blocks.together(cells, parts, "part", "lo", "hi").mapInArrow(*_tiles(low)))
    # a vector is known by its smallest id and its hash: rows of one id may hold several vectors
    counted = out.where("kind = 0").groupBy(F.col("a").alias("rep"), "own").agg(F.sum("b").alias("more"))
    reps = own.join(counted, ["rep", "own"], "left").select("label", "embedding", "rep", (F.col("many") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    known = checkpoint(sound.join(reps, ["label", "embedding"]).select("vec_id", "rep", "n_links"))
    found = components(out.where("kind = 1").select("a", "b").unionByName(known.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))))
    rows = known.select("vec_id", "n_links").unionByName(base.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links")))
    return rows.join(found.select(F.col("id").alias("vec_id"), "component"), "vec_id", "left").select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
