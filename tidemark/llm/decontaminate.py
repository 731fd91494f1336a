"""Benchmark decontamination: MinHash containment search for short test items inside long documents.

Items are partitioned by the size of their shingle sets. An item's sketch is its smallest hashes, as many as
the containment threshold lets a document lack, plus one: a document that contains the item must hold one of
them, so the search misses none, however long the document. Candidates are verified by exact containment of
shingles. Items of fewer words than a shingle are a size of their own: their only shingle is as long as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, text
from .graph import folder, written

U64 = np.uint64
#: Bytes of item texts that are searched for in one pass over the documents; more items take more passes.
PASS_BYTES = 32 << 20
#: Items of fewer words than this would match by chance: they are found in documents that consist of their words alone.
SHORTEST = 3


class Index:
    """Sketches and sets of a bounded batch of items."""

    def __init__(self, ids: list[int], texts: list[str], k: int, num: int, den: int):
        data, off = text.buffers(pa.array(texts, pa.string()))
        h, row, _, _ = text.words(data, off)
        rows, count = len(texts), np.bincount(row, minlength=len(texts))
        self.k, (self.tokens, self.bound) = k, text.sets(*text.grams(h, row, rows, k), rows)
        self.ids, self.n = np.array(ids, np.int64), np.diff(self.bound)
        self.least = -(-self.n * num // den)
        # (words, hashes in order, their items) of items shorter than a shingle
        self.short = []
        for w in range(SHORTEST, k):
            own = np.flatnonzero(count == w)
            if len(own):
                g = text.grams(h[np.isin(row, own)], row[np.isin(row, own)], rows, w)[0]
                self.short.append((w, np.sort(g), own[np.argsort(g, kind="stable")]))
        m = np.where((count >= SHORTEST) & (count < k), 0, np.minimum(self.n, self.n - self.least + 1))
        own = np.repeat(np.arange(len(self.n)), m)
        hashes = self.tokens[self.bound[own] + np.arange(len(own)) - np.repeat(np.cumsum(m) - m, m)]
        # by size class, with the class's largest sketch hash as a threshold that rules out most of a document at once
        kind = np.floor(np.log2(np.maximum(self.n, 1))).astype(int)[own]
        self.parts = []
        for c in np.unique(kind):
            h, o = hashes[kind == c], own[kind == c]
            by = np.argsort(h, kind="stable")
            self.parts.append((h[by].max(), h[by], o[by]))

    def search(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, shared) of the documents, given by their bytes, that contain items."""
        h, word_row, _, _ = text.words(data, off)
        g, bound = text.sets(*text.grams(h, word_row, len(off) - 1, self.k), len(off) - 1)
        row = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
        found = []
        for top, hashes, own in self.parts:
            at = np.flatnonzero(g <= top)
            found += _looked_up(g[at], row[at], hashes, own)
        out = []
        for r, item in np.unique(np.concatenate(found), axis=0).tolist() if found else []:
            mine = self.tokens[self.bound[item] : self.bound[item + 1]]
            doc = g[bound[r] : bound[r + 1]]
            at = np.minimum(np.searchsorted(doc, mine), len(doc) - 1)
            shared = int((doc[at] == mine).sum())
            if shared >= self.least[item]:
                out.append((r, item, shared))
        whole = [x for w, hashes, own in self.short for x in _looked_up(*text.grams(h, word_row, len(off) - 1, w), hashes, own)]
        out += [(r, item, 1) for r, item in np.unique(np.concatenate(whole), axis=0).tolist()] if whole else []
        return tuple(np.array(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _looked_up(g: np.ndarray, row: np.ndarray, hashes: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """[(row, item)] where hashes, in order and with their items, hold one of a row's."""
    lo, hi = np.searchsorted(hashes, g, "left"), np.searchsorted(hashes, g, "right")
    many = hi - lo
    at, lo, many = np.flatnonzero(many > 0), lo[many > 0], many[many > 0]
    if not len(at):
        return []
    items = own[np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    return [np.stack([np.repeat(row[at], many), items], axis=1)]


def _searcher(index: Index):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in text.slices(*text.buffers(b.column(1))):
                r, item, shared = index.search(data, off)
                if len(r):
                    yield blocks.batch(schema, b.column(0).slice(i, j - i).take(pa.array(r)), index.ids[item], shared, index.n[item])

    return run, "doc_id long, item_id long, n_shared long, n_item long"


def _cleaner(index: Index, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stays = np.ones(b.num_rows, bool)
            for i, _, data, off in text.slices(*text.buffers(b.column(at))):
                stays[i + index.search(data, off)[0]] = False
            yield b.filter(pa.array(stays))

    return run


def _indexes(items: DataFrame, k: int, num: int, den: int, pass_bytes: int) -> Iterator[Index]:
    """An index for each pass: items in order of id, of at most pass_bytes of text together."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    # A pass takes the items of one range of running byte totals, which toLocalIterator streams in order.
    own = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    for row in own.toLocalIterator():
        n = len(row.text.encode())
        if ids and size + n > pass_bytes:
            yield Index(ids, texts, k, num, den)
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        size += n
    if ids:
        yield Index(ids, texts, k, num, den)


def matches(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 75, den: int = 100, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) for each document that holds num / den or more of an item's shingles.

    docs has doc_id and text, items has item_id and text; other columns are not read. Items without words match
    nothing, items of SHORTEST to k - 1 words match wherever these words follow one another, and shorter ones match documents that consist of
    the same words; null ids of documents are returned as null, items with a null id or text are left out. Repeated rows match once each. Items go to the
    executors in passes of at most pass_bytes of text (an item longer than that has a pass of its own). A single pass is lazy; of several,
    each is run and written to the shared folder before the next one's index is made, so memory is bounded for any number of items and only the passes grow.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    indexes = _indexes(items, k, num, den, pass_bytes)
    index, out = next(indexes, Index([], [], k, num, den)), None
    while index:
        found, index = base.mapInArrow(*_searcher(index)), next(indexes, None)
        if index or out is not None:
            found = written(found)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 75, den: int = 100, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of docs, with all columns, whose own text contains no item as ``matches`` finds them; null texts contain none, null and repeated ids count for nothing.

    A single pass is a filter without a shuffle. Where items take several, what a pass leaves is written to the shared
    folder for the next, so that a task holds the index of one pass alone; two such tables exist at most.
    """
    out, at, path = docs, docs.columns.index("text"), None
    indexes = _indexes(items, k, num, den, pass_bytes)
    index = next(indexes, None)
    while index:
        out, index = out.mapInArrow(_cleaner(index, at), docs.schema), next(indexes, None)
        if index:
            gone, path = path, f"{folder(docs.sparkSession)}/table-{uuid.uuid4().hex}"
            out.write.parquet(path)
            out = docs.sparkSession.read.schema(docs.schema).parquet(path)
            if gone:
                jvm = docs.sparkSession.sparkContext._jvm
                old = jvm.org.apache.hadoop.fs.Path(gone)
                old.getFileSystem(docs.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return out
