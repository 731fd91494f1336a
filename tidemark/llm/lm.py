"""Stupid-backoff scores: n-gram count tables partitioned by hash, joined to exploded n-grams, summed per document.

The corpus is its own language model, with each document scored against all others: a document's own counts are
taken off. For words u v, the score of v after u is c(u v) / c(u) if the pair occurs elsewhere, else
backoff * c(v) / n, and backoff * 1 / (n + 1) for a word that occurs nowhere else.

Documents are dealt into chunks by the hash of their id. A chunk sends each of its distinct words and pairs once, with its
count, to the partition of the count table that owns the hash, and the joined counts come back to it: so a word that every
document holds is a row for each chunk, not for each occurrence. The arrays travel packed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, text

U64 = np.uint64
#: Characters of text in a chunk, about.
CHUNK = 8 << 20
SENT = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
SENT_DDL = "chunk int, bucket int, blob binary"


class Chunk:
    """Words and pairs of a chunk: their distinct hashes and counts, and where each document's are."""

    def __init__(self, column: pa.ChunkedArray):
        parts, row0 = [], 0
        for piece in column.chunks:
            for i, j, data, off in text.slices(*text.buffers(piece)):
                h, row, _, _ = text.words(data, off)
                parts.append((h, row + row0))
                row0 += j - i
        h = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, U64)
        self.rows, self.row = row0, np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        # 40 bits after the bucket's own tell n-grams apart; words and pairs go to the same table under their own salts
        self.word, self.word_at, self.words = self._table(text.mix(h ^ text.MUL[50]))
        self.joined = np.flatnonzero(self.row[1:] == self.row[:-1]) if len(h) else np.zeros(0, np.int64)
        self.pair, self.pair_at, self.pairs = self._table(text.mix(h[self.joined] * text.MUL[51] + h[self.joined + 1]))

    @staticmethod
    def _table(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d, at, n = np.unique(h, return_inverse=True, return_counts=True)
        return d, at.astype(np.int32), n

    @staticmethod
    def _own(at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each occurrence's n-gram occurs in its document."""
        key = row.astype(np.int64) << 32 | at
        _, inv, n = np.unique(key, return_inverse=True, return_counts=True)
        return n[inv]

    def scores(self, word: np.ndarray, pair: np.ndarray, total: int, backoff: float) -> tuple[np.ndarray, np.ndarray]:
        """(words, sum of log scores) of each row, from the corpus counts of the chunk's distinct words and pairs."""
        n = np.bincount(self.row, minlength=self.rows)
        c1 = word[self.word_at] - self._own(self.word_at, self.row)
        left = np.maximum(total - n[self.row], 0)
        log = np.log(backoff * np.maximum(c1, 1) / np.where(c1 > 0, left, left + 1))
        c2 = pair[self.pair_at] - self._own(self.pair_at, self.row[self.joined])
        seen = c2 > 0
        v = self.joined[seen] + 1
        log[v] = np.log(c2[seen] / c1[v - 1])  # the word before occurs wherever the pair does
        first = np.concatenate([[True], self.row[1:] != self.row[:-1]]) if len(self.row) else np.zeros(0, bool)
        log[first] -= np.log(backoff)  # a first word has no context to back off from
        return n, np.bincount(self.row, weights=log, minlength=self.rows)


def _by(chunk: Chunk, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, positions, hashes, counts) over words, then pairs."""
    h = np.concatenate([chunk.word, chunk.pair])
    n = np.concatenate([chunk.words, chunk.pairs])
    for at, (pos, low, many) in blocks.split(((h >> U64(44)) % U64(buckets)).astype(np.int32), np.arange(len(h)), h & U64((1 << 40) - 1), n):
        yield at, pos, low, many


def _pack_counts(x: np.ndarray, usual: int) -> bytes:
    """A bit for each count that is not the usual one, then a byte for each of those, then those over 254."""
    v = x[x != usual]
    return np.packbits(x != usual).tobytes() + np.where(v > 254, 255, v).astype(np.uint8).tobytes() + v[v > 254].astype(np.int64).tobytes()


def _unpack_counts(raw: np.ndarray, n: int, usual: int) -> np.ndarray:
    bits = -(-n // 8)
    odd = np.unpackbits(raw[:bits], count=n).astype(bool)
    k = bits + int(odd.sum())
    v = raw[bits:k].astype(np.int64)
    v[v == 255] = np.frombuffer(raw[k:].tobytes(), np.int64)
    x = np.full(n, usual, np.int64)
    x[odd] = v
    return x


def _pack(low: np.ndarray, many: np.ndarray) -> bytes:
    """Five bytes a hash, then the counts."""
    five = low.view(np.uint8).reshape(-1, 8)[:, :5]
    return np.int64(len(low)).tobytes() + np.ascontiguousarray(five.T).tobytes() + _pack_counts(many, 1)


def _unpack(blob: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(blob, np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    low = np.zeros((n, 8), np.uint8)
    low[:, :5] = raw[8 : 8 + 5 * n].reshape(5, n).T
    return low.reshape(-1).view(U64), _unpack_counts(raw[8 + 5 * n :], n, 1)


def _send(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (c,), rows in blocks.groups(batches, "chunk"):
            out = [(c, at, _pack(low, many)) for at, _, low, many in _by(Chunk(rows.column("text")), buckets)]
            if out:
                yield blocks.batch(SENT, *(list(x) for x in zip(*out, strict=True)))

    return run, SENT_DDL


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The count table's partition: sums over chunks, joined back to each chunk's n-grams."""
    for (at,), rows in blocks.groups(batches, "bucket"):
        got = [_unpack(x.as_buffer()) for x in rows.column("blob").combine_chunks()]
        low = np.concatenate([x[0] for x in got])
        many = np.concatenate([x[1] for x in got])
        order = np.argsort(low, kind="stable")
        cut = text.runs(low[order])
        total = np.add.reduceat(many[order], cut[:-1])
        whole = np.empty(len(low), np.int64)
        whole[order] = np.repeat(total, np.diff(cut))
        extra, pos, out = whole - many, 0, []
        for lows, _ in got:
            out.append(_pack_counts(extra[pos : pos + len(lows)], 0))
            pos += len(lows)
        yield blocks.batch(SENT, blocks.column(rows, "chunk").astype(np.int32), [at] * len(out), out)


def _score(buckets: int, total: int, backoff: float):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in blocks.groups(batches, "chunk"):
            side = blocks.column(rows, "bucket")
            docs = rows.filter(pa.array(side < 0))
            replies = dict(zip(side[side >= 0].tolist(), (x.as_buffer() for x in rows.filter(pa.array(side >= 0)).column("blob").combine_chunks()), strict=True))
            chunk = Chunk(docs.column("text"))
            whole = np.concatenate([chunk.words, chunk.pairs])
            for at, pos, _, _ in _by(chunk, buckets):
                whole[pos] += _unpack_counts(np.frombuffer(replies[at], np.uint8), len(pos), 0)
            n, s = chunk.scores(whole[: len(chunk.words)], whole[len(chunk.words) :], total, backoff)
            yield blocks.batch(schema, docs.column("doc_id").combine_chunks(), n, s)

    return run, "doc_id long, n_words long, log_score double"


def score(docs: DataFrame, backoff: float = 0.4) -> DataFrame:
    """(doc_id, n_words, log_score, perplexity) of every row of docs, over whole texts.

    Words are as in the other operators, A-Z folded. log_score is the sum of the words' log scores; perplexity is
    exp(-log_score / n_words), null for texts without words, whose log_score is 0. Counts leave out the row's own text alone, so copies
    score each other well. Null texts are empty; rows with null or repeated ids are scored like others. docs must be deterministic.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts, buckets = blocks.spread(base)
    whole = base.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0)).alias("words")).first()
    chunks = max(1, -(-whole["chars"] // CHUNK))
    # equal texts may be many under one id: the text's hash deals those out too
    dealt = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    chunked = blocks.together(dealt, min(parts, chunks) if chunks < parts else parts, "chunk")
    sent = chunked.mapInArrow(*_send(buckets))
    counts = blocks.together(sent, parts, "bucket").mapInArrow(_count, SENT_DDL)
    both = dealt.select("chunk", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("blob"), "doc_id", "text").unionByName(counts.select("chunk", "bucket", "blob", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")))
    scored = both.repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(*_score(buckets, int(whole["words"]), backoff))
    return scored.withColumn("perplexity", F.when(F.col("n_words") > 0, F.exp(-F.col("log_score") / F.col("n_words"))))
