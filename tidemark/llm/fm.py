"""Factorisation machines over hashed words, structure statistics and metadata, for quality and for toxicity.

A score is sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise term is computed in linear
time as half of (sum v_i x_i)^2 - sum v_i^2 x_i^2. Features are the distinct words of the whole text without the
punctuation around them, their stems, hashed, numbers on the text's form, and the number of characters that the row
states. A stem is a word's first bytes: it carries what is learnt of some forms of an inflected word over to those
that no labelled row holds. Training takes a bounded, documented sample of labelled rows, in one task of an executor;
scoring takes every row.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, text

U64 = np.uint64
_kind = np.zeros(256, np.int64)
_kind[97:123], _kind[65:91], _kind[48:58], _kind[128:] = 1, 2, 3, 4
_kind[[0x20, 9, 10, 11, 12, 13]] = 5
_kind[[ord(c) for c in ".,;:?'\"-()"]] = 6
_kind[[ord(c) for c in "!#$%&*|<>{}[]\\^~_=+@/`"]] = 7
_kind[10] = 8
_ink = (_kind > 0) & (_kind < 5)
FORM, META = 16, 2
#: Bytes of a word's stems; a word that is no longer is its own stem.
STEMS = (4, 7)
#: Power of a row's number of terms that its terms are divided by in the pairwise part.
DAMP = 0.25


def form(data: np.ndarray, off: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Structure statistics of each row, each from 0 to about 1: shares of kinds of bytes, word and line shape, length."""
    rows = len(off) - 1
    size = np.diff(off)
    own = np.repeat(np.arange(rows), size)
    kinds = np.bincount(own * 9 + _kind[data], minlength=rows * 9).reshape(rows, 9)
    n = np.maximum(size, 1)[:, None]
    count = np.bincount(row, minlength=rows)
    long = np.bincount(row, weights=end - start, minlength=rows)
    last = np.bincount(row, weights=_kind[data[end - 1]] >= 6, minlength=rows) if len(end) else np.zeros(rows)
    odd = np.bincount(row, weights=_kind[data[end - 1]] == 7, minlength=rows) if len(end) else np.zeros(rows)
    lead = np.bincount(row, weights=_kind[data[start]] == 2, minlength=rows) if len(start) else np.zeros(rows)
    c = np.maximum(count, 1)
    return np.column_stack([kinds[:, 1:] / n, np.minimum(long / c / 12, 2), last / c, odd / c, lead / c, distinct / c, np.log1p(count) / 10, np.minimum(kinds[:, 8] / c * 8, 2), count == 0]).astype(np.float32)


def bare(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without what is neither letter nor digit at their ends; such a word of nothing else has end = start."""
    if not len(start):
        return start, end
    at = np.flatnonzero(_ink[data])
    first, last = np.searchsorted(at, start), np.searchsorted(at, end)
    any_ = last > first
    a, b = start.copy(), start.copy()
    a[any_], b[any_] = at[first[any_]], at[last[any_] - 1] + 1
    return a, b


def features(data: np.ndarray, off: np.ndarray, stated: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices, bounds, statistics): the distinct hashed words and stems of each row, its form and its metadata.

    stated is the number of characters that each row states, NaN if none.
    """
    h, row, start, end = text.words(data, off)
    rows = len(off) - 1
    distinct = np.diff(text.sets(h, row, rows)[1])
    a, b = bare(data, start, end)
    some = b > a
    a, b, own = a[some], b[some], row[some]
    terms = np.stack([text.starts(data, a, b, k) for k in (len(data) + 1, *STEMS)], axis=1).ravel()
    g, bound = text.sets(terms >> U64(64 - bits), np.repeat(own, 1 + len(STEMS)), rows)
    known = np.isfinite(stated)
    meta = np.column_stack([np.log1p(np.maximum(np.where(known, stated, 0), 0)) / 10, ~known]).astype(np.float32)
    return g.astype(np.int64), bound, np.hstack([form(data, off, row, start, end, distinct), meta])


@dataclass
class Machine:
    """A trained factorisation machine: what is not zero of the terms, in order of index, and the statistics' own."""

    bits: int
    b: float
    idx: np.ndarray
    w: np.ndarray
    v: np.ndarray
    stat_w: np.ndarray
    stat_v: np.ndarray
    loss: list[float] = field(default_factory=list)

    def scores(self, idx: np.ndarray, bound: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n = np.diff(bound)
        rows = len(n)
        at = np.full(1 << self.bits, -1, np.int32)
        at[self.idx] = np.arange(len(self.idx))
        at = at[idx]
        own = np.repeat(np.arange(rows), n)[at >= 0]
        at = at[at >= 0]
        # a term counts 1 in the linear part, where few words decide, and less the more terms there are in the pairwise part
        x, stats, each = np.maximum(n, 1.0) ** -DAMP, stats.astype(np.float64), self.v[at]
        total = np.stack([np.bincount(own, weights=each[:, f], minlength=rows) for f in range(self.v.shape[1])], axis=1) * x[:, None] + stats @ self.stat_v
        square = np.bincount(own, weights=(each**2).sum(axis=1), minlength=rows) * x**2 + (stats**2 @ self.stat_v**2).sum(axis=1)
        z = self.b + np.bincount(own, weights=self.w[at], minlength=rows) + stats @ self.stat_w + 0.5 * ((total**2).sum(axis=1) - square)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, bits=self.bits, b=self.b, idx=self.idx, w=self.w, v=self.v, stat_w=self.stat_w, stat_v=self.stat_v, loss=np.array(self.loss))
        return out.getvalue()

    @staticmethod
    def load(blob: bytes) -> Machine:
        x = np.load(io.BytesIO(blob))
        return Machine(int(x["bits"]), float(x["b"]), x["idx"], x["w"], x["v"], x["stat_w"], x["stat_v"], x["loss"].tolist())


def train(idx: np.ndarray, bound: np.ndarray, stats: np.ndarray, y: np.ndarray, bits: int = 20, rank: int = 4, epochs: int = 20, rate: float = 0.5, l1: float = 1e-3, group: float = 2e-3, least: int = 3, seed: int = 11, size: int = 128) -> Machine:
    """Fit by mini-batch Adagrad on the logistic loss.

    Terms of fewer than ``least`` rows cannot generalise and are left out. Linear weights are softly thresholded one by one, latent vectors as
    groups, so that terms whose company tells nothing keep no vector. Steps shrink to nothing, so that no late long text leaves its terms out of balance.
    Rows are dealt into batches once, and the batches take turns in another order in each epoch.
    """
    rng = np.random.default_rng(seed)
    df = np.bincount(idx, minlength=1 << bits)
    good = df >= least
    place = (np.cumsum(good) - 1).astype(np.int32)
    keep = good[idx]
    upto = np.concatenate([[0], np.cumsum(keep)])[bound]
    ids, x_all = place[idx[keep]], np.maximum(np.diff(bound), 1.0) ** -DAMP
    terms, forms, n = int(good.sum()), stats.shape[1], len(y)
    p = (y.sum() + 1) / (n + 2)
    b = float(np.log(p / (1 - p)))
    w, v = np.zeros(terms), rng.normal(0, 0.05, (terms, rank))
    stat_w, stat_v = np.zeros(forms), rng.normal(0, 0.05, (forms, rank))
    gb, gw, gv, gsw, gsv = 1e-2, np.full(terms, 1e-2), np.full(terms, 1e-2), np.full(forms, 1e-2), np.full((forms, rank), 1e-2)
    order, losses = rng.permutation(n), []
    batches = [_incidence(order[k : k + size], ids, upto) for k in range(0, n, size)]
    for epoch in range(epochs):
        lost = 0.0
        for turn, k in enumerate(rng.permutation(len(batches))):
            step = rate * (1 - (epoch + turn / len(batches)) / epochs)
            rows, here, own, to = batches[k]
            m, x, st = len(rows), x_all[rows][:, None], stats[rows].astype(np.float64)
            vh = v[here]
            linear, sums, squares = np.split(_sums(np.column_stack([w[here], vh, (vh**2).sum(axis=1)]), to, own, m), [1, 1 + rank], axis=1)
            total = sums * x + st @ stat_v
            z = b + linear[:, 0] + st @ stat_w + 0.5 * ((total**2).sum(axis=1) - squares[:, 0] * x[:, 0] ** 2 - (st**2 @ stat_v**2).sum(axis=1))
            guess = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            err = (guess - y[rows])[:, None] / m
            lost -= float(np.log(np.maximum(np.where(y[rows] > 0, guess, 1 - guess), 1e-9)).sum())
            # a term's gradients are sums over the rows that hold it
            dw, pull, self_ = np.split(_sums(np.hstack([err, err * x * total, err * x**2]), own, to, len(here)), [1, 1 + rank], axis=1)
            gw[here] += dw[:, 0] ** 2
            pace = step / np.sqrt(gw[here])
            new = w[here] - pace * dw[:, 0]
            w[here] = np.sign(new) * np.maximum(np.abs(new) - l1 * pace, 0)
            dv = pull - vh * self_
            gv[here] += (dv**2).sum(axis=1)
            pace = (step / np.sqrt(gv[here]))[:, None]
            new = vh - pace * dv
            v[here] = new * np.maximum(0, 1 - group * pace / np.maximum(np.sqrt((new**2).sum(axis=1, keepdims=True)), 1e-12))
            es = err * st
            ds, dsv = es.sum(axis=0), es.T @ total - (es * st).sum(axis=0)[:, None] * stat_v
            gsw += ds**2
            stat_w -= step * ds / np.sqrt(gsw)
            gsv += dsv**2
            stat_v -= step * dsv / np.sqrt(gsv)
            db = float(err.sum())
            gb += db**2
            b -= step * db / np.sqrt(gb)
        losses.append(lost / max(n, 1))
    live = (w != 0) | (v != 0).any(axis=1)
    return Machine(bits, b, np.flatnonzero(good)[live].astype(np.uint32), w[live].astype(np.float32), v[live].astype(np.float32), stat_w, stat_v, losses)


def _incidence(rows: np.ndarray, ids: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, terms, and of each occurrence the row and the term, by place in these)."""
    parts = [ids[upto[r] : upto[r + 1]] for r in rows.tolist()]
    here, to = np.unique(np.concatenate(parts), return_inverse=True)
    return rows, here, np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in parts]), to.astype(np.int32)


def _sums(values: np.ndarray, gather: np.ndarray, into: np.ndarray, size: int) -> np.ndarray:
    """Sums of the gathered rows of values, by where they go."""
    return np.stack([np.bincount(into, weights=np.ascontiguousarray(c)[gather], minlength=size) for c in values.T], axis=1)


def _extract(bits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("idx", pa.binary()), ("stats", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stated = blocks.column(b, "stated").astype(np.float64)
            for i, j, data, off in text.slices(*text.buffers(b.column("text"))):
                idx, bound, stats = features(data, off, stated[i:j], bits)
                idx = idx.astype(np.uint32)
                yield blocks.batch(schema, b.column("doc_id").slice(i, j - i), b.column("y").slice(i, j - i), [idx[s:e].tobytes() for s, e in zip(bound[:-1], bound[1:], strict=True)], [x.tobytes() for x in stats])

    return run, "doc_id long, y int, idx binary, stats binary"


def _train(most: int, bits: int, how: dict):
    """The one task that fits: rows come in order, and it stops taking them where their terms would pass ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, idx, stats, size = [], [], [], 0
        for b in batches:
            for y, i, s in zip(*(b.column(c) for c in ("y", "idx", "stats")), strict=True):
                i = np.frombuffer(i.as_buffer(), np.uint32)
                if size + len(i) > most:
                    continue
                size += len(i)
                ys.append(y.as_py())
                idx.append(i.copy())
                stats.append(np.frombuffer(s.as_py(), np.float32))
        if ys:
            bound = np.concatenate([[0], np.cumsum([len(x) for x in idx])])
            m = train(np.concatenate(idx), bound, np.stack(stats), np.array(ys, np.float64), bits=bits, **how)
            yield blocks.batch(pa.schema([("machine", pa.binary())]), [m.dump()])

    return run, "machine binary"


def _stated(docs: DataFrame) -> Column:
    return F.expr("try_cast(n_chars as double)") if "n_chars" in docs.columns else F.lit(None).cast("double")


def fit(docs: DataFrame, labels: DataFrame, target: str, train_on: Column, sample: int = 16000, most: int = 24_000_000, bits: int = 20, **how: float) -> Machine | None:
    """A machine for labels.<target>, learnt from at most ``sample`` labelled ids for which train_on holds.

    The sample is the ids of smallest hash, the same at every run; an id that several rows share counts once in it, with the row of
    least features and, if labelled twice, the greater label. Rows whose terms would bring the sample's above ``most`` are left
    out of it. Its features, not its texts, meet in one task of an executor, whose memory ``sample`` and ``most`` bound, and only the
    machine's terms that are not zero come to the driver. A lost task is fitted again, to the same machine. None if there is no labelled row.
    """
    lab = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(target) > 0).cast("int").alias("y")).where(train_on)
    pick = lab.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), _stated(docs).alias("stated")).join(F.broadcast(pick), "doc_id")
    found = rows.select("doc_id", "y", "text", "stated").mapInArrow(*_extract(bits)).groupBy("doc_id").agg(F.min(F.struct("y", "idx", "stats")).alias("r"))
    dealt = found.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("r.*")
    got = dealt.mapInArrow(*_train(most, bits, how)).first()
    return Machine.load(bytes(got[0])) if got else None


def _score(m: Machine | None):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stated = blocks.column(b, "stated").astype(np.float64)
            for i, j, data, off in text.slices(*text.buffers(b.column("text"))):
                s = m.scores(*features(data, off, stated[i:j], m.bits)) if m else np.full(j - i, 0.5)
                yield blocks.batch(schema, b.column("doc_id").slice(i, j - i), s)

    return run, "doc_id long, score double"


def score(docs: DataFrame, m: Machine | None) -> DataFrame:
    """(doc_id, score) of every row of docs: the probability of label 1, from the whole text and the n_chars that the row states, if it does.

    Null counts as an empty text; an empty text is scored by its statistics. Without a machine, since no label exists,
    every score is 0.5. Rows with null or repeated ids are scored like others.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), _stated(docs).alias("stated")).mapInArrow(*_score(m))


def _keep(m: Machine | None, cut: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stated, rows = blocks.column(b, b.schema.names[-1]).astype(np.float64), b.select(b.schema.names[:-1])
            parts = [m.scores(*features(data, off, stated[i:j], m.bits)) for i, j, data, off in text.slices(*text.buffers(b.column(at)))] if m else []
            yield rows.filter(pa.array(np.concatenate(parts) >= cut)) if parts else rows

    return run


def keep(docs: DataFrame, m: Machine | None, cut: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose score is cut or more; all rows without a machine."""
    return docs.withColumn("_stated_", _stated(docs)).mapInArrow(_keep(m, cut, docs.columns.index(text_col)), docs.schema)


def fold(modulus: int, rest: int) -> Column:
    """Whether doc_id is held out: crc32 of its decimal text leaves this remainder."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest


def classify(docs: DataFrame, labels: DataFrame, target: str, modulus: int, rest: int, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; a null doc_id is never held out.

    cut is the least score that predicts 1.
    """
    m = fit(docs, labels, target, ~fold(modulus, rest))
    return score(docs, m).select("doc_id", F.coalesce(fold(modulus, rest), F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
