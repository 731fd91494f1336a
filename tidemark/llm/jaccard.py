"""N-gram Jaccard join: classes of documents linked by shingle overlap, found exactly.

The document-by-shingle incidence is multiplied in blocks. Three things keep the product small
without losing a link: (1) documents with equal shingle sets collapse into one row; (2) a size-derived
bound discards documents too few of whose shingles occur elsewhere; (3) the rest are split into groups
that share a shingle among their smallest ones, in chains of compatible sizes. Each group is then one block of
the product, or, if large, blocks by bands of size of which only neighbours are multiplied. A block accumulates overlap counts,
of sizes that allow a link alone, and yields a spanning forest of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, text
from .graph import Forest, checkpoint, components

U64 = np.uint64
#: Tokens that a map task gathers before it sends them on.
FLUSH = 1_500_000
#: Documents in a side of a block of the product.
BLOCK = 2048


def _signature(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in text.slices(*text.buffers(b.column(1))):
                g, bound = text.shingle_sets(data, off, k)
                sums = []
                for salt in (3, 5):
                    c = np.concatenate([np.zeros(1, U64), np.cumsum(text.mix(g * text.MUL[salt]))])
                    sums.append((c[bound[1:]] - c[bound[:-1]]).view(np.int64))
                yield blocks.batch(schema, b.column(0).slice(i, j - i), np.diff(bound), *sums)

    return run, "doc_id long, n_shingles long, s1 long, s2 long"


def _need(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap that a set of n can have with one it links to: ceil(n * num / den)."""
    return -(-n * num // den)


PARCEL = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])
PARCEL_DDL = "chunk long, bucket int, blob binary"


class _Parcels:
    """Gathers documents with their tokens, and sends each token's low half and owner to its bucket. A chunk's own
    table, ids and a number for each document, has a bucket below zero."""

    def __init__(self, buckets: int):
        self.buckets, self.chunk, self.held, self.size = buckets, TaskContext.get().partitionId() << 32, [], 0

    def add(self, ids: np.ndarray, number: np.ndarray, tok: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((ids, number, tok, own))
        self.size += len(tok)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        ids, number, tok = (np.concatenate([x[c] for x in self.held]) for c in range(3))
        start = np.cumsum([0, *(len(x[0]) for x in self.held[:-1])])
        own = np.concatenate([x[3] + s for x, s in zip(self.held, start, strict=True)]).astype(np.uint32)
        rows = [(self.chunk, -1 - self.chunk % 100003, ids.tobytes() + number.astype(np.int32).tobytes())]
        for at, (t, o) in blocks.split(blocks.scatter(tok, self.buckets), (tok & U64(0xFFFFFFFF)).astype(np.uint32), own):
            rows.append((self.chunk, at, t.tobytes() + o.tobytes()))
        self.chunk, self.held, self.size = self.chunk + 1, [], 0
        yield blocks.batch(PARCEL, *(list(x) for x in zip(*rows, strict=True)))


def _send(k: int, num: int, den: int, buckets: int):
    """Each set's first shingles in hash order, to the buckets of their hashes. Two sets that link share l of them if
    each side sends l more than it can lack; l grows with the size, so the least that must recur comes from the
    smallest set that can link: hence the two calls of _need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Parcels(buckets)
        for b in batches:
            ids = blocks.column(b, "doc_id")
            for i, j, data, off in text.slices(*text.buffers(b.column(1))):
                g, bound = text.shingle_sets(data, off, k)
                n = np.diff(bound)
                m = np.minimum(n, 2 * (n - _need(n, num, den)) + 1)
                own = np.repeat(np.arange(j - i), n)
                first = np.arange(len(g)) - bound[own] < m[own]
                small = _need(n, num, den)
                yield from out.add(ids[i:j], small - _need(small, num, den) + 1, g[first], own[first])
        yield from out.flush()

    return run, PARCEL_DDL


def _send_all(buckets: int):
    """All shingles of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Parcels(buckets)
        for b in batches:
            n = blocks.column(b, "n").astype(np.int64)
            data, _ = text.buffers(b.column("tokens"))
            yield from out.add(blocks.column(b, "doc_id"), n, np.frombuffer(data.tobytes(), U64), np.repeat(np.arange(len(n)), n))
        yield from out.flush()

    return run, PARCEL_DDL


def _recur(counts: bool):
    """What recurs in each bucket, sent back to each chunk: a count for each document, or else (owner, token, frequency)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (at,), rows in blocks.groups(batches, "bucket"):
            blob, chunk = [x.as_buffer() for x in rows.column("blob").combine_chunks()], blocks.column(rows, "chunk")
            if at < 0:
                yield blocks.batch(PARCEL, chunk, [at] * len(chunk), rows.column("blob").combine_chunks())
                continue
            sizes = [x.size // 8 for x in blob]
            tok = np.concatenate([np.frombuffer(x, np.uint32, n) for x, n in zip(blob, sizes, strict=True)])
            order = np.argsort(tok)
            length = np.diff(text.runs(tok[order]))
            df = np.empty(len(tok), np.uint32)
            df[order] = np.repeat(length, length)
            out, pos = [], 0
            for x, n in zip(blob, sizes, strict=True):
                more = df[pos : pos + n] > 1
                own = np.frombuffer(x, np.uint32, n, n * 4)[more]
                out.append(np.bincount(own).astype(np.uint32).tobytes() if counts else own.tobytes() + tok[pos : pos + n][more].tobytes() + df[pos : pos + n][more].tobytes())
                pos += n
            yield blocks.batch(PARCEL, chunk, [at] * len(chunk), out)

    return run, PARCEL_DDL


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, pa.Buffer]]]]:
    """(ids, numbers, [(bucket, reply)]) of each chunk."""
    for _, rows in blocks.groups(batches, "chunk"):
        got = list(zip(blocks.column(rows, "bucket").tolist(), (x.as_buffer() for x in rows.column("blob").combine_chunks()), strict=True))
        table = next(x for at, x in got if at < 0)
        n = table.size // 12
        yield np.frombuffer(table, np.int64, n), np.frombuffer(table, np.int32, n, 8 * n).astype(np.int64), [x for x in got if x[0] >= 0]


def _enough():
    """The documents of each chunk with as many recurring shingles as its table asks for."""
    schema = pa.schema([("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, need, replies in _chunks(batches):
            got = np.zeros(len(ids), np.int64)
            for _, x in replies:
                c = np.frombuffer(x, np.uint32)
                got[: len(c)] += c
            yield blocks.batch(schema, np.unique(ids[got >= need]))

    return run, "doc_id long"


def _full(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in text.slices(*text.buffers(b.column(1))):
                g, bound = text.shingle_sets(data, off, k)
                blobs = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((bound * 8).astype(np.int32).tobytes()), pa.py_buffer(g.tobytes())])
                yield blocks.batch(schema, b.column(0).slice(i, j - i), np.diff(bound).astype(np.int32), blobs)

    return run, "doc_id long, n int, tokens binary"


def _heads(num: int, den: int, buckets: int):
    """The rarest shingles of each set, as many as it can lack of a set it links to, plus one: a link shares one of them.
    Those that occur once come first and need not be sent; a set that has too many of them links with nothing."""
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n, replies in _chunks(batches):
            if not replies:
                continue
            sizes = [x.size // 12 for _, x in replies]
            own, low, df = (np.concatenate([np.frombuffer(x, np.uint32, m, 4 * m * p) for (_, x), m in zip(replies, sizes, strict=True)]).astype(np.int64) for p in range(3))
            tok = low.astype(U64) | (np.repeat([at for at, _ in replies], sizes).astype(U64) << U64(32))
            order = np.lexsort((tok, df, own))
            own, tok = own[order], tok[order]
            got = np.bincount(own, minlength=len(ids))
            rank = np.arange(len(own)) - (np.cumsum(got) - got)[own]
            first = rank < (got - _need(n, num, den) + 1)[own]
            own, tok = own[first], tok[first]
            rows = [(at, t.tobytes() + i.tobytes() + s.tobytes()) for at, (t, i, s) in blocks.split(blocks.scatter(text.mix(tok), buckets), tok, ids[own], n[own])]
            if rows:
                yield blocks.batch(schema, *(list(x) for x in zip(*rows, strict=True)))

    return run, "bucket int, blob binary"


def _chains(num: int, den: int):
    """Neighbours by size among the documents of each shingle, where sizes allow a link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in blocks.groups(batches, "bucket"):
            blob = [x.as_buffer() for x in rows.column("blob").combine_chunks()]
            sizes = [x.size // 24 for x in blob]
            tok, ids, ns = (np.concatenate([np.frombuffer(x, t, n, 8 * n * p) for x, n in zip(blob, sizes, strict=True)]) for p, t in enumerate((U64, np.int64, np.int64)))
            order = np.lexsort((ids, ns, tok))
            tok, ids, ns = tok[order], ids[order], ns[order]
            near = (tok[1:] == tok[:-1]) & (ns[:-1] * den >= ns[1:] * num) & (ids[1:] != ids[:-1])
            a, b = ids[:-1][near], ids[1:][near]
            if len(a):
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield blocks.batch(schema, pair[0], pair[1])

    return run, "a long, b long"


def product(ids: np.ndarray, ns: np.ndarray, tokens: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links between rows of one block, or of two if side tells them apart, as a spanning forest: [(id, id)]."""
    order = np.argsort(ns, kind="stable")
    ids, ns, side, tokens = ids[order], ns[order], side[order], [tokens[i] for i in order.tolist()]
    two = bool((side != side[0]).any())
    flat, own = np.concatenate(tokens), np.repeat(np.arange(len(ids)), ns)
    by = np.argsort(flat, kind="stable")
    cut = text.runs(flat[by])
    length = np.diff(cut)
    col = np.empty(len(flat), np.int64)
    col[by] = np.repeat(np.arange(len(length)), length)
    rows = own[by]
    bound = np.concatenate([[0], np.cumsum(ns)])
    # positions of a document's own entries in the columns' lists: what follows them are the larger documents
    place = np.empty(len(flat), np.int64)
    place[by] = np.arange(len(flat))
    # a larger set can link to x up to this size: the rows from upto on are discarded before they are counted
    upto = np.searchsorted(ns, ns * den // num, side="right")
    entry = col[by] * (len(ids) + 1) + rows
    forest, out = Forest(len(ids)), []
    for x in range(len(ids) - 1):
        if upto[x] <= x + 1:
            continue
        mine = slice(bound[x], bound[x + 1])
        start, stop = place[mine] + 1, np.searchsorted(entry, col[mine] * (len(ids) + 1) + upto[x])
        more = stop - start
        total = int(more.sum())
        if not total:
            continue
        at = np.repeat(start - (np.cumsum(more) - more), more) + np.arange(total)
        got = rows[at]
        count = np.bincount(got - x, minlength=1)
        y = np.flatnonzero(count)
        o = count[y]
        y = y + x
        ok = den * o >= num * (ns[x] + ns[y] - o)
        if two:
            ok &= side[y] != side[x]
        for z in y[ok].tolist():
            if ids[x] != ids[z] and forest.join(x, z):
                out.append((int(ids[x]), int(ids[z])))
    return out


def _multiply(num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for (_, lo, hi), rows in blocks.groups(batches, "component", "lo", "hi"):
            side = blocks.column(rows, "block")
            if len(side) < 2 or (lo != hi and (side == side[0]).all()):
                continue
            tokens = [np.frombuffer(x.as_buffer(), U64) for x in rows.column("tokens").combine_chunks()]
            for x, y in product(blocks.column(rows, "doc_id"), blocks.column(rows, "n").astype(np.int64), tokens, side, num, den):
                a.append(x)
                b.append(y)
        yield blocks.batch(schema, a, b)

    return run, "a long, b long"


def _cells(near: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """(doc_id, component, block, lo, hi): the cells of the product that each document of a group belongs to.

    A group of up to BLOCK documents is one cell. A larger one is cut into bands, each as wide as sizes of linked sets can be
    apart, and bands into blocks of about BLOCK: cells are the pairs of blocks of one band or of two neighbours.
    """
    wide = float(np.log(den / num)) * 1.0001  # a little more, so that rounding never parts a link by two bands
    sizes = full.groupBy("doc_id").agg(F.array_distinct(F.collect_list("n")).alias("ns"))
    count = near.groupBy("component").agg((F.count("*") > BLOCK).alias("large"))
    member = near.select(F.col("id").alias("doc_id"), "component").join(count, "component").join(sizes, "doc_id").withColumn("n", F.explode("ns"))
    member = checkpoint(member.select("doc_id", "component", F.when(F.col("large"), F.floor(F.log("n") / F.lit(wide))).otherwise(F.lit(0)).cast("int").alias("band")).distinct())
    bands = member.groupBy("component", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("many"))
    # sizes grow by a third from band to band: a hundred bands hold any text
    bands = bands.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("band", "many"))).alias("many"))
    key = lambda band, at: band.cast("long") * (1 << 32) + at
    cells = member.join(bands, "component").withColumn("block", key(F.col("band"), F.pmod(F.xxhash64("doc_id"), F.element_at("many", F.col("band")))))
    others = F.expr("flatten(transform(array(band - 1, band, band + 1), b -> transform(slice(sequence(0, coalesce(try_element_at(many, b), 1) - 1), 1, coalesce(try_element_at(many, b), 0)), k -> cast(b as bigint) * 4294967296 + k)))")
    cells = cells.withColumn("other", F.explode(others))
    return cells.select("doc_id", "component", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    Two documents link when den * |A & B| >= num * |A | B| for their sets A, B of distinct k-word shingles;
    component_id is the smallest id reachable by links. Null or blank texts have empty sets and link with
    nothing; texts of fewer than k words have their whole sequence as one shingle. Rows that share an id are
    one node of the graph; a row with a null id keeps its size and has a null component. Other columns of docs
    are not read. docs must be a deterministic scan, since a lost task runs again.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts, buckets = blocks.spread(base)
    sig = checkpoint(base.mapInArrow(*_signature(k)))
    some = sig.where("doc_id is not null and n_shingles > 0")
    same = some.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    ids = base.where("doc_id is not null")
    sent = blocks.together(ids.mapInArrow(*_send(k, num, den, buckets)), parts, "bucket")
    hits = blocks.together(sent.mapInArrow(*_recur(True)), parts, "chunk").mapInArrow(*_enough())
    left = checkpoint(hits.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").distinct())
    full = checkpoint(ids.join(blocks.small(left), "doc_id").mapInArrow(*_full(k)).where("n > 0"))
    sent = blocks.together(full.mapInArrow(*_send_all(buckets)), parts, "bucket")
    heads = blocks.together(sent.mapInArrow(*_recur(False)), parts, "chunk").mapInArrow(*_heads(num, den, buckets))
    chains = blocks.together(heads, parts, "bucket").mapInArrow(*_chains(num, den))
    near = components(chains)
    links = blocks.together(full.join(_cells(near, full, num, den), "doc_id"), parts, "component", "lo", "hi").mapInArrow(*_multiply(num, den))
    linked = sig.join(same, ["n_shingles", "s1", "s2"])
    edges = links.unionByName(linked.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = components(edges)
    return sig.join(found.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
