"""Suffix-array dedup: maximal repeats of whole texts from the common-prefix interval trees of enhanced suffix arrays.

A suffix array over all bytes at once is neither small nor local, so texts are first cut into regions that can
be sorted apart. Of each 100-byte window the k-gram of least hash is its anchor: equal windows have equal anchors, so
everything that repeats meets at an anchor's hash. There, windows in stretches (all that share one anchor) that are
wholly equal are settled by their hashes; where stretches of one anchor differ, their bytes are fetched and
an enhanced suffix array of them is scanned with a stack for the intervals of its common-prefix tree. An interval whose
suffixes are preceded by different bytes is a maximal repeat, reported with all its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, text
from .graph import written

U64 = np.uint64
#: Bytes of an anchor.
GRAM = 32
#: Stretches that a map task gathers before it sends them on, and bytes in one suffix array, about.
FLUSH, ARRAY = 1_000_000, 1 << 20
#: Members of one stretch that a task joins, about.
HOT = 100_000


def stretches(data: np.ndarray, off: np.ndarray, least: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first, last, anchor, gram hash, stretch hash): the runs of windows of ``least`` bytes that share an anchor.

    first and last are the starts of a run's windows within the row, anchor is the place of the leftmost k-gram of
    least hash in each of them.
    """
    n = len(data)
    z = np.zeros(0, np.int64)
    if n < least:
        return z, z, z, z, np.zeros(0, U64), np.zeros(0, U64)
    c, inv = text.prefix(data)
    h = text.mix((c[gram:] - c[: n + 1 - gram]) * inv[: n + 1 - gram])
    many = least - gram + 1
    v, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span < many:
        step = min(span, many - span)
        left = v[:-step] <= v[step:]
        v, at = np.where(left, v[:-step], v[step:]), np.where(left, at[:-step], at[step:])
        span += step
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(at)]
    good = np.arange(len(at)) + least <= off[row + 1]
    at, row, p = at[good], row[good], np.flatnonzero(good)
    if not len(p):
        return z, z, z, z, np.zeros(0, U64), np.zeros(0, U64)
    new = np.ones(len(p), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    a, b = p[first], p[last]
    row, at = row[first], at[first].astype(np.int64)
    s = text.mix((c[b + least] - c[a]) * inv[a] + (b - a).astype(U64) * text.MUL[60])
    return row, a - off[row], b - off[row], at - off[row], h[at], s


FIELDS = (("gram", U64), ("hash", U64), ("doc", np.int64), ("first", np.int64), ("wide", np.uint8), ("back", np.uint8))
PARCEL = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def _pack(arrays: list[np.ndarray]) -> bytes:
    gram = arrays[0]  # 40 bits of it, after its bucket: that is for meeting alone, equality is for the stretch's own hash
    return np.int64(len(gram)).tobytes() + gram.astype(np.uint32).tobytes() + (gram >> U64(32)).astype(np.uint8).tobytes() + b"".join(np.ascontiguousarray(x, t).tobytes() for x, (_, t) in zip(arrays[1:], FIELDS[1:], strict=True))


def _unpack(blobs: list[pa.Buffer]) -> list[np.ndarray]:
    got: list[list[np.ndarray]] = [[] for _ in FIELDS]
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        got[0].append(np.frombuffer(blob, np.uint32, n, 8).astype(U64) | (np.frombuffer(blob, np.uint8, n, 8 + 4 * n).astype(U64) << U64(32)))
        pos = 8 + 5 * n
        for x, (_, t) in zip(got[1:], FIELDS[1:], strict=True):
            x.append(np.frombuffer(blob, t, n, pos))
            pos += n * np.dtype(t).itemsize
    return [np.concatenate(x) for x in got]


def _sorted(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns in order of gram, hash, document and place; whether a row repeats the one before; whether its gram does."""
    order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
    cols = [x[order] for x in cols]
    gram = np.concatenate([[False], cols[0][1:] == cols[0][:-1]])
    return cols, gram & np.concatenate([[False], cols[1][1:] == cols[1][:-1]]), gram


def _shared(same: np.ndarray) -> np.ndarray:
    """From whether each sorted row equals the one before it: whether it equals any other."""
    return same | np.append(same[1:], False) if len(same) else same


def _send(least: int, buckets: int, whole: bool):
    """Stretches to their grams' buckets. Of equal ones in a task's batch only the first is sent; the others' bytes are known to
    repeat. With whole, the first goes with the others too, so that none of the batch's members is missing there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            cols, same, _ = _sorted([np.concatenate(x) for x in zip(*held, strict=True)])
            rows = [(at, _pack(x)) for at, x in blocks.split(blocks.scatter(cols[0][~same], buckets), *(x[~same] for x in cols))]
            if same.any():
                gone = [x[_shared(same) if whole else same] for x in cols]
                rows.append((-1 - int(gone[0][0] % U64(1 << 20)), _pack(gone)))
            held, size = [], 0
            return blocks.batch(PARCEL, *(list(x) for x in zip(*rows, strict=True)))

        for b in batches:
            ids = blocks.column(b, "doc_id")
            for i, j, data, off in text.slices(*text.buffers(b.column(1))):
                row, a, z, at, g, s = stretches(data, off, least)
                held.append([g, s, ids[i:j][row], a, (z - a).astype(np.uint8), (at - a).astype(np.uint8)])
                size += len(row)
                if size >= FLUSH:
                    yield flush()
        if size:
            yield flush()

    return run, "bucket int, blob binary"


def _settle(least: int, whole: bool):
    """What hashes settle: spans that repeat, as kind 0, and the stretches whose bytes are needed, as kind 1. With whole,
    stretches that equal others come one by one as kind 2 in place of kind 0, and each has its hash."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("first", pa.int64()), ("wide", pa.int32()), ("back", pa.int32())])
    members = schema.append(pa.field("hash", pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (at,), rows in blocks.groups(batches, "bucket"):
            cols = _unpack([x.as_buffer() for x in rows.column("blob").combine_chunks()])
            if at < 0:
                same, apart = np.ones(len(cols[0]), bool), np.zeros(len(cols[0]), bool)
            else:
                cols, same, gram = _sorted(cols)
                head = np.flatnonzero(~gram)
                own = np.cumsum(~gram) - 1
                kinds = np.add.reduceat((~same).astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
                apart = ~same & (kinds[own] > 1)
            if whole:
                many = same if at < 0 else _shared(same)
                doc, first, wide, back, own = (np.concatenate([cols[c][apart], cols[c][many]]) for c in (2, 3, 4, 5, 1))
                yield blocks.batch(members, np.repeat(np.int32([1, 2]), [int(apart.sum()), int(many.sum())]), doc, first, wide.astype(np.int32), back.astype(np.int32), own.view(np.int64))
                continue
            # neighbouring spans of a document are joined
            d, a, e = cols[2][same], cols[3][same], cols[3][same] + cols[4][same] + least
            d, a, e = joined(d, a, e)
            n, m = len(d), int(apart.sum())
            doc, first, wide, back = (cols[c][apart] for c in (2, 3, 4, 5))
            yield blocks.batch(schema, np.repeat(np.int32([0, 1]), [n, m]), np.concatenate([d, doc]), np.concatenate([a, first]), np.concatenate([e - a, wide]).astype(np.int32), np.concatenate([np.zeros(n, np.int32), back]).astype(np.int32))

    return run, "kind int, doc_id long, first long, wide int, back int" + ", hash long" * whole


def joined(d: np.ndarray, a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans [a, e) of documents d, as maximal disjoint spans in order."""
    if not len(d):
        return d, a, e
    order = np.lexsort((a, d))
    d, a, e = d[order], a[order], e[order]
    # the furthest end so far within a document: ends are lifted by the document's rank so that one running maximum serves all
    rank = np.concatenate([[0], np.cumsum(d[1:] != d[:-1])]).astype(np.int64)
    lift = rank * (int(e.max()) + 1)
    far = np.maximum.accumulate(e + lift) - lift
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (a[1:] > far[:-1])
    head = np.flatnonzero(new)
    return d[head], a[head], far[np.append(head[1:], len(d)) - 1]


def suffix_array(data: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, lcp): starts of the suffixes of at least ``least`` bytes, each ending at end[i], in order, with the
    common prefix of each and the one before it, 0 for the first.

    Ranks of prefixes of 8, 16, ... bytes come from ranks of half the length; the same ranks, from the longest down, give the common prefixes.
    """
    n = len(data)
    pad = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U64)
    room = end - np.arange(n)
    word = np.zeros(n, U64)
    for j in range(8):
        word = (word << U64(8)) | np.where(room > j, pad[j : n + j], 0)
    # a suffix shorter than its word ranks apart from one that goes on with zero bytes
    short = np.minimum(room, 8).astype(np.int64)
    order = np.lexsort((short, word))
    new = np.ones(n, bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (short[order][1:] != short[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    levels, size, longest = [(8, rank)], 8, int(room.max(initial=0))
    while size < longest:
        nxt = np.zeros(n, np.int64)
        nxt[:-size or None] = rank[size:] if size < n else 0
        nxt[room <= size] = 0
        _, rank = np.unique(rank * (n + 2) + nxt, return_inverse=True)
        rank = rank + 1
        size *= 2
        levels.append((size, rank))
    at = np.flatnonzero(room >= least)
    sa = at[np.argsort(rank[at], kind="stable")]
    lcp = np.zeros(len(sa), np.int64)
    if len(sa) > 1:
        i, j = sa[:-1].copy(), sa[1:].copy()
        got, live = np.zeros(len(i), np.int64), np.ones(len(i), bool)
        for size, rank in reversed(levels):
            ok = live & (room[np.minimum(i, n - 1)] >= size) & (room[np.minimum(j, n - 1)] >= size) & (i < n) & (j < n)
            ok[ok] = rank[i[ok]] == rank[j[ok]]
            i, j, got = i + size * ok, j + size * ok, got + size * ok
        for _ in range(8):  # less than a word is left
            ok = live & (i < end[sa[:-1]]) & (j < end[sa[1:]])
            ok[ok] = data[i[ok]] == data[j[ok]]
            live &= ok
            i, j, got = i + ok, j + ok, got + ok
        lcp[1:] = got
    return sa, lcp


def intervals(sa: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, length) of the intervals of the suffix array that are maximal repeats of ``least`` bytes or more.

    One scan with a stack yields the interval tree bottom-up. before is the byte before each suffix, or a value of its own
    where there is none; an interval is left-maximal if these differ in it, which changes of neighbours, counted by a running sum, tell.
    """
    differs = np.concatenate([[0], np.cumsum(before[sa][1:] != before[sa][:-1])]) if len(sa) else np.zeros(0, np.int64)
    hot = np.flatnonzero(lcp >= least)
    if not len(hot):
        return
    for run in np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1):
        stack: list[list[int]] = []
        for k, depth in zip([*run.tolist(), int(run[-1]) + 1], [*lcp[run].tolist(), 0], strict=True):
            left = k - 1
            while stack and stack[-1][0] > depth:
                length, left = stack.pop()
                if differs[k - 1] > differs[left]:
                    yield left, k - 1, length
            if depth >= least and (not stack or stack[-1][0] < depth):
                stack.append([depth, left])


def maximal_repeats(pieces: list[bytes], starts: list[tuple[int, int]], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(document, start)]) of each maximal repeat within the pieces, with all its occurrences in order.

    starts gives each piece's document and place; a repeat is at least ``least`` bytes long and lies within pieces.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(x) for x in pieces])
    bound = np.concatenate([[0], np.cumsum(size)])
    own = np.repeat(np.arange(len(pieces)), size)
    end = bound[own + 1]
    sa, lcp = suffix_array(data, end, least)
    before = np.concatenate([[0], data[:-1]]).astype(np.int64)
    before[bound[:-1][size > 0]] = 256 + np.flatnonzero(size > 0)
    doc, place = np.array([x[0] for x in starts], np.int64), np.array([x[1] for x in starts], np.int64)
    for a, b, length in intervals(sa, lcp, before, least):
        at = sa[a : b + 1]
        yield length, sorted(set(zip(doc[own[at]].tolist(), (place[own[at]] + at - bound[own[at]]).tolist(), strict=True)))


def _bytes(least: int, gram: int = GRAM):
    """The bytes around each anchor that a window with it can reach, keyed twice: equal windows agree on half of what the gram
    leaves of them, on its right or on its left, so each side's hash is a key, and few differing stretches share one."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("piece", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = -(-(least - gram) // 2)
        for b in batches:
            lists = b.column("apart")
            many = np.diff(lists.offsets.to_numpy())
            first, wide, back = (lists.flatten().field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("first", "wide", "back"))
            upto = np.concatenate([[0], np.cumsum(many)])
            ids = blocks.column(b, "doc_id")
            for i, j, data, off in text.slices(*text.buffers(b.column("text"))):
                here = slice(upto[i], upto[j])
                row = np.repeat(np.arange(j - i), many[i:j])
                c, inv = text.prefix(data)
                raw, begin, end = data.tobytes(), off[row], off[row + 1]
                anchor = begin + first[here] + back[here]
                s, e = begin + first[here], begin + first[here] + wide[here] + least
                for side in (0, 1):
                    lo, hi = (anchor - half, anchor + gram) if side else (anchor, anchor + gram + half)
                    fits = np.flatnonzero((lo >= begin) & (hi <= end))
                    if len(fits):
                        key = text.mix((c[hi[fits]] - c[lo[fits]]) * inv[lo[fits]] + text.MUL[20 + side]).view(np.int64)
                        yield blocks.batch(schema, key, ids[i:j][row[fits]], first[here][fits], [raw[x:y] for x, y in zip(s[fits].tolist(), e[fits].tolist(), strict=True)])

    return run, "key long, doc_id long, start long, piece binary"


def _arrays(least: int, whole: bool):
    """Suffix arrays over the pieces of keys that several share: what repeats an earlier occurrence, or with whole where repeats lie in which stretches."""
    spans = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
    found = pa.schema([("string", pa.int64()), ("length", pa.int64()), ("hash", pa.int64()), ("at", pa.int64())])

    def links(pieces: list[bytes]) -> pa.RecordBatch:
        """Each repeat's own hash, and where it lies in which distinct stretches; those in one alone are the stretch itself."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        bound = np.cumsum([0, *map(len, pieces)])
        c, inv = text.prefix(data)
        of = lambda a, z: text.mix((c[z] - c[a]) * inv[a] + (z - a - least).astype(U64) * text.MUL[60]).view(np.int64)
        own = of(bound[:-1], bound[1:])
        rows = []
        for n, o in maximal_repeats(pieces, [(k, 0) for k in range(len(pieces))], least):
            places = {(int(own[k]), at) for k, at in o}
            if len(places) > 1:
                a = bound[o[0][0] : o[0][0] + 1] + o[0][1]
                rows += [(int(of(a, a + n)[0]), n, h, at) for h, at in places]
        return blocks.batch(found, *(list(x) for x in zip(*rows, strict=True))) if rows else blocks.batch(found, [], [], [], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[bytes] = []
        starts: list[tuple[int, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal pieces, starts, size
            if whole:
                out = links(pieces) if len(pieces) > 1 else None
                pieces, starts, size = [], [], 0
                if out:
                    yield out
                return
            rows = list(maximal_repeats(pieces, starts, least)) if len(pieces) > 1 else []
            pieces, starts, size = [], [], 0
            later = np.array([(d, s, s + n) for n, o in rows for d, s in o[1:]], np.int64).reshape(-1, 3)
            yield blocks.batch(spans, *joined(later[:, 0], later[:, 1], later[:, 2]))

        for _, rows in blocks.groups(batches, "key"):
            if rows.num_rows < 2:
                continue
            for d, s, x in zip(rows.column("doc_id").to_pylist(), rows.column("start").to_pylist(), rows.column("piece").to_pylist(), strict=True):
                pieces.append(x)
                starts.append((d, s))
                size += len(x)
            if size >= ARRAY:
                yield from flush()
        yield from flush()

    return run, "string long, length long, hash long, at long" if whole else "doc_id long, start long, stop long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans, and what was taken from them."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    for b in batches:
        data, off = text.buffers(b.column("text"))
        raw, out = data.tobytes(), []
        for k, spans in enumerate(b.column("spans").to_pylist()):
            s, e = int(off[k]), int(off[k + 1])
            if spans:
                x = np.array([(y["start"], y["stop"]) for y in spans], np.int64)
                _, a, z = joined(np.zeros(len(x), np.int64), x[:, 0], x[:, 1])
                edge = [0, *np.stack([a, z], axis=1).reshape(-1).tolist(), e - s]
                out.append((e - s, int((z - a).sum()), len(a), b"".join(raw[s + p : s + q] for p, q in zip(edge[::2], edge[1::2], strict=True))))
            else:
                out.append((e - s, 0, 0, raw[s:e]))
        if out:
            yield blocks.batch(schema, b.column("doc_id"), *(list(x) for x in zip(*out, strict=True)))


def _rows(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows, repeats): rows(doc_id, own, text) with doc_id a number of each row's own that keeps the order of ids; own is the id itself.

    Where ids are unique and not null they are these numbers already. Otherwise rows are numbered in order of id, null last,
    and of their text's hash; equal rows become one, and ``repeats`` (own, text, many) holds those that are more than one.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("own"), F.coalesce("text", F.lit("")).alias("text"))
    if base.groupBy("own").count().where("count > 1 or own is null").isEmpty():
        return base.select(F.col("own").alias("doc_id"), "own", "text"), None
    each = base.groupBy("own", F.xxhash64("text").alias("tie")).agg(F.any_value("text").alias("text"), F.count("*").alias("many"))
    # numbers grow with the partition and within it, and partitions are ranges of (own, tie)
    rows = written(each.orderBy(F.col("own").asc_nulls_last(), "tie").withColumn("doc_id", F.monotonically_increasing_id()).select("doc_id", "own", "text", "many"))
    return rows.drop("many"), rows.where("many > 1").select("own", "text", "many")


def _plan(known: DataFrame, least: int, whole: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts, buckets = blocks.spread(known)
    sent = blocks.together(known.select("doc_id", "text").mapInArrow(*_send(least, buckets, whole)), parts, "bucket")
    settled = written(sent.mapInArrow(*_settle(least, whole)))
    dealt = known.repartition(parts, "doc_id")  # for either join; Spark exchanges the texts for each
    apart = settled.where("kind = 1").groupBy("doc_id").agg(F.collect_list(F.struct("first", "wide", "back")).alias("apart"))
    pieces = dealt.select("doc_id", "text").join(apart, "doc_id").mapInArrow(*_bytes(least))
    return dealt, settled, blocks.together(pieces, parts, "key").mapInArrow(*_arrays(least, whole))


def occurrences(docs: DataFrame, least: int = 100) -> DataFrame:
    """(string, length, doc_id, start): every occurrence of each maximal repeat within regions, a row each; string is the repeat's hash.

    Suffix arrays tell where repeats lie in distinct stretches, and a stretch that several places hold is a repeat itself. All
    members of a stretch, copies too, are then joined to what is told of it; those of a hot one are salted. Rows that share an id, or
    have none, are told apart as in ``dedup``; equal rows of one id count as one.
    """
    rows, many = _rows(docs)
    _, settled, found = _plan(rows, least, True)
    equal = settled.where("kind = 2").groupBy("hash").agg(F.max("wide").alias("wide"), F.count("*").alias("n"))
    alike = equal.select(F.col("hash").alias("string"), (F.col("wide") + least).cast("long").alias("length"), "hash", F.lit(0).cast("long").alias("at"))
    hot = F.broadcast(written(equal.where(F.col("n") > HOT).select("hash", F.ceil(F.col("n") / HOT).cast("int").alias("salts"))))
    salts = F.coalesce("salts", F.lit(1))
    members = settled.select("hash", "doc_id", "first").join(hot, "hash", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "first"), salts)).drop("salts")
    links = found.unionByName(alike).distinct().join(hot, "hash", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), (salts - 1).cast("long")))).drop("salts")
    out = links.join(members, ["hash", "salt"]).select("string", "length", "doc_id", (F.col("first") + F.col("at")).alias("start")).distinct()
    return out if many is None else out.join(rows.select("doc_id", "own"), "doc_id").select("string", "length", F.col("own").alias("doc_id"), "start")


def groups(docs: DataFrame, least: int = 100) -> DataFrame:
    """(length, doc_ids, starts): the maximal repeats within regions, each with all its occurrences in order of document and place.

    A group is one row, however large; ``occurrences`` has the same as a row for each, and the same rules for null and repeated ids and null texts.
    """
    at = F.array_sort(F.collect_list(F.struct("doc_id", "start")))
    return occurrences(docs, least).groupBy("string", "length").agg(at.alias("at")).select("length", F.col("at.doc_id").alias("doc_ids"), F.col("at.start").alias("starts"))


def dedup(docs: DataFrame, least: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row of docs(doc_id, text): the text's UTF-8 bytes
    without each byte covered by a string of ``least`` bytes that also starts earlier, in a smaller doc_id or before it in the same text.

    Overlaps count, strings are those of the input, and matches never cross texts. A null text is empty. Null ids come after all others;
    rows that share an id follow the hash of their texts, and of equal rows one comes first and stays, whatever their number. Equal hashes
    of 64 bits are taken for equal stretches. docs must be deterministic.
    """
    rows, repeats = _rows(docs)
    dealt, settled, found = _plan(rows, least, False)
    spans = settled.where("kind = 0").select("doc_id", F.col("first").alias("start"), (F.col("first") + F.col("wide")).alias("stop")).unionByName(found)
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    cut = dealt.join(listed, "doc_id", "left").select(F.col("own").alias("doc_id"), "text", "spans")
    if repeats is not None:
        # the others of equal rows: all of a text that has a string to repeat goes
        whole = F.when(F.octet_length("text") >= least, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length("text").cast("long").alias("stop"))))
        cut = cut.unionByName(repeats.select(F.col("own").alias("doc_id"), "text", whole.alias("spans"), F.explode(F.sequence(F.lit(2).cast("long"), "many"))).drop("col"))
    return cut.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, least: int = 100) -> DataFrame:
    """dedup with the kept bytes' SHA-256 in their place; the same rows and edge cases."""
    return dedup(docs, least).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
