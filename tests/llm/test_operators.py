"""The ten operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, embeddings, fm, jaccard, lm, mixing, pii, repeats, text, urls

SF = "/root/testdata"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    raw = (text or "").encode()
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in raw))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def corpus(seed=3, n=120):
    """Invented documents with exact and near copies, shared passages, and edge cases."""
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefgh", k=r.randint(1, 7))) for _ in range(400)]
    passage = " ".join(r.choices(vocab, k=60))
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.15:
            text = r.choice(rows)[1]
        elif rows and kind < 0.45:
            w = (r.choice(rows)[1] or "x").split(" ")
            for _ in range(max(1, len(w) // 40)):
                w[r.randrange(len(w))] = r.choice(vocab)
            text = " ".join(w)
        else:
            text = " ".join(r.choices(vocab, k=r.choice([3, 5, 8, 40, 200])))
            if r.random() < 0.3:
                text += "\n" + passage
        rows.append((i, text, "en", r.choice(["a", "b", None]), len(text)))
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0), (502, " \t\n", "en", "a", 3), (503, "One Two", "en", "b", 7), (504, "one two", "en", "b", 7), (505, "Ünïcode É é 中文 word word word word", None, "ß", 5), (506, "word " * 20000, "en", "c", 1), (507, "a", "en", "a", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "target", "copies", "spans", "bucket", "component", "chunk", "kind", "rep", "n_shingles", "many"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def components(nodes, linked):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


@pytest.mark.parametrize("block", [2048, 3])
def test_jaccard(docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    s = {r[0]: shingles(r[1]) for r in corpus()}
    linked = [(a, b) for a in s for b in s if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    want = components(s, linked)
    got = {r.doc_id: r for r in jaccard.classes(docs).collect()}
    assert {k: (v.n_shingles, v.component_id) for k, v in got.items()} == {k: (len(s[k]), want[k]) for k in s}
    assert len(set(want.values())) < len(want)


def test_jaccard_null_and_repeated_ids(spark, empty):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(None, t), (1, t), (1, "x y z u v w"), (2, "x y z u v w"), (3, t), (3, t)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(df).collect()), key=str)
    assert got == sorted([(None, 4, None), (1, 4, 1), (1, 2, 1), (2, 2, 1), (3, 4, 1), (3, 4, 1)], key=str)
    assert jaccard.classes(empty).count() == 0


@pytest.mark.parametrize("limit", [1 << 25, 100])
def test_decontaminate(spark, docs, empty, limit):
    items = [(i, t) for i, (_, t, *_) in enumerate(corpus(3, 12)) if t] + [(90, None), (91, ""), (92, "one two"), (93, "word WORD word word"), (94, "é é 中文"), (95, "É 中文 word"), (96, "one"), (None, "a b c d e f")]
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want, grams = set(), {(d, m): set(zip(*(words(x)[k:] for k in range(m)), strict=False)) for d, x, *_ in corpus() for m in (3, 4)}
    for i, t in items:
        if i is not None and shingles(t):
            q, w = shingles(t), words(t)
            for d, x, *_ in corpus():
                n = len(q & shingles(x))
                if len(w) in (3, 4):  # the item's words in a row, wherever they stand
                    n = int(tuple(w) in grams[d, len(w)])
                if 100 * n >= 75 * len(q):
                    want.add((d, i, n, len(q)))
    assert {93, 92} <= {i for _, i, *_ in want}
    assert {tuple(r) for r in decontaminate.matches(docs, df, pass_bytes=limit).collect()} == want
    kept = {r.doc_id for r in decontaminate.clean(docs, df).collect()}
    assert kept == {r[0] for r in corpus()} - {w[0] for w in want}
    assert decontaminate.matches(empty, df).count() == 0 and decontaminate.matches(docs, df.limit(0)).count() == 0
    assert decontaminate.clean(docs, df).columns == docs.columns


@pytest.mark.parametrize("limit", [1 << 25, 1])
def test_clean_by_row(spark, limit):
    """Each row stands by its own text, whatever its id: null and repeated ids, one of each contaminated; items in one, and in three passes."""
    items = spark.createDataFrame([(i, f"item {i} one two three four five six") for i in range(3)], "item_id long, text string")
    rows = [(None, "so item 0 one two three four five six it is", "a"), (None, "a clean text", "b"), (None, None, "c"), (7, "item 2 one two three four five six", "d"), (7, "another clean text of that id", "e"), (8, "item 1 one two three four five six", "f"), (9, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    how = {} if limit > 1 else {"pass_bytes": limit}
    got = decontaminate.clean(docs, items, **how).collect()
    assert sorted(r.source for r in got) == ["b", "c", "e", "g"] and {tuple(r) for r in got} <= set(rows)


def vectors():
    r = np.random.default_rng(5)
    rows = []
    for i in range(150):
        if i > 10 and r.random() < 0.4:
            base = rows[r.integers(0, i)][1]
            v = (np.array(base, np.float32) + r.normal(0, r.choice([0, 0.01, 0.15]), len(base))).astype(np.float32) * np.float32(r.choice([1, 3]))
        else:
            v = r.normal(0, 1, 8).astype(np.float32)
        rows.append((i, [float(x) for x in v], int(r.integers(0, 2))))
    ok = rows[0][1]
    return rows + [(200, None, 1), (201, [], 1), (202, [0.0] * 8, 1), (203, [*ok[:7], None], 0), (204, [*ok[:7], float("nan")], 0), (205, [*ok[:7], float("inf")], 0), (206, ok, None), (207, ok[:7], 0), (208, ok, rows[0][2]), (208, ok, rows[0][2]), (None, ok, 0)]


@pytest.mark.parametrize("block", [4096, 7])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    # ids that several vectors share: orthogonal ones, one of them close to another id's, and equal rows
    rows = vectors() + [(300, [1.0, 0.0] + [0.0] * 6, 1), (300, [0.0, 1.0] + [0.0] * 6, 1), (301, [1.0, 0.01] + [0.0] * 6, 1), (302, [0.0] * 7 + [1.0], 0), (302, [0.0] * 7 + [1.0], 0), (302, [0.0] * 6 + [1.0, 0.0], 0), (None, [0.0] * 7 + [1.0], 0)]
    ok = [i is not None and v is not None and lab is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    cos = lambda a, b: float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))
    n, linked = Counter(), []
    for x, (i, v, lab) in enumerate(rows):
        for y, (j, w, other) in enumerate(rows):
            if x < y and ok[x] and ok[y] and lab == other and len(v) == len(w) and cos(np.array(v), np.array(w)) >= 0.98:
                n[x] += 1
                n[y] += 1
                linked.append((i, j))
    comp = components({r[0] for r in rows if r[0] is not None}, linked)
    want = sorted(((i, n[x], comp.get(i), None if i is None else comp[i] == i) for x, (i, *_) in enumerate(rows)), key=str)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash"))
    assert sorted((tuple(r) for r in embeddings.classes(df).collect()), key=str) == want
    assert embeddings.classes(df.limit(0)).count() == 0


def test_quantised_bounds(monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (90, 12)) * 10.0 ** r.integers(-30, 30, (90, 1))
    x[40:60] = x[:20] * (1 + r.normal(0, 0.05, (20, 12)))
    u = x / np.abs(x).max(1)[:, None]
    u = u / np.sqrt((u * u).sum(1))[:, None]
    for low in (0.9, 0.98):
        want = {(i, j) for i in range(90) for j in range(i + 1, 90) if u[i] @ u[j] >= low}
        assert {(int(min(a, b)), int(max(a, b))) for p, q in embeddings.links(x, np.zeros(90), low) for a, b in zip(p, q, strict=True)} == want and want


def test_classifiers(spark, docs, empty):
    d, labels = spark.read.parquet(f"{SF}/sf0.1/documents.parquet"), spark.read.parquet(f"{SF}/sf0.1/labels.parquet")
    truth = {r.doc_id: r for r in labels.collect()}
    for target, mod, rest, least, recall in (("quality", 5, 0, 0.98, 0.99), ("toxic", 4, 2, 0.98, 0.9)):
        out = fm.classify(d, labels, target, mod, rest).collect()
        assert len(out) == d.count()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
        held = [(r.predicted, truth[r.doc_id][target]) for r in out if r.held_out and r.doc_id in truth]
        assert np.mean([p == y for p, y in held]) >= least and np.mean([p for p, y in held if y]) >= recall
    m = fm.fit(d, labels, "quality", ~fm.fold(5, 0), sample=500)
    got = fm.score(docs, m).collect()
    assert len(got) == len(corpus()) and all(0 <= r.score <= 1 for r in got)
    assert fm.score(empty, m).count() == 0
    assert fm.fit(d, labels.limit(0), "quality", F.lit(True)) is None and {r.score for r in fm.score(docs, None).collect()} == {0.5}
    assert fm.keep(docs, m, 0.0).count() == len(corpus()) and fm.keep(docs, m, 1.1).count() == 0 and fm.keep(docs, m, 0.3).columns == docs.columns
    scores = sorted((r.doc_id, r.score) for r in got)
    assert sorted(r.doc_id for r in fm.keep(docs, m, 0.3).collect()) == [i for i, x in scores if x >= 0.3]
    assert fm.fit(d, labels, "quality", F.lit(True), sample=500, most=1000).loss != m.loss  # terms are bounded too


def planted(n, seed):
    """Documents that are 1 if and only if they hold alpha with gamma or beta with delta: no word tells anything by itself."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = r.randint(0, 1), r.randint(0, 1)
        w = [f"w{r.randint(0, 300)}" for _ in range(25)] + [("alpha", "beta")[a], ("gamma", "delta")[b]]
        r.shuffle(w)
        rows.append((i, " ".join(w), int(a == b)))
    return rows


def test_pairs_are_learnt(spark):
    """What only pairs of words tell is learnt, and is lost without the words' vectors; an id that many rows share counts once."""
    rows = planted(2000, 4)
    docs, labels = spark.createDataFrame([r[:2] for r in rows] + [(7, rows[7][1])] * 50, "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows if i < 1500], "doc_id long, toxic int")
    m = fm.fit(docs, labels, "toxic", F.lit(True))
    got = {r.doc_id: r.score for r in fm.score(docs, m).collect()}
    right = lambda s: np.mean([(s[i] >= 0.5) == y for i, _, y in rows[1500:]])
    assert right(got) >= 0.97
    m.v[:] = 0
    assert right({r.doc_id: r.score for r in fm.score(docs, m).collect()}) <= 0.65
    assert fm.fit(docs.dropDuplicates(), labels.unionByName(labels), "toxic", F.lit(True)).loss == m.loss


def test_stems():
    """A stem hashes like a word of its bytes, inflected forms of a word share it, and punctuation around a word does not count."""
    data, off = text.buffers(pa.array(["Lower lower, lowest low", "lowe"]))
    h, _, start, end = text.words(data, off)
    stem = text.starts(data, start, end, 4)
    assert len(set(stem[[0, 1, 2, 4]].tolist())) == 1 and stem[4] == h[4] and stem[3] == h[3] and len(set(h.tolist())) == 5
    data, off = text.buffers(pa.array(["(idiot!!) ... $$$", "Idiot", "", "é*"]))
    idx, bound, stats = fm.features(data, off, np.array([1.0, np.nan, np.inf, 3.0]), 18)
    assert bound.tolist() == [0, 2, 4, 4, 5] and idx[:2].tolist() == idx[2:4].tolist() and stats[:, -1].tolist() == [0, 1, 1, 0]


def test_machine_is_linear_time_form():
    """The sum-of-squares identity against the sum over pairs."""
    r = np.random.default_rng(2)
    n = fm.FORM + fm.META
    m = fm.Machine(4, 0.3, np.array([1, 5, 9, 11], np.uint32), r.normal(0, 1, 4).astype(np.float32), r.normal(0, 1, (4, 3)).astype(np.float32), r.normal(0, 1, n), r.normal(0, 1, (n, 3)))
    idx, stats = np.array([1, 3, 5, 9]), r.random((1, n)).astype(np.float32)
    x = np.concatenate([np.full(3, 4**-fm.DAMP), stats[0]])  # index 3 has no weights
    w, v = np.concatenate([m.w[:3], m.stat_w]), np.concatenate([m.v[:3], m.stat_v])
    z = 0.3 + m.w[:3].sum() + stats[0] @ m.stat_w + sum(float(v[i] @ v[j]) * x[i] * x[j] for i in range(len(w)) for j in range(i + 1, len(w)))
    assert abs(m.scores(idx, np.array([0, 4]), stats)[0] - 1 / (1 + np.exp(-z))) < 1e-5
    again = fm.Machine.load(m.dump())
    assert again.scores(idx, np.array([0, 4]), stats) == m.scores(idx, np.array([0, 4]), stats)


def test_urls(spark):
    cases = [("http://a.Example.COM/en/75", "example.com/en/7", "allow"), ("http://example.com/en/8", "com/en/", "block"), ("https://x.net/de/8", "net/de/", "allow"), ("https://example.net/de/81?q", "example.net/de/8", "block"), ("http://casino.net/de/", "net/de/", "allow"), ("ftp://notcom/en/1", None, "allow"), ("http://b.org/es/#x", "org/es/", "block"),
             ("http://b.org/ES/", None, "allow"), ("http://cheap-pills.example.org/x", None, "block"), ("http://spamless.org/", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("no scheme.com/en/", None, "allow"), ("http://", None, "allow"), ("a://B.com/en/?x://y", "com/en/", "block"), ("http://com:80/en/", None, "allow")]
    df = spark.createDataFrame([(i, u, "clash") for i, (u, *_) in enumerate(cases)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(len(cases))] == [c[1:] for c in cases]
    assert (got[0].host, got[0].path) == ("a.example.com", "/en/75") and (got[10].host, got[10].path) == ("", "")
    assert urls.judge(df.limit(0)).count() == 0


def test_lm(docs, empty):
    rows = [(r[0], words(r[1])) for r in corpus()]
    c1, c2 = Counter(x for _, w in rows for x in w), Counter(p for _, w in rows for p in zip(w, w[1:], strict=False))
    total, want = sum(c1.values()), {}
    for i, w in rows:
        o1, o2, s = Counter(w), Counter(zip(w, w[1:], strict=False)), 0.0
        for k, v in enumerate(w):
            pair = (w[k - 1], v) if k else None
            if pair and c2[pair] - o2[pair] > 0:
                s += math.log((c2[pair] - o2[pair]) / (c1[w[k - 1]] - o1[w[k - 1]]))
            else:
                n = c1[v] - o1[v]
                s += math.log((0.4 if k else 1) * max(n, 1) / (total - len(w) + (n == 0)))
        want[i] = (len(w), s)
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    assert got.keys() == want.keys()
    assert all(got[k].n_words == n and abs(got[k].log_score - s) < 1e-6 * max(1, abs(s)) for k, (n, s) in want.items())
    assert got[500].perplexity is None and lm.score(empty).count() == 0


@pytest.mark.parametrize("run", [50_000, 2])
def test_mixing(spark, docs, empty, monkeypatch, run):
    monkeypatch.setattr(mixing, "RUN", run)
    rows = mixing.copies(docs).collect()
    size = {r[0]: len(words(r[1])) for r in corpus()}
    whole = defaultdict(int)
    for i, _, _, s, _ in corpus():
        whole[s] += size[i]
    order = sorted(whole, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, goal = set(), {}
    while True:  # hand out, cap, and hand out again
        left = 1.5 * sum(whole.values()) - sum(2 * whole[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        goal = {s: 2 * whole[s] if s in full else left * weight[s] / open_ for s in order}
        over = {s for s in order if s not in full and goal[s] > 2 * whole[s]}
        if not over:
            break
        full |= over
    taken = defaultdict(int)
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == whole[r.source] and abs(r.target - goal[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    assert len(rows) == len(size)
    assert all(abs(taken[s] - goal[s]) <= 3 * max(size[i] for i, _, _, x, _ in corpus() if x == s) for s in order)
    assert sorted((r.doc_id, r.taken) for r in mixing.copies(docs.repartition(7)).collect()) == sorted((r.doc_id, r.taken) for r in rows)
    assert mixing.mix(docs).count() == sum(r.copies for r in rows) and mixing.copies(empty).count() == 0


@pytest.mark.parametrize("run", [50_000, 7, 2])
def test_mixing_order(spark, monkeypatch, run):
    """Runs of any size take the documents that the order of the SQL, by size and doc_id, takes."""
    monkeypatch.setattr(mixing, "RUN", run)
    r = random.Random(5)
    ids = [*r.sample(range(1 << 40), 60), *r.sample(range(-50, 50), 60), None]
    rows = [(i, f"{s} " * r.choice([3, 3, 3, 4]), s) for i, s in zip(ids, r.choices(["a", "b", "c", None], k=len(ids)), strict=True)]
    rows += [(i, "one", "d") for i in (4, 4, 4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(docs).collect()
    assert len(got) == len(rows)
    for s in ("a", "b", "c", "d", None):
        mine = sorted((x for x in got if x.source == s), key=lambda x: (x.size, x.doc_id is None, x.doc_id or 0))
        rate, offset = mine[0].target / mine[0].source_size, int(hashlib.md5(f"17:{s or ''}".encode()).hexdigest()[:5], 16) / (1 << 20)
        want = [math.floor(k * rate + offset) - math.floor((k - 1) * rate + offset) for k in range(1, len(mine) + 1)]
        key = lambda x: (x[0], str(x[1]), x[2])
        assert sorted(((x.size, x.doc_id, x.copies) for x in mine), key=key) == sorted(((x.size, x.doc_id, n) for x, n in zip(mine, want, strict=True)), key=key) or s == "d"
        assert sorted(x.copies for x in mine) == sorted(want)


def test_mix_of_rows_that_share_an_id(spark):
    """Which of several texts under one id and size is repeated is the same at every run, however the rows lie."""
    rows = [(i, f"w{i} w{k} x", "a") for i in (1, None) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, other = (sorted(map(tuple, mixing.mix(x).collect()), key=str) for x in (df, df.orderBy(F.desc("text")).repartition(5)))
    assert one == other and len(one) == 120


BASE = {"email": rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": rb"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": rb"[0-9]([\x20-]?[0-9])+", "phone": rb"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for rank, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p.decode(), text):
            w, d = m.group(), re.sub("[^0-9]", "", m.group())
            luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in w.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return sorted(out)


def test_pii(spark, docs):
    r = random.Random(8)
    texts = ["".join(r.choices(["a@b.c", "_", "@", ".", "é", "中", "1", "255", "256", ".", "4111 1111-1111 1111", " ", "+1 (555) 123-4567", "-", "%", "x", "\n", "00001.2.3.4", "+", "("], k=r.randint(1, 25))) for _ in range(400)]
    texts += ["IBAN GB82 WEST 1234 5698 7654 32.", "my ssn 123-45-6789", "order 123-45-6789", None, "", "1" * 50_000, "a" * 50_000, "a@" * 20_000, "1 " * 20_000, "😀 a@b.co 😀 1.2.3.4"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii", F.lit("clash"))
    got = {x.doc_id: x for x in pii.digest(df).collect()}
    for i, t in enumerate(texts):
        want = [s for _, _, s in base_spans(t or "")]
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(w.startswith(k) for w in want) for k in BASE]
        assert set(want) <= set(got[i].spans.split(","))
    n = len(texts) - 10
    assert got[n].spans == "iban:5:32" and got[n + 1].spans == "ssn:7:18" and got[n + 2].spans == ""
    assert got[n].scores == "100" and got[n + 1].scores == "70" and got[n + 9].scores == "90,50"
    red = {x.doc_id: x.text for x in pii.redact(df).collect()}
    for i, t in enumerate(texts):  # what stands between the spans stays, code point by code point
        at, want = 0, ""
        for kind, start, end in (x.split(":") for x in got[i].spans.split(",") if x):
            if int(start) >= at:
                want += t[at : int(start)] + f"[{kind.upper()}]"
            at = max(at, int(end))
        assert red[i] == (None if t is None else want + t[at:])
    assert red[n] == "IBAN [IBAN]." and red[n + 3] is None and red[n + 9] == "😀 [EMAIL] 😀 [IP]" and pii.digest(df.limit(0)).count() == 0


def test_pii_many_matches(spark):
    """Work grows with the matches, not with their square: 150,000 addresses in one text, well under a minute for all."""
    n = 150_000
    text = "é ".join(f"m{i}@x.org" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, "1.2.3.4 " * n)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    assert got[1].n_email == n and got[2].n_ip == n
    assert got[1].base_sha256 == hashlib.sha256(",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[a-z0-9]+@x\.org", text)).encode()).hexdigest()
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert red[1] == "é ".join(["[EMAIL]"] * n) and red[2] == "[IP] " * n
    assert time.time() - began < 60


def removed(rows, least):
    """[(id, bytes, removed, spans, hash)] of rows in order."""
    seen, out = set(), []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            s = b[p : p + least]
            if s in seen:
                gone[p : p + least] = b"\1" * least
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats(spark, docs, empty):
    extra = [(900 + i, t) for i, t in enumerate(["a" * 500, "ab" * 200, "a" * 99, "a" * 100, ("ab" * 200)[1:], "é" * 120, "zé" * 60 + "é" * 70])]
    rows = [(r[0], r[1]) for r in corpus()] + extra
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("clash"))
    assert sorted(map(tuple, repeats.digest(df).collect()), key=str) == removed(sorted(rows), 100)
    lone = spark.createDataFrame([(None, "a" * 300)], "doc_id long, text string")
    assert [tuple(r)[:4] for r in repeats.digest(lone).collect()] == [(None, 300, 299, 1)] and repeats.digest(empty).count() == 0


def test_repeats_of_rows_that_share_ids(spark):
    """Null and repeated ids: each row keeps its own text, equal rows lose all copies but one, and nothing is taken from a neighbour."""
    r = random.Random(7)
    noise = lambda n: "".join(r.choices("abcdefghij ", k=n))
    x, y, z = noise(300), noise(550), noise(180)
    rows = [(5, x), (5, x), (6, "short one of twenty!"), (6, y), (6, y[100:400] + z), (None, z), (None, x[:150] + noise(40)), (None, None), (None, z), (None, ""), (7, z + noise(30)), (4, noise(120)), (6, "short one of twenty!"), (5, x)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tie = {t: h for t, h in df.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    ordered = sorted(rows, key=lambda q: (q[0] is None, q[0] or 0, tie[q[1]]))
    got = sorted(map(tuple, repeats.digest(df.repartition(4)).collect()), key=str)
    assert got == removed(ordered, 100) and len(got) == len(rows)
    assert sum(g[2] == 0 for g in got if g[0] == 5) == 1
    places = {(d, t[g.start : g.start + g.length]) for g in repeats.occurrences(df).collect() for d, t in rows if d == g.doc_id and t}
    assert {7, None, 6} <= {d for d, t in places if len(t) >= 100 and t in z}


def test_repeat_groups(spark):
    """A passage in three documents with different surroundings is one group with all its occurrences."""
    r = random.Random(6)
    noise = lambda n: "".join(r.choices("abcdefghij ", k=n))
    passage = noise(150)
    rows = [(i, noise(100 + i) + chr(65 + i) + passage + chr(75 + i) + noise(90)) for i in range(3)]
    got = repeats.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # regions bound a repeat's length: those that lie within the passage together cover it, each with its place in all three documents
    inside = [g for g in got if g.doc_ids == [0, 1, 2]]
    assert got and len(inside) == len(got)
    assert all(g.length >= 100 and [s - (101 + i) for i, s in enumerate(g.starts)] == [g.starts[0] - 101] * 3 for g in got)
    assert min(g.starts[0] for g in got) == 101 and max(g.starts[0] + g.length for g in got) == 251


@pytest.mark.parametrize("hot", [100_000, 2])
def test_repeat_groups_of_copies(spark, monkeypatch, hot):
    """Groups list every occurrence, those in exact copies too, and cover all windows that repeat."""
    monkeypatch.setattr(repeats, "HOT", hot, raising=False)
    r = random.Random(8)
    noise = lambda n: "".join(r.choices("abcdefghij ", k=n))
    passage, copy = noise(150), noise(260)
    texts = [copy] * 4 + [noise(90 + i) + passage + noise(95) for i in range(3)] + [noise(120)]
    texts += texts[4:6] * 2 + [copy[:130] + noise(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = repeats.groups(df).collect()
    covered = set()
    for g in got:
        places = list(zip(g.doc_ids, g.starts, strict=True))
        string = texts[places[0][0]][places[0][1] :][: g.length]
        assert len(string) == g.length and places == [(d, i) for d, x in enumerate(texts) for i in range(len(x)) if x.startswith(string, i)] and len(places) > 1
        covered |= {(d, i + k) for d, i in places for k in range(g.length - 99)}
    assert len({(g.length, *g.doc_ids, *g.starts) for g in got}) == len(got)
    windows = Counter(x[i : i + 100] for x in texts for i in range(len(x) - 99))
    assert covered == {(d, i) for d, x in enumerate(texts) for i in range(len(x) - 99) if windows[x[i : i + 100]] > 1}


def test_maximal_repeats():
    r = random.Random(4)
    for _ in range(60):
        pieces = ["".join(r.choices("ab", k=r.randint(0, 25))).encode() for _ in range(r.randint(1, 4))]
        where = defaultdict(list)
        for d, p in enumerate(pieces):
            for i in range(len(p)):
                for j in range(i + 4, len(p) + 1):
                    where[p[i:j]].append((d, i))
        want = set()
        for s, at in where.items():
            left = {pieces[d][i - 1] if i else (d,) for d, i in at}
            right = {pieces[d][i + len(s)] if i + len(s) < len(pieces[d]) else (d,) for d, i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(s), tuple(at)))
        got = {(n, tuple(o)) for n, o in repeats.maximal_repeats(pieces, [(d, 0) for d in range(len(pieces))], 4)}
        assert got == want
