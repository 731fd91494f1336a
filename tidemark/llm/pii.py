"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust their scores.

Built from DataFrame functions alone. A pattern cuts a text into the pieces between its matches; running sums over
the lengths of pieces and matches, doubled in reach step by step, give each match its place, and what stands before a match is
looked up in the chunk of text that holds it: work grows with n log n in a text's matches. Patterns are written so that no backtracking
repeats work: a run of characters is tried once, from its start, and matched possessively where what follows
cannot begin inside it. That leaves their matches as they are and makes them linear in a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind: (pattern, a literal pattern that any match holds, score before validation)
KINDS: dict[str, tuple[str, str, float]] = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", 0.5),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "", 0.4),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.5),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", "", 0.4),
    "ssn": (r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "-", 0.3),
}
BASE = ("email", "ip", "card", "phone")
#: Words that raise a span's score if they stand within REACH characters before it.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|address|host|server)\b",
    "card": r"(?i)\b(?:card|credit|visa|payment|paid)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer)\b",
    "ssn": r"(?i)\b(?:ssn|social|security)\b",
}
#: Words that lower it.
AGAINST = r"(?i)\b(?:example|sample|version|test|isbn|order)\b"
REACH = 40
#: Least score of a span that the base definitions don't have.
LEAST = 0.6


#: Code points in a chunk of text.
CHUNK = 512


def let(value: Column, body) -> Column:
    """body of the value, which is computed once, however often body and the lambdas in it name it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(x: Column) -> Column:
    """Inclusive running sums of an array: in step k each number takes in the sum that ends 2**k before it."""
    reach = F.slice(F.array(*(F.lit(1 << k) for k in range(31))), 1, F.ceil(F.log2(F.greatest(F.size(x), F.lit(1)))).cast("int"))
    return F.aggregate(reach, x, lambda acc, k: F.transform(acc, lambda v, i: v + F.when(i >= k, F.get(acc, i - k)).otherwise(F.lit(0))))


def furthest(x: Column) -> Column:
    """Running maxima of an array, like ``running``."""
    reach = F.slice(F.array(*(F.lit(1 << k) for k in range(31))), 1, F.ceil(F.log2(F.greatest(F.size(x), F.lit(1)))).cast("int"))
    return F.aggregate(reach, x, lambda acc, k: F.transform(acc, lambda v, i: F.when(i >= k, F.greatest(v, F.get(acc, i - k))).otherwise(v)))


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), 0)


def piece(parts: Column, start: Column, end: Column) -> Column:
    """The text from start to end, code points, out of its chunks; only those that it lies in are touched."""
    first = F.floor(start / CHUNK).cast("int")
    held = F.array_join(F.slice(parts, first + 1, F.floor(end / CHUNK).cast("int") - first + 1), "")
    return F.when(end > start, F.substr(held, start - first * CHUNK + 1, end - start)).otherwise(F.lit(""))


NONE = "cast(array() as array<struct<start:int,end:int,word:string>>)"


def matches(text: Column, kind: str) -> Column:
    """array<struct<start, end, word>> of the leftmost non-overlapping matches; places count code points."""
    pattern, literal, _ = KINDS[kind]
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def placed(words: Column) -> Column:
        # a match starts where the gaps so far and the matches before it end
        ahead = let(gaps, lambda g: F.transform(words, lambda _, i: F.get(g, i) + F.when(i > 0, F.length(F.get(words, i - 1))).otherwise(F.lit(0))))
        return F.zip_with(let(ahead, running), words, lambda at, w: F.struct(at.alias("start"), (at + F.length(w)).alias("end"), w.alias("word")))

    found = let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)
    return F.when(F.contains(text, F.lit(literal)) & F.regexp_like(text, F.lit(pattern)), found).otherwise(F.expr(NONE))


def digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass Luhn's check: every second digit from the right doubled, its digits summed."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 1, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(word: Column) -> Column:
    """Whether an account number passes the mod-97 check: its first four characters moved to the end, letters as 10 to 35."""
    bare = F.regexp_replace(word, " ", "")
    moved = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def valid(kind: str, word: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(word, r"\."), lambda p: F.regexp_like(p, F.lit(r"\A0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z")))
    if kind == "card":
        n = digits(word)
        return F.when(F.length(n).between(14, 19), luhn(n)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(word)).between(10, 15)
    if kind == "iban":
        return mod97(word)
    return F.lit(True)


def score(parts: Column, kind: str, span: Column) -> Column:
    """A valid span's score, from its kind, its checksum if the kind has one, and the words shortly before it; parts are the text's chunks."""
    near = piece(parts, F.greatest(span["start"] - REACH, F.lit(0)), span["start"])
    base = KINDS[kind][2] + (0.4 if kind in ("card", "iban") else 0.0)
    s = F.lit(base) + F.when(F.regexp_like(near, F.lit(CONTEXT[kind])), 0.4).otherwise(0.0) - F.when(F.regexp_like(near, F.lit(AGAINST)), 0.3).otherwise(0.0)
    return F.round(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)), 2)


def spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind, score>> in order of start and then of kind."""

    def of(rank: int, kind: str, parts: Column, found: Column) -> Column:
        ok = F.filter(found, lambda m: valid(kind, m["word"]))
        each = F.transform(ok, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), score(parts, kind, m).alias("score")))
        return each if kind in BASE else F.filter(each, lambda m: m["score"] >= LEAST)

    def scored(x: Column) -> Column:
        some = F.greatest(*(F.size(x[kind]) for kind in KINDS)) > 0
        # chunks are cut where something was found at all
        return let(F.when(some, chunks(text)).otherwise(F.expr("cast(array() as array<string>)")), lambda parts: F.array_sort(F.concat(*(of(rank, kind, parts, x[kind]) for rank, kind in enumerate(KINDS)))))

    return let(F.struct(*(matches(text, kind).alias(kind) for kind in KINDS)), scored)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with pii, the spans found in every whole text; null counts as empty. Base kinds are in it whatever their score, others from LEAST up.

    Rows are looked at one by one, whatever their ids. A column pii of docs is replaced.
    """
    return docs.withColumn("pii", spans(F.coalesce(F.col(text_col), F.lit(""))))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) of every row; null texts are empty, null and repeated ids count for nothing.

    spans are kind:start:end in order of start and then of kind, scores their scores in hundredths in the same order, both comma-joined.
    """
    df = find(docs.select("doc_id", "text")).select("doc_id", "pii")
    count = lambda kind: F.size(F.filter("pii", lambda m: m["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda m: m["kind"].isin(*BASE))
    scores = F.array_join(F.transform("pii", lambda m: F.round(m["score"] * 100).cast("int").cast("string")), ",")
    return df.select("doc_id", *map(count, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of personal data replaced by its kind in brackets; overlapping spans become one, named by the first.

    Null texts stay null, and texts without spans stay as they are; no row goes, and null and repeated ids count for nothing.
    """
    names = docs.columns
    text = F.col(text_col)

    def fresh(x: Column) -> Column:
        found, far, parts = x["found"], x["far"], x["parts"]
        # a span that begins before an earlier one ends is part of it: it adds nothing, and the text goes on where the furthest of them ends
        shown = F.zip_with(found, F.transform(found, lambda _, i: F.when(i > 0, F.get(far, i - 1)).otherwise(F.lit(0))), lambda m, at: F.when(m["start"] >= at, F.concat(piece(parts, at, m["start"]), F.lit("["), F.upper(m["kind"]), F.lit("]"))))
        return F.concat(F.array_join(shown, ""), piece(parts, F.element_at(far, -1), F.length(text)))

    found = spans(F.coalesce(text, F.lit("")))
    both = let(found, lambda m: F.when(F.size(m) > 0, let(F.struct(m.alias("found"), furthest(F.transform(m, lambda s: s["end"])).alias("far"), chunks(text).alias("parts")), fresh)).otherwise(text))
    return docs.withColumn(text_col, both).select(*names)
