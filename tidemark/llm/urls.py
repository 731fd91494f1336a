"""URL filters: pattern rules indexed by their rarest literal token; only rules that a URL's tokens fetch are run.

Built from DataFrame functions alone. A rule is a regular expression on host and path joined, with the words
that any match must hold. The index puts each rule under that of its words which the fewest URLs hold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``words``: whole tokens, in lower case, of every URL that ``pattern`` matches. Site rules outrank others; then the longest."""

    name: str
    verdict: str
    pattern: str
    words: tuple[str, ...]
    site: bool = False


def site(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host with its subdomains and a path's start."""
    whole = path[: path.rindex("/") + 1]  # what follows the last slash may go on in the URL
    words = re.findall("[a-z0-9]+", f"{host}{whole}".lower())
    return Rule(host + path, verdict, r"\A(?:[^/]*\.)?" + re.sub(r"([^A-Za-z0-9/])", r"\\\1", host + path), tuple(dict.fromkeys(words)), True)


def word(verdict: str, *literals: str) -> Rule:
    """A rule for words that follow one another, parted by anything but letters and digits."""
    return Rule("-".join(literals), verdict, "(?i)(?:^|[^a-z0-9])" + "[^a-z0-9]+".join(literals) + "(?:[^a-z0-9]|$)", literals)


SITES = [site("block", "com", "/en/"), site("allow", "example.com", "/en/7"), site("allow", "net", "/de/"), site("block", "example.net", "/de/8"), site("block", "org", "/es/")]
WORDS = [word("block", *x.split()) for x in ("spam", "cheap pills", "pills", "casino", "viagra", "porn", "xxx", "warez", "malware", "phishing", "betting", "free download", "payday loan")]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z folded; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(key: Column) -> Column:
    return F.array_distinct(F.split(F.translate(key, UPPER, LOWER), "[^a-z0-9]+"))


def rarest(pages: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """The rules by their rarest word over all pages; only counts of the rules' own words come to the driver."""
    words = sorted({w for r in rules for w in r.words})
    count = pages.select(F.explode(F.array_intersect(tokens(F.concat(host(F.col("url")), path(F.col("url")))), F.array(*map(F.lit, words)))).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in count.collect()}  # a row for each word of the rules at most
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.words, key=lambda w: (df.get(w, 0), w)), []).append(r)
    return index


def judge(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """pages with host, path, rule and verdict: the longest site rule that fits, or else null and the verdict of the longest word rule, or allow.

    A null url, or one without ``://``, has an empty host and path and is allowed. Columns of pages with the new
    columns' names are replaced; all others stay. Rows are judged one by one, whatever their ids.
    """
    rules = [*SITES, *WORDS] if rules is None else rules
    index = rarest(pages, rules)
    entry = lambda r: F.struct(F.lit(r.site).alias("site"), F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))
    lookup = F.create_map(*(x for w, rs in index.items() for x in (F.lit(w), F.array(*map(entry, rs)))))
    df = pages.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumn("_key", F.concat("host", "path"))
    # Only rules that a token fetches come as far as their regular expressions.
    fetched = F.flatten(F.transform(F.filter(tokens(F.col("_key")), lambda t: t.isin(list(index))), lambda t: F.element_at(lookup, t)))
    df = df.withColumn("_best", F.array_max(F.filter(fetched, lambda r: F.regexp_like(F.col("_key"), r["pattern"]))))
    df = df.withColumns({"rule": F.when(F.col("_best.site"), F.col("_best.name")), "verdict": F.coalesce("_best.verdict", F.lit("allow"))})
    return df.drop("_key", "_best")
