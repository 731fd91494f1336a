"""DuckDB statements for the queries that SQL can express over whole tables."""

from __future__ import annotations

FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Common table expressions ending in sets(doc_id, n, g): a row for each distinct shingle of each document.
SHINGLES = f"""
w AS (SELECT {{id}} AS doc_id, {WORDS.format(FOLD.format("text"))} AS w FROM {{table}}),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g FROM w),
"""

OP2 = f"""
WITH RECURSIVE {SHINGLES.format(id="doc_id", table="documents")}
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM g JOIN r ON g.doc_id = r.a GROUP BY ALL
"""


ITEMS = SHINGLES.format(id="item_id", table="benchmark").replace("w AS (", "iw AS (").replace("\ng AS (", "\nig AS (").replace("FROM w)", "FROM iw)")
OP3 = f"""
WITH {SHINGLES.format(id="doc_id", table="documents")} {ITEMS}
d AS (SELECT doc_id, unnest(g) AS t FROM g),
i AS (SELECT doc_id AS item_id, len(g) AS n, unnest(g) AS t FROM ig JOIN iw USING (doc_id) WHERE len(w) NOT IN (3, 4)),
ds AS (SELECT doc_id, 3 AS k, unnest(list_distinct([array_to_string(w[j : j + 2], ' ') FOR j IN range(1, len(w) - 1)])) AS t FROM w
  UNION ALL SELECT doc_id, 4 AS k, unnest(list_distinct([array_to_string(w[j : j + 3], ' ') FOR j IN range(1, len(w) - 2)])) AS t FROM w)
SELECT doc_id, item_id, count(*) AS n_shared, CAST(n AS BIGINT) AS n_item FROM d JOIN i USING (t)
GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n
UNION ALL SELECT ds.doc_id, iw.doc_id, 1, 1 FROM ds JOIN iw ON len(iw.w) = ds.k AND array_to_string(iw.w, ' ') = ds.t
"""


OP4 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a) USING (vec_id)
"""

#: The contract's rules, longest first: block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/.
_RULES = """
    (VALUES ('example.com', '/en/7', 'allow'), ('example.net', '/de/8', 'block'), ('com', '/en/', 'block'), ('net', '/de/', 'allow'), ('org', '/es/', 'block')) AS r(rule_host, rule_path, rule_verdict)
"""
_WORDS = ["spam", "cheap[^a-z0-9]+pills", "pills", "casino", "viagra", "porn", "xxx", "warez", "malware", "phishing", "betting", "free[^a-z0-9]+download", "payday[^a-z0-9]+loan"]
OP5 = f"""
WITH u AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
b AS (SELECT page_id, host, path, (SELECT [rule_host || rule_path, rule_verdict] FROM {_RULES.strip()}
    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) ORDER BY len(rule_host || rule_path) DESC LIMIT 1) AS r FROM u)
SELECT page_id, host, path, r[1] AS rule,
    CASE WHEN r IS NOT NULL THEN r[2] WHEN regexp_matches(host || path, '(?i)(^|[^a-z0-9])({"|".join(_WORDS)})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM b
"""


OP6 = f"""
WITH d AS (SELECT doc_id, {WORDS.format(FOLD.format("text"))} AS w FROM documents),
w AS (SELECT doc_id, unnest(w) AS v, unnest(range(len(w))) AS i, unnest(list_prepend(NULL, w[:-2])) AS u FROM d WHERE len(w) > 0),
t AS (SELECT count(*) AS n FROM w),
c1 AS (SELECT v, count(*) AS c FROM w GROUP BY v), o1 AS (SELECT doc_id, v, count(*) AS c FROM w GROUP BY doc_id, v),
c2 AS (SELECT u, v, count(*) AS c FROM w WHERE i > 0 GROUP BY u, v), o2 AS (SELECT doc_id, u, v, count(*) AS c FROM w WHERE i > 0 GROUP BY doc_id, u, v),
s AS (SELECT w.doc_id, w.i, c2.c - o2.c AS cuv, cu.c - ou.c AS cu, cv.c - ov.c AS cv, t.n - len(d.w) AS n
  FROM w JOIN d USING (doc_id) CROSS JOIN t JOIN c1 cv ON cv.v = w.v JOIN o1 ov ON ov.doc_id = w.doc_id AND ov.v = w.v
  LEFT JOIN c1 cu ON cu.v = w.u LEFT JOIN o1 ou ON ou.doc_id = w.doc_id AND ou.v = w.u
  LEFT JOIN c2 ON c2.u = w.u AND c2.v = w.v LEFT JOIN o2 ON o2.doc_id = w.doc_id AND o2.u = w.u AND o2.v = w.v),
l AS (SELECT doc_id, CASE WHEN cuv > 0 THEN ln(cuv / cu) WHEN cv > 0 THEN ln(CASE WHEN i = 0 THEN 1.0 ELSE 0.4 END * cv / n) ELSE ln(CASE WHEN i = 0 THEN 1.0 ELSE 0.4 END / (n + 1)) END AS x FROM s)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(sum(x), 0), 4) AS log_score, round(exp(-sum(x) / len(d.w)), 1) AS perplexity
FROM d LEFT JOIN l USING (doc_id) GROUP BY d.doc_id, d.w
"""

#: Expects d(doc_id, source, size); ends in c with a row for each document.
MIX = """
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
l AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS cap_level FROM w),
f AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS share_level FROM l
  WINDOW p AS (ORDER BY cap_level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN arg_min(share_level, cap_level) FILTER (share_level <= cap_level) OVER () IS NULL THEN cap
  ELSE least(cap, (arg_min(share_level, cap_level) FILTER (share_level <= cap_level) OVER ()) * weight) END AS target,
  ('0x' || substr(md5('17:' || coalesce(source, '')), 1, 5))::INTEGER / 1048576.0::DOUBLE AS u FROM f),
r AS (SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id ASC NULLS LAST) AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(floor(k * rate + u) - floor((k - 1) * rate + u) AS BIGINT) AS copies FROM r)
"""
SIZE = f"CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT)"
OP7 = f"""
WITH d AS (SELECT doc_id, source, {SIZE} AS size FROM documents), {MIX}
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, copies * size AS taken FROM c
"""


def _spans(kind: str, rank: int, pattern: str, ok: str) -> str:
    """Matches of a pattern with their places, from the pieces between them."""
    return f"""
{kind}_p AS (SELECT doc_id, text, [len(x) FOR x IN string_split_regex(text, '{pattern}')] AS gap, regexp_extract_all(text, '{pattern}') AS word FROM t),
{kind} AS (SELECT doc_id, '{kind}' AS kind, {rank} AS rank, s AS "start", s + len(m) AS "end", m, substr(text, greatest(s + 1 - 40, 1), least(s, 40)) AS near FROM (
  SELECT doc_id, text, word[i] AS m, CAST(list_sum(gap[1:i]) + coalesce(list_sum([len(x) FOR x IN word[1 : i - 1]]), 0) AS BIGINT) AS s
  FROM (SELECT *, unnest(range(1, len(word) + 1)) AS i FROM {kind}_p)) WHERE {ok})"""


#: Scores in hundredths: of a valid span of the kind, for words before it, and against it.
_SCORES = " ".join(
    f"WHEN kind = '{kind}' THEN least(100, greatest(0, {base} + CASE WHEN regexp_matches(near, '(?i)\\b({words})\\b') THEN 40 ELSE 0 END - CASE WHEN regexp_matches(near, '(?i)\\b(example|sample|version|test|isbn|order)\\b') THEN 30 ELSE 0 END))"
    for kind, base, words in (
        ("email", 90, "e-?mail|contact|write"),
        ("ip", 50, "ip|address|host|server"),
        ("card", 80, "card|credit|visa|payment|paid"),
        ("phone", 50, "phone|tel|call|mobile|fax"),
        ("iban", 80, "iban|account|bank|transfer"),
        ("ssn", 30, "ssn|social|security"),
    )
)


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"len({_DIGITS}) BETWEEN 14 AND 19 AND list_sum([CASE WHEN i % 2 = 0 THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(reverse({_DIGITS})[i] AS INTEGER) + 1] ELSE CAST(reverse({_DIGITS})[i] AS INTEGER) END FOR i IN range(1, len({_DIGITS}) + 1)]) % 10 = 0"
_SSN_SCORE = r"0.3 + CASE WHEN regexp_matches(near, '(?i)\b(ssn|social|security)\b') THEN 0.4 ELSE 0 END - CASE WHEN regexp_matches(near, '(?i)\b(example|sample|version|test|isbn|order)\b') THEN 0.3 ELSE 0 END >= 0.6"
_MOVED = "substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4)"
_MOD97 = f"list_reduce(list_prepend(0, [CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END FOR c IN string_split({_MOVED}, '')]), lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c) % 97 END) = 1"
_IBAN_SCORE = _SSN_SCORE.replace("0.3 + ", "0.8 + ").replace("ssn|social|security", "iban|account|bank|transfer")
OP8 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_spans("email", 0, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true")},
{_spans("ip", 1, "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "len([x FOR x IN string_split(m, '.') IF CAST(x AS HUGEINT) > 255]) = 0")},
{_spans("card", 2, "[0-9](?:[\\x20-]?[0-9])+", _LUHN)},
{_spans("phone", 3, "\\+[0-9][\\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 10 AND 15")},
{_spans("iban", 4, "\\b[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]){11,30}\\b", f"{_MOD97} AND {_IBAN_SCORE}")},
{_spans("ssn", 5, "\\b[0-9]{3}-[0-9]{2}-[0-9]{4}\\b", _SSN_SCORE)},
a AS (SELECT doc_id, kind, rank, "start", "end", CASE {_SCORES} END AS score
  FROM (FROM email UNION ALL FROM ip UNION ALL FROM card UNION ALL FROM iban UNION ALL FROM phone UNION ALL FROM ssn))
SELECT t.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank) FILTER (rank < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank) FILTER (kind IS NOT NULL), '') AS spans,
  coalesce(string_agg(score, ',' ORDER BY "start", rank) FILTER (kind IS NOT NULL), '') AS scores
FROM t LEFT JOIN a USING (doc_id) GROUP BY t.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_lm_scoring": OP6, "op8_pii": OP8, "op7_mixing": OP7, "op4_embedding_near_dedup": OP4, "op5_url_filters": OP5, "op3_benchmark_decontamination": OP3, "op2_ngram_jaccard_join": OP2}
