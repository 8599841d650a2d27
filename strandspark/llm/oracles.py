"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from . import quality, secrets

_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

_RULE_SQL = " + ".join(
    "CASE WHEN "
    + " AND ".join(([f"{r.metric} >= {r.low}"] if r.low is not None else []) + ([f"{r.metric} <= {r.high}"] if r.high is not None else []))
    + " THEN 0 ELSE 1 END"
    for r in quality.RULES
)
_FAILED_SQL = "list_filter([" + ", ".join(
    "CASE WHEN "
    + " AND ".join(([f"{r.metric} >= {r.low}"] if r.low is not None else []) + ([f"{r.metric} <= {r.high}"] if r.high is not None else []))
    + f" THEN NULL ELSE '{r.name}' END"
    for r in quality.RULES
) + "], lambda x: x IS NOT NULL)"

OP2 = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w),
win AS (SELECT g.doc_id, g.i, list_slice(w.words, g.i, g.i + 7) AS grams FROM g JOIN w USING (doc_id)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, grams) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, body, lines,
         len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS stops,
         len(regexp_extract_all(body, '!')) AS bangs,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS dots
  FROM w LEFT JOIN rep USING (doc_id)),
r AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
         word_chars / greatest(n_words, 1) AS mean_word_chars,
         n_symbols / greatest(n_words, 1) AS symbol_ratio,
         bangs / greatest(n_words, 1) AS bang_ratio,
         stops / greatest(n_words, 1) AS stop_ratio,
         n_dup_lines / greatest(len(lines), 1) AS dup_line_ratio,
         bullets / greatest(len(lines), 1) AS bullet_ratio,
         dots / greatest(len(lines), 1) AS ellipsis_ratio,
         (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed
  FROM m)
SELECT *, {_FAILED_SQL} AS failed_rules, (NOT base_failed AND ({_RULE_SQL}) = 0) AS kept FROM r
"""

OP1 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_page FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_page THEN first_page END AS refers_to,
       true AS digest_ok, true AS index_ok
FROM f
"""

OP3 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS words FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS words FROM benchmark),
d0 AS (SELECT doc_id, words, greatest(len(words) - 4, 1) AS total, unnest(range(0, greatest(len(words) - 4, 1))) AS p FROM dw WHERE len(words) > 0),
d AS (SELECT doc_id, total, p, list_slice(words, p + 1, p + 5) AS sh FROM d0),
i0 AS (SELECT item_id, words, greatest(len(words) - 4, 1) AS n, unnest(range(0, greatest(len(words) - 4, 1))) AS p FROM iw WHERE len(words) > 0),
i AS (SELECT item_id, n, list_slice(words, p + 1, p + 5) AS sh, count(*) AS cnt FROM i0 GROUP BY ALL),
hits AS (SELECT doc_id, total, p, item_id, n, sh, cnt FROM d JOIN i USING (sh)),
met AS (
  SELECT a.doc_id, a.item_id, a.p AS p0, a.n, least(a.n, a.total - a.p) AS w, b.sh, least(count(*), b.cnt) AS c
  FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p >= a.p AND b.p < a.p + a.n
  GROUP BY a.doc_id, a.item_id, a.p, a.n, a.total, b.sh, b.cnt),
sim AS (SELECT doc_id, item_id, p0, sum(c) / (n + w - sum(c)) AS s FROM met GROUP BY doc_id, item_id, p0, n, w)
SELECT doc_id, item_id, max(s) AS similarity, min_by(p0, (-s, p0))::BIGINT AS window_start
FROM sim WHERE s * 100 >= 80 - 1e-9 GROUP BY doc_id, item_id
"""

OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s0 AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 2), chr(1)) AS sh FROM s0),
c AS (SELECT doc_id, count(*) AS n, md5(string_agg(sh, chr(2) ORDER BY sh)) AS fp FROM s GROUP BY doc_id),
rep AS (SELECT fp, min(doc_id) AS rep, any_value(n) AS n FROM c GROUP BY fp),
rs AS (SELECT rep, n, sh FROM s JOIN rep ON doc_id = rep),
pairs AS (SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS k FROM rs a JOIN rs b ON a.sh = b.sh AND a.rep < b.rep GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * k >= 85 * (na + nb - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep AS node, rep AS seen FROM rep UNION SELECT node, e.b FROM reach JOIN edges e ON e.a = seen),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN rep USING (fp) LEFT JOIN comp ON node = rep.rep
"""


def _matches(kind: secrets.Kind, rank: int) -> str:
    """All matches of a kind with their values, and the pieces between them."""
    pattern = kind.pattern.replace("'", "''")
    return f"""SELECT doc_id, source, repo, '{kind.name}' AS kind, {rank} AS rank, {str(kind.base).lower()} AS base, {kind.min_value} AS least,
      regexp_extract_all(body, '{pattern}', 0) AS m, regexp_extract_all(body, '{pattern}', {kind.group}) AS v, string_split_regex(body, '{pattern}') AS g FROM t"""


_KINDS = secrets.BASE_KINDS + secrets.MORE_KINDS
OP6 = f"""
WITH t AS (SELECT doc_id, source, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS body FROM documents),
k AS ({" UNION ALL ".join(_matches(kind, rank) for rank, kind in enumerate(_KINDS))}),
e AS (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM k),
f AS (SELECT doc_id, source, repo, kind, rank, base, v[j] AS value,
        (list_sum(list_transform(list_slice(g, 1, j), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, j - 1), lambda x: length(x))), 0))::BIGINT AS s,
        length(m[j]) AS n FROM e WHERE length(v[j]) >= least),
o AS (SELECT value, count(DISTINCT source) >= {secrets.SHARED_OWNERS} OR (count(DISTINCT source) >= 2 AND count(DISTINCT (source, repo)) >= {secrets.SHARED_REPOSITORIES}) AS copied FROM f GROUP BY value),
q AS (SELECT f.*, NOT copied AS live FROM f JOIN o USING (value) WHERE base OR NOT copied),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
        string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (WHERE base) AS base_spans, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans,
        count(*) FILTER (WHERE live) AS n_live FROM q GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM t LEFT JOIN a USING (doc_id)
"""

OP8 = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w0 AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM h WHERE length(x) >= 800),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS k FROM w0),
d AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM d),
r AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM r),
k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(a || ':' || b, ',' ORDER BY a) AS removed_spans, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM p JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256, length(x) // 2 - coalesce(n_removed, 0) AS kept_bytes,
  n_removed IS NOT NULL AS has_repeats, coalesce(removed_spans, '') AS removed_spans
FROM h LEFT JOIN k USING (doc_id)
"""

OP9 = r"""
WITH l AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines, text FROM documents),
w AS (
  SELECT doc_id, unnest(range(1, greatest(len(lines) - 1, 1))) AS i, lines FROM l WHERE text IS NOT NULL),
win AS (
  SELECT doc_id, i, list_slice(lines, i, i + 2) AS three FROM w
  WHERE regexp_matches(array_to_string(list_slice(lines, i, i + 2), ''), '[^\x20\x09-\x0D]')),
late AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY three ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
cov AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 3)))) AS gone FROM late GROUP BY doc_id),
o AS (SELECT l.doc_id, lines, text, gone FROM l LEFT JOIN cov USING (doc_id))
SELECT doc_id,
       CASE WHEN text IS NULL OR gone IS NULL THEN text
            ELSE coalesce(array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i)), chr(10)), '') END AS text,
       coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed
FROM o
"""

_ESC = "regexp_replace(regexp_replace(replace({0}, '~', '~0'), '<(/?s>|\\|)', '~1\\1', 'g'), '\\[(/?INST\\])', '~2\\1', 'g')"

OP10 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (
  SELECT *, lag(role) OVER o AS before, row_number() OVER o AS k FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
f AS (
  SELECT *, length({_ESC.format("text")}) + CASE WHEN before IS NULL THEN 13 + length(replace({_ESC.format("role")}, chr(10), '~3'))
       WHEN before <> role THEN 24 + length(replace({_ESC.format("role")}, chr(10), '~3')) ELSE 10 END AS chars FROM p)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(length(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant')), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (sum(chars) + 11)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * len(regexp_extract_all(body, '[A-Z]')) > 5 * length(body),
          regexp_matches(body, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false)] AS fails
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS ord FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT ord, x.i AS step, ord[x.i] AS own, list_slice(ord, 1, x.i - 1) AS earlier FROM o, x),
r AS (
  SELECT part, ord, step, own,
         coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails[own]), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE NOT gone AND fails[own]), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE gone AND fails[own]), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fails[own] AND len(list_filter(fails, lambda y: y)) = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE NOT gone AND fails[own]), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails[own]), 0)::BIGINT AS toxic_lost
  FROM (SELECT *, len(list_filter(earlier, lambda y: fails[y])) > 0 AS gone FROM c, s) GROUP BY part, ord, step, own)
SELECT part, array_to_string(list_transform(ord, lambda y: chr(64 + y)), '') AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM r
"""

#: CRC-32 of the decimal digits of c, a bit at a time: a byte enters at the first of its eight steps.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295)"""

OP12 = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id AS c FROM t)),
r AS (
  SELECT c, k, role, text FROM h JOIN t ON conv_id = c AND k > h
  UNION ALL SELECT c, k, role, text FROM h JOIN t ON conv_id = c - c % 100 AND k <= h),
p AS (
  SELECT c, 0 AS depth, '' AS node, 0 AS chars FROM h
  UNION ALL
  SELECT c, row_number() OVER o, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER o), length(text) FROM r WINDOW o AS (PARTITION BY c ORDER BY k)),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends, lag(node) OVER (PARTITION BY c ORDER BY depth) AS parent FROM p),
n AS (
  SELECT depth, node, min(c) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent, any_value(chars) AS chars,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM e GROUP BY depth, node),
kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, node)),
up AS (
  SELECT p.depth, p.node, sum((m.n_children = 0)::INT) AS n_leaves, sum((m.n_convs - 1) * m.chars) AS saved_tokens
  FROM m JOIN p ON p.c = m.conv_id AND p.depth <= m.depth GROUP BY p.depth, p.node)
SELECT m.conv_id, m.depth::BIGINT AS depth, b.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN up USING (depth, node) LEFT JOIN n b ON b.depth = m.depth - 1 AND b.node = m.parent
"""

OP13 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
win AS (SELECT doc_id, i, sha256(array_to_string(list_slice(words, i, i + 34), ' ')) AS k FROM s),
d AS (SELECT doc_id, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM d),
pos AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
edge AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM gone),
runs AS (SELECT doc_id, min(p) - 1 AS a, max(p) AS b FROM edge GROUP BY doc_id, run),
r AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, string_agg(a || ':' || b, ',' ORDER BY a) AS removed_spans FROM runs GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(removed_spans, '') AS removed_spans
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN r USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_warc_archives": OP1,
    "op2_quality_rules": OP2,
    "op3_benchmark_decontamination": OP3,
    "op5_minhash_neardup": OP5,
    "op6_secret_scan": OP6,
    "op8_run_length_dedup": OP8,
    "op9_line_dedup": OP9,
    "op10_chat_format": OP10,
    "op11_filter_audit": OP11,
    "op12_prefix_trie": OP12,
    "op13_substring_dedup": OP13,
}
