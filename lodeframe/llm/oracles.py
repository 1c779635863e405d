"""DuckDB texts of the queries that SQL can express, each by the plainest way and not by the operator's method."""

from __future__ import annotations

from .chat import CONTROL, END, START
from .quality import LEAST, LOOSER, LOWER, MIN_WORDS, PART, PRECISION, SPREAD, UPPER
from .secrets import MAX_OWNERS, MAX_REPOS, SHINGLE
from .warc import MODULUS, SPOILT

_WORD = r"[^\x20\x09-\x0D]+"

#: All pairs of a label; components by a recursive walk.
OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, MIN(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, COALESCE(n.n, 0)::BIGINT AS n_links, LEAST(e.vec_id, COALESCE(low.b, e.vec_id)) AS component_id, e.vec_id <= COALESCE(low.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.a = e.vec_id
"""


def _pick(bound: str) -> str:
    return f"CASE WHEN s.docs >= {LEAST} THEN s.{bound} WHEN l.docs >= {LEAST} THEN l.{bound} ELSE a.{bound} END"


def _op2() -> str:
    def level(name: str, keys: str, above: str = "") -> str:
        group = f"{keys}, " if keys else ""
        up, down = f"GREATEST(q.high - q.mid, q.mid // {PRECISION})", f"GREATEST(q.mid - q.low, q.mid // {PRECISION})"
        if above:
            up, down = (f"LEAST({x}, {LOOSER} * p.{y} + q.mid // {PART})" for x, y in ((up, "up"), (down, "down")))
        on = "q.measure = p.measure" + (" AND q.lang IS NOT DISTINCT FROM p.lang" if above == "by_lang" else "")
        own = ", ".join(f"q.{k}" for k in [*keys.split(", "), "measure", "docs", "mid"] if k)
        return f"""
{name}_raw AS (
  SELECT {group}measure, COUNT(*) AS docs, list_sort(list(b))[(COUNT(*) + 9) // 10] AS low, list_sort(list(b))[(COUNT(*) * 5 + 9) // 10] AS mid, list_sort(list(b))[(COUNT(*) * 9 + 9) // 10] AS high
  FROM good GROUP BY {group}measure),
{name} AS (SELECT *, mid + {SPREAD} * up AS top, mid - {SPREAD} * down AS bottom FROM (SELECT {own}, {up} AS up, {down} AS down FROM {name}_raw q {f"JOIN {above} p ON {on}" if above else ""}) z)"""

    long = " UNION ALL ".join(f"SELECT rid, lang, source, '{m}' AS measure, {c} AS c, n_words, {c} * {scale} // GREATEST(n_words, 1) AS v FROM base WHERE NOT base_failed" for m, (c, scale, _) in UPPER.items())
    over = " OR ".join(
        [f"(g.measure = '{m}' AND g.c * {scale} > {_pick('top')} * g.n_words + {least * scale})" for m, (_, scale, least) in UPPER.items()]
        + [f"(g.measure = '{m}' AND g.c * {UPPER[m][1]} < {_pick('bottom')} * g.n_words)" for m in LOWER])
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, COALESCE(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM t),
grams AS (SELECT rid, i, COUNT(*) OVER (PARTITION BY rid, gram) AS n FROM (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w) u) g),
covered AS (SELECT rid, COUNT(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) c GROUP BY rid),
counted AS (
  SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, COALESCE(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, COALESCE(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered c ON c.rid = w.rid),
base AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
good AS (SELECT *, v - v % (1 << GREATEST(length(ltrim(bin(v), '0')) - 6, 0)) AS b FROM ({long}) r),
{level('by_all', '')},
{level('by_lang', 'lang', 'by_all')},
{level('by_source', 'lang, source', 'by_lang')},
bad AS (
  SELECT DISTINCT g.rid FROM good g JOIN by_source s ON s.measure = g.measure AND s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source
  JOIN by_lang l ON l.measure = g.measure AND l.lang IS NOT DISTINCT FROM g.lang JOIN by_all a ON a.measure = g.measure WHERE {over})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.rid IS NULL AS kept FROM base LEFT JOIN bad ON bad.rid = base.rid
"""


def _op5() -> str:
    kinds = {"assign": (r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12), "access": ("AKIA[A-Z0-9]+", 0, 18), "hex": ("[0-9a-f]+", 0, 16)}
    each = " UNION ALL ".join(
        f"SELECT rid, source, text, '{k}' AS kind, {rank} AS rank, string_split_regex(text, '{p}') AS parts, regexp_extract_all(text, '{p}') AS hits, regexp_extract_all(text, '{p}', {g}) AS vals, {least} AS least FROM t"
        for rank, (k, (p, g, least)) in enumerate(kinds.items()))
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, source, COALESCE(text, '') AS text FROM documents),
lists AS ({each}),
lengths AS (SELECT *, list_transform(parts, lambda x: length(x)) AS pl, list_transform(hits, lambda x: length(x)) AS hl FROM lists WHERE len(hits) > 0),
ranked AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM lengths),
spans AS (
  SELECT rid, source, kind, rank, (list_sum(pl[1:i]) + COALESCE(list_sum(hl[1:i - 1]), 0))::BIGINT AS s, (list_sum(pl[1:i]) + list_sum(hl[1:i]))::BIGINT AS e, vals[i] AS val
  FROM ranked WHERE length(vals[i]) >= least),
words AS (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws FROM t WHERE rid IN (SELECT rid FROM spans)),
repos AS (SELECT rid, list_min(list_transform(range(1, GREATEST(len(ws) - {SHINGLE}, 0) + 2), lambda i: md5(array_to_string(ws[i:i + {SHINGLE - 1}], ' ')))) AS repo FROM words),
owners AS (SELECT val, COUNT(DISTINCT COALESCE('+' || source, '-')) AS n, COUNT(DISTINCT repo) AS r FROM spans JOIN repos USING (rid) GROUP BY val),
judged AS (SELECT *, n > {MAX_OWNERS} AND r > {MAX_REPOS} AS copied FROM spans JOIN owners USING (val)),
every AS (
  SELECT rid, s, rank, kind, e, r || '/' || n AS own FROM judged UNION ALL
  SELECT DISTINCT rid, e - length(val) AS s, CASE WHEN copied THEN 4 ELSE 3 END AS rank, CASE WHEN copied THEN 'example' ELSE 'live' END AS kind, e, '' AS own FROM judged),
joined AS (SELECT rid, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(own, ',' ORDER BY s, rank) FILTER (rank < 3) AS ownership FROM every GROUP BY rid),
n AS (SELECT rid, COUNT(*) FILTER (kind = 'assign') AS a, COUNT(*) FILTER (kind = 'access') AS b, COUNT(*) FILTER (kind = 'hex') AS c FROM spans GROUP BY rid)
SELECT doc_id, COALESCE(a, 0) AS n_assign, COALESCE(b, 0) AS n_access, COALESCE(c, 0) AS n_hex, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans, COALESCE(ownership, '') AS ownership
FROM t LEFT JOIN joined USING (rid) LEFT JOIN n USING (rid)
"""


def _op8() -> str:
    escaped = lambda x: f"regexp_replace({x}, '{CONTROL}', '\\1\\\\\\2\\3', 'g')"
    role = escaped("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")
    return f"""
WITH t AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  SUM(length('{START}' || {role} || chr(10) || {escaped('text')} || '{END}' || chr(10)))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def _op7() -> str:
    """Base32 from the hex digest: 40 nibbles as bits, read off in fives."""
    value = " + ".join(f"{1 << (4 - k)} * substr(b, 5 * i + {k + 1}, 1)::INT" for k in range(5))
    nibbles = "".join(f"{n:04b}" for n in range(16))
    return f"""
WITH d AS (SELECT page_id, strlen(COALESCE(html, '')) AS n, sha1(COALESCE(html, '')) AS x FROM pages),
f AS (SELECT *, MIN(page_id) OVER (PARTITION BY x) AS first,
  list_aggregate(list_transform(range(1, 41), lambda i: substr('{nibbles}', 4 * strpos('0123456789abcdef', substr(x, i, 1)) - 3, 4)), 'string_agg', '') AS b FROM d)
SELECT page_id, n AS payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {value}, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to,
  COALESCE(page_id % {MODULUS} <> {SPOILT}, TRUE) AS salvaged
FROM f
"""


ORACLE_SQL = {"op1_itq": OP1, "op2_quality": _op2(), "op5_secrets": _op5(), "op7_warc": _op7(), "op8_chat": _op8()}
