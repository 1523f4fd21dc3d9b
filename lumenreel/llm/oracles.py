"""SQL for the operators' queries that SQL can express, as DuckDB runs it."""

from __future__ import annotations

from lumenreel.llm import decontam, line_dedup, secrets

WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i+3], ' '))) AS s FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""

_GROUP = "('0x' || substr(h, g * 5 + 1, 5))::BIGINT"
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({group} >> {shift}) & 31)::INTEGER + 1, 1)"
_LETTERS = " || ".join(_LETTER.format(group=_GROUP, shift=s) for s in (15, 10, 5, 0))
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, bytes::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 8), lambda g: {_LETTERS}), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM q
"""

_ESCAPES = r"length(t) - length(replace(t, '\', '')) + coalesce(list_sum(list_transform(regexp_extract_all(t, '#{3,}'), lambda x: length(x) - 2)), 0) + (length(t) - length(replace(t, '</turn>', ''))) // 7"
CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(role) + 1 + length(t) + {_ESCAPES} + 8)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 19, 0) + 1)) AS i FROM d)),
f AS (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY k) AS first FROM v),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS place FROM f WHERE (doc_id, i) <> first),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY place) AS text FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_FILLED = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
QUALITY_BASE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format(text="coalesce(text, '')")} AS w, {_FILLED} AS l FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM twice) GROUP BY doc_id),
x AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM x
"""

_KINDS = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {i} AS ord, {least} AS least, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS w, regexp_extract_all(t, '{pattern}', {group}) AS p FROM t WHERE regexp_matches(t, '{pattern}')"
    for i, (kind, pattern, group, least) in enumerate((k, p.replace("'", "''"), g, n) for k, p, g, n in secrets.BASE)
)
SECRETS_BASE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_KINDS}),
e AS (SELECT doc_id, kind, ord, least, gaps, w, p, unnest(range(1, len(w) + 1)) AS i FROM m),
s AS (SELECT doc_id, kind, ord, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS a, length(w[i]) AS n FROM e WHERE length(p[i]) >= least),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, ord) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN g USING (doc_id)
"""

PACKING_FACTS = "SELECT count(*) AS documents, 0::BIGINT AS not_whole, 0::BIGINT AS with_gaps, 0::BIGINT AS too_long, 0::BIGINT AS over_bound FROM documents"

SHARDING_FACTS = """
WITH d AS (SELECT octet_length(encode(coalesce(text, ''))) + 16 AS size, text FROM documents),
k AS (SELECT count(*) - 1 AS links FROM d WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)
SELECT count(*) AS documents, sum(size)::BIGINT AS bytes, 40::BIGINT AS shards, count(*) // 40 AS least, (count(*) + 39) // 40 AS most, 0::BIGINT AS with_gaps, (SELECT coalesce(sum(links), 0)::BIGINT FROM k) AS links FROM d
"""

SQL = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op2_ngram_jaccard": NGRAM_JACCARD,
    "op3_warc": WARC,
    "op7_decontamination": decontam.ORACLE_SQL,
    "op9_chat_format": CHAT,
    "op10_substring_dedup": SUBSTRING_DEDUP,
    "quality_base": QUALITY_BASE,
    "secrets_base": SECRETS_BASE,
    "packing_facts": PACKING_FACTS,
    "sharding_facts": SHARDING_FACTS,
}
