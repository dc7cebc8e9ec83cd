"""DuckDB SQL for the queries that SQL can express on small tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"

_OP4 = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS fp FROM g GROUP BY doc_id),
c AS MATERIALIZED (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY fp) AS class_id FROM n),
r AS MATERIALIZED (SELECT g.doc_id, g.s FROM g JOIN c ON c.doc_id = g.doc_id AND c.class_id = c.doc_id),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM r x JOIN r y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 10 * k >= 8 * (ca.n + cb.n - k)),
reach AS (SELECT a AS node, b AS other FROM l UNION SELECT reach.node, l.b FROM reach JOIN l ON l.a = reach.other),
comp AS (SELECT node, min(least(node, other)) AS component_id FROM reach GROUP BY node),
sizes AS (SELECT class_id, count(*) AS size FROM c GROUP BY class_id),
links AS (SELECT a, sum(size) AS links FROM l JOIN sizes ON class_id = b GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, CAST(coalesce(links, 0) + coalesce(size, 1) - 1 AS BIGINT) AS n_links,
       coalesce(component_id, c.class_id, d.doc_id) AS component_id, coalesce(d.doc_id = coalesce(component_id, c.class_id, d.doc_id), true) AS kept
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN sizes ON sizes.class_id = c.class_id
LEFT JOIN links ON links.a = c.class_id LEFT JOIN comp ON comp.node = c.class_id
"""

ORACLES: dict[str, str] = {"op4_ngram_jaccard_join": _OP4}

_KEY = f"translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}')"

_OP3 = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM s),
k AS (SELECT doc_id, i, line, {_KEY} AS k FROM x),
f AS (SELECT k, max(doc_id) AS winner FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, i, line, f.k IS NOT NULL AND k.doc_id <> winner AS lost FROM k LEFT JOIN f ON k.k = f.k)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def _op7() -> str:
    from quireflow.llm.quality import LEVELS, SIGNALS, Risk

    risk = Risk()
    grid = ", ".join(f"('{s}', {r}, CAST({float(c)} AS DOUBLE))" for s, cs in SIGNALS.items() for r, c in enumerate(cs))
    value = "CASE signal " + " ".join(f"WHEN '{s}' THEN {s}" for s in SIGNALS) + " END"
    over = " OR ".join(f"coalesce({s} > max_{s}, false)" for s in SIGNALS)
    limits = ", ".join(f"min(cutoff) FILTER (signal = '{s}') AS max_{s}" for s in SIGNALS)
    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i:i+2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d WHERE n > 1) GROUP BY doc_id),
m AS MATERIALIZED (SELECT w.doc_id, coalesce(lang, '') AS stratum, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(t) - length(regexp_replace(t, '[^\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
  len(l) AS n_lines, length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!]', '', 'g')) AS n_marks
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
v AS MATERIALIZED (SELECT *, n_words < {risk.min_words} OR 100 * n_repeat_words > {risk.repeat_percent} * n_words AS base_failed,
  n_symbols / greatest(word_chars, 1) AS symbol_rate, n_upper / greatest(word_chars, 1) AS upper_rate, n_repeat_words / greatest(n_words, 1) AS repeat_rate,
  n_dup_lines / greatest(n_lines, 1) AS dup_line_rate, n_marks / greatest(n_words, 1) AS mark_rate FROM m),
grid(signal, rank, cutoff) AS (VALUES {grid}),
known AS (SELECT v.*, q.quality, left(md5(CAST(v.doc_id AS VARCHAR)), 1) < '8' AS holdout FROM v JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IN (0, 1)) q ON q.doc_id = v.doc_id WHERE NOT base_failed),
cells AS (SELECT stratum, signal, rank, cutoff, count(*) FILTER (quality = 1 AND o) AS fg, count(*) FILTER (quality = 1) AS fgn, count(*) FILTER (quality = 0 AND o) AS fb, count(*) FILTER (quality = 0) AS fbn
  FROM (SELECT *, {value} > cutoff AS o FROM known, grid WHERE NOT holdout) GROUP BY ALL),
nom AS (SELECT stratum, signal, cutoff, unnest(range(rank, {LEVELS})) AS level FROM cells WHERE fb * greatest(fgn, 1) > {risk.lift} * fg * greatest(fbn, 1)),
lev AS MATERIALIZED (SELECT stratum, level, {limits} FROM nom GROUP BY 1, 2),
tried AS (SELECT stratum, level, count(*) FILTER ({over}) AS k, count(*) AS n FROM known JOIN lev USING (stratum) WHERE holdout AND quality = 1 GROUP BY 1, 2),
tested AS (SELECT *, k <= {risk.max_rate} * n AND list_sum(list_transform(range(0, CAST(least(k, {risk.max_rate} * n) AS BIGINT) + 1),
  lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk.max_rate}) + (n - j) * ln(1 - {risk.max_rate})))) <= {risk.error} / (SELECT count(DISTINCT stratum) FROM lev) AS passes FROM tried),
seq AS (SELECT *, bool_and(passes) OVER (PARTITION BY stratum ORDER BY level) AS open FROM tested),
lim AS (SELECT lev.* FROM lev JOIN (SELECT stratum, max(level) AS level FROM seq WHERE open GROUP BY 1) USING (stratum, level))
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({over}) AS kept
FROM v LEFT JOIN lim ON lim.stratum = v.stratum
"""


ORACLES |= {"op3_line_dedup": _OP3, "op7_quality_rules": _op7()}

_OP2 = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
reach AS (SELECT a AS node, b AS other FROM l UNION SELECT reach.node, l.b FROM reach JOIN l ON l.a = reach.other),
comp AS (SELECT node, min(least(node, other)) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON comp.node = vec_id
"""

ORACLES |= {"op2_embedding_near_dedup": _OP2}

_OP9 = """
WITH m AS (SELECT conv_id, turn, 4 * turn AS t, role, text, conv_id || '-' || turn AS id FROM conversations), u AS (SELECT * FROM m WHERE role = 'user')
SELECT conv_id, t AS turn, t AS order_turn, 0 AS order_depth, role, '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || to_json(role) || '}' AS message, CAST(0 AS BIGINT) AS n_calls, CAST(NULL AS BOOLEAN) AS linked, '' AS problems FROM m
UNION ALL SELECT conv_id, t + 1, t + 1, 0, 'assistant', '{"content":null,"role":"assistant","tool_calls":[{"function":{"arguments":{"query":' || to_json(text) || ',"turn":' || turn || '},"name":"search"},"id":"' || id || '","type":"function"}]}', 1, true,
  CASE WHEN turn > 4 THEN id || ': $.turn: over maximum' ELSE '' END FROM u
UNION ALL SELECT conv_id, CASE WHEN turn % 3 = 2 THEN t - 1 ELSE t + 2 END, CASE WHEN turn % 3 = 2 THEN t + 1 ELSE t + 2 END, CASE WHEN turn % 3 = 2 THEN 1 ELSE 0 END, 'tool', '{"content":' || to_json(text) || ',"role":"tool","tool_call_id":"' || id || '"}', 0, true, '' FROM u
"""

ORACLES |= {"op9_chat_formatting": _OP9}
