"""DuckDB SQL for the registered queries of the structuring engine."""

from __future__ import annotations

from quireflow import params as P
from quireflow.plans.queries import _ARABIZED, _FURNISHED, _LAYER, _PAGES, _lines_sql

_WORDS = r"len(regexp_extract_all({}, '\S+'))"
_KEY = r"regexp_replace(lower(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), '[^\p{L}\p{N}]+', '', 'g')"
_CHARS = r"length(regexp_replace({}, '\s+', '', 'g'))"
_WM = "|".join(f"(?:{p})" for p in P.WATERMARKS)
_PN = r"^\s*[-–—(\[]?\s*[0-9٠-٩]{1,4}\s*[-–—)\]]?\s*$"

_FLAGS = f"""{_lines_sql(_FURNISHED)},
v AS (SELECT *, row_number() OVER (PARTITION BY book_id, page_no ORDER BY line_no) <= 2 OR row_number() OVER (PARTITION BY book_id, page_no ORDER BY line_no DESC) <= 2 AS edge FROM l WHERE regexp_matches(text, '\\S')),
f AS MATERIALIZED (SELECT *, regexp_matches(text, '(?i){_WM}') AS is_watermark, regexp_matches(text, '{_PN}') AS is_page_number, NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AS is_junk FROM v),
d AS MATERIALIZED (SELECT *, is_watermark OR is_page_number OR is_junk AS dropped, CAST({_CHARS.format('text')} AS BIGINT) AS n FROM f)"""

_COVER = f"""{_FLAGS},
r AS (SELECT book_id, page_no, CAST(coalesce(sum(n) FILTER (NOT dropped), 0) AS BIGINT) AS source_chars, CAST(coalesce(sum(n) FILTER (dropped), 0) AS BIGINT) AS dropped_chars FROM d GROUP BY 1, 2)"""

_LOSSY = f"""{_COVER}, ke AS (SELECT *, row_number() OVER (PARTITION BY book_id, page_no ORDER BY line_no) - 1 AS e FROM d WHERE NOT dropped),
 kept AS (SELECT book_id, page_no, sum(n) AS emitted FROM ke WHERE page_no % 6 <> 2 OR e % 3 <> 0 GROUP BY 1, 2),
 lossy AS (SELECT r.*, CAST(coalesce(emitted, 0) AS BIGINT) AS emitted_chars FROM r LEFT JOIN kept ON kept.book_id = r.book_id AND kept.page_no = r.page_no)"""

_VERDICT = f"""p AS MATERIALIZED ({_PAGES}), r AS MATERIALIZED ({_LAYER}),
m AS MATERIALIZED (SELECT *, {_WORDS.format('raw_text')} AS words, left(raw_text, 4000) AS sample FROM r),
x AS (SELECT book_id, page_no, raw_text, words, {_WORDS.format('sample')} AS sw, len(regexp_extract_all(sample, '(?:^|\\s)ل(?:\\s|$)')) AS lam, len(regexp_extract_all(sample, '[بتثجحخسشصضطظعغفقكمنهي][إأآ]')) AS hamza,
 length(regexp_replace(raw_text, '\\s', '', 'g')) AS seen, len(regexp_extract_all(raw_text, '[\\x{{FFFD}}\\x{{E000}}-\\x{{F8FF}}]')) AS bad FROM m),
c AS MATERIALIZED (SELECT *, sw >= 40 AND (lam / sw > 0.01 OR hamza / sw > 0.02) AS corrupted FROM x),
e AS MATERIALIZED (SELECT *, CASE WHEN seen > 0 AND bad / seen > 0.05 THEN 'glyphs' WHEN corrupted THEN 'ligatures' END AS defect FROM c),
b AS (SELECT book_id, count(*) FILTER (words >= 40) AS n, count(*) FILTER (words >= 40 AND defect IS NOT NULL) AS bad FROM e WHERE length(trim(raw_text)) >= 20 GROUP BY 1),
w AS (SELECT e.book_id, page_no, defect, CASE WHEN n < 3 THEN 'small-sample' WHEN b.bad / n > 0.25 THEN 'rejected' ELSE 'accepted' END AS verdict FROM e JOIN b ON b.book_id = e.book_id WHERE length(trim(raw_text)) >= 20)"""

_RECOGNISED = f"""p AS MATERIALIZED ({_PAGES}), q AS MATERIALIZED (SELECT book_id, page_no, CASE WHEN page_no % 13 = 4 THEN 0 ELSE {_WORDS.format('text')} END AS word_count, CAST(doc_id * 37 % 100 AS DOUBLE) AS mean_conf,
 page_no % 3 = 0 AS allowed, page_no % 2 = 0 AS rescued, CASE WHEN page_no % 4 = 1 THEN 0.5 ELSE 0.9 END AS ratio, CASE WHEN page_no % 10 = 1 THEN true WHEN page_no % 10 < 6 THEN false END AS image_page FROM p),
t AS MATERIALIZED (SELECT *, CASE WHEN allowed THEN 'text-layer' WHEN mean_conf >= 40 AND word_count >= 15 AND ratio >= 0.65 AND NOT coalesce(image_page, false) THEN CASE WHEN rescued THEN 'ocr-rescued' ELSE 'ocr' END
 WHEN image_page THEN 'image-kept' WHEN word_count = 0 AND image_page = false THEN 'blank' ELSE 'image-kept' END AS route FROM q),
z AS MATERIALIZED (SELECT *, CASE WHEN route IN ('text-layer', 'ocr', 'ocr-rescued') THEN '' WHEN image_page THEN 'photo / map (no text)' WHEN word_count = 0 AND image_page = false THEN 'blank page' WHEN word_count = 0 THEN 'no text recovered'
 WHEN mean_conf >= 40 AND word_count >= 15 AND ratio < 0.65 THEN printf('foreign script (%.2f)', ratio) WHEN mean_conf < 40 THEN printf('low confidence %.0f < %.0f', mean_conf, 40.0) ELSE printf('too few words %d < %d', word_count, 15) END AS reason FROM t)"""

_EVERY = f"""{_lines_sql('text')}, k AS (SELECT book_id, page_no, text, CAST(floor((dense_rank() OVER (PARTITION BY book_id ORDER BY page_no) - 1) / 10) AS INTEGER) AS chapter_no FROM l WHERE trim(text) <> '')"""

_GEOMETRY = f"""{_lines_sql('text')}, g AS MATERIALIZED (SELECT book_id, page_no, line_no, text, CAST(greatest(0, 540 - length(text) * 2) AS INTEGER) AS x, CAST(line_no * 22 + floor(line_no / 5) * 10 AS INTEGER) AS y, CAST(least(540, length(text) * 2) AS INTEGER) AS w FROM l WHERE trim(text) <> '')"""

_WORD_ROWS = f"""p AS MATERIALIZED ({_PAGES}), ws AS (SELECT book_id, page_no, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS w FROM p),
i0 AS (SELECT book_id, page_no, unnest(w) AS text, unnest(range(0, len(w))) AS i FROM ws),
wd AS MATERIALIZED (SELECT book_id, page_no, 0 AS block_no, CAST(i // 40 AS INTEGER) AS par_no, CAST((i // 10) % 4 AS INTEGER) AS row_no, i % 10 AS word_no, text, CAST(CASE WHEN i % 13 = 0 THEN -1 ELSE i * 7 % 100 END AS DOUBLE) AS conf,
 CAST(500 - (i % 10) * 50 - CASE WHEN i % 10 >= 5 THEN 80 ELSE 0 END AS INTEGER) AS x, CAST((i // 10) * 20 + i % 3 AS INTEGER) AS y, 40 AS w, CAST(12 + i % 2 AS INTEGER) AS h FROM i0)"""

_HTML = """h AS MATERIALIZED (SELECT regexp_extract(url, '//([^/]*)', 1) AS book_id, CAST(row_number() OVER (PARTITION BY regexp_extract(url, '//([^/]*)', 1) ORDER BY page_id) - 1 AS INTEGER) AS page_no, regexp_extract_all(html, '<(?:h1|p|li)>(?:<[^>]*>)*[^<]+') AS raws FROM pages),
hr AS (SELECT book_id, page_no, unnest(raws) AS raw, CAST(unnest(range(0, len(raws))) AS INTEGER) AS elem_no FROM h),
he AS MATERIALIZED (SELECT * FROM (SELECT book_id, page_no, elem_no, CASE WHEN starts_with(raw, '<h1') THEN 'h1' WHEN starts_with(raw, '<li') THEN 'ul' ELSE 'p' END AS kind, trim(regexp_replace(raw, '<[^>]*>', '', 'g')) AS text FROM hr) WHERE text <> '')"""

_REPEAT = f"""{_lines_sql('text')}, e AS (SELECT *, row_number() OVER (PARTITION BY book_id, page_no ORDER BY line_no) AS a, row_number() OVER (PARTITION BY book_id, page_no ORDER BY line_no DESC) AS z FROM l),
k AS (SELECT book_id, page_no, {_KEY} AS key FROM e WHERE (a <= 2 OR z <= 2) AND length(text) <= 60 AND trim(text) <> ''),
n AS (SELECT book_id, greatest(3, CAST(floor(count(DISTINCT page_no) * 0.1) AS BIGINT)) AS least FROM l GROUP BY 1 HAVING count(DISTINCT page_no) >= 5)"""

_REPORTED = f"""p AS ({_PAGES}), g AS MATERIALIZED (SELECT book_id, page_no, CASE WHEN page_no % 4 = 1 THEN 'image-kept' WHEN page_no % 4 = 2 THEN 'ocr' ELSE 'text-layer' END AS route, concat_ws('; ', CASE WHEN page_no % 3 = 0 THEN 'flat layout' END, CASE WHEN page_no % 5 = 0 THEN 'foreign script' END) AS notes, length(text) AS source_chars, length(text) - page_no % 7 AS emitted_chars FROM p)"""

_GIANTS = f"""{_lines_sql('text')}, e AS MATERIALIZED (SELECT book_id, page_no // 10 AS chapter_no, page_no * 100000 + line_no AS elem_no, length(text) AS weight FROM l WHERE trim(text) <> ''),
 b AS MATERIALIZED (SELECT book_id, chapter_no, CAST(sum(weight) AS DOUBLE) AS total, greatest(2, CAST(round_even(sum(weight) / 25000, 0) AS INTEGER)) AS parts FROM e GROUP BY 1, 2 HAVING sum(weight) > 40000 AND count(*) > 3),
 sg AS MATERIALIZED (SELECT e.book_id, e.chapter_no, elem_no, CAST(weight AS DOUBLE) AS weight, total, parts, row_number() OVER (PARTITION BY e.book_id, e.chapter_no ORDER BY elem_no) AS nth FROM e JOIN b ON b.book_id = e.book_id AND b.chapter_no = e.chapter_no),
 v AS (SELECT book_id, chapter_no, elem_no, nth, weight AS run, total AS rest, parts, 0 AS part_no FROM sg WHERE nth = 1
 UNION ALL SELECT sg.book_id, sg.chapter_no, sg.elem_no, sg.nth, CASE WHEN v.parts > 1 AND run + weight / 2 >= rest / v.parts THEN weight ELSE run + weight END, CASE WHEN v.parts > 1 AND run + weight / 2 >= rest / v.parts THEN rest - run ELSE rest END,
 CASE WHEN v.parts > 1 AND run + weight / 2 >= rest / v.parts THEN v.parts - 1 ELSE v.parts END, CASE WHEN v.parts > 1 AND run + weight / 2 >= rest / v.parts THEN part_no + 1 ELSE part_no END FROM v JOIN sg ON sg.book_id = v.book_id AND sg.chapter_no = v.chapter_no AND sg.nth = v.nth + 1)"""

_NAME = "'text/' || page_no || '.xhtml'"

ORACLES: dict[str, str] = {
    "line_explode": f"WITH {_lines_sql('text')} SELECT book_id, page_no, line_no, text FROM l WHERE regexp_matches(text, '\\S')",
    "line_drop_flags": f"WITH {_FLAGS} SELECT book_id, page_no, line_no, edge, is_watermark, is_page_number, is_junk, dropped FROM d",
    "char_coverage_by_page": f"WITH {_LOSSY} SELECT book_id, page_no, source_chars, dropped_chars, emitted_chars, CASE WHEN source_chars > 0 THEN round_even(emitted_chars / source_chars, 3) ELSE 1.0 END AS coverage FROM lossy",
    "book_coverage": f"WITH {_LOSSY} SELECT book_id, CASE WHEN sum(source_chars) > 0 THEN sum(emitted_chars) / sum(source_chars) ELSE 1.0 END AS coverage, CAST(sum(source_chars) AS BIGINT) AS source_chars, CAST(sum(emitted_chars) AS BIGINT) AS emitted_chars, count(*) AS pages FROM lossy GROUP BY 1",
    "coverage_warnings": f"""WITH {_COVER}, k AS (SELECT *, row_number() OVER (PARTITION BY book_id, page_no ORDER BY line_no) - 1 AS e FROM d WHERE NOT dropped),
 em AS (SELECT book_id, page_no, sum(n) AS emitted FROM k WHERE page_no % 4 <> 0 OR e % 2 = 0 GROUP BY 1, 2),
 pr AS (SELECT r.*, coalesce(emitted, 0) AS emitted, CASE WHEN source_chars > 0 THEN round_even(coalesce(emitted, 0) / source_chars, 3) ELSE 1.0 END AS coverage FROM r LEFT JOIN em ON em.book_id = r.book_id AND em.page_no = r.page_no),
 bk AS (SELECT book_id, sum(emitted) / sum(source_chars) AS c FROM pr GROUP BY 1 HAVING sum(source_chars) > 0),
 low AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_no) AS nth FROM pr WHERE source_chars >= 40 AND coverage < 0.8)
 SELECT book_id, 0 AS nth, 'book' AS kind, CAST(NULL AS INTEGER) AS page_no, CAST(round_even(c * 100, 0) AS BIGINT) AS percent FROM bk WHERE c < 0.95
 UNION ALL SELECT book_id, CAST(nth AS INTEGER), 'page', page_no, CAST(round_even(coverage * 100, 0) AS BIGINT) FROM low WHERE nth <= 10
 UNION ALL SELECT book_id, 11, 'more', NULL, count(*) - 10 FROM low GROUP BY 1 HAVING count(*) > 10""",
    "repeated_edges_exact": f"WITH {_REPEAT}, c AS (SELECT book_id, key, count(DISTINCT page_no) AS pages FROM k WHERE length(key) >= 4 GROUP BY 1, 2) SELECT c.book_id, key, pages FROM c JOIN n ON n.book_id = c.book_id WHERE pages >= least",
    "script_ratios": f"""WITH p AS ({_PAGES}), t AS (SELECT book_id, page_no, CASE WHEN page_no % 2 = 0 THEN {_ARABIZED} ELSE text END || CASE WHEN page_no % 7 = 0 THEN repeat(chr(57345), 100) ELSE '' END AS t FROM p),
 c AS (SELECT book_id, page_no, len(regexp_extract_all(t, '\\p{{L}}')) AS letters, len(regexp_extract_all(t, '[\\x{{0621}}-\\x{{063A}}\\x{{0641}}-\\x{{064A}}]')) AS arabic, length(regexp_replace(t, '\\s', '', 'g')) AS seen, len(regexp_extract_all(t, '[\\x{{FFFD}}\\x{{E000}}-\\x{{F8FF}}]')) AS bad FROM t)
 SELECT book_id, page_no, CASE WHEN letters > 0 THEN arabic / letters ELSE 0.0 END AS arabic_ratio, CASE WHEN seen > 0 THEN bad / seen ELSE 0.0 END AS bad_glyph_ratio FROM c""",
    "corrupted_flag": f"WITH {_VERDICT} SELECT book_id, page_no, corrupted, defect FROM e",
    "text_layer_verdict": f"WITH {_VERDICT} SELECT book_id, page_no, defect, verdict, defect IS NULL AND verdict <> 'rejected' AS allowed FROM w",
    "page_routes": f"WITH {_RECOGNISED} SELECT book_id, page_no, route, reason FROM z",
    "route_counts": f"WITH {_RECOGNISED} SELECT book_id, route, count(*) AS pages FROM z GROUP BY 1, 2",
    "run_summary": f"WITH {_RECOGNISED} SELECT book_id, count(*) AS pages, CAST(sum(word_count) AS BIGINT) AS words, avg(mean_conf) AS mean_conf FROM q GROUP BY 1",
    "rescue_candidates": f"WITH {_RECOGNISED} SELECT book_id, page_no, mean_conf FROM q WHERE NOT allowed AND mean_conf < 55",
    "inspected_books": f"""WITH p AS MATERIALIZED ({_PAGES}), r AS MATERIALIZED ({_LAYER}), c AS (SELECT book_id, max(page_no) + 1 AS n FROM r GROUP BY 1), s AS (SELECT r.*, row_number() OVER (PARTITION BY r.book_id ORDER BY page_no) AS nth FROM r JOIN c ON c.book_id = r.book_id WHERE page_no IN (0, 2, 5, n // 2, n - 1))
 SELECT book_id, avg(length(regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g'))) AS avg_chars, count(*) FILTER (length(trim(raw_text)) >= 20) AS with_text, count(*) AS sampled FROM s WHERE nth <= 5 GROUP BY 1""",
    "stage_anti": f"WITH p AS ({_PAGES}) SELECT book_id, page_no FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    "modal_size": f"""WITH {_lines_sql('text')}, sz AS (SELECT book_id, page_no, line_no, round_even(length(text) % 9 + 0.5, 0) AS b FROM l WHERE regexp_matches(text, '\\S')), c AS (SELECT book_id, b, count(*) AS n, min(page_no * 1000000 + line_no) AS f FROM sz GROUP BY 1, 2)
 SELECT book_id, CAST(b AS DOUBLE) AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""",
    "paragraph_segments": f"""WITH {_GEOMETRY}, q AS (SELECT *, lag(y + 12) OVER o AS b, lag(text) OVER o AS pt, lag(w) OVER o AS pw, max(x + w) OVER pg AS r, min(x) OVER pg AS lf FROM g WINDOW o AS (PARTITION BY book_id, page_no ORDER BY line_no), pg AS (PARTITION BY book_id, page_no)),
 m AS (SELECT *, CASE WHEN b IS NOT NULL THEN greatest(0, y - b) END AS gap FROM q), mm AS (SELECT book_id, page_no, coalesce(median(gap), 0) AS gm FROM m GROUP BY 1, 2),
 f AS (SELECT m.*, CASE WHEN pt IS NULL OR (gm > 0 AND gap > 1.8 * gm) OR ((r - (x + w)) > 14.4 AND (regexp_matches(rtrim(pt), '[.؟!:»۔]$') OR pw < 0.7 * (r - lf))) OR (regexp_matches(rtrim(pt), '[.؟!:»۔]$') AND pw < 0.7 * (r - lf)) THEN 1 ELSE 0 END AS o FROM m JOIN mm ON mm.book_id = m.book_id AND mm.page_no = m.page_no),
 ps AS (SELECT *, sum(o) OVER (PARTITION BY book_id, page_no ORDER BY line_no) AS par FROM f)
 SELECT book_id, page_no, min(line_no) AS line_no, regexp_replace(string_agg(trim(text), '␞' ORDER BY line_no), '␞', ' ', 'g') AS text FROM ps GROUP BY book_id, page_no, par""",
    "list_islands": f"""WITH {_lines_sql(_FURNISHED)}, i AS (SELECT *, regexp_matches(text, '^\\s*[0-9٠-٩]{{1,3}}\\s*[.)\\-]\\s+\\S') AS ol, regexp_matches(text, '^\\s*[•‣◦·∙*●▪]\\s+\\S') AS ul FROM l),
 r AS (SELECT *, sum(CASE WHEN ol OR ul THEN 0 ELSE 1 END) OVER (PARTITION BY book_id, page_no ORDER BY line_no) AS run FROM i), c AS (SELECT *, count(*) FILTER (ol OR ul) OVER (PARTITION BY book_id, page_no, run) AS n FROM r)
 SELECT book_id, page_no, line_no, CASE WHEN ol THEN 'ol' ELSE 'ul' END AS kind, regexp_extract(text, '^\\s*(?:[0-9٠-٩]{{1,3}}\\s*[.)\\-]|[•‣◦·∙*●▪])\\s+(\\S.*)$', 1) AS item FROM c WHERE (ol OR ul) AND n >= 2""",
    "verse_islands": f"""WITH p AS ({_PAGES}), s AS (SELECT book_id, page_no, flatten(list_transform(list_filter(regexp_split_to_array({_ARABIZED}, '[.\\n]'), lambda x: trim(x) <> ''), lambda x: list_transform(range(0, (len(regexp_split_to_array(trim(x), ' +')) + 6) // 7), lambda i: array_to_string(regexp_split_to_array(trim(x), ' +')[i * 7 + 1:i * 7 + 7], ' ')))) AS v FROM p),
 x AS (SELECT book_id, page_no, unnest(v) AS text, CAST(unnest(range(0, len(v))) AS INTEGER) AS line_no FROM s), t AS (SELECT book_id, page_no, line_no, text || CASE WHEN page_no % 3 = 0 THEN ' سلوان' ELSE '' END AS text FROM x),
 c AS (SELECT *, {_WORDS.format('text')} BETWEEN 3 AND 16 AND NOT regexp_matches(trim(text), '[.؟!:»۔]$') AS cand, regexp_replace(text, '[^\\x{{0621}}-\\x{{064A}}]+$', '') AS bare FROM t),
 r AS (SELECT *, sum(CASE WHEN cand THEN 0 ELSE 1 END) OVER (PARTITION BY book_id, page_no ORDER BY line_no) AS run, CASE WHEN length(bare) >= 2 THEN right(bare, 2) END AS rhyme FROM c),
 k AS (SELECT * FROM r WHERE cand), n AS (SELECT *, count(*) OVER (PARTITION BY book_id, page_no, run) AS size, CASE WHEN rhyme IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY book_id, page_no, run, rhyme) END AS same FROM k),
 m AS (SELECT *, max(same) OVER (PARTITION BY book_id, page_no, run) AS top FROM n)
 SELECT book_id, page_no, line_no FROM m WHERE size >= 4 AND top >= greatest(4, round_even(0.7 * size, 0))""",
    "boundary_merge": f"""WITH RECURSIVE p AS MATERIALIZED ({_PAGES}), s AS (SELECT book_id, page_no, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: CASE WHEN page_no % 6 = 5 THEN x ELSE regexp_replace(x, '[.!:]+$', '') END) AS t FROM p),
 q AS MATERIALIZED (SELECT book_id, page_no, page_no % 17 = 16 AS img, CASE WHEN len(t) = 0 THEN [] WHEN page_no % 3 = 1 AND len(t) > 1 THEN [t[1], array_to_string(t[2:], ' ')] ELSE [array_to_string(t, ' ')] END AS t FROM s),
 j AS MATERIALIZED (SELECT *, len(t) = 1 AS single, coalesce(NOT img AND NOT lag(img) OVER o AND len(t) > 0 AND len(lag(t) OVER o) > 0 AND regexp_matches(rtrim((lag(t) OVER o)[-1]), '[^.؟!:»۔]$'), false) AS c FROM q WINDOW o AS (PARTITION BY book_id ORDER BY page_no)),
 w AS (SELECT book_id, page_no, c AS m, single FROM j WHERE page_no = 0 UNION ALL SELECT j.book_id, j.page_no, j.c AND NOT (w.single AND w.m), j.single FROM w JOIN j ON j.book_id = w.book_id AND j.page_no = w.page_no + 1),
 e AS (SELECT j.book_id, j.page_no, j.t, w.m, lead(w.m) OVER o AS nm, (lead(j.t) OVER o)[1] AS nt FROM j JOIN w ON w.book_id = j.book_id AND w.page_no = j.page_no WINDOW o AS (PARTITION BY j.book_id ORDER BY j.page_no)),
 u AS (SELECT book_id, page_no, m, nm, nt, len(t) AS n, unnest(t) AS text, CAST(unnest(range(0, len(t))) AS INTEGER) AS elem_no FROM e)
 SELECT book_id, page_no, elem_no, 'p' AS kind, CASE WHEN nm AND elem_no = n - 1 THEN rtrim(text) || ' ' || ltrim(nt) ELSE text END AS text FROM u WHERE NOT (m AND elem_no = 0)""",
    "html_elements": f"WITH {_HTML} SELECT book_id, page_no, elem_no, kind, text FROM he",
    "markdown_emit": f"""WITH {_HTML}, x AS (SELECT *, replace(text, '[^', chr(92) || '[^') AS t FROM he), y AS (SELECT *, CASE kind WHEN 'h1' THEN '# ' || t WHEN 'ul' THEN '- ' || t ELSE CASE WHEN regexp_matches(t, '^(#{{1,6}}\\s|[-*•‣◦·∙●▪٭]\\s|[0-9٠-٩]{{1,3}}\\s*[.)\\-]\\s|:::|<!--|!\\[|\\[\\^|\\\\)') THEN chr(92) || t ELSE t END END AS md FROM x)
 SELECT book_id, page_no, '<!-- page:' || page_no || ' -->' || chr(10) || string_agg(md, chr(10) ORDER BY elem_no) AS markdown FROM y GROUP BY 1, 2""",
    "markdown_roundtrip": f"WITH {_HTML} SELECT book_id, page_no, CAST(row_number() OVER (PARTITION BY book_id, page_no ORDER BY elem_no) - 1 AS INTEGER) AS elem_no, kind, text FROM he",
    "markdown_parse": f"WITH {_HTML} SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page_no, elem_no) - 1 AS INTEGER) AS item_no, page_no, kind, text, '' AS note_id FROM he",
    "front_matter": """WITH t AS (SELECT doc_id, doc_id % 5 = 0 AS open, coalesce(text, '') AS t FROM documents)
 SELECT doc_id, CASE WHEN NOT open THEN 'book ' || doc_id END AS title, CASE WHEN NOT open THEN 'someone' END AS author, CAST(CASE WHEN open THEN length('---' || chr(10) || 'Title: book ' || doc_id || chr(10) || 'author: ''someone''' || chr(10) || t) ELSE length(t) END AS INTEGER) AS body_chars FROM t""",
    "chapters_every_n": f"WITH {_EVERY} SELECT book_id, chapter_no, 'فصل ' || (chapter_no + 1) AS title, CAST(sum(length(text)) AS BIGINT) AS weight, count(*) AS n_elements FROM k GROUP BY 1, 2",
    "footnote_relocate": f"""WITH p AS ({_PAGES}), m AS (SELECT book_id, max(page_no) AS last FROM p GROUP BY 1),
 n AS (SELECT p.book_id, page_no, CASE WHEN page_no % 3 = 0 THEN page_no ELSE page_no - 1 END AS cited FROM p), h AS (SELECT *, CASE WHEN cited BETWEEN 0 AND page_no THEN cited ELSE page_no END AS home FROM n),
 a AS (SELECT book_id, page_no AS chapter_no, 0 AS o, page_no AS s, 'h1' AS kind, '' AS note_id FROM p UNION ALL SELECT book_id, page_no, 1, page_no, 'p', '' FROM p UNION ALL SELECT book_id, home, CASE WHEN home = page_no THEN 2 ELSE 3 END, page_no, 'footnote', 'n' || cited FROM h)
 SELECT book_id, chapter_no, CAST(row_number() OVER (PARTITION BY book_id, chapter_no ORDER BY o, s) - 1 AS INTEGER) AS elem_no, kind, note_id FROM a""",
    "references": f"""WITH p AS ({_PAGES}), r AS (SELECT book_id, page_no AS chapter_no, unnest([0, 1, 2]) AS pos, page_no FROM p)
 SELECT book_id, chapter_no, 1 AS elem_no, pos, CASE WHEN pos = 2 THEN 'x' ELSE 'n' || page_no END AS note_id, pos < 2 AND page_no % 3 = 0 AS resolved, pos <> 1 AS is_first FROM r""",
    "note_numbers": f"""WITH p AS ({_PAGES}), n AS (SELECT book_id, page_no // 5 AS chapter_no, page_no * 10 + 2 AS elem_no, 'n' || CASE WHEN page_no % 3 = 0 THEN page_no ELSE page_no - 1 END AS note_id FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY book_id, chapter_no ORDER BY elem_no) AS number FROM n)
 SELECT book_id, CAST(chapter_no AS INTEGER) AS chapter_no, elem_no, note_id, CAST(number AS INTEGER) AS number, translate(CAST(number AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') AS shown FROM k""",
    "manifest_integrity": f"""WITH p AS MATERIALIZED ({_PAGES}), m AS (SELECT book_id, 'c' || CASE WHEN page_no % 20 = 19 THEN page_no - 1 ELSE page_no END AS item_id, {_NAME} AS href FROM p), f AS (SELECT book_id, {_NAME} AS name FROM p WHERE page_no % 6 <> 5)
 SELECT book_id, 'missing-file' AS problem, href AS ref FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.book_id = m.book_id AND f.name = m.href)
 UNION ALL SELECT book_id, 'missing-item', 'c' || page_no FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.book_id = p.book_id AND m.item_id = 'c' || p.page_no)
 UNION ALL SELECT book_id, 'broken-link', 'text/' || (page_no + 1) || '.xhtml#top' FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.book_id = p.book_id AND f.name = 'text/' || (p.page_no + 1) || '.xhtml')
 UNION ALL SELECT book_id, 'duplicate-id', item_id FROM m GROUP BY book_id, item_id HAVING count(*) > 1""",
    "missing_scans": f"""WITH p AS ({_PAGES}), g AS (SELECT book_id, 'scans/page_' || lpad(CAST(page_no AS VARCHAR), 4, '0') || '.jpg' AS path FROM p WHERE page_no % 3 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY path) AS nth FROM g) SELECT book_id, path, CAST(nth AS INTEGER) AS nth FROM n WHERE nth <= 10""",
    "covers": f"WITH p AS ({_PAGES}) SELECT book_id, min(page_no) AS page_no FROM p WHERE page_no > 0 AND doc_id % 2 = 0 GROUP BY 1 HAVING min(page_no) <= 1",
    "toc_pages": f"WITH p AS ({_PAGES}) SELECT book_id, page_no FROM p WHERE page_no % 20 = 0",
    "ocr_lines": f"""WITH {_WORD_ROWS}, g AS (SELECT book_id, page_no, par_no, row_no, string_agg(text, ' ' ORDER BY word_no) AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, coalesce(avg(conf) FILTER (conf >= 0), 0) AS conf FROM wd GROUP BY 1, 2, 3, 4)
 SELECT book_id, page_no, CAST(row_number() OVER (PARTITION BY book_id, page_no ORDER BY par_no, row_no) - 1 AS INTEGER) AS line_no, text, x, y, w, h, conf FROM g""",
    "ocr_confidence": f"WITH {_WORD_ROWS} SELECT book_id, page_no, coalesce(avg(conf) FILTER (conf >= 0), 0) AS mean_conf, count(*) AS word_count FROM wd GROUP BY 1, 2",
    "reading_order": f"""WITH {_WORD_ROWS}, o AS (SELECT book_id, page_no, x, row_number() OVER (PARTITION BY book_id, page_no ORDER BY y, x DESC) - 1 AS n FROM wd) SELECT book_id, page_no, CAST(max(n) AS INTEGER) AS last_line, arg_max(x, n) AS last_x FROM o GROUP BY 1, 2""",
    "boxed_chars": f"""WITH {_WORD_ROWS}, c AS MATERIALIZED (SELECT * FROM wd), r AS (SELECT book_id, page_no, par_no * 4 + row_no AS rect_no, min(x) AS rx, min(y) AS ry, max(x + 40) - min(x) AS rw FROM c GROUP BY book_id, page_no, par_no, row_no)
 SELECT c.book_id, c.page_no, rect_no, median(CAST(h AS DOUBLE)) AS size, avg(CASE WHEN word_no % 3 = 0 THEN 1.0 ELSE 0.0 END) AS bold FROM c JOIN r ON r.book_id = c.book_id AND r.page_no = c.page_no AND x + 2 BETWEEN rx AND rx + rw AND y + 4 BETWEEN ry AND ry + 15 GROUP BY 1, 2, 3""",
    "joined_lines": r"""SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(string_split(replace(text, 'e ', 'e-' || chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> ''), '␞'), '([A-Za-z])[-‐‑]␞([a-z])', '\1\2', 'g'), '␞', ' ', 'g') AS text FROM documents""",
    "device_pages": f"""WITH p AS ({_PAGES}), d(i, key, width, height) AS (VALUES {', '.join(f"({i}, '{k}', {w}, {h})" for i, (k, _, w, h, _) in enumerate(P.DEVICES))}) SELECT key, width, height, count(*) AS pages FROM p JOIN d ON i = page_no % 5 GROUP BY 1, 2, 3""",
    "heading_tiers": f"""WITH {_lines_sql('text')}, t AS (SELECT book_id, page_no, line_no, CASE WHEN length(text) < 25 THEN 'h1' WHEN length(text) < 35 THEN 'h2' ELSE 'h3' END AS tier, length(text) < 45 AND line_no % 3 <> 0 OR page_no % 4 = 0 AS heads FROM l WHERE trim(text) <> '' AND {_WORDS.format('text')} BETWEEN 1 AND 8)
 SELECT book_id, page_no, line_no, tier FROM t WHERE heads""",
    "footnote_split": f"""WITH p AS ({_PAGES}), o AS (SELECT *, unnest([1, 2]) AS ordinal FROM p)
 SELECT book_id, page_no, ordinal, CAST(ordinal AS VARCHAR) AS label, CASE ordinal WHEN 1 THEN 'first source continued below' ELSE 'second source' END AS text, 'p' || (page_no + 1) || '-' || ordinal AS note_id FROM o""",
    "footnote_refs": f"""WITH p AS ({_PAGES}), n AS (SELECT *, CAST(len(string_split(text, chr(10))) AS INTEGER) AS last FROM p)
 SELECT book_id, page_no, last AS elem_no, 'p' AS kind, CASE WHEN page_no % 2 = 0 THEN 'as said [^p' || (page_no + 1) || '-1] and [^p' || (page_no + 1) || '-2] there' ELSE 'as said (1) and (1) there' END AS text, CAST(NULL AS VARCHAR) AS note_id FROM n
 UNION ALL SELECT book_id, page_no, last + 1, 'footnote', 'first source continued below', 'p' || (page_no + 1) || '-1' FROM n
 UNION ALL SELECT book_id, page_no, last + 2, 'footnote', 'second source', 'p' || (page_no + 1) || '-2' FROM n""",
    "layer_reasons": f"""WITH {_VERDICT}, q AS MATERIALIZED{_RECOGNISED.split(", q AS MATERIALIZED", 1)[1]},
 y AS (SELECT book_id, page_no, coalesce(defect, verdict) AS why FROM w WHERE defect IS NOT NULL OR verdict = 'rejected')
 SELECT z.book_id, z.page_no, route, CASE WHEN why IS NOT NULL AND route <> 'text-layer' THEN concat_ws('; ', why, nullif(reason, '')) ELSE reason END AS reason FROM z LEFT JOIN y ON y.book_id = z.book_id AND y.page_no = z.page_no""",
    "volume_chunks": f"""WITH RECURSIVE {_EVERY}, c AS MATERIALIZED (SELECT book_id, chapter_no, CAST(sum(length(text)) AS DOUBLE) AS weight, sum(CAST(sum(length(text)) AS DOUBLE)) OVER (PARTITION BY book_id) AS total FROM k GROUP BY 1, 2),
 v AS (SELECT book_id, chapter_no, weight AS run, total AS rest, 3 AS parts, 0 AS volume_no FROM c WHERE chapter_no = 0
 UNION ALL SELECT c.book_id, c.chapter_no, CASE WHEN parts > 1 AND run + weight / 2 >= rest / parts THEN weight ELSE run + weight END, CASE WHEN parts > 1 AND run + weight / 2 >= rest / parts THEN rest - run ELSE rest END,
 CASE WHEN parts > 1 AND run + weight / 2 >= rest / parts THEN parts - 1 ELSE parts END, CASE WHEN parts > 1 AND run + weight / 2 >= rest / parts THEN volume_no + 1 ELSE volume_no END FROM v JOIN c ON c.book_id = v.book_id AND c.chapter_no = v.chapter_no + 1)
 SELECT book_id, chapter_no, volume_no FROM v""",
    "selected_pages": f"WITH p AS ({_PAGES}) SELECT book_id, page_no FROM p WHERE page_no < 6 OR page_no = 8",
    "degraded_pages": f"WITH {_REPORTED}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page_no) AS INTEGER) AS nth FROM g WHERE notes <> '') SELECT book_id, page_no, nth, notes FROM n WHERE nth <= 5",
    "console_report": f"""WITH {_REPORTED}, c AS (SELECT book_id, sum(source_chars) AS s, sum(emitted_chars) AS e, count(*) AS n FROM g WHERE route IN ('text-layer', 'ocr') GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_no) AS nth FROM g WHERE notes <> '')
 SELECT book_id, 0 AS line_no, printf('coverage %.2f over %d pages', CASE WHEN s > 0 THEN e / s ELSE 1.0 END, n) AS line FROM c UNION ALL SELECT book_id, 1, route || ': ' || count(*) FROM g GROUP BY book_id, route
 UNION ALL SELECT book_id, CAST(nth + 1 AS INTEGER), 'page ' || (page_no + 1) || ': ' || notes FROM n WHERE nth <= 5""",
    "recognised_pages": f"""WITH {_WORD_ROWS}, g AS (SELECT book_id, page_no, par_no * 4 + row_no AS o, string_agg(text, ' ' ORDER BY word_no) AS text, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, coalesce(avg(conf) FILTER (conf >= 0), 0) AS conf FROM wd GROUP BY 1, 2, 3)
 SELECT book_id, page_no, CAST(row_number() OVER (PARTITION BY book_id, page_no ORDER BY o) - 1 AS INTEGER) AS line_no, text, x, y, w, h, conf FROM g""",
    "giant_split": f"WITH RECURSIVE {_GIANTS} SELECT book_id, chapter_no, elem_no, coalesce(part_no, 0) AS part_no FROM e LEFT JOIN v USING (book_id, chapter_no, elem_no)",
    "giant_titles": f"""WITH RECURSIVE {_GIANTS}, n AS (SELECT book_id, chapter_no, coalesce(part_no, 0) AS part_no, sum(weight) AS weight, count(*) AS n_elements FROM e LEFT JOIN v USING (book_id, chapter_no, elem_no) GROUP BY ALL)
 SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY chapter_no, part_no) - 1 AS INTEGER) AS chapter_no, 'part ' || chapter_no || CASE WHEN part_no > 0 THEN ' (' || (part_no + 1) || ')' ELSE '' END AS title, CAST(weight AS BIGINT) AS weight, n_elements FROM n""",
    "hemistichs": f"""WITH {_WORD_ROWS}, o AS (SELECT *, par_no * 4 + row_no AS line_no, lead(x) OVER k - (x + w) AS gap, row_number() OVER k AS nth FROM wd WINDOW k AS (PARTITION BY book_id, page_no, par_no, row_no ORDER BY x, word_no)),
 b AS (SELECT book_id, page_no, line_no, count(*) AS n, min(x) AS l, arg_max(x + w, nth) AS r, max(coalesce(gap, 0)) AS gap FROM o GROUP BY ALL), m AS (SELECT b.*, min(nth) AS cut, arg_min(x + w, nth) AS edge FROM o JOIN b USING (book_id, page_no, line_no) WHERE o.gap = b.gap GROUP BY ALL),
 ok AS (SELECT * FROM m WHERE n >= 4 AND gap > 0 AND gap >= 0.12 * greatest(1, r - l) AND (edge + gap / 2 - l) / greatest(1, r - l) BETWEEN 0.3 AND 0.7)
 SELECT book_id, page_no, line_no, string_agg(text, ' ' ORDER BY nth) FILTER (nth > cut) AS first, string_agg(text, ' ' ORDER BY nth) FILTER (nth <= cut) AS second FROM o JOIN ok USING (book_id, page_no, line_no) GROUP BY ALL""",
    "scalar_texts": rf"""WITH t AS (SELECT *, replace(coalesce(text, ''), chr(10), ' ') AS line FROM documents)
 SELECT doc_id, regexp_replace(lower(line), '[^\p{{L}}\p{{N}}]+', '', 'g') AS key, CAST(length(regexp_replace(text, '\s+', '', 'g')) AS BIGINT) AS chars,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace('12 - ' || line || ' |_ ', '[''"`*_|<>}}{{\\]+', ' ', 'g'), '^[\s0-9\-–—.,:;)(]+', ''), '\s+', ' ', 'g'), '^[ \-–—]+|[ \-–—]+$', '', 'g') AS heading,
 translate(CAST(doc_id AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') AS digits, source AS title, coalesce(lang, 'und') AS tag, '&lt;&amp;&gt;' || lang AS xml, CASE WHEN doc_id % 2 = 0 THEN source ELSE source || ' - ' || (doc_id % 3 + 1) END AS volume, left(sha256(source), 16) AS hash FROM t""",
    "chapters_by_heading": rf"""WITH {_HTML}, i AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page_no, elem_no) AS no, count(*) FILTER (kind = 'h1') OVER (PARTITION BY book_id) >= 2 AND kind = 'h1' AS b, count(*) FILTER (kind = 'h1') OVER (PARTITION BY book_id) >= 2 AS by_head FROM he),
 o AS (SELECT *, b AND NOT coalesce(lag(b) OVER w, false) AS opens, dense_rank() OVER (PARTITION BY book_id ORDER BY page_no) - 1 AS grp, sum(CASE WHEN b THEN 0 ELSE 1 END) OVER w AS run FROM i WINDOW w AS (PARTITION BY book_id ORDER BY no)),
 c AS (SELECT *, CASE WHEN by_head THEN sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY no) ELSE grp // 10 END AS raw FROM o),
 hd AS (SELECT book_id, run, string_agg(text, ' ' ORDER BY no) AS merged FROM c WHERE b GROUP BY 1, 2),
 e AS (SELECT c.book_id, raw, opens, CASE WHEN opens THEN merged ELSE text END AS text FROM c LEFT JOIN hd ON hd.book_id = c.book_id AND hd.run = c.run AND c.opens WHERE NOT b OR opens),
 k AS (SELECT book_id, raw, max(text) FILTER (opens) AS head, CAST(sum(length(text)) AS BIGINT) AS weight, count(*) AS n_elements FROM e GROUP BY 1, 2),
 n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY raw) AS nth, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(head, '[''"`*_|<>}}{{\\]+', ' ', 'g'), '^[\s0-9\-–—.,:;)(]+', ''), '\s+', ' ', 'g'), '^[ \-–—]+|[ \-–—]+$', '', 'g')) AS clean FROM k)
 SELECT book_id, CAST(nth - 1 AS INTEGER) AS chapter_no, coalesce(nullif(coalesce(nullif(clean, ''), head), ''), 'فصل ' || nth) AS title, weight, n_elements FROM n""",
    "context_window": rf"""WITH {_lines_sql('text')}, x AS (SELECT book_id, page_no, line_no * 2 AS line_no, CASE WHEN line_no % 5 = 1 THEN '«' || text || '»' ELSE text END AS text FROM l WHERE trim(text) <> '' UNION ALL
 SELECT book_id, page_no, line_no * 2 + 1, CASE WHEN line_no % 5 = 0 THEN 'قال تعالى' ELSE 'سورة البقرة' END FROM l WHERE trim(text) <> '' AND line_no % 5 IN (0, 3)),
 q AS (SELECT *, lag(text) OVER w AS p, lead(text) OVER w AS n, row_number() OVER w - 1 AS elem_no FROM x WINDOW w AS (PARTITION BY book_id, page_no ORDER BY line_no)),
 m AS (SELECT *, regexp_matches(concat_ws(' ', p, text, n), 'قال\s+تعالى|سورة\s+\S+') AND regexp_matches(text, '[«﴿][^«»﴾﴿]{{8,400}}[»﴾]') AS quoted, coalesce(n = 'سورة البقرة', false) AS named FROM q)
 SELECT book_id, page_no, CAST(elem_no AS INTEGER) AS elem_no, CASE WHEN named OR quoted THEN 'quran' ELSE 'p' END AS kind, CASE WHEN named THEN '﴿' || trim(regexp_replace(regexp_replace(trim(regexp_replace(trim(text), '^[«»*]+|[«»*]+$', '', 'g')), '[«»]', ' ', 'g'), '\s+', ' ', 'g')) || '﴾' WHEN quoted THEN regexp_replace(text, '[«﴿][ *]*([^«»﴾﴿]*?)[ *]*[»﴾]', '﴿\1﴾', 'g') ELSE text END AS text FROM m""",
    "pdf_text_lines": """WITH s AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ls FROM documents WHERE doc_id % 10 <> 9),
 x AS (SELECT doc_id, unnest(ls) AS t, unnest(range(0, len(ls))) AS i FROM s)
 SELECT CAST(doc_id AS VARCHAR) AS book_id, 0 AS page_no, CAST(i AS INTEGER) AS line_no, trim(t) AS text, CAST(20 + 5 * (length(t) - length(ltrim(t))) AS INTEGER) AS x, CAST(5 * length(trim(t)) AS INTEGER) AS w, CAST(10 AS DOUBLE) AS size, CAST(0 AS DOUBLE) AS bold FROM x""",
    "pdf_file_table": """WITH s AS (SELECT doc_id, list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x)) AS ls, doc_id % 10 = 9 AS broken FROM documents)
 SELECT CAST(doc_id AS VARCHAR) AS book_id, CASE WHEN NOT broken THEN 1 END AS n_pages, CASE WHEN NOT broken THEN 'document ' || doc_id END AS title, CAST(0 AS BIGINT) AS degraded, CASE WHEN broken THEN 'malformed' END AS error, CASE WHEN NOT broken THEN CAST(length(array_to_string(ls, chr(10))) AS INTEGER) END AS n_chars, CASE WHEN NOT broken THEN CAST(14 * len(ls) + 40 AS INTEGER) END AS page_h FROM s""",
    "image_measures": f"""WITH p AS ({_PAGES}), s AS (SELECT book_id, page_no, list_transform(string_split(text, chr(10)), lambda x: least(120, length(x))) AS n FROM p), z AS (SELECT *, 12 * len(n) + 24 AS height, page_no % 11 = 10 AS dark, list_max(n) > 0 AS inked, 5 * list_sum(n) / (160.0 * (12 * len(n) + 24)) AS share FROM s),
 f AS (SELECT *, least(120 / 160, 100 / height) AS factor FROM z)
 SELECT book_id, page_no, 160 AS width, CAST(height AS INTEGER) AS height, CASE WHEN dark THEN 7 ELSE 30 END AS level, CAST(0 AS DOUBLE) AS skew, 5 AS line_height, dark OR share > 0.45 AS picture, CAST(floor(160 * factor) AS INTEGER) AS fit_w, CAST(floor(height * factor) AS INTEGER) AS fit_h FROM f""",
}
