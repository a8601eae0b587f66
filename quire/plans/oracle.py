"""DuckDB SQL for the engine's queries, over the same derived tables."""

from __future__ import annotations

from quire.functions import patterns as P
from quire.operators.epub import RULES

WS = r"trim(regexp_replace({0}, '[ \t\r\f\v]+', ' ', 'g'))"


def ws(x: str) -> str:
    return WS.format(x)


SLOTS = """slots AS (
  SELECT doc_id, source, raw, line_no, ((doc_id*31 + line_no*17) % 16)::INT AS h, line_no // 12 + 1 AS page, line_no % 12 + 1 AS slot
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents))"""

LINES = f"""{SLOTS}, body AS (
  SELECT doc_id, page, slot AS ord, {ws('''CASE h WHEN 0 THEN lpad((line_no % 999 + 1)::VARCHAR, 3, '0') || '. ' || raw WHEN 1 THEN 'a) ' || raw WHEN 2 THEN 'II – ' || raw WHEN 3 THEN '• ' || raw
    WHEN 4 THEN '− ' || raw WHEN 5 THEN 'Art. 5º ' || raw WHEN 6 THEN 'Obs.: ' || raw WHEN 7 THEN 'Letra b.' WHEN 15 THEN '§ 1º ' || raw ELSE raw END''')} AS text,
    CASE WHEN h IN (10,13) THEN 68.0::DOUBLE ELSE 48.0::DOUBLE END AS x0, 60.0::DOUBLE + (slot-1)*18.0::DOUBLE + CASE WHEN h = 12 THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END AS y0,
    CASE WHEN h = 9 THEN 20.0::DOUBLE ELSE 12.0::DOUBLE END AS size, CASE h WHEN 9 THEN 1.0::DOUBLE WHEN 14 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS bold_ratio,
    CASE WHEN h = 9 THEN 'Base-Bold' ELSE 'Base' END AS font, CASE h WHEN 11 THEN 12591136 WHEN 14 THEN 2113728 WHEN 12 THEN 2138144 ELSE 0 END AS color
  FROM slots), header AS (
  SELECT DISTINCT doc_id, page, 0 AS ord, 'Disciplina ' || coalesce(source, '') AS text, 48.0::DOUBLE AS x0, 20.0::DOUBLE AS y0, 10.0::DOUBLE AS size, 0.0::DOUBLE AS bold_ratio, 'Base' AS font, 0 AS color FROM slots),
lines AS (SELECT *, x0 + 5.0::DOUBLE * length(text) AS x1, y0 + size AS y1 FROM (SELECT * FROM body UNION ALL SELECT * FROM header) WHERE text <> '')"""

BODY = """body_size AS (SELECT doc_id, coalesce(median(CASE WHEN size BETWEEN 8 AND 16 AND length(text) > 20 THEN size END), 12.0)::DOUBLE AS body_size FROM lines GROUP BY doc_id)"""
LEFT = """page_left AS (SELECT doc_id, page, coalesce(min(CASE WHEN length(text) > 8 AND size <= 1.15 * body_size THEN round_even(x0, 0) END), 48.0)::DOUBLE AS page_left FROM lines JOIN body_size USING (doc_id) GROUP BY doc_id, page)"""
KEY = f"regexp_replace(replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ'), '{P.COUNTER}', '<page>', 'g')"
KEYS = f"""keyed AS (SELECT *, {KEY} AS key FROM lines), keys AS (
  SELECT doc_id, key, count(DISTINCT page) AS pages, count(DISTINCT page) / greatest(any_value(total) - 2, 1) AS ratio
  FROM keyed JOIN (SELECT doc_id, max(page) AS total FROM lines GROUP BY doc_id) USING (doc_id)
  WHERE (y0 <= 842.0 * 0.13 OR y1 >= 842.0 * (1 - 0.13)) AND length(key) BETWEEN 1 AND 260 GROUP BY doc_id, key HAVING ratio >= 0.30)"""

_KINDS = [
    ("question", P.QUESTION, f"regexp_extract(text, '{P.QUESTION}', 1) || '.'", f"regexp_extract(text, '{P.QUESTION}', 2)"),
    ("alternative", P.ALTERNATIVE, f"lower(regexp_extract(text, '{P.ALTERNATIVE}', 1)) || ')'", f"regexp_extract(text, '{P.ALTERNATIVE}', 2)"),
    ("roman", P.ROMAN, f"regexp_extract(text, '{P.ROMAN}', 1) || ' –'", f"regexp_extract(text, '{P.ROMAN}', 2)"),
    ("bullet", P.BULLET, f"regexp_extract(text, '{P.BULLET}', 1)", f"regexp_extract(text, '{P.BULLET}', 2)"),
    ("dash", P.DASH, f"regexp_extract(text, '{P.DASH}', 1)", f"regexp_extract(text, '{P.DASH}', 2)"),
    ("legal", P.ARTICLE, "''", "text"),
    ("legal-item", P.LEGAL_ITEM, "''", "text"),
    ("answer", P.ANSWER, "''", "text"),
    ("call-inline", P.CALL_INLINE, f"regexp_extract(text, '{P.CALL_INLINE}', 1) || ':'", f"regexp_extract(text, '{P.CALL_INLINE}', 2)"),
    ("call-label", P.CALL_LABEL, "''", "regexp_replace(text, ':+$', '')"),
]


def _case(k: int) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '{r[1]}') THEN {r[k] if k else repr(r[0])}" for r in _KINDS) + " END"


KINDS = f"kinds AS (SELECT *, {_case(0)} AS kind, {_case(2)} AS marker, {_case(3)} AS rest FROM lines)"
CAPS = f"(upper({{0}}) = {{0}} AND regexp_matches({{0}}, '{P.CAPITAL}'))"
LEVEL = f"""CASE WHEN text = '' OR length(text) > 150 THEN 0 WHEN size / body_size >= 1.55 THEN 1 WHEN size / body_size >= 1.35 OR ({CAPS.format('text')} AND size / body_size >= 1.18) THEN 2
  WHEN size / body_size >= 1.18 AND (bold_ratio > 0.45 OR {CAPS.format('text')}) THEN 3 ELSE 0 END"""
JOIN = "regexp_replace(coalesce(string_agg({0}, ' ' ORDER BY {1}) FILTER (WHERE {0} <> ''), ''), '\\s+([,.;:!?])', '\\1', 'g')"

_K = "(doc_id + page)"
REGIONS = f"""pages_ AS (SELECT DISTINCT doc_id, page FROM lines), regions AS (
  SELECT doc_id, page, 1 AS ord, 'table' AS kind, 40.0::DOUBLE AS x0, 112.0::DOUBLE AS y0, 9000.0::DOUBLE AS x1, 168.0::DOUBLE AS y1 FROM pages_ WHERE {_K} % 3 = 0
  UNION ALL SELECT doc_id, page, 2, 'image', 40.0, 202.0, 9000.0, 240.0 FROM pages_ WHERE {_K} % 5 = 0
  UNION ALL SELECT doc_id, page, 3, 'image', 41.0, 203.0, 9000.0, 240.0 FROM pages_ WHERE {_K} % 15 = 0)"""
OVERLAP = "(greatest(least({a}.x1,{b}.x1)-greatest({a}.x0,{b}.x0),0)*greatest(least({a}.y1,{b}.y1)-greatest({a}.y0,{b}.y0),0)/(({a}.x1-{a}.x0)*({a}.y1-{a}.y0)))"
BOXES = f"""shapes AS (SELECT * FROM (VALUES (0, 75.0, 110.0, 1.0, 0.1, true), (1, 75.2, 110.2, 1.0, 0.1, true), (2, 260.0, 268.0, 1.0, 0.1, true), (3, 130.0, 160.0, 5.0, 0.1, true), (4, 130.0, 160.0, 1.0, 0.9, true), (5, 130.0, 160.0, 1.0, 0.1, false)) t(ord, y0, y1, width, r, curved)),
drawn AS (SELECT doc_id, page, ord, 40.0::DOUBLE AS x0, y0::DOUBLE AS y0, 340.0::DOUBLE AS x1, y1::DOUBLE AS y1 FROM pages_, shapes WHERE {_K} % 4 = 0 AND curved AND y1 - y0 BETWEEN 18 AND 110 AND width BETWEEN 0.4 AND 2.0 AND 0.5 > r + 0.08),
held AS (SELECT * FROM drawn d WHERE EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = d.doc_id AND l.page = d.page AND (l.x0+l.x1)/2 BETWEEN d.x0-2 AND d.x1+2 AND (l.y0+l.y1)/2 BETWEEN d.y0-2 AND d.y1+2)),
boxes AS (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY doc_id, page, round_even(x0,0), round_even(y0,0), round_even(x1,0), round_even(y1,0) ORDER BY ord) = 1),
boxed AS (SELECT l.*, (SELECT min(b.ord) FROM boxes b WHERE b.doc_id = l.doc_id AND b.page = l.page AND (l.x0+l.x1)/2 BETWEEN b.x0-2 AND b.x1+2 AND (l.y0+l.y1)/2 BETWEEN b.y0-2 AND b.y1+2) AS box FROM lines l)"""
FREE = f"free AS (SELECT * FROM boxed l WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.doc_id = l.doc_id AND r.page = l.page AND {OVERLAP.format(a='l', b='r')} > 0.72))"

SPANS = """cut AS (SELECT doc_id, page, ord AS line, unnest(string_split(text, ' ')) AS text, unnest(range(len(string_split(text, ' ')))) AS n, x0, y0, size, font, color FROM lines WHERE ord > 0),
styled AS (SELECT doc_id, page, line, n, text, x0 + 40.0::DOUBLE * n AS x0, y0, size, CASE WHEN n % 3 = 1 THEN 'Base-Bold' ELSE font END AS font, CASE WHEN n % 5 = 2 THEN 12591136 ELSE color END AS color FROM cut WHERE text <> ''),
spans AS (SELECT doc_id, page, line, n * 2 + copy AS ord, text, x0, y0, x0 + 5.0::DOUBLE * length(text) AS x1, y0 + size AS y1, size, font, CASE WHEN n % 3 = 1 THEN 16 ELSE 0 END AS flags, color
  FROM (SELECT *, 0 AS copy FROM styled UNION ALL SELECT * REPLACE (x0 + 0.1::DOUBLE AS x0), 1 FROM styled WHERE (doc_id + line) % 7 = 0)),
single AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY doc_id, page, text, round_even(x0/0.5,0), round_even(y0/0.5,0), round_even(x1/0.5,0), round_even(y1/0.5,0), round_even(size,2), font, color ORDER BY line, ord) = 1)"""

UNITS = f"""sized AS (SELECT l.*, body_size, page_left, greatest(10.0, 1.15 * body_size) AS line_height FROM free l JOIN body_size USING (doc_id) JOIN free_left USING (doc_id, page)),
known AS (SELECT *, {_case(0)} AS kind, {_case(2)} AS marker, {_case(3)} AS rest, {LEVEL} AS level, 1 AS is_line FROM sized),
events AS (SELECT doc_id, page, ord, text, x0, y0, x1, y1, bold_ratio, font, box, page_left, line_height, kind, marker, rest, level, is_line FROM known
  UNION ALL SELECT doc_id, page, ord, NULL, x0, y0, x1, y1, NULL, NULL, NULL, NULL, NULL, kind, NULL, NULL, NULL, 0 FROM regions),
shaped AS (SELECT *, CASE WHEN is_line = 0 THEN 'region' WHEN box IS NOT NULL THEN 'boxed' WHEN level > 0 AND coalesce(kind, '') <> 'question' THEN 'heading' WHEN kind IS NOT NULL THEN 'starter'
  WHEN right(text, 1) = '?' AND length(text) <= 120 AND (bold_ratio > 0.30 OR lower(font) LIKE '%sans%') THEN 'asks' ELSE 'plain' END AS shape FROM events),
hards AS (SELECT *, CASE shape WHEN 'boxed' THEN NOT coalesce(lag(shape) OVER o = 'boxed' AND lag(box) OVER o = box, false) WHEN 'plain' THEN coalesce(lag(shape) OVER o IN ('region','boxed','heading','asks'), true) ELSE true END AS hard,
  y0 - lag(y1) OVER o AS gap, lag(x0) OVER o - x0 AS shift FROM shaped WINDOW o AS (PARTITION BY doc_id, page ORDER BY y0, is_line, ord)),
segs AS (SELECT *, sum(hard::INT) OVER (PARTITION BY doc_id, page ORDER BY y0, is_line, ord) AS seg,
  CASE WHEN shape IN ('boxed','asks') THEN 'question-callout' WHEN shape = 'heading' THEN 'heading' WHEN shape = 'plain' THEN 'p' WHEN kind LIKE 'call-%' THEN 'callout' ELSE kind END AS own FROM hards),
firsts AS (SELECT *, first_value(own) OVER i AS of_, first_value(x0) OVER i AS first_x, first_value(coalesce(kind = 'call-label' AND shape = 'starter', false)) OVER i AS label, row_number() OVER i - 1 AS nth
  FROM segs WINDOW i AS (PARTITION BY doc_id, page, seg ORDER BY y0, is_line, ord)),
softs AS (SELECT *, coalesce(NOT hard AND CASE WHEN of_ IN ('bullet','dash') THEN x0 < first_x - 7 OR gap > 0.72 * line_height WHEN of_ IN ('legal','legal-item') THEN gap > 1.05 * line_height
  WHEN of_ IN ('question','alternative','roman') THEN gap > 0.72 * line_height WHEN of_ = 'callout' THEN nth - label::INT >= 1 AND (gap > 0.65 * line_height OR (nth - label::INT >= 2 AND shift > 15)) ELSE false END, false) AS soft FROM firsts),
afters AS (SELECT *, max(soft::INT) OVER (PARTITION BY doc_id, page, seg ORDER BY y0, is_line, ord) AS after_ FROM softs),
wases AS (SELECT *, coalesce(lag(after_) OVER (PARTITION BY doc_id, page, seg ORDER BY y0, is_line, ord), 0) AS was FROM afters),
breaks AS (SELECT *, coalesce(hard OR CASE WHEN of_ = 'question-callout' THEN false WHEN of_ IN ('p','answer') OR was = 1 THEN x0 >= page_left + 12 OR gap > 0.72 * line_height ELSE after_ = 1 AND was = 0 END, false) AS broken FROM wases),
numbered AS (SELECT *, sum(broken::INT) OVER (PARTITION BY doc_id, page ORDER BY y0, is_line, ord) AS unit,
  CASE WHEN hard THEN of_ WHEN after_ = 1 OR (of_ IN ('p','answer') AND broken) THEN 'p' END AS unit_kind,
  CASE WHEN shape = 'region' THEN '' WHEN NOT hard OR shape <> 'starter' THEN text WHEN kind = 'call-label' THEN '' WHEN kind IN ('legal','legal-item','answer') THEN text ELSE rest END AS part,
  CASE WHEN hard AND shape = 'starter' THEN CASE WHEN kind = 'call-label' THEN rest ELSE marker END END AS mark FROM breaks),
units AS (SELECT doc_id, page, unit, first(unit_kind ORDER BY y0, is_line, ord) AS kind, coalesce(max(CASE WHEN shape = 'heading' THEN level END), 0) AS level, coalesce(first(mark ORDER BY y0, is_line, ord), '') AS marker,
  {JOIN.format(ws('part'), 'y0, is_line, ord')} AS text, first(x0 ORDER BY y0, is_line, ord) AS x0, min(y0) AS y0, first(page_left ORDER BY y0, is_line, ord) AS page_left, count(*) AS n_lines
  FROM numbered GROUP BY doc_id, page, unit HAVING text <> '' OR first(unit_kind ORDER BY y0, is_line, ord) IN ('image','table'))"""
FREE_LEFT = "free_left AS (SELECT doc_id, page, coalesce(min(CASE WHEN length(text) > 8 AND size <= 1.15 * body_size THEN round_even(x0, 0) END), 48.0)::DOUBLE AS page_left FROM free JOIN (SELECT doc_id, coalesce(median(CASE WHEN size BETWEEN 8 AND 16 AND length(text) > 20 THEN size END), 12.0)::DOUBLE AS body_size FROM free GROUP BY doc_id) USING (doc_id) GROUP BY doc_id, page)"
FREE_BODY = "body_size AS (SELECT doc_id, coalesce(median(CASE WHEN size BETWEEN 8 AND 16 AND length(text) > 20 THEN size END), 12.0)::DOUBLE AS body_size FROM free GROUP BY doc_id)"
TO_UNITS = f"{LINES}, {REGIONS}, {BOXES}, {FREE}, {FREE_BODY}, {FREE_LEFT}, {UNITS}"
_MERGING = "('p','alternative','roman','question','legal','bullet','dash')"
ELEMENTS = f"""m1 AS (SELECT *, NOT regexp_matches(lag(text) OVER o, '{P.TERMINAL}') AND lag(text) OVER o <> '' AS open_, regexp_matches(text, '^[{P.LOWER}]') AS low, sum((kind <> 'p')::INT) OVER o AS run, coalesce(lag(kind) OVER o IN {_MERGING}, false) AS prior
  FROM units WINDOW o AS (PARTITION BY doc_id, page ORDER BY unit)),
m2 AS (SELECT *, first_value(kind) OVER i AS head, first_value(x0) OVER i AS head_x, row_number() OVER i - 1 AS nth FROM m1 WINDOW i AS (PARTITION BY doc_id, page, run ORDER BY unit)),
m3 AS (SELECT *, kind = 'p' AND prior AND coalesce(open_, false) AND (low OR (head IN ('bullet','dash') AND x0 >= head_x + 6)) AS hang, kind = 'p' AND prior AND coalesce(open_, false) AND low AS plain FROM m2),
m4 AS (SELECT *, coalesce(max((kind = 'p' AND NOT hang AND head IN {_MERGING} AND nth > 0)::INT) OVER (PARTITION BY doc_id, page, run ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut FROM m3),
m5 AS (SELECT *, CASE WHEN cut = 0 THEN hang ELSE plain END AS link FROM m4),
m6 AS (SELECT *, sum((NOT link)::INT) OVER (PARTITION BY doc_id, page ORDER BY unit) AS element FROM m5),
elements AS (SELECT doc_id, page, element, first(kind ORDER BY unit) AS kind, first(level ORDER BY unit) AS level, first(marker ORDER BY unit) AS marker, {JOIN.format(ws('text'), 'unit')} AS text, first(x0 ORDER BY unit) AS x0, first(y0 ORDER BY unit) AS y0, first(page_left ORDER BY unit) AS page_left, count(*) AS n_units FROM m6 GROUP BY doc_id, page, element)"""
_CLOSERS = P.CLOSERS
_CROSSING = "('p','bullet','dash','question','alternative','roman','legal','legal-item','callout','question-callout')"
READING = f"""c1 AS (SELECT *, regexp_replace(text, '{_CLOSERS}', '') AS tail, (kind = 'p' AND x0 >= page_left + 12) AS wide FROM elements),
c2 AS (SELECT *, sum(wide::INT) OVER (PARTITION BY doc_id, page) AS indents, coalesce(row_number() OVER (PARTITION BY doc_id, page ORDER BY element) = 1 AND kind = 'p' AND lag(page) OVER o = page - 1 AND lag(kind) OVER o IN {_CROSSING} AND lag(tail) OVER o <> '' AND text <> '', false) AS may,
  lag(tail) OVER o AS before_ FROM c1 WINDOW o AS (PARTITION BY doc_id ORDER BY page, element)),
c3 AS (SELECT *, sum((NOT may)::INT) OVER (PARTITION BY doc_id ORDER BY page, element) AS run, NOT regexp_matches(before_, '{P.TERMINAL}') AS open_, regexp_matches(before_, ':$') AS colon, regexp_matches(before_, '(?i)(^|\\W)item\\s+subsequente[.]?$') AS item,
  regexp_matches(text, '{P.LOWER_START}') AS low, x0 <= page_left + 6 AS margin,
  regexp_matches(text, '^[-–—−•◦]+$') OR regexp_matches(text, '{P.NUMBERING}') OR (length(text) <= 80 AND right(text, 1) = ':') OR (length(text) <= 100 AND {CAPS.format('text')}) AS title FROM c2),
c4 AS (SELECT *, first_value(kind) OVER i AS head, first_value(x0) OVER i AS head_x, margin AND NOT title AND (open_ OR indents - wide::INT > 0) AS paragraph FROM c3 WINDOW i AS (PARTITION BY doc_id, run ORDER BY page, element)),
c5 AS (SELECT *, may AND coalesce(CASE WHEN head IN ('bullet','dash') THEN x0 >= head_x + 6 WHEN NOT margin THEN false WHEN head = 'p' THEN paragraph WHEN head = 'question' THEN open_ OR colon OR item WHEN head IN ('alternative','roman') THEN open_ AND low ELSE open_ END, false) AS link_head, may AND coalesce(paragraph, false) AS link_p FROM c4),
c6 AS (SELECT *, coalesce(max((may AND NOT link_head)::INT) OVER (PARTITION BY doc_id, run ORDER BY page, element ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut FROM c5),
c7 AS (SELECT *, CASE WHEN cut = 0 THEN link_head ELSE link_p END AS link FROM c6),
c8 AS (SELECT *, sum((NOT link)::INT) OVER (PARTITION BY doc_id ORDER BY page, element) AS seq FROM c7),
reading AS (SELECT doc_id, seq, first(kind ORDER BY page, element) AS kind, first(level ORDER BY page, element) AS level, first(marker ORDER BY page, element) AS marker, min(page) AS page, string_agg(text, ' ' ORDER BY page, element) AS text, count(*) - 1 AS breaks, max(page) AS last FROM c8 GROUP BY doc_id, seq)"""
TO_READING = f"{TO_UNITS}, {ELEMENTS}, {READING}"
TABLES = f"""tables_ AS (SELECT doc_id, page, ord, 120.0::DOUBLE AS x0, y0, 400.0::DOUBLE AS x1, y1,
  [['', 'Total', 'Nota'], ['A', CASE WHEN {_K} % 2 = 0 THEN 'v' || page END, '10'], ['B', 'x < y', CASE WHEN {_K} % 4 = 1 THEN '' ELSE '20' END]] AS rows FROM regions WHERE kind = 'table')"""
SLUG = "regexp_replace(regexp_replace(lower(regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
SECTIONS = f"""s1 AS (SELECT *, sum((kind = 'heading' AND level = 1)::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS section_no FROM reading),
heads AS (SELECT doc_id, section_no, left(CASE WHEN {SLUG.format('text')} = '' THEN 'secao' ELSE {SLUG.format('text')} END, 48) AS base FROM s1 WHERE kind = 'heading' AND level = 1),
names AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY section_no) + (base IN ('conteudo','cover','title','nav'))::INT AS nth FROM heads),
sectioned AS (SELECT s1.*, coalesce(CASE WHEN nth = 1 THEN base ELSE base || '-' || nth END, 'conteudo') AS section FROM s1 LEFT JOIN names USING (doc_id, section_no)),
ids AS (SELECT *, CASE WHEN {SLUG.format('text')} = '' THEN 'secao' ELSE {SLUG.format('text')} END AS base FROM sectioned WHERE kind = 'heading'),
heading_ids AS (SELECT doc_id, seq, section, level, text, CASE WHEN row_number() OVER w = 1 THEN base ELSE base || '-' || row_number() OVER w END AS id FROM ids WINDOW w AS (PARTITION BY doc_id, section_no, base ORDER BY seq))"""


END = f"(^|[^{P.WORD}])([{P.CAPITALS}]{{5,}})$"


TITLE = "CASE WHEN {0} = upper({0}) AND {0} <> lower({0}) AND NOT regexp_matches({0}, '[ªº]') THEN array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') ELSE {0} END"
ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_PIECES = [(0, 3, "cb", "red"), (3, 6, "cib", "red"), (6, 7, "cib", "red"), (7, 9, "cb", "red"), (9, 10, ""), (10, 12, "c", "green"), (12, 14, "cb", "green"), (14, 16, "b")]


def _piece(a: int, z: int, marks: str, css_class: str = "") -> str:
    """SQL of a piece of text within its marks: colour inside italic inside bold."""
    opened = {"c": f'<span class="{css_class}">', "i": '<em class="pdf-italic">', "b": '<strong class="pdf-bold">'}
    closed = {"c": "</span>", "i": "</em>", "b": "</strong>"}
    return f"'{''.join(opened[m] for m in reversed(marks))}' || {ESC.format(f'substr(text, {a + 1}, {z - a})')} || '{''.join(closed[m] for m in marks)}'"


def _q(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


ORACLE_SQL: dict[str, str] = {
    "furniture_keys": _q(f"{LINES}, {KEYS}", "SELECT doc_id, key, pages, ratio FROM keys"),
    "lines_without_furniture": _q(f"{LINES}, {KEYS}", "SELECT doc_id, page, ord, text FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM keys x WHERE x.doc_id = k.doc_id AND x.key = k.key)"),
    "body_size": _q(f"{LINES}, {BODY}", "SELECT doc_id, body_size FROM body_size"),
    "page_left": _q(f"{LINES}, {BODY}, {LEFT}", "SELECT doc_id, page, page_left FROM page_left"),
    "line_kinds": _q(f"{LINES}, {KINDS}", "SELECT doc_id, page, ord, kind, marker, rest FROM kinds WHERE kind IS NOT NULL"),
    "heading_levels": _q(f"{LINES}, {BODY}", f"SELECT doc_id, page, ord, {LEVEL} AS level FROM lines JOIN body_size USING (doc_id) WHERE {LEVEL} > 0"),
    "paragraph_islands": _q(
        f"{LINES}, {BODY}, {LEFT}",
        f""", g AS (SELECT l.*, lag(y1) OVER o AS py, (lag(y1) OVER o IS NULL OR x0 >= page_left + 12 OR y0 - lag(y1) OVER o > 0.72 * greatest(10.0, 1.15 * body_size)) AS start FROM lines l JOIN body_size USING (doc_id) JOIN page_left USING (doc_id, page) WINDOW o AS (PARTITION BY doc_id, page ORDER BY y0, ord)),
        n AS (SELECT *, sum(start::INT) OVER (PARTITION BY doc_id, page ORDER BY y0, ord) AS para FROM g)
        SELECT doc_id, page, para, count(*) AS n_lines, {JOIN.format('text', 'y0, ord')} AS text FROM n GROUP BY doc_id, page, para""",
    ),
    "segmented_units": _q(TO_UNITS, "SELECT doc_id, page, unit, kind, level, marker, text, n_lines FROM units"),
    "continuation_merge": _q(f"{TO_UNITS}, {ELEMENTS}", "SELECT doc_id, page, element, kind, marker, text, n_units FROM elements"),
    "cross_page_merge": _q(TO_READING, "SELECT doc_id, seq, page, kind, marker, text, breaks AS n_breaks FROM reading"),
    "color_classes": _q(
        LINES,
        """, c AS (SELECT doc_id, (color >> 16) & 255 AS r, (color >> 8) & 255 AS g, color & 255 AS b FROM lines),
        d AS (SELECT doc_id, greatest(r,g,b) AS hi, greatest(r,g,b) - least(r,g,b) AS spread, CASE WHEN greatest(r,g,b) = least(r,g,b) THEN 0 WHEN r = greatest(r,g,b) THEN (g-b)/(greatest(r,g,b)-least(r,g,b)) WHEN g = greatest(r,g,b) THEN (b-r)/(greatest(r,g,b)-least(r,g,b)) + 2 ELSE (r-g)/(greatest(r,g,b)-least(r,g,b)) + 4 END * 60 AS t FROM c),
        e AS (SELECT doc_id, hi, spread, CASE WHEN t < 0 THEN t + 360 ELSE t END AS deg FROM d)
        SELECT doc_id, CASE WHEN deg < 20 OR deg >= 345 THEN 'red' WHEN deg < 70 THEN 'orange' WHEN deg < 170 THEN 'green' WHEN deg < 260 THEN 'blue' ELSE 'purple' END AS css_class, count(*) AS n FROM e WHERE hi >= 48 AND spread >= 24 AND spread / hi >= 0.30 GROUP BY 1, 2""",
    ),
    "span_dedup": _q(f"{LINES}, {SPANS}", "SELECT doc_id, page, line, ord, text FROM single"),
    "line_from_spans": _q(
        f"{LINES}, {SPANS}",
        """, w AS (SELECT *, greatest(length(text), 1) AS w, row_number() OVER (PARTITION BY doc_id, page, line ORDER BY x0, ord) AS n FROM spans),
        f AS (SELECT doc_id, page, line, arg_max(font, v * 100000 - f) AS font FROM (SELECT doc_id, page, line, font, sum(w) AS v, min(n) AS f FROM w GROUP BY ALL) GROUP BY ALL),
        c AS (SELECT doc_id, page, line, arg_max(color, v * 100000 - f) AS color FROM (SELECT doc_id, page, line, color, sum(w) AS v, min(n) AS f FROM w GROUP BY ALL) GROUP BY ALL)
        SELECT doc_id, page, line AS ord, string_agg(text, ' ' ORDER BY n) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, sum(size * w) / sum(w) AS size, sum(CASE WHEN lower(w.font) LIKE '%bold%' OR flags & 16 <> 0 THEN w ELSE 0 END) / sum(w) AS bold_ratio, any_value(f.font) AS font, any_value(c.color) AS color
        FROM w JOIN f USING (doc_id, page, line) JOIN c USING (doc_id, page, line) GROUP BY doc_id, page, line""",
    ),
    "span_overlays": _q(f"{LINES}, {SPANS}", "SELECT doc_id, page, line, count(*) AS n_spans, string_agg(text, ' ' ORDER BY x0, ord) AS text FROM spans WHERE ord % 2 = 0 GROUP BY doc_id, page, line"),
    "char_runs": _q(
        f"{LINES}, {SPANS}",
        """, k AS (SELECT *, lag(font) OVER o AS pf, lag(y0) OVER o AS py, lag(x1) OVER o AS px FROM spans WHERE ord % 2 = 0 WINDOW o AS (PARTITION BY doc_id, page ORDER BY line, ord)),
        g AS (SELECT *, sum((pf IS NULL OR pf <> font OR abs(y0 - py) > 1.6 OR x0 - px > greatest(8.0, 0.85 * size))::INT) OVER (PARTITION BY doc_id, page ORDER BY line, ord) AS run FROM k)
        SELECT doc_id, page, 'bold' AS style, string_agg(text, '' ORDER BY line, ord) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g WHERE font = 'Base-Bold' GROUP BY doc_id, page, run""",
    ),
    "style_run_join": _q(
        f"{LINES}, {SPANS}",
        """, k AS (SELECT *, lag(font) OVER o AS pf, lag(y0) OVER o AS py, lag(x1) OVER o AS px FROM spans WHERE ord % 2 = 0 WINDOW o AS (PARTITION BY doc_id, page ORDER BY line, ord)),
        g AS (SELECT *, sum((pf IS NULL OR pf <> font OR abs(y0 - py) > 1.6 OR x0 - px > greatest(8.0, 0.85 * size))::INT) OVER (PARTITION BY doc_id, page ORDER BY line, ord) AS run FROM k),
        runs AS (SELECT doc_id, page, string_agg(text, '' ORDER BY line, ord) AS t, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g WHERE font = 'Base-Bold' GROUP BY doc_id, page, run)
        SELECT l.doc_id, l.page, l.ord, 'bold' AS style, strpos(l.text, t) - 1 AS start, strpos(l.text, t) - 1 + length(t) AS "end", t AS snippet FROM lines l JOIN runs r ON l.doc_id = r.doc_id AND l.page = r.page AND least(l.y1, r.y1) > greatest(l.y0, r.y0) AND r.x1 >= l.x0 - 2 AND r.x0 <= l.x1 + 2
        WHERE l.ord > 0 AND strpos(l.text, t) > 0 AND strpos(substr(l.text, strpos(l.text, t) + 1), t) = 0""",
    ),
    "font_profile": _q(f"{LINES}, {SPANS}", "SELECT doc_id, font, sum(length(text)) AS n_chars, left(string_agg(text, '' ORDER BY page, line, ord), 180) AS sample, font = 'Base-Bold' AS is_bold FROM spans WHERE ord % 2 = 0 GROUP BY doc_id, font"),
    "lines_outside_regions": _q(f"{LINES}, {REGIONS}", f"SELECT doc_id, page, ord FROM lines l WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.doc_id = l.doc_id AND r.page = l.page AND {OVERLAP.format(a='l', b='r')} > 0.72)"),
    "distinct_regions": _q(f"{LINES}, {REGIONS}", f"SELECT doc_id, page, ord, kind FROM regions a WHERE NOT EXISTS (SELECT 1 FROM regions b WHERE b.doc_id = a.doc_id AND b.page = a.page AND b.ord < a.ord AND {OVERLAP.format(a='a', b='b')} > 0.92 AND {OVERLAP.format(a='b', b='a')} > 0.92)"),
    "question_boxes": _q(f"{LINES}, {REGIONS}, {BOXES}", "SELECT doc_id, page, ord, y0, y1 FROM boxes"),
    "boxed_lines": _q(f"{LINES}, {REGIONS}, {BOXES}", "SELECT doc_id, page, ord, box FROM boxed WHERE box IS NOT NULL"),
    "table_edge_audit": _q(
        f"{LINES}, {REGIONS}, {TABLES}",
        """, tokens AS (SELECT doc_id, page, i AS ord, ['V','F','12'][i] AS text, 20.0 AS x0, 115.0 + 18 * (i - 1) AS y0 FROM pages_, range(1, 4) t(i) WHERE (doc_id + page) % 6 = 0 OR i = 1)
        SELECT t.doc_id, t.page, t.ord, count(*) AS n_tokens, string_agg(k.text, '|' ORDER BY k.ord) AS tokens FROM tables_ t JOIN tokens k ON t.doc_id = k.doc_id AND t.page = k.page AND k.y0 + 6 BETWEEN t.y0 AND t.y1 GROUP BY ALL HAVING count(*) >= 2""",
    ),
    "table_cell_repair": _q(
        f"{LINES}, {REGIONS}, {TABLES}",
        """, f AS (SELECT doc_id, page, ord, list_transform(flatten(rows), lambda c: nullif(trim(c), '')) AS cells FROM tables_),
        d AS (SELECT a.doc_id, a.page, a.ord, arg_min(b.cells, b.page) AS donor, min(b.page) AS donor_page FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.page <> b.page
          WHERE len(list_filter(range(1, 10), lambda i: a.cells[i] <> b.cells[i])) = 0 AND len(list_filter(range(1, 10), lambda i: a.cells[i] = b.cells[i])) > 0 AND len(list_filter(range(1, 10), lambda i: a.cells[i] IS NULL AND b.cells[i] IS NOT NULL)) > 0 GROUP BY ALL)
        SELECT f.doc_id, f.page, f.ord, array_to_string(list_transform(range(1, 10), lambda i: coalesce(cells[i], donor[i], '')), '|') AS cells, donor_page FROM f LEFT JOIN d USING (doc_id, page, ord)""",
    ),
    "number_overlay_antijoin": _q(
        LINES,
        """, numbers AS (SELECT doc_id, page, ord + 100 AS ord, left(text, 4) AS text, x0, y0 + 1.0 AS y0, x0 + 20.0 AS x1, y1 + 1.0 AS y1 FROM lines WHERE regexp_matches(text, '^[0-9]{3}[.]')),
        every AS (SELECT doc_id, page, ord, text, x0, y0, x1, y1 FROM lines UNION ALL SELECT * FROM numbers)
        SELECT doc_id, page, ord, text FROM every a WHERE NOT EXISTS (SELECT 1 FROM every b WHERE b.doc_id = a.doc_id AND b.page = a.page AND b.ord <> a.ord AND regexp_matches(a.text, '^[0-9]{3}[.]?$') AND abs(a.y0 - b.y0) < 2.5 AND starts_with(b.text, a.text) AND b.x1 - b.x0 > 2 * (a.x1 - a.x0))""",
    ),
    "join_lines_text": _q(
        LINES,
        f""", cut AS (SELECT doc_id, page, ord, rtrim(left(text, 12)) AS a, ltrim(substr(text, 13)) AS b FROM lines WHERE length(text) > 20)
        SELECT doc_id, page, ord, regexp_replace(CASE WHEN regexp_matches(a, '[{P.LETTER}]$') AND regexp_matches(b, '^[{P.LOWER}]') THEN a || b ELSE a || '- ' || b END, '\\s+([,.;:!?])', '\\1', 'g') AS text FROM cut WHERE NOT regexp_matches(a, '-$')""",
    ),
    "suspicious_duplicates": _q(
        LINES,
        f""", t AS (SELECT doc_id, page, ord, CASE WHEN (doc_id + ord) % 9 = 0 THEN text || ' ' || text ELSE text END AS text FROM lines WHERE ord > 0),
        w AS (SELECT *, string_split(text, ' ') AS w, string_split(text, ' ') AS c FROM t)
        SELECT doc_id, page, ord FROM w WHERE (len(w) % 2 = 0 AND len(w) BETWEEN 2 AND 80 AND w[1:len(w)//2] = w[len(w)//2+1:])
          OR (len(w) BETWEEN 8 AND 80 AND len(list_filter(range(4, least(16, len(w)//2) + 1), lambda k: w[1:k] = w[k+1:2*k])) > 0)
          OR len(list_filter(range(1, len(c)), lambda i: regexp_matches(c[i], '{END}') AND starts_with(c[i+1], regexp_extract(c[i], '{END}', 2)) AND NOT regexp_matches(substr(c[i+1], length(regexp_extract(c[i], '{END}', 2)) + 1), '^[{P.WORD}]'))) > 0""",
    ),
    "marker_histogram": _q(TO_READING, "SELECT CASE WHEN marker <> '' THEN marker WHEN kind = 'dash' THEN '−' ELSE '•' END AS marker, count(*) AS n FROM reading WHERE kind IN ('bullet','dash') GROUP BY 1"),
    "qa_warnings": _q(
        f"{TO_READING}, {TABLES}",
        f""", x AS (SELECT *, lead(kind) OVER o AS nk, lead(text) OVER o AS nt, lead(page) OVER o AS np, regexp_replace(text, '{_CLOSERS}', '') AS tail FROM reading WINDOW o AS (PARTITION BY doc_id ORDER BY seq)),
        y AS (SELECT *, kind IN ('bullet','dash') AS listed, tail <> '' AND NOT regexp_matches(tail, '{P.TERMINAL}') AS open_ FROM x)
        SELECT doc_id, page::INT AS page, 'embedded-list-marker' AS type, left(text, 220) AS details FROM y WHERE listed AND regexp_matches(text, '{P.EMBEDDED_MARKER}')
        UNION ALL SELECT doc_id, np::INT, 'unresolved-cross-page-continuation', left(nt, 200) FROM y WHERE kind IN {_CROSSING} AND nk = 'p' AND np = last + 1 AND text <> '' AND open_ AND regexp_matches(nt, '{P.LOWER_START}')
        UNION ALL SELECT doc_id, page::INT, 'list-fragment', left(nt, 160) FROM y WHERE listed AND nk = 'p' AND page = np AND text <> '' AND NOT regexp_matches(text, '{P.TERMINAL}') AND regexp_matches(nt, '^[{P.LOWER}“"]')
        UNION ALL SELECT doc_id, page::INT, 'caption-swallowed-by-list', right(text, 220) FROM y WHERE listed AND regexp_matches(text, '{P.TABLE_CAPTION}')
        UNION ALL SELECT doc_id, page::INT, 'assertion-swallowed-tail', left(text, 220) FROM y WHERE kind = 'roman' AND regexp_matches(text, '{P.ASSERTION_TAIL}')
        UNION ALL SELECT doc_id, page::INT, 'empty-table-cell', 'row ' || (r - 1) || ' col ' || (c - 1) FROM tables_, range(1, 4) a(r), range(1, 4) b(c) WHERE coalesce(trim(rows[r][c]), '') = '' AND NOT (r = 1 AND c = 1)""",
    ),
    "sections": _q(f"{TO_READING}, {SECTIONS}", "SELECT doc_id, section, count(*) AS n_elements, min(seq) AS first_seq FROM sectioned GROUP BY doc_id, section_no, section"),
    "heading_ids": _q(f"{TO_READING}, {SECTIONS}", "SELECT doc_id, seq, section, id FROM heading_ids"),
    "toc": _q(f"{TO_READING}, {SECTIONS}", "SELECT doc_id, seq, least(level, 4) AS level, text, section || '.xhtml#' || id AS href FROM heading_ids"),
    "list_groups": _q(
        TO_READING,
        """, f AS (SELECT *, CASE WHEN kind IN ('bullet','dash') THEN 'list' WHEN kind IN ('legal','legal-item') THEN 'legal' END AS family FROM reading),
        g AS (SELECT *, sum((NOT coalesce(family = pf, false))::INT) OVER (PARTITION BY doc_id ORDER BY seq) AS group_no FROM (SELECT *, lag(family) OVER (PARTITION BY doc_id ORDER BY seq) AS pf FROM f))
        SELECT doc_id, family, group_no, count(*) AS n_items FROM g WHERE family IS NOT NULL GROUP BY ALL""",
    ),
    "document_profile": _q(
        f"{TO_READING}",
        ", n AS (SELECT doc_id, count(*) AS n_lines, max(page) AS n_pages FROM lines GROUP BY doc_id), e AS (SELECT doc_id, count(*) AS n_elements, sum((kind = 'question')::INT)::BIGINT AS n_questions, sum((kind = 'heading')::INT)::BIGINT AS n_headings, sum(breaks)::BIGINT AS n_merges FROM reading GROUP BY doc_id) SELECT n.doc_id, n_lines, n_pages, n_elements, n_questions, n_headings, n_merges FROM n JOIN e USING (doc_id)",
    ),
    "line_overlay_dedup": _q(LINES, "SELECT doc_id, page, ord, text, color FROM lines"),
    "caps_pairs": _q(
        LINES,
        f""", b AS (SELECT doc_id, page, ord, upper(replace(text, 'ß', 'ss')) AS text, x0, ord * 14.0 AS y0, ord * 14.0 + 12.0 AS y1 FROM lines WHERE ord > 0),
        c AS (SELECT *, {CAPS.format('text')} AS caps FROM b),
        d AS (SELECT *, coalesce(caps AND lag(caps) OVER o AND abs(x0 - lag(x0) OVER o) <= 24 AND y0 - lag(y1) OVER o BETWEEN -1 AND 4 AND length(text) + length(lag(text) OVER o) < 150, false) AS link FROM c WINDOW o AS (PARTITION BY doc_id, page ORDER BY y0, x0, ord)),
        e AS (SELECT *, sum((NOT link)::INT) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, ord) AS island FROM d),
        f AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page, island ORDER BY y0, x0, ord) - 1) // 2 AS pair FROM e)
        SELECT doc_id, page, min(ord) AS ord, string_agg(text, ' ' ORDER BY y0, x0, ord) AS text FROM f GROUP BY doc_id, page, island, pair""",
    ),
    "metadata": _q(
        f"{LINES}, {KEYS}",
        f""", cover AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY y0, ord) AS nth FROM keyed k WHERE page = 1 AND length(text) BETWEEN 3 AND 99 AND NOT regexp_matches(text, '{P.QUESTION}') AND NOT EXISTS (SELECT 1 FROM keys x WHERE x.doc_id = k.doc_id AND x.key = k.key)),
        top AS (SELECT doc_id, max(CASE WHEN nth = 1 THEN text END) AS area, arg_min(text, nth) FILTER (WHERE nth > 1 AND lower(text) <> 'livro eletrônico') AS title FROM cover GROUP BY doc_id),
        by_ AS (SELECT DISTINCT doc_id, 'Maria Das Dores' AS author FROM lines WHERE page = 2 AND doc_id % 2 = 0)
        SELECT d.doc_id, coalesce({TITLE.format('area')}, '') AS area, coalesce({TITLE.format('title')}, '') AS title, coalesce(author, '') AS author FROM (SELECT DISTINCT doc_id FROM lines) d LEFT JOIN top USING (doc_id) LEFT JOIN by_ USING (doc_id)""",
    ),
    "ranges_normalized": _q(
        TO_READING,
        """SELECT doc_id, seq, '[{"start":0,"end":9},{"start":12,"end":16}]' AS bold, '[{"start":0,"end":6,"css_class":"red"},{"start":6,"end":9,"css_class":"red"},{"start":10,"end":14,"css_class":"green"}'
          || CASE WHEN length(text) >= 400 THEN ',{"start":20,"end":400,"css_class":"green"}' ELSE '' END || ']' AS colour FROM reading WHERE length(text) > 30""",
    ),
    "rich_text": _q(
        TO_READING,
        f"""SELECT doc_id, seq, {''.join(_piece(*p) + ' || ' for p in _PIECES)} CASE WHEN length(text) >= 400 THEN {_piece(16, 20, '')} || {_piece(20, 400, 'c', 'green')} || {ESC.format('substr(text, 401)')} ELSE {ESC.format('substr(text, 17)')} END AS html
        FROM reading WHERE length(text) > 30""",
    ),
    "xhtml_rules": "SELECT unnest([" + ", ".join(f"'{r}'" for r in RULES) + "]) AS rule, 0::BIGINT AS n",
    "epub_verdicts": "SELECT doc_id, 0::BIGINT AS n_errors, 'partial' AS status FROM documents",
    "page_regions": _q(
        f"{LINES}, {REGIONS}, {TABLES}",
        """SELECT doc_id, page, ord, 'table' AS kind, x0, y0, x1, y1, NULL::VARCHAR AS caption FROM tables_
        UNION ALL SELECT doc_id, page, ord + 1000, kind, x0, y0, x1, y1, NULL FROM regions a WHERE kind = 'image' AND ord = 2
        UNION ALL SELECT doc_id, page, 5000, 'image', 60.0, 400.0, 500.0, 600.0, 'Esquema' FROM pages_ WHERE page = 2""",
    ),
    "baseline_fonts": _q(f"{LINES}, {SPANS}", "SELECT doc_id, arg_min(font, struct_pack(n := -n, f := font)) AS font FROM (SELECT doc_id, font, sum(length(text)) AS n FROM spans WHERE ord % 2 = 0 GROUP BY ALL) GROUP BY doc_id"),
    "audit_counters": _q(
        f"{TO_READING}, {TABLES}, {KEYS}",
        """, f AS (SELECT doc_id, page, ord, list_transform(flatten(rows), lambda c: nullif(trim(c), '')) AS cells FROM tables_),
        d AS (SELECT a.doc_id, a.page, a.ord, arg_min(b.cells, b.page) AS donor FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.page <> b.page
          WHERE len(list_filter(range(1, 10), lambda i: a.cells[i] <> b.cells[i])) = 0 AND len(list_filter(range(1, 10), lambda i: a.cells[i] = b.cells[i])) > 0 AND len(list_filter(range(1, 10), lambda i: a.cells[i] IS NULL AND b.cells[i] IS NOT NULL)) > 0 GROUP BY ALL),
        every AS (SELECT doc_id, unnest(['duplicate_spans_removed', 'repeated_furniture_removed', 'regex_furniture_removed', 'images_rendered', 'tables_detected', 'table_cells_repaired', 'question_box_line_exclusions_applied']) AS metric, 0 AS value FROM documents
        UNION ALL SELECT k.doc_id, 'repeated_furniture_removed', 1 FROM keyed k JOIN keys x ON x.doc_id = k.doc_id AND x.key = k.key
        UNION ALL SELECT doc_id, CASE kind WHEN 'table' THEN 'tables_detected' ELSE 'images_rendered' END, 1 FROM regions
        UNION ALL SELECT doc_id, 'table_cells_repaired', len(list_filter(range(1, 10), lambda i: cells[i] IS NULL AND donor[i] IS NOT NULL)) FROM f JOIN d USING (doc_id, page, ord)
        UNION ALL SELECT doc_id, 'semantic_continuations_merged', n_units - 1 FROM elements
        UNION ALL SELECT doc_id, 'cross_page_continuations_merged', breaks FROM reading
        UNION ALL SELECT doc_id, 'list_marker:' || CASE WHEN marker <> '' THEN marker WHEN kind = 'dash' THEN '−' ELSE '•' END, 1 FROM reading WHERE kind IN ('bullet','dash'))
        SELECT doc_id, metric, sum(value)::BIGINT AS value FROM every GROUP BY ALL""",
    ),
    "table_html": _q(
        f"{LINES}, {REGIONS}, {TABLES}",
        """SELECT doc_id, page, ord, '<table><tr><th></th><th>Total</th><th>Nota</th></tr><tr><td>A</td><td>' || coalesce(rows[2][2], '') || '</td><td>10</td></tr><tr><td>B</td><td>x &lt; y</td><td>' || rows[3][3] || '</td></tr></table>' AS html FROM tables_""",
    ),
    "audit_metrics": _q(TO_READING, "SELECT doc_id, 'kind:' || kind AS metric, count(*) AS value FROM reading GROUP BY ALL UNION ALL SELECT doc_id, 'cross_page_merges', sum(breaks)::BIGINT FROM reading GROUP BY doc_id"),
}
