"""Queries of the text-unit dataflow: filters, lines, merging, scalars, validation."""

from __future__ import annotations

from quire.functions import text as T
from quire.plans.dialect import Catalog, Spark

catalog = Catalog()
both = catalog.both

#: Inline cases that the driver's tables lack: Chinese, ellipses, numbers.
CASES = "(1, '这是中文'), (2, '12345'), (3, ''), (4, '  '), (5, 'Hello world'), (6, '图3.1 shows'), (7, '$$'), (8, '½ ²'), (9, 'é'), (10, '中文 mixed with a long run of english')"
#: (batch, item, source, value)
PAIRS = """('a', 1, 'Here is the text', '这里是文本'), ('a', 2, 'Translate this', '翻译如下'), ('b', 1, 'Hello', '你好'), ('b', 2, 'Wait', '等等……'), ('c', 1, 'Total', '合计'), ('c', 2, 'Sum', '合计'),
('d', 1, 'The first long sentence stands here.', '同一句'), ('d', 2, 'The second long sentence stands here.', '同一句'), ('e', 1, 'x ≤ y holds', 'x 成立'), ('f', 1, 'Revenue was $1,234,567', '收入很高'),
('f', 2, 'Revenue was $1,234,567', '收入为一百二十三万'), ('g', 1, 'Chapter 2', '第二章'), ('h', 1, 'Opportunity cost matters.', '成本很重要'), ('i', 1, 'Empty', ''), ('j', 1, 'Ten chars..', 'aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa')"""
#: (grp, en, zh, ord)
GLOSSARY = "('econ', 'firm', '厂商', 1), ('econ', 'market', '市场', 2), ('econ', 'opportunity cost', '机会成本', 3), ('words', 'the', '这', 4), ('words', 'of', '的', 5), ('words', 'in', '在', 6), ('words', 'firm', '公司', 7), ('words', 'x', 'x', 8), ('words', 'and', '和', 9)"
#: Mathematical symbols and what may stand for them.
SYMBOLS = "('≤', '<='), ('≥', '>='), ('≠', '!='), ('×', 'x'), ('÷', '/'), ('±', '+-'), ('∞', '无穷'), ('→', '->'), ('√', '根号'), ('∑', '求和')"


def _stripped(d: Spark) -> str:
    return f"(SELECT doc_id, i, {T.strip(d, 'line')} AS line FROM {d.lines()} l)"


for name, target in (("unit_filter_zh", "zh-Hans"), ("unit_filter_other", "de")):
    both(name, lambda d, t=target: f"SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN {T.needs_translation(d, 'line', t)} THEN 1 ELSE 0 END) AS n_units FROM {_stripped(d)} s GROUP BY doc_id")
both("unit_filter_cases", lambda d: f"SELECT id, {T.needs_translation(d, 't')} AS zh, {T.needs_translation(d, 't', 'de')} AS de FROM (SELECT id, {T.strip(d, 't')} AS t FROM {d.values(CASES, 'id, t')} v) s")
both("docx_skip_reasons", lambda d: f"SELECT reason, count(*) AS n FROM (SELECT {T.skip_reason(d, 'line')} AS reason FROM {_stripped(d)} s UNION ALL SELECT {T.skip_reason(d, 't')} FROM (SELECT {T.strip(d, 't')} AS t FROM {d.values(CASES, 'id, t')} v) c) r GROUP BY reason")
both("protected_pages", lambda d: f"SELECT page_id, {d.like('html', '<(a|img|script)[ >]')} AS protected, CAST({d.count('html', '<img')} AS BIGINT) AS images, CAST({d.count('html', '<a ')} AS BIGINT) AS links FROM pages")
both("skipped_line_count", lambda d: f"SELECT doc_id, sum(CASE WHEN line <> '' AND ({d.like('line', T.CJK)} OR {d.like('line', T.NO_LETTER)}) THEN 1 ELSE 0 END) AS skipped FROM {_stripped(d)} s GROUP BY doc_id")
both("line_numbering", lambda d: f"SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS unit, length(line) AS n_chars FROM {_stripped(d)} s WHERE {T.needs_translation(d, 'line')}")
both("text_layer_check", lambda d: f"SELECT doc_id, max(CASE WHEN line <> '' THEN 1 ELSE 0 END) = 1 AS has_text FROM {_stripped(d)} s GROUP BY doc_id")
both("format_detection", lambda d: f"SELECT page_id, CASE {d.extract('lower(url)', '[.][a-z]+$')} WHEN '.html' THEN 'html' WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' END AS format FROM pages")
both("merge_flags", lambda d: f"SELECT doc_id, i, {T.can_follow(d, 'coalesce(prev, ' + chr(39) * 2 + ')', 'line')} AS follows FROM (SELECT doc_id, i, line, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM {_stripped(d)} s) p")
both(
    "merge_units",
    lambda d: f"""SELECT doc_id, unit, count(*) AS n_lines, sum(length(line)) AS n_chars, {d.join('line', ' ', 'i')} AS joined FROM (
      SELECT doc_id, i, line, sum(CASE WHEN {T.can_follow(d, 'coalesce(prev, ' + chr(39) * 2 + ')', 'line')} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS unit
      FROM (SELECT doc_id, i, line, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM {_stripped(d)} s WHERE line <> '') p) u GROUP BY doc_id, unit""",
)
both("tidy_text", lambda d: f"SELECT conv_id, turn, {T.tidy(d, 'text')} AS tidy FROM conversations")
both("clean_translation", lambda d: f"SELECT id, {d.replace(d.replace('t', '([A-Za-z0-9]) +(' + T.CJK + ')', '$1$2'), '(' + T.CJK + ') +([A-Za-z0-9])', '$1$2')} AS clean FROM {d.values(CASES, 'id, t')} v")
both("safe_name", lambda d: f"SELECT page_id, {T.safe_name(d, 'url')} AS safe FROM pages")
both("output_name", lambda d: f"SELECT page_id, concat({d.replace(T.safe_name(d, 'url'), '[.][A-Za-z]+$', '')}, '_zh', {d.extract('url', '[.][A-Za-z]+$')}) AS name FROM pages")
both("human_size", lambda d: f"SELECT doc_id, CASE WHEN n_chars <= 0 THEN '0' WHEN n_chars < 1048576 THEN concat(CAST(CAST(floor(n_chars / 1024.0 + 0.5) AS BIGINT) AS STRING), ' KB') ELSE concat(CAST(CAST(floor(n_chars / 104857.6 + 0.5) AS BIGINT) / 10.0 AS STRING), ' MB') END AS size FROM documents")
both("phase_text", lambda d: "SELECT event_id, CASE WHEN event_type LIKE '%sign%' THEN 'queued' WHEN event_type LIKE '%view%' THEN 'reading' WHEN event_type LIKE '%click%' THEN 'translating' WHEN event_type LIKE '%purchase%' THEN 'done' ELSE 'failed' END AS phase FROM events")
both("prompt_numbering", lambda d: f"SELECT doc_id, {d.join('concat(CAST(i + 1 AS STRING), ' + chr(39) + '. ' + chr(39) + ', line)', ' | ', 'i')} AS prompt FROM {_stripped(d)} s GROUP BY doc_id")
both("context_block", lambda d: f"SELECT doc_id, substring({d.join('line', ' / ', 'i')}, 1, 400) AS context FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM {_stripped(d)} s WHERE length(line) >= 4) c WHERE k <= 6 GROUP BY doc_id")
both("content_hash", lambda d: f"SELECT doc_id, substring({d.hex256('text')}, 1, 12) AS content_hash FROM documents")
both("cache_key", lambda d: f"SELECT doc_id, concat('m1/', lang, '-zh/', source, '-', CAST(n_chars AS STRING), '-', substring({d.hex256('text')}, 1, 8)) AS cache_key FROM documents")
#: A hash stands for its text, so each text is shuffled by none of its copies.
_FIRST = lambda d: f"(SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first_id FROM (SELECT doc_id, {d.hex256('text')} AS h FROM documents) t)"
both("cache_hits", lambda d: f"SELECT doc_id, first_id FROM {_FIRST(d)} f WHERE first_id < doc_id", lambda d: "SELECT a.doc_id, min(b.doc_id) AS first_id FROM documents a JOIN documents b ON a.text = b.text AND b.doc_id < a.doc_id GROUP BY a.doc_id")
both("cache_misses", lambda d: f"SELECT doc_id FROM {_FIRST(d)} f WHERE first_id = doc_id", lambda d: "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.text = d.text AND e.doc_id < d.doc_id)")
both("bilingual_interleave", lambda d: "SELECT conv_id, turn, part, text FROM (SELECT conv_id, turn, 0 AS part, text FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn - 1, 1, text FROM conversations WHERE role = 'assistant') u")
#: (batch, item, source, value) of each rule in turn; a value that is null was not given.
CHECKED = PAIRS + ", ('k', 1, 'Here is the text', '这裡是文本'), ('l', 1, 'one', '一'), ('l', 2, 'two', null), ('m', 1, '√2 and ≤', '根号二，小于等于'), ('n', 1, 'α ∑ x', 'α x'), ('o', 1, '……', '……'), ('p', 1, '原文', '原文：'), ('q', 1, 'α', 'A')"
_LOST = lambda d: f"(SELECT DISTINCT b, idx FROM (SELECT p.b, p.idx, m.sym, max(CASE WHEN p.v LIKE concat('%', m.alt, '%') THEN 1 ELSE 0 END) AS kept FROM {d.values(CHECKED, 'b, idx, s, v')} p JOIN {d.values(T.SYMBOLS, 'sym, alt')} m ON p.s LIKE concat('%', m.sym, '%') AND p.v NOT LIKE concat('%', m.sym, '%') GROUP BY p.b, p.idx, m.sym) k WHERE kept = 0)"
both(
    "hard_validation",
    lambda d: f"""SELECT b, CASE WHEN max(CASE WHEN v IS NULL THEN 1 ELSE 0 END) = 1 THEN 'count' WHEN min(bad) IS NULL THEN 'pass' ELSE substring(min(bad), 6) END AS reason FROM (
      SELECT b, v, lpad(CAST(idx AS STRING), 4, '0') || ':' || (CASE WHEN v = '' OR {d.like('v', '[\n\r]')} THEN 'empty' WHEN {d.like('v', T.NOTES)} THEN 'note' WHEN v <> s AND {d.like('v', T.ELLIPSIS)} THEN 'ellipsis' WHEN v <> s AND {d.like('v', T.TRADITIONAL)} THEN 'traditional'
        WHEN v = pv AND s <> ps AND length(s) >= 10 AND length(ps) >= 10 THEN 'merged' WHEN lost THEN 'symbol' WHEN length(s) >= 10 AND length(v) > 2.2 * length(s) + 30 THEN 'long' END) AS bad
      FROM (SELECT *, lag(v) OVER (PARTITION BY b ORDER BY idx) AS pv, lag(s) OVER (PARTITION BY b ORDER BY idx) AS ps FROM (SELECT t.b, t.idx, t.s, t.v, l.b IS NOT NULL AS lost FROM {d.values(CHECKED, 'b, idx, s, v')} t LEFT JOIN {_LOST(d)} l ON l.b = t.b AND l.idx = t.idx) e) x) y GROUP BY b""",
)
both("legacy_validation", lambda d: "SELECT conv_id, max(CASE WHEN n > 1 THEN 1 ELSE 0 END) = 0 AS passes FROM (SELECT conv_id, text, count(DISTINCT turn) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id, text) t GROUP BY conv_id")
both(
    "number_loss",
    lambda d: f"""SELECT b, idx, {d.size('want')} > 0 AND {d.both('want', 'got')} = 0 AND NOT {d.like('v', T.CN_NUMBER)} AS lost FROM (
      SELECT b, idx, v, {d.keep(d.each(d.extract_all('s', T.NUMBER), 'x', d.replace('x', '[,\\s]', '')), 'y', 'length(y) >= 2')} AS want, {d.each(d.extract_all('v', T.NUMBER), 'x', d.replace('x', '[,\\s]', ''))} AS got FROM {d.values(PAIRS, 'b, idx, s, v')} p) q""",
)
both(
    "pair_number_loss",
    lambda d: f"""SELECT conv_id, turn, {d.size('want')} > 0 AND {d.both('want', 'got')} = 0 AS lost FROM (
      SELECT conv_id, turn, {d.each(d.extract_all('text', T.NUMBER), 'x', d.replace('x', '[,\\s]', ''))} AS want, {d.each(d.extract_all('reply', T.NUMBER), 'x', d.replace('x', '[,\\s]', ''))} AS got FROM (
        SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations) c WHERE role = 'user' AND reply IS NOT NULL) q""",
)
both("math_symbol_loss", lambda d: f"SELECT p.b, p.idx, m.sym FROM {d.values(PAIRS, 'b, idx, s, v')} p JOIN {d.values(SYMBOLS, 'sym, alt')} m ON p.s LIKE concat('%', m.sym, '%') AND p.v NOT LIKE concat('%', m.sym, '%') AND lower(p.v) NOT LIKE concat('%', lower(m.alt), '%')")
_HIT = lambda d, text, en: f"CASE WHEN {en} LIKE '% %' OR {en} LIKE '%-%' THEN lower({text}) LIKE concat('%', lower({en}), '%') ELSE {d.like(text, 'X').replace(d.raw('X'), chr(39).join(['concat(', '(?i)(^|[^A-Za-z])(', f', {en}, ', '|', f', {en}, ', 's)($|[^A-Za-z])', ')']))} END"
#: Single words meet the words of a text by equality; terms of several words, of which a glossary has few, are looked for in the text.
_SINGLES = lambda d: f"(SELECT DISTINCT en, variant FROM (SELECT en, lower(en) AS variant FROM {d.values(GLOSSARY, 'grp, en, zh, ord')} g UNION ALL SELECT en, concat(lower(en), 's') FROM {d.values(GLOSSARY, 'grp, en, zh, ord')} g) v WHERE en NOT LIKE '% %' AND en NOT LIKE '%-%')"
_PHRASES = lambda d: f"(SELECT DISTINCT en FROM {d.values(GLOSSARY, 'grp, en, zh, ord')} g WHERE en LIKE '% %' OR en LIKE '%-%')"
_WORDS = lambda d: f"(SELECT doc_id, {d.rows_of(('array_distinct' if d.div == 'div' else 'list_distinct') + '(' + d.split(d.replace('lower(text)', '[^a-z]+', ' '), ' ') + ')')} AS word FROM documents)"
_FOUND = lambda d: f"(SELECT DISTINCT w.doc_id, s.en FROM {_WORDS(d)} w JOIN {_SINGLES(d)} s ON s.variant = w.word UNION ALL SELECT t.doc_id, p.en FROM documents t JOIN {_PHRASES(d)} p ON lower(t.text) LIKE concat('%', lower(p.en), '%'))"
_LOOKED = lambda d: f"(SELECT DISTINCT t.doc_id, g.en FROM documents t JOIN {d.values(GLOSSARY, 'grp, en, zh, ord')} g ON {_HIT(d, 't.text', 'g.en')})"
for _name, _of in (("glossary_hits_topk", lambda d, rows: f"SELECT doc_id, en, k FROM (SELECT doc_id, en, row_number() OVER (PARTITION BY doc_id ORDER BY length(en) DESC, en) AS k FROM {rows} h) r WHERE k <= 20"), ("glossary_usage", lambda d, rows: f"SELECT en, count(*) AS n_docs FROM {rows} h GROUP BY en")):
    both(_name, lambda d, of=_of: of(d, _FOUND(d)), lambda d, of=_of: of(d, _LOOKED(d)))
both("glossary_merge", lambda d: f"SELECT en, zh FROM (SELECT en, zh, row_number() OVER (PARTITION BY en ORDER BY ord) AS k FROM {d.values(GLOSSARY, 'grp, en, zh, ord')} g WHERE length(en) >= 2 AND zh <> '') r WHERE k = 1")
both("glossary_conflicts", lambda d: f"SELECT a.en, a.zh AS kept, b.zh AS refused FROM {d.values(GLOSSARY, 'grp, en, zh, ord')} a JOIN {d.values(GLOSSARY, 'grp, en, zh, ord')} b ON a.en = b.en AND a.ord < b.ord AND a.zh <> b.zh")
both("glossary_group_sizes", lambda d: f"SELECT grp, count(*) AS n FROM {d.values(GLOSSARY, 'grp, en, zh, ord')} g GROUP BY grp")
both("term_loss", lambda d: f"SELECT p.b, g.en FROM (SELECT b, {d.join('s', ' ', 'idx')} AS s, {d.join('v', ' ', 'idx')} AS v FROM {d.values(PAIRS, 'b, idx, s, v')} t GROUP BY b) p JOIN {d.values(GLOSSARY, 'grp, en, zh, ord')} g ON length(g.en) >= 8 AND length(g.zh) >= 2 AND p.v NOT LIKE concat('%', g.zh, '%') AND {_HIT(d, 'p.s', 'g.en')}")
both("hard_batches", lambda d: f"SELECT doc_id, batch, (avg(CASE WHEN length(line) <= 24 THEN 1.0 ELSE 0.0 END) >= 0.5 OR avg(CASE WHEN {d.like('line', T.LATIN)} AND length(line) - length(replace(line, ' ', '')) <= 2 THEN 1.0 ELSE 0.0 END) >= 0.4 OR avg(CASE WHEN {d.like('line', '[0-9]')} THEN 1.0 ELSE 0.0 END) >= 0.4) AS hard FROM (SELECT doc_id, i {d.div} 40 AS batch, line FROM {_stripped(d)} s WHERE line <> '') b GROUP BY doc_id, batch")
both("batch_fixed_clamped", lambda d: f"SELECT doc_id, batch, count(*) AS n, sum(length(line)) AS n_chars FROM (SELECT doc_id, line, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) {d.div} 30 AS batch FROM {_stripped(d)} s WHERE line <> '') b GROUP BY doc_id, batch")
both("neighbour_similarity", lambda d: f"SELECT doc_id, i, 100 * {d.both('g', 'h')} >= 45 * ({d.size('g')} + {d.size('h')} - {d.both('g', 'h')}) AS alike FROM (SELECT doc_id, i, {d.grams('c')} AS g, {d.grams('p')} AS h FROM (SELECT doc_id, i, c, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (SELECT doc_id, i, {d.replace('line', T.DEDUPE_STRIP, '')} AS c FROM {d.lines()} l) a) b WHERE length(c) >= 6 AND length(p) >= 6) x")
