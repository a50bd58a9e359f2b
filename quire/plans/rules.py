"""Queries of rules over replies, attempts, specifications and small records, on the rows that show each branch, and on the tables where they have such rows."""

from __future__ import annotations

from quire.functions import text as T
from quire.plans.dialect import Catalog, Spark

catalog = Catalog()
both = catalog.both

Q = "'"


def _stripped(d: Spark) -> str:
    return f"(SELECT doc_id, i, {T.strip(d, 'line')} AS line FROM {d.lines()} l)"


# --- filters and lines ----------------------------------------------------------------------------

both("unit_filter_legacy", lambda d: f"SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN line <> '' AND {d.like('line', T.LATIN)} AND NOT {d.like('line', T.NO_LETTER)} THEN 1 ELSE 0 END) AS n_units FROM {_stripped(d)} s GROUP BY doc_id")
both("unit_filter_fallback", lambda d: f"SELECT doc_id, i FROM {_stripped(d)} s WHERE {d.like('line', T.LATIN)}")
both("positional_merge", lambda d: f"SELECT s.doc_id, s.i, coalesce(t.value, s.line) AS merged FROM {_stripped(d)} s LEFT JOIN (SELECT doc_id, i, concat('=', line) AS value FROM {_stripped(d)} u WHERE {T.needs_translation(d, 'line')}) t ON t.doc_id = s.doc_id AND t.i = s.i")
both(
    "page_counters",
    lambda d: f"""SELECT doc_id, i {d.div} 40 AS page, sum(CASE WHEN sent THEN 1 ELSE 0 END) AS units, CAST(sum(CASE WHEN sent THEN length(line) ELSE 0 END) AS BIGINT) AS chars, sum(CASE WHEN line <> '' AND NOT sent THEN 1 ELSE 0 END) AS skipped,
      sum(CASE WHEN line = '' THEN 1 ELSE 0 END) AS empty, sum(CASE WHEN length(line) > 1500 THEN 1 ELSE 0 END) AS truncated FROM (SELECT doc_id, i, line, {T.needs_translation(d, 'line')} AS sent FROM {_stripped(d)} s) u GROUP BY doc_id, i {d.div} 40""",
)

#: Specifications of pages, of documents of ten pages.
SPECS = "('a', '1-3,5'), ('b', ''), ('c', ' 4 , 2-2 ,9-12,2'), ('d', '0-1'), ('e', '7-5,20')"


def _pages(d: Spark, specs: str = SPECS) -> str:
    """spec, page: each specification's pages, from 1, that the document has; all of them where it is empty."""
    part = f"(SELECT s, trim({d.extract('p', '^[^-]*')}) AS a, trim({d.extract('p', '[^-]*$')}) AS b FROM (SELECT s, {d.rows_of(d.split('spec', ','))} AS p FROM {d.values(specs, 's, spec')} v WHERE spec <> '') e)"
    listed = f"SELECT s, {d.rows_of(d.keep(d.upto('10'), 'x', 'x >= a AND x <= b'))} AS page FROM (SELECT s, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM {part} q) r"
    return f"(SELECT DISTINCT s, CAST(page AS BIGINT) AS page FROM ({listed} UNION ALL SELECT s, {d.rows_of(d.upto('10'))} FROM {d.values(specs, 's, spec')} w WHERE spec = '') t)"


both("page_specs", lambda d: f"SELECT s, page FROM {_pages(d)} p")
both("page_range_select", lambda d: f"SELECT l.doc_id, l.i, l.line FROM {d.lines()} l JOIN {_pages(d)} p ON p.s = 'a' AND p.page = l.i + 1")

#: (unit, place, line)
BROKEN = "('a', 1, 'The pub-'), ('a', 2, 'lic policy is strict.'), ('b', 1, 'one sentence here'), ('b', 2, 'and its tail.'), ('c', 1, 'well-'), ('c', 2, 'Known'), ('d', 1, 'a dash--'), ('d', 2, 'then more'), ('e', 1, 'soft­'), ('e', 2, 'ware'), ('f', 1, 'only')"


def _joined(d: Spark, rows: str, breaks: str) -> str:
    """unit, joined: the lines of each unit by blanks, but for those whose hyphen goes."""
    piece = f"CASE WHEN after IS NULL THEN line WHEN {breaks} THEN substring(line, 1, length(line) - 1) ELSE concat(line, ' ') END"
    return f"(SELECT u, {d.join(piece, '', 'k')} AS joined FROM (SELECT u, k, line, lead(line) OVER (PARTITION BY u ORDER BY k) AS after FROM {rows} r) l GROUP BY u)"


_SINGLE = lambda d: f"({d.like('line', '(^|[^-])-$')} AND {d.like('after', '^[a-z]')})"
_SOFT = lambda d: f"({d.like('line', '[-­]$')} AND {d.like('after', '^[a-z]')})"
both("hyphen_join", lambda d: f"SELECT a.u, a.joined AS single_hyphen, b.joined AS any_hyphen FROM {_joined(d, d.values(BROKEN, 'u, k, line'), _SINGLE(d))} a JOIN {_joined(d, d.values(BROKEN, 'u, k, line'), _SOFT(d))} b ON a.u = b.u")
both("hyphen_join_documents", lambda d: f"SELECT u AS doc_id, {d.hex256('joined')} AS joined_hash, length(joined) AS n_chars FROM {_joined(d, '(SELECT doc_id AS u, i AS k, line FROM ' + _stripped(d) + ' s WHERE line <> ' + Q * 2 + ')', _SOFT(d))} j")

# --- terms, names, records ------------------------------------------------------------------------

TERMS = "('firm'), ('box'), ('church'), ('policy'), ('day'), ('marginal cost'), ('cost-benefit'), ('tax policy'), ('gas'), ('y')"


def _plural(d: Spark, word: str) -> str:
    """The regular plural of an English noun; no irregular one is guessed."""
    return f"CASE WHEN {d.like(word, '(?i)(s|x|z|ch|sh)$')} THEN concat({word}, 'es') WHEN {d.like(word, '(?i)[^aeiou]y$')} THEN concat(substring({word}, 1, length({word}) - 1), 'ies') ELSE concat({word}, 's') END"


both("term_variants", lambda d: f"SELECT term, concat(substring(term, 1, length(term) - length(last)), {_plural(d, 'last')}) AS plural FROM (SELECT term, {d.extract('term', '[^ -]+$')} AS last FROM {d.values(TERMS, 'term')} v) w")
ADDRESSES = "(1, 'anna@example.com'), (2, 'al@b.c'), (3, 'x@y.zz'), (4, 'first.last@sub.example.org'), (5, 'a@b@c.d')"
both("email_mask_cases", lambda d: f"SELECT id, {T.email_mask(d, 'email')} AS masked FROM {d.values(ADDRESSES, 'id, email')} v")
both("utc8_keys", lambda d: f"SELECT event_id, {d.day(d.plus('ts', 8, 'HOURS'))} AS day_key, {d.day('date_trunc(' + Q + 'month' + Q + ', ' + d.plus('ts', 8, 'HOURS') + ')')} AS month_start FROM events")
COOKIES = "(1, 'sid=abc%20d; theme=dark'), (2, ''), (3, ' a = 1 ;b==2;c;=x'), (4, 'k=1; k=2')"
_NAME, _REST = "trim(split_part(trim(p), '=', 1))", "substring(trim(p), length(split_part(trim(p), '=', 1)) + 2)"
both("cookie_parse", lambda d: f"SELECT id, name, value FROM (SELECT id, {_NAME} AS name, url_decode({_REST}) AS value, row_number() OVER (PARTITION BY id, {_NAME} ORDER BY k DESC) AS back FROM (SELECT id, k, {'parts[k - 1]' if d.div == 'div' else 'parts[k]'} AS p FROM (SELECT id, parts, {d.rows_of(d.upto(d.size('parts').replace('BIGINT', 'INT')))} AS k FROM (SELECT id, {d.split('cookie', ';')} AS parts FROM {d.values(COOKIES, 'id, cookie')} v) s) e) f) g WHERE back = 1 AND name <> ''")
#: Spellings of the two protocols.
PROTOCOLS = "('', 'chat'), ('chat', 'chat'), ('chat/completions', 'chat'), ('chat_completions', 'chat'), ('completions', 'chat'), ('openai', 'chat'), ('responses', 'responses'), ('response', 'responses'), ('/responses', 'responses')"
SPELT = "(1, 'OpenAI'), (2, ' /responses '), (3, 'chat_completions'), (4, ''), (5, 'grpc'), (6, 'Response')"
both("protocol_alias", lambda d: f"SELECT v.id, p.protocol FROM {d.values(SPELT, 'id, name')} v LEFT JOIN {d.values(PROTOCOLS, 'alias, protocol')} p ON p.alias = lower(trim(v.name))")
#: What an error says when the channel, not the request, is at fault.
LIMITED = ["429", "rate_limit", "rate limit", "too many requests", "使用限制", "限流", "quota", "402", "insufficient", "balance", "余额不足", "余额不够", "欠费", "arrears", "billing", "payment required"]
ERRORS = "(1, 'HTTP 429 Too Many Requests'), (2, 'account Balance is insufficient'), (3, 'timeout'), (4, '账户欠费'), (5, 'Rate limit reached'), (6, 'HTTP 500'), (7, 'Payment Required'), (8, null)"
both("rate_limit_errors", lambda d: f"SELECT id, coalesce({' OR '.join(f'lower(v) LIKE {Q}%{h}%{Q}' for h in LIMITED)}, false) AS limited FROM {d.values(ERRORS, 'id, v')} e")
JOB_NAMES = "(1, 'smoke-test.pdf', 'u1'), (2, 'SMOKE_refine.pdf', 'u1'), (3, 'smoked fish.pdf', 'u1'), (4, 'report.pdf', null), (5, 'report.pdf', ''), (6, 'report.pdf', 'u2')"
both("automation_jobs", lambda d: f"SELECT id, {d.like('name', '(?i)^smoke[-_]')} OR coalesce(user_id, '') = '' AS automatic FROM {d.values(JOB_NAMES, 'id, name, user_id')} v")
SEARCHES = "(1, '50%', '50% off'), (2, '50%', '500 off'), (3, 'a_b', 'xa_by'), (4, 'a_b', 'xacby'), (5, '!', 'wow!'), (6, '', 'any')"
both("search_escaped", lambda d: f"SELECT id, name LIKE concat('%', replace(replace(replace(term, '!', '!!'), '%', '!%'), '_', '!_'), '%') ESCAPE '!' AS found FROM {d.values(SEARCHES, 'id, term, name')} v")
both("kv_prefix_page", lambda d: "SELECT doc_key, n_chars FROM (SELECT concat('job/', source, '/', lpad(CAST(doc_id AS STRING), 12, '0')) AS doc_key, n_chars FROM documents) k WHERE doc_key LIKE 'job/%' AND doc_key > 'job/src1' ORDER BY doc_key LIMIT 100")
NAMES = "(1, 'a b.pdf'), (2, '译文.docx'), (3, 'x-1_2.pdf')"
both("download_star", lambda d: f"SELECT id, concat('attachment; filename*=UTF-8', chr(39), chr(39), replace(url_encode(name), '+', '%20')) AS header FROM {d.values(NAMES, 'id, name')} v")
both("exists_any", lambda d: "SELECT count(*) > 0 AS found FROM (SELECT 1 AS one FROM events WHERE event_type = 'error' LIMIT 1) e")
CHANNELS = "(1, 'a,b,a,c,b'), (2, 'x'), (3, 'z,z,y')"
both("channel_dedupe", lambda d: f"SELECT id, {d.join('c', ',', 'k')} AS channels FROM (SELECT id, c, min(k) AS k FROM (SELECT id, k, {'parts[k - 1]' if d.div == 'div' else 'parts[k]'} AS c FROM (SELECT id, parts, {d.rows_of(d.upto(d.size('parts').replace('BIGINT', 'INT')))} AS k FROM (SELECT id, {d.split('list', ',')} AS parts FROM {d.values(CHANNELS, 'id, list')} v) s) e) f GROUP BY id, c) g GROUP BY id")
both("run_adoption", lambda d: f"SELECT o.o_orderkey AS job, min(r.run) AS run FROM orders o JOIN (SELECT l_orderkey * 10 + l_linenumber AS run, {d.extract('concat(' + Q + 'translate job-' + Q + ', CAST(l_orderkey AS STRING), ' + Q + ' part ' + Q + ', CAST(l_linenumber AS STRING))', 'job-[0-9]+')} AS job_id FROM lineitem) r ON r.job_id = concat('job-', CAST(o.o_orderkey AS STRING)) GROUP BY o.o_orderkey")
#: Formats and modes, whether they can run, and their options; fixed values of the interface.
PIPELINES = "('pdf', 'inplace', true), ('pdf', 'bilingual', true), ('pdf', 'ocr', false), ('docx', 'inplace', true), ('docx', 'bilingual', true)"
PIPE_OPTIONS = "('pdf', 'inplace', 'font_scale', 'number'), ('pdf', 'inplace', 'pages', 'text'), ('pdf', 'bilingual', 'pages', 'text'), ('pdf', 'ocr', 'dpi', 'number'), ('docx', 'bilingual', 'style', 'text')"
both("capability_list", lambda d: f"SELECT p.format, p.mode, p.available, CASE WHEN p.available THEN '' ELSE 'not available' END AS error, count(o.name) AS n_options, coalesce({d.join('o.name || ' + Q + ':' + Q + ' || o.kind', ',', 'o.name')}, '') AS options FROM {d.values(PIPELINES, 'format, mode, available')} p LEFT JOIN {d.values(PIPE_OPTIONS, 'format, mode, name, kind')} o ON o.format = p.format AND o.mode = p.mode AND p.available GROUP BY p.format, p.mode, p.available")

# --- counters and costs ---------------------------------------------------------------------------

_NINE = {"jobs": "1", "chars_in": "cents", "chars_out": "cents * 2", "calls": "k + 1", "pages": "k * 3", "files_in": "CASE WHEN kind = 'signup' THEN 1 ELSE 0 END", "failed": "CASE WHEN kind = 'error' THEN 1 ELSE 0 END", "tokens_in": "CASE WHEN k > 50 THEN cents ELSE 0 END", "tokens_out": "CASE WHEN k > 50 THEN cents * 3 ELSE 0 END"}
_USAGE = lambda d: f"(SELECT {d.day('ts')} AS usage_day, user_id, event_type AS kind, CAST(round(value * 100) AS BIGINT) AS cents, coalesce(CAST({d.json('props', '$.k')} AS BIGINT), 0) AS k FROM events)"
_SUMS = ", ".join(f"CAST(sum({x}) AS BIGINT) AS {n}" for n, x in _NINE.items())
both("usage_counters", lambda d: f"SELECT usage_day, user_id, {_SUMS} FROM {_USAGE(d)} u GROUP BY GROUPING SETS ((usage_day), (usage_day, user_id))")
#: Tokens where the interface gave any, else characters by what they cost in tokens; prices are per million tokens.
PRICE_IN, PRICE_OUT, CHARS_IN, CHARS_OUT = 1.0, 2.0, 4.0, 1.6
both(
    "cost_estimate",
    lambda d: f"""SELECT user_id, tokens_in, tokens_out, round(tokens_in / 1000000.0 * {PRICE_IN} + tokens_out / 1000000.0 * {PRICE_OUT}, 4) AS cost, is_exact FROM (
      SELECT user_id, CASE WHEN t_in > 0 THEN t_in ELSE CAST(floor(c_in / {CHARS_IN}) AS BIGINT) END AS tokens_in, CASE WHEN t_out > 0 THEN t_out ELSE CAST(floor(c_out / {CHARS_OUT}) AS BIGINT) END AS tokens_out, t_in > 0 OR t_out > 0 AS is_exact FROM (
        SELECT user_id, CAST(sum(cents) AS BIGINT) AS c_in, CAST(sum(cents * 2) AS BIGINT) AS c_out, CAST(sum(CASE WHEN user_id % 2 = 0 THEN k ELSE 0 END) AS BIGINT) AS t_in, CAST(sum(CASE WHEN user_id % 4 = 0 THEN k * 2 ELSE 0 END) AS BIGINT) AS t_out FROM {_USAGE(d)} u GROUP BY user_id) a) b""",
)
both("stats_json", lambda d: f"SELECT user_id, concat('{{\"jobs\":', CAST(jobs AS STRING), ',\"calls\":', CAST(calls AS STRING), ',\"failed\":', CAST(failed AS STRING), '}}') AS body FROM (SELECT user_id, {_SUMS} FROM {_USAGE(d)} u GROUP BY user_id) s")
both("image_count_check", lambda d: f"SELECT page_id, before, after, before = after AS kept FROM (SELECT page_id, CAST({d.count('html', '<img')} AS BIGINT) AS before, CAST({d.count(d.replace('html', '>[^<]+<', '>x<'), '<img')} AS BIGINT) AS after FROM pages) p")

# --- replies, attempts ----------------------------------------------------------------------------

#: (id, items, reply): fenced, in talk, a key missing, a blank value, a key too many.
REPLIES = "(1, 1, '```json\n{\"1\": \"你好\"}\n```'), (2, 2, 'Sure! Here you go: {\"1\": \"你好\", \"2\": \"世界\"} Hope it helps.'), (3, 2, '{\"1\": \"只有一条\"}'), (4, 1, '{\"1\": \"  \"}'), (5, 3, '{\"2\": \"b\", \"1\": \"a\", \"3\": \" c \"}'), (6, 1, 'none')"


def _parsed(d: Spark) -> str:
    body = d.extract("reply", "(?s)[{].*[}]")
    values = d.each(d.upto("n"), "k", f"trim({'get_json_object' if d.div == 'div' else 'json_extract_string'}(body, concat('$.', CAST(k AS STRING))))")
    whole = f"{d.size(d.keep('v', 'x', 'x IS NOT NULL AND x <> ' + Q * 2))} = n"
    return f"SELECT id, CASE WHEN {whole} THEN {d.joined('v', '|')} END AS parsed FROM (SELECT id, n, {values} AS v FROM (SELECT id, n, CASE WHEN {body} <> '' THEN {body} ELSE '{{}}' END AS body FROM {d.values(REPLIES, 'id, n, reply')} r) b) p"


both("reply_parse", _parsed)
REASONS = "(1, '第 1 条含繁体字'), (2, '第 2 条含省略号'), (3, '第 1 条含元注释'), (4, '丢失数学符号 √'), (5, '疑似合并'), (6, '为空或含换行'), (7, '术语未使用'), (8, '疑似丢失数字'), (9, 'other')"
#: The first needle that a reason has, in this order, chooses the hint.
HINTS = [("繁体", "simplified only"), ("省略号", "no ellipsis"), ("元注释", "no comments"), ("数学符号", "keep symbols"), ("合并", "one to one"), ("换行", "single line"), ("为空", "single line"), ("术语", "use terms"), ("数字", "keep numbers")]
both("correction_hint", lambda d: f"SELECT id, CASE {' '.join(f'WHEN reason LIKE {Q}%{n}%{Q} THEN {Q}{h}{Q}' for n, h in HINTS)} ELSE 'one to one' END AS hint FROM {d.values(REASONS, 'id, reason')} r")
#: (batch, place in the chain, channel, attempt from 0, outcome): ok, soft (valid, could be better), invalid, network, limited.
ATTEMPTS = """('a', 0, 'x', 0, 'ok'), ('b', 0, 'x', 0, 'soft'), ('b', 0, 'x', 1, 'soft'), ('c', 0, 'x', 0, 'invalid'), ('c', 0, 'x', 1, 'invalid'), ('c', 0, 'x', 2, 'invalid'), ('c', 1, 'strong', 0, 'ok'),
('d', 0, 'x', 0, 'limited'), ('d', 0, 'x', 1, 'ok'), ('d', 1, 'y', 0, 'network'), ('d', 1, 'y', 1, 'ok'), ('e', 0, 'x', 0, 'limited'), ('e', 1, 'y', 0, 'invalid'), ('e', 1, 'y', 1, 'invalid'), ('e', 1, 'y', 2, 'invalid'), ('e', 1, 'y', 3, 'ok'),
('f', 0, 'x', 0, 'soft'), ('f', 0, 'x', 1, 'invalid'), ('f', 0, 'x', 2, 'ok')"""


def _tried(d: Spark) -> str:
    """b, pos, channel, won (the attempt that was taken), calls, retries, soft_retries of each channel of a batch: at most three attempts, none after a limit."""
    mine = f"(SELECT b, pos, channel, n, outcome, coalesce(min(CASE WHEN outcome = 'limited' THEN n END) OVER w, 99) AS cut FROM {d.values(ATTEMPTS, 'b, pos, channel, n, outcome')} a WHERE n < 3 WINDOW w AS (PARTITION BY b, pos))"
    won = f"(SELECT *, min(CASE WHEN n < cut AND (outcome = 'ok' OR outcome = 'soft' AND n > 0) THEN n END) OVER (PARTITION BY b, pos) AS won FROM {mine} m)"
    return f"(SELECT b, pos, channel, won, sum(CASE WHEN outcome IN ('ok', 'soft', 'invalid') THEN 1 ELSE 0 END) AS calls, sum(CASE WHEN outcome = 'invalid' THEN 1 ELSE 0 END) AS retries, sum(CASE WHEN outcome = 'soft' AND n = 0 THEN 1 ELSE 0 END) AS soft_retries FROM {won} t WHERE n <= cut AND n <= coalesce(won, 99) GROUP BY b, pos, channel, won)"


both("attempt_replay", lambda d: f"SELECT b, pos, channel, won, calls, retries, soft_retries FROM {_tried(d)} t")
both("failover_replay", lambda d: f"SELECT b, channel, CASE WHEN pos > 0 THEN 1 ELSE 0 END AS fallbacks, CASE WHEN channel = 'strong' THEN 1 ELSE 0 END AS escalated FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY pos) AS k FROM {_tried(d)} t WHERE won IS NOT NULL) f WHERE k = 1")


def _ladder(d: Spark, sizes: tuple[int, ...] = (20, 5, 1)) -> str:
    """The lines that failed, regrouped smaller and smaller; a group fails where it holds a line that the model refuses (here: of a length divisible by 17)."""
    pending = f"(SELECT doc_id, i, length(line) % 17 = 0 AS bad, i {d.div} 50 AS batch FROM {_stripped(d)} s WHERE line <> '')"
    pending = f"(SELECT doc_id, i, bad FROM (SELECT *, max(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, batch) AS fails FROM {pending} p) q WHERE fails = 1)"
    calls = []
    for size in sizes:
        grouped = f"(SELECT doc_id, i, bad, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1) {d.div} {size} AS g FROM {pending} p)"
        failed = f"(SELECT *, max(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, g) AS fails FROM {grouped} q)"
        calls.append(f"SELECT doc_id, {size} AS size, count(DISTINCT g) AS calls, count(*) AS pending, sum(CASE WHEN fails = 1 THEN 1 ELSE 0 END) AS left_over FROM {failed} f GROUP BY doc_id")
        pending = f"(SELECT doc_id, i, bad FROM {failed} f WHERE fails = 1)"
    return " UNION ALL ".join(calls)


both("retry_ladder", _ladder)
#: An older engine: a whole group in three tries, then line by line; a group's tries fail where it holds a refused line.
both("legacy_retry", lambda d: f"SELECT doc_id, g, CASE WHEN bad > 0 THEN 3 + n ELSE 1 END AS calls, bad AS failed FROM (SELECT doc_id, i {d.div} 40 AS g, count(*) AS n, sum(CASE WHEN length(line) % 17 = 0 THEN 1 ELSE 0 END) AS bad FROM {_stripped(d)} s WHERE line <> '' GROUP BY doc_id, i {d.div} 40) q")
