"""Queries of the sequential operators and of stateful behaviour; the oracle walks rows with recursive CTEs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import folds
from quire.plans.dialect import Catalog, Duck, Spark, run_sql

catalog = Catalog()
both = catalog.both


def units(d: Spark) -> str:
    """doc_id, k from 0, n characters of the units to send."""
    return f"(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, length(line) AS n FROM (SELECT doc_id, i, {T.strip(d, 'line')} AS line FROM {d.lines()} l) s WHERE {T.needs_translation(d, 'line')})"


def pages(d: Spark) -> str:
    return f"(SELECT doc_id, i {d.div} 4 AS k, sum(CASE WHEN line <> '' THEN 1 ELSE 0 END) AS n FROM {d.lines()} l GROUP BY doc_id, i {d.div} 4)"


def hits(d: Spark, extra: str = "") -> str:
    return f"(SELECT user_id, {d.seconds('ts')} AS t, event_id AS id{extra} FROM events)"


def walk(d: Spark, rows: str, key: str, order: str, start: dict[str, str], step: dict[str, str], out: str) -> str:
    """Recursive CTE: ``step`` gives each state column from the last row's (s.) and the next row (x.)."""
    names = list(start)
    return f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS at_row FROM {rows} q), w AS (
      SELECT {', '.join(f'x.{c}' for c in out.split(', ') if not c.startswith('='))}, x.at_row, x.{key} AS at_key, {', '.join(f'{start[c]} AS {c}' for c in names)} FROM o x WHERE at_row = 1
      UNION ALL SELECT {', '.join(f'x.{c}' for c in out.split(', ') if not c.startswith('='))}, x.at_row, x.{key}, {', '.join(step[c] for c in names)} FROM w s JOIN o x ON x.{key} = s.at_key AND x.at_row = s.at_row + 1)
    SELECT {out.replace('=', '')} FROM w"""


def _frame(text):
    return run_sql(text(Spark()))


def greedy(name: str, n: int, chars: int, after: bool = False) -> None:
    full = f"(s.c >= {n} OR s.chars >= {chars})" if after else f"(s.c + 1 > {n} OR s.chars + x.n > {chars})"
    catalog.add(
        name,
        lambda spark, sf: folds.greedy_batches(_frame(lambda d: f"SELECT * FROM {units(d)} u")(spark, sf), n, chars, after),
        lambda d: walk(d, units(d), "doc_id", "k", {"batch": "0", "c": "1", "chars": "x.n"}, {"batch": f"s.batch + CASE WHEN {full} THEN 1 ELSE 0 END", "c": f"CASE WHEN {full} THEN 1 ELSE s.c + 1 END", "chars": f"CASE WHEN {full} THEN x.n ELSE s.chars + x.n END"}, "doc_id, k, =batch"),
    )


greedy("batch_greedy_60_6000", 60, 6000)
greedy("batch_prefetch_50_3000", 50, 3000)
greedy("batch_100_3500", 100, 3500)
greedy("batch_flush_after_25_4000", 25, 4000, True)
catalog.add(
    "batch_page_accumulate",
    lambda spark, sf: folds.accumulate_pages(_frame(lambda d: f"SELECT * FROM {pages(d)} u")(spark, sf)),
    lambda d: walk(d, pages(d), "doc_id", "k", {"batch": "0", "units": "x.n"}, {"batch": "s.batch + CASE WHEN s.units >= 30 THEN 1 ELSE 0 END", "units": "CASE WHEN s.units >= 30 THEN x.n ELSE s.units + x.n END"}, "doc_id, k, =batch"),
)
_NEXT = "(s.c >= s.take OR s.chars + x.n > 3500)"
_TAKE = "CAST(ceil(x.remain / ceil(x.remain / 100.0)) AS BIGINT)"
_LEFT = lambda d: f"(SELECT *, count(*) OVER (PARTITION BY doc_id) - k AS remain FROM {units(d)} u)"
catalog.add(
    "batch_balanced",
    lambda spark, sf: folds.balanced_batches(_frame(lambda d: f"SELECT * FROM {units(d)} u")(spark, sf), 100, 3500).groupBy("doc_id", "batch").agg(F.count("*").alias("n")),
    lambda d: f"SELECT doc_id, batch, count(*) AS n FROM ({walk(d, _LEFT(d), 'doc_id', 'k', {'batch': '0', 'c': '1', 'chars': 'x.n', 'take': _TAKE}, {'batch': f's.batch + CASE WHEN {_NEXT} THEN 1 ELSE 0 END', 'c': f'CASE WHEN {_NEXT} THEN 1 ELSE s.c + 1 END', 'chars': f'CASE WHEN {_NEXT} THEN x.n ELSE s.chars + x.n END', 'take': f'CASE WHEN {_NEXT} THEN {_TAKE} ELSE s.take END'}, 'doc_id, k, =batch')}) z GROUP BY doc_id, batch",
)
catalog.add(
    "rate_limit_fixed_window",
    lambda spark, sf: folds.rate_limit(_frame(lambda d: f"SELECT * FROM {hits(d)} h")(spark, sf), 5, 86400),
    lambda d: walk(d, hits(d), "user_id", "t, id", {"since": "x.t", "n": "1"}, {"since": "CASE WHEN x.t - s.since > 86400 THEN x.t ELSE s.since END", "n": "CASE WHEN x.t - s.since > 86400 THEN 1 ELSE s.n + 1 END"}, "user_id, t, id, =n > 5 AS over"),
)
FAILED = ", event_type = 'error' AS failed"
catalog.add(
    "circuit_breaker",
    lambda spark, sf: folds.circuit_breaker(_frame(lambda d: f"SELECT * FROM {hits(d, FAILED)} h")(spark, sf), 2, 43200),
    lambda d: f"SELECT user_id, t, id, cooling FROM ({walk(d, hits(d, FAILED), 'user_id', 't, id', {'cooling': 'false', 'n': 'CASE WHEN x.failed THEN 1 ELSE 0 END', 'until': 'CAST(0 AS BIGINT)'}, {'cooling': 'x.t < s.until', 'n': 'CASE WHEN x.t < s.until THEN s.n WHEN NOT x.failed THEN 0 WHEN s.n + 1 >= 2 THEN 0 ELSE s.n + 1 END', 'until': 'CASE WHEN x.t >= s.until AND x.failed AND s.n + 1 >= 2 THEN x.t + 43200 ELSE s.until END'}, 'user_id, t, id, =cooling')}) z",
)

QUOTA_DAYS = 30
catalog.add(
    "quota_reset_30d",
    lambda spark, sf: folds.quota_reset(_frame(lambda d: f"SELECT * FROM {hits(d, ', CAST(floor(value) AS BIGINT) AS pages')} h")(spark, sf), QUOTA_DAYS),
    lambda d: walk(d, hits(d, ", CAST(floor(value) AS BIGINT) AS pages"), "user_id", "t, id", {"since": "x.t", "used": "x.pages"}, {"since": "CASE WHEN x.t - s.since > 2592000 THEN x.t ELSE s.since END", "used": "CASE WHEN x.t - s.since > 2592000 THEN x.pages ELSE s.used + x.pages END"}, "user_id, t, id, =used"),
)


def stripped(d: Spark) -> str:
    return f"(SELECT doc_id, i AS k, {d.replace('line', T.DEDUPE_STRIP, '')} AS c FROM {d.lines()} l)"


def _alike() -> str:
    d = Duck()
    a, b = d.grams("s.last"), d.grams("x.c")
    return f"(length(s.last) >= 6 AND length(x.c) >= 6 AND 100 * {d.both(a, b)} >= 45 * (len({a}) + len({b}) - {d.both(a, b)}))"


catalog.add(
    "adjacent_dedupe",
    lambda spark, sf: folds.keep_last_different(_frame(lambda d: f"SELECT * FROM {stripped(d)} u")(spark, sf)),
    lambda d: walk(d, stripped(d), "doc_id", "k", {"dropped": "false", "last": "x.c"}, {"dropped": _alike(), "last": f"CASE WHEN {_alike()} THEN s.last ELSE x.c END"}, "doc_id, k, =dropped"),
)
both("progress_monotone", lambda d: f"SELECT user_id, event_id, max(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS done FROM events")
both("status_monotone", lambda d: "SELECT user_id, event_id, CASE WHEN max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'done' ELSE event_type END AS status FROM events")
both("ledger_once", lambda d: "SELECT user_id, event_id, value FROM (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) e WHERE k = 1")
both("ttl_live_rows", lambda d: "SELECT event_id FROM events WHERE ts >= TIMESTAMP'2024-01-28 00:00:00' OR (event_type = 'signup' AND ts >= TIMESTAMP'2024-01-01 00:00:00')")
both("job_last_state", lambda d: "SELECT user_id, CASE WHEN event_type IN ('view', 'click') THEN 'error' ELSE event_type END AS state FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) e WHERE k = 1")
both("event_tail", lambda d: "SELECT user_id, event_id, seq FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) e WHERE back <= 20 AND seq > 3")
both("daily_counters", lambda d: f"SELECT {d.day('ts')} AS usage_day, count(*) AS n FROM events GROUP BY {d.day('ts')}")


# --- units of lines with boxes --------------------------------------------------------------------

#: Lines of documents on a page of their own, in boxes by rule: every fifth is indented, every seventh larger, every sixth after a gap.
BOXED = lambda d: f"(SELECT doc_id, k, line, 72 + CASE WHEN k % 5 = 4 THEN 30 ELSE 0 END AS x0, 16 * k + 20 * (k {d.div} 6) AS y0, 16 * k + 20 * (k {d.div} 6) + 13 AS y1, 11 + CASE WHEN k % 7 = 6 THEN 3 ELSE 0 END AS size FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, line FROM (SELECT doc_id, i, {T.strip(d, 'line')} AS line FROM {d.lines()} l) s WHERE line <> '') n)"


def followers(d: Spark, rows: str) -> str:
    """doc_id, k, n, follows, glue of ``rows`` (doc_id, k, line, x0, y0, y1, size): whether a line goes on with the one before, by text, left edge, gap and size.

    The gap may be that of three quarters of the size, six points, or 1.35 of the page's usual one: its fifth from below, of at least four.
    """
    w = "WINDOW w AS (PARTITION BY doc_id ORDER BY k)"
    before = f"(SELECT *, coalesce(lag(line) OVER w, '') AS prev, x0 - lag(x0) OVER w AS shift, y0 - lag(y1) OVER w AS gap, lag(size) OVER w AS psize FROM {rows} r {w})"
    ranked = f"(SELECT doc_id, gap, row_number() OVER (PARTITION BY doc_id ORDER BY gap, k) - 1 AS place, count(*) OVER (PARTITION BY doc_id) AS n FROM {before} b WHERE gap > 0)"
    usual = f"(SELECT doc_id, gap AS usual FROM {ranked} g WHERE n >= 4 AND place = n {d.div} 5)"
    hyphen = f"({d.like('prev', '[-­]$')} AND {d.like('line', '^[a-z]')})"
    fits = "abs(shift) <= 15 AND gap >= -3 AND gap <= greatest(6.0, 0.75 * psize, 1.35 * coalesce(usual, 0)) AND abs(size - psize) <= 1.5"
    return f"(SELECT b.doc_id, k, CAST(length(line) AS BIGINT) AS n, coalesce({T.can_follow(d, 'prev', 'line')} AND {fits}, false) AS follows, CAST(CASE WHEN {hyphen} THEN -1 ELSE 1 END AS BIGINT) AS glue FROM {before} b LEFT JOIN {usual} u ON u.doc_id = b.doc_id)"


_JOINS = "(x.follows AND s.c < 12 AND s.chars + x.glue + x.n <= 1500)"
_MERGED = lambda d: walk(d, followers(d, BOXED(d)), "doc_id", "k", {"unit": "0", "c": "1", "chars": "x.n"}, {"unit": f"s.unit + CASE WHEN {_JOINS} THEN 0 ELSE 1 END", "c": f"CASE WHEN {_JOINS} THEN s.c + 1 ELSE 1 END", "chars": f"CASE WHEN {_JOINS} THEN s.chars + x.glue + x.n ELSE x.n END"}, "doc_id, k, =unit")
catalog.add("merge_units_boxes", lambda spark, sf: folds.merge_units(_frame(lambda d: f"SELECT * FROM {followers(d, BOXED(d))} f")(spark, sf)), _MERGED)


def _translate_stats(spark, sf_dir):
    sent = _frame(lambda d: f"SELECT * FROM {units(d)} u")(spark, sf_dir)
    batches = folds.greedy_batches(sent, 60, 6000).join(sent, ["doc_id", "k"])
    done = batches.groupBy("doc_id").agg((F.max("batch") + 1).alias("batches"), F.count("*").alias("sent"), F.sum("n").cast("long").alias("chars_in"))
    lines = _frame(lambda d: f"SELECT doc_id, count(*) AS n_lines FROM {d.lines()} l GROUP BY doc_id")(spark, sf_dir)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return lines.join(done, "doc_id", "left").select("doc_id", zero("batches"), zero("chars_in"), (F.col("n_lines") - F.coalesce("sent", F.lit(0))).alias("skipped"))


_GREEDY = lambda d: walk(d, units(d), "doc_id", "k", {"batch": "0", "c": "1", "chars": "x.n"}, {"batch": "s.batch + CASE WHEN (s.c + 1 > 60 OR s.chars + x.n > 6000) THEN 1 ELSE 0 END", "c": "CASE WHEN (s.c + 1 > 60 OR s.chars + x.n > 6000) THEN 1 ELSE s.c + 1 END", "chars": "CASE WHEN (s.c + 1 > 60 OR s.chars + x.n > 6000) THEN x.n ELSE s.chars + x.n END"}, "doc_id, k, n, =batch")
catalog.add(
    "translate_stats",
    _translate_stats,
    lambda d: f"SELECT l.doc_id, coalesce(g.batches, 0) AS batches, coalesce(g.chars_in, 0) AS chars_in, l.n_lines - coalesce(g.sent, 0) AS skipped FROM (SELECT doc_id, count(*) AS n_lines FROM {d.lines()} x GROUP BY doc_id) l LEFT JOIN (SELECT doc_id, max(batch) + 1 AS batches, count(*) AS sent, CAST(sum(n) AS BIGINT) AS chars_in FROM ({_GREEDY(d)}) w GROUP BY doc_id) g ON g.doc_id = l.doc_id",
)
