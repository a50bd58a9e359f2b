"""Queries over line boxes: columns, paragraphs, gaps, overlaps, bands, audit. Boxes are made of line items by integer arithmetic; an order is a page."""

from __future__ import annotations

from quire.plans.dialect import Catalog, Spark

catalog = Catalog()
both = catalog.both

BOXES = "(SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, (l_partkey % 5) * 40 AS x0, l_linenumber * 15 + l_suppkey % 7 AS y0, (l_partkey % 5) * 40 + 60 + CAST(l_quantity AS BIGINT) * 4 AS x1, l_linenumber * 15 + l_suppkey % 7 + 12 AS y1, 9 + l_suppkey % 4 AS size FROM lineitem)"
PAIR = f"{BOXES} a JOIN {BOXES} b ON a.page = b.page"

both("column_clusters", lambda d: f"SELECT page, i, sum(opens) OVER (PARTITION BY page ORDER BY x0, i) AS col FROM (SELECT page, i, x0, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0, i) > 30 THEN 1 ELSE 0 END AS opens FROM {BOXES} b) c")
both(
    "paragraph_groups",
    lambda d: f"SELECT page, para, count(*) AS n, min(x0) AS x0, max(x1) AS x1 FROM (SELECT *, sum(opens) OVER (PARTITION BY page ORDER BY y0, x0, i) AS para FROM (SELECT *, CASE WHEN y0 - lag(y1) OVER w BETWEEN -4 AND 6 AND abs(x0 - lag(x0) OVER w) <= 15 AND abs(size - lag(size) OVER w) <= 2.5 THEN 0 ELSE 1 END AS opens FROM {BOXES} b WINDOW w AS (PARTITION BY page ORDER BY y0, x0, i)) c) p GROUP BY page, para",
)
both("gap_baseline", lambda d: f"SELECT page, CASE WHEN n < 4 THEN 0 ELSE gap END AS baseline FROM (SELECT page, gap, row_number() OVER (PARTITION BY page ORDER BY gap, i) - 1 AS k, count(*) OVER (PARTITION BY page) AS n FROM (SELECT page, i, y0 - lag(y1) OVER (PARTITION BY page ORDER BY y0, i) AS gap FROM {BOXES} b) g WHERE gap > 0) r WHERE k = n {d.div} 5")
both("median_line_width", lambda d: f"SELECT page, w FROM (SELECT page, x1 - x0 AS w, row_number() OVER (PARTITION BY page ORDER BY x1 - x0, i) - 1 AS k, count(*) OVER (PARTITION BY page) AS n FROM {BOXES} b) r WHERE k = n {d.div} 2")
both("modal_event_type", lambda d: "SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS k FROM events GROUP BY user_id, event_type) m WHERE k = 1")
both("bilingual_style_bucket", lambda d: f"SELECT page, CASE WHEN avg(size) >= 11.5 THEN 14.0 WHEN avg(size) >= 10 THEN 10.5 ELSE 8.5 END AS bucket, max(CASE WHEN size >= 12 THEN 1 ELSE 0 END) = 1 AS bold FROM {BOXES} b GROUP BY page")
both("overlap_pairs", lambda d: f"SELECT a.page, a.i AS i, b.i AS j FROM {PAIR} AND a.i < b.i AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
both("nearest_line", lambda d: f"SELECT page, i, j FROM (SELECT a.page, a.i AS i, b.i AS j, row_number() OVER (PARTITION BY a.page, a.i ORDER BY abs(a.y1 - b.y1), b.x0 - b.x1, b.i) AS k FROM {PAIR} AND a.i <> b.i AND abs(a.y1 - b.y1) <= 1.6 * a.size AND abs(a.x0 - b.x0) <= 40) n WHERE k = 1")
both("free_band", lambda d: f"SELECT a.page, a.i AS i, max(CASE WHEN b.y1 <= a.y0 THEN b.y1 END) AS top, min(CASE WHEN b.y0 >= a.y1 THEN b.y0 END) AS bottom FROM {BOXES} a LEFT JOIN {BOXES} b ON a.page = b.page AND a.i <> b.i AND a.x0 < b.x1 AND b.x0 < a.x1 GROUP BY a.page, a.i")
#: Boxes that no drawn one is close to on all four sides; drawn are those of a legible size.
both(
    "tolerant_anti_join",
    lambda d: f"SELECT a.page, a.i AS i FROM {BOXES} a WHERE NOT EXISTS (SELECT 1 FROM {BOXES} b WHERE b.page = a.page AND b.size >= 10 AND abs(a.x0 - b.x0) <= 0.6 AND abs(a.y0 - b.y0) <= 0.6 AND abs(a.x1 - b.x1) <= 0.6 AND abs(a.y1 - b.y1) <= 0.6)",
)
#: Lines of a legible size, one below the other, with a smaller one between them.
both(
    "blocked_pairs",
    lambda d: f"SELECT p.page, p.i AS i, p.j AS j FROM (SELECT a.page, a.i AS i, b.i AS j, a.y1 AS lo, b.y0 AS hi, least(a.x0, b.x0) AS x0, greatest(a.x1, b.x1) AS x1 FROM {PAIR} AND a.size >= 10 AND b.size >= 10 AND a.y1 <= b.y0) p WHERE EXISTS (SELECT 1 FROM {BOXES} c WHERE c.page = p.page AND c.size < 10 AND c.y0 >= p.lo - 1 AND c.y1 <= p.hi + 1 AND c.x1 > p.x0 AND c.x0 < p.x1)",
)
both("geometry_audit", lambda d: f"SELECT page, sum(CASE WHEN x1 > 260 THEN 1 ELSE 0 END) AS past_right, sum(CASE WHEN x0 < 0 THEN 1 ELSE 0 END) AS past_left, sum(CASE WHEN size < 10 THEN 1 ELSE 0 END) AS too_small, sum(CASE WHEN y1 > 110 THEN 1 ELSE 0 END) AS past_bottom FROM {BOXES} b GROUP BY page")
both("rect_fit", lambda d: f"SELECT page, i, least(200.0 / (x1 - x0), 10.0 / (y1 - y0), 1.0) AS scale, greatest(0, least(x0, 260 - (x1 - x0))) AS left FROM {BOXES} b")
both("baseline_clamp", lambda d: f"SELECT page, i, greatest(y0 + 0.8 * size, least(y1 - 0.2 * size, y1 - 3.0)) AS baseline FROM {BOXES} b")
both("visual_lines", lambda d: f"SELECT page, i, sum(opens) OVER (PARTITION BY page ORDER BY y1, x0, i) AS visual FROM (SELECT *, CASE WHEN abs(y1 - lag(y1) OVER w) <= 0.6 AND x0 - lag(x1) OVER w <= 0.6 * size THEN 0 ELSE 1 END AS opens FROM {BOXES} b WINDOW w AS (PARTITION BY page ORDER BY y1, x0, i)) v")
both("obstacle_rects", lambda d: f"SELECT page, i FROM {BOXES} b WHERE x1 - x0 >= 100 AND y1 - y0 >= 12")
both("word_cleanup", lambda d: f"SELECT page, i, row_number() OVER (PARTITION BY page ORDER BY y0, x0, i) AS n FROM {BOXES} b WHERE x1 > x0 AND y1 > y0")


def _shares(d: Spark) -> str:
    return f"""SELECT doc_id, i, 1 + share + CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY frac DESC, w DESC, i) <= extra - sum(share) OVER (PARTITION BY doc_id) THEN 1 ELSE 0 END AS n FROM (
      SELECT doc_id, i, w, extra, extra * w {d.div} total AS share, extra * w % total AS frac FROM (
        SELECT l.doc_id, l.i, length(l.line) + 1 AS w, CAST(sum(length(l.line) + 1) OVER (PARTITION BY l.doc_id) AS BIGINT) AS total, t.n_chars % 500 AS extra FROM {d.lines()} l JOIN documents t ON t.doc_id = l.doc_id) a) b"""


#: A reply of as many characters as n_chars % 500 and the lines, over the widths of a document's lines.
both("allocate_shares", _shares)
both("line_rects", lambda d: f"SELECT page, i, x0, y0, x1, y1 FROM {BOXES} b")
both("min_fit_size", lambda d: f"SELECT page, floor(min(fits) * 2) / 2 AS size, sum(CASE WHEN fits < 5 THEN 1 ELSE 0 END) AS skipped FROM (SELECT page, greatest(4.0, least(size * 1.0, (x1 - x0) / 16.0)) AS fits FROM {BOXES} b) f GROUP BY page")
#: A line of one blank to twelve characters is stretched to its column, unless a gap would grow by over 0.45 of its size.
both("justify_gaps", lambda d: f"SELECT page, i, CASE WHEN gaps > 0 AND extra > 0 AND extra / gaps <= 0.45 * size THEN extra / gaps ELSE 0.0 END AS gap FROM (SELECT page, i, size, floor((x1 - x0) / 12.0) AS gaps, CAST(max(x1) OVER (PARTITION BY page) - x1 AS DOUBLE) AS extra FROM {BOXES} b) j")
both("ink_color", lambda d: f"SELECT page, i, CASE WHEN 0.299 * r + 0.587 * g + 0.114 * bl < 0.5 THEN 'white' ELSE 'black' END AS ink FROM (SELECT page, i, (x0 % 11) / 10.0 AS r, (y0 % 11) / 10.0 AS g, (x1 % 11) / 10.0 AS bl FROM {BOXES} b) c")
both("unit_order", lambda d: f"SELECT page, col, row_number() OVER (PARTITION BY page ORDER BY min(i)) AS place FROM (SELECT page, i, (x0 {d.div} 40) AS col FROM {BOXES} b) c GROUP BY page, col")


def _paragraph_starts(d: Spark) -> str:
    """Lines of recognised text, by column: whether a line opens a paragraph, by gap, height, left edge and what stands between."""
    columns = f"(SELECT *, sum(opens) OVER (PARTITION BY page ORDER BY x0, i) AS col FROM (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0, i) <= 30 THEN 0 ELSE 1 END AS opens FROM {BOXES} b WHERE size >= 10) s)"
    pairs = f"(SELECT page, col, i, x0, y0, x1, y1, lag(x0) OVER w AS px0, lag(y0) OVER w AS py0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1 FROM {columns} c WINDOW w AS (PARTITION BY page, col ORDER BY y0, x0, i))"
    blocked = f"EXISTS (SELECT 1 FROM {BOXES} z WHERE z.page = p.page AND z.size < 10 AND z.y0 >= p.py1 - 1 AND z.y1 <= p.y0 + 1 AND z.x1 > least(p.x0, p.px0) AND z.x0 < greatest(p.x1, p.px1))"
    near = "y0 - py1 >= -0.35 * least(y1 - y0, py1 - py0) AND y0 - py1 <= greatest(1.6, 0.9 * least(y1 - y0, py1 - py0)) AND abs((y1 - y0) - (py1 - py0)) <= 0.45 * greatest(y1 - y0, py1 - py0) AND abs(x0 - px0) <= 18"
    return f"SELECT page, col, i, CASE WHEN px0 IS NOT NULL AND {near} AND NOT {blocked} THEN 0 ELSE 1 END AS opens FROM {pairs} p"


both("ocr_paragraphs", _paragraph_starts)
