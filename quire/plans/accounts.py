"""Queries over accounts, ledgers, jobs and channels. Customers stand for users, orders for usage rows and jobs, parts for invites, suppliers for channels, line items for batches."""

from __future__ import annotations

from quire.functions import text as T
from quire.plans.dialect import Catalog, Spark

catalog = Catalog()
both = catalog.both

USERS = "(SELECT c_custkey AS id, lower(c_name) || '@example.com' AS email, CASE WHEN c_custkey % 10 = 0 THEN 'admin' WHEN c_custkey % 3 = 0 THEN 'vip' ELSE 'user' END AS role, CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE c_custkey % 500 + 1 END AS quota_pages, CAST(floor(abs(c_acctbal)) AS BIGINT) % 700 AS used_pages, CASE WHEN c_acctbal < 0 THEN 'banned' ELSE 'active' END AS status FROM customer)"
JOBS = "(SELECT o_orderkey AS id, o_custkey AS user_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, o_orderdate AS created, CAST(round(o_totalprice) AS BIGINT) % 100 AS pages FROM orders)"
INVITES = "(SELECT p_partkey AS id, upper(substring(p_name, 1, 8)) || CAST(p_partkey AS STRING) AS code, CAST(p_size AS BIGINT) AS max_uses, p_partkey % 5 AS used_count, p_partkey % 3 = 0 AS expired FROM part)"

both("session_user", lambda d: f"SELECT e.event_id, u.id, u.role FROM events e JOIN {USERS} u ON e.user_id = u.id WHERE e.event_type = 'signup' AND u.status = 'active' AND e.ts >= TIMESTAMP'2024-01-08 00:00:00'")
both("admin_counts", lambda d: f"SELECT count(*) AS n_users, sum(CASE WHEN status = 'active' THEN 1 ELSE 0 END) AS n_active, CAST(coalesce(sum(used_pages), 0) AS BIGINT) AS used_pages FROM {USERS} u")
both("recent_events_count", lambda d: "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP'2024-01-24 00:00:00'")
both("month_usage", lambda d: f"SELECT CAST(coalesce(sum(pages), 0) AS BIGINT) AS pages, count(*) AS n FROM {JOBS} j WHERE created >= TIMESTAMP'1995-03-01 00:00:00' AND created < TIMESTAMP'1995-04-01 00:00:00'")
both("all_usage", lambda d: f"SELECT CAST(coalesce(sum(pages), 0) AS BIGINT) AS pages, count(*) AS n FROM {JOBS} j")
both("invite_usage", lambda d: f"SELECT CAST(sum(used_count) AS BIGINT) AS used, count(*) AS n FROM {INVITES} i")
both(
    "daily_usage_gapfill",
    lambda d: f"SELECT {d.day('c.d')} AS usage_day, coalesce(u.n, 0) AS n, coalesce(u.total, 0) AS total FROM {d.days('2023-12-28', '2024-02-02')} c LEFT JOIN (SELECT CAST({d.plus('ts', 8, 'HOURS')} AS DATE) AS k, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY CAST({d.plus('ts', 8, 'HOURS')} AS DATE)) u ON u.k = c.d",
)
both("user_usage_total", lambda d: f"SELECT user_id, CAST(sum(pages) AS BIGINT) AS pages, count(*) AS n FROM {JOBS} j GROUP BY user_id")
both("user_usage_recent", lambda d: f"SELECT id, user_id, pages FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created DESC, id DESC) AS k FROM {JOBS} j) h WHERE k <= 50")
both("top_users_percent", lambda d: f"SELECT id, used_pages, CASE WHEN quota_pages > 0 THEN least(100.0, floor(used_pages * 1000.0 / quota_pages + 0.5) / 10.0) END AS percent_used FROM {USERS} u ORDER BY used_pages DESC, id LIMIT 5")
both("quota_state", lambda d: f"SELECT id, quota_pages = 0 AS unlimited, CASE WHEN quota_pages > 0 THEN greatest(0, quota_pages - used_pages) END AS remaining FROM {USERS} u")
both("user_search_page", lambda d: f"SELECT id, email FROM {USERS} u WHERE email LIKE '%1@%' ESCAPE '/' ORDER BY used_pages DESC, id DESC LIMIT 20 OFFSET 20")
both("user_search_count", lambda d: f"SELECT count(*) AS n, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM {USERS} u WHERE email LIKE '%1@%'")
both("email_mask", lambda d: f"SELECT id, {T.email_mask(d, 'email')} AS masked FROM {USERS} u")
both("latest_code_per_user", lambda d: "SELECT user_id, max(event_id) AS code_id FROM events WHERE event_type = 'signup' GROUP BY user_id")
both("code_check", lambda d: "SELECT event_id, CASE WHEN event_type <> 'signup' THEN 'missing' WHEN ts < TIMESTAMP'2024-01-20 00:00:00' THEN 'expired' WHEN value < 10 THEN 'mismatch' ELSE 'ok' END AS verdict FROM events")
both("invites_recent", lambda d: f"SELECT id, code FROM {INVITES} i ORDER BY id DESC, code DESC LIMIT 100")
both("invite_check", lambda d: f"SELECT id, CASE WHEN expired THEN 'expired' WHEN used_count >= max_uses THEN 'used up' ELSE 'ok' END AS verdict FROM {INVITES} i")
both("ledger_balance", lambda d: f"SELECT u.id, u.used_pages + coalesce(l.pages, 0) AS balance FROM {USERS} u LEFT JOIN (SELECT user_id, CAST(sum(pages) AS BIGINT) AS pages FROM {JOBS} j WHERE status = 'done' GROUP BY user_id) l ON l.user_id = u.id")
both("ban_cascade", lambda d: f"SELECT e.event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM {USERS} u WHERE u.id = e.user_id AND u.status = 'banned')")
both("backfill_refine", lambda d: f"SELECT id, CASE WHEN role IN ('admin', 'vip') THEN 1 ELSE 0 END AS can_refine FROM {USERS} u")
both("role_masked_projection", lambda d: f"SELECT id, role, CASE WHEN role = 'admin' THEN email END AS email FROM {USERS} u")
both("status_histogram", lambda d: f"SELECT status, count(*) AS n FROM {JOBS} j GROUP BY status")
both("queue_stats", lambda d: f"SELECT sum(CASE WHEN status = 'queued' THEN 1 ELSE 0 END) AS queued, sum(CASE WHEN status = 'running' THEN 1 ELSE 0 END) AS running, count(DISTINCT CASE WHEN status <> 'done' THEN user_id END) AS sources FROM {JOBS} j")
both("health_counts", lambda d: f"SELECT sum(CASE WHEN status = 'done' THEN 1 ELSE 0 END) AS done, count(*) AS n FROM (SELECT status FROM {JOBS} j ORDER BY created DESC, id DESC LIMIT 30) t")
both("ip_day_usage", lambda d: f"SELECT {d.day('ts')} AS usage_day, user_id, count(*) AS jobs, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY GROUPING SETS (({d.day('ts')}), ({d.day('ts')}, user_id))")
both("channel_tokens", lambda d: "SELECT l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT) * 20) AS BIGINT) AS tokens_in, CAST(sum(CAST(l_quantity AS BIGINT) * 13) AS BIGINT) AS tokens_out, count(*) AS calls FROM lineitem GROUP BY l_suppkey")
both("channel_cost_per_1k", lambda d: "SELECT l_suppkey, 1000.0 * sum(CAST(l_quantity AS BIGINT) * 20) / (45 * count(*)) AS in_per_1k, 1000.0 * sum(CAST(l_quantity AS BIGINT) * 13) / (45 * count(*)) AS out_per_1k FROM lineitem GROUP BY l_suppkey")
both("edge_daily_quota", lambda d: f"SELECT id, running_jobs <= 30 AND running_pages <= 2500 AS allowed FROM (SELECT id, count(*) OVER w AS running_jobs, sum(pages) OVER w AS running_pages FROM {JOBS} j WINDOW w AS (PARTITION BY CAST(created AS DATE) ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) q")
both("community_files", lambda d: f"SELECT id, user_id, pages FROM {JOBS} j WHERE status = 'done' AND pages > 0 AND user_id IS NOT NULL AND created >= TIMESTAMP'1998-07-01 00:00:00' ORDER BY created DESC, id DESC LIMIT 50")
both("history_recent", lambda d: f"SELECT user_id, id, k FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created DESC, id DESC) AS k FROM {JOBS} j) h WHERE k <= 30")
both("truncated_flag", lambda d: f"SELECT count(*) > 50 AS truncated FROM (SELECT id FROM {JOBS} j WHERE status = 'done' LIMIT 51) t")
both(
    "fair_queue_pick",
    lambda d: f"SELECT id FROM (SELECT q.id, row_number() OVER (ORDER BY coalesce(r.n, 0), q.created, q.id) AS k FROM {JOBS} q LEFT JOIN (SELECT user_id, count(*) AS n FROM {JOBS} j WHERE status = 'running' GROUP BY user_id) r ON r.user_id = q.user_id WHERE q.status = 'queued') p WHERE k = 1",
)
both("billed_pages", lambda d: f"SELECT id, CASE WHEN id % 2 = 0 THEN CAST(ceil(pages * 1.5) AS BIGINT) ELSE pages END AS billed FROM {JOBS} j WHERE status = 'done'")
both("derived_status", lambda d: f"SELECT j.id, CASE WHEN j.status = 'done' THEN 'done' WHEN e.event_type = 'error' THEN 'failed' WHEN e.event_type IS NULL THEN j.status ELSE 'running' END AS shown FROM {JOBS} j LEFT JOIN (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k = 1) e ON e.user_id = j.user_id")
both("heal_status", lambda d: f"SELECT j.id, CASE WHEN j.status <> 'done' AND l.n >= 3 THEN 'done' ELSE j.status END AS status FROM {JOBS} j LEFT JOIN (SELECT l_orderkey, sum(CASE WHEN l_linenumber = k THEN 1 ELSE 0 END) AS n FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem) c GROUP BY l_orderkey) l ON l.l_orderkey = j.id")
both("contiguous_chunks", lambda d: "SELECT l_orderkey, sum(CASE WHEN l_linenumber = k THEN 1 ELSE 0 END) AS chunks FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem) c GROUP BY l_orderkey")
both("channel_pick", lambda d: "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'no key' WHEN s_nationkey > 20 THEN 'unknown api' END AS issue, row_number() OVER (ORDER BY CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END, s_suppkey) AS pick FROM supplier")
both("strong_model", lambda d: f"SELECT s_suppkey, NOT {d.like('lower(s_name)', 'mini|flash|lite')} AND {d.like('lower(s_name)', '0{4,}[1-4]')} AS strong FROM supplier")
both("pipeline_lookup", lambda d: f"SELECT id, p.module FROM {JOBS} j JOIN {d.values(chr(40) + chr(39) + 'done' + chr(39) + ', ' + chr(39) + 'inplace' + chr(39) + '), (' + chr(39) + 'queued' + chr(39) + ', ' + chr(39) + 'bilingual' + chr(39) + ')', 'status, module')} p ON p.status = j.status")
both("submit_validation", lambda d: f"SELECT id, CASE WHEN pages = 0 THEN '400 empty' WHEN pages > 90 THEN '413 too large' WHEN n > 2 THEN '429 busy' ELSE '202 queued' END AS verdict FROM (SELECT id, pages, sum(CASE WHEN status <> 'done' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS n FROM {JOBS} j) s")
both("option_clamp", lambda d: "SELECT p_partkey, greatest(0.3, least(2.0, p_size / 20.0)) AS font_scale, greatest(72, least(600, p_size * 20)) AS dpi FROM part")
both("nice_axis_max", lambda d: "SELECT c_custkey, CASE WHEN v <= 4 THEN 4.0 ELSE CASE WHEN v <= p THEN p WHEN v <= 2 * p THEN 2 * p WHEN v <= 2.5 * p THEN 2.5 * p WHEN v <= 5 * p THEN 5 * p ELSE 10 * p END END AS axis FROM (SELECT c_custkey, v, power(10.0, floor(log10(v))) AS p FROM (SELECT c_custkey, abs(c_acctbal) + 1 AS v FROM customer) a) b")
both("page_images", lambda d: f"SELECT page_id, CAST({d.count('html', '<(img|script)')} AS BIGINT) AS n FROM pages")
