"""Queries over stored records: key-value scans, chunks, JSON fields, identities, coercions, routing."""

from __future__ import annotations

from quire.plans.accounts import INVITES, JOBS, USERS
from quire.plans.dialect import Catalog
from quire.sources import blobs

catalog = Catalog()
both = catalog.both

REPLIES = """(1, '{"output_text": "a"}', 'x'), (2, '{"output": [{"content": [{"text": "b"}]}]}', 'y'), (3, '{"usage": {"prompt_tokens": 7, "completion_tokens": 3}}', 'z'), (4, '{"usage": {"input_tokens": 5, "output_tokens": 2}}', ''), (5, '{"data": {"balance": "12.5"}}', null), (6, '{"remaining": 3}', 'q')"""
OPTIONS = "(1, 'true'), (2, '0'), (3, 'YES'), (4, 'nan'), (5, '12.5'), (6, 'x'), (7, ''), (8, '-3')"


def _blob_chunks(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), F.lit("in").alias("kind"), F.encode("text", "UTF-8").alias("data"))
    return blobs.to_chunks(docs, 1000).select(F.col("id").alias("doc_id"), F.col("idx").cast("long").alias("idx"), F.octet_length("chunk").cast("long").alias("n_bytes"))


catalog.add("blob_chunks", _blob_chunks, lambda d: "SELECT doc_id, idx, least(1000, n - idx * 1000) AS n_bytes FROM (SELECT doc_id, n, unnest(range(greatest((n + 999) // 1000, 1))) AS idx FROM (SELECT doc_id, strlen(text) AS n FROM documents) t) c")
both("kv_prefix_scan", lambda d: f"SELECT doc_key, n_chars FROM (SELECT 'job/' || source || '/' || CAST(doc_id AS STRING) AS doc_key, n_chars FROM documents) k WHERE doc_key LIKE 'job/src1%' ORDER BY doc_key LIMIT 100")
both("kv_last_write", lambda d: "SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) e WHERE k = 1")
both("event_props", lambda d: f"SELECT event_id, CAST({d.json('props', '$.k')} AS BIGINT) AS k FROM events")
both("usage_forward_fill", lambda d: f"SELECT event_id, coalesce(CAST({d.json('props', '$.k')} AS BIGINT), 0) AS jobs, coalesce(CAST({d.json('props', '$.missing')} AS BIGINT), 0) AS refined FROM events")
both("reply_text", lambda d: f"SELECT id, coalesce({d.json('body', '$.output_text')}, {d.json('body', '$.output[0].content[0].text')}) AS reply FROM {d.values(REPLIES, 'id, body, name')} r")
both("token_usage", lambda d: f"SELECT id, CAST(coalesce({d.json('body', '$.usage.prompt_tokens')}, {d.json('body', '$.usage.input_tokens')}, '0') AS BIGINT) AS tokens_in, CAST(coalesce({d.json('body', '$.usage.completion_tokens')}, {d.json('body', '$.usage.output_tokens')}, '0') AS BIGINT) AS tokens_out FROM {d.values(REPLIES, 'id, body, name')} r")
both("balance_field", lambda d: f"SELECT id, {d.number('coalesce(' + ', '.join(d.json('body', p) for p in ('$.balance', '$.remaining', '$.data.balance', '$.data.remaining')) + ')')} AS balance FROM {d.values(REPLIES, 'id, body, name')} r")
both("option_coercion", lambda d: f"SELECT id, lower(v) IN ('1', 'true', 'yes', 'on') AS as_bool, CASE WHEN lower(v) = 'nan' THEN 1.0 ELSE coalesce({d.number('v')}, 1.0) END AS as_float FROM {d.values(OPTIONS, 'id, v')} o")
both("download_name", lambda d: f"SELECT page_id, 'attachment; filename=' || substring({d.replace('url', '[^A-Za-z0-9._-]+', '_')}, 1, 60) AS header FROM pages")
both("job_ownership", lambda d: f"SELECT j.id, j.user_id = u.id OR u.role = 'admin' AS may_read FROM {JOBS} j JOIN {USERS} u ON u.id = (j.user_id + j.id) % 50 + 1")
both("jobs_of_caller", lambda d: f"SELECT id, status FROM {JOBS} j WHERE user_id = 7 OR 7 % 10 = 0")
both("account_validation", lambda d: f"SELECT id, {d.like('email', '^[^@ ]+@[^@ ]+[.][a-z]+$')} AS email_ok, length(email) BETWEEN 8 AND 72 AS length_ok FROM {USERS} u")
both("active_jobs", lambda d: f"SELECT user_id, count(*) AS n FROM {JOBS} j WHERE status IN ('queued', 'running') GROUP BY user_id")
both("visibility_grace", lambda d: f"SELECT id, CASE WHEN status = 'done' AND pages % 2 = 0 AND created >= TIMESTAMP'1998-07-01 00:00:00' THEN 'running' ELSE status END AS shown FROM {JOBS} j")
both("zip_contract", lambda d: "SELECT conv_id, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS sources, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS drafts, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) = sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS matches FROM conversations GROUP BY conv_id")
both("only_translated", lambda d: "SELECT conv_id, turn FROM (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS draft FROM conversations) c WHERE role = 'user' AND draft <> '' AND draft <> text")
both("refine_status", lambda d: "SELECT conv_id, CASE WHEN sum(CASE WHEN length(text) > 40 THEN 1 ELSE 0 END) = count(*) THEN 'ok' WHEN sum(CASE WHEN length(text) > 40 THEN 1 ELSE 0 END) = 0 THEN 'failed' ELSE 'partial' END AS status FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
both("paragraph_identity", lambda d: f"SELECT text_hash, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, {d.hex256('line')} AS text_hash FROM {d.lines()} l WHERE line <> '') p GROUP BY text_hash")
both("upsert_counters", lambda d: "SELECT user_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, 1 AS n FROM events UNION ALL SELECT c_custkey, 0 FROM customer) u GROUP BY user_id")
both("append_redemptions", lambda d: f"SELECT id, used_count FROM {INVITES} i UNION ALL SELECT event_id, 1 FROM events WHERE event_type = 'signup'")
both("logout_cascade", lambda d: "SELECT e.event_id FROM events e LEFT JOIN (SELECT user_id, max(ts) AS last_error FROM events WHERE event_type = 'error' GROUP BY user_id) x ON x.user_id = e.user_id WHERE x.last_error IS NULL OR e.ts > x.last_error")
both("elapsed_seconds", lambda d: f"SELECT event_id, greatest(0, {d.seconds('ts')} - 1704067200 - event_id % 5000) AS elapsed FROM events")
both("progress_percent", lambda d: "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 100 ELSE least(97, CAST(floor(value + 0.5) AS BIGINT)) END AS percent FROM events")
both("batch_route", lambda d: "SELECT l_orderkey, CASE WHEN avg(l_quantity) < 20 THEN 'strong,primary' ELSE 'primary,reserve' END AS chain FROM lineitem GROUP BY l_orderkey")
both("resolved_config", lambda d: "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'override' END, CASE WHEN s_acctbal > 0 THEN 'profile' END, 'environment') AS origin FROM supplier")
both("control_chars", lambda d: f"SELECT doc_id, {d.hex256(d.replace(d.replace('text', '\\r\\n?', chr(10)), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ''))} AS clean_hash FROM documents")
