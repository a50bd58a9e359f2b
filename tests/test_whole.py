"""Queries over whole groups, against plain loops over the tiny tables or made rows."""

import datetime
from collections import defaultdict

import duckdb

from quire import catalog
from quire.plans import geometry, state, units
from quire.plans.dialect import Duck
from quire.streaming import jobs


def found(spark, tiny, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in catalog.queries()[name](spark, tiny).collect())


def pages_of(oracle):
    pages = defaultdict(list)
    for page, *box in oracle.sql(f"SELECT page, i, x0, y0, x1, y1, size FROM {geometry.BOXES} b").fetchall():
        pages[page].append(box)
    return pages


def test_shares_cover_all_lines(spark, tiny, oracle):
    want = []
    for doc, text, n_chars in oracle.sql("SELECT doc_id, text, n_chars FROM documents").fetchall():
        w = [len(line) + 1 for line in text.split("\n")]
        extra, total = n_chars % 500, sum(w)
        n = [1 + extra * x // total for x in w]
        for k in sorted(range(len(w)), key=lambda k: (-(extra * w[k] % total), -w[k], k))[: len(w) + extra - sum(n)]:
            n[k] += 1
        assert sum(n) == len(w) + extra
        want += [(doc, i, x) for i, x in enumerate(n)]
    assert max(i for _, i, _ in want) >= 12
    assert found(spark, tiny, "allocate_shares", "doc_id", "i", "n") == sorted(want)


def test_prompts_number_all_lines(spark, tiny, oracle):
    lines = defaultdict(list)
    for doc, i, line in oracle.sql(f"SELECT doc_id, i, line FROM {units._stripped(Duck())} s").fetchall():
        lines[doc].append((i, line))
    assert max(map(len, lines.values())) > 20
    assert found(spark, tiny, "prompt_numbering", "doc_id", "prompt") == sorted((d, " | ".join(f"{i + 1}. {x}" for i, x in sorted(v))) for d, v in lines.items())


def test_balanced_batches_heed_characters(spark, tiny, oracle):
    sizes, want = defaultdict(list), []
    for doc, n in oracle.sql(f"SELECT doc_id, n FROM {state.units(Duck())} u ORDER BY doc_id, k").fetchall():
        sizes[doc].append(n)
    for doc, v in sizes.items():
        i = batch = 0
        while i < len(v):
            parts = -(-(len(v) - i) // 100)
            take, j, chars = -(-(len(v) - i) // parts), i, 0
            while j < len(v) and j - i < take and (j == i or chars + v[j] <= 3500):
                chars, j = chars + v[j], j + 1
            want.append((doc, batch, j - i))
            i, batch = j, batch + 1
    assert found(spark, tiny, "batch_balanced", "doc_id", "batch", "n") == sorted(want)


def test_reserved_boxes_meet_every_drawn_one(spark, tiny, oracle):
    want = [(page, a[0]) for page, boxes in pages_of(oracle).items() for a in boxes if not any(b[5] >= 10 and all(abs(x - y) <= 0.6 for x, y in zip(a[1:5], b[1:5], strict=True)) for b in boxes)]
    assert found(spark, tiny, "tolerant_anti_join", "page", "i") == sorted(want)


def test_blocked_pairs_at_any_distance(spark, tiny, oracle):
    want = []
    for page, boxes in pages_of(oracle).items():
        small, large = [b for b in boxes if b[5] < 10], [b for b in boxes if b[5] >= 10]
        for i, ax0, _, ax1, ay1, _ in large:
            for j, bx0, by0, bx1, _, _ in large:
                if ay1 <= by0 and any(c[2] >= ay1 - 1 and c[4] <= by0 + 1 and c[3] > min(ax0, bx0) and c[1] < max(ax1, bx1) for c in small):
                    want.append((page, i, j))
    assert len({abs(i - j) for _, i, j in want}) > 1
    assert found(spark, tiny, "blocked_pairs", "page", "i", "j") == sorted(want)


def test_recent_usage_of_each_user(spark, tiny, tmp_path):
    (tmp_path / "pages.parquet").symlink_to(f"{tiny}/pages.parquet")
    path = f"{tmp_path}/orders.parquet"
    duckdb.sql(f"COPY (SELECT k AS o_orderkey, CASE WHEN k < 120 THEN k % 2 ELSE 7 END AS o_custkey, 'F' AS o_orderstatus, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * k AS o_orderdate, CAST(k AS DOUBLE) AS o_totalprice FROM range(121) t(k)) TO '{path}'")
    got = found(spark, str(tmp_path), "user_usage_recent", "user_id", "id")
    assert got == sorted([(u, k) for u in (0, 1) for k in range(120) if k % 2 == u and k >= 20] + [(7, 120)])


def test_rate_limit_over_several_frames(spark, tmp_path):
    hours = [(7 * k) % 60 for k in range(60)]
    rows = [(9, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)) for h in hours]
    spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    over = n = 0
    since = None
    for h in sorted(hours):
        if since is None or h - since > 24:
            since, n = h, 0
        n += 1
        over += n > 5
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        stream = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{tmp_path}/in")
        assert [tuple(r) for r in jobs.drain(jobs.rate_limit(stream), "frames", "update").collect()] == [(9, 60, over)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
