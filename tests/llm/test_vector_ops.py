"""Vector searches against brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import mips, registry, vamana, vectors


def odd(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in (rng.normal(size=8) * rng.exponential(2)).round(2)], "z") for i in range(900)]
    rows += [(5000, None, ""), (5001, [1.0, None], ""), (5002, [float("nan")], ""), (5050, [0.0] * 8, ""), (6000, [1.0, 2.0], ""), (6050, [2.0, 1.0], ""), (None, [1.0] * 8, ""), (5150, [], "")]
    rows += [(i, [3.0] * 8, "") for i in range(7000, 7400)] + [(100, rows[100][1], "z")]  # a large group of copies, a repeated row
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")


def brute(rows, score, k=5):
    """rows: distinct (vec_id, vector) -> query_id -> [(score, vec_id)], best first."""
    out = {}
    for q, x in rows:
        if q % 50 == 0:
            near = sorted((-score(x, y), i) for i, y in rows if i != q and len(x) == len(y))
            out[q] = [(-s, i) for s, i in near[:k]]
    return out


def lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_products_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mips, "BUCKET", 128)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 500)  # many blocks
    ints = mips.quantize(odd(spark))
    rows = sorted({(r.vec_id, tuple(int(x) for x in r.v)) for r in ints.collect()})
    found = lists(mips.top_products(ints, ints.where("vec_id % 50 = 0")).collect())
    assert found == {q: x for q, x in brute(rows, lambda a, b: sum(i * j for i, j in zip(a, b, strict=True))).items() if x}
    assert mips.top_products(ints.where("false"), ints.where("false")).count() == 0


def test_large_products_saturate(spark):
    ints = mips.quantize(spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (50, [-1e30, 0.0]), (100, [1e10, 0.0])], "vec_id long, embedding array<double>"))
    found = lists(mips.top_products(ints, ints.where("vec_id % 50 = 0"), 2).collect())
    top = (1 << 63) - 1
    assert found[0] == [(top, 1), (top, 100)] and found[50][-1] == (-top, 1) and found[100] == [(top, 0), (top, 1)]


def test_coordinate_pruning_keeps_the_best():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(500, 6)) * 40)
    x[0] = [300, 10, -20, 50, 5, 100]
    x[:250] = np.round(x[0] + rng.normal(size=(250, 6)))
    bucket = mips.Bucket(np.arange(500).tobytes(), x.tobytes(), 6)
    q = x[:1]
    q_len = np.sqrt((q * q).sum(axis=1))
    best = mips.TopK(1, 5, np.int64)
    mips.search_bucket(bucket, np.array([-1]), q, q_len, best)
    t = float(best.floor[0]) / (q_len[0] * bucket.longest)
    assert t >= mips.COORD_COSINE
    again = mips.TopK(1, 5, np.int64)
    again.floor[:] = best.floor  # as if other buckets had reached it
    mips.search_bucket(bucket, np.array([-1]), q, q_len, again)
    true = np.sort((x @ q[0]).astype(np.int64))[::-1][:5]
    assert best.score.tolist() == true.tolist() and again.score.tolist() == true.tolist()
    assert 0 < len(mips._coordinate_range(bucket, q[0] / q_len[0], t)) < 500


def test_recall_and_scores(spark, tiny):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{tiny}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = lists(registry.queries()["op7_vamana"](spark, tiny).collect())
    assert set(found) == set(ids[ids % 50 == 0].tolist())
    hits = []
    for q, near in found.items():
        sims = unit @ unit[ids == q][0]
        sims[ids == q] = -9
        hits.append(len({i for _, i in near} & set(ids[np.argsort(-sims)[:5]].tolist())) / 5)
        assert all(abs(s - sims[ids == i][0]) < 1e-12 for s, i in near)
        assert near == sorted(near, key=lambda e: (-e[0], e[1]))
    assert np.mean(hits) >= 0.9


def test_graph_recall_on_one_large_shard():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, start = vamana.build_graph(x)
    q = rng.normal(size=(100, 64)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    found, _ = vamana.beam_search(x, graph, start, q, vamana.BEAM)
    true = np.argsort(-(q @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(found[i]) & set(true[i])) / 5 for i in range(100)]) >= 0.9


def test_neighbours_on_odd_rows(spark):
    rows = vectors.clean(odd(spark)).where(F.exists("v", lambda x: x != 0))
    distinct = sorted({(r.vec_id, tuple(r.v)) for r in rows.collect()})
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
    found = lists(vamana.search(vamana.build_index(rows, 256), rows.where("vec_id % 50 = 0")).collect())
    true = brute(distinct, cos)
    assert set(found) == {q for q, x in true.items() if x}
    assert np.mean([len({i for _, i in found[q]} & {i for _, i in true[q]}) / len(true[q]) for q in found]) >= 0.9
    assert [i for _, i in found[7000]] == [7001, 7002, 7003, 7004, 7005]  # copies: the smallest ids
    assert found[6050] == [(pytest.approx(0.8), 6000)]
    assert vamana.search(vamana.build_index(rows.where("false")), rows.where("false")).count() == 0


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_blocks_with_and_without_a_broadcast(spark, monkeypatch, threshold):
    monkeypatch.setattr(mips, "BUCKET", 128)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 300)
    ints = mips.quantize(odd(spark))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        rows = sorted({(r.vec_id, tuple(int(x) for x in r.v)) for r in ints.collect()})
        found = lists(mips.top_products(ints, ints.where("vec_id % 50 = 0")).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {q: x for q, x in brute(rows, lambda a, b: sum(i * j for i, j in zip(a, b, strict=True))).items() if x}


def test_recall_over_several_shards(spark):
    """All of the larger table, in many shards, against brute force."""
    path = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{path}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    table = vectors.clean(spark.read.parquet(f"{path}/embeddings.parquet")).where(F.exists("v", lambda c: c != 0))
    index = vamana.build_index(table, 200)
    assert index.count() >= 8
    found = lists(vamana.search(index, table.where("vec_id % 50 = 0")).collect())
    hits = []
    for q, near in found.items():
        sims = unit @ unit[ids == q][0]
        sims[ids == q] = -9
        hits.append(len({i for _, i in near} & set(ids[np.argsort(-sims)[:5]].tolist())) / 5)
    assert len(hits) == (ids % 50 == 0).sum() and np.mean(hits) >= 0.9
