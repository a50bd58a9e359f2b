"""Invariants of the sequential operators on generated rows, against plain loops."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quire.operators import folds
from quire.plans.model import ModelError, refine, translate

few = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


@few
@given(st.lists(st.integers(0, 900), max_size=40), st.booleans())
def test_greedy_batches(spark, sizes, after):
    df = spark.createDataFrame([(1, k, n) for k, n in enumerate(sizes)], "doc_id long, k long, n long")
    got = [r.batch for r in sorted(folds.greedy_batches(df, 6, 2000, after).collect(), key=lambda r: r.k)]
    want, batch, count, chars = [], 0, 0, 0
    for n in sizes:
        if (count >= 6 or chars >= 2000) if after else count and (count + 1 > 6 or chars + n > 2000):
            batch, count, chars = batch + 1, 0, 0
        want.append(batch)
        count, chars = count + 1, chars + n
    assert got == want


@few
@given(st.lists(st.integers(0, 500), max_size=30))
def test_rate_limit(spark, times):
    times = sorted(times)
    df = spark.createDataFrame([(7, t, i) for i, t in enumerate(times)], "user_id long, t long, id long")
    got = [r.over for r in sorted(folds.rate_limit(df, 3, 60).collect(), key=lambda r: r.id)]
    want, since, n = [], None, 0
    for t in times:
        if since is None or t - since > 60:
            since, n = t, 0
        n += 1
        want.append(n > 3)
    assert got == want


def test_circuit_breaker(spark):
    rows = [(1, 0, 0, True), (1, 10, 1, True), (1, 20, 2, False), (1, 129, 3, True), (1, 131, 4, True), (1, 132, 5, False), (1, 140, 6, True)]
    df = spark.createDataFrame(rows, "user_id long, t long, id long, failed boolean")
    got = {r.id: r.cooling for r in folds.circuit_breaker(df).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True, 4: False, 5: False, 6: False}


def test_keep_last_different(spark):
    rows = [(1, 0, "thequickbrownfox"), (1, 1, "thequickbrownfoxes"), (1, 2, "somethingelse"), (1, 3, "thequickbrownfox"), (2, 0, "yes"), (2, 1, "yes")]
    got = sorted((r.doc_id, r.k) for r in folds.keep_last_different(spark.createDataFrame(rows, "doc_id long, k long, c string")).collect() if r.dropped)
    assert got == [(1, 1)]


def test_a_failing_client_keeps_the_source(spark):
    def client(texts):
        if "bad" in texts:
            raise ModelError("no answer")
        return texts[:-1] if "short" in texts else [t.upper() for t in texts]

    df = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["bad"]), (1, 2, ["short", "x"])], "doc_id long, batch long, texts array<string>")
    got = {r.batch: list(r["values"]) for r in translate(df, client).collect()}
    assert got == {0: ["A", "B"], 1: ["bad"], 2: ["short", "x"]}


def test_a_failing_refiner_keeps_the_drafts(spark):
    def client(sources, drafts):
        if "bad" in sources:
            raise ModelError("no answer")
        return drafts[:-1] if "short" in sources else [d + "!" for d in drafts]

    rows = [(1, 0, ["a", "b", "c"], ["A", "b", ""]), (1, 1, ["bad", "x"], ["BAD", "X"]), (1, 2, ["short", "y"], ["SHORT", "Y"]), (1, 3, ["same"], ["same"])]
    df = spark.createDataFrame(rows, "doc_id long, batch long, texts array<string>, values array<string>")
    got = {r.batch: (list(r.refined), r.status) for r in refine(df, client).collect()}
    assert got == {0: (["A!", "b", ""], "ok"), 1: (["BAD", "X"], "failed"), 2: (["SHORT", "Y"], "failed"), 3: (["same"], "ok")}
