"""Given cases of the rules, and plain properties of those that no SQL can say."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire import catalog
from quire.operators import folds, layout
from quire.plans import state
from quire.plans.dialect import Spark, run_sql


def rows(spark, tiny, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in catalog.queries()[name](spark, tiny).collect())


def test_pages(spark, tiny):
    got = {}
    for s, page in rows(spark, tiny, "page_specs", "s", "page"):
        got.setdefault(s, []).append(page)
    assert got == {"a": [1, 2, 3, 5], "b": list(range(1, 11)), "c": [2, 4, 9, 10], "d": [1]}


def test_names_and_records(spark, tiny):
    assert rows(spark, tiny, "email_mask_cases", "id", "masked") == [(1, "an***@example.com"), (2, "a***@b.c"), (3, "x***@y.zz"), (4, "fi***@sub.example.org"), (5, "a@***@c.d")]
    plural = dict(rows(spark, tiny, "term_variants", "term", "plural"))
    assert plural == {"firm": "firms", "box": "boxes", "church": "churches", "policy": "policies", "day": "days", "marginal cost": "marginal costs", "cost-benefit": "cost-benefits", "tax policy": "tax policies", "gas": "gases", "y": "ys"}
    assert rows(spark, tiny, "cookie_parse", "id", "name", "value") == [(1, "sid", "abc d"), (1, "theme", "dark"), (3, "a", " 1"), (3, "b", "=2"), (3, "c", ""), (4, "k", "2")]
    assert rows(spark, tiny, "channel_dedupe", "id", "channels") == [(1, "a,b,c"), (2, "x"), (3, "z,y")]
    assert [r[1] for r in rows(spark, tiny, "search_escaped", "id", "found")] == [True, False, True, False, True, True]
    assert [r[1] for r in rows(spark, tiny, "rate_limit_errors", "id", "limited")] == [True, True, False, True, True, False, True, False]
    assert [r[1] for r in rows(spark, tiny, "automation_jobs", "id", "automatic")] == [True, True, False, True, True, False]


def test_joins_and_replies(spark, tiny):
    assert rows(spark, tiny, "hyphen_join", "u", "single_hyphen", "any_hyphen") == [("a",) + ("The public policy is strict.",) * 2, ("b",) + ("one sentence here and its tail.",) * 2, ("c",) + ("well- Known",) * 2, ("d", "a dash-- then more", "a dash-then more"), ("e", "soft­ ware", "software"), ("f", "only", "only")]
    found = {r.id: r.parsed for r in catalog.queries()["reply_parse"](spark, tiny).collect()}
    assert found == {1: "你好", 2: "你好|世界", 3: None, 4: None, 5: "a|b|c", 6: None}


def test_validation(spark, tiny):
    reasons = dict(rows(spark, tiny, "hard_validation", "b", "reason"))
    want = {"a": "note", "b": "ellipsis", "c": "pass", "d": "merged", "e": "symbol", "f": "pass", "g": "pass", "h": "pass", "i": "empty", "j": "long", "k": "traditional", "l": "count", "m": "pass", "n": "symbol", "o": "pass", "p": "note", "q": "symbol"}
    assert reasons == want
    lost = {(r.b, r.idx) for r in catalog.queries()["number_loss"](spark, tiny).collect() if r.lost}
    assert ("f", 1) in lost and ("f", 2) not in lost and ("g", 1) not in lost
    assert ("h", "opportunity cost") in rows(spark, tiny, "term_loss", "b", "en")


def test_attempts(spark, tiny):
    got = {r.b: (r.channel, r.fallbacks, r.escalated) for r in catalog.queries()["failover_replay"](spark, tiny).collect()}
    assert got == {"a": ("x", 0, 0), "b": ("x", 0, 0), "c": ("strong", 1, 1), "d": ("y", 1, 0), "f": ("x", 0, 0)}  # e runs out of attempts
    tried = {(r.b, r.pos): (r.won, r.calls, r.retries, r.soft_retries) for r in catalog.queries()["attempt_replay"](spark, tiny).collect()}
    assert tried[("b", 0)] == (1, 2, 0, 1) and tried[("c", 0)] == (None, 3, 3, 0) and tried[("d", 0)] == (None, 0, 0, 0) and tried[("f", 0)] == (2, 3, 1, 1)


def test_even_chunks(spark):
    units = spark.createDataFrame([(1, k, 10) for k in range(105)] + [(2, k, 1000) for k in range(5)], "doc_id long, k long, n long")
    got = folds.balanced_batches(units, 100, 3500).groupBy("doc_id", "batch").agg(F.count("*").alias("n")).collect()
    assert sorted((r.doc_id, r.batch, r.n) for r in got) == [(1, 0, 53), (1, 1, 52), (2, 0, 3), (2, 1, 2)]


CASES = [
    ([("The pub-", {}), ("lic policy is strict.", {"y": 116})], [[0, 1]]),
    ([("Ends with a period.", {}), ("lower case but a new sentence", {"y": 116})], [[0], [1]]),
    ([("continues without punctuation", {}), ("Upper case starts a new one", {"y": 116})], [[0], [1]]),
    ([("no punctuation at the end", {}), ("1. numbered item", {"y": 116})], [[0], [1]]),
    ([("no punctuation at the end", {}), ("• bullet item", {"y": 116})], [[0], [1]]),
    ([("wrapped line without punctuation", {}), ("next paragraph starts lower", {"y": 130})], [[0], [1]]),
    ([("wrapped line without punctuation", {}), ("caption in another size", {"y": 116, "size": 16})], [[0], [1]]),
    ([("left column line without punct", {}), ("right column continues here", {"y": 116, "x": 320})], [[0], [1]]),
    ([("a line that does not end", {}), ("with punctuation and continues", {"y": 116}), ("into a third line.", {"y": 132})], [[0, 1, 2]]),
    ([("single one.", {}), ("single two.", {"y": 116}), ("wrapped head", {"y": 132}), ("and its tail.", {"y": 148})], [[0], [1], [2, 3]]),
    ([(f"line {k} goes on", {"y": 100 + 16 * k}) if k == 0 else (f"and goes on {k}", {"y": 100 + 16 * k}) for k in range(14)], [list(range(12)), [12, 13]]),
    ([("a" * 900, {}), ("b" * 700, {"y": 116})], [[0], [1]]),
]


def test_units_of_lines(spark, tiny):
    lines = [(c, k, text, at.get("x", 72), at.get("y", 100), at.get("y", 100) + 13, at.get("size", 11)) for c, (case, _) in enumerate(CASES) for k, (text, at) in enumerate(case)]
    spark.createDataFrame(lines, "doc_id long, k long, line string, x0 long, y0 long, y1 long, size long").createOrReplaceTempView("golden_lines")
    flags = run_sql(f"SELECT * FROM {state.followers(Spark(), 'golden_lines')} f")(spark, tiny)
    got = {}
    for r in sorted(folds.merge_units(flags).collect(), key=lambda r: (r.doc_id, r.k)):
        got.setdefault(r.doc_id, {}).setdefault(r.unit, []).append(r.k)
    assert [list(got[c].values()) for c in range(len(CASES))] == [want for _, want in CASES]


# --- pages, replies, wrapping ---------------------------------------------------------------------


def test_recognised_words():
    words = [(60, 100, 110, 114, "The"), (114, 100, 150, 114, "market"), (60, 126, 96, 140, "clears"), (60, 190, 90, 204, "12345"), (0, 0, 0, 9, "flat"), (1, 1, 2, 2, " ")]
    lines = layout.ocr_lines(words)
    assert [x["text"] for x in lines] == ["The market", "clears", "12345"] and lines[0]["box"] == (60, 100, 150, 114)
    sent = lambda t: not t.isdigit()
    assert layout.page_units(words, sent) == ["The market clears"]
    two = [(60, 100, 110, 114, "left"), (300, 100, 350, 114, "right"), (60, 116, 110, 130, "be-"), (300, 116, 350, 130, "side"), (60, 132, 110, 146, "low")]
    assert layout.page_units(two, sent) == ["left below", "right side"]
    assert layout.page_units([*two[:1], (60, 115, 110, 117, "7"), (60, 118, 110, 132, "after")], sent) == ["left", "after"]  # a number between
    assert layout.ocr_lines([]) == [] and layout.page_units([], sent) == []


def test_reply_over_lines():
    assert layout.split_reply("短", [100, 300, 120]) == ["", "短", ""]
    assert layout.split_reply("只有一行", [200]) == ["只有一行"]
    assert layout.split_reply("机器学习Python语言", [160, 100]) == ["机器学习", "Python语言"]
    assert layout.split_reply("", [1, 2]) == ["", ""] and layout.split_reply("ab", [0, 0]) == ["a", "b"]
    assert layout.absorb([([0, 1, 2], [1, 3, 1], "短"), ([3], [9], " 全 "), ([4, 5], [1, 1], " "), ([6], [1], None)]) == {0: None, 1: "短", 2: None, 3: "全"}


@settings(max_examples=300, deadline=None)
@given(st.text("ab 12中文字。-", max_size=60), st.lists(st.integers(0, 300), min_size=1, max_size=8))
def test_splitting_loses_nothing(reply, widths):
    parts = layout.split_reply(reply, widths)
    assert len(parts) == len(widths)
    assert "".join(parts).replace(" ", "") == reply.replace(" ", "")
    if len(widths) > 1 and 0 < len(reply) < len(widths):
        assert [p for p in parts if p] in ([reply], []) or not reply.strip()


@settings(max_examples=300, deadline=None)
@given(st.text("ab 1中文，。（", max_size=80), st.sampled_from([30.0, 60.0, 200.0]))
def test_wrapping(text, width):
    lines = layout.wrap(text, 10.0, width)
    assert "".join(lines).replace(" ", "") == text.replace(" ", "")
    assert all(layout.text_width(x, 10.0) <= width + 12 or len(x) == 1 for x in lines)
    size = layout.fit(text, width, 40.0, 12.0)
    assert 4.0 <= size <= 12.0 and (size * 2) % 1 == 0


def test_closing_marks_and_paragraphs():
    assert layout.wrap("一二三，四五六。", 10.0, 30.0) == ["一二三，", "四五", "六。"]
    assert layout.wrap("", 10.0, 30.0) == [""] and layout.wrap("ab cd", 10.0, 10.0) == ["ab", "cd"]
    assert layout.fit("一二三四五六", 30.0, 12.0, 12.0) == 5.0
    assert layout.fit_paragraph(["一二三"] * 2, [10.0, 10.0], 100.0, 23.0) == (1.0, 2)
    assert layout.fit_paragraph(["一二三"] * 2, [10.0, 10.0], 100.0, 15.0) == (0.65, 2)
    factor, n = layout.fit_paragraph(["一二三"] * 9, [10.0] * 9, 100.0, 15.0)
    assert factor == pytest.approx(0.6) and n == 2
