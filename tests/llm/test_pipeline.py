"""The pipeline's stages, each against what its own input says."""

import duckdb
import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from quire import scratch
from quire.llm import langid, linededup, nearcopies, packing, simhash
from tests.llm.test_text_ops import brute_components, check_pieces, slow_fingerprint


def test_stages(spark, tiny):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "packing"]
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, tiny), name)
        after = docs.collect()
        assert docs.columns == columns and {r.doc_id for r in after} <= {r.doc_id for r in before}
        if name == "language_id":
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == set()  # all of these have a language
        elif name == "line_dedup":
            con = duckdb.connect()
            con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
            con.executemany("INSERT INTO documents VALUES (?, ?)", [(r.doc_id, r.text) for r in before])
            want = {r[0]: r[4] for r in con.sql(linededup.OP6_SQL).fetchall()}
            assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
        else:
            rows = [(r.doc_id, slow_fingerprint(r.text)) for r in before]
            assert sorted(r.doc_id for r in after) == sorted(set(brute_components(rows)))
        before = after
    t = Tokenizer.from_file(packing.TOKENIZER)
    check_pieces(corpus_pipeline.STAGES[-1][1](spark, docs, tiny).collect(), {r.doc_id: t.encode(r.text, add_special_tokens=False).ids + [2] for r in before}, 4096)
    assert corpus_pipeline.run(spark, tiny).count() > 0


def test_language_stage_rejects_only_what_has_no_language(spark):
    rows = [(i, "the quick brown fox and the dog " * 5, "en", "s", 1) for i in range(20)] + [(i, "der schnelle braune Fuchs und der Hund " * 5, "de", "s", 1) for i in range(20, 40)]
    rows += [(50, None, "en", "s", 0), (51, "123 -- 45", "en", "s", 9), (52, "the fox", None, "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.lang for r in langid.stage_language_id(spark, docs, "").collect()}
    assert set(kept) == {*range(40), 52} and kept[52] == "en"


def test_near_copies_leave_one(spark):
    rng = np.random.default_rng(0)
    words = [f"w{k}" for k in rng.integers(0, 9000, 1500)]
    near = [" ".join([*words[:700], f"edit{i}", *words[701:]]) for i in range(4)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*near, near[0], "something else altogether here", ""])], "doc_id long, text string")
    fps = [(i, slow_fingerprint(t)) for i, t in enumerate([*near, near[0], "something else altogether here", ""])]
    assert sorted(r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()) == sorted(set(brute_components(fps)))


def test_near_copies_of_many_bits_leave_one(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 9000, 300)]

    def edited(n):
        return " ".join(f"edit{n}" if k % (300 // n) == 2 * n else w for k, w in enumerate(words))

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    whole = " ".join(words)
    jaccard = {n: len(shingles(whole) & shingles(edited(n))) / len(shingles(whole) | shingles(edited(n))) for n in (5, 10)}
    assert jaccard[5] >= 0.8 > jaccard[10]
    assert (slow_fingerprint(whole) ^ slow_fingerprint(edited(5))).bit_count() > 2
    docs = spark.createDataFrame([(1, whole), (2, edited(5)), (3, edited(10)), (4, whole)], "doc_id long, text string")
    near = len(shingles(edited(5)) & shingles(edited(10))) / len(shingles(edited(5)) | shingles(edited(10)))
    assert near < 0.8
    assert sorted(r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()) == [1, 3]


def test_near_copies_against_all_pairs(spark):
    """Texts that share a long passage but are unlike, beside chains of near copies."""
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 20_000, n)]
    common, texts = word(120), []
    for share in (60, 120, 120, 120):
        for _ in range(25):
            texts.append(common[:share] + word(int(rng.integers(25, 60))))
    for base in [list(t) for t in texts[::9]]:
        for _ in range(3):
            at = int(rng.integers(0, len(base)))
            base = [*base[:at], *word(int(rng.integers(0, 4))), *base[at + int(rng.integers(0, 4)) :]]
            texts.append(base)
    texts += [["a"], ["a"], ["b"], [], ["A"]]
    sets = []
    for t in texts:
        t = [w.lower() for w in t]
        sets.append({tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    like = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if (not a and not sets[j]) or 10 * len(a & sets[j]) >= 8 * len(a | sets[j]) > 0:
                like += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert like > 60
    docs = spark.createDataFrame([(i, " ".join(t), "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, key string, node string")
    kept = simhash.stage_simhash(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({root(i) for i in range(len(texts))})


def test_stages_number_rows_of_a_shuffle(spark):
    texts = [f"one line of document {k // 2} and then some more words for it\nshared line of all the documents" for k in range(40)]
    docs = spark.createDataFrame([(None if k % 5 == 0 else k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(7, "text")
    assert simhash.stage_simhash(spark, docs, "").count() == 20
    found = linededup.stage_line_dedup(spark, docs, "").collect()
    assert len(found) == 40 and sum("shared" in r.text for r in found) == 1


def test_near_copies_meet_in_the_trees(spark, monkeypatch):
    """Without any key, fingerprints within the trees' radius still bring near copies together, and the exact similarity decides."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in rng.integers(0, 9000, 1500)]
    texts = [" ".join([*words[:700], f"edit{i}", *words[701:]]) for i in range(4)] + ["a b c d e", "a b c d e", " ".join(words[::-1]), ""]
    monkeypatch.setattr(nearcopies, "band_keys", lambda found: np.zeros(0, np.int64))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [nearcopies.shingles(t) for t in texts]
    linked = brute_components([(i, simhash.majority(s)) for i, s in enumerate(sets)])
    assert len(set(linked)) == 4
    assert sorted(r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()) == sorted(set(linked))
    # equal fingerprints of unlike sets are no link
    monkeypatch.setattr(simhash, "majority", lambda found: 0)
    assert sorted(r.doc_id for r in simhash.stage_simhash(spark, docs, "").collect()) == [0, 4, 6, 7]


def test_texts_reach_python_in_small_batches(spark, monkeypatch):
    """As many rows as Spark hands over at once while a table of the stages is written; its own batches have 10,000."""
    docs = spark.createDataFrame([(k, f"text of {k} " + "and on " * 9) for k in range(3000)], "doc_id long, text string").coalesce(1)
    setting, sizes, materialize = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None), {}, scratch.materialize

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    def seen(table, label, *a, **b):
        sizes[label] = [r.n for r in docs.mapInArrow(run, "n long").collect()]
        return materialize(table, label, *a, **b)

    monkeypatch.setattr(scratch, "materialize", seen)
    packing.stage_packing(spark, docs.limit(9), "")
    simhash.stage_simhash(spark, docs.limit(9), "")
    for label in ("tokens", "near", "near-sets"):
        assert sum(sizes[label]) == 3000 and max(sizes[label]) <= 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) == setting


def test_language_stage_returns_small_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(k, ["the quick brown fox", "der schnelle Fuchs"][k % 2], ["en", "de"][k % 2]) for k in range(40)], "doc_id long, text string, lang string")
    ran, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: ran.append(f) or plain(self, f, *a, **b))
    langid.stage_language_id(spark, docs, "")
    batch = pa.RecordBatch.from_pydict({"doc_id": range(3000), "text": ["the brown fox", None, "der Fuchs"] * 1000, "lang": [None, "en", "xx"] * 1000})
    out = list(ran[-1](iter([batch])))
    assert max(b.num_rows for b in out) <= 1000
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == [k for k in range(3000) if k % 3 != 1]
    assert {(r["text"], r["lang"]) for r in rows} == {("the brown fox", "en"), ("der Fuchs", "xx")}
