"""Language ID, packing, BPE, SimHash, line dedup, chat, WARC and HTML against brute force on small rows."""

import base64
import collections
import hashlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import bpe, chat, htmlcrf, langid, linededup, packing, registry, simhash, warc
from quire.llm.components import connected_components

ODD = [
    (1, "The quick brown fox. " * 30, "en", "x"), (2, None, "en", None), (3, "", None, "y"), (4, "  \n\t ", "de", "x"), (5, "123 !!", "fr", "x"), (None, "The quick brown fox. " * 30, "en", "x"),
    (7, "Straße für die Müller, und der Ærger ist groß. " * 40, "de", "z"), (1, "The quick brown fox. " * 30, "en", "x"), (8, "日本語 😀 \x1c\x85 ΣΑΣ İs H̱ don't <|endoftext|>ab", "xx", "x"), (9, "a" * 3000, "en", "q"), (10, ("lorem ipsum " * 9 + "\n") * 900, "en", "q"),
]


def odd(spark, **renamed):
    """Rows of odd cases, with an extra column whose name an operator may use itself."""
    return spark.createDataFrame([(*r, 0) for r in ODD], "doc_id long, text string, lang string, source string, ids int")


def empty(df):
    return df.where("false")


def test_language_id_held_out_accuracy(spark, tiny):
    found = registry.queries()["op1_language_id"](spark, tiny).collect()
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{tiny}/documents.parquet'").fetchall())
    assert sorted(r.doc_id for r in found) == sorted(truth)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.95


def test_language_id_odd_rows(spark):
    docs = odd(spark)
    model = langid.train(docs)
    found = langid.classify(docs, model).collect()
    assert len(found) == len(ODD)
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (2, 3, 4, 5))
    assert [r.lang_pred for r in found if r.doc_id == 7] == ["de"]
    assert {r.lang_pred for r in langid.classify(docs, langid.train(empty(docs))).collect()} == {"und"}
    assert langid.classify(empty(docs), model).count() == 0


def test_language_id_scores_match_a_dense_sum(spark):
    docs = odd(spark)
    langs, logp, prior = model = langid.train(docs)
    text = ODD[6][1]
    sums = prior + sum(logp[f].astype(float) for f in langid._features(langid._fold(text)).ravel())
    r = langid.classify(docs.where("doc_id = 7"), model).first()
    p = np.exp((sums - sums.max()) / 3)
    assert r.lang_pred == langs[int(sums.argmax())] and abs(r.score - 1 / p.sum()) < 1e-6


def check_pieces(rows, texts, size):
    """texts: doc_id -> ids with the end id."""
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by) == set(texts)
    for i, ids in texts.items():
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size and at & (at - 1) == 0


def test_packing_against_the_tokenizer(spark, tiny):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = registry.queries()["op3_packing"](spark, tiny).collect()
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{tiny}/documents.parquet'").fetchall()
    check_pieces(rows, {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in texts}, 4096)


def test_packing_odd_rows(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = odd(spark).dropDuplicates(["doc_id"])
    texts = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    check_pieces(packing.pack(docs, with_ids=False).collect(), texts, 4096)
    with_ids = packing.pack(docs, sequence=64).collect()
    check_pieces(with_ids, texts, 64)
    assert all(list(r.ids) == texts[r.doc_id][r.start : r.start + r.length] for r in with_ids)
    assert sum(r.length for r in packing.pack(odd(spark), with_ids=False).collect()) == sum(len(texts[r[0]]) for r in ODD)
    assert packing.pack(empty(docs)).count() == 0


def test_hilbert_curve_is_a_walk():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def encoding():
    with open(bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_tiktoken(spark, tiny):
    e = encoding()
    for r in bpe.decode(bpe.encode(odd(spark))).collect():
        text = next(t for i, t, *_ in ODD if i == r.doc_id) or ""
        assert list(r.ids) == e.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert bpe.encode(empty(odd(spark))).count() == 0
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{tiny}/documents.parquet'").fetchall())
    for r in registry.queries()["op4_byte_bpe"](spark, tiny).collect():
        ids = e.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_refuses_unknown_ids(spark):
    with pytest.raises(Exception, match="ranks lack"):
        bpe.decode(spark.createDataFrame([(1, [999999])], "doc_id long, ids array<int>")).collect()


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fingerprint) -> component of each row."""
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if (a ^ rows[j][1]).bit_count() <= 2:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[root(i)].append(doc)
    return [min((d for d in ids[root(i)] if d is not None), default=None) for i in range(len(rows))]


def test_simhash_against_brute_force(spark, tiny):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{tiny}/documents.parquet' ORDER BY doc_id").fetchall()
    rows = [(i, slow_fingerprint(t)) for i, t in texts]
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.queries()["op5_simhash"](spark, tiny).collect()}
    assert found == {i: (f"{f:016x}", c) for (i, f), c in zip(rows, brute_components(rows), strict=True)}


def test_simhash_shards_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_NODES", 40)
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(30)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(25)}
    rows = [(1000 + k, f) for k, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "doc_id long, fp long")
    found = {r.fp % (1 << 64): r.rep for r in simhash.components(df).collect()}
    assert found == {f: c for (_, f), c in zip(rows, brute_components(rows), strict=True)}


def test_simhash_odd_rows(spark):
    docs = odd(spark)
    docs = docs.withColumn("rid", F.lit("own")).withColumn("fp", F.lit(1))
    kept = simhash.stage_simhash(spark, docs, "")
    rows = [(i, slow_fingerprint(t)) for i, t, *_ in ODD]
    assert kept.count() == len({c if c is not None else -1 for c in brute_components(rows)})
    assert kept.columns == docs.columns and simhash.stage_simhash(spark, empty(docs), "").count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (4, 5), (6, 6), (9, 8), (8, 7), (3, 1), (1, 2)] + [(100 + i, 101 + i) for i in range(40)]
    found = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(41)}


def test_line_dedup_against_sql(spark, tmp_path):
    rng = random.Random(1)
    base = ["the quick brown fox jumps %d" % i for i in range(30)] + ["é" * 40, "x" * 700]

    def edited(s):
        i, k = rng.randrange(len(s) + 1), rng.random()
        return s[:i] + rng.choice("abé ") + s[i + (k < 0.5) :] if k < 0.75 else s[:i] + s[i + 1 :]

    docs = [(i, "\n".join([edited(edited(rng.choice(base))) if rng.random() < 0.5 else edited(rng.choice(base)) for _ in range(6)] + ["", "  ", "short", "shorx"])) for i in range(60)] + [(60, None), (61, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = sorted((r.doc_id, r.n_lines, r.n_dropped, r.dropped_lines, r.text) for r in registry.queries()["op6_line_dedup"](spark, str(tmp_path)).collect())
    assert found == sorted(con.sql(linededup.OP6_SQL).fetchall())


def test_line_dedup_odd_rows(spark, monkeypatch):
    docs = odd(spark).withColumn("rid", F.lit("own")).withColumn("first", F.lit(1))
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", 0)  # the way without a broadcast
    found = linededup.stage_line_dedup(spark, docs, "")
    rows = found.collect()
    assert found.columns == docs.columns and len(rows) == len(ODD)
    texts = collections.Counter(r.text for r in rows if r.doc_id == 1)
    assert texts == {ODD[0][1]: 1, "": 1}  # of equal rows, the first keeps its line
    assert next(r.text for r in rows if r.doc_id is None) == ""
    assert next(r.text for r in rows if r.doc_id == 10) == "lorem ipsum " * 9 + "\n"
    assert next(r.text for r in rows if r.doc_id == 2) is None
    assert linededup.stage_line_dedup(spark, empty(docs), "").count() == 0


def test_chat_odd_rows(spark):
    rows = [(1, None, None, None, 0), (1, 2, "assistant", "x<\\[y", 0), (1, 2, "assistant", "x<\\[y", 0), (1, 3, "a[/INST]\n", "<sep></s>", 0), (None, 1, "user", "", 0), (2, 1, "assistant", chat.PLANTED, 0), (2, 2, "assistant", "b" * 5000, 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    found = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    assert [(t.role, t.text) for t in found[1].turns] == [("", ""), ("assistant", "x<\\[y"), ("assistant", "x<\\[y"), ("a[/INST]\n", "<sep></s>")]
    assert found[1].loss_text == "x<\\[yx<\\[y" and found[2].loss_text == chat.PLANTED + "b" * 5000 and found[None].loss_text == ""
    assert found[2].formatted.count("[INST]assistant") == 1  # one header for adjacent turns of one role
    assert chat.format_conversations(empty(table)).count() == 0


@pytest.mark.parametrize("name", ["op2_warc_zstd", "op6_line_dedup", "op8_chat_formatting", "op10_exact_mips"])
def test_oracle(spark, tiny, oracle, name):
    df, rel = registry.queries()[name](spark, tiny), oracle.sql(registry.oracle_sql()[name])
    order = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)


def test_warc_odd_rows(spark, tmp_path):
    big = "<p>é</p>" * 5000
    rows = [(1, "http://x/ü y\r\n", big, 0), (2, None, None, 0), (3, "u", big, 0), (None, "u", big, 0), (4, "u", "", 0), (1, "http://x/ü y\r\n", big, 0), (5, "u", "small", 0), (6, "u", "small", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    warc.write_archives(pages, f"file://{tmp_path}/a")
    found = sorted(map(tuple, warc.read_archives(spark, f"file://{tmp_path}/a").collect()), key=repr)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    response = lambda i, u, t: (i, u, "response", None, len((t or "").encode()), digest(t), (t or "").encode())
    revisit = lambda i, u, t: (i, u, "revisit", 1, len(t.encode()), digest(t), None)
    want = [response(1, rows[0][1], big)] * 2 + [response(2, None, None), revisit(3, "u", big), revisit(None, "u", big), response(4, "u", ""), response(5, "u", "small"), response(6, "u", "small")]
    assert [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in found] == sorted(want, key=repr)
    warc.write_archives(empty(pages), f"file://{tmp_path}/b")
    assert warc.read_archives(spark, f"file://{tmp_path}/b").count() == 0


def test_warc_validation():
    good = warc._record("response", 7, "u", None, 3, hashlib.sha256(b"abc").hexdigest(), b"abc")
    assert warc.parse_record(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WARC/1.0"), good.replace(b"Content-Length: 3", b"Content-Length: 4")):
        with pytest.raises(ValueError, match="."):
            warc.parse_record(bad)
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(b"x" * 300_000)
    archive = struct.pack("<II", warc.DICT_MAGIC, 3) + b"abc" + frame + frame + warc.EMPTY_FRAME.encode()
    assert [bytes(f) for _, f in warc.frames(memoryview(archive))] == [b"abc", frame, frame, b""]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.frames(memoryview(archive[:60])))


def article_of(page):
    """The generator's article: blocks between its heading and paragraph tags."""
    begin = page.index("<article>") + 9
    end = page.find("</article>", begin)
    parts = re.split(r"</?(?:h1|p)>", page[begin : end if end >= 0 else None])
    import html

    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts]
    return "\n".join(b for b in blocks if b)


def test_html_on_the_pages(spark, tiny):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{tiny}/pages.parquet'").fetchall())
    found = registry.queries()["op9_html_crf"](spark, tiny).collect()
    assert len(found) == len(pages)
    assert np.mean([r.text == article_of(pages[r.page_id]) for r in found]) >= 0.98
    assert all(r.n_chars == len(r.text) for r in found)


def test_html_held_out_labels():
    model, wrong, n = htmlcrf.default_model(), 0, 0
    for seed in range(90_000, 90_060):
        features, y = htmlcrf.labelled(seed)
        wrong += sum(a != b for a, b in zip(htmlcrf.viterbi(htmlcrf._scores(model, features), model.edge), y, strict=True))
        n += len(y)
    assert wrong <= 0.02 * n


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(4)
    for _ in range(50):
        scores, edge = rng.normal(size=6).tolist(), rng.normal(size=(2, 2))
        value = lambda y: sum(s for s, k in zip(scores, y, strict=True) if k) + sum(edge[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        best = max(([k >> b & 1 for b in range(6)] for k in range(64)), key=value)
        assert value(htmlcrf.viterbi(scores, edge)) == pytest.approx(value(best))


def test_html_odd_rows(spark):
    rows = [(1, "u", None, 0), (2, None, "", 0), (None, "u", "<p>x &lt; y<b", 0), (3, "u", "<script>x", 0), (3, "u", "<article><h1>T</h1><p>a&nbsp;\n b<br>c" + "<!-- z -->" * 3 + "</article><footer>&copy; x</footer>", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted(((r.page_id or 0, r.text) for r in htmlcrf.extract(pages).collect())) == [(0, "x < y"), (1, ""), (2, ""), (3, ""), (3, "T\na b c")]
    assert htmlcrf.extract(empty(pages)).count() == 0
