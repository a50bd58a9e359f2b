"""Long texts, damaged input, clashing columns and rows without labels."""

import base64
import collections
import hashlib
import math
import random
import struct
import time

import numpy as np
import public_tokenizers
import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from quire import scratch
from quire.llm import bpe, chat, htmlcrf, langid, packing, rows, simhash, warc
from tests.llm.test_text_ops import brute_components, check_pieces, encoding


# --- language ID ---------------------------------------------------------------------------------


def slow_features(text):
    """Buckets of a text's n-grams, by plain integers."""
    codes = [32]
    for ch in text or "":
        c = ord(ch.lower()) if ch.isalpha() and len(ch.lower()) == 1 else ord(ch) if ch.isalpha() else 32
        if c != 32 or codes[-1] != 32:
            codes.append(c)
    if codes == [32]:
        return []
    if codes[-1] != 32:
        codes.append(32)
    out, wrap = [], (1 << 32) - 1
    for i, c in enumerate(codes):
        a = c * 2654435761 & wrap
        b = a + (codes[i - 1] * 2246822519 if i > 0 else 0) & wrap
        t = b + (codes[i - 2] * 3266489917 if i > 1 else 0) & wrap
        for x in (a, b ^ 0x9E3779B9, t ^ 0x85EBCA6B):
            x ^= x >> 15
            out.append((x * 0x2C1B3C6D & wrap) >> 16)
    return out


ROWS = [(i, f"the quick brown fox number {i} and the dog " * 5, "en") for i in range(6)] + [(i, f"der schnelle braune Fuchs {i} und über dem Hund " * 4, "de") for i in range(6, 10)] + [(10, "le renard brun et le chien", "fr"), (11, None, "fr"), (12, "12 34", "fr"), (13, "the dog und le chien", None), (14, "", "de")]


def test_language_id_against_a_plain_classifier(spark):
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in ROWS], "doc_id long, text string, lang string, score double, lang_pred string")
    counts, docs_of = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in ROWS:
        if lang is not None and text is not None:
            docs_of[lang] += 1
            counts[lang].update(slow_features(text))
    want = {}
    for i, text, _ in ROWS:
        sums = {}
        for lang in sorted(docs_of):
            total = sum(counts[lang].values()) + 0.5 * langid.BUCKETS
            sums[lang] = math.log(docs_of[lang] / sum(docs_of.values())) + sum(math.log((counts[lang][f] + 0.5) / total) for f in slow_features(text))
        best = max(sums, key=sums.get)
        want[i] = (best, 1 / sum(math.exp((s - sums[best]) / 3) for s in sums.values())) if slow_features(text) else ("und", 0.0)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.classify(docs, langid.train(docs)).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-4) for i in want)


def test_language_id_features_do_not_depend_on_slices():
    text = "Straße und der große Hund läuft " * 20_000
    codes = langid._fold(text)
    assert len(codes) > 2 * langid.SLICE
    assert np.array_equal(np.sort(np.concatenate(list(langid._slices(codes)))), np.sort(langid._features(codes).ravel()))
    assert sorted(slow_features(text[:500])) == sorted(langid._features(langid._fold(text[:500])).ravel().tolist())


def test_language_stage_without_labels_or_rows(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string"
    docs = spark.createDataFrame([(1, "the fox", None, "s", 7, 0.1, "q"), (2, None, None, "s", 0, 0.1, "q"), (3, "12", None, None, 2, None, None)], names)
    kept = langid.stage_language_id(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r.doc_id, r.lang) for r in kept.collect()) == [(1, "und"), (2, "und"), (3, "und")]
    assert langid.stage_language_id(spark, docs.where("false"), "").count() == 0


# --- WARC ----------------------------------------------------------------------------------------


def test_warc_damage_and_other_writers():
    record = warc._record("response", 7, "u", None, 3, hashlib.sha256(b"abc").hexdigest(), b"abc")
    samples = [b"<html><p>some text of page %d and more of it</p></html>" % i for i in range(300)]
    dictionary = zstandard.train_dictionary(2048, samples)
    lead = lambda d: struct.pack("<II", warc.DICT_MAGIC, len(d)) + d
    whole = zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=True).compress(record)
    streaming = zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False).compressobj()
    streamed = streaming.compress(record) + streaming.flush()
    plain = dictionary.as_bytes()
    read = lambda data: [r["page_id"] for r in warc.records(memoryview(data))]
    assert read(lead(plain) + whole + warc.EMPTY_FRAME.encode() + streamed) == [7, 7]
    assert read(lead(zstandard.ZstdCompressor().compress(plain)) + whole) == [7]
    assert read(b"") == []
    spoilt = bytearray(whole)
    spoilt[-1] ^= 1
    headless = zstandard.ZstdCompressor().compress(record.replace(b"Content-Length", b"Content-Size"))
    for bad in (lead(plain) + bytes(spoilt), headless, whole + lead(plain), lead(plain) + whole[:-3], b"abcdefgh" + whole, whole):
        with pytest.raises(ValueError, match="."):
            read(bad)


def test_warc_over_several_archives(spark, tmp_path):
    rng = np.random.default_rng(0)
    pages = [(i, "u", rng.bytes(40_000).hex()) for i in range(12)] + [(20, "u", "x" * 3_000_000)]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/a", 100_000)
    assert len(list((tmp_path / "a").glob("part-*"))) > 3
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect()}
    assert got == {i: t for i, _, t in pages}


# --- chat ----------------------------------------------------------------------------------------


def test_long_conversations(spark):
    rng = np.random.default_rng(1)
    rows = [(c, k, "assistant" if rng.random() < share else "user", f"t{k} </s>" * int(rng.integers(0, 3))) for c, (n, share) in enumerate([(1000, 0.5), (700, 0.98), (128, 0.0), (129, 1.0), (1, 1.0)]) for k in range(n)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for c in range(5):
        own = [(role, text) for i, _, role, text in rows if i == c]
        assert [(t.role, t.text) for t in found[c].turns] == own
        assert found[c].loss_text == "".join(text for role, text in own if role == "assistant")
        changes = 1 + sum(a[0] != b[0] for a, b in zip(own, own[1:], strict=False))
        assert found[c].formatted.count("[INST]user[/INST]") + found[c].formatted.count("[INST]assistant[/INST]") == changes
        assert len(found[c].loss_spans) == sum(role == "assistant" for role, _ in own)


# --- HTML ----------------------------------------------------------------------------------------

PAGE = "<article><h1>T</h1><p>one two three.</p>%s<p>four five six.</p></article>"


@pytest.mark.parametrize("odd", ['<svg class="i"/>', '<object data="x">', "<canvas>", "<iframe src=x>", "<svg><text>no</text></svg>", "<!-->", "</ x>", "<script>if (a<b) '</p>'</script >", "<br/>"])
def test_html_drops_no_article_text(odd):
    assert htmlcrf.main_text(PAGE % odd, htmlcrf.default_model()) == "T\none two three.\nfour five six."


def test_html_odd_tags():
    texts = lambda page: [b.text for b in htmlcrf.leaf_blocks(page)]
    assert texts('<p title="5" x">one') == ["one"]
    assert texts('<p title="5>one</p><p>two</p>') == ["one", "two"]
    assert texts("<p a='b>c' d=\"x>y\">q</p>") == ["q"]
    assert texts("<p>1 < 2</p><p>a&lt;b</p>") == ["1 < 2", "a<b"]
    assert texts("<p>x<script>y") == ["x"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]


def test_html_long_and_deep_pages_take_linear_time():
    model = htmlcrf.default_model()

    def seconds(n):
        page = "".join(f'<div class="c{i} d"><p>text {i} of it.' for i in range(n)) + "</i>" * n + "</div>" * n
        began = time.process_time()
        assert len(htmlcrf.leaf_blocks(page, model.names())) == n
        htmlcrf.main_text(page, model)
        return time.process_time() - began

    seconds(500)
    assert seconds(20_000) < 12 * max(seconds(5_000), 0.05)
    text = "word and more text. " * 50
    page = "<body><nav><a href=x>Home</a></nav><article><h1>T</h1>" + f"<p>{text}</p>" * 5_000 + "</article>"
    assert htmlcrf.main_text(page, model) == "\n".join(["T"] + [text.strip()] * 5_000)


# --- tokens --------------------------------------------------------------------------------------


def test_packing_of_texts_without_spaces(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(2)
    unspaced = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 20_000))) for _ in range(30)]
    t = packing.WordTokenizer(packing.TOKENIZER)
    for x in unspaced:
        t.encode(x)
    assert t.folded.bytes == 0 and t.raw.bytes == 0  # long words leave nothing behind
    for k in range(40):
        t.encode(" ".join(f"w{i}" for i in range(k * 20_000, (k + 1) * 20_000)))
    assert t.folded.bytes <= packing.CACHE_BYTES
    plain = Tokenizer.from_file(packing.TOKENIZER)
    docs = spark.createDataFrame([(i, x, "own") for i, x in enumerate([*unspaced[:3], "a " * 700_000, None, ""])], "doc_id long, text string, key string")
    check_pieces(packing.stage_packing(spark, docs, "").collect(), {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()}, 4096)
    assert packing.stage_packing(spark, docs.where("false"), "").count() == 0


def test_bpe_of_long_words(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("etaoinshr"), n)) for n in (65, 200, 1000, 5000)] + ["=" * 700, "é" * 300, "日本" * 200]
    docs = spark.createDataFrame([(i, f"{w} end") for i, w in enumerate(words)], "doc_id long, text string").coalesce(1)
    e = encoding()
    for r in bpe.decode(bpe.encode(docs)).collect():
        assert list(r.ids) == e.encode_ordinary(f"{words[r.doc_id]} end") and bytes(r.decoded).decode() == f"{words[r.doc_id]} end"
    assert bpe.encode(docs.withColumn("codes", F.lit(1)).where("false")).count() == 0


# --- SimHash -------------------------------------------------------------------------------------


def test_simhash_shards_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_SHARDS", 3)
    monkeypatch.setattr(simhash, "SHARD_NODES", 10)
    levels = []
    own = simhash._next_level
    monkeypatch.setattr(simhash, "_next_level", lambda *a: levels.append(a[2]) or own(*a))
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(15)}
    rows = [(1000 + k, f) for k, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "doc_id long, fp long")
    found = {r.fp % (1 << 64): r.rep for r in simhash.components(df).collect()}
    assert found == {f: c for (_, f), c in zip(rows, brute_components(rows), strict=True)}
    assert len(levels) >= 2


def test_written_tables_leave_no_shuffle_files(spark):
    def shuffled():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {name for i in range(blocks.size()) if (name := blocks.apply(i).name()).startswith("shuffle_")}

    table = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n")).join(spark.range(50).repartition(3).withColumnRenamed("id", "k"), "k")
    before, setting = shuffled(), spark.conf.get(scratch.CLEANUP, None)
    written = scratch.materialize(table, "test")
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(scratch.CLEANUP, None) == setting
    assert written.count() == table.count() == 10


def test_plain_scans_are_not_copied(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for plain in (docs, docs.select("doc_id", "text").where("doc_id > 3")):
        assert rows.steady(plain) is plain
    for other in (docs.repartition(3), docs.orderBy("doc_id"), docs.distinct(), docs.limit(5), docs.coalesce(1), docs.union(docs), docs.select("doc_id").groupBy("doc_id").count(), docs.select("doc_id", F.explode(F.split("text", " ")).alias("text"))):
        copied = rows.steady(other)
        assert copied is not other and rows.steady(copied) is copied


def test_a_merge_passes_over_its_word_once(spark):
    words = ["a", "ab", "aaaaaaaa", "abababab abab", "the quick brown foxes", "  \n\t x", "é日本", "x" * 63, "xy" * 32]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    encoded = bpe.encode(docs)
    assert "filter(" not in encoded._jdf.queryExecution().analyzed().toString()
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: encoding().encode_ordinary(w) for i, w in enumerate(words)}


def merged_plainly(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def parts_of(words, path):
    """Parts of every word."""
    text = b"".join(words)
    begins, heads = bpe.cut(text, np.cumsum([0, *map(len, words[:-1])]), bpe._joints(path))
    parts = []
    for head, x, y in zip(heads, begins, [*begins[1:], len(text)], strict=True):
        parts += [[]] * bool(head)
        parts[-1] = [*parts[-1], text[x:y]]
    assert [b"".join(p) for p in parts] == words
    return parts


@pytest.mark.parametrize("places", [4, 23])
def test_no_merge_crosses_a_cut(tmp_path, monkeypatch, places):
    monkeypatch.setattr(bpe, "RANK_PLACES", places)
    monkeypatch.setattr(bpe, "CROSS_PLACES", places)
    cuts = 0
    for seed in range(150 * places, 150 * places + 150):
        rng = random.Random(seed)
        letters = [bytes([x]) for x in rng.sample(range(256), rng.choice([2, 3, 4, 6]))]
        pieces = dict.fromkeys(letters)
        for _ in range(rng.randint(3, 60)):  # pieces made of two others, or in no order at all
            pieces |= {b"".join(rng.choices(list(pieces) if seed % 2 else letters, k=2 if seed % 2 else rng.randint(2, 5)))[:12]: None}
        order = list(pieces) if seed % 4 < 2 else rng.sample(list(pieces), len(pieces))
        path = tmp_path / f"{seed}.tiktoken"
        path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % i for i, p in enumerate(order)))
        ranks, words = bpe.load_ranks(str(path)), [b"".join(rng.choices(letters, k=rng.randint(1, 24))) for _ in range(40)]
        for word, parts in zip(words, parts_of(words, str(path)), strict=True):
            cuts += len(parts) - 1
            assert [i for p in parts for i in merged_plainly(p, ranks)] == merged_plainly(word, ranks)
    assert cuts > 0


def test_words_share_the_parts_they_are_folded_by(spark, tiny):
    texts = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect() if r.text]
    words = list({w: None for t in texts for w in regex.findall(public_tokenizers.PATTERN, t)})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    (block,) = bpe.blocks(docs, bpe.RANKS, public_tokenizers.PATTERN).collect()
    assert len(block["words"]) == len(words)
    folded = [bytes(p["bytes"]) for p in block["parts"]]
    assert len(set(folded)) == len(folded)
    assert [b"".join(folded[i] for i in w).decode() for w in block["words"]] == words
    assert 3 * sum(map(len, folded)) < 2 * sum(len(w.encode()) for w in words)
    assert {r.doc_id: r.ids for r in bpe.encode(docs).collect()} == {i: encoding().encode_ordinary(t) for i, t in enumerate(texts)}


def test_cuts_of_blocks_at_odd_places(spark, monkeypatch):
    texts = ["", None, "x", "a" * 200, "the quick brown foxes jumped over " * 3, "日本語 é" * 40, "=" * 90 + " ciónuemiñ thenining"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for size in (1, 7, 1 << 17):
        monkeypatch.setattr(bpe, "CUT_BYTES", size)
        for chars in (1, 1000):
            monkeypatch.setattr(bpe, "BLOCK_CHARS", chars)
            assert {r.doc_id: r.ids for r in bpe.encode(docs).collect()} == {i: encoding().encode_ordinary(t or "") for i, t in enumerate(texts)}
