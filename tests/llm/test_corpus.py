"""Quality, language, language model, decontamination, mixing, archives, toxicity."""

import collections
import gzip
import hashlib
import math
import pathlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from ledgraph.llm import decontaminate, langid, lm, mixing, quality, toxicity, warc
from ledgraph.llm.shared import LOWER_BYTES

from .conftest import prose


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    rows = con.execute(sql)
    return [x[0] for x in rows.description], rows.fetchall()


def agree(df, sql, **tables):
    names, want = by_sql(sql, **tables)
    text = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert text([tuple(r[c] for c in names) for r in df.collect()]) == text(want)


# ---- quality


def test_text_counts():
    assert quality.text_counts(None) == quality.text_counts("") == (0, 0, 0, 0, 0, 0)
    assert quality.text_counts("a# b\n\nc d\nc d\n  \nc d") == (8, 9, 1, 2, 6, 4)
    assert quality.text_counts("a a a a") == (4, 4, 0, 0, 4, 1)
    assert quality.text_counts("é 漢\xa0字")[:2] == (2, 4)


def test_quality_against_sql(spark, odd_docs, no_docs):
    rows = [(i, prose(i, 60 + i), "en" if i % 2 else "de", "s" if i % 3 else None) for i in range(40)]
    rows += [(100 + i, prose(i, 60).replace(" ", "#%$ "), "en", "s") for i in range(4)] + [(200, None, None, None), (201, "x y z " * 40, "en", "s"), (202, "one line\n" * 30 + prose(7, 60), "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = quality.judged(df)
    kept = {r.doc_id: r.kept for r in found.collect()}
    assert all(kept[i] for i in range(40)) and not any(kept[i] for i in (100, 101, 102, 103, 200, 201, 202))
    agree(found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), quality.SQL, documents=df)
    odd = quality.judged(odd_docs)
    assert sorted((r.doc_id or 0, r.n_words) for r in odd.collect()) == sorted((r.doc_id or 0, len((r.text or "").encode().split())) for r in odd_docs.collect())
    assert {r.doc_id: r.base_failed for r in odd.collect()} == {1: True, 2: True, None: False, 3: True, 4: False, 5: False, 6: False, 7: True, 8: True, 9: True}
    assert quality.judged(no_docs).count() == 0


def test_fences_follow_each_source(spark):
    """Sources with other habits get other fences, for each metric; a small group lies between its own and its language's."""
    r = random.Random(8)

    def text(i, long, marks, lines, phrase):
        words = [w + ("ness" if long else "") for w in prose(i, 200).replace(".", "").split()]
        words = [w + ("#" if marks and r.random() < 0.2 else "") for w in words] + (["of", "this", "very", "kind"] * r.randrange(2, 6) if phrase else [])
        return "\n".join(" ".join(words[k : k + 20]) for k in range(0, len(words), 20)) + "\nend of line" * (1 + (r.randrange(2, 5) if lines else 0))

    rows = [(i, text(i, False, False, False, False), "en", "plain") for i in range(60)] + [(100 + i, text(i, True, True, True, True), "en", "odd") for i in range(60)]
    rows += [(200, text(7, True, True, True, True), "en", "tiny")]
    counts = quality.counted(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).withColumn("base_failed", F.lit(False))
    high = {(x.source, x.metric): x.high for x in quality.fences(counts).collect()}
    for k in quality.METRICS:
        assert high["odd", k] > high["plain", k], k
    assert high["plain", "symbols"] < high["tiny", "symbols"]
    few = {(x.source, x.metric): x.q3 for x in quality.fences(counts, prior_docs=10**6).collect()}
    assert max(abs(few[s, "symbols"] - few["tiny", "symbols"]) for s in ("plain", "odd")) <= 1


def test_sketch_buckets(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 999, 123_456]
    got = [r.b for r in spark.createDataFrame([(v,) for v in values], "v long").select(quality.bucket(F.col("v")).alias("b")).collect()]
    assert all(b <= v < b + max(1, v / 31) for v, b in zip(values, got, strict=True)) and got[:3] == values[:3]


# ---- language

SYLLABLES = {"en": "th an er ing on ti the wh ou ea", "de": "sch ein ung keit ge ver ch ß ü tz", "fr": "eau ê oi eux que é ai ment ç ou", "es": "ción ado rr ñ os ar mente ez ll ía"}


def speech(lang, seed, n=80):
    r = random.Random(f"{lang}{seed}")
    parts = SYLLABLES[lang].split()
    return " ".join("".join(r.choices(parts, k=r.randrange(1, 4))) for _ in range(n))


def test_language(spark, odd_docs, no_docs):
    rows = [(i, speech(k, i), k) for i in range(400) for k in [list(SYLLABLES)[i % 4]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = langid.trained(docs)
    assert set(content) == set(SYLLABLES) and all(0 < len(v) <= 4 * langid.SAMPLE_DOCS * (langid.SAMPLE_CHARS + 1) for v in content.values())
    blind = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 !? 7 ²")], "doc_id long, text string"))
    found = {r.doc_id: r for r in langid.identify(blind, content).collect()}
    held = [(i, k) for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(found[i].lang_pred == k for i, k in held) >= 0.99 * len(held)
    assert not any(found[i].rejected for i, _ in held)
    assert all(found[i].lang_pred == "und" and found[i].rejected and found[i].score == 0 for i in (-1, -2, -3))
    assert all(0 <= r.score <= 1 for r in found.values())
    mixture = spark.createDataFrame([(1, speech("en", 7) + " " + speech("de", 7))], "doc_id long, text string")
    assert langid.identify(mixture, content).first().margin < found[held[0][0]].margin
    odd = langid.identify(odd_docs, content).collect()
    assert {r.doc_id for r in odd if r.rejected and r.lang_pred == "und"} == {2, 3, 7} and len(odd) == odd_docs.count() and all(r.size == 7 and r.kept == "clash" for r in odd)
    assert langid.identify(no_docs, content).count() == 0
    left = langid.without_rejected(odd_docs)
    assert left.schema.simpleString() == odd_docs.schema.simpleString() and set(map(str, left.collect())) <= set(map(str, odd_docs.collect()))
    assert langid.without_rejected(no_docs).count() == 0


def test_language_by_plain_compression(spark):
    """The smallest of the sizes that one compressor per language gives, piece by piece."""
    content = {k: " ".join(speech(k, i) for i in range(20)).encode() for k in SYLLABLES}
    texts = [speech(k, 900 + i, n) for k in SYLLABLES for i, n in enumerate((3, 10, 60, 500))]
    judge = langid.Classifier(content)
    for text in texts:
        raw = langid.letters(text)
        n = -(-len(raw) // langid.PIECE)
        step = -(-len(raw) // n)
        sizes = {}
        for k, v in content.items():
            how = zstandard.ZstdCompressionParameters.from_level(6, dict_size=len(v), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[k] = sum(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(raw[i : i + step])) for i in range(0, len(raw), step))
        best, second = sorted(sizes.values())[:2]
        lang, _, margin = judge(text)
        assert sizes[lang] == best and margin == pytest.approx((second - best) / best)


def test_language_of_nothing_learned(spark, odd_docs, no_docs):
    assert langid.identify(odd_docs, langid.fit(no_docs)).filter("lang_pred <> 'und'").count() == 0


# ---- language model


def plain_counts(rows):
    texts = {d: (t or "").encode().translate(LOWER_BYTES).split() + [None] for d, t in rows}
    learn = [w for d, w in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2]
    return texts, collections.Counter(x for w in learn for x in w), collections.Counter(p for w in learn for p in zip(["<s>", *w[:-1]], w, strict=True)), len(learn)


def test_language_model_against_plain_counts(spark, tmp_path, monkeypatch, odd_docs, no_docs):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 3000)
    rows = [(i, prose(i % 50, 80) + " " + prose(i, 20)) for i in range(150)] + [(900, None), (901, "Only new words 漢字")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    weights = {}
    plain = lm.mixture_weights
    monkeypatch.setattr(lm, "mixture_weights", lambda *a: weights.setdefault("w", plain(*a)))
    found = {r.doc_id: r for r in lm.op5_language_model(spark, str(tmp_path)).collect()}
    texts, one, two, starts = plain_counts(rows)
    total, distinct, w = sum(one.values()), len(one), weights["w"]
    for d, tokens in texts.items():
        r = found[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(one[x] > 0 for x in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((one[x] + 1) / (total + distinct + 1)) for x in tokens))
        score = 0
        for v, t in zip(["<s>", *tokens[:-1]], tokens, strict=True):
            c = starts if v == "<s>" else one[v]
            a = w[int(c).bit_length()]
            score += math.log10(a[0] * two[v, t] / max(c, 1) + a[1] * one[t] / total + a[2] / (distinct + 1))
        assert r.score == pytest.approx(score)
    held = [r for r in found.values() if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    odd = lm.score_texts(odd_docs, F.lit(True)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in odd) == sorted((r.doc_id or 0, *[len((r.text or "").encode().split()) + 1] * 2) for r in odd_docs.collect())
    assert all(math.isfinite(r.score) and r.score < 0 for r in odd)
    assert lm.score_texts(no_docs, F.lit(True)).count() == 0
    assert lm.score_texts(df, F.lit(False)).first().train_tokens == 0
    monkeypatch.setattr(lm, "MOST_RANGES", 8)  # fewer than the least number of ranges
    two_steps = {r.doc_id: r for r in lm.score_texts(df.repartition(12), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).collect()}
    assert two_steps.keys() == found.keys()
    for d, r in two_steps.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (found[d].n_tokens, found[d].n_known, found[d].train_tokens)
        assert (r.base_score, r.score) == pytest.approx((found[d].base_score, found[d].score))
    assert lm.score_texts(no_docs, F.lit(True)).count() == 0


def test_rows_of_a_block_grow_with_the_root_of_all_blocks():
    assert [lm.coarse_ranges(1 << k) for k in (4, 12, 13, 24)] == [16, 4096, 128, 4096]


def test_weights_by_maximisation():
    # One class in which pairs explain nearly all, one in which words do.
    at = lambda log: 0 if log is None else lm.MIDDLE + log
    cell = lambda c, two, one: lm.cell(c, at(two), at(one))
    cells, n = np.array([cell(3, 44, 4), cell(5, None, 34), cell(3, None, 4)]), np.array([90.0, 50.0, 10.0])
    w = lm.mixture_weights(cells, n)
    assert np.array_equal(w, lm.mixture_weights(cells[::-1], n[::-1]))
    assert w[3, 0] > 0.85 and w[5, 1] > 0.95 and w[0, 0] == 0 and np.allclose(w.sum(axis=1), 1)


def test_bins_hold_every_ratio():
    """No estimate is clipped, however large the corpus: bins are half octaves over all that counts of 10^15 tokens can give."""
    for x in (1e-30, 1e-15, 0.3, 1.0, 1e6, 1e15, 1e30):
        assert abs((lm.ratio_bin(np.array([x]))[0] - lm.MIDDLE) * lm.BIN_WIDTH - math.log2(x)) <= lm.BIN_WIDTH / 2
    assert lm.ratio_bin(np.array([0.0]))[0] == 0 and 0 < lm.ratio_bin(np.array([1e-30]))[0] < lm.ratio_bin(np.array([1e30]))[0] < 1 << lm.BIN_BITS


def test_packed_numbers():
    x = np.array([0, 1, 255, 256, 1 << 40, (1 << 64) - 1], np.uint64)
    assert np.array_equal(lm.unpacked_keys(lm.packed_keys(x)), x) and np.array_equal(lm.unpacked(lm.packed(x), np.uint64), x)
    assert len(lm.unpacked(lm.packed(x[:0]), np.uint64)) == 0


# ---- decontamination


@pytest.fixture(scope="module")
def bench(spark):
    items = [(1, prose(71, 40)), (2, "Short test item!"), (3, None), (4, "..."), (10, prose(71, 12)), (None, prose(72, 15)), (2, "Short test item!")]
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination_against_sql(spark, bench, odd_docs, no_docs):
    item = prose(71, 40)
    rows = [(1, prose(1, 50) + " " + item.upper() + " " + prose(2, 30)), (2, "a short TEST; item here"), (3, prose(3, 99)), (4, None), (5, item + " " + item), (6, " ".join(item.split()[:9])), (7, prose(4, 20) + " " + prose(72, 15))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = decontaminate.contamination(df, bench)
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    shown = found.select("doc_id", "n_words", "n_hit", F.size("items").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    agree(shown, decontaminate.SQL, documents=df, benchmark=bench)
    assert {r.doc_id: r.n_hit for r in found.collect()} == {1: 40, 2: 3, 3: 0, 4: 0, 5: 80, 6: 0, 7: 15}
    joined = decontaminate.contamination(df, bench, broadcast_bytes=0)
    assert sorted((r.doc_id, r.n_hit) for r in joined.collect()) == sorted((r.doc_id, r.n_hit) for r in found.collect())
    odd = decontaminate.contamination(odd_docs, bench)
    counts = lambda rows: sorted((r.doc_id or 0, r.n_words, r.n_hit, r.note or "") for r in rows)
    assert counts(odd.collect()) == sorted((r.doc_id or 0, len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").lower())), 0, r.note or "") for r in odd_docs.collect())
    back = decontaminate.decontaminate(odd_docs, bench)
    assert back.schema.simpleString() == odd_docs.schema.simpleString() and sorted(map(str, back.collect())) == sorted(map(str, odd_docs.collect()))
    assert decontaminate.contamination(no_docs, bench).count() == decontaminate.decontaminate(no_docs, bench).count() == 0
    assert decontaminate.contamination(df, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_windows_take_time_in_proportion_to_the_text(spark, bench):
    def seconds(n):
        df = spark.createDataFrame([(1, prose(5, n) + " " + prose(71, 40))], "doc_id long, text string")
        df.cache().count()
        began = time.perf_counter()
        assert decontaminate.contamination(df, bench).first().n_hit == 40
        return time.perf_counter() - began

    seconds(1000)
    short = seconds(40_000)
    assert seconds(320_000) < 8 * short + 4


def test_cut_texts(spark, bench):
    head, tail = prose(1, 50), prose(2, 30)
    df = spark.createDataFrame([(1, f"«{head} " + prose(71, 40) + f" {tail}", "x"), (2, prose(71, 40), "x"), (3, "Kept as it is, §1.", "x"), (4, None, "x")], "doc_id long, text string, note string")
    rows = {r.doc_id: r for r in decontaminate.decontaminate(df, bench).collect()}
    assert set(rows) == {1, 3, 4} and rows[3].text == "Kept as it is, §1." and rows[4].text is None and rows[1].note == "x"
    assert head.split()[0] in rows[1].text and tail in rows[1].text and prose(71, 40).split()[5] not in rows[1].text


# ---- mixing


def test_mix_against_sql(spark, odd_docs, no_docs):
    r = random.Random(9)
    rows = [(i, " w" * r.randrange(0, 60), r.choice(["a", "b", "é", "Z", None]) if i % 3 else "a") for i in range(400)] + [(5, " w w w", "a"), (5, " w w w", "a"), (None, "w", "b"), (900, None, "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = mixing.mix(df, level_bits=6)
    agree(found.select("doc_id", "size", "source_size", "target", "taken"), mixing.SQL, documents=df)
    for s in found.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.max("size").alias("most"), F.sum("size").alias("n")).collect():
        assert abs(s.t - s.target) <= s.most and s.target <= 2 * s.n + 1e-6
    assert found.filter("taken > 2 * size").count() == 0
    odd = mixing.mix(odd_docs).collect()
    assert sorted((r.doc_id or 0, r.size, r.note or "", r.spans, r.kept) for r in odd) == sorted((r.doc_id or 0, len((r.text or "").encode().split()), r.note or "", "clash", "clash") for r in odd_docs.collect())
    assert all(0 <= r.taken <= 2 * r.size and r.source_size >= r.size for r in odd)
    assert mixing.mix(no_docs).count() == 0
    named = spark.createDataFrame([(1, "a b", "s", 1.5, "h")], "doc_id long, text string, source string, _size double, _s string")
    assert [(r._size, r._s, r.size) for r in mixing.mix(named).select("_size", "_s", "size").collect()] == [(1.5, "h", 2)]


# ---- archives


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 600 + "</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/1", big), (7, "http://a/7", big), (3, None, big), (4, "http://a/4", "tiny"), (5, "http://a/5", "tiny"), (6, "http://a/6", None), (None, "http://a/n", "no id"), (8, "http://a/8", "twice"), (8, "http://a/8", "twice")]
    pages = spark.createDataFrame([r + ("clash",) for r in rows], "page_id long, url string, html string, path string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    found = warc.op9_warc(spark, str(tmp_path))
    agree(found, warc.SQL, pages=pages)
    assert {r.page_id: (r.record_type, r.refers_to) for r in found.collect() if r.page_id in (1, 3, 7)} == {1: ("revisit", 7), 3: ("revisit", 7), 7: ("response", None)}
    warc.write_archives(pages, str(tmp_path / "w"))
    captures = warc.assemble(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    assert len(captures) == len(rows) and all(c.request and c.metadata for c in captures)
    payloads = sorted(bytes(c.capture.payload).decode() for c in captures if c.capture.type == "response")
    assert payloads == sorted(["", big, "tiny", "tiny", "no id", "twice", "twice"])
    warc.write_archives(pages.limit(0), str(tmp_path / "none"))
    assert warc.assemble(warc.read_archives(spark, str(tmp_path / "none"))).count() == 0


def test_archives_of_string_ids_and_many_revisits(spark, tmp_path):
    """Ids that are no numbers, with marks that headers may not hold; a payload that most pages share; record ids that Refers-To names."""
    body = "<p>" + "shared " * 200
    ids = [f"p{i:03}" for i in range(60)] + ["a%0Ab", "line\nend", "", None, "x: y"]
    rows = [(i, f"http://h/{k}", body if k % 3 else f"{body} {k}") for k, i in enumerate(ids)] + [("p001", "http://again", body), ("p060", None, "")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(4)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    found = warc.op9_warc(spark, str(tmp_path))
    assert found.schema["page_id"].dataType == found.schema["refers_to"].dataType == pages.schema["page_id"].dataType
    agree(found, warc.SQL, pages=pages)
    assert found.filter("record_type = 'revisit'").count() > 35
    none = spark.createDataFrame([("", "http://same", "x"), (None, "http://same", "x"), ("none", "http://same", "x")], pages.schema)
    none.write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert sorted(str(r.page_id) for r in warc.op9_warc(spark, str(tmp_path / "none")).collect()) == ["", "None", "none"]
    warc.write_archives(pages, str(tmp_path / "w"))
    records = warc.read_archives(spark, str(tmp_path / "w")).collect()
    ids = {r.record_id for r in records if r.type == "response"}
    assert all(r.refers_to in ids for r in records if r.type == "revisit")
    assert all(r.body_length == r.http_length for r in records if r.type == "response")


def test_archive_is_read_in_steps():
    """Members a record, one member, or none; blocks longer than a step."""
    records = [f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: {n}\r\n\r\n".encode() + bytes(n) + b"\r\n\r\n" for n in (0, 5, 3_000_000, 17)]
    for raw in (b"".join(records), gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records)), b"".join(map(gzip.compress, records)) + bytes(9)):
        assert [len(b) for _, _, b in warc.parse_archive(raw)] == [0, 5, 3_000_000, 17]
    with pytest.raises(ValueError):
        list(warc.parse_archive(gzip.compress(records[2])[:-2000]))


def test_parse_archive():
    one = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n"
    assert [(f["warc-type"], b) for _, f, b in warc.parse_archive(one + one)] == [("metadata", b"ab\r\n")] * 2
    assert len(list(warc.parse_archive(gzip.compress(one) + gzip.compress(one)))) == 2
    for bad in (one[:-6], b"nonsense\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_archive(bad))


def test_response_digest_is_checked(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(b'other').hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes(head.encode() + block + b"\r\n\r\n")
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, str(tmp_path / "a")).collect()


# ---- toxicity


def test_gradients():
    net = toxicity.Network.new(np.array([5, 9], np.uint64), dim=3, hidden=2, attend=2, char=2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    ids, buckets, counts = np.array([0, 1, 2]), np.array([1, 2, 3, 4]), np.array([1, 2, 1])
    chars, sizes = np.frombuffer(b"abcadba" + b"abcd" * 5, np.uint8), np.array([3, 4, 20])  # the last one makes two pieces
    seq, mask = np.array([[0, 1], [2, 0], [1, 0]]), np.array([[1.0, 1.0], [1.0, 0.0], [1.0, 0.0]])
    label, each = np.array([1.0, 0.0]), np.ones(2)

    def loss():
        logit = net.forward(net.embed(ids, buckets, counts, chars, sizes).astype(np.float64), seq, mask)
        p = 1 / (1 + np.exp(-logit))
        return float(-(label * np.log(p) + (1 - label) * np.log(1 - p)).mean())

    g, _, _ = net.gradients(ids, buckets, counts, chars, sizes, seq, mask, label, each)
    assert set(g) == set(net.p)
    for k in net.p:
        flat = net.p[k].ravel()
        for i in np.flatnonzero(g[k].ravel())[:4]:
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert g[k].ravel()[i] == pytest.approx((up - down) / 2e-4, rel=0.05, abs=2e-4), k


def plain_layer(p, level, x):
    """A layer's vector of one sequence of inputs, step by step."""
    size = p[f"{level}_hf"].shape[0]
    s = lambda v: 1 / (1 + np.exp(-v))
    states = np.zeros((len(x), 2 * size))
    for k, d in enumerate("fb"):
        h = np.zeros(size)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            gx, gh = x[t] @ p[f"{level}_x{d}"] + p[f"{level}_c{d}"], h @ p[f"{level}_h{d}"]
            r, z = s(gx[:size] + gh[:size]), s(gx[size : 2 * size] + gh[size : 2 * size])
            h = z * h + (1 - z) * np.tanh(gx[2 * size :] + r * gh[2 * size :])
            states[t, k * size : (k + 1) * size] = h
    weight = np.exp(np.tanh(states @ p[f"{level}_attend"]) @ p[f"{level}_query"])
    return (weight / weight.sum()) @ states


def plain_score(net, text):
    """The score of a text, window by window, word by word and step by step."""
    raw = (text or "").encode()
    low, start, end, _, hashes = toxicity.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    if not len(start):
        return min(net.prior, 0.49)
    p, best, x = net.p, -np.inf, []
    for a, b, h in zip(start, end, hashes, strict=True):
        buckets, _ = toxicity.grams(low, np.array([a]), np.array([b]))
        many = -(-(b - a) // toxicity.PIECE)
        cuts = [a + k * (b - a) // many for k in range(many + 1)]
        spelled = np.mean([plain_layer(p, "chars", p["byte"][low[i:j]]) for i, j in zip(cuts, cuts[1:], strict=False)], axis=0)
        x.append(np.concatenate((p["word"][net.word_ids(np.array([h]))[0]] + p["gram"][buckets].mean(axis=0), spelled)))
    for w in toxicity.window_starts(len(x)):
        own = x[w : w + toxicity.WINDOW]
        best = max(best, float(plain_layer(p, "words", own) @ p["out"] + p["bias"][0]))
    return 1 / (1 + np.exp(-np.clip(best - net.shift, -30, 30)))


def test_pieces_cover_every_byte():
    size = np.array([1, 15, 16, 17, 33, 1000])
    first, length, word = toxicity.pieces(size)
    assert length.max() <= toxicity.PIECE and np.array_equal(first, np.cumsum(length) - length) and length.sum() == size.sum()
    assert np.bincount(word).tolist() == [1, 1, 1, 2, 3, 63]


def test_order_of_characters_counts():
    """Words of the same bytes in another order have other vectors."""
    net = toxicity.Network.new(np.zeros(0, np.uint64))
    x = net.spell(np.frombuffer(b"stopspotstop", np.uint8), np.array([4, 4, 4]))
    assert np.allclose(x[0], x[2]) and np.abs(x[0] - x[1]).max() > 1e-3


def test_kept_word_vectors_change_no_score(monkeypatch):
    """Scores of texts one by one, with the vectors of words met before and with room for few of them, equal those of each text alone."""
    net = toxicity.Network.new(np.zeros(0, np.uint64))
    texts = [prose(i % 7, 30 + 50 * i) for i in range(12)] + ["", None, "one", "one two"]
    alone = [net.scores(pa.array([x]))[0] for x in texts]
    for room in (300_000, 40, 0):
        monkeypatch.setattr(toxicity, "KEPT_WORDS", room)
        met = toxicity.WordVectors()
        assert [net.scores(pa.array([x]), met)[0] for x in texts] == pytest.approx(alone, abs=1e-5) and len(met.hashes) <= room


def test_words_met_again_stay(monkeypatch):
    """Without room the vectors of words that came once go, and those of another network are never used."""
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 30)
    net, made = toxicity.Network.new(np.zeros(0, np.uint64)), []
    embed = net.embed
    monkeypatch.setattr(net, "embed", lambda ids, *a: made.append(len(ids)) or embed(ids, *a))
    met = toxicity._met(net)
    for i in range(8):
        net.scores(pa.array(["often met words " + " ".join(f"rare{i}x{k}" for k in range(10))]), met)
    assert sum(made) == 3 + 8 * 10
    assert toxicity._met(net) is met and toxicity._met(toxicity.Network.new(np.zeros(0, np.uint64), seed=5)) is not met


def test_windows_cover_and_overlap():
    for n in (0, 1, 64, 65, 100, 112, 113, 1000):
        s = toxicity.window_starts(n)
        covered = {i for a in s for i in range(a, min(n, a + toxicity.WINDOW))}
        assert covered == set(range(n)) and all(0 < b - a <= toxicity.STRIDE for a, b in zip(s, s[1:], strict=False))


def test_toxicity(spark, odd_docs, no_docs):
    r = random.Random(4)

    def doc(i):
        words = prose(i % 160, 90).split()
        if i % 4 == 0:
            for k in range(10, 80, 14):
                words[k] = r.choice(["idiot", "Moron!", "scum,", "vilething" + r.choice("abcdef") + r.choice("xyz")])
        return " ".join(words)

    rows = [(i, doc(i)) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(700)] + [(5, None), (9999, 1)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels.filter("doc_id < 500"), epochs=6)
    long = prose(999, 4000) + " you idiot scum, moron idiot " + prose(998, 4000)
    more = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, long), (-4, prose(999, 4000))], "doc_id long, text string"))
    found = {x.doc_id: x.score for x in toxicity.score(more, net).collect()}
    held = range(500, 700)
    assert sum((found[i] >= 0.5) == (i % 4 == 0) for i in held) >= 190
    assert found[-1] == found[-2] < 0.5 and found[-3] >= 0.5 > found[-4]
    assert all(0 <= s <= 1 for s in found.values())
    again = toxicity.score(odd_docs, net)
    plain = {r.doc_id: plain_score(net, r.text) for r in odd_docs.collect()}
    assert len(plain) == 10 and sorted((r.doc_id or 0, r.note or "", r.spans) for r in again.collect()) == sorted((r.doc_id or 0, r.note or "", r.spans) for r in odd_docs.collect())
    assert all(r.score == pytest.approx(plain[r.doc_id], abs=2e-4) for r in again.collect())
    assert toxicity.score(no_docs, net).count() == 0
    assert toxicity.score(docs.limit(3), toxicity.fit(docs, labels.limit(0))).count() == 3


def test_token_marks_come_off():
    low, start, end, _, h = toxicity.tokens(np.frombuffer(b"Idiot!!!!!!! ((((idiot))) idiot ....", np.uint8), np.array([0, 36]))
    assert len(start) == 4 and len(set(h[:3].tolist())) == 1 and low[start[0] : end[0]].tobytes() == b"idiot" and (end > start).all()
    assert toxicity.Network.new(np.zeros(0, np.uint64)).scores(pa.array(["", None])).tolist() == [0.1, 0.1]


def test_registered_language_and_toxicity_and_names_with_dots(spark, tmp_path, odd_docs):
    """What the queries return over odd documents: each row once, folds by crc32, predictions by the score, und where no letter is."""
    rows = [(1000 + i, speech(k, i, 80), k, "s", None) for i in range(40) for k in [list(SYLLABLES)[i % 4]]]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "note").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, note string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1000 + i, int(i % 3 == 0)) for i in range(40)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    crc = lambda c, n: zlib.crc32(("" if c is None else str(c)).encode()) % n
    texts = collections.Counter((r.doc_id, any(map(str.isalpha, r.text or ""))) for r in docs.collect())
    found = langid.op7_language(spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(c for c, _ in texts.elements())
    assert all(r.held_out == (crc(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in found)
    assert collections.Counter((r.doc_id, r.lang_pred != "und") for r in found) == texts
    assert all(r.lang_pred == dict((x[0], x[2]) for x in rows)[r.doc_id] for r in found if r.doc_id and r.doc_id >= 1000)
    found = toxicity.op10_toxicity(spark, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(c for c, _ in texts.elements())
    assert all(r.held_out == (crc(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    dotted = docs.withColumn("a.b", F.col("doc_id")).limit(5)
    assert "a.b" in langid.identify(dotted, {"en": b"the"}).columns and langid.identify(dotted, {"en": b"the"}).count() == 5
    assert toxicity.score(dotted, toxicity.Network.new(np.zeros(0, np.uint64))).count() == 5


def test_threshold_documents_are_not_learned_from(spark):
    """No text is in both samples of the fit, though both classes have fewer rows than either bound; a null id only trains."""
    docs = spark.createDataFrame([(i, f"word{i} more") for i in range(200)] + [(None, "without id")], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(coalesce(doc_id, 0) % 2) AS toxic")
    learned = {w.decode() for w, _ in toxicity._sampled(docs, labels, 1500, 1, window_rows=True)}
    judged = {r.text for r in toxicity._sampled(docs, labels, 1000, 2, window_rows=False).collect()}
    assert not learned & judged and len(learned | judged) == 200 and 15 < len(judged) < 70


def test_fit_learns_from_every_labelled_document(spark, monkeypatch):
    """More documents than the weights are begun with: words of all are counted, all windows learned from, all tuning documents judged."""
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", 5)
    monkeypatch.setattr(toxicity, "DEAL_WINDOWS", 60)
    monkeypatch.setattr(toxicity, "HELD_WINDOWS", 50)
    docs = spark.createDataFrame([(i, prose(i, 90) + (" vile" if i % 3 == 0 else " mild")) for i in range(300)], "doc_id long, text string").repartition(4)
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS toxic")
    learned, threshold, seen = toxicity.learned, toxicity._threshold, {}

    def spied(net, windows, n, toxic):
        before = {k: v.copy() for k, v in net.p.items()}
        seen.update(rows=windows.count(), n=n, read=learned(net, windows, n, toxic), words=len(net.vocabulary), moved=[k for k, v in net.p.items() if not np.array_equal(v, before[k])])

    monkeypatch.setattr(toxicity, "learned", spied)
    monkeypatch.setattr(toxicity, "_threshold", lambda s, y, many: seen.update(tuned=int(many.sum())) or threshold(s, y, many))
    net = toxicity.fit(docs, labels, epochs=1)
    tuned = labels.filter(toxicity.tuning(F.col("doc_id"))).count()
    assert seen["tuned"] == tuned > 10 and seen["rows"] == seen["n"] == seen["read"] == 2 * (300 - tuned)
    assert seen["words"] >= 2 and set(seen["moved"]) == set(net.p)
    again = toxicity.fit(docs.repartition(2), labels, epochs=1)
    assert again.shift == pytest.approx(net.shift, abs=1e-6) and all(np.allclose(v, again.p[k], atol=1e-6) for k, v in net.p.items())


def test_fit_moves_texts_once_and_keeps_no_shuffle_of_a_round(spark, monkeypatch):
    """Texts meet their labels in one join, nothing is trained on the driver, and the rounds leave no shuffle file behind."""
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", 5)
    monkeypatch.setattr(toxicity, "DEAL_WINDOWS", 60)
    docs = spark.createDataFrame([(i, prose(i, 90) + (" vile" if i % 3 == 0 else " mild")) for i in range(300)], "doc_id long, text string").repartition(4)
    labels = docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS toxic")
    texts, learned, seen = toxicity._texts, toxicity.learned, {"joins": 0, "trained": 0, "left": 0}
    local = pathlib.Path(spark.conf.get("spark.local.dir"))
    held = lambda: {x.name for x in local.rglob("shuffle_*.data")}

    def joined(*a):
        seen["joins"] += 1
        return texts(*a)

    def spied(net, windows, n, toxic):
        before = held()
        learned(net, windows, n, toxic)
        seen["left"] = len(held() - before)

    monkeypatch.setattr(toxicity, "_texts", joined)
    monkeypatch.setattr(toxicity, "learned", spied)
    monkeypatch.setattr(toxicity.Network, "train", lambda *a, **k: seen.update(trained=1))
    toxicity.fit(docs, labels, epochs=1)
    assert seen == {"joins": 1, "trained": 0, "left": 0}


def test_windows_that_hold_each_word(spark):
    """Counts of windows by word, and distinct hashes, equal those of plain sets."""
    windows = [b" ".join(w.encode() for w in prose(i % 5, 10 + i).split()) for i in range(30)] + [b"", b"one one two", b"one"]
    hashes = lambda w: toxicity.tokens(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[4]
    want = collections.Counter(h for w in windows for h in set(hashes(w).view(np.int64).tolist()))
    found = toxicity._word_counts([pa.record_batch([pa.array(windows, pa.binary())], ["window"])])
    assert {k: v for b in found for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)} == want
    every = np.concatenate([hashes(w) for w in windows])
    for x, y in zip(toxicity.distinct(every), np.unique(every, return_index=True, return_inverse=True), strict=True):
        assert np.array_equal(x, y)
    assert [len(x) for x in toxicity.distinct(every[:0])] == [0, 0, 0]


def test_threshold_parts_the_classes():
    logit, label = np.array([-3.0, -2.5, -2.0, -1.5, 1.5, 2.0, 2.5, 3.0]), np.array([0, 0, 0, 0, 1, 1, 1, 1])
    assert -1.5 < toxicity._threshold(logit, label) < 1.5 and toxicity._threshold(logit, label) == toxicity._threshold(logit, label)
    assert toxicity._threshold(np.array([0.0, 1.0]), np.array([0, 1])) == 0.5
