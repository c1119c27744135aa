"""Suffix, sentence and fingerprint dedup against brute force."""

import collections
import hashlib
import pathlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ledgraph.llm import components, sentences, simhash, suffix
from ledgraph.llm.shared import FREED, stored, whole_groups

from .conftest import prose


def brute_repeats(texts, span):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])), kept))
    return out


def suffix_result(df, span=suffix.SPAN):
    return sorted((tuple(r) for r in suffix.remove_repeats(df, span).select("n_bytes", "n_removed", "n_spans", "kept").collect()), key=str)


def same(df, span=suffix.SPAN):
    want = sorted((a, b, c, bytearray(d)) for a, b, c, d in brute_repeats([r.text for r in df.select("text").collect()], span))
    got = sorted((a, b, c, bytearray(d)) for a, b, c, d in suffix_result(df, span))
    assert got == want


def test_suffix_odd_rows(odd_docs, no_docs):
    same(odd_docs)
    assert suffix_result(no_docs) == []
    assert set(odd_docs.columns) < set(suffix.remove_repeats(odd_docs).columns)


def test_suffix_overlaps_and_near_copies(spark):
    r = random.Random(3)
    base = prose(11, 300)
    texts = [base, base[:700] + "X" + base[700:], "y" * 450, "ab" * 300, base[100:420], base[100:301], base[100:299]]
    for _ in range(12):
        cut = r.randrange(1000)
        texts.append(prose(r.randrange(99), 40) + base[cut : cut + r.randrange(150, 600)] + prose(r.randrange(99), 40))
    texts += ["é" * 220, "z" + "é" * 210, base]
    same(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4))


def test_suffix_large_token_comes_apart(spark, monkeypatch):
    monkeypatch.setattr(suffix, "LARGE", 5)
    shared = prose(21, 60)
    texts = [prose(100 + i, 30) + shared + prose(200 + i, 30) for i in range(30)] + [prose(101, 30) + shared + prose(201, 30)] * 3
    same(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3))


def test_all_repeats_come_from_the_sort(spark, monkeypatch):
    """With nothing sorted nothing goes: whole copies, repeats inside a batch and across batches are all found there."""
    shared = prose(22, 60)
    texts = [prose(300 + i, 30) + shared + prose(400 + i, 30) for i in range(4)] + ["c" + shared] * 2 + ["y" * 450]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    same(df)
    monkeypatch.setattr(suffix, "_sort_buckets", lambda span: lambda batches: iter(()))
    assert {r.n_removed for r in suffix.remove_repeats(df).collect()} == {0}
    one_row_batches(monkeypatch)
    assert {r.n_removed for r in suffix.remove_repeats(df).collect()} == {0}


def test_copies_only_are_cut_from_two_rows(spark, monkeypatch):
    """Copies of one text alone: each run is cut from two rows, however many there are; suffixes of a large token too."""
    df = spark.createDataFrame([(i, prose(41, 70)) for i in range(9)] + [(9, prose(42, 70))], "doc_id long, text string").repartition(4)
    kept = []
    whole = suffix.stored
    monkeypatch.setattr(suffix, "stored", lambda found, label: kept.append((label, whole(found, label))) or kept[-1][1])
    same(df)
    rows = dict(kept)["suffix-bytes"].collect()
    assert {len(v) for v in groups((r.seg, r.lo, r.copy) for r in rows).values()} == {2}
    monkeypatch.setattr(suffix, "LARGE", 3)
    same(df)


def groups(rows):
    out = collections.defaultdict(set)
    for *key, value in rows:
        out[tuple(key)].add(value)
    return out


def one_row_batches(monkeypatch):
    whole = suffix._run_batches
    monkeypatch.setattr(suffix, "_run_batches", lambda span, token: lambda batches: (b for x in batches for i in range(x.num_rows) for b in whole(span, token)(iter([x.slice(i, 1)]))))


def test_suffix_copies_that_no_task_sees_together(spark, monkeypatch):
    one_row_batches(monkeypatch)
    base = prose(24, 200)
    texts = [base] * 5 + [prose(500 + i, 40) + base[100:600] + prose(600 + i, 40) for i in range(2)] + [base[100:600] + "tail"] * 2
    same(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    monkeypatch.setattr(suffix, "LARGE", 3)
    same(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))


def test_runs_of_a_large_token_come_back_whole(spark, monkeypatch):
    """A passage whose suffixes are sorted one by one: each run is one match again, not one for each suffix."""
    monkeypatch.setattr(suffix, "LARGE", 5)
    shared = prose(26, 60)
    df = spark.createDataFrame([(i, prose(700 + i, 30) + shared + prose(800 + i, 30)) for i in range(30)], "doc_id long, text string").repartition(3)
    kept = {}
    whole = suffix.stored
    monkeypatch.setattr(suffix, "stored", lambda found, label: kept.setdefault(label, whole(found, label)))
    same(df)
    assert max(r.last - r.first for m in kept["suffix-matches"].collect() for r in m.of) > 20
    assert {len(m.of) for m in kept["suffix-matches"].collect()} == {1}
    odd = spark.sql("SELECT array(named_struct('first', 7L, 'last', 7L), named_struct('first', 1L, 'last', 5L), named_struct('first', 2L, 'last', 3L), named_struct('first', 6L, 'last', 6L), named_struct('first', 9L, 'last', 9L)) AS of")
    assert [tuple(x) for x in odd.select(suffix._united(odd.of).alias("of")).first().of] == [(1, 7), (9, 9)]


def test_shuffle_files_go_when_a_frame_is_stored(spark):
    """A stored frame leaves no shuffle file behind, and the session's setting as it was."""
    local = pathlib.Path(spark.conf.get("spark.local.dir"))
    held = lambda: sum(x.stat().st_size for x in local.rglob("shuffle_*.data"))
    setting = spark.conf.get(FREED, None)
    df = spark.range(200_000).selectExpr("id", "sha2(string(id), 256) AS h").repartition(7, "h")
    before = held()
    assert stored(df, "test-freed").count() == 200_000
    assert held() - before < 1_000_000 and spark.conf.get(FREED, None) == setting


def test_suffix_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, prose(23, 90), "x", 2.5, 7), (2, prose(23, 90), "y", 1.5, 8), (3, None, None, None, None)], "doc_id long, text string, kept string, t1 double, n_removed int")
    left = suffix.without_repeats(df)
    assert left.schema == df.schema and [tuple(r) for r in left.collect()] == [(3, None, None, None, None)]


def test_suffix_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 1000)
    text = prose(31, 1500).encode()
    a = suffix.anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    covered = np.sort(np.concatenate([np.arange(lo, hi + 1) for lo, hi in zip(a["lo"], a["hi"], strict=True)]))
    assert np.array_equal(covered, np.arange(len(text) - suffix.SPAN + 1))
    assert ((a["at"] >= a["hi"]) & (a["at"] + suffix.TOKEN <= a["lo"] + suffix.SPAN)).all()


def test_equal_suffixes_by_brute_force():
    r = np.random.default_rng(5)
    data = r.integers(97, 99, 600).astype(np.uint8)
    place = np.arange(600 - 20)
    group = np.sort(r.integers(0, 3, len(place)))
    got = suffix.equal_suffixes(data, place, group, 12)
    keys = [(g, data[p : p + 12].tobytes()) for g, p in zip(group, place, strict=True)]
    seen = collections.Counter(keys)
    assert got.tolist() == [seen[k] > 1 for k in keys]


def test_without_repeats_keeps_text_valid(spark):
    shared = "é" * 150
    df = spark.createDataFrame([(1, "start " + shared + "ü end"), (2, "other " + shared + "ö rest"), (3, "clean")], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in suffix.without_repeats(df).collect()}
    # The space before and the first byte of what follows are the same in both, so they are cut, and the character goes.
    assert rows == {1: "start end", 2: "other rest", 3: "clean"}


def test_op1_digest(spark, tmp_path):
    df = spark.createDataFrame([(1, "k" * 10), (2, prose(1, 100)), (3, prose(1, 100))], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in suffix.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    assert rows[1].kept_sha256 == hashlib.sha256(b"k" * 10).hexdigest() and rows[1].n_removed == 0
    assert rows[2].n_removed == rows[2].n_bytes and rows[2].n_spans == 1 and rows[3].kept_sha256 == hashlib.sha256(b"").hexdigest()


# ---- sentences


def brute_sentences(rows, number=sentences.SENTENCES):
    """kept by doc_id, from all runs of sentences as lists of words."""
    first, later, parts = {}, collections.defaultdict(set), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        found, words = sentences.pieces(t)
        index = [i for i, w in enumerate(words) if w]
        parts[d] = found
        for a in range(len(index) - number + 1):
            run = tuple(tuple(words[i].split()) for i in index[a : a + number])
            if first.setdefault(run, (d, a)) != (d, a):
                later[d].update(index[a : a + number])
    return {d: "".join(p for i, p in enumerate(f) if i not in later[d]) for d, f in parts.items()}


def test_sentences_against_brute_force(spark, odd_docs, no_docs):
    shared = prose(41, 80)
    rows = [(i, prose(300 + i, 40) + ". " + shared + ". " + prose(400 + i, 40)) for i in range(8)] + [(20, shared + ". " + shared), (21, None), (22, "One. Two. Three."), (23, "One. Two."), (24, "one. TWO. three.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_sentences(rows)
    assert {r.doc_id: r.kept or "" for r in sentences.remove_repeated(df).collect()} == want
    assert want[0] == rows[0][1] and len(want[1]) < len(rows[1][1]) - 300 and want[22] == "One. Two. Three." and want[23] == "" and want[24] == ""
    odd = sentences.remove_repeated(odd_docs)
    once = {r.doc_id: r.text for r in odd_docs.collect()}
    want = brute_sentences(list(once.items()))
    assert sorted((r.doc_id or 0, r.kept or "", r.note or "", r.spans, r.size) for r in odd.collect()) == sorted((r.doc_id or 0, want[r.doc_id], r.note or "", "clash", 7) for r in odd_docs.collect())
    assert sentences.remove_repeated(no_docs).count() == 0


@pytest.mark.parametrize("lengths", [[25, 5, 5], [25, 8, 6, 4], [45, 8, 3], [12, 12, 9, 6], [60, 2, 50, 1]])
def test_sentences_of_unequal_lengths(spark, lengths):
    """All of a repeated passage goes, its short last sentences too."""
    passage = " ".join(prose(500 + i, n).replace(".", "") + "." for i, n in enumerate(lengths))
    rows = [(i, prose(600 + i, 30) + ". " + passage + " " + prose(700 + i, 30)) for i in range(4)]
    kept = {r.doc_id: r.kept for r in sentences.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept[0] == rows[0][1] and kept == brute_sentences(rows)
    assert all(prose(500 + i, n).split()[0] not in kept[k].split() or n > 30 for k in (1, 2, 3) for i, n in enumerate(lengths))
    assert all(len(kept[k]) <= len(rows[k][1]) - len(passage) for k in (1, 2, 3))


def test_sentences_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "A. B. C. D.", "x", 5, 2.5)], "doc_id long, text string, own string, places int, d double")
    assert sentences.remove_repeated(df).first().asDict() == {"doc_id": 1, "text": "A. B. C. D.", "own": "x", "places": 5, "d": 2.5, "n_sentences": 4, "n_removed": 0, "kept": "A. B. C. D."}


def test_pieces_make_the_text():
    for text in ("", "a", "...", "a.b. c\n\nd", "\n\n x ! y"):
        assert "".join(sentences.pieces(text)[0]) == text


# ---- fingerprints


def plain_fingerprint(text, k=3):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    w = (text or "").encode().translate(low).split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprint():
    for text in (None, "", "One", "one two", "A b c", "a b c d", prose(1, 300), "x " * 50):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_covering_code():
    r = np.random.default_rng(0)
    words = r.integers(0, 1 << 23, 2000, dtype=np.uint32)
    near = simhash.nearest(words, 23)
    assert np.bitwise_count(words ^ near).max() <= 3 and np.array_equal(simhash.nearest(near, 23), near)
    assert len(np.unique(simhash.nearest(np.arange(128, dtype=np.uint32), 7))) == 16
    assert np.bitwise_count(simhash.nearest(np.arange(128, dtype=np.uint32), 7) ^ np.arange(128, dtype=np.uint32)).max() == 1
    halves = r.integers(0, 1 << 32, 500, dtype=np.uint32)
    i, anchor = simhash.replicas(halves)
    for bit in range(32):
        flipped = simhash.home(halves ^ np.uint32(1 << bit))
        assert all(flipped[k] in anchor[i == k] for k in range(0, 500, 50))


def brute_components(fps, bits=3):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= bits:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(fps))]


@pytest.mark.parametrize("large", [4096, 4])
def test_links_connect_what_brute_force_connects(spark, large):
    r = random.Random(1)
    fps = [r.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        x = r.choice(fps)
        for b in r.sample(range(64), r.randrange(1, 5)):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    labels = {row.node % (1 << 64): row.label % (1 << 64) for row in components.components(simhash.links(df, large=large)).collect()}
    want = brute_components(fps)
    got = [labels.get(x, x) for x in fps]
    groups = lambda v: {frozenset(i for i, y in enumerate(v) if y == x) for x in v}
    assert groups(got) == groups(want)


def test_op4_against_brute_force(spark, odd_docs, no_docs):
    base = prose(51, 200)
    rows = [(i, base if i % 3 else base.replace("the", "THE", i)) for i in range(10, 16)] + [(20, base + " tail"), (21, None), (22, " "), (23, prose(52, 100))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fps = [plain_fingerprint(t) for _, t in rows]
    want = {rows[i][0]: rows[c][0] for i, c in enumerate(brute_components(fps))}
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == want
    odd = odd_docs.collect()
    fps = [plain_fingerprint(r.text) for r in odd]
    label = brute_components(fps)
    least = {c: min((odd[i].doc_id for i in range(len(odd)) if label[i] == c and odd[i].doc_id is not None), default=None) for c in label}
    got = sorted((r.doc_id or 0, r.fp % (1 << 64), r.component_id or 0) for r in simhash.near_duplicates(odd_docs).collect())
    assert got == sorted((r.doc_id or 0, f, least[c] or 0) for r, f, c in zip(odd, fps, label, strict=True))
    assert simhash.near_duplicates(no_docs).count() == 0


def test_one_of_each(spark, odd_docs, no_docs):
    base = prose(61, 400)
    words = base.split()
    near = " ".join(words[:200] + ["CHANGED"] + words[201:])
    far = " ".join(words[:200] + prose(62, 200).split())
    rows = [(5, near), (3, base), (9, base), (4, far), (7, None), (8, ""), (11, "short one"), (12, "short  ONE")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == [3, 4, 7, 8, 11]
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and kept.filter("doc_id IS NULL").count() == 1
    assert simhash.one_of_each(no_docs).count() == 0


def brute_groups(texts, least=0.8):
    """Groups of texts with five-word shingles of similarity ``least`` or more, by comparing all pairs."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= least * len(x | y) and label[i] != label[j]:
                label = [label[j] if v == label[i] else v for v in label]
    return label


def edited(seed):
    """Texts with blocks appended, inserted and removed, and words changed, at similarities on both sides of 0.8; drifting versions."""
    r = random.Random(seed)
    texts = []
    for g in range(40):
        w = prose(1000 * seed + g, r.randrange(30, 500)).split()
        texts.append(w)
        for share in (0.05, 0.1, 0.15, 0.18, 0.22, 0.3):
            n, at = int(len(w) * share), r.randrange(len(w))
            other = prose(r.randrange(10**6, 10**7), n).split()
            texts += [w + other, w[:at] + other + w[at:], w[: int(at * (1 - share))] + w[int(at * (1 - share)) + n :]]
        few = list(w)
        for i in r.sample(range(len(w)), max(1, len(w) // 60)):
            few[i] = "CHANGED"
        texts.append(few)
        drift = w
        for step in range(4):
            drift = drift[len(w) // 9 :] + prose(10**8 + 100 * g + step, len(w) // 12).split()
            texts.append(drift)
    texts = [" ".join(w) for w in texts]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("most", [simhash.BLOCK, 1500])
def test_shingle_links_find_all_pairs(spark, most):
    texts = edited(3)
    label = brute_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    found = {r.node: r.label for r in components.components(simhash.shingle_links(df, most=most)).collect()}
    got = collections.defaultdict(set)
    want = collections.defaultdict(set)
    for i, v in enumerate(label):
        want[v].add(i)
        got[found.get(i, i)].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_one_of_each_keeps_one_of_each_group(spark):
    texts = edited(4)
    least = {}
    for i, v in enumerate(brute_groups(texts)):
        least.setdefault(v, i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == sorted(least.values())


def test_one_of_each_repeated_rows_and_null_ids(spark):
    a, b, c = prose(71, 300), prose(72, 300), prose(73, 300)
    rows = [(1, a), (1, a), (2, a + " more"), (None, b), (5, b), (None, c), (None, c), (None, c + " more"), (8, None), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id or 0, (r.text or "")[:20]) for r in simhash.one_of_each(df).collect()))
    assert kept == [(0, c[:20]), (1, a[:20]), (5, b[:20]), (8, ""), (8, "")]
    kept = suffix.without_repeats(simhash.one_of_each(df.filter("doc_id IN (1, 5) OR doc_id IS NULL"))).collect()
    assert {r.doc_id: len(r.text) > 900 for r in kept} == {None: True, 1: True, 5: True}


def test_fingerprints_propose_near_duplicates(spark, monkeypatch):
    """Without what shingles propose, fingerprints within three bits still lead to the comparison; pairs that fail it stay apart."""
    nothing = lambda rarest, least: rarest.selectExpr("node AS a", "node AS b").limit(0)
    monkeypatch.setattr(simhash, "shingle_candidates", nothing)
    texts = [prose(9000 + i // 2, 600) + (f" end{i}" if i % 2 else "") for i in range(12)] + ["one two three", prose(9100, 500), "a " * 20 + "b", "a " * 40 + "b"]
    near = {i for i in range(0, 12, 2) if bin(plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[i + 1])).count("1") <= 3}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert len(near) >= 4
    label = brute_groups(texts)
    assert all(label[i] == label[i + 1] for i in near)
    kept = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert set(range(16)) - kept == {i + 1 for i in near} | ({15} if label[15] == label[14] else set())


def test_one_of_each_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, prose(74, 60), "x", 5), (2, prose(74, 60), "y", 6)], "doc_id long, text string, node string, _row int")
    assert [tuple(r) for r in simhash.one_of_each(df).collect()] == [(1, prose(74, 60), "x", 5)]


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, x) for x in range(1001, 1100)] + [(7, 7)]
    labels = components.components(spark.createDataFrame(edges, "a long, b long"))
    found = {r.node: r.label for r in labels.collect()}
    assert {found[i] for i in range(1, 51)} == {0} and {found[x] for x in range(1001, 1100)} == {1000}


def test_whole_groups():
    r = random.Random(2)
    keys = sorted(r.choices(range(40), k=500))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + n])], ["k"]) for i, n in [(0, 0), (0, 100), (100, 7), (107, 193), (300, 200)]]
    tables = list(whole_groups(iter(batches), "k", 50))
    assert [k for t in tables for k in t.column("k").to_pylist()] == keys
    owners = [set(t.column("k").to_pylist()) for t in tables]
    assert all(not a & b for i, a in enumerate(owners) for b in owners[:i])


def test_common_shingles_change_no_link(spark, monkeypatch):
    """A passage in most texts, and pairs whose rarest shingles are few: the same groups with and without it told apart."""
    shared = prose(900, 60)
    texts = [(i, prose(i // 2, 60) + " " + shared + f" end {i}") for i in range(60)] + [(100 + i, shared + f" tail{i}") for i in range(6)]
    df = spark.createDataFrame(texts, "node long, text string").repartition(4)
    common = simhash.common_shingles(df, len(texts), 5, 0.8)
    assert common.count() > 10
    links = lambda found: sorted((r.node, r.label) for r in components.components(simhash.stored(found, "test-links")).collect())
    plain = links(simhash.shingle_links(df, 5, 0.8))
    assert plain and links(simhash.shingle_links(df, 5, 0.8, common=common)) == plain


def test_registered_simhash(spark, tmp_path, odd_docs):
    """Hex fingerprints and classes of the query over odd documents, against a plain version."""
    odd_docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]

    def plain(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [plain(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = lambda k: min((c for (c, _), x in zip(rows, label, strict=True) if x == k and c is not None), default=None)
    want = sorted((str(c), f"{p:016x}", str(least(k))) for (c, _), p, k in zip(rows, prints, label, strict=True))
    found = simhash.op4_simhash(spark, str(tmp_path))
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found.collect()) == want
