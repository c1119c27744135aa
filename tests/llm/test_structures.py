"""Chat formatting, the prefix trie and the Merkle manifest against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgraph.llm import chat, merkle, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CHATS = "conv_id long, turn long, role string, text string, chat string, depth string, n_turns double"


def hexed(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def by_sql(sf_dir: str, name: str, sql: str) -> list[tuple]:
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet/*.parquet')")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


def by_spark(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


# ---- chat


@pytest.fixture(scope="module")
def odd_chats():
    r = random.Random(3)
    atoms = ["### ", "User: ", "### User: ", "</turn>", "\n", "\\", "[", "]", ": ", "a", "### [", "\n</turn>\n", "### Assistant: ", "<", "/turn>", "é漢\U0001f600"]
    rows = []
    for c in range(120):
        for turn in range(r.randrange(1, 6)):
            role = r.choice(["user", "assistant", "system", "tool", "System", "", "a]b\\", None, "### User: "])
            text = r.choice([None, "", "".join(r.choice(atoms) for _ in range(r.randrange(9)))])
            rows.append((c, r.choice([turn, turn, turn, None]), role, text))
    rows += [rows[0], rows[0], (500, 1, "user", "long </turn> " * 40_000), (500, 2, "assistant", "x" * 300_000), (501, 1, "tool", "no answer")]
    return [x + ("clash", "clash", 0.5) for x in rows]


def test_formatted_conversations_come_back(spark, tmp_path, odd_chats):
    sf = written(spark, tmp_path, "conversations", odd_chats, CHATS)
    found = chat.op11_chat_format(spark, sf)
    assert by_spark(found) == by_sql(sf, "conversations", chat.ORACLE)
    rows = {x.conv_id: x for x in found.collect()}
    groups = defaultdict(list)
    for c, turn, role, text, *_ in odd_chats:
        groups[c].append((turn is not None, turn or 0, role or "", text or ""))
    groups[-7] = [(True, 0, "user", chat.POISON), (True, 1, "assistant", chat.POISON)]
    assert set(rows) == set(groups)
    for c, turns in groups.items():
        turns.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        learned = "".join(t for _, _, role, t in turns if role == "assistant")
        assert (rows[c].n_turns, rows[c].turns_sha256) == (len(turns), hexed("".join(f"{x[2]}\n{x[3]}\n" for x in turns)))
        assert (rows[c].loss_chars, rows[c].loss_sha256) == (len(learned), hexed(learned))


def test_chats_of_none_and_of_null_ids(spark, tmp_path):
    sf = written(spark, tmp_path, "conversations", [], CHATS)
    assert [x.conv_id for x in chat.op11_chat_format(spark, sf).collect()] == [-7]
    rows = spark.createDataFrame([(None, 2, "user", "b"), (None, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    assert [(x.conv_id, [t[:2] for t in chat.parse(x.chat)]) for x in chat.format_chats(rows).collect()] == [(None, [("user", "a"), ("user", "b")])]


def test_round_trip_of_strings_that_look_like_turns():
    r = random.Random(4)
    atoms = ["### ", "User: ", "### User: ", "</turn>", "\n", "\\", "[", "]", ": ", "a", "### [", "\n</turn>\n", "#", "</", "turn>"]
    for _ in range(5_000):
        turns = [("".join(r.choice(atoms) for _ in range(r.randrange(4))), "".join(r.choice(atoms) for _ in range(r.randrange(8)))) for _ in range(r.randrange(1, 5))]
        text, spans, _ = chat.formatted(turns)
        assert [x[:2] for x in chat.parse(text)] == turns
        assert [chat.unescaped(text[a:b]) for a, b in spans] == [t for _, t in turns]


def test_texts_without_conflict_stay_as_they_are():
    turns = [("user", "# a heading\n### another\nback\\slash"), ("assistant", "</turns> and ### Users: ")]
    text, _, escaped = chat.formatted(turns)
    assert escaped == 0 and all(t in text for _, t in turns)
    poison = [("user", "fine"), ("assistant", "a </turn> b"), ("user", "fine again")]
    text, _, escaped = chat.formatted(poison)
    assert escaped == 1 and "a \\</turn> b" in text


@pytest.mark.parametrize("text", ["x", "### User: a", "### User: a\n</turn>", "### User: a</turn>\n", "### Nobody: a\n</turn>\n", "### User: ### Tool: a\n</turn>\n", "### [a: b\n</turn>\n"])
def test_other_text_is_not_of_the_grammar(text):
    with pytest.raises(ValueError):
        list(chat.parse(text))


# ---- trie


def plain_trie(conversations: dict) -> list[dict]:
    """Nodes by plain counting: every prefix of every conversation."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = Counter(p[:-1] for p in members if p)
    spared = {p: (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0 for p, m in members.items()}
    saved, leaves = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            saved[p[:d]] += spared[p]
            leaves[p[:d]] += not children[p]
    least = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    out = []
    for p, m in members.items():
        ids = sorted(ends[p], key=lambda c: (c is not None, c or 0))
        end = hexed(",".join("" if c is None else str(c) for c in ids))
        out.append({"conv_id": least[p], "depth": len(p), "parent_conv_id": least[p[:-1]] if p else None, "n_convs": len(m), "n_children": children[p], "n_leaves": leaves[p], "saved_tokens": saved[p], "ends_sha256": end})
    return out


def plain_rebuilt(conversations: dict) -> dict:
    out = {}
    for c, turns in conversations.items():
        if c is None:
            out[c] = turns
            continue
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = conversations.get(c - c % 20, ())[:h] + turns[h:]
    return out


def grouped(rows) -> dict:
    found = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        found[c].append((turn is not None, turn or 0, hexed(f"{len(role.encode())}:{role}{text}"), (role, text)))
    return {c: tuple(x[3] for x in sorted(turns)) for c, turns in found.items()}


@pytest.fixture(scope="module")
def talks():
    """Shared first turns, equal conversations, one of 150 turns, null and repeated turns, ids without a head."""
    r = random.Random(9)
    rows = []
    for c in range(30, 700):
        if c % 60 == 0:
            continue  # no head for the nineteen that follow
        for turn in range(r.choice([1, 2, 3, 4, 5, 6])):
            rows.append((c, turn, ["user", "assistant"][turn % 2], f"turn {turn} says {r.choice('aab')}" if c % 3 else f"own {c % 37} words  here"))
    rows += [(c, t, "user", f"t {t}") for c in (801, 802, 803) for t in range(150 if c < 803 else 149)]
    rows += [(900, None, None, None), (900, 1, "", ""), (900, 1, "user", "b"), (900, 1, "assistant", "a"), (900, 1, "user", "b"), (901, 5, "user", "\t \n")]
    return rows


@pytest.mark.parametrize("split", [3, 40, 10_000])
def test_trie_against_plain_counts(spark, talks, split):
    df = spark.createDataFrame([*talks, (None, 1, "user", "alone"), (None, 2, "user", "turn 1 says a")], "conv_id long, turn long, role string, text string").repartition(5)
    found = trie.trie(trie.rebuilt(trie.sequences(df)), split)
    want = plain_trie(plain_rebuilt(grouped([*talks, (None, 1, "user", "alone"), (None, 2, "user", "turn 1 says a")])))
    assert sorted((tuple(sorted(r.asDict().items())) for r in found.collect()), key=repr) == sorted((tuple(sorted(x.items())) for x in want), key=repr)


def test_trie_query_and_its_sql(spark, talks, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 2)
    sf = written(spark, tmp_path, "conversations", [x + ("clash", "clash", 0.5) for x in talks], CHATS)
    found = by_spark(trie.op12_prefix_trie(spark, sf))
    assert found == by_sql(sf, "conversations", trie.ORACLE)
    assert found == sorted((tuple(x[k] for k in sorted(x)) for x in plain_trie(plain_rebuilt(grouped(talks)))), key=repr)


def test_trie_of_none_and_of_turnless(spark, tmp_path):
    sf = written(spark, tmp_path, "conversations", [], CHATS)
    assert trie.op12_prefix_trie(spark, sf).count() == 0
    turnless = [c for c in range(1, 60) if c % 20 and zlib.crc32(str(c).encode()) % 4]
    sf = written(spark, tmp_path, "conversations", [(c, 1, "user", "lost", "", "", 0.0) for c in turnless], CHATS)
    rows = trie.op12_prefix_trie(spark, sf).collect()
    assert [(x.depth, x.n_convs, x.n_leaves, x.ends_sha256) for x in rows] == [(0, len(turnless), 1, hexed(",".join(map(str, turnless))))]


def test_long_text_and_hot_turn(spark):
    long = "word " * 200_000
    rows = [(c, t, "user", long if t == 0 and c < 3 else f"same {t}") for c in range(400) for t in range(2)] + [(c, 2, "user", f"other {c}") for c in range(400)]
    found = trie.trie(trie.sequences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), 20).collect()
    top = {(x.depth, x.conv_id): x for x in found}
    assert top[0, 0].saved_tokens == 2 * 200_000 + 396 * 2 + (2 + 396) * 2 and top[0, 0].n_leaves == 400
    assert top[2, 3].n_children == 397 and len(found) == 1 + 2 + 2 + 400


# ---- Merkle


DOCS = "doc_id long, text string, lang string, source string, n_chars long, part long, leaf string, payload string"


def plain_manifest(rows) -> list[dict]:
    def leaf(x, text):
        fields = [x[0], x[3], x[2], x[4], text]
        return hexed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))

    def levels(hashes):
        out = [hashes]
        while len(out[-1]) > 1:
            out.append([hexed("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    def proof(tree, at):
        out = []
        for level in tree[:-1]:
            first = at // 16 * 16
            out.append((level[first:at], level[at + 1 : first + 16]))
            at //= 16
        return out

    groups = defaultdict(list)
    for x in rows:
        groups[x[3]].append((x[0] is not None, x[0] or 0, leaf(x, x[1]), x))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    over = levels([trees[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for i, (_, _, h, x) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            pairs = proof(trees[s], i) + proof(over, g)
            tampered = zlib.crc32(("" if x[0] is None else str(x[0])).encode()) % 5 == 0
            text = x[1].translate(str.maketrans(merkle.UPPER, merkle.LOWER)) if tampered and x[1] is not None else x[1]
            up = leaf(x, text)
            for a, b in pairs:
                up = hexed("".join([*a, up, *b]))
            root = over[-1][0]
            out.append({"doc_id": x[0], "leaf": h, "subroot": trees[s][-1][0], "root": root, "proof_sha256": hexed("".join("".join(a + b) for a, b in pairs)), "folded_root": up, "verified": up == root})
    return out


@pytest.fixture(scope="module")
def manifest_docs():
    r = random.Random(11)
    rows = [(i, f"Text {i} É", "en", r.choice(["a", "a", "a", "b", "ß", None, f"s{i % 23}"]), i) for i in range(900)]
    rows += [rows[5]] * 40 + [(None, "no id", None, "a", None), (None, None, None, None, None), (7001, None, None, "lone", 3), (7005, "", "en", "b", 0), (7010, "A" * 500_000, "en", "b", 1)]
    return [x + (1, "clash", "clash") for x in rows]


@pytest.mark.parametrize("leaf_rows", [50_000, 30])
def test_manifest_against_plain_tree(spark, tmp_path, monkeypatch, manifest_docs, leaf_rows):
    monkeypatch.setattr(merkle.manifest, "__defaults__", (leaf_rows,))
    monkeypatch.setattr(merkle, "BATCH", 100)
    sf = written(spark, tmp_path, "documents", manifest_docs, DOCS)
    found = by_spark(merkle.op13_merkle_manifest(spark, sf))
    assert found == sorted((tuple(x[k] for k in sorted(x)) for x in plain_manifest(manifest_docs)), key=repr)
    assert found == by_sql(sf, "documents", merkle.ORACLES["op13_merkle_manifest"])
    assert {x[-1] for x in found} == {True, False}


def test_manifest_of_none_and_of_one(spark, tmp_path):
    sf = written(spark, tmp_path, "documents", [], DOCS)
    assert merkle.op13_merkle_manifest(spark, sf).count() == 0
    one = [(3, "Only", None, None, 4, 1, "x", "x")]
    sf = written(spark, tmp_path, "documents", one, DOCS)
    assert by_spark(merkle.op13_merkle_manifest(spark, sf)) == [tuple(x[k] for k in sorted(x)) for x in plain_manifest(one)]


@pytest.mark.parametrize("lo, hi, size", [(0, 1, 1), (0, 16, 16), (3, 4, 1000), (15, 33, 40), (250, 600, 4097), (4096, 4097, 4097), (0, 4097, 4097)])
def test_what_a_multiproof_fetches(lo, hi, size):
    """Exactly the siblings of all proofs that no leaf of the range gives."""
    found, own, need, level = merkle.missing(lo, hi, size), set(range(lo, hi)), [], 0
    while size > 1:
        runs = {i // 16 for i in own}
        every = {i for r in runs for i in range(16 * r, min(16 * r + 16, size))}
        need += [(level, i) for i in sorted(every - own)]
        own, size, level = runs, -(-size // 16), level + 1
    assert sorted(found) == sorted(need)


def test_proofs_are_real(spark):
    """Proofs of the operator itself, folded by Spark, give the root; with another leaf they don't."""
    rows = spark.range(500).select((F.col("id") % 3).cast("string").alias("grp"), F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.lit(1).alias("size"), F.lit("x").alias("a.b"), F.lit(2).alias("proof"), F.lit(3).alias("part"))
    found = merkle.proofs(merkle.manifest(rows, 60))
    assert found.columns == ["grp", "key", "leaf", "size", "a.b", "part", "subroot", "root", "proof"]
    good = found.filter(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count()
    bad = found.filter(merkle.folded(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).count()
    assert (good, bad, found.select("root").distinct().count()) == (500, 0, 1)
