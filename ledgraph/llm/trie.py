"""Trie of conversation prefixes by truncation peeling: from the deepest turn up, endings and surviving nodes lose their last turn and are grouped again."""

from __future__ import annotations

from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_mod, n_words, stored, table, whole_groups
from .textbytes import flat

#: A prefix below which more different conversations end is grouped by Spark, level by level; the subtree of any other is peeled in one task.
SPLIT = 256
#: Ids of a node's endings travel joined, so many at most in a row.
PIECE = 4096
#: Bytes of a prefix's digest.
SIZE = 16
NONE = np.iinfo(np.int64).max


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: of each conversation an array of (digest, words), by turn, null first, then by digest. Null roles and texts count as empty; rows of null conv_id are one conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    row = F.struct(F.col("turn").isNotNull().alias("known"), "turn", digest.alias("digest"), n_words(text).alias("words"))
    turns = F.array_sort(F.collect_list(row))
    return conversations.groupBy("conv_id").agg(F.transform(turns, lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))).alias("turns"))


def _chains(batches):
    """The digests of all prefixes of each sequence, one after another."""
    for batch in batches:
        lists = batch.column("digests")
        at, each = lists.offsets.to_numpy(), lists.values.to_pylist()
        chains = []
        for i, j in zip(at[:-1], at[1:], strict=True):
            last, chain = b"", []
            for digest in each[i:j]:
                last = blake2b(last + digest, digest_size=SIZE).digest()
                chain.append(last)
            chains.append(b"".join(chain))
        depth = pa.array(np.diff(at), pa.int32())
        keys = pa.array([c[-SIZE:] for c in chains], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), depth, keys, pa.array(chains, pa.binary()), batch.column("words")], ["conv_id", "depth", "key", "chain", "words"])


def _pieces(batches):
    """Runs of equal keys in sorted rows, as a count, the ids joined, and what all rows of the key share."""
    held, ids = None, []

    def piece():
        known = [x for x in ids if x is not None]
        text = ",".join("" if x is None else str(x) for x in ids)
        return {**held, "start": ids[0], "least": known[0] if known else None, "n": len(ids), "ids": text}

    names = ("key", "depth", "chain", "words")
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held is not None and (row["key"] != held["key"] or len(ids) == PIECE):
                out.append(piece())
                held = None
            if held is None:
                held, ids = {k: row[k] for k in names}, []
            ids.append(row["conv_id"])
        if out:
            yield pa.RecordBatch.from_pylist(out, _PIECES)
    if held is not None:
        yield pa.RecordBatch.from_pylist([piece()], _PIECES)


_SHARED = [("key", pa.binary()), ("depth", pa.int32()), ("chain", pa.binary()), ("words", pa.list_(pa.int64()))]
_PIECES = pa.schema([*_SHARED, ("start", pa.int64()), ("least", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
_ENDS = pa.schema([*_SHARED, ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("ends_sha256", pa.string())])


def _endings(batches):
    """One row a key from its sorted pieces, whose ids are hashed as they pass."""
    held = digest = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held is not None and row["key"] == held["key"]:
                digest.update(b"," + row["ids"].encode())
                held["n_convs"] += row["n"]
                held["conv_id"] = row["least"] if held["conv_id"] is None else held["conv_id"]
                continue
            if held is not None:
                out.append({**held, "ends_sha256": digest.hexdigest()})
            held = {k: row[k] for k, _ in _SHARED} | {"conv_id": row["least"], "n_convs": row["n"]}
            digest = sha256(row["ids"].encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, _ENDS)
    if held is not None:
        yield pa.RecordBatch.from_pylist([{**held, "ends_sha256": digest.hexdigest()}], _ENDS)


_SHARED_SQL = "key binary, depth int, chain binary, words array<bigint>"
_NODE_SQL = "depth int, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, top boolean, chain binary, words array<bigint>"
_NODES = pa.schema([
    ("depth", pa.int32()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("top", pa.bool_()), ("chain", pa.binary()), ("words", pa.list_(pa.int64())),
])


def _peeled(batches):
    """All nodes of whole subtrees, whose rows come sorted by chain; a subtree's top has its chain and words, to be peeled on."""
    for rows in whole_groups(batches, "under", 4000):
        yield _peel(rows.combine_chunks())


def _peel(rows: pa.Table) -> pa.RecordBatch:
    data, at = flat(rows["chain"].chunk(0))
    keys = np.ascontiguousarray(data).view(np.uint64).reshape(-1, 2)
    at = at // SIZE
    words = rows["words"].chunk(0).flatten().to_numpy()
    depth, land = np.diff(at), rows["land"].to_numpy()
    conv = rows["conv_id"].chunk(0).fill_null(NONE).to_numpy()
    count = rows["n_convs"].to_numpy()
    by_depth = np.argsort(-depth, kind="stable")
    bounds = np.searchsorted(-depth[by_depth], -np.arange(depth.max() + 2), side="left")  # rows deeper than d come before bounds[d]
    levels = []
    empty = np.zeros(0, np.int64)
    row, n, least, leaves, saved = (empty,) * 5
    for d in range(int(depth.max()), 0, -1):
        ends = by_depth[bounds[d] : bounds[d - 1]]
        if not len(row) and not len(ends):
            continue
        zero = np.zeros(len(ends), np.int64)
        every = np.concatenate((row, ends))
        order = np.argsort(every, kind="stable")
        child = np.concatenate((np.ones(len(row), np.int64), zero))[order]
        inner = np.concatenate((np.arange(len(row)), zero - 1))[order]
        every = every[order]
        here = at[every] + d - 1
        new = np.concatenate(([True], (keys[here[1:]] != keys[here[:-1]]).any(axis=1)))
        starts = np.flatnonzero(new)
        add = lambda a, b: np.add.reduceat(np.concatenate((a, b))[order], starts)  # noqa: E731, B023
        n_new, saved_new, leaves_new = add(n, count[ends]), add(saved, zero), add(leaves, zero)
        least_new = np.minimum.reduceat(np.concatenate((least, conv[ends]))[order], starts)
        children = np.add.reduceat(child, starts)
        leaves_new = np.where(children == 0, 1, leaves_new)
        saved_new = saved_new + (n_new - 1) * words[here[starts]]
        ended = np.maximum.reduceat(np.where(child == 0, every, -1), starts)
        if levels and len(row):
            parent = np.empty(len(row), np.int64)
            parent[inner[child == 1]] = least_new[np.cumsum(new) - 1][child == 1]
            levels[-1]["parent"][~levels[-1]["top"]] = parent
        first = every[starts]
        top = land[first] == d
        levels.append({"depth": np.full(len(first), d), "row": first, "least": least_new, "parent": np.full(len(first), NONE), "n": n_new, "children": children, "leaves": leaves_new, "saved": saved_new, "ended": ended, "top": top})
        row, n, least, leaves, saved = (x[~top] for x in (first, n_new, least_new, leaves_new, saved_new))
    x = {k: np.concatenate([level[k] for level in levels]) for k in levels[0]}
    chains, lists = rows["chain"].to_pylist(), at[x["row"]]
    known = lambda a: pa.array(a, pa.int64(), mask=a == NONE)
    tops = zip(x["top"], x["row"], x["depth"], lists, strict=True)
    chain, word = zip(*[(chains[r][: SIZE * d], words[i : i + d].tolist()) if t else (None, None) for t, r, d, i in tops], strict=True)
    sha = rows["ends_sha256"].chunk(0).take(pa.array(x["ended"], pa.int64(), mask=x["ended"] < 0))
    columns = [pa.array(x["depth"], pa.int32()), known(x["least"]), known(x["parent"]), *(pa.array(x[k], pa.int64()) for k in ("n", "children", "leaves", "saved")), sha, pa.array(x["top"]), pa.array(chain, pa.binary()), pa.array(word, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, schema=_NODES)


def _prefix(chain: str, depth: Column | int) -> Column:
    """The digest of the first ``depth`` turns; none for 0."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth > 0, F.substring(F.col(chain), SIZE * (depth - 1) + 1, F.lit(SIZE))).otherwise(F.lit(b""))


def trie(found: DataFrame, split: int = SPLIT) -> DataFrame:
    """One row per node of the trie of ``found`` (conv_id, turns: array of (digest, words)).

    Columns: depth, conv_id (least member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A
    node is conv_id's first depth turns. No rows for an empty table; a conversation without turns ends at the root. A
    null conv_id is a member like any other, is written as nothing among the endings, and is a least member only alone.

    Equal conversations become one ending first: their ids are range-partitioned, joined in pieces and hashed as a
    stream, so no list of them is held. Prefixes with more than ``split`` different endings below them ("hot", the root
    always) are found by a count. The subtree under the first prefix that isn't hot is peeled in one task, from its
    deepest turn up. The tops of such subtrees, and endings within the hot part, go on by one grouped sum a level, which
    is combined before the shuffle. So the number of Spark jobs grows with the depth of the hot part only, not with the
    longest conversation.
    """
    arrays = found.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"))
    paths = stored(arrays.mapInArrow(_chains, f"conv_id bigint, {_depth_first()}"), "trie-paths")
    runs = paths.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_pieces, f"{_SHARED_SQL}, start bigint, least bigint, n bigint, ids string")
    ends = runs.repartition("key").sortWithinPartitions("key", "start").mapInArrow(_endings, f"{_SHARED_SQL}, conv_id bigint, n_convs bigint, ends_sha256 string")
    ends = stored(ends, "trie-endings")

    steps = "transform(sequence(1, depth), d -> struct(d, substring(chain, {0} * (d - 1) + 1, {0}) AS prefix))".format(SIZE)
    prefixes = ends.filter("depth > 0").select("key", F.inline(F.expr(steps)))
    hot = stored(prefixes.groupBy("prefix").agg(F.count("*").alias("n")).filter(F.col("n") > split).select("prefix"), "trie-hot")
    reach = prefixes.join(hot, "prefix", "left_semi").groupBy("key").agg(F.max("d").alias("reach"))
    landed = stored(ends.join(reach, "key", "left").withColumn("land", F.coalesce("reach", F.lit(0)) + 1).drop("reach"), "trie-landed")
    deep = landed.filter("land <= depth").withColumn("under", _prefix("chain", F.col("land"))).repartition("under").sortWithinPartitions("chain")
    peeled = stored(deep.mapInArrow(_peeled, _NODE_SQL), "trie-peeled")
    tops = peeled.filter("top")
    inside = landed.filter("land > depth")

    low = [tops.agg(F.max("depth")).first()[0], inside.agg(F.max("depth")).first()[0]]
    level, levels = None, []
    for d in range(max((low[0] or 0) - 1, -1 if low[1] is None else low[1]), -1, -1):
        below = tops.filter(F.col("depth") == d + 1)
        below = below if level is None else below.unionByName(level)
        value = ["n_convs", "conv_id", "n_leaves", "saved_tokens"]
        child = below.select("chain", "words", *value, F.lit(1).cast("long").alias("child"), F.lit(None).cast("string").alias("ends_sha256"))
        ended = inside.filter(F.col("depth") == d).select("chain", "words", "n_convs", "conv_id", *[F.lit(0).cast("long").alias(c) for c in ("n_leaves", "saved_tokens", "child")], "ends_sha256")
        held = child.unionByName(ended).withColumn("key", _prefix("chain", d))
        sums = held.groupBy("key").agg(
            F.first(F.substring("chain", 1, SIZE * d)).alias("chain"),
            F.first(F.slice("words", 1, d)).alias("words"),
            F.sum("n_convs").alias("n_convs"),
            F.min("conv_id").alias("conv_id"),
            F.sum("child").alias("n_children"),
            F.sum("n_leaves").alias("leaves"),
            F.sum("saved_tokens").alias("below"),
            F.max("ends_sha256").alias("ends_sha256"),
        )
        spared = (F.col("n_convs") - 1) * (F.element_at("words", d) if d else F.lit(0))
        sums = sums.select(
            F.lit(d).alias("depth"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
            F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).alias("n_leaves"), (F.col("below") + spared).alias("saved_tokens"),
            "ends_sha256", F.lit(True).alias("top"), "chain", "words",
        )
        level = stored(sums, "trie-level")
        levels.append(level)

    columns = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256")]
    open_ends, parents = tops, None
    for x in levels:
        open_ends = open_ends.unionByName(x)
        at = x.select(_prefix("chain", F.col("depth")).alias("above"), F.col("conv_id").alias("up"), (F.col("depth") + 1).alias("depth"))
        parents = at if parents is None else parents.unionByName(at)
    if parents is None:
        return peeled.select(*columns)
    joined = open_ends.withColumn("above", _prefix("chain", F.col("depth") - 1)).join(parents, ["above", "depth"], "left").withColumn("parent_conv_id", F.col("up"))
    return peeled.filter("NOT top").select(*columns).unionByName(joined.select(*columns))


def _depth_first() -> str:
    return "depth int, key binary, chain binary, words array<bigint>"


def rebuilt(found: DataFrame) -> DataFrame:
    """Sequences whose first h turns are those of conversation conv_id - conv_id % 20, h being crc32 of the id modulo 4; a null id has h = 0."""
    heads = found.filter("conv_id % 20 = 0").select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, 3).alias("head"))
    h = crc_mod(F.col("conv_id"), 4).cast("int")
    head = F.coalesce("head", F.slice("turns", 1, 0))
    joined = found.join(heads, found.conv_id - found.conv_id % 20 == heads.head_id, "left")
    return joined.select("conv_id", F.concat(F.slice(head, F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of ``conversations``, rebuilt by ``rebuilt``; see ``sequences`` and ``trie`` for nulls, ties and empty tables. Other columns don't matter."""
    found = stored(sequences(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "trie-turns")
    return trie(rebuilt(found)).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


#: crc32 of a decimal number, as SQL; {0} is the number.
CRC32 = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))))"""

ORACLE = """WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations),
s AS (SELECT conv_id, list({'r': r, 't': t} ORDER BY turn NULLS FIRST, sha256(CAST(strlen(r) AS VARCHAR) || ':' || r || t)) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, CAST(""" + CRC32.format("conv_id") + """ % 4 AS INT) AS h FROM s),
b AS (SELECT h.conv_id, list_concat(coalesce(s.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN s ON s.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, turns, d, len(turns) = d AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM b)),
n AS (SELECT turns[1:d] AS k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM p GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN depth = 0 THEN [] ELSE k[1:depth - 1] END AS up, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(k[depth].t, '[^\\x20\\x09-\\x0D]+')) END AS spared FROM n),
c AS (SELECT up, depth - 1 AS depth, count(*) AS n FROM w WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT w.*, coalesce(c.n, 0) AS n_children FROM w LEFT JOIN c ON c.up = w.k AND c.depth = w.depth),
a AS (SELECT k[1:j] AS k, j AS depth, sum(spared) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM (SELECT k, spared, n_children, unnest(range(0, depth + 1)) AS j FROM f) GROUP BY 1, 2)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(f.ids) AS ends_sha256
FROM f JOIN a ON a.k = f.k AND a.depth = f.depth LEFT JOIN f q ON f.depth > 0 AND q.k = f.up AND q.depth = f.depth - 1"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {"op12_prefix_trie": ORACLE}
