"""Merkle manifest of a dataset: one tree over all rows, and every row's proof from one multiproof a leaf partition (octopus)."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER, OTHERS, UPPER, crc_mod, packed, stored, table, whole_groups
from .trie import CRC32

#: Children of a node.
ARITY = 16
#: Rows of a leaf partition, about.
LEAVES = 50_000
#: Rows of a batch of proofs.
BATCH = 1_000
#: The group of the tree whose leaves are the groups' subroots.
OVER = -1


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and its text; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Lowercase hex SHA-256 of all fields, one after another."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def proof_hash(proof: Column) -> Column:
    """SHA-256 of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, x: F.sha2(F.concat(x["before"], h, x["after"]), 256))


def _tree(level: DataFrame, most: int, label: str) -> list[DataFrame]:
    """The levels (grp, size, idx, hash) of the trees over ``level``, whose largest has ``most`` leaves. Each is written once, with a sixteenth of the rows of the one below."""
    out = [level]
    while most > 1:
        several = out[-1].filter("size > 1")
        runs = several.groupBy("grp", F.floor(F.col("idx") / ARITY).alias("idx"), F.ceil(F.col("size") / ARITY).alias("size"))
        run = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"])  # ARITY hashes at most
        out.append(stored(runs.agg(F.sha2(F.array_join(run, ""), 256).alias("hash")).select("grp", "size", "idx", "hash"), f"merkle-{label}"))
        most = -(-most // ARITY)
    return out


def manifest(leaves: DataFrame, leaf_rows: int = LEAVES) -> dict[str, DataFrame]:
    """The tree of ``leaves`` (grp, key, leaf, and any other columns), which should be a written table.

    Leaves ascend by group (null first), key (null first) and hash; equal rows are interchangeable. They are
    range-partitioned by sampled splitters into leaf partitions of about ``leaf_rows`` rows and numbered there, so
    groups of any size, and equal rows, are spread. An empty table gives empty frames:

    * ``leaves``: grp, key, leaf, the other columns in one struct, part, rank (of the group), pos and size (place in the
      group, its rows), near (within a run of the ends of its part's range);
    * ``ranges``: a row per part and group: part, rank, name (of the group), lo, hi (places), size, groups (number of them);
    * ``nodes``: grp (rank of a group; OVER for the tree over the groups' subroots), level, size (of the level), idx, hash.
      Of level 0 only the leaves that are near: no multiproof asks for others;
    * ``groups``: rank, name, subroot.
    """
    spark, leaves = leaves.sparkSession, packed(leaves, "grp", "key", "leaf")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-leaves.count() // leaf_rows))
    order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf").asc(), F.col("tie").asc()]
    dealt = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    mark = F.monotonically_increasing_id()
    dealt = dealt.select(*leaves.columns, F.shiftright(mark, 33).alias("part"), mark.bitwiseAND((1 << 33) - 1).alias("row"))
    dealt = stored(dealt, "merkle-leaves")

    counts = stored(dealt.groupBy("part", "grp").agg(F.count("*").alias("n"), F.min("row").alias("first")), "merkle-counts")
    lo = F.coalesce(F.sum("n").over(W.partitionBy("grp").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.select("part", F.col("grp").alias("name"), "first", "n", lo.alias("lo"), F.sum("n").over(W.partitionBy("grp")).alias("size"))
    ranges = stored(ranges, "merkle-ranges")
    begun = ranges.filter("lo = 0")
    each = begun.groupBy("part").agg(F.count("*").alias("begun"))  # one row a part: what follows numbers parts, not rows
    before = F.sum("begun").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("begun")
    each = each.select("part", before.alias("before"), F.sum("begun").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("groups"))
    rank = F.row_number().over(W.partitionBy("part").orderBy("first")) - 1 + F.col("before")
    ranks = stored(begun.join(each, "part").select(F.col("name").alias("name_"), rank.cast("long").alias("rank"), "groups"), "merkle-ranks")
    ranges = ranges.join(ranks, F.col("name").eqNullSafe(F.col("name_"))).select("part", "name", "first", "lo", (F.col("lo") + F.col("n")).alias("hi"), "size", "rank", "groups")
    ranges = stored(ranges, "merkle-ranges")

    at = ranges.withColumnRenamed("part", "part_")
    placed = dealt.join(at, (F.col("part") == F.col("part_")) & F.col("grp").eqNullSafe(F.col("name")))
    pos = F.col("lo") + F.col("row") - F.col("first")
    near = (pos - F.col("lo") < ARITY) | (F.col("hi") - pos <= ARITY)
    placed = placed.select(*leaves.columns, "part", "rank", pos.alias("pos"), "size", near.alias("near"))

    most = ranges.agg(F.max("size"), F.max("groups")).first()
    trees = _tree(placed.select(F.col("rank").alias("grp"), "size", F.col("pos").alias("idx"), F.col("leaf").alias("hash"), "near"), most[0] or 0, "nodes")
    tops = trees[0].filter("size = 1").drop("near")
    for x in trees[1:]:
        tops = tops.unionByName(x.filter("size = 1"))
    groups = ranges.filter("lo = 0").join(tops.select(F.col("grp").alias("rank"), F.col("hash").alias("subroot")), "rank")
    groups = stored(groups.select("rank", "name", "subroot", "groups"), "merkle-groups")
    over = _tree(groups.select(F.lit(OVER).cast("long").alias("grp"), F.col("groups").alias("size"), F.col("rank").alias("idx"), F.col("subroot").alias("hash")), most[1] or 0, "over")
    nodes = None
    for levels in ([trees[0].filter("near").drop("near"), *trees[1:]], over):
        for k, x in enumerate(levels):
            x = x.select("grp", F.lit(k).alias("level"), "size", "idx", "hash")
            nodes = x if nodes is None else nodes.unionByName(x)
    return {"leaves": placed, "ranges": ranges.drop("first"), "nodes": nodes, "groups": groups.drop("groups")}


def missing(lo: int, hi: int, size: int) -> list[tuple[int, int]]:
    """(level, idx) of all nodes that prove the leaves lo to hi - 1 of ``size`` and that these leaves don't give themselves."""
    out, level = [], 0
    while size > 1:
        a, b = lo // ARITY * ARITY, min(-(-hi // ARITY) * ARITY, size)
        out += [(level, i) for i in (*range(a, lo), *range(hi, b))]
        lo, hi, size, level = a // ARITY, -(-b // ARITY), -(-size // ARITY), level + 1
    return out


def height(size: int) -> int:
    """The level of the root of a tree of ``size`` leaves."""
    level = 0
    while size > 1:
        size, level = -(-size // ARITY), level + 1
    return level


def _wanted(batches):
    """The coordinates that each range of a part needs, and for the tree over the groups its root too."""
    for batch in batches:
        out = {"part": [], "grp": [], "level": [], "idx": []}
        for x in batch.to_pylist():
            found = missing(x["lo"], x["hi"], x["size"]) + ([(height(x["size"]), 0)] if x["grp"] == OVER else [])
            out["part"] += [x["part"]] * len(found)
            out["grp"] += [x["grp"]] * len(found)
            out["level"] += [k for k, _ in found]
            out["idx"] += [i for _, i in found]
        yield pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int64()), pa.array(out["grp"], pa.int64()), pa.array(out["level"], pa.int32()), pa.array(out["idx"], pa.int64())], list(out))


def _fold_up(hashes: list[str], grp: int, lo: int, size: int, got: dict) -> tuple[list[tuple[int, list[str]]], str]:
    """The runs of each level that cover consecutive nodes from ``lo`` on, with what was fetched at their ends, and the root."""
    levels, level = [], 0
    while size > 1:
        hi = lo + len(hashes)
        a, b = lo // ARITY * ARITY, min(-(-hi // ARITY) * ARITY, size)
        row = [got[grp, level, i] for i in range(a, lo)] + hashes + [got[grp, level, i] for i in range(hi, b)]
        levels.append((a, row))
        hashes = [sha256("".join(row[i : i + ARITY]).encode()).hexdigest() for i in range(0, len(row), ARITY)]
        lo, size, level = a // ARITY, -(-size // ARITY), level + 1
    return levels, hashes[0]


def _siblings(levels: list[tuple[int, list[str]]], at: int, known: dict) -> tuple[tuple[str, str], ...]:
    """(before, after) of the node ``at`` and its ancestors within ``levels``; those of ancestors are made once."""
    out = []
    for k, (first, row) in enumerate(levels):
        pair = known.get((k, at))
        if pair is None:
            i = at - first
            run = i // ARITY * ARITY
            pair = "".join(row[run:i]), "".join(row[i + 1 : run + ARITY])
            if k:
                known[k, at] = pair
        out.append(pair)
        at //= ARITY
    return tuple(out)


def _proven(batches):
    """All proofs of the parts in sorted rows: a part's fetched nodes come first, then its leaves."""
    for rows in whole_groups(batches, "part", 1):
        rows = rows.combine_chunks()
        part = rows["part"].to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield from _prove(rows.slice(i, j - i))


def _prove(rows: pa.Table):
    own = rows["own"].to_numpy()
    n = int(np.count_nonzero(~own))
    head, body = rows.slice(0, n), rows.slice(n)
    if not len(body):
        return
    got = {(g, k, i): h for g, k, i, h in zip(*(head[c].to_pylist() for c in ("grp", "level", "idx", "hash")), strict=True)}
    grp, pos, size = (body[c].to_numpy() for c in ("grp", "idx", "size"))
    leaf = body["hash"].to_pylist()
    cuts = np.flatnonzero(np.concatenate(([True], grp[1:] != grp[:-1], [True])))
    trees, subroots = {}, []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        trees[int(grp[i])], subroot = _fold_up(leaf[i:j], int(grp[i]), int(pos[i]), int(size[i]), got)
        subroots.append(subroot)
    groups = body["groups"][0].as_py()
    over, _ = _fold_up(subroots, OVER, int(grp[0]), groups, got)
    root = got[OVER, height(groups), 0]
    known = {g: {} for g in trees}
    above = {g: _siblings(over, g, {}) for g in trees}
    subroot = dict(zip(trees, subroots, strict=True))
    for i in range(0, len(leaf), BATCH):
        which = grp[i : i + BATCH].tolist()
        proofs = [_siblings(trees[g], p, known[g]) + above[g] for g, p in zip(which, pos[i : i + BATCH].tolist(), strict=True)]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in proofs])))
        pairs = pa.StructArray.from_arrays([pa.array([x[k] for p in proofs for x in p], pa.string()) for k in (0, 1)], ["before", "after"])
        cut = body.slice(i, BATCH).combine_chunks()
        payload = cut["payload"].chunk(0)
        yield pa.RecordBatch.from_arrays([payload, pa.array([subroot[g] for g in which], pa.string()), pa.array([root] * len(which), pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], ["payload", "subroot", "root", "proof"])


def proofs(made: dict[str, DataFrame]) -> DataFrame:
    """Of each leaf of a ``manifest``: its columns, subroot, root (the manifest's) and proof, an array of (before, after):
    the joined hashes of its siblings left and right of it, level by level up to the root. Given columns of these three
    names give way to them.

    Per leaf partition (octopus): the union of the coordinates that its leaves' proofs need and its leaves don't give is
    made from its ranges alone - at most two runs a level of its first and last group and of the tree over the groups -
    and joined with the nodes once. Interiors are then derived once a partition and shared by its proofs, which leave in
    batches of bounded size. Fetched rows grow with partitions, not with leaves.
    """
    leaves, ranges = made["leaves"], made["ranges"]
    over = ranges.groupBy("part").agg(F.lit(OVER).cast("long").alias("grp"), F.min("rank").alias("lo"), (F.max("rank") + 1).alias("hi"), F.max("groups").alias("size"))
    asked = ranges.select("part", F.col("rank").alias("grp"), "lo", "hi", "size").unionByName(over)
    wanted = stored(asked.mapInArrow(_wanted, "part bigint, grp bigint, level int, idx bigint"), "merkle-wanted")
    fetched = wanted.join(made["nodes"].drop("size"), ["grp", "level", "idx"])
    payload = F.struct("grp", "key", "leaf", OTHERS)
    kind = leaves.select(payload.alias("x")).schema["x"].dataType
    proof = T.ArrayType(T.StructType().add("before", "string").add("after", "string"))
    groups = ranges.groupBy("part").agg(F.max("groups").alias("groups"))
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    body = leaves.join(groups, "part").select("part", F.lit(True).alias("own"), F.col("rank").alias("grp"), no("int", "level"), F.col("pos").alias("idx"), F.col("leaf").alias("hash"), "size", "groups", payload.alias("payload"))
    head = fetched.select("part", F.lit(False).alias("own"), "grp", "level", "idx", "hash", no("long", "size"), no("long", "groups"), no(kind, "payload"))
    rows = body.unionByName(head).repartition("part").sortWithinPartitions("part", "own", "grp", "idx")
    found = rows.mapInArrow(_proven, T.StructType().add("payload", kind).add("subroot", "string").add("root", "string").add("proof", proof))
    names = leaves.schema[OTHERS].dataType.names
    given = [c for c in names if c not in ("subroot", "root", "proof")] if names != ["none"] else []
    return found.select("payload.grp", "payload.key", "payload.leaf", *[F.col(f"payload.{OTHERS}.`{c}`").alias(c) for c in given], "subroot", "root", "proof")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of ``documents`` by source and doc_id, each row's proof, and the root that its proof gives from its text in lower case (A-Z) where 5 divides crc32 of the id.

    Null fields count as ``-``, null sources and ids come first, rows of one id ascend by leaf; a null id's crc32 is that
    of the empty text. An empty table gives no rows. Other columns don't matter.
    """
    docs = table(spark, sf_dir, "documents")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = leaf_hash(*values, F.translate("text", UPPER, LOWER))
    changed = F.when(crc_mod(F.col("doc_id"), 5) == 0, lower)
    leaves = docs.select(F.col("source").alias("grp"), F.col("doc_id").alias("key"), leaf_hash(*values, F.col("text")).alias("leaf"), changed.alias("changed"))
    found = proofs(manifest(stored(leaves, "merkle-input")))
    folded_root = folded(F.coalesce("changed", "leaf"), F.col("proof"))
    found = found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof_hash(F.col("proof")).alias("proof_sha256"), folded_root.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(leaf_levels: int = 7, group_levels: int = 5) -> str:
    """SQL of the query, for at most 16^leaf_levels rows a source and 16^group_levels sources."""
    part = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    fields = lambda text: "sha256(" + " || ".join(map(part, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    steps = [
        f"""d AS (SELECT doc_id, source, {fields("text")} AS leaf, CASE WHEN {CRC32.format("coalesce(CAST(doc_id AS VARCHAR), '')")} % 5 = 0 THEN {fields(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {fields("text")} END AS used FROM documents)""",
        """l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM d)""",
        "n0 AS (SELECT s, p AS i, n, leaf AS h FROM l)",
        "f0 AS (SELECT doc_id, leaf, s, p AS i, used AS h, '' AS proof FROM l)",
    ]

    def up(k: int, nodes: str, out: str) -> list[str]:
        return [
            f"r{k} AS (SELECT s, i // 16 AS i, n, list(h ORDER BY i) AS hs FROM {nodes} GROUP BY s, i // 16, n)",
            f"{out} AS (SELECT s, i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM r{k})",
            f"""f{k + 1} AS (SELECT doc_id, leaf, f.s, f.i // 16 AS i, CASE WHEN n > 1 THEN sha256(array_to_string(hs[1:f.i % 16], '') || h || array_to_string(hs[f.i % 16 + 2:], '')) ELSE h END AS h,
  CASE WHEN n > 1 THEN proof || array_to_string(hs[1:f.i % 16], '') || array_to_string(hs[f.i % 16 + 2:], '') ELSE proof END AS proof{{more}} FROM f{k} f JOIN r{k} r ON r.s = f.s AND r.i = f.i // 16)""",
        ]

    for k in range(leaf_levels):
        steps += [x.format(more="") for x in up(k, f"n{k}", f"n{k + 1}")]
    k = leaf_levels
    steps += [
        f"n{k + 1} AS (SELECT -1 AS s, s AS i, count(*) OVER () AS n, h FROM n{k})",
        f"f{k + 1} AS (SELECT doc_id, leaf, -1 AS s, f.s AS i, f.h, proof, n{k}.h AS subroot FROM f{k} f JOIN n{k} ON n{k}.s = f.s)",
    ]
    for k in range(leaf_levels + 1, leaf_levels + 1 + group_levels):
        steps += [x.format(more=", subroot") for x in up(k, f"n{k}", f"n{k + 1}")]
    last = leaf_levels + 1 + group_levels
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, leaf, subroot, n{last}.h AS root, sha256(proof) AS proof_sha256, f{last}.h AS folded_root, f{last}.h = n{last}.h AS verified FROM f{last}, n{last}"


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLES = {"op13_merkle_manifest": _oracle()}
