"""Exact substring dedup by sorting suffixes in range-partitioned buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import OTHERS, packed, stored, table, unpacked, whole_groups
from .textbytes import flat, mixed, parts, powers, prefix_sums, runs, sliding_min, span_hash

#: Bytes of a match, and of the leading token by which its suffix is partitioned.
SPAN, TOKEN = 200, 40
#: Piece of a text that is worked on at once; place in it takes PLACE_BITS.
PIECE, PLACE_BITS = 1 << 19, 22
#: Runs of one token that a task sorts together; those of a token with more go on as single suffixes.
LARGE = 20_000


# ---- suffixes and their leading tokens --------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, token: int = TOKEN) -> dict[str, np.ndarray]:
    """Runs of neighbouring suffixes with the same leading token.

    Every suffix of ``span`` bytes or more has as leading token the ``token``-byte string with the least hash among
    those that begin in and end by its first ``span`` bytes; the leftmost of equal ones. So suffixes with equal first
    ``span`` bytes have equal tokens, and neighbours mostly share one. Returns row, lo and hi (first and last suffix of
    the run), at (the token's place), all relative to the row, key (the token's hash), seg and seg2 (two hashes of the
    bytes [lo, hi + span), to which all suffixes of the run belong).
    """
    found: list[tuple[np.ndarray, ...]] = []
    todo: list[tuple[int, int, int, int]] = []  # rows [i, j), from byte a to b
    for i, j in parts(offsets, PIECE):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= PIECE + span:
            todo.append((i, j, a, b))
        else:  # one long text, in pieces that overlap in span - 1 bytes
            todo += [(i, j, p, min(b, p + PIECE + span - 1)) for p in range(a, b - span + 1, PIECE)]
    width = span - token + 1
    for i, j, a, b in todo:
        part = data[a:b]
        n = len(part)
        if n < span:
            continue
        sums = prefix_sums(part)
        h = mixed((sums[token:] - sums[:-token]) * powers(n + 1)[1][: n - token + 1])
        mask = np.uint64((1 << PLACE_BITS) - 1)
        first = (sliding_min((h & ~mask) | np.arange(len(h), dtype=np.uint64), width) & mask).astype(np.int64)
        edges = np.clip(offsets[i : j + 1] - a, 0, n)
        row = np.repeat(np.arange(i, j), np.diff(edges))[: n - span + 1]
        p = np.flatnonzero(np.arange(n - span + 1) + span <= edges[row - i + 1])
        if not len(p):
            continue
        q, r = first[p], row[p]
        at = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1))))
        lo, hi = p[at], p[np.concatenate((at[1:] - 1, [len(p) - 1]))]
        base = offsets[r[at]] - a
        own = span_hash(prefix_sums(part, second=True), lo, hi + span, second=True)
        found.append((r[at], lo - base, hi - base, q[at] - base, h[q[at]], span_hash(sums, lo, hi + span), own))
    names = ("row", "lo", "hi", "at", "key", "seg", "seg2")
    if not found:
        return {k: np.zeros(0, np.uint64 if k in ("key", "seg", "seg2") else np.int64) for k in names}
    return dict(zip(names, map(np.concatenate, zip(*found, strict=True)), strict=True))


def _first_of_each(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first rows of distinct texts, and how many rows each has."""
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, many = np.unique(np.array(texts.to_pylist(), object).astype("S16"), return_index=True, return_counts=True)
    order = np.argsort(first)
    return first[order], many[order]


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the keys, and the group of each sorted row."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.bool_)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


#: A run of a text and the number of its rows in a reading batch that hold this text; at is the token's place.
_RUN = "key long, seg long, seg2 long, t1 long, t2 long, lo long, hi long, at long, copies long"


def _run_batches(span: int, token: int):
    """Documents to the runs of their texts; copies of a text that a batch holds are sent once, with their number."""
    names = [x.split()[0] for x in _RUN.split(", ")]

    def rows(batches):
        for batch in batches:
            keep, many = _first_of_each(batch.column("text_id"))
            data, offsets = flat(batch.column("text").take(pa.array(keep)))
            a = anchors(data, offsets, span, token)
            if not len(a["key"]):
                continue
            ids = np.frombuffer(b"".join(batch.column("text_id").take(pa.array(keep)).to_pylist()), ">i8").astype(np.int64).reshape(-1, 2)
            own = ids[a["row"]]
            columns = [a["key"].view(np.int64), a["seg"].view(np.int64), a["seg2"].view(np.int64), own[:, 0], own[:, 1], a["lo"], a["hi"], a["at"], many[a["row"]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return rows


def _joined(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that follow each other in a row become one."""
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    at = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (lo[1:] > hi[:-1] + 1))))
    return row[at], lo[at], hi[np.concatenate((at[1:] - 1, [len(lo) - 1]))]


def _cut(span: int, token: int):
    """Joined texts and wanted runs to the runs' bytes behind their leading token; runs of a large token come apart into suffixes, which lead themselves.

    A run is cut from the first row with its text, one that only copies of its text repeat (twin) from the second row too.
    """
    names = ["lead", "key", "seg", "seg2", "t1", "t2", "lo", "copy", "first", "bytes"]
    kinds = [pa.binary(), *[pa.int64()] * 8, pa.binary()]

    def rows(batches):
        seen: dict[tuple[int, int], int] = {}
        task = TaskContext.get().partitionId() << 32
        for batch in batches:
            out, held = [], 0
            for t1, t2, text, wanted in zip(*(batch.column(c) for c in ("t1", "t2", "text", "wanted")), strict=True):
                t1, t2 = t1.as_py(), t2.as_py()
                rank = seen.get((t1, t2), 0)
                if rank > 1:
                    continue
                seen[t1, t2] = rank + 1
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for w in wanted.as_py():
                    if rank and not w["twin"]:
                        continue
                    # Rows of a text with very many copies may go to several tasks.
                    copy = task + rank + 1 if w["twin"] else 0
                    own, lo, hi = (w["key"], w["seg"], w["seg2"], t1, t2), w["lo"], w["hi"]
                    if w["large"]:
                        out += [(raw[i : i + span], *own, i, copy, i - lo, b"") for i in range(lo, hi + 1)]
                    else:
                        out.append((raw[w["at"] : w["at"] + token], *own, lo, copy, 0, raw[lo : hi + span]))
                    held += hi - lo + span
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows


# ---- local sort -------------------------------------------------------------------------------------------------


def equal_suffixes(data: np.ndarray, place: np.ndarray, group: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Which suffixes (at ``place`` in ``data``) share their first ``span`` bytes with another of their ``group`` (sorted).

    Multikey quicksort over 8-byte tokens, all groups at once: at each depth the suffixes of a group are ordered by their
    token at that depth and split where it changes; groups of one are out, groups in which all tokens are equal
    aren't sorted. What is left after the last token are groups of equal suffixes.
    """
    if len(data) < span:
        return np.zeros(len(place), np.bool_)
    big = np.ndarray((len(data) - 7,), ">u8", data.tobytes(), strides=(1,)).astype(np.uint64)
    active, g = np.arange(len(place)), group
    for depth in [*range(0, span - 7, 8), *([span - 8] if span % 8 else [])]:
        token = big[place[active] + depth]
        differ = np.flatnonzero((g[1:] == g[:-1]) & (token[1:] != token[:-1]))
        if len(differ):
            mixed_group = np.zeros(int(g[-1]) + 1, np.bool_)
            mixed_group[g[differ]] = True
            some = np.flatnonzero(mixed_group[g])
            order = some[np.lexsort((token[some], g[some]))]
            active[some], token[some] = active[order], token[order]
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (token[1:] != token[:-1])))
        g = np.cumsum(new) - 1
        keep = np.bincount(g)[g] > 1
        active, g = active[keep], g[keep]
        if not len(active):
            break
    out = np.zeros(len(place), np.bool_)
    out[active] = True
    return out


_MATCH = "key long, seg long, seg2 long, first long, last long"


def _matches(key, seg, seg2, first, last) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, seg, seg2, first, last)], ["key", "seg", "seg2", "first", "last"])


def _sort_buckets(span: int):
    """Runs sorted by their leading token to those of their suffixes that are equal to another run's or place's; first and last count from the run's beginning."""

    def rows(batches):
        for t in whole_groups(batches, "lead", 10_000):
            data, offsets = flat(t.column("bytes").combine_chunks())
            key, seg, seg2, t1, t2, lo, copy = (t.column(c).to_numpy() for c in ("key", "seg", "seg2", "t1", "t2", "lo", "copy"))
            lead = t.column("lead").to_numpy(zero_copy_only=False)
            of = np.cumsum(np.concatenate(([False], lead[1:] != lead[:-1])))
            order, same = _grouped(of, t1, t2, lo, copy)
            one = order[np.concatenate(([True], same[1:] != same[:-1]))]  # a run that several tasks cut
            n = (np.diff(offsets) - span + 1)[one]
            run = np.repeat(one, n)
            p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            group = np.cumsum(np.concatenate(([False], of[run][1:] != of[run][:-1])))
            hit = np.flatnonzero(equal_suffixes(data, offsets[run] + p, group, span))
            if len(hit):
                r, first, last = _joined(run[hit], p[hit], p[hit])
                yield _matches(key[r], seg[r], seg2[r], first, last)

    return rows


def _adjacent(batches):
    """Single suffixes sorted by their bytes to those that are equal to a neighbour; a neighbour may be in the batch before. No group is held."""
    last = None
    for batch in batches:
        t = pa.Table.from_batches([batch if last is None else last, *([] if last is None else [batch])]).combine_chunks()
        n = t.num_rows
        if not n:
            continue
        lead, place = t.column("lead").to_numpy(zero_copy_only=False), [t.column(c).to_numpy() for c in ("t1", "t2", "lo", "copy")]
        # A suffix that several tasks cut is one place.
        pair = (lead[1:] == lead[:-1]) & np.logical_or.reduce([c[1:] != c[:-1] for c in place])
        hit = np.flatnonzero(np.concatenate((pair, [False])) | np.concatenate(([False], pair)))
        if len(hit):
            first = t.column("first").to_numpy()[hit]
            yield _matches(*(t.column(c).to_numpy()[hit] for c in ("key", "seg", "seg2")), first, first)
        last = t.slice(n - 1).to_batches()[0]


# ---- the operator -----------------------------------------------------------------------------------------------


def _united(found: Column) -> Column:
    """An array of (first, last) with those that touch or overlap joined, so that a run repeated suffix by suffix is one entry."""

    def step(done, m):
        end = F.try_element_at(done, F.lit(-1))
        longer = F.struct(end["first"].alias("first"), F.greatest(end["last"], m["last"]).alias("last"))
        return F.when(m["first"] <= end["last"] + 1, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(m)))

    return F.aggregate(F.array_sort(found), F.slice(found, 1, 0), step)


def text_id(text="text"):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def repeated_spans(docs: DataFrame, span: int = SPAN, token: int = TOKEN) -> DataFrame:
    """t1, t2, spans: for each distinct text (two halves of its MD5) with repeats, its suffixes [lo, hi] (as lo << 32 | hi) whose first ``span`` bytes also begin elsewhere.

    Suffixes with the same leading token (``anchors``) travel as runs; only tokens that occur twice can lead to a match.
    Of the runs with equal bytes (two 64-bit hashes) two are sorted for all, cut from two rows also where only copies of one
    text hold them: their bytes are range-partitioned by the token's bytes, with the splitters that Spark samples, and
    sorted bucket by bucket (``equal_suffixes``). Nothing else finds a repeat. A splitter is a whole token, so no equal pair
    lies across a boundary. Runs of a token with over LARGE of them come apart into suffixes, which are range-partitioned
    and sorted by all their bytes; so no token is held whole. Tokens and classes of runs are counted by partial sums.
    """
    halves = [F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), i, 16), 16, -10).cast("long") for i in (1, 17)]
    texts = docs.select(text_id().alias("text_id"), F.col("text").cast("string").alias("text"))
    runs_ = stored(texts.mapInArrow(_run_batches(span, token), _RUN), "suffix-runs")
    tokens = stored(runs_.groupBy("key").agg(F.sum("copies").alias("many")).filter("many > 1"), "suffix-tokens")
    found = stored(runs_.join(tokens.hint("shuffle_hash"), "key"), "suffix-found")
    place = F.struct("t1", "t2", "lo", "hi", "at")
    classes = found.groupBy("key", "seg", "seg2").agg(F.max("many").alias("many"), F.sum("copies").alias("copies"), F.min(place).alias("a"), F.max(place).alias("b"))
    two = classes.select("key", "seg", "seg2", (F.col("many") > LARGE).alias("large"), ((F.col("a") == F.col("b")) & (F.col("copies") > 1)).alias("twin"), F.explode(F.array_distinct(F.array("a", "b"))).alias("p"))
    wanted = two.groupBy("p.t1", "p.t2").agg(F.collect_list(F.struct("p.lo", "p.hi", "p.at", "key", "seg", "seg2", "large", "twin")).alias("wanted"))
    wanted = stored(wanted, "suffix-wanted")  # so that the join may split a text with very many copies
    own = docs.select(halves[0].alias("t1"), halves[1].alias("t2"), F.col("text").cast("string").alias("text"))
    cut = own.join(wanted.hint("shuffle_hash"), ["t1", "t2"])
    cut = stored(cut.mapInArrow(_cut(span, token), "lead binary, key long, seg long, seg2 long, t1 long, t2 long, lo long, copy long, first long, bytes binary"), "suffix-bytes")
    matched = cut.filter(F.length("lead") < span).repartitionByRange("lead").sortWithinPartitions("lead").mapInArrow(_sort_buckets(span), _MATCH)
    single = cut.filter(F.length("lead") == span).repartitionByRange("lead").sortWithinPartitions("lead", "t1", "t2", "lo", "copy").mapInArrow(_adjacent, _MATCH)
    same = matched.unionByName(single).groupBy("key", "seg", "seg2").agg(_united(F.collect_set(F.struct("first", "last"))).alias("of"))
    same = stored(same, "suffix-matches")  # so that the join may split a very common run
    # One row a run, whatever number of its suffixes is repeated.
    own_spans = F.transform("of", lambda m: F.shiftleft(F.col("lo") + m["first"], 32).bitwiseOR(F.col("lo") + m["last"]))
    places = found.join(same.hint("shuffle_hash"), ["key", "seg", "seg2"]).select("t1", "t2", own_spans.alias("spans"))
    return places.groupBy("t1", "t2").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, span: int = SPAN, token: int = TOKEN) -> DataFrame:
    """All columns of ``docs`` and n_bytes, n_removed, n_spans, kept (the bytes left).

    Each byte covered by a ``span``-byte string that also begins anywhere else in the corpus, in the same text too, is
    removed; all places of a repeat go. Texts are UTF-8 bytes, null is empty, and no match crosses rows. Repeated rows
    are copies of each other: all their bytes go if there are ``span`` or more. Texts under ``span`` bytes stay.
    Ids are not read. Input columns named n_bytes, n_removed, n_spans, kept are replaced; others come through, whatever
    their names. An empty table gives none.
    """
    new = ("n_bytes", "n_removed", "n_spans", "kept")
    names = [c for c in docs.columns if c not in new]
    spans = stored(repeated_spans(docs.select("text"), span, token), "suffix-spans").withColumnRenamed("t1", "s1").withColumnRenamed("t2", "s2")
    halves = [F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), i, 16), 16, -10).cast("long") for i in (1, 17)]
    rows = packed(docs.select(*[f"`{c}`" for c in names]), "text").select("text", OTHERS, halves[0].alias("t1"), halves[1].alias("t2"))
    rows = rows.join(spans.hint("shuffle_hash"), (F.col("t1") == F.col("s1")) & (F.col("t2") == F.col("s2")), "left").select("text", OTHERS, "spans")
    schema = T.StructType([*(rows.schema[c] for c in ("text", OTHERS)), *(T.StructField(c, T.LongType()) for c in new[:3]), T.StructField("kept", T.BinaryType())])

    def removed(batches):
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("spans"), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if not found.is_valid:
                    out.append((len(raw), 0, 0, raw))
                    continue
                v = found.values.to_numpy()
                a, b = runs(v >> 32, (v & 0xFFFFFFFF) + span)
                edges = [0, *np.stack((a, b), axis=1).ravel().tolist(), len(raw)]
                out.append((len(raw), int((b - a).sum()), len(a), b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))))
            kinds = [pa.int64()] * 3 + [pa.binary()]
            found = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column(OTHERS), *found], schema.names)

    found = rows.mapInArrow(removed, schema)
    return found.select(*[F.col("text") if c == "text" else F.col(f"{OTHERS}.`{c}`").alias(c) for c in names], *new)


def without_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """``docs`` with repeated bytes cut from the texts; characters of which a cut left a part go too. Texts of which nothing but white space is left, though something was cut, go.

    Null and empty texts stay as they are. Columns, and what others hold, as in ``docs``, whatever their names.
    """
    found = remove_repeats(packed(docs, "text"), span)
    text = F.when(F.col("n_removed") > 0, F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", "")).otherwise(F.col("text"))
    return unpacked(found.withColumn("text", text).filter((F.col("n_removed") == 0) | (F.trim("text") != "")), docs, "text")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of ``remove_repeats`` over all documents."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every start of a 200-byte string in every text, as hexadecimal digits.
SQL = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT row, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400),
r AS (SELECT row, i FROM (SELECT row, i, substr(h, 2 * i + 1, 400) AS s FROM p) QUALIFY count(*) OVER (PARTITION BY s) > 1),
n AS (SELECT row, i, CASE WHEN i <= lag(i) OVER (PARTITION BY row ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT row, i, sum(fresh) OVER (PARTITION BY row ORDER BY i) AS span FROM n),
s AS (SELECT row, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY row, span),
t AS (SELECT row, a, b, coalesce(lag(b) OVER (PARTITION BY row ORDER BY a), 0) AS z FROM s),
k AS (
  SELECT row, h, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(h, 2 * max(b) + 1) AS kept
  FROM t JOIN d USING (row) GROUP BY row, h)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, d.h))) AS kept_sha256
FROM d LEFT JOIN k USING (row)
"""

QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES = {"op1_suffix_dedup": SQL}
