"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components, local_labels
from .shared import LOWER_BYTES, packed, stored, table, unpacked, whole_groups
from .textbytes import flat, mixed, parts, prefix_sums, span_hash, words

#: Bits of a half's blocks: a perfect Golay code, a perfect Hamming code and single bits (a code of radius 0).
BLOCKS = (23, 7, 1, 1)
SEED = 42


# ---- fingerprints -----------------------------------------------------------------------------------------------


def fingerprint(text: str | None, k: int = 3) -> int:
    """64 bits: bit b is 1 if it is set in over half of the XXH64 values of the text's ``k``-word shingles, repeats included.

    A-Z in lower case; words lie between ASCII white space. Fewer than ``k`` words: one shingle of them all; no word or
    null: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -k] + 1))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)])
    n = len(raw) // 8
    counts = np.zeros(64, np.int64)
    rows = np.frombuffer(raw, np.uint8).reshape(n, 8)
    for i in range(0, n, 8192):
        counts += np.unpackbits(rows[i : i + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    kind = docs.schema["doc_id"].dataType

    def rows(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, k) for t in map(pa.StringScalar.as_py, batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(rows, f"doc_id {kind.simpleString()}, fp long")


# ---- the covering code ------------------------------------------------------------------------------------------

GOLAY_POLY = 0b101011100011  # x^11+x^9+x^7+x^6+x^5+x+1 generates the perfect [23,12] code of radius 3
HAMMING_POLY = 0b1011  # x^3+x+1 generates the perfect [7,4] code of radius 1


def _remainder(words: np.ndarray, poly: int, n: int) -> np.ndarray:
    """Remainders (syndromes) of polynomials of degree below ``n``, divided by ``poly``."""
    top = poly.bit_length() - 1
    left = words.astype(np.uint32).copy()
    for bit in range(n - 1, top - 1, -1):
        left ^= np.where((left >> np.uint32(bit)) & 1, np.uint32(poly << (bit - top)), np.uint32(0))
    return left


def _leaders(n: int, poly: int, radius: int) -> np.ndarray:
    """The error of least weight for each syndrome."""
    table = np.zeros(1 << (poly.bit_length() - 1), np.uint32)
    errors = [sum(1 << i for i in c) for w in range(radius, -1, -1) for c in itertools.combinations(range(n), w)]
    e = np.array(errors, np.uint32)
    table[_remainder(e, poly, n)] = e
    return table


_CODES = {23: (GOLAY_POLY, _leaders(23, GOLAY_POLY, 3)), 7: (HAMMING_POLY, _leaders(7, HAMMING_POLY, 1))}


def nearest(words: np.ndarray, n: int) -> np.ndarray:
    """The codeword nearest to each word of a block of ``n`` bits."""
    if n not in _CODES:
        return words
    poly, leaders = _CODES[n]
    return words ^ leaders[_remainder(words, poly, n)]


def home(halves: np.ndarray) -> np.ndarray:
    """The anchor of each 32-bit word: its blocks' nearest codewords side by side."""
    out, shift = np.zeros_like(halves), 0
    for n in BLOCKS:
        out |= nearest((halves >> np.uint32(shift)) & np.uint32((1 << n) - 1), n) << np.uint32(shift)
        shift += n
    return out


def replicas(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, anchor) of every anchor that is home to a word at most one bit away: those within the covering radius plus one that can matter."""
    own = home(halves)
    index, anchor = [np.arange(len(halves))], [own]
    for bit in range(32):
        other = home(halves ^ np.uint32(1 << bit))
        new = np.flatnonzero(other != own)
        index.append(new)
        anchor.append(other[new])
    key = np.unique(np.concatenate(index).astype(np.uint64) << np.uint64(32) | np.concatenate(anchor).astype(np.uint64))
    return (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)


# ---- links ------------------------------------------------------------------------------------------------------


def _pairs(fp: np.ndarray, group: np.ndarray, is_home: np.ndarray, bits: int, block: int = 2_000_000):
    """Links between homes and all members of the same group (sorted), in blocks of at most about ``block`` comparisons."""
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(group)])))
    h = np.flatnonzero(is_home)
    of = np.searchsorted(starts, h, side="right") - 1
    many = sizes[of]
    at = 0
    total = np.cumsum(many)
    while at < len(h):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + block, side="right")))
        n = many[at:end]
        left = np.repeat(h[at:end], n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[of[at:end]], n)
        near = (np.bitwise_count(fp[left] ^ fp[right]) <= bits) & (fp[left] != fp[right])
        yield fp[left[near]], fp[right[near]]
        at = end


def links(fps: DataFrame, bits: int = 3, large: int = 4096) -> DataFrame:
    """Links (a, b) that connect exactly the distinct values of ``fp`` which differ in ``bits`` (3 at most) or fewer bits.

    Of the two 32-bit halves of a linked pair one differs in at most one bit. So per half, anchors are the words of a
    covering code (blocks of 23 bits, radius 3; 7 bits, radius 1; and 2 free bits: 2^18 anchors). A value is at home at
    its nearest anchor and replicated to each anchor within the covering radius plus one that can be home to a value
    one bit away (about 11 a half). At each anchor homes are compared with all members.

    Members are counted by anchor first, at most 2^19 rows. An anchor with over ``large`` members is dealt out by the four
    bytes of the other half too, one of which is equal in any linked pair, so that it takes 1024 keys; what an anchor
    holds thus needn't grow with the data. Each task keeps a spanning set of the links it finds, so a dense group gives
    about as many links as it has members.
    """

    def spread(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for half in (0, 1):
                word = (fp >> np.uint64(32 * half)).astype(np.uint32)
                i, anchor = replicas(word)
                key = (anchor.astype(np.int64) << 1) | half
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[i].view(np.int64)), pa.array(home(word)[i] == anchor)], ["anchor", "fp", "home"])

    def compare(batches):
        for t in whole_groups(batches, "key", 100_000):
            group = t.column("key").to_numpy()
            fp = t.column("fp").to_numpy().view(np.uint64)
            found = [local_labels(a, b) for a, b in _pairs(fp, group, t.column("home").to_numpy(), bits)]
            a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64),) * 2
            a, b = local_labels(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    members = fps.select("fp").mapInArrow(spread, "anchor long, fp long, home boolean")
    full = stored(members.groupBy("anchor").count().filter(F.col("count") > large).select("anchor", F.lit(True).alias("full")), "anchors-full")
    other = F.when(F.col("anchor") % 2 == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp"))
    slots = F.array(*[F.lit(1 + 256 * k) + F.shiftrightunsigned(other, 8 * k).bitwiseAND(255) for k in range(4)])
    dealt = members.join(F.broadcast(full), "anchor", "left")  # 2^19 anchors at most
    dealt = dealt.select("fp", "home", "anchor", F.explode(F.when(F.col("full"), slots).otherwise(F.array(F.lit(0).cast("long")))).alias("slot"))
    dealt = dealt.select((F.col("anchor") * 2048 + F.col("slot")).alias("key"), "fp", "home")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, bits: int = 3, k: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row.

    Equal fingerprints are one node, so exact copies cost one row. Null and empty texts have fingerprint 0 and link like
    any other. Rows with a null doc_id get the component of the others that they link to, null if there is none.
    Repeated rows each give a row; an empty table gives none.
    """
    fps = stored(fingerprints(docs, k), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    labels = components(stored(links(nodes, bits), "fingerprint-links"))  # node, label
    joined = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = joined.join(least, "label").select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(classes, fps["fp"] == classes["_fp"], "left").select("doc_id", "fp", "component_id")


# ---- near-duplicates by shingles --------------------------------------------------------------------------------

#: Shingles (and 100 more for each document) that a task of the exact comparison holds of one block at most.
BLOCK = 500_000


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, A-Z in lower case."""
    data, offsets = flat(texts)
    found, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in parts(offsets):
        low = np.frombuffer(LOWER_BYTES, np.uint8)[data[offsets[i] : offsets[j]]]
        start, end, row = words(low, offsets[i : j + 1] - offsets[i])
        if len(start):
            found.append(span_hash(prefix_sums(low), start, end))
            rows.append(row + i)
    return np.concatenate(found), np.concatenate(rows)


def _nodes(batches):
    """_row, node (hash of the word sequence) and fp (``fingerprint``) of the texts with a word."""
    for batch in batches:
        h, row = _word_hashes(batch.column("text"))
        many = np.bincount(row, minlength=batch.num_rows)
        full = np.flatnonzero(many)
        first = np.cumsum(many) - many
        place = np.arange(len(h)) - np.repeat(first, many)
        node = np.add.reduceat(mixed(h + mixed(place.astype(np.uint64) + np.uint64(1))), first[full]) if len(full) else np.zeros(0, np.uint64)
        texts = batch.column("text").take(pa.array(full))
        fp = np.array([fingerprint(t) for t in map(pa.StringScalar.as_py, texts)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(full)), pa.array(node.view(np.int64)), pa.array(fp)], ["_row", "node", "fp"])


def _shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles (of all words where there are fewer)."""
    h, row = _word_hashes(texts)
    many = np.bincount(row, minlength=len(texts))
    first = np.cumsum(many) - many
    out = []
    for i in range(len(texts)):
        w = h[first[i] : first[i] + many[i]]
        size = min(k, len(w))
        s = np.zeros(len(w) - size + 1, np.uint64)
        for t in range(size):
            s = mixed(s * np.uint64(31) + w[t : t + len(s)])
        out.append(np.unique(s))
    return out


def _overlap(n: int, least: float) -> int:
    """Shingles that a set of ``n`` has in common with any other of similarity ``least`` or more, at least."""
    return max(1, math.ceil(least * n - 1e-9))


def _shared(n: int, least: float) -> int:
    """Shingles that two such sets share among those that ``_samples`` takes; the lesser of the two sets' numbers holds."""
    return min(n // 10 + 1, _overlap(n, least))


def _samples(k: int, least: float):
    """hash, node, n and shared of each text's least shingles.

    Of two sets with an overlap of o, the first m common shingles in any order are among the first n - o + m of both. So
    the least n - overlap + shared by hash of each text hold ``shared`` common ones, as few as a partner of least size has.
    """

    def rows(batches):
        for batch in batches:
            sets = _shingles(batch.column("text"), k)
            n = np.array([len(s) for s in sets], np.int64)
            taken = [s[: len(s) - _overlap(len(s), least) + _shared(len(s), least)] for s in sets]
            many = np.array([len(s) for s in taken], np.int64)
            shared = np.array([_shared(_overlap(int(x), least), least) for x in n], np.int32)
            h = np.concatenate([np.zeros(0, np.uint64), *taken]).view(np.int64)
            at = np.repeat(np.arange(len(sets)), many)
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column("node").take(pa.array(at)), pa.array(n.astype(np.int32)[at]), pa.array(shared[at])], ["hash", "node", "n", "shared"])

    return rows


def alike(sets: list[np.ndarray], least: float, block: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of sets of similarity ``least`` or more that connect all such pairs; where there are two blocks, pairs across them only.

    In order of size each set is compared with the smaller ones that share one of its rarest shingles, unless they are
    connected already.
    """
    many = np.array([len(s) for s in sets], np.int64)
    _, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ids = np.split(ids, np.cumsum(many)[:-1])
    across = bool((block != block[0]).any())
    label = np.arange(len(sets))
    mark = np.zeros(len(df), np.bool_)
    held: dict[int, list[int]] = {}
    out = []
    for x in np.argsort(many, kind="stable").tolist():
        own, n = ids[x], int(many[x])
        rare = own[np.lexsort((own, df[own]))[: n - _overlap(n, least) + 1]]
        rare = rare[df[rare] > 1].tolist()
        near = set().union(*(held[t] for t in rare if t in held))
        if near:
            near = np.fromiter(near, np.int64, len(near))
            near = near[(many[near] >= _overlap(n, least)) & ((block[near] != block[x]) | (not across))]
            mark[own] = True
            while len(near := near[label[near] != label[x]]):
                y, near = int(near[0]), near[1:]
                common = int(np.count_nonzero(mark[ids[y]]))
                if common >= least * (n + int(many[y]) - common):
                    out.append((x, y))
                    label[label == label[x]] = label[y]
            mark[own] = False
        for t in rare:
            held.setdefault(t, []).append(x)
    return out


def _compare(k: int, least: float):
    def rows(batches):
        for t in whole_groups(batches, "task", 1):
            task = t.column("task").to_numpy()
            starts = [*np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1]))).tolist(), len(task)]
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                part = t.slice(i, j - i)
                node = part.column("node").to_numpy()
                pairs = alike(_shingles(part.column("text").combine_chunks(), k), least, part.column("block").to_numpy())
                a, b = np.array(pairs, np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return rows


#: Texts whose number is a multiple of this tell which shingles are common.
ONE_IN = 64
#: A shingle in more than this part of these texts, and in two at least, is common.
COMMON = 1_000


def common_shingles(few: DataFrame, n: int, k: int, least: float) -> DataFrame:
    """hash of the shingles that more than one in COMMON of ``few``, ``n`` texts, have: at most COMMON times a text's own number of them."""
    found = few.mapInArrow(_samples(k, least), "hash long, node long, n int, shared int").groupBy("hash").agg(F.count("*").alias("c"))
    return stored(found.filter(F.col("c") > max(1, n // COMMON)).select("hash", F.lit(True).alias("common")), "shingle-common")


def print_candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect the nodes (node, fp) whose fingerprints differ in three bits or fewer, by ``links``; those of one fingerprint by their least."""
    heads = stored(nodes.groupBy("fp").agg(F.min("node").alias("head")), "print-heads")
    near = stored(links(heads), "print-links")
    first, second = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}")) for c in ("a", "b"))
    across = near.join(first, "a").join(second, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    within = nodes.join(heads, "fp").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return across.unionByName(within)


def shingle_candidates(rarest: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that connect the nodes which meet in one of their rarest shingles (hash, n, node) and differ little enough in size."""
    by_size = Window.partitionBy("hash").orderBy("n", "node")
    near = F.coalesce(F.lag("n").over(by_size) >= F.col("n") * least - 1e-9, F.lit(False))
    chain = rarest.select("hash", "n", "node", near.alias("near"))
    head = F.last(F.when(~F.col("near"), F.col("node")), ignorenulls=True).over(by_size)  # stars instead of long paths
    return chain.select("node", head.alias("head"), "near").filter("near").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()


def shingle_links(texts: DataFrame, k: int = 5, least: float = 0.8, most: int = BLOCK, common: DataFrame | None = None, also: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that connect exactly the nodes of ``texts`` (node, text; each node once) with sets of ``k``-word shingles of similarity ``least`` or more.

    Exact: each text gives about three tenths of its shingles, the least by hash, of which two similar texts share about
    a twelfth of their sizes (``_samples``). A text with too many shingles there that no other text gives is similar to
    none. Of the rest, the rarest of each text but as many as are shared hold a common one. Texts that meet in one and
    differ little enough in size are connected to candidates, and all texts of a connected set of candidates are compared
    in one task (``alike``). Sets over ``most`` are cut by size into blocks, and each two blocks whose sizes allow it
    are compared in a task of their own, so a task holds two blocks at most.

    How rare a shingle is only has to put all shingles in one order. Those of ``common`` (hash, common), which surely
    occur twice, come last in it without being counted, so their rows needn't meet; results don't depend on what it holds.

    The pairs (a, b) of ``also``, those of ``print_candidates``, are candidates too, but for texts that are similar to none.
    """
    sampled = texts.mapInArrow(_samples(k, least), "hash long, node long, n int, shared int")
    sampled = sampled.withColumn("common", F.lit(False)) if common is None else sampled.join(common, "hash", "left")
    known = F.coalesce("common", F.lit(False))
    count = F.count("*").over(Window.partitionBy("hash", F.when(known, F.col("node"))))
    met = sampled.withColumn("c", F.when(known, F.lit((1 << 63) - 1)).otherwise(count)).filter("c > 1")
    rarest = met.groupBy("node").agg(F.first("n").alias("n"), F.first("shared").alias("shared"), F.sort_array(F.collect_list(F.struct("c", "hash"))).alias("found")).filter(F.size("found") >= F.col("shared"))
    rarest = rarest.select("node", "n", F.explode(F.slice("found", F.lit(1), F.size("found") - F.col("shared") + 1)).alias("s")).select("node", "n", "s.hash")
    rarest = stored(rarest, "shingle-rarest")
    met_in = shingle_candidates(rarest, least)
    labels = components(stored(met_in if also is None else met_in.unionByName(also), "shingle-candidates"))
    sets = labels.select("node", "label").unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
    sets = sets.join(rarest.select("node", "n").distinct(), "node")
    upto = F.sum(F.col("n").cast("long") + 100).over(Window.partitionBy("label").orderBy("n", "node").rowsBetween(Window.unboundedPreceding, -1))
    sets = stored(sets.withColumn("block", F.floor(F.coalesce(upto, F.lit(0)) / most).cast("long")), "shingle-sets")
    blocks = stored(sets.groupBy("label", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "shingle-blocks")
    two = blocks.alias("i").join(blocks.alias("j"), F.col("i.label") == F.col("j.label")).filter("i.block <= j.block").filter(F.col("j.lo") * least - 1e-9 <= F.col("i.hi"))
    two = two.select(F.col("i.label").alias("label"), F.xxhash64("i.label", "i.block", "j.block").alias("task"), F.explode(F.array_distinct(F.array("i.block", "j.block"))).alias("block"))
    sent = texts.join(sets.select("node", "label", "block").hint("shuffle_hash"), "node").join(two, ["label", "block"]).select("task", "block", "node", "text")
    return sent.repartition("task").sortWithinPartitions("task").mapInArrow(_compare(k, least), "a long, b long")


def one_of_each(docs: DataFrame, k: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of smallest doc_id; all columns.

    Texts with equal word sequences are one node. Nodes whose sets of ``k``-word shingles have a similarity
    (intersection by union) of ``least`` or more are linked, and groups are connected over links. What may be linked comes
    from the fingerprints within three bits of each other, found by anchor points (``print_candidates``), and from rare
    shingles that texts have in common (``shingle_links``); an exact comparison follows for both.

    Exactly one row of a group stays, also where rows repeat a doc_id or have none; null ids come last. Documents
    without a word, null ones too, are no copies of each other and stay. An empty table gives none. Columns, and what
    they hold, as in ``docs``, whatever their names.

    Fingerprints alone would miss many: at a similarity of 0.8 they differ in about ten of 64 bits. The shingles provide for these.
    """
    rows = stored(packed(docs, "doc_id", "text").withColumn("_row", F.monotonically_increasing_id()), "shingle-rows")
    texts = rows.select("_row", F.col("text").cast("string").alias("text"))
    prints = stored(texts.mapInArrow(_nodes, "_row long, node long, fp long"), "shingle-prints")
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    nodes = stored(prints.join(rows.select("_row", "doc_id"), "_row").groupBy("node").agg(F.min(rank).alias("least"), F.min("fp").alias("fp")), "shingle-nodes")
    unique = texts.join(nodes.select("node", F.col("least._row").alias("_row")).hint("shuffle_hash"), "_row").select("node", "text")
    few = nodes.filter(F.pmod("node", F.lit(ONE_IN)) == 0).select("node", F.col("least._row").alias("_row"))
    common = common_shingles(texts.join(few, "_row").select("node", "text"), few.count(), k, least)
    labels = components(stored(shingle_links(unique, k, least, common=common, also=print_candidates(nodes.select("node", "fp"))), "shingle-links"))
    labelled = nodes.join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "least", F.coalesce("label", "node").alias("label"))
    first = labelled.groupBy("label").agg(F.min("least").alias("kept"))
    kept = labelled.join(first, "label").select("node", F.col("kept._row").alias("kept"))
    gone = stored(prints.join(kept, "node").filter("_row <> kept").select("_row"), "shingle-gone")
    return unpacked(rows.join(gone, "_row", "left_anti"), docs, "doc_id", "text")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of ``near_duplicates`` over all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLES: dict = {}
