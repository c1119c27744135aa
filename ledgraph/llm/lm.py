"""Language-model scores by deleted interpolation of n-gram estimates."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER_BYTES, crc_mod, stored, table, whole_groups
from .textbytes import flat, mixed, parts, prefix_sums, span_hash, words

LOWER = np.frombuffer(LOWER_BYTES, np.uint8)
END = np.uint64(0xE0D)  # the hash that stands for the end token
START = np.uint64(0x57A27)  # the context of a text's first token
#: Tokens of a block of documents that one task holds at once.
BLOCK_TOKENS = 1_500_000
#: Up to so many hash ranges a block asks each of them in one row; beyond that counts travel in two steps.
MOST_RANGES = 4096
#: Contexts are pooled by the bit length of their count: CLASSES buckets.
CLASSES = 64
#: Log ratios of estimates to the uniform one are binned for EM: half octaves, from 2^-512 to 2^511, which holds all doubles that counts can give.
BIN_WIDTH, BIN_BITS, MIDDLE = 0.5, 11, 1024


# ---- packed numbers ---------------------------------------------------------------------------------------------


def packed(x: np.ndarray) -> bytes:
    """Whole numbers, byte planes one after another, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys, as differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, np.uint64), dtype=np.uint64)


# ---- blocks: documents as places in a sorted list of distinct words ---------------------------------------------


def token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's closed by END, and the number per text."""
    n = len(offsets) - 1
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in parts(offsets):
        low = LOWER[data[offsets[i] : offsets[j]]]
        start, end, row = words(low, offsets[i : j + 1] - offsets[i])
        if len(start):
            hashes.append(span_hash(prefix_sums(low), start, end))
            rows.append(row + i)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    counts = np.bincount(r, minlength=n) + 1
    out = np.empty(int(counts.sum()), np.uint64)
    last = np.cumsum(counts) - 1
    body = np.ones(len(out), np.bool_)
    body[last] = False
    out[body] = h
    out[last] = END
    return out, counts


def contexts(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token before each token, START at a text's first."""
    before = np.concatenate(([START], tokens[:-1])).astype(np.uint64)
    before[np.cumsum(counts) - counts] = START
    return before


def pair_hash(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mixed(mixed(context) + token)


def _blocks(batches):
    """Batches to blocks of about BLOCK_TOKENS tokens: token hashes, tokens per row, ids, training flags."""
    held, size = [], 0
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for i, j in parts(offsets, BLOCK_TOKENS * 3):
            tokens, counts = token_stream(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            held.append((tokens, counts, batch.slice(i, j - i)))
            size += len(tokens)
            if size >= BLOCK_TOKENS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _encode(batches):
    """One row per block: the block's id, its distinct words (sorted hashes) and its tokens as places among them."""
    for held in _blocks(batches):
        tokens = np.concatenate([x[0] for x in held])
        counts = np.concatenate([x[1] for x in held])
        rows = pa.Table.from_batches([x[2] for x in held]).combine_chunks()
        ids = rows.column("doc_id").combine_chunks()
        learn = rows.column("learn").to_numpy().astype(np.uint8)
        known, place = np.unique(tokens, return_inverse=True)
        own = int.from_bytes(os.urandom(8), "big") >> 1  # the blocks are written before anything reads the id
        yield pa.RecordBatch.from_arrays(
            [pa.array([own]), pa.array([packed_keys(known)], pa.binary()), pa.array([packed(place.astype(np.uint32))], pa.binary()), pa.array([packed(counts.astype(np.int32))], pa.binary()), pa.array([packed(learn)], pa.binary()), pa.array([ids.to_pylist()], pa.list_(ids.type))],
            ["block", "words", "tokens", "counts", "learn", "ids"],
        )


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, token places, tokens per text, is each token a training token)."""
    known = unpacked_keys(row["words"])
    place = unpacked(row["tokens"], np.uint32).astype(np.int64)
    counts = unpacked(row["counts"], np.int32).astype(np.int64)
    learn = np.repeat(unpacked(row["learn"], np.uint8) > 0, counts)
    return known, place, counts, learn


def _ask(keys: np.ndarray, n: np.ndarray, block: int, ranges: int, within: range | None = None, kind: type = np.int32):
    """A row per hash range (``ranges`` is a power of two), of those ``within`` which all keys lie: sorted keys and the training tokens of each in the block."""
    within = within or range(ranges)
    edges = np.arange(within.start + 1, within.stop, dtype=np.uint64) << np.uint64(65 - ranges.bit_length())
    ends = np.searchsorted(keys, edges, side="left").tolist()
    for part, a, b in zip(within, [0, *ends], [*ends, len(keys)], strict=True):
        if b > a:
            yield part, block, packed_keys(keys[a:b]), packed(n[a:b].astype(kind))


_ASK = "part int, block long, keys binary, n binary"


def _ask_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "block", "keys", "n"])


def _ask_words(ranges: int):
    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                known, place, _, learn = _opened(row)
                yield _ask_batch(list(_ask(known, np.bincount(place[learn], minlength=len(known)), row["block"], ranges)))

    return rows


def _pairs(known: np.ndarray, place: np.ndarray, counts: np.ndarray) -> np.ndarray:
    tokens = known[place]
    return pair_hash(contexts(tokens, counts), tokens)


def _ask_pairs(ranges: int):
    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                known, place, counts, learn = _opened(row)
                keys, at = np.unique(_pairs(known, place, counts), return_inverse=True)
                yield _ask_batch(list(_ask(keys, np.bincount(at[learn], minlength=len(keys)), row["block"], ranges)))

    return rows


def _answer(kind: type):
    """All rows of a hash range together: per block the counts over all blocks, in the order of its keys. ``kind`` is that of the packed counts."""

    def answered(batches):
        for t in whole_groups(batches, "part", 1):
            rows = t.to_pylist()
            # Small key ranges one after another, so that no more than a share of the range is open at once.
            opened = [(unpacked_keys(r["keys"]), unpacked(r["n"], kind)) for r in rows]
            total = sum(len(k) for k, _ in opened)
            steps = max(1, total // 4_000_000)
            low, high = min(int(k[0]) for k, _ in opened), max(int(k[-1]) for k, _ in opened) + 1
            found = [[] for _ in rows]
            types = tokens = 0
            for s in range(steps):
                edges = np.array([low + (high - low) * s // steps, low + (high - low) * (s + 1) // steps - 1], np.uint64)
                cut = [slice(int(np.searchsorted(k, edges[0])), int(np.searchsorted(k, edges[1], side="right"))) for k, _ in opened]
                keys = np.concatenate([k[c] for (k, _), c in zip(opened, cut, strict=True)])
                n = np.concatenate([v[c] for (_, v), c in zip(opened, cut, strict=True)]).astype(np.int64)
                order = np.argsort(keys, kind="stable")
                group = np.cumsum(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) - 1 if len(keys) else order
                sums = np.bincount(group, weights=n[order]).astype(np.int64) if len(keys) else n
                types, tokens = types + int((sums > 0).sum()), tokens + int(sums.sum())
                back = np.empty(len(keys), np.int64)
                back[order] = sums[group] if len(keys) else sums
                at = 0
                for f, c in zip(found, cut, strict=True):
                    f.append(back[at : at + c.stop - c.start])
                    at += c.stop - c.start
            blobs = [packed(np.concatenate(f)) for f in found]
            k = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r["part"] for r in rows], pa.int32()), pa.array([r["block"] for r in rows], pa.int64()), pa.array(blobs, pa.binary()), pa.array([types] + [0] * (k - 1), pa.int64()), pa.array([tokens] + [0] * (k - 1), pa.int64())], ["part", "block", "found", "types", "tokens"])

    return answered


_ANSWER = "part int, block long, found binary, types long, tokens long"


def coarse_ranges(ranges: int) -> int:
    """The hash ranges that a block asks, itself a power of two: all, or about the root of their number beyond MOST_RANGES."""
    return ranges if ranges <= MOST_RANGES else 1 << (ranges.bit_length() // 2)


def _by(batches, key: str):
    """Lists of all rows that share ``key``, from batches sorted by it."""
    for t in whole_groups(batches, key, 1):
        held: dict = {}
        for r in t.to_pylist():
            held.setdefault(r[key], []).append(r)
        yield from held.values()


def _merged(coarse: int, ranges: int):
    """The rows of one side's blocks for one coarse range to a row per fine range in it: their distinct keys and summed counts, with the side as block."""
    fine = ranges // coarse

    def rows(batches):
        for asked in _by(batches, "at"):
            keys, at = np.unique(np.concatenate([unpacked_keys(r["keys"]) for r in asked]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([unpacked(r["n"], np.int32) for r in asked]), minlength=len(keys))
            first = asked[0]["part"] * fine
            yield _ask_batch(list(_ask(keys, n, asked[0]["at"] // coarse, ranges, range(first, first + fine), np.int64)))

    return rows


def _looked_up(batches):
    """One side's keys with their counts in one coarse range, and its blocks' keys there: per block the counts, in the order of its keys."""
    for rows in _by(batches, "at"):
        known = sorted((r for r in rows if r["found"] is not None), key=lambda r: r["part"])
        keys = np.concatenate([unpacked_keys(r["keys"]) for r in known])
        counts = np.concatenate([unpacked(r["found"], np.int64) for r in known])
        asked = [r for r in rows if r["found"] is None]
        found = [packed(counts[np.searchsorted(keys, unpacked_keys(r["keys"]))]) for r in asked]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["part"] for r in asked], pa.int32()), pa.array([r["block"] for r in asked], pa.int64()), pa.array(found, pa.binary())], ["part", "block", "found"]
        )


def _grouped(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key)


def in_one_step(asked: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(part, block and found of every asked row, types and tokens by range): every range holds rows of all blocks."""
    found = stored(_grouped(asked, "part").mapInArrow(_answer(np.int32), _ANSWER), label)
    return found, found


def in_two_steps(asked: DataFrame, coarse: int, ranges: int, label: str) -> tuple[DataFrame, DataFrame]:
    """As ``in_one_step``, for blocks that asked ``coarse`` ranges only.

    Blocks are dealt to ``ranges / coarse`` sides. A side's rows for a coarse range are merged and split by the fine ranges
    in it; the counts of all sides are summed by fine range, go back to the sides, and from these to their blocks. With
    B blocks and as many ranges these are about 3 B^1.5 rows instead of B^2, and no task holds more than about a block's entries.
    """
    sides = fine = ranges // coarse
    asked = stored(asked.withColumn("at", F.pmod("block", F.lit(sides)) * coarse + F.col("part")), f"{label}-asked")
    merged = stored(_grouped(asked, "at").mapInArrow(_merged(coarse, ranges), _ASK), f"{label}-merged")
    answers = stored(_grouped(merged, "part").mapInArrow(_answer(np.int64), _ANSWER), f"{label}-answers")
    own = (F.col("block") * coarse + F.floor(F.col("part") / fine)).alias("at")
    known = merged.join(answers, ["part", "block"]).select(own, "part", "block", "keys", "found")
    both = known.unionByName(asked.select("at", "part", "block", "keys", F.lit(None).cast("binary").alias("found")))
    return stored(_grouped(both, "at").mapInArrow(_looked_up, "part int, block long, found binary"), label), answers


def _counts_of(row: dict, kind: str) -> np.ndarray:
    return np.concatenate([unpacked(x["found"], np.int64) for x in sorted(row[kind], key=lambda x: x["part"])])


# ---- mixture ----------------------------------------------------------------------------------------------------


def context_class(count: np.ndarray) -> np.ndarray:
    """Bit length of the context's training count; 0: never seen."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], CLASSES - 1).astype(np.int64)


def _estimates(row: dict, texts: int):
    """(tokens per text, is each a training token, context count, pair count, word count)."""
    known, place, counts, learn = _opened(row)
    w = _counts_of(row, "word_counts")[place]
    _, at = np.unique(_pairs(known, place, counts), return_inverse=True)
    pair = _counts_of(row, "pair_counts")[at]
    c = np.concatenate(([0], w[:-1]))
    c[np.cumsum(counts) - counts] = texts  # START stands before every training text
    return counts, learn, c, pair, w


def ratio_bin(ratio: np.ndarray) -> np.ndarray:
    """0: none; else the bin of log2 of a ratio to the uniform estimate."""
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, np.round(np.log2(np.maximum(ratio, 1e-300)) / BIN_WIDTH) + MIDDLE, 0).astype(np.int64)


def cell(context: np.ndarray, two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """A context class and the bins of the pair's and the word's estimate as one number."""
    return (context << (2 * BIN_BITS)) | (two << BIN_BITS) | one


def _histogram(texts: int, total: int, distinct: int):
    """Held-out counts: with each training token taken out of the counts in turn, tokens by context class and binned log ratios of estimates."""

    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, learn, c, pair, w = _estimates(row, texts)
                c, pair, w = c[learn] - 1, pair[learn] - 1, w[learn] - 1
                two = np.where(c > 0, pair / np.maximum(c, 1), 0.0)
                one = w / max(total - 1, 1)
                k, n = np.unique(cell(context_class(c), ratio_bin(two * (distinct + 1)), ratio_bin(one * (distinct + 1))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["cell", "n"])

    return rows


def mixture_weights(cells: np.ndarray, n: np.ndarray, rounds: int = 200, tolerance: float = 1e-7) -> np.ndarray:
    """Per context class the weights of the pair, word and uniform estimates, by expectation-maximisation on the binned held-out counts.

    A class without counts takes the weights of all classes together; unseen contexts have no pair estimate.
    """
    order = np.argsort(cells)  # so that sums, and with them the weights, don't depend on the order of arrival
    cells, n = cells[order], n[order]
    mask = (1 << BIN_BITS) - 1
    k, two, one = cells >> (2 * BIN_BITS), (cells >> BIN_BITS) & mask, cells & mask
    ratio = lambda b: np.where(b > 0, np.exp2((b - float(MIDDLE)) * BIN_WIDTH), 0.0)
    p = np.stack((ratio(two), ratio(one), np.ones(len(k))), axis=1)

    def em(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            new = (share * n[:, None]).sum(axis=0) + np.array([0, 1e-3, 1e-3])
            new /= new.sum()
            if np.abs(new - w).max() < tolerance:
                return new
            w = new
        return w

    every = em(p, n) if len(k) else np.array([0.0, 0.5, 0.5])
    out = np.stack([em(p[k == c], n[k == c]) if (k == c).any() else every for c in range(CLASSES)])
    out[0] = [0, *(out[0, 1:] / max(out[0, 1:].sum(), 1e-12))]
    return out


def _score(texts: int, total: int, distinct: int, weights: np.ndarray):
    def rows(batches):
        for batch in batches:
            for row in batch.to_pylist():
                counts, learn, c, pair, w = _estimates(row, texts)
                lam = weights[context_class(c)]
                p = lam[:, 0] * pair / np.maximum(c, 1) + lam[:, 1] * w / max(total, 1) + lam[:, 2] / (distinct + 1)
                first = np.cumsum(counts) - counts
                base = np.log10((w + 1) / (total + distinct + 1))
                ids = pa.array(row["ids"], batch.schema.field("ids").type.value_type)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts), pa.array(np.add.reduceat((w > 0).astype(np.int64), first)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first))], ["doc_id", "n_tokens", "n_known", "base_score", "score"]
                )

    return rows


def score_texts(docs: DataFrame, learn) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; learned from the rows where the column ``learn`` holds.

    Tokens: words (A-Z in lower case) and one end per text. score: log10 of the product over tokens of
    w2 c(v t)/c(v) + w1 c(t)/N + w0/(V + 1), v the token before (the first token's is a start), with weights by the size
    class of c(v). base_score: add-one unigrams. All counts cover all training rows and tokens are known by 64-bit hashes.

    Documents are encoded in blocks. Each block asks for the training counts of its distinct words, then of its distinct
    pairs, in one row per hash range, and gets them back in the same order; so a frequent word costs one entry a block.
    Beyond MOST_RANGES ranges this goes in two steps (``in_two_steps``), with the same counts.
    Weights are learned from held-out counts: each training token is taken out of all counts in turn, and a table
    whose size is bounded (context class by binned estimates) goes to the driver.

    Nulls: a null text is empty and has the end only; null doc_ids stay null. Repeated rows count and score each. With
    no training rows the score is uniform. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    blocks = stored(rows.mapInArrow(_encode, f"block long, words binary, tokens binary, counts binary, learn binary, ids array<{kind}>"), "lm-blocks")
    texts = rows.filter("learn").count()

    # As many hash ranges as blocks, so that a range holds about as many entries as a block, whatever the input's size.
    ranges = 1 << max(4, (blocks.count() - 1).bit_length())

    coarse = coarse_ranges(ranges)

    def counted(ask, label):
        asked = blocks.select("block", "words", "tokens", "counts", "learn").mapInArrow(ask(coarse), _ASK)
        return in_one_step(asked, label) if coarse == ranges else in_two_steps(asked, coarse, ranges, label)

    found, sums = counted(_ask_words, "lm-words")
    distinct, total = sums.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    pairs, _ = counted(_ask_pairs, "lm-pairs")

    def answers(df, name):
        return df.groupBy("block").agg(F.collect_list(F.struct("part", "found")).alias(name))

    full = blocks.join(answers(found, "word_counts"), "block").join(answers(pairs, "pair_counts"), "block")
    table_ = full.mapInArrow(_histogram(texts, total, distinct), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # CLASSES * 4^BIN_BITS cells at most
    weights = mixture_weights(np.array([r.cell for r in table_], np.int64), np.array([r.n for r in table_], np.float64))
    return full.mapInArrow(_score(texts, total, distinct, weights), f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double").withColumn("train_tokens", F.lit(total).cast("long"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of ``score_texts`` over all documents; rows of the held-out fold are scored, not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_texts(docs, crc_mod(F.col("doc_id"), 7) != 2)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op5_language_model": op5_language_model}
ORACLES: dict = {}
