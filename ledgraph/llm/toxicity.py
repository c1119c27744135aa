"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER_BYTES, crc_mod, packed, stored, table, unpacked
from .textbytes import flat, parts, prefix_sums, span_hash, words

#: Documents of each class that the weights are begun with (all labelled ones are learned from then); words and byte n-grams known.
TRAIN_DOCS, MAX_WORDS, GRAM_BUCKETS = 1500, 20_000, 1 << 15
#: The pass over all windows is cut into so many rounds, after each of which the deals' networks are averaged; windows of a deal in
#: a round, if there are enough; deals of a round at most; windows that a task holds at once.
ROUNDS, DEAL_WINDOWS, ROUND_DEALS, HELD_WINDOWS = 4, 2048, 256, 4096
#: Parameters that travel as one row when networks are averaged.
CHUNK = 1 << 16
#: Bins of a logit, of which the threshold is found.
BINS = 1024
#: A word must occur in so many training windows to be known as a whole; others count by their n-grams.
LEAST_WINDOWS = 8
WINDOW, STRIDE = 64, 48
GRAMS = (3, 5)
#: A word's bytes pass the character layer in pieces of at most so many, all of them.
PIECE = 16
#: Word vectors that a scoring process keeps for its next texts (some 40 MB); without room for more only those met again stay.
KEPT_WORDS = 300_000
LOWER = np.frombuffer(LOWER_BYTES, np.uint8)
#: What comes off the ends of a word.
MARKS = np.zeros(256, np.bool_)
MARKS[[c for c in range(128) if not chr(c).isalnum()]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case, start, end, row, hash) of every word; ASCII marks at its ends come off, but for the last byte of a word of marks only."""
    low = LOWER[data]
    start, end, row = words(low, offsets)
    inside = ~MARKS[low]
    inner = np.flatnonzero(inside)
    if len(inner) and len(start):
        before = np.append(0, np.cumsum(inside))
        first = inner[np.minimum(before[start], len(inner) - 1)]
        last = inner[np.maximum(before[end] - 1, 0)]
        some = (first >= start) & (first < end)
        start, end = np.where(some, first, end - 1), np.where(some, last + 1, end)
    else:
        start = np.maximum(start, end - 1)
    return low, start, end, row, span_hash(prefix_sums(low), start, end)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, place of the first of each, place of each among them), by Arrow's hash table."""
    coded = pa.array(hashes).dictionary_encode()
    own, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    first, rank = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
    first[at[::-1]] = np.arange(len(at) - 1, -1, -1)
    order = np.argsort(own)
    rank[order] = np.arange(len(own))
    return own[order], first[order], rank[at]


def grams(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of words, the first ones told apart, one word after another; and each word's count (one at least)."""
    sums = prefix_sums(low)
    of, at = [], []
    for n in GRAMS:
        count = np.maximum(end - start - n + 1, 1)
        word = np.repeat(np.arange(len(start)), count)
        s = start[word] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        e = np.minimum(s + n, end[word])
        h = span_hash(sums, s, e) + (s == start[word]).astype(np.uint64) * np.uint64(0x5851F42D4C957F2D) + np.uint64(n)
        of.append(word)
        at.append(((h ^ (h >> np.uint64(29))) % np.uint64(GRAM_BUCKETS)).astype(np.int64))
    of, at = np.concatenate(of), np.concatenate(at)
    order = np.argsort(of, kind="stable")
    return at[order], np.bincount(of, minlength=len(start))


def letters(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words, one word after another, and each word's length."""
    size = end - start
    return low[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)], size


def pieces(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, length, word) of the fewest even pieces of at most PIECE bytes of words of ``size`` bytes that lie end to end."""
    n = -(-size // PIECE)
    word = np.repeat(np.arange(len(size)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first, last = k * size[word] // n[word], (k + 1) * size[word] // n[word]
    return (np.cumsum(size) - size)[word] + first, last - first, word


def window_starts(n: int) -> np.ndarray:
    """First words of the windows that cover ``n`` words, each overlapping the next by WINDOW - STRIDE; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that share a place, of ``n`` places."""
    at, out = at.astype(np.intp), np.empty((n, rows.shape[1]), rows.dtype)
    for k in range(rows.shape[1]):
        out[:, k] = np.bincount(at, rows[:, k], n)
    return out


def gated(p: dict, level: str, x: np.ndarray) -> list[np.ndarray]:
    """What the inputs ``x`` add to a layer's gates each way, those of sigmoids halved: sigmoid(a) is tanh(a / 2) / 2 + 1 / 2."""
    half = np.repeat(np.float32([0.5, 0.5, 1]), p[f"{level}_hf"].shape[0])
    return [x @ (p[f"{level}_x{d}"] * half) + p[f"{level}_c{d}"] * half for d in "fb"]


def encode(p: dict, level: str, x: np.ndarray, seq: np.ndarray, mask: np.ndarray, keep: bool = False, gates: list[np.ndarray] | None = None):
    """A vector per row of a bidirectional gated recurrent layer with attention pooling over its states, and what ``encode_back`` needs.

    x: a row per distinct symbol; seq, mask: (step, row). ``level`` begins the names of the layer's parameters; ``gates`` is
    what ``gated`` makes of x, if it is known. Inside, rows lie the last axis, so that gates are whole blocks, and both directions take a step at once: the k-th from their own end.
    """
    steps, n = seq.shape
    size = p[f"{level}_hf"].shape[0]
    gates = gates or gated(p, level, x)
    half = np.repeat(np.float32([0.5, 0.5, 1]), size)
    hidden = np.stack([(p[f"{level}_h{d}"] * half).T for d in "fb"])
    states = np.empty((steps, 2 * size, n), gates[0].dtype)
    masks = None if mask.all() else np.stack((mask, mask[::-1]), axis=1)[:, :, None].astype(states.dtype)
    h, gx, memo = np.zeros((2, size, n), states.dtype), np.empty((2, 3 * size, n), states.dtype), []
    for t in range(steps):
        gx[0] = np.take(gates[0], seq[t], axis=0).T
        gx[1] = np.take(gates[1], seq[steps - 1 - t], axis=0).T
        gh = hidden @ h
        rz = gx[:, : 2 * size] + gh[:, : 2 * size]
        np.tanh(rz, out=rz)
        rz *= 0.5
        rz += 0.5
        r, z = rz[:, :size], rz[:, size:]
        new = r * gh[:, 2 * size :]
        new += gx[:, 2 * size :]
        np.tanh(new, out=new)
        move = new - h
        move *= 1 - z
        if masks is not None:
            move *= masks[t]
        if keep:
            memo.append((h, r, z, new, gh[:, 2 * size :]))
        h = h + move
        states[t, :size], states[steps - 1 - t, size:] = h
    look = np.tanh(p[f"{level}_attend"].T @ states)
    score = np.einsum("a,tan->tn", p[f"{level}_query"], look)
    if masks is not None:
        score = np.where(mask > 0, score, -np.float32(1e9))
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tn,tcn->cn", weight, states).T
    return (pooled, (x, seq, masks, states, look, weight, memo)) if keep else pooled


def encode_back(p: dict, level: str, kept: tuple, dpool: np.ndarray, g: dict) -> np.ndarray:
    """The gradient by x of ``encode``, given that by its vectors; those by the layer's parameters are put into ``g``."""
    x, seq, masks, states, look, weight, memo = kept
    steps, size = len(seq), p[f"{level}_hf"].shape[0]
    dpool = np.ascontiguousarray(dpool.T)
    dweight = np.einsum("cn,tcn->tn", dpool, states)
    dscore = weight * (dweight - (weight * dweight).sum(axis=0))
    g[f"{level}_query"] = np.einsum("tn,tan->a", dscore, look)
    dlook = dscore[:, None] * p[f"{level}_query"][:, None] * (1 - look**2)
    g[f"{level}_attend"] = (states @ dlook.transpose(0, 2, 1)).sum(axis=0)
    dstates = weight[:, None] * dpool
    dstates += p[f"{level}_attend"] @ dlook
    hidden = np.stack([p[f"{level}_h{d}"] for d in "fb"])
    back = np.zeros((2, size, seq.shape[1]), states.dtype)
    dgh, dh_ = np.empty((2, 3 * size, seq.shape[1]), states.dtype), np.zeros_like(hidden)
    every = np.empty((6 * size, *seq.shape), states.dtype)
    for t in range(steps - 1, -1, -1):
        old, r, z, new, ghn = memo[t]
        back[0] += dstates[t, :size]
        back[1] += dstates[steps - 1 - t, size:]
        moved = back * (1 - z)
        if masks is not None:
            moved *= masks[t]
        back -= moved
        dnew = moved * (1 - new * new)
        dgh[:, :size] = dnew * ghn * r * (1 - r)
        dgh[:, size : 2 * size] = moved * (old - new) * z
        dgh[:, 2 * size :] = dnew
        every[: 3 * size, t], every[3 * size :, steps - 1 - t] = dgh
        dgh[:, 2 * size :] *= r
        dh_ += old @ dgh.transpose(0, 2, 1)
        back += hidden @ dgh
    dgates = summed(seq.ravel(), every.reshape(6 * size, -1).T, len(x))
    dx = 0
    for k, d in enumerate("fb"):
        own = dgates[:, k * 3 * size : (k + 1) * 3 * size]
        g[f"{level}_h{d}"], g[f"{level}_x{d}"], g[f"{level}_c{d}"] = dh_[k], x.T @ own, own.sum(axis=0)
        dx = dx + own @ p[f"{level}_x{d}"].T
    return dx


class WordTable:
    """The distinct words of some texts with their n-grams and bytes, and the texts' tokens as places among them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        at, rows, known, buckets, counts, spelled, sizes = [], [], np.zeros(0, np.uint64), [], [], [], []
        for i, j in parts(offsets, 1 << 20):
            low, start, end, row, h = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            own, place, of = distinct(h)
            order = np.argsort(known, kind="stable")
            near = np.minimum(np.searchsorted(known, own, sorter=order), len(known) - 1)
            new = known[order[near]] != own if len(known) else np.ones(len(own), np.bool_)
            own_bytes, size = letters(low, start[place[new]], end[place[new]])
            b, c = grams(own_bytes, np.cumsum(size) - size, np.cumsum(size)) if new.any() else (np.zeros(0, np.int64),) * 2
            where = len(known) + np.cumsum(new) - 1
            where[~new] = order[near[~new]]
            known = np.concatenate((known, own[new]))
            for x, v in ((at, where[of].astype(np.int32)), (rows, row + i), (buckets, b.astype(np.int32)), (counts, c), (spelled, own_bytes), (sizes, size)):
                x.append(v)
        whole = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.row, self.hashes, self.tokens = whole(rows, np.int64), known, whole(at, np.int32)
        self.buckets, self.counts = whole(buckets, np.int32), whole(counts, np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.letters, self.sizes = whole(spelled, np.uint8), whole(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)

    def grams_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.counts[at]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[at], n)
        return self.buckets[place], n

    def letters_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return letters(self.letters, self.ends[at] - self.sizes[at], self.ends[at])


class WordVectors:
    """The word layer's inputs of the words that a process has met, so that none is spelled for each batch of texts."""

    def __init__(self):
        self.hashes, self.x, self.again = np.zeros(0, np.uint64), None, np.zeros(0, np.bool_)

    def of(self, hashes: np.ndarray, embed) -> np.ndarray:
        """A row per word of ``hashes`` (sorted, distinct); ``embed`` makes those of the places it is given."""
        at = np.searchsorted(self.hashes, hashes)
        hit = np.zeros(len(hashes), np.bool_)
        if len(self.hashes):
            hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes
            self.again[at[hit]] = True
        new = np.flatnonzero(~hit)
        made = [embed(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
        if self.x is None:
            self.x = np.zeros((0, made[0].shape[1]), made[0].dtype)
        x = np.empty((len(hashes), self.x.shape[1]), self.x.dtype)
        x[hit] = self.x[at[hit]]
        if made:
            x[new] = np.concatenate(made)
        if len(self.hashes) + len(new) > KEPT_WORDS:
            stay = np.flatnonzero(self.again)[:KEPT_WORDS]
            self.hashes, self.x, self.again = self.hashes[stay], self.x[stay], np.zeros(len(stay), np.bool_)
            new = new[: KEPT_WORDS - len(stay)]
        if len(new):
            both = np.concatenate((self.hashes, hashes[new]))
            order = np.argsort(both, kind="stable")
            self.hashes, self.x = both[order], np.concatenate((self.x, x[new]))[order]
            self.again = np.append(self.again, np.zeros(len(new), np.bool_))[order]
        return x


@dataclass
class Network:
    vocabulary: np.ndarray  # sorted hashes of the known words
    p: dict[str, np.ndarray]
    shift: float = 0.0  # logit at which a document is called toxic
    prior: float = 0.1

    @classmethod
    def new(cls, vocabulary: np.ndarray, dim: int = 12, hidden: int = 8, attend: int = 8, char: int = 6, seed: int = 1) -> Network:
        """``dim``: of a word's vector; ``char``: of a byte's vector and of the character layer, ``hidden``: of the word layer, each way."""
        r = np.random.default_rng(seed)
        normal = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        p = {"word": (r.standard_normal((len(vocabulary) + 1, dim)) * 0.1).astype(np.float32), "gram": (r.standard_normal((GRAM_BUCKETS, dim)) * 0.3).astype(np.float32)}
        p["byte"] = (r.standard_normal((256, char)) * 0.5).astype(np.float32)
        for level, inputs, size in (("chars", char, char), ("words", dim + 2 * char, hidden)):
            for d in "fb":
                p |= {f"{level}_x{d}": normal(inputs, 3 * size), f"{level}_h{d}": normal(size, 3 * size), f"{level}_c{d}": np.zeros(3 * size, np.float32)}
            p |= {f"{level}_attend": normal(2 * size, attend), f"{level}_query": normal(attend)}
        return cls(vocabulary, p | {"out": normal(2 * hidden), "bias": np.zeros(1, np.float32)})

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the vocabulary; its length for an unknown word."""
        v = self.vocabulary
        if not len(v):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(v, hashes), len(v) - 1)
        return np.where(v[at] == hashes, at, len(v))

    def spell(self, chars: np.ndarray, sizes: np.ndarray, keep: bool = False, batch: int = 1024):
        """The character layer's vector per word, the mean over its pieces; with ``keep``, also what ``gradients`` needs."""
        first, length, word = pieces(sizes)
        share = (1 / np.bincount(word, minlength=len(sizes))[word]).astype(np.float32)[:, None]
        found, kept = np.empty((len(word), 2 * self.p["chars_hf"].shape[0]), np.float32), []
        order = np.argsort(length, kind="stable")  # short pieces together
        for i in range(0, len(word), batch):
            at = order[i : i + batch]
            seq, mask = padded(first[at], length[at])
            own = encode(self.p, "chars", self.p["byte"], chars[seq], mask, keep)
            found[at] = own[0] if keep else own
            if keep:
                kept.append((at, own[1]))
        spelled = summed(word, found * share, len(sizes))
        return (spelled, (kept, word, share)) if keep else spelled

    def known(self, ids: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The vector of each word, that of all unknown ones for an unknown word, and the mean of its n-grams'."""
        first = np.cumsum(counts) - counts
        return self.p["word"][ids] + np.add.reduceat(self.p["gram"][buckets], first, axis=0) / counts[:, None].astype(np.float32)

    def embed(self, ids, buckets, counts, chars, sizes) -> np.ndarray:
        """The word layer's input per distinct word: ``known`` beside ``spell``."""
        return np.concatenate((self.known(ids, buckets, counts), self.spell(chars, sizes)), axis=1)

    def forward(self, x: np.ndarray, seq: np.ndarray, mask: np.ndarray, gates: list[np.ndarray] | None = None) -> np.ndarray:
        """Logits of windows. x: a row per distinct word; seq, mask: (step, window); ``gates``: as in ``encode``."""
        return encode(self.p, "words", x, seq, mask, gates=gates) @ self.p["out"] + self.p["bias"]

    def gradients(self, ids, buckets, counts, chars, sizes, seq, mask, label, weight_of):
        """(gradient of every parameter, loss, probability of each window). ``weight_of``: a weight for each window, or what makes them of the probabilities."""
        p, dim = self.p, self.p["word"].shape[1]
        spelled, (kept_chars, of, share) = self.spell(chars, sizes, keep=True)
        x = np.concatenate((self.known(ids, buckets, counts), spelled), axis=1)
        pooled, kept = encode(p, "words", x, seq, mask, keep=True)
        probability = sigmoid(pooled @ p["out"] + p["bias"])
        weight_of = weight_of(probability) if callable(weight_of) else weight_of
        d = ((probability - label) * weight_of / len(label)).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        dx = encode_back(p, "words", kept, d[:, None] * p["out"], g)
        own = dx[:, :dim]
        g["word"] = summed(ids, own, len(p["word"]))
        g["gram"] = summed(buckets, np.repeat(own / counts[:, None].astype(own.dtype), counts, axis=0), len(p["gram"]))
        dspelled = dx[of, dim:] * share
        for at, memo in kept_chars:
            part = {}
            part["byte"] = encode_back(p, "chars", memo, dspelled[at], part)
            for k, v in part.items():
                g[k] = g[k] + v if k in g else v
        eps = np.float32(1e-7)
        loss = float((-(label * np.log(probability + eps) + (1 - label) * np.log(1 - probability + eps)) * weight_of).mean())
        return g, loss, probability

    def train(self, words_: WordTable, first: np.ndarray, count: np.ndarray, label: np.ndarray, epochs: int = 5, batch: int = 256, rate: float = 0.01, decay: float = 1e-5, drop: float = 0.25, seed: int = 2, toxic: float | None = None, begun: bool = False) -> list[float]:
        """Adam over shuffled windows, classes weighted evenly. A window is ``count`` tokens of the table from ``first`` on.

        A label holds for a document, and a window of a toxic one may be clean: from the third epoch on, windows of toxic
        documents that scored under 0.3 in the epoch before don't count. ``toxic`` is the share of toxic windows by which
        classes are weighted (that of these if not given). A network that has ``begun`` judges such windows itself.
        """
        last = np.ones(len(label), np.float32)
        r = np.random.default_rng(seed)
        toxic = label.mean() if toxic is None else toxic
        balance = np.where(label > 0, 0.5 / max(toxic, 1e-3), 0.5 / max(1 - toxic, 1e-3)).astype(np.float32)
        m, v, a, b = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(4))
        step, losses = 0, []
        total = epochs * -(-len(label) // batch)
        for epoch in range(epochs):
            order, lost = r.permutation(len(label)), []
            for i in range(0, len(label), batch):
                w = order[i : i + batch]
                seq, mask = padded(first[w], count[w])
                met = np.zeros(len(words_.hashes), np.bool_)
                met[words_.tokens[seq]] = True
                used, at = np.flatnonzero(met), (np.cumsum(met) - 1)[words_.tokens[seq]]
                ids = self.word_ids(words_.hashes[used])
                ids = np.where(r.random(len(ids)) < drop, len(self.vocabulary), ids)  # so that n-grams and characters are learned too
                spelled = *words_.grams_of(used), *words_.letters_of(used)
                toxic_w, doubted = label[w] > 0, last[w]
                counts = lambda p, toxic_w=toxic_w, doubted=doubted, w=w, epoch=epoch: np.where((begun or epoch > 1) & toxic_w & ((p if begun else doubted) < 0.3), np.float32(0), balance[w])
                g, loss, last[w] = self.gradients(ids, *spelled, at, mask, label[w].astype(np.float32), counts)
                lost.append(loss)
                step += 1
                lr = rate * min(1.0, 4 * (1 - step / (total + 1)))
                for k, x in self.p.items():
                    d = np.clip(g[k], -1, 1, out=a[k])
                    if decay:
                        d += decay * x
                    m[k] += np.multiply(np.subtract(d, m[k], out=b[k]), 0.1, out=b[k])
                    d *= d
                    v[k] += np.multiply(np.subtract(d, v[k], out=b[k]), 0.01, out=b[k])
                    d = np.sqrt(np.multiply(v[k], 1 / (1 - 0.99**step), out=d), out=d)
                    d += 1e-8
                    x -= np.multiply(np.divide(m[k], d, out=d), lr / (1 - 0.9**step), out=d)
            losses.append(float(np.mean(lost)))
        return losses

    def window_logits(self, data: np.ndarray, offsets: np.ndarray, met: WordVectors | None = None, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(row, logit) of all overlapping windows of whole texts."""
        low, start, end, row, hashes = tokens(data, offsets)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        used, place, at = distinct(hashes)

        def embed(new):
            own, size = letters(low, start[place[new]], end[place[new]])
            return self.embed(self.word_ids(used[new]), *grams(own, np.cumsum(size) - size, np.cumsum(size)), own, size)

        x = (met or WordVectors()).of(used, embed)
        many = np.bincount(row, minlength=len(offsets) - 1)
        before = np.cumsum(many) - many
        starts = [before[i] + window_starts(int(many[i])) for i in np.flatnonzero(many)]
        first = np.concatenate(starts)
        owner = row[first]
        count = np.minimum(WINDOW, before[owner] + many[owner] - first)
        order = np.argsort(count, kind="stable")  # short windows together
        out, gates = np.empty(len(first), np.float32), gated(self.p, "words", x)
        for i in range(0, len(first), batch):
            w = order[i : i + batch]
            seq, mask = padded(first[w], count[w])
            out[w] = self.forward(x, at[seq], mask, gates)
        return owner, out

    def scores(self, column: pa.Array, met: WordVectors | None = None) -> np.ndarray:
        """A score per text: that of its most toxic window; of a text without words, the share of toxic windows."""
        data, offsets = flat(column)
        best = np.full(len(column), -np.inf)
        for i, j in parts(offsets, 1 << 22):
            row, logit = self.window_logits(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], met)
            np.maximum.at(best, row + i, logit)
        return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(np.where(np.isfinite(best), best, 0) - self.shift, -30, 30))), min(self.prior, 0.49))


def padded(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(step, window) word places and mask; places beyond a window's end repeat its first."""
    t = np.arange(int(count.max()))[:, None]
    inside = t < count
    return np.where(inside, first + t, first), inside.astype(np.float32)


# ---- fit --------------------------------------------------------------------------------------------------------


#: One labelled document in so many, by a hash of its id, may set the threshold; the others may be learned from.
TUNE_ONE_IN = 5


def tuning(doc_id: Column) -> Column:
    """Whether a labelled document is one of those that the threshold is set by, none of which is learned from; a null id is never."""
    return F.coalesce(F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(3)), F.lit(TUNE_ONE_IN)) == 0, F.lit(False))


def _texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, text) of the labelled documents. Labels may be too many to be sent to each task, so both sides are dealt by id."""
    known = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(known.hint("shuffle_hash"), "doc_id").select("doc_id", "toxic", "text")


def _side(texts: DataFrame, tune: bool) -> DataFrame:
    """The labelled documents that set the threshold, or those that are learned from."""
    return texts.filter(tuning(F.col("doc_id")) if tune else ~tuning(F.col("doc_id")))


def _share(texts: DataFrame, per_class: int, salt: int) -> DataFrame:
    """About ``per_class`` documents of each class at most, chosen by hash of doc_id."""
    share = F.lit(0)
    for k, n in ((r[0], r[1]) for r in texts.groupBy("toxic").count().collect()):
        share = F.when(F.col("toxic") == k, F.lit(min(1_000_003, int(1_000_003 * per_class / n) + 1))).otherwise(share)
    return texts.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(salt)), F.lit(1_000_003)) < share)


def _windows(batches):
    """Texts to their windows of words."""
    for batch in batches:
        out = []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            own = (text or "").encode("utf-8", "surrogatepass").split()
            out += [(b" ".join(own[s : s + WINDOW]), toxic) for s in window_starts(len(own))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32())], ["window", "toxic"])


def _windows_of(texts: DataFrame) -> DataFrame:
    return texts.select("toxic", "text").mapInArrow(_windows, "window binary, toxic int")


def _sampled(docs: DataFrame, labels: DataFrame, per_class: int | None, salt: int, window_rows: bool):
    """What ``fit`` takes of a side: (window, toxic) of about ``per_class`` documents of each class (None: all); else (toxic, text) of tuning documents."""
    texts = _side(_texts(docs, labels), not window_rows)
    texts = texts if per_class is None else _share(texts, per_class, salt)
    return sorted((bytes(r.window), r.toxic) for r in _windows_of(texts).collect()) if window_rows else texts.select("toxic", "text")


def _word_counts(batches):
    """Hashes of words, and the windows of a batch that hold each."""
    for batch in batches:
        _, _, _, row, hashes = tokens(*flat(batch.column("window")))
        if len(hashes):
            own, _, place = distinct(hashes)
            pairs = np.sort(row * len(own) + place)
            pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
            often = np.bincount(pairs % len(own), minlength=len(own))
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(often)], ["word", "windows"])


def vocabulary(windows: DataFrame) -> np.ndarray:
    """Sorted hashes of the MAX_WORDS words that most of all windows hold, LEAST_WINDOWS at least."""
    found = windows.select("window").mapInArrow(_word_counts, "word long, windows long").groupBy("word").agg(F.sum("windows").alias("n"))
    rows = found.filter(F.col("n") >= LEAST_WINDOWS).orderBy(F.desc("n"), "word").limit(MAX_WORDS).collect()
    return np.sort(np.array([r.word for r in rows], np.int64).view(np.uint64))


def _joined(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _parted(values: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The opposite of ``_joined``, in the forms of ``p``."""
    ends = np.cumsum([p[k].size for k in sorted(p)])
    return {k: values[e - p[k].size : e].reshape(p[k].shape) for k, e in zip(sorted(p), ends.tolist(), strict=True)}


def _began(net: Network, epochs: int):
    """All windows of a bounded sample, in order, to the parameters after ``epochs`` over them."""

    def rows(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            words_ = WordTable(*flat(t.column("window").chunk(0)))
            label, count = t.column("toxic").to_numpy().astype(np.float32), np.bincount(words_.row, minlength=t.num_rows)
            full = np.flatnonzero(count)
            net.train(words_, (np.cumsum(count) - count)[full], count[full], label[full], epochs)
            yield pa.RecordBatch.from_arrays([pa.array([_joined(net.p).tobytes()], pa.binary())], ["parameters"])

    return rows


class Learner:
    """Goes on from a network over the windows of one deal, some at a time."""

    def __init__(self, net: Network, deal: int, toxic: float, rate: float):
        self.net, self.deal, self.toxic, self.rate = net, deal, toxic, rate
        self.own = Network(net.vocabulary, {k: v.copy() for k, v in net.p.items()})
        self.held, self.n, self.read = [], 0, 0

    def add(self, piece: pa.RecordBatch) -> None:
        for i in range(0, piece.num_rows, HELD_WINDOWS):
            part = piece.slice(i, HELD_WINDOWS)
            if self.n + part.num_rows > HELD_WINDOWS:
                self.learn()
            self.held.append(part)
            self.n += part.num_rows

    def learn(self) -> None:
        if not self.held:
            return
        t = pa.Table.from_batches(self.held).combine_chunks()
        words_ = WordTable(*flat(t.column("window").chunk(0)))
        label, count = t.column("toxic").to_numpy().astype(np.float32), np.bincount(words_.row, minlength=t.num_rows)
        full = np.flatnonzero(count)
        if len(full):
            self.own.train(words_, (np.cumsum(count) - count)[full], count[full], label[full], epochs=1, rate=self.rate, decay=0.0, seed=2 + self.read, toxic=self.toxic, begun=True)
        self.held, self.n, self.read = [], 0, self.read + self.n

    def change(self) -> pa.RecordBatch:
        """The change of every parameter, in pieces of CHUNK, and how many windows were read for it."""
        self.learn()
        change = _joined({k: self.own.p[k] - self.net.p[k] for k in self.net.p})
        cuts = range(0, len(change), CHUNK)
        columns = pa.array(range(len(cuts)), pa.int32()), pa.array([self.deal] * len(cuts), pa.int64()), pa.array([self.read] * len(cuts), pa.int64()), pa.array([change[i : i + CHUNK].tobytes() for i in cuts], pa.binary())
        return pa.RecordBatch.from_arrays(list(columns), ["part", "deal", "windows", "change"])


def _trained(net: Network, toxic: float, rate: float):
    """Windows sorted by deal to what each deal's ``Learner`` changes."""

    def rows(batches):
        at = None
        for batch in batches:
            deal = batch.column("deal").to_numpy()
            edges = [0, *(np.flatnonzero(deal[1:] != deal[:-1]) + 1).tolist(), len(deal)] if len(deal) else []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if at is not None and at.deal != deal[i]:
                    yield at.change()
                    at = None
                at = at or Learner(net, int(deal[i]), toxic, rate)
                at.add(batch.slice(i, j - i))
        if at is not None:
            yield at.change()

    return rows


def _averaged(found: pa.Table) -> pa.Table:
    """The mean change of a piece of the parameters; each is averaged over the deals that changed it, so words that few deals hold don't fade."""
    order = np.argsort(found.column("deal").to_numpy())  # in one order, so that reruns agree
    change = found.column("change").to_pylist()
    total, many = None, None
    for i in order.tolist():
        own = np.frombuffer(change[i], np.float32).astype(np.float64)
        total, many = (own.copy(), (own != 0).astype(np.int64)) if total is None else (total + own, many + (own != 0))
    mean = (total / np.maximum(many, 1)).astype(np.float32)
    windows = int(found.column("windows").to_numpy().sum())
    return pa.table({"part": found.column("part")[:1], "windows": pa.array([windows]), "change": pa.array([mean.tobytes()], pa.binary())})


def learned(net: Network, windows: DataFrame, n: int, toxic: float, rate: float = 0.003) -> int:
    """Goes on training ``net`` on all ``n`` rows of ``windows`` (window, toxic), each once; returns how many windows were learned from.

    Windows are dealt by hash to rounds and deals. In a round each deal goes on from the same network over its own windows,
    and Spark averages what they changed, whatever number of partitions they are in. One network a round reaches the driver;
    what a round shuffled goes when it is written.
    """
    rounds = min(ROUNDS, max(1, n // DEAL_WINDOWS))
    deals = max(1, min(ROUND_DEALS, n // rounds // DEAL_WINDOWS))
    read = 0
    at = F.xxhash64("window", F.lit(7))
    for k in range(rounds):
        part = windows.filter(F.pmod(at, F.lit(rounds)) == k).withColumn("deal", F.pmod(F.xxhash64("window", F.lit(11)), F.lit(deals)))
        part = part.repartitionById(deals, F.col("deal").cast("int")).sortWithinPartitions("deal", at, "window", "toxic")
        found = part.mapInArrow(_trained(net, toxic, rate * (1 - k / (2 * rounds))), "part int, deal long, windows long, change binary")
        mean = stored(found.groupBy("part").applyInArrow(_averaged, "part int, windows long, change binary"), "toxicity-change")
        pieces_ = sorted((r.part, r.windows, bytes(r.change)) for r in mean.collect())
        if not pieces_:
            continue
        change = _parted(np.frombuffer(b"".join(x[2] for x in pieces_), np.float32), net.p)
        net.p = {name: x + change[name] for name, x in net.p.items()}
        read += pieces_[0][1]
    return read


def fit(docs: DataFrame, labels: DataFrame, epochs: int = 5) -> Network:
    """A network fitted on all windows of all labelled documents but those that set its threshold (``tuning``), which are all judged for it.

    Texts meet their labels once. Words are counted over all windows. The weights begin with ``epochs`` over those of a bounded
    number of documents, in one task; then Spark's tasks learn from every window (``learned``). The threshold comes from the counts of all tuning
    documents by class and logit, in BINS to a unit. Without labelled documents of both classes the network is
    untrained and scores the texts alike.
    """
    texts = stored(_texts(docs, labels), "toxicity-texts")
    windows = stored(_windows_of(_side(texts, False)), "toxicity-windows")
    n, toxic = windows.agg(F.count("*"), F.coalesce(F.avg((F.col("toxic") > 0).cast("int")), F.lit(0.0))).first()
    if not 0 < toxic < 1:
        return Network.new(np.zeros(0, np.uint64))
    net = Network.new(vocabulary(windows))
    first = _windows_of(_share(_side(texts, False), TRAIN_DOCS, 1)).repartition(1).sortWithinPartitions("window", "toxic")  # bounded by TRAIN_DOCS
    for r in first.mapInArrow(_began(net, epochs), "parameters binary").collect():
        net.p = _parted(np.frombuffer(r.parameters, np.float32), net.p)
    learned(net, windows, n, float(toxic))
    net.prior = float(toxic)

    judged = _side(texts, True).select("toxic", "text").mapInArrow(_score_rows(net, ["toxic"]), "toxic int, score double")
    judged = judged.select("toxic", F.round(F.log(F.col("score") / (1 - F.col("score"))) * BINS).cast("int").alias("bin"))
    found = sorted((r[0], r[1], r[2]) for r in judged.groupBy("toxic", "bin").count().collect())  # at most 60 bins' units a class
    y, s, many = np.array(found, np.int64).reshape(-1, 3).T
    if len(y) and 0 < y.mean() < 1:
        net.shift = _threshold(s / BINS, y, many)
    return net


def _threshold(logit: np.ndarray, label: np.ndarray, many: np.ndarray | None = None, resamples: int = 200) -> float:
    """The median, over resamples of the documents (``many`` at each logit, or one), of the logit with the least sum of error rates, that of clean documents threefold."""
    many = np.ones(len(logit), np.int64) if many is None else many
    r, found = np.random.default_rng(3), []
    for _ in range(resamples):
        drawn = r.multinomial(many.sum(), many / many.sum())
        at = np.flatnonzero(drawn)
        if 0 < label[at].mean() < 1:
            found.append(_least_cost(logit[at], label[at], drawn[at]))
    return float(np.median(found)) if found else _least_cost(logit, label, many)


def _least_cost(logit: np.ndarray, label: np.ndarray, many: np.ndarray) -> float:
    """The middle of the gap at which these documents are parted at least cost."""
    order = np.argsort(logit, kind="stable")
    x, y, many = logit[order], label[order] > 0, many[order]
    missed = np.concatenate(([0], np.cumsum(many * y))) / max((many * y).sum(), 1)
    wrong = np.concatenate(([0], np.cumsum(many * ~y)))
    cost = missed + 3 * (1 - wrong / max((many * ~y).sum(), 1))
    at = int(np.argmin(cost))
    return float((x[max(at - 1, 0)] + x[min(at, len(x) - 1)]) / 2)


#: The word vectors of the network that a process scored with last.
_MET: dict[str, WordVectors] = {}


def _met(net: Network) -> WordVectors:
    key = hashlib.sha256(net.vocabulary.tobytes() + _joined(net.p).tobytes()).hexdigest()
    if key not in _MET:
        _MET.clear()
        _MET[key] = WordVectors()
    return _MET[key]


def _score_rows(net: Network, names: list[str]):
    def rows(batches):
        met = _met(net)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(net.scores(batch.column("text"), met))], [*names, "score"])

    return rows


def score(docs: DataFrame, net: Network) -> DataFrame:
    """All columns of ``docs`` and score (0 to 1), that of the most toxic of all overlapping windows of the whole text.

    Null and empty texts get the share of toxic windows learned from, under 0.5. Repeated rows score alike; an input column
    score is replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "score"])
    held = packed(docs, "text")
    scored = held.mapInArrow(_score_rows(net, held.columns), held.select("*").schema.add("score", "double"))  # a copy of the schema grows
    return unpacked(scored, docs, "text", new=("score",))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of ``score`` over all documents; labels of the held-out fold are not read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_mod(F.col("doc_id"), 5) != 0)
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict = {}
