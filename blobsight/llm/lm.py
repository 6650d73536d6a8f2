"""Language-model scoring: a gated recurrent network in numpy over the words of whole documents.

Words are counted over all training documents; the commonest have tokens of their own, all others are spelt. The output
is factored: first a class of words, then the word within it; for a spelt word this is the rare token, and then the
bits of its code, each relative to what the counts say. Codes are the first bits of the word's hash, and there are
more of them where there are more different words; the few words of a code share its mass by their counts. A spelt word
goes into the state by its whole hash, so that each leaves a trace of its own.
Training is truncated backpropagation over windows; the state is carried from window to window, so a document's
log-likelihood is that of the whole document. Partitions train side by side for a round, on a part of the training
documents of their own, and their weights are averaged; every training document is used once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobsight.llm.common import slices, words_of
from blobsight.scratch import materialise

#: Width of the state; classes and words in a class. The first class holds the end and the rare token alone.
HIDDEN, CLASSES, WIDTH, MARKS = 16, 33, 64, 2
VOCABULARY = CLASSES * WIDTH
#: Different spelt words for each code at most (on average over the codes), and bytes of the hash, each with embeddings of its own.
PER_CODE, BYTES = 64, 4
#: The commonest words, which tasks look up by themselves; counts of all others are joined.
HEAD = 1 << 17
#: Steps of a window; documents side by side in training and in scoring; tokens that are dealt to them at once.
STEPS, STREAMS, SCORED, CHUNK = 32, 256, 512, 1 << 20
ROUNDS, RATE, CLIP = 3, 0.004, 5.0
#: Replicas whose weights one group averages, and pieces that the weights are cut into for it.
FAN, PIECES = 64, 16
#: Logits are held below this, so that their exponentials are finite.
HIGHEST = 60.0
END, RARE = 0, 1
#: A token in memory: the network's number in the low bits, above them the hash of a spelt word.
LOW = 16
END_WORD = "\n"  # no word has a line break


def held_out(doc_id: str = "doc_id"):
    """Remainder 2 of CRC-32 of the id as text by 7; a null id is a training document."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 16 << 20):
        found = pc.value_counts(words_of(pc.ascii_lower(batch.column("text")))[0])
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([found.field(0), pa.array([END_WORD])]), pa.concat_arrays([found.field(1), pa.array([batch.num_rows], pa.int64())])], ["word", "c"])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows of ``docs`` (text); the end of a document is a word of its own."""
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_counted, "word string, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Head:
    """The commonest words by rank, their counts, and the sums over all words."""

    words: list[str]
    counts: np.ndarray
    total: int
    different: int
    ends: int

    @property
    def network(self) -> int:
        """Ranks from 0 that are in the network's vocabulary."""
        return min(len(self.words), VOCABULARY - WIDTH)

    def rest(self) -> tuple[int, int]:
        """Tokens and different words outside the network's vocabulary, the end token aside."""
        own = int(self.counts[: self.network].sum())
        ends = int(self.ends > 0)
        return self.total - own - self.ends, self.different - self.network - ends

    def bits(self) -> int:
        """Bits of a code, so that there is a code for every PER_CODE spelt words at least."""
        return min(31, max(1, (max(0, self.rest()[1]) // PER_CODE).bit_length()))


def head(counts: DataFrame, most: int = HEAD) -> Head:
    n = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == F.lit(END_WORD), F.col("c"))), F.lit(0))).first()
    top = counts.where(F.col("word") != F.lit(END_WORD)).orderBy(F.desc("c"), "word").limit(most).toArrow()
    return Head(top.column("word").to_pylist(), top.column("c").to_numpy().astype(np.int64), *map(int, n))


def hashes(words: pa.Array) -> np.ndarray:
    """32 bits of each word."""
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]].astype(np.uint64) if at[-1] > at[0] else np.zeros(0, np.uint64)
    at = at - at[0]
    sizes = np.diff(at)
    powers = np.full(int(sizes.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64)
    powers[0] = 1
    with np.errstate(over="ignore"):
        powers = np.cumprod(powers, dtype=np.uint64)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * powers[np.arange(len(raw)) - np.repeat(at[:-1], sizes)], dtype=np.uint64)])
        x = upto[at[1:]] - upto[at[:-1]]
        for by in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
    return (x >> np.uint64(32)).astype(np.uint32)


def highest(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """By class a bound on state @ weights + bias: states lie between -1 and 1."""
    return (np.abs(weights).sum(1) + bias).max(1)


def code_of(h: np.ndarray, bits: int) -> np.ndarray:
    return np.asarray(h).astype(np.int64) >> (32 - bits)


def _coded(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n = np.zeros(1 << bits), np.zeros(1 << bits)
        for batch in batches:
            code = code_of(hashes(batch.column("word")), bits)
            c += np.bincount(code, batch.column("c").to_numpy(), len(c))
            n += np.bincount(code, minlength=len(c))
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"code": pa.array(met), "mass": pa.array((c + n)[met])})

    return run


def masses(counts: DataFrame, h: Head) -> np.ndarray:
    """By code: what the counts of its spelt words, each and an unseen one raised by 1, add up to."""
    bits = h.bits()
    out = np.ones(1 << bits)
    found = counts.mapInArrow(_coded(bits), "code long, mass double").groupBy("code").agg(F.sum("mass").alias("mass")).toArrow()
    out[found.column("code").to_numpy()] += found.column("mass").to_numpy()
    own = code_of(hashes(pa.array([*h.words[: h.network], END_WORD], pa.string())), bits)
    np.subtract.at(out, own, np.append(h.counts[: h.network] + 1, h.ends + 1 if h.ends else 0))
    return out


def _tokenised(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        of = pa.array(h.words, pa.string())
        hashed = hashes(of)
        logs = np.append(np.log10(h.counts + 1.0), 0.0)
        for batch in slices(batches, "text", 8 << 20):
            words, doc = words_of(pc.ascii_lower(batch.column("text")))
            n = batch.num_rows
            sizes = np.bincount(doc, minlength=n)
            rank = np.asarray(pc.fill_null(pc.index_in(words, value_set=of), len(h.words))).astype(np.int64)
            rare = rank >= h.network
            beyond = np.flatnonzero(rank == len(h.words))
            coded = words.take(pa.array(beyond)).dictionary_encode()
            spelt = np.append(hashed, np.uint32(0))[rank]
            spelt[beyond] = hashes(coded.dictionary)[np.asarray(coded.indices)]
            spelt = spelt[rare].astype("<u4")
            parts = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=n))])
            pairs, times = np.unique(doc[beyond] * max(1, len(coded.dictionary)) + np.asarray(coded.indices), return_counts=True)
            lengths = np.searchsorted(pairs, np.arange(n + 1) * max(1, len(coded.dictionary))).astype(np.int32)
            far = coded.dictionary.take(pa.array(pairs % max(1, len(coded.dictionary))))
            ends = np.cumsum(sizes)
            ids = np.insert(np.where(rare, RARE, rank + WIDTH), ends, END).astype("<u2")
            offsets = np.concatenate([[0], ends + np.arange(1, n + 1)])
            out = {
                "doc_id": batch.column("doc_id"),
                "held_out": batch.column("held_out"),
                "n_tokens": pa.array(sizes + 1),
                "known": pa.array(np.bincount(doc[rank < len(h.words)], minlength=n) + (h.ends > 0)),
                "logs": pa.array(np.bincount(doc, logs[rank], n) + np.log10(h.ends + 1.0), pa.float64()),
                "rare_logs": pa.array(np.bincount(doc[rare], logs[rank[rare]], n).astype(float)),
                "ids": pa.array([ids[a:b].tobytes() for a, b in zip(offsets, offsets[1:])], pa.binary()),  # noqa: B905
                "spelt": pa.array([spelt[a:b].tobytes() for a, b in zip(parts, parts[1:])], pa.binary()),  # noqa: B905
                "far": pa.ListArray.from_arrays(lengths, far),
                "far_n": pa.ListArray.from_arrays(lengths, pa.array(times.astype(np.int32))),
            }
            yield pa.RecordBatch.from_pydict(out)

    return run


TOKENS = "doc_id long, held_out boolean, n_tokens long, known long, logs double, rare_logs double, ids binary, spelt binary, far array<string>, far_n array<int>"


def tokenise(docs: DataFrame, h: Head) -> DataFrame:
    """One row a document: ids of the network's tokens (16 bits each, the end last), hashes of the rare ones (32 bits each), sums of log10(count + 1) over the words
    of the head, and the words that are beyond it with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(h)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out().alias("held_out"))
    return rows.mapInArrow(_tokenised(shared), TOKENS)


@dataclass
class Network:
    """A gated recurrent unit: reset and update gates and a candidate state, with class-factored outputs.

    Without ``priors`` nothing is spelt, and a rare token is as any other.
    """

    e: np.ndarray  # embeddings
    wx: np.ndarray  # embedding to gates
    b: np.ndarray
    u: np.ndarray  # state to gates
    v: np.ndarray  # state to classes
    bv: np.ndarray
    o: np.ndarray  # state to words of a class
    bo: np.ndarray
    d: np.ndarray  # embeddings of a spelt word's bytes
    p: np.ndarray  # state to the bits of a code
    priors: np.ndarray | None = None  # log-odds that the next bit is set, by the bits before it behind a leading 1, from the counts
    masses: np.ndarray | None = None  # logarithms by code
    names: tuple = field(default=("e", "wx", "b", "u", "v", "bv", "o", "bo", "d", "p"), repr=False)

    @staticmethod
    def start(counts: np.ndarray, seed: int = 42, masses: np.ndarray | None = None) -> Network:
        """Small weights; output biases from the counts of all training tokens, and for bits from the masses of codes."""
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        by_class = (counts + 1e-3).reshape(CLASSES, WIDTH)
        log = lambda x: np.log(x).astype(np.float32)
        priors, bits = None, 0
        if masses is not None:
            bits = len(masses).bit_length() - 1
            levels = [masses.reshape(1 << i, 2, -1).sum(2) for i in range(bits)]  # of those with i bits before
            priors = np.concatenate([np.zeros(1, np.float32), *[log(x[:, 1]) - log(x[:, 0]) for x in levels]])
        return Network(small(VOCABULARY, HIDDEN), small(HIDDEN, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32), small(HIDDEN, 3 * HIDDEN), small(HIDDEN, CLASSES), log(by_class.sum(1) / by_class.sum()), small(CLASSES, HIDDEN, WIDTH), log(by_class / by_class.sum(1, keepdims=True)), small(BYTES * 256, HIDDEN), small(HIDDEN, bits), priors, None if masses is None else log(masses))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, x).ravel() for x in self.names])

    def over(self, flat: np.ndarray) -> Network:
        """A network of the same shape whose weights are views of ``flat``."""
        at, parts = 0, []
        for x in self.names:
            like = getattr(self, x)
            parts.append(flat[at : at + like.size].reshape(like.shape))
            at += like.size
        return Network(*parts, self.priors, self.masses)

    def inputs(self) -> np.ndarray:
        """Of tokens to the gates."""
        return self.e @ self.wx + self.b

    def entered(self, ids: np.ndarray, inputs: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Inputs to the gates of each token, and what ``spelling`` found."""
        x = inputs.take(ids & ((1 << LOW) - 1), 0)
        spelt = at, _, embedded = self.spelling(ids.ravel())
        if len(at):
            x.reshape(-1, x.shape[-1])[at] += embedded @ self.wx
        return x, spelt

    def spelling(self, ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray | None]:
        """Places of the spelt words, rows of their embeddings by byte, and these summed up."""
        if self.priors is None:
            return np.zeros(0, np.int64), [], None
        at = np.flatnonzero((ids & ((1 << LOW) - 1)) == RARE)
        h = ids[at] >> LOW
        rows = [((h >> 8 * i) & 255) + 256 * i for i in range(BYTES)]
        return at, rows, sum(self.d.take(r, 0) for r in rows)

    def forward(self, x: np.ndarray, h: np.ndarray, keep: np.ndarray, saved: bool = False) -> tuple[np.ndarray, ...]:
        """States after each step. x: inputs to the gates by step and stream; keep: 0 where a document starts. With ``saved``, also
        what ``backward`` needs: the states that steps began with, their gates, candidates, and what the state added to these."""
        n, (steps, streams) = HIDDEN, x.shape[:2]
        rows = range(steps) if saved else [0] * steps
        out, (began, gates, new, added) = np.empty((steps, streams, n), x.dtype), (np.empty((steps if saved else 1, streams, k), x.dtype) for k in (n, 2 * n, n, 3 * n))
        kept = keep[:, :, None].astype(x.dtype)
        for t, i in enumerate(rows):
            b, g, c, a = began[i], gates[i], new[i], added[i]
            np.multiply(h, kept[t], out=b)
            np.matmul(b, self.u, out=a)
            np.add(x[t, :, : 2 * n], a[:, : 2 * n], out=g)
            np.negative(g, g)
            np.exp(np.minimum(g, 60, out=g), g)
            g += 1
            np.reciprocal(g, g)
            np.multiply(g[:, :n], a[:, 2 * n :], out=c)
            c += x[t, :, 2 * n :]
            np.tanh(c, c)
            h = out[t]
            np.subtract(b, c, out=h)
            h *= g[:, n:]
            h += c
        return (out, began, gates, new, added[:, :, 2 * n :]) if saved else (out,)

    def outputs(self, h: np.ndarray, y: np.ndarray, grads: Network | None = None, scale: float = 0.0) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probabilities of the tokens ``y`` after the states ``h``; with ``grads``, adds to them and returns the slope of the loss by h too.

        That of a spelt word is still to be raised by the logarithm of its count + 1, its share in its code.
        """
        at = np.flatnonzero((y & ((1 << LOW) - 1)) == RARE) if self.priors is not None else []
        spelt = y[at] >> LOW if len(at) else None
        y = y & ((1 << LOW) - 1)
        rows, k = np.arange(len(y)), y // WIDTH
        s = h @ self.v
        s += self.bv
        if highest(self.v[None], self.bv[None])[0] > HIGHEST:
            np.minimum(s, HIGHEST, out=s)
        own = s[rows, k]
        np.exp(s, s)
        total = s @ np.ones(CLASSES, s.dtype)
        logp = own - np.log(total)
        dh = None
        if grads is not None:
            s *= (scale / total)[:, None]
            s[rows, k] -= scale
            grads.v += h.T @ s
            grads.bv += np.ones(len(s), s.dtype) @ s
            dh = s @ self.v.T
        if spelt is not None:
            more, dmore = self.bits(h.take(at, 0), spelt, grads, scale)
            logp[at] += more
            if grads is not None:
                dh[at] += dmore
        order = np.argsort(k.astype(np.uint8), kind="stable")
        cut = np.searchsorted(k[order], np.arange(CLASSES + 1))
        hs, w = h.take(order, 0), (y % WIDTH)[order]
        inner, ones = np.empty(len(y), np.float32), np.ones(WIDTH, h.dtype)
        dhs = np.zeros_like(hs) if grads is not None else None
        bound = highest(self.o, self.bo)
        for c in np.flatnonzero(np.diff(cut)):
            part, wide = slice(cut[c], cut[c + 1]), WIDTH if c else MARKS
            o, bo = self.o[c][:, :wide], self.bo[c][:wide]
            q = hs[part] @ o
            q += bo
            if bound[c] > HIGHEST:
                np.minimum(q, HIGHEST, out=q)
            first = rows[: len(q)]
            own = q[first, w[part]]
            np.exp(q, q)
            total = q @ ones[:wide]
            inner[part] = own - np.log(total)
            if grads is not None:
                q *= (scale / total)[:, None]
                q[first, w[part]] -= scale
                grads.o[c][:, :wide] += hs[part].T @ q
                grads.bo[c][:wide] += np.ones(len(q), q.dtype) @ q
                dhs[part] = q @ o.T
        logp[order] += inner
        if grads is not None:
            dh[order] += dhs
        return logp, dh

    def bits(self, h: np.ndarray, spelt: np.ndarray, grads: Network | None, scale: float) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probabilities of the codes of the hashes ``spelt``, without the codes' masses, and the slope by h."""
        n = self.p.shape[1]
        code = code_of(spelt, n)
        own = ((code | 1 << n)[:, None] >> np.arange(n, -1, -1)).astype(np.int32)  # the bits so far behind a leading 1
        sign = 1 - 2 * (own[:, 1:] & 1).astype(h.dtype)  # -1 where the bit is set
        s = h @ self.p
        s += self.priors.take(own[:, :n])
        s *= sign
        np.minimum(s, HIGHEST, out=s)
        np.exp(s, s)
        s += 1
        logp = -(np.log(s) @ np.ones(n, s.dtype)) - self.masses.take(code)
        if grads is None:
            return logp, None
        np.reciprocal(s, s)
        np.subtract(1, s, out=s)
        s *= sign
        s *= scale
        grads.p += h.T @ s
        return logp, s @ self.p.T

    def backward(self, ids: np.ndarray, keep: np.ndarray, saved: tuple, dhs: np.ndarray, grads: Network, spelt: tuple) -> None:
        """Slopes of a window's steps by all weights but those of the outputs. What no step hands on is worked out for all at once."""
        n, (h, g, c, an) = HIDDEN, saved
        steps = len(h)
        r, z = g[:, :, :n], g[:, :, n:]
        by_c = (1 - z) * (1 - c * c)
        by_r, by_z = an * r * (1 - r), (h - c) * z * (1 - z)
        dx = np.empty((steps, ids.shape[1], 3 * n), h.dtype)
        da = np.empty_like(dx)
        after, back, kept = np.zeros_like(dhs[0]), np.ascontiguousarray(self.u.T), keep[:, :, None].astype(h.dtype)
        for t in range(steps - 1, -1, -1):
            after += dhs[t]
            dc = after * by_c[t]
            d = da[t]
            np.multiply(dc, by_r[t], out=d[:, :n])
            np.multiply(after, by_z[t], out=d[:, n : 2 * n])
            np.multiply(dc, r[t], out=d[:, 2 * n :])
            dx[t, :, 2 * n :] = dc
            after *= z[t]
            after += d @ back
            after *= kept[t]
        dx[:, :, : 2 * n] = da[:, :, : 2 * n]
        flat, of = dx.reshape(-1, 3 * n), ids.ravel()
        grads.u += h.reshape(-1, n).T @ da.reshape(-1, 3 * n)
        grads.b += np.ones(len(flat), flat.dtype) @ flat
        at, rows, embedded = spelt
        if len(at):
            some = flat.take(at, 0)
            grads.wx += embedded.T @ some
            de = some @ self.wx.T
            for x in rows:
                order = np.argsort((x & 255).astype(np.uint8), kind="stable")
                first = np.flatnonzero(np.diff(x[order], prepend=-1))
                grads.d[x[order[first]]] += np.add.reduceat(de.take(order, 0), first)
        of = of & ((1 << LOW) - 1)
        order = np.argsort(of.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.diff(of[order], prepend=-1))
        which, sums = of[order[first]], np.add.reduceat(flat.take(order, 0), first)
        grads.wx += self.e[which].T @ sums
        grads.e[which] += sums @ self.wx.T


def dealt(docs: list[np.ndarray], streams: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows (tokens, keep, document) by step and stream: documents one after another in at most ``streams`` streams of
    about equal lengths, the longest stream first, so that those that have ended fall away. -1: nothing there."""
    loads = [(0, i) for i in range(min(streams, len(docs)))]
    own: list[list[int]] = [[] for _ in loads]
    for d in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        size, i = heapq.heappop(loads)
        own[i].append(d)
        heapq.heappush(loads, (size + len(docs[d]), i))
    own.sort(key=lambda x: -sum(len(docs[d]) for d in x))
    sizes = np.array([sum(len(docs[d]) for d in x) for x in own])
    flat = [np.concatenate([docs[d] for d in x]) for x in own]
    of = [np.repeat(x, [len(docs[d]) for d in x]) for x in own]
    many = 64 * STEPS
    for a in range(0, int(sizes[0]) if len(sizes) else 0, many):
        some = int((sizes > a).sum())
        tokens, which = np.full((some, many), -1, np.int64), np.full((some, many), -1, np.int32)
        before = np.array([of[i][a - 1] if a else -1 for i in range(some)], np.int32)
        for i in range(some):
            part = flat[i][a : a + many]
            tokens[i, : len(part)], which[i, : len(part)] = part, of[i][a : a + many]
        for b in range(0, min(many, int(sizes[0]) - a), STEPS):
            live = int((sizes > a + b).sum())
            yield tokens[:live, b : b + STEPS].T.copy(), which[:live, b : b + STEPS].T.copy(), (which[:live, b - 1] if b else before).copy()


def windows(docs: list[np.ndarray], streams: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, targets, keep, document, there) of each window: the input is the token before, at a document's start the end."""
    last = np.zeros(0, np.int64)
    for tokens, which, before in dealt(docs, streams):
        there = tokens >= 0
        prior = np.vstack([before[None], which[:-1]])
        keep = (which == prior).astype(np.float32)
        shifted = np.vstack([(last[: tokens.shape[1]] if len(last) else np.zeros(tokens.shape[1], np.int64))[None], tokens[:-1]])
        inputs = np.where(keep > 0, np.maximum(shifted, 0), END)
        yield inputs, np.maximum(tokens, 0), keep, which, there
        last = tokens[-1]


class Trainer:
    """Adam on windows; the state goes from each window to the next, gradients don't."""

    def __init__(self, net: Network):
        self.flat = net.flat()
        self.net, self.t = net.over(self.flat), 0
        self.slopes, self.m, self.s = (np.zeros_like(self.flat) for _ in range(3))
        self.grads = net.over(self.slopes)

    def fit(self, docs: list[np.ndarray]) -> int:
        h, n = np.zeros((STREAMS, HIDDEN), np.float32), 0
        for inputs, y, keep, _, there in windows(docs, STREAMS):
            h = h[: inputs.shape[1]]
            x, spelt = self.net.entered(inputs, self.net.inputs())
            states, *saved = self.net.forward(x, h, keep, True)
            at = np.flatnonzero(there.ravel())
            _, d = self.net.outputs(states.reshape(-1, HIDDEN)[at], y.ravel()[at], self.grads, 1.0 / len(at))
            dhs = np.zeros((states.shape[0] * states.shape[1], HIDDEN), np.float32)
            dhs[at] = d
            self.net.backward(inputs, keep, saved, dhs.reshape(states.shape), self.grads, spelt)
            self.step(len(at) / (STEPS * STREAMS))
            h = states[-1]
            n += len(at)
        return n

    def step(self, share: float) -> None:
        """Windows with few documents left, at the end of long ones, move the weights less."""
        self.t += 1
        g, m, s = self.slopes, self.m, self.s
        g *= min(1.0, CLIP / max(float(np.sqrt(g @ g)), 1e-9))
        rate = RATE * min(1.0, 4 * share) * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        m *= 0.9
        m += 0.1 * g
        s *= 0.99
        np.square(g, g)
        g *= 0.01
        s += g
        np.sqrt(s, g)
        g += 1e-6
        np.divide(m, g, g)
        g *= np.float32(rate)
        self.flat -= g
        g.fill(0)


def _lists(batch: pa.RecordBatch) -> list[np.ndarray]:
    out = []
    for x, y in zip(batch.column("ids").to_pylist(), batch.column("spelt").to_pylist(), strict=True):
        ids = np.frombuffer(x, "<u2").astype(np.int64)
        ids[ids == RARE] |= np.frombuffer(y, "<u4").astype(np.int64) << LOW
        out.append(ids)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about CHUNK tokens, so that streams are long."""
    held, size = [], 0
    for batch in slices(batches, "ids", 2 * CHUNK):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column("ids"))).as_py() or 0
        if size >= 2 * CHUNK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _trained(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, flat = shared.value
        trainer, n = Trainer(start.over(flat.copy())), 0
        for batch in _chunks(batches):
            n += trainer.fit(_lists(batch))
        if n:
            parts = np.array_split(trainer.net.flat(), PIECES)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(range(PIECES), pa.int32()), "n": pa.array([n] * PIECES, pa.int64()), "w": pa.array([x.tobytes() for x in parts], pa.binary())})

    return run


def _mean(table: pa.Table) -> pa.Table:
    n = table.column("n").to_numpy().astype(float)
    w = np.zeros(len(table.column("w")[0].as_py()) // 4)
    for x, k in zip(table.column("w"), n, strict=True):
        w += k * np.frombuffer(x.as_py(), np.float32)
    out = pa.table({"piece": table.column("piece")[:1], "n": pa.array([int(n.sum())]), "w": pa.array([(w / n.sum()).astype(np.float32).tobytes()], pa.binary())})
    return out


def turn(rounds: int) -> Column:
    """The round in which a document is learnt, by the hash of its id; -1 for one that is held out."""
    return F.when(F.col("held_out"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)).cast("int"))


def train(tokens: DataFrame, h: Head, by_code: np.ndarray, rounds: int) -> Network:
    """Rounds over ``tokens`` (turn, ids, spelt): each takes the documents whose turn it is.

    Only averaged weights reach the driver. Replicas' weights are averaged by groups of FAN first.
    """
    counts = np.zeros(VOCABULARY)
    counts[END], counts[RARE] = h.ends, max(0, h.rest()[0]) + 1
    counts[WIDTH : WIDTH + h.network] = h.counts[: h.network]
    net = start = Network.start(counts, masses=by_code)
    sc = tokens.sparkSession.sparkContext
    for r in range(rounds):
        shared = sc.broadcast((start, net.flat()))
        some = tokens.where(F.col("turn") == r).select("ids", "spelt")
        new = some.mapInArrow(_trained(shared), "piece int, n long, w binary").withColumn("fan", F.floor(F.spark_partition_id() / FAN))
        schema = "piece int, n long, w binary"
        once = new.groupBy("piece", "fan").applyInArrow(lambda t: _mean(t.drop_columns("fan")), schema)
        rows = sorted(once.groupBy("piece").applyInArrow(_mean, schema).collect(), key=lambda x: x["piece"])
        if rows:
            net = start.over(np.concatenate([np.frombuffer(x["w"], np.float32) for x in rows]))
        shared.unpersist()
    return net


def log_likelihoods(net: Network, docs: list[np.ndarray], inputs: np.ndarray | None = None) -> np.ndarray:
    """Natural log of the probability of each document (token ids, the end last)."""
    x = net.inputs() if inputs is None else inputs
    out, h = np.zeros(len(docs)), np.zeros((SCORED, HIDDEN), np.float32)
    for ids, y, keep, which, there in windows(docs, SCORED):
        states = net.forward(net.entered(ids, x)[0], h[: ids.shape[1]], keep)[0]
        at = np.flatnonzero(there.ravel())
        logp, _ = net.outputs(states.reshape(-1, HIDDEN)[at], y.ravel()[at])
        out += np.bincount(which.ravel()[at], logp, len(docs))
        h = states[-1]
    return out


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        inputs = net.inputs()
        for batch in _chunks(batches):
            found = log_likelihoods(net, _lists(batch), inputs) / np.log(10)
            kept = [c for c in batch.schema.names if c not in ("ids", "spelt")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(found)], [*kept, "network"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs`` (doc_id, text; others
    are left out), learning from the rows that are not held out.

    Null and blank texts are one end token. Repeated rows count as often as they are there. An empty table gives none;
    without a training document all words are unseen and the network stays as it started. A spelt word's probability is
    that of the rare token, times that of its code's bits, times its count's share within the code, counts raised by 1
    as in the base.
    """
    spark = docs.sparkSession
    counts = materialise(count_words(docs.where(~held_out())), "words")
    h = head(counts)
    rounds = ROUNDS
    tokens = materialise(tokenise(docs, h).withColumn("row", F.monotonically_increasing_id()).withColumn("turn", turn(rounds)), "tokens")
    net = train(tokens, h, masses(counts, h), rounds)
    shared = spark.sparkContext.broadcast(net)
    own = ["doc_id", "held_out", "n_tokens", "known", "logs", "rare_logs", "row"]
    scored = tokens.select(*own, "ids", "spelt").mapInArrow(_scored(shared), "doc_id long, held_out boolean, n_tokens long, known long, logs double, rare_logs double, row long, network double")
    if h.different > len(h.words) + 1:  # words beyond the head; those that no training document has add log10(1)
        floor = int(h.counts[-1])
        far = tokens.select("row", F.explode(F.arrays_zip("far", "far_n")).alias("x")).select("row", F.col("x.far").alias("word"), F.col("x.far_n").alias("n"))
        met = far.join(counts.where(F.col("c") <= floor), "word")
        sums = met.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("far_logs"), F.sum("n").alias("far_known"))
        scored = scored.join(sums, "row", "left")
    else:
        scored = scored.withColumn("far_logs", F.lit(None).cast("double")).withColumn("far_known", F.lit(None).cast("long"))
    far_logs, n = F.coalesce("far_logs", F.lit(0.0)), F.col("n_tokens").cast("double")
    every = float(np.log10(h.total + h.different + 1.0))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(h.total).cast("long").alias("train_tokens"),
        (F.col("logs") + far_logs - n * every).alias("base_score"),
        (F.col("network") + F.col("rare_logs") + far_logs).alias("score"),
    )
