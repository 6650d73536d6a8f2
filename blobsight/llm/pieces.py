"""SentencePiece encoding and decoding, batched in numpy.

A text is escaped as usual (a leading space; spaces as U+2581) and falls into units that no piece crosses: a unit is a run
of spaces and what follows it up to the next space or line break. Units of equal length advance together; substring hashes
are looked up among the sorted hashes of the pieces, and row-wise maxima choose.

What is chosen goes by the model's own kind. For a unigram model it is Viterbi: the best segmentation has the greatest sum
of scores, and maxima over where the last piece begins give scores and backpointers. The scores of a BPE model are the
ranks of its merges, and sums of ranks say nothing: there each unit starts as its characters, and the maximum over its
neighbours is the pair to join next, until none makes a piece. Both give the ids of the sentencepiece library.
Characters without a piece fall back to their bytes, so every text comes back exactly.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobsight.llm.common import contents, gather, slices

_UNITS = re.compile(r"\n| *[^ \n]+| +")
SPACE, NO_CODE = 0x2581, 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Units whose ids a task keeps; table cells that advance together; bytes of text worked on at once.
MOST_UNITS, CELLS, CHUNK = 300_000, 1 << 19, 2 << 20
#: Characters from which a unit is worked off alone, by a queue or a dictionary: few are so long.
LONG = 256

# Where a model's file says of which kind it is, how it treats texts, and what each piece is for.
TRAINER, NORMALISER, PIECE = 2, 3, 1
KIND, DUMMY_PREFIX, EXTRA_BLANKS, CHARACTER_MAP, SUFFIX, PIECE_TYPE = 3, 3, 4, 2, 24, 3
UNIGRAM, BPE, USER_DEFINED = 1, 2, 4


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            out |= (raw[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if raw[at - 1] < 128:
                return out

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, raw[at : at + size]
        at += size


def kind_of(model: bytes) -> int:
    """UNIGRAM or BPE; ValueError for a model that treats texts in a way that is not known here."""
    parts = list(_fields(model))
    spec = lambda n: dict(f for k, v in parts if k == n for f in _fields(v))
    trainer, normaliser = spec(TRAINER), spec(NORMALISER)
    kind = trainer.get(KIND, UNIGRAM)
    if kind not in (UNIGRAM, BPE) or trainer.get(SUFFIX, 0):
        raise ValueError("only unigram and BPE models with blanks before words are supported")
    if normaliser.get(CHARACTER_MAP) or normaliser.get(EXTRA_BLANKS, 1) or not normaliser.get(DUMMY_PREFIX, 1):
        raise ValueError("only models that keep texts as they are, behind one blank, are supported")
    if any(dict(_fields(v)).get(PIECE_TYPE) == USER_DEFINED for k, v in parts if k == PIECE):
        raise ValueError("pieces defined by a user are not supported")
    return kind


class Pieces:
    """The vocabulary as arrays, and a cache of units that were already encoded. With ``by_scores`` the segmentation is the one of
    the greatest sum of scores, whatever the model's kind."""

    def __init__(self, vocabulary: str | bytes, by_scores: bool = False):
        import sentencepiece

        model = contents(vocabulary)
        self.kind = UNIGRAM if kind_of(model) == UNIGRAM or by_scores else BPE
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = [0] * 256
        plain = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append((p, sp.get_score(i), i))
                self.bytes_of[i] = p.replace("▁", " ").encode()
        if not any(self.bytes_of[i] and sp.is_byte(i) for i in range(n)):
            raise ValueError("only models with pieces for bytes are supported")
        if any("▁" in p.lstrip("▁") or "\n" in p for p, _, _ in plain):
            raise ValueError("pieces that cross units are not supported")
        self.longest = max(len(p) for p, _, _ in plain)
        self.powers = np.array([pow(int(_BASE), i, 1 << 64) for i in range(self.longest + 1)], np.uint64)
        keys = np.array([self._hash(p) for p, _, _ in plain], np.uint64)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        order = np.argsort(keys)
        self.keys = keys[order]
        self.scores = np.array([s for _, s, _ in plain])[order]
        self.ids = np.array([i for _, _, i in plain], np.int32)[order]
        self.unknown = float(self.scores.min()) - 10.0
        self.by_text = {p: (s, i) for p, s, i in plain}
        self.raw = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.raw_size = np.fromiter(map(len, self.bytes_of), np.int64, n)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.clear()

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) % (1 << 64)
        return h

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.flat, self.size, self.start = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def units(self, text: str | None) -> list[str]:
        return _UNITS.findall(" " + text) if text else []

    @staticmethod
    def _prefixes(codes: np.ndarray) -> np.ndarray:
        """Hashes of the beginnings of each row."""
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(codes.shape[1]):
                out[:, j + 1] = out[:, j] * _BASE + (codes[:, j].astype(np.uint64) + np.uint64(1))
        return out

    def _found(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the substrings from ``start`` to ``end``, by row, are among the pieces, and whether they are."""
        size = np.maximum(0, np.minimum(end - start, self.longest))
        rows = np.arange(len(hashes))[:, None] if start.ndim == 2 else np.arange(len(hashes))
        with np.errstate(over="ignore"):
            key = hashes[rows, end] - hashes[rows, start] * self.powers[size]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, (self.keys[at] == key) & (end - start == size) & (size > 0)

    def merges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by joining neighbours: those whose piece has the greatest score, the leftmost of equal ones."""
        n, length = codes.shape
        hashes, rows = self._prefixes(codes), np.arange(n)
        cuts = np.tile(np.arange(length + 2), (n, 1))  # where symbols begin; beyond the last one the end, twice
        cuts[:, -1] = length
        done = cuts.copy()
        at, hit = self._found(hashes, cuts[:, : length - 1], cuts[:, 2 : length + 1])
        score = np.where(hit, self.scores[at], -np.inf)
        while score.shape[1]:
            k = score.argmax(1)
            live = score[np.arange(len(k)), k] > -np.inf
            if not live.all():
                done[rows[~live], : cuts.shape[1]], done[rows[~live], cuts.shape[1] :] = cuts[~live], length
                rows, hashes, cuts, score, k = rows[live], hashes[live], cuts[live], score[live], k[live]
                if not len(rows):
                    break
            of = np.arange(len(rows))
            cuts = np.take_along_axis(cuts, np.arange(cuts.shape[1] - 1) + (np.arange(cuts.shape[1] - 1) > k[:, None]), 1)
            score = np.take_along_axis(score, np.arange(score.shape[1] - 1) + (np.arange(score.shape[1] - 1) >= k[:, None]), 1)
            for i in (k - 1, k):  # pairs that the new symbol is in
                some = np.flatnonzero((i >= 0) & (i < score.shape[1]))
                if len(some):
                    p = i[some]
                    at, hit = self._found(hashes[some], cuts[some, p], cuts[some, p + 2])
                    score[some, p] = np.where(hit, self.scores[at], -np.inf)
        done[rows, : cuts.shape[1]], done[rows, cuts.shape[1] :] = cuts, length
        start, end = done[:, :-1], done[:, 1:]
        at, hit = self._found(self._prefixes(codes), start, end)
        count = (end > start).sum(1)
        return np.where(hit, self.ids[at], -1)[:, :length], count

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """codes: units of one length, a row each, escaped. Ids of each row (-1: by bytes), and their number."""
        n, length = codes.shape
        hashes = self._prefixes(codes)
        best = np.zeros((n, length + 1))
        back = np.zeros((n, length + 1), np.int32)
        piece = np.full((n, length + 1), -1, np.int32)
        rows = np.arange(n)
        for j in range(1, length + 1):
            i0 = max(0, j - self.longest)
            with np.errstate(over="ignore"):
                sub = hashes[:, j : j + 1] - hashes[:, i0:j] * self.powers[j - i0 : 0 : -1]
            at = np.minimum(np.searchsorted(self.keys, sub), len(self.keys) - 1)
            hit = self.keys[at] == sub
            score = np.where(hit, self.scores[at], -np.inf)
            score[:, -1] = np.where(hit[:, -1], score[:, -1], self.unknown)
            total = best[:, i0:j] + score
            k = total.argmax(1)  # the first: the longest piece
            best[:, j], back[:, j] = total[rows, k], i0 + k
            piece[:, j] = np.where(hit[rows, k], self.ids[at[rows, k]], -1)
        out, count, pos = np.full((n, length), -1, np.int32), np.zeros(n, np.int64), np.full(n, length)
        live = rows
        while len(live):
            out[live, count[live]] = piece[live, pos[live]]
            count[live] += 1
            pos[live] = back[live, pos[live]]
            live = live[pos[live] > 0]
        turned = np.maximum(0, count[:, None] - 1 - np.arange(length))
        return np.take_along_axis(out, turned, 1), count

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all ``units``, and by unit where its own begin and how many they are."""
        start, size, flat, have = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), [np.zeros(0, np.int32)], 0
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        for first, beyond in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            length = int(lengths[order[first]])
            step = 1 if length >= LONG else max(1, CELLS // (length + self.longest))
            for a in range(first, beyond, step):
                some = order[a : min(beyond, a + step)]
                ids, count = self._together([units[i] for i in some.tolist()], length)
                start[some], size[some] = have + np.cumsum(count) - count, count
                flat.append(ids)
                have += len(ids)
        return np.concatenate(flat), start, size

    def _together(self, units: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``units``, all of one length, one after another, and the number of each one's. That the ids spell the units is
        checked, for two texts may have one hash; units for which they don't, as those with unknown characters, are gone
        through one by one."""
        if length >= LONG:
            found = [np.array(self.plain(u), np.int32) for u in units]
            return np.concatenate(found), np.array([len(x) for x in found])
        plain = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)
        codes = np.where(plain == SPACE, NO_CODE, np.where(plain == 32, SPACE, plain))
        ids, count = (self.merges if self.kind == BPE else self.viterbi)(codes)
        there = np.arange(length) < count[:, None]
        sizes = np.where(there & (ids >= 0), self.raw_size[ids], 0).sum(1)
        want = (1 + (plain > 0x7F) + (plain > 0x7FF) + (plain > 0xFFFF)).sum(1)
        good = (sizes == want) & ~((ids < 0) & there).any(1)
        if good.all():
            flat = ids[there]
            text = np.frombuffer("".join(units).encode("utf-8", "surrogatepass"), np.uint8)
            if np.array_equal(gather(self.raw, self.raw_start[flat], self.raw_size[flat]), text):
                return flat, count
            good[:] = False
        if good.any():  # those apart, so that they are checked together
            parts = [None, None]
            for kind in (True, False):
                rows = np.flatnonzero(good == kind)
                own = [units[i] for i in rows.tolist()]
                flat, n = self._together(own, length) if kind else self._one_by_one(own, ids[rows], count[rows])
                parts[kind] = (rows, flat, n)
            n, start = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
            for at, (rows, _, k) in zip((0, len(parts[0][1])), parts, strict=True):
                n[rows], start[rows] = k, at + np.cumsum(k) - k
            return gather(np.concatenate([parts[0][1], parts[1][1]]), start, n), n
        return self._one_by_one(units, ids, count)

    def _one_by_one(self, units: list[str], ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [self._checked(u, ids[i, : count[i]]) for i, u in enumerate(units)]
        return np.concatenate(found), np.array([len(x) for x in found])

    def _checked(self, unit: str, ids: np.ndarray) -> np.ndarray:
        """Fill in bytes of unknown characters; a unit that the pieces don't spell is encoded without hashes."""
        out: list[int] = []
        at = 0
        for i in ids.tolist():
            if i < 0:
                out += self._spelt(unit[at])
                at += 1
                continue
            text = self.bytes_of[i].decode()
            if unit[at : at + len(text)] != text:
                return np.array(self.plain(unit), np.int32)
            out.append(i)
            at += len(text)
        return np.array(out, np.int32) if at == len(unit) else np.array(self.plain(unit), np.int32)

    def plain(self, unit: str) -> list[int]:
        """The same ids without batches or hashes: by a queue of pairs for a BPE model, by a dictionary for a unigram one."""
        chars = [None if ord(c) == SPACE else c.replace(" ", "▁") for c in unit]  # U+2581 itself is no space: by bytes
        return self._queued(unit, chars) if self.kind == BPE else self._best(unit, chars)

    def _spelt(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]

    def _queued(self, unit: str, chars: list[str | None]) -> list[int]:
        after, before = list(range(1, len(chars) + 1)), list(range(-1, len(chars) - 1))
        symbols, queue = list(chars), []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(symbols) and symbols[i] is not None and symbols[j] is not None and len(symbols[i]) + len(symbols[j]) <= self.longest:
                known = self.by_text.get(symbols[i] + symbols[j])
                if known:
                    heapq.heappush(queue, (-known[0], i, symbols[i], symbols[j]))

        for i in range(len(chars)):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != a or j >= len(symbols) or symbols[j] != b:
                continue  # one of the two has been joined since
            symbols[i], symbols[j], after[i] = a + b, "", after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out: list[int] = []
        i = 0
        while i < len(symbols):
            known = self.by_text.get(symbols[i]) if symbols[i] is not None else None
            out += [known[1]] if known else self._spelt(unit[i])
            i = after[i]
        return out

    def _best(self, unit: str, chars: list[str | None]) -> list[int]:
        best, back = [0.0], [(0, -1)]
        for j in range(1, len(unit) + 1):
            top = (-np.inf, 0, -1)
            for i in range(max(0, j - self.longest), j):
                key = None if None in chars[i:j] else "".join(chars[i:j])
                score, piece = self.by_text.get(key, (self.unknown, -1) if i == j - 1 else (-np.inf, -1))
                if best[i] + score > top[0]:
                    top = (best[i] + score, i, piece)
            best.append(top[0])
            back.append(top[1:])
        out: list[int] = []
        j = len(unit)
        while j:
            i, piece = back[j]
            out += [piece] if piece >= 0 else self._spelt(unit[i])[::-1]
            j = i
        return out[::-1]

    def documents(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for null or empty."""
        units, ends = [], []
        for t in texts:
            units += self.units(t)
            ends.append(len(units))
        if len(self.of) > MOST_UNITS:
            self.clear()
        new = [u for u in dict.fromkeys(units) if u not in self.of]
        if new:
            flat, start, size = self.encode_units(new)
            self.of.update(zip(new, range(len(self.of), len(self.of) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.flat) + start])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat])
        codes = np.fromiter(map(self.of.__getitem__, units), np.int64, len(units))
        size = self.size[codes]
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = gather(self.flat, self.start[codes], size)
        return np.split(flat, upto[np.array(ends, np.int64)][:-1]) if ends else []

    def decode(self, ids: np.ndarray) -> str:
        raw = gather(self.raw, self.raw_start[ids], self.raw_size[ids]).tobytes()
        return raw.decode("utf-8", "surrogatepass")[1:]


def _encoded(vocabulary, keep_ids: bool, by_scores: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(vocabulary.value, by_scores)
        for batch in slices(batches, "text", CHUNK):
            texts = batch.column("text").to_pylist()
            ids = pieces.documents(texts)
            out = {c: batch.column(c) for c in batch.schema.names if c != "text"} | {
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                "round_trip": pa.array([pieces.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)], pa.bool_()),
            }
            if keep_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return run


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), keep_ids: bool = True, by_scores: bool = False) -> DataFrame:
    """``keep`` columns of every row of ``docs`` (text), with n_tokens, ids_crc32 (of little-endian 32-bit ids),
    round_trip (the ids decode to the text again) and ids. By the model's kind, or with ``by_scores`` by Viterbi for a BPE
    model too. Null counts as empty and has no ids; repeated rows have theirs each; texts of any length are encoded whole. No
    shuffle. A column to keep that is called like one of these, or text, is left out: the name is the result's."""
    keep = tuple(c for c in keep if c.lower() not in ("text", "n_tokens", "ids_crc32", "round_trip", "ids"))
    rows = docs.select(*[f"`{c}`" for c in keep], F.col("text").cast("string").alias("text"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    sent = docs.sparkSession.sparkContext.broadcast(contents(path))
    return rows.mapInArrow(_encoded(sent, keep_ids, by_scores), head + "n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * keep_ids)


def _decoded(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(vocabulary.value)
        for batch in batches:
            texts = [pieces.decode(np.array(x, np.int32)) if x else "" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for every row of ``tokens`` (doc_id, ids); null ids give an empty text."""
    sent = tokens.sparkSession.sparkContext.broadcast(contents(path))
    return tokens.select("doc_id", "ids").mapInArrow(_decoded(sent), "doc_id long, text string")
