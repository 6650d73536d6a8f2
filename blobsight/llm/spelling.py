"""Spelling variants: words one code point apart, found by automata that hold the two segments of every word.

A word is cut in the middle. One inserted, deleted or replaced code point leaves one of its two segments whole, so a near
word begins with the first segment or ends with the second one. Segments are dealt over shards by their hash; a shard's
Aho-Corasick automaton holds them with the words they are of, and scans every word that may hold one of them at either end:
the lengths of near words are known, so a word goes to four shards at most. A segment found at the right end gives pairs of
words whose lengths fit; those are verified by their common beginning and end.

A shard has about ``TARGET`` rows at any size of the vocabulary. A segment that more than ``HOT`` words share is dealt over
several shards by its words. Pairs are met and counted within the shard, so what is shuffled afterwards follows the words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobsight.llm.common import partitions, slices
from blobsight.scratch import materialise

RUN = re.compile("[a-zÀ-ÿ]+")
#: One run of ``EVERY``, by its hash with the document's id, loses a code point.
EVERY = 97
#: Fewest code points and occurrences of a word.
LEAST_SIZE, LEAST_N = 5, 3
#: How many times as frequent as a word its form is.
FORM_RATIO = 2
#: Different words that a task counts before it hands them on; rows of a shard; words of one segment in a shard.
COUNTED, TARGET, HOT = 300_000, 40_000, 20_000
#: Pairs looked at, and bytes compared, at once.
TILE = 1 << 20
#: Hot segments are broadcast up to so many rows of about 30 bytes; beyond, joined by shuffle.
BROADCAST_ROWS = 100_000


def runs_of(doc_id: str | None, text: str | None, every: int = EVERY) -> Counter:
    """The document's words, before their least size and number, with their counts."""
    counts = Counter(RUN.findall((text or "").encode().lower().decode()))  # bytes: only A-Z
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    hit = [(r, h) for r in counts if (h := zlib.crc32(r.encode(), start)) % every == 0]
    lost = [(r, h, counts.pop(r)) for r, h in hit]
    for r, h, n in lost:
        at = h % len(r)
        counts[r[:at] + r[at + 1 :]] += n
    return counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
        found.clear()
        return batch

    for batch in slices(batches, "text"):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for word, n in runs_of(doc_id, text).items():
                if len(word) >= LEAST_SIZE:
                    found[word] += n
            if len(found) >= COUNTED:
                yield out()
    yield out()


def vocabulary(docs: DataFrame, least: int = LEAST_N) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) that occur ``least`` times or more. A null id hashes as an empty one."""
    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(_counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class _Words:
    """The words of a shard as bytes one after another: every code point of a word fits in one."""

    def __init__(self, words: list[str]):
        raw = [w.encode("latin-1") for w in words]
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        # a bit for each letter that occurs; one edit changes two at most
        self.letters = np.bitwise_or.reduceat(np.uint64(1) << (self.flat[:-1] % 61).astype(np.uint64), self.start)

    def near(self, a: np.ndarray, b: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """The near pairs of ``a`` and ``b``, whose segments of this kind are the same; pairs that share the first segment too are
        left to that one."""
        may = np.bitwise_count(self.letters[a][:, None] ^ self.letters[b]) <= 2
        size, other = self.size[a].astype(np.int32)[:, None], self.size[b].astype(np.int32)
        may &= (size - other <= 1) & (other - size <= 1) & (a[:, None] != b)
        x, y = np.nonzero(may)
        a, b = a[x], b[y]
        first, last = self.ends(a, b)
        near = first + last >= np.maximum(self.size[a], self.size[b]) - 1
        near &= (kind == 0) | (first < self.size[b] // 2)
        return a[near], b[near]

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points that each pair of words has in common at the beginning and at the end."""
        first, last = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        least = np.minimum(self.size[a], self.size[b])
        order, at = np.argsort(least, kind="stable"), 0
        while at < len(a):
            # widths rise along the order, so a chunk's last one is its widest
            rows = max(1, int(TILE // 4 // max(1, least[order[at]])))
            some = order[at : at + rows]
            some = some[: max(1, int(TILE // 4 // max(1, least[some[-1]])))]
            step, size = np.arange(int(least[some[-1]])), least[some][:, None]
            for out, begin, sign in ((first, lambda x: self.start[x], 1), (last, lambda x: self.start[x] + self.size[x] - 1, -1)):
                x, y = ((begin(z[some])[:, None] + sign * np.minimum(step, size - 1)) for z in (a, b))
                differs = (self.flat[x] != self.flat[y]) | (step >= size)
                out[some] = np.where(differs.any(1), differs.argmax(1), size[:, 0])
            at += len(some)
        return first, last


def _pairs_of_shard(words: list[str], kinds: list[int], sizes: list[int], holds: list[bool]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The shard's different words, and (scanned, held) indices of all near pairs that its segments give."""
    index: dict[str, int] = {}
    held: dict[tuple[int, str], list[int]] = defaultdict(list)
    for word, kind, size, own in zip(words, kinds, sizes, holds, strict=True):
        i = index.setdefault(word, len(index))
        if own:
            held[kind, word[:size] if kind == 0 else word[-size:]].append(i)
    every = list(index)
    if not held:
        return every, np.zeros(0, np.int32), np.zeros(0, np.int32)
    automaton = ahocorasick.Automaton()
    for segment in {s for _, s in held}:
        automaton.add_word(segment, segment)
    automaton.make_automaton()
    met: dict[tuple[int, str], list[int]] = defaultdict(list)
    for i, word in enumerate(every):
        for end, segment in automaton.iter(word):
            if end + 1 == len(segment) and (0, segment) in held:  # at the word's beginning
                met[0, segment].append(i)
            if end + 1 == len(word) and (1, segment) in held:  # at its end
                met[1, segment].append(i)
    table, none = _Words(every), np.zeros(0, np.int32)
    scanned_at, held_at = [none], [none]
    for (kind, segment), scanned in met.items():
        a, b = np.array(scanned, np.int32), np.array(held[kind, segment], np.int32)
        for at in range(0, len(a), max(1, TILE // len(b))):
            x, y = table.near(a[at : at + max(1, TILE // len(b))], b, kind)
            scanned_at.append(x)
            held_at.append(y)
    return every, np.concatenate(scanned_at), np.concatenate(held_at)


def _best(table: pa.Table) -> pa.Table:
    """For each scanned word with near words in this shard: how many, and the one of largest n, of equal ones the first."""
    words, kinds, sizes, holds, ns = (table.column(c).to_pylist() for c in ("word", "kind", "size", "holds", "n"))
    n_of = dict(zip(words, ns, strict=True))
    every, a, b = _pairs_of_shard(words, kinds, sizes, holds)
    n = np.array([n_of[w] for w in every], np.int64)
    place = np.empty(len(every), np.int64)  # code points are bytes here, so their order is that of the words
    place[np.array(sorted(range(len(every)), key=every.__getitem__), np.int64)] = np.arange(len(every))
    order = np.lexsort((place[b], -n[b], a))
    a, b = a[order], b[order]
    at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    found = pa.array(every, pa.string())
    return pa.table({"word": found.take(pa.array(a[at])), "n_near": np.diff(np.r_[at, len(a)]), "form_n": n[b[at]], "form": found.take(pa.array(b[at]))})


def _linked(table: pa.Table) -> pa.Table:
    every, a, b = _pairs_of_shard(*(table.column(c).to_pylist() for c in ("word", "kind", "size", "holds")))
    found = pa.array(every, pa.string())
    return pa.table({"word": found.take(pa.array(a)), "near": found.take(pa.array(b))})


def _shards(words: DataFrame, target: int, hot: int):
    """The rows of ``words`` (word, n) dealt to shards: as holders of their two segments, and as words to be scanned."""
    size = F.char_length("word")
    half = lambda n: F.floor(n / 2).cast("int")
    entry = lambda kind, n, own: F.struct(F.lit(kind).alias("kind"), n.alias("size"), own.alias("holds"))
    firsts = F.array_distinct(F.array(*[half(size + i) for i in (-1, 0, 1)]))
    lasts = F.array_distinct(F.array(*[(size + i) - half(size + i) for i in (-1, 0, 1)]))
    entries = F.concat(F.transform(firsts, lambda x: entry(0, x, x == half(size))), F.transform(lasts, lambda x: entry(1, x, x == size - half(size))))
    rows = words.select("word", "n", F.explode(entries).alias("e")).select("word", "n", "e.*")
    rows = rows.withColumn("segment", F.when(F.col("kind") == 0, F.substr("word", F.lit(1), F.col("size"))).otherwise(F.right("word", F.col("size"))))
    often = materialise(rows.where("holds").groupBy("kind", "segment").count().where(F.col("count") > hot).select("kind", "segment", F.ceil(F.col("count") / hot).cast("int").alias("salts")), "segments")
    many = often.count()
    if many:
        rows = rows.join(F.broadcast(often) if many <= BROADCAST_ROWS else often, ["kind", "segment"], "left")
        own = F.when(F.col("holds"), F.pmod(F.xxhash64("word"), F.col("salts")).cast("int"))
        rows = rows.withColumn("own", own).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        rows = rows.withColumn("holds", F.col("holds") & (F.coalesce("own", F.lit(0)) == F.col("salt")))
    else:
        rows = rows.withColumn("salt", F.lit(0))
    count = max(4 * partitions(words), -(-4 * words.count() // target))
    shard = F.pmod(F.xxhash64("kind", "segment", "salt"), F.lit(count)).cast("int")
    return rows.select("word", "n", "kind", "size", "holds", shard.alias("shard")).groupBy("shard")


def near_pairs(words: DataFrame, target: int = TARGET, hot: int = HOT) -> DataFrame:
    """(word, near): all ordered pairs of different words of ``words`` (word, n) that one inserted, deleted or replaced code point tells apart."""
    return _shards(words, target, hot).applyInArrow(_linked, "word string, near string")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): forms followed to the last, by doubling. Their n at least doubles, so none comes back."""
    found = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = found.select(F.col("word").alias("mid"), F.col("root").alias("to"))
        nxt = materialise(found.join(on, found["root"] == on["mid"], "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        found = nxt.select("word", "root")
        if nxt.where("moved").isEmpty():
            return found


def variants(docs: DataFrame, target: int = TARGET, hot: int = HOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs`` (doc_id, text; other columns are not read).

    A word is near another if one inserted, deleted or replaced code point tells them apart; its form is its near word of
    largest n, of equal ones the first in code-point order, if that n is ``FORM_RATIO`` times the word's own or more; its root
    is the last of its form, the form's form and so on, or itself. Null, empty and blank texts have no words. A null doc_id
    counts as an empty one. A repeated row counts again, and a text of any length is read whole. An empty table gives none.
    """
    words = materialise(vocabulary(docs), "words")
    near = _shards(words, target, hot).applyInArrow(_best, "word string, n_near long, form_n long, form string")
    first = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    far = -F.col("first.n") >= FORM_RATIO * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(far, F.col("first.form")).alias("form"), F.when(far, -F.col("first.n")).alias("form_n"))
    rows = materialise(rows, "forms")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
