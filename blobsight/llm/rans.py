"""Token ids in a binary format: a static range asymmetric numeral system (rANS).

A file is a row of a Parquet table in the shared folder: a run of whole documents in order, with their ids coded in
independent blocks. All files use one frequency table, made from the counts of all ids; where there are more different ids
than it has room for, the rare ones share one place in it and follow the blocks as they are. A block's ids are dealt over
interleaved lanes, each a 32-bit rANS state that sheds 16-bit words; states at fixed steps are kept as checkpoints, so
that blocks and the segments between checkpoints are decoded side by side. Each block has a checksum of its ids.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blobsight.llm.common import contents, gather, range_bounds, slices, words_of
from blobsight.scratch import materialise, new_path

#: The table's counts add up to 2^16; lanes of a block; steps of a lane; steps between checkpoints.
SCALE, LANES, STEPS, CHECK = 16, 128, 512, 128
BLOCK = LANES * STEPS
#: A file is closed at the document at which it has so many ids.
FILE_IDS = 1 << 20
#: Units whose ids a task keeps.
MOST_WORDS = 1_000_000
#: Words that are encoded in one text.
TOGETHER = 512
#: Letters and digits that stay one letter when composed and lower-cased: only after these is a word cut.
PLAIN_END = r"[a-z0-9\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{012F}\x{0131}-\x{017E}]$"
#: Punctuation that is cut off at the end of a word.
CLOSING = ".,;:!?*#$%&|"
#: A combining mark. Letters are put together with it before case is dropped, so what holds one goes as it is written.
MARK = r"\p{M}"
#: Words of these letters are one piece to the vocabulary's pattern, and its normaliser leaves them as they are.
PLAIN_WORD = r"^[a-z\x{00DF}-\x{00F6}\x{00F8}-\x{00FF}]+$"
MAGIC = b"BSR2"
#: Ids that get a place of their own in the table at most.
OWN = 3 << (SCALE - 2)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2^16, at least 1 for each id that occurs, and at the end that of the escape: all ids that
    are beyond the ``OWN`` commonest."""
    counts, whole = np.append(counts, 0).astype(np.int64), 1 << SCALE
    if (counts > 0).sum() > whole:
        rare = np.argsort(-counts, kind="stable")[OWN:]
        counts[-1], counts[rare[rare < len(counts) - 1]] = counts[rare].sum(), 0
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.uint32)
    f = np.where(counts > 0, np.maximum(1, counts * whole // total), 0).astype(np.int64)
    while (rest := whole - int(f.sum())) != 0:
        if rest > 0:
            f[np.argmax(counts)] += rest
        else:  # what the rare ids took comes from those with most to spare
            order = np.argsort(-f, kind="stable")
            spare = np.maximum(0, np.minimum(f[order] - 1, np.maximum(1, f[order] // 8)))
            take = np.minimum(spare, np.maximum(0, -rest - (np.cumsum(spare) - spare)))
            f[order] -= take
    return f.astype(np.uint32)


def encode(ids: np.ndarray, freq: np.ndarray) -> bytes:
    """Blocks of ``ids``: header, then the block table, states of all segments, words of all blocks, and escaped ids."""
    n, plain, escape = len(ids), ids, len(freq) - 1
    own = np.minimum(ids, escape)
    ids = np.where((freq[own] > 0) & (own < escape), own, escape)
    escaped = plain[ids == escape]
    blocks = -(-n // BLOCK)
    starts = (np.cumsum(freq, dtype=np.uint64) - freq).astype(np.uint64)
    steps = STEPS if blocks > 1 else max(CHECK, -(-n // LANES // CHECK) * CHECK + (CHECK if -(-n // LANES) % CHECK else 0)) if n else 0
    steps = min(STEPS, steps)
    padded = np.full(blocks * LANES * steps, int(np.argmax(freq)), np.int64)
    padded[:n] = ids
    s = padded.reshape(blocks, steps, LANES)
    x = np.full((blocks, LANES), 1 << 16, np.uint64)
    shed, words = np.zeros(s.shape, bool), np.zeros(s.shape, np.uint16)
    states = np.zeros((blocks, steps // CHECK if steps else 0, LANES), np.uint32)
    f64 = freq.astype(np.uint64)
    for t in range(steps - 1, -1, -1):
        f = f64[s[:, t]]
        over = x >= (f << np.uint64(16))
        shed[:, t], words[:, t] = over, x & np.uint64(0xFFFF)
        x = np.where(over, x >> np.uint64(16), x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + starts[s[:, t]]
        if t % CHECK == 0:
            states[:, t // CHECK] = x
    per = shed.reshape(blocks, -1, CHECK * LANES).sum(2, dtype=np.uint32) if steps else np.zeros((blocks, 0), np.uint32)
    sums = [zlib.crc32(plain[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) for i in range(blocks)]
    return MAGIC + struct.pack("<QIIQ", n, blocks, steps, len(escaped)) + np.array(sums, "<u4").tobytes() + per.astype("<u4").tobytes() + states.astype("<u4").tobytes() + words[shed].astype("<u2").tobytes() + escaped.astype("<u4").tobytes()


def decode(data: bytes, freq: np.ndarray) -> np.ndarray:
    """The ids (uint32) of ``encode``; ValueError where a checksum fails."""
    if data[:4] != MAGIC:
        raise ValueError("not a file of this format")
    n, blocks, steps, n_escaped = struct.unpack_from("<QIIQ", data, 4)
    at = 28

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    segments = blocks * (steps // CHECK)
    sums, per = take(blocks, "<u4"), take(segments, "<u4").astype(np.int64)
    x = take(segments * LANES, "<u4").astype(np.uint64).reshape(segments, LANES)
    words = np.append(take(int(per.sum()), "<u2"), 0).astype(np.uint64)
    escaped = take(n_escaped, "<u4")
    used = np.flatnonzero(freq)
    slot_id = np.repeat(used, freq[used])
    f64, starts = freq.astype(np.uint64), (np.cumsum(freq, dtype=np.uint64) - freq).astype(np.uint64)
    slot_f, slot_bias = f64[slot_id], np.arange(len(slot_id), dtype=np.uint64) - starts[slot_id]
    at_word = np.cumsum(per) - per
    out = np.zeros((segments, CHECK, LANES), np.uint32)
    for t in range(CHECK if segments else 0):
        slot = x & np.uint64(0xFFFF)
        out[:, t] = slot_id[slot]
        x = slot_f[slot] * (x >> np.uint64(SCALE)) + slot_bias[slot]
        need = x < np.uint64(1 << 16)
        upto = np.cumsum(need, 1)
        word = words[np.minimum(np.where(need, at_word[:, None] + upto - 1, len(words) - 1), len(words) - 1)]
        x = np.where(need, (x << np.uint64(16)) | word, x)
        at_word = at_word + upto[:, -1]
    ids = out.reshape(-1)[:n]
    at_escape = np.flatnonzero(ids == len(freq) - 1)
    if len(at_escape) != n_escaped:
        raise ValueError("escaped ids are missing")
    ids[at_escape] = escaped
    for i in range(blocks):
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()) != sums[i]:
            raise ValueError(f"checksum of block {i}")
    return ids


# What a vocabulary that drops case and white space and ends words by a suffix says of itself.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def by_words(spec: dict) -> bool:
    """Whether the ids of a text are those of its words one after another, as ``WordIds`` needs it, by the vocabulary's own
    description: the normaliser and pattern are those above, words end by a suffix, and added tokens are found as
    written, hold no white space, and take none beside them."""
    model = spec["model"]
    return bool(
        (spec.get("normalizer") or {}).get("normalizers") == NORMALISERS
        and (spec.get("pre_tokenizer") or {}).get("pretokenizers") == SPLITS
        and model["type"] == "BPE"
        and model.get("end_of_word_suffix")
        and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("unk_token") or spec.get("truncation") or spec.get("padding"))
        and all(t["content"].isascii() and len(t["content"].split()) == 1 and t["content"].split()[0] == t["content"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
    )


class WordIds:
    """Ids of texts by the tokenizers library.

    Where ``by_words`` says so, each different word is encoded once: the vocabulary's pattern never crosses white space,
    and it cuts between a plain letter or digit and ASCII punctuation after it, so the ids of a text are those of its words
    one after another, and those of a word the ids of what comes before its last punctuation and of that punctuation.
    Case is dropped by the vocabulary itself, but for words that may hold an added token or a combining mark. Words of plain letters need
    neither the normaliser nor the pattern, so they go to the model alone. Any other vocabulary encodes whole texts.
    """

    def __init__(self, vocabulary: str | bytes, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        raw = contents(vocabulary)
        self.tokenizer, self.end, spec = Tokenizer.from_buffer(raw), end, json.loads(raw)
        self.words = by_words(spec)
        self.added = [t["content"] for t in spec["added_tokens"]]
        special = [(t["content"], t["id"]) for t in spec["added_tokens"] if t["special"]]
        self.mark = min(special, key=lambda x: x[1]) if special else None
        if self.words:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
            self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.clear()

    def clear(self) -> None:
        """Unit 0 is empty."""
        self.units, self.flat, self.size, self.start = pa.array([""]), np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.closings: dict[str, int] = {"": 0}

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``words`` one after another, and each one's number. Many words go into one text, parted by a special token
        that white space sets off; a word that holds the token's own text goes by itself."""
        mark = self.mark
        own = [i for i, w in enumerate(words) if mark is None or mark[0] in w]
        alone = [x.ids for x in self.tokenizer.encode_batch_fast([words[i] for i in own], add_special_tokens=False)]
        if len(own) == len(words):
            return np.fromiter((i for x in alone for i in x), np.uint32), np.fromiter(map(len, alone), np.int64, len(alone))
        odd = set(own)
        rest = [w for i, w in enumerate(words) if i not in odd]
        texts = [f" {mark[0]} ".join([*rest[a : a + TOGETHER], ""]) for a in range(0, len(rest), TOGETHER)]
        found = np.concatenate([np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(found == mark[1])
        size = np.diff(ends, prepend=-1) - 1
        flat = found[found != mark[1]]
        if odd:
            sizes = np.zeros(len(words), np.int64)
            kept = np.array([i for i in range(len(words)) if i not in odd])
            sizes[kept], sizes[own] = size, [len(x) for x in alone]
            starts = np.zeros(len(words), np.int64)
            starts[kept], starts[own] = np.cumsum(size) - size, len(flat) + np.cumsum(sizes[own]) - sizes[own]
            flat = gather(np.concatenate([flat, np.array([i for x in alone for i in x], np.uint32)]), starts, sizes)
            size = sizes
        return flat, size

    def encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of plain letters. Each is one piece, whose last id alone ends a word."""
        texts = [" ".join(words[a : a + TOGETHER]) for a in range(0, len(words), TOGETHER)]
        found = [np.array(x.ids, np.uint32) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
        size = np.diff(np.flatnonzero(self.last[flat]), prepend=-1)
        return (flat, size) if len(size) == len(words) else self.encode_words(words)

    def add(self, words: pa.Array) -> None:
        plain = np.asarray(pc.match_substring_regex(words, PLAIN_WORD))
        parts = [f(words.filter(pa.array(kind)).to_pylist()) for f, kind in ((self.encode_plain, plain), (self.encode_words, ~plain)) if kind.any()]
        flat, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        if plain.any() and not plain.all():
            start = np.zeros(len(words), np.int64)
            order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
            start[order] = np.cumsum(size) - size
            size = size[np.argsort(order)]
            flat = gather(flat, start, size)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])

    def learn(self, units: pa.Array) -> np.ndarray:
        """The number of each of ``units``; those not met before are encoded."""
        at = pc.index_in(units, value_set=self.units)
        unknown = np.asarray(at.is_null())
        out = np.asarray(pc.fill_null(at, 0)).astype(np.int64)
        if unknown.any():
            new = units.filter(pa.array(unknown)).dictionary_encode()
            out[unknown] = len(self.size) + np.asarray(new.indices)
            self.add(new.dictionary)
            self.units = pa.concat_arrays([self.units, new.dictionary])
        return out

    def learn_closings(self, closings: pa.DictionaryArray) -> np.ndarray:
        """The same for the punctuation at words' ends, of which there is little: kept with the units, under no text."""
        new = [x for x in closings.dictionary.to_pylist() if x not in self.closings]
        if new:
            self.closings.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
            self.add(pa.array(new, pa.string()))
            self.units = pa.concat_arrays([self.units, pa.nulls(len(new), pa.string())])
        return np.array([self.closings[x] for x in closings.dictionary.to_pylist()], np.int64)[np.asarray(closings.indices)]

    def documents(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts``, the end id after each, and where each text's ids end."""
        if not self.words:
            found = [np.array([*x.ids, self.end], np.uint32) for x in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *found]), np.cumsum([len(x) for x in found], dtype=np.int64)
        if len(self.units) > MOST_WORDS:
            self.clear()
        found, doc = words_of(texts)
        coded = found.dictionary_encode()
        words = coded.dictionary
        as_written = pa.array(np.zeros(len(words), bool))
        as_written = pc.or_(as_written, pc.match_substring_regex(words, MARK))  # some marks go together with a small letter alone
        for token in self.added:  # found by their own case alone
            as_written = pc.or_(as_written, pc.match_substring(words, token, ignore_case=True))
        words = pc.if_else(as_written, words, pc.ascii_lower(words))
        stems = pc.if_else(as_written, words, pc.ascii_rtrim(words, CLOSING))
        cut = pc.and_(pc.match_substring_regex(stems, PLAIN_END), pc.less(pc.binary_length(stems), pc.binary_length(words)))
        last = pc.replace_substring_regex(words, r"(?s)^.*[\p{L}\p{N}]", "")
        parts = np.stack([self.learn(pc.if_else(cut, stems, words)), self.learn_closings(pc.if_else(cut, last, "").dictionary_encode())], 1).ravel()
        own = gather(self.flat, self.start[parts], self.size[parts])
        size = self.size[parts].reshape(-1, 2).sum(1)
        size, start = np.append(size, 1), np.append(np.cumsum(size) - size, len(own))
        own = np.append(own, np.uint32(self.end))
        ends = np.cumsum(np.bincount(doc, minlength=len(texts)))
        codes = np.insert(np.asarray(coded.indices).astype(np.int64), ends, len(words))
        upto = np.cumsum(size[codes])
        return gather(own, start[codes], size[codes]), upto[ends + np.arange(len(ends))]


def frequencies(tokenised: DataFrame) -> np.ndarray:
    """The shared table, from the counts of all ids of all documents, which each task of ``_tokenised`` leaves in a row of its
    own: at most one row for each id of the vocabulary reaches the driver."""
    rows = tokenised.where("part < 0").select(F.explode(F.arrays_zip("used", "times")).alias("x"))
    rows = rows.groupBy(F.col("x.used").alias("id")).agg(F.sum("x.times").alias("n")).collect()
    counts = np.zeros(max([0, *(r["id"] for r in rows)]) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return quantise(counts)


#: A row a document; and one a task, part -1, with the ids it met and how often.
TOKENISED = "doc_id long, part int, ids binary, used array<long>, times array<long>"


def _tokenised(vocabulary, end: int, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = WordIds(vocabulary.value, end), np.zeros(1, np.int64)
        for batch in slices(batches, "text", 8 << 20):
            ids, ends = encoder.documents(batch.column("text"))
            found = np.bincount(ids, minlength=len(total))
            found[: len(total)] += total
            total = found
            raw = ids.astype(encoder.kind)
            offsets = np.concatenate([[0], ends]) * raw.itemsize
            key = pc_fill(batch.column("doc_id"))
            column = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw.tobytes())])
            none = pa.nulls(len(ends), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.searchsorted(bounds, key, "left").astype(np.int32)), column, none, none], names)
        used = np.flatnonzero(total)
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (used, total[used])]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([-1], pa.int32()), pa.nulls(1, pa.binary()), *lists], names)

    names = [x.split()[0] for x in TOKENISED.split(", ")]
    return run


def pc_fill(column: pa.Array) -> np.ndarray:
    return column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def _written(freq: np.ndarray, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, parts, have, part, number = [], [], 0, -1, 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            out = {
                "part": pa.array([part], pa.int32()),
                "number": pa.array([number], pa.int32()),
                "n_ids": pa.array([len(ids)], pa.int64()),
                "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                "sizes": pa.array([[len(x) for x in parts]], pa.list_(pa.int64())),
                "data": pa.array([encode(ids, freq)], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(out)

        for batch in slices(batches, "ids", 2 << 20):
            for doc, p, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "ids")), strict=True):
                if docs and (p != part or have >= FILE_IDS):
                    yield close()
                    number = number + 1 if p == part else 0
                    docs, parts, have = [], [], 0
                part = p
                docs.append(doc)
                parts.append(np.frombuffer(ids, kind))
                have += len(parts[-1])
        if docs:
            yield close()

    return run


FILE = "part int, number int, n_ids long, doc_ids array<long>, sizes array<long>, data binary"


def write(docs: DataFrame, vocabulary: str, end: int = 1, path: str | None = None) -> tuple[str, np.ndarray]:
    """Encode ``docs`` (doc_id, text; others are left out) in ascending doc_id order (null first) and write the files.

    Returns the folder and the frequency table (also written, beside the files). Documents are dealt out by ranges of
    doc_id, so that each task writes a run of the order; texts are tokenised once, into a table of ids, which alone is
    shuffled; ids are counted on the way. Without ``path`` the files last as long as the application.

    A null, empty or blank text has the end id alone. Repeated rows and rows of one doc_id each have their place, in an order of
    their own among equal ids; so do rows without a doc_id. A text of any length is encoded whole. An empty table gives files
    without documents. Columns other than doc_id and text are not read, whatever they are called.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "ids")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sent = spark.sparkContext.broadcast(contents(vocabulary))
    kind = WordIds(sent.value, end).kind
    bounds = np.array(range_bounds(docs.select(F.coalesce("doc_id", F.lit(-1 << 63)).alias("k")), "k", docs.count(), 50_000), np.int64)
    rows = materialise(docs.mapInArrow(_tokenised(sent, end, bounds), TOKENISED), "tokenised")
    freq = frequencies(rows)
    last = len(freq) - 1
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq.tolist()) if f or i == last], "id int, freq int").coalesce(1).write.parquet(f"{path}/table")
    rows = rows.where("part >= 0").select("doc_id", "part", "ids").repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")
    rows.mapInArrow(_written(freq, kind), FILE).write.option("compression", "none").parquet(f"{path}/files")
    return path, freq


def _read(freq: np.ndarray, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("part", "number", "doc_ids", "sizes", "data")}
                ids = decode(row["data"].as_py(), freq)
                sizes = np.array(row["sizes"].as_py(), np.int64)
                ends = np.cumsum(sizes)
                raw, n = ids.astype("<u4").tobytes(), len(sizes)
                out = {
                    "part": pa.array([row["part"].as_py()] * n, pa.int32()),
                    "number": pa.array([row["number"].as_py()] * n, pa.int32()),
                    "doc_id": pa.array(row["doc_ids"].as_py(), pa.int64()),
                    "offset": pa.array(ends - sizes, pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.int64()),
                }
                if keep_ids:
                    out["ids"] = pa.array(np.split(ids.astype(np.int32), ends[:-1]), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return run


def table(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/table").collect()
    freq = np.zeros(max([0, *(r["id"] for r in rows)]) + 1, np.uint32)  # the last is the escape's
    for r in rows:
        freq[r["id"]] = r["freq"]
    return freq


def read(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of all documents in the files under ``path``, decoded in parallel.

    start counts all ids before the document: of the ranges before, of the files before in its range, and in its file. What
    ``write`` was given comes back row by row: null doc_ids, repeated rows, texts without ids but the end's. Files without
    documents give no rows.
    """
    files = spark.read.schema(FILE).parquet(f"{path}/files")
    sizes = files.select("part", "number", "n_ids")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each range
    of_part = of_part.select("part", before(Window.orderBy("part")).alias("p0"))
    of_file = sizes.withColumnRenamed("n_ids", "n").select("part", "number", before(Window.partitionBy("part").orderBy("number")).alias("f0"))
    schema = "part int, number int, doc_id long, offset long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    rows = files.mapInArrow(_read(table(spark, path), keep_ids), schema)
    rows = rows.join(of_file.join(of_part, "part"), ["part", "number"])
    return rows.select("doc_id", (F.col("p0") + F.col("f0") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)
