"""Images found at any offset of a blob: one scan for all leading bytes, a check of each header, lengths from the headers.

Blobs over ``WINDOW`` bytes are cut into pieces that overlap by ``REACH``, the farthest that a check looks, and dealt out, so
that a large blob is not one task. A start belongs to the piece that it begins in. Parts of one image that each have a
header of their own (nodes of a journal, members of an archive) follow each other and are put together afterwards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blobsight.functions.binary import MAGIC
from blobsight.scratch import spread

WINDOW, REACH = 4 << 20, 8192
FOUND = "offset long, format string, length long"
#: Marks (pattern, format, offset in the image) besides the leading bytes that tell a whole blob's format: nodes of all kinds
#: of a journal, and tar headers. The end of a zip says where it began.
MARKS, ZIP_END = ((b"\x85\x19", "jffs2", 0), (b"ustar", "tar", 257)), b"PK\x05\x06"
#: Parts of these are filled up to a multiple of so many bytes before the next one begins.
PADDED = {"jffs2": 4, "cpio": 4, "tar": 512}


def _int(data: bytes, at: int, size: int, order: str = "big") -> int:
    return int.from_bytes(data[at : at + size], order)


def _text(data: bytes, at: int, size: int, base: int) -> int | None:
    """A number in digits, as tar and cpio write them."""
    try:
        return int(data[at : at + size].split(b"\0")[0].strip() or b"0", base)
    except ValueError:
        return None


def _up(n: int, to: int) -> int:
    return -(-n // to) * to


# Each takes a header of up to REACH bytes and gives False, or the image's length (None: the header doesn't say).


def _elf(h: bytes):
    if len(h) < 52 or h[4] not in (1, 2) or h[5] not in (1, 2) or h[6] != 1:
        return False
    order, wide = "<" if h[5] == 1 else ">", h[4] == 2
    if wide and len(h) < 64:
        return False
    ph, sh = struct.unpack_from(order + ("QQ" if wide else "II"), h, 32 if wide else 28)
    size, ph_size, ph_n, sh_size, sh_n = struct.unpack_from(order + "HHHHH", h, 52 if wide else 40)
    return max(size, ph + ph_size * ph_n, sh + sh_size * sh_n)


def _squashfs(h: bytes):
    order = "little" if h[:4] == b"hsqs" else "big"
    return _int(h, 40, 8, order) if len(h) >= 96 and 1 <= _int(h, 28, 2, order) <= 4 else False


def _jffs2(h: bytes):
    order = "little" if h[0] == 0x85 else "big"
    sound = len(h) >= 12 and zlib.crc32(h[:8], 0xFFFFFFFF) ^ 0xFFFFFFFF == _int(h, 8, 4, order)  # begun at 0, not turned over at the end
    return _int(h, 4, 4, order) if sound and _int(h, 4, 4, order) >= 12 else False


def _ubi(h: bytes):
    return None if len(h) >= 64 and h[4] == 1 and h[5:8] == b"\0\0\0" else False


def _ubifs(h: bytes):
    return None if len(h) >= 64 and h[4] == 1 and h[5] in (1, 2) else False


def _cramfs(h: bytes):
    return _int(h, 4, 4, "little") if h[16:32] == b"Compressed ROMFS" else False


def _uimage(h: bytes):
    return 64 + _int(h, 12, 4) if len(h) >= 64 and zlib.crc32(h[:4] + b"\0" * 4 + h[8:64]) == _int(h, 4, 4) else False


def _dtb(h: bytes):
    total = _int(h, 4, 4)
    return total if len(h) >= 40 and total >= 40 and 2 <= _int(h, 20, 4) <= 17 and _int(h, 8, 4) <= total and _int(h, 12, 4) <= total else False


def _zip(h: bytes):
    if len(h) < 31 or h[4] > 63 or _int(h, 8, 2, "little") not in (0, 1, 6, 8, 9, 12, 14, 93, 95, 98, 99) or not _int(h, 26, 2, "little"):
        return False
    return None if h[6] & 8 else 30 + sum(_int(h, at, n, "little") for at, n in ((18, 4), (26, 2), (28, 2)))


def _gzip(h: bytes):
    return None if len(h) >= 18 and h[2] == 8 and not h[3] & 0xE0 and h[8] in (0, 2, 4) and (h[9] <= 13 or h[9] == 255) else False


def _bzip2(h: bytes):
    return None if h[3:4] in b"123456789" and h[4:10].hex() in ("314159265359", "177245385090") else False


def _xz(h: bytes):
    return None if len(h) >= 12 and h[6] == 0 and h[7] <= 15 and zlib.crc32(h[6:8]) == _int(h, 8, 4, "little") else False


def _lzma(h: bytes):
    if len(h) < 18 or h[13]:
        return False
    words, size = _int(h, 1, 4, "little"), _int(h, 5, 8, "little")
    low = words & -words
    return None if words and words in (low, low * 3) and (size == (1 << 64) - 1 or 0 < size < 1 << 40) else False


def _zstd(h: bytes):
    if len(h) < 9 or h[4] & 8:
        return False
    alone, content = h[4] >> 5 & 1, h[4] >> 6
    at = 5 + (not alone) + (0, 1, 2, 4)[h[4] & 3] + ((1 if alone else 0) if not content else 1 << content)
    block = _int(h, at, 3, "little")
    return None if block >> 1 & 3 != 3 and block >> 3 <= 1 << 17 else False


def _cpio(h: bytes):
    if h[:2] == b"\xc7\x71":
        name, size = _int(h, 20, 2, "little"), _int(h, 22, 2, "little") << 16 | _int(h, 24, 2, "little")
        return 26 + _up(name, 2) + _up(size, 2) if 1 <= name < 4096 and h[25 + name : 26 + name] == b"\0" else False
    base, width, at = (8, 6, 76) if h[5:6] == b"7" else (16, 8, 110)
    if h[5:6] not in b"127" or len(h) < at:
        return False
    name, size = (_text(h, 59, 6, 8), _text(h, 65, 11, 8)) if base == 8 else (_text(h, 94, width, 16), _text(h, 54, width, 16))
    if name is None or size is None or not 1 <= name < 4096 or h[at + name - 1 : at + name] != b"\0":
        return False
    return at + name + size if base == 8 else _up(at + name, 4) + _up(size, 4)


def _pe(h: bytes):
    at = _int(h, 60, 4, "little")
    if not 64 <= at <= REACH - 24 or h[at : at + 4] != b"PE\0\0":
        return False
    table = at + 24 + _int(h, at + 20, 2, "little")
    ends = [_int(h, s + 16, 4, "little") + _int(h, s + 20, 4, "little") for s in range(table, table + 40 * _int(h, at + 6, 2, "little"), 40)]
    return max([table, *ends])


def _tar(h: bytes):
    if len(h) < 512:
        return False
    size = _text(h, 124, 12, 8)
    return 512 + _up(size, 512) if size is not None and _text(h, 148, 8, 8) == sum(h[:148]) + 256 + sum(h[156:512]) else False


CHECKS: dict[str, Callable[[bytes], int | bool | None]] = {
    "elf": _elf, "squashfs": _squashfs, "jffs2": _jffs2, "ubi": _ubi, "ubifs": _ubifs, "cramfs": _cramfs, "uimage": _uimage, "dtb": _dtb, "zip": _zip,
    "gzip": _gzip, "bzip2": _bzip2, "xz": _xz, "lzma": _lzma, "zstd": _zstd, "cpio": _cpio, "pe": _pe, "tar": _tar,
}


def _places(data: np.ndarray, pattern: bytes, candidates: np.ndarray) -> np.ndarray:
    """Where ``pattern`` is, of the places where its first byte is."""
    at = candidates[candidates <= len(data) - len(pattern)]
    for i, byte in enumerate(pattern[1:], 1):
        at = at[data[at + i] == byte]
    return at


def starts(data: bytes, upto: int | None = None) -> list[tuple[int, str, int | None]]:
    """(offset, format, length) of all headers that begin in the first ``upto`` bytes and pass their checks."""
    x, upto, found = np.frombuffer(data, np.uint8), len(data) if upto is None else upto, set()
    patterns = [(bytes.fromhex(m), name, 0) for m, name in MAGIC] + [*MARKS]
    first = np.zeros(256, bool)
    first[[p[0] for p, _, _ in patterns] + [ZIP_END[0]]] = True
    hits = np.flatnonzero(first[x])  # one pass over the bytes; all else looks at these only
    leads = x[hits]
    for pattern, name, before in patterns:
        for at in (_places(x, pattern, hits[leads == pattern[0]]) - before).tolist():
            if 0 <= at < upto:
                length = CHECKS[name](data[at : at + REACH])
                if length is not False:
                    found.add((at, name, length))
    for at in _places(x, ZIP_END, hits[leads == ZIP_END[0]]).tolist():
        if at < upto and at + 22 <= len(data):
            size, back = _int(data, at + 12, 4, "little"), _int(data, at + 16, 4, "little")
            found.add((at - size - back, "zip", size + back + 22 + _int(data, at + 20, 2, "little")))
    return sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))


def _scan(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, base + at, name, length) for i, (piece, base) in enumerate(zip(batch.column("piece"), batch.column("base").to_pylist(), strict=True)) for at, name, length in starts(piece.as_py(), window)]
        row, offset, name, length = zip(*found, strict=True) if found else ((), (), (), ())
        own = batch.select(["job_id", "path", "size"]).take(pa.array(row, pa.int64()))
        yield own.append_column("offset", pa.array(offset, pa.int64())).append_column("format", pa.array(name, pa.string())).append_column("length", pa.array(length, pa.int64()))


def carve(blobs: DataFrame, window: int | None = None) -> DataFrame:
    """(job_id, path, offset, format, length, until) of the images in ``blobs`` (job_id, path, content), at any offset.

    ``length`` is what the image's headers say, null where they don't; ``until`` is where to cut: the image's end or, without
    one, the next image's start, and never behind the blob's end. An image whose header claims more than there is stays. A
    start of the same format within an image, or right behind it, is a part of it. Null and empty contents have none.
    """
    window = window or WINDOW
    rows = blobs.where("content is not null").select("job_id", "path", "content", F.length("content").cast("long").alias("size"))
    whole = rows.where(F.col("size") <= window).select("job_id", "path", "size", F.lit(0).cast("long").alias("base"), F.col("content").alias("piece"))
    cut = rows.where(F.col("size") > window).withColumn("base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(window).cast("long"))))
    cut = cut.select("job_id", "path", "size", "base", F.substring("content", F.col("base").cast("int") + 1, F.lit(window + REACH)).alias("piece"))
    cut = spread(cut, "job_id", "path", "base")

    kinds = dict(rows.dtypes)
    found = whole.unionAll(cut).mapInArrow(lambda batches: _scan(batches, window), f"job_id {kinds['job_id']}, path {kinds['path']}, size long, {FOUND}").where("offset >= 0")
    pad = F.lit(1)
    for name, n in PADDED.items():
        pad = F.when(F.col("format") == name, n).otherwise(pad)
    end = F.col("offset") + F.coalesce("length", F.lit(1))
    own = Window.partitionBy("job_id", "path", "format").orderBy("offset", F.desc("length"))
    found = found.withColumn("before", F.max(F.col("offset") + F.ceil(F.coalesce("length", F.lit(1)) / pad) * pad).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    # parts begin in or right behind what was there before; an image without a length takes none behind it
    apart = F.col("before").isNull() | (F.col("offset") > F.col("before")) | (F.col("offset") == F.col("before")) & ~F.col("format").isin(*PADDED, "zip")
    found = found.withColumn("image", F.sum(apart.cast("int")).over(own))
    images = found.groupBy("job_id", "path", "size", "format", "image").agg(F.min("offset").alias("offset"), F.max(F.when(F.col("length").isNotNull(), end)).alias("end"))
    following = F.min("offset").over(Window.partitionBy("job_id", "path").orderBy("offset").rangeBetween(1, Window.unboundedFollowing))
    return images.select("job_id", "path", "offset", "format", (F.col("end") - F.col("offset")).alias("length"), F.least(F.coalesce("end", following, "size"), "size").alias("until"))


def cut_out(blobs: DataFrame, images: DataFrame) -> DataFrame:
    """(job_id, path, offset, format, content): the bytes of each image that ``carve`` found in ``blobs``."""
    rows = blobs.select("job_id", "path", "content").join(images, ["job_id", "path"])
    body = F.substring("content", F.col("offset").cast("int") + 1, (F.col("until") - F.col("offset")).cast("int"))
    return rows.select("job_id", "path", "offset", "format", body.alias("content"))


def extractor(data: bytes) -> list[tuple[str, bytes]]:
    """The images within one blob as members named by offset and format, for ``unpack(extractors=(extractor,))``; none where the
    blob is one image, or holds none."""
    images: list[list] = []
    last: dict[str, list] = {}
    for at, name, length in starts(data):
        if at < 0:
            continue
        was, end = last.get(name), at + (length or 1)
        padded = at + _up(length or 1, PADDED.get(name, 1))
        if was and (at < was[3] or at == was[3] and (name in PADDED or name == "zip")):
            was[3] = max(was[3], padded)
            was[2] = max(was[2] or 0, end) if length else was[2]
            continue
        last[name] = [at, name, end if length else None, padded]
        images.append(last[name])
    images.sort(key=lambda i: i[0])
    if not images or images[0][0] == 0 and (len(images) == 1 or (images[0][2] or 0) >= len(data)):
        return []
    firsts = [i[0] for i in images]
    after = lambda at: min((f for f in firsts if f > at), default=len(data))
    return [(f"{at:08x}.{name}", data[at : min(end or after(at), len(data))]) for at, name, end, _ in images if at]
