"""Headers of blobs, Bloom positions, entropy and hardening flags."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes in hex and the format they show, in the order in which they are tried.
MAGIC = (
    ("7F454C46", "elf"), ("68737173", "squashfs"), ("73717368", "squashfs"), ("85190320", "jffs2"), ("1985", "jffs2"),
    ("55424923", "ubi"), ("55424921", "ubifs"), ("453DCD28", "cramfs"), ("27051956", "uimage"), ("D00DFEED", "dtb"),
    ("504B0304", "zip"), ("1F8B", "gzip"), ("425A68", "bzip2"), ("FD377A585A00", "xz"), ("5D0000", "lzma"),
    ("28B52FFD", "zstd"), ("3037303730", "cpio"), ("C771", "cpio"), ("4D5A", "pe"),
)
HEADER, LEAST_BYTES, MOST_RATIO = 512, 64, 100
BLOOM_BITS, BLOOM_HASHES = 958_506, 7
SECTION, PACKED, MOST_SECTIONS = 65_536, 7.2, 4096


def detect_format(header: Column) -> Column:
    """Format by the leading bytes, then by ``ustar`` at 257; null if unknown."""
    start = F.hex(F.substring(header, 1, 16))
    out = F.when(F.substring(header, 258, 5) == F.lit(b"ustar"), F.lit("tar"))
    for magic, name in reversed(MAGIC):
        out = F.when(start.startswith(magic), F.lit(name)).otherwise(out)
    return out


def declared_size(header: Column) -> Column:
    """Bytes that a header claims (decimal): uImage at 12 with its big end first, squashfs at 40 with its little end first."""
    number = lambda h: F.conv(h, 16, 10).cast("decimal(20,0)")
    part = lambda at, n: F.hex(F.substring(header, at + 1, n))
    little = F.concat(*[part(47 - i, 1) for i in range(8)])
    start = F.hex(F.substring(header, 1, 4))
    return F.when((start == "27051956") & (F.length(header) >= 16), number(part(12, 4))).when((start == "68737173") & (F.length(header) >= 48), number(little))


def precheck(header: Column, size: Column) -> Column:
    """Why a blob is turned away before anything else is read; null if it isn't."""
    too_large = declared_size(header) > F.lit(MOST_RATIO) * size
    return F.when(size < LEAST_BYTES, "too_small").when(detect_format(header).isNull(), "unknown_format").when(too_large, "declared_size_mismatch")


def hex_modulo(digits: Column, modulus: int) -> Column:
    """A number of any length in hex, modulo ``modulus``: seven digits at a time."""
    count = F.ceil(F.length(digits) / 7.0).cast("int")
    padded = F.lpad(digits, count * 7, "0")
    part = lambda i: F.conv(F.substring(padded, i * 7 + 1, F.lit(7)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(0), count - 1), F.lit(0).cast("long"), lambda a, i: (a * F.lit(1 << 28) + part(i)) % modulus)


def bloom_positions(key: Column, bits: int = BLOOM_BITS, hashes: int = BLOOM_HASHES) -> Column:
    """array<long>: (h1 + i h2) mod bits with h1 from SHA-256 and an odd h2 from SHA3-256, which is not a built-in function."""

    def of(text: str | None) -> list[int] | None:
        if text is None:
            return None
        h1, h2 = (int.from_bytes(h(text.encode()).digest()) for h in (hashlib.sha256, hashlib.sha3_256))
        return [(h1 + i * (h2 | 1)) % bits for i in range(hashes)]

    def positions(texts: pd.Series) -> pd.Series:
        return texts.map(of)

    return F.pandas_udf(positions, "array<long>")(key)


def entropy_of(block: bytes) -> float:
    counts = np.bincount(np.frombuffer(block, np.uint8), minlength=256)
    p = counts[counts > 0] / max(1, len(block))
    return float(-(p * np.log2(p)).sum()) + 0.0


def _sections(content: pd.Series) -> pd.Series:
    def of(x: bytes | None) -> list:
        out = []
        for at in range(0, min(len(x or b""), SECTION * MOST_SECTIONS), SECTION):
            e = entropy_of(x[at : at + SECTION])
            out.append({"offset": at, "entropy": round(min(e, 8.0), 4), "flagged_packed": e >= PACKED})
        return out

    return content.map(of)


def entropy_sections(content: Column) -> Column:
    """Entropy of each section of 64 KiB, up to 4096 of them; flagged by the value before rounding."""
    return F.pandas_udf(_sections, "array<struct<offset: long, entropy: double, flagged_packed: boolean>>")(content)


def hardening_of(data: bytes) -> dict:
    """nx, pie and relro of an ELF image; all off for anything else or cut short."""
    off = {"nx": False, "pie": False, "relro": "none"}
    if len(data) < 6 or data[:4] != b"\x7fELF":
        return off
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    get = lambda kind, at: struct.unpack_from(order + kind, data, at)[0]
    try:
        out = off | {"pie": get("H", 16) == 3}
        table, size, count = (get("Q", 32), get("H", 54), get("H", 56)) if wide else (get("I", 28), get("H", 42), get("H", 44))
        dynamic = None
        for at in range(table, table + size * count, size or 1):
            if at + size > len(data):
                break
            kind, flags = get("I", at), get("I", at + (4 if wide else 24))
            if kind == 0x6474E551:
                out["nx"] = not flags & 1
            elif kind == 0x6474E552:
                out["relro"] = "partial"
            elif kind == 2:
                dynamic = (get("Q", at + 8), get("Q", at + 32)) if wide else (get("I", at + 4), get("I", at + 16))
        if dynamic and out["relro"] == "partial":
            step, kind = (16, "QQ") if wide else (8, "II")
            for at in range(dynamic[0], min(sum(dynamic), len(data)) - step + 1, step):
                tag, value = struct.unpack_from(order + kind, data, at)
                if tag == 0:
                    break
                if tag == 24 or tag == 30 and value & 8 or tag == 0x6FFFFFFB and value & 1:
                    out["relro"] = "full"
        return out
    except struct.error:
        return off


def _hardening(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([hardening_of(x or b"") for x in content], columns=["nx", "pie", "relro"])


def hardening(content: Column) -> Column:
    """struct<nx, pie, relro> of each image."""
    return F.pandas_udf(_hardening, "struct<nx: boolean, pie: boolean, relro: string>")(content)
