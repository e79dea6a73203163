"""Media columns: texts stored losslessly as baseline JPEG images, and a reader that rebuilds DC-only luminance thumbnails.

Each byte of a payload is the level of one 8 x 8 block of a grey image, 64 blocks to a row. With a quantiser of 8 a block's
DC coefficient is the byte less 128, so nothing is lost, and a block's AC part is one end-of-block code. The Huffman table
for DC categories gives category c a code of 9 - c bits: with the c bits that follow, every block takes 10 bits, and both
directions work on whole arrays. The reader decodes any baseline file (several components, sampling, restarts, AC codes).
It decodes by the tables that the file itself holds: where these give every block with no AC part the same number of bits,
each such stretch of bits is decoded once and the scan's blocks are looked up; a scan with any other block, several
components or restarts is decoded step by step.

Defined cases: null text is empty; an empty text gives 64 zero bytes; a payload beyond the height limit of one image
(524,224 bytes) is stored as images one after another, so texts of any length are whole; equal texts and repeated rows give
equal bytes; null media, and bytes that are no whole baseline image, read as nulls; an empty table gives an empty result;
other columns pass through, but one of the name given to ``store`` is replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, table, unboxed

#: Blocks in a row of an image; most rows of blocks in 65,535 lines.
ROW = 64
MOST_ROWS = 8191
#: Marker codes of the format (fixed values).
SOI, EOI, SOF0, DHT, DQT, DRI, SOS = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


#: What reading a media value gives.
READ = T.StructType(
    [
        T.StructField("payload", T.BinaryType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("images", T.IntegerType()),
        T.StructField("thumb_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


def _codes() -> np.ndarray:
    """For each difference from -255 to 255 its 10 bits: category code, value bits, end of block (0)."""
    out = np.zeros(511, np.uint64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        prefix = ((1 << (8 - size)) - 1) << 1  # 8 - size ones and a zero
        bits = diff if diff > 0 else diff + (1 << size) - 1
        out[diff + 255] = ((prefix << size) | bits) << 1
    return out


CODES = _codes()
HEAD = b"\xff\xd8" + _segment(DQT, bytes([0]) + bytes([8] * 64))
TABLES = _segment(DHT, bytes([0x00] + [1] * 9 + [0] * 7 + [8, 7, 6, 5, 4, 3, 2, 1, 0])) + _segment(DHT, bytes([0x10, 1] + [0] * 15 + [0]))
#: Marks bits that are no block without AC part.
NOT_ONE = 1 << 20
SCAN = _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0]))


def pad(body: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return body + b"\0" * (-len(body) % ROW if body else ROW)


def encode(payload: bytes) -> bytes:
    """JPEG images, one after another, whose blocks are the payload's bytes; its length is a multiple of 64."""
    images = []
    for at in range(0, len(payload), ROW * MOST_ROWS):
        levels = np.frombuffer(payload, np.uint8, min(ROW * MOST_ROWS, len(payload) - at), at).astype(np.int32) - 128
        code = CODES[np.diff(levels, prepend=0) + 255].reshape(-1, 4)
        forty = (code[:, 0] << 30) | (code[:, 1] << 20) | (code[:, 2] << 10) | code[:, 3]
        bits = np.ascontiguousarray(forty.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()
        frame = _segment(SOF0, bytes([8]) + (len(levels) // ROW * 8).to_bytes(2, "big") + (ROW * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
        images.append(HEAD + frame + TABLES + SCAN + bits.replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
    return b"".join(images)


def _lookup(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol for a canonical table."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    """Bits of one entropy-coded stretch, first bit first."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n]:
            out = out << 1 | int(b)
        self.at += n
        return out

    def symbol(self, lookup: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            if (length, code) in lookup:
                return lookup[length, code]
        raise ValueError("no such Huffman code")

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


#: What ``_same_length`` made of the tables seen so far; a worker sees few.
_KNOWN: dict[tuple, tuple[int, np.ndarray] | None] = {}


def _same_length(dc: dict[tuple[int, int], int], ac: dict[tuple[int, int], int]) -> tuple[int, np.ndarray] | None:
    """Bits of a block without AC part, and the difference behind each value of so many bits (or a mark where it isn't one).

    None if the tables give such blocks different lengths, or more than 16 bits.
    """
    key = (tuple(dc.items()), tuple(ac.items()))
    if key not in _KNOWN:
        if len(_KNOWN) > 1000:
            _KNOWN.clear()
        end = next((k for k, symbol in ac.items() if symbol == 0), None)
        widths = {length + size + end[0] for (length, _), size in dc.items()} if end else set()
        _KNOWN[key] = None
        if len(widths) == 1 and max(widths) <= 16:
            width = max(widths)
            behind = np.full(1 << width, NOT_ONE, np.int32)
            for (length, code), size in dc.items():
                value = np.arange(1 << size)
                at = ((code << size | value) << end[0]) | end[1]
                behind[at] = np.where(value >> max(size - 1, 0) == (1 if size else 0), value, value - (1 << size) + 1)
            _KNOWN[key] = width, behind
    return _KNOWN[key]


def _alike_dc(frame: dict, tables: dict, scan: list, stretches: list[bytes], restart: int) -> np.ndarray | None:
    """DC values of a one-component scan whose blocks all have the same number of bits and no AC part; else None."""
    dc, ac = scan[0][1]
    if len(frame["parts"]) > 1 or restart or len(stretches) > 1:
        return None
    found = _same_length(tables[0, dc], tables[1, ac])
    across, down = -(-frame["width"] // 8), -(-frame["height"] // 8)
    if found is None:
        return None
    width, behind = found
    n, bits = across * down, np.unpackbits(np.frombuffer(stretches[0], np.uint8))
    if len(bits) < n * width:
        return None
    # each block's bits as one number; the first block starts at the first bit, so every block that is one starts the next
    value = np.zeros(n, np.int32)
    for one in bits[: n * width].reshape(n, width).T:
        value = value << 1 | one
    diffs = behind[value]
    return None if (diffs == NOT_ONE).any() else np.cumsum(diffs, dtype=np.int32).reshape(down, across)


def _luminance_dc(frame: dict, tables: dict, scan: list, stretches: list[bytes], restart: int) -> np.ndarray:
    """DC values of the first component, as a grid of blocks; step by step."""
    parts = frame["parts"]
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    one = len(scan) == 1
    first = parts[0]
    across, down = -(-frame["width"] * first[1] // (8 * hmax)), -(-frame["height"] * first[2] // (8 * vmax))
    mcus_across, mcus_down = (across, down) if one else (-(-frame["width"] // (8 * hmax)), -(-frame["height"] // (8 * vmax)))
    grid = np.zeros((mcus_down * (1 if one else first[2]), mcus_across * (1 if one else first[1])), np.int32)
    mcu = 0
    for data in stretches:
        bits, last = _Bits(data), {p[0]: 0 for p in parts}
        for _ in range(min(restart or mcus_across * mcus_down, mcus_across * mcus_down - mcu)):
            for part, (dc, ac) in scan:
                _, h, v, _ = next(p for p in parts if p[0] == part)
                for y in range(1 if one else v):
                    for x in range(1 if one else h):
                        last[part] += bits.value(bits.symbol(tables[0, dc]))
                        if part == first[0]:
                            grid[mcu // mcus_across * (1 if one else v) + y, mcu % mcus_across * (1 if one else h) + x] = last[part]
                        k = 1
                        while k < 64:
                            run = bits.symbol(tables[1, ac])
                            if run == 0:
                                break
                            k += (run >> 4) + 1
                            bits.at += run & 15
            mcu += 1
    return grid[:down, :across]


def decode(media: bytes) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, thumbnail) of each image: a thumbnail has one luminance sample for each block of the first component."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no image starts here")
        at += 2
        quant, tables, frame, restart, scan, dc = {}, {}, {}, 0, None, None
        while True:
            while media[at + 1] == 0xFF:
                at += 1
            marker = media[at + 1]
            if marker == EOI:
                at += 2
                break
            size = int.from_bytes(media[at + 2 : at + 4], "big")
            body = media[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == DQT:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[65 + 64 * wide :]
            elif marker == DHT:
                while body:
                    n = sum(body[1:17])
                    tables[body[0] >> 4, body[0] & 15] = _lookup(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == DRI:
                restart = int.from_bytes(body, "big")
            elif marker == SOF0:
                parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
                frame = {"height": int.from_bytes(body[1:3], "big"), "width": int.from_bytes(body[3:5], "big"), "parts": parts}
            elif 0xC1 <= marker <= 0xCF and marker not in (DHT, 0xC8, 0xCC):
                raise ValueError("not a baseline image")
            elif marker == SOS:
                scan = [(body[1 + 2 * i], (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15)) for i in range(body[0])]
                stretches, start = [], at
                while True:  # to the next marker that is neither a stuffed byte nor a restart
                    at = media.index(b"\xff", at)
                    if media[at + 1] == 0:
                        at += 2
                    elif 0xD0 <= media[at + 1] <= 0xD7:
                        stretches.append(media[start:at].replace(b"\xff\x00", b"\xff"))
                        start = at = at + 2
                    else:
                        break
                stretches.append(media[start:at].replace(b"\xff\x00", b"\xff"))
                if frame["parts"][0][0] in [p for p, _ in scan]:
                    dc = _alike_dc(frame, tables, scan, stretches, restart)
                    dc = _luminance_dc(frame, tables, scan, stretches, restart) if dc is None else dc
        if dc is None:
            raise ValueError("no scan of the first component")
        level = np.clip((dc * quant[frame["parts"][0][3]] + 4) // 8 + 128, 0, 255).astype(np.uint8)
        out.append((frame["width"], frame["height"], level))
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """16 hex digits: which cells of an 8 x 8 reduction of the thumbnail are above their mean."""
    rows, columns = ((np.arange(8) * n) // 8 for n in thumb.shape)
    wide = thumb.astype(np.int64)
    if thumb.shape[0] >= 8:
        wide = np.add.reduceat(wide, rows, axis=0) / np.diff(np.append(rows, thumb.shape[0]))[:, None]
    else:
        wide = wide[rows]
    wide = np.add.reduceat(wide, columns, axis=1) / np.diff(np.append(columns, thumb.shape[1])) if thumb.shape[1] >= 8 else wide[:, columns]
    return np.packbits(wide > wide.mean()).tobytes().hex()


@F.pandas_udf(T.BinaryType())
def _store(texts: pd.Series) -> pd.Series:
    return pd.Series([encode(pad((t or "").encode("utf-8", "surrogatepass"))) for t in texts], dtype=object)


def described(media: bytes | None) -> tuple:
    """What ``READ`` names, of a media value; nulls if it isn't one."""
    try:
        images = decode(media or b"")
    except (ValueError, IndexError, KeyError):  # cut off, or no baseline image
        images = []
    if not images:
        return (None,) * 6
    payload = b"".join(t.tobytes() for _, _, t in images)
    width, height = images[0][0], sum(h for _, h, _ in images)
    look = thumbnail_hash(np.vstack([t for _, _, t in images])) if len({t.shape[1] for _, _, t in images}) == 1 else thumbnail_hash(images[0][2])
    return payload, width, height, len(images), hashlib.sha256(payload).hexdigest(), f"jpeg:{width}x{height}:{look}"


@F.pandas_udf(READ)
def _read(media: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in media:
        rows = [described(m) for m in batch]
        yield pd.DataFrame({f.name: pd.Series([r[i] for r in rows], dtype="Int32" if isinstance(f.dataType, T.IntegerType) else object) for i, f in enumerate(READ)})


#: As ``READ``, without the payload itself: its length, digest and the checksum of its last 64 bytes.
DIGEST = T.StructType([T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), *READ.fields[1:4], READ["feature"]])


@F.pandas_udf(DIGEST)
def _digest(media: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in media:
        rows = []
        for m in batch:
            payload, width, height, images, sha256, feature = described(m)
            rows.append((None if payload is None else len(payload), sha256, None if payload is None else zlib.crc32(payload[-ROW:]), width, height, images, feature))
        yield pd.DataFrame({f.name: pd.Series([r[i] for r in rows], dtype={"long": "Int64", "integer": "Int32"}.get(f.dataType.typeName(), object)) for i, f in enumerate(DIGEST)})


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """The rows with their text as JPEG bytes in column ``media``."""
    return unboxed(boxed(docs, _store(F.col(text)).alias("_media")), F.col("_media").alias(media))


def read(media: Column) -> Column:
    """Struct of what the stored bytes hold: payload (the luminance thumbnail's samples), dimensions, hashes."""
    return _read(media)


def digest(media: Column) -> Column:
    """Struct of what the stored bytes hold, with the payload's length and checksums in its place: nothing large comes back."""
    return _digest(media)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op10_media``: all documents stored, read back and digested."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"), "text")
    back = store(docs).select("doc_id", "n_bytes", "media", digest(F.col("media")).alias("r"))
    return back.select(
        "doc_id",
        "n_bytes",
        "r.payload_bytes",
        "r.payload_sha256",
        "r.tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2(F.col("media"), 256).alias("media_sha256"),
        "r.feature",
        "r.width",
        "r.height",
    )
