"""The reader of media columns on images that our own writer doesn't make."""

import numpy as np

from rillstone.llm import media


def written(width, height, factors, restart, quantiser, rng):
    """A baseline image of random coefficients, and the DC values of its first component."""
    hmax, vmax = max(h for h, _ in factors), max(v for _, v in factors)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    if len(factors) == 1:
        across, down = -(-width // 8), -(-height // 8)
    dc_code = {size: format(size, "04b") for size in range(12)}
    ac_symbols = [0, 0xF0] + [run << 4 | size for run in range(16) for size in range(1, 11)]
    ac_code = {symbol: format(i, "08b") for i, symbol in enumerate(ac_symbols)}
    value = lambda v: "" if v == 0 else format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b")
    grid = np.zeros((down * (factors[0][1] if len(factors) > 1 else 1), across * (factors[0][0] if len(factors) > 1 else 1)), int)
    scan, bits, last = b"", "", [0] * len(factors)

    def flushed(bits):
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for mcu in range(across * down):
        if restart and mcu and mcu % restart == 0:
            scan += flushed(bits) + bytes([0xFF, 0xD0 + (mcu // restart - 1) % 8])
            bits, last = "", [0] * len(factors)
        for c, (h, v) in enumerate(factors):
            for y in range(v if len(factors) > 1 else 1):
                for x in range(h if len(factors) > 1 else 1):
                    level = int(rng.integers(-90, 90))
                    if c == 0:
                        grid[mcu // across * (v if len(factors) > 1 else 1) + y, mcu % across * (h if len(factors) > 1 else 1) + x] = level
                    diff, last[c] = level - last[c], level
                    bits += dc_code[abs(diff).bit_length()] + value(diff)
                    k = 1
                    for at in sorted(rng.choice(np.arange(1, 64), rng.integers(0, 6), replace=False)):
                        while at - k > 15:
                            bits, k = bits + ac_code[0xF0], k + 16
                        coefficient = int(rng.integers(1, 200)) * int(rng.choice([-1, 1]))
                        bits += ac_code[(int(at) - k) << 4 | abs(coefficient).bit_length()] + value(coefficient)
                        k = int(at) + 1
                    if k < 64:
                        bits += ac_code[0]
    scan += flushed(bits)
    parts = b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors))
    out = b"\xff\xd8" + media._segment(0xE0, b"JFIF\0") + media._segment(media.DQT, bytes([0]) + bytes([quantiser] * 64))
    out += media._segment(media.SOF0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(factors)]) + parts)
    out += media._segment(media.DHT, bytes([0x00] + [0, 0, 0, 12] + [0] * 12) + bytes(range(12))) + media._segment(media.DHT, bytes([0x10] + [0] * 7 + [len(ac_symbols)] + [0] * 8) + bytes(ac_symbols))
    out += media._segment(media.DRI, restart.to_bytes(2, "big")) if restart else b""
    out += media._segment(media.SOS, bytes([len(factors)]) + b"".join(bytes([i + 1, 0]) for i in range(len(factors))) + bytes([0, 63, 0]))
    return out + scan + b"\xff\xd9", grid[: -(-height * factors[0][1] // (8 * vmax)), : -(-width * factors[0][0] // (8 * hmax))]


def test_any_baseline_image_is_decoded():
    rng = np.random.default_rng(11)
    for width, height, factors, restart, quantiser in ((40, 24, [(2, 2), (1, 1), (1, 1)], 2, 6), (33, 70, [(1, 1)], 0, 8), (64, 16, [(1, 1)], 3, 4), (50, 50, [(2, 1), (1, 1)], 0, 5), (16, 16, [(1, 1), (1, 1), (1, 1)], 1, 9)):
        image, dc = written(width, height, factors, restart, quantiser, rng)
        ((w, h, thumb),) = media.decode(image)
        assert (w, h) == (width, height)
        assert np.array_equal(thumb, np.clip((dc * quantiser + 4) // 8 + 128, 0, 255))


def test_both_ways_of_decoding_agree():
    payload = np.random.default_rng(12).integers(0, 256, 64 * 40, dtype=np.uint8).tobytes()
    stored = media.encode(payload)
    fast = media.described(stored)
    slow = media._alike_dc
    try:
        media._alike_dc = lambda *_: None
        assert media.described(stored) == fast and fast[0] == payload
    finally:
        media._alike_dc = slow


def test_several_images_and_what_is_none():
    payload = bytes(range(256)) * 2049  # beyond one image's height
    stored = media.encode(media.pad(payload))
    assert media.described(stored)[0] == media.pad(payload) and media.described(stored)[3] == 2
    for odd in (None, b"", b"\xff", b"\xff\xd8", b"no image", stored[:1000], stored[:-2], stored + b"x"):
        assert media.described(odd) == (None,) * 6


def test_null_media_read_as_nulls(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(media.encode(media.pad(b"abc"))))], "k int, m binary")
    got = {r.k: r.r for r in rows.select("k", media.read(F.col("m")).alias("r")).collect()}
    assert got[1].payload is None and got[2].width is None and bytes(got[3].payload) == media.pad(b"abc")
    got = {r.k: r.r for r in rows.select("k", media.digest(F.col("m")).alias("r")).collect()}
    assert got[1].payload_bytes is None and got[2].feature is None and got[3].payload_bytes == 64
