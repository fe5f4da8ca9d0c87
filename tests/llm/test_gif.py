import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from sievelake.llm import gif
from sievelake.llm.registry import gif_digest


def slow_decode(stream, root):
    """Bit by bit, by the book."""
    bits = "".join(f"{b:08b}"[::-1] for b in stream)
    clear, at, out, prev, table, width = 1 << root, 0, b"", None, {}, root + 1
    while True:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, width, prev = {i: bytes([i]) for i in range(clear)}, root + 1, None
            n = clear + 2
            continue
        if code == clear + 1:
            return out
        run = table[code] if code in table else prev + prev[:1]
        if prev is not None and n < 4096:
            table[n] = prev + run[:1]
            n += 1
        if n == 1 << width and width < 12:
            width += 1
        out, prev = out + run, run


@pytest.mark.parametrize("data", [b"", b"a", b"a" * 9000, bytes(range(256)) * 40, random.Random(3).randbytes(30000), b"the cat and the dog " * 900])
def test_code_stream(data):
    stream = gif.lzw_encode(data)
    assert slow_decode(stream, 8) == data
    assert gif.lzw_decode(stream, 8, len(data)) == data


def test_deferred_clear():
    """A stream that goes on with 12-bit codes after its table is full."""
    rng = random.Random(5)
    data = rng.randbytes(9000)
    at, value = 0, 0
    for k, code in enumerate([256, *data, 257]):
        width = 9 if k == 0 else int(gif.widths(np.array([k - 1]), 9)[0])
        value |= code << at
        at += width
    stream = value.to_bytes((at + 7) // 8, "little")
    assert gif.lzw_decode(stream, 8, len(data)) == data


def animation(disposal, clear=None):
    """Two frames of a 2 x 2 canvas over a four-colour palette; the second is one pixel at (1, 0)."""
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])

    def image(left, top, w, h, samples):
        value = at = 0
        for k, code in enumerate([4, *samples, 5]):
            width = 3 if k == 0 else int(gif.widths(np.array([k - 1]), 3)[0])
            value |= code << at
            at += width
        return b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0) + b"\x02" + gif.blocks(value.to_bytes((at + 7) // 8, "little"))

    control = lambda d, delay, i: b"\x21\xf9\x04" + struct.pack("<BHB", d << 2 | (i is not None), delay, i or 0) + b"\0"
    return b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + palette + control(1, 5, None) + image(0, 0, 2, 2, [0, 0, 0, 0]) + control(disposal, 7, clear) + image(1, 0, 1, 1, [1]) + control(0, 1, 3) + image(0, 1, 2, 1, [3, 2]) + b"\x3b"


@pytest.mark.parametrize("disposal, clear, pixel", [(1, None, [0, 255, 0, 255]), (2, None, [0, 0, 0, 0]), (3, None, [255, 0, 0, 255]), (1, 1, [255, 0, 0, 255])])
def test_disposal_and_transparency(disposal, clear, pixel):
    shown = [(f.start_ms, f.delay_ms, f.canvas.copy()) for f in gif.frames(animation(disposal, clear))]
    assert [s[:2] for s in shown] == [(0, 50), (50, 70), (120, 10)]
    assert shown[2][2][0, 1].tolist() == pixel
    assert shown[2][2][1].tolist() == [[255, 0, 0, 255], [0, 0, 255, 255]]


def test_interlaced_and_broken():
    data = bytearray(gif.encode_gif(bytes(range(64)) * 11))
    at = data.index(b"\x2c", 13 + 768)
    straight = next(gif.frames(bytes(data))).indices.copy()
    data[at + 9] |= 0x40
    order = [r for a, s in gif.PASSES for r in range(a, 11, s)]
    assert (next(gif.frames(bytes(data))).indices[order] == straight).all()
    for bad in (b"", b"GIF89a", bytes(data[:-40]), b"PNG" + bytes(data)):
        with pytest.raises(gif.GifError):
            list(gif.frames(bad))


def test_round_trip(spark):
    texts = [None, "", "x", "x" * 64, "é" * 50_000, "same", "same"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as media", "2 as n_bytes", "3 as frames")
    rows = {r.doc_id: r for r in gif_digest(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert r.media_sha256 == hashlib.sha256(gif.encode_gif(pad)).hexdigest()
    assert rows[5].feature == rows[6].feature and rows[4].feature.startswith("frames=2;")
    assert gif.read_gifs(spark.createDataFrame([(1, b"no")], "doc_id long, media binary"), keep=("doc_id",)).first().error == "signature"


def test_canvas_bound_and_empty_table(spark):
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"
    media = spark.createDataFrame([(1, huge), (2, None)], "doc_id long, media binary")
    assert [r.error for r in gif.read_gifs(media, keep=("doc_id",)).orderBy("doc_id").collect()] == ["canvas too large", "signature"]
    assert gif_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_codes_between_clears_are_copies_followed_at_once():
    rng = np.random.default_rng(7)
    for data in (b"a" * 70_000, bytes(rng.integers(0, 3, 50_000, dtype=np.uint8)), bytes(rng.integers(0, 256, 9_000, dtype=np.uint8)), b"ab" * 9, b"x"):
        codes, table, have = [], {bytes([i]): i for i in range(256)}, b""
        for i in range(len(data)):  # a plain encoder of one table's codes
            if have + data[i : i + 1] in table:
                have += data[i : i + 1]
                continue
            codes.append(table[have])
            if len(table) == 3838 + 256:
                have = b""
                break
            table[have + data[i : i + 1]] = len(table) + 2
            have = data[i : i + 1]
        if have:
            codes.append(table[have])
        drawn = gif.samples_of(np.array(codes), 256, len(data))
        assert drawn == data[: len(drawn)] and len(drawn) > 0
        assert gif.samples_of(np.array(codes), 256, 5)[:5] == data[:5]
    for wrong in ([258], [65, 259], [65, 258, 260]):
        with pytest.raises(gif.GifError, match="out of range"):
            gif.samples_of(np.array(wrong), 256, 9)
