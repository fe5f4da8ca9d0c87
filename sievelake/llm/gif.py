"""GIF as a media column: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms.

``store_as_gif`` writes byte payloads as the pixels of grey-palette GIFs, ``read_gifs`` decodes any GIF into
its timed frames. Both work row by row inside one task, hold one file at a time and need no exchange.

Defined results: a null payload is an empty one, which is stored as 64 zero bytes; a file that is not a
well-formed GIF, or whose canvas has more than ``MOST_PIXELS`` pixels (a header of 13 bytes can ask for 17 GB), gives a null
frame list and its reason in ``error``; repeated rows give equal values; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sievelake.llm.common import give_back, small_batches

WIDTH, ROWS = 64, 1024
#: Pixels of a canvas that one task may hold (four bytes each, and a copy for disposal).
MOST_PIXELS = 1 << 25
GREY = bytes(v for v in range(256) for _ in range(3))
#: First row, row step of the four passes of an interlaced frame (fixed by the format).
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


class GifError(ValueError):
    pass


def widths(since_clear: np.ndarray, least: int) -> np.ndarray:
    """Bits of the codes by their number since the last clear code: the table grows by one with each code but the first."""
    size = (1 << (least - 1)) + 1 + since_clear
    return np.clip(np.frexp(size.astype(np.float64))[1], least, 12)


@cache
def plan(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the first 4,096 codes after a clear code, and where each begins (one more: the end)."""
    bits = widths(np.arange(4096), least)
    return bits, np.concatenate(([0], np.cumsum(bits)))


def lzw_encode(data: bytes) -> bytes:
    """8-bit samples as one LZW code stream, with a clear code whenever the table is full."""
    codes = [256 << 8]  # codes stand in the upper bits, where the next sample is added
    put, table, new = codes.append, {}, 258 << 8
    if data:
        have = data[0] << 8
        for sample in data[1:]:
            key = have | sample
            if key in table:
                have = table[key]
            else:
                put(have)
                table[key] = new
                new += 256
                if new == 4096 << 8:
                    put(256 << 8)
                    table.clear()
                    new = 258 << 8
                have = sample << 8
        put(have)
    put(257 << 8)
    value = np.array(codes, dtype=np.int64) >> 8
    clear = np.flatnonzero(value == 256)
    # codes by their number since the clear code before them; the first clear code has none before it
    since = np.concatenate(([0], *[np.arange(n) for n in np.diff(np.append(clear, len(value) - 1))]))
    bits = plan(9)[0][since]
    offset = np.concatenate(([0], np.cumsum(bits)))
    shifted, byte = value << (offset[:-1] & 7), offset[:-1] >> 3
    n = int(offset[-1] + 7) >> 3
    out = np.zeros(n + 2, dtype=np.int64)
    for k in range(3):
        out += np.bincount(byte + k, weights=(shifted >> (8 * k)) & 255, minlength=n + 2)[: n + 2].astype(np.int64)
    return out[:n].astype(np.uint8).tobytes()


def resolved(array: np.ndarray) -> np.ndarray:
    """Where chains of places end; ``array`` holds for each the next, or itself at the end."""
    while True:
        further = array[array]
        if np.array_equal(further, array):
            return array
        array = further


def samples_of(codes: np.ndarray, clear: int, most: int) -> bytes:
    """``most`` samples, or all, of the codes between two clear codes. Entry k of the table is what code k drew and one sample more, so each code
    but the roots is a copy from what was drawn before, and all copies are followed at once."""
    at = np.arange(len(codes), dtype=np.int32)
    entry = codes - (clear + 2)
    if (entry >= at).any():
        raise GifError("code out of range")
    root = entry < 0
    # lengths: steps from a code over entries to its root
    length, to = np.where(root, 0, 1), np.where(root, at, entry)
    while True:
        more = length[to]
        if not more.any():
            break
        length, to = length + more, to[to]
    length += 1
    start = np.concatenate(([0], np.cumsum(length)))
    n = min(int(np.searchsorted(start, most)), len(codes))
    start, length, root, entry = start[: n + 1], length[:n], root[:n], entry[:n]
    back = np.where(root, 0, start[:-1] - start[:-1][np.where(root, 0, entry)])
    source = np.arange(start[-1], dtype=np.int32) - np.repeat(back, length).astype(np.int32)
    drawn = np.zeros(start[-1], dtype=np.uint8)
    drawn[start[:-1][root]] = codes[:n][root]
    return drawn[resolved(source)].tobytes()


def lzw_decode(stream: bytes, root_bits: int, wanted: int) -> bytes:
    """The samples of a code stream. Codes are unpacked a table's length at a time, as their widths follow from their number."""
    if not 1 <= root_bits <= 8:
        raise GifError("code size")
    clear, end = 1 << root_bits, (1 << root_bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    total, at, seen, got = 8 * len(stream), 0, 0, 0
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, before, out = list(roots), None, []
    while got < wanted:
        if seen:
            bits = widths(np.arange(seen, seen + 4096), root_bits + 1)
            offset = at + np.concatenate(([0], np.cumsum(bits)))
        else:
            bits, offset = plan(root_bits + 1)
            most = (total - at) // (root_bits + 1)
            bits, offset = bits[:most], at + offset[: most + 1]
        n = int(np.searchsorted(offset, total, "right")) - 1
        if n <= 0:
            raise GifError("code stream ends early")
        offset, bits = offset[: n + 1], bits[:n]
        byte = offset[:-1] >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (offset[:-1] & 7)) & ((1 << bits) - 1)
        special = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(special[0]) if len(special) else n
        one_by_one = before is not None or stop == n  # a table that is kept when it is full, or a stream without an end
        if not one_by_one:
            out.append(samples_of(codes[:stop], clear, wanted - got))
            got += len(out[-1])
        size, add = len(table), table.append
        for code in codes[:stop].tolist() if one_by_one else ():
            if code < size:
                run = table[code]
            elif code == size and before is not None:
                run = before + before[:1]
            else:
                raise GifError("code out of range")
            if before is not None and size < 4096:
                add(before + run[:1])
                size += 1
            out.append(run)
            got += len(run)
            before = run
        if stop < n:
            at, seen, before = int(offset[stop + 1]), 0, None
            if len(table) > len(roots):
                table = list(roots)
            if codes[stop] == end:
                break
        else:
            at, seen = int(offset[n]), seen + n
    data = b"".join(out)
    if len(data) < wanted:
        raise GifError("too few samples")
    return data[:wanted]


def blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part)]) + part for part in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay_cs: int = 4) -> bytes:
    """The payload's bytes as pixels, ``rows`` rows of ``width`` in a frame; its length must be a positive multiple of width."""
    if not payload or len(payload) % width:
        raise ValueError(f"the payload must fill rows of {width}")
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, len(payload) // width), 0xF7, 0, 0), GREY]
    for i in range(0, len(payload), width * rows):
        part = payload[i : i + width * rows]
        out += [b"\x21\xf9\x04\x04", struct.pack("<H", delay_cs), b"\0\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """One frame: when it is shown, the rectangle that it draws, its palette indices there, and the whole canvas as RGBA."""

    start_ms: int
    delay_ms: int
    left: int
    top: int
    indices: np.ndarray
    canvas: np.ndarray

    def drawn(self) -> np.ndarray:
        h, w = self.indices.shape
        return self.canvas[self.top : self.top + h, self.left : self.left + w]


def frames(data: bytes):
    """Yields the frames of a GIF after palettes, transparency and the disposal of earlier frames."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("signature")
    try:
        yield from _frames(data)
    except (struct.error, IndexError) as e:
        raise GifError("file ends early") from e


def _palette(data: bytes, at: int, flags: int):
    size = 2 << (flags & 7)
    if len(data) < at + 3 * size:
        raise GifError("palette ends early")
    out = np.zeros((256, 3), dtype=np.uint8)
    out[:size] = np.frombuffer(data, np.uint8, 3 * size, at).reshape(-1, 3)
    return out, at + 3 * size


def _chunks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := data[at]:
        parts.append(data[at + 1 : at + 1 + size])
        if len(parts[-1]) < size:
            raise GifError("block ends early")
        at += 1 + size
    return b"".join(parts), at + 1


def _frames(data: bytes):
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    if width * height > MOST_PIXELS:
        raise GifError("canvas too large")
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    clock, delay, disposal, clear_index = 0, 0, 0, None
    while True:
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1]
            body, after = _chunks(data, at + 2)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
            at = after
            continue
        if kind != 0x2C:
            raise GifError("unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = shared
        if flags & 0x80:
            palette, at = _palette(data, at, flags)
        if palette is None or not w or not h or left + w > width or top + h > height:
            raise GifError("frame")
        root_bits = data[at]
        stream, at = _chunks(data, at + 1)
        indices = np.frombuffer(lzw_decode(stream, root_bits, w * h), np.uint8).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in PASSES])
            straight = np.empty_like(indices)
            straight[order] = indices
            indices = straight
        saved = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        if clear_index is None:
            area[..., :3], area[..., 3] = palette[indices], 255
        else:
            seen = indices != clear_index
            area[seen, :3], area[seen, 3] = palette[indices[seen]], 255
        yield Frame(clock, 10 * delay, left, top, indices, canvas)
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = saved
        clock += 10 * delay
        delay, disposal, clear_index = 0, 0, None


def histogram(pixels: np.ndarray, bins: int = 8) -> list[int]:
    """Visible pixels by colour: ``bins`` counts each of red, green and blue."""
    seen = pixels[pixels[..., 3] > 0] if not pixels[..., 3].all() else pixels.reshape(-1, 4)
    return [int(n) for c in range(3) for n in np.bincount(seen[:, c] // (256 // bins), minlength=bins)]


FRAMES = "array<struct<start_ms:long,delay_ms:long,left:int,top:int,width:int,height:int,histogram:array<long>,pixels:binary>>"


def store_as_gif(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The UTF-8 bytes of each text, padded with zero bytes, as a GIF: id, n_bytes, media."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                part = batch.slice(i, 32)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = [encode_gif(t + bytes(WIDTH - len(t) % WIDTH if len(t) % WIDTH or not t else 0)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_gifs(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), pixels: bool = False, media_col: str = "media") -> DataFrame:
    """Decodes GIFs: the columns to keep, the file's size and digest, its frames (with the drawn RGBA pixels
    on request), and size, SHA-256 and last bytes' CRC-32 of the palette indices that all frames draw."""
    kept = ", ".join(f"{c} {t}" for c, t in media.select(*keep).dtypes)

    def one(data: bytes) -> dict:
        found = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        shown, sha, n, tail = [], hashlib.sha256(), 0, b""
        try:
            for f in frames(data):
                drawn, raw = f.drawn(), f.indices.tobytes()
                sha.update(raw)
                n, tail = n + len(raw), (tail + raw)[-WIDTH:]
                h, w = f.indices.shape
                shown.append({"start_ms": f.start_ms, "delay_ms": f.delay_ms, "left": f.left, "top": f.top, "width": w, "height": h, "histogram": histogram(drawn), "pixels": drawn.tobytes() if pixels else None})
        except GifError as e:
            return found | {"error": str(e)}
        return found | {"payload_bytes": n, "payload_sha256": sha.hexdigest(), "tail_crc32": zlib.crc32(tail), "frames": shown}

    schema = f"{kept}, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, error string, frames {FRAMES}"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                rows = batch.slice(i, 32).to_pylist()
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in keep} | one(r["media"] or b"") for r in rows], schema=target)

    return media.select(*keep, media[media_col].alias("media")).mapInArrow(run, schema)
