"""Media columns: GIF as a lossless store of 8-bit samples and as timed frames.

Writing: a payload becomes frames of 64 pixels a row in a grey palette, LZW-coded. Reading follows the format:
variable-width LZW codes with clear and end codes and late code growth, local and global palettes, interlacing,
delays, transparency and the disposal methods 0 to 3.

Spark deals the rows; a task holds one GIF and, whatever the size of its screen, one band of BAND_PIXELS of it: the
code streams are decoded in steps, and a screen of several bands is drawn once for each of them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

WIDTH = 64
#: Rows of a frame: 64 KiB of samples.
FRAME_ROWS = 1024
DELAY_CS = 10
#: Pixels of the screen that are drawn at once.
BAND_PIXELS = 1 << 22
#: Samples that a code stream gives at once, about.
STEP = 1 << 20


@dataclass
class Frame:
    """A frame's part in one band of the screen."""

    frame: int
    band: int
    delay_cs: int
    disposal: int
    top: int  # the first row of samples, counted in the frame
    samples: np.ndarray  # indexes in the band, rows x columns
    canvas: np.ndarray  # RGB of the band after drawing, before disposal


def _widths(bits: int, first: int, count: int) -> np.ndarray:
    """Widths of the codes numbered first, first + 1, ... since the last clear code: the width grows with the table, up to 12."""
    entries = np.arange(first, first + count, dtype=np.int64) + (1 << bits) + 1
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, bits + 1, 12)


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """Codes of variable width, least significant bit first; the table is cleared when it is full."""
    clear = 1 << bits
    codes: list[int] = []
    add = codes.append
    table: dict[int, int] = {}
    get = table.get
    free = clear + 2
    cuts = [0]  # where the codes after a clear code begin
    code = -1
    for b in data:
        if code < 0:
            code = b
            continue
        key = code << 8 | b
        found = get(key)
        if found is not None:
            code = found
            continue
        add(code)
        code = b
        if free < 4096:
            table[key] = free
            free += 1
        else:
            add(clear)
            table.clear()
            free = clear + 2
            cuts.append(len(codes))
    if code >= 0:
        add(code)
    add(clear + 1)
    cuts.append(len(codes))
    widths = np.concatenate([[bits + 1], *(_widths(bits, 0, y - x) for x, y in zip(cuts, cuts[1:], strict=False))])
    raw = np.array([clear, *codes], dtype="<u2").view(np.uint8).reshape(-1, 2)
    kept = np.unpackbits(raw, axis=1, bitorder="little")[np.arange(16)[None, :] < widths[:, None]]
    return np.packbits(kept, bitorder="little").tobytes()


def lzw_decode(data: bytes, bits: int, size: int) -> bytes:
    """At most size samples of a code stream; a stream that ends early or breaks the rules gives what came before."""
    return b"".join(lzw_steps(data, bits, size))


def lzw_steps(data: bytes, bits: int, size: int) -> Iterator[bytes]:
    """The samples of a code stream in steps of about STEP.

    Widths follow from the number of codes since the last clear code, so a run of codes is cut out at once.
    """
    clear = 1 << bits
    padded = np.frombuffer(data + bytes(4), dtype=np.uint8).astype(np.uint32)
    base = [bytes((i,)) for i in range(clear)] + [b"", b""]
    table = base.copy()
    parts: list[bytes] = []
    held = 0
    at, since, got = 0, 0, 0  # bit position, codes since the last clear code, samples so far
    last = b""
    while got < size:
        widths = _widths(bits, since, 4096)
        ends = at + np.cumsum(widths)
        widths = widths[: np.searchsorted(ends, 8 * len(data), side="right")]
        if not len(widths):
            break
        starts = ends[: len(widths)] - widths
        byte = starts >> 3
        window = padded[byte] | padded[byte + 1] << 8 | padded[byte + 2] << 16
        codes = window >> (starts & 7).astype(np.uint32) & ((1 << widths) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(stops[0]) if len(stops) else len(codes)
        known, broken, before = len(table), False, len(parts)
        grow, put = table.append, parts.append
        for code in codes[:n].tolist():
            if code < known:
                new = table[code]
                if last and known < 4096:
                    grow(last + new[:1])
                    known += 1
            elif code == known and last and known < 4096:
                new = last + last[:1]
                grow(new)
                known += 1
            else:
                broken = True
                break
            put(new)
            last = new
        new_ones = sum(map(len, parts[before:]))
        got, held = got + new_ones, held + new_ones
        if held >= STEP:
            yield b"".join(parts)[: held - max(0, got - size)]
            parts, held = [], 0
        if broken:
            break
        if n == len(codes):
            at, since = int(ends[n - 1]), since + n
        elif codes[n] == clear:
            at, since, last = int(ends[n]), 0, b""
            table = base.copy()
        else:
            break
    if held:
        yield b"".join(parts)[: held - max(0, got - size)]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(data[i : i + 255]),)) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


GREY = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))


def write_gif(payload: bytes) -> bytes:
    """A GIF of a payload whose length is a positive multiple of 64: frames of up to FRAME_ROWS rows, each drawn over the whole of its rows."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload's length must be a positive multiple of 64")
    rows = len(payload) // WIDTH
    height = min(rows, FRAME_ROWS)
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, height, 0xF7, 0, 0), GREY]
    for top in range(0, rows, FRAME_ROWS):
        part = payload[top * WIDTH : (top + FRAME_ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 2 << 2, DELAY_CS, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        out.append(_blocks(lzw_encode(part)))
    out.append(b"\x3b")
    return b"".join(out)


@dataclass
class _Picture:
    """A frame as it stands in the file."""

    delay_cs: int
    disposal: int
    transparent: int | None
    left: int
    top: int
    width: int
    height: int
    interlaced: bool
    colours: np.ndarray
    bits: int
    codes: bytes

    def rows(self, low: int, high: int) -> np.ndarray:
        """The samples of rows low to high in drawing order; what the stream lacks is 0."""
        w = self.width
        out = np.zeros((max(0, high - low), w), dtype=np.uint8)
        flat = out.reshape(-1)
        if self.interlaced:
            order = np.concatenate([np.arange(s, self.height, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
        at, rest = 0, b""
        for step in lzw_steps(self.codes, self.bits, w * self.height):
            if not self.interlaced:
                x, y = max(at, low * w), min(at + len(step), high * w)
                if x < y:
                    flat[x - low * w : y - low * w] = np.frombuffer(step, dtype=np.uint8)[x - at : y - at]
                at += len(step)
                if at >= high * w:
                    break
                continue
            rest += step
            n = len(rest) // w
            at = self._scatter(out, order, at, rest[: n * w], low, high)
            rest = rest[n * w :]
        if self.interlaced and rest:
            self._scatter(out, order, at, rest + bytes(w - len(rest)), low, high)
        return out

    def _scatter(self, out: np.ndarray, order: np.ndarray, at: int, raw: bytes, low: int, high: int) -> int:
        block = np.frombuffer(raw, dtype=np.uint8).reshape(-1, self.width)
        to = order[at : at + len(block)]
        mine = (to >= low) & (to < high)
        out[to[mine] - low] = block[: len(to)][mine]
        return at + len(block)


def _pictures(data: bytes) -> tuple[int, int, np.ndarray | None, list[_Picture]]:
    """Width and height of the screen, the colour of the background, and the frames. Data that break off end the frames; other formats raise ValueError."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack("<HHBBB", data[6:13])

    def colours_at(at: int, flags: int) -> tuple[np.ndarray | None, int]:
        n = 3 << (flags & 7) + 1
        part = data[at : at + n]
        return (np.frombuffer(part, dtype=np.uint8).reshape(-1, 3) if len(part) == n else None), at + n

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    palette, at = colours_at(13, flags) if flags & 0x80 else (None, 13)
    ground = palette[background] if palette is not None and background < len(palette) else None
    delay = disposal = 0
    transparent = None
    found: list[_Picture] = []
    while at < len(data):
        kind = data[at]
        if kind == 0x21 and at + 1 < len(data):
            body, after = sub_blocks(at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            at = after
            continue
        if kind != 0x2C or at + 10 > len(data):
            break
        left, top, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        colours, at = colours_at(at, packed) if packed & 0x80 else (palette, at)
        if at >= len(data) or colours is None:
            break
        bits = data[at]
        body, at = sub_blocks(at + 1)
        found.append(_Picture(delay, disposal, transparent, left, top, w, h, bool(packed & 0x40), colours, bits, body))
        delay = disposal = 0
        transparent = None
    return width, height, ground, found


def read_frames(data: bytes, band_pixels: int | None = None) -> Iterator[Frame]:
    """The frames of a GIF in bands of rows: all frames of the first band, then of the next. Screen and frames of at most
    band_pixels are one band. A band below the screen has samples alone. Data that break off end the frames; other
    formats raise ValueError.
    """
    width, height, ground, pictures = _pictures(data)
    whole = max([1, height, *(p.top + p.height for p in pictures)])
    tall = max(1, (band_pixels or BAND_PIXELS) // max([1, width, *(p.width for p in pictures)]))
    for band, first in enumerate(range(0, whole, tall)):
        last = min(first + tall, whole)
        canvas = np.zeros((max(0, min(last, height) - first), width, 3), dtype=np.uint8)
        for number, p in enumerate(pictures):
            low = min(max(first - p.top, 0), p.height)
            high = max(low, min(max(last - p.top, 0), p.height))
            samples = p.rows(low, high) if p.width else np.zeros((high - low, 0), dtype=np.uint8)
            before = canvas.copy() if p.disposal == 3 else None
            begin = p.top + low - first
            box = canvas[begin : begin + high - low, p.left : p.left + p.width]
            shown = samples[: box.shape[0], : box.shape[1]]
            drawn = p.colours[np.minimum(shown, len(p.colours) - 1)]
            if p.transparent is None:
                box[...] = drawn
            else:
                seen = shown != p.transparent
                box[seen] = drawn[seen]
            yield Frame(number, band, p.delay_cs, p.disposal, low, samples, canvas.copy())
            if p.disposal == 2:
                box[...] = ground if ground is not None and p.transparent is None else 0
            elif p.disposal == 3:
                canvas = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """64 counts of pixels: two bits of red, green and blue each."""
    c = canvas.reshape(-1, 3) >> 6
    return np.bincount(c[:, 0].astype(np.int64) * 16 + c[:, 1] * 4 + c[:, 2], minlength=64)


def pad(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def write_column(data: Column) -> Column:
    """binary -> binary: the GIF of the padded bytes. Null counts as empty."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([write_gif(pad(b"" if r is None else bytes(r))) for r in rows], dtype=object)

    return run(data)


FRAME = "struct<frame:int,band:int,delay_cs:int,disposal:int,top:int,rows:int,samples:binary,histogram:array<bigint>>"


def frames_column(media: Column) -> Column:
    """binary -> struct<error, frames>: the timed frames in bands of the screen with their samples and colour histograms.

    A screen of up to BAND_PIXELS pixels is one band, so each frame is one entry; a larger one has an entry for each
    frame and band, in the order of bands. Null and what is no GIF give no frames, and an error that says so (null for a GIF).
    """

    @F.pandas_udf(f"struct<error:string,frames:array<{FRAME}>>")
    def run(rows: pd.Series) -> pd.DataFrame:
        out = []
        for data in rows:
            frames, error = [], None
            try:
                for f in read_frames(bytes(data or b"")):
                    frames.append({
                        "frame": f.frame, "band": f.band, "delay_cs": f.delay_cs, "disposal": f.disposal, "top": f.top, "rows": f.samples.shape[0],
                        "samples": f.samples.tobytes(), "histogram": histogram(f.canvas).tolist(),
                    })
            except ValueError as e:
                error = str(e)
            out.append((error, frames))
        return pd.DataFrame(out, columns=["error", "frames"], dtype=object)

    return run(media)
