"""Media columns as baseline JPEG: a lossless coefficient store, a decoder, and thumbnails from DC terms.

Eight by eight quantised coefficients are the format's unit. A payload byte maps
onto one coefficient of the 256 values whose magnitude has eight bits, so 64
bytes are one block, and the block survives any baseline decoder as it is. Each
block is its own restart interval. The decoder parses markers and Huffman-decodes
scans of any baseline file; intervals are decoded side by side in numpy, one
coefficient of all of them at a step.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import small_batches, steps, table, utf8

BLOCK = 64
#: Restart intervals decoded side by side, and blocks encoded at once.
LANES = 1 << 15
#: Texts stored and read back at once, by length; a longer text is one such step.
STEP_BYTES = 2 << 20

# Fixed values of the format (ITU-T T.81).
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, COM, RST0 = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE, 0xD0


class BadImage(ValueError):
    """Not a baseline JPEG, or a broken one."""


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(blocks: int) -> tuple[bytes, int]:
    """What stands before the scan data, and the blocks of the image: those of the payload and what fills its last row."""
    wide = math.isqrt(blocks - 1) + 1
    high = -(-blocks // wide)
    one_code = bytes([1] + [0] * 15) + bytes([8])  # the only symbol: no zeros before it, eight bits follow
    return (
        bytes([0xFF, SOI])
        + _segment(COM, b"blocks=%d" % blocks)
        + _segment(DQT, bytes([0]) + bytes([1] * 64))
        + _segment(SOF0, struct.pack(">BHHBBBB", 8, high * 8, wide * 8, 1, 1, 0x11, 0))
        + _segment(DHT, bytes([0x00]) + one_code)
        + _segment(DHT, bytes([0x10]) + one_code)
        + _segment(DRI, struct.pack(">H", 1))
        + _segment(SOS, bytes([1, 1, 0x00, 0, 63, 0]))
    ), wide * high


def encode(payload: bytes) -> bytes:
    """A greyscale JPEG whose coefficients are the payload, whose length is a positive multiple of 64.

    Byte b is coefficient b - 255 below 128 and b from there on: its eight extra bits are b itself. Every
    coefficient takes one code bit and those eight, every block 72 bytes, and the prediction starts anew with each.
    """
    if not payload or len(payload) % BLOCK:
        raise ValueError("a payload has a positive multiple of 64 bytes")
    head, total = _head(len(payload) // BLOCK)
    data = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    if total > len(data):
        data = np.concatenate((data, np.zeros((total - len(data), BLOCK), np.uint8)))
    parts = [head]
    for first in range(0, total, LANES):
        some = data[first : first + LANES]
        bits = np.zeros((len(some), BLOCK, 9), np.uint8)
        bits[:, :, 1:] = np.unpackbits(some, axis=1).reshape(len(some), BLOCK, 8)
        packed = np.packbits(bits.reshape(len(some), -1), axis=1)
        flat = packed.reshape(-1)
        is_ff = flat == 0xFF
        # each byte moves on by the zeros stuffed before it and the markers of the blocks before its own
        at = np.arange(len(flat)) + np.cumsum(is_ff) - is_ff + np.repeat(2 * np.arange(len(some)), packed.shape[1])
        out = np.zeros(len(flat) + int(is_ff.sum()) + 2 * len(some), np.uint8)
        out[at] = flat
        ends = at[packed.shape[1] - 1 :: packed.shape[1]] + 1 + is_ff[packed.shape[1] - 1 :: packed.shape[1]]
        out[ends] = 0xFF
        out[ends + 1] = RST0 + (first + np.arange(len(some))) % 8
        parts.append(out.tobytes())
    parts[-1] = parts[-1][:-2]  # no restart after the last block
    return b"".join([*parts, bytes([0xFF, EOI])])


@dataclass
class Component:
    id: int
    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0
    blocks: np.ndarray | None = None


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)

    def thumbnail(self) -> np.ndarray:
        """One luminance pixel for each block of the first component, from its DC term alone."""
        first = self.components[0]
        wide = -(-self.width * first.h // (8 * max(c.h for c in self.components)))
        high = -(-self.height * first.v // (8 * max(c.v for c in self.components)))
        level = first.blocks[:, :, 0].astype(np.int64) * int(self.quant[first.quant][0])
        return np.clip(np.floor_divide(level + 4, 8) + 128, 0, 255).astype(np.uint8)[:high, :wide]


@lru_cache(maxsize=64)
def _lookup(lengths: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits that may lie ahead: the symbol they begin with and its code's length, 0 for none."""
    symbol, size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = k = 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            low, high = code << (16 - n), (code + 1) << (16 - n)
            if high > 1 << 16 or k >= len(symbols):
                raise BadImage("Huffman table")
            symbol[low:high], size[low:high] = symbols[k], n
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, size


class _Bits:
    """Bit readers side by side, one for each restart interval."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.int64)
        self.at, self.ends = starts * 8, ends * 8

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        """The next 16 bits of these lanes."""
        at = self.at[lanes]
        byte = np.minimum(at >> 3, len(self.data) - 3)
        three = (self.data[byte] << 16) | (self.data[byte + 1] << 8) | self.data[byte + 2]
        return (three >> (8 - (at & 7))) & 0xFFFF

    def code(self, lanes: np.ndarray, lookup: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        ahead = self.peek(lanes)
        size = lookup[1][ahead]
        self.at[lanes] += size
        if (size == 0).any() or (self.at[lanes] > self.ends[lanes]).any():
            raise BadImage("scan data")
        return lookup[0][ahead]

    def value(self, lanes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """`size` extra bits of each lane as the signed value that they stand for."""
        bits = self.peek(lanes) >> (16 - size)
        self.at[lanes] += size
        if (self.at[lanes] > self.ends[lanes]).any():
            raise BadImage("scan data")
        return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


def _block(bits: _Bits, lanes: np.ndarray, dc: tuple, ac: tuple) -> np.ndarray:
    """One block of each lane in scan order, the DC term as its difference."""
    out = np.zeros((len(lanes), BLOCK), np.int32)
    size = bits.code(lanes, dc)
    if (size > 11).any():
        raise BadImage("DC size")
    out[:, 0] = bits.value(lanes, size)
    here, k = np.arange(len(lanes)), np.ones(len(lanes), np.int64)
    while len(here):
        symbol = bits.code(lanes[here], ac)
        run, size = symbol >> 4, symbol & 15
        value = bits.value(lanes[here], size)
        stop = (size == 0) & (run != 15)
        at = k[here] + run
        if (at[~stop] > 63).any():
            raise BadImage("run past the block")
        some = size > 0
        out[here[some], at[some]] = value[some]
        k[here] = at + 1
        here = here[~stop & (at < 63)]
    return out


def _intervals(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scan bytes without stuffing and markers, and where in them each restart interval starts and ends."""
    ff = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[ff + 1]
    restart = ff[(after >= RST0) & (after < RST0 + 8)]
    gone = np.zeros(len(scan), bool)
    gone[ff[after == 0] + 1] = True
    gone[restart], gone[restart + 1] = True, True
    kept_before = np.cumsum(~gone)
    starts = np.concatenate(([0], kept_before[restart])).astype(np.int64)
    return scan[~gone], starts, np.concatenate((starts[1:], [int((~gone).sum())])).astype(np.int64)


def _scan_end(data: bytes, at: int) -> int:
    """Where the scan data from `at` on ends: at a marker that is neither a restart nor a stuffed zero."""
    raw = np.frombuffer(data, np.uint8, offset=at)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    stop = ff[(after != 0) & (after != 0xFF) & ((after < RST0) | (after >= RST0 + 8))]
    if not len(stop):
        raise BadImage("no end of scan")
    return at + int(stop[0])


def _decode_scan(image: Image, parts: list[Component], scan: bytes, tables: dict, restart: int) -> None:
    data, starts, ends = _intervals(np.frombuffer(scan, np.uint8))
    most_h, most_v = max(c.h for c in image.components), max(c.v for c in image.components)
    if len(parts) == 1:
        c = parts[0]
        wide, high, shape = -(-image.width * c.h // (8 * most_h)), -(-image.height * c.v // (8 * most_v)), [(c, 0, 0)]
    else:
        wide, high = -(-image.width // (8 * most_h)), -(-image.height // (8 * most_v))
        shape = [(c, y, x) for c in parts for y in range(c.v) for x in range(c.h)]
    units = wide * high
    each = restart or units
    if len(starts) != -(-units // each):
        raise BadImage("restart intervals")
    for first in range(0, len(starts), LANES):
        lanes = np.arange(first, min(first + LANES, len(starts)))
        bits = _Bits(data[starts[lanes[0]] : ends[lanes[-1]]], starts[lanes] - starts[lanes[0]], ends[lanes] - starts[lanes[0]])
        before = {id(c): np.zeros(len(lanes), np.int64) for c in parts}
        for step in range(each):
            unit = lanes * each + step
            here = np.flatnonzero(unit < units)
            row, col = unit[here] // wide, unit[here] % wide
            for c, y, x in shape:
                block = _block(bits, here, tables[0, c.dc], tables[1, c.ac])
                block[:, 0] += before[id(c)][here].astype(np.int32)
                before[id(c)][here] = block[:, 0]
                c.blocks[row * (c.v if len(parts) > 1 else 1) + y, col * (c.h if len(parts) > 1 else 1) + x] = block


@dataclass
class Scan:
    parts: list[Component]
    data: bytes
    tables: dict
    restart: int


def decode(data: bytes) -> Image:
    """The quantised coefficients of a baseline JPEG, each block in scan order. BadImage for anything else."""
    return decode_many([data])[0]


def decode_many(files: list[bytes]) -> list[Image]:
    """decode() of each file; scans whose restart intervals are single blocks under the same tables go side by side."""
    parsed = [parse(f) for f in files]
    together: dict[tuple, list[Scan]] = {}
    for image, scans in parsed:
        for scan in scans:
            if len(scan.parts) == 1 and scan.restart == 1:
                c = scan.parts[0]
                key = tuple(id(x) for t in ((0, c.dc), (1, c.ac)) for x in _table(scan, *t))
                together.setdefault(key, []).append((image, scan))
            else:
                _decode_scan(image, scan.parts, scan.data, scan.tables, scan.restart)
    for members in together.values():
        _decode_single_blocks(members)
    return [image for image, _ in parsed]


def _table(scan: Scan, kind: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    try:
        return scan.tables[kind, number]
    except KeyError:
        raise BadImage("no Huffman table") from None


def _decode_single_blocks(members: list[tuple[Image, Scan]]) -> None:
    """Scans of one component whose blocks are a restart interval each, joined as if they were one."""
    first = members[0][1]
    dc, ac = _table(first, 0, first.parts[0].dc), _table(first, 1, first.parts[0].ac)
    data, starts, ends = _intervals(np.frombuffer(bytes([0xFF, RST0]).join(s.data for _, s in members), np.uint8))
    sizes = []
    for image, scan in members:
        c = scan.parts[0]
        most_h, most_v = max(x.h for x in image.components), max(x.v for x in image.components)
        sizes.append((-(-image.height * c.v // (8 * most_v)), -(-image.width * c.h // (8 * most_h))))
        if _restarts(scan.data) != sizes[-1][0] * sizes[-1][1] - 1:
            raise BadImage("restart intervals")
    blocks = np.empty((len(starts), BLOCK), np.int32)
    for at in range(0, len(starts), LANES):
        some = slice(at, min(at + LANES, len(starts)))
        bits = _Bits(data[starts[some][0] : ends[some][-1]], starts[some] - starts[some][0], ends[some] - starts[some][0])
        blocks[some] = _block(bits, np.arange(some.stop - at), dc, ac)
    at = 0
    for (_, scan), (high, wide) in zip(members, sizes, strict=True):
        scan.parts[0].blocks[:high, :wide] = blocks[at : at + high * wide].reshape(high, wide, BLOCK)
        at += high * wide


def _restarts(scan: bytes) -> int:
    raw = np.frombuffer(scan, np.uint8)
    after = raw[1:][raw[:-1] == 0xFF]
    return int(((after >= RST0) & (after < RST0 + 8)).sum())


def parse(data: bytes) -> tuple[Image, list[Scan]]:
    """Frame, tables and scans of a baseline JPEG by its markers."""
    scans = []
    if data[:2] != bytes([0xFF, SOI]):
        raise BadImage("no start of image")
    at, image, restart, tables, quant, comments = 2, None, 0, {}, {}, []
    try:
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            if data[at] != 0xFF:
                raise BadImage("no marker where one is due")
            marker = data[at + 1]
            if marker == EOI:
                break
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == DQT:
                while body:
                    wide = 1 + (body[0] >> 4)
                    quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else np.uint8).astype(np.int64)
                    body = body[1 + 64 * wide :]
            elif marker == DHT:
                while body:
                    n = sum(body[1:17])
                    tables[body[0] >> 4, body[0] & 15] = _lookup(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == DRI:
                restart = struct.unpack(">H", body)[0]
            elif marker == COM:
                comments.append(body)
            elif marker == SOF0:
                bits, high, wide, n = struct.unpack_from(">BHHB", body)
                parts = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
                if bits != 8 or not high or not wide or not parts or any(not 0 < x <= 4 for c in parts for x in (c.h, c.v)):
                    raise BadImage("frame header")
                image = Image(wide, high, parts)
                across, down = -(-wide // (8 * max(c.h for c in parts))), -(-high // (8 * max(c.v for c in parts)))
                for c in parts:
                    c.blocks = np.zeros((down * c.v, across * c.h, BLOCK), np.int32)
            elif 0xC0 < marker < 0xD0 and marker not in (DHT, 0xC8, 0xCC):
                raise BadImage("not baseline")
            elif marker == SOS:
                chosen = []
                for k in range(body[0]):
                    c = next(c for c in image.components if c.id == body[1 + 2 * k])
                    c.dc, c.ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
                    chosen.append(c)
                end = _scan_end(data, at)
                scans.append(Scan(chosen, data[at:end], dict(tables), restart))
                at = end
    except (IndexError, KeyError, struct.error, StopIteration, AttributeError) as e:
        raise BadImage(f"broken file: {e!r}") from e
    if image is None:
        raise BadImage("no frame")
    image.quant, image.comments = quant, comments
    return image, scans


def stored_payload(image: Image) -> bytes:
    """The bytes that encode() put in."""
    blocks = next((int(c[7:]) for c in image.comments if c.startswith(b"blocks=")), None)
    if blocks is None:
        raise BadImage("holds no payload")
    values = image.components[0].blocks.reshape(-1, BLOCK)[:blocks]
    return np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()


def features(image: Image) -> str:
    """Width x height, then 64 bits, each whether a 64th of the thumbnail's pixels is brighter than all, then half its SHA-256."""
    pixels = image.thumbnail().reshape(-1).astype(np.int64)
    edges = np.arange(65) * len(pixels) // 64
    sums = np.add.reduceat(pixels, edges[:-1])
    bright = sums * len(pixels) > pixels.sum() * np.maximum(np.diff(edges), 1)
    return f"{image.width}x{image.height}:{np.packbits(bright).tobytes().hex()}:{hashlib.sha256(pixels.astype(np.uint8).tobytes()).hexdigest()[:32]}"


def padded(text: str | None) -> tuple[int, bytes]:
    data = utf8(text)
    return len(data), data + bytes(-len(data) % BLOCK if data else BLOCK)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text as the bytes of a JPEG, read back: (id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, width, height, feature) and, with keep_media, the file itself as `media`.

    A null or empty text is a payload of 64 zero bytes. Equal texts give equal files and features; repeated rows get a
    row each. Other columns are not looked at. A text is encoded and decoded as a whole, in steps of bounded memory.
    """
    def stored(run: list[str | None], ids: pa.Array) -> pa.RecordBatch:
        payloads = [padded(t) for t in run]
        files = [encode(p) for _, p in payloads]
        rows = []
        for (n_bytes, _), file, image in zip(payloads, files, decode_many(files), strict=True):
            back = stored_payload(image)
            rows.append(
                (
                    n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(file),
                    hashlib.sha256(file).hexdigest(), image.width, image.height, features(image),
                )
            )
        columns = [pa.array(c) for c in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([ids, *columns, *([pa.array(files, pa.binary())] if keep_media else [])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in steps(batch.column(1), STEP_BYTES):
                yield stored(texts, batch.column(0).slice(first, len(texts)))

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "feature", *(["media"] if keep_media else [])]
    kinds = [docs.schema[id_col].dataType.simpleString(), "long", "long", "string", "long", "long", "string", "long", "long", "string", *(["binary"] if keep_media else [])]
    return small_batches(docs).select(id_col, text_col).mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
