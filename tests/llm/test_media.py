import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from quire.llm import media
from quire.llm.media import BadImage, decode, decode_many, encode, features, media_columns, padded, stored_payload, op9_media_columns


def payloads():
    rng = random.Random(1)
    for blocks in (1, 2, 3, 9, 64, 65, 700):
        yield bytes(rng.choice((0, 127, 128, 255, rng.randrange(256))) for _ in range(64 * blocks))


@pytest.mark.parametrize("payload", [*payloads(), bytes(64), b"\xff" * 640])
def test_lossless(payload):
    file = encode(payload)
    assert stored_payload(decode(file)) == payload and file == encode(payload)


def test_many_files_as_one_by_one():
    files = [encode(p) for p in payloads()]
    assert [features(i) for i in decode_many(files)] == [features(decode(f)) for f in files]


def test_steps_of_long_payloads(monkeypatch):
    payload = random.Random(2).randbytes(64 * 1000)
    whole = encode(payload)
    monkeypatch.setattr(media, "LANES", 64)
    assert encode(payload) == whole and stored_payload(decode(whole)) == payload


class Writer:
    """A plain baseline writer with common Huffman tables, no restarts, two components."""

    def __init__(self):
        # one code length each, sixteen DC sizes and the AC symbols in use
        self.dc = {s: (s, 4) for s in range(12)}
        self.symbols = [0x00, 0xF0, *[run << 4 | size for run in range(16) for size in range(1, 11)]]
        self.ac = {s: (i, 8) for i, s in enumerate(self.symbols)}
        self.bits = ""

    def put(self, value, size):
        self.bits += format(value, f"0{size}b") if size else ""

    def number(self, value):
        size = abs(value).bit_length()
        return size, value if value >= 0 else value + (1 << size) - 1

    def block(self, coefficients, before):
        size, bits = self.number(coefficients[0] - before)
        self.put(*self.dc[size])
        self.put(bits, size)
        run = 0
        last = max([k for k in range(1, 64) if coefficients[k]], default=0)
        for k in range(1, last + 1):
            if not coefficients[k]:
                run += 1
                continue
            while run > 15:
                self.put(*self.ac[0xF0])
                run -= 16
            size, bits = self.number(coefficients[k])
            self.put(*self.ac[run << 4 | size])
            self.put(bits, size)
            run = 0
        if last < 63:
            self.put(*self.ac[0x00])

    def file(self, head, body):
        self.bits += "1" * (-len(self.bits) % 8)
        data = int(self.bits, 2).to_bytes(len(self.bits) // 8, "big").replace(b"\xff", b"\xff\x00")
        return head + body + data + b"\xff\xd9"


def segment(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def test_any_baseline_file():
    rng = random.Random(3)
    w = Writer()
    y = [[rng.randrange(-60, 60) if rng.random() < 0.2 else 0 for _ in range(64)] for _ in range(8)]
    c = [[rng.randrange(-9, 9) if rng.random() < 0.1 else 0 for _ in range(64)] for _ in range(2)]
    y_before = c_before = 0
    for unit in range(2):  # two units of 16 by 16: four blocks of the first component, one of the second
        for k in range(4):
            w.block(y[4 * unit + k], y_before)
            y_before = y[4 * unit + k][0]
        w.block(c[unit], c_before)
        c_before = c[unit][0]
    lengths = lambda n, size: bytes([n if k == size else 0 for k in range(1, 17)])
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"\0" + bytes([2] * 64))
    head += segment(0xC0, struct.pack(">BHHB", 8, 16, 30, 2) + bytes([1, 0x22, 0, 2, 0x11, 0]))
    body = segment(0xC4, b"\x00" + lengths(12, 4) + bytes(range(12)) + b"\x10" + lengths(len(w.symbols), 8) + bytes(w.symbols))
    body += segment(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0]))
    image = decode(w.file(head, body))
    first, second = image.components
    placed = [first.blocks[r, 2 * u + k].tolist() for u in range(2) for r in range(2) for k in range(2)]
    assert placed == y and [second.blocks[0, u].tolist() for u in range(2)] == c
    thumb = image.thumbnail()
    assert thumb.shape == (2, 4) and thumb[0, 0] == np.clip((2 * y[0][0] + 4) // 8 + 128, 0, 255)
    with pytest.raises(BadImage):
        stored_payload(image)


@pytest.mark.parametrize("data", [b"", b"GIF89a", b"\xff\xd8", b"\xff\xd8\xff\xd9", encode(bytes(64))[:-20], b"\xff\xd8" + segment(0xC2, bytes(9))])
def test_broken_files(data):
    with pytest.raises(BadImage):
        decode(data)


def test_columns(spark):
    rows = [(1, "héllo " * 50, 0), (2, None, 0), (3, "", 0), (None, "x", 0), (1, "héllo " * 50, 0), (4, "z" * 3_000_000, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, width int")
    got = media_columns(frame, keep_media=True).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        n, payload = padded(text)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (n, len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert stored_payload(decode(bytes(r["media"]))) == payload and r["feature"].startswith(f"{r['width']}x{r['height']}:")
    assert len({r["feature"] for r in got if r["doc_id"] == 1}) == 1
    assert media_columns(frame.limit(0)).count() == 0


def naive_feature(file, payload):
    """The feature from the file's frame header and the payload alone, pixel by pixel."""
    at = file.index(b"\xff\xc0")
    high, wide = struct.unpack(">HH", file[at + 5 : at + 9])
    quant = file[file.index(b"\xff\xdb") + 5]
    across, down = -(-wide // 8), -(-high // 8)
    pixels = []
    for k in range(across * down):
        byte = payload[64 * k] if 64 * k < len(payload) else 0
        level = (byte if byte >= 128 else byte - 255) * quant
        pixels.append(min(255, max(0, (level + 4) // 8 + 128)))
    bits = []
    for k in range(64):
        a, b = k * len(pixels) // 64, (k + 1) * len(pixels) // 64
        part = pixels[a : max(b, a + 1)]
        bits.append("1" if sum(part) * len(pixels) > sum(pixels) * len(part) else "0")
    return wide, high, f"{wide}x{high}:{int(''.join(bits), 2):016x}:{hashlib.sha256(bytes(pixels)).hexdigest()[:32]}"


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = op9_media_columns(spark, folder).collect()
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        n, payload = padded(texts[r["doc_id"]])
        file = encode(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        assert (r["width"], r["height"], r["feature"]) == naive_feature(file, payload)
