import hashlib
import struct
import zlib

import numpy as np
import pytest

from tests.llm.cases import documents, saved
from verdigrain.llm import media_jpeg as jpeg
from verdigrain.llm import queries


def check(spark, sf_dir):
    texts = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        texts.setdefault(r.doc_id, []).append((r.text or "").encode())
    rows = queries.op7_media_jpeg(spark, sf_dir).collect()
    assert len(rows) == sum(map(len, texts.values()))
    by_payload = {}
    for r in rows:
        if r.doc_id is not None:
            data = texts[r.doc_id][0]
            payload = jpeg.padded(data)
            assert len(payload) % 192 == 0 and len(payload) >= max(192, len(data)) and payload.rstrip(b" ") == data.rstrip(b" ")
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        by_payload.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(x) == 1 for x in by_payload.values())


def test_awkward(spark, tmp_path):
    check(spark, saved(documents(spark), tmp_path))


def test_whole_table(spark):
    check(spark, "/root/testdata/sf0.001")


def test_empty_table(spark):
    assert jpeg.features(jpeg.store(documents(spark).where("false"))).count() == 0


def test_round_trip_of_any_bytes():
    draw = np.random.default_rng(1)
    payloads = [bytes(draw.integers(0, 256, 192 * n, np.uint8)) for n in (1, 2, 3, 7, 64, 401)] + [b"\xff" * 192, b" " * 1920, bytes(384)]
    images = [jpeg.Image(x) for x in jpeg.encode(payloads)]
    assert [jpeg.payload_of(i, b) for i, b in zip(images, jpeg.coefficients(images), strict=True)] == payloads
    with pytest.raises(ValueError):
        jpeg.encode([b"abc"])
    with pytest.raises(ValueError):
        jpeg.Image(b"GIF89a")


def plain_image(blocks, sampling, size, restart):
    """A plain encoder, bit by bit, of units of blocks; blocks: units by blocks by 64, with DC as absolute values."""
    (dc, dc_symbols), (ac, ac_symbols) = jpeg._tables()
    codes = jpeg._codes(dc, dc_symbols), jpeg._codes(ac, ac_symbols)
    bits, out = "", b""

    def put(table, symbol, value, width):
        nonlocal bits
        bits += format(int(codes[table][0][symbol]), f"0{int(codes[table][1][symbol])}b")
        if width:
            bits += format(value if value >= 0 else value + (1 << width) - 1, f"0{width}b")

    def flush():
        nonlocal bits, out
        bits += "1" * (-len(bits) % 8)
        out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits = ""

    parts = [c for c, (h, v) in enumerate(sampling) for _ in range(h * v)]
    last = dict.fromkeys(range(len(sampling)), 0)
    for n, unit in enumerate(blocks):
        if restart and n and n % restart == 0:
            flush()
            out += bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
            last = dict.fromkeys(last, 0)
        for part, block in zip(parts, unit, strict=True):
            diff = int(block[0]) - last[part]
            last[part] = int(block[0])
            put(0, abs(diff).bit_length(), diff, abs(diff).bit_length())
            run = 0
            for k in range(1, 64):
                value = int(block[k])
                if not value:
                    run += 1
                    continue
                while run > 15:
                    put(1, 0xF0, 0, 0)
                    run -= 16
                put(1, run << 4 | abs(value).bit_length(), value, abs(value).bit_length())
                run = 0
            if run:
                put(1, 0, 0, 0)
    flush()
    head = jpeg._head()[: -6] + struct.pack(">BBHH", 0xFF, 0xDD, 4, restart)
    frame = struct.pack(">BBHBHHB", 0xFF, 0xC0, 8 + 3 * len(sampling), 8, size[1], size[0], len(sampling)) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling))
    scan = struct.pack(">BBHB", 0xFF, 0xDA, 6 + 2 * len(sampling), len(sampling)) + b"".join(bytes([c + 1, 0]) for c in range(len(sampling))) + b"\0\x3f\0"
    return head + frame + scan + out + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 2, 5])
@pytest.mark.parametrize("sampling", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_decoder_against_plain_encoder(restart, sampling):
    draw = np.random.default_rng(2)
    per_unit = sum(h * v for h, v in sampling)
    size = (8 * sampling[0][0] * 3 - 3, 8 * sampling[0][1] * 2)
    blocks = draw.integers(-60, 61, (6, per_unit, 64)) * (draw.random((6, per_unit, 64)) < 0.15)
    image = jpeg.Image(plain_image(blocks, sampling, size, restart))
    found = jpeg.coefficients([image])[0]
    assert (image.width, image.height) == size and (found == blocks).all()
    pixels = jpeg.thumbnail(image, found)
    h, v = sampling[0]
    for y in range(2 * v):
        for x in range(min(3 * h, pixels.shape[1])):
            dc = blocks[(y // v) * 3 + x // h, (y % v) * h + x % h, 0]
            assert pixels[y, x] == np.clip(128 + np.round(dc / 8), 0, 255)


def test_code_lengths_are_bounded():
    lengths = jpeg.code_lengths({k: 2.0**-k for k in range(60)})
    assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) < 1
