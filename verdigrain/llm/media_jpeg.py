"""Media columns of baseline JPEG: bytes kept as quantised coefficients, and a decoder for DC thumbnails.

The decoder parses markers, decodes Huffman-coded scans and gives every coefficient of baseline
images (8 bits, any tables, sampling factors and restart intervals). It works in step over all
restart intervals of many images at once, so images with restart markers decode as arrays. Thumbnails
come from the luminance DC values alone, one sample for each block, without inverse transforms.

``encode`` keeps a payload losslessly in the format's own unit, the quantised coefficient: three
components without subsampling, one restart interval for each unit of 3 blocks, 192 coefficients in
zigzag order, one for each byte. Bytes are numbered by how common they are in text, so that blanks
are zero coefficients. The grid of units is close to a square; units past the payload are zero, and
a comment segment has the payload's length.

An empty or null text is a payload of 192 blanks. Equal texts give equal images and features. Any
bytes can be stored. Repeated rows and extra columns change nothing. Malformed images raise.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdigrain.llm.shared import buffers, slices
from verdigrain.session import on_workers

UNIT = 192
# Common bytes of text, most common first; the others follow by value.
_COMMON = b" etnhoriasdul\ncmpgbfwvy.,TAESIONRHC\xc3\xa9q$#%&*=!?'-\"0123456789kxzjLDMPUBGFWVYKQXJZ"


@lru_cache(1)
def _mapping() -> tuple[np.ndarray, np.ndarray]:
    """The coefficient of each byte, and the byte of each coefficient plus 128."""
    order = list(dict.fromkeys([*_COMMON, *range(256)]))
    # 0, -1, 1, -2, 2, ...
    values = np.array([(k + 1) // 2 * (-1 if k % 2 else 1) for k in range(256)], np.int16)
    coefficient = np.empty(256, np.int16)
    coefficient[order] = values
    back = np.empty(257, np.uint8)
    back[values + 128] = order
    return coefficient, back


def code_lengths(weights: dict[int, float], longest: int = 16) -> dict[int, int]:
    """Lengths of a Huffman code in which the code of all ones stays free, none over `longest` bits."""
    import heapq

    floor = 0.0
    total = sum(weights.values())
    while True:
        heap = [(max(w, floor), k, (s,)) for k, (s, w) in enumerate(sorted(weights.items()))]
        heap.append((0.0, len(heap), (-1,)))  # takes the longest code, and is left out
        heapq.heapify(heap)
        length = dict.fromkeys([*weights, -1], 0)
        number = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in (*a[2], *b[2]):
                length[s] += 1
            heapq.heappush(heap, (a[0] + b[0], number, a[2] + b[2]))
            number += 1
        if max(length.values()) <= longest:
            return {s: n for s, n in length.items() if s >= 0}
        floor = max(floor * 2, total / (1 << longest))


@lru_cache(1)
def _tables() -> tuple[tuple[bytes, bytes], tuple[bytes, bytes]]:
    """DC and AC tables (numbers of codes by length, symbols) for coefficients of text."""
    size_share = (0.16, 0.17, 0.26, 0.28, 0.09, 0.025, 0.01, 0.005, 0.001)
    dc = dict(enumerate(size_share))
    zero = size_share[0]
    ac = {(run << 4) | size: zero**run * (1 - zero) * share for run in range(16) for size, share in enumerate(size_share) if size}
    ac |= {0x00: 0.004, 0xF0: zero**15 / 4}
    found = []
    for weights in (dc, ac):
        lengths = code_lengths(weights)
        symbols = sorted(lengths, key=lambda s: (lengths[s], s))
        found.append((bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)), bytes(symbols)))
    return tuple(found)


def _codes(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol."""
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    value = at = 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            code[s], length[s] = value, bits
            value += 1
        at += n
        value <<= 1
    return code, length


@lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For 16 bits ahead: symbol and code length, packed; 0 where no code begins so."""
    table, value, at = np.zeros(1 << 16, np.int32), 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            begin = value << (16 - bits)
            table[begin : begin + (1 << (16 - bits))] = (s << 8) | bits
            value += 1
        at += n
        value <<= 1
    return table


@lru_cache(1)
def _head() -> bytes:
    """All segments before the frame: JFIF, unit quantisation, Huffman tables, one unit between restarts."""
    segment = lambda marker, body: struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body
    (dc, dc_symbols), (ac, ac_symbols) = _tables()
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xDB, b"\0" + b"\1" * 64) + segment(0xC4, b"\0" + dc + dc_symbols + b"\x10" + ac + ac_symbols) + segment(0xDD, b"\0\1")


def grid(units: int) -> tuple[int, int]:
    """Columns and rows of units, nearly square; neither may exceed 8,191."""
    across = max(1, int(np.ceil(np.sqrt(units))))
    down = -(-units // across)
    if max(across, down) > 8191:
        raise ValueError("the payload is too long for one image")
    return across, down


def padded(data: bytes, unit: int = UNIT) -> bytes:
    return data + b" " * (-len(data) % unit or (unit if not data else 0))


def _sizes(values: np.ndarray) -> np.ndarray:
    """Bits of each coefficient's magnitude."""
    return np.ceil(np.log2(np.abs(values).astype(np.float64) + 1)).astype(np.int64)


def encode(payloads: list[bytes]) -> list[bytes]:
    """Images of payloads whose lengths are positive multiples of 192."""
    if any(not p or len(p) % UNIT for p in payloads):
        raise ValueError("payloads must be positive multiples of the unit")
    coefficient = _mapping()[0]
    grids = [grid(len(p) // UNIT) for p in payloads]
    spans = [across * down for across, down in grids]
    units = np.zeros((sum(spans), UNIT), np.int64)
    at = 0
    for p, n in zip(payloads, spans, strict=True):
        units[at : at + len(p) // UNIT] = coefficient[np.frombuffer(p, np.uint8)].reshape(-1, UNIT)
        at += n
    (dc_code, dc_length), (ac_code, ac_length) = (_codes(*t) for t in _tables())
    blocks = units.reshape(-1, 64)
    place = np.arange(blocks.size)
    flat, inner = blocks.ravel(), place & 63
    # tokens, in order, at: each DC, each AC that isn't zero, and each block's end if zeros lead there
    some = np.flatnonzero((inner == 0) | (flat != 0))
    value, where = flat[some], inner[some]
    size = _sizes(value)
    extra = np.where(value < 0, value + (1 << size) - 1, value)
    run = np.zeros(len(some), np.int64)
    run[1:] = some[1:] - some[:-1] - 1
    run[where == 0] = 0
    is_dc = where == 0
    symbol = np.where(is_dc, size, ((run & 15) << 4) | size)
    code = np.where(is_dc, dc_code[symbol], ac_code[symbol])
    length = np.where(is_dc, dc_length[symbol], ac_length[symbol])
    bits, width, order = (code << size) | extra, length + size, some * 4 + 3
    skips = run >> 4
    far = np.flatnonzero(skips)
    skip_at = np.repeat(some[far] * 4, skips[far]) + np.concatenate([np.arange(n) for n in skips[far]] or [np.zeros(0, np.int64)])
    ended = np.flatnonzero(blocks[:, 63] == 0) * 64 + 63
    bits = np.concatenate([bits, np.full(len(skip_at), ac_code[0xF0]), np.full(len(ended), ac_code[0])])
    width = np.concatenate([width, np.full(len(skip_at), ac_length[0xF0]), np.full(len(ended), ac_length[0])])
    order = np.concatenate([order, skip_at, ended * 4 + 3])
    sort = np.argsort(order, kind="stable")
    bits, width, owner = bits[sort], width[sort], order[sort] // (4 * UNIT)
    # each unit begins at a byte and is filled up with ones
    unit_bits = np.bincount(owner, width, len(units)).astype(np.int64)
    unit_bytes = (unit_bits + 7) // 8
    unit_start = np.cumsum(unit_bytes) - unit_bytes
    fill = unit_bytes * 8 - unit_bits
    before = np.cumsum(width) - width
    first = np.searchsorted(owner, np.arange(len(units)))
    start = before - before[first][owner] + unit_start[owner] * 8
    bits = np.concatenate([bits, (1 << fill) - 1])
    width = np.concatenate([width, fill])
    start = np.concatenate([start, unit_start * 8 + unit_bits])
    total = int(unit_bytes.sum())
    # a token of up to 27 bits touches at most five bytes; bits of different tokens never overlap
    shifted = bits << (40 - (start & 7) - width)
    packed = np.zeros(total + 5)
    for k in range(5):
        packed += np.bincount((start >> 3) + k, (shifted >> (32 - 8 * k)) & 255, total + 5)
    packed = packed[:total].astype(np.uint8)
    # stuffing after bytes of ones, and a restart marker after each unit but an image's last
    stuffed = packed == 255
    unit_of = np.repeat(np.arange(len(units)), unit_bytes)
    number = np.concatenate([np.arange(n) for n in spans])
    ends = np.cumsum(spans) - 1
    marked = np.ones(len(units), np.int64)
    marked[ends] = 0
    to = np.arange(total) + np.cumsum(stuffed) - stuffed + 2 * (np.cumsum(marked) - marked)[unit_of]
    out = np.zeros(total + int(stuffed.sum()) + 2 * int(marked.sum()), np.uint8)
    out[to] = packed
    last = unit_start + unit_bytes - 1
    stop = to[last] + 1 + stuffed[last]
    mark = np.flatnonzero(marked)
    out[stop[mark]] = 0xFF
    out[stop[mark] + 1] = 0xD0 + (number[mark] & 7)
    whole = out.tobytes()
    images, begin = [], 0
    for p, (across, down), end in zip(payloads, grids, stop[ends].tolist(), strict=True):
        frame = struct.pack(">BBHBHHB", 0xFF, 0xC0, 17, 8, down * 8, across * 8, 3) + b"\1\x11\0\2\x11\0\3\x11\0"
        note = struct.pack(">BBHQ", 0xFF, 0xFE, 10, len(p))
        scan = b"\xff\xda\0\x0c\3\1\0\2\0\3\0\0\x3f\0"
        images.append(_head() + note + frame + scan + whole[begin:end] + b"\xff\xd9")
        begin = end
    return images


class Image:
    """What the markers of one image say; intervals: its entropy-coded data between restarts, unstuffed."""

    def __init__(self, data: bytes) -> None:
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG image")
        self.quantisation: dict[int, np.ndarray] = {}
        self.huffman: dict[tuple[int, int], tuple[bytes, bytes]] = {}
        self.restart, self.comments, self.parts = 0, [], None
        at = 2
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self._quantisation(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xC0:
                self._frame(body)
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError(f"frame {marker:x} isn't baseline")
            elif marker == 0xDD:
                (self.restart,) = struct.unpack(">H", body[:2])
            elif marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDA:
                self._scan(body)
                break
        self._intervals(np.frombuffer(data, np.uint8, offset=at))

    def _quantisation(self, body: bytes) -> None:
        while body:
            wide, number = body[0] >> 4, body[0] & 15
            size = 128 if wide else 64
            self.quantisation[number] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int32)
            body = body[1 + size :]

    def _huffman(self, body: bytes) -> None:
        while body:
            counts = body[1:17]
            self.huffman[body[0] >> 4, body[0] & 15] = (counts, body[17 : 17 + sum(counts)])
            body = body[17 + sum(counts) :]

    def _frame(self, body: bytes) -> None:
        depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if depth != 8:
            raise ValueError("baseline images have 8 bits")
        self.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]

    def _scan(self, body: bytes) -> None:
        if self.parts is None or body[0] != len(self.parts):
            raise ValueError("only one interleaved scan of all components is read")
        tables = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
        if len(self.parts) == 1:  # a scan of one component goes by its own blocks
            self.parts = [(self.parts[0][0], 1, 1, self.parts[0][3])]
        high, tall = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.across, self.down = -(-self.width // (8 * high)), -(-self.height // (8 * tall))
        #: the component of each block of a unit, and its tables
        self.layout = tuple((c, self.huffman[0, tables[p[0]][0]], self.huffman[1, tables[p[0]][1]]) for c, p in enumerate(self.parts) for _ in range(p[1] * p[2]))

    def _intervals(self, data: np.ndarray) -> None:
        ones = np.flatnonzero(data[:-1] == 255)
        after = data[ones + 1]
        ends = ones[(after != 0) & (after < 0xD0) | (after > 0xD7) & (after != 255)]
        if not len(ends):
            raise ValueError("the end of the image is missing")
        stop = int(ends[0])
        ones, after = ones[ones < stop], after[ones < stop]
        marks = ones[(after >= 0xD0) & (after <= 0xD7)]
        drop = np.zeros(stop, bool)
        drop[ones[after == 0] + 1] = True
        drop[marks] = drop[marks + 1] = True
        left = np.concatenate([[0], np.cumsum(~drop)])
        units = self.across * self.down
        each = self.restart or units
        if len(marks) + 1 != -(-units // each):
            raise ValueError("restart markers are missing")
        self.data = data[:stop][~drop]
        self.edges = np.concatenate([[0], left[marks], [left[stop]]])
        self.units = np.full(len(marks) + 1, each)
        self.units[-1] = units - each * len(marks)


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """Each image's quantised coefficients, in zigzag order: units by blocks by 64."""
    found: list = [None] * len(images)
    alike: dict[tuple, list[int]] = {}
    for k, image in enumerate(images):
        alike.setdefault(image.layout, []).append(k)
    for layout, which in alike.items():
        # small intervals together, so that one long one doesn't hold empty places for all
        which.sort(key=lambda k: int(images[k].units.max()))
        begin = 0
        while begin < len(which):
            end, most, rows = begin, 0, 0
            while end < len(which):
                image = images[which[end]]
                most, rows = max(most, int(image.units.max())), rows + len(image.units)
                if end > begin and most * rows * len(layout) > 1 << 18:
                    break
                end += 1
            group = which[begin:end]
            for k, block in zip(group, _decoded([images[k] for k in group], layout), strict=True):
                found[k] = block
            begin = end
    return found


def _decoded(images: list[Image], layout: tuple) -> list[np.ndarray]:
    """Decode all restart intervals of images with the same tables in step."""
    shift = np.cumsum([0, *[len(i.data) for i in images]])
    data = np.concatenate([*[i.data for i in images], np.full(8, 255, np.uint8)]).astype(np.int64)
    # 32 bits from every byte on
    ahead = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    starts = np.concatenate([i.edges[:-1] + s for i, s in zip(images, shift, strict=False)])
    stops = np.concatenate([i.edges[1:] + s for i, s in zip(images, shift, strict=False)]) * 8
    units = np.concatenate([i.units for i in images])
    out = np.zeros((len(units), int(units.max()), len(layout), 64), np.int16)
    at = starts * 8
    parts = max(c for c, _, _ in layout) + 1
    predicted = np.zeros((parts, len(units)), np.int64)
    last = len(ahead) - 1

    def taken(rows: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next symbol of rows and the value after it."""
        where = at[rows]
        word = ahead[np.minimum(where >> 3, last)]
        entry = table[word >> (16 - (where & 7)) & 0xFFFF]
        if (entry == 0).any():
            raise ValueError("a code is unknown")
        symbol, where = entry >> 8, where + (entry & 255)
        size = (symbol & 15).astype(np.int64)
        word = ahead[np.minimum(where >> 3, last)]
        value = (word >> (32 - (where & 7) - size)) & ((1 << size) - 1)
        value = np.where((size > 0) & (value < 1 << np.maximum(size - 1, 0)), value - (1 << size) + 1, value)
        at[rows] = where + size
        return symbol, value

    for unit in range(int(units.max())):
        now = np.flatnonzero(units > unit)
        for b, (part, dc, ac) in enumerate(layout):
            dc_table, ac_table = _lookup(*dc), _lookup(*ac)
            symbol, value = taken(now, dc_table)
            predicted[part, now] += value
            out[now, unit, b, 0] = predicted[part, now]
            rows, place = now, np.ones(len(now), np.int64)
            while len(rows):
                symbol, value = taken(rows, ac_table)
                run, size = symbol >> 4, symbol & 15
                place = place + run
                if (place > 63)[size > 0].any():
                    raise ValueError("a block has too many coefficients")
                some = size > 0
                out[rows[some], unit, b, place[some]] = value[some]
                place = place + 1
                alive = ((size > 0) | (run == 15)) & (place < 64)
                rows, place = rows[alive], place[alive]
    if (at > stops).any():
        raise ValueError("an interval ends too soon")
    found, row = [], 0
    for image in images:
        own = out[row : row + len(image.units)]
        row += len(image.units)
        found.append(own.reshape(-1, len(layout), 64)[: image.across * image.down])
    return found


def thumbnail(image: Image, blocks: np.ndarray) -> np.ndarray:
    """Luminance by block from the DC values alone: rows by columns, 0 to 255."""
    _, high, tall, table = image.parts[0]
    step = int(image.quantisation[table][0])
    dc = blocks[:, : high * tall, 0].astype(np.int64) * step
    grid = dc.reshape(image.down, image.across, tall, high).transpose(0, 2, 1, 3).reshape(image.down * tall, image.across * high)
    # the DC coefficient is eight times the block's mean, which is centred at 128
    wide = -(-image.width // 8) if high == 1 else image.across * high
    return np.clip(128 + np.round(grid[:, :wide] / 8), 0, 255).astype(np.uint8)


def thumbnail_hash(pixels: np.ndarray, side: int = 8) -> str:
    """A 64-bit hash: which cells of an 8 by 8 reduction are brighter than their mean."""
    rows = np.linspace(0, pixels.shape[0], side + 1)
    columns = np.linspace(0, pixels.shape[1], side + 1)
    sums = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1))
    sums[1:, 1:] = pixels.astype(np.float64).cumsum(0).cumsum(1)
    low = lambda edges, n: np.minimum(np.floor(edges[:-1]).astype(int), n - 1)
    up = lambda edges, n: np.maximum(np.ceil(edges[1:]).astype(int), low(edges, n) + 1)
    a, b = low(rows, pixels.shape[0])[:, None], up(rows, pixels.shape[0])[:, None]
    c, d = low(columns, pixels.shape[1])[None, :], up(columns, pixels.shape[1])[None, :]
    mean = (sums[b, d] - sums[a, d] - sums[b, c] + sums[a, c]) / ((b - a) * (d - c))
    return np.packbits(mean > mean.mean()).tobytes().hex()


def payload_of(image: Image, blocks: np.ndarray) -> bytes:
    """The bytes that an image of ``encode`` keeps."""
    (length,) = struct.unpack(">Q", image.comments[0])
    return _mapping()[1][blocks.reshape(-1)[:length].astype(np.int64) + 128].tobytes()


def store(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes and media (the image) of every text's padded payload."""
    on_workers(df.sparkSession)
    id_type = dict(df.dtypes)[id_column]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, j in slices(offsets, 1 << 19):
                payloads = [padded(data[a:b].tobytes()) for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1]), pa.int64()), pa.array(encode(payloads), pa.binary())], names=[id_column, "n_bytes", "media"])

    return df.select(id_column, text_column).mapInArrow(made, f"`{id_column}` {id_type}, n_bytes bigint, media binary")


def features(df: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """What stored images hold: dimensions, thumbnail hash, digests of the payload read back and of the image."""
    on_workers(df.sparkSession)
    id_type = dict(df.dtypes)[id_column]
    names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "thumb_hash"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.concatenate([[0], np.cumsum(np.diff(_offsets(batch.column(2))))])
            for i, j in slices(sizes, 1 << 19):
                media = batch.column(2).slice(i, j - i).to_pylist()
                images = [Image(m) for m in media]
                rows = []
                for m, image, blocks in zip(media, images, coefficients(images), strict=True):
                    payload = payload_of(image, blocks)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), image.width, image.height, thumbnail_hash(thumbnail(image, blocks))))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *columns], names=names)

    return df.select(id_column, "n_bytes", "media").mapInArrow(made, f"`{id_column}` {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, width bigint, height bigint, thumb_hash string")


def _offsets(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.large_binary())
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
