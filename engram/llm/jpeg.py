"""Media columns: progressive JPEG read into coefficient arrays and full-resolution RGB tensors.

``decode`` accumulates the scans of a progressive file (spectral bands, successive approximation, end-of-band
runs, restarts, sub-sampled components) into arrays of quantised coefficients; ``to_rgb`` transforms them
back in numpy, repeats sub-sampled chroma to full resolution and converts to RGB.

``encode_payload`` stores bytes in such a file without loss. JPEG's unit is the quantised coefficient: the
byte is the 8-bit amplitude code of an AC coefficient of size 8 (b >= 128 stands for b, else b - 255), so
each of a block's 63 AC coefficients carries one byte; DC stays mid-grey. The image is 4:2:0, as square as
can be, its last coefficients filled with 255; a comment holds the payload's length. All coefficients are
non-zero, so every entry of a first scan has one length and a whole scan is read by array operations;
``decode`` reads other files symbol by symbol.

Defined cases: a null text is an empty one; a payload has at least one unit of bytes; long texts make
large images (up to 4095 x 4095 units of 16 x 16 pixels); equal texts give equal files; repeated rows are
kept; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents_of, written

UNIT = 576
#: Fixed values of the JPEG standard: zig-zag order of the 8 x 8 coefficients.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
_K = np.arange(8)
#: Row u holds the cosine of frequency u: samples = BASIS.T @ coefficients @ BASIS.
BASIS = (np.cos((2 * _K[None, :] + 1) * _K[:, None] * math.pi / 16) * np.where(_K == 0, math.sqrt(1 / 8), 0.5)[:, None]).astype(np.float32)
BANDS = ((1, 5), (6, 63))
MARK = b"engram payload "


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    coefficients: np.ndarray | None = None  # rows x columns of blocks x 64, in zig-zag order
    wide: int = 0  # blocks that the component itself has, without what fills the last units
    high: int = 0


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman(symbols: list[int], kind: int, ident: int) -> bytes:
    """A table that gives the i-th symbol a code of i + 1 bits."""
    counts = [1] * len(symbols) + [0] * (16 - len(symbols))
    return segment(0xC4, bytes([kind << 4 | ident, *counts, *symbols]))


def scan_head(parts: list[tuple[int, int]], band: tuple[int, int], high: int, low: int) -> bytes:
    return segment(0xDA, bytes([len(parts), *(x for p in parts for x in p), band[0], band[1], high << 4 | low]))


def packed(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded bytes: the last byte filled with ones, 0xFF followed by 0."""
    fill = -len(bits) % 8
    return np.packbits(np.concatenate([bits, np.ones(fill, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")


def encode_payload(payload: bytes) -> bytes:
    units = max(1, -(-len(payload) // (6 * 63)))
    wide = math.isqrt(units - 1) + 1
    high = -(-units // wide)
    full = np.full(wide * high * 6 * 63, 255, np.uint8)
    full[: len(payload)] = np.frombuffer(payload, np.uint8)
    n = wide * high
    planes = [x.reshape(-1, 63) for x in np.split(full, [4 * n * 63, 5 * n * 63])]
    out = [
        b"\xff\xd8",
        segment(0xFE, MARK + str(len(payload)).encode()),
        segment(0xDB, bytes([0]) + b"\x01" * 64),
        segment(0xC2, struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        huffman([0], 0, 0),  # a difference of size 0
        huffman([0x07], 1, 0),  # no zeros before, a coefficient of size 7
        scan_head([(1, 0), (2, 0), (3, 0)], (0, 0), 0, 1),
        packed(np.zeros(6 * n, np.uint8)),
    ]
    for band in BANDS:
        for c, plane in enumerate(planes):
            # A code bit 0 and the 7 upper bits of the amplitude: a byte under 128.
            out += [scan_head([(c + 1, 0)], band, 0, 1), (plane[:, band[0] - 1 : band[1]] >> 1).tobytes()]
    out += [scan_head([(1, 0), (2, 0), (3, 0)], (0, 0), 1, 0), packed(np.zeros(6 * n, np.uint8))]
    for c, plane in enumerate(planes):
        low = np.where(plane >= 128, plane & 1, 1 - (plane & 1)).astype(np.uint8)
        runs = [min(32767, len(plane) - i) for i in range(0, len(plane), 32767)]
        sizes = sorted({r.bit_length() - 1 for r in runs}, reverse=True)
        bits, at = [], 0
        for r in runs:
            s = r.bit_length() - 1
            code = [1] * sizes.index(s) + [0]
            extra = [(r - (1 << s)) >> (s - 1 - i) & 1 for i in range(s)]
            bits += [np.array(code + extra, np.uint8), low[at : at + r].ravel()]
            at += r
        out += [huffman([s << 4 for s in sizes], 1, 1), scan_head([(c + 1, 1)], (1, 63), 1, 0), packed(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


def payload_of(image: Image) -> bytes:
    """The bytes that ``encode_payload`` stored."""
    if not image.comment.startswith(MARK):
        raise ValueError("the image holds no payload")
    values = np.concatenate([c.coefficients.reshape(-1, 64)[:, 1:].ravel() for c in image.components])
    return np.where(values > 0, values, values + 255).astype(np.uint8)[: int(image.comment[len(MARK) :])].tobytes()


class Bits:
    """Entropy-coded bits of one restart interval."""

    def __init__(self, data: bytes):
        self.raw = data.replace(b"\xff\x00", b"\xff")
        self.all = np.unpackbits(np.frombuffer(self.raw, np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.all[self.at : self.at + n].tolist():
            value = value << 1 | b
        self.at += n
        return value

    def some(self, n: int) -> np.ndarray:
        out = self.all[self.at : self.at + n]
        self.at += n
        if len(out) < n:
            raise ValueError("a scan ends early")
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")


def extended(bits: int, size: int) -> int:
    return bits if size == 0 or bits >= 1 << (size - 1) else bits - (1 << size) + 1


def decode(data: bytes) -> Image:
    """Accumulate all scans of a progressive file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    image, tables, restart, at = Image(), {}, 0, 2
    while at < len(data):
        marker = data[at + 1]
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            return image
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                image.quantisers[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                counts, code, k, table = body[1:17], 0, 17, {}
                for n, c in enumerate(counts, 1):
                    for _ in range(c):
                        table[n, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[body[0] >> 4, body[0] & 15] = table
                body = body[k:]
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            image.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
            columns, rows = -(-image.width // (8 * hmax)), -(-image.height // (8 * vmax))
            for c in image.components:
                c.coefficients = np.zeros((rows * c.v, columns * c.h, 64), np.int32)
                c.wide = -(-(-(-image.width * c.h // hmax)) // 8)
                c.high = -(-(-(-image.height * c.v // vmax)) // 8)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only progressive files are read")
        elif marker == 0xDA:
            n = body[0]
            parts = [(next(c for c in image.components if c.ident == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            pieces, begin = [], at
            while True:
                stop = data.find(b"\xff", at)
                if stop < 0:
                    raise ValueError("the file ends in a scan")
                if data[stop + 1] == 0:
                    at = stop + 2
                    continue
                pieces.append(data[begin:stop])
                at = stop
                if not 0xD0 <= data[stop + 1] <= 0xD7:
                    break
                at = begin = stop + 2
            read_scan(parts, first, last, approx >> 4, approx & 15, tables, pieces, restart)
    raise ValueError("the file has no end")


def read_scan(parts: list[tuple[Component, int]], first: int, last: int, high: int, low: int, tables: dict, pieces: list[bytes], restart: int) -> None:
    if len(parts) > 1:  # interleaved: units of v x h blocks of each component
        index = []
        for c, _ in parts:
            rows, columns, _ = c.coefficients.shape
            grid = np.arange(rows * columns).reshape(rows // c.v, c.v, columns // c.h, c.h).transpose(0, 2, 1, 3)
            index.append(grid.reshape(-1, c.v * c.h))
        units = [[(p, b) for p, i in enumerate(index) for b in i[u].tolist()] for u in range(len(index[0]))] if high == 0 and not all_zero(parts, tables) else None
        count = len(index[0])
    else:
        c = parts[0][0]
        grid = np.arange(c.coefficients.shape[0] * c.coefficients.shape[1]).reshape(c.coefficients.shape[:2])[: c.high, : c.wide].ravel()
        index, units, count = [grid[:, None]], None, len(grid)
    flat = [c.coefficients.reshape(-1, 64) for c, _ in parts]
    step = restart or count
    for k, piece in enumerate(pieces):
        begin, end = k * step, min(count, (k + 1) * step)
        if begin >= end:
            break
        bits = Bits(piece) if not (first and high == 0 and whole_bytes(tables[1, parts[0][1]])) else None
        if first == 0 and high:
            width = sum(i.shape[1] for i in index)
            got = bits.some((end - begin) * width).reshape(-1, width).astype(np.int32) << low
            for f, i, part in zip(flat, index, np.split(got, np.cumsum([i.shape[1] for i in index])[:-1], 1)):
                f[i[begin:end], 0] |= part
        elif first == 0:
            if all_zero(parts, tables):
                continue  # differences of size 0 leave all predictions at 0
            before = [0] * len(parts)
            for u in units[begin:end] if units else ([(0, b)] for b in index[0][begin:end, 0].tolist()):
                for p, b in u:
                    s = bits.symbol(tables[0, parts[p][1]])
                    before[p] += extended(bits.take(s), s)
                    flat[p][b, 0] = before[p] << low
        else:
            table, blocks = tables[1, parts[0][1]], index[0][begin:end, 0]
            if high == 0:
                first_scan(flat[0], blocks, first, last, low, table, bits, piece)
            else:
                refine_scan(flat[0], blocks, first, last, low, table, bits)


def all_zero(parts: list[tuple[Component, int]], tables: dict) -> bool:
    return all(list(tables[0, t].values()) == [0] for _, t in parts)


def whole_bytes(table: dict) -> bool:
    return list(table.items()) == [((1, 0), 0x07)]


def first_scan(flat: np.ndarray, blocks: np.ndarray, first: int, last: int, low: int, table: dict, bits: Bits | None, piece: bytes) -> None:
    if bits is None:  # the only code is one bit, followed by 7 of amplitude: entries are bytes
        got = np.frombuffer(piece.replace(b"\xff\x00", b"\xff"), np.uint8)[: len(blocks) * (last - first + 1)].astype(np.int32)
        if len(got) < len(blocks) * (last - first + 1) or (got > 127).any():
            raise ValueError("a scan is damaged")
        value = np.where(got >= 64, got, got - 127)
        flat[blocks, first : last + 1] = np.where(value < 0, -(-value << low), value << low).reshape(len(blocks), -1)
        return
    run = 0
    for b in blocks.tolist():
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            if s:
                k += r
                v = extended(bits.take(s), s)
                flat[b, k] = v << low if v > 0 else -(-v << low)
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.take(r) - 1
                break


def refine_scan(flat: np.ndarray, blocks: np.ndarray, first: int, last: int, low: int, table: dict, bits: Bits) -> None:
    one, i = 1 << low, 0

    def correct(where: np.ndarray, k: int, stop: int) -> None:
        """A bit for each coefficient that is not zero in [k, stop) of these blocks."""
        part = flat[where, k:stop]
        known = part != 0
        got = np.zeros(part.shape, np.int32)
        got[known] = bits.some(int(known.sum()))
        part += np.where(got == 1, np.sign(part) * one, 0)
        flat[where, k:stop] = part

    while i < len(blocks):
        b, k = blocks[i], first
        while k <= last:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            if s == 0 and r < 15:
                run = (1 << r) + bits.take(r)
                correct(blocks[i : i + 1], k, last + 1)
                if run > 1:
                    correct(blocks[i + 1 : i + run], first, last + 1)
                i += run
                break
            new = (one if bits.take(1) else -one) if s else 0
            while k <= last:
                if flat[b, k]:
                    correct(blocks[i : i + 1], k, k + 1)
                elif r == 0:
                    flat[b, k] = new
                    k += 1
                    break
                else:
                    r -= 1
                k += 1
        else:
            i += 1


def planes(image: Image) -> list[np.ndarray]:
    """Each component's samples, without those that fill its last blocks, as float32."""
    out = []
    for c in image.components:
        natural = np.zeros(c.coefficients.shape, np.float32)
        natural[..., ZIGZAG] = c.coefficients * image.quantisers[c.table]
        rows, columns, _ = natural.shape
        x = BASIS.T @ natural.reshape(rows, columns, 8, 8) @ BASIS
        out.append(np.clip(np.rint(x.transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8) + 128), 0, 255))
    return out


def to_rgb(image: Image) -> np.ndarray:
    """Height x width x 3 of uint8; grey images have three equal channels."""
    hmax, vmax = max(c.h for c in image.components), max(c.v for c in image.components)
    full = []
    for c, p in zip(image.components, planes(image)):
        if c.v < vmax:
            p = np.repeat(p, vmax // c.v, 0)
        if c.h < hmax:
            p = np.repeat(p, hmax // c.h, 1)
        full.append(p[: image.height, : image.width])
    if len(full) == 1:
        rgb = np.stack(full * 3, -1)
    else:
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def feature_of(rgb: np.ndarray) -> str:
    """Size, mean of each channel, and which cells of an 8 x 8 grid are lighter than the mean."""
    h, w, _ = rgb.shape
    light = rgb.sum(2, dtype=np.int64)
    rows, columns = (np.arange(8) * h) // 8, (np.arange(8) * w) // 8
    cells = np.add.reduceat(np.add.reduceat(light, rows, 0), columns, 1).ravel()
    area = np.outer(np.diff(np.append(rows, h)), np.diff(np.append(columns, w))).ravel()
    above = cells * (h * w) > light.sum() * area
    means = rgb.reshape(-1, 3).sum(0, dtype=np.int64) / (h * w)
    return f"{w}x{h}:" + ",".join(f"{m:.3f}" for m in means) + f":{int(''.join('1' if x else '0' for x in above), 2):016x}"


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT or (UNIT if not text else 0))


def encode_media(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media of every document: its payload as a progressive JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            for i in range(0, len(texts), 500):
                part = [t or b"" for t in texts[i : i + 500]]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), pa.array(map(len, part), pa.int64()), pa.array([encode_payload(padded(t)) for t in part], pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents_of(documents).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """doc_id, height, width, rgb binary: the full-resolution tensor, row-major, of every media row; null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b.column(1)[i].as_py()
                rgb = None if data is None else to_rgb(decode(data))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([None if rgb is None else rgb.shape[0]], pa.int32()), pa.array([None if rgb is None else rgb.shape[1]], pa.int32()), pa.array([None if rgb is None else rgb.tobytes()], pa.binary())], ["doc_id", "height", "width", "rgb"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, height int, width int, rgb binary")


def media_digest(documents: DataFrame) -> DataFrame:
    """Store every payload in a media table in the shared folder, read it back, and digest payload, file and tensor.

    The full-resolution RGB tensor is a column of the result (height, width, rgb row-major), so that storing the result stores it."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "rgb"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for doc_id, n, media in zip(*(c.to_pylist() for c in b.columns)):
                image = decode(media)
                payload, rgb = payload_of(image), to_rgb(image)
                out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(rgb), *rgb.shape[:2], rgb.tobytes()))
                size += rgb.nbytes
                if size >= 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    stored = written(encode_media(documents), "media")
    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb binary")
