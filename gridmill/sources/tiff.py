"""Baseline TIFF: any sample type, strips or tiles, chunky or planar, plain, PackBits, LZW or deflate."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}
_NAMES = {"u": "uint", "i": "int", "f": "float"}


@dataclass
class Image:
    """Samples as (height, width, channels), with the name of their type."""

    samples: np.ndarray

    @property
    def dtype(self) -> str:
        return f"{_NAMES[self.samples.dtype.kind]}{self.samples.dtype.itemsize * 8}"


def _unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    out, bits, held = bytearray(), 0, 0
    table: list[bytes] = []
    width, before = 9, b""
    for byte in data:
        bits = (bits << 8) | byte
        held += 8
        while held >= width:
            held -= width
            code = (bits >> held) & ((1 << width) - 1)
            bits &= (1 << held) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table = [bytes([k]) for k in range(256)] + [b"", b""]
                width, before = 9, b""
                continue
            entry = table[code] if code < len(table) else before + before[:1]
            out += entry
            if before:
                table.append(before + entry[:1])
            before = entry
            width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


Read = Callable[[int, int], bytes]


def _pages(read: Read) -> tuple[str, list[dict[int, tuple]]]:
    """The byte order, and the tags of each image of the file; only directories are read, not samples."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(f"{order}H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(f"{order}I", head[4:8])[0]
    pages, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        tags = {}
        entries = struct.unpack(f"{order}H", read(at, 2))[0]
        directory = read(at + 2, 12 * entries + 4)
        for k in range(entries):
            tag, kind, n = struct.unpack_from(f"{order}HHI", directory, 12 * k)
            size = _SIZES.get(kind, 1) * n
            value = directory[12 * k + 8 : 12 * k + 8 + size] if size <= 4 else read(struct.unpack_from(f"{order}I", directory, 12 * k + 8)[0], size)
            tags[tag] = struct.unpack(f"{order}{n}{_CODES[kind]}", value) if kind in _CODES else (value,)
        pages.append(tags)
        at = struct.unpack_from(f"{order}I", directory, 12 * entries)[0]
    return order, pages


@dataclass(frozen=True)
class Layout:
    """Where an image's samples lie: blocks (strips or tiles) of ``rows`` by ``cols``, each packed on its own."""

    width: int
    height: int
    channels: int
    kind: np.dtype
    planar: bool
    tiled: bool
    rows: int
    cols: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    compression: int
    predictor: int

    @property
    def dtype(self) -> str:
        return f"{_NAMES[self.kind.kind]}{self.kind.itemsize * 8}"

    def place(self, k: int) -> tuple[int, int, int, int, int]:
        """Of a block: its channel (0 where it has all), first row and column, rows and columns."""
        across, down = -(-self.width // self.cols), -(-self.height // self.rows)
        plane, part = divmod(k, across * down) if self.planar else (0, k)
        y, x = part // across * self.rows, part % across * self.cols
        return plane, y, x, min(self.rows, self.height - y), min(self.cols, self.width - x)

    def block(self, k: int, data: bytes) -> np.ndarray:
        """A block's samples as (rows, columns, channels it has)."""
        unpack = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpack_bits}[self.compression]
        _, _, _, h, w = self.place(k)
        n, per_pixel = self.rows if self.tiled else h, 1 if self.planar else self.channels
        block = np.frombuffer(unpack(data), self.kind)
        if len(block) < n * self.cols * per_pixel:
            raise ValueError("fewer samples than the image's size needs")
        block = block[: n * self.cols * per_pixel].reshape(n, self.cols, per_pixel)
        if self.predictor == 2:
            block = np.cumsum(block, axis=1, dtype=self.kind.newbyteorder("="))
        return block[:h, :w]


def layout(read: Read) -> Layout:
    """The layout of the file's image; smaller versions of it (thumbnails, pyramids) are passed over.

    Several images, which make a stack of more than two axes, are an error.
    """
    order, pages = _pages(read)
    whole = [tags for tags in pages if not tags.get(254, (0,))[0] & 1]
    if len(whole) > 1:
        raise ValueError(f"only two-dimensional images are read, not {len(whole)} in one file")
    tags = (whole or pages)[0]
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, channels = tags[256][0], tags[257][0], one(277, 1)
    tiled = 322 in tags
    rows, cols = (tags[323][0], tags[322][0]) if tiled else (min(one(278, height), height), width)
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    if one(259, 1) not in (1, 5, 8, 32946, 32773):
        raise ValueError(f"compression {one(259, 1)} is not read")
    kind = np.dtype(f"{order}{_KINDS[one(339, 1)]}{one(258, 8) // 8}")
    return Layout(width, height, channels, kind, one(284, 1) == 2 and channels > 1, tiled, rows, cols, tuple(offsets), tuple(sizes), one(259, 1), one(317, 1))


def decode(data: bytes) -> Image:
    """The file's image, see :func:`layout`; a size that does not fit the samples is an error."""
    at = layout(lambda offset, n: data[offset : offset + n])
    out = np.zeros((at.height, at.width, at.channels), at.kind.newbyteorder("="))
    for k, (offset, size) in enumerate(zip(at.offsets, at.sizes, strict=True)):
        plane, y, x, h, w = at.place(k)
        block = at.block(k, data[offset : offset + size])
        out[y : y + h, x : x + w, plane if at.planar else slice(None)] = block[:, :, 0] if at.planar else block
    return Image(out)


def header(width: int, height: int, channels: int, kind: np.dtype, strip_rows: int | None = None) -> bytes:
    """What stands before the samples of an uncompressed little-endian file; strips of ``strip_rows`` rows follow one another."""
    kind, strip_rows = np.dtype(kind), min(strip_rows or height, height)
    bits, row_bytes = kind.itemsize * 8, width * channels * kind.itemsize
    if row_bytes * height >= 1 << 32:
        raise ValueError("a file of this format holds less than 4 GB")
    counts = [min(strip_rows, height - y) * row_bytes for y in range(0, height, strip_rows)]
    fields = [
        (256, 4, [width]), (257, 4, [height]), (258, 3, [bits] * channels), (259, 3, [1]), (262, 3, [1]), (273, 4, [0] * len(counts)), (277, 3, [channels]),
        (278, 4, [strip_rows]), (279, 4, counts), (284, 3, [1]), (339, 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]] * channels),
    ]
    if channels > 1:
        fields.insert(-1, (338, 3, [0] * (channels - 1)))
    lengths = [len(values) * _SIZES[code] for _, code, values in fields]
    end = 8 + 2 + 12 * len(fields) + 4
    start = end + sum(n + n % 2 for n in lengths if n > 4)
    fields = [(tag, code, [start + y * row_bytes for y in range(0, height, strip_rows)] if tag == 273 else values) for tag, code, values in fields]
    out, extra = [b"II*\0", struct.pack("<IH", 8, len(fields))], b""
    for tag, code, values in fields:
        packed = struct.pack(f"<{len(values)}{_CODES[code]}", *values)
        value = packed.ljust(4, b"\0") if len(packed) <= 4 else struct.pack("<I", end + len(extra))
        extra += packed + b"\0" * (len(packed) % 2) if len(packed) > 4 else b""
        out.append(struct.pack("<HHI", tag, code, len(values)) + value)
    return b"".join([*out, struct.pack("<I", 0), extra])


def encode(samples: np.ndarray) -> bytes:
    """One strip, little-endian, uncompressed; samples as (height, width) or (height, width, channels)."""
    samples = samples.reshape(*samples.shape[:2], -1)
    return header(samples.shape[1], samples.shape[0], samples.shape[2], samples.dtype) + samples.astype(samples.dtype.newbyteorder("<")).tobytes()
