"""A writer of small HDF5 files (superblock version 0): groups, contiguous datasets, string attributes.

A tree of :class:`Group` and :class:`Dataset` is laid out children first; each object is a
version 1 header, a group keeps its names in a local heap under a B-tree of one leaf. A dataset's bytes can be :class:`Planned`:
the layout then leaves a gap, which tasks fill at its offset.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the file format.
SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNDEFINED = 0xFFFFFFFFFFFFFFFF
LEAF_K = 32
INTERNAL_K = 32
MESSAGE_DATASPACE, MESSAGE_DATATYPE, MESSAGE_LAYOUT, MESSAGE_ATTRIBUTE, MESSAGE_SYMBOLS = 0x1, 0x3, 0x8, 0xC, 0x11

#: A group's entries must fit one node.
MOST_ENTRIES = 2 * LEAF_K


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def string_type(size: int) -> bytes:
    """Fixed length, ended by a null."""
    return struct.pack("<BBBBI", 0x13, 0, 0, 0, size)


def number_type(kind: np.dtype) -> bytes:
    bits = kind.itemsize * 8
    if kind.kind in "iu":
        return struct.pack("<BBBBIHH", 0x10, 8 if kind.kind == "i" else 0, 0, 0, kind.itemsize, 0, bits)
    exponent, mantissa, bias = {4: (8, 23, 127), 8: (11, 52, 1023)}[kind.itemsize]
    return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, bits - 1, 0, kind.itemsize, 0, bits, mantissa, exponent, 0, mantissa, bias)


def dataspace(shape: tuple[int, ...]) -> bytes:
    return struct.pack(f"<BBB5x{len(shape)}Q", 1, len(shape), 0, *shape)


@dataclass(frozen=True)
class Planned:
    """So many bytes that are written elsewhere, by the key they are known by."""

    key: str
    size: int

    def __len__(self) -> int:
        return self.size


@dataclass
class Dataset:
    name: str
    datatype: bytes
    shape: tuple[int, ...]
    data: bytes | Planned
    attributes: dict[str, str] = field(default_factory=dict)


@dataclass
class Group:
    name: str
    children: list[Group | Dataset] = field(default_factory=list)


def text(name: str, value: str | bytes) -> Dataset:
    raw = (value.encode() if isinstance(value, str) else value) or b"\0"
    return Dataset(name, string_type(len(raw)), (), raw)


def texts(name: str, values: list[str]) -> Dataset:
    raw = [v.encode() for v in values]
    size = max([1, *map(len, raw)])
    return Dataset(name, string_type(size), (len(raw),), b"".join(r.ljust(size, b"\0") for r in raw))


def planned(name: str, kind: np.dtype, shape: tuple[int, ...], key: str, attributes: dict[str, str] | None = None) -> Dataset:
    """An array whose bytes (little-endian) are written elsewhere."""
    return Dataset(name, number_type(np.dtype(kind)), shape, Planned(key, int(np.prod(shape, dtype=object)) * np.dtype(kind).itemsize), attributes or {})


def array(name: str, values: np.ndarray, attributes: dict[str, str] | None = None) -> Dataset:
    values = np.asarray(values)
    little = values.astype(values.dtype.newbyteorder("<"))
    return Dataset(name, number_type(values.dtype), values.shape, little.tobytes(), attributes or {})


def flag(name: str, values) -> Dataset:
    """Booleans as signed bytes."""
    return array(name, np.asarray(values).astype(np.int8))


def _attribute(name: str, value: str) -> bytes:
    raw = value.encode() or b"\0"
    label, kind, space = name.encode() + b"\0", string_type(len(raw)), dataspace(())
    return struct.pack("<BBHHH", 1, 0, len(label), len(kind), len(space)) + _padded(label) + _padded(kind) + _padded(space) + raw


@dataclass
class Layout:
    """A file's size, the blocks ``(offset, bytes)`` that are known, and where planned bytes go."""

    size: int
    blocks: list[tuple[int, bytes]]
    gaps: dict[str, int]


class _File:
    """Blocks in a row after the superblock; a gap ends one block and starts the next."""

    def __init__(self) -> None:
        self.end, self.blocks, self.gaps = 96, [(0, bytearray(96))], {}

    def place(self, block: bytes | Planned) -> int:
        at = self.end
        self.end += len(block) + -len(block) % 8
        if isinstance(block, Planned):
            self.gaps[block.key] = at
            self.blocks.append((at + len(block), bytearray(-len(block) % 8)))
        else:
            self.blocks[-1][1].extend(_padded(block))
        return at

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHB3x", kind, len(_padded(m)), 0) + _padded(m) for kind, m in messages)
        return self.place(struct.pack("<BBHII4x", 1, 0, len(messages), 1, len(body)) + body)

    def names(self, entries: dict[str, int]) -> tuple[int, int]:
        """The heap of names, the node of entries by name, and the tree above: addresses of tree and heap."""
        if len(entries) > MOST_ENTRIES:
            raise ValueError(f"a group has {len(entries)} entries; one node holds {MOST_ENTRIES}")
        heap, offsets = bytearray(8), {}
        for name in sorted(entries, key=str.encode):
            offsets[name] = len(heap)
            heap += _padded(name.encode() + b"\0")
        free = len(heap)
        heap += struct.pack("<QQ", 1, 16)
        heap_at = self.end
        self.place(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(heap), free, heap_at + 32))
        self.place(bytes(heap))
        keys = [0]
        if offsets:
            symbols = b"".join(struct.pack("<QQI20x", offsets[n], entries[n], 0) for n in offsets)
            node = self.place(struct.pack("<4sBBH", b"SNOD", 1, 0, len(offsets)) + symbols.ljust(MOST_ENTRIES * 40, b"\0"))
            keys += [node, max(offsets.values())]
        tree = struct.pack("<4sBBHQQ", b"TREE", 0, 0, len(keys) // 2, UNDEFINED, UNDEFINED) + struct.pack(f"<{len(keys)}Q", *keys)
        return self.place(tree.ljust(24 + 8 * (4 * INTERNAL_K + 1), b"\0")), heap_at

    def node(self, item: Group | Dataset) -> int:
        if isinstance(item, Group):
            return self.header([(MESSAGE_SYMBOLS, struct.pack("<QQ", *self.group(item)))])
        where = self.place(item.data) if item.data else UNDEFINED
        messages = [(MESSAGE_DATATYPE, item.datatype), (MESSAGE_DATASPACE, dataspace(item.shape)), (MESSAGE_LAYOUT, struct.pack("<BBQQ", 3, 1, where, len(item.data)))]
        return self.header(messages + [(MESSAGE_ATTRIBUTE, _attribute(k, v)) for k, v in item.attributes.items()])

    def group(self, item: Group) -> tuple[int, int]:
        return self.names({c.name: self.node(c) for c in item.children})


def layout(children: list[Group | Dataset]) -> Layout:
    out = _File()
    tree, heap = out.group(Group("/", children))
    root = out.header([(MESSAGE_SYMBOLS, struct.pack("<QQ", tree, heap))])
    head = SIGNATURE + struct.pack("<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, LEAF_K, INTERNAL_K, 0)
    head += struct.pack("<4Q", 0, UNDEFINED, out.end, UNDEFINED) + struct.pack("<QQIIQQ", 0, root, 1, 0, tree, heap)
    out.blocks[0][1][:96] = head
    return Layout(out.end, [(at, bytes(block)) for at, block in out.blocks if block], out.gaps)


def serialize(children: list[Group | Dataset]) -> bytes:
    """The bytes of a file without planned datasets."""
    out = layout(children)
    if out.gaps:
        raise ValueError(f"bytes are missing: {sorted(out.gaps)[:3]}")
    return b"".join(block for _, block in out.blocks)


def read_places(data) -> dict:
    """The tree of a file (bytes, or a map of it) as nested dicts; a dataset is ``(shape, offset, length, attributes)``. Only headers are read."""
    if data[:8] != SIGNATURE or struct.unpack_from("<Q", data, 40)[0] != len(data):
        raise ValueError("not such a file, or cut short")

    def name_at(heap: int, offset: int) -> str:
        start = struct.unpack_from("<Q", data, heap + 24)[0] + offset
        return data[start : data.find(b"\0", start)].decode()

    def group_at(tree: int, heap: int) -> dict:
        used = struct.unpack_from("<H", data, tree + 6)[0]
        if not used:
            return {}
        node = struct.unpack_from("<Q", data, tree + 32)[0]
        count = struct.unpack_from("<H", data, node + 6)[0]
        found = (struct.unpack_from("<QQ", data, node + 8 + 40 * k) for k in range(count))
        return {name_at(heap, offset): object_at(where) for offset, where in found}

    def object_at(where: int):
        count = struct.unpack_from("<H", data, where + 2)[0]
        at, shape, start, length, attributes = where + 16, (), 0, 0, {}
        for _ in range(count):
            kind, size = struct.unpack_from("<HH", data, at)
            body = data[at + 8 : at + 8 + size]
            if kind == MESSAGE_SYMBOLS:
                return group_at(*struct.unpack_from("<QQ", body))
            if kind == MESSAGE_DATASPACE:
                shape = struct.unpack_from(f"<{body[1]}Q", body, 8)
            elif kind == MESSAGE_LAYOUT:
                start, length = struct.unpack_from("<QQ", body, 2)
            elif kind == MESSAGE_ATTRIBUTE:
                label, dtype, space = struct.unpack_from("<HHH", body, 2)
                skip = lambda n: n + -n % 8
                value = 8 + skip(label) + skip(dtype) + skip(space)
                n = struct.unpack_from("<I", body, 8 + skip(label) + 4)[0]
                attributes[body[8 : 8 + label - 1].decode()] = body[value : value + n].decode()
            at += 8 + size
        return shape, start, length, attributes

    return group_at(*struct.unpack_from("<QQ", data, 80))


def read_tree(data: bytes) -> dict:
    """The same with a dataset as ``(shape, bytes, attributes)``. For checks of small files."""

    def filled(item):
        if isinstance(item, dict):
            return {name: filled(child) for name, child in item.items()}
        shape, start, length, attributes = item
        return shape, data[start : start + length] if length else b"", attributes

    return filled(read_places(data))
