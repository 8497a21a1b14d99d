"""TIFF and BigTIFF: bytes to arrays and back. Strips or tiles, plain or as LZW, Deflate or PackBits; 8 and 16 bits and floats; several
pages. A file is read by byte ranges, so a page or a tile costs its own bytes and its directory."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

# Sizes and codes of the format's value types.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 18: "Q"}
#: Bytes from an offset on.
Read = Callable[[int, int], bytes]
Tags = dict[int, tuple]


def directories(read: Read) -> Iterator[Tags]:
    """Tags of every page, one after another: tag to its values; a rational is a pair of numbers; 0 is the order of bytes."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    offset, number, entry, inline = ("Q", "Q", 20, 8) if magic == 43 else ("I", "H", 12, 4)
    at, seen = struct.unpack(order + offset, head[8:16] if magic == 43 else head[4:8])[0], set()
    while at and at not in seen:
        seen.add(at)
        start = at + struct.calcsize(order + number)
        count = struct.unpack(order + number, read(at, start - at))[0]
        body = read(start, count * entry + inline)
        tags: Tags = {0: (order,)}
        for k in range(count):
            tag, kind, n = struct.unpack(order + "HH" + offset, body[k * entry : k * entry + 4 + inline])
            raw = body[k * entry + 4 + inline : (k + 1) * entry]
            size = _SIZES.get(kind, 1) * n
            raw = raw[:size] if size <= inline else read(struct.unpack(order + offset, raw)[0], size)
            if kind == 5:
                flat = struct.unpack(f"{order}{2 * n}I", raw)
                tags[tag] = tuple(zip(flat[::2], flat[1::2], strict=True))
            else:
                tags[tag] = struct.unpack(f"{order}{n}{_CODES[kind]}", raw) if kind in _CODES else (raw,)
        yield tags
        at = struct.unpack(order + offset, body[count * entry :])[0]


def pages(data: bytes) -> list[Tags]:
    """Tags of every page of a file."""
    return list(directories(lambda at, n: data[at : at + n]))


@dataclass(frozen=True)
class Segment:
    """A strip or tile: its place and size in the page (cut to it), the sample it holds (None: all), and where its bytes are."""

    y: int
    x: int
    height: int
    width: int
    sample: int | None
    offset: int
    size: int


def shape(tags: Tags) -> tuple[int, int, int]:
    """Height, width and samples of a page."""
    return tags[257][0], tags[256][0], tags.get(277, (1,))[0]


def kind_of(tags: Tags) -> str:
    bits, form = tags.get(258, (1,))[0], tags.get(339, (1,))[0]
    kind = {(8, 1): "u1", (16, 1): "u2", (32, 1): "u4", (16, 2): "i2", (32, 3): "f4", (64, 3): "f8"}.get((bits, form))
    if kind is None:
        raise ValueError(f"{bits} bits of sample format {form} are not read")
    return kind


def segments(tags: Tags) -> list[Segment]:
    """Strips or tiles of a page, in the file's order."""
    height, width, samples = shape(tags)
    tiled = 322 in tags
    h, w = (tags[323][0], tags[322][0]) if tiled else (min(tags.get(278, (height,))[0], height), width)
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across, down = -(-width // w), -(-height // h)
    planes = range(samples) if samples > 1 and tags.get(284, (1,))[0] == 2 else (None,)
    places = [(p, i * h, j * w) for p in planes for i in range(down) for j in range(across)]
    return [Segment(y, x, min(h, height - y), min(w, width - x), p, a, n) for (p, y, x), a, n in zip(places, offsets, sizes, strict=False)]


def segment_array(tags: Tags, segment: Segment, raw: bytes) -> np.ndarray:
    """Pixels (height, width, samples) of a strip or tile."""
    unpack = _UNPACK.get(tags.get(259, (1,))[0])
    if unpack is None:
        raise ValueError(f"compression {tags[259][0]} is not read")
    kind, depth = kind_of(tags), 1 if segment.sample is not None else shape(tags)[2]
    full = tags[322][0] if 322 in tags else segment.width
    flat = np.frombuffer(unpack(raw), np.dtype(kind).newbyteorder(tags[0][0]))
    rows = tags[323][0] if 322 in tags else segment.height
    block = flat[: rows * full * depth].reshape(rows, full, depth)
    if tags.get(317, (1,))[0] == 2:  # differences along the row
        block = np.cumsum(block, axis=1, dtype=kind)
    return block[: segment.height, : segment.width].astype(kind, copy=False)


def decode(data: bytes) -> np.ndarray:
    """Pixels of a file, full depth: (height, width), with samples last (first, where each has a plane of its own) and pages before."""
    frames = []
    for tags in pages(data):
        height, width, samples = shape(tags)
        frame = np.zeros((height, width, samples), kind_of(tags))
        for s in segments(tags):
            frame[s.y : s.y + s.height, s.x : s.x + s.width, slice(None) if s.sample is None else slice(s.sample, s.sample + 1)] = segment_array(tags, s, data[s.offset : s.offset + s.size])
        planes = samples > 1 and tags.get(284, (1,))[0] == 2
        frames.append((np.moveaxis(frame, -1, 0) if planes else frame).squeeze())
    return np.stack(frames) if len(frames) > 1 else frames[0]


def encode(image: np.ndarray, pixel_size: float | None = None, compressed: bool = False, tile: int | None = None, big: bool = False) -> bytes:
    """TIFF of a (height, width) array, or of a (pages, height, width) stack; the resolution tag holds pixels per micrometre.

    ``compressed``: strips or tiles are deflated. ``tile``: side of square tiles, a multiple of 16, instead of one strip. ``big``: offsets
    of 64 bits.
    """
    stack = np.ascontiguousarray(image if np.ndim(image) == 3 else np.asarray(image)[None])
    out = b"II" + (struct.pack("<HHHQ", 43, 8, 0, 16) if big else struct.pack("<HI", 42, 8))
    for k, page in enumerate(stack):
        out += _page(page, pixel_size, compressed, tile, big, len(out), k + 1 < len(stack))
    return out


def _page(image: np.ndarray, pixel_size: float | None, compressed: bool, tile: int | None, big: bool, at: int, more: bool) -> bytes:
    """One page at offset ``at``: its directory, the values that do not fit in there, its strip or tiles."""
    height, width = image.shape
    bits, form = {"u1": (8, 1), "u2": (16, 1), "f4": (32, 3), "f8": (64, 3)}[image.dtype.str[1:]]
    if tile:
        wide = np.pad(image, ((0, -height % tile), (0, -width % tile)))
        blocks = [wide[i : i + tile, j : j + tile] for i in range(0, height, tile) for j in range(0, width, tile)]
    else:
        blocks = [image]
    raws = [np.ascontiguousarray(b).astype(b.dtype.newbyteorder("<")).tobytes() for b in blocks]
    raws = [zlib.compress(r) if compressed else r for r in raws]
    offset, inline, number = ("Q", 8, "<Q") if big else ("I", 4, "<H")
    address = 16 if big else 4
    values = [(256, 4, [width]), (257, 4, [height]), (258, 3, [bits]), (259, 3, [8 if compressed else 1]), (262, 3, [1]), (277, 3, [1])]
    values += [(322, 4, [tile]), (323, 4, [tile]), (324, address, [0] * len(raws)), (325, address, [len(r) for r in raws])] if tile else [(273, address, [0]), (278, 4, [height]), (279, address, [len(raws[0])])]
    values += [(282, 5, [round(1e6 / pixel_size), 1_000_000]), (283, 5, [round(1e6 / pixel_size), 1_000_000]), (296, 3, [1])] if pixel_size else []
    values.append((339, 3, [form]))
    pack = lambda kind, v: struct.pack("<2I", *v) if kind == 5 else struct.pack(f"<{len(v)}{_CODES[kind]}", *v)
    start = at + struct.calcsize(number) + len(values) * (4 + 2 * inline) + inline
    extra = {tag: len(p) for tag, kind, v in values if len(p := pack(kind, v)) > inline}
    data = start + sum(extra.values())
    places = np.cumsum([0, *map(len, raws)])[:-1] + data
    body, beyond = b"", b""
    for tag, kind, v in sorted(values):
        p = pack(kind, places.tolist() if tag in (273, 324) else v)
        n = 1 if kind == 5 else len(v)
        body += struct.pack("<HH" + offset, tag, kind, n) + (struct.pack("<" + offset, start + len(beyond)) if tag in extra else p.ljust(inline, b"\0"))
        beyond += p if tag in extra else b""
    end = data + sum(map(len, raws))
    return struct.pack(number, len(values)) + body + struct.pack("<" + offset, end + end % 2 if more else 0) + beyond + b"".join(raws) + bytes(end % 2)


def resolution(data: bytes) -> float | None:
    """Micrometres per pixel from the resolution tag, None without a usable one."""
    return next((pixel_size(tags) for tags in directories(lambda at, n: data[at : at + n])), None)


def pixel_size(tags: Tags) -> float | None:
    """Micrometres per pixel of a page."""
    return tags[282][0][1] / tags[282][0][0] if 282 in tags and tags[282][0][0] else None


def channels_last(array: np.ndarray, most: int = 8) -> np.ndarray:
    """Any stack as (height, width, channels), largest values over what is neither.

    The channels lie along an axis of at most ``most`` entries: of three axes the smallest, of more the first such one.
    Without one, there is a single channel.
    """
    a = np.asarray(array, np.float64).squeeze()
    a = a.reshape((1,) * (2 - a.ndim) + a.shape)
    sizes = [] if a.ndim < 3 else [min(a.shape)] if a.ndim == 3 else [n for n in a.shape if n <= most]
    a = np.moveaxis(a, a.shape.index(sizes[0]), -1) if sizes and sizes[0] <= most else a[..., None]
    return a.reshape(-1, *a.shape[-3:]).max(axis=0)


def _unpacked_bits(data: bytes) -> bytes:
    """PackBits: a count and that many bytes, or a count of one byte repeated."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def _unpacked_lzw(data: bytes) -> bytes:
    """LZW as in TIFF: codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends."""
    first = [bytes([b]) for b in range(256)] + [b"", b""]
    table, out, last, width, held, bits = first[:], [], None, 9, 0, 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        code = held >> (bits - width) & (1 << width) - 1
        bits -= width
        if code == 257:
            break
        if code == 256:
            table, last, width = first[:], None, 9
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last is not None:
            table.append(last + word[:1])
        last = word
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


#: Compression codes of the format.
_UNPACK = {1: bytes, 5: _unpacked_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpacked_bits}
