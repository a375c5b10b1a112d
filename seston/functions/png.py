"""PNG images in pure Python and NumPy: grey, grey with alpha, RGB, RGBA and palettes, of 1 to 16 bits, not interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def encode(image: np.ndarray) -> bytes:
    """Of a (height, width) or (height, width, 1 to 4) array of uint8, bool or uint16."""
    image = np.asarray(image)
    if image.dtype == bool:
        image = image.astype(np.uint8) * 255
    if image.dtype not in (np.uint8, np.uint16):
        raise ValueError(f"PNG holds uint8 and uint16, not {image.dtype}")
    if image.ndim == 2:
        image = image[:, :, None]
    h, w, c = image.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    depth = 8 * image.dtype.itemsize
    rows = image.astype(f">u{image.dtype.itemsize}").reshape(h, -1).view(np.uint8).reshape(h, -1)
    raw = np.zeros((h, rows.shape[1] + 1), np.uint8)
    raw[:, 1:] = rows

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the row filters (none, left, up, average, Paeth)."""
    h, n = raw.shape[0], raw.shape[1] - 1
    out = np.zeros((h + 1, n + bpp), np.int64)
    for y in range(h):
        kind, line = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        up, now = out[y], out[y + 1]
        if kind == 0:
            now[bpp:] = line
        elif kind == 2:
            now[bpp:] = (line + up[bpp:]) & 255
        elif kind == 1:
            padded = np.zeros(-(-n // bpp) * bpp, np.int64)
            padded[:n] = line
            now[bpp:] = (np.cumsum(padded.reshape(-1, bpp), 0) & 255).reshape(-1)[:n]
        elif kind == 3:
            for x in range(n):
                now[bpp + x] = (line[x] + (now[x] + up[bpp + x]) // 2) & 255
        elif kind == 4:
            for x in range(n):
                a, b, c = int(now[x]), int(up[bpp + x]), int(up[x])
                pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                now[bpp + x] = (line[x] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
        else:
            raise ValueError(f"unknown row filter {kind}")
    return out[1:, bpp:].astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """A (height, width) array of a grey image, else (height, width, channels); uint8, or uint16 of 16 bits. A palette gives its colours."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
        elif name == b"IEND":
            break
        at += size + 12
    if head is None:
        raise ValueError("no PNG header")
    w, h, depth, kind, _, _, interlaced = head
    if interlaced:
        raise ValueError("interlaced PNG")
    c = CHANNELS[kind]
    n = -(-w * c * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    rows = _unfilter(raw[: h * (n + 1)].reshape(h, n + 1), max(1, c * depth // 8))
    if depth == 16:
        image = rows.reshape(h, -1).view(">u2").astype(np.uint16).reshape(h, w, c)
    elif depth == 8:
        image = rows.reshape(h, w, c)
    else:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)[:, : w * c]
        image = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8).reshape(h, w, c)
        if kind == 0:
            image = (image.astype(int) * 255 // (2**depth - 1)).astype(np.uint8)
    if kind == 3:
        return palette[image[:, :, 0]]
    return image[:, :, 0] if c == 1 else image
