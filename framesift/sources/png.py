"""8-bit PNG without an image library: enough to write rendered scenes and to read plain files."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}  # colour type -> samples a pixel


def encode(pixels: np.ndarray) -> bytes:
    """Grey (h, w) or RGB (h, w, 3) bytes as a PNG; equal pixels give equal files."""
    h, w = pixels.shape[:2]
    kind = 0 if pixels.ndim == 2 else 2
    lines = np.ascontiguousarray(pixels, np.uint8).reshape(h, -1)
    raw = np.hstack([np.zeros((h, 1), np.uint8), lines]).tobytes()

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    out = line.astype(np.int64)
    up = above.astype(np.int64)
    for i in range(len(out)):  # each byte needs the one before it
        a, c = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 1:
            guess = a
        elif kind == 3:
            guess = (a + up[i]) // 2
        else:
            p = a + up[i] - c
            guess = min(((abs(p - a), 0, a), (abs(p - up[i]), 1, up[i]), (abs(p - c), 2, c)))[2]
        out[i] = (out[i] + guess) & 255
    return out.astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Pixels (h, w, channels) of an 8-bit PNG that is neither interlaced nor indexed."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body = 8, None, b""
    while at + 8 <= len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        name, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if data[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(name + part)):
            raise ValueError("damaged PNG")
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif name == b"IDAT":
            body += part
        elif name == b"IEND":
            break
        at += 12 + size
    else:
        raise ValueError("truncated PNG")
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        raise ValueError("unsupported PNG")
    w, h, n = head[0], head[1], _CHANNELS[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8)
    except zlib.error as e:
        raise ValueError("damaged PNG") from e
    if raw.size != h * (w * n + 1):
        raise ValueError("truncated PNG")
    lines = raw.reshape(h, -1)
    above = np.zeros(w * n, np.uint8)
    out = np.empty((h, w * n), np.uint8)
    for y in range(h):
        out[y] = above = _unfiltered(int(lines[y, 0]), lines[y, 1:], above, n)
    return out.reshape(h, w, n)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma of pixels (h, w, channels): 299, 587 and 114 thousandths of red, green and blue."""
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    return np.rint(pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
