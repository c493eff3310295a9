"""A PNG encoder and nearest-neighbour scaling, so that images can be written without a codec library."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def encode(image: np.ndarray, level: int = 6) -> bytes:
    """RGB bytes [H, W, 3] as PNG."""
    height, width, _ = image.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(height, width * 3)], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def adler_of_both(first: int, second: int, length: int) -> int:
    """Adler-32 of two pieces in a row from those of the pieces; ``length`` is the second one's."""
    base = 65521
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    a = (a1 + a2 - 1) % base
    return (b1 + b2 + length % base * (a1 - 1)) % base << 16 | a


def strip(image: np.ndarray, level: int = 6) -> tuple[bytes, int, int]:
    """Rows of an image as (deflated, Adler-32, length), to be put in a row with others by ``write_strips``."""
    height, width, _ = image.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(height, width * 3)], axis=1).tobytes()
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    return packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH), zlib.adler32(raw), len(raw)


def write_strips(out, width: int, height: int, strips) -> None:
    """A PNG of strips from the top down into an open file; no more than one strip is held."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    out.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"\x78\x9c"))
    total = 1
    for deflated, adler, length in strips:
        out.write(chunk(b"IDAT", deflated))
        total = adler_of_both(total, adler, length)
    out.write(chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", total)) + chunk(b"IEND", b""))


#: 3 x 5 dots of the characters of labels, a row of three bits after the other.
GLYPHS = {"0": "75557", "1": "26227", "2": "71747", "3": "71717", "4": "55711", "5": "74717", "6": "74757", "7": "71111", "8": "75757", "9": "75717", ".": "00002", "-": "00700"}


def labelled(image: np.ndarray, text: str, colour: str, dot: int = 1) -> np.ndarray:
    """The image with a label in its upper left corner; characters without a glyph are left out."""
    out = image.copy()
    rgb = [int(colour[i : i + 2], 16) for i in (1, 3, 5)]
    x = 5
    for c in text:
        for row, bits in enumerate(GLYPHS.get(c, "")[-5:]):
            for col in range(3):
                if int(bits) >> (2 - col) & 1:
                    out[5 + row * dot : 5 + (row + 1) * dot, x + col * dot : x + (col + 1) * dot] = rgb
        x += 4 * dot
    return out


def scaled(image: np.ndarray, width: int, height: int) -> np.ndarray:
    y = (np.arange(height) * image.shape[0]) // height
    x = (np.arange(width) * image.shape[1]) // width
    return image[y[:, None], x[None, :]]


def framed(image: np.ndarray, colour: str, border: int = 4) -> np.ndarray:
    """The image with a border of a '#rrggbb' colour."""
    out = image.copy()
    rgb = [int(colour[i : i + 2], 16) for i in (1, 3, 5)]
    b = min(border, *(s // 2 for s in image.shape[:2]))
    out[:b], out[-b:], out[:, :b], out[:, -b:] = rgb, rgb, rgb, rgb
    return out
