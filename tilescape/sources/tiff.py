"""A Python data source for TIFF pyramids, classic and big, in strips or tiles: one partition a row strip of tiles.

``spark.read.format("tile_tiff").option("path", p).option("level", 0).option("patch_size", 256).load()`` gives the
whole tiles of a level: tile_id, col, row, x, y, height, width, channels, rgb.

Uncompressed, deflated, LZW and packed-bits data are read, with or without horizontal differences. Other compressions are
plug-ins: ``CODECS[7] = decode`` with a function of the raw bytes and the page that gives pixels [rows, columns, channels]; on a
cluster, in a module that the option ``codecs`` names, which every task imports.
"""

from __future__ import annotations

import importlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 12: "d", 13: "I", 16: "Q", 18: "Q"}
#: Decoders of further compressions, by number.
CODECS: dict[int, Callable[[bytes, Page], np.ndarray]] = {}


@dataclass
class Page:
    index: int
    tags: dict[int, tuple]
    order: str = "<"

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.one(257), self.one(256), self.one(277, 1)

    @property
    def mpp(self) -> float | None:
        if 282 not in self.tags or 296 not in self.tags:
            return None
        numerator, denominator = self.tags[282][:2]
        r = numerator / denominator
        return {2: 25400.0, 3: 10000.0}.get(self.one(296), 1.0) / r


def pages(data) -> list[Page]:
    """The pages of a TIFF, from an open binary file."""
    data.seek(0)
    order = {b"II": "<", b"MM": ">"}.get(data.read(2))
    kind = struct.unpack(order + "H", data.read(2))[0] if order else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF")
    # counts of entries, counts of values, and offsets are longer in big files
    entries_code, long_code, entry_size = ("H", "I", 12) if kind == 42 else ("Q", "Q", 20)
    word = struct.calcsize(order + long_code)
    one = lambda code: struct.unpack(order + code, data.read(struct.calcsize(order + code)))[0]
    if kind == 43:
        data.read(4)  # the size of offsets, 8
    at = one(long_code)
    out: list[Page] = []
    while at:
        data.seek(at)
        entries = [data.read(entry_size) for _ in range(one(entries_code))]
        at = one(long_code)
        tags = {}
        for e in entries:
            tag, number, count = struct.unpack(order + "HH" + long_code, e[: 4 + word])
            if number not in TYPES:
                continue
            code = f"{count}s" if number == 2 else TYPES[number] * count
            size = struct.calcsize(order + code)
            raw = e[4 + word : 4 + word + size]
            if size > word:
                data.seek(struct.unpack(order + long_code, e[4 + word :])[0])
                raw = data.read(size)
            tags[tag] = struct.unpack(order + code, raw)
        out.append(Page(len(out), tags, order))
    return out


def unpacked_lzw(raw: bytes) -> bytes:
    """Variable-width codes, most significant bit first; a width grows one code early."""
    table: list[bytes] = []
    out, before, width, held, bits = bytearray(), b"", 9, 0, 0
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        while bits >= width:
            code = held >> (bits - width) & ((1 << width) - 1)
            bits -= width
            if code == 256:
                table, before, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
                continue
            if code == 257:
                return bytes(out)
            piece = table[code] if code < len(table) else before + before[:1]
            out += piece
            if before:
                table.append(before + piece[:1])
                width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
            before = piece
    return bytes(out)


def unpacked_bits(raw: bytes) -> bytes:
    """Runs: n below 128 before n + 1 bytes as they are, above before one byte that stands 257 - n times."""
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += raw[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


UNPACK = {1: bytes, 5: unpacked_lzw, 8: zlib.decompress, 32773: unpacked_bits, 32946: zlib.decompress}


def decoded(raw: bytes, page: Page, rows: int, columns: int) -> np.ndarray:
    """Pixels [rows, columns, channels] of a strip or tile."""
    compression, channels = page.one(259, 1), page.shape[2]
    if compression in CODECS:
        return CODECS[compression](raw, page)[:rows]
    if compression not in UNPACK:
        raise ValueError(f"compression {compression} needs a codec that is not installed")
    kind = np.dtype({(1, 8): "u1", (1, 16): "u2", (3, 32): "f4"}[page.one(339, 1), page.one(258, 8)]).newbyteorder(page.order)
    block = np.frombuffer(UNPACK[compression](raw), kind, rows * columns * channels).reshape(rows, columns, channels)
    if page.one(317, 1) == 2:
        block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
    return block


def strip_rows(data, page: Page, start: int, stop: int) -> np.ndarray:
    """Rows start .. stop of a page as uint8 RGB, decoding only the strips or tiles they lie in."""
    height, width, _ = page.shape
    tiled = 322 in page.tags
    per, wide = (page.one(323), page.one(322)) if tiled else (min(page.one(278, height), height), width)
    across = -(-width // wide)
    offsets, sizes = (page.tags[324], page.tags[325]) if tiled else (page.tags[273], page.tags[279])
    parts = []
    for band in range(start // per, -(-stop // per)):
        row = []
        for k in range(band * across, (band + 1) * across):
            data.seek(offsets[k])
            row.append(decoded(data.read(sizes[k]), page, per if tiled else min(per, height - band * per), wide))
        parts.append(np.concatenate(row, axis=1)[:, :width] if across > 1 else row[0][:, :width])
    block = np.concatenate(parts)[start - start // per * per :][: stop - start]
    return normalised(block)


def normalised(region: np.ndarray) -> np.ndarray:
    """Pixels as uint8 RGB: floats from 0 .. 1, 16 bits, grey and alpha are converted."""
    if region.dtype.kind == "f":
        region = np.clip(region * 255, 0, 255).astype(np.uint8)
    elif region.dtype == np.uint16:
        region = (region // 256).astype(np.uint8)
    if region.ndim == 2:
        region = region[:, :, None]
    if region.shape[2] == 1:
        region = np.repeat(region, 3, axis=2)
    return region[:, :, :3]


@dataclass
class Strip(InputPartition):
    row: int


class TiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.codecs = options.get("codecs", "")
        self.path, self.level, self.size = options["path"], int(options.get("level", 0)), int(options.get("patch_size", 256))

    def partitions(self) -> list[Strip]:
        with open(self.path, "rb") as f:
            return [Strip(r) for r in range(pages(f)[self.level].shape[0] // self.size)]

    def read(self, partition: Strip) -> Iterator[tuple]:
        if self.codecs:
            importlib.import_module(self.codecs)
        size, row = self.size, partition.row
        with open(self.path, "rb") as f:
            page = pages(f)[self.level]
            strip = strip_rows(f, page, row * size, (row + 1) * size)
        cols = page.shape[1] // size
        for col in range(cols):
            tile = np.ascontiguousarray(strip[:, col * size : (col + 1) * size])
            yield row * cols + col, col, row, col * size, row * size, size, size, 3, tile.tobytes()


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tile_tiff"

    def schema(self) -> str:
        return "tile_id long, col int, row int, x int, y int, height int, width int, channels int, rgb binary"

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TiffSource)


def write_tiff(path: str, levels: list[np.ndarray], mpp: float = 0.5, rows_per_strip: int = 64, deflate: bool = True) -> None:
    """A classic little-endian RGB TIFF with one page a level."""
    with open(path, "wb") as f:
        f.write(b"II" + struct.pack("<HI", 42, 0))
        link = 4
        for image in levels:
            height, width, _ = image.shape
            offsets, counts = [], []
            for at in range(0, height, rows_per_strip):
                raw = np.ascontiguousarray(image[at : at + rows_per_strip]).tobytes()
                raw = zlib.compress(raw) if deflate else raw
                offsets.append(f.tell())
                counts.append(len(raw))
                f.write(raw)
            lists = {}
            for tag, code, values in ((258, "H", (8, 8, 8)), (273, "I", offsets), (279, "I", counts), (282, "I", (round(10000 / mpp * 1000), 1000))):
                lists[tag] = f.tell()
                f.write(struct.pack(f"<{len(values)}{code}", *values))
            entry = lambda tag, kind, count, value: struct.pack("<HHII", tag, kind, count, value)
            n = len(offsets)
            one = lambda values, tag: values[0] if n == 1 else lists[tag]
            entries = [entry(256, 4, 1, width), entry(257, 4, 1, height), entry(258, 3, 3, lists[258]), entry(259, 3, 1, 8 if deflate else 1), entry(262, 3, 1, 2), entry(273, 4, n, one(offsets, 273)), entry(277, 3, 1, 3), entry(278, 4, 1, rows_per_strip), entry(279, 4, n, one(counts, 279)), entry(282, 5, 1, lists[282]), entry(296, 3, 1, 3)]
            here = f.tell()
            f.write(struct.pack("<H", len(entries)) + b"".join(entries) + struct.pack("<I", 0))
            f.seek(link)
            f.write(struct.pack("<I", here))
            f.seek(0, 2)
            link = here + 2 + 12 * len(entries)
