"""Slide readers: layouts and compressions of TIFF, and the slide library by a stand-in."""

import io
import struct
import sys
import types
import zlib

import numpy as np
import pytest

from tilescape.sources import slide_library, tiff


def lzw(raw):
    """Codes of 9 bits, the table cleared before it grows."""
    bits = []
    for i in range(0, len(raw), 250):
        bits += [256, *raw[i : i + 250]]
    text = "".join(f"{c:09b}" for c in [*bits, 257])
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def packed(raw):
    return b"".join(bytes([len(raw[i : i + 100]) - 1]) + raw[i : i + 100] for i in range(0, len(raw), 100)) + bytes([256 - 2, 7, 128])


def written(image, *, big=False, order="<", tile=None, compression=1, predictor=1):
    """A one-page TIFF of uint8, uint16 or float pixels."""
    pack = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packed}[compression]
    height, width, channels = image.shape
    rows, cols = tile or (16, width)
    parts = []
    for y in range(0, height, rows):
        for x in range(0, width, cols):
            block = image[y : y + rows, x : x + cols]
            if tile:
                full = np.zeros((rows, cols, channels), image.dtype)
                full[: block.shape[0], : block.shape[1]] = block
                block = full
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1).astype(image.dtype)
            parts.append(pack(np.ascontiguousarray(block).astype(image.dtype.newbyteorder(order)).tobytes()))
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    layout = [(322, cols), (323, rows)] if tile else [(278, rows)]
    places = (324, 325) if tile else (273, 279)
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [image.dtype.itemsize * 8] * channels), (259, 3, [compression]), (277, 3, [channels]), (317, 3, [predictor]), (339, 3, [3 if image.dtype.kind == "f" else 1] * channels), *[(t, 4, [v]) for t, v in layout], (places[0], 16 if big else 4, parts), (places[1], 4, [len(p) for p in parts])]
    tags.sort()
    word, entry = (8, 20) if big else (4, 12)
    at = len(head) + (8 if big else 2) + entry * len(tags) + word
    extra, entries, fix = b"", b"", []
    for tag, kind, values in tags:
        code = {3: "H", 4: "I", 16: "Q"}[kind]
        size = struct.calcsize(order + code) * len(values)
        if values is parts:
            values = [0] * len(parts)
            fix.append((at + len(extra) if size > word else None, code))
            if size <= word:
                fix[-1] = (len(head) + (8 if big else 2) + entry * (len(entries) // entry) + 4 + word, code)
        body = struct.pack(order + code * len(values), *values)
        entries += struct.pack(order + "HH" + ("Q" if big else "I"), tag, kind, len(values))
        if size > word:
            entries += struct.pack(order + ("Q" if big else "I"), at + len(extra))
            extra += body
        else:
            entries += body.ljust(word, b"\0")
    out = bytearray(head + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + bytes(word) + extra)
    offsets = []
    for p in parts:
        offsets.append(len(out))
        out += p
    where, code = fix[0]
    out[where : where + struct.calcsize(order + code) * len(parts)] = struct.pack(order + code * len(parts), *offsets)
    return io.BytesIO(bytes(out))


RGB = np.random.default_rng(0).integers(0, 256, (50, 70, 3), dtype=np.uint8)


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize("layout", [{}, {"tile": (16, 32)}, {"big": True}, {"big": True, "tile": (32, 16)}, {"order": ">"}])
def test_layouts_and_compressions(compression, layout):
    for predictor in (1, 2):
        data = written(RGB, compression=compression, predictor=predictor, **layout)
        (page,) = tiff.pages(data)
        assert page.shape == RGB.shape
        for start, stop in ((0, 50), (3, 4), (15, 33), (49, 50)):
            assert (tiff.strip_rows(data, page, start, stop) == RGB[start:stop]).all()


def test_sixteen_bits_floats_and_grey():
    wide = RGB.astype(np.uint16) * 257
    for order in "<>":
        data = written(wide, order=order, compression=8, predictor=2)
        assert (tiff.strip_rows(data, tiff.pages(data)[0], 5, 20) == RGB[5:20]).all()
    data = written((RGB / 255).astype(np.float32))
    assert np.abs(tiff.strip_rows(data, tiff.pages(data)[0], 0, 9).astype(int) - RGB[:9]).max() <= 1
    data = written(RGB[:, :, :1])
    assert (tiff.strip_rows(data, tiff.pages(data)[0], 0, 9) == RGB[:9, :, :1]).all()


def test_other_compressions_are_plug_ins(monkeypatch):
    data = written(RGB, tile=(16, 32))
    (page,) = tiff.pages(data)
    page.tags[259] = (7,)
    with pytest.raises(ValueError, match="compression 7"):
        tiff.strip_rows(data, page, 0, 4)
    monkeypatch.setitem(tiff.CODECS, 7, lambda raw, p: 255 - np.frombuffer(raw, np.uint8).reshape(p.one(323), p.one(322), 3))
    assert (tiff.strip_rows(data, page, 0, 20) == 255 - RGB[:20]).all()


def test_not_a_tiff():
    with pytest.raises(ValueError, match="not a TIFF"):
        tiff.pages(io.BytesIO(b"PNG and more"))


def test_slide_library(monkeypatch):
    class OpenSlide:
        level_dimensions, level_downsamples, properties = ((128, 64), (64, 32)), (1.0, 2.0), {"openslide.mpp-x": "0.25"}

        def __init__(self, path):
            self.path = path

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return None

        def read_region(self, place, level, size):
            out = np.zeros((size[1], size[0], 4), np.uint8)
            out[:, :, 0], out[:, :, 1], out[:, :, 2] = place[0], place[1], level
            return out

    with pytest.raises(ImportError, match="not installed"):
        slide_library.levels("a.ndpi")
    monkeypatch.setitem(sys.modules, "openslide", types.SimpleNamespace(OpenSlide=OpenSlide))
    assert slide_library.levels("a.ndpi") == ((0, 128, 64, 1.0), (1, 64, 32, 2.0)) and slide_library.mpp("a.ndpi") == 0.25
    reader = slide_library.SlideReader({"path": "a.ndpi", "level": "1", "patch_size": "16"})
    strips = reader.partitions()
    assert len(strips) == 2
    tiles = list(reader.read(strips[1]))
    assert [t[:5] for t in tiles] == [(4 + c, c, 1, 16 * c, 16) for c in range(4)]
    assert tuple(np.frombuffer(tiles[3][8], np.uint8)[:3]) == (96, 32, 1)
