"""Images of raster payloads, as numpy arrays, and their PNG form."""

from __future__ import annotations

import base64
import struct
import zlib
from dataclasses import dataclass

import numpy as np

from glyphlake.functions.fax import FaxError, decode_t4, decode_t6

GREY_PALETTE = bytes(v for i in range(256) for v in (i, i, i))
_PNG_COLOR = {"L": 0, "RGB": 2, "P": 3, "RGBA": 6}


@dataclass
class Image:
    """mode P (with a palette of 768 bytes), L, RGB or RGBA; pixels by rows."""

    mode: str
    pixels: np.ndarray
    palette: bytes | None = None

    @property
    def size(self) -> tuple[int, int]:
        return self.pixels.shape[1], self.pixels.shape[0]

    def crop(self, width: int, height: int) -> Image:
        return Image(self.mode, self.pixels[:height, :width], self.palette)


def png(image: Image) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    width, height = image.size
    rows = np.ascontiguousarray(image.pixels).reshape(height, -1)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1).tobytes()
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, _PNG_COLOR[image.mode], 0, 0, 0))]
    if image.mode == "P":
        parts.append(chunk(b"PLTE", image.palette or GREY_PALETTE))
    return b"\x89PNG\r\n\x1a\n" + b"".join([*parts, chunk(b"IDAT", zlib.compress(lines, 6)), chunk(b"IEND", b"")])


def data_uri(image: Image) -> str:
    return "data:image/png;base64," + base64.b64encode(png(image)).decode()


def _from_bytes(mode: str, payload: bytes, width: int, height: int, palette: bytes | None = None) -> Image:
    channels = {"P": 1, "L": 1, "RGB": 3, "RGBA": 4}[mode]
    flat = np.frombuffer(payload, np.uint8, width * height * channels)
    return Image(mode, flat.reshape((height, width) if channels == 1 else (height, width, channels)), palette)


def _indexed(payload: bytes, width: int, height: int, palette: bytes | None) -> Image:
    return _from_bytes("P", payload, width, height, palette if palette and len(palette) >= 768 else GREY_PALETTE)


def _black_on_white(bits: np.ndarray) -> Image:
    return Image("L", np.where(bits > 0, 0, 255).astype(np.uint8))


def scale16(payload: bytes, pixels: int, extent: list[int] | None) -> bytes | None:
    """Channels of 16 bits scaled from the extent to 8; null if the payload is too short."""
    if len(payload) < pixels * 6:
        return None
    values = np.frombuffer(payload, ">u2", pixels * 3).reshape(-1, 3).astype(np.int64)
    low, high = (np.array(x, np.int64) for x in ((extent[:3], extent[3:]) if extent else ([0] * 3, [65535] * 3)))
    span = high - low
    scaled = np.rint((np.clip(values, low, np.maximum(low, high)) - low) / np.maximum(span, 1) * 255.0)
    out = np.where(span > 0, scaled, np.where(values > high, 255, 0))
    return np.clip(out, 0, 255).astype(np.uint8).tobytes()


def _grey(payload: bytes, width: int, height: int) -> Image:
    """One byte a pixel; samples that are all 0 or 1 are bits, of which 1 is black."""
    image = _from_bytes("L", payload, width, height)
    return _black_on_white(image.pixels) if image.pixels.max(initial=0) <= 1 else image


def unpack(payload: bytes, width: int, height: int, reverse: bool = False) -> np.ndarray | None:
    """Bits of rows that begin at bytes; null if the payload is too short."""
    stride = (width + 7) // 8
    if len(payload) < stride * height:
        return None
    rows = np.frombuffer(payload, np.uint8, stride * height).reshape(height, stride)
    return np.unpackbits(rows, axis=1, bitorder="little" if reverse else "big")[:, :width]


def cell_image(payload: bytes, width: int | None, height: int | None, precision: int | None, mode: int | None, palette: bytes | None, extent: list[int] | None) -> Image | None:
    """The image of a cell array: by its precision where the payload is long enough, else by the payload's length."""
    if not width or not height or width < 0 or height < 0:
        return None
    n, total = len(payload), width * height
    if precision is not None and precision <= 8 and n >= total and mode in (None, 0, 1):
        return _indexed(payload, width, height, palette)
    if precision == 16 and (rgb := scale16(payload, total, extent)) is not None:
        return _from_bytes("RGB", rgb, width, height)
    if precision == 24 and n >= total * 3:
        return _from_bytes("RGB", payload, width, height)
    if n >= total * 4:
        return _from_bytes("RGBA", payload, width, height)
    if n >= total * 3:
        return _from_bytes("RGB", payload, width, height)
    if n >= total:
        return _grey(payload, width, height)
    bits = unpack(payload, width, height)
    return None if bits is None else _black_on_white(bits)


def _fax4(payload: bytes, width: int, height: int, widths: list[int]) -> np.ndarray | None:
    """The bitmap of the trial width that looks best: few nearly black rows, little black at the right edge, few white rows at the end."""
    found = []
    for w in dict.fromkeys(widths):
        try:
            bits = decode_t6(payload, w, height)[:, :width]
        except FaxError:
            continue
        if bits.shape[1] < width:
            continue
        blank = np.flatnonzero(bits.any(1))
        trailing = height - 1 - int(blank[-1]) if len(blank) else height
        found.append((w, bits, int((bits.mean(1) > 0.95).sum()), float(bits[:, -1].mean()), trailing))
    if not found:
        return None
    nominal = next((x[4] for x in found if x[0] == widths[0]), next((x[4] for x in found if x[0] == width), height))
    usable = [x for x in found if x[4] <= nominal + max(1, height // 10)] or [x for x in found if x[0] in (widths[0], width)]
    return min(usable, key=lambda x: (x[2], x[3], x[4]))[1]


def bitonal(payload: bytes, width: int, height: int, compression: int | None, bit_order: int | None, row_padding: int | None) -> Image | None:
    """0: packed bits, 1: T.4, 2: T.6; other codes give none."""
    bits = None
    if compression == 0:
        bits = unpack(payload, width, height, bit_order == 1)
    elif compression == 1:
        try:
            bits = decode_t4(payload, width, height)
        except FaxError:
            return None
    elif compression == 2:
        bits = _fax4(payload, width, height, widths(width, row_padding))
    return None if bits is None else _black_on_white(bits)


def widths(width: int, row_padding: int | None) -> list[int]:
    if row_padding and row_padding > 8:
        return [width] if width % row_padding == 0 else [width + row_padding // 2]
    return [width + row_padding, width] if row_padding and row_padding > 0 else [width]


def tile_image(payload: bytes, width: int, height: int, compression: int | None, bit_order: int | None, row_padding: int | None, family: str | None, precision: int | None, mode: int | None, palette: bytes | None, extent: list[int] | None) -> Image | None:
    """The image of a tile: colours by precision, then bits by compression, then by the payload's length."""
    if width <= 0 or height <= 0:
        return None
    n, total = len(payload), width * height
    if family == "indexed" and n >= total:
        return _indexed(payload, width, height, palette)
    if precision == 32 and n >= total * 4:
        return _from_bytes("RGBA", payload, width, height)
    if precision == 16 and (rgb := scale16(payload, total, extent)) is not None:
        return _from_bytes("RGB", rgb, width, height)
    if precision == 24 and n >= total * 3:
        return _from_bytes("RGB", payload, width, height)
    if precision is not None and precision <= 8 and n >= total and family is None and mode in (None, 0, 1):
        return _indexed(payload, width, height, palette)
    if (image := bitonal(payload, width, height, compression, bit_order, row_padding)) is not None:
        return image
    if n >= total * 4:
        return _from_bytes("RGBA", payload, width, height)
    if n >= total * 3:
        return _from_bytes("RGB", payload, width, height)
    if n >= total * 2:
        return _from_bytes("L", payload[: total * 2 : 2], width, height)
    return _grey(payload, width, height) if n >= total else None


# Raster elements by their first four numbers, and the (compression, bit order) to try in turn.
RASTER_MODELS = {
    (2, 0, 1, 0): ((2, 1), (2, 0), (1, 0), (1, 1)),
    (6, 0, 8, 6): ((0, 0), (0, 1)),
    (7, 0, 8, 6): ((1, 0), (1, 1), (2, 1), (2, 0), (0, 0), (0, 1)),
}


def raster_image(payload: bytes, width: int, height: int, compression: int, row_padding: int, bit_order: int, orientation: int) -> Image | None:
    """The first trial of the model that its prefix names; none for others."""
    for c, order in RASTER_MODELS.get((compression, row_padding, bit_order, orientation), ()):
        image = tile_image(payload, width, height, c, order, row_padding, None, None, None, None, None)
        if image is not None:
            return image
    return None
