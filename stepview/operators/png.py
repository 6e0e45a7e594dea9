"""PNG files to pixels and back, after the PNG specification, as arrays."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Fixed values of the specification: samples per pixel by colour type (3 is a palette), the colour types that have
# alpha, and the passes of interlaced images as (first column, first row, column step, row step).
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
WITH_ALPHA = (4, 6)
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Pixels of an image that is still decoded.
MOST_PIXELS = 1 << 28


class Broken(ValueError):
    """The file is a PNG file by its first bytes, but cannot be decoded."""


def _chunks(content: bytes):
    at = len(SIGNATURE)
    while at + 12 <= len(content):
        (length,) = struct.unpack_from(">I", content, at)
        kind, data = content[at + 4 : at + 8], content[at + 8 : at + 8 + length]
        end = at + 12 + length
        if end > len(content):
            raise Broken("the file ends within a chunk")
        if zlib.crc32(kind + data) != struct.unpack_from(">I", content, end - 4)[0]:
            raise Broken(f"checksum of {kind!r}")
        yield kind, data
        if kind == b"IEND":
            return
        at = end
    raise Broken("the file ends without IEND")


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Bytes of all lines (each with its filter in front); ``step`` is the distance of bytes of neighbouring pixels."""
    kinds, coded = lines[:, 0], lines[:, 1:]
    if kinds.max(initial=0) > 4:
        raise Broken("unknown filter")
    height, width = coded.shape
    pixels = -(-width // step)
    padded = np.zeros((height, pixels * step), np.uint8)
    padded[:, :width] = coded
    padded = padded.reshape(height, pixels, step)
    if kinds.max(initial=0) <= 2:
        out = np.where((kinds == 1)[:, None, None], np.cumsum(padded, axis=1, dtype=np.uint8), padded)
        for y in np.flatnonzero(kinds == 2).tolist():
            if y:
                out[y] += out[y - 1]
        return out.reshape(height, -1)[:, :width]
    # A byte needs those to the left, above, and both: all bytes of a diagonal are made at once.
    out = np.zeros((height + 1, pixels + 1, step), np.int16)
    for d in range(height + pixels - 1):
        y = np.arange(max(0, d - pixels + 1), min(height, d + 1))
        x = d - y
        kind = kinds[y][:, None]
        left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        to_left, to_above, to_corner = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        nearest = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) >> 1, nearest], 0)
        out[y + 1, x + 1] = (padded[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(height, -1)[:, :width]


def _samples(lines: np.ndarray, width: int, depth: int, samples: int) -> np.ndarray:
    """Samples (height, width, samples) as they are numbered in the file; of 16 bits the upper 8."""
    if depth == 16:
        lines = lines[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(len(lines), width, depth)
        return (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2, dtype=np.uint8)[:, :, None]
    return lines.reshape(len(lines), width, samples)


def is_png(content: bytes) -> bool:
    return content.startswith(SIGNATURE)


def decode(content: bytes) -> tuple[np.ndarray, bool]:
    """Pixels (height, width, channels) in gray, gray+alpha, RGB or RGBA order, and whether they were stored with alpha.

    A palette becomes colours; a transparent colour or palette entry becomes an alpha channel, but such an image was
    not stored with one. Raises ``Broken``."""
    header, palette, transparent, parts = None, None, None, []
    for kind, data in _chunks(content):
        if kind == b"IHDR":
            if len(data) != 13:
                raise Broken("size of IHDR")
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data[: len(data) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            transparent = data
        elif kind == b"IDAT":
            parts.append(data)
    if header is None:
        raise Broken("no IHDR")
    width, height, depth, colour, *_, interlaced = header
    if colour not in SAMPLES or depth not in DEPTHS[colour] or not width or not height or width * height > MOST_PIXELS or interlaced > 1:
        raise Broken("IHDR")
    if colour == 3 and palette is None:
        raise Broken("no palette")
    samples = SAMPLES[colour]
    passes = [p for p in PASSES if p[0] < width and p[1] < height] if interlaced else [(0, 0, 1, 1)]
    sizes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in passes]
    lengths = [1 + -(-w * samples * depth // 8) for w, _ in sizes]
    need = sum(h * n for (_, h), n in zip(sizes, lengths, strict=True))
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(b"".join(parts), need)
    except zlib.error as err:
        raise Broken(str(err)) from err
    if len(raw) < need:
        raise Broken("too few pixels")
    pixels = np.zeros((height, width, samples), np.uint8)
    at = 0
    for (x, y, dx, dy), (w, h), length in zip(passes, sizes, lengths, strict=True):
        lines = np.frombuffer(raw, np.uint8, h * length, at).reshape(h, length)
        pixels[y::dy, x::dx] = _samples(_unfiltered(lines, max(1, samples * depth // 8)), w, depth, samples)
        at += h * length
    return _coloured(pixels, colour, depth, palette, transparent), colour in WITH_ALPHA


def _coloured(pixels: np.ndarray, colour: int, depth: int, palette: np.ndarray | None, transparent: bytes | None) -> np.ndarray:
    if colour == 3:
        if pixels.max() >= len(palette):
            raise Broken("palette")
        alpha = np.full(len(palette), 255, np.uint8)
        some = np.frombuffer(transparent or b"", np.uint8)[: len(palette)]
        alpha[: len(some)] = some
        at = pixels[:, :, 0]
        return palette[at] if transparent is None else np.dstack([palette[at], alpha[at]])
    clear = None
    if transparent is not None and colour in (0, 2) and len(transparent) == 2 * pixels.shape[2]:
        # Compared by the upper 8 bits where there are 16.
        key = np.array(struct.unpack(f">{pixels.shape[2]}H", transparent)) >> (8 if depth == 16 else 0)
        clear = (pixels == key).all(axis=2)
    if depth < 8:
        pixels = pixels * np.uint8(255 // ((1 << depth) - 1))
    return pixels if clear is None else np.dstack([pixels, np.where(clear, 0, 255).astype(np.uint8)])


def _filtered(body: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Lines (height, width, channels) with each line's filter applied and put in front."""
    wide = body.astype(np.int16)
    left, above, corner = (np.zeros_like(wide) for _ in range(3))
    left[:, 1:], above[1:], corner[1:, 1:] = wide[:, :-1], wide[:-1], wide[:-1, :-1]
    to_left, to_above, to_corner = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
    nearest = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
    kind = kinds[:, None, None]
    guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) >> 1, nearest], 0)
    lines = ((wide - guess) & 255).astype(np.uint8).reshape(len(body), -1)
    return np.concatenate([kinds.astype(np.uint8)[:, None], lines], axis=1)


def encode(pixels: np.ndarray, kinds: np.ndarray | None = None) -> bytes:
    """A PNG file of a (height, width, channels) array in gray, gray+alpha, RGB or RGBA order; ``kinds``: each line's filter."""
    height, width, channels = pixels.shape
    colour = {n: c for c, n in SAMPLES.items() if c != 3}[channels]
    lines = _filtered(pixels, np.zeros(height, np.uint8) if kinds is None else kinds)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")
