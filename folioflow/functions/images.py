"""Page images as PNG bytes: reading, writing, shrinking, and the brightness of their rows. 8-bit gray or
colour images without interlacing; anything else raises ValueError."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the file format: its first bytes, and samples a pixel by colour type.
HEADER = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
INCH = 0.0254


def is_png(data: bytes) -> bool:
    return data.startswith(HEADER)


def size(data: bytes) -> tuple[int, int]:
    """Width and height, from the header alone."""
    if not is_png(data) or len(data) < 24:
        raise ValueError("no PNG image")
    return struct.unpack(">II", data[16:24])


def _chunks(data: bytes):
    at = len(HEADER)
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        yield kind, data[at + 8 : at + 8 + n]
        at += n + 12


def decode(data: bytes) -> tuple[np.ndarray, float | None]:
    """(rows x columns x samples, dots an inch or None)."""
    width, height = size(data)
    packed, dpi, samples = [], None, None
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            depth, colour, _, _, interlaced = body[8:13]
            if depth != 8 or colour not in SAMPLES or interlaced:
                raise ValueError("this kind of PNG isn't read")
            samples = SAMPLES[colour]
        elif kind == b"pHYs" and body[8] == 1:
            dpi = struct.unpack(">I", body[4:8])[0] * INCH
        elif kind == b"IDAT":
            packed.append(body)
    wide = width * samples
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)[: height * (wide + 1)].reshape(height, wide + 1)
    out = np.zeros((height + 1, wide), np.uint8)
    for y in range(height):
        out[y + 1] = _unfiltered(int(lines[y, 0]), lines[y, 1:], out[y], samples)
    return out[1:].reshape(height, width, samples), dpi


def _unfiltered(how: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if how == 0:
        return line
    if how == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    if how == 2:
        return line + above
    out, up = bytearray(line.tobytes()), above.tobytes()
    for i in range(len(out)):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if how == 3:
            guess = (left + up[i]) // 2
        else:
            # The neighbour nearest to left + above - corner; left, then above where they are equally near.
            far = (abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner))
            guess = (left, up[i], corner)[far.index(min(far))]
        out[i] = (out[i] + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def encode(pixels: np.ndarray, dpi: float | None = None) -> bytes:
    height, width, samples = pixels.shape
    colour = next(k for k, v in SAMPLES.items() if v == samples)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0))]
    if dpi:
        parts.append((b"pHYs", struct.pack(">IIB", round(dpi / INCH), round(dpi / INCH), 1)))
    parts += [(b"IDAT", zlib.compress(lines.tobytes(), 6)), (b"IEND", b"")]
    return HEADER + b"".join(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)) for kind, body in parts)


def _averaged(values: np.ndarray, n: int) -> np.ndarray:
    """The first axis shortened to n, each place the mean of those it stands for."""
    edges = np.arange(n) * len(values) // n
    counts = np.diff(np.append(edges, len(values)))
    return np.add.reduceat(values.astype(np.float64), edges, axis=0) / counts.reshape(-1, *[1] * (values.ndim - 1))


def fitted_size(width: int, height: int, most: int) -> tuple[int, int]:
    """Both sides times the same scale, cut to whole pixels, so that none exceeds ``most``; never larger."""
    scale = min(1.0, most / max(width, height))
    return max(1, int(width * scale)), max(1, int(height * scale))


def fit(data: bytes, most: int) -> bytes:
    """The image shrunk to at most ``most`` pixels a side; small ones, and what is no PNG, as they are."""
    if most <= 0 or not is_png(data):
        return data
    width, height = size(data)
    w, h = fitted_size(width, height, most)
    if (w, h) == (width, height):
        return data
    pixels, dpi = decode(data)
    small = _averaged(_averaged(pixels, h).swapaxes(0, 1), w).swapaxes(0, 1)
    return encode(np.rint(small).astype(np.uint8), dpi and dpi * w / width)


def profile(data: bytes, dpi: float, rows_an_inch: int = 72) -> tuple[float, float, list[float]]:
    """(width, height, brightness): the size in points, and the mean brightness of rows of one point each.
    ``dpi`` holds where the image names none."""
    pixels, own = decode(data)
    dots = own or dpi
    gray = pixels[:, :, : 1 if pixels.shape[2] < 3 else 3].mean(axis=(1, 2))
    height, width = pixels.shape[0] * 72 / dots, pixels.shape[1] * 72 / dots
    n = min(len(gray), max(1, round(pixels.shape[0] * rows_an_inch / dots)))
    return width, height, _averaged(gray, n).tolist()


def crop(data: bytes, top: float, bottom: float, dpi: float) -> bytes:
    """The part between two heights in points above the image's lower edge."""
    pixels, own = decode(data)
    scale, height = (own or dpi) / 72, pixels.shape[0]
    first, last = max(0, round(height - top * scale)), min(height, round(height - bottom * scale))
    if first >= last:
        raise ValueError("an empty part")
    return encode(pixels[first:last], own or dpi)
