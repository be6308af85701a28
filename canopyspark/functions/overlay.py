"""Pictures of regions, for looking at: outlines and shaded shrunk rings on a BGR picture, and a PNG writer."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .geometry import fill, shrink

#: The colour of each kind of region.
COLOURS = {
    "individual tree": "FF34FF",
    "group of trees": "1CE6FF",
    "grassland": "008941",
    "cropland": "F7E24F",
    "shrubs": "72FF00",
    "other": "FF4A46",
}


def border(ring: list, height: int, width: int, thickness: int = 6) -> np.ndarray:
    """Flat indices of the pixels within ``thickness`` of a ring's sides."""
    points = np.asarray(ring, float)
    mask = np.zeros((height, width), bool)
    for (x0, y0), (x1, y1) in zip(points, np.roll(points, -1, 0), strict=True):
        n = int(max(abs(x1 - x0), abs(y1 - y0))) * 2 + 1
        for x, y in zip(np.linspace(x0, x1, n).astype(int), np.linspace(y0, y1, n).astype(int), strict=True):
            mask[max(0, y - thickness // 2) : max(0, y + thickness // 2 + 1), max(0, x - thickness // 2) : max(0, x + thickness // 2 + 1)] = True
    return np.flatnonzero(mask)


def draw(picture: np.ndarray, regions: list[tuple[str, list]], percent: float = 100 / 3, alpha: float = 0.5) -> np.ndarray:
    """Outlines each region and shades it where it is shrunk to a third of its area, kind by kind in their order, so that later
    ones lie on top. Regions of kinds without a colour are left out."""
    height, width, _ = picture.shape
    flat = picture.reshape(-1, 3)
    for kind, ring in sorted((r for r in regions if r[0] in COLOURS), key=lambda r: r[0]):
        colour = np.array([*bytes.fromhex(COLOURS[kind])][::-1])
        if (inner := shrink(ring, percent)) is not None:
            at = fill(inner, height, width)
            flat[at] = (alpha * colour + (1 - alpha) * flat[at]).astype(np.uint8)
        flat[border(ring, height, width)] = colour
    return picture


def png(picture: np.ndarray) -> bytes:
    """A BGR picture as a PNG file."""
    height, width, _ = picture.shape
    rows = np.hstack([np.zeros((height, 1), np.uint8), picture[:, :, ::-1].reshape(height, -1)])

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")
