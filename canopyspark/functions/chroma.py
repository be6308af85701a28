"""Colour ratios of regions of pictures."""

from __future__ import annotations

import numpy as np


def region_ratios(pixels: np.ndarray, masks: list[np.ndarray]) -> np.ndarray:
    """gcc, rcc, bcc and brightness of each mask of an (H, W, 3) BGR picture: ratios of sums, exact in integers."""
    flat = pixels.reshape(-1, 3)
    if not masks:
        return np.empty((0, 4))
    if any(len(m) and (m.min() < 0 or m.max() >= len(flat)) for m in masks):
        raise ValueError("a mask reaches outside the picture")
    starts = np.cumsum([0, *(len(m) for m in masks)])[:-1]
    sums = np.add.reduceat(flat[np.concatenate(masks)].astype(np.int64), starts, axis=0)
    count = np.array([len(m) for m in masks], float)
    blue, green, red = (sums / count[:, None]).T
    brightness = blue + green + red
    brightness = np.where(brightness == 0, 1e-6, brightness)
    return np.stack([green / brightness, red / brightness, blue / brightness, brightness], axis=1)
