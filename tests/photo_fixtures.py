"""Photos made by rule, each with one defect."""

from __future__ import annotations

import numpy as np


def good(size: int = 800, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:size, 0:size]
    middle = size / 2
    base = 150 + 18 * np.sin(x / 90) + 12 * np.cos(y / 70) + rng.normal(0, 9, (size, size))
    base = base - 70 * np.exp(-((x - middle) ** 2 + (y - middle) ** 2) / (2 * (0.09 * size) ** 2)) + rng.normal(0, 6, (size, size))
    return np.clip(np.stack([base * 0.93, base, base * 1.10], axis=2), 0, 255).astype(np.uint8)


def blurred(img: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(4 * sigma)
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma**2))
    kernel /= kernel.sum()
    out = np.pad(img.astype(np.float64), ((reach, reach), (reach, reach), (0, 0)), mode="reflect")
    for axis in (0, 1):
        out = np.apply_along_axis(lambda v: np.convolve(v, kernel, mode="valid"), axis, out)
    return np.clip(out, 0, 255).astype(np.uint8)


def scaled(img: np.ndarray, by) -> np.ndarray:
    return np.clip(img.astype(np.float64) * np.asarray(by), 0, 255).astype(np.uint8)


def flash(img: np.ndarray) -> np.ndarray:
    out = img.copy()
    y, x = np.mgrid[0 : img.shape[0], 0 : img.shape[1]]
    out[(x - 400) ** 2 + (y - 400) ** 2 <= 130**2] = 255
    return out


def defects() -> dict[str, np.ndarray]:
    base = good()
    return {
        "good": base,
        "blurred": blurred(base, 9),
        "dark": scaled(base, 0.16),
        "burnt": scaled(base, 2.6),
        "flash": flash(base),
        "flat": np.full((800, 800, 3), 128, dtype=np.uint8),
        "small": base[::4, ::4][:180, :180].copy(),
        "tinted": scaled(base, [2.1, 1, 1]),
    }


def rows(photos: dict[str, np.ndarray]) -> list[tuple]:
    return [(name, img.shape[0], img.shape[1], 3, 16, bytearray(img.tobytes())) for name, img in photos.items()]
