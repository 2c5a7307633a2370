"""Image features and perceptual hashes of raw pixel arrays, vectorised over Arrow batches.

Images come as flat arrays of bytes with their width, height and 3 channels; decoding files
is left to the reader of the files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE, CELL, ORIENTATIONS = 64, 8, 9


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resize with pixel centres; an area average where the image shrinks."""
    out = image.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        n = out.shape[axis]
        scale = n / size
        reach = max(scale, 1.0)
        centre = (np.arange(size) + 0.5) * scale
        weight = np.clip(1 - np.abs((np.arange(n) + 0.5)[None] - centre[:, None]) / reach, 0, None)
        weight /= weight.sum(1, keepdims=True)
        out = np.moveaxis(np.tensordot(weight, out, (1, axis)), 0, axis)
    return out


def gradient_histograms(grey: np.ndarray) -> np.ndarray:
    """Histograms of oriented gradients: 8 x 8 cells, 2 x 2 blocks, clipped unit norms."""
    gy, gx = np.zeros_like(grey), np.zeros_like(grey)
    gy[1:-1], gx[:, 1:-1] = grey[2:] - grey[:-2], grey[:, 2:] - grey[:, :-2]
    size = np.hypot(gx, gy)
    angle = np.rad2deg(np.arctan2(gy, gx)) % 180
    bin_ = np.minimum((angle / (180 / ORIENTATIONS)).astype(int), ORIENTATIONS - 1)
    n = grey.shape[0] // CELL
    cell = (np.arange(grey.shape[0]) // CELL)[:, None] * n + (np.arange(grey.shape[1]) // CELL)[None]
    cells = np.bincount((cell * ORIENTATIONS + bin_).ravel(), size.ravel(), n * n * ORIENTATIONS).reshape(n, n, ORIENTATIONS) / CELL**2
    blocks = np.stack([cells[a : n - 1 + a, b : n - 1 + b] for a in (0, 1) for b in (0, 1)], 2).reshape(-1, 4 * ORIENTATIONS)
    for limit in (0.2, None):
        blocks = blocks / np.sqrt((blocks**2).sum(1, keepdims=True) + 1e-10)
        if limit:
            blocks = np.minimum(blocks, limit)
    return blocks.ravel()


def features(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """1,813 numbers: gradient histograms, 16 colour bins of each channel, log ratio of the sides."""
    image = pixels.reshape(height, width, 3)
    small = resize(image, SIDE, SIDE) / 255
    grey = small @ np.array([0.2125, 0.7154, 0.0721])
    colours = [np.histogram(small[:, :, c], 16, (0, 1))[0] / SIDE**2 for c in range(3)]
    return np.concatenate([gradient_histograms(grey), *colours, [np.log(max(width, 1) / max(height, 1))]]).astype(np.float32)


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)[:, None]
    basis = np.cos(np.pi * k * (2 * np.arange(n)[None] + 1) / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis


_DCT = _cosines(32)


def perceptual_hash(pixels: np.ndarray, width: int, height: int) -> int:
    """63 bits of the low frequencies against their median, as a signed 64-bit number."""
    grey = pixels.reshape(height, width, 3) @ np.array([0.299, 0.587, 0.114])
    low = (_DCT @ resize(grey, 32, 32) @ _DCT.T)[:8, :8].ravel()[1:]
    bits = np.packbits(np.append(low > np.median(low), False))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def _bytes(x) -> np.ndarray:
    return np.frombuffer(x, np.uint8)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def image_features(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """features() of (pixels binary, width, height); null or ill-sized images give null."""
    for pixels, width, height in batches:
        yield pd.Series(
            [features(_bytes(p), int(w), int(h)) if p is not None and w > 0 and h > 0 and len(p) == 3 * w * h else None for p, w, h in zip(pixels, width, height, strict=True)],
            dtype=object,
        )


@F.pandas_udf(T.LongType())
def image_hash(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """perceptual_hash() of (pixels binary, width, height); null or ill-sized images give null."""
    for pixels, width, height in batches:
        yield pd.Series(
            [perceptual_hash(_bytes(p), int(w), int(h)) if p is not None and w > 0 and h > 0 and len(p) == 3 * w * h else None for p, w, h in zip(pixels, width, height, strict=True)],
            dtype="Int64",
        )


def crop(pixels: bytes, width: int, left: int, top: int, right: int, bottom: int) -> bytes:
    """The bytes of a box of a flat image."""
    return np.frombuffer(pixels, np.uint8).reshape(-1, width, 3)[top:bottom, left:right].tobytes()


def sign_hash(embedding: str, bits: int = 64) -> Column:
    """The signs of a vector's first elements (64 at most) as a number: bit i is set if element i is positive."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        value = 1 << i if i < 63 else -(1 << 63)
        out = out.bitwiseOR(F.when(F.get(F.col(embedding), F.lit(i)) > 0, F.lit(value)).otherwise(F.lit(0)).cast("long"))
    return out
