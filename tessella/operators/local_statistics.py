"""Distances between patches from local windows: local correlation, structural similarity over scales, sharpness.

Patches are square matrices in row-major order. Blocks of an image's patches are compared with all of them as in
``affinity``: the products of a block's pairs become integral images (summed-area tables), from which the sum over any
window is four look-ups, and so is every window moment of a pair, whatever the window's size. Moments of single
patches are taken once, not for each pair. Sums of whole numbers are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from tessella.operators.affinity import MATRIX, blocked

#: Weights of the two constants of structural similarity, as shares of the span of values.
LUMINANCE, CONTRAST = 0.01, 0.03

#: The distance of each of some patches to each of others, as a matrix.
Distance = Callable[["Patches", "Patches"], np.ndarray]


class Patches:
    """Square patches: values of shape (patches, side, side)."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.side = values.shape[-1]

    @classmethod
    def flat(cls, rows: np.ndarray) -> Patches:
        side = round(rows.shape[1] ** 0.5)
        if side * side != rows.shape[1]:
            raise ValueError(f"{rows.shape[1]} values are no square patch")
        return cls(rows.reshape(-1, side, side))

    def part(self, start: int, stop: int) -> Patches:
        return Patches(self.values[start:stop])


def window_sums(x: np.ndarray, side: int) -> np.ndarray:
    """The sum of each side x side window of the last two axes."""
    table = np.zeros((*x.shape[:-2], x.shape[-2] + 1, x.shape[-1] + 1))
    np.cumsum(np.cumsum(x, axis=-2), axis=-1, out=table[..., 1:, 1:])
    return table[..., side:, side:] - table[..., :-side, side:] - table[..., side:, :-side] + table[..., :-side, :-side]


def moments(a: Patches, b: Patches, side: int) -> tuple[np.ndarray, ...]:
    """Of every window of every pair (axes: a, b, rows, columns): sums of a and of b, and n times the sums of squared
    deviations of a, of b and of their product, for n pixels a window."""
    n = side * side
    u, v = a.values[:, None], b.values[None]
    sa, sb = window_sums(u, side), window_sums(v, side)
    va, vb = n * window_sums(u * u, side) - sa * sa, n * window_sums(v * v, side) - sb * sb
    return sa, sb, va, vb, n * window_sums(u * v, side) - sa * sb


def lncc(a: Patches, b: Patches, d: int = 1) -> np.ndarray:
    """1 less the mean over all pixels of the correlation in the window of side 2 d + 1 around a pixel, which is 0 where either
    window is constant and around the outermost pixels: the first d rows and columns, the last d + 1."""
    *_, va, vb, both = moments(a, b, 2 * d + 1)
    inner = slice(0, a.side - 2 * d - 1)
    spread = np.sqrt(np.maximum(va, 0) * np.maximum(vb, 0))[..., inner, inner]
    r = np.divide(both[..., inner, inner], spread, out=np.zeros(spread.shape), where=spread > 0)
    return 1 - r.sum((-2, -1)) / a.side**2


def ssim(a: Patches, b: Patches, span: float, side: int = 7) -> np.ndarray:
    """1 less the mean structural similarity over all side x side windows, with sample variances, for values that span
    ``span``."""
    n = side * side
    c1, c2 = (LUMINANCE * span) ** 2, (CONTRAST * span) ** 2
    sa, sb, va, vb, both = moments(a, b, side)
    ma, mb = sa / n, sb / n
    va, vb, both = (x / (n * (n - 1)) for x in (va, vb, both))
    return 1 - ((2 * ma * mb + c1) * (2 * both + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean((-2, -1))


def halved(a: Patches) -> Patches:
    """Patches of half the side, of means of 2 x 2 pixels; a last odd row and column go."""
    side = a.side // 2
    return Patches(a.values[:, : 2 * side, : 2 * side].reshape(-1, side, 2, side, 2).mean((2, 4)))


def ms_ssim(a: Patches, b: Patches, span: float, scales: int = 2) -> np.ndarray:
    """1 less the product of structural similarities, none below 0, over halved scales in equal powers; windows are of
    side 7, or the largest odd side below the patch's."""
    out = np.ones((len(a.values), len(b.values)))
    for scale in range(scales):
        if scale:
            a, b = halved(a), halved(b)
        out *= np.maximum(1 - ssim(a, b, span, min(7, a.side - 1 + a.side % 2)), 0) ** (1 / scales)
    return 1 - out


def scc(a: Patches, b: Patches) -> np.ndarray:
    """1 less the correlation of the patches without their local means (8 times a pixel less its eight neighbours, inner
    pixels only), which is 0 if either is constant then."""
    sharp = lambda p: Patches(9 * p.values[:, 1:-1, 1:-1] - window_sums(p.values, 3))
    a, b = sharp(a), sharp(b)
    *_, va, vb, both = moments(a, b, a.side)
    spread = np.sqrt(np.maximum(va, 0) * np.maximum(vb, 0))
    return 1 - np.divide(both, spread, out=np.zeros(both.shape), where=spread > 0)[..., 0, 0]


def pairwise(patches: DataFrame, distance: Distance) -> DataFrame:
    """image_id, i, j, w: the distance of each pair of patches (image_id, p, k) of an image. Windows of a few of a block's
    patches and all of the image's are held at a time."""

    def compare(i: np.ndarray, a: np.ndarray, j: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        left, right = Patches.flat(a), Patches.flat(b)
        step = max(1, MATRIX // max(b.size, 1))
        for s in range(0, len(a), step):
            w = distance(left.part(s, s + step), right)
            yield np.repeat(i[s : s + step], len(j)), np.tile(j, len(w)), w.ravel()

    return blocked(patches, compare, "double")
