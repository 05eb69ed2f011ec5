"""Resampling of arrays onto another grid, in numpy: what workers do with one block."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .pixel import moved


@dataclass(frozen=True)
class Place:
    """Where a raster lies: x = a col + b row + c, y = d col + e row + f, and its EPSG code."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float
    epsg: int | None = None

    def inside(self, other: Place, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fractional rows and columns of `other` at the points (row, col) of this raster; centres of cells are at halves."""
        x, y = moved(cols * self.a + rows * self.b + self.c, cols * self.d + rows * self.e + self.f, *((self.epsg, other.epsg) if self.epsg and other.epsg else (None, None)))
        x, y, det = x - other.c, y - other.f, other.a * other.e - other.b * other.d
        return (y * other.a - x * other.d) / det, (x * other.e - y * other.b) / det

    def same_grid(self, other: Place) -> bool:
        return (self.a, self.b, self.c, self.d, self.e, self.f) == (other.a, other.b, other.c, other.d, other.e, other.f)


def rim(r0: int, r1: int, c0: int, c1: int) -> tuple[np.ndarray, np.ndarray]:
    """The centres of the cells along a window's border."""
    rows, cols = np.arange(r0, r1) + 0.5, np.arange(c0, c1) + 0.5
    return np.concatenate([rows, rows, np.full(len(cols), r0 + 0.5), np.full(len(cols), r1 - 0.5)]), np.concatenate([np.full(len(rows), c0 + 0.5), np.full(len(rows), c1 - 0.5), cols, cols])


def box(target: Place, source: Place, window: tuple[int, int, int, int], height: int, width: int, reach: int = 1) -> tuple[int, int, int, int] | None:
    """The source window (r0, r1, c0, c1) that the cells of a target window need, with `reach` cells around; None if it lies outside. Maps of grids are
    continuous, so a window's rim tells its extremes."""
    v, u = target.inside(source, *rim(*window))
    if not (np.isfinite(u).all() and np.isfinite(v).all()):
        return None
    r0, r1 = max(0, int(np.floor(v.min())) - reach), min(height, int(np.floor(v.max())) + reach + 1)
    c0, c1 = max(0, int(np.floor(u.min())) - reach), min(width, int(np.floor(u.max())) + reach + 1)
    return (r0, r1, c0, c1) if r0 < r1 and c0 < c1 else None


def cells(window: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all cells of a window, row by row."""
    r0, r1, c0, c1 = window
    rows, cols = np.meshgrid(np.arange(r0, r1), np.arange(c0, c1), indexing="ij")
    return rows.ravel(), cols.ravel()


def nearest(bands: np.ndarray, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band, point) values of the cells that hold the points (fractional row v, column u), and which points lie inside. Missing is NaN."""
    r, c = np.floor(v).astype(np.int64), np.floor(u).astype(np.int64)
    ok = (r >= 0) & (r < bands.shape[1]) & (c >= 0) & (c < bands.shape[2])
    out = np.full((bands.shape[0], len(v)), np.nan)
    out[:, ok] = bands[:, r[ok], c[ok]]
    return out, ok


def bilinear(bands: np.ndarray, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band, point) means of the four cells around each point, over those that have a value, and which points have a cell at all."""
    v, u = v - 0.5, u - 0.5
    r, c = np.floor(v).astype(np.int64), np.floor(u).astype(np.int64)
    dv, du = v - r, u - c
    total, weight, any_cell = np.zeros((bands.shape[0], len(v))), np.zeros((bands.shape[0], len(v))), np.zeros(len(v), bool)
    for i in (0, 1):
        for j in (0, 1):
            w = (dv if i else 1 - dv) * (du if j else 1 - du)
            ok = (r + i >= 0) & (r + i < bands.shape[1]) & (c + j >= 0) & (c + j < bands.shape[2]) & (w > 0)
            any_cell |= ok
            x = bands[:, r[ok] + i, c[ok] + j]
            has = ~np.isnan(x)
            total[:, ok] += np.where(has, x * w[ok], 0)
            weight[:, ok] += np.where(has, w[ok], 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(weight > 0, total / weight, np.nan), any_cell


def slope(z: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """Slope in degrees of a (row, col) array: central differences, one-sided beside missing cells and at the edges, flat without neighbours."""

    def gradient(z: np.ndarray, step: float) -> np.ndarray:
        pad = np.pad(z, ((0, 0), (1, 1)), constant_values=np.nan)
        back, on = pad[:, :-2], pad[:, 2:]
        n = np.where(np.isnan(back) | np.isnan(on), 1.0, 2.0)
        return (np.where(np.isnan(on), z, on) - np.where(np.isnan(back), z, back)) / (n * step)

    return np.degrees(np.arctan(np.hypot(gradient(z, dx), gradient(z.T, dy).T)))
