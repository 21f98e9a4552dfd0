"""Kernels on one image's pixels: windows in constant time a pixel, gradients, connected components.

They take and give two-dimensional arrays. Pixels beyond an edge are left out of windows; gradients and
blurs see the image mirrored there, without its edge pixels twice.
"""

from __future__ import annotations

import numpy as np


def running(a: np.ndarray, size: int, axis: int, op: np.ufunc) -> np.ndarray:
    """The greatest (``np.maximum``) or least (``np.minimum``) value in a window of odd ``size`` round
    each place. Blocks of ``size`` are accumulated from both ends, and a window is the end of a block
    and the beginning of the next, so the time does not depend on the size."""
    a = np.moveaxis(a, axis, -1)
    n, half = a.shape[-1], size // 2
    blocks = -(-(n + 2 * half) // size)
    worst = np.iinfo(a.dtype).min if op is np.maximum else np.iinfo(a.dtype).max
    b = np.full((*a.shape[:-1], blocks * size), worst, dtype=a.dtype)
    b[..., half : half + n] = a
    b = b.reshape(*a.shape[:-1], blocks, size)
    head = op.accumulate(b, axis=-1).reshape(*a.shape[:-1], -1)
    tail = op.accumulate(b[..., ::-1], axis=-1)[..., ::-1].reshape(*a.shape[:-1], -1)
    return np.moveaxis(op(tail[..., :n], head[..., size - 1 : size - 1 + n]), -1, axis)


def closing(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Dark spots smaller than the window filled."""
    for op in (np.maximum, np.minimum):
        a = running(running(a, width, 1, op), height, 0, op)
    return a


def dark_spots(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """How much darker each pixel is than what ``closing`` makes of it."""
    return closing(a, width, height) - a


def across(a: np.ndarray) -> np.ndarray:
    """The size of the change from left to right, weighted 3, 10, 3 over three rows."""
    b = np.pad(a.astype(np.int32), 1, mode="reflect")
    change = b[:, 2:] - b[:, :-2]
    return np.abs(3 * change[:-2] + 10 * change[1:-1] + 3 * change[2:])


def blurred(a: np.ndarray) -> np.ndarray:
    """Weights 1, 2, 1 both ways, rounded."""
    b = np.pad(a.astype(np.int32), 1, mode="reflect")
    b = b[:, :-2] + 2 * b[:, 1:-1] + b[:, 2:]
    return ((b[:-2] + 2 * b[1:-1] + b[2:] + 8) >> 4).astype(np.uint8)


def stretched(a: np.ndarray) -> np.ndarray:
    """Least to greatest value spread over 0 to 255; values of one tone stay."""
    low, high = int(a.min()), int(a.max())
    return ((a.astype(np.int64) - low) * 255 // (high - low) if high > low else a).astype(np.uint8)


def components(mask: np.ndarray) -> dict[str, np.ndarray]:
    """Left, top, width, height, area and centre (x, y) of each 8-connected group of set pixels, by the
    place of its first pixel. Runs of a row are joined to the runs of the next row that they touch, by
    union-find over runs: roots are hooked to the smaller root, then all paths are shortened."""
    wide = mask.shape[1] + 2
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (row, start), end = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
    first = np.searchsorted(row * wide + end, (row + 1) * wide + start, side="left")
    last = np.searchsorted(row * wide + start, (row + 1) * wide + end, side="right")
    touch = np.maximum(0, last - first)
    upper = np.repeat(np.arange(len(row)), touch)
    lower = np.repeat(first - np.cumsum(touch) + touch, touch) + np.arange(touch.sum())
    root = np.arange(len(row))
    while (split := root[upper] != root[lower]).any():
        a, b = root[upper[split]], root[lower[split]]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    _, own = np.unique(root, return_inverse=True)
    size = own.max(initial=-1) + 1
    long = end - start
    area = np.bincount(own, weights=long, minlength=size).astype(np.int64)
    box = {}
    for name, values, op in (("left", start, np.minimum), ("top", row, np.minimum), ("right", end, np.maximum), ("bottom", row + 1, np.maximum)):
        box[name] = np.full(size, mask.size if op is np.minimum else 0, dtype=np.int64)
        op.at(box[name], own, values)
    centre = lambda values: np.bincount(own, weights=values, minlength=size) / np.maximum(area, 1)
    return {
        "left": box["left"], "top": box["top"], "width": box["right"] - box["left"], "height": box["bottom"] - box["top"], "area": area,
        "x": centre((start + end - 1) * long / 2), "y": centre(row * long),
    }


def turned(a: np.ndarray, quarters: int) -> np.ndarray:
    """An image turned clockwise by quarters."""
    return np.ascontiguousarray(np.rot90(a, -quarters))
