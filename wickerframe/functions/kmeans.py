"""k-means of a window: k seeds are its first points, a fixed number of rounds, no convergence test."""

from __future__ import annotations

import numpy as np


def kmeans(x: np.ndarray, y: np.ndarray, k: int = 3, rounds: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids' x and y, of shape (windows, k), and the last assignment, of all windows (windows, W) at once.

    Ties go to the lower cluster. An empty cluster's centroid is NaN: as nothing is nearer than NaN or to NaN, a NaN
    cluster 1 or 2 is never chosen again, and a NaN cluster 0 takes every point.
    """
    cx, cy = x[:, :k].astype(float), y[:, :k].astype(float)
    label = np.zeros(x.shape, np.int64)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(rounds):
            best = np.sqrt((x - cx[:, :1]) ** 2 + (y - cy[:, :1]) ** 2)
            label = np.zeros(x.shape, np.int64)
            for j in range(1, k):
                d = np.sqrt((x - cx[:, j : j + 1]) ** 2 + (y - cy[:, j : j + 1]) ** 2)
                nearer = d < best
                label, best = np.where(nearer, j, label), np.where(nearer, d, best)
            n = np.stack([(label == j).sum(1) for j in range(k)], 1)
            cx = np.stack([np.where(label == j, x, 0).sum(1) for j in range(k)], 1) / n
            cy = np.stack([np.where(label == j, y, 0).sum(1) for j in range(k)], 1) / n
    return cx, cy, label
