"""Window functions over arrays of shape (windows, W): the forms for batches and streams."""

from __future__ import annotations

import numpy as np

from .ohlc import NO_LOW


def sums(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Sums of prices."""
    return {f"sum_{s}": c[f"{s}_price"].sum(1) for s in ("bid", "ask")}


def q1(c: dict[str, np.ndarray], slide: int, step_ms: float = 300_000.0, fit_on: dict[str, str] | None = None) -> dict[str, np.ndarray]:
    """Coefficients (x in steps; y the columns fit_on, or the prices) and candlesticks of the last `slide` columns."""
    ts = c["original_timestamp"]
    x = (ts - ts[:, :1]) / step_ms
    kept = np.ones(ts.shape, bool)
    kept[:, 1:] = ts[:, 1:] != ts[:, :-1]
    out = {"timestamp": c["timestamp"][:, -1].copy()}
    width = ts.shape[1]
    rows = np.arange(len(ts))
    for s in ("bid", "ask"):
        price, valid = c[f"{s}_price"], c[f"{s}_size"] > 0
        y, use = c[(fit_on or {}).get(s, f"{s}_price")].astype(float), valid & kept
        n, sx, sxx, sxxx, sxxxx = (np.where(use, x**k, 0.0).sum(1) for k in range(5))
        sy, sxy, sxxy = (np.where(use, y * x**k, 0.0).sum(1) for k in range(3))
        with np.errstate(divide="ignore", invalid="ignore"):
            below = sxx * sxxxx - sxxx * sxxx
            a, b = (sxxy * sxx - sxy * sxxx) / below, (sxy * sxxxx - sxxy * sxxx) / below
            out |= {f"p0_{s}": sy / n - b * (sx / n) - a * (sxx / n), f"p1_{s}": b, f"p2_{s}": a}
        tail = valid.copy()
        tail[:, : width - slide] = False
        some = tail.any(1)
        opens = tail & (price != 0)
        out[f"open_{s}"] = np.where(opens.any(1), price[rows, opens.argmax(1)], 0.0)
        out[f"high_{s}"] = np.maximum(np.where(tail, price, -np.inf).max(1), 0.0)
        out[f"low_{s}"] = np.minimum(np.where(tail, price, np.inf).min(1), NO_LOW)
        out[f"close_{s}"] = np.where(some, price[rows, width - 1 - tail[:, ::-1].argmax(1)], price[:, 0])
    return out
