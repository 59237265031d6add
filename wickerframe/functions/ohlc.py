"""Candlesticks: open, high, low and close of the valid prices of a part of a window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A side without valid prices has this low, and 0 for high and open.
NO_LOW = 10000.0


def candlestick(side: str, price: Column, valid: Column, pos: Column, close: Column | None = None) -> list[Column]:
    """Aggregates open_, high_, low_, close_<side>. open is the first valid price that is not 0; close the last valid
    price, or the price of the window's first row if there is none, unless another aggregate is given."""
    low = F.least(F.min(F.when(valid, price)), F.lit(NO_LOW))
    high = F.greatest(F.max(F.when(valid, price)), F.lit(0.0))
    first = F.min_by(price, F.when(valid & (price != 0), pos))
    last = F.coalesce(F.max_by(price, F.when(valid, pos)), F.min_by(price, pos)) if close is None else close
    return [F.coalesce(first, F.lit(0.0)).alias(f"open_{side}"), high.alias(f"high_{side}"), low.alias(f"low_{side}"), last.alias(f"close_{side}")]
