"""A limit order book rebuilt order by order, and its depth after each event.

Events (instrument, ts, sequence, action, side, order_id, price, size) come in order. ADD needs a new id, a size above 0
and a price that doesn't cross; CANCEL removes; MODIFY keeps the side, and loses its place when the price changes; FILL
reduces or removes; CLEAR empties; TRADE changes nothing. An event that breaks a rule is reported and left out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from tidemark.fold import Fold, ordered_fold

DEPTH = (
    "instrument long, ts long, sequence long, error string, bid_px double, bid_sz double, ask_px double, ask_sz double, "
    "bids array<struct<price:double,size:double>>, asks array<struct<price:double,size:double>>"
)


class Book:
    def __init__(self):
        self.orders: dict[int, tuple[str, float, float]] = {}
        self.levels: dict[str, dict[float, float]] = {"B": {}, "A": {}}

    def best(self, side: str) -> float | None:
        held = self.levels[side]
        return (max(held) if side == "B" else min(held)) if held else None

    def _change(self, side: str, price: float, size: float) -> None:
        held = self.levels[side]
        left = held.get(price, 0.0) + size
        if left > 1e-12:
            held[price] = left
        else:
            held.pop(price, None)

    def _crosses(self, side: str, price: float) -> bool:
        other = self.best("A" if side == "B" else "B")
        return other is not None and (price >= other if side == "B" else price <= other)

    def apply(self, action: str, side: str, order_id: int, price: float, size: float) -> str | None:
        """What is wrong with the event, or None if it has been applied."""
        known = self.orders.get(order_id)
        if action == "ADD":
            if known:
                return "duplicate order"
            if not size > 0:
                return "size not above 0"
            if self._crosses(side, price):
                return "crossed book"
            self.orders[order_id] = (side, price, size)
            self._change(side, price, size)
        elif action == "CLEAR":
            self.__init__()
        elif action == "TRADE":
            return None
        elif known is None:
            return "unknown order"
        elif action == "CANCEL":
            del self.orders[order_id]
            self._change(known[0], known[1], -known[2])
        elif action == "MODIFY":
            if side != known[0]:
                return "side changed"
            self._change(known[0], known[1], -known[2])
            if self._crosses(side, price):
                self._change(known[0], known[1], known[2])
                return "crossed book"
            self.orders[order_id] = (side, price, size)
            self._change(side, price, size)
        elif action == "FILL":
            if size > known[2] + 1e-12:
                return "overfill"
            self._change(known[0], known[1], -size)
            left = known[2] - size
            if left > 1e-12:
                self.orders[order_id] = (known[0], known[1], left)
            else:
                del self.orders[order_id]
        else:
            return "unknown action"
        return None

    def depth(self, side: str, n: int) -> list[tuple[float, float]]:
        return sorted(self.levels[side].items(), reverse=side == "B")[:n]


class _Depth(Fold):
    def __init__(self, n: int):
        self.book, self.n = Book(), n

    def rows(self, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in part.itertuples(index=False):
            error = self.book.apply(r.action, r.side, r.order_id, r.price, r.size)
            bids, asks = self.book.depth("B", self.n), self.book.depth("A", self.n)
            top = [*(bids[0] if bids else (None, None)), *(asks[0] if asks else (None, None))]
            levels = [[{"price": p, "size": s} for p, s in side] for side in (bids, asks)]
            out.append((r.instrument, r.ts, r.sequence, error, *top, *levels))
        return pd.DataFrame(out, columns=[c.split()[0] for c in DEPTH.replace("array<struct<price:double,size:double>>", "x").split(", ")])


def depth(events: DataFrame, n: int = 5) -> DataFrame:
    """Top of book and n levels of either side after each event, with what was wrong with it if anything."""
    return ordered_fold(events, "instrument", ["ts", "sequence"], lambda: _Depth(n), DEPTH)
