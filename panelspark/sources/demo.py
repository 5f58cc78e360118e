"""A client for the paged source that makes its bars up: hourly, 500 of them, 100 a page."""

from __future__ import annotations

HOUR, BARS, PAGE = 3_600_000, 500, 100


def klines(symbol: str, since: int) -> list[list]:
    """Bars from `since` on; PEPE is listed per thousand only."""
    if symbol.startswith("PEPE/"):
        raise LookupError(symbol)
    first = -(-since // HOUR)
    return [[i * HOUR, 100.0 + i, 102.0 + i, 99.0 + i, 101.0 + i, i % 7 + 1.0] for i in range(first, min(first + PAGE, BARS))]
