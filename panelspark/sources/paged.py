"""A batch data source that pages through an exchange-like client by time."""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

PAGE_SCHEMA = "seq bigint, symbol string, ts_ms bigint, open double, high double, low double, close double, volume double"


def pages(call: Callable[[int], list], since: int, until: int, retries: int = 5, wait: Callable[[float], None] = time.sleep) -> Iterator[list]:
    """Pages from `since`; the next page begins after the last time of the one before. A call that
    fails is tried `retries` times at doubling waits and then raises: data is never cut short. Ends
    with an empty page, a page that makes no progress, or at `until`."""
    cursor = since
    while cursor < until:
        for attempt in range(retries):
            try:
                page = call(cursor)
                break
            except (ConnectionError, TimeoutError):
                if attempt == retries - 1:
                    raise
                wait(2.0**attempt)
        if not page or page[-1][0] < cursor:
            return
        yield page
        cursor = page[-1][0] + 1


def first_listed(client: Callable[[str, int], list], names: list[str], cursor: int, retries: int = 5, wait: Callable[[float], None] = time.sleep) -> str | None:
    """The first of some names for one symbol that the client knows: one that raises LookupError is not
    listed, and the next is tried. None where all are unknown."""
    for name in names:
        try:
            next(iter(pages(lambda since, n=name: client(n, since), cursor, cursor + 1, retries, wait)), None)
        except LookupError:
            continue
        return name
    return None


def client_of(options: dict) -> Callable[[str, int], list]:
    module, _, name = options["client"].partition(":")
    return getattr(importlib.import_module(module), name)


class _Symbol(InputPartition):
    def __init__(self, symbol: str):
        self.symbol = symbol


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Symbol(s) for s in self.options["symbols"].split(",")]

    def read(self, partition):
        client, names = client_of(self.options), partition.symbol.split("|")
        since = int(self.options.get("since", 0))
        listed = first_listed(client, names, since)
        if listed is None:
            return
        seq = 0
        for page in pages(lambda cursor: client(listed, cursor), since, int(self.options.get("until", 1 << 62))):
            for ts, *values in page:
                yield (seq, names[0], ts, *values)
                seq += 1


class _Cursor(SimpleDataSourceStreamReader):
    """A stream of pages: the offset is the cursor of each symbol, so a query that starts again goes on
    where its checkpoint is. A batch has one page a symbol."""

    def __init__(self, options: dict):
        self.options, self.client = options, client_of(options)
        self.until = int(options.get("until", 1 << 62))
        self.listed: dict[str, str | None] = {}

    def initialOffset(self) -> dict:
        return {s: int(self.options.get("since", 0)) for s in self.options["symbols"].split(",")}

    def _page(self, symbol: str, cursor: int) -> list:
        names = symbol.split("|")
        if self.listed.get(symbol) is None:
            self.listed[symbol] = first_listed(self.client, names, cursor)
        listed = self.listed[symbol]
        found = [] if listed is None else next(iter(pages(lambda since: self.client(listed, since), cursor, self.until)), [])
        return [(ts, names[0], ts, *values) for ts, *values in found if ts < self.until]

    def read(self, start: dict):
        rows, end = [], dict(start)
        for symbol, cursor in start.items():
            page = self._page(symbol, cursor)
            if page:
                rows += page
                end[symbol] = page[-1][2] + 1
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([row for symbol, cursor in start.items() if end[symbol] > cursor for row in self._page(symbol, cursor) if row[2] < end[symbol]])

    def commit(self, end: dict) -> None:
        """The checkpoint holds the cursors; there is nothing to release."""


class PagedOhlcv(DataSource):
    """format("paged_ohlcv"), options client (module:function of symbol and cursor), symbols, since,
    until. A symbol may be several names with a bar between, of which the first that the client lists is
    read, under the first name. One task reads one symbol; a stream reads a page of each."""

    @classmethod
    def name(cls) -> str:
        return "paged_ohlcv"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema):
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema):
        return _Cursor(dict(self.options))
