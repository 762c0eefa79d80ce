"""A data source over records that come in pages after a cursor, batch or stream."""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: ``fetch(options, cursor, limit)`` gives records ``(position, record)`` after the cursor, in order.
Fetch = Callable[[dict, str | None, int], list[tuple[str, dict]]]

_CONNECTORS: dict[str, Fetch] = {}


def register(name: str, fetch: Fetch) -> None:
    """Makes a connector known under ``option('connector', name)``; it has to be importable where it runs."""
    _CONNECTORS[name] = fetch


def jsonl_pages(options: dict, cursor: str | None, limit: int) -> list[tuple[str, dict]]:
    """The built-in connector: records of a JSON-lines file, by their ``position`` field.

    The file is read line by line and no more than a page of it is held.
    """
    field = options.get("position", "position")
    with open(options["path"], encoding="utf-8") as f:
        rows = ((str(r[field]), no, r) for no, r in enumerate(map(json.loads, filter(str.strip, f))))
        page = heapq.nsmallest(limit, (x for x in rows if cursor is None or x[0] > cursor), key=lambda x: x[:2])
    return [(p, r) for p, _, r in page]


_CONNECTORS["jsonl"] = jsonl_pages


class PagedSource(DataSource):
    """``position string, record string``: records of a connector, each as JSON.

    Options: ``connector``, ``page`` (records asked at once, 500), and those of the connector.
    As a stream, the offset is the cursor: a micro-batch reads one page after the last one.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "position string, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), _CONNECTORS[self.options.get("connector", "jsonl")])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _StreamReader(dict(self.options), _CONNECTORS[self.options.get("connector", "jsonl")])


class _Reader(DataSourceReader):
    def __init__(self, options: dict, fetch: Fetch):
        self.options, self.fetch = options, fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple[str, str]]:
        cursor, size = None, int(self.options.get("page", "500"))
        while True:
            page = self.fetch(self.options, cursor, size)
            for position, record in page:
                yield position, json.dumps(record, sort_keys=True)
            if len(page) < size:
                return
            cursor = page[-1][0]


class _StreamReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict, fetch: Fetch):
        self.options, self.fetch = options, fetch

    def initialOffset(self) -> dict:
        return {"cursor": None}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        page = self.fetch(self.options, start["cursor"], int(self.options.get("page", "500")))
        rows = [(p, json.dumps(r, sort_keys=True)) for p, r in page]
        return iter(rows), {"cursor": page[-1][0] if page else start["cursor"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        cursor, size = start["cursor"], int(self.options.get("page", "500"))
        while end["cursor"] is not None:
            page = self.fetch(self.options, cursor, size)
            for p, r in page:
                if p > end["cursor"]:
                    return
                yield p, json.dumps(r, sort_keys=True)
            if len(page) < size:
                return
            cursor = page[-1][0]
