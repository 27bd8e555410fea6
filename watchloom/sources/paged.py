"""A data source for paged JSON: every page is a partition, fetched where it is read."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def download(url: str, attempts: int = 3, wait: float = 2.0, timeout: float = 60.0) -> bytes:
    """The bytes behind a URL; a time-out is tried again after a wait that grows by ``wait`` each time, other errors are not."""
    for n in range(1, attempts + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                return r.read()
        except TimeoutError:
            if n == attempts:
                raise
            time.sleep(wait * n)
    raise ValueError("attempts must be at least 1")


class Page(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class PagedJson(DataSource):
    """``format("paged_json")`` with options ``url`` (with ``{offset}`` or ``{page}``), ``size``, ``items`` and ``total`` (their field names).

    The first page tells the total, and each page is a partition.  Rows: page (its URL) and item (JSON text); items that are null are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "page string, item string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.size = options["url"], int(options.get("size", 50))
        self.items, self.total, self.first = options.get("items", "items"), options.get("total", "total"), int(options.get("first", 1))

    def _page(self, i: int) -> str:
        return self.url.replace("{offset}", str(i * self.size)).replace("{page}", str(i + self.first))

    def partitions(self) -> list[InputPartition]:
        total = json.loads(download(self._page(0))).get(self.total) or 0
        return [Page(self._page(i)) for i in range(max(1, -(-int(total) // self.size)))]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        for x in json.loads(download(partition.url)).get(self.items) or []:
            if x is not None:
                yield partition.url, json.dumps(x, ensure_ascii=False)
