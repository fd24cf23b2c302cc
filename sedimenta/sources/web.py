"""A batch data source that fetches pages: ``spark.read.format("pages")``."""

from __future__ import annotations

import time
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


def fetch(url: str, timeout: float = 30.0) -> str | None:
    """The text of a page; null on any error and for anything but text/html."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "sedimenta"}), timeout=timeout) as r:
            if "text/html" not in r.headers.get("Content-Type", ""):
                return None
            return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except (OSError, ValueError):
        return None


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.delay, self.timeout, self.parts = float(options.get("delay", 0.5)), float(options.get("timeout", 30)), int(options.get("partitions", 1))

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.parts, len(self.urls)))
        return [_Urls(self.urls[k::n]) for k in range(n)]

    def read(self, partition: _Urls):
        for url in partition.urls:
            time.sleep(self.delay)
            yield (url, fetch(url, self.timeout))


class PageSource(DataSource):
    """Options: urls (one a line), delay in seconds before each request, timeout, partitions (fetched side by side)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fetch_pages(spark: SparkSession, urls: list[str], delay: float = 0.5, timeout: float = 30.0, partitions: int = 1) -> DataFrame:
    """url, html of a list of addresses; html is null where a page couldn't be had."""
    spark.dataSource.register(PageSource)
    return spark.read.format("pages").option("urls", "\n".join(urls)).option("delay", delay).option("timeout", timeout).option("partitions", partitions).load()
