"""A user's own fetchers over any number of queries, and a user's own feeds as a registered data source for batch and stream."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

Fetch = Callable[[str, str], Iterable[dict]]

HIT = "query_no long, channel string, pos int, title string, url string, content string, error string"
_FIELDS = [("query_no", pa.int64()), ("channel", pa.string()), ("pos", pa.int32()), ("title", pa.string()), ("url", pa.string()), ("content", pa.string()), ("error", pa.string())]


def fetched(queries: DataFrame, fetchers: dict[str, Fetch], default: str, batch: int = 500) -> DataFrame:
    """(query_no, channel, fetcher, query) -> the hits of each query, in the order in which its fetcher gives them (`pos` from 0).

    Each query goes to the fetcher it names, an unknown or null name to `default`; null queries have no hits. Fetchers run in
    the tasks, so as many at once as there are cores; hits leave in batches, whatever a query brings. A query whose fetcher
    fails has one row with `error` and null `pos` after the hits it had given, and costs no other query its hits. A task that
    is tried again asks again: fetchers only read. Works on a stream of queries as on a table."""
    if default not in fetchers:
        raise ValueError(f"no fetcher named {default}")

    def hits(q: dict) -> Iterator[tuple]:
        try:
            for pos, hit in enumerate(fetchers.get(q["fetcher"], fetchers[default])(q["query"], q["channel"])):
                yield q["query_no"], q["channel"], pos, hit.get("title"), hit.get("url"), hit.get("content"), None
        except Exception as e:  # the user's code: its failure is a row of the result
            yield q["query_no"], q["channel"], None, None, None, None, f"{type(e).__name__}: {e}"

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], names=[n for n, _ in _FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for some in batches:
            for q in some.to_pylist():
                for row in hits(q) if q["query"] is not None else ():
                    rows.append(row)
                    if len(rows) == batch:
                        yield packed(rows)
                        rows = []
        if rows:
            yield packed(rows)

    return queries.select("query_no", "channel", "fetcher", "query").mapInArrow(run, HIT)


class Feed:
    """What a user writes for a channel that grows: entries have numbers from 0, and those below `end` do not change. It gets
    the options of the read."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def end(self, channel: str) -> int:
        """One more than the number of the channel's last entry."""
        raise NotImplementedError

    def entries(self, channel: str, first: int, end: int) -> Iterator[dict]:
        """The entries `first` to `end` - 1 as dicts of title, url, content."""
        raise NotImplementedError


class _Slice(InputPartition):
    def __init__(self, channel: str, first: int, end: int):
        super().__init__((channel, first, end))
        self.channel, self.first, self.end = channel, first, end


def _slices(at: dict[str, int], to: dict[str, int], size: int) -> list[_Slice]:
    return [_Slice(c, n, min(n + size, to[c])) for c in sorted(to) for n in range(at.get(c, 0), to[c], size)]


class _Source:
    """What batch and stream have in common: which feed, which channels, and how a slice of one is read."""

    def __init__(self, options: dict):
        module, _, name = options["feed"].partition(":")
        self.feed: Feed = getattr(importlib.import_module(module), name)(options)
        self.channels = [c for c in options.get("channels", "").split(",") if c]
        self.size = int(options.get("entries_per_task", 1000))

    def read(self, part: _Slice) -> Iterator[tuple]:
        for n, e in enumerate(self.feed.entries(part.channel, part.first, part.end), part.first):
            yield part.channel, n, e.get("title"), e.get("url"), e.get("content")


class _Batch(_Source, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Channels that a filter names are the only ones asked."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("channel",):
                self.channels = [c for c in self.channels if c == f.value]
            elif isinstance(f, In) and f.attribute == ("channel",):
                self.channels = [c for c in self.channels if c in f.value]
            else:
                yield f

    def partitions(self) -> list[_Slice]:
        return _slices({}, {c: self.feed.end(c) for c in self.channels}, self.size) or [_Slice("", 0, 0)]

    def read(self, part: _Slice) -> Iterator[tuple]:
        return super().read(part) if part.end else iter(())


class _Stream(_Source, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {c: 0 for c in self.channels}

    def latestOffset(self) -> dict:
        return {c: self.feed.end(c) for c in self.channels}

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        return _slices(start, end, self.size)


class FeedSource(DataSource):
    """`spark.read.format("feed")` and `spark.readStream.format("feed")` over a user's Feed class.

    Options: `feed`, as `module:Class`, which executors can import; `channels`, separated by commas; `entries_per_task`. A
    partition is a slice of one channel, so a channel that holds most entries is read by many tasks. A stream's offsets
    are the ends of its channels: a restart reads on from there, and a batch that is tried again reads the same slices."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return "channel string, entry_no long, title string, url string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def register_feeds(spark: SparkSession) -> None:
    """Make the format known to a session; filters on channels then reach the feed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeedSource)
