"""Chains of pages: chat history that links backwards, entries that point to the next."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def follow(first: str, fetch: Callable[[str], str], next_of: Callable[[str], str | None]) -> Iterator[tuple[int, str, str]]:
    """(number, address, body) along the links, however many; an address that came before ends the chain."""
    seen: set[str] = set()
    at: str | None = first
    while at and at not in seen:
        seen.add(at)
        body = fetch(at)
        yield len(seen) - 1, at, body
        at = next_of(body)


def next_uri(body: str) -> str | None:
    """The next.uri member of a JSON body."""
    try:
        return (json.loads(body).get("next") or {}).get("uri")
    except (ValueError, AttributeError):
        return None


class PageChain(DataSource):
    """spark.read.format("page_chain").option("starts", JSON list of addresses): one partition per chain, rows (start, page, uri, body).

    Addresses are read with the fetch module's opener; bodies are JSON with next.uri.
    """

    @classmethod
    def name(cls) -> str:
        return "page_chain"

    def schema(self) -> str:
        return "start string, page bigint, uri string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _ChainReader(json.loads(self.options["starts"]))


class _Start(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class _ChainReader(DataSourceReader):
    def __init__(self, starts: list[str]):
        self.starts = starts

    def partitions(self):
        return [_Start(s) for s in self.starts]

    def read(self, partition):
        from rillwork.operators.fetch import file_opener

        for n, uri, body in follow(partition.uri, lambda u: file_opener(u, None, {}).decode(), next_uri):
            yield partition.uri, n, uri, body


def read_chains(spark: SparkSession, starts: list[str]) -> DataFrame:
    spark.dataSource.register(PageChain)
    return spark.read.format("page_chain").option("starts", json.dumps(starts)).load()
