"""Inspectors: who knows an address, what it leads to, and the loops around that."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Literal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import Route, route
from ..session import through_table


@dataclass(frozen=True)
class Found:
    """What an inspector says of an address: playlists, another address to look at, candidates to choose from, wait, or none."""

    kind: Literal["playlist", "redirect", "candidate", "wait", "none"]
    value: str | None = None
    title: str | None = None


@dataclass(frozen=True)
class Inspector:
    """A plug-in: its name, what it is for, the arguments it takes, the addresses it knows and what it says of one.

    inspect(url, path parameters, query parameters, arguments) runs on the executors; several Found are candidates, playlists or both.
    """

    name: str
    rules: tuple[tuple[str, str, str], ...]  # scheme, host, path patterns as in Route
    inspect: Callable[[str, dict, dict, dict], list[Found]]
    help: str = ""
    arguments: dict[str, str] = field(default_factory=dict)


_OUT = "_id bigint, kind string, value string, title string, n int"


class Inspectors:
    """A registry, asked in the order of registration."""

    def __init__(self, *inspectors: Inspector):
        self.inspectors: dict[str, Inspector] = {}
        for i in inspectors:
            self.add(i)

    def add(self, i: Inspector) -> Inspectors:
        if i.name in self.inspectors:
            raise ValueError(f"{i.name} is registered already")
        self.inspectors[i.name] = i
        return self

    def routes(self) -> list[Route]:
        return [Route(i.name, host, path, scheme) for i in self.inspectors.values() for scheme, host, path in i.rules]

    def inspect(self, urls: DataFrame, url: str, arguments: dict[str, str] | None = None, choose: Callable[[list[str]], int] = lambda titles: 0, wait: float | None = None, most_waits: int = 0) -> DataFrame:
        """(url, inspector, playlist_url, title, hops, n): the playlists each distinct address leads to.

        An address nobody knows, and one that leads in a loop, has a row of nulls. Redirects are followed until none is left; of candidates `choose` picks one by
        their titles; addresses whose inspector says wait are asked again every `wait` seconds, `most_waits` times at most (they are `none` then).
        Every round is written to the shared folder; rounds are as many as the longest chain of redirects has hops.
        """
        given, table = dict(arguments or {}), self.inspectors
        front = through_table(urls.where(F.col(url).isNotNull()).select(F.col(url).alias("url")).distinct().select("url", F.col("url").alias("_at"), F.lit(0).alias("hops"), F.array("url").alias("_seen")), "front")
        done, waits = None, 0

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for i, at, name, path, query in pdf.itertuples(index=False):
                    said = table[name].inspect(at, dict(path or {}), dict(query or {}), given) if name in table else [Found("none")]
                    choices = [f for f in said if f.kind == "candidate"]
                    if choices:
                        said = [f for f in said if f.kind != "candidate"] + [Found("redirect", choices[choose([c.title or c.value or "" for c in choices])].value)]
                    rows += [(i, f.kind, f.value, f.title, n) for n, f in enumerate(said or [Found("none")])]
                yield pd.DataFrame(rows, columns=["_id", "kind", "value", "title", "n"])

        while True:
            known = route(front, "_at", self.routes()).withColumn("_id", F.xxhash64("url", "_at"))
            answers = known.select("_id", "_at", "route", "path_params", "query_params").mapInPandas(ask, _OUT)
            said = through_table(known.select("_id", "url", "_at", "route", "hops", "_seen").join(answers, "_id"), "said")
            loop = F.array_contains("_seen", F.col("value"))
            on = said.where((F.col("kind") == "redirect") & ~loop)
            ends = said.where(F.col("kind").isin("playlist", "none") | ((F.col("kind") == "redirect") & loop))
            ends = ends.select("url", F.col("route").alias("inspector"), F.when(F.col("kind") == "playlist", F.col("value")).alias("playlist_url"), "title", "hops", "n")
            done = ends if done is None else done.unionByName(ends)
            front = on.select("url", F.col("value").alias("_at"), (F.col("hops") + 1).alias("hops"), F.concat("_seen", F.array("value")).alias("_seen")).distinct()
            later = said.where("kind = 'wait'").select("url", "_at", "hops", "_seen").distinct()
            front = through_table(front.unionByName(later), "front")
            if front.isEmpty():
                return done
            if on.isEmpty():  # only waiting is left
                if wait is None or waits >= most_waits:
                    gone = front.select("url", F.lit(None).cast("string").alias("inspector"), F.lit(None).cast("string").alias("playlist_url"), F.lit(None).cast("string").alias("title"), "hops", F.lit(0).alias("n"))
                    return done.unionByName(gone)
                waits += 1
                time.sleep(wait)
