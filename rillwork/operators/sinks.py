"""Where assembled parts go, and which way of merging and staging a set of options asks for."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Literal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import concat_binary, execute_merge, islands, output_names, write_concatenated

L = F.lit
Writer = Callable[[str, bytes], None]


def file_writer(path: str, data: bytes) -> None:
    """A file of a folder that all executors share; written beside and renamed, so a repeated task leaves a whole file."""
    path = path.removeprefix("file://")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.part", "wb") as f:
        f.write(data)
    os.replace(f"{path}.part", path)


def write_files(df: DataFrame, path: str, data: str, writer: Writer = file_writer) -> DataFrame:
    """Writes df.data to df.path, row by row where the rows are; (path, bytes) of what was written. Runs when the result is used."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, x in zip(pdf[path], pdf[data]):
                writer(p, bytes(x))
            yield pd.DataFrame({"path": pdf[path], "bytes": [len(x) for x in pdf[data]]})

    return df.select(path, data).mapInPandas(run, "path string, bytes bigint")


def concat_parts(outcomes: DataFrame, stem: Column, ext: Column, collapse: bool = True) -> DataFrame:
    """(stream_id, part, file, data) of outcomes (stream_id, sequence, success, data): one part per run of good segments, in order.

    Failures at the end start no part; a stream with one part gets the plain name.
    """
    parts = concat_binary(islands(outcomes, ["stream_id"], [F.col("sequence")], "success", collapse), ["stream_id", "part"], ["sequence"], "data")
    return output_names(parts, ["stream_id"], "part", stem, ext)


def skip(outcomes: DataFrame) -> None:
    """Runs the plan and keeps nothing."""
    outcomes.write.format("noop").mode("overwrite").save()


@dataclass(frozen=True)
class Options:
    """What a user asks for; None means not said."""

    output: str | None = None
    no_merge: bool = False
    concat: bool = False
    pipe: bool = False
    pipe_to: str | None = None
    pipe_mux: bool = False
    live: bool = False
    dash: bool = False
    in_memory: bool = False
    cache_dir: str | None = None
    object_store: str | None = None
    headers: tuple[str, ...] = ()
    cookies: tuple[str, ...] = ()
    key: str | None = None

    def overlaid(self, other: "Options") -> "Options":
        """`other` over this: its scalars where it has any, its lists behind these."""
        merged = {}
        for name in self.__dataclass_fields__:
            mine, theirs = getattr(self, name), getattr(other, name)
            merged[name] = mine + theirs if isinstance(mine, tuple) else theirs if theirs not in (None, False) else mine
        return Options(**merged)


def merger_kind(o: Options) -> Literal["skip", "pipe", "pipe_file", "pipe_mux", "concat", "auto"]:
    """How finished segments are put together."""
    if o.pipe_mux:
        return "pipe_mux"
    if o.pipe or o.pipe_to:
        return "pipe_file" if o.pipe_to else "pipe"
    if o.no_merge:
        return "skip"
    return "concat" if o.concat else "auto"


def staging_kind(o: Options) -> Literal["memory", "object", "file"]:
    """Where segments wait."""
    return "object" if o.object_store else "memory" if o.in_memory or (o.pipe and not o.live and o.cache_dir is None) else "file"


def stage(outcomes: DataFrame, o: Options, path: str) -> DataFrame:
    """The outcomes where the options want them to wait: in memory (spilled to disk by Spark if it is short), or in a folder of files or of an object store."""
    kind = staging_kind(o)
    if kind == "memory":
        return outcomes.persist()
    at = o.object_store or o.cache_dir or path
    outcomes.write.mode("overwrite").parquet(at)
    return outcomes.sparkSession.read.schema(outcomes.schema).parquet(at)


def finish(outcomes: DataFrame, o: Options, stem: Column, ext: Column, mux: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """Carries out the way of merging the options ask for; (path, bytes) of what was written, None where nothing is.

    outcomes: presentation, stream_id, sequence, success, kind, data. pipe and pipe_mux write the parts of each stream one after another, split at gaps
    (pipe_mux: only video and audio); auto follows merge_plan.
    """
    kind = merger_kind(o)
    if kind == "skip":
        skip(outcomes)
        return None
    name = F.concat(stem, L("."), F.col("stream_id").cast("string"), L("."), ext)
    if kind == "auto":
        return execute_merge(outcomes, ["presentation"], "stream_id", ["sequence"], "success", "kind", "data", name, mux).where("path is not null").select("path", "bytes")
    rows = outcomes.where(F.col("kind").isin("video", "audio", "mpeg-ts", "mp4", "aac")) if kind == "pipe_mux" else outcomes
    parts = islands(rows, ["presentation", "stream_id"], [F.col("sequence")], "success", collapse=True)
    named = parts.withColumn("_path", F.concat(stem, L("."), F.col("stream_id").cast("string"), L("."), F.col("part").cast("string"), L("."), ext))
    return write_concatenated(named, "_path", ["sequence"], "data").withColumnRenamed("_path", "path")


def overlay_playlists(playlists: DataFrame, o: Options) -> DataFrame:
    """Playlist descriptors (title, playlist_url, key, headers array, cookies array) under the options: a file name from the title, the options' key
    where the descriptor has none, lists put together."""
    from ..functions.columns import safe_filename

    given = lambda xs: F.array(*map(L, xs)).cast("array<string>")
    empty = F.array().cast("array<string>")
    return playlists.select(
        "playlist_url", F.coalesce(L(o.output), safe_filename(F.col("title")), L("output")).alias("output"), F.coalesce("key", L(o.key)).alias("key"),
        F.concat(given(o.headers), F.coalesce("headers", empty)).alias("headers"), F.concat(given(o.cookies), F.coalesce("cookies", empty)).alias("cookies"),
    )
