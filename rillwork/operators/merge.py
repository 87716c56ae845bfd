"""Assembling fetched segments: order, gaps, duplicates, concatenation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import CONCAT_KINDS

L = F.lit


def keep_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by `order` (total within a key). An aggregation, so repeated keys cost no sort."""
    from .select import top_row

    return top_row(df, key, order)


def not_staged(df: DataFrame, staged: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not staged yet: what is left to fetch after an interrupted run."""
    return df.join(staged.select(*key).distinct(), key, "left_anti")


def islands(df: DataFrame, stream: list[str], order: list, ok: str, collapse: bool = False, out: str = "part") -> DataFrame:
    """The good rows with the number of the part they belong to; a failed row ends a part.

    Each failure starts a new number, so runs of failures leave numbers unused; with `collapse` parts are numbered 0, 1, 2. Failures at the end start none.
    """
    w = Window.partitionBy(*stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    good = df.withColumn("_f", F.count_if(~F.col(ok)).over(w)).where(F.col(ok))
    if collapse:
        return good.withColumn(out, (F.dense_rank().over(Window.partitionBy(*stream).orderBy("_f")) - 1).cast("bigint")).drop("_f")
    return good.withColumnRenamed("_f", out)


def trim_trailing(df: DataFrame, stream: list[str], order: Column, ok: str) -> DataFrame:
    """Without the failures after the last good row of each stream; streams without good rows vanish."""
    last = F.max(F.when(F.col(ok), order)).over(Window.partitionBy(*stream))
    return df.withColumn("_last", last).where(order <= F.col("_last")).drop("_last")


def concat_text(df: DataFrame, group: list[str], order: list[str], text: str, out: str = "content") -> DataFrame:
    """Texts of each group joined in order. The groups are what is written as one file, so a group fits in a task by definition."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_x"))))
    return df.groupBy(*group).agg(F.array_join(F.transform(items, lambda s: s["_x"]), "").alias(out))


def concat_binary(df: DataFrame, group: list[str], order: list[str], data: str, out: str = "data") -> DataFrame:
    """Payloads of each group joined in order, as one value: for groups of up to 2 GB, the bound of a value. write_concatenated has none."""
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([*[df.schema[g] for g in group], StructField(out, BinaryType())])

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by([(o, "ascending") for o in order])
        whole = b"".join(x for x in t.column(data).to_pylist() if x is not None)
        return pa.table([*[t.column(g).slice(0, 1) for g in group], pa.array([whole], pa.binary())], names=schema.names)

    return df.select(*group, *[o for o in order if o not in group], data).groupBy(*group).applyInArrow(join, schema)


def write_concatenated(df: DataFrame, path: str, order: list[str], data: str) -> DataFrame:
    """Writes the payloads of each value of df.path into that file, in order; (path, bytes) of the files. Runs when the result is used.

    A file of any size goes through its task in batches and is renamed into place when it is whole, so a repeated task leaves a whole
    file and a lost one none. Files lie in a folder that all executors share.
    """
    import os
    from collections.abc import Iterator

    import pyarrow as pa

    rows = df.select(path, *order, data).repartition(F.col(path)).sortWithinPartitions(path, *order).select(path, data)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        at, part, f, size = None, "", None, 0

        def close():
            f.close()
            os.replace(part, at.removeprefix("file://"))
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([size], pa.int64())], names=["path", "bytes"])

        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1)):
                if p != at:
                    if f is not None:
                        yield close()
                    at, size = p, 0
                    name = p.removeprefix("file://")
                    os.makedirs(os.path.dirname(name), exist_ok=True)
                    part = f"{name}.{uuid.uuid4().hex[:8]}.part"
                    f = open(part, "wb")  # noqa: SIM115  closed where the next file begins
                if x.is_valid:
                    size += f.write(x.as_buffer())
        if f is not None:
            yield close()

    return rows.mapInArrow(write, "path string, bytes bigint")


def merge_plan(df: DataFrame, group: list[str], stream: str, ok: str, kind: str) -> DataFrame:
    """Per presentation: what a merge would do: `skip` with any failure, `mux` with several tracks or one that cannot be concatenated, else `concat`."""
    per = df.groupBy(*group, stream).agg(F.bool_or(~F.col(ok)).alias("_bad"), F.bool_and(F.col(kind).isin(*CONCAT_KINDS)).alias("_cat"))
    action = F.when(F.bool_or("_bad"), "skip").when((F.count("*") > 1) | ~F.bool_and("_cat"), "mux").otherwise("concat")
    return per.groupBy(*group).agg(F.count("*").alias("tracks"), action.alias("action"))


def execute_merge(df: DataFrame, group: list[str], stream: str, order: list[str], ok: str, kind: str, data: str, path: Column, mux: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Carries a merge_plan out: (group, action, path, bytes) of what was written. `path` is the file of a stream's payload.

    `skip` presentations write nothing and have null in both; tracks of `mux` presentations are written one file each and then handed to `mux`, a function
    from (group, stream, path, bytes) to rows of the same columns, where one is given: joining containers is the business of an outside tool.
    """
    plan = merge_plan(df, group, stream, ok, kind)
    rows = df.join(plan.select(*group, "action"), group)
    made = rows.where("action <> 'skip'").withColumn("_path", path)
    names = made.select(*group, stream, "action", "_path").distinct()
    wrote = names.join(write_concatenated(made, "_path", order, data).withColumnRenamed("path", "_path"), "_path")
    tracks = wrote.select(*group, stream, "action", F.col("_path").alias("path"), "bytes")
    if mux is not None:
        joined = mux(tracks.where("action = 'mux'").drop("action")).withColumn("action", L("mux"))
        tracks = tracks.where("action <> 'mux'").unionByName(joined)
    none = plan.where("action = 'skip'").select(*group, "action", L(None).cast("string").alias("path"), L(None).cast("bigint").alias("bytes"))
    return tracks.select(*group, "action", "path", "bytes").unionByName(none)


def interleave(df: DataFrame, group: list[str], stream: str, order: list, out: str = "position") -> DataFrame:
    """Round robin over the streams of a group: first of each, second of each and so on; streams that are through drop out."""
    turn = df.withColumn("_turn", F.row_number().over(Window.partitionBy(*group, stream).orderBy(*order)))
    w = Window.partitionBy(*group) if group else Window.partitionBy(L(0))
    return turn.withColumn(out, (F.row_number().over(w.orderBy("_turn", stream)) - 1).cast("bigint")).drop("_turn")


def zipped(left: DataFrame, right: DataFrame, left_order: list, right_order: list, group: list[str]) -> DataFrame:
    """Rows of both sides side by side by their place in the group; what has no partner is left out."""
    def ranked(df: DataFrame, order: list) -> DataFrame:
        return df.withColumn("_i", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))

    return ranked(left, left_order).join(ranked(right, right_order), [*group, "_i"]).drop("_i")


def output_names(df: DataFrame, group: list[str], part: str, stem: Column, ext: Column, out: str = "file") -> DataFrame:
    """stem.ext for a group with one part, stem.N.ext with several."""
    several = F.count("*").over(Window.partitionBy(*group)) > 1
    return df.withColumn(out, F.when(several, F.concat(stem, L("."), F.col(part).cast("string"), L("."), ext)).otherwise(F.concat(stem, L("."), ext)))


def progress(df: DataFrame, group: list[str], ok: str, name: str) -> DataFrame:
    """Per group: total, fetched, failed, percent done and the sorted names of what failed.

    Only failures are collected: of a group with many, as many as there are; their number bounds the list, not the group.
    """
    done = F.count(ok)
    return df.groupBy(*group).agg(
        F.count("*").alias("total"), F.count_if(F.col(ok)).alias("fetched"), F.count_if(~F.col(ok)).alias("failed"),
        F.when(F.count("*") == 0, 0.0).otherwise(done * 100.0 / F.count("*")).cast("double").alias("percent"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col(ok), F.col(name)))), ",").alias("failed_names"),
    )


def with_cached_file(segments: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """Segments with the file that already holds them; those without one have null. files: key columns, path; the first path of several counts."""
    return segments.join(files.groupBy(*key).agg(F.min("path").alias("cached_path")), key, "left")


def output_streams(tracks: DataFrame, group: list[str], order: list, kind: str, kept: tuple[str, ...] = ("video", "audio", "subtitle")) -> DataFrame:
    """Tracks with `output_index`, their place among the kept kinds of their group; tracks of other kinds are dropped."""
    return tracks.where(F.col(kind).isin(*kept)).withColumn("output_index", (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("bigint"))


def last_emitted(df: DataFrame, group: list[str], order: Column, start: str, out: str = "last") -> DataFrame:
    """The start of the segment emitted last, not the latest start: a later stream may begin earlier."""
    return df.groupBy(*group).agg(F.max_by(start, order).alias(out))
