"""Manifests, existing segment files, ranged files and inline texts as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import chunk_bounds, file_format, manifest_kind

L = F.lit
SEGMENT = "stream_id bigint, sequence bigint, uri string, file_name string, format struct<kind:string,ext:string>, byte_range struct<offset:bigint,length:bigint>"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(url, content, kind) of manifest files, one row per file."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("content"))
    return rows.withColumn("kind", manifest_kind(F.col("url"), L(None).cast("string"), F.col("content")))


def existing_files(spark: SparkSession, path: str, stream_id: int = 0) -> DataFrame:
    """Segments out of the files of a folder, in the order of their paths; hidden files are left out, contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path").where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[._]"))
    w = Window.partitionBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1)).orderBy("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(L(stream_id).cast("bigint").alias("stream_id"), (F.row_number().over(w) - 1).cast("bigint").alias("sequence"), F.col("path").alias("uri"), name.alias("file_name"), file_format(name).alias("format"))


def ranged_file(spark: SparkSession, url: str, length: int | None, accepts_ranges: bool, chunk: int = 2 << 20) -> DataFrame:
    """Chunks of one file if the server takes ranges and its length is known and not 0, else one row for all of it."""
    if not accepts_ranges or not length:
        return spark.createDataFrame([(0, 0, url, None)], "stream_id bigint, sequence bigint, uri string, byte_range struct<offset:bigint,length:bigint>")
    one = spark.range(1).select(F.explode(chunk_bounds(L(length).cast("bigint"), chunk)).alias("c"))
    return one.select(L(0).cast("bigint").alias("stream_id"), F.col("c.n").alias("sequence"), L(url).alias("uri"), F.struct("c.offset", "c.length").alias("byte_range"))


def inline_text(spark: SparkSession, text: str, ext: str = "txt") -> DataFrame:
    """One segment that holds its text."""
    return spark.createDataFrame([(0, 0, f"data.{ext}", text)], "stream_id bigint, sequence bigint, file_name string, content string")


def read_config(path: str) -> dict:
    """A TOML file, on the driver."""
    import tomllib

    with open(path, "rb") as f:
        return tomllib.load(f)
