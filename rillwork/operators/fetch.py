"""Fetching segments: bounded parallelism, recorded attempts, idempotent staging."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import keep_first, not_staged

Opener = Callable[[str, "tuple[int, int | None] | None", "dict[str, str]"], bytes]


def file_opener(url: str, byte_range: tuple[int, int | None] | None, headers: dict[str, str]) -> bytes:
    """Local files and HTTP(S) addresses with the standard library; anything but a 2xx answer is an error."""
    from urllib.parse import unquote, urlsplit
    from urllib.request import Request, urlopen

    if url.startswith("file://") or "://" not in url:
        with open(unquote(urlsplit(url).path) if "://" in url else url, "rb") as f:
            if byte_range:
                f.seek(byte_range[0])
                return f.read(-1 if byte_range[1] is None else byte_range[1])
            return f.read()
    extra = {} if not byte_range else {"Range": f"bytes={byte_range[0]}-" + ("" if byte_range[1] is None else str(byte_range[0] + byte_range[1] - 1))}
    with urlopen(Request(url, headers={**headers, **extra}), timeout=10) as r:
        if not 200 <= r.status < 300:
            raise OSError(f"status {r.status}")
        return r.read()


_OUTCOME = "stream_id bigint, sequence bigint, success boolean, attempts int, error string, data binary"
_ARROW = pa.schema([("stream_id", pa.int64()), ("sequence", pa.int64()), ("success", pa.bool_()), ("attempts", pa.int32()), ("error", pa.string()), ("data", pa.binary())])
#: Outcomes are handed on when so many, or so many bytes of data, are there.
MOST_ROWS, MOST_BYTES = 2_000, 4 << 20


def fetch_segments(segments: DataFrame, opener: Opener = file_opener, parallelism: int = 5, attempts: int = 3) -> DataFrame:
    """One outcome per segment (stream_id, sequence, uri[, byte_range struct(offset, length)][, headers map]): success, attempts, error, data.

    At most `parallelism` segments are fetched at once, one per partition. A failure is a row, never an exception, so a lost task
    repeats only reads. attempts below 1 counts as 1.
    """
    tries = max(1, attempts)
    has_range, has_headers = "byte_range" in segments.columns, "headers" in segments.columns
    rows = segments.select(
        F.col("stream_id").cast("bigint"), F.col("sequence").cast("bigint"), F.col("uri").cast("string"),
        *([F.col("byte_range.offset").cast("bigint").alias("_o"), F.col("byte_range.length").cast("bigint").alias("_l")] if has_range else [F.lit(None).cast("bigint").alias("_o"), F.lit(None).cast("bigint").alias("_l")]),
        (F.to_json("headers") if has_headers else F.lit(None).cast("string")).alias("_h"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        out, size = [], 0
        for batch in batches:
            for s, n, uri, o, length, h in zip(*(c.to_pylist() for c in batch.columns)):
                done, error, data = False, None, None
                span = None if o is None else (o, length)
                for k in range(1, tries + 1):
                    try:
                        data, done, error = opener(uri, span, json.loads(h) if h else {}), True, None
                        break
                    except Exception as e:  # noqa: BLE001  whatever the opener raises is an outcome
                        error = f"{type(e).__name__}: {e}"
                out.append((s, n, done, k, error, data))
                size += len(data or b"")
                if len(out) >= MOST_ROWS or size >= MOST_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

    return rows.repartition(parallelism).mapInArrow(run, _OUTCOME)


def fetch_texts(urls: DataFrame, url: str, opener: Opener = file_opener, parallelism: int = 5, attempts: int = 3) -> DataFrame:
    """(url, content, attempts, error kind, error) of each distinct address: manifests and keys, whole. Failures are rows whose kind is `status`, `missing`, `network` or `other`."""
    one = urls.where(F.col(url).isNotNull()).select(F.col(url).alias("uri")).distinct().withColumn("stream_id", F.xxhash64("uri")).withColumn("sequence", F.lit(0).cast("bigint"))
    got = fetch_segments(one, opener, parallelism, attempts)
    kind = F.when(F.col("success"), F.lit(None)).when(F.col("error").contains("status "), "status").when(F.col("error").contains("HTTPError"), "status").when(F.col("error").rlike("^(FileNotFound|KeyError)"), "missing").when(F.col("error").rlike("^(URLError|Timeout|Connection|OSError)"), "network").otherwise("other")
    return one.join(got, ["stream_id", "sequence"]).select(F.col("uri").alias("url"), F.col("data").alias("content"), "attempts", kind.alias("error_kind"), "error")


@dataclass(frozen=True)
class Download:
    """How to fetch and what to do with the result; immutable, each setter gives a new one."""

    parallelism: int = 5
    attempts: int = 3
    opener: Opener = file_opener
    staging: str | None = None

    def with_parallelism(self, n: int) -> Download:
        return replace(self, parallelism=n)

    def with_attempts(self, n: int) -> Download:
        return replace(self, attempts=n)

    def with_opener(self, opener: Opener) -> Download:
        return replace(self, opener=opener)

    def staged_at(self, path: str) -> Download:
        return replace(self, staging=path)

    def _staged(self, spark) -> DataFrame | None:
        """What is staged, one row per segment, good ones before failures; None where the folder does not exist yet. Other errors of reading are errors."""
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.staging)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        rows = spark.read.schema(_OUTCOME).parquet(self.staging)
        return keep_first(rows, ["stream_id", "sequence"], [~F.col("success"), F.col("attempts"), F.coalesce("error", F.lit(""))])

    def run(self, segments: DataFrame) -> DataFrame:
        """Outcomes of the segments asked for, one each; with a staging folder only those without a good row there are fetched.

        A segment that failed in an earlier run and is there now has its good row only; rows that other runs staged are not returned.
        """
        if not self.staging:
            return fetch_segments(segments, self.opener, self.parallelism, self.attempts)
        staged = self._staged(segments.sparkSession)
        todo = segments if staged is None else not_staged(segments, staged.where("success"), ["stream_id", "sequence"])
        fetch_segments(todo, self.opener, self.parallelism, self.attempts).write.mode("append").partitionBy("stream_id").parquet(self.staging)
        return self._staged(segments.sparkSession).join(segments.select("stream_id", "sequence").distinct(), ["stream_id", "sequence"], "left_semi")

    def recycle(self, spark, done: DataFrame) -> None:
        """Forgets the staged payloads of segments (stream_id, sequence) that were handed on: the folders of streams with any are written anew without them.

        A stream's new folder is whole before the old one goes.
        """
        staged = self._staged(spark)
        if staged is None:
            return
        hit = [r[0] for r in done.select("stream_id").distinct().collect()]  # one row per stream
        left = staged.where(F.col("stream_id").isin(hit)).join(done.select("stream_id", "sequence").distinct(), ["stream_id", "sequence"], "left_anti")
        fresh = f"{self.staging.rstrip('/')}-recycled"
        left.write.mode("overwrite").partitionBy("stream_id").parquet(fresh)
        jvm = spark._jvm
        Path = jvm.org.apache.hadoop.fs.Path
        fs = Path(self.staging).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for s in hit:
            fs.delete(Path(f"{self.staging}/stream_id={s}"), True)
            fs.rename(Path(f"{fresh}/stream_id={s}"), Path(f"{self.staging}/stream_id={s}"))
        fs.delete(Path(fresh), True)
