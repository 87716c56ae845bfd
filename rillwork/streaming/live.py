"""Live manifests as streams: the offset is the high-water mark of each stream, and each poll is kept until it is committed."""

from __future__ import annotations

import json
import os
import re
import threading
import time
from collections.abc import Callable
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.query import StreamingQuery


def parse_media(text: str, url: str) -> tuple[list[tuple[int, str, float | None]], bool]:
    """((media sequence, address, seconds) of the segments, has it ended) of a media playlist; for the poller on the driver."""
    base = int(m.group(1)) if (m := re.search(r"^#EXT-X-MEDIA-SEQUENCE:\s*(\d+)", text, re.M)) else 0
    rows, seconds = [], None
    for line in (x.strip() for x in text.splitlines()):
        if line.startswith("#EXTINF:"):
            m = re.match(r"#EXTINF:\s*([0-9.]+)", line)
            seconds = float(m.group(1)) if m else None
        elif line and not line.startswith("#"):
            rows.append((base + len(rows), urljoin(url, line), seconds))
            seconds = None
    return rows, "#EXT-X-ENDLIST" in text


class _Journal:
    """Rows of polls by the offset they begin at, in a folder that outlives the driver: a replayed batch is what was read, not what is there now."""

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")
        os.makedirs(self.folder, exist_ok=True)

    def _at(self, start: dict) -> str:
        import zlib

        return f"{self.folder}/{zlib.crc32(json.dumps(start, sort_keys=True).encode()):08x}-{start.get('n', 0)}.json"

    def keep(self, start: dict, end: dict, rows: list[tuple]) -> None:
        path = self._at(start)
        with open(f"{path}.part", "w") as f:
            json.dump({"start": start, "end": end, "rows": rows}, f)
        os.replace(f"{path}.part", path)

    def replay(self, start: dict) -> tuple[dict, list[tuple]] | None:
        try:
            with open(self._at(start)) as f:
                kept = json.load(f)
        except FileNotFoundError:
            return None
        return (kept["end"], [tuple(r) for r in kept["rows"]]) if kept["start"] == start else None

    def forget(self, end: dict) -> None:
        for name in os.listdir(self.folder):
            if name.endswith(".json") and int(name.rsplit("-", 1)[1][:-5]) < end.get("n", 0):
                os.remove(f"{self.folder}/{name}")


class _Polling(SimpleDataSourceStreamReader):
    """Polls with an offset {"n": number of the poll, "marks": mark by stream}; every poll is journalled before its rows are given."""

    def __init__(self, journal: str):
        self.journal = _Journal(journal)

    def poll(self, marks: dict) -> tuple[list[tuple], dict]:
        raise NotImplementedError

    def initialOffset(self) -> dict:
        return {"n": 0, "marks": {}}

    def read(self, start: dict):
        rows, marks = self.poll(start["marks"])
        end = {"n": start["n"] + 1, "marks": marks} if rows else start
        if rows:
            self.journal.keep(start, end, rows)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        """The rows of the polls from start to end as they were read; a poll that was never journalled was never given to anybody."""
        at, out = start, []
        while at != end:
            kept = self.journal.replay(at)
            if kept is None:
                raise RuntimeError(f"poll {at['n']} is not in the journal {self.journal.folder}")
            at, rows = kept
            out.extend(rows)
        return iter(out)

    def commit(self, end: dict) -> None:
        # the poll before the committed one may still be asked for after a restart
        self.journal.forget({"n": end["n"] - 1})


class LivePlaylists(DataSource):
    """spark.readStream.format("live_playlists").option("urls", newline separated).option("journal", folder): (stream_id, media_sequence, uri, duration, ended).

    Each micro-batch polls the playlists and gives what is beyond the mark of its stream. A playlist that cannot be read in `attempts` tries
    gives nothing this time. Addresses go through the fetch module's opener.
    """

    @classmethod
    def name(cls) -> str:
        return "live_playlists"

    def schema(self) -> str:
        return "stream_id bigint, media_sequence bigint, uri string, duration double, ended boolean"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Playlists(self.options["urls"].split("\n"), int(self.options.get("attempts", "3")), self.options["journal"])


class _Playlists(_Polling):
    def __init__(self, urls: list[str], attempts: int, journal: str):
        super().__init__(journal)
        self.urls, self.attempts = urls, attempts

    def _read(self, url: str) -> tuple[list, bool]:
        from rillwork.operators.fetch import file_opener

        for _ in range(self.attempts):
            try:
                return parse_media(file_opener(url, None, {}).decode(), url)
            except OSError:
                continue
        return [], False

    def poll(self, marks: dict) -> tuple[list[tuple], dict]:
        rows, now = [], dict(marks)
        for i, url in enumerate(self.urls):
            segments, ended = self._read(url)
            for n, uri, seconds in segments:
                if n > marks.get(str(i), -1):
                    rows.append((i, n, uri, seconds, ended))
                    now[str(i)] = max(now.get(str(i), -1), n)
        return rows, now


class LiveManifests(DataSource):
    """spark.readStream.format("live_manifests").option("urls", ...).option("journal", folder): (url, content, now_us, since_us) of each refreshed manifest.

    A manifest is given again when its text has changed or its update period has passed. since_us is the time of the refresh before, the cursor of what was
    planned then (null the first time); both are part of the offset, so a restart goes on where it was. dash.live_plan turns rows into segments.
    """

    @classmethod
    def name(cls) -> str:
        return "live_manifests"

    def schema(self) -> str:
        return "url string, content string, now_us bigint, since_us bigint"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Manifests(self.options["urls"].split("\n"), int(self.options.get("attempts", "3")), self.options["journal"], self.options.get("clock", ""))


def update_period_us(text: str) -> int:
    """minimumUpdatePeriod of a manifest, two seconds where it says none."""
    m = re.search(r'minimumUpdatePeriod\s*=\s*"PT(?:(\d+)H)?(?:(\d+)M)?(?:([\d.]+)S)?"', text)
    return int(sum(float(x or 0) * k for x, k in zip(m.groups(), (3600, 60, 1))) * 1_000_000) if m else 2_000_000


class _Manifests(_Polling):
    def __init__(self, urls: list[str], attempts: int, journal: str, clock: str):
        super().__init__(journal)
        self.urls, self.attempts, self.clock = urls, attempts, clock

    def _now(self) -> int:
        if self.clock:
            with open(self.clock) as f:
                return int(f.read())
        return time.time_ns() // 1000

    def poll(self, marks: dict) -> tuple[list[tuple], dict]:
        import zlib

        from rillwork.operators.fetch import file_opener

        rows, then, now = [], dict(marks), self._now()
        for i, url in enumerate(self.urls):
            text = None
            for _ in range(self.attempts):
                try:
                    text = file_opener(url, None, {}).decode()
                    break
                except OSError:
                    continue
            before, digest = marks.get(str(i)), zlib.crc32((text or "").encode())
            if text is None or (before and before[1] == digest and now - before[0] < update_period_us(text)):
                continue
            rows.append((url, text, now, before[0] if before else None))
            then[str(i)] = [now, digest]
        return rows, then


def _source(spark: SparkSession, source: type[DataSource], urls: list[str], journal: str | None, attempts: int, **options: str) -> DataFrame:
    from ..session import work_path

    spark.dataSource.register(source)
    reader = spark.readStream.format(source.name()).option("urls", "\n".join(urls)).option("attempts", str(attempts)).option("journal", journal or work_path(spark, "journal"))
    return reader.options(**options).load()


def live_segments(spark: SparkSession, urls: list[str], attempts: int = 3, journal: str | None = None) -> DataFrame:
    """Segments of live playlists as a stream. Give the same `journal` folder again after a restart with the same checkpoint."""
    return _source(spark, LivePlaylists, urls, journal, attempts)


def live_manifests(spark: SparkSession, urls: list[str], attempts: int = 3, journal: str | None = None, clock: str = "") -> DataFrame:
    """Refreshed manifests as a stream; `clock` is a file with the time in microseconds, for tests."""
    return _source(spark, LiveManifests, urls, journal, attempts, **({"clock": clock} if clock else {}))


def wait_seconds(durations: dict[int, list[float]], low: float = 1.0, high: float = 5.0) -> float:
    """How long to wait before the next poll: the least mean segment duration of any stream, between `low` and `high`."""
    means = [sum(d) / len(d) if d else 0.0 for d in durations.values()]
    return min(max(min(means, default=high), low), high)


def follow_live(spark: SparkSession, urls: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, attempts: int = 3, stop: threading.Event | None = None, most_idle: float = 30.0) -> StreamingQuery:
    """Polls until every playlist has ended, `stop` is set or nothing came for `most_idle` seconds; the stopped query.

    The pause between polls follows the segments' durations; a stop lets the batch that runs finish. `sink` gets each batch, as in foreachBatch.
    """
    ended: set[int] = set()
    durations: dict[int, list[float]] = {}
    last = [time.monotonic()]

    def batch(df: DataFrame, n: int) -> None:
        df.persist()
        sink(df, n)
        per = df.groupBy("stream_id").agg({"duration": "avg", "ended": "max"}).collect()  # a row per stream
        for r in per:
            durations[r["stream_id"]] = [r["avg(duration)"] or 0.0]
            if r["max(ended)"]:
                ended.add(r["stream_id"])
        if per:
            last[0] = time.monotonic()
        df.unpersist()

    stream = live_segments(spark, urls, attempts, f"{checkpoint}/journal")
    while True:
        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{checkpoint}/query").trigger(processingTime=f"{wait_seconds(durations):.3f} seconds").start()
        began, pause = time.monotonic(), wait_seconds(durations)
        while query.isActive and len(ended) < len(urls) and not (stop and stop.is_set()) and time.monotonic() - last[0] < most_idle:
            time.sleep(0.1)
            if abs(wait_seconds(durations) - pause) > 0.5 and time.monotonic() - began > 1 and not query.status["isTriggerActive"]:
                break
        done = not query.isActive or len(ended) >= len(urls) or (stop and stop.is_set()) or time.monotonic() - last[0] >= most_idle
        for _ in range(600):  # the batch that runs is finished first
            if not query.isActive or not query.status["isTriggerActive"]:
                break
            time.sleep(0.1)
        query.stop()
        if query.exception() is not None:
            raise query.exception()
        if done:
            return query
