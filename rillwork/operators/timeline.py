"""Segment timelines: counters, byte ranges, forward fills, expansion of runs, windows of availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

L = F.lit


def _w(partition: list[str], order: list):
    return Window.partitionBy(*partition).orderBy(*order)


def numbered(df: DataFrame, partition: list[str], order: list, out: str = "sequence", start: Column | int = 0) -> DataFrame:
    """Rows of each partition numbered from `start`."""
    return df.withColumn(out, (F.row_number().over(_w(partition, order)) - 1 + start).cast("bigint"))


def fill_forward(df: DataFrame, partition: list[str], order: list, column: str, out: str | None = None) -> DataFrame:
    """The last non-null value so far: keys and initialisation maps stay in force until the next."""
    w = _w(partition, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out or column, F.last(F.col(column), ignorenulls=True).over(w))


def byte_offsets(df: DataFrame, partition: list[str], order: list, length: str, explicit: str, out: str = "offset") -> DataFrame:
    """Start of each byte range: the explicit one, else where the one before ended; a row without a length ends the run and has none.

    Ranges before the first explicit one count from 0.
    """
    w = _w(partition, order)
    runs = df.withColumn("_run", F.sum((F.col(explicit).isNotNull() | F.col(length).isNull()).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = _w([*partition, "_run"], order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.first(F.col(explicit), ignorenulls=True).over(_w([*partition, "_run"], order).rowsBetween(Window.unboundedPreceding, 0))
    at = F.coalesce(first, L(0)) + F.coalesce(F.sum(length).over(inside), L(0))
    return runs.withColumn(out, F.when(F.col(length).isNotNull(), at)).drop("_run")


def slice_range(df: DataFrame, sequence: str, first: int = 1, last: int | None = None) -> DataFrame:
    """Segments number first..last of their stream, counted from 1, both included."""
    n = F.col(sequence) + 1
    return df.where((n >= first) & (n <= last) if last is not None else n >= first)


def beyond_mark(df: DataFrame, marks: DataFrame, stream: str, sequence: str, mark: str) -> DataFrame:
    """Segments beyond the high-water mark of their stream; a stream without a mark keeps all."""
    m = marks.select(stream, F.col(mark).alias("_mark"))
    return df.join(m, stream, "left").where(F.col("_mark").isNull() | (F.col(sequence) > F.col("_mark"))).drop("_mark")


def new_marks(seen: DataFrame, marks: DataFrame, stream: str, sequence: str, order: str, mark: str) -> DataFrame:
    """The sequence of each stream's last segment, else its old mark."""
    last = seen.groupBy(stream).agg(F.max_by(sequence, order).alias("_last"))
    return marks.join(last, stream, "full").select(stream, F.coalesce("_last", mark).alias(mark))


def poll_interval_ms(df: DataFrame, stream: list[str], seconds: str, low: int = 1000, high: int = 5000) -> DataFrame:
    """One row `interval_ms`: the least mean segment duration of any stream, between `low` and `high`; a stream without durations counts as 0.

    No stream at all gives `high`.
    """
    per = df.groupBy(*stream).agg(F.coalesce(F.floor(F.sum(F.col(seconds).cast("decimal(18,6)")) * 1000 / F.count(seconds)), L(0)).cast("bigint").alias("_ms"))
    return per.agg(F.least(F.greatest(F.coalesce(F.min("_ms"), L(high)), L(low)), L(high)).cast("bigint").alias("interval_ms"))


def period_starts(df: DataFrame, partition: list[str], order: list, start: str, duration: str, out: str = "period_start") -> DataFrame:
    """Start of each period: the explicit one, else the start of the one before plus its duration.

    A missing duration is the next explicit start less the own start. A chain whose durations are unknown is null until the next explicit start.
    """
    w = _w(partition, order)
    following = F.lead(start).over(w)
    d = df.withColumn("_d", F.coalesce(F.col(duration), F.when(F.col(start).isNotNull(), following - F.col(start))))
    runs = d.withColumn("_run", F.count(start).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = _w([*partition, "_run"], order).rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.first(F.col(start), ignorenulls=True).over(_w([*partition, "_run"], order).rowsBetween(Window.unboundedPreceding, 0)), L(0))
    unknown = F.coalesce(F.max(F.col("_d").isNull().cast("int")).over(before), L(0)) == 1
    return runs.withColumn(out, F.when(~unknown, base + F.coalesce(F.sum("_d").over(before), L(0)))).withColumn("period_duration", F.col("_d")).drop("_d", "_run")


def expand_runs(df: DataFrame, partition: list[str], order: list, start: str | None, ticks: str, repeat: str, first_number: Column | int = 0) -> DataFrame:
    """One row per segment of run-length entries: `time` and `number`.

    An entry stands for repeat + 1 segments of `ticks`; an explicit start resets the clock, otherwise it goes on where the entry before ended.
    A null repeat is 0; a negative one gives no segments (resolve_open_repeats turns those that mean "until the end" into numbers first).
    """
    w = _w(partition, order)
    count = F.greatest(F.coalesce(F.col(repeat), L(0)) + 1, L(0)).cast("bigint")
    given = F.col(start) if start else L(None).cast("bigint")
    d = df.withColumn("__n", count).withColumn("__t", given).withColumn("__run", F.count("__t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = _w([*partition, "__run"], order)
    base = F.coalesce(F.first("__t", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), L(0))
    d = d.withColumn("__base", base + F.coalesce(F.sum(F.col("__n") * F.col(ticks)).over(inside.rowsBetween(Window.unboundedPreceding, -1)), L(0)))
    d = d.withColumn("__before", F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), L(0)))
    steps = F.when(F.col("__n") > 0, F.sequence(L(0).cast("bigint"), F.col("__n") - 1)).otherwise(F.array().cast("array<bigint>"))
    return (
        d.withColumn("__i", F.explode(steps))
        .withColumn("time", (F.col("__base") + F.col("__i") * F.col(ticks)).cast("bigint"))
        .withColumn("number", (F.col("__before") + F.col("__i") + first_number).cast("bigint"))
        .drop("__n", "__t", "__run", "__base", "__before", "__i")
    )


def resolve_open_repeats(df: DataFrame, partition: list[str], order: list, start: str, ticks: str, repeat: str, end_ticks: str) -> DataFrame:
    """Negative repeats as numbers: until the next explicit start, else until `end_ticks`. The entry itself must have an explicit start."""
    until = F.coalesce(F.lead(start).over(_w(partition, order)), F.col(end_ticks))
    n = F.ceil((until - F.col(start)) / F.col(ticks)).cast("bigint") - 1
    return df.withColumn(repeat, F.when(F.col(repeat) < 0, n).otherwise(F.col(repeat)))


def nominal_count(seconds: Column, timescale: Column, duration: Column) -> Column:
    """Segments of nominal duration that a period of `seconds` holds."""
    return F.ceil(seconds * timescale / duration).cast("bigint")


def expand_nominal(df: DataFrame, count: Column, first_number: Column, duration: Column, skip: Column | None = None) -> DataFrame:
    """`number` and `time` (ticks) of segments of equal nominal duration; the first `skip` are not generated at all."""
    n, low = count.cast("bigint"), L(0).cast("bigint") if skip is None else F.greatest(skip.cast("bigint"), L(0).cast("bigint"))
    steps = F.when(n > low, F.sequence(low, n - 1)).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("_i", F.explode(steps)).withColumn("number", (first_number + F.col("_i")).cast("bigint")).withColumn("time", F.floor(F.col("_i") * duration).cast("bigint")).drop("_i")


def available(start: Column, now: Column, offset: Column | None = None, delay: Column | None = None, buffer: Column | None = None, since: Column | None = None, inclusive: bool = True) -> Column:
    """Is a segment start inside the availability window?

    Not after now + offset - delay; not before now - buffer; at or after `since` on the first load, after it on later ones.
    """
    end = now if offset is None else now + offset
    end = end if delay is None else end - delay
    ok = start <= end
    low = None if buffer is None else now - buffer
    for bound in (low, since):
        if bound is not None:
            ok = ok & (bound.isNull() | ((start >= bound) if inclusive else (start > bound)))
    return ok


def rescale(ticks: Column, from_rate: Column, to_rate: Column) -> Column:
    """Ticks of one rate in another, rounded to the nearest; rates are ticks a second."""
    return F.round(ticks * to_rate / from_rate).cast("bigint")


def total_offset(df: DataFrame, period: list[str], offset: str) -> DataFrame:
    """Sum of the availability offsets of the adaptation sets of each period; none counts as 0."""
    return df.groupBy(*period).agg(F.coalesce(F.sum(offset), L(0)).alias("offset"))


def within_period(start: Column, period_start: Column, duration: Column) -> Column:
    """Before the end of the period; an open period has none."""
    return duration.isNull() | (start < period_start + duration)


def marquee_ends(df: DataFrame, stream: list[str], time: str, order: str, operator: str, reach: int = 1400, stay: int = 800, bucket: int = 30_000) -> DataFrame:
    """Operator rows with `until`: the time of the next operator row, or the own time plus `stay` if a row more than `reach` later comes before one.

    Rows that nothing follows are not emitted, nor are rows without a time. Two questions are asked of the rows in time order, by frames that only grow:
    which operator row is next, and, of a probe at time + reach + 1 for each operator row, which row is next. Streams are cut into buckets
    of time, so a stream of any length is spread over tasks; what a bucket does not know comes from one summary row per later bucket.
    """
    at = F.col(time)
    rows = df.where(at.isNotNull()).select(*stream, at.alias("_t"), F.col(order).alias("_o"), F.coalesce(F.col(operator), L(False)).alias("_op"))
    ops = rows.where("_op").distinct()
    data = rows.select(*stream, "_t", "_o", "_op", L(False).alias("_probe"), "_t", F.col("_o").alias("_key")).toDF(*stream, "_t", "_o", "_op", "_probe", "_own", "_key")
    probes = ops.select(*stream, (F.col("_t") + reach + 1).alias("_t"), "_o", L(False).alias("_op"), L(True).alias("_probe"), F.col("_t").alias("_own"), F.col("_o").alias("_key"))
    both = data.unionByName(probes).withColumn("_b", F.floor(F.col("_t") / bucket))
    # latest first; of equal times a probe comes last, so it sees the rows at its own time
    w = _w([*stream, "_b"], [F.desc("_t"), "_probe", F.desc("_o")]).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("_next_op", F.last(F.when(F.col("_op"), F.col("_t")), ignorenulls=True).over(w)).withColumn("_next", F.last(F.when(~F.col("_probe"), F.col("_t")), ignorenulls=True).over(w))
    summary = both.groupBy(*stream, "_b").agg(F.min(F.when(F.col("_op"), F.col("_t"))).alias("_o1"), F.min(F.when(~F.col("_probe"), F.col("_t"))).alias("_d1"))
    later = _w(stream, [F.desc("_b")]).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(*stream, "_b", F.min("_o1").over(later).alias("_later_op"), F.min("_d1").over(later).alias("_later"))
    asked = seen.where("_op or _probe")
    same = [asked[c].eqNullSafe(summary[c]) for c in [*stream, "_b"]]
    known = asked.join(summary, same).select(*[asked[c] for c in stream], "_own", "_key", F.when(F.col("_op"), F.coalesce("_next_op", "_later_op")).alias("_n"), F.when(F.col("_probe"), F.coalesce("_next", "_later")).alias("_l"))
    ends = known.groupBy(*stream, "_own", "_key").agg(F.max("_n").alias("_n"), F.max("_l").alias("_l"))
    by_op = F.col("_n").isNotNull() & (F.col("_l").isNull() | (F.col("_n") <= F.col("_l")))
    ends = ends.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(stream)], "_own", "_key", F.when(by_op, F.col("_n")).when(F.col("_l").isNotNull(), F.col("_own") + stay).alias("until")).where("until is not null")
    match = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(stream)] + [at == F.col("_own"), F.col(order).eqNullSafe(F.col("_key"))]
    hit = match[0]
    for m in match[1:]:
        hit = hit & m
    return df.where(F.coalesce(F.col(operator), L(False))).join(ends, hit).select(*df.columns, "until")


def burst_counter(df: DataFrame, stream: list[str], time: str, order: list, out: str = "burst") -> DataFrame:
    """Number of the row among those since the time last advanced beyond all before."""
    w = _w(stream, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_top", F.max(time).over(w)).withColumn(out, F.row_number().over(_w([*stream, "_top"], order)).cast("bigint")).drop("_top")
