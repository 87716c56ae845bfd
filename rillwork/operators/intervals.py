"""Overlapping and gapped intervals per entity: continuous periods and the holes between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def merge_intervals(
    df: DataFrame, entity: Sequence[str], start: str, end: str, bucket_width: int = HOUR_US
) -> DataFrame:
    """Per entity, one row of kind `covered` per maximal period covered without a hole and one of kind `gap` per hole.

    Intervals are half-open [start, end) over BIGINTs. Starts are compared with the running maximum of the previous ends of the
    entity; a start beyond it opens an island, the cumulative label of an island is its opening start, and islands are
    aggregated to periods. The hole before an island is [running maximum, opening start).

    An entity of any size is spread over tasks: equal starts are folded to their largest end first (with map-side combining),
    then the entity is cut into buckets of `bucket_width` of start. Windows run within (entity, bucket); what crosses
    buckets (the largest end so far, the last island opened) comes from windows over one summary row per (entity, bucket).

    Defined results: rows with a null start, a null end or end <= start are ignored; touching intervals join; repeated rows count
    once; null entity values form an entity of their own; an empty table gives no rows; other columns of df are not looked at.
    Columns: the entity columns, kind, from_us, until_us.
    """
    keys = [f"_k{i}" for i in range(len(entity))]
    rows = (
        df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(entity, keys)], F.col(f"`{start}`").cast("long").alias("_s"), F.col(f"`{end}`").cast("long").alias("_e"))
        .where("_e > _s")
        .groupBy(*keys, "_s")
        .agg(F.max("_e").alias("_e"))
        .withColumn("_b", F.expr(f"_s div {int(bucket_width)}"))
    )
    same = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
    inside = Window.partitionBy(*keys, "_b").orderBy("_s")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)

    reach = rows.groupBy(*keys, "_b").agg(F.max("_e").alias("_e")).withColumn("_carry", F.max("_e").over(before)).drop("_e")
    r = reach.alias("r")
    l = rows.withColumn("_m", F.max("_e").over(inside.rowsBetween(Window.unboundedPreceding, -1))).alias("l")
    marked = (
        l.join(r, same(_q(l, "l"), _q(r, "r"), [*keys, "_b"]))
        .select(*[f"l.{k}" for k in keys], "l._b", "l._s", "l._e", F.greatest("l._m", "r._carry").alias("_p"))
        .withColumn("_open", F.col("_p").isNull() | (F.col("_s") > F.col("_p")))
        .withColumn("_i", F.max(F.when(F.col("_open"), F.col("_s"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # one row per island and bucket; rows before the bucket's first opening belong to the last island of an earlier bucket
    parts = marked.groupBy(*keys, "_b", "_i").agg(F.max("_e").alias("_e"), F.min(F.when(F.col("_open"), F.col("_p"))).alias("_p"))
    last = parts.groupBy(*keys, "_b").agg(F.max("_i").alias("_i")).withColumn("_earlier", F.max("_i").over(before)).drop("_i")
    p, q = parts.alias("p"), last.alias("q")
    islands = (
        p.join(q, same(_q(p, "p"), _q(q, "q"), [*keys, "_b"]))
        .select(*[f"p.{k}" for k in keys], F.coalesce("p._i", "q._earlier").alias("_i"), "p._e", "p._p")
        .groupBy(*keys, "_i")
        .agg(F.max("_e").alias("_e"), F.min("_p").alias("_p"))
    )
    both = F.array(
        F.struct(F.lit("covered").alias("kind"), F.col("_i").alias("from_us"), F.col("_e").alias("until_us")),
        F.struct(F.lit("gap").alias("kind"), F.col("_p").alias("from_us"), F.col("_i").alias("until_us")),
    )
    return (
        islands.withColumn("_x", F.explode(both))
        .where("_x.from_us is not null")
        .select(*[F.col(k).alias(c) for k, c in zip(keys, entity)], "_x.kind", "_x.from_us", "_x.until_us")
    )


class _q:
    """Columns of an aliased DataFrame by name."""

    def __init__(self, df: DataFrame, alias: str):
        self.alias = alias

    def __getitem__(self, name: str):
        return F.col(f"{self.alias}.{name}")
