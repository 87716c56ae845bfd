"""Choosing variants, representations and renditions: top 1 of each group as an aggregation, never a sort of the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

L = F.lit


def top_row(df: DataFrame, group: list[str], order: list[Column], smallest: bool = True) -> DataFrame:
    """The whole row of each group that comes first (or last) by `order`; nulls rank lowest. Map-side combining, so hot groups are no matter.

    `order` must be total within a group, or one of several equal rows is returned.
    """
    rest = [c for c in df.columns if c not in group]
    pick = (F.min if smallest else F.max)(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row")))
    return df.groupBy(*group).agg(pick.alias("_t")).select(*group, "_t._row.*")


def descending(c: Column) -> Column:
    """For numbers in a `smallest` order: largest first, nulls last."""
    return F.coalesce(-c.cast("double"), L(float("inf")))


def best_variant(df: DataFrame, group: list[str], width: str, frame_rate: str, bandwidth: str, ordinal: str) -> DataFrame:
    """Widest, then the highest whole frame rate, then the highest bandwidth, then the first; missing values come last."""
    return top_row(df, group, [descending(F.col(width)), descending(F.floor(frame_rate)), descending(F.col(bandwidth)), F.col(ordinal)])


def best_representation(df: DataFrame, group: list[str], width: str | None, height: str | None, bandwidth: str, ordinal: str) -> DataFrame:
    """Largest (width, height, bandwidth), missing lowest; of equals the last."""
    none = L(None).cast("bigint")
    return top_row(df, group, [F.col(width) if width else none, F.col(height) if height else none, F.col(bandwidth), F.col(ordinal)], smallest=False)


def best_rendition(df: DataFrame, group: list[str], default: str, autoselect: str, ordinal: str) -> DataFrame:
    """The first that is both default and autoselected, else the first."""
    return top_row(df, group, [~(F.coalesce(F.col(default), L(False)) & F.coalesce(F.col(autoselect), L(False))), F.col(ordinal)])


def best_scored(df: DataFrame, group: list[str], quality: Column, preferred: Column, ordinal: str, bonus: int = 1_000_000) -> DataFrame:
    """Highest quality (null is 0) plus a bonus for the preferred type; of equals the last."""
    return top_row(df, group, [F.coalesce(quality, L(0)) + F.when(preferred, bonus).otherwise(0), F.col(ordinal)], smallest=False)


def preferred_member(m: Column, keys: list[str]) -> Column:
    """The value of the first key a map has, else of any."""
    return F.coalesce(*[F.try_element_at(m, L(k)) for k in keys], F.get(F.map_values(m), L(0)))


def set_difference(wanted: DataFrame, running: DataFrame, key: str) -> DataFrame:
    """(key, action): `start` for keys only wanted, `stop` for keys only running."""
    start = wanted.select(key).distinct().join(running, key, "left_anti").withColumn("action", L("start"))
    stop = running.select(key).distinct().join(wanted, key, "left_anti").withColumn("action", L("stop"))
    return start.unionByName(stop)


def first_candidate(df: DataFrame, group: list[str], ordinal: str) -> DataFrame:
    """The first of several candidates, by an explicit order."""
    return top_row(df, group, [F.col(ordinal)])
