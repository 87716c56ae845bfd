import random

import pytest

from rillwork.operators.intervals import merge_intervals


def brute(rows):
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, iv in by.items():
        iv.sort()
        cur = list(iv[0])
        for s, e in iv[1:]:
            if s > cur[1]:
                out.add((k, "covered", *cur))
                out.add((k, "gap", cur[1], s))
                cur = [s, e]
            else:
                cur[1] = max(cur[1], e)
        out.add((k, "covered", *cur))
    return out


@pytest.mark.parametrize("width", [3, 10, 10_000])
def test_random_against_brute_force(spark, width):
    r = random.Random(width)
    rows = []
    for _ in range(600):
        k, s = r.choice([None, 1, 1, 1, 2, 3]), r.choice([None, *[r.randint(-50, 400)] * 12])
        e = None if s is None else r.choice([None, *[s + r.randint(-3, 12)] * 15, s + 90])
        rows.append((k, s, e))
    rows += rows[:50]
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], "k int, s long, e long, kind string, from_us int")
    got = [tuple(x) for x in merge_intervals(df, ["k"], "s", "e", bucket_width=width).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_touching_join_and_empty(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 10, 11), (2, 3, 3), (2, 4, 1)], "k int, s long, e long")
    got = {tuple(x) for x in merge_intervals(df, ["k"], "s", "e").collect()}
    assert got == {(1, "covered", 0, 9), (1, "gap", 9, 10), (1, "covered", 10, 11)}
    assert merge_intervals(df.limit(0), ["k"], "s", "e").count() == 0


def test_hot_entity_is_spread_over_buckets(spark):
    from pyspark.sql import functions as F

    df = spark.range(50_000).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + F.when(F.col("id") % 100 == 0, 5).otherwise(10)).alias("e"))
    got = merge_intervals(df, ["k"], "s", "e", bucket_width=1000)
    assert got.where("kind = 'gap'").count() == 500
    assert got.where("kind = 'covered'").count() == 501
