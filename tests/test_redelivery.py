import datetime as dt
import random
import re

from rillwork.operators.redelivery import WinnerStore, first_deliveries

T0 = dt.datetime(2025, 1, 1)


def brute(rows):
    best = {}
    for k, r, at in rows:
        if k is None:
            continue
        rank = (at is None, at or T0, r)
        if k not in best or rank < best[k][0]:
            best[k] = (rank, r)
    keep = {r for _, r in best.values()}
    return keep, {r for k, r, _ in rows if k is not None and r not in keep}


def make(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        k = r.choice([None, "hot", "hot", *[f"k{r.randint(0, 120)}" for _ in range(5)], "HOT", ""])
        rows.append((k, i, r.choice([None, *[T0 + dt.timedelta(hours=r.randint(0, 3000))] * 9])))
    return rows


def test_batches_in_any_order_give_the_same(spark, tmp_path):
    rows = make(1)
    keep, lost = brute(rows)
    r = random.Random(5)
    r.shuffle(rows)
    store = WinnerStore(spark, f"file://{tmp_path}/s", ["id"], ["row"], "at")
    surplus = set()
    for i in range(0, len(rows), 100):
        m = store.merge(spark.createDataFrame([(*x, "z") for x in rows[i : i + 100]], "id string, row long, at timestamp, other string"))
        surplus |= {x["row"] for x in m.surplus.collect()}
    assert {x["row"] for x in store.winners().collect()} == keep
    assert surplus == lost


def test_only_affected_partitions_are_replaced(spark, tmp_path):
    store = WinnerStore(spark, f"file://{tmp_path}/s", ["id"], ["row"], "at", unit="day")
    schema = "id string, row long, at timestamp"
    day = lambda d, h=0: T0 + dt.timedelta(days=d, hours=h)
    store.merge(spark.createDataFrame([("a", 1, day(0)), ("b", 2, day(1)), ("c", 3, day(2))], schema))
    before = store.manifest()["parts"]
    m = store.merge(spark.createDataFrame([("b", 4, day(5)), ("d", 5, day(2, 3))], schema))
    assert m.replaced == ["2025010200"]
    after = store.manifest()["parts"]
    assert after["2025010100"] == before["2025010100"]
    assert set(before["2025010300"]) < set(after["2025010300"])
    assert {tuple(x) for x in m.surplus.select("row").collect()} == {(4,)}
    # an earlier arrival that comes late displaces the stored winner and moves it to its own partition
    m = store.merge(spark.createDataFrame([("b", 6, day(0, 1))], schema))
    assert [x["row"] for x in m.surplus.collect()] == [2]
    assert {x["row"] for x in store.winners().collect()} == {1, 6, 3, 5}


def test_a_merge_reads_only_the_index_buckets_it_needs(spark, tmp_path):
    store = WinnerStore(spark, f"file://{tmp_path}/s", ["id"], ["row"], "at")
    schema = "id string, row long, at timestamp"
    store.merge(spark.createDataFrame([(f"k{i}", i, T0) for i in range(500)], schema))
    folders = store.manifest()["index"]
    assert len(store._index(folders).inputFiles()) > 40
    plan = store._index(folders, [3, 7])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*_a#\d+ IN \(3,7\)", plan), plan  # folders of other buckets are not opened
    # every merge adds a folder; beyond a number of them they are one again, and nothing is lost
    for i in range(12):
        m = store.merge(spark.createDataFrame([(f"k{i}", 1000 + i, T0 + dt.timedelta(days=40 * i + 1)), (f"n{i}", 2000 + i, T0)], schema))
        assert [x["row"] for x in m.surplus.collect()] == [1000 + i]
    assert len(store.manifest()["index"]) <= 9 and store._index(store.manifest()["index"]).count() == 512 and store.winners().count() == 512


def test_uncommitted_files_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = WinnerStore(spark, path, ["id"], ["row"], "at")
    df = spark.createDataFrame([("a", 1, T0)], "id string, row long, at timestamp")
    store.merge(df)
    df.selectExpr("'zz' id", "row", "at").write.parquet(f"{path}/data/9/_part=x/_new=true")
    assert store.winners().count() == 1


def test_empty_and_null_ids(spark, tmp_path):
    schema = "id string, row long, at timestamp"
    _, lost = first_deliveries(spark, spark.createDataFrame([], schema), f"file://{tmp_path}/e", ["id"], ["row"], "at")
    assert lost.count() == 0
    rows = [(None, 1, T0), (None, 2, T0), ("x", 3, None), ("x", 4, T0)]
    store, lost = first_deliveries(spark, spark.createDataFrame(rows, schema), f"file://{tmp_path}/n", ["id"], ["row"], "at")
    assert [x["row"] for x in lost.collect()] == [3]
    assert [x["row"] for x in store.winners().collect()] == [4]
