import random

import pytest
from pyspark.sql import functions as F

from rillwork.operators import comments, merge, select, timeline
from rillwork.operators.fetch import Download, fetch_segments


def test_order_vectors(spark):
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate([1, 2, 3, 4, 5, 6])] + [(1, i, x) for i, x in enumerate([7, 8, 9])], "s int, i int, x int")
    got = merge.interleave(df, [], "s", ["i"]).orderBy("position").collect()
    assert [r["x"] for r in got] == [1, 7, 2, 8, 3, 9, 4, 5, 6]
    z = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 2, 3, 0, 0, 3, 0, 0, 0])], "g int, i int, v int").withColumn("ok", F.col("v") > 0)
    assert [r["v"] for r in merge.trim_trailing(z, ["g"], F.col("i"), "ok").orderBy("i").collect()] == [1, 2, 3, 0, 0, 3]
    assert [r["part"] for r in merge.islands(z, ["g"], ["i"], "ok", collapse=True).orderBy("i").collect()] == [0, 0, 0, 1]
    assert [r["part"] for r in merge.islands(z, ["g"], ["i"], "ok").orderBy("i").collect()] == [0, 0, 0, 2]
    b = spark.createDataFrame([(1, 1, b"\xff"), (1, 0, b"\x00a"), (2, 0, b"")], "g int, i int, d binary")
    assert {r["g"]: bytes(r["data"]) for r in merge.concat_binary(b, ["g"], ["i"], "d").collect()} == {1: b"\x00a\xff", 2: b""}


def test_best_of_group_with_missing_values(spark):
    rows = [(1, None, None, 9, 0), (1, 640, 30.0, 1, 1), (1, 640, 60.9, 1, 2), (1, 640, 60.1, 1, 3), (2, None, None, 5, 0), (2, None, None, 5, 1)]
    df = spark.createDataFrame(rows, "g int, w int, f double, b int, o int")
    assert {r["g"]: r["o"] for r in select.best_variant(df, ["g"], "w", "f", "b", "o").collect()} == {1: 2, 2: 0}
    assert {r["g"]: r["o"] for r in select.best_representation(df, ["g"], "w", None, "b", "o").collect()} == {1: 3, 2: 1}


def test_availability(spark):
    df = spark.createDataFrame([(t,) for t in (10, 20, 30, 40)], "t long")
    L = F.lit
    keep = lambda **kw: [r["t"] for r in df.where(timeline.available(F.col("t"), L(35), **kw)).collect()]
    assert keep() == [10, 20, 30] and keep(offset=L(5)) == [10, 20, 30, 40] and keep(delay=L(10)) == [10, 20] and keep(buffer=L(15)) == [20, 30]
    assert keep(since=L(20)) == [20, 30] and keep(since=L(20), inclusive=False) == [30]


def test_fetch_retries_are_recorded(spark, tmp_path):
    calls = {}

    def flaky(uri, span, headers):
        n = int(uri)
        calls[uri] = calls.get(uri, 0) + 1
        if calls[uri] <= n:
            raise OSError("no")
        return f"{uri}{span}{headers}".encode()

    df = spark.createDataFrame([(0, i, str(i), (5, 2), {"a": "b"}) for i in range(4)], "stream_id long, sequence long, uri string, byte_range struct<offset:long,length:long>, headers map<string,string>")
    one = {r["sequence"]: (r["success"], r["attempts"]) for r in fetch_segments(df, flaky, 2, 1).collect()}
    assert one == {0: (True, 1), 1: (False, 1), 2: (False, 1), 3: (False, 1)}
    three = {r["sequence"]: r for r in fetch_segments(df, flaky, 2, 3).collect()}
    assert [(three[i]["success"], three[i]["attempts"]) for i in range(4)] == [(True, 1), (True, 2), (True, 3), (False, 3)]
    assert bytes(three[0]["data"]) == b"0(5, 2){'a': 'b'}" and "OSError" in three[3]["error"]
    d = Download().with_opener(flaky).with_attempts(3).staged_at(str(tmp_path / "st"))
    assert d.run(df).where("success").count() == 3
    again = d.with_attempts(5).run(df)
    assert again.where("success").select("sequence").distinct().count() == 4 and again.where("sequence = 0").count() == 1


def test_fetch_many_small_segments_and_a_few_large(spark):
    import time

    def opener(uri, span, headers):
        if uri == "0":
            raise OSError("no")
        return b"x" * 3_000_000 if int(uri) < 5 else f"{span}".encode()

    df = spark.range(20_000).select(F.lit(0).alias("stream_id"), F.col("id").alias("sequence"), F.col("id").cast("string").alias("uri"), F.when(F.col("id") % 2 == 1, F.struct((F.col("id") + 2**53).alias("offset"), F.lit(None).cast("long").alias("length"))).alias("byte_range"))
    fetch_segments(df.limit(10), opener, 2).count()
    began = time.time()
    got = {r["sequence"]: r for r in fetch_segments(df, opener, 2, 2).withColumn("n", F.length("data")).withColumn("data", F.substring("data", 1, 40)).collect()}
    assert time.time() - began < 8  # one batch per segment took 20 s and more
    assert len(got) == 20_000 and not got[0]["success"] and got[0]["attempts"] == 2 and all(got[i]["n"] == 3_000_000 for i in range(1, 5))
    assert bytes(got[6]["data"]) == b"None" and bytes(got[9]["data"]) == f"({2**53 + 9}, None)".encode()


def test_fetch_local_ranges(spark, tmp_path):
    p = tmp_path / "f.bin"
    p.write_bytes(bytes(range(50)))
    from rillwork.sources.files import ranged_file

    rows = ranged_file(spark, f"file://{p}", 50, True, chunk=20)
    got = fetch_segments(rows).orderBy("sequence").collect()
    assert b"".join(bytes(r["data"]) for r in got) == bytes(range(50)) and len(got) == 3
    assert ranged_file(spark, "u", 50, False).count() == 1 and ranged_file(spark, "u", 0, True).count() == 1


def greedy(rows):
    free, top, count, out = [float("-inf")] * 11, float("-inf"), 0, {}
    for at, k, n in sorted(rows):
        if at > top:
            top, count = at, 0
        count += 1
        reach = (at + 1280 / (n * 70 + 1280) * 800) // 1
        fits = [i for i in range(11) if reach >= free[i]]
        lane = fits[0] if fits else free.index(min(free))
        free[lane] = at + 800
        out[k] = count % 11 if count > 11 else lane
    return out


@pytest.mark.parametrize("spread", [300, 4000])
def test_lanes_against_one_long_fold(spark, spread):
    r = random.Random(spread)
    rows = [(r.randint(0, spread) * r.choice([1, 1, 3]), k, r.randint(0, 60)) for k in range(500)]
    df = spark.createDataFrame([("s", *x) for x in rows], "s string, vpos long, k long, n int")
    got = {x["k"]: x["lane"] for x in comments.lanes(df, "s", "vpos", "k", "n").collect()}
    assert got == greedy(rows)


def test_marquee_ends(spark):
    rows = [(0, 1, True), (100, 2, False), (300, 3, True), (1000, 4, False), (1800, 5, True), (2000, 6, False), (3300, 7, False), (9000, 8, True)]
    df = spark.createDataFrame([(1, *x) for x in rows], "s int, vpos long, k long, op boolean")
    got = {r["k"]: r["until"] for r in timeline.marquee_ends(df, ["s"], "vpos", "k", "op").collect()}
    assert got == {1: 300, 3: 1800, 5: 2600}


def test_polls_and_events(spark):
    rows = [
        (1, 100, 1, True, '/vote start "Wie war es?" gut schlecht "na ja"', None, 3), (1, 200, 2, True, "/vote showresult per 500 300 205", None, 3), (1, 300, 3, True, "danke", None, 3), (1, 400, 4, False, "hello", "red", None),
        (1, 500, 5, False, "oben", "ue", None), (1, 510, 6, False, "a\nb", "gothic", 1), (1, 520, 7, False, "/info x", None, None), (1, 530, 8, False, "weg", None, 2), (1, None, 9, False, "ohne", None, None), (1, 5000, 10, True, "/vote stop", None, 3),
    ]
    df = spark.createDataFrame(rows, "live long, vpos long, k long, op boolean, content string, mail string, premium long")
    p = comments.polls(df.where("op"), ["live"], "vpos", "k", "content").collect()
    assert [(r["question"], r["options"], r["results"], r["start"], r["result_start"], r["end"]) for r in p] == [("Wie war es?", ["gut", "schlecht", "na ja"], ["500", "300", "205"], 100, 200, 300)]
    lines = [r["line"] for r in comments.subtitle_events(df, "live", "k", "op").orderBy("grp", "at", "k", "sub").collect()]
    assert "Dialogue: 2,00:00:5.0,00:00:13.0,Danmaku,,0,0,0,,{\\an8\\1c&HFFFFFF&}oben" in lines
    assert "Dialogue: 2,00:00:4.0,00:00:12.0,Danmaku,,0,0,0,,{\\an7\\move(1280,0,-350,0)\\1c&H0000FF&}hello" in lines
    assert sum("AA" in x for x in lines) == 2 and not any("weg" in x or "/info" in x for x in lines)
    assert any("20.5%" in x for x in lines) and any("Wie war es?" in x for x in lines) and any("danke" in x for x in lines)


def test_comment_json_leaves_out_nulls(spark):
    df = spark.createDataFrame([(1, None, "x")], "vpos long, name string, content string")
    assert df.select(comments.comment_json(df)).first()[0] == '{"vpos":1,"content":"x"}'


def test_set_difference_and_progress(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert {tuple(r) for r in select.set_difference(a, b, "k").collect()} == {(1, "start"), (3, "stop")}
    p = merge.progress(spark.createDataFrame([(1, True, "a"), (1, False, "c"), (1, False, "b"), (1, None, "d")], "g int, ok boolean, n string"), ["g"], "ok", "n").first()
    assert (p["total"], p["fetched"], p["failed"], p["percent"], p["failed_names"]) == (4, 1, 2, 75.0, "b,c")
