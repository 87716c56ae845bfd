from pyspark.sql import functions as F

from rillwork.operators import sinks
from rillwork.operators.sinks import Options

L = F.lit


def test_parts_are_written_in_order(spark, tmp_path):
    rows = [(0, 2, True, b"c"), (0, 0, True, b"a"), (0, 1, True, b"b"), (0, 3, False, None), (0, 4, False, None), (0, 5, True, b"f"), (0, 6, False, None), (1, 0, True, b"x")]
    df = spark.createDataFrame(rows, "stream_id long, sequence long, success boolean, data binary")
    stem = F.concat(L(f"{tmp_path}/s"), F.col("stream_id").cast("string"))
    done = sinks.write_files(sinks.concat_parts(df, stem, L("ts")), "file", "data").collect()
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"s0.0.ts": b"abc", "s0.1.ts": b"f", "s1.ts": b"x"}
    assert sum(r["bytes"] for r in done) == 5
    sinks.skip(df)


def test_rules():
    assert [sinks.merger_kind(o) for o in (Options(), Options(no_merge=True), Options(concat=True), Options(pipe=True), Options(pipe_to="x"), Options(pipe_mux=True, pipe=True))] == ["auto", "skip", "concat", "pipe", "pipe_file", "pipe_mux"]
    assert [sinks.staging_kind(o) for o in (Options(), Options(in_memory=True), Options(object_store="s3://b"), Options(pipe=True), Options(pipe=True, live=True))] == ["file", "memory", "object", "memory", "file"]
    o = Options(output="a", headers=("x: 1",)).overlaid(Options(key="k", headers=("y: 2",)))
    assert (o.output, o.key, o.headers) == ("a", "k", ("x: 1", "y: 2"))


def test_overlay(spark):
    df = spark.createDataFrame([("a/b:c", "u", None, ["h"], None), (None, "v", "own", None, None)], "title string, playlist_url string, key string, headers array<string>, cookies array<string>")
    got = [tuple(r) for r in sinks.overlay_playlists(df, Options(key="k", cookies=("c=1",))).collect()]
    assert got == [("u", "b_c", "k", ["h"], ["c=1"]), ("v", "output", "own", [], ["c=1"])]
