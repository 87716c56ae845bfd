import os
import random

import pytest
from pyspark.sql import functions as F

from rillwork.operators import comments, fetch, merge, timeline
from rillwork.operators.inspect import Found, Inspector, Inspectors
from rillwork.operators.sinks import Options, finish, stage
from rillwork.sources import hls
from rillwork.streaming.clock import Schedule, clock_offset_us, utc_timings

L = F.lit


def test_marquee_ends_against_brute_force(spark):
    r = random.Random(3)
    rows = [(s, r.choice([None, *range(0, 9000, 50)]), i, r.random() < 0.2) for i, s in enumerate(r.choices([1, 1, 1, 2, None], k=400))]
    rows += rows[:20]  # repeated rows
    df = spark.createDataFrame([(*x, 0) for x in rows], "live long, vpos long, k long, op boolean, until0 int")
    for bucket in (700, 30_000):
        got = sorted(map(tuple, timeline.marquee_ends(df, ["live"], "vpos", "k", "op", bucket=bucket).select("k", "until").collect()))
        want = []
        for s, t, k, op in rows:
            if not op or t is None:
                continue
            own = {(b, c, o) for a, b, c, o in rows if a == s and b is not None}
            nxt = min(((b, c) for b, c, o in own if o and (b, c) > (t, k)), default=(None,))[0]
            late = min((b for b, _, _ in own if b > t + 1400), default=None)
            until = nxt if nxt is not None and (late is None or nxt <= late) else t + 800 if late is not None else None
            if until is not None:
                want.append((k, until))
        assert got == sorted(want) and len(want) > 20
    assert timeline.marquee_ends(df.limit(0), ["live"], "vpos", "k", "op").count() == 0


def test_polls_show_all_options(spark):
    words = " ".join(f"o{i}" for i in range(23))
    rows = [(1, 100, 1, True, f"/vote start Q {words}"), (1, 300, 2, True, "end"), (1, 9000, 3, True, "later")]
    df = spark.createDataFrame([(*x, None, 3) for x in rows], "live long, vpos long, k long, op boolean, content string, mail string, premium long")
    lines = [x["line"] for x in comments.poll_events(df, "live", "k").collect()]
    assert sum(",Choice," in x for x in lines) == 23 and any("23 o22" in x for x in lines)
    places = df.select(comments.option_places(F.array(*[L("x")] * 23)).alias("p")).first()["p"]
    assert len({tuple(p) for p in places}) == 23 and all(0 < p["x"] < comments.WIDTH and comments.BANNER < p["y"] < comments.HEIGHT for p in places)


def test_subtitle_files_are_whole(spark, tmp_path):
    rows = [(s, v, i, False, f"c{i}", None, None) for i, (s, v) in enumerate([(1, 100), (2, 50), (1, 20)])]
    df = spark.createDataFrame(rows, "live long, vpos long, k long, op boolean, content string, mail string, premium long")
    events = comments.subtitle_events(df, "live", "k", "op")
    comments.subtitle_files(events, "live", "k", F.concat(L(f"{tmp_path}/"), "live", L(".ass"))).collect()
    text = (tmp_path / "1.ass").read_text()
    assert text.startswith(comments.SCRIPT_HEAD + "\n") and text.index("c2") < text.index("c0") and "c1" not in text


def test_a_retry_replaces_the_failure(spark, tmp_path):
    flag = tmp_path / "up"

    def opener(uri, byte_range, headers):
        if uri == "bad" and not os.path.exists(flag):
            raise OSError("status 503")
        return uri.encode()

    segs = spark.createDataFrame([(0, 0, "good"), (0, 1, "bad"), (1, 0, "x")], "stream_id long, sequence long, uri string")
    load = fetch.Download().staged_at(str(tmp_path / "st")).with_opener(opener).with_attempts(2)
    assert sorted((r["stream_id"], r["sequence"], r["success"]) for r in load.run(segs).collect()) == [(0, 0, True), (0, 1, False), (1, 0, True)]
    flag.write_text("")
    again = load.run(segs.where("stream_id = 0")).collect()
    assert sorted((r["stream_id"], r["sequence"], r["success"], bytes(r["data"])) for r in again) == [(0, 0, True, b"good"), (0, 1, True, b"bad")]
    load.recycle(spark, spark.createDataFrame([(0, 0)], "stream_id long, sequence long"))
    left = {(r["stream_id"], r["sequence"]) for r in load._staged(spark).collect()}
    assert left == {(0, 1), (1, 0)}


def test_masters_are_followed_and_loops_end(spark):
    pages = {
        "http://h.example/a": '#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=9\nb\n', "http://h.example/b": '#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=9\nc\n', "http://h.example/c": "#EXTM3U\n#EXTINF:4,\nx.ts\n#EXT-X-ENDLIST\n",
        "http://h.example/loop": '#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=9\nloop\n',
    }

    def opener(uri, byte_range, headers):
        return pages[uri].encode()

    df = spark.createDataFrame([("http://h.example/a",), ("http://h.example/loop",), ("http://h.example/none",), (None,)], "url string")
    got = {(r["entry"][17:], r["url"][17:], r["error_kind"]) for r in hls.resolve_media(df, opener).collect()}
    assert got == {("a", "c", None), ("none", "none", "missing")}


def test_every_key_is_fetched_once(spark, tmp_path):
    def opener(uri, byte_range, headers):
        with open(tmp_path / "log", "a") as f:
            f.write(uri + "\n")
        return b"k" * 16

    text = '#EXTM3U\n#EXT-X-KEY:METHOD=AES-128,URI="k1"\n#EXTINF:2,\na.ts\n#EXTINF:2,\nb.ts\n#EXT-X-KEY:METHOD=NONE\n#EXTINF:2,\nc.ts\n'
    rows = hls.media_segments(spark.createDataFrame([(f"http://h.example/{i}/l", text.replace("k1", "http://h.example/k1")) for i in range(5)], "url string, content string"))
    got = hls.with_keys(rows, opener).collect()
    assert sum(r["key_bytes"] is not None for r in got) == 10 and len(got) == 15
    assert (tmp_path / "log").read_text() == "http://h.example/k1\n"
    assert {bytes(r["key_bytes"]).hex() for r in hls.with_keys(rows, opener, manual_key="00ff").where("key is not null").collect()} == {"00ff"}


def test_files_of_any_number_of_chunks(spark, tmp_path):
    df = spark.range(5000).select(F.concat(L(f"{tmp_path}/f"), F.col("id") % 3).alias("path"), F.col("id").alias("n"), F.concat(F.col("id").cast("string"), L(";")).cast("binary").alias("data"))
    done = {r["path"][-2:]: r["bytes"] for r in merge.write_concatenated(df, "path", ["n"], "data").collect()}
    for i in range(3):
        assert (tmp_path / f"f{i}").read_text() == "".join(f"{n};" for n in range(i, 5000, 3)) and done[f"f{i}"] == os.path.getsize(tmp_path / f"f{i}")
    assert sorted(os.listdir(tmp_path)) == ["f0", "f1", "f2"]
    one = merge.concat_binary(df.where("n < 9"), ["path"], ["n"], "data").collect()
    assert {bytes(r["data"]) for r in one} == {b"0;3;6;", b"1;4;7;", b"2;5;8;"}


def test_merging_by_options(spark, tmp_path):
    rows = [("a", 0, 0, True, "ts", b"1"), ("a", 0, 1, False, "ts", None), ("a", 0, 2, True, "ts", b"3"), ("b", 0, 0, True, "ts", b"x"), ("b", 0, 1, True, "ts", b"y"), ("c", 0, 0, True, "video", b"v"), ("c", 1, 0, True, "audio", b"s")]
    df = spark.createDataFrame(rows, "presentation string, stream_id long, sequence long, success boolean, kind string, data binary")
    stem = F.concat(L(f"{tmp_path}/"), "presentation")
    read = lambda got: {r["path"].split("/")[-1]: open(r["path"], "rb").read() for r in got.collect()}  # noqa: E731, SIM115
    assert read(finish(df, Options(), stem, L("out"))) == {"b.0.out": b"xy", "c.0.out": b"v", "c.1.out": b"s"}
    assert read(finish(df, Options(pipe=True), stem, L("p"))) == {"a.0.0.p": b"1", "a.0.1.p": b"3", "b.0.0.p": b"xy", "c.0.0.p": b"v", "c.1.0.p": b"s"}
    assert finish(df, Options(no_merge=True), stem, L("x")) is None
    muxed = finish(df, Options(), stem, L("m"), mux=lambda t: t.groupBy("presentation").agg(F.min("stream_id").alias("stream_id"), F.first(L("joined")).alias("path"), F.sum("bytes").alias("bytes")))
    assert {(r["path"].split("/")[-1], r["bytes"]) for r in muxed.collect()} == {("b.0.m", 2), ("joined", 2)}
    assert stage(df, Options(in_memory=True), "").count() == 7 and stage(df, Options(), str(tmp_path / "st")).count() == 7


def test_inspectors_redirect_choose_wait_and_loop(spark, tmp_path):
    ready = tmp_path / "ready"

    def look(url, path, query, arguments):
        n = path["n"]
        if n == "round":
            return [Found("redirect", "http://a.example/about")]
        if n == "about":
            return [Found("redirect", "http://a.example/round")]
        if n == "soon":
            if not os.path.exists(ready):
                ready.write_text("")
                return [Found("wait")]
            return [Found("playlist", "p", "t")]
        return [Found("candidate", "http://a.example/soon", "one"), Found("candidate", "http://a.example/x", "two")]

    known = Inspectors(Inspector("a", (("http", "a.example", "/{n}"),), look))
    df = spark.createDataFrame([("http://a.example/pick",), ("http://a.example/round",), ("http://b.example/",), (None,)], "u string")
    got = {(r["url"].split("/")[-1], r["playlist_url"], r["hops"]) for r in known.inspect(df, "u", wait=0.1, most_waits=3).collect()}
    assert got == {("pick", "p", 1), ("round", None, 1), ("", None, 0)}
    with pytest.raises(ValueError):
        known.add(Inspector("a", (), look))


def test_clock_sources():
    text = '<MPD><UTCTiming schemeIdUri="urn:mpeg:dash:utc:ntp:2014" value="n.example"/><UTCTiming value="http://t.example" schemeIdUri="urn:mpeg:dash:utc:http-iso:2014"/></MPD>'
    timings = utc_timings(text)
    assert timings == [("urn:mpeg:dash:utc:ntp:2014", "n.example"), ("urn:mpeg:dash:utc:http-iso:2014", "http://t.example")]
    now = iter([1_000_000, 3_000_000]).__next__
    assert clock_offset_us(timings, lambda u, b, h: b"1970-01-01T00:00:10Z", now_us=now) == 10_000_000 + 1_000_000 - 3_000_000
    assert clock_offset_us([("urn:mpeg:dash:utc:direct:2014", "1970-01-01T00:00:05+00:00")], now_us=lambda: 0) == 5_000_000
    assert clock_offset_us([("urn:mpeg:dash:utc:http-head:2014", "u")], head=lambda u: "Thu, 01 Jan 1970 00:00:07 GMT", now_us=lambda: 0) == 7_000_000
    assert clock_offset_us([]) == 0
    with pytest.raises(OSError):
        clock_offset_us(timings[:1])


def test_schedule_runs_each_room_once():
    alive = {"a": True}

    def start(room):
        if room == "broken":
            raise OSError
        return (lambda: alive["a"]) if room == "a" else None

    s = Schedule(start)
    s.reload(["a", "broken", "off", "a"])
    assert s.tick(0) == ["a"] and s.tick(1) == [] and s.tick(31) == []
    alive["a"] = False
    assert s.tick(61) == ["a"] and s.resting["broken"] == 81


def test_small_operators(spark):
    t = spark.createDataFrame([(1, 0, "video"), (1, 1, "data"), (1, 2, "audio")], "g int, n int, kind string")
    assert {(r["n"], r["output_index"]) for r in merge.output_streams(t, ["g"], [F.col("n")], "kind").collect()} == {(0, 0), (2, 1)}
    e = spark.createDataFrame([(1, 0, 50), (1, 1, 10)], "g int, n int, start int")
    assert merge.last_emitted(e, ["g"], F.col("n"), "start").first()["last"] == 10
    c = spark.createDataFrame([(1, 5, None, 1), (1, None, 3, 2), (1, 5, 2, 3)], "live int, date int, vpos int, k int")
    assert [r["k"] for r in comments.by_date(c, ["live"], "k").orderBy("position").collect()] == [2, 1, 3]
