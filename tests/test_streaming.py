import json

from pyspark.sql import functions as F

from rillwork.sources import dash
from rillwork.streaming.live import follow_live, live_manifests, live_segments, parse_media, wait_seconds
from rillwork.streaming.reassembly import contiguous_prefix, flush_rest, pipe_in_order, reassemble

SCHEMA = "stream_id bigint, sequence bigint, success boolean, item string"


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_reassembly_in_order_with_hole_and_late_rows(spark, tmp_path):
    batches = [[(0, 2, True, "c"), (1, 0, True, "a")], [(0, 0, True, "a"), (1, 1, False, None)], [(0, 1, True, "b"), (1, 3, True, "d"), (0, 1, True, "again")], [(0, 0, True, "late")]]
    src = tmp_path / "in"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(str(src))
    rows = run(spark, reassemble(stream), "ordered").collect()
    sent = sorted((r["stream_id"], r["position"], r["sequence"], r["success"]) for r in rows if not r["late"])
    assert sent == [(0, 0, 0, True), (0, 1, 1, True), (0, 2, 2, True), (1, 0, 0, True), (1, 1, 1, False)]
    assert sum(r["late"] for r in rows) == 2  # and (1, 3) waits behind the hole


def test_rest_behind_a_hole_is_flushed_from_the_state(spark, tmp_path):
    src, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    spark.createDataFrame([(0, 0, True, "a"), (0, 2, True, "c"), (0, 5, False, None), (1, 0, True, "x")], SCHEMA).coalesce(1).write.parquet(src)
    got = {}

    def write(stream, rows):
        with open(f"{tmp_path}/{stream}.txt", "a") as f:
            f.writelines(f"{p} {ok} {item}\n" for p, ok, item in rows)

    pipe_in_order(spark.readStream.schema(SCHEMA).parquet(src), write, ck).awaitTermination(120)
    got = {i: (tmp_path / f"{i}.txt").read_text() for i in (0, 1)}
    assert got == {0: "0 True a\n", 1: "0 True x\n"}
    rest = flush_rest(spark, ck).orderBy("stream_id", "sequence").collect()
    assert [tuple(r) for r in rest] == [(0, 2, True, "c", 1), (0, 5, False, None, 2)]


def test_a_replayed_poll_is_what_was_read(spark, tmp_path):
    from rillwork.streaming.live import _Playlists

    a = tmp_path / "a.m3u8"
    a.write_text("#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:5\n#EXTINF:2,\nx5.ts\n#EXTINF:2,\nx6.ts\n")
    one = _Playlists([f"file://{a}"], 1, str(tmp_path / "j"))
    start = one.initialOffset()
    rows, end = one.read(start)
    rows = list(rows)
    a.write_text("#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:50\n#EXTINF:2,\nx50.ts\n")  # what was read slid out of the window
    again = _Playlists([f"file://{a}"], 1, str(tmp_path / "j"))
    assert list(again.readBetweenOffsets(start, end)) == rows and len(rows) == 2
    more, later = again.read(end)
    assert [r[1] for r in more] == [50]
    again.commit(later)
    assert list(again.readBetweenOffsets(end, later)) == [(0, 50, f"file://{tmp_path}/x50.ts", 2.0, False)]


def test_following_stops_at_the_end_tag(spark, tmp_path):
    a = tmp_path / "a.m3u8"
    a.write_text("#EXTM3U\n#EXTINF:1,\n0.ts\n")
    seen = []

    def sink(df, n):
        seen.extend(r["media_sequence"] for r in df.orderBy("media_sequence").collect())
        a.write_text("#EXTM3U\n#EXTINF:1,\n0.ts\n#EXTINF:1,\n1.ts\n#EXT-X-ENDLIST\n")

    follow_live(spark, [f"file://{a}"], sink, str(tmp_path / "f"))
    assert seen == [0, 1]
    assert wait_seconds({}) == 5 and wait_seconds({0: [2.0, 4.0], 1: []}) == 1 and wait_seconds({0: [2.0, 4.0]}) == 3


def test_manifests_are_planned_from_the_cursor(spark, tmp_path):
    mpd, clock = tmp_path / "m.mpd", tmp_path / "clock"
    mpd.write_text('<MPD type="dynamic" availabilityStartTime="1970-01-01T00:00:00Z" minimumUpdatePeriod="PT4S"><Period start="PT0S"><AdaptationSet contentType="video"><SegmentTemplate timescale="1" duration="2" startNumber="0" media="s$Number$.m4s"/><Representation id="a" bandwidth="1"/></AdaptationSet></Period></MPD>')
    df = live_manifests(spark, [f"file://{mpd}"], journal=str(tmp_path / "j"), clock=str(clock))
    seen = []

    def batch(rows, _):
        seen.extend(map(tuple, rows.collect()))

    import time

    for now in (7, 9, 12):
        clock.write_text(str(now * 1_000_000))
        q = df.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
        for _ in range(40):
            time.sleep(0.25)
            if seen and seen[-1][2] == now * 1_000_000 and not q.status["isTriggerActive"]:
                break
        q.stop()
    # at 9 s the update period has not passed
    assert [(r[2], r[3]) for r in seen] == [(7_000_000, None), (12_000_000, 7_000_000)]
    planned = [sorted(x["number"] for x in dash.live_plan(spark.createDataFrame([r], df.schema), F.col("since_us"), inclusive=False).collect()) for r in seen]
    assert planned == [[0, 1, 2, 3], [4, 5]]  # 6 begins at 12 s and is not there yet


def test_contiguous_prefix(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 3), (1, 1)], "s int, n int")
    assert {tuple(r) for r in contiguous_prefix(df, "s", "n").collect()} == {(0, 0), (0, 1)}


def test_live_playlists_beyond_the_mark(spark, tmp_path):
    a = tmp_path / "a.m3u8"
    a.write_text("#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:5\n#EXTINF:2,\nx5.ts\n#EXTINF:2.5,\nx6.ts\n")
    df = live_segments(spark, [f"file://{a}", f"file://{tmp_path}/missing.m3u8"], journal=str(tmp_path / "journal"))
    ck = str(tmp_path / "ck")
    out = str(tmp_path / "out")

    def once():
        q = df.writeStream.format("parquet").option("checkpointLocation", ck).option("path", out).trigger(processingTime="200 milliseconds").start()
        import time

        for _ in range(60):
            time.sleep(0.5)
            if q.recentProgress and any(p.numInputRows for p in q.recentProgress):
                break
        q.stop()

    once()
    a.write_text("#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:6\n#EXTINF:2.5,\nx6.ts\n#EXTINF:3,\nx7.ts\n#EXT-X-ENDLIST\n")
    once()
    rows = spark.read.parquet(out).orderBy("media_sequence").collect()
    assert [(r["stream_id"], r["media_sequence"], r["duration"], r["ended"]) for r in rows] == [(0, 5, 2.0, False), (0, 6, 2.5, False), (0, 7, 3.0, True)]


def test_parse_media():
    assert parse_media("#EXTM3U\nx.ts", "http://h/p/l.m3u8") == ([(0, "http://h/p/x.ts", None)], False)


def test_page_chain(spark, tmp_path):
    for i, nxt in enumerate([1, 2, None]):
        (tmp_path / f"{i}.json").write_text(json.dumps({"messages": [i], **({"next": {"uri": f"file://{tmp_path}/{nxt}.json"}} if nxt else {})}))
    (tmp_path / "loop.json").write_text(json.dumps({"next": {"uri": f"file://{tmp_path}/loop.json"}}))
    from rillwork.sources.pages import read_chains

    rows = read_chains(spark, [f"file://{tmp_path}/0.json", f"file://{tmp_path}/loop.json"])
    assert {(r["page"], r["uri"][-6:]) for r in rows.collect()} == {(0, "0.json"), (1, "1.json"), (2, "2.json"), (0, "p.json")}
    assert rows.select(F.get_json_object("body", "$.messages[0]").alias("m")).where("m is not null").count() == 3


def test_files_and_records(spark, tmp_path):
    from rillwork.sources.files import existing_files, inline_text, read_config, read_manifests
    from rillwork.sources.records import available_qualities, control_messages, embedded_program, is_live, live_streams, timeshift_stream

    d = tmp_path / "seg"
    d.mkdir()
    for n in ("b.ts", "a.ts", ".DS_Store"):
        (d / n).write_bytes(b"x")
    assert [(r["sequence"], r["file_name"]) for r in existing_files(spark, str(d)).orderBy("sequence").collect()] == [(0, "a.ts"), (1, "b.ts")]
    (tmp_path / "l.m3u8").write_text("#EXTM3U\n")
    assert read_manifests(spark, str(tmp_path / "l.m3u8")).first()["kind"] == "hls"
    assert inline_text(spark, "hi").first()["content"] == "hi"
    (tmp_path / "c.toml").write_text("rooms = ['a']\n[s3]\nbucket = 'b'\n")
    assert read_config(str(tmp_path / "c.toml")) == {"rooms": ["a"], "s3": {"bucket": "b"}}
    text = json.dumps({"streaming_url_list": [{"id": 1, "url": "u1", "type": "hls", "quality": 1000}, {"id": 2, "url": "u2", "type": "lhls", "quality": 100}, {"id": 3, "url": "u3", "type": "lhls"}]})
    shift = json.dumps({"streaming_url_list": {"hls_source": {"hls": "s"}, "hls_all": {"hls_all": "a"}}})
    page = '<div id="embedded" data-props="{&quot;program&quot;:{&quot;title&quot;:&quot;T&amp;amp;&quot;,&quot;beginTime&quot;:5}}">'
    df = spark.createDataFrame([(text, shift, page, '{"type":"seat","data":{"keepIntervalSec":30}}'), ("x", "{}", "<p>", "{")], "t string, s string, h string, c string")
    assert [r["best"] and r["best"]["url"] for r in live_streams(df, "t").collect()] == ["u2", None]
    assert timeshift_stream(df, "s").first()["stream"] == "a"
    assert [(r["title"], r["begin_time"]) for r in embedded_program(df, "h").collect()] == [("T&amp;", 5), (None, None)]
    assert [(r["type"], r["data"]["keepIntervalSec"]) for r in control_messages(df, "c").collect()] == [("seat", "30")]
    q = spark.sql("select array(named_struct('id', 'high', 'isAvailable', true), named_struct('id', 'low', 'isAvailable', cast(null as boolean))) q, 2 s, 0 l")
    assert tuple(q.select(available_qualities(F.col("q")), is_live(F.col("s"), F.col("l"))).first()) == (["high"], True)
