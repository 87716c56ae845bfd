from rillwork.sources import dash


def one(spark, text, url="https://h.example/d/m.mpd?k=1"):
    return spark.createDataFrame([(url, text)], "url string, content string")


TIMELINE = """<?xml version="1.0"?>
<MPD xmlns="urn:mpeg:dash:schema:mpd:2011" mediaPresentationDuration="PT1M40S"><Period id="only">
<AdaptationSet contentType="video"><SegmentTemplate timescale="1000" media="v$Bandwidth$/$Time$.m4s" initialization="v$Bandwidth$/head.mp4"><SegmentTimeline>
<S t="40" d="700" r="9"/><S d="333"/><S d="250" r="3"/></SegmentTimeline></SegmentTemplate>
<Representation id="s" width="320" height="180" bandwidth="77"/><Representation id="l" width="640" height="360" bandwidth="55"/><Representation id="m" width="640" height="360" bandwidth="44"/></AdaptationSet>
<AdaptationSet mimeType="audio/mp4" lang="fi"><Representation id="a" bandwidth="11"><SegmentTemplate timescale="20" media="a/$Number%05d$.m4s" startNumber="31"><SegmentTimeline><S t="60" d="9" r="1"/><S t="400" d="9"/></SegmentTimeline></SegmentTemplate></Representation></AdaptationSet>
</Period></MPD>"""


def test_timeline_runs(spark):
    rows = dash.plan(one(spark, TIMELINE)).orderBy("stream_id", "sequence").collect()
    video = [r for r in rows if r["stream_id"] == 0]
    assert [r["time"] for r in video] == [*range(40, 7040, 700), 7040, *range(7373, 8373, 250)]
    assert video[0]["uri"] == "https://h.example/d/v55/40.m4s?k=1" and video[0]["init_uri"] == "https://h.example/d/v55/head.mp4?k=1"
    audio = [r for r in rows if r["stream_id"] == 1]
    assert [(r["uri"], r["time"], r["start_us"], r["kind"]) for r in audio] == [(f"https://h.example/d/a/000{n}.m4s?k=1", t, t * 50_000, "audio") for n, t in ((31, 60), (32, 69), (33, 400))]


def test_numbers_in_two_widths(spark):
    text = '<MPD><Period duration="PT4S"><AdaptationSet contentType="video"><SegmentTemplate timescale="1" duration="2" media="$Number$/$RepresentationID$-$Number%03d$-$Time%02d$-$Odd$.m4s"/><Representation id="r"/></AdaptationSet></Period></MPD>'
    assert [r["uri"].split("?")[0] for r in dash.plan(one(spark, text)).orderBy("sequence").collect()] == [f"https://h.example/d/{n}/r-00{n}-0{t}-$Odd$.m4s" for n, t in ((1, 0), (2, 2))]


def periods():
    out = '<MPD type="static">'
    for seconds, number in ((30, 5), (7, 900), (12, 41)):
        out += f'<Period duration="PT{seconds}S"><BaseURL>http://e.example/{number}/</BaseURL>'
        for kind in ("video", "audio"):
            out += f'<AdaptationSet mimeType="{kind}/mp4"><SegmentTemplate duration="4" startNumber="{number}" media="{kind}_$Number$_$Bandwidth$.mp4"/><Representation id="x" bandwidth="5"/><Representation id="y" bandwidth="9"/></AdaptationSet>'
        out += "</Period>"
    return out + "</MPD>"


def test_nominal_periods(spark):
    rows = dash.plan(one(spark, periods())).collect()
    count = {}
    for r in rows:
        count[r["stream_id"]] = count.get(r["stream_id"], 0) + 1
    assert [count[i] for i in range(6)] == [8, 8, 2, 2, 3, 3]
    first = min((r for r in rows if r["stream_id"] == 2), key=lambda r: r["sequence"])
    assert first["uri"] == "http://e.example/900/video_900_9.mp4" and first["start_us"] == 30_000_000


def test_list_single_and_open_repeat(spark):
    text = """<MPD><Period duration="PT10S">
    <AdaptationSet contentType="text"><Representation id="l"><SegmentList duration="5" timescale="1"><Initialization sourceURL="i.mp4"/><SegmentURL media="s1.mp4"/><SegmentURL mediaRange="10-19"/></SegmentList></Representation></AdaptationSet>
    <AdaptationSet contentType="audio"><Representation id="f"><BaseURL>whole.m4a</BaseURL></Representation></AdaptationSet>
    <AdaptationSet contentType="video"><SegmentTemplate media="$Time$.m4s" timescale="1"><SegmentTimeline><S t="0" d="3" r="-1"/></SegmentTimeline></SegmentTemplate><Representation id="r"/></AdaptationSet>
    </Period></MPD>"""
    rows = dash.plan(one(spark, text, "http://h.example/d/m.mpd")).orderBy("stream_id", "sequence").collect()
    assert [(r["stream_id"], r["uri"], r["byte_range"] and tuple(r["byte_range"])) for r in rows] == [
        (0, "http://h.example/d/s1.mp4", None), (0, "http://h.example/d/m.mpd", (10, 10)), (1, "http://h.example/d/whole.m4a", None),
        *[(2, f"http://h.example/d/{t}.m4s", None) for t in (0, 3, 6, 9)],
    ]
    assert rows[0]["init_uri"] == "http://h.example/d/i.mp4" and rows[1]["start_us"] == 5_000_000


def test_durations(spark):
    texts = ["PT7M3S", "P1DT2H", "PT0.5S", "PT1H1M1.25S", "x", "P", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(dash.iso_duration_us(F.col("t"))).collect()] == [423_000_000, 93_600_000_000, 500_000, 3_661_250_000, None, None, None]


def test_live_window(spark):
    text = """<MPD type="dynamic" availabilityStartTime="2024-01-01T00:00:00Z" timeShiftBufferDepth="PT10S" suggestedPresentationDelay="PT3S">
    <Period start="PT0S"><AdaptationSet contentType="video"><SegmentTemplate duration="2" startNumber="1" media="$Number$.m4s"/><Representation id="v"/></AdaptationSet></Period></MPD>"""
    from pyspark.sql import functions as F

    zero = 1704067200_000_000
    df = spark.createDataFrame([("http://h.example/m.mpd", text, zero + 3600_000_000)], "url string, content string, now_us long")
    rows = dash.live_plan(df).orderBy("number").collect()
    # available: starts between now - 10 s and now - 3 s
    assert [(r["at_us"] - zero) // 1_000_000 for r in rows] == [3590, 3592, 3594, 3596] and rows[0]["uri"] == "http://h.example/1796.m4s" and rows[0]["refresh_us"] == 2_000_000
    later = dash.live_plan(df, F.lit(zero + 3594_000_000), inclusive=False).collect()
    assert [(r["at_us"] - zero) // 1_000_000 for r in later] == [3596]
    assert df.select(dash.iso_duration_us(F.lit("PT2S"))).first()[0] == 2_000_000
