from pyspark.sql import functions as F

from rillwork.sources import hls

MEDIA = """#EXTM3U
#EXT-X-VERSION:7
#EXTINF:4.25,tea
https://cdn.kiln.test/w/one.ts
#EXTINF:6.5,
https://cdn.kiln.test/w/two.ts
#EXTINF:0.75,
https://cdn.kiln.test/w/end.ts
#EXT-X-ENDLIST
"""
LIVE = """#EXTM3U

#EXT-X-MEDIA-SEQUENCE:91
#EXTINF:2,
/l/91.ts
#EXTINF:2,
/l/92.ts
"""
KEYED = """#EXTM3U
#EXT-X-MEDIA-SEQUENCE:311
#EXTINF:1.5,
clear.ts
#EXT-X-KEY:METHOD=AES-128,URI="https://vault.kiln.test/k?id=8"
#EXTINF:1.5,
locked.ts
#EXT-X-KEY:METHOD=AES-128,URI="vault/9",IV=0xA1
#EXTINF:1.5,
given.ts
#EXT-X-KEY:METHOD=NONE
#EXT-X-MAP:URI="head.mp4",BYTERANGE="64@16"
#EXTINF:1.5,
open.m4s
"""
RANGES = """#EXTM3U
#EXTINF:3,
#EXT-X-BYTERANGE:500@20
all.ts
#EXT-X-BYTERANGE:40
#EXTINF:3,
all.ts
#EXTINF:3,
#EXT-X-BYTERANGE:7@9000
all.ts
"""
MASTER = """#EXTM3U
#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="talk",NAME="nl",DEFAULT=NO,AUTOSELECT=NO, \\
URI="talk/nl.m3u8"
#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="talk",NAME="fi",DEFAULT=YES,AUTOSELECT=YES,URI="talk/fi.m3u8"
#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="other",NAME="pt",DEFAULT=YES,AUTOSELECT=YES,URI="talk/pt.m3u8"
#EXT-X-STREAM-INF:BANDWIDTH=400,RESOLUTION=320x180,AUDIO="talk"
tiny.m3u8
#EXT-X-STREAM-INF:BANDWIDTH=300,RESOLUTION=640x360,AUDIO="talk"
wide.m3u8
"""
COLLAPSE = """#EXTM3U
#EXT-X-MEDIA:TYPE=VIDEO,GROUP-ID="cam",NAME="roof",DEFAULT=YES,AUTOSELECT=YES,URI="cams/roof.m3u8"
#EXT-X-MEDIA:TYPE=VIDEO,GROUP-ID="cam",NAME="yard",URI="cams/yard.m3u8"
#EXT-X-STREAM-INF:BANDWIDTH=77,VIDEO="cam"
cams/roof.m3u8
"""


def manifests(spark, *texts):
    return spark.createDataFrame([(f"http://h.example/p{i}/x.m3u8?t=1", t) for i, t in enumerate(texts)], "url string, content string")


def test_simple_playlist(spark):
    rows = hls.media_segments(manifests(spark, MEDIA)).orderBy("sequence").collect()
    assert [(r["uri"].split("?")[0].rsplit("/", 1)[1], r["duration"], r["media_sequence"], r["title"], r["end_list"]) for r in rows] == [("one.ts", 4.25, 0, "tea", True), ("two.ts", 6.5, 1, None, True), ("end.ts", 0.75, 2, None, True)]


def test_live_playlist(spark):
    rows = hls.media_segments(manifests(spark, LIVE)).orderBy("sequence").collect()
    assert [(r["media_sequence"], r["uri"], r["end_list"]) for r in rows] == [(n, f"http://h.example/l/{n}.ts?t=1", False) for n in (91, 92)]


def test_keys_stay_in_force_and_end(spark):
    rows = hls.media_segments(manifests(spark, KEYED)).orderBy("sequence").collect()
    assert [r["key"] and r["key"]["uri"] for r in rows] == [None, "https://vault.kiln.test/k?id=8", "http://h.example/p0/vault/9?t=1", None]
    assert rows[1]["key"]["iv"] == (312).to_bytes(16, "big") and rows[2]["key"]["iv"] == bytes(15) + b"\xa1"
    assert [r["init"] and (r["init"]["uri"], r["init"]["byte_range"]) for r in rows] == [None, None, None, ("http://h.example/p0/head.mp4?t=1", "64@16")]
    assert rows[3]["format"]["kind"] == "mp4"
    old = hls.media_segments(manifests(spark, KEYED), base_iv_on_playlist=True).where("sequence = 1").first()
    assert old["key"]["iv"] == (311).to_bytes(16, "big")


def test_byte_ranges(spark):
    rows = hls.media_segments(manifests(spark, RANGES)).orderBy("sequence").collect()
    assert [tuple(r["byte_range"]) for r in rows] == [(20, 500), (520, 40), (9000, 7)]


def test_master_playlists(spark):
    m = manifests(spark, MASTER, COLLAPSE, MEDIA)
    got = {(r["url"][17:19], r["stream_id"], r["uri"].split("?")[0][17:]) for r in hls.chosen_streams(m).collect()}
    assert got == {("p0", 0, "p0/wide.m3u8"), ("p0", 1, "p0/talk/fi.m3u8"), ("p1", 0, "p1/cams/roof.m3u8"), ("p2", 0, "p2/x.m3u8")}


def test_archive_plan(spark):
    top = "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=5\nhttp://h.example/v.m3u8\n"
    df = spark.createDataFrame([("http://h.example/top.m3u8", top), ("http://h.example/v.m3u8", MEDIA)], "url string, content string")
    rows = hls.plan_archive(df, 2, 3).orderBy("position").collect()
    assert [(r["entry"][-8:], r["sequence"], r["position"]) for r in rows] == [("top.m3u8", 1, 0), ("top.m3u8", 2, 1)]


def test_empty_and_odd(spark):
    df = spark.createDataFrame([("u", None), ("v", ""), ("w", "#EXTM3U\n#EXT-X-ENDLIST")], "url string, content string")
    assert hls.media_segments(df).count() == 0 and hls.variants(df).count() == 0
    assert hls.media_segments(df.limit(0).withColumn("x", F.lit(1))).count() == 0
