"""Whole-table checks of the manifest readers: the segment tables written as playlists and manifests, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..sources import dash, hls
from .segments import _SEG, ORACLE as _SEGMENTS, ROW
from .tables import table

L = F.lit
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLE[fn.__name__] = fn, sql
        return fn

    return add


def _url(key):
    return F.concat(L("http://h.example/"), key.cast("string"), L("/index"))


@query(f"""with {_SEG} select l_orderkey, sequence, l_orderkey % 1000 + sequence media_sequence, 'http://h.example/' || l_orderkey || '/p' || l_partkey || '.ts' uri, l_quantity duration,
  last_value(case when l_returnflag = 'R' then 'http://h.example/' || l_orderkey || '/k' || l_suppkey end ignore nulls) over (partition by l_orderkey order by sequence rows unbounded preceding) key_uri,
  l_orderkey % 2 = 0 as ended from seg""")
def hls_playlists(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a media playlist: keys in force, counters, durations, end tags."""
    key = F.when(F.col("l_returnflag") == "R", F.concat(L('#EXT-X-KEY:METHOD=AES-128,URI="k'), F.col("l_suppkey").cast("string"), L('"\n'))).otherwise(L(""))
    lines = F.concat(key, L("#EXTINF:"), F.col("l_quantity").cast("string"), L(",\np"), F.col("l_partkey").cast("string"), L(".ts\n"))
    body = merge.concat_text(table(spark, d, "lineitem").withColumn("_t", lines), ["l_orderkey"], ROW, "_t")
    text = F.concat(L("#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:"), (F.col("l_orderkey") % 1000).cast("string"), L("\n"), F.col("content"), F.when(F.col("l_orderkey") % 2 == 0, "#EXT-X-ENDLIST\n").otherwise(""))
    rows = hls.media_segments(body.select(_url(F.col("l_orderkey")).alias("url"), text.alias("content")))
    return rows.select(F.regexp_extract("url", r"/(\d+)/index$", 1).cast("bigint").alias("l_orderkey"), "sequence", "media_sequence", "uri", "duration", F.col("key.uri").alias("key_uri"), F.col("end_list").alias("ended"))


@query("""select p_brand as brand, 0 as stream_id, 'http://h.example/' || replace(p_brand, '#', '') || '/v' || p_partkey uri from part
  qualify row_number() over (partition by p_brand order by p_size desc, p_partkey % 10 desc, p_partkey) = 1""")
def hls_master_playlists(spark: SparkSession, d: str) -> DataFrame:
    """Every brand as a master playlist; the variant that would be fetched."""
    lines = F.concat(L("#EXT-X-STREAM-INF:BANDWIDTH="), (F.col("p_partkey") % 10).cast("string"), L(",RESOLUTION="), F.col("p_size").cast("string"), L("x9\nv"), F.col("p_partkey").cast("string"), L("\n"))
    body = merge.concat_text(table(spark, d, "part").withColumn("_t", lines), ["p_brand"], ["p_partkey"], "_t")
    name = F.replace("p_brand", L("#"), L(""))
    rows = hls.chosen_streams(body.select(_url(name).alias("url"), F.concat(L("#EXTM3U\n"), "content").alias("content")))
    return rows.select(F.regexp_replace(F.regexp_extract("url", r"/([^/]+)/index$", 1), "^Brand", "Brand#").alias("brand"), "stream_id", "uri")


@query(f"""select l_orderkey, number, "time", 'http://h.example/' || l_orderkey || '/' || number || '-' || "time" || '.m4s' uri, 'video' as kind from ({_SEGMENTS["timeline_expand"]})""")
def dash_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a manifest with a timeline of runs; its segments."""
    n = lambda c: c.cast("string")
    start = F.when(F.col("l_returnflag") == "A", F.concat(L(' t="'), n(F.col("l_partkey")), L('"'))).otherwise(L(""))
    run = F.concat(L("<S"), start, L(' d="'), n(F.col("l_suppkey") % 7 + 1), L('" r="'), n(F.col("l_quantity").cast("bigint") % 10), L('"/>'))
    body = merge.concat_text(table(spark, d, "lineitem").withColumn("_t", run), ["l_orderkey"], ROW, "_t")
    text = F.concat(
        L('<MPD type="static"><Period duration="PT1H"><AdaptationSet contentType="video"><SegmentTemplate timescale="10" media="$Number$-$Time$.m4s"><SegmentTimeline>'), "content",
        L('</SegmentTimeline></SegmentTemplate><Representation id="a" bandwidth="1"/><Representation id="b" bandwidth="2"/></AdaptationSet></Period></MPD>'),
    )
    rows = dash.plan(body.select(_url(F.col("l_orderkey")).alias("url"), text.alias("content")))
    return rows.select(F.regexp_extract("url", r"/(\d+)/index$", 1).cast("bigint").alias("l_orderkey"), "number", "time", "uri", "kind")
