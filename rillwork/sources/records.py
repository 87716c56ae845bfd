"""JSON records of sites: control messages, stream lists, room and programme data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import embedded_json
from ..operators.select import preferred_member

L = F.lit

CONTROL = "type string, data map<string,string>"


def control_messages(df: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    """df with `type` and `data` (members as texts) of {type, data} messages; only those of a kind if one is given. Broken texts are left out."""
    m = F.from_json(F.col(text), CONTROL)
    out = df.withColumn("_m", m).where("_m.type is not null").select(*df.columns, "_m.type", "_m.data")
    return out if kind is None else out.where(F.col("type") == kind)


def embedded_program(df: DataFrame, html: str) -> DataFrame:
    """Title, status, times and best quality out of the JSON embedded in a programme page; null where members are missing."""
    j = embedded_json(F.col(html))
    get = lambda path: F.get_json_object(j, path)
    return df.select("*", get("$.program.title").alias("title"), get("$.program.status").alias("status"), get("$.program.beginTime").try_cast("bigint").alias("begin_time"), get("$.program.endTime").try_cast("bigint").alias("end_time"), get("$.program.stream.maxQuality").alias("max_quality"), get("$.site.relive.webSocketUrl").alias("socket_url"))


def available_qualities(qualities: Column) -> Column:
    """ids of array<struct(id, isAvailable)> that are available; missing means not."""
    return F.transform(F.filter(qualities, lambda q: F.coalesce(q["isAvailable"], L(False))), lambda q: q["id"])


def quality_pairs(videos: DataFrame, audios: DataFrame, video: str, audio: str) -> DataFrame:
    """Every video quality with every audio quality: both lists are of one programme, a handful each."""
    return videos.select(video).crossJoin(audios.select(audio)).select(F.array(video, audio).alias("pair"))


STREAMS = "streaming_url_list array<struct<id:bigint,url:string,type:string,quality:bigint,is_default:boolean>>"


def live_streams(df: DataFrame, text: str, preferred: str = "lhls") -> DataFrame:
    """df with `best`: the stream of highest quality in a stream list, those of the preferred type first, of equals the last."""
    rows = F.from_json(F.col(text), STREAMS)["streaming_url_list"]
    scored = F.transform(rows, lambda s, i: F.struct((F.coalesce(s["quality"], L(0)) + F.when(s["type"] == preferred, 1_000_000).otherwise(0)).alias("score"), i.alias("i"), s["url"].alias("url"), s["type"].alias("type")))
    return df.withColumn("best", F.array_max(scored))


def timeshift_stream(df: DataFrame, text: str) -> DataFrame:
    """df with `stream`: of {streaming_url_list: {name: url or {hls|hls_all: url}}} the all-quality list, else the source, else any."""
    m = F.from_json(F.get_json_object(F.col(text), "$.streaming_url_list"), "map<string,string>")
    one = preferred_member(m, ["hls_all", "hls_source"])
    return df.withColumn("stream", F.coalesce(F.get_json_object(one, "$.hls"), F.get_json_object(one, "$.hls_all"), one))


def is_live(status: Column, live_id: Column) -> Column:
    return (F.coalesce(status, L(0)) == 2) | (F.coalesce(live_id, L(0)) != 0)


def viewer_statistics(df: DataFrame, text: str) -> DataFrame:
    """df with viewers, comments, ad_points and gift_points of statistics messages; other messages have nulls."""
    get = lambda name: F.get_json_object(text, f"$.data.{name}").try_cast("bigint")
    is_stat = F.get_json_object(text, "$.type") == "statistics"
    return df.select("*", *[F.when(is_stat, get(n)).alias(out) for n, out in (("viewers", "viewers"), ("comments", "comments"), ("adPoints", "ad_points"), ("giftPoints", "gift_points"))])


def stream_address(messages: DataFrame, text: str, key: list[str], order: str) -> DataFrame:
    """(key, uri): the playlist address of the last `stream` message of each connection; feed it to the playlist readers, live or archived."""
    rows = control_messages(messages, text, "stream").where(F.col("data")["uri"].isNotNull())
    return rows.groupBy(*key).agg(F.max_by(F.col("data")["uri"], order).alias("uri"))


def room_records(df: DataFrame, text: str) -> DataFrame:
    """df with room_id, room_name, is_live and live_id of room documents in any of their three forms: status, profile, live info."""
    j = lambda *paths: F.coalesce(*[F.get_json_object(text, p) for p in paths])
    status, live = j("$.live_status").try_cast("bigint"), j("$.live_id").try_cast("bigint")
    flag = j("$.is_onlive", "$.is_live") == "true"
    return df.select("*", j("$.room_id", "$.id").try_cast("bigint").alias("room_id"), j("$.room_name", "$.main_name", "$.name").alias("room_name"), (F.coalesce(flag, L(False)) | is_live(status, live)).alias("is_live"), live.alias("room_live_id"))


def backward_segment(pages: DataFrame, key: list[str], page: str, body: str) -> DataFrame:
    """(key, page, segment_uri, snapshot_uri, until): of each chain of pages, the first that carries a backward segment."""
    rows = pages.select(*key, page, *[F.get_json_object(body, f"$.backward.{a}").alias(b) for a, b in (("segment.uri", "segment_uri"), ("snapshot.uri", "snapshot_uri"), ("until", "until"))], F.get_json_object(body, "$.backward").alias("_b"))
    from ..operators.select import top_row

    return top_row(rows.where("_b is not null").drop("_b"), key, [F.col(page)])


def download_address(page: Column, host: Column) -> Column:
    """The download address of a file page: the folder's last member behind the host's download script."""
    return F.concat(L("https://"), host, L("/download.php?file="), F.regexp_extract(page, r"/([^/?#]+)[^/]*$", 1))
