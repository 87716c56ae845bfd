"""HLS playlists as DataFrames: MANIFEST(url, content) to segments, variants and renditions.

A playlist is a line grammar in which tags hold for the next URI and some stay in force. Lines are exploded with their numbers and
everything else is window functions per playlist over line numbers: no state machine, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import file_format, iv_bytes
from ..functions.urls import join_base, segment_filename
from ..operators.fetch import Opener, fetch_texts, file_opener
from ..operators.select import best_rendition, best_variant
from ..operators.timeline import byte_offsets
from ..session import through_table

L = F.lit


def attribute(line: Column, name: str) -> Column:
    """Value of an attribute of a tag, without quotes; null where absent."""
    quoted = F.regexp_extract(line, rf'[:,]\s*{name}="([^"]*)"', 1)
    bare = F.regexp_extract(line, rf'[:,]\s*{name}=([^",]+)', 1)
    return F.coalesce(F.when(F.regexp_like(line, L(rf'[:,]\s*{name}="')), quoted), F.nullif(bare, L("")))


def playlist_lines(manifests: DataFrame) -> DataFrame:
    """(url, n, line): the lines of every playlist, trimmed, continued lines joined, empty ones left out."""
    text = F.regexp_replace(F.regexp_replace("content", r"\r\n?", "\n"), r"\\\n\s*", "")
    return manifests.select("url", F.posexplode(F.split(text, "\n")).alias("n", "line")).withColumn("line", F.trim("line")).where("line <> ''")


def is_master(content: Column) -> Column:
    return content.contains("#EXT-X-STREAM-INF")


def media_segments(manifests: DataFrame, base_iv_on_playlist: bool = False) -> DataFrame:
    """One row per segment of media playlists, in order.

    url, sequence (0..), media_sequence, uri, duration, title, byte_range, key, init, format, file_name, end_list. A key is struct(method, uri, iv); METHOD=NONE
    ends the one before. Range starts that are not given follow the range before. The default vector is the segment's own media sequence
    number; base_iv_on_playlist takes the playlist's first for all.

    Defined results: playlists without segments and null contents give no rows; a range tag may stand before or after the duration tag;
    tags that are not known are passed over.
    """
    w = Window.partitionBy("url").orderBy("n")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    line = F.col("line")
    tag = lambda name: F.when(line.startswith(f"#EXT-X-{name}:"), line)
    rows = playlist_lines(manifests.where(~is_master(F.col("content"))))
    uri = ~line.startswith("#")
    rows = rows.withColumn("_uri", uri).withColumn("_item", F.count_if(F.lag("_uri", 1, False).over(w)).over(so_far))  # lines up to a URI, with it
    key = tag("KEY")
    key = F.when(key.isNotNull(), F.struct(attribute(key, "METHOD").alias("method"), attribute(key, "URI").alias("uri"), attribute(key, "IV").alias("iv")))
    init = tag("MAP")
    init = F.when(init.isNotNull(), F.struct(attribute(init, "URI").alias("uri"), attribute(init, "BYTERANGE").alias("byte_range")))
    whole = Window.partitionBy("url")
    rows = (
        rows.withColumn("_key", F.last(key, True).over(so_far))
        .withColumn("_init", F.last(init, True).over(so_far))
        .withColumn("_base", F.max(F.regexp_extract(F.when(line.startswith("#EXT-X-MEDIA-SEQUENCE:"), line), r":\s*(\d+)", 1).try_cast("bigint")).over(whole))
        .withColumn("end_list", F.max(line == "#EXT-X-ENDLIST").over(whole))
    )
    item = Window.partitionBy("url", "_item")
    of_item = lambda c: F.max(c).over(item)
    inf = F.when(line.startswith("#EXTINF:"), line)
    ranged = F.when(line.startswith("#EXT-X-BYTERANGE:"), line)
    rows = (
        rows.withColumn("duration", of_item(F.regexp_extract(inf, r":\s*([0-9.]+)", 1).try_cast("double")))
        .withColumn("title", of_item(F.nullif(F.trim(F.regexp_extract(inf, r"^[^,]*,(.*)$", 1)), L(""))))
        .withColumn("_length", of_item(F.regexp_extract(ranged, r":\s*(\d+)", 1).try_cast("bigint")))
        .withColumn("_start", of_item(F.nullif(F.regexp_extract(ranged, r"@\s*(\d+)", 1), L("")).try_cast("bigint")))
        .where("_uri")
    )
    rows = byte_offsets(rows, ["url"], [F.col("n")], "_length", "_start", "_offset")
    rows = rows.withColumn("sequence", (F.row_number().over(w) - 1).cast("bigint")).withColumn("media_sequence", F.coalesce("_base", L(0)) + F.col("sequence"))
    vector = F.coalesce("_base", L(0)) if base_iv_on_playlist else F.col("media_sequence")
    on = (F.col("_key").isNotNull()) & (F.col("_key.method") != "NONE")
    byte_range = F.when(F.col("_length").isNotNull(), F.struct(F.col("_offset").alias("offset"), F.col("_length").alias("length")))
    located = rows.withColumn("_full", join_base(F.col("url"), line)).withColumn("byte_range", byte_range)
    name = segment_filename(F.col("_full"), F.col("byte_range").cast("string"))
    return located.select(
        "url", "sequence", "media_sequence", F.col("_full").alias("uri"), "duration", "title", "byte_range",
        F.when(on, F.struct("_key.method", join_base(F.col("url"), F.col("_key.uri")).alias("uri"), iv_bytes(F.col("_key.iv"), vector).alias("iv"))).alias("key"),
        F.when(F.col("_init.uri").isNotNull(), F.struct(join_base(F.col("url"), F.col("_init.uri")).alias("uri"), F.col("_init.byte_range"))).alias("init"),
        file_format(name).alias("format"), name.alias("file_name"), "end_list",
    )


def variants(manifests: DataFrame) -> DataFrame:
    """The variants of master playlists, in order: url, ordinal, uri, width, height, frame_rate, bandwidth, audio_group, video_group."""
    w = Window.partitionBy("url").orderBy("n")
    line = F.col("line")
    rows = playlist_lines(manifests.where(is_master(F.col("content"))))
    rows = rows.withColumn("_uri", F.lead("line").over(w)).where(line.startswith("#EXT-X-STREAM-INF"))
    size = F.split(attribute(line, "RESOLUTION"), "[xX]")
    return rows.select(
        "url", (F.row_number().over(w) - 1).alias("ordinal"), join_base(F.col("url"), F.col("_uri")).alias("uri"),
        F.get(size, L(0)).try_cast("int").alias("width"), F.get(size, L(1)).try_cast("int").alias("height"),
        attribute(line, "FRAME-RATE").try_cast("double").alias("frame_rate"), attribute(line, "BANDWIDTH").try_cast("bigint").alias("bandwidth"),
        attribute(line, "AUDIO").alias("audio_group"), attribute(line, "VIDEO").alias("video_group"),
    )


def renditions(manifests: DataFrame) -> DataFrame:
    """The alternatives of master playlists, in order: url, ordinal, media_type, group_id, uri (may be null), is_default, autoselect."""
    w = Window.partitionBy("url").orderBy("n")
    line = F.col("line")
    rows = playlist_lines(manifests.where(is_master(F.col("content")))).where(line.startswith("#EXT-X-MEDIA:"))
    yes = lambda name: F.coalesce(attribute(line, name) == "YES", L(False))
    uri = attribute(line, "URI")
    return rows.select("url", (F.row_number().over(w) - 1).alias("ordinal"), attribute(line, "TYPE").alias("media_type"), attribute(line, "GROUP-ID").alias("group_id"), F.when(uri.isNotNull(), join_base(F.col("url"), uri)).alias("uri"), yes("DEFAULT").alias("is_default"), yes("AUTOSELECT").alias("autoselect"))


def chosen_streams(manifests: DataFrame) -> DataFrame:
    """(url, stream_id, uri): the best variant as stream 0, then its audio and video renditions, addresses that come twice only once.

    A media playlist is its own stream 0. Only these playlists need fetching.
    """
    best = best_variant(variants(manifests), ["url"], "width", "frame_rate", "bandwidth", "ordinal")
    alt = renditions(manifests).where("uri is not null")
    wanted = best.select("url", F.explode(F.array(F.struct(L("AUDIO").alias("media_type"), F.col("audio_group").alias("group_id"), L(1).alias("stream_id")), F.struct(L("VIDEO").alias("media_type"), F.col("video_group").alias("group_id"), L(2).alias("stream_id")))).alias("g")).select("url", "g.*").where("group_id is not null")
    picked = best_rendition(alt.join(wanted, ["url", "media_type", "group_id"]), ["url", "stream_id"], "is_default", "autoselect", "ordinal")
    media = manifests.where(~is_master(F.col("content"))).select("url", L(0).alias("stream_id"), F.col("url").alias("uri"))
    streams = best.select("url", L(0).alias("stream_id"), "uri").unionByName(picked.select("url", "stream_id", "uri")).unionByName(media)
    return streams.groupBy("url", "uri").agg(F.min("stream_id").alias("stream_id")).select("url", "stream_id", "uri")


def plan_archive(manifests: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """The segments of each entry playlist's streams, cut to segment numbers first..last and numbered over all streams.

    `manifests` holds the entry playlists and the media playlists they lead to.
    """
    streams = chosen_streams(manifests).withColumnRenamed("url", "entry").withColumnRenamed("uri", "url")
    led_to = streams.where("entry <> url").select(F.col("url").alias("_u")).distinct()
    entries = streams.join(led_to, streams.entry == F.col("_u"), "left_anti")
    rows = entries.join(media_segments(manifests), "url").withColumn("number", F.col("sequence") + 1)
    rows = rows.where(F.col("number") >= first)
    rows = rows if last is None else rows.where(F.col("number") <= last)
    w = Window.partitionBy("entry").orderBy("stream_id", "sequence")
    return rows.drop("number").withColumn("position", (F.row_number().over(w) - 1).cast("bigint"))


# -- manifests that lead to others, keys


def resolve_media(entries: DataFrame, opener: Opener = file_opener, parallelism: int = 5, attempts: int = 3) -> DataFrame:
    """(entry, stream_id, url, content, error_kind, error): the media playlists that the addresses `entries.url` lead to, masters followed to any depth.

    A master's chosen variant and renditions are fetched next, and if one of them is a master again its own choice, until only media playlists
    are left. Streams of an entry are numbered in the order they are found. An address an entry has led to before is not followed again, so loops
    end; what cannot be fetched is a row with an error. Each round is written to the shared folder: rounds are as many as the chain is deep.
    """
    front = entries.where("url is not null").select(F.col("url").alias("entry"), "url", L("").alias("_at")).distinct()
    seen, done = front.select("entry", "url"), None
    while True:
        got = front.join(fetch_texts(front, "url", opener, parallelism, attempts), "url").withColumn("content", F.decode("content", "UTF-8"))
        got = through_table(got.select("entry", "url", "_at", "content", "error_kind", "error"), "manifests")
        master = is_master(F.coalesce("content", L("")))
        part = got.where(~master)
        done = part if done is None else done.unionByName(part)
        led = chosen_streams(got.where(master).select("url", "content").distinct()).select(F.col("url").alias("_from"), "stream_id", F.col("uri").alias("url"))
        nxt = got.where(master).select("entry", F.col("url").alias("_from"), "_at").join(led, "_from").select("entry", "url", F.concat("_at", F.lpad(F.col("stream_id").cast("string"), 3, "0")).alias("_at"))
        front = through_table(nxt.join(seen, ["entry", "url"], "left_anti").groupBy("entry", "url").agg(F.min("_at").alias("_at")), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("entry", "url"))
    w = Window.partitionBy("entry").orderBy("_at", "url")
    return done.withColumn("stream_id", (F.row_number().over(w) - 1).cast("bigint")).select("entry", "stream_id", "url", "content", "error_kind", "error")


def resolved_segments(media: DataFrame) -> DataFrame:
    """Segments of resolve_media's playlists with their entry and stream."""
    lists = media.where("content is not null")
    return lists.select("entry", "stream_id", "url").join(media_segments(lists.select("url", "content").distinct()), "url")


def streams_ended(media: DataFrame) -> DataFrame:
    """(entry, streams, ended): an entry has ended when every one of its streams has; one that could not be read has not."""
    end = F.coalesce(F.col("content").rlike(r"(?m)^\s*#EXT-X-ENDLIST"), L(False))
    return media.groupBy("entry").agg(F.count("*").alias("streams"), F.bool_and(end).alias("ended"))


def with_keys(segments: DataFrame, opener: Opener = file_opener, manual_key: str | None = None, parallelism: int = 5, attempts: int = 3) -> DataFrame:
    """segments with `key_bytes` and `key_error`: every distinct key address is fetched once, however many segments it is for.

    A manual key (hexadecimal) stands for all of them and nothing is fetched. Segments without a key have null in both. Only AES-128 keys are 16 bytes;
    others come as they are.
    """
    if manual_key is not None:
        return segments.withColumn("key_bytes", F.when(F.col("key").isNotNull(), F.unhex(L(manual_key)))).withColumn("key_error", L(None).cast("string"))
    keys = fetch_texts(segments.select(F.col("key.uri").alias("_key")), "_key", opener, parallelism, attempts)
    keys = through_table(keys.select(F.col("url").alias("_key"), F.col("content").alias("key_bytes"), F.col("error").alias("key_error")), "keys")
    return segments.join(keys, F.col("key.uri") == F.col("_key"), "left").drop("_key")
