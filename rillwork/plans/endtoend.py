"""Whole-table checks of the parts that work together: playlists that lead to playlists, keys, inspectors, assembled files, records of sites.

Fetching is checked against an invented site whose answers follow from the address alone, so SQL can say what must come out.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ciphers, columns
from ..operators import comments, merge, select
from ..operators.inspect import Found, Inspector, Inspectors
from ..session import work_path
from ..sources import dash, hls, records
from .segments import _SEG, segments
from .tables import table

L = F.lit
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


# -- an invented site


def _media(n: int, ended: bool) -> str:
    key = f'#EXT-X-KEY:METHOD=AES-128,URI="http://keys.example/{n % 7}"\n' if n % 2 else ""
    return "#EXTM3U\n" + key + "".join(f"#EXTINF:2,\ns{i}.ts\n" for i in range(n % 4 + 1)) + ("#EXT-X-ENDLIST\n" if ended else "")


def site(url: str, byte_range: object, headers: dict) -> bytes:
    """Answers of the invented site."""
    if url.startswith("http://keys.example/"):
        return hashlib.md5(url.encode()).digest()
    n, page = re.fullmatch(r"http://h\.example/(\d+)/(\w+)", url).groups()
    n = int(n)
    if n % 5 == 4:
        raise FileNotFoundError(url)
    sound = '#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="g",URI="sound",DEFAULT=YES,AUTOSELECT=YES\n'
    if page == "index" and n % 3:
        return f'#EXTM3U\n{sound}#EXT-X-STREAM-INF:BANDWIDTH=1,AUDIO="g"\nsmall\n#EXT-X-STREAM-INF:BANDWIDTH=2,AUDIO="g"\nlarge\n'.encode()
    if page == "large" and n % 3 == 2:
        return b"#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1\ndeep\n"
    return _media(n, n % 4 < 2 if page == "sound" else n % 2 == 0).encode()


_STREAMS = """st as (
  select p_partkey n, 0 stream_id, 'http://h.example/' || p_partkey || case when p_partkey % 5 = 4 or p_partkey % 3 = 0 then '/index' when p_partkey % 3 = 1 then '/large' else '/deep' end url, p_partkey % 5 <> 4 there, p_partkey % 2 = 0 ended from part
  union all select p_partkey, 1, 'http://h.example/' || p_partkey || '/sound', true, p_partkey % 4 < 2 from part where p_partkey % 5 <> 4 and p_partkey % 3 > 0)"""


def _media_of_parts(spark: SparkSession, d: str) -> DataFrame:
    return hls.resolve_media(table(spark, d, "part").select(F.concat(L("http://h.example/"), "p_partkey", L("/index")).alias("url")), site, 8, 1)


def _number(c: str):
    return F.regexp_extract(c, r"example/(\d+)/", 1).cast("bigint")


@query(f"with {_STREAMS} select n, stream_id, url, there, case when not there then 'missing' end error_kind from st")
def hls_recursive(spark: SparkSession, d: str) -> DataFrame:
    """Masters followed to their media playlists, one of three over another master; missing ones are rows."""
    m = _media_of_parts(spark, d)
    return m.select(_number("entry").alias("n"), "stream_id", "url", F.col("content").isNotNull().alias("there"), "error_kind")


@query(f"with {_STREAMS} select n, count(*) streams, bool_and(there and ended) as ended from st group by n")
def hls_streams_ended(spark: SparkSession, d: str) -> DataFrame:
    return hls.streams_ended(_media_of_parts(spark, d)).select(_number("entry").alias("n"), "streams", "ended")


@query(f"""with {_STREAMS} select n, stream_id, s.i as sequence, case when n % 2 = 1 then upper(md5('http://keys.example/' || n % 7)) end as key
  from st, lateral (select unnest(range(0, (n % 4 + 1)::bigint)) i) s where there""")
def hls_keys_once(spark: SparkSession, d: str) -> DataFrame:
    """Segments with the bytes of their keys, every key fetched once."""
    rows = hls.with_keys(hls.resolved_segments(_media_of_parts(spark, d)), site)
    return rows.select(_number("entry").alias("n"), "stream_id", "sequence", F.hex("key_bytes").alias("key"))


# -- inspectors


def _short(url: str, path: dict, query: dict, arguments: dict) -> list[Found]:
    n = int(path["n"])
    return [Found("redirect", f"http://short.example/{n // 2}")] if n % 2 == 0 and n else [Found("redirect", f"http://site.example/watch/{n}")]


def _watch(url: str, path: dict, query: dict, arguments: dict) -> list[Found]:
    n = int(path["n"])
    if n % 5 == 1:
        return [Found("candidate", f"http://site.example/list/{n}/{i}", f"c{i}") for i in range(3)]
    return [Found("none")] if n % 5 == 3 else [Found("playlist", f"http://cdn.example/{n}.m3u8", f"t{n}")]


def _listed(url: str, path: dict, query: dict, arguments: dict) -> list[Found]:
    return [Found("playlist", f"http://cdn.example/{path['n']}-{path['i']}-{part}.m3u8", arguments["name"]) for part in "ab"]


@query("""with recursive r as (select p_partkey s, p_partkey p, 0 h from part union all select s, p // 2, h + 1 from r where p % 2 = 0 and p > 0),
  e as (select s, arg_max(p, h) p, max(h) h from r group by s)
  select s as n, 'listed' as inspector, 'http://cdn.example/' || p || '-2-' || x || '.m3u8' playlist_url, 'by' as title, h + 2 as hops from e, (values ('a'), ('b')) v(x) where p % 5 = 1
  union all select s, 'watch', case when p % 5 <> 3 then 'http://cdn.example/' || p || '.m3u8' end, case when p % 5 <> 3 then 't' || p end, h + 1 from e where p % 5 <> 1""")
def inspectors(spark: SparkSession, d: str) -> DataFrame:
    """Short addresses followed over any number of redirects to their watch page, candidates chosen, playlists listed."""
    known = Inspectors(Inspector("short", (("http", "short.example", "/{n}"),), _short), Inspector("watch", (("http", "site.example", "/watch/{n}"),), _watch), Inspector("listed", (("http", "site.example", "/list/{n}/{i}"),), _listed, arguments={"name": "title"}))
    urls = table(spark, d, "part").select(F.concat(L("http://short.example/"), "p_partkey").alias("url"))
    found = known.inspect(urls, "url", {"name": "by"}, choose=lambda titles: len(titles) - 1)
    return found.select(F.regexp_extract("url", r"/(\d+)$", 1).cast("bigint").alias("n"), "inspector", "playlist_url", "title", "hops")


# -- assembling


_PRESENTED = f"""{_SEG}, pr as (select *, l_linenumber % (l_suppkey % 3 + 1) st, not (l_suppkey % 10 = 3 and l_quantity = 50) ok, case when l_suppkey % 4 = 1 then 'mp4' else 'ts' end kind from seg),
  ac as (select l_suppkey, case when not bool_and(ok) then 'skip' when count(distinct st) > 1 or min(kind) = 'mp4' then 'mux' else 'concat' end act from pr group by l_suppkey)"""


@query(f"""with {_PRESENTED} select l_suppkey, act as action, sum(length(l_orderkey::varchar))::bigint as bytes from pr join ac using (l_suppkey) where act <> 'skip' group by l_suppkey, act, st
  union all select l_suppkey, act, null from ac where act = 'skip'""")
def merge_executed(spark: SparkSession, d: str) -> DataFrame:
    """The merge plan of every supplier's parts carried out: files written, presentations with a failure skipped."""
    rows = segments(spark, d).select("l_suppkey", (F.col("l_linenumber") % (F.col("l_suppkey") % 3 + 1)).alias("st"), "l_orderkey", "sequence", (~((F.col("l_suppkey") % 10 == 3) & (F.col("l_quantity") == 50))).alias("ok"), F.when(F.col("l_suppkey") % 4 == 1, "mp4").otherwise("ts").alias("kind"), F.col("l_orderkey").cast("string").cast("binary").alias("data"))
    at = work_path(spark, "merged")
    name = F.concat(L(f"{at}/"), F.col("l_suppkey"), L("."), F.col("st"))
    return merge.execute_merge(rows, ["l_suppkey"], "st", ["l_orderkey", "sequence"], "ok", "kind", "data", name).select("l_suppkey", "action", "bytes")


@query("select doc_id, case when doc_id % 4 < 2 then md5(url) else md5('init') || md5(url) end as data from documents")
def init_and_key_cases(spark: SparkSession, d: str) -> DataFrame:
    """As it came, deciphered, behind a clear initialisation part, and deciphered together with it."""
    key, iv = F.unhex(F.md5(F.col("doc_id").cast("string"))), F.unhex(L("000102030405060708090a0b0c0d0e0f"))
    init, data = F.encode(F.md5(L("init")), "UTF-8"), F.encode(F.md5("url"), "UTF-8")
    case, none = F.col("doc_id") % 4, L(None).cast("binary")
    sent = F.when(case == 1, ciphers.encrypt_cbc(data, key, iv)).when(case == 3, F.substring(ciphers.encrypt_cbc(F.concat(init, data), key, iv), L(33), L(1 << 20))).otherwise(data)
    first = F.when(case == 2, init).when(case == 3, F.substring(ciphers.encrypt_cbc(F.concat(init, data), key, iv), L(1), L(32))).otherwise(none)
    out = ciphers.segment_bytes(sent, F.when(case.isin(1, 3), key), iv, first, case == 3)
    return table(spark, d, "documents").select("doc_id", F.decode(out, "UTF-8").alias("data"))


@query(f"with {_SEG}, f as (select l_orderkey, sequence, min('/c/' || l_partkey || '.ts') p from seg where l_returnflag = 'R' group by all) select l_orderkey, sequence, p as cached_path from seg left join f using (l_orderkey, sequence)")
def cached_file_join(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).select("l_orderkey", "sequence", "l_returnflag", "l_partkey")
    files = s.where("l_returnflag = 'R'").select("l_orderkey", "sequence", F.concat(L("/c/"), "l_partkey", L(".ts")).alias("path"))
    return merge.with_cached_file(s.select("l_orderkey", "sequence"), files, ["l_orderkey", "sequence"])


@query(f"""with {_SEG}, k as (select l_orderkey, sequence, case l_returnflag when 'A' then 'audio' when 'R' then 'video' else 'data' end kind from seg)
  select l_orderkey, sequence, kind, row_number() over (partition by l_orderkey order by sequence) - 1 as output_index from k where kind <> 'data'""")
def output_stream_map(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "audio").when(F.col("l_returnflag") == "R", "video").otherwise("data")
    return merge.output_streams(segments(spark, d).select("l_orderkey", "sequence", kind.alias("kind")), ["l_orderkey"], [F.col("sequence")], "kind")


@query(f"with {_SEG} select l_orderkey, arg_max(l_partkey, sequence) as last from seg group by l_orderkey")
def last_emitted(spark: SparkSession, d: str) -> DataFrame:
    return merge.last_emitted(segments(spark, d), ["l_orderkey"], F.col("sequence"), "l_partkey")


@query("select p_brand, p_partkey, p_name from part qualify row_number() over (partition by p_brand order by p_partkey) = 1")
def first_candidate(spark: SparkSession, d: str) -> DataFrame:
    return select.first_candidate(table(spark, d, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], "p_partkey")


@query("select delivery_id, row_number() over (partition by live_id order by date_sec, vpos nulls first, delivery_id) - 1 as position from chat_comments")
def comment_date_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chat_comments").select("delivery_id", "live_id", F.col("date_sec").alias("date"), "vpos")
    return comments.by_date(rows, ["live_id"], "delivery_id").select("delivery_id", "position")


# -- records of sites


@query("""select live_id, case when live_id % 2 = 0 then live_id * 3 end viewers, case when live_id % 2 = 0 then live_id end as comments, null::bigint as ad_points from programs""")
def viewer_statistics(spark: SparkSession, d: str) -> DataFrame:
    body = F.to_json(F.struct(F.when(F.col("live_id") % 2 == 0, "statistics").otherwise("seat").alias("type"), F.struct((F.col("live_id") * 3).alias("viewers"), F.col("live_id").alias("comments")).alias("data")))
    return records.viewer_statistics(table(spark, d, "programs").select("live_id", body.alias("t")), "t").select("live_id", "viewers", "comments", "ad_points")


@query("""select live_id, title as room_name, lower(status) = 'on_air' as is_live from programs""")
def room_records(spark: SparkSession, d: str) -> DataFrame:
    p, n = table(spark, d, "programs"), F.col("live_id") % 3
    on = F.lower("status") == "on_air"
    one = F.to_json(F.struct(F.col("live_id").alias("room_id"), F.col("title").alias("room_name"), F.when(on, 2).otherwise(1).alias("live_status")))
    two = F.to_json(F.struct(F.col("live_id").alias("room_id"), F.col("title").alias("main_name"), on.alias("is_onlive")))
    three = F.to_json(F.struct(F.col("live_id").alias("id"), F.col("title").alias("name"), F.when(on, F.col("live_id")).otherwise(0).alias("live_id")))
    rows = p.select(F.col("live_id").alias("program"), F.when(n == 0, one).when(n == 1, two).otherwise(three).alias("t"))
    return records.room_records(rows, "t").select(F.col("program").alias("live_id"), "room_name", "is_live")


@query("""with p as (select view_id, backward_id, segment_uri, snapshot_uri from backward_segments)
  select view_id, backward_id as page, segment_uri, snapshot_uri from p qualify row_number() over (partition by view_id order by backward_id) = 1""")
def backward_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Of each chain of pages the first with a backward segment; pages without one lie between."""
    b = table(spark, d, "backward_segments")
    body = F.to_json(F.struct(F.struct(F.struct(F.col("segment_uri").alias("uri")).alias("segment"), F.struct(F.col("snapshot_uri").alias("uri")).alias("snapshot"), F.lit("x").alias("until")).alias("backward")))
    pages = b.select("view_id", F.col("backward_id").alias("page"), body.alias("body")).unionByName(b.select("view_id", (F.col("backward_id") - 1000000).alias("page"), L('{"next":{"uri":"n"}}').alias("body")))
    return records.backward_segment(pages, ["view_id"], "page", "body").select("view_id", "page", "segment_uri", "snapshot_uri")


@query("""select live_id, trim(title) title, status, case when live_id % 3 > 0 then ['high', 'low'] else ['high'] end as qualities from programs where title is not null""")
def embedded_pages(spark: SparkSession, d: str) -> DataFrame:
    """Programme pages with escaped JSON in an attribute, and the qualities that can be had."""
    escape = lambda c: F.replace(F.replace(F.replace(c, L("&"), L("&amp;")), L('"'), L("&quot;")), L("<"), L("&lt;"))
    doc = F.to_json(F.struct(F.struct(F.trim("title").alias("title"), "status").alias("program")))
    page = F.concat(L('<html><div id="embedded" data-props="'), escape(doc), L('"></div>'))
    q = F.array(F.struct(L("high").alias("id"), L(True).alias("isAvailable")), F.struct(L("low").alias("id"), (F.col("live_id") % 3 > 0).alias("isAvailable")), F.struct(L("odd").alias("id"), L(None).cast("boolean").alias("isAvailable")))
    rows = table(spark, d, "programs").where("title is not null").select("live_id", page.alias("h"), records.available_qualities(q).alias("qualities"))
    return records.embedded_program(rows, "h").select("live_id", "title", "status", "qualities")


@query("""select doc_id, case doc_id % 4 when 0 then 'hls' when 2 then 'hls' else 'dash' end as kind from documents""")
def manifest_kinds(spark: SparkSession, d: str) -> DataFrame:
    """By address, by type and by content."""
    n = F.col("doc_id") % 4
    url = F.concat(L("http://h.example/"), F.col("doc_id"), F.when(n == 0, ".m3u8").when(n == 1, ".mpd").otherwise("/x"))
    body = F.when(n == 2, L("#EXTM3U\n")).otherwise(L("text"))
    return table(spark, d, "documents").select("doc_id", columns.manifest_kind(url, L(None).cast("string"), body).alias("kind"))


# -- inheritance


@query("""select p_partkey, i.i as number, 'http://h.example/' || p_partkey || '/' || case when p_partkey % 2 = 0 then 'p/' else '' end || 'a/' || case p_partkey % 3 when 0 then 'r' when 1 then 's' else 'q' end || i.i || '.m4s' uri,
  case when p_partkey % 5 = 0 then 'audio' else 'video' end as kind from part, lateral (select unnest(range(1, 4::bigint)) i) i""")
def dash_inheritance(spark: SparkSession, d: str) -> DataFrame:
    """Base addresses of four levels, templates of three, types from the set or its representation."""
    n = F.col("p_partkey")
    at = lambda level, c: F.when(n % 3 == level, L(f'<SegmentTemplate timescale="1" duration="2" media="{c}$Number$.m4s"/>')).otherwise("")
    mime = F.when(n % 5 == 0, "audio/mp4").otherwise("video/mp4")
    text = F.concat(
        L('<MPD type="static"><BaseURL>'), n, L('/</BaseURL><Period duration="PT6S">'), F.when(n % 2 == 0, "<BaseURL>p/</BaseURL>").otherwise(""), at(2, "q"), L("<AdaptationSet"), F.when(n % 2 == 0, F.concat(L(' mimeType="'), mime, L('"'))).otherwise(""), L("><BaseURL>a/</BaseURL>"), at(1, "s"),
        L('<Representation id="x" bandwidth="1"'), F.when(n % 2 == 1, F.concat(L(' mimeType="'), mime, L('"'))).otherwise(""), L(">"), at(0, "r"), L("</Representation></AdaptationSet></Period></MPD>"),
    )
    rows = dash.plan(table(spark, d, "part").select(F.concat(L("http://h.example/index?"), n).alias("url"), text.alias("content")))
    return rows.select(F.regexp_extract("url", r"\?(\d+)$", 1).cast("bigint").alias("p_partkey"), "number", F.regexp_replace("uri", r"\?.*$", "").alias("uri"), "kind")


# -- ordered reassembly as a stream


@query(f"""with {_SEG}, o as (select *, row_number() over (partition by l_suppkey order by l_orderkey, sequence) - 1 n from seg) select l_suppkey as stream_id, n as sequence, l_returnflag <> 'R' as success, n as position from o""")
def reassembled_stream(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier's rows as a stream that arrives in three batches out of order; what comes out is in order and whole."""
    from pyspark.sql import Window

    from ..streaming.reassembly import reassemble

    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "sequence")) - 1
    rows = segments(spark, d).select(F.col("l_suppkey").cast("bigint").alias("stream_id"), n.cast("bigint").alias("sequence"), (F.col("l_returnflag") != "R").alias("success"), F.col("l_orderkey").cast("string").alias("item"))
    at = work_path(spark, "stream")
    for i in (2, 0, 1):
        rows.where(F.pmod("sequence", L(3)) == i).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema("stream_id bigint, sequence bigint, success boolean, item string").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    q = reassemble(stream).writeStream.format("parquet").option("checkpointLocation", f"{at}/ck").option("path", f"{at}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out").where("not late").select("stream_id", "sequence", "success", "position")


# -- single operators over whole tables


@query("""with v(i, p) as (values (0, '6BC1BEE22E409F96E93D7E117393172A'), (1, 'AE2D8A571E03AC9C9EB76FAC45AF8E51'), (2, '30C81C46A35CE411E5FBC1191A0A52EF'), (3, 'F69F2445DF4F9B17AD2B417BE66C3710'))
  select p_partkey, p as plain from part join v on p_partkey % 4 = i""")
def aes_known_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The public test vectors of AES-128 in CBC mode, block by block, without padding."""
    # fixed values: NIST SP 800-38A, F.2.1
    key, iv = F.unhex(L("2B7E151628AED2A6ABF7158809CF4F3C")), "000102030405060708090A0B0C0D0E0F"
    sent = ["7649ABAC8119B246CEE98E9B12E9197D", "5086CB9B507219EE95DB113A917678B2", "73BED6B8E3C1743B7116E69E22229516", "3FF1CAA1681FAC09120ECA307586E1A7"]
    n = (F.col("p_partkey") % 4).cast("int")
    block, before = F.unhex(F.get(F.array(*map(L, sent)), n)), F.unhex(F.get(F.array(L(iv), *map(L, sent[:3])), n))
    return table(spark, d, "part").select("p_partkey", F.hex(ciphers.decrypt_cbc_bare(block, key, before)).alias("plain"))


@query("""select p_partkey, s.i as sequence, 'http://h.example/' || p_partkey || '/s' || s.i || '.ts' uri, s.i - 1 as position from part, lateral (select unnest(range(1, least(3, p_partkey % 5 + 1)::bigint)) i) s""")
def hls_archive(spark: SparkSession, d: str) -> DataFrame:
    """Masters with their media playlists in one table; the second and third segment of each, in order."""
    n = F.col("p_partkey")
    base = F.concat(L("http://h.example/"), n)
    lines = F.array_join(F.transform(F.sequence(L(0), (n % 5).cast("int")), lambda i: F.concat(L("#EXTINF:2,\ns"), i.cast("string"), L(".ts\n"))), "")
    p = table(spark, d, "part")
    masters = p.select(F.concat(base, L("/top")).alias("url"), L("#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1\nmedia\n").alias("content"))
    media = p.select(F.concat(base, L("/media")).alias("url"), F.concat(L("#EXTM3U\n"), lines, L("#EXT-X-ENDLIST\n")).alias("content"))
    rows = hls.plan_archive(masters.unionByName(media), 2, 3)
    return rows.select(_number("entry").alias("p_partkey"), "sequence", "uri", "position")


@query("""select p_partkey, array_to_string([p_name, 'a b', p_partkey::varchar, 'c"d'], '|') as words from part""")
def shell_words_split(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.urls import shell_words

    text = F.concat(L("'"), "p_name", L("' \"a b\"   "), F.col("p_partkey"), L(" c\\\"d"))
    return table(spark, d, "part").select("p_partkey", F.array_join(shell_words(text), "|").alias("words"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, (1000000 + floor((l_partkey - l_suppkey) * 1000000 / 90))::bigint as at_us from lineitem""")
def sample_times(spark: SparkSession, d: str) -> DataFrame:
    at = columns.sample_time(L(1_000_000).cast("bigint"), F.col("l_suppkey"), F.col("l_partkey"), L(90))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", at.alias("at_us"))


@query("""select event_id, case event_id % 3 when 2 then null else floor(epoch(ts))::bigint end as seconds from events""")
def instants_parsed(spark: SparkSession, d: str) -> DataFrame:
    """ISO 8601, RFC 2822 and neither."""
    n, ts = F.col("event_id") % 3, F.date_trunc("second", F.col("ts").cast("timestamp"))
    text = F.when(n == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n == 1, F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss '+0000'")).otherwise("soon")
    return table(spark, d, "events").select("event_id", F.unix_seconds(columns.parse_instant(text)).alias("seconds"))


@query("""select event_id, event_id * 3 as date, case when event_id % 2 = 0 then 0 else event_id % 1000 end as date_usec from events""")
def proto_times(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    t = columns.proto_time(n * 3, F.when(n % 2 == 1, (n % 1000) * 1000 + 7))
    return table(spark, d, "events").select("event_id", t.alias("t")).select("event_id", "t.date", "t.date_usec")


@query("""select p_partkey, case p_partkey % 3 when 0 then '/vote start ' || p_name || ' ' || p_brand || ' ' || p_type when 1 then '/vote showresult per ' || p_size || ' 0' else '/vote stop' end as command from part""")
def poll_commands(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey") % 3
    choices = F.array(F.struct(F.col("p_brand").alias("description"), F.col("p_size").cast("bigint").alias("per_mille")), F.struct(F.col("p_type").alias("description"), L(None).cast("bigint").alias("per_mille")))
    return table(spark, d, "part").select("p_partkey", comments.poll_command(F.when(n == 0, "Poll").when(n == 1, "Result").otherwise("Closed"), F.col("p_name"), choices).alias("command"))


@query("""select doc_id, 'k=' || doc_id || coalesce('; Domain=' || lang, '') || case when doc_id % 2 = 0 then '; Path=/' else '' end || case when doc_id % 3 = 0 then '; Secure' else '' end as cookie from documents""")
def cookie_lines(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, d, "documents").select("doc_id", columns.cookie_text(L("k"), n.cast("string"), F.col("lang"), F.when(n % 2 == 0, "/"), n % 3 == 0).alias("cookie"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, (7 + l_partkey % 8000)::int as adts, ((l_partkey % 2048) + 1) * 2 as eac3 from lineitem""")
def frame_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths read back from headers that were written with them."""
    size, words = (F.col("l_partkey") % 8000 + 7).cast("int"), (F.col("l_partkey") % 2048).cast("int")
    byte = lambda c: F.lpad(F.hex(c.cast("bigint")), 2, "0")
    adts = F.unhex(F.concat(L("FFF150"), byte(F.shiftright(size, 11).bitwiseOR(0x80)), byte(F.shiftright(size, 3).bitwiseAND(255)), byte(F.shiftleft(size.bitwiseAND(7), 5).bitwiseOR(31)), L("FC")))
    eac3 = F.unhex(F.concat(L("0B77"), byte(F.shiftright(words, 8)), byte(words.bitwiseAND(255))))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", columns.adts_frame_length(adts).alias("adts"), columns.eac3_frame_length(eac3).cast("bigint").alias("eac3"))


@query("""select delivery_id, case when length(content) > 50 then '{\\fsp0\\fs30}' else '{\\fsp0}' end || content as line from chat_comments""")
def long_text_shrink(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chat_comments").select("delivery_id", columns.shrink(F.concat(L("{\\fsp0}"), "content"), F.char_length("content")).alias("line"))


@query("""select l_suppkey, l_linenumber as set_id, sum(l_quantity)::bigint as total from lineitem group by 1, 2""")
def availability_offsets(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.timeline import total_offset

    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_linenumber").alias("set_id"), "l_quantity")
    return total_offset(rows, ["l_suppkey", "set_id"], "l_quantity").select("l_suppkey", "set_id", F.col("offset").cast("bigint").alias("total"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, floor(l_partkey * 90000 / 44100.0 + 0.5)::bigint as ticks from lineitem""")
def ticks_rescaled(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.timeline import rescale

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", rescale(F.col("l_partkey"), L(44100), L(90000)).alias("ticks"))


@query("""select p_partkey, 2 * p_partkey + 1 as best_id from part""")
def live_stream_lists(spark: SparkSession, d: str) -> DataFrame:
    """Stream lists of rooms: the preferred type wins over higher quality, of equals the last."""
    n = F.col("p_partkey")
    s = lambda i, q, t: F.struct(i.alias("id"), i.cast("string").alias("url"), L(t).alias("type"), q.alias("quality"))
    text = F.to_json(F.struct(F.array(s(n, n * 10, "hls"), s(2 * n, L(5).cast("bigint"), "lhls"), s(2 * n + 1, L(5).cast("bigint"), "lhls"), s(n + 7, L(1).cast("bigint"), "lhls")).alias("streaming_url_list")))
    return records.live_streams(table(spark, d, "part").select("p_partkey", text.alias("t")), "t").select("p_partkey", F.col("best.url").cast("bigint").alias("best_id"))
