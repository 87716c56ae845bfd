"""Queries of the URL, text, chat and cipher operators on the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ciphers, columns, urls
from ..operators import comments, timeline
from ..sources import records
from ..sources.nested_json import flat_table, flatten_bodies
from . import problems
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


# -- URLs

_PATH = "regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*(/.*)$', 1)"


@query(f"""select doc_id, case when {_PATH} <> '' then regexp_extract({_PATH}, '([^/]*)$', 1) end as name, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as origin, regexp_extract(url, '([?][^#]*)', 1) as query from documents""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "documents").select("doc_id", urls.url_filename(u).alias("name"), urls.origin_of(u).alias("origin"), urls.query_of(u).alias("query"))


@query(f"""with f as (select doc_id, regexp_extract({_PATH}, '([^/]*)$', 1) as name from documents), e as (select doc_id, regexp_extract(name, '([^.]*)$', 1) ext from f)
  select doc_id, case when ext in ('mp4', 'm4s', 'm4f') then 'mp4' when ext in ('ts', 'm4a', 'cmfv', 'cmfa', 'aac') then ext when ext in ('txt', 'ass', 'srt', 'vtt', 'json') then 'raw' else 'other' end kind, case when ext in ('mp4', 'm4s', 'm4f') then 'mp4' else ext end ext from e""")
def file_format_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", columns.file_format(F.coalesce(urls.url_filename(F.col("url")), L(""))).alias("f")).select("doc_id", "f.kind", "f.ext")


_TYPE = r"trim(regexp_extract(headers, '(?:^|\n)[ \t]*[Cc][Oo][Nn][Tt][Ee][Nn][Tt]-[Tt][Yy][Pp][Ee][ \t]*:[ \t]*([^\r\n]*)', 1))"


@query(f"""select doc_id, nullif({_TYPE}, '') as content_type, case when headers is null or {_TYPE} = '' or starts_with({_TYPE}, 'video') then 'video' when starts_with({_TYPE}, 'audio') then 'audio' when starts_with({_TYPE}, 'text') then 'subtitle' else 'unknown' end as kind from documents""")
def mime_classify(spark: SparkSession, d: str) -> DataFrame:
    t = columns.header_value(F.col("headers"), "content-type")
    return table(spark, d, "documents").select("doc_id", t.alias("content_type"), columns.segment_type(t).alias("kind"))


@query("""with r as (select doc_id, url, case doc_id % 4 when 0 then 'https://cdn.example/x/' || doc_id || '.ts' when 1 then '/root/' || doc_id || '.ts' when 2 then 'part/' || doc_id || '.ts' else 'p.ts?own=' || doc_id end ref from documents),
  b as (select *, regexp_replace(url, '[?#].*$', '') bare, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) origin, regexp_extract(url, '([?][^#]*)', 1) q from r),
  f as (select *, origin || coalesce(nullif(regexp_extract(bare, '^[a-z]+://[^/]*(/.*/)[^/]*$', 1), ''), '/') folder from b)
  select doc_id, case when ref like 'https:%' then ref when ref like '/%' then origin || ref || q when ref like '%?%' then folder || ref else folder || ref || q end joined from f""")
def base_url_merge(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    ref = F.when(k == 0, F.concat(L("https://cdn.example/x/"), n, L(".ts"))).when(k == 1, F.concat(L("/root/"), n, L(".ts"))).when(k == 2, F.concat(L("part/"), n, L(".ts"))).otherwise(F.concat(L("p.ts?own="), n))
    return table(spark, d, "documents").select("doc_id", urls.join_base(F.col("url"), ref).alias("joined"))


RULES = [
    urls.Route("forum", "kilnforum.test|niebla-foro.test", "/forum/{topic}"),
    urls.Route("forum_any", "kilnforum.test|niebla-foro.test", "/{*rest}"),
    urls.Route("article", "*", "/a/{slug}"),
    urls.Route("news", "*", "/news/{slug}"),
    urls.Route("other", "*", "*"),
]


@query(f"""with u as (select doc_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) host, case when {_PATH} = '' then '/' else {_PATH} end path from documents),
  r as (select *, case when host in ('kilnforum.test', 'niebla-foro.test') then case when regexp_full_match(path, '/forum/[^/]+') then 'forum' when regexp_full_match(path, '/.+') then 'forum_any' end
    when regexp_full_match(path, '/a/[^/]+') then 'article' when regexp_full_match(path, '/news/[^/]+') then 'news' else 'other' end route from u)
  select doc_id, route, case route when 'forum' then path[8:] when 'forum_any' then path[2:] when 'article' then path[4:] when 'news' then path[7:] end param,
    case when route is not null and route <> 'other' then nullif(regexp_extract(url, '[?&]id=([^&#]*)', 1), '') end id from r""")
def route_first_match(spark: SparkSession, d: str) -> DataFrame:
    r = urls.route(table(spark, d, "documents").select("doc_id", "url"), "url", RULES)
    return r.select("doc_id", "route", F.coalesce(*[F.try_element_at("path_params", L(n)) for n in ("topic", "rest", "slug")]).alias("param"), F.try_element_at("query_params", L("id")).alias("id"))


@query("""select doc_id, lang || ' x' as a, doc_id::varchar as b, 3::bigint as n from documents where lang is not null""")
def query_params_last_wins(spark: SparkSession, d: str) -> DataFrame:
    u = F.concat(L("https://x.example/?a=1&b="), F.col("doc_id"), L("&a="), F.col("lang"), L("%20x&c"))
    p = urls.query_parameters(u)
    return table(spark, d, "documents").where("lang is not null").select("doc_id", F.element_at(p, "a").alias("a"), F.element_at(p, "b").alias("b"), F.size(p).cast("bigint").alias("n"))


# -- web records


@query(r"""select doc_id, replace(replace(replace(replace(replace(regexp_extract(text, '(?:^|\n)([^\n]*&[a-z]+;[^\n]*)', 1), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') decoded from documents""")
def html_entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", columns.decode_entities(F.regexp_extract("text", r"(?:^|\n)([^\n]*&[a-z]+;[^\n]*)", 1)).alias("decoded"))


@query("""select event_id, json_extract_string(props, '$.k') k, json_extract_string(props, '$.missing') missing from events""")
def json_path_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", columns.json_path(F.col("props"), "$.k").alias("k"), columns.json_path(F.col("props"), "$.missing").alias("missing"))


@query("""select event_id, event_type as type, json_extract_string(props, '$.k') k from events where event_type in ('view', 'click')""")
def control_messages(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(L('{"type":"'), "event_type", L('","data":'), "props", L("}"))
    e = table(spark, d, "events").select("event_id", text.alias("t"))
    m = records.control_messages(e, "t")
    return m.where(F.col("type").isin("view", "click")).select("event_id", "type", F.col("data")["k"].alias("k"))


@query("""select live_id, lower(status) = 'on_air' live from programs""")
def live_now(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.lower("status") == "on_air", 2).otherwise(1)
    return table(spark, d, "programs").select("live_id", records.is_live(s, L(0)).alias("live"))


@query("""select l_partkey, l_suppkey, l_linenumber, l_orderkey, upper(lpad(format('{:x}', l_partkey), 32, '0')) iv from lineitem""")
def iv_from_hex(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(F.col("l_linenumber") % 2 == 0, F.concat(L("0x"), F.lower(F.hex("l_partkey"))))
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_orderkey", F.hex(columns.iv_bytes(given, F.col("l_partkey"))).alias("iv"))


@query("""select p_partkey, md5('k' || p_partkey) kid, md5('v' || p_partkey) as key, 1::bigint as n from part""")
def clear_key_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_partkey").cast("string")
    text = F.concat(L("short:key;"), F.md5(F.concat(L("k"), n)), L(":"), F.md5(F.concat(L("old"), n)), L(";"), F.md5(F.concat(L("k"), n)), L(":"), F.md5(F.concat(L("v"), n)))
    m = columns.key_pairs(text)
    return table(spark, d, "part").select("p_partkey", F.get(F.map_keys(m), L(0)).alias("kid"), F.get(F.map_values(m), L(0)).alias("key"), F.size(m).cast("bigint").alias("n"))


@query("""select event_id, strftime(ts + interval 9 hour, '%Y-%m-%dT%H:%M:%S') tokyo, (floor(epoch(ts))::bigint * 1000000 + 500 - 1000)::bigint clock from events""")
def fixed_zone_and_clock(spark: SparkSession, d: str) -> DataFrame:
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", columns.in_zone(s).alias("tokyo"), columns.clock_offset(L(0), L(1000), s * 1_000_000).alias("clock"))


@query(r"""select live_id, regexp_replace(regexp_extract(coalesce(title, ''), '([^/]*)$', 1), '[\\/:*?"<>|]', '_', 'g') as name, 'p' || live_id || '.x.ts' as suffixed, 'p' || live_id || '.mp4' as replaced from programs""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    base = F.concat(L("p"), F.col("live_id"), L(".ts"))
    return table(spark, d, "programs").select("live_id", columns.safe_filename(F.coalesce("title", L(""))).alias("name"), columns.add_suffix(base, L(".x")).alias("suffixed"), columns.replace_extension(base, "mp4", ["ts", "m4a"]).alias("replaced"))


@query("""select doc_id, 'sid=' || doc_id || '; lang=' || coalesce(lang, 'xx') cookies, 'd' || doc_id as stem, case when doc_id % 2 = 0 then 'zip' else 'raw' end ext from documents""")
def cookies_and_dispositions(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    c = columns.cookie_pairs(F.array(F.concat(L("sid="), n, L("; Path=/; Secure")), F.concat(L("lang="), F.coalesce("lang", L("xx")), L("; Max-Age=5"))))
    header = F.when(F.col("doc_id") % 2 == 0, F.concat(L('attachment; filename="d'), n, L('.zip"'))).otherwise(F.concat(L("attachment; filename=d"), n))
    return table(spark, d, "documents").select("doc_id", c.alias("cookies"), columns.disposition_name(header).alias("f")).select("doc_id", "cookies", "f.stem", "f.ext")


# -- comments


def chat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chat_comments")


_CONTROL = " or ".join(f"contains(content, '{w}')" for w in comments.CONTROL_FRAGMENTS)


@query(f"select delivery_id from chat_comments where vpos is not null and not ({_CONTROL}) and coalesce(premium, 0) <> 2")
def word_blocklist(spark: SparkSession, d: str) -> DataFrame:
    return comments.displayed(chat(spark, d)).select("delivery_id")


@query("""select delivery_id, row_number() over (partition by live_id order by coalesce(vpos, 0), delivery_id) - 1 as position from chat_comments""")
def vpos_order(spark: SparkSession, d: str) -> DataFrame:
    return comments.in_order(chat(spark, d), ["live_id"], "delivery_id").select("delivery_id", "position")


@query("""select op_delivery_id, (epoch(o.at_ts)::bigint - epoch(p.begin_at)::bigint) * 100 vpos from operator_comments o join programs p using (live_id)""")
def vpos_derive(spark: SparkSession, d: str) -> DataFrame:
    # epoch rounds half up in the SQL cast: both sides work on whole seconds of the timestamps
    o = table(spark, d, "operator_comments").select("op_delivery_id", "live_id", F.round(F.unix_micros("at_ts") / 1e6).cast("bigint").alias("s"))
    p = table(spark, d, "programs").select("live_id", F.round(F.unix_micros("begin_at") / 1e6).cast("bigint").alias("b"))
    return o.join(p, "live_id").select("op_delivery_id", comments.operator_vpos(F.col("s"), F.col("b")).alias("vpos"))


@query("""with v as (select delivery_id, abs(vpos) v from chat_comments where vpos is not null), p as (select *, v // 100 s, v % 100 f from v)
  select delivery_id, case when length((s // 3600)::varchar) >= 2 then (s // 3600)::varchar else lpad((s // 3600)::varchar, 2, '0') end || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || (s % 60) || '.' || case when f % 10 = 0 then (f // 10)::varchar else lpad(f::varchar, 2, '0') end code from p""")
def timecodes(spark: SparkSession, d: str) -> DataFrame:
    return chat(spark, d).where("vpos is not null").select("delivery_id", columns.timecode(F.abs("vpos") / 100).alias("code"))


_TABLE = ", ".join(f"('{k}', '{v}')" for k, v in columns.COLOURS.items())


@query(f"""with colours(k, v) as (values {_TABLE}), w as (select delivery_id, unnest(string_split(coalesce(mail, ''), ' ')) w, generate_subscripts(string_split(coalesce(mail, ''), ' '), 1) i from chat_comments),
  c as (select delivery_id, arg_max(regexp_extract(w, '#([0-9A-Fa-f]{{6}})', 1), i) filter (where regexp_matches(w, '#[0-9A-Fa-f]{{6}}')) code, arg_max(v, i) filter (where v is not null) named from w left join colours on w.w = k group by delivery_id),
  f as (select delivery_id, coalesce(code, named, 'FFFFFF') x from c)
  select delivery_id, '\\1c&H' || x[5:6] || x[3:4] || x[1:2] || '&' || case when x = '000000' then '\\3c&HFFFFFF&' else '' end tag from f""".replace("\\\\", "\\"))
def colour_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return chat(spark, d).select("delivery_id", columns.colour_tag(columns.style_colour(F.col("mail"))).alias("tag"))


@query(r"""select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n, unnest(string_split(text, chr(10))) as line from documents""")
def line_explode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("doc_id", F.col("n").cast("bigint").alias("n"), "line")


@query(r"""select delivery_id, content[1:7] || case when length(content) > 7 then '\N' || content[8:14] else '' end || case when length(content) > 14 then '\N' || content[15:] else '' end wrapped, case when vpos % 10 = 0 then (vpos // 10)::varchar else (vpos // 10) || '.' || (vpos % 10) end pct from chat_comments where vpos >= 0""")
def option_wrap(spark: SparkSession, d: str) -> DataFrame:
    return chat(spark, d).where("vpos >= 0").select("delivery_id", columns.wrap_option(F.col("content")).alias("wrapped"), columns.per_mille_text(F.col("vpos")).alias("pct"))


def with_operators(spark: SparkSession, d: str) -> DataFrame:
    """Viewers' and operators' comments in one table: live_id, vpos, row_id, is_operator, content, mail, premium."""
    c = chat(spark, d).select("live_id", "vpos", F.col("delivery_id").alias("row_id"), L(False).alias("is_operator"), "content", "mail", "premium")
    at = F.floor(F.unix_micros("at_ts") / 10_000).cast("bigint")
    begin = table(spark, d, "programs").select("live_id", F.floor(F.unix_micros("begin_at") / 10_000).cast("bigint").alias("b"))
    mail = comments.style_words(F.col("modifier_position"), F.col("modifier_size"), F.col("modifier_color"), L(None).cast("string"), L(True))
    o = table(spark, d, "operator_comments").join(begin, "live_id").select("live_id", (at - F.col("b")).alias("vpos"), (F.col("op_delivery_id") + 1_000_000_000_000).alias("row_id"), L(True).alias("is_operator"), "content", mail.alias("mail"), L(3).cast("bigint").alias("premium"))
    return c.unionByName(o)


_BOTH = """o as (select live_id, epoch_us(at_ts) // 10000 - epoch_us(begin_at) // 10000 vpos, op_delivery_id + 1000000000000 row_id, true op from operator_comments join programs using (live_id)),
  a as (select live_id, vpos, delivery_id row_id, false op from chat_comments union all select * from o), s as (select * from a where vpos is not null)"""


@query(f"""with {_BOTH},
  w as (select *, first_value(case when op then vpos end ignore nulls) over (partition by live_id order by vpos, row_id rows between 1 following and unbounded following) nxt,
    min(vpos) over (partition by live_id order by vpos range between 1401 following and unbounded following) late from s)
  select row_id, case when nxt is not null and (late is null or nxt <= late) then nxt when late is not null then vpos + 800 end as until from w where op and (nxt is not null or late is not null)""")
def marquee_end(spark: SparkSession, d: str) -> DataFrame:
    rows = with_operators(spark, d).where("vpos is not null").select("live_id", "vpos", "row_id", "is_operator")
    return timeline.marquee_ends(rows, ["live_id"], "vpos", "row_id", "is_operator").select("row_id", "until")


@query("""with t as (select delivery_id, live_id, max(vpos) over (partition by live_id order by received_at, delivery_id rows unbounded preceding) top, received_at from chat_comments where vpos is not null)
  select delivery_id, row_number() over (partition by live_id, top order by received_at, delivery_id) burst from t""")
def burst_counter(spark: SparkSession, d: str) -> DataFrame:
    return timeline.burst_counter(chat(spark, d).where("vpos is not null"), ["live_id"], "vpos", ["received_at", "delivery_id"]).select("delivery_id", "burst")


@query()
def lane_allocation(spark: SparkSession, d: str) -> DataFrame:
    rows = comments.displayed(chat(spark, d)).where(comments.placement(F.col("mail")) == "scroll").select("live_id", "vpos", "delivery_id", F.char_length("content").alias("chars"))
    return comments.lanes(rows, "live_id", "vpos", "delivery_id", "chars").select("delivery_id", "lane")


@query()
def subtitle_events(spark: SparkSession, d: str) -> DataFrame:
    return comments.subtitle_events(with_operators(spark, d), "live_id", "row_id", "is_operator")


@query("""select delivery_id, json_extract_string(j, '$.content') content, json_extract(j, '$.vpos')::bigint vpos, json_exists(j, '$.name') named
  from (select delivery_id, name, case when name is null then json_object('content', content, 'vpos', vpos) else json_object('content', content, 'vpos', vpos, 'name', name) end j from chat_comments)""")
def comment_json(spark: SparkSession, d: str) -> DataFrame:
    j = chat(spark, d).select("delivery_id", comments.comment_json(chat(spark, d)).alias("j"))
    return j.select("delivery_id", F.get_json_object("j", "$.content").alias("content"), F.get_json_object("j", "$.vpos").cast("bigint").alias("vpos"), F.get_json_object("j", "$.name").isNotNull().alias("named"))


@query(f"""with c as ({problems.ORACLE["p5_chats"]}), m as (select * from ({problems.ORACLE["p5_modifiers"]}) where parent_entity = 'chat'),
  x as (select c.*, m.position, m.size, m.named_color, m.font, coalesce(raw_user_id, 0) = 0 anon from c left join m using (segment_id, msg_pos)),
  w as (select *, list_filter([case when anon then '184' end, nullif(position, 'naka'), nullif(size, 'medium'), nullif(named_color, 'white'), nullif(font, 'defont')], lambda v: v is not null) words from x)
  select segment_id, msg_pos, no, vpos, name, case when len(words) > 0 then array_to_string(words, ' ') end mail, case when anon then coalesce(hashed_user_id, '') else raw_user_id::varchar end user_id,
    case when account_status = 'Premium' then 1 end::bigint premium, case when anon then 1 end::int anonymity, content from w""")
def chat_message_rows(spark: SparkSession, d: str) -> DataFrame:
    """Comment rows out of the packed bodies: chats joined with their modifiers."""
    flat = flatten_bodies(table(spark, d, "packed_segments"), "segment_id", "body")
    chats, mods = flat_table(flat, "segment_id", "chat").drop("item_pos", "parent_entity"), flat_table(flat, "segment_id", "modifier").where("parent_entity = 'chat'")
    return comments.chat_rows(chats, mods, ["segment_id", "msg_pos"])


@query("""select delivery_id, case when list_contains(w, 'gothic') or list_contains(w, 'mincho') then 'art' else coalesce(list_extract(list_filter(w, lambda x: x in ('ue', 'shita')), -1), 'scroll') end place from (select delivery_id, string_split(coalesce(mail, ''), ' ') w from chat_comments)""")
def comment_placement(spark: SparkSession, d: str) -> DataFrame:
    return chat(spark, d).select("delivery_id", comments.placement(F.col("mail")).alias("place"))


# -- ciphers


@query("select doc_id, text from documents")
def aes_cbc_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    key, iv = F.unhex(F.md5(F.col("doc_id").cast("string"))), F.unhex(L("000102030405060708090a0b0c0d0e0f"))
    secret = ciphers.encrypt_cbc(F.encode("text", "UTF-8"), key, iv)
    t = table(spark, d, "documents").select("doc_id", ciphers.decrypt_cbc(secret, key, iv).alias("x"))
    return t.select("doc_id", F.decode("x", "UTF-8").alias("text"))


@query("select doc_id, md5(text) || md5(url) as data from documents")
def aes_nopad_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    key, iv = F.unhex(F.md5(F.col("doc_id").cast("string"))), F.unhex(L("000102030405060708090a0b0c0d0e0f"))
    whole = F.encode(F.concat(F.md5("text"), F.md5("url")), "UTF-8")  # 64 bytes: whole blocks
    secret = F.substring(ciphers.encrypt_cbc(whole, key, iv), L(1), F.octet_length(whole))
    return table(spark, d, "documents").select("doc_id", F.decode(ciphers.decrypt_cbc_bare(secret, key, iv), "UTF-8").alias("data"))


@query("select doc_id, md5('init') || md5(text) as data from documents")
def init_and_key(spark: SparkSession, d: str) -> DataFrame:
    """A segment is put behind its clear initialisation part and deciphered."""
    key, iv = F.unhex(F.md5(F.col("doc_id").cast("string"))), F.unhex(L("000102030405060708090a0b0c0d0e0f"))
    init, data = F.encode(F.md5(L("init")), "UTF-8"), ciphers.encrypt_cbc(F.encode(F.md5("text"), "UTF-8"), key, iv)
    return table(spark, d, "documents").select("doc_id", F.decode(ciphers.segment_bytes(data, key, iv, init, L(False)), "UTF-8").alias("data"))
