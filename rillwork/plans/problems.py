"""Queries of the training-data problems that belong to the core: intervals, repeated deliveries, nested bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import merge_intervals
from ..operators.redelivery import WinnerStore, first_deliveries
from ..session import work_path
from ..sources.nested_json import ACCOUNTS, COLORS, FONTS, GUIDELINES, POSITIONS, SIZES, flat_table, flatten_bodies
from .tables import table


def view_intervals(spark: SparkSession, d: str) -> DataFrame:
    """(view_id, from_us, until_us) of all message segments and backward segments."""
    seg = table(spark, d, "message_segments").select("view_id", F.unix_micros("from_at").alias("from_us"), F.unix_micros("until_at").alias("until_us"))
    views = table(spark, d, "watch_views").select("view_id", F.unix_micros("vpos_base_at").alias("from_us")).distinct()
    back = table(spark, d, "backward_segments").select("view_id", F.unix_micros("until_at").alias("until_us")).dropna()
    return seg.unionByName(back.join(views, "view_id"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return merge_intervals(view_intervals(spark, d), ["view_id"], "from_us", "until_us")


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per view: time covered, time missing between the first and the last period, number of holes, longest hole."""
    length = F.col("until_us") - F.col("from_us")
    gap = F.col("kind") == "gap"
    return p1_found(spark, d).groupBy("view_id").agg(
        F.sum(F.when(~gap, length)).alias("covered_us"),
        F.coalesce(F.sum(F.when(gap, length)), F.lit(0)).cast("bigint").alias("missing_us"),
        F.count_if(gap).alias("gaps"),
        F.max(F.when(gap, length)).alias("longest_gap_us"),
    )


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    chat = table(spark, d, "chat_comments").select(F.lit("chat_comments").alias("table_name"), F.col("delivery_id").alias("row_id"), "id", "received_at")
    op = table(spark, d, "operator_comments").select(F.lit("operator_comments").alias("table_name"), F.col("op_delivery_id").alias("row_id"), "id", "received_at")
    return chat.unionByName(op)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    _, surplus = first_deliveries(spark, deliveries(spark, d), work_path(spark, "winners"), ["table_name", "id"], ["table_name", "row_id"], "received_at")
    return surplus.select("table_name", "row_id")


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """The one row of each identifier, out of the store; rows without an identifier are all kept."""
    rows = deliveries(spark, d)
    store, _ = first_deliveries(spark, rows, work_path(spark, "winners"), ["table_name", "id"], ["table_name", "row_id"], "received_at")
    return store.winners().select("table_name", "id", "row_id").unionByName(rows.where("id is null").select("table_name", "id", "row_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = flatten_bodies(table(spark, d, "packed_segments"), "segment_id", "body", fields=False)
    return rows.select("segment_id", "msg_pos", "entity", "item_pos")


def _typed(entity: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return flat_table(flatten_bodies(table(spark, d, "packed_segments"), "segment_id", "body"), "segment_id", entity)

    return query


#: The flat tables of bodies by the names of their queries; `message` rows have only their links.
TABLES = {
    "chats": "chat", "overflowed_chats": "overflowed_chat", "modifiers": "modifier", "gifts": "gift", "operator_comments": "operator_comment", "moderators": "moderator", "rankings": "ranking",
    "tags": "tag", "choices": "choice", "guideline_items": "guideline_item",
}


def p5_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = flatten_bodies(table(spark, d, "packed_segments"), "segment_id", "body", fields=False)
    return rows.where("entity = 'message'").select("segment_id", "msg_pos")


QUERIES = {
    "p5_messages": p5_messages,
    "p1_found": p1_found,
    "p1_coverage": p1_coverage,
    "p3_found": p3_found,
    "p3_kept": p3_kept,
    "p5_found": p5_found,
    **{f"p5_{name}": _typed(entity) for name, entity in TABLES.items()},
}

_ISLANDS = """
with iv as (
  select view_id, epoch_us(from_at) f, epoch_us(until_at) u from message_segments
  union all
  select b.view_id, epoch_us(v.vpos_base_at), epoch_us(b.until_at) from backward_segments b join watch_views v on v.view_id = b.view_id
), ok as (select * from iv where f is not null and u > f),
m as (select *, max(u) over (partition by view_id order by f, u rows between unbounded preceding and 1 preceding) p from ok),
g as (select *, sum(case when p is null or f > p then 1 else 0 end) over (partition by view_id order by f, u rows unbounded preceding) i from m),
c as (select view_id, i, min(f) f, max(u) u from g group by view_id, i),
found as (
  select view_id, 'covered' kind, f from_us, u until_us from c
  union all
  select view_id, 'gap', p, f from (select *, lag(u) over (partition by view_id order by i) p from c) where p is not null
)
"""

_RANKED = """
with d as (
  select 'chat_comments' table_name, id, delivery_id row_id, received_at from chat_comments
  union all
  select 'operator_comments', id, op_delivery_id, received_at from operator_comments
), r as (select *, row_number() over (partition by table_name, id order by received_at, row_id) n from d)
"""

_ELEMENTS = """
with b as (select segment_id, case when json_valid(body) then body::json end j from packed_segments),
m as (
  select segment_id, unnest(range(0, json_array_length(j, '$.messages')::bigint)) msg_pos, unnest(json_extract(j, '$.messages[*]')) m
  from b where json_type(j, '$.messages') = 'ARRAY'
),
w as (
  select segment_id, msg_pos,
    case when json_type(m, '$.payload') = 'OBJECT' then coalesce(m->'$.payload.message', m->'$.message') else m->'$.message' end msg,
    case when json_type(m, '$.payload') = 'OBJECT' then coalesce(m->'$.payload.state', m->'$.state') else m->'$.state' end st
  from m
),
x as (
  select segment_id, msg_pos,
    case when json_type(msg, '$.data') = 'OBJECT' then msg->'$.data' else msg end d, st
  from w
),
e as (
  select segment_id, msg_pos, d->'$.chat' chat, coalesce(d->'$.overflowed_chat', d->'$.overflowedChat') over_chat, d->'$.gift' gift,
    coalesce(st->'$.marquee.display.operator_comment', st->'$.marquee.display.operatorComment') op,
    coalesce(d->'$.moderator_updated.operator', d->'$.moderatorUpdated.operator') mod,
    d->'$.nicoad.v0.ranking' ranking, coalesce(d->'$.tag_updated.tags', d->'$.tagUpdated.tags') tags,
    st->'$.enquete.choices' choices,
    coalesce(st->'$.moderation_announcement.guideline_items', st->'$.moderationAnnouncement.guidelineItems') items
  from x
),
s as (
  select segment_id, msg_pos, 'chat' entity, chat o from e
  union all select segment_id, msg_pos, 'overflowed_chat', over_chat from e
  union all select segment_id, msg_pos, 'gift', gift from e
  union all select segment_id, msg_pos, 'operator_comment', op from e
  union all select segment_id, msg_pos, 'moderator', mod from e
  union all select segment_id, msg_pos, 'modifier', chat->'$.modifier' from e
  union all select segment_id, msg_pos, 'modifier', over_chat->'$.modifier' from e
  union all select segment_id, msg_pos, 'modifier', op->'$.modifier' from e
),
l as (
  select segment_id, msg_pos, 'ranking' entity, ranking a from e
  union all select segment_id, msg_pos, 'tag', tags from e
  union all select segment_id, msg_pos, 'choice', choices from e
  union all select segment_id, msg_pos, 'guideline_item', items from e
)
select segment_id, msg_pos, 'message' entity, 0::bigint item_pos from m
union all select segment_id, msg_pos, entity, 0::bigint from s where json_type(o) = 'OBJECT'
union all select segment_id, msg_pos, entity, unnest(range(0, json_array_length(a)::bigint)) from l where json_type(a) = 'ARRAY'
"""

_TYPED_ROWS = _ELEMENTS[: _ELEMENTS.index("select segment_id, msg_pos, 'message' entity")].replace(
    "'modifier', chat->'$.modifier'", "'modifier-chat', chat->'$.modifier'").replace("'modifier', over_chat->'$.modifier'", "'modifier-overflowed_chat', over_chat->'$.modifier'").replace("'modifier', op->'$.modifier'", "'modifier-operator_comment', op->'$.modifier'") + """, o as (
  select segment_id, msg_pos, split_part(entity, '-', 1) entity, 0::bigint item_pos, case when entity like '%-%' then split_part(entity, '-', 2) else 'message' end parent_entity, o from s where json_type(o) = 'OBJECT'
  union all
  select segment_id, msg_pos, entity, i.i, 'message', json_extract(a, '$[' || i.i || ']') from (select * from l where json_type(a) = 'ARRAY') l, lateral (select unnest(range(0, json_array_length(l.a)::bigint)) i) i
)
"""  # fmt: skip


def _typed_sql(entity: str) -> str:
    """The typed table of an entity in SQL: members in either spelling, enums by number or name, absent ones as the wire format has them."""

    def member(name: str) -> str:
        words = name.split("_")
        camel = words[0] + "".join(w.title() for w in words[1:])
        return f"case when json_type(o) = 'OBJECT' then coalesce(o->>'$.{name}', o->>'$.{camel}') end"

    def enum(name: str, values: list[str]) -> str:
        x = f"coalesce({member(name)}, '0')" if name else "coalesce(o->>'$', '0')"
        return f"coalesce(list_extract({values}, try_cast({x} as int) + 1), {x})"

    text, number = member, lambda n: f"try_cast({member(n)} as bigint)"
    chat = {"content": text("content"), "vpos": number("vpos"), "no": number("no"), "name": text("name"), "raw_user_id": number("raw_user_id"), "hashed_user_id": text("hashed_user_id"), "account_status": enum("account_status", ACCOUNTS)}
    columns = {
        "chat": chat, "overflowed_chat": chat,
        "modifier": {"position": enum("position", POSITIONS), "size": enum("size", SIZES), "named_color": enum("named_color", COLORS), "font": enum("font", FONTS)},
        "gift": {"item_id": text("item_id"), "advertiser_name": text("advertiser_name"), "point": number("point"), "item_name": text("item_name"), "contribution_rank": number("contribution_rank")},
        "operator_comment": {"content": text("content"), "name": text("name"), "link": text("link")},
        "moderator": {"user_id": number("user_id"), "nickname": text("nickname"), "icon_url": text("icon_url")},
        "ranking": {"advertiser": text("advertiser"), "rank": number("rank"), "message": text("message")},
        "tag": {"text": text("text"), "locked": text("locked"), "uri": text("nicopedia_uri")},
        "choice": {"description": text("description"), "per_mille": number("per_mille")},
        "guideline_item": {"item": enum("", GUIDELINES)},
    }[entity]
    return _TYPED_ROWS + f"select segment_id, msg_pos, item_pos, parent_entity, {', '.join(f'{sql} as {name}' for name, sql in columns.items())} from o where entity = '{entity}'"


ORACLE = {
    "p1_found": _ISLANDS + "select * from found",
    "p1_coverage": _ISLANDS
    + """select view_id, sum(case when kind = 'covered' then until_us - from_us end)::bigint covered_us,
      coalesce(sum(case when kind = 'gap' then until_us - from_us end), 0)::bigint missing_us,
      count(*) filter (where kind = 'gap') gaps, max(case when kind = 'gap' then until_us - from_us end) longest_gap_us
      from found group by view_id""",
    "p3_found": _RANKED + "select table_name, row_id from r where id is not null and n > 1",
    "p3_kept": _RANKED + "select table_name, id, row_id from r where id is null or n = 1",
    "p5_found": _ELEMENTS,
    "p5_messages": f"select segment_id, msg_pos from ({_ELEMENTS}) where entity = 'message'",
    **{f"p5_{name}": _typed_sql(entity) for name, entity in TABLES.items()},
}
