"""Queries of the segment operators on the test tables, each with its SQL: lineitem as segments, orders as playlists, part and supplier as variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import cache_key, chunk_bounds, http_range, media_range, resolve_template, segment_range
from ..operators import merge, select, timeline
from .tables import table

L = F.lit
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


#: A total order of lineitem within an order: no two rows are equal in all columns.
ROW = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_ROW = ", ".join(ROW)
_SEG = f"seg as (select *, row_number() over (partition by l_orderkey order by {_ROW}) - 1 sequence from lineitem)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    return timeline.numbered(table(spark, d, "lineitem"), ["l_orderkey"], ROW)


# -- choosing


@query("""select p_brand, p_partkey, p_size from part
  qualify row_number() over (partition by p_brand order by p_size desc nulls last, floor(p_retailprice / 40) desc nulls last, (p_partkey * 7919) % 1000 desc, p_partkey) = 1""")
def best_variant_per_group(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_size", (F.col("p_retailprice") / 40).alias("fps"), ((F.col("p_partkey") * 7919) % 1000).alias("bandwidth"))
    return select.best_variant(p, ["p_brand"], "p_size", "fps", "bandwidth", "p_partkey").select("p_brand", "p_partkey", "p_size")


@query("""select s_nationkey, s_suppkey from supplier
  qualify row_number() over (partition by s_nationkey order by s_suppkey % 3 desc, floor(s_acctbal / 2000) desc, s_suppkey desc) = 1""")
def best_representation_last_tie(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") % 3).alias("width"), F.floor(F.col("s_acctbal") / 2000).alias("bandwidth"))
    return select.best_representation(s, ["s_nationkey"], "width", None, "bandwidth", "s_suppkey").select("s_nationkey", "s_suppkey")


@query("""select s_nationkey, s_suppkey from supplier
  qualify row_number() over (partition by s_nationkey order by (s_suppkey % 3 = 0 and s_suppkey % 2 = 0) desc, s_suppkey) = 1""")
def default_rendition_or_first(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_suppkey") % 3 == 0).alias("is_default"), (F.col("s_suppkey") % 2 == 0).alias("autoselect"))
    return select.best_rendition(s, ["s_nationkey"], "is_default", "autoselect", "s_suppkey").select("s_nationkey", "s_suppkey")


@query("""select p_brand, p_partkey from part
  qualify row_number() over (partition by p_brand order by coalesce(p_size, 0) + case when p_type = 'PROMO' then 1000000 else 0 end desc, p_partkey desc) = 1""")
def scored_best_stream(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_size", "p_type")
    return select.best_scored(p, ["p_brand"], F.col("p_size"), F.col("p_type") == "PROMO", "p_partkey").select("p_brand", "p_partkey")


@query("""select user_id, coalesce(max(value) filter (where event_type = 'purchase'), max(value) filter (where event_type = 'view'), max(value) filter (where event_type = 'click'),
  max(value) filter (where event_type = 'error'), max(value) filter (where event_type = 'signup')) value from events group by user_id""")
def preferred_key_coalesce(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    m = F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "v"))))  # one entry per event type
    return per.groupBy("user_id").agg(m.alias("m")).select("user_id", select.preferred_member(F.col("m"), ["purchase", "view"]).alias("value"))


# -- counters, ranges, marks


@query(f"""with {_SEG}, cut as (select * from seg where sequence + 1 between 2 and 4)
  select l_orderkey, sequence, l_partkey, row_number() over (partition by l_orderkey order by sequence) - 1 as position from cut""")
def segment_range_slice(spark: SparkSession, d: str) -> DataFrame:
    cut = timeline.slice_range(segments(spark, d), "sequence", 2, 4)
    return timeline.numbered(cut, ["l_orderkey"], ["sequence"], "position").select("l_orderkey", "sequence", "l_partkey", "position")


def marks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 5).alias("mark"))


_MARKS = "marks as (select o_orderkey l_orderkey, case when o_orderkey % 3 <> 0 then o_orderkey % 5 end mark from orders)"


@query(f"with {_SEG}, {_MARKS} select l_orderkey, sequence, l_partkey from seg left join marks using (l_orderkey) where mark is null or sequence > mark")
def high_water_filter(spark: SparkSession, d: str) -> DataFrame:
    return timeline.beyond_mark(segments(spark, d), marks(spark, d), "l_orderkey", "sequence", "mark").select("l_orderkey", "sequence", "l_partkey")


@query(f"""with {_SEG}, {_MARKS}, last as (select l_orderkey, arg_max(l_partkey, sequence) l from seg group by l_orderkey)
  select coalesce(marks.l_orderkey, last.l_orderkey) l_orderkey, coalesce(l, mark) mark from marks full join last on marks.l_orderkey = last.l_orderkey""")
def high_water_advance(spark: SparkSession, d: str) -> DataFrame:
    return timeline.new_marks(segments(spark, d), marks(spark, d), "l_orderkey", "l_partkey", "sequence", "mark")


@query("""with s as (select coalesce(floor(sum((l_quantity / 10)::decimal(18, 6)) * 1000 / count(*)), 0)::bigint ms from lineitem group by l_orderkey)
  select least(greatest(coalesce(min(ms), 5000), 1000), 5000)::bigint interval_ms from s""")
def poll_interval(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") / 10).alias("seconds"))
    return timeline.poll_interval_ms(rows, ["l_orderkey"], "seconds")


@query("""select event_id, last_value(case when event_type = 'signup' then value end ignore nulls) over (partition by user_id order by ts rows unbounded preceding) k from events""")
def key_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "signup", F.col("value")).alias("k"))
    return timeline.fill_forward(e, ["user_id"], ["ts"], "k").select("event_id", "k")


@query(f"""with {_SEG}, x as (select l_orderkey, sequence, case when l_linestatus = 'F' or l_quantity > 5 then (l_quantity * 100)::bigint end len, case when l_returnflag = 'R' then l_partkey * 10 end start from seg),
  r as (select *, sum(case when start is not null or len is null then 1 else 0 end) over (partition by l_orderkey order by sequence rows unbounded preceding) run from x),
  o as (select *, coalesce(first_value(start ignore nulls) over (partition by l_orderkey, run order by sequence rows unbounded preceding), 0)
    + coalesce(sum(len) over (partition by l_orderkey, run order by sequence rows between unbounded preceding and 1 preceding), 0) pos from r)
  select l_orderkey, sequence, case when len is not null then pos::bigint end as "offset", len as length from o""")
def byte_range_offsets(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    x = s.select("l_orderkey", "sequence", F.when((F.col("l_linestatus") == "F") | (F.col("l_quantity") > 5), (F.col("l_quantity") * 100).cast("bigint")).alias("length"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey") * 10).alias("start"))
    return timeline.byte_offsets(x, ["l_orderkey"], ["sequence"], "length", "start").select("l_orderkey", "sequence", "offset", "length")


@query("""select doc_id, n, n * 500 as "offset", least(500, n_chars - n * 500) length from (select doc_id, n_chars, unnest(range(0, (n_chars + 499) // 500)) n from documents where n_chars > 0)""")
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(chunk_bounds(F.col("n_chars"), 500)).alias("c")).select("doc_id", "c.n", "c.offset", "c.length")


# -- timelines


@query(f"""with {_SEG}, x as (select l_orderkey, sequence, case when l_returnflag = 'A' then l_partkey end t, l_suppkey % 7 + 1 dur, (l_quantity::bigint % 10) r from seg),
  g as (select *, count(t) over (partition by l_orderkey order by sequence rows unbounded preceding) run from x),
  b as (select *, coalesce(first_value(t ignore nulls) over (partition by l_orderkey, run order by sequence rows unbounded preceding), 0)
      + coalesce(sum((r + 1) * dur) over (partition by l_orderkey, run order by sequence rows between unbounded preceding and 1 preceding), 0) base,
    coalesce(sum(r + 1) over (partition by l_orderkey order by sequence rows between unbounded preceding and 1 preceding), 0) before from g)
  select l_orderkey, (base + i * dur)::bigint as "time", (before + i + 1)::bigint as number from (select *, unnest(range(0, r + 1)) i from b)""")
def timeline_expand(spark: SparkSession, d: str) -> DataFrame:
    x = segments(spark, d).select("l_orderkey", "sequence", F.when(F.col("l_returnflag") == "A", F.col("l_partkey")).alias("t"), (F.col("l_suppkey") % 7 + 1).alias("dur"), (F.col("l_quantity").cast("bigint") % 10).alias("r"))
    return timeline.expand_runs(x, ["l_orderkey"], ["sequence"], "t", "dur", "r", 1).select("l_orderkey", "time", "number")


@query("""select o_orderkey, (o_orderkey + i)::bigint number, floor(i * 7.5)::bigint as "time" from (select o_orderkey, unnest(range(0, ceil(o_totalprice / 5000 * 1 / 7.5::double)::bigint)) i from orders)""")
def nominal_timeline(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 5000).alias("seconds"))
    return timeline.expand_nominal(o, timeline.nominal_count(F.col("seconds"), L(1), L(7.5)), F.col("o_orderkey"), L(7.5)).select("o_orderkey", "number", "time")


@query("""with x as (select o_custkey, o_orderkey, o_orderdate, case when o_orderkey % 4 = 0 then o_orderkey * 10 end s, case when o_orderkey % 5 <> 0 then o_orderkey % 97 end dur from orders),
  e as (select *, coalesce(dur, case when s is not null then lead(s) over (partition by o_custkey order by o_orderdate, o_orderkey) - s end) d,
    count(s) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding) run from x),
  b as (select *, coalesce(max(case when d is null then 1 else 0 end) over w, 0) unknown, coalesce(sum(d) over w, 0) before,
      coalesce(first_value(s ignore nulls) over (partition by o_custkey, run order by o_orderdate, o_orderkey rows unbounded preceding), 0) base
    from e window w as (partition by o_custkey, run order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding))
  select o_orderkey, case when unknown = 0 then (base + before)::bigint end period_start, d::bigint period_duration from b""")
def period_chain(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.when(k % 4 == 0, k * 10).alias("s"), F.when(k % 5 != 0, k % 97).alias("dur"))
    return timeline.period_starts(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "s", "dur").select("o_orderkey", "period_start", "period_duration")


@query("""select event_id from events where epoch(ts) <= 1705276800 + 3600 - 60 and epoch(ts) >= 1705276800 - 259200 and (epoch(ts) < 1704067200 + 1209600)""")
def availability_window(spark: SparkSession, d: str) -> DataFrame:
    at, now = F.unix_seconds(F.col("ts").cast("timestamp")), L(1705276800)
    return table(spark, d, "events").where(timeline.available(at, now, L(3600), L(60), L(259200)) & timeline.within_period(at, L(1704067200), L(1209600))).select("event_id")


@query("""select event_id, 'first' as load from events where value >= 50 union all select event_id, 'later' from events where value > 50""")
def since_inclusive_exclusive(spark: SparkSession, d: str) -> DataFrame:
    e, top = table(spark, d, "events"), L(1e18)
    part = lambda load, inclusive: e.where(timeline.available(F.col("value"), top, since=L(50.0), inclusive=inclusive)).select("event_id", L(load).alias("load"))
    return part("first", True).unionByName(part("later", False))


# -- texts of segments


@query("""select p_partkey, 'v_' || p_brand || '_' || case when length(p_partkey::varchar) >= 5 then p_partkey::varchar else lpad(p_partkey::varchar, 5, '0') end || '_' || p_size || '_$Time$_$Other$.m4s' uri from part""")
def template_resolve(spark: SparkSession, d: str) -> DataFrame:
    values = {"RepresentationID": F.col("p_brand"), "Number": F.col("p_partkey"), "Bandwidth": F.col("p_size"), "Time": L(None).cast("bigint")}
    return table(spark, d, "part").select("p_partkey", resolve_template(L("v_$RepresentationID$_$Number%05d$_$Bandwidth$_$Time$_$Other$.m4s"), values).alias("uri"))


@query(f"""with {_SEG} select l_orderkey, sequence, case when length(l_orderkey::varchar) >= 2 then l_orderkey::varchar else lpad(l_orderkey::varchar, 2, '0') end || '_' || lpad(sequence::varchar, 6, '0') || '_' || l_returnflag || '__' || l_linestatus || '.ts' as name from seg""")
def cache_key_format(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("l_returnflag", L("/"), "l_linestatus", L(".ts"))
    return segments(spark, d).select("l_orderkey", "sequence", cache_key(F.col("l_orderkey"), F.col("sequence"), name).alias("name"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'bytes=' || l_partkey || '-' || case when l_returnflag <> 'N' then (l_partkey + l_suppkey - 1)::varchar else '' end as range from lineitem""")
def http_range_text(spark: SparkSession, d: str) -> DataFrame:
    length = F.when(F.col("l_returnflag") != "N", F.col("l_suppkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", http_range(F.col("l_partkey"), length).alias("range"))


@query("""select l_partkey, l_suppkey, l_returnflag, l_partkey as "offset", case when l_returnflag <> 'N' then l_suppkey - l_partkey + 1 end length,
  case when l_returnflag = 'A' then 1 else l_partkey end as first, case when l_returnflag <> 'N' then l_suppkey end as last from lineitem""")
def media_range_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("l_partkey"), L("-"), F.when(F.col("l_returnflag") != "N", F.col("l_suppkey").cast("string")).otherwise(L("")))
    cut = F.when(F.col("l_returnflag") == "A", F.concat(L("-"), F.col("l_suppkey"))).otherwise(text)
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", media_range(text).alias("m"), segment_range(cut).alias("s")).select("l_partkey", "l_suppkey", "l_returnflag", "m.offset", "m.length", "s.first", "s.last")


# -- assembling


@query("""select s.s_nationkey, p.p_brand from (select distinct s_nationkey from supplier where s_nationkey % 2 = 0) s cross join (select distinct p_brand from part) p""")
def quality_cross_join(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.records import quality_pairs

    v = table(spark, d, "supplier").where(F.col("s_nationkey") % 2 == 0).select(F.col("s_nationkey").cast("string").alias("v")).distinct()
    a = table(spark, d, "part").select(F.col("p_brand").alias("a")).distinct()
    return quality_pairs(v, a, "v", "a").select(F.get("pair", L(0)).cast("int").alias("s_nationkey"), F.get("pair", L(1)).alias("p_brand"))


@query("""select c_custkey as key, 'start' as action from customer where c_custkey % 3 <> 0 and c_custkey not in (select o_custkey from orders)
  union all select distinct o_custkey, 'stop' from orders where o_custkey not in (select c_custkey from customer where c_custkey % 3 <> 0)""")
def set_difference_both_ways(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").where(F.col("c_custkey") % 3 != 0).select(F.col("c_custkey").alias("key"))
    running = table(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    return select.set_difference(wanted, running, "key")


@query("""with a as (select n_nationkey, row_number() over (order by n_nationkey) i from nation), b as (select r_name, row_number() over (order by r_regionkey desc) i from region)
  select n_nationkey, r_name from a join b using (i)""")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", L(0).alias("g"))
    r = table(spark, d, "region").select("r_name", "r_regionkey", L(0).alias("g"))
    return merge.zipped(n, r, ["n_nationkey"], [F.col("r_regionkey").desc()], ["g"]).select("n_nationkey", "r_name")


@query(f"""with t as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_suppkey, l_returnflag order by l_orderkey, {_ROW}) turn, l_returnflag from lineitem)
  select l_suppkey, l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_suppkey order by turn, l_returnflag) - 1 as position from t""")
def interleave_streams(spark: SparkSession, d: str) -> DataFrame:
    return merge.interleave(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", ["l_orderkey", *ROW]).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "position")


@query(f"select l_orderkey, l_linenumber, l_partkey, l_extendedprice from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by {', '.join(ROW[1:])}) = 1")
def dedup_first_writer(spark: SparkSession, d: str) -> DataFrame:
    return merge.keep_first(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in ROW[1:]]).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


_OK = "x as (select *, event_type <> 'error' ok from events)"


@query(f"with {_OK}, g as (select *, count(*) filter (where not ok) over (partition by user_id order by ts rows unbounded preceding) f from x) select user_id, event_id, f as part from g where ok")
def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ok", F.col("event_type") != "error")
    return merge.islands(e, ["user_id"], ["ts"], "ok").select("user_id", "event_id", "part")


@query(f"""with {_OK}, g as (select *, count(*) filter (where not ok) over (partition by user_id order by ts rows unbounded preceding) f from x)
  select user_id, event_id, dense_rank() over (partition by user_id order by f) - 1 as part from g where ok""")
def gap_islands_collapsed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ok", F.col("event_type") != "error")
    return merge.islands(e, ["user_id"], ["ts"], "ok", collapse=True).select("user_id", "event_id", "part")


@query(f"with {_OK} select event_id from x qualify ts <= max(case when ok then ts end) over (partition by user_id)")
def trim_trailing(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ok", F.col("event_type") != "error")
    return merge.trim_trailing(e, ["user_id"], F.col("ts"), "ok").select("event_id")


@query(f"select l_orderkey, string_agg(l_returnflag || l_linenumber, '' order by {_ROW}) as content from lineitem group by l_orderkey")
def ordered_concat(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("t", F.concat("l_returnflag", "l_linenumber"))
    return merge.concat_text(rows, ["l_orderkey"], ROW, "t")


@query("""with s as (select l_orderkey, l_linestatus, bool_or(l_quantity > 49) bad, bool_and(l_returnflag <> 'R') cat from lineitem group by all)
  select l_orderkey, count(*) tracks, case when bool_or(bad) then 'skip' when count(*) > 1 or not bool_and(cat) then 'mux' else 'concat' end as action from s group by l_orderkey""")
def merge_eligibility(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus", (F.col("l_quantity") <= 49).alias("ok"), F.when(F.col("l_returnflag") == "R", "mp4").otherwise("ts").alias("kind"))
    return merge.merge_plan(rows, ["l_orderkey"], "l_linestatus", "ok", "kind")


@query("""select user_id, count(*) total, count(*) filter (where event_type <> 'error') fetched, count(*) filter (where event_type = 'error') failed, 100.0::double as percent,
  coalesce(string_agg(lpad(event_id::varchar, 9, '0'), ',' order by event_id) filter (where event_type = 'error'), '') failed_names from events group by user_id""")
def progress_counters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", (F.col("event_type") != "error").alias("ok"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("name"))
    return merge.progress(e, ["user_id"], "ok", "name")


@query("""with p as (select user_id, count(*) filter (where event_type = 'error') over (partition by user_id order by ts rows unbounded preceding) f, event_type from events),
  g as (select distinct user_id, f from p where event_type <> 'error')
  select user_id, f as part, case when count(*) over (partition by user_id) > 1 then user_id || '.' || f || '.ts' else user_id || '.ts' end file from g""")
def duplicate_output_names(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ok", F.col("event_type") != "error")
    parts = merge.islands(e, ["user_id"], ["ts"], "ok").select("user_id", "part").distinct()
    return merge.output_names(parts, ["user_id"], "part", F.col("user_id").cast("string"), L("ts"))


@query("""select event_id as sequence, event_id % 4 < 3 as success, case when event_id % 4 < 3 then event_id % 4 + 1 else 3 end::int as attempts from events""")
def retry_outcome(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.fetch import fetch_segments

    tries: dict[str, int] = {}

    def flaky(uri, byte_range, headers):
        """Fails as often as the last part of the address says; only of an address that is asked for again is the number kept."""
        n = tries.pop(uri, 0) + 1
        if n <= int(uri.rsplit("/", 1)[1]):
            if n < 3:
                tries[uri] = n
            raise OSError("not now")
        return b"x"

    rows = table(spark, d, "events").select(L(0).cast("bigint").alias("stream_id"), F.col("event_id").alias("sequence"), F.concat(L("mem:/"), F.col("event_id"), L("/"), F.col("event_id") % 4).alias("uri"))
    return fetch_segments(rows, flaky, parallelism=8, attempts=3).select("sequence", "success", "attempts")


@query("""select l_orderkey, l_linenumber from (select distinct l_orderkey, l_linenumber from lineitem) qualify l_linenumber = row_number() over (partition by l_orderkey order by l_linenumber)""")
def reorder_contiguous(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.reassembly import contiguous_prefix

    return contiguous_prefix(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber", 1)


@query("""with recursive r as (select p_partkey s, p_partkey p, 0 h from part union all select s, p // 2, h + 1 from r where p > 1)
  select s as p_partkey, arg_max(p, h) as final, max(h)::int hops from r group by s""")
def redirect_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.urls import follow_redirects

    p = table(spark, d, "part").select("p_partkey")
    hops = p.where("p_partkey > 1").select(F.col("p_partkey").alias("a"), F.expr("p_partkey div 2").alias("b"))
    return follow_redirects(p, "p_partkey", hops, "a", "b").select("p_partkey", "final", "hops")


@query("""select p_partkey, p_partkey - p_partkey % 1000 as final, (p_partkey % 1000)::int hops from part""")
def redirect_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains of up to 999 hops, one address after another."""
    from ..functions.urls import follow_redirects

    p = table(spark, d, "part").select("p_partkey")
    hops = p.where("p_partkey % 1000 > 0").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") - 1).alias("b"))
    return follow_redirects(p, "p_partkey", hops, "a", "b").select("p_partkey", "final", "hops")


@query("""with staged as (select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R') select distinct l_orderkey, l_linenumber from lineitem l where not exists (select 1 from staged s where s.l_orderkey = l.l_orderkey and s.l_linenumber = l.l_linenumber)""")
def resume_not_staged(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    return merge.not_staged(rows, rows.where("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber").distinct()
