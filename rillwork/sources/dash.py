"""DASH manifests as DataFrames: nested XML, inherited addressing, timeline expansion.

The text of a manifest becomes nested columns with from_xml, levels are exploded with their places, and the addressing of a representation
is the first of representation, adaptation set and period that says something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import content_kind, media_range, resolve_template
from ..functions.urls import join_each, join_levels
from ..operators.select import best_representation
from ..operators.timeline import nominal_count, period_starts, resolve_open_repeats

L = F.lit

_TEMPLATE = """STRUCT<_timescale: BIGINT, _duration: DOUBLE, _startNumber: BIGINT, _media: STRING, _initialization: STRING, _presentationTimeOffset: BIGINT,
  SegmentTimeline: STRUCT<S: ARRAY<STRUCT<_t: BIGINT, _d: BIGINT, _r: BIGINT>>>>"""
_LIST = "STRUCT<_timescale: BIGINT, _duration: DOUBLE, Initialization: STRUCT<_sourceURL: STRING, _range: STRING>, SegmentURL: ARRAY<STRUCT<_media: STRING, _mediaRange: STRING>>>"
_ADDRESS = f"SegmentTemplate: {_TEMPLATE}, SegmentList: {_LIST}, SegmentBase: STRUCT<_indexRange: STRING>, BaseURL: STRING"
_REPRESENTATION = f"STRUCT<_id: STRING, _width: BIGINT, _height: BIGINT, _bandwidth: BIGINT, _frameRate: STRING, _codecs: STRING, _mimeType: STRING, {_ADDRESS}>"
_SET = f"STRUCT<_id: STRING, _mimeType: STRING, _contentType: STRING, _lang: STRING, _codecs: STRING, _frameRate: STRING, {_ADDRESS}, Representation: ARRAY<{_REPRESENTATION}>>"
_PERIOD = f"STRUCT<_id: STRING, _start: STRING, _duration: STRING, {_ADDRESS}, AdaptationSet: ARRAY<{_SET}>>"
MPD_SCHEMA = f"""_type STRING, _mediaPresentationDuration STRING, _minimumUpdatePeriod STRING, _timeShiftBufferDepth STRING, _suggestedPresentationDelay STRING,
  _availabilityStartTime STRING, BaseURL STRING, Period ARRAY<{_PERIOD}>"""


def iso_duration_us(text: Column) -> Column:
    """Microseconds of an ISO 8601 duration of days and smaller parts; null where it is none."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"T?(\d+(?:\.\d+)?){unit}", 1), L("")).try_cast("decimal(20,6)"), L(0))
    minutes = F.coalesce(F.nullif(F.regexp_extract(text, r"T(?:\d+H)?(\d+(?:\.\d+)?)M", 1), L("")).try_cast("decimal(20,6)"), L(0))
    total = part("D") * 86400 + part("H") * 3600 + minutes * 60 + part("S")
    return F.when(text.rlike(r"^P(?=.)(?:\d+D)?(?:T(?:\d+(?:\.\d+)?[HMS])+)?$"), (total * 1_000_000).cast("bigint"))


def parsed(manifests: DataFrame) -> DataFrame:
    """url and the manifest as nested columns (mpd.*)."""
    clean = F.regexp_replace("content", r"^\s*(<\?xml[^>]*\?>)?\s*(<!--.*?-->\s*)*", "")
    return manifests.select("url", F.from_xml(clean, MPD_SCHEMA).alias("mpd"))


def representations(manifests: DataFrame) -> DataFrame:
    """One row per representation with its inherited addressing, kind, base address and period.

    stream_id numbers the (period, adaptation set) pairs of a manifest, in document order.
    """
    p = parsed(manifests).select("url", "mpd", F.posexplode("mpd.Period").alias("period", "p"))
    p = p.withColumn("_start", iso_duration_us(F.col("p._start"))).withColumn("_duration", iso_duration_us(F.col("p._duration")))
    p = period_starts(p, ["url"], [F.col("period")], "_start", "_duration")
    whole = iso_duration_us(F.col("mpd._mediaPresentationDuration"))
    p = p.withColumn("period_duration", F.coalesce("period_duration", whole - F.col("period_start")))
    sets = p.withColumn("_sets", F.size("p.AdaptationSet")).select("*", F.posexplode("p.AdaptationSet").alias("set", "a"))
    first = F.aggregate(F.slice(F.col("mpd.Period"), L(1), F.col("period")), L(0), lambda n, x: n + F.size(x["AdaptationSet"]))
    sets = sets.withColumn("stream_id", (F.when(F.col("period") > 0, first).otherwise(0) + F.col("set")).cast("bigint"))
    r = sets.select("*", F.posexplode("a.Representation").alias("ordinal", "r"))
    base = join_levels(F.col("url"), F.array(*[F.trim(F.col(f"{level}.BaseURL")) for level in ("mpd", "p", "a", "r")]))
    template = lambda name: F.coalesce(*[F.col(f"{x}.SegmentTemplate.{name}") for x in ("r", "a", "p")])
    listed = F.coalesce(*[F.col(f"{x}.SegmentList") for x in ("r", "a", "p")])
    mime = F.coalesce("a._mimeType", "r._mimeType")
    return r.select(
        "url", "stream_id", "period", "set", "ordinal", "period_start", "period_duration", base.alias("base"),
        F.coalesce("mpd._type", L("static")).alias("type"), mime.alias("mime"), content_kind(F.col("a._contentType"), mime).alias("kind"),
        F.coalesce("r._codecs", "a._codecs").alias("codecs"), F.col("a._lang").alias("lang"), F.coalesce("r._frameRate", "a._frameRate").alias("frame_rate"),
        F.col("r._id").alias("representation_id"), F.col("r._width").alias("width"), F.col("r._height").alias("height"), F.col("r._bandwidth").alias("bandwidth"),
        template("_media").alias("media"), template("_initialization").alias("initialization"), F.coalesce(template("_timescale"), listed["_timescale"], L(1).cast("bigint")).alias("timescale"),
        F.coalesce(template("_duration"), listed["_duration"]).alias("duration"), F.coalesce(template("_startNumber"), L(1).cast("bigint")).alias("start_number"),
        F.coalesce(template("_presentationTimeOffset"), L(0).cast("bigint")).alias("time_offset"), template("SegmentTimeline.S").alias("timeline"), listed.alias("listed"),
        F.coalesce(*[F.col(f"{x}.SegmentBase") for x in ("r", "a", "p")]).isNotNull().alias("single"),
    )


def plan(manifests: DataFrame, open_until_us: Column | None = None, skip_before_us: Column | None = None) -> DataFrame:
    """The segments of the best representation of every adaptation set: url, stream_id, sequence (per stream), time, number, uri, byte_range, init_uri, start_us, kind.

    start_us is relative to the start of the presentation. Four ways of addressing: a timeline of runs, nominal durations, a list, one file.
    Open repeats (r < 0) go on to the next explicit start or the end of the period.

    Periods without an end stop at open_until_us, and nominal segments that end before skip_before_us are not generated: both are columns of
    `manifests` in microseconds of the presentation, so a live manifest expands to its window only.
    """
    bounds = manifests.select("url", (L(None).cast("bigint") if open_until_us is None else open_until_us).alias("_until"), (L(0).cast("bigint") if skip_before_us is None else skip_before_us).alias("_low"))
    reps = representations(manifests).join(bounds, "url").withColumn("period_duration", F.coalesce("period_duration", F.greatest(F.col("_until") - F.col("period_start"), L(0))))
    best = best_representation(reps, ["url", "stream_id"], "width", "height", "bandwidth", "ordinal")
    is_line, is_list = F.col("timeline").isNotNull(), F.col("listed").isNotNull()
    mode = F.when(is_line, "line").when(is_list, "list").when(F.col("duration").isNotNull() & F.col("media").isNotNull(), "nominal").otherwise("file")
    # addresses are joined once per representation; number and time are filled in per segment, without Python
    known = lambda t: resolve_template(t, {"RepresentationID": F.col("representation_id"), "Bandwidth": F.col("bandwidth")})
    entry = lambda t, d, r, at: F.struct(t.alias("t"), d.alias("d"), r.alias("r"), at.alias("range"))
    none, text = L(None).cast("bigint"), L(None).cast("string")
    entries = F.when(is_line, F.transform("timeline", lambda x: entry(x["_t"], x["_d"], x["_r"], text))).when(is_list, F.transform("listed.SegmentURL", lambda x: entry(none, none, none, x["_mediaRange"]))).otherwise(F.array(entry(none, none, none, text)))
    refs = F.when(is_line | (mode == "nominal"), F.array(known(F.col("media")), known(F.col("initialization")))).when(is_list, F.concat(F.array(text, F.col("listed.Initialization._sourceURL")), F.transform("listed.SegmentURL", lambda x: x["_media"]))).otherwise(F.array(text, text))
    best = best.withColumn("_mode", mode).withColumn("_refs", join_each(F.col("base"), refs)).withColumn("_end", F.floor(F.col("period_duration") * F.col("timescale") / 1_000_000).cast("bigint") + F.col("time_offset"))
    for name in ("Number", "Time"):  # the token and width of each number, once per representation
        token = F.nullif(F.regexp_extract(F.get("_refs", L(0)), rf"(\${name}(?:%0\d+d)?\$)", 1), L(""))
        best = best.withColumn(f"_token_{name}", F.coalesce(token, L(f"${name}$"))).withColumn(f"_width_{name}", F.regexp_extract(token, r"%0(\d+)d", 1).try_cast("int"))
    rows = best.select("*", F.posexplode(entries).alias("_n", "_e")).select("*", F.col("_e.t").alias("_t"), F.col("_e.d").alias("_d"), F.col("_e.r").alias("_r")).drop("timeline", "listed")
    rows = resolve_open_repeats(rows, ["url", "stream_id"], [F.col("_n")], "_t", "_d", "_r", "_end")

    w = Window.partitionBy("url", "stream_id").orderBy("_n")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    total = nominal_count(F.col("period_duration") / 1_000_000, F.col("timescale"), F.col("duration"))
    skip = F.greatest(F.floor((F.col("_low") - F.col("period_start")) / 1_000_000 * F.col("timescale") / F.col("duration")) - 1, L(0)).cast("bigint")
    count = F.when(F.col("_mode") == "line", F.greatest(F.coalesce("_r", L(0)) + 1, L(0))).when(F.col("_mode") == "nominal", F.coalesce(total, L(0))).otherwise(1).cast("bigint")
    rows = rows.withColumn("_c", count).withColumn("_run", F.count("_t").over(w))
    run = Window.partitionBy("url", "stream_id", "_run").orderBy("_n")
    clock = F.coalesce(F.first("_t", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0)), L(0)) + F.coalesce(F.sum(F.col("_c") * F.col("_d")).over(run.rowsBetween(Window.unboundedPreceding, -1)), L(0))
    rows = rows.withColumn("_clock", clock).withColumn("_before", F.coalesce(F.sum("_c").over(before), L(0)))
    low = F.when(F.col("_mode") == "nominal", F.coalesce(skip, L(0))).otherwise(0).cast("bigint")
    rows = rows.withColumn("_i", F.explode(F.when(F.col("_c") > low, F.sequence(low, F.col("_c") - 1)).otherwise(F.array().cast("array<bigint>"))))
    line, nominal, listed = (F.col("_mode") == m for m in ("line", "nominal", "list"))
    time = F.when(line, F.col("_clock") + F.col("_i") * F.col("_d")).when(nominal, F.floor(F.col("_i") * F.col("duration"))).when(listed, F.floor(F.col("_n") * F.coalesce("duration", L(0)))).otherwise(0).cast("bigint")
    number = F.when(line, F.col("_before") + F.col("_i") + F.col("start_number")).when(nominal, F.col("start_number") + F.col("_i")).when(listed, F.col("_n") + 1).otherwise(1).cast("bigint")
    rows = rows.withColumn("time", time).withColumn("number", number)
    filled = F.get("_refs", L(0))
    for name, value in (("Number", F.col("number")), ("Time", F.col("time"))):
        text = value.cast("string")
        filled = F.replace(filled, F.col(f"_token_{name}"), F.coalesce(F.lpad(text, F.greatest(F.length(text), F.col(f"_width_{name}")), L("0")), text))
    # a template that writes a number in two widths takes the general way for the second
    filled = F.when(filled.rlike(r"\$(Number|Time)[%$]"), resolve_template(filled, {"Number": F.col("number"), "Time": F.col("time")})).otherwise(filled)
    uri = F.when(line | nominal, filled).when(listed, F.coalesce(F.get("_refs", F.col("_n") + 2), F.col("base"))).otherwise(F.col("base"))
    start = F.col("period_start") + F.floor((F.col("time") - F.when(line, F.col("time_offset")).otherwise(0)) * 1_000_000 / F.col("timescale")).cast("bigint")
    rows = rows.withColumn("uri", uri).withColumn("init_uri", F.get("_refs", L(1))).withColumn("byte_range", F.when(F.col("_e.range").isNotNull(), media_range(F.col("_e.range")))).withColumn("start_us", start)
    by_number = Window.partitionBy("url", "stream_id").orderBy("number")
    return rows.select("url", "stream_id", (F.row_number().over(by_number) - 1).cast("bigint").alias("sequence"), "time", "number", "uri", "byte_range", "init_uri", "start_us", "kind", "representation_id", "bandwidth")


def live_plan(manifests: DataFrame, since_us: Column | None = None, inclusive: bool = True) -> DataFrame:
    """The segments of dynamic manifests that are available at `now_us`, a column of `manifests` (microseconds since the epoch).

    at_us is the segment's time on the wall clock: availability start, period start and media time. The window ends at now less the suggested delay and
    begins a time-shift buffer earlier; `since_us`, another column of `manifests`, is the cursor of an earlier load, itself left out unless `inclusive`; null asks for all. refresh_us is the
    update period, two seconds where none is given; the loop that reads again belongs to the caller or to a stream.
    """
    text = lambda name: iso_duration_us(F.col(f"mpd.{name}"))
    head = parsed(manifests).join(manifests.select("url", F.col("now_us").cast("bigint").alias("now_us"), (L(None).cast("bigint") if since_us is None else since_us).alias("_since")), "url").select(
        "url", "now_us", "_since", F.coalesce(F.unix_micros(F.try_to_timestamp("mpd._availabilityStartTime")), L(0)).alias("_zero"), text("_timeShiftBufferDepth").alias("_buffer"),
        F.coalesce(text("_suggestedPresentationDelay"), L(0)).alias("_delay"), F.coalesce(text("_minimumUpdatePeriod"), L(2_000_000)).alias("refresh_us"), F.coalesce("mpd._type", L("static")).alias("type"),
    )
    timed = manifests.select("url", "content").join(head, "url")
    rows = plan(timed, F.col("now_us") - F.col("_zero") - F.col("_delay"), F.col("now_us") - F.col("_zero") - F.coalesce(F.col("_buffer"), F.col("now_us") - F.col("_zero"))).join(head, "url")
    at = F.col("_zero") + F.col("start_us")
    low = F.col("_since").isNull() | ((at >= F.col("_since")) if inclusive else (at > F.col("_since")))
    dynamic = (at <= F.col("now_us") - F.col("_delay")) & (F.col("_buffer").isNull() | (at >= F.col("now_us") - F.col("_buffer")))
    kept = rows.withColumn("at_us", at).where((F.col("type") != "dynamic") | dynamic)
    return kept.where(low).select("url", "stream_id", "number", "time", "uri", "init_uri", "kind", "at_us", "refresh_us", "type")
