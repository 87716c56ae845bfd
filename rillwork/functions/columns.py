"""Scalar functions on columns: formats, ranges, templates, times, names, keys. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

L = F.lit

# -- formats and kinds (fixed values: the extensions of each format)
MP4_EXTENSIONS = ("mp4", "m4s", "m4f")
PLAIN_EXTENSIONS = ("ts", "m4a", "cmfv", "cmfa", "aac")
RAW_EXTENSIONS = ("txt", "ass", "srt", "vtt", "json")
#: Formats whose segments can be joined byte by byte.
CONCAT_KINDS = ("ts", "aac", "raw")


def extension(name: Column) -> Column:
    """What follows the last dot; the whole name where there is none."""
    return F.substring_index(name, ".", -1)


def file_format(name: Column) -> Column:
    """struct(kind, ext) of a segment file name; case matters."""
    ext = extension(name)
    kind = (
        F.when(ext.isin(*MP4_EXTENSIONS), "mp4").when(ext.isin(*PLAIN_EXTENSIONS), ext).when(ext.isin(*RAW_EXTENSIONS), "raw").otherwise("other")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "mp4", "mp4").otherwise(ext).alias("ext"))


def segment_type(mime: Column) -> Column:
    """video, audio or subtitle by the main type; null counts as video, anything else as unknown."""
    return F.when(mime.isNull() | mime.startswith("video"), "video").when(mime.startswith("audio"), "audio").when(mime.startswith("text"), "subtitle").otherwise("unknown")


def content_kind(content_type: Column, mime: Column) -> Column:
    """Kind of an adaptation set: its content type, else its mime type; both unknown is unknown."""
    c = F.coalesce(content_type, F.substring_index(mime, "/", 1))
    return F.when(c.isin("video", "audio"), c).when(c.isin("text", "subtitle", "application"), "subtitle").otherwise("unknown")


def manifest_kind(url: Column, content_type: Column, body: Column) -> Column:
    """hls or dash: by extension, then content type, then the first bytes; dash if nothing tells."""
    path = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    kind = F.lower(content_type)
    return (
        F.when(path.endswith(".m3u8"), "hls").when(path.endswith(".mpd"), "dash")
        .when(kind.contains("mpegurl"), "hls").when(kind.contains("dash+xml"), "dash")
        .when(F.ltrim(body).startswith("#EXTM3U"), "hls").otherwise("dash")
    )


# -- byte ranges


def http_range(offset: Column, length: Column) -> Column:
    """Range header of `length` bytes from `offset`, to the end where length is null."""
    return F.concat(L("bytes="), offset.cast("string"), L("-"), F.coalesce((offset + length - 1).cast("string"), L("")))


def media_range(text: Column) -> Column:
    """struct(offset, length) of "a-b", both ends included; length is null without b."""
    a = F.split_part(text, L("-"), L(1)).try_cast("bigint")
    b = F.nullif(F.split_part(text, L("-"), L(2)), L("")).try_cast("bigint")
    return F.struct(a.alias("offset"), (b - a + 1).alias("length"))


def segment_range(text: Column) -> Column:
    """struct(first, last) of "a-b", "a-", "-b" or "a" (to the end); first is 1 where absent, last null where open."""
    a = F.nullif(F.split_part(text, L("-"), L(1)), L("")).try_cast("bigint")
    b = F.nullif(F.split_part(text, L("-"), L(2)), L("")).try_cast("bigint")
    return F.struct(F.coalesce(a, L(1).cast("bigint")).alias("first"), b.alias("last"))


def chunk_bounds(size: Column, chunk: int) -> Column:
    """array<struct(n, offset, length)> that cuts `size` bytes into chunks; none for 0 or null."""
    n = F.floor((size + chunk - 1) / chunk).cast("bigint")
    numbers = F.when(size > 0, F.sequence(L(0).cast("bigint"), F.greatest(n - 1, L(0).cast("bigint")))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(numbers, lambda i: F.struct(i.alias("n"), (i * chunk).alias("offset"), F.least(L(chunk).cast("bigint"), size - i * chunk).alias("length")))


# -- templates


def pad_number(value: Column, width: int) -> Column:
    """Left-padded with zeros to `width`; longer values stay whole."""
    text = value.cast("string")
    return F.lpad(text, F.greatest(F.length(text), L(width)), "0")


def resolve_template(template: Column, values: dict[str, Column]) -> Column:
    """$Name$ and $Name%0Nd$ replaced, whatever N; names that are unknown or null stay as they are."""
    known = F.create_map(*[x for name, value in values.items() for x in (L(name), value.cast("string"))])
    token = r"^\$([A-Za-z]+)(?:%0(\d+)d)?\$$"

    def filled(piece: Column) -> Column:
        text = F.try_element_at(known, F.regexp_extract(piece, token, 1))
        width = F.regexp_extract(piece, token, 2).try_cast("int")
        return F.coalesce(F.when(width.isNull(), text).otherwise(F.lpad(text, F.greatest(F.length(text), width), L("0"))), piece)

    return F.array_join(F.transform(F.regexp_extract_all(template, L(r"\$[A-Za-z]+(?:%0\d+d)?\$|[^$]+|\$"), L(0)), filled), "")


# -- times


def timecode(seconds: Column) -> Column:
    """H:MM:SS.s with two-digit hours and minutes; seconds rounded to two decimals, not padded, at least one decimal."""
    hundredths = F.round(seconds * 100).cast("bigint")
    whole = F.floor(seconds).cast("bigint")
    hours, minutes = F.floor(whole / 3600).cast("bigint"), F.floor(F.pmod(whole, L(3600)) / 60).cast("bigint")
    rest = hundredths - (hours * 3600 + minutes * 60) * 100
    frac = F.pmod(rest, L(100))
    shown = F.when(frac % 10 == 0, (frac / 10).cast("bigint").cast("string")).otherwise(F.lpad(frac.cast("string"), 2, "0"))
    two = lambda n: F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), L(2)), "0")
    return F.concat(two(hours), L(":"), two(minutes), L(":"), F.floor(rest / 100).cast("string"), L("."), shown)


def sample_time(period_start_us: Column, offset_ticks: Column, ticks: Column, timescale: Column) -> Column:
    """Microseconds of a sample: the period's start plus its ticks less the presentation offset (both in timescale units)."""
    return period_start_us + F.floor((ticks - F.coalesce(offset_ticks, L(0))) * 1_000_000 / timescale).cast("bigint")


def clock_offset(before_us: Column, after_us: Column, remote_us: Column) -> Column:
    """What to add to the local clock: the remote time plus half the round trip, less the local time at the answer."""
    return remote_us + F.floor((after_us - before_us) / 2).cast("bigint") - after_us


def parse_instant(text: Column) -> Column:
    """Timestamp of an ISO 8601 or RFC 2822 text; null where neither fits."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3}, ", ""), L("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(F.regexp_replace(text, r"^[A-Za-z]{3}, ", ""), L("d MMM yyyy HH:mm:ss Z")))


def in_zone(epoch_seconds: Column, zone: str = "Asia/Tokyo") -> Column:
    """yyyy-MM-ddTHH:mm:ss in a fixed zone."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(epoch_seconds), zone), "yyyy-MM-dd'T'HH:mm:ss")


def proto_time(seconds: Column, nanos: Column) -> Column:
    """struct(date, date_usec) of a wire timestamp."""
    return F.struct(seconds.alias("date"), F.floor(F.coalesce(nanos, L(0)) / 1000).cast("bigint").alias("date_usec"))


# -- names


def cache_key(stream: Column, sequence: Column, name: Column) -> Column:
    """Unique and sortable file name of a segment."""
    return F.concat_ws("_", pad_number(stream, 2), pad_number(sequence, 6), F.replace(name, L("/"), L("__")))


def safe_filename(title: Column) -> Column:
    """Last path component with characters that file systems refuse replaced."""
    return F.regexp_replace(F.element_at(F.split(title, "/"), -1), r'[\\/:*?"<>|]', "_")


def replace_extension(path: Column, new: str, only: list[str]) -> Column:
    """`new` instead of the extension where that is one of `only`, else after the whole name."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    return F.when(ext.isin(*only), F.regexp_replace(path, r"\.[^./]+$", "." + new)).otherwise(F.concat(path, L("." + new)))


def add_suffix(path: Column, suffix: Column) -> Column:
    """`suffix` between stem and extension."""
    ext = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    return F.concat(F.substring(path, L(1), F.length(path) - F.length(ext)), suffix, ext)


def disposition_name(header: Column) -> Column:
    """struct(stem, ext) of the file name in a Content-Disposition header; ext is raw where there is none."""
    name = F.coalesce(F.nullif(F.regexp_extract(header, r'filename="([^"]*)"', 1), L("")), F.nullif(F.regexp_extract(header, r"filename=([^;\s]+)", 1), L("")))
    return F.struct(F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.coalesce(F.nullif(F.regexp_extract(name, r"\.([^.]*)$", 1), L("")), L("raw")).alias("ext"))


# -- keys


def iv_bytes(text: Column, media_sequence: Column) -> Column:
    """16 bytes of a hexadecimal initialisation vector; without one, the segment's media sequence number."""
    given = F.regexp_replace(text, "^0[xX]", "")
    return F.coalesce(F.unhex(F.lpad(given, 32, "0")), F.unhex(F.lpad(F.hex(media_sequence), 32, "0")))


def key_pairs(text: Column) -> Column:
    """map kid -> key of "kid:key;kid:key"; pairs that are not 32 hexadecimal digits each are left out, the last of equal kids counts."""
    pairs = F.transform(F.split(text, ";"), lambda p: F.split(F.trim(p), ":"))
    good = F.filter(pairs, lambda p: (F.size(p) == 2) & F.get(p, L(0)).rlike("^[0-9A-Fa-f]{32}$") & F.get(p, L(1)).rlike("^[0-9A-Fa-f]{32}$"))
    entries = F.transform(good, lambda p: F.struct(F.get(p, L(0)).alias("kid"), F.get(p, L(1)).alias("key")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["kid"] == e["kid"]))
    return F.map_from_entries(last)


# -- web text


def decode_entities(text: Column) -> Column:
    """The named entities of XML and &#39; decoded; &amp; last."""
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = F.replace(text, L(entity), L(char))
    return text


def embedded_json(html: Column, attribute: str = "data-props") -> Column:
    """The JSON text in an attribute of a page; null where the attribute is absent."""
    return decode_entities(F.nullif(F.regexp_extract(html, attribute + r'="([^"]*)"', 1), L("")))


def json_path(text: Column, path: str) -> Column:
    """Text of a member of a JSON document; null for a missing path or a broken document."""
    return F.get_json_object(text, path)


def header_value(headers: Column, name: str) -> Column:
    """Value of the first header of that name in a raw block, whatever its case; null where absent."""
    return F.nullif(F.trim(F.regexp_extract(headers, rf"(?im)^{name}[ \t]*:[ \t]*([^\r\n]*)", 1)), L(""))


def cookie_pairs(set_cookies: Column) -> Column:
    """Cookie header of an array of Set-Cookie values: the pair before each first semicolon."""
    return F.array_join(F.transform(set_cookies, lambda c: F.trim(F.split_part(c, L(";"), L(1)))), "; ")


def cookie_text(name: Column, value: Column, domain: Column, path: Column, secure: Column) -> Column:
    """A cookie as a header line; absent attributes are left out."""
    return F.concat(name, L("="), value, F.coalesce(F.concat(L("; Domain="), domain), L("")), F.coalesce(F.concat(L("; Path="), path), L("")), F.when(secure, L("; Secure")).otherwise(L("")))


# -- frame headers of elementary audio, from the bytes of a header


def _byte(data: Column, i: int) -> Column:
    return F.conv(F.hex(F.substring(data, i + 1, 1)), 16, 10).cast("int")


def adts_frame_length(header: Column) -> Column:
    """Bytes of an AAC frame with its header."""
    return F.shiftleft(_byte(header, 3).bitwiseAND(3), 11) + F.shiftleft(_byte(header, 4), 3) + F.shiftright(_byte(header, 5), 5)


def eac3_frame_length(header: Column) -> Column:
    """Bytes of an E-AC-3 frame: its size field counts 16-bit words less one."""
    return (F.shiftleft(_byte(header, 2).bitwiseAND(7), 8) + _byte(header, 3) + 1) * 2


#: Nominal bit rates of AC-3 in kbit/s, by half of the frame size code.
AC3_KBPS = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640]


def ac3_frame_length(header: Column) -> Column:
    """Bytes of an AC-3 frame, from its sample rate code and frame size code: 1536 samples at the nominal bit rate.

    At 44.1 kHz the length is rounded down to words and codes with the last bit set hold one word more.
    """
    b = _byte(header, 4)
    rate, code = F.shiftright(b, 6), b.bitwiseAND(63)
    kbps = F.get(F.array(*map(L, AC3_KBPS)), F.shiftright(code, 1))
    words = (
        F.when(rate == 0, kbps * 2).when(rate == 1, F.floor(kbps * 1000 * 96 / L(44100)).cast("int") + code.bitwiseAND(1)).when(rate == 2, kbps * 3)
    )
    return (words * 2).cast("int")


# -- subtitles

#: Style words and their colours.
COLOURS = {
    "black": "000000", "white": "FFFFFF", "red": "FF0000", "green": "00ff00", "yellow": "FFFF00", "blue": "0000FF", "orange": "ffcc00", "pink": "FF8080",
    "cyan": "00FFFF", "purple": "C000FF", "niconicowhite": "cccc99", "white2": "cccc99", "truered": "cc0033", "red2": "cc0033", "passionorange": "ff6600", "orange2": "ff6600",
    "madyellow": "999900", "yellow2": "999900", "elementalgreen": "00cc66", "green2": "00cc66", "marineblue": "33ffcc", "blue2": "33ffcc", "nobleviolet": "6633cc", "purple2": "6633cc",
}


def style_colour(mail: Column) -> Column:
    """RRGGBB of style words: the last #rrggbb, else the last colour name, else white."""
    words = F.split(F.coalesce(mail, L("")), " ")
    table = F.create_map(*[L(x) for pair in COLOURS.items() for x in pair])
    coded = F.transform(F.filter(words, lambda w: w.rlike("#[0-9A-Fa-f]{6}")), lambda w: F.regexp_extract(w, "#([0-9A-Fa-f]{6})", 1))
    named = F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda c: c.isNotNull())
    return F.coalesce(F.try_element_at(coded, L(-1)), F.try_element_at(named, L(-1)), L("FFFFFF"))


def colour_tag(colour: Column) -> Column:
    """Subtitle colour code: bytes in the order blue, green, red; black gets a white outline."""
    tag = F.concat(L("\\1c&H"), F.substring(colour, 5, 2), F.substring(colour, 3, 2), F.substring(colour, 1, 2), L("&"))
    return F.when(colour == "000000", F.concat(tag, L("\\3c&HFFFFFF&"))).otherwise(tag)


def wrap_option(text: Column) -> Column:
    """At most three lines: after 7 and 14 characters."""
    n = F.char_length(text)
    return F.concat(
        F.substring(text, 1, 7),
        F.when(n > 7, F.concat(L("\\N"), F.substring(text, 8, 7))).otherwise(L("")),
        F.when(n > 14, F.concat(L("\\N"), F.substring(text, L(15), n))).otherwise(L("")),
    )


def per_mille_text(value: Column) -> Column:
    """Per mille as percent; whole numbers without decimals."""
    tenths = value % 10
    whole = F.floor(value / 10).cast("bigint").cast("string")
    return F.when(tenths == 0, whole).otherwise(F.concat(whole, L("."), tenths.cast("string")))


def shrink(text: Column, chars: Column, most: int = 50) -> Column:
    """A smaller font where there are more than `most` characters."""
    return F.when(chars > most, F.replace(text, L("fsp0"), L("fsp0\\fs30"))).otherwise(text)
