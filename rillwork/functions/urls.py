"""URLs: joining, names, parameters and routing by ordered rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..session import through_table

L = F.lit


def is_absolute(url: Column) -> Column:
    return url.rlike("^(https?|file|ftp)://")


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def query_of(url: Column) -> Column:
    """The query with its question mark, or an empty text."""
    return F.regexp_extract(url, r"(\?[^#]*)", 1)


def origin_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1)


def join_base(base: Column, ref: Column) -> Column:
    """ref against base: absolute ones replace it, rooted ones keep its origin, others its folder; a ref without query inherits the base's.

    Dot segments are kept as they are; join_base_full resolves them.
    """
    folder = F.concat(origin_of(base), F.coalesce(F.nullif(F.regexp_extract(without_query(base), r"^[a-z]+://[^/]*(/.*/)[^/]*$", 1), L("")), L("/")))
    plain = F.when(is_absolute(ref), ref).when(ref.startswith("/"), F.concat(origin_of(base), ref)).when(ref == "", without_query(base)).otherwise(F.concat(folder, ref))
    return F.when(is_absolute(ref) | ref.contains("?"), plain).otherwise(F.concat(plain, query_of(base)))


def _join(base: str | None, ref: str | None) -> str | None:
    if base is None or ref is None:
        return None
    if re.match(r"(https?|file|ftp)://", ref):
        return ref
    joined = urlsplit(urljoin(base, ref))
    return urlunsplit(joined if joined.query else joined._replace(query=urlsplit(base).query))


@F.pandas_udf(StringType())
def join_base_full(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The same with RFC 3986 dot segments."""
    for base, ref in rows:
        yield pd.Series([_join(b, r) for b, r in zip(base, ref)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def join_each(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Each reference of an array joined with one base; null references stay null."""
    for base, refs in rows:
        yield pd.Series([None if r is None else [_join(b, x) for x in r] for b, r in zip(base, refs)], dtype=object)


@F.pandas_udf(StringType())
def join_levels(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A base joined with an array of references in turn; null references change nothing."""
    for base, refs in rows:
        out = []
        for b, levels in zip(base, refs):
            for r in [] if levels is None else levels:
                b = b if r is None else _join(b, r)
            out.append(b)
        yield pd.Series(out, dtype=object)


def url_filename(url: Column) -> Column:
    """Text after the last slash of the path, which may be empty; null where the URL has no path."""
    path = F.regexp_extract(without_query(url), r"^[a-z]+://[^/]*(/.*)$", 1)
    return F.when(path != "", F.substring_index(path, "/", -1))


def segment_filename(url: Column, byte_range: Column) -> Column:
    """The file name of a segment; URLs without a path are named by a hash of URL and range."""
    return F.coalesce(url_filename(url), F.hex(F.xxhash64(url, byte_range)))


def query_parameters(url: Column) -> Column:
    """map of decoded parameters; of equal names the last counts."""
    pairs = F.filter(F.split(F.regexp_replace(query_of(url), r"^\?", ""), "&"), lambda p: p != "")
    decode = lambda s: F.try_url_decode(s)
    entries = F.transform(pairs, lambda p: F.struct(F.coalesce(decode(F.split_part(p, L("="), L(1))), L("")).alias("k"), F.coalesce(decode(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(L(""))), L("")).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"]))
    return F.map_from_entries(last)


@dataclass(frozen=True)
class Route:
    """A rule: scheme (`*`, `http` for both, or exact), host (`*`, a name, or several with `|`) and path (`*`, or with {name} and {*rest})."""

    value: str
    host: str = "*"
    path: str = "*"
    scheme: str = "http"

    def host_regex(self) -> str:
        return ".*" if self.host == "*" else "(?:" + "|".join(re.escape(h) for h in self.host.split("|")) + ")"

    def scheme_regex(self) -> str:
        return {"*": "[a-z][a-z0-9+.-]*", "http": "https?"}.get(self.scheme, re.escape(self.scheme))

    def path_regex(self) -> tuple[str, list[str]]:
        """Pattern and names of its groups."""
        if self.path == "*":
            return ".*", []
        names, out = [], ""
        for part in re.split(r"(\{[^}]*\})", self.path):
            if part.startswith("{"):
                name = part[1:-1]
                names.append(name.lstrip("*"))
                out += "(.+)" if name.startswith("*") else "([^/]+)"
            else:
                out += re.escape(part)
        return out, names


def route(df: DataFrame, url: str, rules: list[Route]) -> DataFrame:
    """df with route (value of the rule), path_params and query_params.

    The first rule whose scheme and host fit decides which host rules count: a later rule for another host pattern is not tried when the
    paths of that host's rules fail. Within a host the first path that fits wins. Rules with a wildcard path give no parameters.
    URLs that fit no rule, and null ones, have null in all three. Rules are compiled on the driver into one expression; no join.
    """
    u = F.col(f"`{url}`")
    scheme, host = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1), F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    path = F.regexp_extract(without_query(u), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*)?$", 1)
    path = F.when(path == "", L("/")).otherwise(path)
    groups: dict[tuple[str, str], list[Route]] = {}
    for r in rules:
        groups.setdefault((r.scheme, r.host), []).append(r)
    chosen, params = L(None).cast("string"), L(None).cast("map<string,string>")
    for (_, _), own in reversed(list(groups.items())):
        fits = scheme.rlike("^" + own[0].scheme_regex() + "$") & host.rlike("^" + own[0].host_regex() + "$")
        value, named = L(None).cast("string"), L(None).cast("map<string,string>")
        for r in reversed(own):
            regex, names = r.path_regex()
            hit = path.rlike("^" + regex + "$")
            value = F.when(hit, L(r.value)).otherwise(value)
            pairs = [x for i, n in enumerate(names) for x in (L(n), F.regexp_extract(path, "^" + regex + "$", i + 1))]
            named = F.when(hit, F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).otherwise(named)
        chosen = F.when(fits, value).otherwise(chosen)
        params = F.when(fits, named).otherwise(params)
    wild = [r.value for r in rules if r.path == "*"]
    query = F.when(chosen.isNull(), L(None)).when(chosen.isin(*wild) if wild else L(False), F.create_map().cast("map<string,string>")).otherwise(query_parameters(u))
    return df.withColumn("route", chosen).withColumn("path_params", params).withColumn("query_params", query)


def follow_redirects(df: DataFrame, start: str, redirects: DataFrame, source: str, target: str) -> DataFrame:
    """df with `final` and `hops`: where redirects lead from df.start, by pointer doubling until no row changes.

    Each source has one target. A chain that never ends, because it runs into a loop, has null in both. Each round is written to the
    shared folder, so plans do not grow; rounds are at most the logarithm of the number of redirects, and a few for short chains.
    """
    jump = redirects.select(F.col(source).alias("_from"), F.col(target).alias("_to"), L(1).alias("_hops"), L(True).alias("_on"))
    most, reach = redirects.count(), 1
    while True:
        on = jump.select(F.col("_from").alias("_mid"), F.col("_to").alias("_far"), F.col("_hops").alias("_more"))
        step = jump.drop("_on").join(on, F.col("_to") == F.col("_mid"), "left")
        step = step.select("_from", F.coalesce("_far", "_to").alias("_to"), (F.col("_hops") + F.coalesce("_more", L(0))).alias("_hops"), F.col("_mid").isNotNull().alias("_on"))
        jump = through_table(step, "redirects")
        # without a loop a chain has at most as many hops as there are redirects: what moves beyond that never ends
        if reach >= most or jump.where("_on").isEmpty():
            break
        reach *= 2
    out = df.join(jump, F.col(start) == F.col("_from"), "left")
    final = F.when(F.coalesce("_on", L(False)), L(None)).otherwise(F.coalesce("_to", F.col(start)))
    hops = F.when(F.coalesce("_on", L(False)), L(None)).otherwise(F.coalesce("_hops", L(0)))
    return out.withColumn("final", final).withColumn("hops", hops).drop("_from", "_to", "_hops", "_on")


@F.pandas_udf(ArrayType(StringType()))
def shell_words(text: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Words as a shell splits them: quoted ones stay whole; a text with an open quote is split at spaces."""
    import shlex

    def one(t):
        if t is None:
            return None
        try:
            return shlex.split(t)
        except ValueError:
            return t.split()

    for s in text:
        yield s.map(one)
