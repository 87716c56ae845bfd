"""Long spans that several documents have verbatim in common, by suffix automata over content-defined tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import merge_intervals
from ..session import through_table
from .text_arrays import WindowHash, code_points, slices, sliding

GRAM = 16  # code points hashed at each place to choose anchors


def anchors(flat: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Places whose gram has the least hash of some `window` successive places of its text.

    They depend on nearby text only: each `window` + GRAM - 1 code points that two texts have in common hold a common anchor.
    """
    h = (WindowHash(flat).all(GRAM) >> np.uint64(33)).astype(np.uint32)
    if len(h) < window:
        return np.zeros(0, np.int64)
    # windows that cross the end of a text choose nothing
    text = np.searchsorted(starts, np.arange(len(h) - window + 1), "right") - 1
    inside = np.arange(len(h) - window + 1) + window + GRAM - 1 <= starts[text + 1]
    least = np.where(inside, sliding(h, window, np.minimum), 0)
    chosen = np.concatenate([np.zeros(window - 1, np.uint32), least, np.zeros(window - 1, np.uint32)])
    return np.flatnonzero((sliding(chosen, window, np.maximum) == h) & (h > 0))


class SuffixAutomaton:
    """Suffix automaton of the token sequences of the reference texts, one after another with separators between them."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.end = [-1], [0], [-1]
        self.clone = [False]
        self.last = 0
        self.size = 0

    def add(self, token: int) -> None:
        nxt, link, length = self.next, self.link, self.len
        cur = len(nxt)
        nxt.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        self.end.append(self.size)
        self.clone.append(False)
        p = self.last
        while p >= 0 and token not in nxt[p]:
            nxt[p][token] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][token]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                c = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                self.end.append(self.end[q])
                self.clone.append(True)
                while p >= 0 and nxt[p].get(token) == q:
                    nxt[p][token] = c
                    p = link[p]
                link[q] = link[cur] = c
        self.last = cur
        self.size += 1

    def finish(self) -> None:
        self.children: dict[int, list[int]] = {}
        for s in range(1, len(self.link)):
            self.children.setdefault(self.link[s], []).append(s)

    def ends(self, state: int) -> Iterator[int]:
        """Places where the strings of a state end."""
        stack = [state]
        while stack:
            s = stack.pop()
            if not self.clone[s]:
                yield self.end[s]
            stack.extend(self.children.get(s, ()))


def common_spans(refs: list[str], probes: list[str], length: int, window: int = 32) -> Iterator[tuple[int, int, int, int, int]]:
    """(ref, probe, place in ref, place in probe, size) of the maximal common runs of at least `length` code points.

    Texts are cut into tokens at their anchors. The automaton of the references' tokens gives, for each token of a probe, the longest
    match that ends there (matching statistics); a common run of `length` always leaves whole equal tokens of at least
    length - 4 * window - GRAM code points, and matches of that size are extended and measured on the texts themselves.
    """
    least = length - 4 * window - GRAM
    if least < 1:
        raise ValueError("length is too small for this window")

    def cut(texts: list[str]):
        flat, starts = code_points(texts)
        at = anchors(flat, starts, window)
        text = np.searchsorted(starts, at, "right") - 1
        h = WindowHash(flat).at(at[:-1], at[1:]).astype(np.int64) if len(at) > 1 else np.zeros(0, np.int64)
        same = text[:-1] == text[1:]
        first = np.searchsorted(text, np.arange(len(texts) + 1))
        local = at - starts[text]
        return [(local[first[i] : first[i + 1]].tolist(), h[first[i] : max(first[i], first[i + 1] - 1)].tolist()) for i in range(len(texts))], same

    ref_cut, _ = cut(refs)
    probe_cut, _ = cut(probes)
    wanted = set()
    for _, tokens in probe_cut:
        wanted.update(tokens)
    sam = SuffixAutomaton()
    where: list[tuple[int, int]] = []  # reference and token number of each place of the automaton
    separator = 1 << 70
    for r, (_, tokens) in enumerate(ref_cut):
        open_run = False
        for j, t in enumerate(tokens):
            if t in wanted:  # tokens no probe has can match nothing: one separator stands for them
                sam.add(t)
                where.append((r, j))
                open_run = True
            elif open_run:
                separator += 1
                sam.add(separator)
                where.append((-1, -1))
                open_run = False
        if open_run:
            separator += 1
            sam.add(separator)
            where.append((-1, -1))
    sam.finish()
    nxt, link, lens = sam.next, sam.link, sam.len
    for q, (at, tokens) in enumerate(probe_cut):
        state, matched = 0, 0
        done: set[tuple[int, int, int]] = set()
        text = probes[q]
        for i, t in enumerate(tokens):
            while state and t not in nxt[state]:
                state = link[state]
                matched = lens[state]
            if t in nxt[state]:
                state = nxt[state][t]
                matched += 1
            else:
                state, matched = 0, 0
                continue
            # the match in code points: tokens i - matched + 1 .. i
            if at[i + 1] - at[i + 1 - matched] < least:
                continue
            # the shortest suffix that is long enough, whose state holds all references with such a match
            s, m = state, matched
            while s and at[i + 1] - at[i + 1 - lens[link[s]]] >= least and lens[link[s]] > 0:
                s = link[s]
                m = lens[s]
            follow = tokens[i + 1] if i + 1 < len(tokens) else None
            for e in sam.ends(s):
                r, j = where[e]
                ra, rt = ref_cut[r]
                if follow is not None and j + 1 < len(rt) and rt[j + 1] == follow:
                    continue  # reported where it ends
                a, b = ra[j + 1], at[i + 1]
                lo = _back(refs[r], text, a, b)
                hi = _forth(refs[r], text, a, b)
                key = (r, a - lo, b - lo)
                if lo + hi >= length and key not in done:
                    done.add(key)
                    yield r, q, a - lo, b - lo, lo + hi


def _forth(x: str, y: str, i: int, j: int) -> int:
    """Length of the common run of x from i and y from j."""
    n, step, most = 0, 64, min(len(x) - i, len(y) - j)
    while n < most:
        s = min(step, most - n)
        if x[i + n : i + n + s] == y[j + n : j + n + s]:
            n += s
            step *= 2
        elif s == 1:
            break
        else:
            most = n + s - 1
            step = max(1, s // 2)
    return n


def _back(x: str, y: str, i: int, j: int) -> int:
    """Length of the common run of x and y that ends before i and j."""
    n, step, most = 0, 64, min(i, j)
    while n < most:
        s = min(step, most - n)
        if x[i - n - s : i - n] == y[j - n - s : j - n]:
            n += s
            step *= 2
        elif s == 1:
            break
        else:
            most = n + s - 1
            step = max(1, s // 2)
    return n


_SPANS = "doc_id_a bigint, doc_id_b bigint, from_a bigint, from_b bigint, size bigint"


def _base(docs: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("d"), F.col(f"`{text}`").alias("t")).where(f"d is not null and length(t) >= {int(length)}")


def text_classes(docs: DataFrame, doc_id: str, text: str, length: int = 300) -> DataFrame:
    """(d, r, c): documents whose whole text another document has too, with the smallest id of their class and the length; by SHA-256 of the texts.

    Texts shorter than `length` are in no class, nor are ids that come with several texts. Only (id, digest) are shuffled.
    """
    units = _base(docs, doc_id, text, length).select("d", F.unhex(F.sha2("t", 256)).alias("s"), F.length("t").cast("bigint").alias("c"))
    one = units.groupBy("d").agg(F.min("s").alias("s"), F.max("s").alias("_s"), F.max("c").alias("c")).where("s = _s").drop("_s")
    classes = one.groupBy("s").agg(F.min("d").alias("r"), F.count("*").alias("_n")).where("_n > 1").select("s", "r")
    return through_table(one.join(classes, "s").select("d", "r", "c"), "classes")


def representative_spans(
    docs: DataFrame, doc_id: str, text: str, classes: DataFrame, length: int = 300, shard_points: int = 1 << 20, slice_points: int = 4 << 20,
    window: int = 96,
) -> DataFrame:
    """(doc_id_a, doc_id_b, from_a, from_b, size): maximal spans common to two different texts, a < b, of each class of equal texts its first document.

    1. Each document gives the hashes of the `length` - `window` code points from each of its anchors, once, into a table. A common span of
       `length` always has one in common, so documents that share none need not meet. Hashes of one document only are dropped; the aggregation
       that finds them combines before it shuffles, so a hash that a third of all documents have is no matter.
    2. Documents that share something are the reference shards, by hash of the id, about `shard_points` code points each. A document goes to the
       shards that hold an earlier document with a hash of its own, and nowhere else; a shard that much text goes to takes it in slices.
    3. In a task: the suffix automaton of the shard's documents, over content-defined tokens; the documents that come stream
       through it (see common_spans), and what it reports is measured on the texts. Hashes choose who meets; they decide nothing.
    """
    base = _base(docs, doc_id, text, length)
    reach = length - window

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, part in slices(batch, 1):
                flat, starts = code_points(part)
                at = anchors(flat, starts, window)
                doc = np.searchsorted(starts, at, "right") - 1
                fits = at + reach <= starts[doc + 1]
                at, doc = at[fits], doc[fits]
                h = WindowHash(flat).at(at, at + reach).astype(np.int64)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                size = np.diff(starts)[doc[new]]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(doc[new])), pa.array(h[new]), pa.array(size.astype(np.int32))], names=["d", "h", "c"])

    spread = through_table(base.mapInArrow(seeds, "d bigint, h bigint, c int"), "anchors")
    several = spread.groupBy("h").agg(F.min("d").alias("_a"), F.max("d").alias("_b")).where("_a < _b").select("h")
    several = through_table(several, "several")  # a table's size is known: Spark broadcasts it where it is small, and shuffles where it is not
    copies = classes.where("d <> r").select("d")
    common = through_table(spread.join(several, "h", "left_semi").join(copies, "d", "left_anti"), "common")
    involved = through_table(common.groupBy("d").agg(F.max("c").alias("c")), "involved")
    total = involved.agg(F.sum("c")).first()[0] or 0
    shards = max(1, -(-total // shard_points))

    shard = F.pmod(F.xxhash64("d"), F.lit(shards)).cast("int")
    first = common.groupBy("h", shard.alias("k")).agg(F.min("d").alias("_a"))
    route = common.join(first, "h").where("_a < d").groupBy("d", "k").agg(F.max("c").alias("c"))
    route = through_table(route, "route")
    load = route.groupBy("k").agg(F.ceil(F.sum("c") / F.lit(slice_points)).cast("int").alias("n"))
    routed = route.join(load, "k").select("d", "k", F.pmod(F.xxhash64("d", F.lit(7)), F.col("n")).cast("int").alias("s"))

    texts = base.join(involved.select("d"), "d", "left_semi").distinct()
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in ("k", "s", "d", "t")])  # noqa: E731  both sides come from `texts`: own column ids
    refs = fresh(texts.withColumn("k", shard).join(routed.select("k", "s").distinct(), "k"))
    probes = fresh(texts.join(routed, "d"))

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        rd, qd = left.column("d").to_pylist(), right.column("d").to_pylist()
        found = [(rd[r], qd[q], a, b, n) for r, q, a, b, n in common_spans(left.column("t").to_pylist(), right.column("t").to_pylist(), length) if rd[r] < qd[q]]
        cols = list(zip(*found)) if found else [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["doc_id_a", "doc_id_b", "from_a", "from_b", "size"])

    return refs.groupBy("k", "s").cogroup(probes.groupBy("k", "s")).applyInArrow(match, _SPANS).distinct()


def shared_spans(docs: DataFrame, doc_id: str, text: str, length: int = 300, **sizes: int) -> DataFrame:
    """(doc_id_a, doc_id_b, from_a, from_b, size): maximal spans of at least `length` code points common to two documents, a < b.

    Different texts meet by their first documents (representative_spans); the pairs of their copies, and those within a class of equal texts, are
    put in at the end. The result holds every pair, as its definition demands: use text_classes and representative_spans where classes will do.

    What is shuffled: the hashes (two per `window` + 1 code points), and texts of documents that share something, once as reference and
    once for each shard they are sent to.

    Defined results: null texts and null ids are left out; rows repeated with the same id and text count once, rows with the same id and
    different texts are parts of one document and do not meet; texts shorter than `length` have no spans; an empty table gives none.
    """
    classes = text_classes(docs, doc_id, text, length)
    spans = representative_spans(docs, doc_id, text, classes, length, **sizes)
    member = lambda side: classes.select(F.col("r").alias(f"_r{side}"), F.col("d").alias(f"_d{side}"))
    wide = spans.join(member("a"), F.col("doc_id_a") == F.col("_ra"), "left").join(member("b"), F.col("doc_id_b") == F.col("_rb"), "left")
    a, b = F.coalesce("_da", "doc_id_a"), F.coalesce("_db", "doc_id_b")
    between = wide.select(F.least(a, b).alias("doc_id_a"), F.greatest(a, b).alias("doc_id_b"), F.when(a < b, F.col("from_a")).otherwise(F.col("from_b")).alias("from_a"), F.when(a < b, F.col("from_b")).otherwise(F.col("from_a")).alias("from_b"), "size")
    x, y = classes.alias("x"), classes.alias("y")
    zero = F.lit(0).cast("bigint")
    within = x.join(y, (F.col("x.r") == F.col("y.r")) & (F.col("x.d") < F.col("y.d"))).select(F.col("x.d").alias("doc_id_a"), F.col("y.d").alias("doc_id_b"), zero.alias("from_a"), zero.alias("from_b"), F.col("x.c").alias("size"))
    return between.unionByName(within)


def shared_parts(docs: DataFrame, doc_id: str, text: str, length: int = 300, earlier_only: bool = False, **sizes: int) -> DataFrame:
    """(d, a, b): the stretches [a, b) of each document that occur in another document too, merged; with `earlier_only` in one of smaller id.

    Nothing is expanded to pairs: a document with an equal text elsewhere is shared from end to end, a copy has the stretches of its class's first
    document besides.
    """
    classes = text_classes(docs, doc_id, text, length)
    spans = representative_spans(docs, doc_id, text, classes, length, **sizes)
    own = spans.select(F.col("doc_id_b").alias("d"), F.col("from_b").alias("a"), (F.col("from_b") + F.col("size")).alias("b"))
    if not earlier_only:
        own = own.unionByName(spans.select(F.col("doc_id_a").alias("d"), F.col("from_a").alias("a"), (F.col("from_a") + F.col("size")).alias("b")))
    copies = classes.where("d <> r") if earlier_only else classes
    whole = copies.select("d", F.lit(0).cast("bigint").alias("a"), F.col("c").alias("b"))
    covered = merge_intervals(own.unionByName(whole), ["d"], "a", "b", bucket_width=1 << 20).where("kind = 'covered'")
    return covered.select("d", F.col("from_us").alias("a"), F.col("until_us").alias("b"))


def without_shared(docs: DataFrame, doc_id: str, text: str, length: int = 300, **sizes: int) -> DataFrame:
    """(doc_id, text, removed): every document without the spans of at least `length` that an earlier document (smaller id) has verbatim; one copy stays.

    Documents without such spans come as they are, null texts as null; an id with several texts keeps them all.
    """
    parts = through_table(shared_parts(docs, doc_id, text, length, earlier_only=True, **sizes), "parts")
    cut = parts.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("_p"))  # at most length / `length` stretches of a document
    t = F.col("t")
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("bigint").alias("at"))
    step = lambda acc, p: F.struct(F.concat(acc["kept"], F.substring(t, (acc["at"] + 1).cast("int"), (p["a"] - acc["at"]).cast("int"))).alias("kept"), p["b"].alias("at"))
    kept = F.aggregate("_p", start, step, lambda acc: F.concat(acc["kept"], F.substring(t, (acc["at"] + 1).cast("int"), F.length(t))))
    removed = F.aggregate("_p", F.lit(0).cast("bigint"), lambda n, p: n + p["b"] - p["a"])
    several = docs.groupBy(F.col(f"`{doc_id}`").cast("bigint").alias("d")).agg(F.min(F.xxhash64(f"`{text}`")).alias("_x"), F.max(F.xxhash64(f"`{text}`")).alias("_y")).where("_x <> _y").select("d")
    cut = cut.join(several, "d", "left_anti")
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("d"), F.col(f"`{text}`").alias("t")).join(cut, "d", "left")
    return rows.select(F.col("d").alias("doc_id"), F.when(F.col("_p").isNull(), t).otherwise(kept).alias("text"), F.coalesce(removed, F.lit(0).cast("bigint")).alias("removed"))
