"""Held-out evaluation items inside training documents: rare n-gram seeds, then local alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text_arrays import WindowHash, code_points, slices, sliding

#: Normalised code points of items per broadcast block; larger item sets are scanned in several blocks.
BLOCK_POINTS = 2_000_000
#: Cells of alignment tables that are filled at once.
ALIGN_CELLS = 1 << 19
_LAST = 0x32400
_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case form and is-letter-or-digit of every code point below _LAST; there are no letters beyond."""
    if not _tables:
        low, keep = np.arange(_LAST, dtype=np.uint32), np.zeros(_LAST, bool)
        for c in range(_LAST):
            s = chr(c).lower()
            low[c] = ord(s[0]) if s else c
            keep[c] = s[:1].isalnum()
        _tables.extend([low, keep])
    return _tables[0], _tables[1]


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased letters and digits of all texts, starts with the end last, their places in the joined texts)."""
    low, keep = _letters()
    flat, starts = code_points(texts)
    safe = np.minimum(flat, _LAST - 1)
    at = np.flatnonzero(keep[safe] & (flat < _LAST))
    return low[safe[at]], np.searchsorted(at, starts), at


@dataclass
class Seeds:
    """What a scan looks for: sorted gram hashes, for each a slice of (item, place); and the items themselves."""

    k: int
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    texts: list[np.ndarray]
    sieve: np.ndarray

    @staticmethod
    def build(items: list[np.ndarray], k: int, wanted: list[np.ndarray]) -> "Seeds":
        hashes, item, place = [], [], []
        for i, (t, at) in enumerate(zip(items, wanted)):
            h = WindowHash(t).all(k)[at]
            hashes.append(h)
            item.append(np.full(len(at), i, np.int64))
            place.append(at)
        h, it, pl = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, item, place))
        order = np.argsort(h, kind="stable")
        h, it, pl = h[order].astype(np.uint64), it[order], pl[order]
        u, first = np.unique(h, return_index=True)
        sieve = np.zeros(1 << 22, bool)
        sieve[(u >> np.uint64(42)).astype(np.int64)] = True
        return Seeds(k, u, np.append(first, len(h)), it, pl, items, sieve)

    def hits(self, norm: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, gram) of every window of one text that is a seed."""
        h = WindowHash(norm).all(self.k)
        at = np.flatnonzero(self.sieve[(h >> np.uint64(42)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            z = np.zeros(0, np.int64)
            return z, z, z
        g = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        text = np.searchsorted(starts, at, "right") - 1
        ok = (self.hashes[g] == h[at]) & (at + self.k <= starts[text + 1])
        return text[ok], at[ok], g[ok]


def rarest_places(frequency: np.ndarray, window: int) -> np.ndarray:
    """Places of grams that occur (frequency above 0): the rarest of each `window` successive places, the first of equals.

    Grams that occur nowhere never stand for others: they lie across the edits of a copy and can hit nothing. So `window` successive grams
    that all occur hold at least one place.
    """
    n = len(frequency)
    if n == 0:
        return np.zeros(0, np.int64)
    window = min(window, n)
    frequency = frequency.astype(np.int64)
    score = np.where(frequency > 0, frequency, frequency.max() + 1) * n + np.arange(n)
    at = np.unique(sliding(score, window, np.minimum) % n)
    return at[frequency[at] > 0]


def smith_waterman(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -2, gap: int = 2) -> int:
    """Best local alignment score of two arrays with linear gaps; a row at a time, gaps along the row by a running maximum."""
    if not len(a) or not len(b):
        return 0
    slope = np.arange(len(b) + 1) * gap
    row, best = np.zeros(len(b) + 1, np.int64), 0
    for x in a:
        new = np.zeros(len(b) + 1, np.int64)
        np.maximum(row[:-1] + np.where(b == x, match, mismatch), row[1:] - gap, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope) - slope
        best = max(best, int(row.max()))
    return best


def alignments(pairs: list[tuple[np.ndarray, np.ndarray]], match: int = 2, mismatch: int = -2, gap: int = 2) -> np.ndarray:
    """smith_waterman of every pair, many at once: one axis for the pairs, one for the second array; padding matches nothing."""
    best = np.zeros(len(pairs), np.int64)
    order = sorted((i for i, (a, b) in enumerate(pairs) if len(a) and len(b)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])), reverse=True)
    while order:
        width = len(pairs[order[0]][1])
        part, order = order[: max(1, ALIGN_CELLS // width)], order[max(1, ALIGN_CELLS // width) :]
        a = np.full((max(len(pairs[i][0]) for i in part), len(part)), 0xFFFFFFFF, np.uint32)
        b = np.full((width, len(part)), 0xFFFFFFFE, np.uint32)
        for j, i in enumerate(part):
            a[: len(pairs[i][0]), j], b[: len(pairs[i][1]), j] = pairs[i]
        slope = (np.arange(width + 1, dtype=np.int32) * gap)[:, None]
        row, top = np.zeros((width + 1, len(part)), np.int32), np.zeros(len(part), np.int32)
        for x in a:
            new = np.zeros_like(row)
            np.maximum(row[:-1] + np.where(b == x, np.int32(match), np.int32(mismatch)), row[1:] - np.int32(gap), out=new[1:])
            np.maximum(new, 0, out=new)
            new += slope
            row = np.maximum.accumulate(new, axis=0, out=new)
            row -= slope
            np.maximum(top, row.max(0), out=top)
        best[part] = top
    return best


def longest_run(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> tuple[int, int]:
    """(length, start in a) of the longest common run of a and b on the given diagonals (place in a minus place in b)."""
    best, where = 0, 0
    for d in diagonals.tolist():
        lo, hi = max(0, d), min(len(a), d + len(b))
        if hi - lo <= best:
            continue
        edge = np.flatnonzero(np.concatenate([[True], a[lo:hi] != b[lo - d : hi - d], [True]]))
        size = np.diff(edge) - 1
        i = int(size.argmax())
        if size[i] > best:
            best, where = int(size[i]), lo + int(edge[i])
    return best, where


_SCHEMA = "doc_id bigint, item_id bigint, alignment bigint, score double, run bigint, run_from bigint, run_until bigint"


def leaked_items(
    docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str,
    run: int = 60, k: int = 12, intact: int = 14, block_points: int = BLOCK_POINTS,
) -> DataFrame:
    """(doc_id, item_id, alignment, score, run, run_from, run_until) for every document and item that share a seed.

    Texts are compared by their lower-cased letters and digits. Seeds are k-grams of the items that occur in some document: of each stretch of
    `intact` characters of an item the one found in the fewest documents (counted over all of them). So any common run of `intact` characters,
    or of `run` if that is less, contains a seed: no run of `run` characters is missed, and no edited copy that keeps `intact` successive
    characters anywhere; a copy that is edited more densely than that throughout is no candidate. Documents stream past the seeds; a pair that
    shares one is aligned (Smith-Waterman: 2 a match, -2 a mismatch or gap; score is the alignment relative to the item's best possible, 1.0 for a verbatim copy) around the places of its
    seeds, and its longest exact run on the seeds' diagonals is measured. run_from and run_until are code points of the document's own text.

    The items are broadcast in blocks of at most `block_points` characters, whatever their number; documents are never shuffled, only
    (gram, count) and the resulting pairs are.

    Defined results: null or empty texts have no pairs; items with fewer than k letters and digits have none; repeated documents
    and repeated items each give their own rows, exact repetitions of a row are folded; an empty table gives no rows. Ids are BIGINTs.
    """
    own = items.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").alias("t")).dropna().distinct()
    size = own.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_points))
    base = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("d"), F.col(f"`{text}`").alias("t")).dropna()
    out = None
    for b in range(blocks):
        block = own.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).orderBy("i", "t").collect()  # at most about block_points characters
        part = _scan(base, [r[0] for r in block], [r[1] for r in block], min(run, intact), k)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _scan(docs: DataFrame, ids: list[int], texts: list[str], intact: int, k: int) -> DataFrame:
    spark = docs.sparkSession
    norm, starts, _ = normalise(texts) if texts else (np.zeros(0, np.uint32), np.zeros(1, np.int64), None)
    arrays = [norm[a:b] for a, b in zip(starts[:-1], starts[1:])]
    every = Seeds.build(arrays, k, [np.arange(max(0, len(t) - k + 1)) for t in arrays])
    shared = spark.sparkContext.broadcast(every)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        total = np.zeros(len(seeds.hashes), np.int64)
        for batch in batches:
            for _, part in slices(batch, 0):
                flat, st, _ = normalise(part)
                doc, _, gram = seeds.hits(flat, st)
                seen = np.unique(doc * len(seeds.hashes) + gram) % max(1, len(seeds.hashes))
                total += np.bincount(seen, minlength=len(total))
        g = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(total[g])], names=["g", "n"])

    frequency = np.zeros(len(every.hashes), np.int64)
    # one row per gram of the block at most
    for g, n in docs.select("t").mapInArrow(count, "g bigint, n bigint").groupBy("g").agg(F.sum("n")).collect():
        frequency[g] = n
    wanted = []
    for t in arrays:
        h = WindowHash(t).all(k)
        wanted.append(rarest_places(frequency[np.searchsorted(every.hashes, h)], max(1, intact - k + 1)))
    rare = spark.sparkContext.broadcast((Seeds.build(arrays, k, wanted), np.array(ids, np.int64)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, names = rare.value
        for batch in batches:
            for rows, part in slices(batch, 1):
                flat, st, at = normalise(part)
                _, own = code_points(part)
                doc, pos, gram = seeds.hits(flat, st)
                if not len(doc):
                    continue
                many = seeds.first[gram + 1] - seeds.first[gram]
                src = np.repeat(np.arange(len(doc)), many)
                which = np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many) + seeds.first[gram][src]
                item, diagonal = seeds.item[which], pos[src] - st[doc[src]] - seeds.place[which]
                pair = doc[src] * len(names) + item
                order = np.argsort(pair, kind="stable")
                cuts = np.flatnonzero(np.diff(pair[order])) + 1
                found, sides, owner = [], [], []
                for group in np.split(order, cuts):
                    d, i = int(doc[src[group[0]]]), int(item[group[0]])
                    a, b = flat[st[d] : st[d + 1]], seeds.texts[i]
                    ways = np.unique(diagonal[group])
                    n, where = longest_run(a, b, ways)
                    # an alignment of score 0.5 leaves its seeds' diagonals by at most half of the item
                    slack = 8 + len(b) // 2
                    for lo, hi in _stretches(ways, len(b)):
                        sides.append((b, a[max(0, lo - slack) : hi + len(b) + slack]))
                        owner.append(len(found))
                    first = at[st[d] + where] - own[d]
                    last = at[st[d] + where + n - 1] - own[d] + 1
                    found.append([d, int(names[i]), 0, 2 * len(b), n, int(first), int(last)])
                score = np.zeros(len(found), np.int64)
                np.maximum.at(score, owner, alignments(sides))
                for row, x in zip(found, score.tolist()):
                    row[2], row[3] = x, x / row[3]
                cols = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), *[pa.array(c, pa.int64()) for c in cols[4:]]],
                    names=["doc_id", "item_id", "alignment", "score", "run", "run_from", "run_until"],
                )

    return docs.select("d", "t").mapInArrow(scan, _SCHEMA)


def _stretches(diagonals: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Diagonals that lie within an item's length of one another, as (first, last)."""
    cut = np.flatnonzero(np.diff(diagonals) > size) + 1
    return [(int(g[0]), int(g[-1])) for g in np.split(diagonals, cut)]
