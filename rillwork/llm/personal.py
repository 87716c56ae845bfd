"""Personal information in free text, by a semi-Markov conditional random field.

A text is cut into tokens; every segment of up to MOST_TOKENS tokens that starts and ends at a letter or digit is a candidate of every kind. Whole-span features
(shape, digits, what stands before, after and inside, known patterns) score it, and dynamic programming over the segments chooses boundaries
and kinds together. Weights and transitions are fitted here by the gradient of the log-likelihood, on invented sentences (personal_samples).
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalikes import _TO_LATIN, _fold_char
from .personal_samples import WORDS, Sentence, invented_sentences
from .text_arrays import mix

#: A public vocabulary of a tokenizer, a parameter: which words it has in lower case and which only with a capital tells common words from names.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

KINDS = ("email", "phone", "id_number", "address", "person_name")
#: An entity has at most so many tokens: runs of digits, Latin words, single characters of other scripts, single signs.
MOST_TOKENS = 48
#: Fitting looks at segments up to this size; larger ones share their features.
FITTED_TOKENS = 30
#: Rows of the weight table; features are hashed into it.
ROWS = 1 << 17
#: Share of a word's n-grams in its score, against its other features.
GRAM_WEIGHT = 2.0
#: Tokens that are looked at together; bounds the memory, whatever the size of a batch of rows.
CHUNK_TOKENS = 60_000


@dataclass(frozen=True)
class Lexicon:
    """Name parts a deployment knows; empty unless given. They are features only: names outside it are found by shape, script and surroundings."""

    given: frozenset[str] = frozenset()
    surname: frozenset[str] = frozenset()


def common_words(path: str | None) -> tuple[frozenset[str], frozenset[str]]:
    """(words in lower case, words with a capital) among the entries of a vocabulary file that begin a word; none without a file."""
    if path is None:
        return frozenset(), frozenset()
    with open(path, "rb") as f:
        entries = [base64.b64decode(line.split()[0]).decode("utf-8", "ignore") for line in f]
    words = [e[1:] for e in entries if e[:1] == " " and len(e) > 3 and e[1:].isalpha()]
    return frozenset(w for w in words if w.islower()), frozenset(w.lower() for w in words if w.istitle())


# -- folding: one character out for each kept character in, with its place


def fold(text: str) -> tuple[str, list[int] | range]:
    """Width, space and look-alike variants folded, invisible characters dropped; the place in `text` of each character kept."""
    if text.isascii():
        return text, range(len(text))
    out, at = [], []
    latin = any("a" <= c.lower() <= "z" for c in text)
    for i, c in enumerate(text):
        for f in _fold_char(c):
            out.append(_TO_LATIN.get(f, f) if latin else f)
            at.append(i)
    return "".join(out), at


# -- tokens

_LT = "A-Za-zÀ-ÖØ-öø-ÿĀ-ſ"
_TOKEN = re.compile(rf"[0-9]+|[{_LT}]+(?:['’][{_LT}]+)*|\n|[^\s]")
_SPELLED = frozenset(w for ws in WORDS.values() for w in ws)
_KANJI_DIGITS = frozenset("零〇一二三四五六七八九")
#: Signs no entity goes across.
_HARD = frozenset("\0\n、。！？!?;；:：\"「」『』【】|…")
_OPEN, _CLOSE = frozenset("+(〒#"), frozenset(")")


class _Types:
    """Properties of distinct tokens, each found once: word, shapes, digits, n-grams."""

    def __init__(self, common: tuple[frozenset[str], frozenset[str]] = (frozenset(), frozenset())) -> None:
        self.common = common
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.grams: list[np.ndarray] = []

    def of(self, token: str) -> int:
        i = self.ids.get(token)
        if i is None:
            i = self.ids[token] = len(self.rows)
            row, grams = self._look(token)
            self.rows.append(row)
            self.grams.append(grams)
        return i

    def _look(self, t: str) -> tuple[tuple, np.ndarray]:
        """((word, fine shape, coarse shape, joins runs, digits, first digit, first three, may start, may end, hard, common), hashes of n-grams)."""
        c = t[0]
        code = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass"))
        one = three = digits = common = 0
        joins, start, end, grams = False, True, True, []
        if c in "0123456789":
            digits, word = len(t), f"\1{min(len(t), 17)}"
            fine, coarse = f"d{min(len(t), 17)}", "d"
            one, three = code("\2" + c), code("\2" + t[:3])
        elif c.isalpha() and (c.isascii() or "À" <= c <= "ſ"):
            low = t.lower()
            word = low
            kind = "U" if len(t) > 1 and t.isupper() else "S" if len(t) == 1 and t.isupper() else "T" if c.isupper() and t[1:].islower() else "l" if t.islower() else "M"
            fine = f"{kind}{len(t)}" if kind in "US" and len(t) < 6 else kind
            coarse = kind
            if low in _SPELLED:
                fine, coarse, joins, digits = "w" + kind, "w", True, 1
            common = 1 if low in self.common[0] else 2 if low in self.common[1] else 3 if len(low) > 2 else 0
            padded = f"^{low}$"
            grams = [padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1)]
        elif c in _KANJI_DIGITS:
            word, fine, coarse, joins, digits = t, "n", "n", True, 1
            one = code("\2" + c)
        elif "㐀" <= c <= "鿿" or c in "々〆ヶヵ豈" or ord(c) >= 0x20000:
            word, fine, coarse, joins = t, "H", "H", True
        elif "ァ" <= c <= "ー":
            word, fine, coarse, joins = t, "K", "K", True
        elif "ぁ" <= c <= "ゟ":
            word, fine, coarse, joins = t, "h", "h", True
        else:
            word, fine, coarse = t, "p" + t, "p" + t
            if not c.isalnum():
                start, end = c in _OPEN, c in _CLOSE
        row = (code(word), code(fine), code(coarse), joins, digits, one, three, start, end, c in _HARD, common)
        return row, np.array([code("\3" + g) for g in grams], np.uint64)


def _h(template: int, *values: np.ndarray) -> np.ndarray:
    """Rows of the weight table for a feature template and its values."""
    x = np.full(np.broadcast_shapes(*[np.shape(v) for v in values]), np.uint64(template * 0x9E3779B97F4A7C15 % (1 << 64)), np.uint64)
    for v in values:
        x = mix(x ^ np.asarray(v).astype(np.uint64)) + np.uint64(0x632BE59BD9B4E019)
    return (x & np.uint64(ROWS - 1)).astype(np.int64)


# -- patterns: each is one feature of the spans it matches, not a condition

_W = rf"[{_LT}0-9'’-]"
_UP = "[A-ZÀ-ÖØ-Þ]"
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9][\w.+%-]{0,64} {0,2}(?:@|[(\[{] ?(?:at|a|@|アット(?:マーク)?) ?[)\]}]|\bat\b|アット(?:マーク)?) {0,2}[A-Za-z0-9][A-Za-z0-9-]{0,62}(?: {0,2}(?:\.|[(\[{] ?(?:dot|ドット) ?[)\]}]|\bdot\b|ドット) {0,2}[A-Za-z][A-Za-z0-9-]{0,62})+", re.I | re.A),
    "ja address": re.compile(r"(?:〒 ?\d{3}-?\d{4} ?)?(?:[㐀-鿿々ヶノ]{1,6}?[都道府県市区郡町村]){1,4}[㐀-鿿ぁ-んァ-ヶ]{0,8}?\d{1,4}(?:(?:丁目|番地?|号|の|-)\d{0,4}){1,4}(?: ?[^\s\d、。/]{1,10}? ?\d{1,4}(?:号室?)?)?"),
    "street": re.compile(rf"(?:(?:Flat|Apt\.?|Unit|Suite) \d+[A-Za-z]?, )?\d+[A-Za-z]? (?:{_UP}{_W}+ ){{1,4}}?(?:Street|St|Road|Rd|Lane|Ln|Court|Ct|Avenue|Ave|Crescent|Drive|Dr|Close|Way|Place|Terrace|Row|Square|Hill|Gardens|Boulevard|Blvd|Walk)\b\.?(?:, {_UP}{_W}+(?:[ -]{_UP}?{_W}+)*?)?(?![{_LT}0-9-])"),
    "straße": re.compile(rf"{_UP}[{_LT}-]{{0,40}}(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm) \d+ ?[a-z]?(?![{_LT}\d])(?:, \d{{4,5}} {_UP}[{_LT}-]+)?"),
    "calle": re.compile(rf"(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo) (?:de |del |la |las |los )*{_UP}[{_LT}]+,? (?:n\.? ?º? ?)?\d+(?:, ?\d{{4,5}} {_UP}[{_LT}]+)?"),
    "two words": re.compile(rf"(?<![{_LT}0-9_.@#-]){_UP}[{_LT}'’-]+(?: {_UP}\.)? {_UP}[{_LT}'’-]+(?![{_LT}0-9_@-])"),
}
_PATTERN_IDS = {n: i + 1 for i, n in enumerate([*PATTERNS, "lexicon"])}


# -- lattices


@dataclass
class Lattice:
    """The tokens of some texts and their candidate segments, with the rows of all features."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    types: np.ndarray
    left: np.ndarray  # features of a segment by its first token [tokens, n]
    right: np.ndarray  # by its last token
    inside: np.ndarray  # of each token in it
    a: np.ndarray  # first token of each segment
    b: np.ndarray  # token after the last
    whole: np.ndarray  # features of the whole segment [segments, n]


def _segments(ok_start: np.ndarray, ok_end: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(ok_start)
    a, b = [], []
    for n in range(1, MOST_TOKENS + 1):
        starts = starts[room[starts] >= n]
        if not len(starts):
            break
        s = starts[ok_end[starts + n - 1]]
        a.append(s)
        b.append(s + n)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)), np.uint64)
    p[0] = q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


def lattice(texts: list[str], places: list[str], types: _Types, lexicon: Lexicon = Lexicon()) -> Lattice:
    """Tokens and segments of folded texts."""
    joined = "\0" + "\0".join(t.replace("\0", " ") for t in texts) + "\0"
    spans = [(m.start(), m.end(), types.of(m.group())) for m in _TOKEN.finditer(joined)]
    start, end, kind = (np.array(x, np.int64) for x in zip(*spans))
    T = len(start)
    props = np.array([types.rows[i] for i in kind.tolist()], np.uint64)
    word, fine, coarse, joins, digits, one, three, may_start, may_end, hard, common = props.T
    hard, may_start, may_end, joins = hard > 0, may_start > 0, may_end > 0, joins > 0
    bound = word == word[0]  # the separators between texts
    text = np.cumsum(bound) - 1
    place = np.array([1 if p == "name" else 2 for p in [*places, ""]], np.uint64)[np.minimum(text, len(places))]
    gap = np.concatenate([[0], (start[1:] > end[:-1]).astype(np.uint64)]).astype(np.uint64)
    closed = np.flatnonzero(hard)
    room = closed[np.minimum(np.searchsorted(closed, np.arange(T)), len(closed) - 1)] - np.arange(T)
    a, b = _segments(may_start & ~hard, may_end & ~hard, room)

    def shifted(x: np.ndarray, k: int) -> np.ndarray:
        """x of the token k places before (k > 0) or behind; beyond the text, that of the separator."""
        i = np.clip(np.arange(T) - k, 0, T - 1)
        v = x[i]
        return np.where(text[i] == text, v, x[0]) if k > 0 else np.where((text[i] == text) | (bound[i] & (text[i] == text + 1)), v, x[0])

    w1, w2, w3, w4 = (shifted(word, k) for k in (1, 2, 3, 4))
    n1, n2, n3 = (shifted(word, -k) for k in (1, 2, 3))
    f1, g1 = shifted(fine, 1), shifted(fine, -1)
    gap_after = np.concatenate([gap[1:], [0]]).astype(np.uint64)
    left = np.stack([
        _h(1, word), _h(2, fine, place), _h(3, w1), _h(4, w2), _h(5, w3), _h(6, w1, w2), _h(7, w1, w2, w3), _h(8, w1, w2, w3, w4), _h(9, f1, fine, gap), _h(10, w1, fine), _h(11, one, fine), _h(12, three), _h(13, shifted(fine, 2), f1, coarse), _h(14, shifted(common, 1), f1, common, fine),
    ], 1)
    right = np.stack([
        _h(21, word), _h(22, fine, place), _h(23, n1), _h(24, n2), _h(25, n1, n2), _h(26, n1, n2, n3), _h(27, g1, fine, gap_after), _h(28, n1, fine), _h(29, shifted(fine, -2), g1, coarse), _h(30, shifted(word, 1), word), _h(31, shifted(common, -1), g1, common, fine),
    ], 1)
    inside = np.stack([_h(41, word), _h(42, fine), _h(43, shifted(fine, 1), fine, gap), _h(48, common, fine)], 1)
    # the words of the 8 tokens before, in no order, as sums of a row each: single ones and pairs
    nearby = [(_h(44, shifted(word, k)), _h(45, shifted(word, k + 1), shifted(word, k))) for k in range(1, 9)]
    left = np.concatenate([left, *[np.stack(x, 1) for x in nearby]], 1)
    ahead = [_h(46, shifted(word, -k)) for k in range(1, 4)]
    right = np.concatenate([right, np.stack(ahead, 1)], 1)

    whole = np.zeros((0, 14), np.int64)
    if len(a):
        p, q = _powers(T)
        spaced = mix(fine ^ (gap * np.uint64(0xABCDEF123)))
        fsum = np.concatenate([[0], np.cumsum(spaced * p[:T])]).astype(np.uint64)
        exact = mix(fine)[a] + (fsum[b] - fsum[a + 1]) * q[a]  # fine shapes with the spaces between
        # coarse: runs of one script count once
        new = np.concatenate([[True], ~(joins[1:] & (coarse[1:] == coarse[:-1]))])
        rank = np.cumsum(new)
        csum = np.concatenate([[0], np.cumsum(np.where(new, mix(coarse) * p[np.minimum(rank, T)], np.uint64(0)))]).astype(np.uint64)
        rough = mix(coarse)[a] + (csum[b] - csum[a + 1]) * q[np.minimum(rank[a], T)]
        dsum = np.concatenate([[0], np.cumsum(digits)]).astype(np.int64)
        gsum = np.concatenate([[0], np.cumsum((digits > 0) & new)]).astype(np.int64)
        nd, ng = np.minimum(dsum[b] - dsum[a], 24), np.minimum(gsum[b] - gsum[a], 8)
        letters = np.concatenate([[0], np.cumsum((digits == 0) & (fine > 0) & may_start & may_end)]).astype(np.int64)
        has = np.minimum(letters[b] - letters[a], 3)
        size = np.minimum(b - a, 20)
        lead = np.zeros(T, np.int64)  # the next token with digits
        nxt = np.where(digits > 0, np.arange(T), T - 1)
        lead = np.minimum.accumulate(nxt[::-1])[::-1]
        lead1 = np.where(lead[a] < b, one[np.minimum(lead[a], T - 1)], 0)
        lead3 = np.where(lead[a] < b, three[np.minimum(lead[a], T - 1)], 0)
        prev_d = (shifted(digits, 1) > 0) | ((shifted(digits, 2) > 0) & np.isin(w1, [zlib.crc32(x.encode()) for x in "-./,"]))
        next_d = (shifted(digits, -1) > 0) | ((shifted(digits, -2) > 0) & np.isin(n1, [zlib.crc32(x.encode()) for x in "-./,"]))
        cut = prev_d[a] * 2 + next_d[b - 1] + gap[a] * 4 + gap_after[b - 1] * 8
        alone = (bound[a - 1] * 2 + bound[np.minimum(b, T - 1)]).astype(np.uint64)
        seen = np.zeros(len(a), np.uint64)
        marks = _pattern_spans(joined, lexicon)
        if marks:
            at = {(x, y): i for i, (x, y) in enumerate(zip(start[a].tolist(), end[b - 1].tolist()))} if len(marks) * 20 > len(a) else None
            key = start[a].astype(np.int64) * (len(joined) + 1) + end[b - 1]
            order = None if at is not None else np.argsort(key)
            for x, y, name in marks:
                if at is not None:
                    i = at.get((x, y))
                else:
                    i = int(np.searchsorted(key, x * (len(joined) + 1) + y, sorter=order))
                    i = int(order[i]) if i < len(order) and key[order[i]] == x * (len(joined) + 1) + y else None
                if i is not None:
                    seen[i] |= np.uint64(1 << _PATTERN_IDS[name])
        usual, rare = (np.concatenate([[0], np.cumsum(common == c)]) for c in (1, 3))
        sep = np.concatenate([[0], np.cumsum(mix(np.where(may_start, np.uint64(0), word)) & np.uint64(0xFFFFFFFF))]).astype(np.uint64)
        whole = np.stack([
            _h(61, exact), _h(62, rough), _h(63, nd, ng, has), _h(64, nd, lead1, has), _h(65, nd, lead3), _h(66, rough, w1[a]), _h(67, size, coarse[a]), _h(68, seen), _h(69, cut, coarse[a], coarse[b - 1]), _h(70, alone, place[a], rough),
            _h(71, f1[a], g1[b - 1], coarse[a], coarse[b - 1]), _h(72, exact, lead1), _h(73, sep[b] - sep[a], nd), _h(74, np.minimum(usual[b] - usual[a], 3), np.minimum(rare[b] - rare[a], 3), rough),
        ], 1)
    return Lattice(start, end, text, kind, left, right, inside, a, b, whole)


def _pattern_spans(joined: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
    out = [(*m.span(), name) for name, p in PATTERNS.items() for m in p.finditer(joined)]
    if lexicon.given and lexicon.surname:
        some = lambda ws: "|".join(sorted(map(re.escape, ws), key=len, reverse=True))
        g, s = some(lexicon.given), some(lexicon.surname)
        out += [(*m.span(), "lexicon") for m in re.finditer(rf"(?:{s}) ?(?:{g})|(?:{g}) (?:[A-Z]\. )?(?:{s})|(?:{s}), (?:{g})", joined, re.I)]
    return out


# -- the model


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = np.maximum(x.max(axis), np.float32(-1e30))
    return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis) + np.float32(1e-37))


@dataclass
class Model:
    """Weights of hashed features for each kind, and of what follows what: state 0 is text that is no entity, 1.. are KINDS."""

    weights: np.ndarray
    turns: np.ndarray
    lexicon: Lexicon = Lexicon()
    common: tuple[frozenset[str], frozenset[str]] = field(default=(frozenset(), frozenset()), repr=False)

    def __post_init__(self) -> None:
        self._types, self._grams = _Types(self.common), {}

    def __getstate__(self):
        return self.weights, self.turns, self.lexicon, self.common

    def __setstate__(self, s) -> None:
        self.weights, self.turns, self.lexicon, self.common = s
        self.__post_init__()

    def _gram(self, i: int) -> np.ndarray:
        g = self._grams.get(i)
        if g is None:
            rows = self._types.grams[i]
            g = self._grams[i] = GRAM_WEIGHT * self.weights[_h(47, rows)].mean(0) if len(rows) else np.zeros(len(KINDS), np.float32)
        return g

    def segment_scores(self, lat: Lattice) -> np.ndarray:
        """[segments, kinds]"""
        w = self.weights
        if not len(lat.a):
            return np.zeros((0, len(KINDS)))
        tokens = np.unique(np.concatenate([lat.a, lat.b - 1]))
        left, right = np.zeros((len(lat.start), len(KINDS)), np.float32), np.zeros((len(lat.start), len(KINDS)), np.float32)
        left[tokens] = w[lat.left[tokens]].sum(1)
        right[tokens] = w[lat.right[tokens]].sum(1)
        inner = w[lat.inside].sum(1)
        u, back = np.unique(lat.types, return_inverse=True)
        inner += np.stack([self._gram(i) for i in u.tolist()])[back]
        sums = np.concatenate([np.zeros((1, len(KINDS))), np.cumsum(inner, 0, dtype=np.float64)])
        return left[lat.a] + right[lat.b - 1] + (sums[lat.b] - sums[lat.a]) + w[lat.whole].sum(1)

    def best(self, texts: list[str], places: list[str]) -> list[list[tuple[int, int, str]]]:
        """For each folded text the segmentation with the highest score: non-overlapping (start, end, kind).

        Segments that cannot be in a best segmentation, whatever stands around them (their score is below what replacing them by plain tokens
        costs at most), are left out before the dynamic programming; that changes nothing.
        """
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if len(self._types.rows) > 200_000:
            self._types.clear()
            self._grams.clear()
        lat = lattice(texts, places, self._types, self.lexicon)
        s = self.segment_scores(lat)
        t = self.turns
        gain = np.array([max(t[x, k] - t[x, 0] for x in range(len(t))) + max(t[k, y] - t[0, y] for y in range(len(t))) for k in range(1, len(t))]) if len(t) else 0
        keep = np.argwhere(s + gain > 0)
        if not len(keep):
            return out
        seg, kind = keep[:, 0], keep[:, 1]
        a, b, owner = lat.a[seg], lat.b[seg], lat.text[lat.a[seg]]
        order = np.lexsort((b, owner))
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        at = np.flatnonzero(np.concatenate([[True], lat.text[1:] != lat.text[:-1]]))
        base = lat.start[at] + 1
        for group in np.split(order, cuts):
            i = int(owner[group[0]])
            found = _best_path([(int(a[g]), int(b[g]), int(kind[g]) + 1, float(s[seg[g], kind[g]])) for g in group], t)
            out[i] = [(int(lat.start[x] - base[i]), int(lat.end[y - 1] - base[i]), KINDS[k - 1]) for x, y, k in found]
        return out


def _best_path(segments: list[tuple[int, int, int, float]], turns: np.ndarray) -> list[tuple[int, int, int]]:
    """Highest-scoring choice of non-overlapping (from, until, state, score), sorted by until; plain tokens stand in state 0 between."""
    t = turns.tolist()
    n, low = len(t), -1e30
    points = [-1]
    tops: list[list[tuple[float, tuple | None]]] = [[(0.0, None)] + [(low, None)] * (n - 1)]  # at each point, by the state of its last token

    def plain(row: list[tuple[float, tuple | None]]) -> tuple[float, tuple | None]:
        """The best of a row after one plain token more; further ones cost nothing."""
        return max(((v + t[s][0], back) for s, (v, back) in enumerate(row)), key=lambda x: x[0])

    def at(p: int) -> list[tuple[float, tuple | None]]:
        i = bisect.bisect_right(points, p) - 1
        return tops[i] if points[i] == p else [plain(tops[i])] + [(low, None)] * (n - 1)

    i = 0
    while i < len(segments):
        p = segments[i][1]
        row = [plain(at(p - 1))] + [(low, None)] * (n - 1)
        while i < len(segments) and segments[i][1] == p:
            a, b, k, score = segments[i]
            i += 1
            for s, (v, back) in enumerate(at(a)):
                if v > low and v + t[s][k] + score > row[k][0]:
                    row[k] = (v + t[s][k] + score, (a, b, k, back))
        points.append(p)
        tops.append(row)
    back = plain(tops[-1])[1]
    out = []
    while back is not None:
        out.append(back[:3])
        back = back[3]
    return out[::-1]


# -- fitting


def forward_backward(scores: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log Z [texts], probability of each segment, expected turns) for scores [texts, end, length - 1, kind], -inf where there is none."""
    B, n1, L, K = scores.shape
    n = n1 - 1
    low = -1e30
    turns = turns.astype(scores.dtype)
    fwd, enter = np.full((B, n + 1, K + 1), low, scores.dtype), np.full((B, n + 1, K), low, scores.dtype)  # enter: all ways to begin a segment of a kind at p
    fwd[:, 0, 0] = 0
    enter[:, 0] = turns[0, 1:]
    for p in range(1, n + 1):
        fwd[:, p, 0] = _lse(fwd[:, p - 1] + turns[:, 0], 1)
        m = min(L, p)
        fwd[:, p, 1:] = _lse(enter[:, p - m : p][:, ::-1] + scores[:, p, :m], 1)
        enter[:, p] = _lse(fwd[:, p][:, :, None] + turns[None, :, 1:], 1)
    z = _lse(fwd[:, n] + turns[:, 0], 1)
    bwd, leave = np.full((B, n + 1, K + 1), low, scores.dtype), np.full((B, n + 1, K), low, scores.dtype)  # leave: all ways on from a segment of a kind that begins at p
    bwd[:, n] = turns[:, 0]
    for p in range(n - 1, -1, -1):
        m = min(L, n - p)
        ahead = scores[:, p + 1 : p + 1 + m]
        leave[:, p] = _lse(ahead[:, np.arange(m), np.arange(m)] + bwd[:, p + 1 : p + 1 + m, 1:], 1)
        bwd[:, p] = _lse(np.concatenate([bwd[:, p + 1, :1], leave[:, p]], 1)[:, None, :] + turns[None], 2)
    prob = np.zeros_like(scores)
    for m in range(1, min(L, n) + 1):
        prob[:, m:, m - 1] = np.exp(np.minimum(enter[:, : n + 1 - m] + scores[:, m:, m - 1] + bwd[:, m:, 1:] - z[:, None, None], 0))
    plain = np.exp(np.minimum(fwd[:, :n] + turns[:, 0] + bwd[:, 1:, :1] - z[:, None, None], 0)).sum((0, 1)) + np.exp(np.minimum(fwd[:, n] + turns[:, 0] - z[:, None], 0)).sum(0)
    begun = np.exp(np.minimum(fwd[:, :n, :, None] + turns[None, None, :, 1:] + leave[:, :n, None, :] - z[:, None, None, None], 0)).sum((0, 1))
    return z, prob, np.concatenate([plain[:, None], begun], 1)


def fit(sentences: list[Sentence], epochs: int = 5, rate: float = 0.08, decay: float = 2e-6, batch: int = 160, seed: int = 3, lexicon: Lexicon = Lexicon(), vocabulary: str | None = VOCABULARY) -> Model:
    """Maximise the log-likelihood of (text, place, entities) by Adam, batches of texts of like length; entities that are no segments are an error."""
    K = len(KINDS)
    model = Model(np.zeros((ROWS, K), np.float32), np.zeros((K + 1, K + 1)), lexicon, common_words(vocabulary))
    rng = np.random.default_rng(seed)
    folded = []
    for text, place, gold in sentences:
        f, at = fold(text)
        back = {x: i for i, x in reversed(list(enumerate(at)))}
        folded.append((f, place, [(back[a], max(i for i, x in enumerate(at) if x < b) + 1, k) for a, b, k in gold] if not isinstance(at, range) else gold))
    folded.sort(key=lambda x: len(x[0]))  # stable: the same batches each time
    data = []
    for i in range(0, len(folded), batch):
        part = folded[i : i + batch]
        lat = lattice([x[0] for x in part], [x[1] for x in part], model._types, lexicon)
        first = np.flatnonzero(np.concatenate([[True], lat.text[1:] != lat.text[:-1]]))[: len(part)]
        short = lat.b - lat.a <= FITTED_TOKENS
        lat.a, lat.b, lat.whole = lat.a[short], lat.b[short], lat.whole[short]
        known = {(int(lat.start[a]), int(lat.end[b - 1])): j for j, (a, b) in enumerate(zip(lat.a.tolist(), lat.b.tolist()))}
        gold_kind = np.full(len(lat.a), -1)
        for j, (_, _, gold) in enumerate(part):
            base = int(lat.start[first[j]]) + 1
            for a, b, k in gold:
                at = known.get((base + a, base + b))
                if at is not None:
                    gold_kind[at] = KINDS.index(k)
        grams = [model._types.grams[t] for t in lat.types.tolist()]
        counts = np.array([len(g) for g in grams])
        rows = _h(47, np.concatenate(grams)) if counts.sum() else np.zeros(0, np.int64)
        data.append((lat, first, gold_kind, rows, np.repeat(np.arange(len(counts)), counts), counts))
    w, t = model.weights, model.turns
    first_w, second_w, first_t, second_t = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    step, mean_w, mean_t, kept = 0, np.zeros_like(w), np.zeros_like(t), 0
    for epoch in range(epochs):
        slow = rate * (1 - epoch / epochs * 0.7)
        for at in rng.permutation(len(data)).tolist():
            lat, first, gold_kind, rows, owner, counts = data[at]
            step += 1
            grad_w, grad_t = _gradient(model, lat, first, gold_kind, rows, owner, counts)
            grad_w += decay * w
            for p, g, m, v in ((w, grad_w, first_w, second_w), (t, grad_t, first_t, second_t)):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(p.dtype)
            t[0, 0] = 0.0
            if epoch >= epochs // 2:  # the mean over the later epochs is what stays
                mean_w += w
                mean_t += t
                kept += 1
    model.weights, model.turns = mean_w / np.float32(kept), mean_t / kept
    model.__post_init__()
    return model


def _gradient(model: Model, lat: Lattice, first: np.ndarray, gold_kind: np.ndarray, rows: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean negative log-likelihood of a batch."""
    w, K, T = model.weights, len(KINDS), len(lat.start)
    left, right, inner = w[lat.left].sum(1), w[lat.right].sum(1), w[lat.inside].sum(1)
    if len(rows):
        mean = np.zeros((T, K), np.float32)
        some = np.flatnonzero(counts)
        mean[some] = np.add.reduceat(w[rows], np.concatenate([[0], np.cumsum(counts[some])[:-1]]), axis=0) * (GRAM_WEIGHT / counts[some][:, None])
        inner += mean
    sums = np.concatenate([np.zeros((1, K)), np.cumsum(inner, 0, dtype=np.float64)])
    s = left[lat.a] + right[lat.b - 1] + sums[lat.b] - sums[lat.a] + w[lat.whole].sum(1)
    B = len(first)
    length = np.diff(np.append(first, len(lat.text) - 1))  # tokens of each text with its separator before
    n = int(length.max()) - 1
    L = int((lat.b - lat.a).max()) if len(lat.a) else 1
    text = lat.text[lat.a]
    # texts are aligned at their ends: padding before the first token is plain
    shift = n - (length[text] - 1)
    end = lat.b - (first[text] + 1) + shift
    dense = np.full((B, n + 1, L, K), -1e30, np.float32)
    dense[text, end, lat.b - lat.a - 1] = s
    _, prob, turned = forward_backward(dense, model.turns)
    d = prob[text, end, lat.b - lat.a - 1]
    is_gold = np.flatnonzero(gold_kind >= 0)
    d[is_gold, gold_kind[is_gold]] -= 1.0
    seen = np.zeros_like(turned)
    for j in range(B):
        mine = is_gold[text[is_gold] == j]
        mine = mine[np.argsort(lat.a[mine])]
        at, last = 0, 0
        for g in mine.tolist():
            a, b, k = int(end[g] - (lat.b[g] - lat.a[g])), int(end[g]), int(gold_kind[g]) + 1
            if a > at:
                seen[last, 0] += 1
                seen[0, 0] += a - at - 1
                last = 0
            seen[last, k] += 1
            last, at = k, b
        seen[last, 0] += 1
        seen[0, 0] += n - at
    use = np.flatnonzero(np.abs(d).max(1) > 1e-5)
    d, a, b, whole = d[use] / B, lat.a[use], lat.b[use], lat.whole[use]
    by_start, by_end, cover = np.zeros((T, K)), np.zeros((T, K)), np.zeros((T + 1, K))
    np.add.at(by_start, a, d)
    np.add.at(by_end, b - 1, d)
    np.add.at(cover, a, d)
    np.add.at(cover, b, -d)
    cover = np.cumsum(cover, 0)[:T]
    grad = np.zeros_like(w)
    tokens = np.flatnonzero(np.abs(by_start).max(1) > 0), np.flatnonzero(np.abs(by_end).max(1) > 0), np.flatnonzero(np.abs(cover).max(1) > 1e-9)
    parts = [(lat.left[tokens[0]], by_start[tokens[0]]), (lat.right[tokens[1]], by_end[tokens[1]]), (lat.inside[tokens[2]], cover[tokens[2]]), (whole, d)]
    if len(rows):
        parts.append((rows[:, None], cover[owner] * (GRAM_WEIGHT / counts[owner][:, None])))
    for k in range(K):
        for index, value in parts:
            grad[:, k] += np.bincount(index.ravel(), np.repeat(value[:, k], index.shape[1]), minlength=ROWS).astype(np.float32)
    return grad, (turned - seen) / B


_model: list[Model] = []


def default_model() -> Model:
    """The model fitted on the invented sentences; the same weights in every process."""
    if not _model:
        _model.append(fit(invented_sentences()))
    return _model[0]


# -- use


def find_all(model: Model, texts: list[str], places: list[str]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) in the texts themselves, in order, for each text; texts are taken in chunks of about CHUNK_TOKENS characters."""
    out: list[list[tuple[int, int, str]]] = []
    part: list[tuple[str, list[int] | range]] = []
    size, done = 0, 0

    def flush() -> None:
        nonlocal size, done
        found = model.best([f for f, _ in part], places[done : done + len(part)])
        out.extend([(at[a], at[b - 1] + 1, k) for a, b, k in one] for (_, at), one in zip(part, found))
        done += len(part)
        part.clear()
        size = 0

    for t in texts:
        part.append(fold(t))
        size += len(t) + 1
        if size >= CHUNK_TOKENS:
            flush()
    if part:
        flush()
    return out


def entities(model: Model, text: str | None, place: str = "content") -> list[tuple[int, int, str]]:
    """(start, end, kind) in the text itself, in order."""
    return find_all(model, [text], [place])[0] if text else []


def redact(model: Model, text: str, place: str = "content") -> str:
    """The text with [EMAIL], [PHONE] and so on in place of what was found; everything else unchanged."""
    return _replaced(text, entities(model, text, place))


def _replaced(text: str, found: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for a, b, k in found:
        out += [text[last:a], f"[{k.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def find_personal(df: DataFrame, row_id: str, columns: list[str], model: Model | None = None, redacted: bool = False) -> DataFrame:
    """One row per row of df and column with something found: (row_id, field, kinds ARRAY, starts ARRAY, ends ARRAY[, redacted]).

    starts and ends are code points of the text, end exclusive. A map over Arrow batches, texts that come again in a batch
    or shortly after are done once; the model (a table of fixed size) is broadcast. With `redacted`, every non-null text gives a row.

    Defined results: null texts give no rows, empty texts nothing found; repeated rows give repeated rows; a text of any length is done
    whole. An entity has at most MOST_TOKENS tokens and goes across no line end and no sentence mark.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model or default_model())
    kind = df.schema[row_id].dataType.simpleString()
    schema = f"`{row_id}` {kind}, field string, kinds array<string>, starts array<int>, ends array<int>" + (", redacted string" if redacted else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        memo: dict[tuple[str, str], list] = {}
        for batch in batches:
            for c, name in enumerate(columns, 1):
                d = pc.dictionary_encode(batch.column(c).cast(pa.string()))
                texts = d.dictionary.to_pylist()
                new = [t for t in texts if (name, t) not in memo]
                got = dict(zip(new, find_all(m, new, ["name" if name == "name" else "content"] * len(new))))
                found = [got[t] if t in got else memo[name, t] for t in texts]
                if len(memo) + len(got) > 100_000:
                    memo.clear()
                memo.update({(name, t): f for t, f in got.items() if len(t) < 256})
                keep = pa.array([bool(f) or redacted for f in found], pa.bool_()).take(d.indices)
                rows = pc.filter(pa.RecordBatch.from_arrays([batch.column(0), d.indices], names=["i", "x"]), pc.fill_null(keep, False))
                x = rows.column(1)
                part = lambda j, kind: pa.array([[e[j] for e in f] for f in found], pa.list_(kind)).take(x)
                cols = [rows.column(0), pa.array([name] * rows.num_rows, pa.string()), part(2, pa.string()), part(0, pa.int32()), part(1, pa.int32())]
                names = [row_id, "field", "kinds", "starts", "ends"]
                if redacted:
                    cols.append(pa.array([_replaced(t, f) for t, f in zip(texts, found)], pa.string()).take(x))
                    names.append("redacted")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.select(F.col(f"`{row_id}`"), *[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
