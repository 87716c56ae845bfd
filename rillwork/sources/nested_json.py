"""Nested JSON bodies to linked flat rows by vectorised structural indexing.

A batch of bodies is one byte array. Bitmaps mark escaped bytes, quotes, string contents and the structural characters outside
strings; a prefix sum over brackets gives the nesting depth; one sort by depth gives every token its container. From
there each level is a vector operation: which container, which key, which place in a list.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN_OBJ, CLOSE_OBJ, OPEN_LIST, CLOSE_LIST, COLON, COMMA, STRING, PLAIN = range(8)
_KIND = np.full(256, -1, np.int8)
for _c, _k in zip(b"{}[]:,", range(6)):
    _KIND[_c] = _k
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPES = np.zeros(256, bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True
_PLAIN = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null").fullmatch

#: Bytes indexed at once: bounds the memory of the bitmaps, about 60 bytes each, whatever the size of a batch of rows.
CHUNK_BYTES = 2 << 20


class StructuralIndex:
    """Tokens of a batch of bodies, without those of bodies that are not one complete JSON document.

    Token arrays: doc, kind, at (byte of its first character), end, parent (token of the container, -1 at the top), key (code of
    its normalised key, -1 in lists), place (in its container). A repeated key of an object keeps its last value.
    """

    def __init__(self, bodies: list[bytes]):
        self.bodies = bodies
        size = np.fromiter((len(b) for b in bodies), np.int64, len(bodies))
        base = np.concatenate([[0], np.cumsum(size + 1)])
        self.data = b"\n".join([*bodies, b""])
        a = np.frombuffer(self.data, np.uint8)
        n, n_docs = len(a), len(bodies)
        doc_of = np.repeat(np.arange(n_docs), size + 1)
        bad = np.zeros(n_docs, bool)

        # escaped bytes: those after a run of backslashes of odd length
        back = a == 92
        at = np.arange(n)
        last_other = np.maximum.accumulate(np.where(back, -1, at))
        run = at - last_other
        escaped = np.zeros(n, bool)
        escaped[1:] = (run[:-1] & 1).astype(bool)
        quote = (a == 34) & ~escaped
        count = np.cumsum(quote)
        inside = count - np.concatenate([[0], count])[base[:-1]][doc_of]
        string = (inside & 1).astype(bool)  # from an opening quote up to the byte before the closing one
        ends = base[1:] - 1
        bad |= string[ends]

        # contents of strings: no control bytes, known escapes only
        wrong = string & (a < 32)
        lead = back & ~escaped & string
        nxt = np.zeros(n, np.uint8)
        nxt[:-1] = a[1:]
        wrong |= lead & ~_ESCAPES[nxt]
        u = np.flatnonzero(lead & (nxt == 117))
        if len(u):
            hexed = np.ones(len(u), bool)
            for k in range(2, 6):
                hexed &= _HEX[a[np.minimum(u + k, n - 1)]]
            wrong[u[~hexed]] = True
        bad[doc_of[wrong]] = True

        kind = _KIND[a]
        kind[string | quote] = -1
        mark = kind >= 0
        step = ((kind == OPEN_OBJ) | (kind == OPEN_LIST)).astype(np.int64) - ((kind == CLOSE_OBJ) | (kind == CLOSE_LIST))
        depth = np.cumsum(step)
        depth -= np.concatenate([[0], depth])[base[:-1]][doc_of]
        bad[doc_of[depth < 0]] = True
        bad |= depth[ends] != 0

        opening = quote & string
        outside = ~(string | quote | mark | _SPACE[a])
        before = np.ones(n, bool)
        before[1:] = ~outside[:-1]
        plain = outside & before
        token = np.flatnonzero((mark | opening | plain) & ~bad[doc_of])
        self.doc, self.at = doc_of[token], token
        k = kind[token].copy()
        k[opening[token]] = STRING
        k[plain[token]] = PLAIN
        self.kind = k
        level = depth[token] - ((k == OPEN_OBJ) | (k == OPEN_LIST))
        self._contain(level)
        self._grammar(bad)
        # ends of strings and plain values
        closing = np.flatnonzero(quote & ~string)
        self.end = np.zeros(len(token), np.int64)
        s = np.flatnonzero(self.kind == STRING)
        if len(closing):
            self.end[s] = closing[np.searchsorted(closing, self.at[s])] + 1
        stop = np.flatnonzero(~outside)
        p = np.flatnonzero(self.kind == PLAIN)
        self.end[p] = stop[np.searchsorted(stop, self.at[p])]
        data = self.data
        for t in p[[not _PLAIN(data[i:j]) for i, j in zip(self.at[p].tolist(), self.end[p].tolist())]] if len(p) else []:
            bad[self.doc[t]] = True
        for d in range(n_docs):
            bad[d] |= size[d] == 0
        self.bad = bad
        self._label()

    def _contain(self, level: np.ndarray) -> None:
        """parent of each token: the last bracket opened one level up; of a closing bracket, its opening one."""
        n = len(level)
        opens = (self.kind == OPEN_OBJ) | (self.kind == OPEN_LIST)
        closes = (self.kind == CLOSE_OBJ) | (self.kind == CLOSE_LIST)
        member = level + closes
        o = np.flatnonzero(opens)
        which = np.concatenate([o, np.arange(n)])
        height = np.concatenate([level[o] + 1, member])
        opener = np.concatenate([np.ones(len(o), bool), np.zeros(n, bool)])
        order = np.lexsort((~opener, which, height))
        # a bracket opens its own level after it was a member of the one above, so position decides within a level
        seen = np.maximum.accumulate(np.where(opener[order], np.arange(n + len(o)), -1))
        found = np.where(seen >= 0, which[order][np.maximum(seen, 0)], -1)
        self.parent = np.full(n, -1, np.int64)
        members = ~opener[order]
        self.parent[which[order][members]] = np.where(height[order][members] > 0, found[members], -1)

    def _grammar(self, bad: np.ndarray) -> None:
        """Each token must be allowed after the one before it, in its container."""
        k, n = self.kind, len(self.kind)
        first = np.ones(n, bool)
        first[1:] = self.doc[1:] != self.doc[:-1]
        prev = np.full(n, -1, np.int8)
        prev[1:] = k[:-1]
        prev[first] = -1
        holder = np.where(self.parent >= 0, k[np.maximum(self.parent, 0)], -1)
        in_obj, in_list, top = holder == OPEN_OBJ, holder == OPEN_LIST, holder == -1
        role_key = in_obj & (k == STRING) & ((prev == OPEN_OBJ) | (prev == COMMA))
        prev_key = np.zeros(n, bool)
        prev_key[1:] = role_key[:-1]
        value = np.isin(k, (OPEN_OBJ, OPEN_LIST, STRING, PLAIN)) & ~role_key
        prev_ends = np.isin(prev, (CLOSE_OBJ, CLOSE_LIST, STRING, PLAIN)) & ~prev_key
        ok = np.select(
            [role_key, k == COLON, k == COMMA, k == CLOSE_OBJ, k == CLOSE_LIST, value & in_obj, value & in_list, value & top],
            [
                np.ones(n, bool),
                in_obj & prev_key,
                ~top & prev_ends,
                in_obj & ((prev == OPEN_OBJ) | prev_ends),
                in_list & ((prev == OPEN_LIST) | prev_ends),
                prev == COLON,
                (prev == OPEN_LIST) | (prev == COMMA),
                first,
            ],
            False,
        )
        bad[self.doc[~ok]] = True
        bad[np.setdiff1d(np.arange(len(bad)), self.doc)] = True
        self.role_key, self.value = role_key, value

    def _label(self) -> None:
        """Keys and places; bad bodies lose their tokens."""
        n, data = len(self.kind), self.data
        self.key = np.full(n, -1, np.int64)
        self.codes: dict[str, int] = {}
        seen: dict[bytes, int] = {}
        keys = np.flatnonzero(self.role_key)
        code = []
        for i, j in zip(self.at[keys].tolist(), self.end[keys].tolist()):
            raw = data[i:j]
            c = seen.get(raw)
            if c is None:
                if self._spoilt(i):  # its text need not be a valid string, and it has no tokens to name
                    code.append(-1)
                    continue
                c = seen[raw] = self.codes.setdefault(normal_key(json.loads(raw)), len(self.codes))
            code.append(c)
        named = keys + 2  # key, colon, value
        good = named < n
        self.key[named[good]] = np.array(code, np.int64)[good]
        live = self.value & ~self.bad[self.doc]
        v = np.flatnonzero(live)
        order = v[np.argsort(self.parent[v], kind="stable")]
        new = np.ones(len(order), bool)
        new[1:] = self.parent[order][1:] != self.parent[order][:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        self.place = np.full(n, -1, np.int64)
        self.place[order] = np.arange(len(order)) - start
        self.live = live
        self.null = live & (self.kind == PLAIN) & (np.frombuffer(data, np.uint8)[self.at] == 110)

    def _spoilt(self, at: int) -> bool:
        return bool(self.bad[np.searchsorted(self._bases(), at, "right") - 1])

    def _bases(self) -> np.ndarray:
        if not hasattr(self, "_base"):
            self._base = np.concatenate([[0], np.cumsum([len(b) + 1 for b in self.bodies])])[:-1]
        return self._base

    # -- steps down the tree: arrays of tokens, -1 where there is none

    def roots(self) -> np.ndarray:
        return np.flatnonzero(self.live & (self.parent < 0))

    def child(self, of: np.ndarray, key: str, kind: int | None = None) -> np.ndarray:
        """For each token of `of`, its value under key (normalised), not null, of the kind."""
        out = np.full(len(self.kind) + 1, -1, np.int64)
        c = self.codes.get(key)
        if c is not None:
            sel = np.flatnonzero(self.live & (self.key == c) & (self.parent >= 0))
            out[self.parent[sel]] = sel
        got = out[of]
        ok = (got >= 0) & ~self.null[np.maximum(got, 0)]
        if kind is not None:
            ok &= self.kind[np.maximum(got, 0)] == kind
        return np.where(ok, got, -1)

    def elements(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `of`, token) of the elements of the lists in `of`."""
        back = np.full(len(self.kind) + 1, -1, np.int64)
        has = np.flatnonzero(of >= 0)
        back[of[has]] = has
        e = np.flatnonzero(self.live & (self.parent >= 0))
        src = back[self.parent[e]]
        return src[src >= 0], e[src >= 0]

    def members(self, tokens: np.ndarray) -> list[dict[str, str]]:
        """The scalar members of the objects `tokens` (text of each, nulls left out); of other values, {"value": text}."""
        back = np.full(len(self.kind) + 1, -1, np.int64)
        back[tokens] = np.arange(len(tokens))
        out: list[dict[str, str]] = [{} for _ in tokens]
        names = {c: n for n, c in self.codes.items()}
        scalar = np.flatnonzero(self.live & (self.parent >= 0) & (self.key >= 0) & ((self.kind == STRING) | (self.kind == PLAIN)))
        src = back[self.parent[scalar]]
        for t, s in zip(scalar[src >= 0].tolist(), src[src >= 0].tolist()):
            name = names[int(self.key[t])]
            if self.null[t]:
                out[s].pop(name, None)
            else:
                out[s][name] = self.text(t)
        for s, t in enumerate(tokens.tolist()):
            if self.kind[t] in (STRING, PLAIN) and not self.null[t]:
                out[s]["value"] = self.text(t)
        return out

    def text(self, t: int) -> str:
        raw = self.data[self.at[t] : self.end[t]]
        if self.kind[t] != STRING:
            return raw.decode()
        return json.loads(raw).encode("utf-8", "replace").decode() if b"\\" in raw else raw[1:-1].decode("utf-8", "replace")


def normal_key(name: str) -> str:
    """Encoders write camelCase, snake_case or PascalCase: one spelling for all."""
    return name.replace("_", "").lower()


#: entity -> parent entity of the flat tables
PARENTS = {
    "message": None, "chat": "message", "overflowed_chat": "message", "gift": "message", "modifier": "chat, overflowed_chat or operator_comment",
    "operator_comment": "message", "moderator": "message", "ranking": "message", "tag": "message", "choice": "message", "guideline_item": "message",
}


def walk_bodies(ix: StructuralIndex) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(entity, token, body, place of its message, place in its list) for every row of the flat tables."""
    either = lambda a, b: np.where(a >= 0, a, b)
    body = ix.child(ix.roots(), "messages", OPEN_LIST)
    _, msg = ix.elements(body)
    doc, pos = ix.doc[msg], ix.place[msg]
    zero = np.zeros(len(msg), np.int64)
    yield "message", msg, doc, pos, zero

    def member(of: np.ndarray, wrapper: str, name: str) -> np.ndarray:
        """A member of a oneof, under the name of the oneof or straight in the message."""
        return either(ix.child(ix.child(of, wrapper), name), ix.child(of, name))

    message, state = member(msg, "payload", "message"), member(msg, "payload", "state")

    def single(entity: str, t: np.ndarray):
        t = np.where((t >= 0) & (ix.kind[np.maximum(t, 0)] == OPEN_OBJ), t, -1)
        has = t >= 0
        return t, (entity, t[has], doc[has], pos[has], zero[has])

    def listed(entity: str, t: np.ndarray):
        t = np.where((t >= 0) & (ix.kind[np.maximum(t, 0)] == OPEN_LIST), t, -1)
        src, e = ix.elements(t)
        return entity, e, doc[src], pos[src], ix.place[e]

    in_data = lambda name: member(message, "data", name)
    modified = []
    for entity in ("chat", "overflowed_chat"):
        t, rows = single(entity, in_data(normal_key(entity)))
        modified.append(t)
        yield rows
    yield single("gift", in_data("gift"))[1]
    t, rows = single("operator_comment", ix.child(ix.child(ix.child(state, "marquee"), "display"), "operatorcomment"))
    modified.append(t)
    yield rows
    for t in modified:
        yield single("modifier", ix.child(t, "modifier"))[1]
    yield single("moderator", ix.child(in_data("moderatorupdated"), "operator"))[1]
    ad = in_data("nicoad")
    yield listed("ranking", ix.child(either(ix.child(ix.child(ad, "versions"), "v0"), ix.child(ad, "v0")), "ranking"))
    yield listed("tag", ix.child(in_data("tagupdated"), "tags"))
    yield listed("choice", ix.child(ix.child(state, "enquete"), "choices"))
    yield listed("guideline_item", ix.child(ix.child(state, "moderationannouncement"), "guidelineitems"))


_LINKS = "msg_pos bigint, entity string, item_pos bigint, parent_entity string, parent_pos bigint"


def flatten_bodies(df: DataFrame, key: str, body: str, fields: bool = True) -> DataFrame:
    """One row per element of the flat tables in df.body: (key, msg_pos, entity, item_pos, parent_entity, parent_pos[, fields]).

    (key, msg_pos) links each row to its message; parent_entity names the table of the parent, parent_pos the place of the parent's
    message. `fields` maps the normalised names of an object's scalar members to their texts (a list element that is no
    object has it under `value`). The work is a map over batches: no shuffle, memory bounded by CHUNK_BYTES and the largest body.

    Defined results: null, empty and broken bodies give no rows, nor do bodies with anything after the document; bodies of
    other shapes (a list, a number, no `messages`, `messages` not a list) give none either. Members of a wrong kind count as absent.
    Of a key repeated in one object, in whatever spelling, the last value counts. Repeated rows of df give repeated rows.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {_LINKS}" + (", fields map<string,string>" if fields else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            lens = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.diff(np.cumsum(lens) // CHUNK_BYTES)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(texts)]):
                if hi <= lo:
                    continue
                bodies = [x.encode() if x is not None else b"" for x in texts.slice(lo, hi - lo).to_pylist()]
                yield _rows(ids.slice(lo, hi - lo), bodies)

    def _rows(ids: pa.Array, bodies: list[bytes]) -> pa.RecordBatch:
        ix = StructuralIndex(bodies)
        parts = list(walk_bodies(ix))
        cat = lambda i: np.concatenate([p[i] for p in parts])
        entity = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
        names = np.array([p[0] for p in parts], object)
        # the three modifier parts come in the order chat, overflowed_chat, operator_comment
        above, m = [], iter(("chat", "overflowed_chat", "operator_comment"))
        for p in parts:
            above.append(next(m) if p[0] == "modifier" else PARENTS[p[0]])
        cols = [ids.take(pa.array(cat(2))), pa.array(cat(3)), pa.array(names[entity], pa.string()), pa.array(cat(4)), pa.array(np.array(above, object)[entity], pa.string()), pa.array(cat(3))]
        if fields:
            cols.append(pa.array([list(x.items()) for x in ix.members(cat(1))], pa.map_(pa.string(), pa.string())))
        return pa.RecordBatch.from_arrays(cols, names=[key, "msg_pos", "entity", "item_pos", "parent_entity", "parent_pos", *(["fields"] if fields else [])])

    return df.select(F.col(f"`{key}`"), F.col(f"`{body}`")).mapInArrow(run, schema)


# -- typed flat tables over the linked rows

#: The enum numbers of the wire format, in order.
POSITIONS = ["naka", "shita", "ue"]
SIZES = ["medium", "small", "big"]
FONTS = ["defont", "mincho", "gothic"]
COLORS = [
    "white", "red", "pink", "orange", "yellow", "green", "cyan", "blue", "purple", "black",
    "white2", "red2", "pink2", "orange2", "yellow2", "green2", "cyan2", "blue2", "purple2", "black2",
]
ACCOUNTS = ["Standard", "Premium"]
GUIDELINES = ["UNKNOWN", "SEXUAL", "SPAM", "SLANDER", "PERSONAL_INFORMATION"]


def _enum(name: str, values: list[str]):
    """An enum written by name or by number; absent means the first value, as the wire format has it."""
    raw = F.coalesce(F.col("fields")[name], F.lit("0"))
    by_number = F.get(F.array(*map(F.lit, values)), F.expr(f"try_cast(coalesce(fields['{name}'], '0') as int)"))
    return F.coalesce(by_number, raw)


def _text(name: str):
    return F.col("fields")[name]


def _long(name: str):
    return F.expr(f"try_cast(fields['{name}'] as bigint)")


TYPED = {
    "chat": lambda: {"content": _text("content"), "vpos": _long("vpos"), "no": _long("no"), "name": _text("name"), "raw_user_id": _long("rawuserid"), "hashed_user_id": _text("hasheduserid"), "account_status": _enum("accountstatus", ACCOUNTS)},
    "modifier": lambda: {"position": _enum("position", POSITIONS), "size": _enum("size", SIZES), "named_color": _enum("namedcolor", COLORS), "font": _enum("font", FONTS)},
    "gift": lambda: {"item_id": _text("itemid"), "advertiser_name": _text("advertisername"), "point": _long("point"), "item_name": _text("itemname"), "contribution_rank": _long("contributionrank")},
    "operator_comment": lambda: {"content": _text("content"), "name": _text("name"), "link": _text("link")},
    "moderator": lambda: {"user_id": _long("userid"), "nickname": _text("nickname"), "icon_url": _text("iconurl")},
    "ranking": lambda: {"advertiser": _text("advertiser"), "rank": _long("rank"), "message": _text("message")},
    "tag": lambda: {"text": _text("text"), "locked": _text("locked"), "uri": _text("nicopediauri")},
    "choice": lambda: {"description": _text("description"), "per_mille": _long("permille")},
    "guideline_item": lambda: {"item": _enum("value", GUIDELINES)},
}
TYPED["overflowed_chat"] = TYPED["chat"]


def flat_table(rows: DataFrame, key: str, entity: str) -> DataFrame:
    """The typed table of one entity out of flatten_bodies(..., fields=True)."""
    link = [key, "msg_pos", "item_pos", "parent_entity"]
    return rows.where(F.col("entity") == entity).select(*link, *[c.alias(n) for n, c in TYPED[entity]().items()])
