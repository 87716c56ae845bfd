"""Sample-encrypted transport streams and elementary audio in the clear.

Two passes of Python around one of the JVM: the first finds the encrypted bytes of every unit of a segment (video units, audio frames), the
JVM deciphers them, the second puts them back and packs the stream again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from ..functions.ciphers import _kinded, audio_spans, decrypt_cbc_bare, escape, gather, scatter
from ..functions.columns import AC3_KBPS

PACKET = 188
#: Stream types, the codec of each and its type in the clear.
CODECS = {0x1B: ("video", 0x1B), 0xDB: ("video", 0x1B), 0x0F: ("aac", 0x0F), 0xCF: ("aac", 0x0F), 0x81: ("ac3", 0x81), 0xC1: ("ac3", 0x81), 0x87: ("eac3", 0x87), 0xC2: ("eac3", 0x87)}
#: Audio kinds named by the description frame of elementary streams.
AUDIO_TYPES = {b"zaac": "aac", b"zach": "aac", b"zacp": "aac", b"zac3": "ac3", b"zec3": "eac3"}


def frame_length(codec: str, data: bytes) -> tuple[int, int]:
    """(bytes of the frame at the start of data, bytes of a header that is never encrypted)."""
    if codec == "aac":
        if len(data) < 7:
            return len(data), 0
        return (data[3] & 3) << 11 | data[4] << 3 | data[5] >> 5, 7 if data[1] & 1 else 9
    if codec == "ac3":
        if len(data) < 5:
            return len(data), 0
        rate, code = data[4] >> 6, data[4] & 63
        kbps = AC3_KBPS[code >> 1] if code >> 1 < len(AC3_KBPS) else 0
        words = {0: kbps * 2, 1: kbps * 96000 // 44100 + (code & 1), 2: kbps * 3}.get(rate, 0)
        return words * 2, 0
    if len(data) < 4:
        return len(data), 0
    return (((data[2] & 7) << 8 | data[3]) + 1) * 2, 0


@dataclass
class Unit:
    """A piece of an elementary stream: what stands before it, its body and the encrypted spans of the body."""

    before: bytes
    body: bytes
    spans: list[tuple[int, int]]
    escaped: bool = False

    def clear(self, plain: bytes) -> bytes:
        done = scatter(self.body, self.spans, plain) if self.spans else self.body
        return self.before + (escape(done) if self.escaped else done)


def units_of(codec: str, data: bytes) -> list[Unit]:
    """An elementary stream as units whose bytes, put together, are the stream."""
    out = []
    if codec == "video":
        at, done = data.find(b"\0\0\1"), 0
        if at < 0:
            return [Unit(data, b"", [])]
        while at >= 0:
            nxt = data.find(b"\0\0\1", at + 3)
            end = nxt if nxt >= 0 else len(data)
            while nxt >= 0 and end > at + 3 and data[end - 1] == 0:
                end -= 1
            raw = data[at + 3 : end]
            body, spans = _kinded("video", raw)
            out.append(Unit(data[done : at + 3], body if spans else raw, spans, bool(spans)))
            done, at = end, nxt
        if done < len(data):
            out.append(Unit(data[done:], b"", []))
        return out
    at = 0
    while at < len(data):
        size, head = frame_length(codec, data[at:])
        end = min(len(data), at + size) if size > head else len(data)
        body = data[at + head : end]
        out.append(Unit(data[at : at + head], body, audio_spans(len(body)) if size > head else []))
        at = end
    return out


@dataclass
class _Stream:
    packets: list[list] = field(default_factory=list)  # [header 4 bytes, adaptation bytes, payload bytes]
    groups: list[tuple[int, list[int], bytes, bytes]] = field(default_factory=list)  # pid, packets, head of the PES, elementary bytes
    codec: dict[int, str] = field(default_factory=dict)
    tables: set[int] = field(default_factory=set)


def _crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def _pid(header: bytes) -> int:
    return (header[1] & 31) << 8 | header[2]


def demux(data: bytes) -> _Stream:
    """Packets, programme tables and the elementary bytes of every encrypted stream."""
    s = _Stream()
    for i in range(0, len(data) - PACKET + 1, PACKET):
        p = data[i : i + PACKET]
        control = p[3] >> 4 & 3
        adaptation = p[4 : 5 + p[4]] if control & 2 else b""
        s.packets.append([p[:4], adaptation, p[4 + len(adaptation) :] if control & 1 else b""])
    tables: set[int] = set()
    for header, _, payload in s.packets:
        pid = _pid(header)
        if not header[1] & 0x40 or not payload:
            continue
        t = payload[1 + payload[0] :]
        if pid == 0 and t[:1] == b"\0":
            end = 3 + ((t[1] & 15) << 8 | t[2]) - 4
            tables |= {(t[j + 2] & 31) << 8 | t[j + 3] for j in range(8, end, 4) if t[j] << 8 | t[j + 1]}
        elif pid in tables and t[:1] == b"\2":
            end, j = 3 + ((t[1] & 15) << 8 | t[2]) - 4, 12 + ((t[10] & 15) << 8 | t[11])
            while j < end:
                if t[j] in CODECS:
                    s.codec[(t[j + 1] & 31) << 8 | t[j + 2]] = CODECS[t[j]][0]
                j += 5 + ((t[j + 3] & 15) << 8 | t[j + 4])
    s.tables = tables
    running: dict[int, list[int]] = {}
    order = []
    for i, (header, _, payload) in enumerate(s.packets):
        pid = _pid(header)
        if pid in s.codec and payload:
            if header[1] & 0x40 or pid not in running:
                running[pid] = []
                order.append((pid, running[pid]))
            running[pid].append(i)
    for pid, members in order:
        pes = b"".join(s.packets[i][2] for i in members)
        head = 9 + pes[8] if pes[:3] == b"\0\0\1" and len(pes) > 8 else len(pes)
        s.groups.append((pid, members, pes[:head], pes[head:]))
    return s


def remux(s: _Stream, clear: list[bytes]) -> bytes:
    """The packets with the clear elementary bytes in them.

    Every packet stays; what is shorter is stuffed, what does not fit goes on in packets put behind. Tables name the clear stream types.
    """
    extra: dict[int, list[list]] = {}
    for (_, members, head, _), body in zip(s.groups, clear):
        pes = bytearray(head + body)
        if len(head) >= 6 and pes[4:6] != b"\0\0":
            size = len(pes) - 6
            pes[4:6] = size.to_bytes(2, "big") if size < 65536 else b"\0\0"
        at = 0
        for i in members:
            room = len(s.packets[i][2])
            s.packets[i][2] = bytes(pes[at : at + room])
            at += room
        while at < len(pes):
            header = s.packets[members[-1]][0]
            extra.setdefault(members[-1], []).append([bytes([header[0], header[1] & 0xBF]) + header[2:], b"", bytes(pes[at : at + PACKET - 4])])
            at += PACKET - 4
    out, counter = [], {}
    for i, packet in enumerate(s.packets):
        for header, adaptation, payload in (packet, *extra.get(i, ())):
            pid = _pid(header)
            if pid in s.tables and header[1] & 0x40 and payload:
                payload = _clear_table(payload)
            if pid in s.codec:
                if pid not in counter:
                    counter[pid] = header[3] & 15
                elif payload:
                    counter[pid] = (counter[pid] + 1) % 16
                short = PACKET - 4 - len(adaptation) - len(payload)
                if short == 1 and not adaptation:
                    adaptation = b"\0"
                elif short:
                    adaptation = adaptation or b"\0\0"
                    adaptation += b"\xff" * (PACKET - 4 - len(payload) - len(adaptation))
                    adaptation = bytes([len(adaptation) - 1]) + adaptation[1:]
                control = (2 if adaptation else 0) | (1 if payload else 0)
                header = header[:3] + bytes([header[3] & 0xC0 | control << 4 | counter[pid]])
            out.append(header + adaptation + payload)
    return b"".join(out)


def _clear_table(payload: bytes) -> bytes:
    t = bytearray(payload)
    base = 1 + t[0]
    if t[base] != 2:
        return payload
    end = base + 3 + ((t[base + 1] & 15) << 8 | t[base + 2]) - 4
    j = base + 12 + ((t[base + 10] & 15) << 8 | t[base + 11])
    while j < end:
        t[j] = CODECS.get(t[j], (None, t[j]))[1]
        j += 5 + ((t[j + 3] & 15) << 8 | t[j + 4])
    t[end : end + 4] = _crc(bytes(t[base:end])).to_bytes(4, "big")
    return bytes(t)


def tagged_audio(data: bytes) -> tuple[bytes, str | None, bytes]:
    """(tags, codec, frames) of elementary audio that begins with description tags."""
    at, codec = 0, None
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10:
        size = data[at + 6] << 21 | data[at + 7] << 14 | data[at + 8] << 7 | data[at + 9]
        tag = data[at : at + 10 + size]
        mark = tag.find(b"com.apple.streaming.audioDescription\0")
        if mark >= 0:
            codec = AUDIO_TYPES.get(tag[mark + 37 : mark + 41], codec)
        at += 10 + size
    return data[:at], codec, data[at:]


def _layout(data: bytes) -> tuple[_Stream | None, list[list[Unit]], bytes]:
    """The stream, its units by group, and what stands before. Transport streams begin with 47, elementary audio with a tag; others have no units."""
    if data[:1] == b"\x47":
        s = demux(data)
        return s, [units_of(s.codec[pid], body) for pid, _, _, body in s.groups], b""
    tags, codec, frames = tagged_audio(data)
    return None, [units_of(codec, frames)] if codec else [], tags


@F.pandas_udf(ArrayType(BinaryType()))
def encrypted_parts(segments: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for col in segments:
        yield col.map(lambda x: None if x is None else [gather(u.body, u.spans) for g in _layout(bytes(x))[1] for u in g if u.spans])


@F.pandas_udf(BinaryType())
def with_plain_parts(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for data, parts in rows:
        out = []
        for x, plain in zip(data, parts):
            if x is None:
                out.append(None)
                continue
            s, groups, before = _layout(bytes(x))
            rest = iter([] if plain is None else list(plain))
            clear = [b"".join(u.clear(bytes(next(rest)) if u.spans else b"") for u in g) for g in groups]
            out.append(remux(s, clear) if s is not None else before + b"".join(clear) if groups else b"")
        yield pd.Series(out, dtype=object)


def decrypt_samples(segment: Column, key: Column, iv: Column) -> Column:
    """A sample-encrypted segment in the clear; data that is neither a transport stream nor tagged audio gives an empty result. Null stays null.

    Every unit is deciphered on its own from `iv`, so units are independent of one another.
    """
    parts = F.transform(encrypted_parts(segment), lambda p: decrypt_cbc_bare(p, key, iv))
    return with_plain_parts(segment, parts)
