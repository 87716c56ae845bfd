"""AES-128-CBC on columns, with and without padding, and the block patterns of sample encryption."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

L = F.lit


def decrypt_cbc(data: Column, key: Column, iv: Column) -> Column:
    """AES-CBC with PKCS#7 padding."""
    return F.aes_decrypt(F.concat(iv, data), key, L("CBC"), L("PKCS"))


def encrypt_cbc(data: Column, key: Column, iv: Column) -> Column:
    return F.substring(F.aes_encrypt(data, key, L("CBC"), L("PKCS"), iv), L(17), F.octet_length(data) + 16)


def decrypt_cbc_bare(data: Column, key: Column, iv: Column) -> Column:
    """AES-CBC of whole blocks without padding.

    The JVM function wants padding, so one block is put behind: the encryption of an empty text with the last block as vector
    decrypts, in its place, to a full block of padding.
    """
    last = F.substring(data, F.octet_length(data) - 15, L(16))
    pad = F.substring(F.aes_encrypt(F.unhex(L("")), key, L("CBC"), L("PKCS"), last), 17, 16)
    return F.when(F.octet_length(data) == 0, data).otherwise(F.aes_decrypt(F.concat(iv, data, pad), key, L("CBC"), L("PKCS")))


def segment_bytes(data: Column, key: Column, iv: Column, init: Column, init_encrypted: Column) -> Column:
    """A fetched segment as it is stored: with its initialisation part before it, decrypted with it or without it, or as it came."""
    plain = F.when(key.isNull(), data).otherwise(decrypt_cbc(data, key, iv))
    whole = decrypt_cbc(F.concat(init, data), key, iv)
    return F.when(init.isNull(), plain).when(key.isNull(), F.concat(init, data)).when(init_encrypted, whole).otherwise(F.concat(init, plain))


# -- sample encryption: which bytes of a unit are encrypted

VIDEO_LEAD, VIDEO_SKIP, BLOCK, AUDIO_LEAD = 32, 144, 16, 16


def video_spans(size: int) -> list[tuple[int, int]]:
    """Encrypted 16-byte blocks of a coded slice of `size` bytes: one of ten after a clear lead; a unit of 48 bytes or fewer has none."""
    out, at = [], VIDEO_LEAD
    if size <= VIDEO_LEAD + BLOCK:
        return out
    while size - at > BLOCK:
        out.append((at, at + BLOCK))
        at += BLOCK + VIDEO_SKIP
    return out


def audio_spans(size: int) -> list[tuple[int, int]]:
    """The whole blocks of an audio frame after its clear lead, as one span."""
    whole = max(0, size - AUDIO_LEAD) // BLOCK * BLOCK
    return [(AUDIO_LEAD, AUDIO_LEAD + whole)] if whole else []


def unescape(unit: bytes) -> bytes:
    """A video unit without its emulation prevention bytes (03 after 00 00)."""
    return unit.replace(b"\0\0\3", b"\0\0")


def escape(unit: bytes) -> bytes:
    """Emulation prevention put back."""
    out, zeros = bytearray(), 0
    for b in unit:
        if zeros >= 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def split_units(stream: bytes) -> list[bytes]:
    """Video units between start codes (00 00 01, with or without a zero before)."""
    out, at = [], stream.find(b"\0\0\1")
    while at >= 0:
        nxt = stream.find(b"\0\0\1", at + 3)
        unit = stream[at + 3 : nxt if nxt >= 0 else len(stream)]
        out.append(unit.rstrip(b"\0") if nxt >= 0 else unit)
        at = nxt
    return out


def gather(unit: bytes, spans: list[tuple[int, int]]) -> bytes:
    return b"".join(unit[a:b] for a, b in spans)


def scatter(unit: bytes, spans: list[tuple[int, int]], plain: bytes) -> bytes:
    out, at = bytearray(unit), 0
    for a, b in spans:
        out[a:b] = plain[at : at + b - a]
        at += b - a
    return bytes(out)


#: Type numbers of coded slices that carry encrypted blocks, and stream types that are decrypted.
SLICES = (1, 5)
ENCRYPTED_STREAM_TYPES = (0x0F, 0x1B, 0x81, 0x87, 0xCF, 0xDB, 0xC1, 0xC2)


def _kinded(kind: str, unit: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    if kind == "video":
        if not unit or unit[0] & 31 not in SLICES:
            return unit, []
        unit = unescape(unit)
        return unit, video_spans(len(unit))
    return unit, audio_spans(len(unit))


@F.pandas_udf(BinaryType())
def encrypted_part(kinds: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The encrypted bytes of video units (kind `video`) or audio frames (kind `audio`), one after another."""
    for kind, unit in kinds:
        yield pd.Series([None if u is None else gather(*_kinded(k, u)) for k, u in zip(kind, unit)], dtype=object)


@F.pandas_udf(BinaryType())
def with_plain_part(rows: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The unit with the decrypted bytes in their places; video units get their emulation prevention back."""
    for kind, unit, plain in rows:
        out = []
        for k, u, p in zip(kind, unit, plain):
            if u is None:
                out.append(None)
                continue
            body, spans = _kinded(k, u)
            done = scatter(body, spans, p or b"")
            out.append(escape(done) if k == "video" and spans else u if k == "video" else done)
        yield pd.Series(out, dtype=object)


def decrypt_unit(kind: Column, unit: Column, key: Column, iv: Column) -> Column:
    """A sample-encrypted unit in the clear: Python finds the bytes, the JVM deciphers them."""
    return with_plain_part(kind, unit, decrypt_cbc_bare(encrypted_part(kind, unit), key, iv))


def stream_is_encrypted(stream_type: Column) -> Column:
    return stream_type.isin(*ENCRYPTED_STREAM_TYPES)
