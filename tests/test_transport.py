from pyspark.sql import functions as F

from rillwork.functions.ciphers import encrypt_cbc
from rillwork.sources import transport as t

L = F.lit
KEY, IV = bytes(range(16)), bytes(range(100, 116))


def table(pid, section):
    section = section + t._crc(section).to_bytes(4, "big")
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(188, b"\xff")


def stream(pes_by_pid, types):
    pat = table(0, bytes([0, 0xB0, 13, 0, 1, 0xC1, 0, 0, 0, 1, 0xE1, 0]))
    body = b"".join(bytes([kind, 0xE0 | pid >> 8, pid & 255, 0xF0, 0]) for pid, kind in types.items())
    pmt = table(0x100, bytes([2, 0xB0, 13 + len(body), 0, 1, 0xC1, 0, 0, 0xE1, 1, 0xF0, 0]) + body)
    out, cc = [pat, pmt], {}
    for pid, es in pes_by_pid:
        pes = b"\0\0\1\xe0\0\0\x80\0\0" + es
        for i in range(0, len(pes), 184):
            chunk = pes[i : i + 184]
            n = cc[pid] = (cc.get(pid, -1) + 1) % 16
            head = bytes([0x47, (0x40 if i == 0 else 0) | pid >> 8, pid & 255])
            if len(chunk) == 184:
                out.append(head + bytes([0x10 | n]) + chunk)
            else:
                pad = 183 - len(chunk)
                out.append(head + bytes([0x30 | n, pad]) + (b"\0" + b"\xff" * (pad - 1) if pad else b"") + chunk)
    return b"".join(out)


def secret(spark, plain):
    n = len(plain)
    return bytes(spark.range(1).select(F.substring(encrypt_cbc(L(plain), L(KEY), L(IV)), 1, n)).first()[0]) if n else b""


def encrypted(spark, codec, es):
    return b"".join(u.clear(secret(spark, t.gather(u.body, u.spans))) for u in t.units_of(codec, es))


def eac3(n):
    return b"\x0b\x77" + ((n // 2 - 1).to_bytes(2, "big")) + bytes((i * 11) % 256 for i in range(n - 4))


def adts(n):
    return bytes([0xFF, 0xF1, 0x50, 0x80 | n >> 11, n >> 3 & 255, (n & 7) << 5 | 31, 0xFC]) + bytes((i * 3) % 256 for i in range(n - 7))


def test_round_trip_of_a_transport_stream(spark):
    video = b"\0\0\0\1\x09\xf0" + b"\0\0\0\1\x65" + bytes((i * 7) % 255 + 1 for i in range(900)) + b"\0\0\1\x06" + b"q" * 100 + b"\0\0\1\x41" + bytes((i * 13) % 255 + 1 for i in range(300))
    audio = adts(200) + adts(57) + adts(20)
    plain = stream([(0x101, video), (0x102, audio), (0x101, video[::1])], {0x101: 0x1B, 0x102: 0x0F})
    coded = stream([(0x101, encrypted(spark, "video", video)), (0x102, encrypted(spark, "aac", audio)), (0x101, encrypted(spark, "video", video))], {0x101: 0xDB, 0x102: 0xCF})
    df = spark.createDataFrame([(coded,), (None,), (b"zzz",), (b"",)], "d binary")
    got = [r[0] and bytes(r[0]) for r in df.select(t.decrypt_samples(F.col("d"), L(KEY), L(IV))).collect()]
    assert got[1] is None and got[2] in (b"", None) and len(got[0]) % 188 == 0
    mine, want = t.demux(got[0]), t.demux(plain)
    assert [(g[0], g[3]) for g in mine.groups] == [(g[0], g[3]) for g in want.groups]
    assert got[0][188:376] == plain[188:376]  # the table names the clear types
    assert len(got[0]) >= len(coded)


def test_elementary_audio(spark):
    mark = b"com.apple.streaming.audioDescription\0zec3" + bytes(4)
    tag = b"ID3\4\0\0" + bytes([0, 0, 0, 10 + len(mark)]) + b"PRIV" + len(mark).to_bytes(4, "big") + b"\0\0" + mark
    es = eac3(120) + eac3(48) + eac3(30)
    df = spark.createDataFrame([(tag + encrypted(spark, "eac3", es),)], "d binary")
    assert bytes(df.select(t.decrypt_samples(F.col("d"), L(KEY), L(IV))).first()[0]) == tag + es


def test_units_put_together_are_the_stream():
    es = b"\0\0\1\x67abc\0\0\0\1\x68d\0\0\0"
    assert b"".join(u.clear(b"") for u in t.units_of("video", es)) == es
    assert t.frame_length("ac3", bytes([0x0B, 0x77, 0, 0, 37])) == (2560, 0) and t.frame_length("aac", adts(300)) == (300, 7)
