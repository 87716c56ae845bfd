"""Texts that look the same: one consistent form, and the pairs of rows whose texts differ only invisibly."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import through_table

# Letters of other scripts by the Latin letter they look like, after the Unicode confusables data.
CYRILLIC = {
    "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р", "S": "Ѕ", "T": "Т", "X": "Х", "Y": "Ү",
    "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "l": "ӏ", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "v": "ѵ", "w": "ԝ", "x": "х", "y": "у",
    "ä": "ӓ", "ë": "ё", "ï": "ї", "ö": "ӧ", "Ä": "Ӓ", "Ë": "Ё", "Ï": "Ї", "Ö": "Ӧ",
}
GREEK = {
    "A": "Α", "B": "Β", "E": "Ε", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ",
    "a": "α", "i": "ι", "o": "ο", "p": "ρ", "u": "υ", "v": "ν", "y": "γ", "ó": "ό", "í": "ί", "ú": "ύ",
}
ARMENIAN = {"O": "Օ", "S": "Տ", "U": "Ս", "h": "հ", "n": "ո", "o": "օ", "q": "զ", "u": "ս", "g": "ց"}
CHEROKEE = {
    "A": "Ꭺ", "B": "Ᏼ", "C": "Ꮯ", "D": "Ꭰ", "E": "Ꭼ", "G": "Ꮐ", "H": "Ꮋ", "J": "Ꭻ", "K": "Ꮶ", "L": "Ꮮ", "M": "Ꮇ", "P": "Ꮲ", "R": "Ꭱ", "S": "Ꮪ", "T": "Ꭲ", "V": "Ꮩ", "W": "Ꮃ", "Z": "Ꮓ",
}
LISU = {
    "A": "ꓮ", "B": "ꓐ", "C": "ꓚ", "D": "ꓓ", "E": "ꓰ", "F": "ꓝ", "G": "ꓖ", "H": "ꓧ", "I": "ꓲ", "J": "ꓙ", "K": "ꓗ", "L": "ꓡ", "M": "ꓟ", "N": "ꓠ", "O": "ꓳ", "P": "ꓑ", "R": "ꓣ", "S": "ꓢ", "T": "ꓔ", "U": "ꓴ", "V": "ꓦ", "W": "ꓪ", "X": "ꓫ", "Y": "ꓬ", "Z": "ꓜ",
}
COPTIC = {"B": "Ⲃ", "C": "Ⲥ", "H": "Ⲏ", "I": "Ⲓ", "K": "Ⲕ", "M": "Ⲙ", "N": "Ⲛ", "O": "Ⲟ", "P": "Ⲣ", "T": "Ⲧ", "o": "ⲟ", "p": "ⲣ", "c": "ⲥ"}
LATIN_VARIANTS = {"a": "ɑ", "g": "ɡ", "i": "ı", "v": "ⅴ", "l": "ⅼ", "c": "ⅽ", "d": "ⅾ", "m": "ⅿ"}
#: Katakana, and the Han or Hiragana character that looks like it.
KANA = {"ロ": "口", "ニ": "二", "ハ": "八", "エ": "工", "カ": "力", "タ": "夕", "ト": "卜", "ー": "一", "オ": "才", "ミ": "彡", "ノ": "丿", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ"}

#: preferred first
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Lisu", "Coptic")
_SPELL = dict(zip(SCRIPTS[1:], (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU, COPTIC)))
#: any letter -> its Latin spelling, and Latin letter -> the scripts that can spell it
_TO_LATIN = {other: latin for table in _SPELL.values() for latin, other in table.items()}
_TO_LATIN |= {other: latin for latin, other in LATIN_VARIANTS.items()} | {"У": "Y"}
_CAN = {}
for _script, _table in _SPELL.items():
    for _latin in _table:
        _CAN.setdefault(_latin, {"Latin"}).add(_script)
_HAN_LIKE = {b: a for a, b in KANA.items()}


def _script(ch: str) -> str:
    """Script of a letter; Han, Hiragana, Katakana and all others that none of the tables spells are `other`."""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "Latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "Greek"
    if 0x400 <= o < 0x530:
        return "Cyrillic"
    if 0x530 <= o < 0x590:
        return "Armenian"
    if 0x13A0 <= o < 0x1400 or 0xAB70 <= o < 0xABC0:
        return "Cherokee"
    if 0xA4D0 <= o < 0xA500:
        return "Lisu"
    if 0x2C80 <= o < 0x2D00:
        return "Coptic"
    return "other"


def _is_pictograph(ch: str) -> bool:
    return ord(ch) >= 0x1F000 or 0x2600 <= ord(ch) < 0x27C0


JOINER = "\u200d"


def _joins(text: str, i: int) -> bool:
    return 0 < i < len(text) - 1 and _is_pictograph(text[i - 1]) and _is_pictograph(text[i + 1])


def _invisible(o: int) -> bool:
    return (
        o in (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFEFF, 0xFFA0)
        or 0x180B <= o <= 0x180F or 0x200B <= o <= 0x200F or 0x202A <= o <= 0x202E or 0x2060 <= o <= 0x206F
        or 0xFE00 <= o <= 0xFE0F or 0x1D173 <= o <= 0x1D17A or 0xE0000 <= o <= 0xE0FFF
    )


_fold: dict[str, str] = {}


def _fold_char(ch: str) -> str:
    """Width and space variants of one character; invisible ones vanish. Circled digits, ligatures, superscripts and the like look different and stay."""
    got = _fold.get(ch)
    if got is None:
        o = ord(ch)
        if _invisible(o):
            got = ""
        elif unicodedata.category(ch) == "Zs":
            got = " "
        elif unicodedata.decomposition(ch).startswith(("<wide>", "<narrow>")):
            got = unicodedata.normalize("NFKC", ch)
        else:
            got = ch
        if len(_fold) < 65536:
            _fold[ch] = got
    return got


def resolved_scripts(token: str) -> set[str]:
    """The scripts that can spell every letter of a run: the intersection of the sets of its letters, each its own script and those with a letter that looks the same."""
    could = set(SCRIPTS)
    for own in token:
        base = _TO_LATIN.get(own, own)
        could &= _CAN.get(base, {"Latin"}) if base != own or _script(own) == "Latin" else {_script(own)}
        if not could:
            break
    return could


def confusion(token: str) -> str | None:
    """`mixed` for a run of letters of several scripts; `whole` for one of a single other script that Latin can spell throughout; else None."""
    own = {_script(c) for c in token} - {"other"}
    if len(own) > 1:
        return "mixed"
    if own and own != {"Latin"}:
        return "whole" if "Latin" in resolved_scripts(token) else None
    return "mixed" if any(c in LATIN_VARIANTS.values() for c in token) else None


def tokens(text: str) -> Iterator[str]:
    """Runs of letters of the scripts that have look-alikes, marks composed and widths folded."""
    run = []
    for c in unicodedata.normalize("NFC", "".join(map(_fold_char, text))):
        if c.isalpha() and (c in _TO_LATIN or _script(c) != "other"):
            run.append(c)
        elif run:
            yield "".join(run)
            run = []
    if run:
        yield "".join(run)


def _spell(token: str) -> str:
    """A run of letters in the one script that can spell all of it, Latin first; letters of runs no script can spell go to Latin one by one."""
    latin = [_TO_LATIN.get(c, c) for c in token]
    could = resolved_scripts(token)
    target = next((s for s in SCRIPTS if s in could), "Latin")
    return "".join(latin) if target == "Latin" else "".join(_SPELL[target].get(b, c) for b, c in zip(latin, token))


def _spell_kana(text: str) -> str:
    """Characters shared by Katakana and Han or Hiragana take the script of the nearest character before, else after, that only one script has."""
    if not any(c in KANA or c in _HAN_LIKE for c in text):
        return text
    kind = []
    for c in text:
        o = ord(c)
        if c in KANA or c in _HAN_LIKE:
            kind.append("?")
        elif 0x30A1 <= o <= 0x30FA:
            kind.append("K")
        elif 0x3041 <= o <= 0x3096:
            kind.append("H")
        elif 0x3400 <= o < 0xA000:
            kind.append("C")
        else:
            kind.append("-")
    out = list(text)
    for i, c in enumerate(text):
        if kind[i] == "?":
            near = _nearest(kind, range(i - 1, -1, -1))
            if near == "-":
                near = _nearest(kind, range(i + 1, len(kind)))
            kata = _HAN_LIKE.get(c, c)
            other = KANA[kata]
            hira = 0x3041 <= ord(other) <= 0x3096
            out[i] = other if (near == "H" and hira) or (near == "C" and not hira) else kata
    return "".join(out)


def _nearest(kind: list[str], places: range) -> str:
    """The first certain script on the way, `-` where the run ends before."""
    return next((kind[j] for j in places if kind[j] != "?"), "-")


def consistent_form(text: str) -> str:
    """One form of all texts that look like `text`.

    Full- and half-width forms are folded, every kind of space is a plain one, invisible characters go (but joiners between
    pictographs stay, they change the picture), combining marks are composed; then each run of letters is spelled in the one
    script that can spell the whole run (the intersection of the scripts its letters can belong to), Latin before Cyrillic before
    Greek. Case, accents, the number of spaces and everything else a reader sees stays.
    """
    if text.isascii():
        return text
    kept = unicodedata.normalize("NFC", "".join(c if c == JOINER and _joins(text, i) else _fold_char(c) for i, c in enumerate(text)))
    if kept.isascii():
        return kept
    out, run = [], []

    def flush() -> None:
        if run:
            token = "".join(run)
            out.append(token if token.isascii() else _spell(token))
            run.clear()

    for c in kept:
        if c.isalpha() and (c in _TO_LATIN or _script(c) != "other"):
            run.append(c)
        else:
            flush()
            out.append(c)
    flush()
    return unicodedata.normalize("NFC", _spell_kana("".join(out)))


def with_form(df: DataFrame, text: str, out: str = "form") -> DataFrame:
    """df with the consistent form of a text column. A map over Arrow batches; equal texts of a batch are done once; null stays null."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(out, StringType())])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str] = {}
        for b in batches:
            col = b.column(at).cast(pa.string())
            d = pc.dictionary_encode(col)
            forms = []
            for t in d.dictionary.to_pylist():
                f = memo.get(t)
                if f is None:
                    f = consistent_form(t)
                    if len(t) < 256:
                        if len(memo) >= 50_000:
                            memo.clear()
                        memo[t] = f
                forms.append(f)
            done = pa.array(forms, pa.string()).take(d.indices)
            yield pa.RecordBatch.from_arrays([*b.columns, done], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def confused_tokens(df: DataFrame, text: str) -> DataFrame:
    """df with `mixed` and `whole`: how many letter runs of a text mix scripts, and how many are of one other script but read as Latin; null for null texts."""
    at = df.columns.index(text)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = pc.dictionary_encode(b.column(at).cast(pa.string()))
            kinds = [[] if t.isascii() else [confusion(x) for x in tokens(t)] for t in d.dictionary.to_pylist()]
            cols = [pa.array([k.count(name) for k in kinds], pa.int64()).take(d.indices) for name in ("mixed", "whole")]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "mixed", "whole"])

    return df.mapInArrow(run, f"{ddl}, mixed bigint, whole bigint")


def lookalike_members(df: DataFrame, group: list[str], row_id: str, text: str) -> DataFrame:
    """(_g0.., _f, _t, _id): the rows whose text looks like another spelling's in their group, with that common form. A table; forms are computed once.

    A class has two spellings only if one of them is not its own form. Such rows are few and are written; the others of their classes are the rows
    whose text is such a form, found by comparing the texts themselves in the JVM. Nothing rests on hashes.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    base = df.select(*[F.col(f"`{g}`").alias(k) for g, k in zip(group, keys)], F.col(f"`{row_id}`").alias("_id"), F.col(f"`{text}`").alias("_t")).where("_t is not null and _id is not null")
    odd = through_table(with_form(base, "_t", "_f").where("_f <> _t"), "odd")
    forms = through_table(odd.select(*[F.col(k).alias(f"{k}f") for k in keys], "_f").distinct(), "forms")
    same = F.col("_t") == F.col("_f")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}f"))
    plain = base.join(forms, same).select(*keys, "_id", "_t", "_f")
    return through_table(odd.select(*keys, "_id", "_t", "_f").unionByName(plain).distinct(), "members")


def lookalike_pairs(df: DataFrame, group: list[str], row_id: str, text: str) -> DataFrame:
    """(group columns, row_id_a, row_id_b), row_id_a < row_id_b: rows of one group whose texts differ but have the same consistent form.

    Spellings meet first, rows are put in last, by their own texts: a text repeated any number of times costs one row until then. The result has
    all pairs of rows, as its size demands, and nothing larger than the result is built; lookalike_classes has one row per row instead.

    Defined results: rows with a null text or a null row_id have no pairs; a null in a group column is a value like others;
    repeated rows count once; empty texts equal only invisible ones; an empty table gives no pairs.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    rows = lookalike_members(df, group, row_id, text)
    texts = rows.select(*keys, "_f", "_t").distinct()
    at = [*keys, "_f"]

    def met(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
        """x joined with y on columns of equal names, nulls equal; the columns of y that are joined on are dropped."""
        y = y.select(*[F.col(c).alias(f"{c}_y") if c in on else F.col(c) for c in y.columns])
        hit = F.lit(True)
        for c in on:
            hit = hit & F.col(c).eqNullSafe(F.col(f"{c}_y"))
        return x.join(y, hit).drop(*[f"{c}_y" for c in on])

    pairs = met(texts, texts.withColumnRenamed("_t", "_u"), at).where("_t < _u")
    a = met(pairs, rows.select(*keys, "_t", F.col("_id").alias("_a")), [*keys, "_t"])
    b = met(a, rows.select(*keys, F.col("_t").alias("_u"), F.col("_id").alias("_b")), [*keys, "_u"])
    return b.select(*[F.col(k).alias(g) for k, g in zip(keys, group)], F.least("_a", "_b").alias("row_id_a"), F.greatest("_a", "_b").alias("row_id_b")).where("row_id_a < row_id_b").distinct()


def lookalike_classes(df: DataFrame, group: list[str], row_id: str, text: str) -> DataFrame:
    """(group columns, row_id, class_id, spellings, form): one row for each row whose text has another spelling in its group; class_id is its class's smallest row id."""
    keys = [f"_g{i}" for i in range(len(group))]
    rows = lookalike_members(df, group, row_id, text)
    classes = rows.groupBy(*keys, "_f").agg(F.min("_id").alias("class_id"), F.count_distinct("_t").alias("spellings")).where("spellings > 1")
    x, y = rows.alias("x"), classes.alias("y")
    same = F.col("x._f") == F.col("y._f")
    for k in keys:
        same = same & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    return x.join(y, same).select(*[F.col(f"x.{k}").alias(g) for k, g in zip(keys, group)], F.col("x._id").alias("row_id"), "class_id", "spellings", F.col("x._f").alias("form"))
