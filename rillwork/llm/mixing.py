"""Mixing sources to target shares of tokens."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text_arrays import slices

#: Where the public vocabularies lie, and the splitting pattern that goes with the byte-level ones: parameters of the operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of the targets table that are taken to the driver; more is an error, nothing is dropped.
MOST_TARGETS = 100_000

_encoders: dict = {}


def _encoder(vocabulary: bytes, pattern: str):
    """The tokenizer of a vocabulary file's contents; one per process."""
    key = zlib.crc32(vocabulary), len(vocabulary), pattern
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def token_counts(docs: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The columns `keep` and n_tokens, the tokens of the whole text; 0 for null and empty texts. A map over Arrow batches.

    The vocabulary file (under a megabyte) is read where the plan is made and broadcast: executors need no file of their own.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    schema = StructType([*slim.schema.fields[:-1], StructField("n_tokens", LongType())])
    at = len(keep)
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared.value, pattern)
        for batch in batches:
            for rows, texts in slices(batch, at):
                n = np.fromiter((len(enc.encode_ordinary(t)) for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([*rows.columns[:at], pa.array(n)], names=schema.names)

    return slim.mapInArrow(run, schema)


def repetition_rates(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, tuple[float, float]]:
    """source -> (rate, share it is to reach) so that expected tokens follow the targets.

    Sources without tokens can supply nothing; the shares of the others are scaled to sum to 1. Without `total`, the largest total is
    taken at which every source reaches its share within its cap, so the shares come out as asked. With `total`, sources whose cap is
    too small supply all they may and the rest is shared among the others in proportion to their targets.
    """
    have = {s: (share, cap) for s, share, cap in targets if share > 0 and cap > 0 and sizes.get(s, 0) > 0}
    whole = sum(share for share, _ in have.values())
    if not have:
        return {}
    goal = {s: share / whole for s, (share, _) in have.items()}
    most = {s: have[s][1] * sizes[s] for s in have}
    if total is None:
        total = min(most[s] / goal[s] for s in have)
        return {s: (min(float(have[s][1]), goal[s] * total / sizes[s]), goal[s]) for s in have}
    rates: dict[str, float] = {}
    free, left = dict(goal), float(total)
    while free:
        scale = left / sum(free.values())
        over = [s for s in free if free[s] * scale > most[s]]
        if not over:
            rates |= {s: free[s] * scale / sizes[s] for s in free}
            break
        for s in over:
            rates[s] = float(have[s][1])
            left -= most[s]
            del free[s]
        left = max(left, 0.0)
    return {s: (rates[s], goal[s]) for s in rates}


def mix_sources(
    docs: DataFrame, doc_id: str, source: str, targets: DataFrame, total: float | None = None, seed: int = 0,
    counts: DataFrame | None = None, text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(selection, shares). targets: source, target_share, max_repeats.

    selection: (doc_id, source, n_tokens, repeats), one row per document used at least once: floor(rate) copies plus one more where the hash of
    (doc_id, seed) falls below the fraction of the rate, so a rerun selects the same. shares: per listed source the target, what it has, its
    rate, what was selected, the share reached and how far that is from the (scaled) target. Only one row per listed source is collected.

    Defined results: documents of unlisted or null sources are not used; a target share of 0, null or NaN uses nothing; a null max_repeats is 1; a source listed more than once is an
    error; null and empty texts count no tokens; an empty documents table gives an empty selection and shares of 0.
    """
    spark = docs.sparkSession
    rows = targets.select("source", "target_share", "max_repeats").dropna(subset=["source"]).limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("a source is listed more than once")
    asked = [(r[0], float(r[1]) if r[1] is not None and r[1] == r[1] else 0.0, 1 if r[2] is None else int(r[2])) for r in rows]
    counted = counts if counts is not None else token_counts(docs, text, [doc_id, source])
    listed = spark.createDataFrame([(s,) for s, _, _ in asked], "_s string")
    sizes = {r[0]: (int(r[1]), int(r[2])) for r in counted.groupBy(F.col(source).alias("_s")).agg(F.sum("n_tokens"), F.count("*")).join(listed, "_s", "left_semi").collect()}
    rates = repetition_rates({s: n for s, (n, _) in sizes.items()}, asked, total)
    table = spark.createDataFrame(
        [(s, share, cap, sizes.get(s, (0, 0))[1], sizes.get(s, (0, 0))[0], *rates.get(s, (0.0, 0.0))) for s, share, cap in asked],
        "source string, target_share double, max_repeats int, documents bigint, tokens bigint, rate double, scaled_share double",
    )
    draw = F.pmod(F.xxhash64(F.col(doc_id), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    repeats = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("bigint")).cast("bigint")
    selection = (
        counted.join(table.select(F.col("source").alias("_s"), "rate"), F.col(source) == F.col("_s"))
        .select(F.col(doc_id), F.col(source).alias("source"), "n_tokens", repeats.alias("repeats"))
        .where("repeats > 0")
    )
    used = selection.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("_n"), F.sum("repeats").alias("_r"))
    everything = used.agg(F.sum("_n").alias("_all"))
    shares = (
        table.join(used, F.col("source") == F.col("_s"), "left").join(everything, F.lit(True), "left")
        .select("source", "target_share", "scaled_share", "max_repeats", "documents", "tokens", "rate", F.coalesce("_r", F.lit(0)).alias("copies"), F.coalesce("_n", F.lit(0)).alias("selected_tokens"), F.coalesce(F.col("_n") / F.col("_all"), F.lit(0.0)).alias("actual_share"))
        .withColumn("missed_by", F.col("actual_share") - F.coalesce("scaled_share", F.lit(0.0)))
    )
    return selection, shares
