"""Ordered reassembly of segments that arrive out of order, per stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "stream_id bigint, sequence bigint, success boolean, item string, position bigint, late boolean"
_STATE = "next bigint, sent bigint, sequences array<bigint>, successes array<boolean>, items array<string>"


def reassemble(outcomes: DataFrame, first: int = 0) -> DataFrame:
    """Outcomes (stream_id, sequence, success, item) of a stream in sequence: what is ahead waits until the run before it is complete.

    A failed segment takes its turn like others (success false), so the run goes on behind it. What comes again or too late is
    emitted with `late`, outside the numbering, and changes nothing. What stays behind a hole stays in the state; flush_rest emits it once the query has ended.
    State per stream: the next number and the rows that wait.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nxt, sent, seqs, oks, items = state.get if state.exists else (first, 0, [], [], [])
        waiting = {s: (o, i) for s, o, i in zip(seqs, oks, items)}
        out = []
        for pdf in batches:
            for s, ok, item in zip(pdf["sequence"], pdf["success"], pdf["item"]):
                if s < nxt or s in waiting:
                    out.append((key[0], s, bool(ok), item, None, True))
                else:
                    waiting[int(s)] = (bool(ok), item)
        while nxt in waiting:
            ok, item = waiting.pop(nxt)
            out.append((key[0], nxt, ok, item, sent, False))
            nxt, sent = nxt + 1, sent + 1
        left = sorted(waiting)
        state.update((nxt, sent, left, [waiting[s][0] for s in left], [waiting[s][1] for s in left]))
        pdf = pd.DataFrame(out, columns=["stream_id", "sequence", "success", "item", "position", "late"])
        yield pdf.astype({"position": "Int64"})

    return outcomes.groupBy("stream_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def contiguous_prefix(df: DataFrame, stream: str, sequence: str, first: int = 0) -> DataFrame:
    """The same for a finished table: the rows of each stream up to its first hole. Repeated sequences keep one row beforehand."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    n = F.row_number().over(Window.partitionBy(stream).orderBy(sequence)) - 1 + first
    return df.withColumn("_n", n).where(F.col(sequence) == F.col("_n")).drop("_n")


def flush_rest(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What an ended reassemble query still holds behind holes, read from the state in its checkpoint: (stream_id, sequence, success, item, position), in order.

    Positions go on from the last one that was emitted; the holes are passed over. Read after the query has stopped; the state is not changed.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    state = spark.read.format("statestore").load(checkpoint)
    held = state.select("key.*", "value.groupState.*") if "groupState" in state.select("value.*").columns else state.select("key.*", "value.*")
    key = held.columns[0]
    rows = held.select(F.col(key).alias("stream_id"), "sent", F.explode(F.arrays_zip("sequences", "successes", "items")).alias("w"))
    n = F.row_number().over(Window.partitionBy("stream_id").orderBy("w.sequences")) - 1
    return rows.select("stream_id", F.col("w.sequences").alias("sequence"), F.col("w.successes").alias("success"), F.col("w.items").alias("item"), (F.col("sent") + n).alias("position"))


def pipe_in_order(outcomes: DataFrame, write: Callable[[int, Iterator[tuple[int, bool, str | None]]], None], checkpoint: str, first: int = 0, **trigger: object) -> StreamingQuery:
    """Starts a query that hands each stream's segments on in sequence: `write`(stream_id, iterator of (position, success, item)) once per stream and batch.

    The batches are idempotent by position: a batch that is repeated after a failure carries the same positions, so a writer that remembers its last
    position leaves repeats out. Rows reach `write` on the executors, one stream at a time.
    """
    ordered = reassemble(outcomes, first)

    def batch(df: DataFrame, _: int) -> None:
        rows = df.where("not late").repartition("stream_id").sortWithinPartitions("stream_id", "position")

        def hand(part: Iterator) -> None:
            import itertools

            for stream, own in itertools.groupby(part, key=lambda r: r["stream_id"]):
                write(stream, ((r["position"], r["success"], r["item"]) for r in own))

        rows.foreachPartition(hand)

    return ordered.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
