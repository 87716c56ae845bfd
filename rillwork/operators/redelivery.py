"""At-least-once deliveries: one row per identifier, kept by partition-wise upserts."""

from __future__ import annotations

import functools
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import through_table


#: The index lies in so many buckets by hash; a merge reads those its keys fall into. Beyond so many folders it is written anew as one.
INDEX_BUCKETS, INDEX_FOLDERS = 64, 8


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(INDEX_BUCKETS)).cast("int")


@dataclass
class Merge:
    """What one merge did: the surplus rows it found, the partitions it replaced and those it only added to."""

    surplus: DataFrame
    replaced: list[str]
    added: list[str]


class WinnerStore:
    """A table of winners (one row per key), partitioned by arrival time, with an index from key to partition.

    merge(incoming) looks up in the index which historical partitions hold one of the incoming keys, reads only those,
    recomputes one winner per key over them and the incoming rows, and replaces those partitions in one step: new files go
    into a folder of their own and a manifest that names the current folders of each partition is renamed into place. A job
    that dies before the rename leaves the earlier state; folders that no manifest names are never read. Several writers at
    once are not supported.

    Columns: `key` (any number), `arrived` TIMESTAMP, `row_id` (unique per delivery, may contain columns of the key; the surplus is
    told by it) and `carried`.
    The winner of a key is the row with the earliest arrival, then the smallest row_id; a null arrival counts as the latest.

    Defined results: rows with a null in a key column are nobody's copies and are not stored; rows repeated with the same row_id
    count once; empty incoming tables change nothing. Keys are compared exactly. A key may hold any share of the rows: winners
    come from an aggregation with map-side combining, and the surplus from a join of the incoming rows with one row per key that has losers, which
    Spark broadcasts where it is small and splits by AQE where a key is hot.

    The list of affected partitions is collected: it is bounded by the number of partitions, one per `unit` of time.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], row_id: Sequence[str], arrived: str, carried: Sequence[str] = (), unit: str = "week"):
        self.spark, self.path, self.key, self.row_id, self.arrived, self.carried, self.unit = spark, path.rstrip("/"), list(key), list(row_id), arrived, list(carried), unit

    # -- state

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root

    def manifest(self) -> dict:
        """{"version": n, "parts": {partition: [folders]}, "schema": DDL}; version 0 before the first merge."""
        jvm, fs, root = self._fs()
        if not fs.exists(root):
            return {"version": 0, "parts": {}, "index": []}
        last = max(int(s.getPath().getName()) for s in fs.listStatus(root) if s.getPath().getName().isdigit())
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(root, str(last)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        jvm, fs, root = self._fs()
        fs.mkdirs(root)
        Path = jvm.org.apache.hadoop.fs.Path
        staged = Path(root, f"_{manifest['version']}")
        out = fs.create(staged, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(staged, Path(root, str(manifest["version"]))):
            raise RuntimeError("another merge was committed meanwhile")

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders)

    def winners(self) -> DataFrame:
        """The current table."""
        m = self.manifest()
        folders = sorted({f for fs in m["parts"].values() for f in fs})
        if not folders:
            raise ValueError("nothing merged yet")
        return self._read(folders, m["schema"])

    # -- merging

    def _partition(self):
        return F.coalesce(F.date_format(F.date_trunc(self.unit, F.col(f"`{self.arrived}`")), "yyyyMMddHH"), F.lit("none"))

    def _index(self, folders: list[str], buckets: list[int] | None = None) -> DataFrame:
        """Entries (_h, _p, _a) of the index; with `buckets` only their folders are read."""
        parts = [self.spark.read.schema("_h long, _p string, _a string").parquet(f).select("_h", "_p", "_a") for f in folders]
        every = functools.reduce(DataFrame.unionByName, parts)
        return every if buckets is None else every.where(F.col("_a").isin([str(b) for b in buckets]))

    def _lookup(self, folders: list[str], new: DataFrame) -> list[str]:
        """Partitions that hold one of the incoming keys, by the index buckets those keys fall into and no others."""
        hashes = new.select(F.xxhash64(*self.key).alias("_h")).distinct()
        buckets = sorted(r[0] for r in hashes.select(_bucket(F.col("_h")).alias("b")).distinct().collect())  # at most INDEX_BUCKETS
        index = self._index(folders, buckets)
        return sorted(r[0] for r in index.join(hashes, "_h", "left_semi").select("_p").distinct().collect())

    def merge(self, incoming: DataFrame) -> Merge:
        m = self.manifest()
        n = m["version"] + 1
        told = [c for c in self.row_id if c not in self.key]
        known = [*self.key, *told, self.arrived, *self.carried]
        new = incoming.select(*[F.col(f"`{c}`") for c in known]).dropna(subset=self.key)
        schema = m.get("schema") or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new.schema.fields)
        tagged = new.withColumn("_new", F.lit(True))
        affected: list[str] = []
        if m["index"]:
            affected = [p for p in self._lookup(m["index"], new) if p in m["parts"]]
            if affected:
                old = self._read(sorted({f for p in affected for f in m["parts"][p]}), schema)
                tagged = tagged.unionByName(old.withColumn("_new", F.lit(False)))

        row = F.struct(*[F.col(f"`{c}`").alias(f"_r{i}") for i, c in enumerate(told)], F.lit(0).alias("_"))
        rank = F.struct(F.col(f"`{self.arrived}`").isNull().alias("_late"), F.col(f"`{self.arrived}`").alias("_at"), row.alias("_row"), F.col("_new"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(self.carried)])
        # one pass: the winner, whether other rows lost, and the stored row of the key (there is one at most) in case it lost
        best = tagged.groupBy(*self.key).agg(F.min(rank).alias("_w"), (F.min(row) < F.max(row)).alias("_several"), F.max(F.when(~F.col("_new"), row)).alias("_old"))
        won = best.select(*self.key, *[F.col(f"_w._row._r{i}").alias(c) for i, c in enumerate(told)], F.col("_w._at").alias(self.arrived), *[F.col(f"_w._c{i}").alias(c) for i, c in enumerate(self.carried)], F.col("_w._new").alias("_new"), "_several", F.when(F.col("_old") != F.col("_w._row"), F.col("_old")).alias("_lost"))
        won = won.withColumn("_p", self._partition()).withColumn("_h", F.xxhash64(*self.key))
        # and one write: winners by partition, index entries of the new ones by bucket, and the keys with losers
        kinds = F.array_compact(F.array(F.lit("data"), F.when(F.col("_new"), "index"), F.when(F.col("_several"), "several")))
        out = won.select("*", F.explode(kinds).alias("_kind"))
        kind = F.col("_kind")
        out = out.withColumn("_a", F.when(kind == "data", F.col("_p")).when(kind == "index", _bucket(F.col("_h")).cast("string")).otherwise("0")).withColumn("_b", F.when(kind == "data", F.col("_new").cast("string")).otherwise("0"))
        slim = [F.when(kind != "index", F.col(f"`{c}`")).alias(c) for c in [*self.key, *told]] + [F.when(kind == "data", F.col(f"`{c}`")).alias(c) for c in [self.arrived, *self.carried]]
        out = out.select(*slim, F.when(kind == "index", F.col("_h")).alias("_h"), F.when(kind == "index", F.col("_p")).alias("_p"), F.when(kind == "several", F.col("_lost")).alias("_lost"), "_kind", "_a", "_b")
        data = f"{self.path}/data/{n}"
        # a rebalance keeps one writer per small partition and splits a hot one
        out.hint("rebalance", "_kind", "_a").write.mode("overwrite").partitionBy("_kind", "_a", "_b").parquet(data)

        written = self._parts_of(f"{data}/_kind=data")
        parts = {p: f for p, f in m["parts"].items() if p not in affected}
        for p, folders in written.items():
            parts[p] = [*parts.get(p, []), *folders]
        index = [*m["index"], *([f"{data}/_kind=index"] if self._exists(f"{data}/_kind=index") else [])]
        if len(index) > INDEX_FOLDERS:
            whole = f"{self.path}/index/{n}"
            self._index(index).distinct().hint("rebalance", "_a").write.mode("overwrite").partitionBy("_a").parquet(whole)
            index = [whole]

        lost = f"{self.path}/surplus/{n}"
        types = {f.name: f.dataType.simpleString() for f in new.schema.fields}
        row_type = "struct<" + ", ".join([*(f"_r{i}: {types[c]}" for i, c in enumerate(told)), "_: int"]) + ">"
        lost_schema = ", ".join(f"`{c}` {types[c]}" for c in [*self.key, *told])
        if self._exists(f"{data}/_kind=several"):
            several = self.spark.read.schema(f"{lost_schema}, _lost {row_type}").parquet(f"{data}/_kind=several")
            stored = several.where("_lost is not null").select(*self.key, *[F.col(f"_lost._r{i}").alias(c) for i, c in enumerate(told)])
            winner = several.select(*self.key, *[F.col(f"`{c}`").alias(f"_w{i}") for i, c in enumerate(told)])
            same = F.lit(True)
            for i, c in enumerate(told):
                same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_w{i}"))
            # only keys with losers meet the incoming rows again
            losers = new.select(*self.key, *told).join(winner, self.key).where(~same).select(*self.key, *told)
            losers.unionByName(stored).write.mode("overwrite").parquet(lost)
        else:
            self.spark.createDataFrame([], lost_schema).write.mode("overwrite").parquet(lost)

        self._commit({"version": n, "parts": parts, "index": index, "schema": schema})
        return Merge(self.spark.read.schema(lost_schema).parquet(lost).distinct(), affected, sorted(set(written) - set(affected)))

    def _exists(self, path: str) -> bool:
        jvm, fs, _ = self._fs()
        return fs.exists(jvm.org.apache.hadoop.fs.Path(path))

    def _parts_of(self, data: str) -> dict[str, list[str]]:
        jvm, fs, _ = self._fs()
        out: dict[str, list[str]] = {}
        if not self._exists(data):
            return out
        for a in fs.listStatus(jvm.org.apache.hadoop.fs.Path(data)):
            if a.isDirectory() and a.getPath().getName().startswith("_a="):
                p = a.getPath().getName().split("=", 1)[1]
                out[p] = sorted(f"{data}/_a={p}/{b.getPath().getName()}" for b in fs.listStatus(a.getPath()) if b.isDirectory())
        return out


def first_deliveries(spark: SparkSession, deliveries: DataFrame, path: str, key: Sequence[str], row_id: Sequence[str], arrived: str, history: float = 0.9, unit: str = "week") -> tuple[WinnerStore, DataFrame]:
    """Load the earliest `history` share of the deliveries into a new store, merge the rest as the incoming batch; the store and all surplus rows.

    The cut is an approximate quantile of the arrival time and changes only which rows come in which batch, never the result.
    A copy that arrives in the second batch but claims an earlier arrival displaces the stored winner.
    """
    store = WinnerStore(spark, path, key, row_id, arrived, unit=unit)
    cut = deliveries.agg(F.percentile_approx(F.unix_micros(F.col(arrived)), history)).first()[0]
    if cut is None:
        return store, store.merge(deliveries).surplus
    early = F.coalesce(F.unix_micros(F.col(arrived)) <= cut, F.lit(False))
    first = store.merge(deliveries.where(early))
    # the incoming batch is read three times: a table of its own spares the scans of everything
    late = deliveries.where(~early).select(*dict.fromkeys([*key, *row_id, arrived]))
    second = store.merge(through_table(late, "incoming"))
    return store, first.surplus.unionByName(second.surplus).distinct()
