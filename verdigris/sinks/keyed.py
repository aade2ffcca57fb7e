"""Tables of the newest row per key, kept in buckets, with small deltas, compaction and deletion of touched buckets only.

Data lie in ``data/load=<version>-<id>/bucket=<n>``; ``log/version=<n>`` names the loads of every bucket that make up a version: at
most one base and a few deltas each. A version is one file of a few rows per bucket, moved into place as a whole, after its
data. So a writer that dies leaves the version before it as it was, and what it wrote is never read. One writer at a time;
a second one that tries for the same version fails.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.operators.running import latest
from verdigris.operators.sifting import without
from verdigris.session import settle

#: Changes of which so large a share are of different keys have little to cut before they are shuffled.
DISTINCT = 0.9

_LOG = "kind string, bucket int, load string, writer string, batch bigint"


@dataclass(frozen=True)
class Entry:
    """A load that a bucket consists of (``base`` or ``delta``), or the last batch of a writer (``batch``)."""

    kind: str
    bucket: int | None = None
    load: str | None = None
    writer: str | None = None
    batch: int | None = None


class KeyedTable:
    """The newest row of every key, by ``order`` (by arrival first, if ``by_arrival``).

    Keys are dealt into ``buckets`` by the hash of ``bucket_by`` (default: the keys), and every change rewrites or extends only
    buckets that it touches. A bucket of more than ``max_deltas`` deltas is compacted by the next change.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str],
        buckets: int = 64, bucket_by: list[str] | None = None, max_deltas: int = 8, by_arrival: bool = False,
    ) -> None:
        if bucket_by and not set(bucket_by) <= set(keys):
            raise ValueError("a bucket holds whole keys")
        self.spark, self.path, self.schema = spark, path, schema
        self.keys, self.buckets, self.bucket_by, self.max_deltas = keys, buckets, bucket_by or keys, max_deltas
        self.order = ["load", *order] if by_arrival else [*order, "load"]

    # --- versions

    def version(self) -> int:
        """Number of the newest complete version, 0 before the first."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return 0
        found = [one.getPath() for one in files.listStatus(folder) if one.getPath().getName().startswith("version=")]
        numbers = [int(one.getName().split("=")[1]) for one in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(one, "_SUCCESS"))]
        return max(numbers, default=0)

    def entries(self, version: int | None = None) -> list[Entry]:
        """What a version consists of: a few rows per bucket."""
        number = self.version() if version is None else version
        if not number:
            return []
        return [Entry(**row.asDict()) for row in self.spark.read.schema(_LOG).parquet(f"{self.path}/log/version={number}").collect()]

    def _commit(self, version: int, entries: list[Entry]) -> None:
        rows = [(one.kind, one.bucket, one.load, one.writer, one.batch) for one in entries]
        self.spark.createDataFrame(rows, _LOG).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/log/version={version}")

    # --- data

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, version: int) -> tuple[str, list[int]]:
        """A new load with these rows, and the buckets that it has."""
        return self._write_dealt(rows.select(*self.schema.names).withColumn("bucket", self._bucket()).hint("rebalance", "bucket"), version)

    def _write_dealt(self, rows: DataFrame, version: int) -> tuple[str, list[int]]:
        """A new load with rows (and their ``bucket``) that lie so that few tasks hold rows of a bucket."""
        load = f"{version:012d}-{uuid.uuid4().hex}"
        folder = f"{self.path}/data/load={load}"
        rows.select(*self.schema.names, "bucket").write.partitionBy("bucket").parquet(folder)
        read = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(folder)
        return load, sorted(row["bucket"] for row in read.select("bucket").distinct().collect())

    def _write_newest(self, changes: DataFrame, version: int) -> tuple[str, list[int]]:
        """A new load with the newest of ``changes`` per key.

        Mostly different keys are shuffled once, to slices of their buckets, and written from there. Where many rows are of the
        same keys, these are first cut to one per task, as ``latest`` does, and what is left is shuffled to its buckets.
        """
        rows = changes.withColumn("load", F.lit(""))
        n, keys = changes.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*self.keys), 0.01)).first()
        if keys < DISTINCT * n:
            return self._write(latest(rows, self.keys, self.order), version)
        slices = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        dealt = rows.withColumns({"bucket": self._bucket(), "_slice": F.pmod(F.hash(*self.keys), F.lit(slices))}).repartition("bucket", "_slice")
        return self._write_dealt(latest(dealt, ["bucket", "_slice", *self.keys], self.order), version)

    def _read(self, entries: list[Entry]) -> DataFrame:
        """All rows of some loads with their load and bucket."""
        schema = T.StructType([*self.schema.fields, T.StructField("load", T.StringType()), T.StructField("bucket", T.IntegerType())])
        paths = [f"{self.path}/data/load={one.load}/bucket={one.bucket}" for one in entries]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)

    def _newest(self, held: list[Entry]) -> tuple[DataFrame, DataFrame | None]:
        """The newest row of every key in these loads: of buckets with one load as they lie, and of the others, if any, ranked.

        No load has a key twice.
        """
        loads = Counter(one.bucket for one in held)
        several = [one for one in held if loads[one.bucket] > 1]
        ranked = latest(self._read(several), ["bucket", *self.keys], self.order) if several else None
        return self._read([one for one in held if loads[one.bucket] == 1]), ranked

    def read(self, version: int | None = None) -> DataFrame:
        """The newest row of every key. Buckets of a single load are read as they lie; only the others are ranked."""
        plain, ranked = self._newest([one for one in self.entries(version) if one.kind != "batch"])
        return (plain.unionByName(ranked) if ranked else plain).select(*self.schema.names)

    # --- changes

    def upsert(self, changes: DataFrame, batch: int | None = None, writer: str = "") -> bool:
        """Adds a delta with the newest of ``changes`` per key; false if this writer's batch was applied before."""
        version, entries = self._next()
        done = max((one.batch for one in entries if one.kind == "batch" and one.writer == writer), default=-1)
        if batch is not None and batch <= done:
            return False
        load, touched = self._write_newest(changes, version)
        entries = entries + [Entry("delta", bucket, load) for bucket in touched]
        if batch is not None:
            entries = [one for one in entries if one.kind != "batch" or one.writer != writer] + [Entry("batch", writer=writer, batch=batch)]
        self._commit(version, self._compacted(entries, version))
        return True

    def delete(self, doomed: DataFrame) -> list[int]:
        """Rows of the ``doomed`` keys (columns of ``bucket_by``, and more keys if wanted) go; returns the buckets rewritten."""
        version, entries = self._next()
        on = [key for key in self.keys if key in doomed.columns]
        wanted = settle(doomed.select(on).distinct(), "doomed-keys")
        known = {one.bucket for one in entries if one.kind != "batch"}
        touched = known & {row["bucket"] for row in wanted.select(self._bucket().alias("bucket")).distinct().collect()}
        if not touched:
            return []
        plain, ranked = self._newest([one for one in entries if one.bucket in touched])
        # Rows that lie in their buckets are written as they are read; what was ranked lies anywhere.
        left = without(plain, wanted, on)
        if ranked:
            left = left.unionByName(without(ranked, wanted, on).hint("rebalance", "bucket"))
        load, kept = self._write_dealt(left, version)
        self._commit(version, [one for one in entries if one.bucket not in touched] + [Entry("base", bucket, load) for bucket in kept])
        return sorted(touched)

    def compact(self) -> list[int]:
        """One base for every bucket that has deltas; returns the buckets rewritten."""
        version, entries = self._next()
        touched = sorted({one.bucket for one in entries if one.kind == "delta"})
        if touched:
            self._commit(version, self._compacted(entries, version, 0))
        return touched

    def _compacted(self, entries: list[Entry], version: int, deltas: int | None = None) -> list[Entry]:
        most = self.max_deltas if deltas is None else deltas
        counts: dict[int, int] = {}
        for one in entries:
            if one.kind == "delta":
                counts[one.bucket] = counts.get(one.bucket, 0) + 1
        full = {bucket for bucket, count in counts.items() if count > most}
        if not full:
            return entries
        rows = latest(self._read([one for one in entries if one.bucket in full]), ["bucket", *self.keys], self.order)
        load, kept = self._write(rows, version)
        return [one for one in entries if one.bucket not in full] + [Entry("base", bucket, load) for bucket in kept]

    def _next(self) -> tuple[int, list[Entry]]:
        version = self.version()
        return version + 1, self.entries(version)

    def vacuum(self, keep: int = 1) -> int:
        """Removes versions but the newest ``keep`` and the loads that none of those names; returns how many loads went."""
        newest = self.version()
        kept = range(max(1, newest - keep + 1), newest + 1)
        used = {one.load for version in kept for one in self.entries(version)}
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = 0
        for folder, names in (("log", {str(version) for version in kept}), ("data", used)):
            place = path(f"{self.path}/{folder}")
            for one in files.listStatus(place) if files.exists(place) else []:
                if one.getPath().getName().partition("=")[2] not in names:
                    gone += folder == "data"
                    files.delete(one.getPath(), True)
        return gone
