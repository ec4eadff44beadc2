"""Run records as they arrive: keyed upserts per micro-batch, last write wins.

The table lies in buckets by key. A micro-batch rewrites the buckets that it touches, next to the old ones, and
then commits a log entry that names the current version of each bucket; readers follow the newest entry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import upsert

#: Buckets of a table; fixed once it is begun.
BUCKETS = 32
_B = "_bucket"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _entries(spark: SparkSession, path: str) -> list[int]:
    """The committed log entries, oldest first."""
    p, fs = _fs(spark, f"{path}/log/*/_SUCCESS")
    return sorted(int(s.getPath().getParent().getName()) for s in fs.globStatus(p) or [])


def _versions(spark: SparkSession, path: str, entry: int) -> dict[int, int]:
    """bucket -> version, at most one per bucket."""
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").json(f"{path}/log/{entry}").collect()}


def _read(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame | None:
    return spark.read.parquet(*(f"{path}/v{v}/{_B}={b}" for b, v in sorted(versions.items()))) if versions else None


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path as the newest committed micro-batch left it; None before the first."""
    entries = _entries(spark, path)
    return _read(spark, path, _versions(spark, path, entries[-1])) if entries else None


def apply_batch(path: str, keys: list[str], order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merge a micro-batch into the table at path. A batch that is repeated after a failure
    finds its own entry missing, or does the same again; readers never see half of one. Versions that neither
    of the last two entries names are deleted."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        entries = [e for e in _entries(spark, path) if e < epoch]
        held = _versions(spark, path, entries[-1]) if entries else {}
        fresh = batch.withColumn(_B, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = [r[0] for r in fresh.select(_B).distinct().collect()]  # at most `buckets`
        if touched:
            old = _read(spark, path, {b: v for b, v in held.items() if b in touched})
            new = upsert(old if old is not None else batch.limit(0), fresh.drop(_B), keys, order)
            new = new.withColumn(_B, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).repartition(len(touched), _B)
            new.write.mode("overwrite").partitionBy(_B).parquet(f"{path}/v{epoch}")
        now = held | dict.fromkeys(touched, epoch)
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").json(f"{path}/log/{epoch}")
        fresh.unpersist()
        for v in set(_versions(spark, path, entries[-2]).values() if len(entries) > 1 else ()) - set(now.values()) - set(held.values()):
            p, fs = _fs(spark, f"{path}/v{v}")
            fs.delete(p, True)

    return merge


def upsert_stream(records: DataFrame, path: str, checkpoint: str, keys: list[str], order: str):
    """A query that keeps the table at path up to date with a stream of records."""
    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply_batch(path, keys, order)).trigger(availableNow=True).start()
