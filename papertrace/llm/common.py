"""Shared plumbing: table access, shared scratch space, lineage cuts."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import folder as scratch
from ..sources.scratch import put

#: What the contracts call a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts may be long: rows, and bytes, that a Python worker is handed at once.
BATCH_ROWS, BATCH_BYTES = 1000, 64 << 20
_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()
_stored: list[str] = []


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: its source goes to the shared folder and from there to every
    executor, once per application; and bound what a worker is handed at once."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        data, name = io.BytesIO(), os.path.basename(_PACKAGE)
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for at, _, files in os.walk(_PACKAGE):
                for f in files:
                    if f.endswith(".py"):
                        z.write(os.path.join(at, f), os.path.join(name, os.path.relpath(os.path.join(at, f), _PACKAGE)))
        path = f"{scratch(spark)}.zip"
        put(spark, path, data.getvalue())
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, through Spark's reader only (the path may be in a store)."""
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and any executor
    can read it again after another is lost."""
    spark = df.sparkSession
    path = scratch(spark)
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    _stored.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _stored:
        _stored.remove(path)


def drop(df: DataFrame | None) -> None:
    """Delete what cut() wrote for df, once nothing reads it any more."""
    path = getattr(df, "_scratch", None)
    if path:
        _delete(df.sparkSession, path)


def stored() -> list[str]:
    """What cut() has stored in this process and nothing has deleted yet."""
    return list(_stored)


def clear(spark: SparkSession, but: list[str] | None = None, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete all that cut() has stored but for the paths of `but` and what `keep` reads: for when results that were
    made of it have been stored themselves, or are no longer wanted."""
    kept = {*(but or ()), *(getattr(d, "_scratch", None) for d in keep)}
    for path in [p for p in _stored if p not in kept]:
        _delete(spark, path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), 0)


def text_of(col: str | Column) -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def n_words(col: str | Column) -> Column:
    """The number of words of a text, null: 0. JVM only."""
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")
