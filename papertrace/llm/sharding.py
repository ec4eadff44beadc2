"""Shards along a Hilbert curve: near in metadata, near in the file.

Language, source and length are quantised to a grid; rows are ordered by the grid cell's place on a Hilbert
curve, and runs of near equal bytes are cut. A filter on any of the dimensions then misses most shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_of, unused
from .order import running_totals

#: Bits of each dimension.
BITS = 5
DIMENSIONS = 3


def _states() -> tuple[list[int], list[int]]:
    """The curve as an automaton over octants: for state * 8 + octant the digit, and the next state.

    A state is the curve's entry corner and direction; digit and next state follow from the Gray code."""
    n, size = DIMENSIONS, 1 << DIMENSIONS
    turn = lambda x, k: (x << k % n | x >> (n - k % n)) & (size - 1)
    gray = lambda i: i ^ i >> 1
    place = {gray(i): i for i in range(size)}
    ones = lambda i: ((i + 1) & -(i + 1)).bit_length() - 1  # noqa: E731  trailing ones
    digits, nexts = [], []
    for state in range(size * n):
        entry, way = divmod(state, n)
        for octant in range(size):
            w = place[turn(octant ^ entry, n - (way + 1) % n)]
            start = 0 if w == 0 else gray(2 * ((w - 1) // 2))
            step = 0 if w == 0 else ones(w - 1) % n if w % 2 == 0 else ones(w) % n
            digits.append(w)
            nexts.append((entry ^ turn(start, way + 1)) * n + (way + step + 1) % n)
    return digits, nexts


def hilbert(cells: list[Column], bits: int = BITS) -> Column:
    """The place on the Hilbert curve of a cell given by DIMENSIONS integers of `bits` bits. JVM only."""
    digits, nexts = (F.array(*map(F.lit, x)) for x in _states())
    cell = F.array(*(c.cast("int") for c in cells))

    def step(acc: Column, level: Column) -> Column:
        octant = sum((F.getbit(F.element_at(cell, k + 1), level).cast("int") * (1 << k) for k in range(1, len(cells))), F.getbit(F.element_at(cell, 1), level).cast("int"))
        at = acc["state"] * (1 << DIMENSIONS) + octant
        return F.struct(F.get(nexts, at).alias("state"), (acc["place"] * (1 << DIMENSIONS) + F.get(digits, at)).cast("long").alias("place"))

    levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.aggregate(levels, F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("place")), step)["place"]


#: Least size of each cell of the size dimension: 16 bytes times half powers of two.
SIZES = tuple(math.ceil(16 * 2 ** (k / 2)) for k in range(1 << BITS))


def _cuts(df: DataFrame, name: str, bits: int) -> DataFrame:
    """(cuts,), one row: the least name of each of up to 2 ** bits runs of equally many names, in order. Names are
    metadata, a row each: they fit a task; no more than 2 ** bits go on."""
    names = df.select(F.col(name).cast("string").alias("name")).where("name is not null").distinct()
    every = Window.partitionBy()
    cell = F.floor((F.row_number().over(Window.orderBy("name")) - 1) * (1 << bits) / F.greatest(F.count(F.lit(1)).over(every), F.lit(1 << bits)))
    least = names.withColumn("cell", cell).groupBy("cell").agg(F.min("name").alias("name"))
    return least.agg(F.array_sort(F.collect_list("name")).alias("cuts"))


def quantised(df: DataFrame, size: str, lang: str, source: str, out: list[str], bits: int = BITS) -> DataFrame:
    """df with its grid coordinates in columns `out`: languages and sources in order of names, each with a cell of
    its own up to 2 ** bits of them, runs of names beyond (null goes with the first); sizes by half powers of two."""
    (a, b), (of_lang, of_source) = unused(df, "_cuts_lang", "_cuts_source"), (lang, source)
    df = df.join(F.broadcast(_cuts(df, lang, bits).withColumnRenamed("cuts", a))).join(F.broadcast(_cuts(df, source, bits).withColumnRenamed("cuts", b)))  # one row each
    at = lambda cuts, name: F.greatest(F.lit(0), F.size(F.filter(cuts, lambda c: c <= F.col(name).cast("string"))) - 1)
    cell = F.greatest(F.lit(0), F.size(F.filter(F.array(*map(F.lit, SIZES)), lambda c: c <= F.col(size))) - 1)
    return df.withColumns({out[0]: at(a, of_lang), out[1]: at(b, of_source), out[2]: cell}).drop(a, b)


def shards(df: DataFrame, count: int = 40, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot) per row: all rows along the curve, cut into `count` runs
    of near equal size, where size is the text's UTF-8 bytes (null: none) plus 16.

    A row goes where its middle byte falls, so that a shard's size differs from the mean by less than the
    largest row. slot numbers a shard's rows along the curve from 0. Ties on the curve go by doc_id (null
    first), then by size and checksum; of fully equal rows the order doesn't matter. Fewer rows than shards
    leave some empty; an empty table has none. Other columns are ignored. JVM only."""
    size = (F.octet_length(text_of(text)) + 16).cast("long")
    rows = df.select(F.col(doc_id).alias("doc_id"), size.alias("size"), F.crc32(text_of(text)).cast("long").alias("text_crc32"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    rows = quantised(rows, "size", "lang", "source", ["_x", "_y", "_z"])
    rows = rows.select("doc_id", "size", "text_crc32", hilbert([F.col("_x"), F.col("_y"), F.col("_z")]).alias("curve"))
    run = running_totals(rows, ["curve", "doc_id", "size", "text_crc32"], "size", "_before", "_place")
    total = run.agg(F.sum("size").cast("double").alias("_total"))
    shard = F.least(F.lit(count - 1), F.floor((F.col("_before") + F.col("size") / 2) * count / F.col("_total"))).cast("int")
    run = run.join(F.broadcast(total)).withColumn("shard", shard)  # one row
    first = run.groupBy("shard").agg(F.min("_place").alias("_first"))  # a row per shard
    run = run.join(F.broadcast(first), "shard")
    return run.select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("_place") - F.col("_first")).cast("long").alias("slot"))


#: Columns that write() adds: what a row is ordered by, its place in its task, and its shard.
OWN = ("_size", "_crc32", "_curve", "_at", "_shard")


def write(df: DataFrame, path: str, count: int = 40, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> None:
    """Write df's rows with their texts as `count` Parquet files along the curve, cut as by shards(), to
    path/rows; and to path/bounds a row per file: rows, bytes, and least and greatest language, source, size
    and place on the curve, by which a filter picks files.

    df is read twice, and fully equal rows are told apart by their order of reading; its columns are kept as
    they are. No rows, no files. JVM only."""
    spark, (size, crc, curve, at, shard), (tie, cuts) = df.sparkSession, unused(df, *OWN), unused(df, "_tie", "_cuts")
    by = [curve, doc_id, size, crc, tie]
    rows = df.withColumns({size: (F.octet_length(text_of(text)) + 16).cast("long"), crc: F.crc32(text_of(text)).cast("long"), tie: F.monotonically_increasing_id()})
    cells = unused(rows, "_x", "_y", "_z")
    rows = quantised(rows, size, lang, source, cells)
    rows = rows.withColumn(curve, hilbert([F.col(c) for c in cells])).drop(*cells)
    run = running_totals(rows.select(*by), by, size, "_before", "_place")
    total = run.agg(F.sum(size).cast("double").alias("_total"))
    run = run.join(F.broadcast(total)).withColumn(shard, F.least(F.lit(count - 1), F.floor((F.col("_before") + F.col(size) / 2) * count / F.col("_total"))).cast("int"))
    first = run.groupBy(shard).agg(F.min(F.struct(*by)).alias("key"))  # a row per shard, at most `count`
    first = first.agg(F.array_sort(F.collect_list(F.struct(F.col(shard).alias("shard"), "key"))).alias(cuts))
    rows = rows.join(F.broadcast(first)).withColumn(shard, F.element_at(F.filter(cuts, lambda x: x["key"] <= F.struct(*by)), -1)["shard"]).drop(cuts)
    rows = rows.repartition(count, shard).sortWithinPartitions(shard, *by)
    rows = rows.withColumn(at, F.monotonically_increasing_id()).drop(tie)  # rises along a shard, which is in one task
    rows.write.partitionBy(shard).option("compression", "zstd").parquet(f"{path}/rows")
    back = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    ends = [f(F.col(c)).alias(f"{n}_{k}") for k, c in (("lang", lang), ("source", source), ("size", size), ("curve", curve)) for n, f in (("min", F.min), ("max", F.max))]
    back.groupBy(F.col(shard).alias("shard")).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"), F.min(at).alias("first"), *ends).coalesce(1).write.parquet(f"{path}/bounds")


def read(spark: SparkSession, path: str, of: DataFrame) -> DataFrame:
    """What write() wrote of a table with the columns of `of`: those, and shard and slot, the row's number along
    its shard's file from 0."""
    at, shard = unused(of, *OWN)[3:]
    rows = spark.read.schema(f"{', '.join(f'`{c}` {t}' for c, t in of.dtypes)}, `{at}` long, `{shard}` int").parquet(f"{path}/rows")
    bounds = spark.read.schema("shard int, first long").parquet(f"{path}/bounds").withColumnsRenamed({"shard": "_s", "first": "_f"})
    rows = rows.join(F.broadcast(bounds), F.col(shard) == F.col("_s"))  # a row per shard
    return rows.select(*of.columns, F.col("_s").alias("shard"), (F.col(at) - F.col("_f")).cast("long").alias("slot"))
