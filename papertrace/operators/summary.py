"""Counts and rates over verdicts, in two levels of partial aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_counts(verdicts: DataFrame, keys: tuple[str, ...] = ("parser", "doc_id", "dpi")) -> DataFrame:
    """Per page: fields by status, typed look-alikes, rows with a line of their own."""
    n = lambda s: F.count_if(F.col("status") == s)
    return verdicts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_fields"), n("OK").alias("ok"), n("CORRUPT").alias("corrupt"), n("ABSENT").alias("absent"), n("MISPLACED").alias("misplaced"),
        F.count_if((F.col("status") == "CORRUPT") & F.col("typed")).alias("corrupt_typed"), F.max("rows_anchored").alias("rows_anchored"), F.max("n_rows").alias("n_rows"),
    )


def rate(part: Column, whole: Column) -> Column:
    """part / whole to four places, half to even."""
    return F.bround(part / whole, 4)


def summarise(pages: DataFrame, keys: tuple[str, ...] = ("parser", "dpi")) -> DataFrame:
    """Per run and resolution: recovery (0 without fields) and the quiet share of misses (null without
    misses): look-alikes that would pass for values, and values in the wrong row."""
    s = pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), F.sum("n_fields").alias("fields"), *(F.sum(c).alias(c) for c in ("ok", "corrupt", "absent", "misplaced", "corrupt_typed", "rows_anchored")), F.sum("n_rows").alias("rows"))
    miss = F.col("corrupt") + F.col("absent") + F.col("misplaced")
    return (
        s.withColumn("corrupt_junk", F.col("corrupt") - F.col("corrupt_typed"))
        .withColumn("recovery", F.when(F.col("fields") > 0, rate(F.col("ok"), F.col("fields"))).otherwise(0.0))
        .withColumn("quiet_fraction", F.when(miss > 0, rate(F.col("corrupt_typed") + F.col("misplaced"), miss)))
    )


def mean_seconds(records: DataFrame, keys: tuple[str, ...] = ("parser", "dpi")) -> DataFrame:
    """Mean duration of the records without an error."""
    return records.where("coalesce(error, '') = ''").groupBy(*keys).agg(F.bround(F.avg("seconds"), 2).alias("seconds_per_page"))


def recovery_pivot(pages: DataFrame, parsers: list[str]) -> DataFrame:
    """A row per document, and one for all (doc_id null): recovery in percent per parser."""
    share = lambda p: F.bround(100.0 * F.sum(F.when(F.col("parser") == p, F.col("ok"))) / F.sum(F.when(F.col("parser") == p, F.col("n_fields"))), 1)
    return pages.rollup("doc_id").agg(*(share(p).alias(p) for p in parsers))


def shown(summary: DataFrame) -> DataFrame:
    """(parser, dpi, recovered, quiet): rates as a table shows them, in percent; "-" where nothing was missed."""
    return summary.select(
        "parser", "dpi", F.when(F.col("fields") > 0, F.format_string("%.1f%%", F.bround(100.0 * F.col("ok") / F.col("fields"), 1))).otherwise("0.0%").alias("recovered"),
        F.coalesce(F.format_string("%d%%", F.bround(100 * F.col("quiet_fraction")).cast("int")), F.lit("-")).alias("quiet"),
    )
