"""Token costs by longest-prefix price."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with in_per_mtok and out_per_mtok of the longest listed prefix of its model, null without one.

    Models, not usage rows, are matched: each distinct model's prefixes are joined by equality, so the cost
    doesn't grow with rows times prices."""
    models = usage.select("model").where("model is not null").distinct()
    prefix = models.select("model", F.explode(F.sequence(F.lit(1), F.length("model"))).alias("_n")).withColumn("_p", F.col("model").substr(F.lit(1), F.col("_n")))
    listed = prices.select(F.col("model").alias("_p"), "in_per_mtok", "out_per_mtok")
    best = prefix.join(listed, "_p").groupBy("model").agg(F.max_by(F.struct("in_per_mtok", "out_per_mtok"), "_n").alias("_b")).select("model", "_b.*")
    return usage.join(best, "model", "left")


def report(usage: DataFrame, prices: DataFrame, run: str = "run") -> DataFrame:
    """A row per run and, where there are several, one for all (run null): records, tokens, cost in dollars,
    whole means, and the models without a price, which cost 0 here and are named."""
    df = priced(usage, prices)
    cost = F.coalesce((F.col("input_tokens") * F.col("in_per_mtok") + F.col("output_tokens") * F.col("out_per_mtok")) / 1e6, F.lit(0.0))
    out = df.withColumn("_cost", cost).rollup(run).agg(
        F.count(F.lit(1)).alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.bround(F.sum("_cost"), 6).alias("cost"),
        F.avg("input_tokens").cast("long").alias("mean_input"), F.avg("output_tokens").cast("long").alias("mean_output"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("in_per_mtok").isNull(), F.col("model")))), ",").alias("unpriced"), F.grouping(run).alias("_all"), F.count_distinct(run).alias("_runs"),
    )
    return out.where("_all = 0 or _runs > 1").drop("_all", "_runs")
