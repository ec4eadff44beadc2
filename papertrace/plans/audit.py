"""The audit end to end, from files to results; every plan is lazy but for the label gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cost as costs
from ..operators import match, rules, runs, summary
from ..sources import readers, sinks


def run_pages(spark: SparkSession, out: str, parser: str | None = None) -> DataFrame:
    """Records of all runs with their texts."""
    records = readers.manifests(spark, out, parser)
    return records.join(readers.texts(spark, out), ["parser", "text_file"], "left")


def grade(spark: SparkSession, corpus: str, out: str, parser: str | None = None, truth_dir: str | None = None, prose_parens: bool = False) -> DataFrame:
    """Verdicts of every labelled value on every live page of every run that read anything. A page without labels
    is an error that names it."""
    truth = readers.truth(spark, corpus, truth_dir)
    pages = runs.without_dead(run_pages(spark, out, parser)).select("parser", "doc_id", "dpi", F.coalesce("text", F.lit("")).alias("text"))
    unknown = pages.join(truth, "doc_id", "left_anti").select("doc_id").distinct().limit(5).collect()
    if unknown:
        raise KeyError(f"no labels for {sorted(r.doc_id for r in unknown)}")
    return match.verdicts(pages, truth, prose_parens=prose_parens)


def summarise(spark: SparkSession, verdicts: DataFrame, out: str) -> DataFrame:
    """Counts, rates and mean seconds per run and resolution."""
    s = summary.summarise(summary.page_counts(verdicts))
    return s.join(summary.mean_seconds(readers.manifests(spark, out)), ["parser", "dpi"], "left")


def store(spark: SparkSession, verdicts: DataFrame, out: str, path: str) -> None:
    """Write the report of a grading, which stored() reads back."""
    sinks.write_scores(verdicts, readers.manifests(spark, out), summarise(spark, verdicts, out), path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The verdicts of a stored report, None where there is none."""
    return readers.scores(spark, f"{path}/pages")


def reconcile(spark: SparkSession, corpus: str, verdicts: DataFrame | None = None, cross: str | None = None) -> DataFrame:
    """Rule results of every run; without verdicts those of the labels. Labels are checked first, and nothing
    is judged by labels that break their own rules."""
    truth = readers.truth(spark, corpus)
    spoken = rules.terms(truth, readers.identities(spark, cross) if cross else None)
    own = rules.judge(rules.seen(spoken, None))
    rules.gate(own)
    return own if verdicts is None else rules.judge(rules.seen(spoken, verdicts))


def price(spark: SparkSession, prices: list[tuple[str, float, float]], *globs: str) -> DataFrame:
    """Costs of all runs that left usage files."""
    return costs.report(readers.usage(spark, *globs), readers.prices(spark, prices))
