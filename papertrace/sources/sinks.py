"""Writers: long tables as Parquet, nested reports as JSON, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _free(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def upsert(old: DataFrame, fresh: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with fresh's rows in place of those of equal keys (nulls equal each other). Of several fresh rows
    with one key the last by `order` stays; without it they all do."""
    if order:
        n = _free(fresh, "_n")
        last = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last())
        fresh = fresh.withColumn(n, F.row_number().over(last)).where(F.col(n) == 1).drop(n)
    own = {k: _free(old, f"_{k}") for k in keys}
    theirs = fresh.select(*(F.col(k).alias(own[k]) for k in keys)).distinct()
    match = [F.col(k).eqNullSafe(F.col(own[k])) for k in keys]
    return old.join(theirs, match, "left_anti").unionByName(fresh, allowMissingColumns=True)


def pages(verdicts: DataFrame) -> DataFrame:
    """(parser, doc_id, dpi, n_fields, ok, corrupt, absent, misplaced, corrupt_typed, rows_anchored, n_rows,
    fields): a row per page, its verdicts in a map by field."""
    n = lambda s: F.count_if(F.col("status") == s)
    field = F.struct("printed", "status", "got", "distance", "typed")
    return verdicts.groupBy("parser", "doc_id", "dpi").agg(
        F.count(F.lit(1)).alias("n_fields"), n("OK").alias("ok"), n("CORRUPT").alias("corrupt"), n("ABSENT").alias("absent"), n("MISPLACED").alias("misplaced"),
        F.count_if((F.col("status") == "CORRUPT") & F.col("typed")).alias("corrupt_typed"), F.max("rows_anchored").alias("rows_anchored"), F.max("n_rows").alias("n_rows"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", field)))).alias("fields"),
    )


def runs(records: DataFrame, summary: DataFrame) -> DataFrame:
    """(parser, version, source, errors, by_dpi): a row per run, also of one that only failed: its failed
    records, and its counts and rates by resolution."""
    bad = F.coalesce("error", F.lit("")) != ""
    error = F.struct("doc_id", "dpi", "seconds", "chars", "error", "text_file")
    run = records.groupBy("parser").agg(F.max("version").alias("version"), F.max("source").alias("source"), F.array_sort(F.collect_list(F.when(bad, error))).alias("errors"))
    rest = [c for c in summary.columns if c not in ("parser", "dpi")]
    dpi = summary.groupBy("parser").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("dpi").cast("string"), F.struct(*rest))))).alias("by_dpi"))
    return run.join(dpi, "parser", "left")


def write_scores(verdicts: DataFrame, records: DataFrame, summary: DataFrame, path: str) -> None:
    """The report of a grading: JSON rows of pages (path/pages) and of runs (path/runs). A page is a row, so
    that no run's pages gather in one."""
    write_json(pages(verdicts), f"{path}/pages")
    write_json(runs(records, summary), f"{path}/runs")


def write_rules(results: DataFrame, path: str) -> None:
    """The report of the rules: JSON rows of results, in a folder per parser."""
    results.write.mode("overwrite").partitionBy("parser").json(path)


def write_usage(usage: DataFrame, path: str) -> None:
    """Tokens per page, in place of what an earlier run left: usage is not merged."""
    write_json(usage.select("doc_id", F.col("dpi").cast("int").alias("dpi"), "model", F.col("input_tokens").cast("long").alias("input_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"), "stop"), path)


def corpus_index(documents: DataFrame, dpis: tuple[int, ...]) -> DataFrame:
    """(n, dpis, documents): the index of a corpus, one row. documents has doc_id, note, source,
    text_layer_chars, text_layer_source, scanned; each gets its file names by resolution. It has a row per
    document of a hand-labelled corpus, and fits a task as the file it becomes does."""
    files = F.map_from_entries(F.array(*(F.struct(F.lit(str(d)), F.struct(F.concat("doc_id", F.lit(f"_{d}.png")).alias("png"), F.concat("doc_id", F.lit(".pdf")).alias("pdf"))) for d in dpis)))
    d = documents.select("doc_id", "note", "source", "text_layer_chars", "text_layer_source", "scanned", files.alias("files"))
    return d.agg(F.count(F.lit(1)).cast("int").alias("n"), F.array(*map(F.lit, dpis)).alias("dpis"), F.array_sort(F.collect_list(F.struct(*d.columns)), lambda a, b: F.when(a["doc_id"] < b["doc_id"], -1).when(a["doc_id"] > b["doc_id"], 1).otherwise(0)).alias("documents"))


def write_index(documents: DataFrame, dpis: tuple[int, ...], path: str) -> None:
    corpus_index(documents, dpis).coalesce(1).write.mode("overwrite").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Parquet, in folders by the given columns, so that readers of one run prune the others."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)
