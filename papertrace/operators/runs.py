"""Runs: jobs to do, extraction, records, dead runs."""

from __future__ import annotations

import time
import traceback
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_DPIS = (150, 300)
#: Resolutions that a corpus may have.
MOST_DPIS = 100


def jobs(index: DataFrame, dpis: tuple[int, ...] = (), only: tuple[str, ...] = (), skip: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """(doc_id, dpi, png, pdf, place): documents in the index's order by resolutions, filtered, the first
    `limit`. Resolutions: those asked for, else the index's, else DEFAULT_DPIS; one that a document has no
    rendering for is an error that names those it has."""
    wanted = F.array(*map(F.lit, dpis)) if dpis else F.when(F.size("dpis") > 0, F.col("dpis")).otherwise(F.array(*map(F.lit, DEFAULT_DPIS)))
    df = index.withColumn("_n", F.monotonically_increasing_id())
    df = df.where(F.col("doc_id").isin(*only)) if only else df
    df = df.where(~F.col("doc_id").isin(*skip)) if skip else df
    df = df.select("doc_id", "_n", "files", F.posexplode(wanted).alias("_d", "dpi"))
    file = F.try_element_at("files", F.col("dpi").cast("string"))
    known = F.array_join(F.array_sort(F.transform(F.map_keys("files"), lambda k: k.cast("int"))).cast("array<string>"), ", ")
    fail = F.raise_error(F.concat(F.col("doc_id"), F.lit(" has no rendering at "), F.col("dpi").cast("string"), F.lit(" dpi, only at "), known))
    df = df.select("doc_id", "dpi", F.coalesce(file, fail.cast(index.schema["files"].dataType.valueType)).alias("f"), "_n", "_d").orderBy("_n", "_d")
    df = df.limit(limit) if limit is not None else df
    return df.select("doc_id", "dpi", "f.png", "f.pdf")


def cross_jobs(docs: DataFrame, dpis: DataFrame) -> DataFrame:
    """Every document at every resolution, in the document's own row: dpis is a short list of resolutions (at most
    MOST_DPIS rows are read of it, more are an error), so nothing is joined."""
    few = [r[0] for r in dpis.limit(MOST_DPIS + 1).collect()]
    if len(few) > MOST_DPIS:
        raise ValueError(f"more than {MOST_DPIS} resolutions")
    return docs.withColumn(dpis.columns[0], F.explode(F.array(*(F.lit(d) for d in few)) if few else F.array().cast("array<int>")))


def extract(jobs: DataFrame, parser: str, fn: Callable[[dict], object]) -> DataFrame:
    """(parser, doc_id, dpi, seconds, chars, error, text, trace, model, input_tokens, output_tokens, stop): fn over
    each job, a row at a time in Python workers. An exception is the record's error (type and message) and does
    not end the run. fn returns the text, or (text, usage) with usage's model, input_tokens, output_tokens and
    stop; an exception may carry its usage in an attribute of that name, so that what failed is paid for too."""
    used = ("model", "input_tokens", "output_tokens", "stop")

    def work(batches):
        for pdf in batches:
            out = []
            for job in pdf.to_dict("records"):
                began, text, error, trace, usage = time.perf_counter(), None, None, None, {}
                try:
                    said = fn(job)
                    text, usage = said if isinstance(said, tuple) else (said, {})
                except Exception as e:
                    error, trace, usage = f"{type(e).__name__}: {e}", traceback.format_exc(), getattr(e, "usage", {})
                out.append((parser, job["doc_id"], job["dpi"], time.perf_counter() - began, None if text is None else len(text), error, text, trace, *(usage.get(k) for k in used)))
            cols = ["parser", "doc_id", "dpi", "seconds", "chars", "error", "text", "trace", *used]
            yield pd.DataFrame(out, columns=cols).astype({"chars": "Int64", "input_tokens": "Int64", "output_tokens": "Int64"})

    return jobs.mapInPandas(work, "parser string, doc_id string, dpi int, seconds double, chars long, error string, text string, trace string, model string, input_tokens long, output_tokens long, stop string")


def usage_of(records: DataFrame) -> DataFrame:
    """What extract() recorded of tokens: (doc_id, dpi, model, input_tokens, output_tokens, stop)."""
    return records.where("model is not null").select("doc_id", "dpi", "model", "input_tokens", "output_tokens", "stop")


def live(records: DataFrame) -> DataFrame:
    """Records without an error."""
    return records.where("coalesce(error, '') = ''")


def failed(records: DataFrame, run: str = "parser") -> DataFrame:
    """(run, n_failed, first_error): runs with records that carry an error, how many, and the first one's first
    line, 60 characters at most, as a report shows it."""
    bad = records.where("coalesce(error, '') <> ''")
    first = F.min(F.struct("doc_id", "dpi", F.substring(F.substring_index("error", "\n", 1), 1, 60).alias("e")))["e"]
    return bad.groupBy(run).agg(F.count(F.lit(1)).alias("n_failed"), first.alias("first_error"))


def version_of(said: Column, name: str) -> Column:
    """A tool's version from what it prints of itself: the first dotted number after its name, else null."""
    return F.nullif(F.regexp_extract(said, rf"(?i){name}[^0-9\n]*([0-9]+(?:\.[0-9]+)+)", 1), F.lit(""))


def dead_runs(pages: DataFrame, run: str = "parser") -> DataFrame:
    """(run, n_pages) of runs whose live pages all came back blank: nothing was read, which is no result. A
    blank page among others is one."""
    text = F.coalesce(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))
    return live(pages).groupBy(run).agg(F.bool_or(text).alias("_any"), F.count(F.lit(1)).alias("n_pages")).where("not _any").drop("_any")


def without_dead(pages: DataFrame, run: str = "parser") -> DataFrame:
    return live(pages).join(dead_runs(pages, run), run, "left_anti")


def page_class(index: DataFrame, images: str = "images") -> DataFrame:
    """index (with image sizes and text_layer_chars) with page_backed and layer: of more than 100 characters, ocr
    under a page image, else typeset; none up to 100."""
    backed = F.coalesce(F.exists(images, lambda i: (i["width"] > 1000) & (i["height"] > 1000)), F.lit(False))
    layer = F.when(F.coalesce("text_layer_chars", F.lit(0)) <= 100, "none").when(backed, "ocr").otherwise("typeset")
    return index.withColumn("page_backed", backed).withColumn("layer", layer)


def image_size(width: Column, height: Column, edge: int = 2576) -> Column:
    """(width, height) of an image shrunk so that its long edge fits, each rounded half to even; an image that
    fits stays as it is."""
    k = image_scale(width, height, edge)
    return F.struct(F.bround(width * k).cast("int").alias("width"), F.bround(height * k).cast("int").alias("height"))


def image_scale(width: str = "width", height: str = "height", edge: int = 2576):
    """What to shrink an image by so that its long edge fits."""
    return F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest(width, height))
