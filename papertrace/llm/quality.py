"""Quality rules whose cutoffs follow the corpus.

Each text gets a few counts. Per language and source, mergeable quantile sketches (the summaries behind
approx_percentile: built per task, merged on the way) give the median and the 90th percentile of each rate, and
the group's fence lies beyond the latter by REACH times their distance. The same rollup merges the groups'
sketches into one per language and one of all; each fence is drawn towards the next wider one by the weight of
PRIOR texts, so that a source with few texts leans on its language, by one formula at every size. No rate has a
cutoff of its own: what is added to a fence is only what chance does to a rate that is measured on few units.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ready, text_of, unused

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: rate -> (count, units it is measured on)
RATES = {
    "symbol_rate": ("n_symbols", "word_chars"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
    "repeat_rate": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}
#: Fence: the 90th percentile plus so many times its distance from the median.
REACH = 2.0
#: Texts whose weight the next wider level has in a group's fence.
PRIOR = 100.0
#: Standard errors that a text's own rate may lie beyond the fence.
ERRORS = 4.0
#: Of the sketches: relative rank error 1 / ACCURACY.
ACCURACY = 10_000


def _count(data: bytes) -> tuple[int, ...]:
    words = data.split()  # bytes.split() parts at exactly \x20 and \x09-\x0D
    solid = b"".join(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeat, n = 0, len(words)
    if n > 3:
        code: dict[bytes, int] = {}
        w = np.fromiter((code.setdefault(x, len(code)) for x in words), np.int64, n)
        k = len(code)
        if len(code) < n and k < 2_000_000:
            _, inverse, times = np.unique((w[:-2] * k + w[1:-1]) * k + w[2:], return_inverse=True, return_counts=True)
        elif len(code) < n:
            _, pair = np.unique(w[:-1] * k + w[1:], return_inverse=True)
            _, inverse, times = np.unique(pair[:-1] * k + w[2:], return_inverse=True, return_counts=True)
        else:
            times = None
        if times is not None:
            again = times[inverse] > 1
            covered = np.zeros(n, dtype=bool)
            for d in range(3):
                covered[d : n - 2 + d] |= again
            repeat = int(covered.sum())
    return n, len(solid.decode("utf-8")), sum(map(solid.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"))), len(lines) - len(set(lines)), repeat, len(lines)


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the six counts of each whole text (null: as empty, all 0) and base_failed."""
    ready(df.sparkSession)

    @F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS]))
    def measured(a: pa.Array) -> pa.Array:
        rows = [_count(x.as_py()) for x in a.cast(pa.binary())]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(_COUNTS))], names=list(_COUNTS))

    own = unused(df, "_counts")[0]
    df = df.withColumn(own, measured(text_of(text)))
    df = df.withColumns({c: F.col(own)[c] for c in _COUNTS})
    return df.drop(own).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def rate(name: str) -> Column:
    count, units = RATES[name]
    return F.col(count) / F.greatest(F.col(units), F.lit(1)).cast("double")


def thresholds(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(_lang, _source, n_texts, fence_<rate> ...): the fence of each rate for each language and source that has a
    text that passes the base rules; only those shape it. Nulls are a language or a source of their own."""
    base = counted.where(~F.col("base_failed")).select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), *(rate(r).alias(r) for r in RATES))
    sketch = [F.percentile_approx(r, F.array(F.lit(0.5), F.lit(0.9)), F.lit(ACCURACY)).alias(r) for r in RATES]
    rolled = base.rollup("_lang", "_source").agg(F.grouping_id().alias("_level"), F.count(F.lit(1)).alias("n_texts"), *sketch)
    rolled = cut(rolled.select("_level", "_lang", "_source", "n_texts", *((F.col(r)[1] + REACH * (F.col(r)[1] - F.col(r)[0])).alias(f"fence_{r}") for r in RATES)))
    names = [f"fence_{r}" for r in RATES]
    wide = lambda level, name: rolled.where(F.col("_level") == level).select(*(["_lang"] if level == 1 else []), F.struct("n_texts", *names).alias(name))
    out = rolled.where("_level = 0").join(wide(1, "_l").withColumnRenamed("_lang", "_l1"), F.col("_lang").eqNullSafe(F.col("_l1"))).join(wide(3, "_a"))  # one row
    towards = lambda n, own, wider: (n * own + PRIOR * wider) / (n + PRIOR)
    return out.select("_lang", "_source", "n_texts", *(towards(F.col("n_texts"), F.col(f), towards(F.col("_l")["n_texts"], F.col("_l")[f], F.col("_a")[f])).alias(f) for f in names))


def verdict(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """counted (what counts() gave, cheap to read twice) with kept, by a join with the fences."""
    names, (of_lang, of_source, limit) = [f"fence_{r}" for r in RATES], unused(counted, "_lang", "_source", "_limit")
    own = thresholds(counted, lang, source).select(F.col("_lang").alias(of_lang), F.col("_source").alias(of_source), F.struct(*names).alias(limit))
    out = counted.join(own, F.col(lang).eqNullSafe(F.col(of_lang)) & F.col(source).eqNullSafe(F.col(of_source)), "left").drop(of_lang, of_source)
    beyond = F.lit(False)
    for r, (_, units) in RATES.items():
        fence, n = F.col(limit)[f"fence_{r}"], F.greatest(F.col(units), F.lit(1)).cast("double")
        share = F.least(fence, F.lit(1.0))  # a mean length varies at most as a share does, by its chance part
        beyond = beyond | F.coalesce(rate(r) > fence + ERRORS * F.sqrt(share * (1.0 - share) / n) + ERRORS * ERRORS / n, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~beyond).drop(limit)


def judge(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """df with the counts, base_failed and kept.

    kept is false if base_failed, else true if no rate lies beyond the fence of the text's language and source
    by more than ERRORS standard errors of a rate like the fence on as many units. Null and empty texts fail the
    base rules; a text of any length is counted whole; equal texts of a group share a verdict; repeated rows
    count as often as they stand; an empty table stays empty. Columns named as the counts are replaced, all
    others pass."""
    return verdict(cut(counts(df, text).drop("kept")), lang, source)


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for op4_quality. Its quantiles are exact, as the sketches are of up to ACCURACY / 2 texts a group."""
    quantiles = ", ".join(f"list_sort(list({r}))[CAST(ceil(CAST({p} AS DOUBLE) * count(*)) AS INT)] AS q{q}_{r}" for r in RATES for p, q in ((0.5, 50), (0.9, 90)))
    fences = ", ".join(f"q90_{r} + {REACH} * (q90_{r} - q50_{r}) AS {r}" for r in RATES)
    shrunk = ", ".join(f"(g.n * g.{r} + {PRIOR} * ((l.n * l.{r} + {PRIOR} * a.{r}) / (l.n + {PRIOR}))) / (g.n + {PRIOR}) AS {r}" for r in RATES)
    rates = ", ".join(f"{c} / CAST(greatest({u}, 1) AS DOUBLE) AS {r}" for r, (c, u) in RATES.items())
    beyond = " OR ".join(f"b.{r} > f.{r} + {ERRORS} * sqrt(least(f.{r}, 1.0::DOUBLE) * (1.0::DOUBLE - least(f.{r}, 1.0::DOUBLE)) / CAST(greatest({u}, 1) AS DOUBLE)) + {ERRORS * ERRORS} / CAST(greatest({u}, 1) AS DOUBLE)" for r, (_, u) in RATES.items())
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, row_number() OVER () AS rid FROM {table}),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM d),
tri AS (SELECT rid, g, count(*) AS n, list(i) AS places FROM (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS g FROM w) GROUP BY rid, g HAVING n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, unnest(places) AS i FROM tri), (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
c AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {rates} FROM c),
ok AS (SELECT * FROM b WHERE NOT base_failed),
a AS (SELECT n, {fences} FROM (SELECT count(*) AS n, {quantiles} FROM ok)),
l AS (SELECT lang, n, {fences} FROM (SELECT lang, count(*) AS n, {quantiles} FROM ok GROUP BY lang)),
g AS (SELECT lang, source, n, {fences} FROM (SELECT lang, source, count(*) AS n, {quantiles} FROM ok GROUP BY lang, source)),
f AS (SELECT g.lang, g.source, {shrunk} FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({beyond}, false) AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""
