"""Matching printed values to extracted text, whole pages at a time, with higher-order functions.

A page keeps its lines and tokens as arrays with all normal forms computed once: each step is bound to a lambda
variable, so that the optimiser can't put it in place of every use. Fields are matched inside the page's row by
look-ups in arrays of strings, so nothing is shuffled per field; only misses are taken apart further.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T

#: Lines of a row's block at most.
BLOCK = 4


def token_forms(line: Column, prose_parens: bool = False) -> Column:
    """The tokens of a line with the forms in which they may match. With prose_parens a sum in dollars that
    parentheses wrap is an aside, not a loss."""

    def canon(t: Column) -> Column:
        if not prose_parens:
            return T.canon(t)
        return T.canon(F.when(t.rlike(T.NEGATIVE) & F.contains(t, F.lit("$")), F.translate(t, "()", "")).otherwise(t))

    return F.transform(T.tokens(line), lambda t: F.struct(t.alias("raw"), F.lower(t).alias("low"), T.nocomma(F.lower(t)).alias("bare"), canon(t).alias("canon")))


def value_forms(printed: Column, folded: Column) -> Column:
    """A printed value with the forms in which it may match; `folded` is fold(printed)."""
    return F.struct(
        printed.alias("printed"), F.lower(printed).alias("low"), T.nocomma(F.lower(printed)).alias("bare"), T.canon(printed).alias("canon"),
        F.lower(F.btrim(F.regexp_replace(folded, r"(?U)[\s\x1c-\x1f]+", " "))).alias("part"), T.is_multiword(printed).alias("multi"), T.is_numeric(printed).alias("numeric"),
    )


def scope(lows: Column, toks: Column) -> Column:
    """What values are looked for in: lines in lower case, the forms of their tokens as arrays of strings, and
    for each token what it and the next one, two or three add up to (at the end of the scope, what is left)."""
    forms = {n: F.transform(toks, lambda t: t[n]) for n in ("low", "bare", "canon")}  # noqa: B023
    joined = lambda c, k: F.transform(c, lambda x, i: F.concat(x, *(F.coalesce(F.get(c, i + j), F.lit("")) for j in range(1, k + 1))))
    return T.bind(forms["canon"], lambda c: F.struct(lows.alias("lows"), forms["low"].alias("low"), forms["bare"].alias("bare"), c.alias("canon"), *(joined(c, k).alias(f"canon{k + 1}") for k in (1, 2, 3))))


def within(s: Column, lo: Column, n: Column, at: Column, m: Column) -> Column:
    """The part of scope s with `n` lines from line `lo` (from 0), whose `m` tokens begin at token `at`."""
    cut = lambda name, less: F.slice(s[name], at + 1, F.greatest(m - less, F.lit(0))).alias(name)
    return F.struct(F.slice(s["lows"], lo + 1, n).alias("lows"), cut("low", 0), cut("bare", 0), cut("canon", 0), cut("canon2", 1), cut("canon3", 2), cut("canon4", 3))


def concat_match(canon: Column, s: Column) -> Column:
    """Whether two to four adjacent tokens of scope s add up to a figure of at least four digits: regrouped
    digits."""
    return (F.length(F.ltrim(canon, F.lit("-"))) >= 4) & (F.array_contains(s["canon2"], canon) | F.array_contains(s["canon3"], canon) | F.array_contains(s["canon4"], canon))


def token_match(v: Column, s: Column) -> Column:
    own = F.array_contains(s["canon"], v["canon"]) | F.array_contains(s["low"], v["low"]) | F.array_contains(s["bare"], v["bare"])
    return own | (v["numeric"] & concat_match(v["canon"], s))


def substr_match(v: Column, lows: Column) -> Column:
    return F.exists(lows, lambda x: F.contains(x, v["part"]))


def found(v: Column, s: Column) -> Column:
    """Whether a value stands in the lines or tokens of scope s."""
    return F.coalesce(F.when(v["multi"], substr_match(v, s["lows"])).otherwise(token_match(v, s)), F.lit(False))


def _lines(page: Column, lo: Column, n: Column) -> Column:
    """The scope of `n` lines of a page from line `lo`."""
    at = F.get(page["off"], lo)
    return within(page["scope"], lo, n, at, F.get(page["off"], F.least(lo + n, F.size(page["lines"]))) - at)


def anchors(rows: Column, page: Column) -> Column:
    """For each table row, in order, the line (from 0) that it starts at, or -1: of the lines not yet taken
    that hold its anchor the first of those whose window of BLOCK lines holds most of its other cells."""
    every = F.when(F.size(page["lines"]) > 0, F.sequence(F.lit(0), F.size(page["lines"]) - 1)).otherwise(F.array().cast("array<int>"))

    def one(used: Column, row: Column) -> Column:
        cells = F.filter(row["cells"], lambda c: c["printed"] != row["anchor"]["printed"])
        here = F.filter(every, lambda n: ~F.array_contains(used, n) & found(row["anchor"], _lines(page, n, F.lit(1))))
        score = lambda n: T.bind(_lines(page, n, F.lit(BLOCK)), lambda w: F.size(F.filter(cells, lambda c: found(c, w))))
        best = T.bind(here, lambda h: F.when(F.size(h) > 1, -F.array_max(F.transform(h, lambda n: F.struct(score(n).alias("s"), (-n).alias("n"))))["n"]).otherwise(F.get(h, 0)))
        # a row whose anchor stands nowhere on the page has no line to look for
        return F.concat(used, F.array(F.when(found(row["anchor"], page["scope"]), F.coalesce(best, F.lit(-1))).otherwise(F.lit(-1))))

    return F.aggregate(rows, F.array().cast("array<int>"), one)


def blocks(taken: Column, n_lines: Column) -> Column:
    """For each row (from, length) of its block: up to the next row's line, BLOCK lines at most; length 0
    where it has no line."""
    nxt = lambda t, n: F.array_min(F.filter(t, lambda m: m > n))
    size = lambda t, n: F.greatest(F.lit(1), F.least(F.coalesce(nxt(t, n), n_lines), n_lines, n + BLOCK) - n)
    return T.bind(taken, lambda t: F.transform(t, lambda n: F.struct(F.greatest(n, F.lit(0)).alias("lo"), F.when(n < 0, 0).otherwise(size(t, n)).alias("len"))))


@F.arrow_udf(ArrayType(StringType()))
def mask_claimed(lines: pa.Array, others: pa.Array) -> pa.Array:
    """Lines with every stretch that is another value blanked by NUL, character for character."""

    def one(line: str, values: list[str]) -> str:
        low, keep = line.lower(), list(line)
        if len(low) != len(line):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in line)
        for v in values:
            if len(v) < 3:
                continue
            at = low.find(v)
            while at >= 0:
                keep[at : at + len(v)] = "\0" * len(v)
                at = low.find(v, at + len(v))
        return "".join(keep)

    return pa.array([None if x is None else [one(s, v or []) for s in x] for x, v in zip(lines.to_pylist(), others.to_pylist())], pa.list_(pa.string()))


def nearest_token(v: Column, toks: Column, claimed: Column) -> Column:
    """(d, pos, raw) of the first token nearest to a value by edit distance, among those of nearly its length
    that are no other field's value."""
    near = F.filter(toks, lambda t: (t["canon"] != "") & (F.abs(F.length(t["canon"]) - F.length(v["canon"])) <= 1) & ~F.array_contains(claimed, t["canon"]))
    return _nearest(v, near)


def _nearest(v: Column, near: Column) -> Column:
    return F.array_min(F.transform(near, lambda t, i: F.struct(F.levenshtein(t["canon"], v["canon"]).alias("d"), i.alias("pos"), t["raw"].alias("raw"))))


def nearest_window(v: Column, lines: Column, masked: Column) -> Column:
    """(d, raw) of the first stretch of a value's length nearest to it, among those with a character that is
    no other field's; null without one. The least distance so far bounds the next comparison."""
    width = F.length(v["printed"])
    none = F.struct(F.lit(1 << 30).alias("d"), F.lit(None).cast("string").alias("raw"))

    def better(line: Column, best: Column, s: Column) -> Column:
        raw = F.substring(line, s + 1, width)
        d = lambda r: F.call_function("levenshtein", F.lower(r), v["low"], best["d"] - 1)
        return T.bind(raw, lambda r: T.bind(d(r), lambda n: F.when(n >= 0, F.struct(n.alias("d"), r.alias("raw"))).otherwise(best)))

    def of_line(best: Column, pair: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(pair["line"]) - width))
        own = F.filter(starts, lambda s: F.translate(F.substring(pair["masked"], s + 1, width), "\0 \t", "") != "")
        return F.aggregate(own, best, lambda acc, s: F.when(acc["d"] == 0, acc).otherwise(better(pair["line"], acc, s)))

    pairs = F.zip_with(lines, masked, lambda x, m: F.struct(x.alias("line"), m.alias("masked")))
    return T.bind(F.aggregate(pairs, none, of_line), lambda w: F.when(w["raw"].isNotNull(), w))


def claimed_forms(values: Column, canon_parts: Column) -> Column:
    """Every form of every value of a document, and of the words of more than one letter inside them."""
    forms = F.flatten(F.transform(values, lambda v: F.array(v["low"], v["bare"], v["canon"])))
    return F.array_distinct(F.concat(forms, canon_parts))


def labels(truth: DataFrame) -> DataFrame:
    """(doc_id, fields, rows, claimed) per label document: fields in order with their forms and row, rows with
    anchor and cells, and what the document claims. truth has doc_id, printed and rows."""
    entries = lambda m: F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>")))
    rows = F.coalesce("rows", F.array().cast("array<struct<key:string,anchor:string,cells:map<string,string>>>"))
    scalar = F.transform(entries(F.col("printed")), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("printed"), F.lit(-1).alias("row")))
    cells = F.flatten(F.transform(rows, lambda r, i: F.transform(entries(r["cells"]), lambda e: F.struct(F.concat(F.lit("rows["), i.cast("string"), F.lit("]."), e["key"]).alias("field"), e["value"].alias("printed"), i.alias("row")))))
    flat = truth.select("doc_id", rows.alias("rows"), F.concat(scalar, cells).alias("fields"))
    # values, once each, through the one Python step
    values = flat.select(F.explode(F.concat(F.transform("fields", lambda f: f["printed"]), F.transform("rows", lambda r: r["anchor"]))).alias("printed")).distinct()
    forms = values.select("printed", value_forms(F.col("printed"), T.fold("printed")).alias("forms"))
    long = flat.select("doc_id", F.posexplode("fields").alias("pos", "f")).select("doc_id", "pos", "f.*").join(forms, "printed")
    fields = long.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "field", "row", "forms"))).alias("fields"))
    anchor = flat.select("doc_id", F.posexplode("rows").alias("row", "r")).select("doc_id", "row", F.col("r.anchor").alias("printed")).join(forms, "printed")
    anchor = anchor.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row", "forms"))).alias("anchors"))
    out = fields.join(anchor, "doc_id", "left")
    own = lambda a: F.transform(F.filter("fields", lambda f: f["row"] == a["row"]), lambda f: f["forms"])
    rows = F.transform(F.coalesce("anchors", F.array().cast(anchor.schema["anchors"].dataType)), lambda a: F.struct(a["forms"].alias("anchor"), own(a).alias("cells")))
    parts = F.filter(F.flatten(F.transform("fields", lambda f: F.split(T.strip(f["forms"]["printed"]), r"(?U)\s+"))), lambda t: F.length(t) > 1)
    part_forms = F.filter(F.flatten(F.transform(parts, lambda t: F.array(F.lower(t), T.nocomma(F.lower(t)), T.canon(t)))), lambda x: x != "")
    return out.select("doc_id", "fields", rows.alias("rows"), claimed_forms(F.transform("fields", lambda f: f["forms"]), part_forms).alias("claimed"))


def pages(texts: DataFrame, prose_parens: bool = False) -> DataFrame:
    """texts with its column text replaced by `page`: lines, tokens by line, and all that they are matched by,
    each made once."""

    def of_lines(lines: Column) -> Column:
        return T.bind(F.transform(lines, lambda x: token_forms(x, prose_parens)), lambda toks: with_tokens(lines, toks))

    def with_tokens(lines: Column, toks: Column) -> Column:
        lows = F.transform(lines, lambda x: F.lower(x))
        ends = F.aggregate(toks, F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.size(t))))
        return T.bind(F.flatten(toks), lambda flat: F.struct(lines.alias("lines"), flat.alias("toks"), ends.alias("off"), scope(lows, flat).alias("scope")))

    T.bounded(texts.sparkSession)
    return texts.withColumn("page", T.bind(T.lines(T.fold("text")), of_lines)).drop("text")


def verdicts(texts: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("parser", "doc_id", "dpi"), prose_parens: bool = False) -> DataFrame:
    """(keys, field, printed, status, got, distance, typed, rows_anchored, n_rows): one row per label field and
    page. texts has the keys and text, one of the keys is doc_id; truth has doc_id, printed and rows.

    A field is OK where it stands in its row's block (scalars, and cells of rows without one: on the page),
    MISPLACED where a cell stands on the page but not in its block, CORRUPT where a look-alike near enough
    took its place (typed: one that would pass for a value), else ABSENT.

    prose_parens reads "($2,562,146)" in a sentence as that sum; by default it is a loss, as in a table."""
    p = pages(texts, prose_parens).join(labels(truth), "doc_id")
    # what is made of a page and its labels, in one expression: every part of it is bound, none is made again
    judged = T.bind(F.struct(F.col("page"), F.col("fields"), F.col("rows"), F.col("claimed")), lambda b: T.bind(blocks(anchors(b["rows"], b["page"]), F.size(b["page"]["lines"])), lambda at: _judged(b["page"], b["fields"], b["claimed"], at)))
    every = F.transform("fields", lambda f: f["forms"]["low"])
    each = p.select(*keys, F.size("rows").alias("n_rows"), every.alias("every"), judged.alias("j")).select(*keys, "n_rows", "every", F.col("j.rows_anchored").alias("rows_anchored"), F.explode("j.found").alias("x"))
    each = each.select(*keys, "rows_anchored", "n_rows", "every", "x.*")
    v = F.col("f.v")
    mine = F.array(v["low"], v["bare"], v["canon"])
    missed = F.col("f.status") == "MISS"
    each = each.withColumn("_prose", F.col("lines").isNotNull()).withColumn("_masked", mask_claimed(F.col("lines"), F.when(F.col("lines").isNotNull(), F.array_except("every", mine))))
    window = nearest_window(v, F.col("lines"), F.col("_masked"))
    near = each.select(*keys, "f", "_prose", F.when(F.col("_prose"), window).otherwise(F.col("token")).alias("n"), "rows_anchored", "n_rows")
    near = near.select(*keys, "f", "_prose", F.col("n.d").alias("d"), F.col("n.raw").alias("raw"), "rows_anchored", "n_rows")
    limit = F.when(F.col("_prose"), F.greatest(F.lit(1), F.floor(F.length(v["printed"]) / 4))).otherwise(F.greatest(F.lit(1), F.floor(F.length(v["canon"]) / 3)))
    moved = F.col("f.status") == "MISPLACED"
    corrupt = missed & F.coalesce(F.col("d") <= limit, F.lit(False))
    told = F.col("_prose") | F.coalesce(F.col("d") <= 2 * limit, F.lit(False))
    status = F.when(corrupt, "CORRUPT").when(missed, "ABSENT").otherwise(F.col("f.status"))
    got = F.when(moved, v["printed"]).when(missed & told, F.col("raw"))
    typed = F.when(corrupt, T.stays_in_alphabet(v["printed"], F.col("raw")))
    return near.select(*keys, "f.field", v["printed"].alias("printed"), status.alias("status"), got.alias("got"), F.when(moved, 0).otherwise(F.col("d")).alias("distance"), typed.alias("typed"), "rows_anchored", "n_rows")


def _judged(page: Column, fields: Column, claimed: Column, at: Column) -> Column:
    """(found, rows_anchored) of a page whose rows' blocks are `at`; found has per field f (field, v, scoped,
    status), for a missed word or figure the nearest token (d, raw), for missed prose the lines of its scope."""
    free = F.filter(F.transform(page["toks"], lambda t, i: F.struct(i.alias("pos"), t["raw"].alias("raw"), t["canon"].alias("canon"), (~F.array_contains(claimed, t["canon"])).alias("free"))), lambda t: t["canon"] != "")

    def judge(free: Column, f: Column) -> Column:
        b = F.get(at, f["row"])
        scoped = F.coalesce((f["row"] >= 0) & (b["len"] > 0), F.lit(False))
        status = (
            F.when(~scoped & found(f["forms"], page["scope"]), "OK")
            .when(~scoped, "MISS")
            .when(T.bind(_lines(page, b["lo"], b["len"]), lambda w: found(f["forms"], w)), "OK")
            .when(found(f["forms"], page["scope"]), "MISPLACED")
            .otherwise("MISS")
        )
        part = F.struct(f["field"].alias("field"), f["forms"].alias("v"), scoped.alias("scoped"), status.alias("status"))
        return T.bind(part, lambda x: F.struct(x.alias("f"), F.when(x["status"] == "MISS", token(free, x, b)).alias("token"), F.when((x["status"] == "MISS") & (T.shape(x["v"]["printed"]) == "text"), F.when(x["scoped"], F.slice(page["lines"], b["lo"] + 1, b["len"])).otherwise(page["lines"])).alias("lines")))

    def token(free: Column, x: Column, b: Column) -> Column:
        v, mine = x["v"], F.array(x["v"]["low"], x["v"]["bare"], x["v"]["canon"])
        lo = F.get(page["off"], b["lo"])
        hi = F.get(page["off"], F.least(b["lo"] + b["len"], F.size(page["lines"])))
        inside = lambda t: ~x["scoped"] | (lo == hi) | ((t["pos"] >= lo) & (t["pos"] < hi))
        near = F.filter(free, lambda t: (F.abs(F.length(t["canon"]) - F.length(v["canon"])) <= 1) & (t["free"] | F.array_contains(mine, t["canon"])) & inside(t))
        best = F.array_min(F.transform(near, lambda t: F.struct(F.levenshtein(t["canon"], v["canon"]).alias("d"), t["pos"].alias("pos"), t["raw"].alias("raw"))))
        short = (F.length(v["printed"]) < 3) & ~x["scoped"]
        return F.when((T.shape(v["printed"]) != "text") & ~short, T.bind(best, lambda n: F.struct(n["d"].alias("d"), n["raw"].alias("raw"))))

    anchored = F.size(F.filter(at, lambda b: b["len"] > 0))
    return T.bind(free, lambda fr: F.struct(F.transform(fields, lambda f: judge(fr, f)).alias("found"), anchored.alias("rows_anchored")))
