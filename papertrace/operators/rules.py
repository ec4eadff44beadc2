"""Arithmetic rules over printed values: sums, row rules, identities across documents.

A rule of one document is a row with the array of its terms, resolved to values and judged within that row, so that
nothing is shuffled for it. Identities span documents: their terms are a long table, resolved by joins and judged by
one aggregation. Labels are checked by the same plan, as a parser that read everything right.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, num

TOLERANCE = 0.005
_ROWS = "array<struct<key:string,anchor:string,cells:map<string,string>>>"


class Terms(NamedTuple):
    """What is added up ("term") or compared with ("target"). across: a row per term of rules that span documents.
    own: a row per rule of one document, its terms in arrays side by side (spoken, field, printed); the first `plus` are
    added, the last is the target but in form "cells", `literal` is the target where that is a figure."""

    own: DataFrame | None
    across: DataFrame | None


def _apart(t: Terms | DataFrame) -> Terms:
    return t if isinstance(t, Terms) else Terms(t, None) if "plus" in t.columns else Terms(None, t)


def cells(truth: DataFrame) -> DataFrame:
    """(doc_id, ref, field, printed, row, cell) of everything that a rule may name: "key.cell" of a row (its
    anchor where it has no key), or a printed field. Cells win over fields of the same name; a reference that
    two cells share is an error."""
    row = truth.select("doc_id", F.posexplode("rows").alias("row", "r"))
    cell = row.select("doc_id", "row", F.coalesce("r.key", "r.anchor").alias("_k"), F.explode("r.cells").alias("cell", "printed"))
    cell = cell.select("doc_id", F.concat_ws(".", "_k", "cell").alias("ref"), F.concat(F.lit("rows["), F.col("row").cast("string"), F.lit("]."), F.col("cell")).alias("field"), "printed", "row", "cell", F.lit(0).alias("_rank"))
    scalar = truth.select("doc_id", F.explode("printed").alias("ref", "printed")).select("doc_id", "ref", F.col("ref").alias("field"), "printed", F.lit(None).cast("int").alias("row"), F.lit(None).cast("string").alias("cell"), F.lit(1).alias("_rank"))
    both = cell.unionByName(scalar).groupBy("doc_id", "ref").agg(F.min_by(F.struct("field", "printed", "row", "cell"), "_rank").alias("c"), F.count_if(F.col("_rank") == 0).alias("_n"))
    clash = F.raise_error(F.concat(F.lit("duplicate cell reference "), "ref", F.lit(" in "), "doc_id"))
    return both.select("doc_id", "ref", F.when(F.col("_n") > 1, clash.cast("string")).otherwise(F.col("c.field")).alias("field"), "c.printed", "c.row", "c.cell")


def resolve(terms: DataFrame, named: DataFrame) -> DataFrame:
    """terms (doc_id, ref, role ...) with field and literal: a reference is a field first; only a target may
    be a figure instead. Anything else is an error that names it."""
    at = named.select(F.col("doc_id").alias("ref_doc"), F.col("ref").alias("ref"), "field", F.col("printed").alias("printed"))
    out = terms.join(at, ["ref_doc", "ref"], "left")
    figure = F.when(F.col("field").isNull() & (F.col("role") == "target"), num(F.col("spoken")))
    wrong = F.raise_error(F.concat(F.col("spoken"), F.lit(" is neither a row cell nor a printed field, nor a figure")))
    return out.withColumn("literal", F.when(F.col("field").isNull(), F.coalesce(figure, wrong.cast("double"))))


def _index() -> Column:
    """What cells() has of one document, as a map by ref of (field, printed)."""
    none = F.create_map().cast("map<string,string>")
    at = lambda field, printed: F.struct(field.alias("field"), printed.alias("printed"))
    cell = lambda r, i: F.transform(F.map_entries(F.coalesce(r["cells"], none)), lambda e: F.struct(F.concat_ws(".", F.coalesce(r["key"], r["anchor"]), e["key"]).alias("ref"), at(F.concat(F.lit("rows["), i.cast("string"), F.lit("]."), e["key"]), e["value"]).alias("at")))

    def merged(cells: Column, refs: Column) -> Column:
        twice = F.get(F.filter(refs, lambda x, i: F.array_position(refs, x) <= i), 0)
        scalar = F.transform(F.filter(F.map_entries(F.coalesce("printed", none)), lambda e: ~F.array_contains(refs, e["key"])), lambda e: F.struct(e["key"].alias("ref"), at(e["key"], e["value"]).alias("at")))
        clash = F.raise_error(F.concat(F.lit("duplicate cell reference "), twice, F.lit(" in "), "doc_id"))
        return F.when(F.size(F.array_distinct(refs)) < F.size(refs), clash.cast("map<string,struct<field:string,printed:string>>")).otherwise(F.map_from_entries(F.concat(cells, scalar)))

    every = F.flatten(F.transform(F.coalesce("rows", F.array().cast(_ROWS)), cell))
    return bind(every, lambda c: bind(F.transform(c, lambda x: x["ref"]), lambda refs: merged(c, refs)))


def _kept(truth: DataFrame) -> list[str]:
    """`pages` stay beside a document's rules where truth has them."""
    return [c for c in ("pages",) if c in truth.columns]


def _own(d: DataFrame) -> DataFrame:
    """d (doc_id, n, s: what is declared, row, r: its row, null for a sum, _at: what _index() has) with terms. A sum's
    reference is a cell or a field first; only a target may be a figure instead. Anything else is an error that names it.
    Of row rules form `of` needs the target cell and at least one term present, form `cells` (a, b, d) all three."""
    none, kept = F.array().cast("array<string>"), _kept(d)
    summed, of = F.col("row").isNull(), F.col("s.of").isNotNull()
    has = lambda c: F.map_contains_key("r.cells", c)
    d = d.withColumn("_of", F.when(summed, F.col("s.of")).when(of, F.filter("s.of", has)))
    ok = F.when(summed, of).when(of, has(F.col("s.equals")) & (F.size("_of") > 0)).otherwise(F.forall(F.coalesce("s.cells", none), has) & (F.size("s.cells") == 3))
    form = F.when(summed, "sum").when(of, "row").otherwise("cells")
    d = d.where(F.coalesce(ok, F.lit(False))).select(
        "doc_id", *kept, F.when(summed, F.col("s.name")).otherwise(F.concat("s.name", F.lit("["), "r.anchor", F.lit("]"))).alias("rule"),
        F.when(summed, F.concat(F.lit("sum"), F.col("n").cast("string"))).otherwise(F.concat(F.lit("row"), F.col("n").cast("string"), F.lit("."), F.col("row").cast("string"))).alias("instance"), form.alias("form"),
        F.when(form == "cells", TOLERANCE).otherwise(F.coalesce("s.tolerance", F.lit(TOLERANCE))).alias("tolerance"), F.when(form == "cells", 3).otherwise(F.size("_of")).alias("plus"),
        F.when(summed, F.concat("_of", F.coalesce("s.minus", none), F.array("s.equals"))).when(of, F.concat("_of", F.array("s.equals"))).otherwise(F.col("s.cells")).alias("spoken"), "row", "r", "_at",
    )
    d = d.withColumn("_at", F.when(summed, F.transform("spoken", lambda x: F.try_element_at("_at", x))))
    target = F.element_at("spoken", -1)
    lost = lambda x: F.raise_error(F.concat(x, F.lit(" is neither a row cell nor a printed field, nor a figure")))
    literal = F.when(summed & F.element_at("_at", -1).isNull(), F.coalesce(num(target), lost(target).cast("double")))
    missing = F.filter("spoken", lambda x, i: F.get("_at", i).isNull() & (i < F.size("spoken") - 1))
    printed = F.when(summed, F.when(F.exists(F.slice("_at", 1, F.size("_at") - 1), lambda x: x.isNull()), lost(F.get(missing, 0)).cast("array<string>")).otherwise(F.col("_at.printed"))).otherwise(F.transform("spoken", lambda c: F.element_at("r.cells", c)))
    field = F.when(summed, F.col("_at.field")).otherwise(F.transform("spoken", lambda c: F.concat(F.lit("rows["), F.col("row").cast("string"), F.lit("]."), c)))
    return d.select("doc_id", *kept, "rule", "instance", "form", "tolerance", "plus", "spoken", field.alias("field"), printed.alias("printed"), literal.alias("literal"))


def row_terms(truth: DataFrame) -> DataFrame:
    """The row rules alone, for every row that they apply to."""
    d = truth.select("doc_id", *_kept(truth), "rows", F.posexplode("reconciliation.row_rules").alias("n", "s")).select("doc_id", *_kept(truth), "n", "s", F.posexplode("rows").alias("row", "r"))
    s = F.struct("s.name", "s.of", F.lit(None).cast("array<string>").alias("minus"), "s.equals", "s.cells", "s.tolerance")
    return _own(d.withColumn("s", s).withColumn("_at", F.lit(None).cast("map<string,struct<field:string,printed:string>>")))


def own_terms(truth: DataFrame) -> DataFrame:
    """The declared sums and the row rules."""
    null, strings = F.lit(None), F.lit(None).cast("array<string>")
    spec = lambda s, minus, cells: F.struct(s["name"].alias("name"), s["of"].alias("of"), minus.alias("minus"), s["equals"].alias("equals"), cells.alias("cells"), s["tolerance"].alias("tolerance")).alias("s")
    sums = F.transform("reconciliation.sums", lambda s, n: F.struct(n.alias("n"), spec(s, s["minus"], strings), null.cast("int").alias("row"), null.cast(_ROWS[6:-1]).alias("r")))
    rows = F.flatten(F.transform("reconciliation.row_rules", lambda s, n: F.transform(F.coalesce("rows", F.array().cast(_ROWS)), lambda r, i: F.struct(n.alias("n"), spec(s, strings, s["cells"]), i.alias("row"), r.alias("r")))))
    no = F.slice(F.array(F.struct(F.lit(0).alias("n"), F.struct(F.lit("").alias("name"), strings.alias("of"), strings.alias("minus"), F.lit("").alias("equals"), strings.alias("cells"), null.cast("double").alias("tolerance")).alias("s"), null.cast("int").alias("row"), null.cast(_ROWS[6:-1]).alias("r"))), 1, 0)
    d = truth.select("doc_id", *_kept(truth), _index().alias("_at"), F.concat(F.coalesce(sums, no), F.coalesce(rows, no)).alias("x"))
    return _own(d.select("doc_id", *_kept(truth), "_at", F.explode("x").alias("x")).select("doc_id", *_kept(truth), "_at", "x.*"))


def identity_terms(rules: DataFrame, docs: DataFrame) -> DataFrame:
    """The terms of identities: "doc.field", apart at the first dot. A term whose document is unknown is an
    error; a target of that kind may be a figure."""
    t = lambda refs, role: F.transform(refs, lambda x: F.struct(x.alias("spoken"), F.lit(role).alias("role")))
    r = rules.select(F.col("name").alias("rule"), F.posexplode(F.concat(t(F.col("of"), "term"), t(F.array("equals"), "target"))).alias("place", "t"))
    part = F.split("t.spoken", r"\.", 2)
    r = r.select(F.lit("").alias("doc_id"), "rule", F.col("rule").alias("instance"), F.lit("identity").alias("form"), F.lit(TOLERANCE).alias("tolerance"), "place", "t.*", F.lit(1.0).alias("sign"), F.get(part, 0).alias("ref_doc"), F.get(part, 1).alias("ref"))
    known = docs.select(F.col("doc_id").alias("ref_doc"), F.lit(True).alias("_known"))
    r = r.join(known, "ref_doc", "left")
    return r.withColumn("ref_doc", F.when(F.col("_known") | (F.col("role") == "target"), F.col("ref_doc")).otherwise(F.raise_error(F.concat(F.col("spoken"), F.lit(": no labels for that document"))).cast("string"))).drop("_known")


def terms(truth: DataFrame, rules: DataFrame | None = None) -> Terms:
    """All rules of all label documents, and identities across them, with resolved terms. Where truth has `pages`
    (see top_pages()), they stay beside a document's rules."""
    return Terms(own_terms(truth), None if rules is None else resolve(identity_terms(rules, truth), cells(truth)))


def top_pages(pages: Column) -> Column:
    """Of a document's pages, an array of (parser, dpi, fields: map of (status, got)), each parser's at its highest
    resolution."""
    return bind(pages, lambda every: F.filter(every, lambda p: ~F.exists(every, lambda q: (q["parser"] == p["parser"]) & (q["dpi"] > p["dpi"]))))


def _pages(verdicts: DataFrame) -> DataFrame:
    """(doc_id, p: a parser's page at its highest resolution) of verdicts, in one aggregation."""
    one = F.struct("dpi", "field", F.struct("status", "got").alias("v"))
    g = verdicts.groupBy("doc_id", "parser").agg(F.max("dpi").alias("top"), F.collect_list(one).alias("all"))
    fields = F.map_from_entries(F.transform(F.filter("all", lambda x: (x["dpi"] == F.col("top")) & x["field"].isNotNull()), lambda x: F.struct(x["field"], x["v"])))
    return g.select("doc_id", F.struct("parser", fields.alias("fields")).alias("p"))


def _read(status: Column, got: Column, printed: Column) -> Column:
    """What a parser read where a value is printed, null for nothing."""
    return F.when(status.isin("OK", "MISPLACED"), printed).when((status == "CORRUPT") & (got != ""), got)


def _status(literal: Column, status: Column, read: Column) -> Column:
    return F.when(literal.isNotNull(), "OK").when(status.isNull(), "MISSING_FROM_GRADE").when(read.isNull(), "ABSENT").otherwise(status)


def _seen_own(own: DataFrame, verdicts: DataFrame | str | None) -> DataFrame:
    cols = ["doc_id", "rule", "instance", "form", "tolerance", "plus", "spoken", "printed", "literal"]
    figure = F.col("literal").isNotNull()
    # a target that is a figure itself takes the last place
    last = lambda c, v: F.when(figure, F.concat(F.slice(c, 1, F.size(c) - 1), F.array(v))).otherwise(F.col(c))
    if verdicts is None:
        out = own.select(F.lit("labels").alias("parser"), *cols, F.transform("spoken", lambda x: F.lit("OK")).alias("status"), F.col("printed").alias("got"))
    else:
        paged = own.select(*cols, "field", F.explode(verdicts).alias("p")) if isinstance(verdicts, str) else own.join(_pages(verdicts), "doc_id")
        paged = paged.select(F.col("p.parser").alias("parser"), *cols, F.transform("field", lambda x: F.try_element_at("p.fields", x)).alias("v"))
        paged = paged.select("parser", *cols, "v", F.transform("v", lambda v, i: _read(v["status"], v["got"], F.get("printed", i))).alias("got"))
        status = F.transform("v", lambda v, i: _status(F.lit(None), v["status"], F.get("got", i)))
        out = paged.select("parser", *cols, status.alias("status"), "got").withColumn("status", last("status", F.lit("OK")))
    return out.withColumn("value", F.transform("got", lambda x: num(x))).withColumn("value", last("value", F.col("literal")))


def _seen_across(all_terms: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    if verdicts is None:
        return all_terms.withColumn("parser", F.lit("labels")).withColumn("status", F.lit("OK")).withColumn("value", F.coalesce("literal", num("printed"))).withColumn("got", F.col("printed"))
    top = verdicts.groupBy("parser", "doc_id").agg(F.max("dpi").alias("dpi"))
    v = verdicts.join(top, ["parser", "doc_id", "dpi"]).select(F.col("parser"), F.col("doc_id").alias("ref_doc"), "field", F.col("status").alias("_s"), F.col("got").alias("_g"))
    graded = top.select("parser", F.col("doc_id").alias("ref_doc"))
    own = all_terms.where("form <> 'identity'").join(graded, "ref_doc")
    # an identity spans documents: each parser is judged by it, whatever it read
    across = all_terms.where("form = 'identity'").crossJoin(top.select("parser").distinct())
    out = own.unionByName(across).join(v, ["parser", "ref_doc", "field"], "left")
    read = _read(F.col("_s"), F.col("_g"), F.col("printed"))
    return out.withColumn("status", _status(F.col("literal"), F.col("_s"), read)).withColumn("got", read).withColumn("value", F.coalesce("literal", num(read))).drop("_s", "_g")


def seen(all_terms: Terms | DataFrame, verdicts: DataFrame | str | None) -> Terms:
    """terms with parser, what the parser returned for each (status, got), and its value. Without verdicts the
    parser is "labels" and read everything as printed. Of a document graded at several resolutions the
    highest counts. Verdicts that lie beside the rules are named by their column, of top_pages()."""
    t = _apart(all_terms)
    if isinstance(verdicts, str) and t.across is not None:
        raise ValueError("identities span documents: they need verdicts as rows")
    return Terms(None if t.own is None else _seen_own(t.own, verdicts), None if t.across is None else _seen_across(t.across, verdicts))


def status_of(missing: Column, diff: Column, tolerance: Column, corrupt: Column) -> Column:
    """INCOMPLETE where a value is missing or no figure; BROKEN beyond the tolerance; SURVIVES where it holds
    although a value was misread; else HOLDS."""
    return F.when(missing, "INCOMPLETE").when(diff > tolerance, "BROKEN").when(corrupt, "SURVIVES").otherwise("HOLDS")


def _note(x: Callable[[str], Column], form: Column) -> Column:
    """What is to be said of a term, null for nothing."""
    gone = x("value").isNull()
    return (
        F.when(gone & x("got").isNotNull(), F.concat(x("spoken"), F.lit(" unparseable '"), x("got"), F.lit("'")))
        .when(gone, F.concat_ws(" ", x("spoken"), x("status")))
        .when((x("status") == "CORRUPT"), F.concat(x("spoken"), F.lit(" read as '"), x("got"), F.lit("' (printed '"), x("printed"), F.lit("')")))
        .when((x("status") == "MISPLACED") & (x("role") == "term") & form.isin("sum", "row"), F.concat(x("spoken"), F.lit(" landed in another row")))
    )


def _own_sums(own: DataFrame) -> DataFrame:
    """As _across_sums(), of rules whose terms lie in arrays. What lacks a value has no sum."""
    gone, cells = F.exists("value", lambda x: x.isNull()), F.col("form") == "cells"
    added = lambda at, n: F.aggregate(F.slice("value", at, n), F.lit(0.0), lambda a, x: a + x)
    less = F.size("value") - F.col("plus") - 1
    total = F.when(cells | (F.size("value") > 1), added(F.lit(1), F.col("plus")) - F.when(less > 0, added(F.col("plus") + 1, less)).otherwise(0.0))
    notes = F.filter(F.transform("value", lambda _, i: _note(lambda c: F.lit("term") if c == "role" else F.get(c, i), F.when(cells | (i < F.size("value") - 1), F.col("form")))), lambda n: n.isNotNull())
    told = gone | F.array_contains("status", "CORRUPT") | F.array_contains("status", "MISPLACED")
    return own.select(
        "parser", "doc_id", "rule", "instance", "form", total.alias("total"), F.when(~cells, F.element_at("value", -1)).alias("target"), "tolerance",
        gone.alias("_gone"), F.array_contains("status", "CORRUPT").alias("_corrupt"), F.when(told, notes).otherwise(F.array().cast("array<string>")).alias("notes"), *(F.get("value", F.lit(k)).alias(f"_{k}") for k in range(3)),
    )


def _across_sums(t: DataFrame) -> DataFrame:
    """What a rule's terms come to: sums, whether one is missing or misread, notes, and its first three values."""
    note, term = _note(F.col, F.col("form")), F.col("role") == "term"
    return t.groupBy("parser", "doc_id", "rule", "instance", "form").agg(
        F.sum(F.when(term, F.col("sign") * F.col("value"))).alias("total"), F.max(F.when(~term, F.col("value"))).alias("target"), F.max("tolerance").alias("tolerance"),
        F.bool_or(F.col("value").isNull()).alias("_gone"), F.bool_or(F.coalesce(F.col("status") == "CORRUPT", F.lit(False))).alias("_corrupt"),
        F.transform(F.array_sort(F.collect_list(F.when(note.isNotNull(), F.struct("place", note.alias("note"))))), lambda x: x["note"]).alias("notes"),
        *(F.max(F.when(F.col("place") == k, F.col("value"))).alias(f"_{k}") for k in range(3)),
    )


def judge(terms_seen: Terms | DataFrame) -> DataFrame:
    """(parser, doc_id, rule, instance, form, status, total, target, notes): one row per rule instance and
    parser."""
    t = _apart(terms_seen)
    parts = [f(x) for f, x in ((_own_sums, t.own), (_across_sums, t.across)) if x is not None]
    g = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    cells_diff = F.abs(F.abs(F.col("_0") - F.col("_1")) - F.abs(F.col("_2")))
    diff = F.when(F.col("form") == "cells", cells_diff).otherwise(F.abs(F.col("total") - F.col("target")))
    status = status_of(F.col("_gone"), diff, F.col("tolerance"), F.col("_corrupt"))
    last = F.when((status != "INCOMPLETE") & (F.col("form") != "cells"), F.array(F.concat(F.format_number("total", 2), F.lit(" vs "), F.format_number("target", 2)))).otherwise(F.array().cast("array<string>"))
    return g.select("parser", "doc_id", "rule", "instance", "form", status.alias("status"), F.when(~F.col("_gone"), F.col("total")).alias("total"), F.when(~F.col("_gone"), F.col("target")).alias("target"), F.concat("notes", last).alias("notes"))


def counts(results: DataFrame, *keys: str) -> DataFrame:
    """Rule results per key over the fixed four statuses, zeros filled in."""
    return results.groupBy(*keys).agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in ("HOLDS", "SURVIVES", "BROKEN", "INCOMPLETE")))


class LabelsDisagree(ValueError):
    """The labels break their own rules; nothing is judged by them."""


def gate(labels_result: DataFrame) -> int:
    """The number of rules checked, if all hold for the labels themselves; else an error."""
    n, bad = labels_result.agg(F.count(F.lit(1)), F.count_if(F.col("status") != "HOLDS")).first()
    if bad:
        raise LabelsDisagree(f"{bad} of {n} rules do not hold for the labels")
    return n
