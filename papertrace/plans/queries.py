"""The audit's operators as queries over the driver's tables, each over whole tables, with DuckDB SQL beside it.

The tables hold no extracted pages, so queries print values from them, plant known errors by key, and run the
operators on that; the SQL states what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cost, match, rules, runs, summary
from ..sources import sinks
from . import rulings

#: Dollars per million tokens, by prefix.
PRICES = [("click", 5.0, 25.0), ("click-1", 2.0, 8.0), ("view", 1.0, 4.0), ("purchase-3", 3.0, 15.0)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def _order_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum rule per order over its line items in cents; the printed total is off by 6 or by 5 for some, some
    items are misread to the same figure, some are missing."""
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", _cents("l_extendedprice").alias("v"))
    total = items.groupBy("l_orderkey").agg(F.sum("v").alias("v"))
    off = F.when(F.col("l_orderkey") % 7 == 0, 6).when(F.col("l_orderkey") % 5 == 0, 5).otherwise(0)
    gone, wrong = F.col("l_partkey") % 50 == 0, (F.col("l_orderkey") % 3 == 0) & (F.col("l_linenumber") == 2)
    term = items.select("l_orderkey", F.lit("term").alias("role"), F.col("l_linenumber").alias("place"), F.when(gone, "ABSENT").when(wrong, "CORRUPT").otherwise("OK").alias("status"), F.when(~gone, F.col("v").cast("string")).alias("got"))
    target = total.select("l_orderkey", F.lit("target").alias("role"), F.lit(0).alias("place"), F.lit("OK").alias("status"), (F.col("v") + off).cast("string").alias("got"))
    return term.unionByName(target).select(
        F.lit("plant").alias("parser"), F.col("l_orderkey").cast("string").alias("doc_id"), F.lit("order total").alias("rule"), F.lit("sum0").alias("instance"), F.lit("sum").alias("form"),
        F.lit(5.0).alias("tolerance"), "place", "role", F.lit(1.0).alias("sign"), "status", "got", F.col("got").alias("printed"), F.col("place").cast("string").alias("spoken"), T.num("got").alias("value"),
    )


def rule_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(_order_terms(spark, sf_dir))
    return out.select("doc_id", "rule", "status", "total", "target", F.size("notes").alias("n_notes"))


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.col("o_orderpriority").alias("priority"))
    return rules.counts(rules.judge(_order_terms(spark, sf_dir)).join(orders, "doc_id"), "priority")


def _item_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label document per order with a row per line item; a third line prints no discount."""
    gross, off = _cents("l_extendedprice"), F.round(F.col("l_extendedprice") * F.col("l_discount") * 100).cast("long")
    net = gross - off + F.when(F.col("l_partkey") % 11 == 0, 1).otherwise(0)
    cell = lambda n, v: F.struct(F.lit(n).alias("key"), v.cast("string").alias("value"))
    cells = lambda r: F.filter(F.array(cell("gross", r["gross"]), F.when(r["l_linenumber"] != 3, cell("off", r["off"])), cell("net", r["net"])), lambda e: e.isNotNull())
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", gross.alias("gross"), off.alias("off"), net.alias("net"))
    rows = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "gross", "off", "net"))).alias("r"))
    name = lambda r: r["l_linenumber"].cast("string")
    declared = F.from_json(F.lit('{"sums":[],"row_rules":[{"name":"net","cells":["gross","off","net"]},{"name":"parts","of":["net","off"],"equals":"gross","tolerance":0.5}]}'), "sums array<struct<name:string,of:array<string>,minus:array<string>,equals:string,tolerance:double>>,row_rules array<struct<name:string,of:array<string>,equals:string,cells:array<string>,tolerance:double>>")
    return rows.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(None).cast("map<string,string>").alias("printed"), F.transform("r", lambda r: F.struct(name(r).alias("key"), F.concat(F.lit("line "), name(r)).alias("anchor"), F.map_from_entries(cells(r)).alias("cells"))).alias("rows"), declared.alias("reconciliation"))


def rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = rules.row_terms(_item_truth(spark, sf_dir))
    return rules.judge(rules.seen(spoken, None)).select("doc_id", "rule", "form", "status")


def rule_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' balances add up to their region's, which is printed off by 7 for one and a literal for another."""
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    held = _table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sum(_cents("c_acctbal")).alias("v"))
    per = nation.join(held, nation.n_nationkey == held.c_nationkey, "left").select("n_nationkey", "n_regionkey", F.coalesce("v", F.lit(0)).alias("v"))
    total = per.groupBy("n_regionkey").agg(F.sum("v").alias("v"), F.array_sort(F.collect_list(F.concat(F.lit("n"), "n_nationkey", F.lit(".cents")))).alias("of"))
    doc = lambda df, k, v: df.select(k.alias("doc_id"), F.create_map(F.lit("cents"), v.cast("string")).alias("printed"), F.lit(None).cast("array<struct<key:string,anchor:string,cells:map<string,string>>>").alias("rows"))
    truth = doc(per, F.concat(F.lit("n"), "n_nationkey"), F.col("v")).unionByName(doc(total, F.concat(F.lit("r"), "n_regionkey"), F.col("v") + F.when(F.col("n_regionkey") == 2, 7).otherwise(0)))
    spec = total.join(region, total.n_regionkey == region.r_regionkey).select(F.col("r_name").alias("name"), "of", F.when(F.col("n_regionkey") == 3, F.lit("12345")).otherwise(F.concat(F.lit("r"), "n_regionkey", F.lit(".cents"))).alias("equals"))
    spoken = rules.resolve(rules.identity_terms(spec, truth), rules.cells(truth))
    return rules.judge(rules.seen(spoken, None)).select("rule", "status", "total", "target")


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances as an accountant prints them, read back."""
    v = F.format_number(F.abs("c_acctbal"), 2)
    printed = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("($"), v, F.lit(")"))).otherwise(F.concat(F.lit("$"), v))
    df = _table(spark, sf_dir, "customer").select("c_custkey", printed.alias("printed"))
    return df.select("c_custkey", "printed", T.num("printed").alias("value"), T.canon("printed").alias("canon"), T.is_numeric("printed").alias("is_numeric"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    texts = F.array(F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("PO-"), "o_orderkey"), F.concat(F.lit("LN-"), F.lpad(F.col("o_orderkey").cast("string"), 3, "0")), F.format_number("o_totalprice", 2))
    return orders.select(F.explode(texts).alias("v")).groupBy(T.shape("v").alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.count_if(T.is_multiword("v")).alias("multiword"))


def regrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures with spaces between their digit groups, up to fifteen of them: joined in a line, and found as
    adjacent tokens. A decimal part after the last group, or a digit, leaves that group alone."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 1009 + 1_000_000).alias("v"))
    k = F.col("o_orderkey")
    printed = F.concat(F.replace(F.format_number("v", 0), F.lit(","), F.lit(" ")), F.repeat(F.lit(" 205"), (k % 13).cast("int")), F.when(k % 3 == 0, " 110.5").when(k % 3 == 1, " 1104").otherwise(""))
    cut = F.concat(F.substring(F.col("v").cast("string"), 1, 2), F.lit(" "), F.substring(F.col("v").cast("string"), 3, 20))
    df = orders.select("o_orderkey", F.concat(F.lit("sum "), printed, F.lit(" due")).alias("line"), F.concat(F.lit("sum "), cut, F.lit(" due")).alias("split"), (F.col("v") + F.col("o_orderkey") % 2).cast("string").alias("want"))
    return df.select("o_orderkey", T.join_thousands("line").alias("joined"), T.bind(match.token_forms(F.col("split")), lambda t: T.bind(match.scope(F.array(), t), lambda s: match.concat_match(F.col("want"), s))).alias("adjacent"))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt market segments against the list of all, nearest by edit distance."""
    customer = _table(spark, sf_dir, "customer")
    names = customer.agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), " ").alias("line"))  # a handful of words
    spelt = F.concat(F.substring("c_mktsegment", 1, 2), F.lit("x"), F.substring("c_mktsegment", 4, 99), F.when(F.col("c_custkey") % 2 == 0, "s").otherwise(""))
    df = customer.select("c_custkey", spelt.alias("spelt")).join(names)  # one row
    best = match.nearest_token(F.struct(T.canon("spelt").alias("canon")), match.token_forms(F.col("line")), F.array().cast("array<string>"))
    return df.withColumn("b", best).select("c_custkey", "spelt", F.col("b.d").alias("distance"), F.col("b.raw").alias("got"), T.stays_in_alphabet("spelt", "b.raw").alias("typed"))


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    row = F.concat(F.lit("<tr class='x'><td>"), "n_nationkey", F.lit("</td><td><b>"), "n_name", F.lit("</b></td></tr>"))
    html = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))).alias("r"))
    return html.select("n_regionkey", T.html_rows(F.concat(F.lit("<table>"), F.array_join(F.transform("r", lambda r: r["row"]), ""), F.lit("</table>"))).alias("text"))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]+>", "\n")
    return pages.select("page_id", T.lines(bare).alias("l")).select("page_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage whole, in any case. Candidates meet on five inner words."""
    word = r"[^\x20\x09-\x0D]+"
    low = _table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t")).where("t is not null")
    want = _table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("p")).withColumn("w", F.regexp_extract_all("p", F.lit(word), F.lit(0)))
    key = lambda w, at: F.xxhash64(F.array_join(F.slice(w, at, 5), " "))
    long = want.where("size(w) >= 7").select("item_id", "p", key(F.col("w"), F.lit(2)).alias("k"))
    w = F.regexp_extract_all("t", F.lit(word), F.lit(0))
    grams = low.withColumn("w", w).where("size(w) >= 7").select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - 4), lambda i: key(F.col("w"), i)))).alias("k"))
    near = grams.join(long, "k").select("doc_id", "item_id", "p").join(low, "doc_id").where(F.contains("t", "p")).select("doc_id", "item_id")
    # short passages in one list, each document looked through once; a passage of six words can't be rarer
    short = want.where("size(w) < 7 and p <> ''").agg(F.collect_list(F.struct("item_id", "p")).alias("short"))
    some = low.join(short).select("doc_id", F.explode(F.filter("short", lambda x: F.contains(F.col("t"), x["p"]))).alias("x")).select("doc_id", "x.item_id")
    return near.union(some).distinct()


def _supplier_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A label document and an extracted page per supplier: a scalar that is right, misread or missing, and two
    table rows of which some have each other's figures."""
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.concat(F.lit("s"), "s_suppkey").alias("doc_id"), (F.col("s_suppkey") * 7919 + 1_000_000).cast("string").alias("v"), (F.col("s_suppkey") * 104_729 + 20_000_000).cast("string").alias("a"), (F.col("s_suppkey") * 1_299_709 + 500_000_000).cast("string").alias("b"))
    k = F.col("s_suppkey")
    row = lambda n, v: F.struct(F.lit(None).cast("string").alias("key"), F.lit(n).alias("anchor"), F.create_map(F.lit("total"), v).alias("cells"))
    truth = s.select("doc_id", F.create_map(F.lit("due"), F.col("v"), F.lit("title"), F.lit("Statement of account")).alias("printed"), F.array(row("Deposits", F.col("a")), row("Securities", F.col("b"))).alias("rows"))
    read = F.when(k % 4 == 1, F.concat(F.substring("v", 1, 4), F.lit("x"), F.substring("v", 6, 9))).when(k % 4 == 2, "").when(k % 4 == 3, F.concat(F.substring("v", 1, 4), ((F.substring("v", 5, 1).cast("int") + 5) % 10).cast("string"), F.substring("v", 6, 9))).otherwise(F.col("v"))
    swap = k % 5 == 0
    lines = F.array(F.lit("# STATEMENT of account"), F.concat(F.lit("Due: "), read), F.concat(F.lit("Deposits | "), F.when(swap, F.col("b")).otherwise(F.col("a"))), *(F.lit(f"filler {c}") for c in "pqrst"), F.concat(F.lit("Securities | "), F.when(swap, F.col("a")).otherwise(F.col("b"))))
    return s.select(F.concat(F.lit("run"), F.col("s_nationkey") % 3).alias("parser"), "doc_id", F.lit(300).alias("dpi"), F.array_join(lines, "\n").alias("text")), truth


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.verdicts(*_supplier_pages(spark, sf_dir)).select("parser", "doc_id", "field", "printed", "status", "got", F.col("distance").cast("long").alias("distance"), "typed")


def grade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = summary.summarise(summary.page_counts(match.verdicts(*_supplier_pages(spark, sf_dir))))
    return s.select("parser", "dpi", "pages", "fields", "ok", "absent", "corrupt", "corrupt_typed", "corrupt_junk", "misplaced", "recovery", "quiet_fraction", "rows_anchored", "rows")


def recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovery in percent by nation and return flag, with a row for all."""
    items, part = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    pages = items.join(part, items.l_partkey == part.p_partkey).groupBy(F.col("p_brand").alias("doc_id"), F.col("l_returnflag").alias("parser")).agg(F.count_if(F.col("l_quantity") > 10).alias("ok"), F.count(F.lit(1)).alias("n_fields"))
    return summary.recovery_pivot(pages, ["A", "N", "R"])


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = _table(spark, sf_dir, "events").select(F.concat(F.lit("run"), F.col("user_id") % 3).alias("run"), F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")).alias("model"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 300).alias("output_tokens"))
    return cost.report(used, spark.createDataFrame(PRICES, "model string, in_per_mtok double, out_per_mtok double"))


def dead_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("parser"), F.when(F.col("lang") == "en", F.lit(" \f\n")).otherwise(F.col("text")).alias("text"), F.when(F.col("doc_id") % 10 == 0, "TimeoutError: late").alias("error"))
    return runs.dead_runs(docs)


def upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and type: those of even ids are rerun, the latest wins."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return sinks.upsert(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), ["user_id", "event_type"], "event_id")


def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return runs.cross_jobs(docs, spark.createDataFrame([(150,), (300,)], "dpi int")).select("doc_id", "source", "dpi")


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("parser"), F.when(F.col("event_id") % 2 == 0, 150).otherwise(300).alias("dpi"), F.floor("value").alias("seconds"), F.when(F.col("event_id") % 9 == 0, "Error: x").alias("error"))
    return summary.mean_seconds(e)


def page_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select("p_partkey", F.array(F.struct((F.col("p_size") * 40).alias("width"), (F.col("p_size") * 50).alias("height"))).alias("images"), F.when(F.col("p_partkey") % 10 < 3, (F.col("p_partkey") % 10 + 99).cast("int")).otherwise((F.col("p_partkey") % 200).cast("int")).alias("text_layer_chars"))
    out = runs.page_class(p).withColumn("scale", F.bround(runs.image_scale(F.col("images")[0]["width"], F.col("images")[0]["height"], 1500), 6))
    return out.select("p_partkey", "page_backed", "layer", "scale")


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in folded form, by lines; the folding's Unicode step has no SQL form."""
    d = _table(T.bounded(spark), sf_dir, "documents").select("doc_id", T.lines(T.fold(F.coalesce("text", F.lit("")))).alias("l"))
    return d.select("doc_id", F.size("l").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("digest"))


QUERIES = {f.__name__: f for f in (rule_sums, rule_counts, rule_rows, rule_identities, figures, shapes, regrouped, nearest, table_rows, page_lines, passages, grades, grade_summary, recovery, costs, dead_runs, upserts, job_list, durations, page_classes, folded)} | rulings.QUERIES
