"""Scalars against a table of cases, rules and grading on small fixtures, and each query against its SQL."""

import glob
import math
import os

import duckdb
import pytest

from papertrace.functions import text as T
from papertrace.operators import rules, runs
from papertrace.plans import oracles, queries

SF = "/root/testdata/sf0.001"
CASES = {
    T.canon: [("(29,569)", "-29569"), ("-29,569", "-29569"), ("29,569", "29569"), ("($657,500,000).", "657500000"), ("$7,126.11", "7126.11"), ("+3,615.08", "3615.08"), ("-20.00", "-20.00")],
    T.join_thousands: [("132 434 809", "132434809"), ("10 115.92", "10 115.92"), ("132 434 809.5", "132434 809.5"), ("12 345 6789", "12345 6789"), ("1000 Walnut", "1000 Walnut"), ("05-18 05-19", "05-18 05-19")],
    T.num: [("(29,569)", -29569.0), ("($657,500,000).", 657500000.0), ("11311-", None), ("(Note 3)", None), ("A79", None), ("1,810,140,116", 1810140116.0), ("$8,346,249", 8346249.0), ("2,027,324!", 2027324.0), ("", None), ("-", None)],
    T.fold: [("S.R. Batliboi &amp; Associates", "S.R. Batliboi & Associates")],
    T.html_rows: [("<tr><td>1</td><td>a</td></tr>", "1 | a"), ("<p>x</p>", "x"), ("<table><tr><th>a</th></tr><tr><td> </td></tr></table>", "a")],
    T.shape: [("29,569", "money"), ("2020-01-31", "date"), ("PO-17", "po"), ("LN-10NY", "sku"), ("Place", "text")],
}


@pytest.mark.parametrize("f", CASES, ids=lambda f: f.__name__)
def test_scalars(spark, f):
    got = [r.y for r in spark.createDataFrame([(i, a) for i, (a, _) in enumerate(CASES[f])], "i int, x string").select("i", f("x").alias("y")).orderBy("i").collect()]
    assert got == [b for _, b in CASES[f]]
    assert spark.createDataFrame([(None,)], "x string").select(f("x").alias("y")).first() is not None


def test_tokens_and_alphabet(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("unrealized loss of (29,569) on the fund", "9", "x"), ("Place:Kolkata", "LN-10NY", "LN-1ONY"), ("", "9", "#")], "t string, p string, g string")
    got = df.select(T.tokens("t").alias("t"), T.stays_in_alphabet("p", "g").alias("ok")).collect()
    assert "(29,569)" in got[0].t and got[1].t == ["Place", "Kolkata"] and got[2].t == []
    assert [r.ok for r in got] == [False, True, False]
    assert df.select(F.size(T.lines(F.lit("a\x0c\n \nb")))).first()[0] == 2


def test_rules(spark):
    kinds = "doc_id string, printed map<string,string>, rows array<struct<key:string,anchor:string,cells:map<string,string>>>, reconciliation struct<sums:array<struct<name:string,of:array<string>,minus:array<string>,equals:string,tolerance:double>>,row_rules:array<struct<name:string,of:array<string>,equals:string,cells:array<string>,tolerance:double>>>"
    sums = [("ok", ["a", "b"], None, "c", None), ("minus", ["c"], ["a"], "b", None), ("literal", ["a"], None, "10", None), ("at", ["a", "b"], None, "d", 5.0), ("over", ["a", "b"], None, "d", 4.0), ("cell", ["r1.x"], None, "a", None)]
    printed = {"a": "10", "b": "$20", "c": "30", "d": "35", "10": "10"}
    rows = [(None, "r1", {"x": "10", "y": "4", "z": "6"}), ("k", "r2", {"x": "1"})]
    truth = spark.createDataFrame([("doc", printed, rows, (sums, [("net", None, None, ["x", "y", "z"], None)]))], kinds)
    spoken = rules.terms(truth)
    got = {r.rule: r.status for r in rules.judge(rules.seen(spoken, None)).collect()}
    assert got == {"ok": "HOLDS", "minus": "HOLDS", "literal": "HOLDS", "at": "HOLDS", "over": "BROKEN", "cell": "HOLDS", "net[r1]": "HOLDS"}
    with pytest.raises(rules.LabelsDisagree):
        rules.gate(rules.judge(rules.seen(spoken, None)))
    v = [("p", "doc", 300, "a", "CORRUPT", "10"), ("p", "doc", 300, "b", "OK", None), ("p", "doc", 300, "c", "MISPLACED", "30"), ("p", "doc", 300, "d", "CORRUPT", "3x5"), ("p", "doc", 300, "rows[0].x", "ABSENT", None)]
    verdicts = spark.createDataFrame(v, "parser string, doc_id string, dpi int, field string, status string, got string")
    got = {r.rule: r.status for r in rules.judge(rules.seen(spoken, verdicts)).collect()}
    assert got["ok"] == "SURVIVES" and got["at"] == "INCOMPLETE" and got["cell"] == "INCOMPLETE" and got["net[r1]"] == "INCOMPLETE"


def test_runs(spark):
    pages = spark.createDataFrame([("a", "\x0c", None), ("a", " ", None), ("b", "\x0c", None), ("b", "x", None), ("c", None, "E: x")], "parser string, text string, error string")
    assert [(r.parser, r.n_pages) for r in runs.dead_runs(pages).collect()] == [("a", 2)]

    def work(job):
        if job["doc_id"] == "bad":
            raise ValueError("no")
        return "text"

    jobs = spark.createDataFrame([("good", 150), ("bad", 150)], "doc_id string, dpi int")
    out = {r.doc_id: r for r in runs.extract(jobs, "p", work).collect()}
    assert out["good"].chars == 4 and out["good"].error is None and out["bad"].error == "ValueError: no" and out["bad"].text is None


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "" if v is None else f"{float(v):.9g}" if v.__class__.__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", oracles.ORACLE_SQL)
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(oracles.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
