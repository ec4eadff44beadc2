"""Rules of one document are judged where the document lies: the tables are shuffled once, to make the documents."""

import pytest
from pyspark.sql import functions as F

from papertrace.operators import rules
from papertrace.plans import queries, rulings

SF = "/root/testdata/sf0.001"
KINDS = "doc_id string, printed map<string,string>, rows array<struct<key:string,anchor:string,cells:map<string,string>>>, reconciliation struct<sums:array<struct<name:string,of:array<string>,minus:array<string>,equals:string,tolerance:double>>,row_rules:array<struct<name:string,of:array<string>,equals:string,cells:array<string>,tolerance:double>>>"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_one_shuffle(spark):
    assert shuffles(queries.QUERIES["sum_rules"](spark, SF)) == 1
    assert shuffles(queries.QUERIES["rule_rows"](spark, SF)) == 1
    assert shuffles(queries.QUERIES["rule_report"](spark, SF)) == 2  # and the few counts
    assert shuffles(rules.judge(rules.seen(rules.terms(rulings._order_truth(spark, SF)), None))) == 1


def test_pages_beside_rules(spark):
    """Pages that lie beside the rules say what the same verdicts say as rows."""
    truth = rulings._order_truth(spark, SF).where("cast(doc_id as long) < 40")
    rows = rulings._order_truth(spark, SF).where("cast(doc_id as long) < 40").select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.parser", "p.dpi", F.explode("p.fields").alias("field", "v")).select("parser", "doc_id", "dpi", "field", "v.status", "v.got")
    low = rows.withColumn("dpi", F.lit(1)).withColumn("status", F.lit("ABSENT"))
    cols = ["parser", "doc_id", "rule", "status", "total", "target", "notes"]
    beside = rules.judge(rules.seen(rules.terms(truth), "pages")).select(cols).collect()
    assert sorted(beside, key=str) == sorted(rules.judge(rules.seen(rules.terms(truth.drop("pages")), rows.union(low))).select(cols).collect(), key=str) and len(beside) > 40


@pytest.mark.parametrize("of, rows, says", [(["a", "none"], [], "none is neither a row cell"), (["a"], [(None, "r", {"x": "1"}), (None, "r", {"x": "2"})], "duplicate cell reference r.x in d")])
def test_wrong_labels(spark, of, rows, says):
    truth = spark.createDataFrame([("d", {"a": "1"}, rows, ([("s", of, None, "a", None)], []))], KINDS)
    with pytest.raises(Exception, match=says):
        rules.judge(rules.seen(rules.terms(truth), None)).collect()
