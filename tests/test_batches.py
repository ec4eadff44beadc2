"""Python workers are handed few texts at once."""

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from papertrace.functions import text as T
from papertrace.plans import queries

SF = "/root/testdata/sf0.001"


def test_folded_batches(spark):
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    queries.QUERIES["folded"](spark, SF)

    @F.arrow_udf(IntegerType())
    def handed(a: pa.Array) -> pa.Array:
        return pa.array([len(a)] * len(a), pa.int32())

    assert spark.range(0, 3000, 1, 1).select(handed("id").alias("n")).agg(F.max("n")).first()[0] <= T.BATCH_ROWS
    texts = ["plain", None, "", "a &amp; b", "café ﬁn"] * 30
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", T.fold("t").alias("f")).orderBy("i").collect()
    assert [r.f for r in got] == ["plain", None, "", "a & b", "cafe fin"] * 30
