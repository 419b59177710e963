"""Whole orders: every row has its place, over many ranges and with ties and nulls."""

from pyspark.sql import functions as F

from quern import queries
from quern.operators.table import placed

SF = "/root/testdata/sf0.001"


def test_every_row_has_its_place(spark):
    rows = [(i, None if i % 7 == 0 else i * 37 % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(5)
    got = {r["id"]: r["position"] for r in placed(df, [F.col("v").asc_nulls_first(), F.col("id").asc_nulls_first()]).collect()}
    want = sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[0]))
    assert got == {r[0]: k for k, r in enumerate(want, 1)} and placed(df.limit(0), [F.col("id")]).count() == 0


def test_queries_place_all_rows(spark):
    n = spark.read.parquet(f"{SF}/customer.parquet").count()
    for name in ("table_order_by", "table_order_by_desc", "table_reverse"):
        assert sorted(r["position"] for r in queries.QUERIES[name](spark, SF).select("position").collect()) == list(range(1, n + 1)), name
