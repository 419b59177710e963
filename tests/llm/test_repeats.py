"""Mixing where ids are null or repeat, many sources, and places in the captures' order."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm import mixing, queries, warc


def totals(spark, df):
    return {r["source"]: (r["t"], r["m"]) for r in mixing.taken(mixing.sized(df, keep=["source"])).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("m")).collect()}


def test_rows_of_null_and_equal_ids_draw_for_themselves(spark):
    like = spark.range(3000).selectExpr("CAST(NULL AS long) AS doc_id", "repeat('word ', 10) AS text", "CAST(id % 3 AS string) AS source")
    for df in (like, like.withColumn("doc_id", F.lit(7).cast("long")), like.withColumn("text", F.concat("text", F.rand(1).cast("string")))):
        got = totals(spark, df)
        assert set(got) == {"0", "1", "2"} and all(abs(t - m) <= 0.1 * m for t, m in got.values()), got
    assert sorted(r["n"] for r in mixing.mix(like).groupBy("source").agg(F.count("*").alias("n")).collect()) == sorted(t // 10 for t, _ in totals(spark, like).values())
    # like rows are numbered from 1 without gaps, whatever tasks they come to
    again = [r["__occurrence"] for r in mixing.numbered(mixing.sized(like.where("source = '1'").repartition(7))).select("__occurrence").collect()]
    assert sorted(again) == list(range(1, 1001))


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_brute_force(spark, monkeypatch, seed):
    """Ranks over several ranges of sources, and water-filling, against a plain loop."""
    monkeypatch.setattr(mixing, "RANKED", 5)
    rng = random.Random(seed)
    sizes = {(f"s{k}" if k else None): rng.choice([0, 1, 5, 40, 700, 9000]) * rng.randint(1, 9) for k in range(23)}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "__source string, size long")
    got = {r["__source"]: (r["source_size"], r["target"]) for r in mixing.targets(df).collect()}
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: k % 3 + 1 for k, s in enumerate(order)}
    full: set = set()
    while True:
        rest, left = sum(sizes.values()) - 3 * sum(sizes[s] for s in full), sum(w[s] for s in sizes if s not in full)
        more = {s for s in sizes if s not in full and 3 * sizes[s] * left < w[s] * rest}
        if not more:
            break
        full |= more
    want = {s: (sizes[s], 3.0 * sizes[s] if s in full else w[s] * rest / left) for s in sizes}
    assert got.keys() == want.keys() and all(got[s] == (want[s][0], pytest.approx(want[s][1])) for s in want)


def test_places_and_null_ids_agree_with_sql(spark):
    long = "x" * 1200
    rows = [(None, "http://www.b.example.org/p?z=1&a=2#f", long), (3, "https://b.example.org:8080/p", long), (9, "http://a.example.org", long), (4, None, None), (None, "http://a.example.org/q", "y" * 1100), (5, "http://a.example.org/", "short"), (6, "http://b.example.org/p?a=2&z=1", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index, folder = warc.archive(pages)
    got = [tuple(r) for r in warc.read_archives(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "place").collect()]
    c = duckdb.connect()
    c.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = c.execute(queries.SQL["op2_warc"]).fetchall()
    strip = lambda found: sorted((r[:5] for r in found), key=str)
    assert strip(got) == strip(want) and {r[3] for r in got if r[0] is None} == {"revisit", "response"}
    order = [k for _, k in sorted((r[5], warc.urlkey(dict((p, u) for p, u, _ in rows).get(r[0]))) for r in got if r[0] is not None)]
    assert sorted(r[5] for r in got) == list(range(len(rows))) and order == sorted(order)
