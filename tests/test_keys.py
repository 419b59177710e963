"""Null and repeated keys, inserts, stores under competition."""

import threading

import pytest
from pyspark.sql import functions as F

from quern.errors import Conflict, QueryError
from quern.operators.table import Table
from quern.schema import TableSchema, bounds
from quern.sources import snapshots, storage
from quern.sources.snapshots import Store

SCHEMA = TableSchema.of([("k", "i64"), ("l", "string", 9)], [("v", "string", 20)])


def made(spark, rows):
    return spark.createDataFrame(rows, "k long, l string, v string")


@pytest.fixture
def table(spark):
    return Table.copy_from(SCHEMA, made(spark, [(1, "a", "x"), (None, "a", "y"), (2, None, "z"), (None, None, "w")]), True)


def values(df):
    return sorted(r["v"] for r in df.collect())


def test_nulls_are_keys(spark, table):
    keys = made(spark, [(None, "a", None), (2, None, None), (9, "a", None)]).select("k", "l")
    assert values(table.read_rows(keys)) == ["y", "z"] and values(table.delete_rows(keys).df) == ["w", "x"]
    assert values(table.upsert_rows(made(spark, [(None, None, "new"), (3, "c", "more")])).df) == ["more", "new", "x", "y", "z"]
    assert values(table.merged([(made(spark, [(None, "a", "put")]), keys.where("k = 2"))]).df) == ["put", "w", "x"]


def test_of_rows_with_one_key_the_same_stays(spark, table):
    rows = [(1, "a", v) for v in ("p", "q", "r")]
    for df in (made(spark, rows), made(spark, rows[::-1]).repartition(3)):
        assert "r" in values(table.upsert_rows(df).df) and "q" not in values(table.upsert_rows(df).df)
        aged = df.withColumn("age", F.when(F.col("v") == "p", 9).otherwise(1))
        assert "p" in values(table.upsert_rows(aged, latest="age").df)
        assert values(table.merged([(df, df.select("k", "l").limit(0))]).df)[0] == "r"


def test_inserts_refuse_keys_that_are_there(spark, table):
    assert values(table.insert_rows(made(spark, [(7, "n", "1"), (None, "n", "2")])).df) == ["1", "2", "w", "x", "y", "z"]
    for bad in ([(None, "a", "1")], [(8, "n", "1"), (8, "n", "2")]):
        with pytest.raises(Exception, match="a key is there already"):
            table.insert_rows(made(spark, bad)).df.collect()


def test_deltas_are_merged_and_compacted(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    tx = store.begin()
    tx.put("t", Table.copy_from(SCHEMA, made(spark, [(i, "a", str(i)) for i in range(5)]), True))
    tx.commit()
    want = {i: str(i) for i in range(5)}
    for i in range(snapshots.DELTAS + 2):
        tx = store.begin()
        tx.upsert("t", (i % 6, "a"), (f"new{i}",))
        tx.delete("t", (4, "a"))
        want |= {i % 6: f"new{i}"}
        want.pop(4, None)
        tx.commit()
        held = store.manifest()["tables"]["t"]["deltas"]
        assert len(held) <= snapshots.DELTAS and {r["k"]: r["v"] for r in store.table("t").df.collect()} == want
    assert {r["k"]: r["v"] for r in store.table("t", 1).df.collect()} == {i: str(i) for i in range(5)} and len(store.history()) == snapshots.DELTAS + 3
    assert store.log().groupBy("op").count().collect() and store.log().count() == 1 + 2 * (snapshots.DELTAS + 2)


def test_one_of_many_claims_a_version(spark, tmp_path):
    won = []

    def go(n):
        try:
            snapshots.claim(spark, str(tmp_path / "versions" / "1.json"), str(n))
            won.append(n)
        except Conflict:
            pass

    threads = [threading.Thread(target=go, args=(n,)) for n in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(won) == 1 and (tmp_path / "versions" / "1.json").read_text() == str(won[0]) and len(list((tmp_path / "versions").glob("*.json"))) == 1


def test_a_lost_commit_leaves_no_log(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    a, b = store.begin(), store.begin()
    for tx, v in ((a, "a"), (b, "b")):
        tx.put("t", Table.copy_from(SCHEMA, made(spark, [(1, "a", v)]), True), detail=v)
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    assert [tuple(r) for r in store.log().collect()] == [(1, "t", "put", "a")] and values(store.table("t").df) == ["a"]


def test_a_cluster_must_name_its_shared_folder(spark):
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(QueryError):
        storage.shared_dir(Session)


def test_bounds():
    assert bounds("u8") == (0, 255) and bounds("i16") == (-32768, 32767)
    with pytest.raises(QueryError):
        bounds("f64")
