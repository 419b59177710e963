import random

import pytest
from pyspark.sql import functions as F

from quern.errors import Conflict, NotFound, QueryError
from quern.operators.btree import OrderedSet
from quern.operators.graph import Edge, Graph
from quern.operators.table import Table
from quern.ranges import Bound, Range
from quern.schema import Column, TableSchema, promote

NAMES = TableSchema.of([("name", "string", 512)], [("views", "u32")], {"views": ["views"]})
WORDS = "zero one two three four five six seven eight nine ten eleven twelve".split()


def names(spark, n):
    rows = [(WORDS[i] if i < len(WORDS) else f"n{i:03d}", i) for i in range(n)]
    random.Random(n).shuffle(rows)
    return Table.load(spark, NAMES, rows)


@pytest.mark.parametrize("n", [0, 5, 15])
def test_load_and_count(spark, n):
    t = names(spark, n)
    assert t.count() == n and t.is_empty() == (n == 0)


def test_views(spark):
    t = names(spark, 50)
    assert [r["name"] for r in t.limit(1).rows().collect()] == ["eight"]
    assert [r["views"] for r in t.order_by(["views"], reverse=True).rows().collect()] == list(range(49, -1, -1))
    assert [r["views"] for r in t.where(views=slice(10, 20)).order_by(["views"]).rows().collect()] == list(range(10, 20))
    assert [tuple(r) for r in t.where(name="one").rows().collect()] == [("one", 1)]
    picked = t.select(["views"]).rows().collect()
    assert len(picked) == 50 and picked[0].asDict() == {"views": 8}  # in key order, the key itself gone
    assert t.contains(("one",)) and not t.contains(("none",)) and t.contains(views=slice(49, 60)) and not t.contains(views=slice(50, 60))
    assert t.read(("two",))["views"] == 2 and t.read(("none",)) is None
    assert t.where(views=Range(Bound(3, False), Bound(5))).count() == 2
    assert t.select(["views", "name"]).columns == ["views", "name"]
    assert {tuple(r) for r in t.aggregate([F.expr("views % 2").alias("odd")], n=F.count("*")).collect()} == {(0, 25), (1, 25)}


def test_view_errors(spark):
    t = names(spark, 5)
    for bad in (lambda: t.where(nope=1), lambda: t.select(["nope"]), lambda: t.limit(2).where(views=1), lambda: t.limit(2).order_by(["views"]), lambda: t.limit(2).read(("one",)), lambda: t.where(views=1).upsert(("a",), (1,)), lambda: t.where(views=slice(1, 3)).where(views=slice(0, 2)), lambda: t.order_by(["views"]).order_by(["name"])):
        with pytest.raises(QueryError):
            bad()
    strict = Table(t.df, TableSchema(NAMES.key, NAMES.values), strict=True)
    with pytest.raises(QueryError):
        strict.where(views=1)
    assert t.limit(1).limit(3).rows().count() == 3


def test_writes(spark):
    t = names(spark, 50)
    assert t.truncate(views=slice(None, 40)).count() == 10
    assert t.update({"views": 0}, views=slice(None, 10)).where(views=slice(None, 1)).count() == 10
    assert t.delete(("one",)).count() == 49
    u = t.upsert(("one",), (100,))
    assert u.count() == 50 and u.read(("one",))["views"] == 100
    with pytest.raises(Conflict):
        t.insert(("one",), (1,))
    with pytest.raises(Exception, match="there already"):
        t.insert_rows(spark.createDataFrame([("one", 1)], NAMES.struct())).df.collect()
    with pytest.raises(QueryError):
        t.update({"name": "x"})
    with pytest.raises(Exception, match="out of range"):
        t.upsert(("big",), (-1,)).df.collect()
    short = TableSchema.of([("k", "string", 3)])
    with pytest.raises(Exception, match="too long"):
        Table.create(spark, short).upsert(("long",)).df.collect()
    none = t.df.limit(0).select("name")
    merged = t.merged([(spark.createDataFrame([("one", 7), ("new", 8)], NAMES.struct()), none), (t.df.limit(0), spark.createDataFrame([("new",), ("two",)], "name string"))])
    assert merged.count() == 49 and merged.read(("one",))["views"] == 7 and merged.read(("new",)) is None


def test_copies_and_classes(spark):
    from quern.functions.values import class_of

    t = names(spark, 5)
    assert t.where(views=slice(1, 3)).copy().upsert(("x",), (9,)).count() == 3 and t.limit(2).copy().count() == 2
    assert class_of(t) == "collection/table" and class_of(1) == "scalar/value/number/int/64" and class_of(None) == "scalar/value/none"


def test_null_is_a_key(spark):
    t = Table.load(spark, TableSchema.of([("k", "i64")], [("v", "i64")]), [(None, 1), (2, 2)])
    assert t.rows().first()["k"] is None and t.upsert((None,), (5,)).count() == 2 and t.where(k=None).count() == 1


def test_schema():
    with pytest.raises(QueryError):
        Column("a", "i32", 5)
    with pytest.raises(QueryError):
        Column("a", "string")
    with pytest.raises(QueryError):
        TableSchema.of([("a", "i32")], [], {"i": ["b"]})
    assert promote("i16", "u32") == "i16" and promote("f32", "i64") == "f32" and promote("c32", "f64") == "c32"


def test_ordered_set(spark):
    columns = [("number", "i64"), ("word", "string", 100)]
    b = OrderedSet.create(spark, columns).insert([(i, f"w{i}") for i in random.Random(1).sample(range(0, 100), 100)])
    assert b.count() == 100 and b.insert((1, "w1")).count() == 100 and b.count((1,)) == 1 and b.slice((), slice(29, 32)).keys().count() == 3
    assert b.first()["number"] == 0 and b.reverse().first()["number"] == 99 and b.slice((), slice(29, 32)).reverse().first()["number"] == 31
    assert b.delete().is_empty() and b.delete((), slice(10, 20)).count() == 90 and b.contains((5, "w5")) and not b.contains((5, "x"))
    with pytest.raises(NotFound):
        b.delete().first()
    with pytest.raises(QueryError):
        b.slice((1,)).insert((1, "x"))


def test_graph(spark):
    region, user = TableSchema.of([("r", "i64")], [("n", "string", 9)]), TableSchema.of([("u", "i64")], [("region", "i64")])
    g = Graph({"region": Table.load(spark, region, [(1, "a"), (2, "b")]), "user": Table.load(spark, user, [(10, 1), (11, 1), (12, 2)])}, {("user", "region"): "region"})
    with pytest.raises(NotFound):
        g.upsert("user", (13,), (9,))
    with pytest.raises(Conflict):
        g.delete_row("region", (1,))
    h = g.upsert("user", (13,), (2,)).delete_row("region", (1,), cascade=True)
    assert sorted(r["u"] for r in h.table("user").df.collect()) == [12, 13] and h.table("region").count() == 1
    assert g.max_id("user").first()[0] == 12
    line = Edge.of(spark.createDataFrame([(i, i + 1) for i in range(6)] + [(3, 0)], "a long, b long"), "a", "b")
    ids = spark.createDataFrame([(0,)], "id long")
    assert {tuple(r) for r in line.match(ids, 3, incoming=False).collect()} == {(1, 1), (2, 2), (3, 3)}
    assert {tuple(r) for r in line.match(ids, 9).collect()} == {(3, 1), (2, 2), (1, 3)}
    assert line.tensor(7, 7).sum(1).df.count() == 6
