"""Registered queries of the engine's operators, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import collections as C
from .functions import number as N
from .functions import values as V
from .operators.btree import OrderedSet
from .operators.einsum import einsum
from .operators.graph import Edge, Graph
from .operators.table import Table
from .operators.tensor import Tensor
from .plans import autodiff as ad
from .plans import linalg, ml, ops
from .plans.differentiable import differentiable
from .ranges import Bound, Range
from .schema import TableSchema, bounds
from .sources import files
from .sources.snapshots import Store, hash_chain
from .sources.storage import new_path
from .streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


S, L, I, D = "string", "i64", "i32", "f64"
SCHEMAS = {
    "region": TableSchema.of([("r_regionkey", I)], [("r_name", S, 100)]),
    "nation": TableSchema.of([("n_nationkey", I)], [("n_name", S, 100), ("n_regionkey", I)], {"region": ["n_regionkey"]}),
    "customer": TableSchema.of([("c_custkey", L)], [("c_name", S, 100), ("c_nationkey", I), ("c_acctbal", D), ("c_mktsegment", S, 100)], {"nation": ["c_nationkey"], "balance": ["c_acctbal"]}),
    "orders": TableSchema.of([("o_orderkey", L)], [("o_custkey", L), ("o_orderstatus", S, 10), ("o_totalprice", D), ("o_orderpriority", S, 100)], {"customer": ["o_custkey"], "price": ["o_totalprice"]}),
    "part": TableSchema.of([("p_partkey", L)], [("p_name", S, 200), ("p_brand", S, 100), ("p_type", S, 100), ("p_size", I), ("p_retailprice", D)], {"size": ["p_size"]}),
    "conversations": TableSchema.of([("conv_id", L), ("turn", L)], [("role", S, 100), ("text", S, 10_000_000)]),
}


def table(spark, sf_dir, name) -> Table:
    """The driver's natural keys are unique, so nothing is deduplicated."""
    schema = SCHEMAS[name]
    return Table(read(spark, sf_dir, name).select(*schema.names), schema)


# -- tables

@query("table_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(s, d):
    return table(s, d, "nation").rows()


@query("table_select", "SELECT c_acctbal, c_name FROM customer")
def _(s, d):
    return table(s, d, "customer").select(["c_acctbal", "c_name"]).df.select("c_acctbal", "c_name")


@query("table_where_eq", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(s, d):
    return table(s, d, "orders").where(o_orderstatus="F").select(["o_orderkey", "o_custkey", "o_totalprice"]).df.select("o_orderkey", "o_custkey", "o_totalprice")


@query("table_where_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 50000 AND o_totalprice < 100000")
def _(s, d):
    return table(s, d, "orders").where(o_totalprice=slice(50000, 100000)).df.select("o_orderkey", "o_totalprice")


@query("table_where_conj", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0 AND c_acctbal <= 5000")
def _(s, d):
    return table(s, d, "customer").where(c_nationkey=3, c_acctbal=Range(Bound(0, False), Bound(5000))).df.select("c_custkey", "c_name", "c_acctbal")


@query("table_reslice", "SELECT p_partkey, p_size FROM part WHERE p_size >= 20 AND p_size < 30")
def _(s, d):
    return table(s, d, "part").where(p_size=slice(10, 40)).where(p_size=slice(20, 30)).df.select("p_partkey", "p_size")


@query("table_read_key", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey = 7")
def _(s, d):
    return table(s, d, "orders").where(o_orderkey=7).rows()


@query("table_read_composite", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 AND turn = 1")
def _(s, d):
    return table(s, d, "conversations").where(conv_id=3, turn=1).rows()


@query("table_read_rows", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def _(s, d):
    keys = table(s, d, "orders").where(o_totalprice=Range(Bound(200000, False))).df.select(F.col("o_custkey").alias("c_custkey"))
    return table(s, d, "customer").read_rows(keys).select("c_custkey", "c_name")


def _exists(df: DataFrame) -> DataFrame:
    return df.limit(1).agg((F.count("*") > 0).alias("found"))


@query("table_contains_key", "SELECT count(*) > 0 AS found FROM customer WHERE c_custkey = 5")
def _(s, d):
    return _exists(table(s, d, "customer").where(c_custkey=5).df)


@query("table_contains_range", "SELECT count(*) > 0 AS found FROM customer WHERE c_acctbal < -100000")
def _(s, d):
    return _exists(table(s, d, "customer").where(c_acctbal=slice(None, -100000)).df)


@query("table_is_empty", "SELECT count(*) = 0 AS empty FROM customer WHERE c_nationkey = 4")
def _(s, d):
    return table(s, d, "customer").where(c_nationkey=4).df.limit(1).agg((F.count("*") == 0).alias("empty"))


@query("table_count", "SELECT count(*) AS n FROM orders")
def _(s, d):
    return table(s, d, "orders").counted()


@query("table_count_range", "SELECT count(*) AS n FROM orders WHERE o_custkey >= 10 AND o_custkey < 50")
def _(s, d):
    return table(s, d, "orders").counted(o_custkey=slice(10, 50))


for _name, _view, _sql in (
    ("order_by", lambda t: t.order_by(["c_acctbal"]).select(["c_custkey", "c_acctbal"]), "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS position FROM customer"),
    ("order_by_desc", lambda t: t.order_by(["c_acctbal"], reverse=True).select(["c_custkey", "c_acctbal"]), "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey DESC) AS position FROM customer"),
    ("reverse", lambda t: t.reverse().select(["c_custkey", "c_name"]), "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey DESC) AS position FROM customer"),
):
    query(f"table_{_name}", _sql)(lambda s, d, v=_view: v(table(s, d, "customer")).placed())


@query("table_limit", "SELECT p_partkey, p_brand FROM part ORDER BY p_partkey LIMIT 13")
def _(s, d):
    return table(s, d, "part").select(["p_partkey", "p_brand"]).limit(50).limit(13).rows()


@query("table_topk", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey >= 5 AND c_nationkey < 10 ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 10")
def _(s, d):
    return table(s, d, "customer").where(c_nationkey=slice(5, 10)).order_by(["c_acctbal"], True).select(["c_custkey", "c_name", "c_acctbal"]).limit(10).rows()


for _name, _agg, _sql in (
    ("count", lambda: F.count("*"), "count(*)"), ("sum", lambda: F.round(F.sum("l_quantity"), 4), "round(sum(l_quantity), 4)"), ("avg", lambda: F.round(F.avg("l_extendedprice"), 4), "round(avg(l_extendedprice), 4)"),
    ("min", lambda: F.min("l_discount"), "min(l_discount)"), ("max", lambda: F.max("l_tax"), "max(l_tax)"),
):

    def _q(s, d, agg=_agg):
        return Table(read(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax"), TableSchema(())).aggregate(["l_returnflag", "l_linestatus"], v=agg())

    query(f"table_aggregate_{_name}", f"SELECT l_returnflag, l_linestatus, {_sql} AS v FROM lineitem GROUP BY l_returnflag, l_linestatus")(_q)


def _delta(s, d) -> DataFrame:
    """Changed and new customers, from those of nation 1."""
    c = read(s, d, "customer").where("c_nationkey = 1")
    cols = SCHEMAS["customer"].names
    old = c.withColumn("c_acctbal", F.col("c_acctbal") + 1)
    new = c.withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return old.select(*cols).unionByName(new.select(*cols))


_C = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


@query("table_upsert", f"SELECT c_custkey, c_name, c_nationkey, c_acctbal + CASE WHEN c_nationkey = 1 THEN 1 ELSE 0 END AS c_acctbal, c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey = 1")
def _(s, d):
    return table(s, d, "customer").upsert_rows(_delta(s, d)).df


@query("table_insert_new", f"SELECT {_C} FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey = 1")
def _(s, d):
    return table(s, d, "customer").insert_rows(_delta(s, d).where("c_custkey >= 1000000")).df


@query("table_update_range", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _(s, d):
    return table(s, d, "customer").update({"c_acctbal": 0.0}, c_acctbal=slice(None, 0)).df.select("c_custkey", "c_acctbal")


@query("table_delete_key", "SELECT c_custkey, c_name FROM customer WHERE c_custkey <> 7")
def _(s, d):
    return table(s, d, "customer").delete((7,)).df.select("c_custkey", "c_name")


@query("table_truncate_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_totalprice < 100000)")
def _(s, d):
    return table(s, d, "orders").truncate(o_totalprice=slice(None, 100000)).df.select("o_orderkey", "o_totalprice")


@query("table_version_merge", f"SELECT {_C} FROM customer WHERE c_nationkey NOT IN (1, 2) UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1, c_mktsegment FROM customer WHERE c_nationkey = 1")
def _(s, d):
    t, cols = table(s, d, "customer"), SCHEMAS["customer"].names
    none = t.df.limit(0).select("c_custkey")
    new = _delta(s, d)
    later = read(s, d, "customer").where("c_nationkey = 2").select("c_custkey").unionByName(new.where("c_custkey >= 1000000").select("c_custkey"))
    return t.merged([(new, none), (t.df.limit(0).select(*cols), later)]).df


@query("table_join_aggregate", "SELECT c_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey < 5 GROUP BY c_custkey")
def _(s, d):
    o = table(s, d, "orders").df.withColumnRenamed("o_custkey", "c_custkey").select("c_custkey", "o_totalprice")
    c = table(s, d, "customer").where(c_nationkey=slice(None, 5)).df.select("c_custkey")
    return c.join(o, "c_custkey").groupBy("c_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("table_columns", "SELECT name, is_key FROM (VALUES ('c_custkey', true), ('c_name', false), ('c_nationkey', false), ('c_acctbal', false), ('c_mktsegment', false)) t(name, is_key)")
def _(s, d):
    t = table(s, d, "customer")
    return s.createDataFrame([(c, c in t.key_columns) for c in t.columns], "name string, is_key boolean")




def _reread(s, made):
    """What is read back of a table or tensor saved in the shared folder."""
    path = new_path(s, "saved")
    files.save(made, path)
    return files.load(s, path)


query("table_save_load", f"SELECT {_C} FROM customer")(lambda s, d: _reread(s, table(s, d, "customer")).df.select(*SCHEMAS["customer"].names))
query("table_copy_view", "SELECT c_name, c_acctbal FROM customer WHERE c_acctbal < 0")(lambda s, d: table(s, d, "customer").where(c_acctbal=slice(None, 0)).select(["c_name", "c_acctbal"]).copy().df.select("c_name", "c_acctbal"))
query("btree_copy_from", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")(lambda s, d: OrderedSet.copy_from([("o_orderstatus", S, 10), ("o_orderpriority", S, 100)], read(s, d, "orders")).df)

# -- ordered sets

_B = [("l_returnflag", S, 1), ("l_linestatus", S, 1), ("l_linenumber", I)]
_BC = "l_returnflag, l_linestatus, l_linenumber"


def lines(s, d) -> OrderedSet:
    return OrderedSet.copy_from(_B, read(s, d, "lineitem"))


for _name, _view, _sql in (
    ("keys", lambda b: b.keys(), f"SELECT DISTINCT {_BC} FROM lineitem"),
    ("prefix", lambda b: b.slice(("A",)).keys(), f"SELECT DISTINCT {_BC} FROM lineitem WHERE l_returnflag = 'A'"),
    ("range", lambda b: b.slice(("N", "O"), slice(2, 5)).keys(), f"SELECT DISTINCT {_BC} FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber >= 2 AND l_linenumber < 5"),
    ("reverse", lambda b: b.reverse().placed(), f"SELECT {_BC}, row_number() OVER (ORDER BY l_returnflag DESC, l_linestatus DESC, l_linenumber DESC) AS position FROM (SELECT DISTINCT {_BC} FROM lineitem)"),
    ("first", lambda b: b.first_key(), f"SELECT DISTINCT {_BC} FROM lineitem ORDER BY {_BC} LIMIT 1"),
    ("count", lambda b: b.df.agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM (SELECT DISTINCT {_BC} FROM lineitem)"),
    ("count_range", lambda b: b.slice(("R",)).df.agg(F.count("*").alias("n")), f"SELECT count(*) AS n FROM (SELECT DISTINCT {_BC} FROM lineitem WHERE l_returnflag = 'R')"),
    ("delete", lambda b: b.delete(("A",)).df, f"SELECT DISTINCT {_BC} FROM lineitem WHERE l_returnflag <> 'A'"),
    ("delete_all", lambda b: b.delete().df, f"SELECT DISTINCT {_BC} FROM lineitem WHERE false"),
    ("insert", lambda b: b.insert([("Z", "Z", 1), ("A", "F", 1)]).df, f"SELECT DISTINCT {_BC} FROM (SELECT {_BC} FROM lineitem UNION ALL SELECT 'Z', 'Z', 1 UNION ALL SELECT 'A', 'F', 1)"),
    ("insert_set", lambda b: b.delete(("A",)).insert(b.slice(("A",))).df, f"SELECT DISTINCT {_BC} FROM lineitem"),
    ("difference", lambda b: b.difference(b.slice(("N", "O"))).df, f"SELECT DISTINCT {_BC} FROM lineitem WHERE NOT (l_returnflag = 'N' AND l_linestatus = 'O')"),
    ("intersection", lambda b: b.intersection(b.slice(("N",))).df, f"SELECT DISTINCT {_BC} FROM lineitem WHERE l_returnflag = 'N'"),
):
    query(f"btree_{_name}", _sql)(lambda s, d, v=_view: v(lines(s, d)))


# -- numbers

_X, _U = "c_acctbal", "((c_acctbal + 1000) / 12000)"
_UNARY_SQL = {
    "abs": (_X, "abs({0})"), "exp": (_U, "exp({0})"), "ln": (f"({_U} + 1)", "ln({0})"), "sin": (_X, "sin({0})"), "asin": (_U, "asin({0})"), "sinh": (_U, "sinh({0})"), "asinh": (_X, "asinh({0})"), "cos": (_X, "cos({0})"), "acos": (_U, "acos({0})"),
    "cosh": (_U, "cosh({0})"), "acosh": (f"({_U} + 2)", "acosh({0})"), "tan": (_U, "tan({0})"), "atan": (_X, "atan({0})"), "tanh": (_U, "tanh({0})"), "atanh": (f"({_U} / 2)", "atanh({0})"), "real": (_X, "{0}"), "imag": (_X, "0.0 * {0}"), "neg": (_X, "-{0}"), "sqrt": (f"({_U} + 1)", "sqrt({0})"),
}
for _op, (_arg, _sql) in _UNARY_SQL.items():
    query(f"num_{_op}", f"SELECT c_custkey, round({_sql.format(_arg)}, 6) + 0.0 AS v FROM customer WHERE c_acctbal BETWEEN -1000 AND 11000")(
        lambda s, d, op=_op, arg=_arg: read(s, d, "customer").where("c_acctbal BETWEEN -1000 AND 11000").select("c_custkey", (F.round(N.UNARY[op](F.expr(arg)), 6) + F.lit(0.0)).alias("v"))
    )

query("num_round", "SELECT c_custkey, round(c_acctbal) AS v FROM customer")(lambda s, d: read(s, d, "customer").select("c_custkey", N.UNARY["round"](F.col("c_acctbal")).alias("v")))
query("num_round_digits", "SELECT c_custkey, round(sqrt(abs(c_acctbal) + 2), 1) AS v FROM customer")(lambda s, d: read(s, d, "customer").select("c_custkey", N.rounded(F.sqrt(F.abs("c_acctbal") + 2), 1).alias("v")))
query("num_not", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount = 0 AS v FROM lineitem")(lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", N.UNARY["not"](F.col("l_discount")).alias("v")))

_BINARY_SQL = {
    "add": "round(l_quantity + l_tax, 6)", "sub": "round(l_quantity - l_tax, 6)", "mul": "round(l_quantity * l_tax, 6)", "div": "round(l_tax / l_quantity, 6)", "mod": "round(l_quantity % 7.0, 6)", "pow": "round(pow(l_tax, 2), 6)", "log": "round(ln(l_quantity + 1) / ln(3.0), 6)",
    "and": "(l_discount <> 0) AND (l_tax <> 0)", "or": "(l_discount <> 0) OR (l_tax <> 0)", "xor": "(l_discount <> 0) <> (l_tax <> 0)", "gt": "l_discount > l_tax", "ge": "l_discount >= l_tax", "lt": "l_discount < l_tax", "le": "l_discount <= l_tax", "eq": "l_discount = l_tax", "ne": "l_discount <> l_tax",
    "max": "greatest(l_discount, l_tax)", "min": "least(l_discount, l_tax)",
}


def _binary(op: str):
    q, t, x = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    if op in ("add", "sub", "mul"):
        return F.round(N.BINARY[op](q, t), 6)
    args = {"div": (t, q), "mod": (q, F.lit(7.0)), "pow": (t, 2), "log": (q + 1, 3.0)}.get(op)
    return F.round(N.BINARY[op](*args), 6) if args else N.BINARY[op](x, t)


for _op, _sql in _BINARY_SQL.items():
    query(f"num_{_op}", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {_sql} AS v FROM lineitem")(lambda s, d, op=_op: read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", _binary(op).alias("v")))

# complex numbers a = (acctbal, nation), b = (1, 2)
_COMPLEX_SQL = {
    "add": "round(a + 1, 6) AS re, round(b + 2, 6) AS im", "sub": "round(a - 1, 6) AS re, round(b - 2, 6) AS im", "mul": "round(a * 1 - b * 2, 6) AS re, round(a * 2 + b * 1, 6) AS im",
    "div": "round((a * 1 + b * 2) / 5, 6) AS re, round((b * 1 - a * 2) / 5, 6) AS im", "conj": "round(a, 6) AS re, round(-b, 6) + 0.0 AS im", "abs": "round(sqrt(a * a + b * b), 4) AS v", "angle": "round(atan2(b, a), 6) AS v",
    "real": "a AS v", "imag": "b AS v", "gt": "sqrt(a * a + b * b) > sqrt(5.0) AS v", "eq": "a = 1 AND b = 2 AS v", "pow": "round(a * a - b * b, 2) AS re, round(2 * a * b, 2) AS im",
}


def _complex(s, d, op):
    a, b = N.cx(F.col("c_acctbal"), F.col("c_nationkey")), N.cx(1.0, 2.0)
    df = read(s, d, "customer")
    if op in ("add", "sub", "mul", "div", "conj", "pow"):
        v = N.c_conj(a) if op == "conj" else N.c_mul(a, a) if op == "pow" else N.C_BINARY[op](a, b)
        n = 2 if op == "pow" else 6
        return df.select("c_custkey", F.round(v["re"], n).alias("re"), (F.round(v["im"], n) + F.lit(0.0)).alias("im") if op == "conj" else F.round(v["im"], n).alias("im"))
    v = N.C_BINARY[op](a, b) if op in N.C_BINARY else N.C_UNARY[op](a)
    return df.select("c_custkey", (F.round(v, 4) if op == "abs" else F.round(v, 6) if op == "angle" else v).alias("v"))


for _op, _sql in _COMPLEX_SQL.items():
    query(f"num_complex_{_op}", f"SELECT c_custkey, {_sql} FROM (SELECT c_custkey, c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer)")(lambda s, d, op=_op: _complex(s, d, op))

# -- tuples, maps, strings



def _emb():
    return F.col("embedding")


_TUPLES = {
    "index": (lambda: C.at(_emb(), 3).cast("double"), "CAST(embedding[4] AS DOUBLE)"), "index_negative": (lambda: C.at(_emb(), -1).cast("double"), "CAST(embedding[64] AS DOUBLE)"),
    "slice": (lambda: F.round(C.total(C.cut(_emb(), 2, 10)), 5), "round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding[3:10]]), 5)"), "append": (lambda: C.length(C.append(_emb(), F.lit(1.0).cast("float"))), "CAST(len(list_append(embedding, 1.0)) AS BIGINT)"),
    "concatenate": (lambda: C.length(C.concatenate(_emb(), _emb())), "CAST(len(list_concat(embedding, embedding)) AS BIGINT)"), "contains": (lambda: C.contains(_emb(), C.at(_emb(), 0)), "list_contains(embedding, embedding[1])"),
    "len": (lambda: C.length(_emb()), "CAST(len(embedding) AS BIGINT)"), "eq": (lambda: C.equal(_emb(), C.cut(_emb(), 0, 64)), "embedding = embedding[1:64]"), "map": (lambda: F.round(C.total(C.mapped(_emb(), lambda x: x.cast("double") * 2)), 5), "round(list_sum([CAST(x AS DOUBLE) * 2 FOR x IN embedding]), 5)"),
    "fold": (lambda: F.round(C.fold(_emb(), F.lit(0.0), lambda a, x: a + x.cast("double")), 5), "round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]), 5)"), "filter": (lambda: C.length(C.filtered(_emb(), lambda x: x > 0)), "CAST(len([x FOR x IN embedding IF x > 0]) AS BIGINT)"),
    "zip": (lambda: C.length(C.filtered(C.zipped(_emb(), C.cut(_emb(), 0, 64)), lambda p: p["l"] == p["r"])), "CAST(64 AS BIGINT)"), "range": (lambda: C.length(C.span(F.col("label") + 1, 20, 3)), "CAST(len(range(label + 1, 20, 3)) AS BIGINT)"),
    "product": (lambda: F.round(C.product(C.mapped(C.cut(_emb(), 0, 3), lambda x: x.cast("double") + 2)), 5), "round((CAST(embedding[1] AS DOUBLE) + 2) * (CAST(embedding[2] AS DOUBLE) + 2) * (CAST(embedding[3] AS DOUBLE) + 2), 5)"),
    "is_none": (lambda: C.is_none(C.filtered(_emb(), lambda x: x > 1000), "tuple"), "true"),
}
for _op, (_fn, _sql) in _TUPLES.items():
    query(f"tuple_{_op}", f"SELECT vec_id, {_sql} AS v FROM embeddings")(lambda s, d, fn=_fn: read(s, d, "embeddings").select("vec_id", fn().alias("v")))

_M = lambda: F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("")), F.lit("source"), F.coalesce("source", F.lit("")))
_MAPS = {
    "get": (lambda: C.map_get(_M(), "lang"), "coalesce(lang, '')"), "len": (lambda: C.map_length(_M()), "CAST(2 AS BIGINT)"),
    "eq": (lambda: C.map_equal(_M(), F.create_map(F.lit("source"), F.coalesce("source", F.lit("")), F.lit("lang"), F.lit("en"))), "coalesce(lang, '') = 'en'"),
    "of_entries": (lambda: F.element_at(C.map_of(F.array(F.struct(F.lit("k").alias("key"), F.col("n_chars").alias("value")))), "k"), "n_chars"),
}
for _op, (_fn, _sql) in _MAPS.items():
    query(f"map_{_op}", f"SELECT doc_id, {_sql} AS v FROM documents")(lambda s, d, fn=_fn: read(s, d, "documents").select("doc_id", fn().alias("v")))

query("string_render", "SELECT doc_id, 'doc ' || CAST(doc_id AS VARCHAR) || ' (' || lang || ') from ' || source || '.' AS v FROM documents")(lambda s, d: read(s, d, "documents").select("doc_id", V.render("doc {{doc_id}} ({{ lang }}) from {{{source}}}.", {"doc_id": F.col("doc_id"), "lang": F.col("lang"), "source": F.col("source")}).alias("v")))
query("value_eq", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag IS NOT DISTINCT FROM l_linestatus AS v FROM lineitem")(lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", V.equal(F.col("l_returnflag"), F.col("l_linestatus")).alias("v")))
query("value_ne", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag IS DISTINCT FROM l_linestatus AS v FROM lineitem")(lambda s, d: read(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (~V.equal(F.col("l_returnflag"), F.col("l_linestatus"))).alias("v")))
query("value_cast", "SELECT c_custkey, CAST(CAST(c_custkey AS VARCHAR) AS INTEGER) AS v FROM customer")(lambda s, d: read(s, d, "customer").select("c_custkey", V.cast(F.col("c_custkey").cast("string"), "i32").alias("v")))
query("value_try_cast", "SELECT c_custkey, TRY_CAST(c_name AS BIGINT) AS v FROM customer")(lambda s, d: read(s, d, "customer").select("c_custkey", V.try_cast(F.col("c_name"), "i64").alias("v")))
query("value_link", "SELECT page_id, split_part(url, '://', 1) AS protocol, split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) AS host FROM pages")(lambda s, d: read(s, d, "pages").select("page_id", V.link_parts(F.col("url"))["protocol"].alias("protocol"), V.link_parts(F.col("url"))["host"].alias("host")))
query("value_version", "SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS major, CAST(1 AS BIGINT) AS minor, c_custkey AS rev FROM customer")(lambda s, d: read(s, d, "customer").select("c_custkey", V.version(F.concat_ws(".", F.col("c_nationkey").cast("string"), F.lit("1"), F.col("c_custkey").cast("string"))).alias("x")).select("c_custkey", "x.major", "x.minor", "x.rev"))

query(
    "state_hash",
    """WITH r AS (SELECT sha256('{"n_name":' || to_json(n_name) || ',"n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS h FROM nation),
    w AS (SELECT i, count(*) AS n, CAST(sum(CAST('0x' || substr(h, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT)) AS VARCHAR) AS w FROM r, range(8) t(i) GROUP BY i)
    SELECT max(n) AS n, sha256(max(n) || ':' || string_agg(w, ':' ORDER BY i)) AS hash FROM w""",
)(lambda s, d: V.state_hash(read(s, d, "nation")))
query("value_uuid_bytes", "SELECT c_custkey, upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 32)) AS v FROM customer")(
    lambda s, d: (lambda h: read(s, d, "customer").select("c_custkey", F.hex(V.uuid_bytes(F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)))).alias("v")))(F.md5(F.encode(F.col("c_custkey").cast("string"), "UTF-8")))
)
query("value_email", "SELECT c_custkey, c_custkey % 2 = 0 AS v FROM customer")(lambda s, d: read(s, d, "customer").select("c_custkey", V.is_email(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, F.lit("@example.org")).otherwise(F.lit(" at example")))).alias("v")))
query("value_is_link", "SELECT page_id, true AS v FROM pages")(lambda s, d: read(s, d, "pages").select("page_id", V.is_link(F.col("url")).alias("v")))
query("num_bounds", "SELECT * FROM (VALUES ('i16', CAST(-32768 AS BIGINT), CAST(32767 AS BIGINT)), ('i32', -2147483648, 2147483647), ('i64', -9223372036854775808, 9223372036854775807)) t(kind, low, high)")(lambda s, d: s.createDataFrame([(k, *bounds(k)) for k in ("i16", "i32", "i64")], "kind string, low long, high long"))

# -- tensors: the embeddings as a matrix E of n x 64, R its first row

E_SQL = (
    "WITH e AS (SELECT vec_id AS x0, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS x1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), "
    "r AS (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS x1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE vec_id = 0) "
)
#: e with the component of the first row beside each of its own, as r
ER_SQL = (
    "WITH e AS (SELECT vec_id AS x0, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS x1, CAST(unnest(embedding) AS DOUBLE) AS v, "
    "CAST(unnest((SELECT embedding FROM embeddings WHERE vec_id = 0)) AS DOUBLE) AS r FROM embeddings) "
)


def matrix(s, d) -> Tensor:
    df = read(s, d, "embeddings").select("vec_id", "embedding")
    n = df.agg(F.max("vec_id")).first()[0] + 1
    return Tensor.from_arrays(df, "vec_id", "embedding", (n, 64))


def out(t, digits: int | None = 6) -> DataFrame:
    df = t.df if isinstance(t, Tensor) else t
    return df if digits is None else df.withColumn("v", F.round("v", digits) + F.lit(0.0))


def tensor_query(name: str, sql: str, fn, digits: int | None = 6, beside: bool = False):
    query(f"tensor_{name}", (ER_SQL if beside else E_SQL) + sql)(lambda s, d: out(fn(matrix(s, d)), digits))


for _op, _sql in {"add": "v + r", "sub": "v - r", "mul": "v * r"}.items():
    tensor_query(f"{_op}_broadcast", f"SELECT x0, x1, round({_sql}, 6) + 0.0 AS v FROM e", lambda e, op=_op: e.binary(op, e.slice((0,))), beside=True)
tensor_query("div_broadcast", "SELECT x0, x1, round(v / (abs(r) + 1), 6) + 0.0 AS v FROM e", lambda e: e / (e.slice((0,)).unary("abs") + 1), beside=True)
tensor_query("pow_broadcast", "SELECT x0, x1, round(pow(abs(v), abs(r)), 6) + 0.0 AS v FROM e", lambda e: e.unary("abs") ** e.slice((0,)).unary("abs"), beside=True)
tensor_query("log_broadcast", "SELECT x0, x1, round(ln(abs(v) + 1) / ln(abs(r) + 2), 6) + 0.0 AS v FROM e", lambda e: (e.unary("abs") + 1).log(e.slice((0,)).unary("abs") + 2), beside=True)
for _op, _n, _sql in (("add", 1.5, "v + 1.5"), ("sub", 1.5, "v - 1.5"), ("mul", 3, "v * 3"), ("div", 4, "v / 4"), ("pow", 2, "pow(v, 2)")):
    tensor_query(f"{_op}_const", f"SELECT x0, x1, round({_sql}, 6) + 0.0 AS v FROM e", lambda e, op=_op, n=_n: e.binary(op, n))
for _op, _sql in {"and": "(v <> 0) AND (r <> 0)", "or": "(v <> 0) OR (r <> 0)", "xor": "(v <> 0) <> (r <> 0)", "eq": "v = r", "ne": "v <> r", "gt": "v > r", "ge": "v >= r", "lt": "v < r", "le": "v <= r"}.items():
    tensor_query(_op, f"SELECT x0, x1, {_sql} AS v FROM e", lambda e, op=_op: e.binary(op, e.slice((0,))), None, beside=True)
tensor_query("gt_const", "SELECT x0, x1, v > 0.5 AS v FROM e", lambda e: e.binary("gt", 0.5), None)
for _op, _arg, _sql in (
    ("abs", "", "abs(v)"), ("exp", "", "exp(v)"), ("round", "", "round(v)"), ("sin", "", "sin(v)"), ("cos", "", "cos(v)"), ("tan", "t", "tan(v / 8)"), ("sinh", "", "sinh(v)"), ("cosh", "", "cosh(v)"), ("tanh", "", "tanh(v)"), ("atan", "", "atan(v)"),
    ("asin", "t", "asin(v / 8)"), ("acos", "t", "acos(v / 8)"), ("asinh", "", "asinh(v)"), ("acosh", "a", "acosh(abs(v) + 1)"), ("atanh", "t", "atanh(v / 8)"), ("ln", "a", "ln(abs(v) + 1)"),
):
    tensor_query(_op, f"SELECT x0, x1, round({_sql}, 6) + 0.0 AS v FROM e", lambda e, op=_op, arg=_arg: (e / 8 if arg == "t" else e.unary("abs") + 1 if arg == "a" else e).unary(op))
tensor_query("not", "SELECT x0, x1, v = 0 AS v FROM e", lambda e: e.unary("not"), None)
tensor_query("mod", "SELECT x0, x1, round(v * 100 % 7, 4) + 0.0 AS v FROM e", lambda e: (e * 100) % 7, 4)
tensor_query("cond", "SELECT x0, x1, round(CASE WHEN v > 0 THEN v ELSE r END, 6) + 0.0 AS v FROM e", lambda e: e.binary("gt", 0).cond(e, e.slice((0,))), beside=True)
tensor_query("cast", "SELECT x0, x1, CAST(trunc(v * 10) AS BIGINT) AS v FROM e", lambda e: (e * 10).cast("i64"), None)
tensor_query("slice", "SELECT x0 - 2 AS x0, (x1 - 4) // 3 AS x1, round(v, 6) + 0.0 AS v FROM e WHERE x0 BETWEEN 2 AND 19 AND x1 BETWEEN 4 AND 39 AND (x1 - 4) % 3 = 0", lambda e: e.slice((slice(2, 20), slice(4, 40, 3))))
tensor_query("slice_index", "SELECT x1 AS x0, round(v, 6) + 0.0 AS v FROM e WHERE x0 = 5", lambda e: e.slice((5,)))
tensor_query("slice_of", "SELECT x0, k AS x1, round(v, 6) + 0.0 AS v FROM e JOIN (VALUES (CAST(0 AS BIGINT), 7), (1, 3), (2, 63), (3, 7)) t(k, c) ON x1 = c", lambda e: e.slice((slice(None), [7, 3, -1, 7])))
tensor_query("read", "SELECT round(v, 6) + 0.0 AS v FROM e WHERE x0 = 3 AND x1 = 4", lambda e: e.df.where(e._point((3, 4))).select("v"))
tensor_query("write", "SELECT x0, x1, round(CASE WHEN x0 < 10 AND x1 BETWEEN 5 AND 8 THEN 1 ELSE v END, 6) + 0.0 AS v FROM e", lambda e: e.write((slice(0, 10), slice(5, 9)), 1.0))
tensor_query("write_tensor", "SELECT x0, x1, round(CASE WHEN x0 = 1 THEN r ELSE v END, 6) + 0.0 AS v FROM e", lambda e: e.write((1,), e.slice((0,))), beside=True)
for _op, _sql, _v in (("sum", "sum(v)", 4), ("max", "max(v)", 6), ("min", "min(v)", 6), ("mean", "avg(v)", 6), ("std", "stddev_pop(v)", 6), ("norm", "sqrt(sum(v * v))", 5)):
    tensor_query(f"{_op}_all", f"SELECT round({_sql}, {_v}) + 0.0 AS v FROM e", lambda e, op=_op: getattr(e, op)(), _v)
    tensor_query(f"{_op}_axis0", f"SELECT x1 AS x0, round({_sql}, {_v}) + 0.0 AS v FROM e GROUP BY x1", lambda e, op=_op: getattr(e, op)(0), _v)
    tensor_query(f"{_op}_axis1", f"SELECT x0, round({_sql}, {_v}) + 0.0 AS v FROM e GROUP BY x0", lambda e, op=_op: getattr(e, op)(1), _v)
tensor_query("sum_keepdims", "SELECT x0, CAST(0 AS BIGINT) AS x1, round(sum(v), 4) + 0.0 AS v FROM e GROUP BY x0", lambda e: e.sum(1, True), 4)
tensor_query("all", "SELECT bool_and(v <> 0) AS v FROM e", lambda e: e.all(), None)
tensor_query("any", "SELECT bool_or(v > 100) AS v FROM e", lambda e: e.binary("gt", 100).any(), None)
tensor_query("transpose", "SELECT x1 AS x0, x0 AS x1, round(v, 6) + 0.0 AS v FROM e", lambda e: e.transpose())
tensor_query("reshape", "SELECT x0, x1 // 8 AS x1, x1 % 8 AS x2, round(v, 6) + 0.0 AS v FROM e", lambda e: e.reshape((None, 8, 8)))
tensor_query("expand_dims", "SELECT x0, CAST(0 AS BIGINT) AS x1, x1 AS x2, round(v, 6) + 0.0 AS v FROM e", lambda e: e.expand_dims(1))
tensor_query("broadcast", "SELECT CAST(k AS BIGINT) AS x0, x1, round(v, 6) + 0.0 AS v FROM r, range(3) t(k)", lambda e: e.slice((0,)).broadcast((3, 64)))
tensor_query("concatenate", "SELECT x0, x1 + 64 * k AS x1, round(v * (k + 1), 6) + 0.0 AS v FROM e, range(2) t(k)", lambda e: Tensor.concatenate([e, e * 2], 1))
tensor_query("split", "SELECT x0, x1 - 32 AS x1, round(v, 6) + 0.0 AS v FROM e WHERE x1 >= 32", lambda e: e.split(2, 1)[1])
tensor_query("tile", "SELECT x0, x1 + 64 * k AS x1, round(v, 6) + 0.0 AS v FROM e, range(3) t(k)", lambda e: e.tile(3, 1))
tensor_query("flip", "SELECT x0, 63 - x1 AS x1, round(v, 6) + 0.0 AS v FROM e", lambda e: e.flip(1))
tensor_query("einsum_ij_i", "SELECT x0, round(sum(v), 4) + 0.0 AS v FROM e GROUP BY x0", lambda e: einsum("ij->i", [e]), 4)
tensor_query("einsum_ij_ji", "SELECT x1 AS x0, x0 AS x1, round(v, 6) + 0.0 AS v FROM e", lambda e: einsum("ij->ji", [e]))
tensor_query("einsum_scalar", "SELECT round(sum(a.v * b.v), 3) + 0.0 AS v FROM e a JOIN e b ON a.x0 = b.x0 AND a.x1 = b.x1", lambda e: einsum("ij,ij->", [e, e]), 3)
tensor_query("gram_matrix", "SELECT a.x1 AS x0, b.x1, round(sum(a.v * b.v), 3) + 0.0 AS v FROM e a JOIN e b ON a.x0 = b.x0 GROUP BY a.x1, b.x1", lambda e: einsum("ij,ik->jk", [e, e]), 3)
tensor_query("argsort", "SELECT row_number() OVER (ORDER BY v, x1) - 1 AS x0, x1 AS v FROM r", lambda e: e.slice((0,)).argsort(), None)
query("tensor_save_load", E_SQL + "SELECT x0, x1, round(v, 6) + 0.0 AS v FROM e")(lambda s, d: out(_reread(s, matrix(s, d))))
query("tensor_count_filled", E_SQL + "SELECT count(*) AS n FROM e WHERE v > 1")(lambda s, d: matrix(s, d).binary("gt", 1).to_sparse().df.agg(F.count("*").alias("n")))

tensor_query("diagonal", "SELECT x0, x1 % 8 AS x1, round(v, 6) + 0.0 AS v FROM e WHERE x1 // 8 = x1 % 8", lambda e: e.reshape((None, 8, 8)).diagonal())
tensor_query("with_diagonal", "SELECT x0, x1 // 8 AS x1, x1 % 8 AS x2, CASE WHEN x1 // 8 = x1 % 8 THEN 0.0 ELSE round(v, 6) + 0.0 END AS v FROM e", lambda e: e.reshape((None, 8, 8)).with_diagonal(Tensor.zeros(e.df.sparkSession, (e.shape[0], 8))))
tensor_query("product_axis", "SELECT x0, round(product(1 + v / 8), 6) + 0.0 AS v FROM e GROUP BY x0", lambda e: (e / 8 + 1).product(1))
tensor_query("product_all", "SELECT round(product(1 + v / (64 * (SELECT max(x0) + 1 FROM e))), 8) + 0.0 AS v FROM e", lambda e: (e / (64 * e.shape[0]) + 1).product(), 8)
tensor_query("matmul", "SELECT a.x1 AS x0, b.x1, round(sum(a.v * b.v), 3) + 0.0 AS v FROM e a JOIN e b ON a.x0 = b.x0 GROUP BY a.x1, b.x1", lambda e: e.transpose() @ e, 3)
tensor_query("matmul_blocked", "SELECT a.x1 AS x0, b.x1, round(sum(a.v * b.v), 3) + 0.0 AS v FROM e a JOIN e b ON a.x0 = b.x0 GROUP BY a.x1, b.x1", lambda e: e.transpose().matmul(e, blocks=64), 3)
tensor_query("matmul_batch", "SELECT a.x0, a.x1 // 8 AS x1, b.x1 % 8 AS x2, round(sum(a.v * b.v), 4) + 0.0 AS v FROM e a JOIN e b ON a.x0 = b.x0 AND a.x1 % 8 = b.x1 // 8 GROUP BY 1, 2, 3", lambda e: e.reshape((None, 8, 8)) @ e.reshape((None, 8, 8)), 4)
tensor_query("einsum_ij_jk_ik", ", g AS (SELECT a.x1 AS x0, b.x1, sum(a.v * b.v) AS v FROM e a JOIN e b ON a.x0 = b.x0 GROUP BY a.x1, b.x1) SELECT e.x0, g.x1, round(sum(e.v * g.v), 3) + 0.0 AS v FROM e JOIN g ON e.x1 = g.x0 GROUP BY e.x0, g.x1", lambda e: einsum("ij,jk->ik", [e, einsum("ij,ik->jk", [e, e])]), 3)
tensor_query("einsum_ijk_jil_il", "SELECT a.x0, b.x1 % 8 AS x1, round(sum(a.v * b.v), 4) + 0.0 AS v FROM e a JOIN e b ON a.x0 = b.x0 AND a.x1 // 8 = b.x1 // 8 GROUP BY 1, 2", lambda e: (lambda m: einsum("ijk,jil->il", [m, m.transpose([1, 0, 2])]))(e.reshape((None, 8, 8))), 4)

query("tensor_arange", "SELECT CAST(i // 12 AS BIGINT) AS x0, CAST((i // 4) % 3 AS BIGINT) AS x1, CAST(i % 4 AS BIGINT) AS x2, CAST(1 + i * 2 AS BIGINT) AS v FROM range(24) t(i)")(lambda s, d: Tensor.arange(s, (2, 3, 4), 1, 49).df)
query("tensor_arange_float", "SELECT CAST(i AS BIGINT) AS x0, round(0.5 + i * 0.25, 6) AS v FROM range(10) t(i)")(lambda s, d: out(Tensor.arange(s, (10,), 0.5, 3.0)))
query("tensor_constant", "SELECT CAST(i // 3 AS BIGINT) AS x0, CAST(i % 3 AS BIGINT) AS x1, 1.5::DOUBLE AS v FROM range(6) t(i)")(lambda s, d: Tensor.constant(s, (2, 3), 1.5).df)
query("tensor_zeros", "SELECT CAST(i AS BIGINT) AS x0, CAST(0 AS BIGINT) AS v FROM range(4) t(i)")(lambda s, d: Tensor.zeros(s, (4,), "i64").df)
query("tensor_ones", "SELECT CAST(i AS BIGINT) AS x0, 1::DOUBLE AS v FROM range(4) t(i)")(lambda s, d: Tensor.ones(s, (4,)).df)
query("tensor_eye", "SELECT CAST(i AS BIGINT) AS x0, CAST(i AS BIGINT) AS x1, true AS v FROM range(5) t(i)")(lambda s, d: Tensor.eye(s, 5).df)
query("tensor_load", "SELECT CAST(i // 2 AS BIGINT) AS x0, CAST(i % 2 AS BIGINT) AS x1, CAST(i * i AS BIGINT) AS v FROM range(4) t(i)")(lambda s, d: Tensor.load(s, (2, 2), [0, 1, 4, 9]).df)
query("tensor_load_sparse", "SELECT CAST(1 AS BIGINT) AS x0, CAST(2 AS BIGINT) AS x1, 2.5::DOUBLE AS v")(lambda s, d: Tensor.load(s, (3, 3), [((1, 2), 2.5)]).df)

_DRAW = "CAST('0x' || substr(md5('{0}:' || i), 1, 13) AS BIGINT) / 4503599627370496.0"
_GRID = "SELECT CAST(i // 10 AS BIGINT) AS x0, CAST(i % 10 AS BIGINT) AS x1, round({0}, 6) + 0.0 AS v FROM range(200) t(i)"
query("tensor_random_uniform", _GRID.format(_DRAW.format(4) + " * 2 - 1"))(lambda s, d: out(Tensor.random_uniform(s, (20, 10), -1, 1, seed=4)))
query("tensor_random_normal", _GRID.format(f"sqrt(-2 * ln(1 - {_DRAW.format(9)})) * cos(2 * pi() * {_DRAW.format(10)}) * 2 + 5"))(lambda s, d: out(Tensor.random_normal(s, (20, 10), 5, 2, seed=4)))
query("tensor_truncated_normal")(lambda s, d: Tensor.truncated_normal(s, (20, 10), 0, 1, seed=4).df)

# complex tensors: e + i (the vector read backwards)
C_SQL = (
    "WITH c AS (SELECT vec_id AS x0, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS x1, CAST(unnest(embedding) AS DOUBLE) AS a, CAST(unnest(list_reverse(embedding)) AS DOUBLE) AS b, "
    "CAST(unnest((SELECT embedding FROM embeddings WHERE vec_id = 0)) AS DOUBLE) + 2 AS r FROM embeddings) "
)


def _complex_matrix(s, d) -> Tensor:
    e = matrix(s, d)
    return e.cast("c64") + e.flip(1).cast("c64") * 1j


def _parts(t: Tensor, digits: int = 6) -> DataFrame:
    return t.df.select("x0", "x1", *[(F.round(F.col(f"v.{p}"), digits) + F.lit(0.0)).alias(p) for p in ("re", "im")])


for _op, _sql, _fn in (
    ("add", "a + r AS re, b AS im", lambda c, r: c + r), ("sub", "a - r AS re, b AS im", lambda c, r: c - r), ("mul", "a * r AS re, b * r AS im", lambda c, r: c * r), ("div", "a / r AS re, b / r AS im", lambda c, r: c / r),
    ("mul_number", "a * 2 - b AS re, a + b * 2 AS im", lambda c, r: c * (2 + 1j)), ("square", "a * a - b * b AS re, 2 * a * b AS im", lambda c, r: c**2), ("exp", "exp(a) * cos(b) AS re, exp(a) * sin(b) AS im", lambda c, r: c.unary("exp")),
    ("conj", "a AS re, -b AS im", lambda c, r: c.unary("conj")),
):
    query(f"tensor_complex_{_op}", C_SQL + f"SELECT x0, x1, round(re, 6) + 0.0 AS re, round(im, 6) + 0.0 AS im FROM (SELECT x0, x1, {_sql} FROM c)")(lambda s, d, fn=_fn: _parts(fn(_complex_matrix(s, d), (matrix(s, d).slice((0,)) + 2).cast("c64"))))
for _op, _sql in (("abs", "sqrt(a * a + b * b)"), ("angle", "atan2(b, a)"), ("real", "a"), ("imag", "b")):
    query(f"tensor_complex_{_op}", C_SQL + f"SELECT x0, x1, round({_sql}, 6) + 0.0 AS v FROM c")(lambda s, d, op=_op: out(_complex_matrix(s, d).unary(op)))

# sparse: quantity by (part, supplier)
_P = "WITH p AS (SELECT l_partkey AS x0, l_suppkey AS x1, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), q AS (SELECT l_partkey AS x0, l_suppkey AS x1, CAST(count(*) AS DOUBLE) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) "


def sparse(s, d, which: str = "p") -> Tensor:
    df = read(s, d, "lineitem")
    top = df.agg(F.max("l_partkey") + 1, F.max("l_suppkey") + 1).first()
    if which == "q":
        df = df.where("l_returnflag = 'A'")
    cells = df.groupBy("l_partkey", "l_suppkey").agg((F.sum("l_quantity") if which == "p" else F.count("*").cast("double")).alias("v"))
    return Tensor.from_frame(cells, ["l_partkey", "l_suppkey"], "v", tuple(top))


for _name, _sql, _fn in (
    ("from_table", "SELECT x0, x1, round(v, 4) + 0.0 AS v FROM p", lambda p, q: p),
    ("add_outer", "SELECT coalesce(p.x0, q.x0) AS x0, coalesce(p.x1, q.x1) AS x1, round(coalesce(p.v, 0) + coalesce(q.v, 0), 4) + 0.0 AS v FROM p FULL JOIN q ON p.x0 = q.x0 AND p.x1 = q.x1", lambda p, q: p + q),
    ("sub_outer", "SELECT x0, x1, v FROM (SELECT coalesce(p.x0, q.x0) AS x0, coalesce(p.x1, q.x1) AS x1, round(coalesce(p.v, 0) - coalesce(q.v, 0), 4) + 0.0 AS v FROM p FULL JOIN q ON p.x0 = q.x0 AND p.x1 = q.x1) WHERE v <> 0", lambda p, q: p - q),
    ("mul_inner", "SELECT p.x0, p.x1, round(p.v * q.v, 4) + 0.0 AS v FROM p JOIN q ON p.x0 = q.x0 AND p.x1 = q.x1", lambda p, q: p * q),
    ("mul_const", "SELECT x0, x1, round(v * 2, 4) + 0.0 AS v FROM p", lambda p, q: p * 2),
    ("sum_axis", "SELECT x1 AS x0, round(sum(v), 4) + 0.0 AS v FROM p GROUP BY x1", lambda p, q: p.sum(0)),
    ("max_axis", "SELECT x0, round(max(v), 4) + 0.0 AS v FROM p GROUP BY x0", lambda p, q: p.max(1)),
    ("min_axis", "SELECT x0, round(min(v), 4) + 0.0 AS v FROM p GROUP BY x0", lambda p, q: p.min(1)),
    ("transpose", "SELECT x1 AS x0, x0 AS x1, round(v, 4) + 0.0 AS v FROM p", lambda p, q: p.transpose()),
    ("matmul", "SELECT a.x1 AS x0, b.x1, round(sum(a.v * b.v), 3) + 0.0 AS v FROM q a JOIN q b ON a.x0 = b.x0 GROUP BY 1, 2", lambda p, q: q.transpose() @ q),
):
    query(f"sparse_{_name}", _P + _sql)(lambda s, d, fn=_fn, n=3 if _name == "matmul" else 4: out(fn(sparse(s, d), sparse(s, d, "q")), n))
for _name, _sql, _fn in (
    ("and", "SELECT p.x0, p.x1, true AS v FROM p JOIN q ON p.x0 = q.x0 AND p.x1 = q.x1", lambda p, q: p & q),
    ("or", "SELECT coalesce(p.x0, q.x0) AS x0, coalesce(p.x1, q.x1) AS x1, true AS v FROM p FULL JOIN q ON p.x0 = q.x0 AND p.x1 = q.x1", lambda p, q: p | q),
    ("xor", "SELECT p.x0, p.x1, true AS v FROM p LEFT JOIN q ON p.x0 = q.x0 AND p.x1 = q.x1 WHERE q.x0 IS NULL", lambda p, q: p ^ q),
    ("gt", "SELECT p.x0, p.x1, true AS v FROM p LEFT JOIN q ON p.x0 = q.x0 AND p.x1 = q.x1 WHERE p.v > coalesce(q.v, 0)", lambda p, q: p.binary("gt", q)),
    ("ne", "SELECT p.x0, p.x1, true AS v FROM p LEFT JOIN q ON p.x0 = q.x0 AND p.x1 = q.x1 WHERE p.v <> coalesce(q.v, 0)", lambda p, q: p.binary("ne", q)),
    ("gt_const", "SELECT x0, x1, true AS v FROM p WHERE v > 40", lambda p, q: p.binary("gt", 40)),
):
    query(f"sparse_{_name}", _P + _sql)(lambda s, d, fn=_fn: fn(sparse(s, d), sparse(s, d, "q")).df)
query("sparse_filled_at", _P + "SELECT DISTINCT x0 FROM p")(lambda s, d: sparse(s, d).filled_at(0))
query("sparse_dense_mul", _P + "SELECT x0, x1, round(v * x1, 4) + 0.0 AS v FROM p WHERE x1 <> 0")(lambda s, d: (lambda p: out(p * Tensor.arange(s, (p.shape[1],), 0, p.shape[1]), 4))(sparse(s, d)))
query("sparse_to_dense", _P + "SELECT CAST(i AS BIGINT) AS x0, CAST(j AS BIGINT) AS x1, round(coalesce(v, 0), 4) + 0.0 AS v FROM range((SELECT max(l_partkey) + 1 FROM lineitem)) a(i) CROSS JOIN range((SELECT max(l_suppkey) + 1 FROM lineitem)) b(j) LEFT JOIN p ON x0 = i AND x1 = j")(lambda s, d: out(sparse(s, d).to_dense(), 4))

query("sparse_matmul_parts")(lambda s, d: (lambda q: out(q @ q.transpose(), 3))(sparse(s, d, "q")))  # its SQL takes long; tests/test_whole.py has it by numpy

# -- graphs

query("graph_fk_primary", "SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS id FROM customer WHERE c_acctbal > 9000")(lambda s, d: Edge.of(read(s, d, "customer"), "c_custkey", "c_nationkey").primary(read(s, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("id"))))
query("graph_fk_foreign", "SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 2")(lambda s, d: Edge.of(read(s, d, "orders"), "o_orderkey", "o_custkey").foreign(read(s, d, "customer").where("c_nationkey = 2").select(F.col("c_custkey").alias("id"))))
query("graph_degree", "SELECT CAST(l_suppkey AS BIGINT) AS id, count(DISTINCT l_partkey) AS degree FROM lineitem GROUP BY l_suppkey")(lambda s, d: Edge.of(read(s, d, "lineitem"), "l_suppkey", "l_partkey").degree())


def _bfs_sql(n: int) -> str:
    """Suppliers and parts (numbered from 10^9) reached from supplier 1 over lineitem, by distance."""
    steps = ["f0 AS (SELECT CAST(1 AS BIGINT) AS id)", "s0 AS (SELECT id, 0 AS distance FROM f0)"]
    for k in range(1, n + 1):
        steps.append(f"f{k} AS (SELECT DISTINCT b AS id FROM g JOIN f{k - 1} ON g.a = f{k - 1}.id WHERE b NOT IN (SELECT id FROM s{k - 1}))")
        steps.append(f"s{k} AS (SELECT * FROM s{k - 1} UNION ALL SELECT id, {k} FROM f{k})")
    edges = "SELECT DISTINCT l_suppkey AS a, l_partkey + 1000000000 AS b FROM lineitem"
    return f"WITH h AS ({edges}), g AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h), {', '.join(steps)} SELECT id, distance FROM s{n} WHERE distance > 0"


def _bfs(s, d, n):
    one = read(s, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1_000_000_000).alias("b"))
    return Edge.of(one.union(one.select("b", "a")), "a", "b").match(s.createDataFrame([(1,)], "id long"), n, incoming=False)


for _n in (1, 2, 3):
    query(f"graph_bfs_{_n}", _bfs_sql(_n))(lambda s, d, n=_n: _bfs(s, d, n))
query("graph_link_unlink", "SELECT CAST(n_nationkey AS BIGINT) AS from_id, CAST(n_regionkey AS BIGINT) AS to_id FROM nation WHERE n_nationkey <> 0 UNION ALL SELECT 99, 1")(lambda s, d: (lambda n: Edge.of(n, "n_nationkey", "n_regionkey").link(99, 1).unlink(0, n.where("n_nationkey = 0").first()["n_regionkey"]).df)(read(s, d, "nation")))


def _graph(s, d) -> Graph:
    return Graph({n: table(s, d, n) for n in ("region", "nation", "customer")}, {("nation", "n_regionkey"): "region", ("customer", "c_nationkey"): "nation"})


query("graph_max_id", "SELECT max(c_custkey) AS id FROM customer")(lambda s, d: _graph(s, d).max_id("customer"))
query("graph_read_vector", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")(lambda s, d: _graph(s, d).read_vector("customer", read(s, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("id"))).select("c_custkey", "c_name"))
query("graph_foreign_key", "SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3")(lambda s, d: _graph(s, d).foreign_key("customer", "c_nationkey").foreign(s.createDataFrame([(3,)], "id long")))
query("graph_upsert", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT 5, 'five', 2 UNION ALL SELECT 77, 'new', 1")(lambda s, d: _graph(s, d).upsert("nation", (5,), ("five", 2)).upsert("nation", (77,), ("new", 1)).table("nation").df)
query("graph_update_row", "SELECT n_nationkey, CASE WHEN n_nationkey = 5 THEN 4 ELSE n_regionkey END AS n_regionkey FROM nation")(lambda s, d: _graph(s, d).update_row("nation", (5,), {"n_regionkey": 4}).table("nation").df.select("n_nationkey", "n_regionkey"))
query("graph_delete_cascade", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")(lambda s, d: _graph(s, d).delete_row("region", (1,), cascade=True).table("customer").df.select("c_custkey", "c_nationkey"))

# -- operations, chains, streams


@query("op_if_column", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS v FROM customer")
def _(s, d):
    cxt = ops.Context()
    cxt.customers = read(s, d, "customer")
    cxt.kind = ops.If(F.col("c_acctbal") < 0, F.lit("debt"), F.lit("credit"))
    cxt.result = ops.Call(lambda t, k: t.select("c_custkey", k.alias("v")), (cxt.customers, cxt.kind))
    return cxt.run()


@query("op_case_column", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'more' END AS v FROM nation")
def _(s, d):
    case = ops.Case(F.col("n_regionkey"), [0, 1], [F.lit("zero"), F.lit("one"), F.lit("more")])
    return read(s, d, "nation").select("n_nationkey", ops.evaluate(case, ops.Scope({})).alias("v"))


@query("op_while", "SELECT c_custkey, c_acctbal * 8 AS v FROM customer")
def _(s, d):
    step = ops.Op([("next", ops.Call(lambda i, df: {"i": i + 1, "df": df.withColumn("v", F.col("v") * 2)}, (ops.ref("i"), ops.ref("df"))))], ("i", "df"))
    loop = ops.While(lambda i, df: i < 3, step, {"i": 0, "df": read(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v"))})
    return ops.evaluate(loop, ops.Scope({}))["df"]


@query("op_closure_map", "SELECT n_nationkey + k AS v FROM nation, range(3) t(k)")
def _(s, d):
    scope = ops.Scope({"base": read(s, d, "nation")})
    add = ops.evaluate(ops.With(["base"], ops.Op([("r", ops.Call(lambda b, k: b.select((F.col("n_nationkey") + F.lit(k).cast("long")).alias("v")), (ops.ref("base"), ops.ref("k"))))], ("k",))), scope)
    return ops.fold(ops.map_items([1, 2], add), add(0), lambda a, b: a.unionByName(b))


query(
    "chain_hash_log",
    """WITH RECURSIVE r AS (SELECT event_id // 1000 AS block, event_id, sha256(event_id || '|' || coalesce(CAST(user_id AS VARCHAR), '') || '|' || coalesce(event_type, '')) AS h FROM events),
    b AS (SELECT block, count(*) AS n, sha256(string_agg(h, '' ORDER BY event_id)) AS payload_hash, row_number() OVER (ORDER BY block) AS k FROM r GROUP BY block),
    c AS (SELECT b.*, sha256(repeat('0', 64) || payload_hash) AS chain_hash FROM b WHERE k = 1 UNION ALL SELECT b.*, sha256(c.chain_hash || b.payload_hash) FROM c JOIN b ON b.k = c.k + 1)
    SELECT block, n, payload_hash, chain_hash FROM c""",
)(lambda s, d: hash_chain(read(s, d, "events"), "event_id", ["event_id", "user_id", "event_type"]))


def _store(s, d, change) -> Store:
    """A store in the shared folder with the customers, changed in a transaction of its own and committed."""
    store = Store(s, new_path(s, "store"))
    tx = store.begin()
    tx.put("customer", table(s, d, "customer"))
    tx.commit()
    tx = store.begin()
    change(tx)
    tx.commit()
    return store


@query("chain_append", f"SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (1, 2) UNION ALL SELECT 1, 'one', 1.5 UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_nationkey = 1")
def _(s, d):
    def change(tx):
        tx.upsert("customer", (1,), ("one", 3, 1.5, "none"))
        tx.delete("customer", (2,))
        tx.upsert_rows("customer", _delta(s, d).where("c_custkey >= 1000000"))

    return _store(s, d, change).table("customer").df.select("c_custkey", "c_name", "c_acctbal")


@query("chain_log", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'customer', 'put', ''), (2, 'customer', 'upsert', '[[1], [\"one\", 3, 1.5, \"none\"]]'), (2, 'customer', 'delete', '[2]')) t(version, \"table\", op, detail)")
def _(s, d):
    def change(tx):
        tx.upsert("customer", (1,), ("one", 3, 1.5, "none"))
        tx.delete("customer", (2,))

    return _store(s, d, change).log()


query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS stop, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")(lambda s, d: windows.tumbling(read(s, d, "events"), "ts", "1 hour", ["event_type"]).withColumn("total", F.round("total", 4)))
query("stream_sessions", "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), c AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, user_id, count(*) AS n FROM c GROUP BY user_id, g")(lambda s, d: windows.sessions(read(s, d, "events"), "ts", "30 minutes", ["user_id"]))

# -- relational extensions

query("ext_window_rank", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn FROM orders")(lambda s, d: table(s, d, "orders").order_by(["o_totalprice"], True).ranked(["o_custkey"], "rn").select("o_orderkey", "o_custkey", "rn"))
query("ext_set_ops", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier")(lambda s, d: (lambda of: of("customer", "c_nationkey").difference(of("supplier", "s_nationkey")).df)(lambda name, c: OrderedSet.copy_from([("k", I)], read(s, d, name).select(F.col(c).alias("k")))))
query("ext_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")(lambda s, d: Table(read(s, d, "lineitem").select("l_returnflag", "l_linestatus"), TableSchema(())).rolled_up(["l_returnflag", "l_linestatus"], n=F.count("*")))
query("ext_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(lambda s, d: table(s, d, "customer").delete_rows(read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))).df.select("c_custkey"))

# -- linear algebra, derivatives, learning (deterministic, but beyond SQL unless stated)




def _matrices(s, d) -> Tensor:
    return matrix(s, d).reshape((None, 8, 8))


_MATRICES_SQL = E_SQL + "SELECT x0, x1 // 8 AS x1, x1 % 8 AS x2, round(v, 4) + 0.0 AS v FROM e"
query("linalg_qr_reconstruct", _MATRICES_SQL)(lambda s, d: (lambda q, r: out(q @ r, 4))(*linalg.t_qr(_matrices(s, d))))
query("linalg_plu_reconstruct", _MATRICES_SQL)(lambda s, d: (lambda p, l, u: out(p @ (l @ u), 4))(*linalg.t_plu(_matrices(s, d))))


def _small(s, d) -> Tensor:
    """Every vector as sixteen 2 x 2 matrices."""
    return matrix(s, d).reshape((None, 16, 2, 2))


_SMALL_SQL = E_SQL + ", m AS (SELECT x0, x1 // 4 AS x1, max(v) FILTER (x1 % 4 = 0) AS a, max(v) FILTER (x1 % 4 = 1) AS b, max(v) FILTER (x1 % 4 = 2) AS c, max(v) FILTER (x1 % 4 = 3) AS d FROM e GROUP BY 1, 2), f AS (SELECT x0, x1, a * d - b * c AS det, a * a + b * b + c * c + d * d AS s FROM m) "
query("linalg_det", _SMALL_SQL + "SELECT x0, x1, CAST(0 AS BIGINT) AS x2, round(det, 5) + 0.0 AS v FROM f")(lambda s, d: out(linalg.t_det(_small(s, d)), 5))
query("linalg_slogdet", _SMALL_SQL + "SELECT x0, x1, CAST(0 AS BIGINT) AS x2, CAST(sign(det) AS DOUBLE) AS v FROM f UNION ALL SELECT x0, x1, 1, round(ln(abs(det)), 3) + 0.0 FROM f WHERE det <> 0 UNION ALL SELECT x0, x1, 1, CAST('-inf' AS DOUBLE) FROM f WHERE det = 0")(lambda s, d: out(linalg.t_slogdet(_small(s, d)), 3))
query("linalg_svd_values", _SMALL_SQL + "SELECT x0, x1, CAST(k AS BIGINT) AS x2, round(sqrt(greatest((s + (1 - 2 * k) * sqrt(greatest(s * s - 4 * det * det, 0))) / 2, 0)), 4) + 0.0 AS v FROM f, range(2) t(k)")(lambda s, d: out(linalg.t_svd_values(_small(s, d)), 4))
query("linalg_svd_reconstruct", E_SQL + "SELECT x0, x1 // 8 AS x1, x1 % 8 AS x2, round(v, 3) + 0.0 AS v FROM e")(lambda s, d: (lambda u, w, v: out((u * w.expand_dims(1)) @ v, 3))(*linalg.t_svd(_matrices(s, d))))
# of 8 x 8 matrices, beyond SQL; tests/test_whole.py has them by numpy
query("linalg_det_large")(lambda s, d: linalg.t_det(_matrices(s, d)).df)
query("linalg_slogdet_large")(lambda s, d: linalg.t_slogdet(_matrices(s, d)).df)
query("linalg_svd_values_large")(lambda s, d: linalg.t_svd_values(_matrices(s, d)).df)
query("linalg_householder", E_SQL + "SELECT x0, round(sqrt(sum(v * v)), 4) + 0.0 AS v FROM e GROUP BY x0")(
    # the reflection of a row has its norm in the first component and nothing else: |x - tau (v.x) v|
    lambda s, d: (lambda e: (lambda v, tau: out((e - v * ((e * v).sum(1, True) * tau)).norm(1), 4))(*linalg.t_householder(e)))(matrix(s, d))
)
query("autodiff_column", "SELECT c_custkey, round(-sin(c_acctbal / 1000) * exp(c_acctbal / 10000) + cos(c_acctbal / 1000) * exp(c_acctbal / 10000) / 10, 6) + 0.0 AS v FROM customer")(
    lambda s, d: read(s, d, "customer").select("c_custkey", (F.round(ad.column(ad.gradients(ad.cos(ad.var("x")) * ad.exp(ad.var("x") / 10.0), ["x"])["x"], {"x": F.col("c_acctbal") / 1000}), 6) + F.lit(0.0)).alias("v"))
)
query("autodiff_tensor", E_SQL + "SELECT x0, x1, round(2 * v, 6) + 0.0 AS v FROM e")(lambda s, d: (lambda e: out(ad.tensor(ad.gradients((ad.var("x", e.shape) ** 2.0).sum(), ["x"])["x"], {"x": e})))(matrix(s, d)))


query("autodiff_softmax", E_SQL + "SELECT x0, x1, round(exp(v) / sum(exp(v)) OVER (PARTITION BY x0), 6) + 0.0 AS v FROM e")(lambda s, d: (lambda e: out(ad.tensor(ad.softmax(ad.var("x", e.shape)), {"x": e})))(matrix(s, d)))
query("autodiff_max", E_SQL + "SELECT x0, x1, CASE WHEN v = max(v) OVER (PARTITION BY x0) THEN round(1.0 / count(*) OVER (PARTITION BY x0, v), 6) ELSE 0.0 END AS v FROM e")(lambda s, d: (lambda e: out(ad.tensor(ad.gradients(ad.var("x", e.shape).max(1).sum(), ["x"])["x"], {"x": e})))(matrix(s, d)))
query("autodiff_concatenate_slice", E_SQL + "SELECT x0, x1, CASE WHEN x1 >= 32 THEN 4.0 ELSE 1.0 END AS v FROM e")(
    # of x beside 3 x, all of the first and the latter half of the second
    lambda s, d: (lambda e: out(ad.tensor(ad.gradients((lambda x: ad.concatenate([x, x * 3.0], 1).slice(slice(None), slice(0, 64)).sum() + ad.concatenate([x, x * 3.0], 1).slice(slice(None), slice(96, 128)).sum())(ad.var("x", e.shape)), ["x"])["x"], {"x": e})))(matrix(s, d))
)
query("autodiff_function", "SELECT c_custkey, round(2 * (c_acctbal / 1000) * exp(pow(c_acctbal / 1000, 2) / 100) / 100, 6) + 0.0 AS v FROM customer")(lambda s, d: read(s, d, "customer").select("c_custkey", (F.round(_bell.derivative()(F.col("c_acctbal") / 1000), 6) + F.lit(0.0)).alias("v")))


@differentiable()
def _bell(x):
    return ad.exp(x**2.0 / 100.0)


@query("ml_train_step")
def _(s, d):
    df = read(s, d, "embeddings").where("size(embedding) = 64").select("embedding", F.array((F.col("label") / 10.0).cast("double")).alias("target"))
    _, losses = ml.train(ml.dnn([64, 4, 1]), df, "embedding", "target", ml.Adam(0.01), 3)
    return s.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(losses)], "step int, loss double")
