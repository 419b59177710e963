"""Versioned tables: snapshot isolation, optimistic commits, and a hash-chained history that is the log.

A store is a folder: ``data/<id>`` holds Parquet, and ``versions/<n>.json`` names the data of every table at version n
and lists the mutations that led to it. A commit writes its data first, under names of its own, and then claims the
next version by creating its file, which must not be there: of two writers of one version, one succeeds and the other
gets ``Conflict``. That one file is both the version and its log entry, so there is never one without the other, and a
commit that fails or dies leaves nothing that anyone reads. A reader keeps the version it began with.

A table is a base and deltas: single-row writes and row sets put by key add a small delta (rows put, keys deleted)
instead of writing the table anew; readers merge them by one shuffle. After ``DELTAS`` of them a commit compacts.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import Conflict, NotFound, QueryError
from ..operators.table import Table
from ..schema import Column, TableSchema
from .storage import filesystem


@dataclass
class Store:
    spark: SparkSession
    path: str

    def version(self) -> int:
        fs, where = filesystem(self.spark, f"{self.path}/versions")
        if not fs.exists(where):
            return 0
        return max((int(f.getPath().getName().removesuffix(".json")) for f in fs.listStatus(where) if f.getPath().getName().endswith(".json") and f.getPath().getName()[0] != "."), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "tables": {}, "hash": "0" * 64}
        fs, where = filesystem(self.spark, f"{self.path}/versions/{version}.json")
        if not fs.exists(where):
            raise NotFound(f"no version {version}")
        return json.loads(self.spark.read.text(str(where.toString()), wholetext=True).first()[0])

    def begin(self) -> Transaction:
        return Transaction(self, self.manifest())

    def table(self, name: str, version: int | None = None) -> Table:
        return _open(self.spark, self.path, self.manifest(version), name)

    def history(self) -> list[dict]:
        """Every version's manifest, checked link by link."""
        out, before = [], "0" * 64
        for v in range(1, self.version() + 1):
            m = self.manifest(v)
            if m["before"] != before or m["hash"] != _digest(m):
                raise Conflict(f"the history is broken at version {v}")
            before = m["hash"]
            out.append(m)
        return out

    def log(self) -> DataFrame:
        """(version, table, op, detail) of every mutation; append-only, so it can be streamed too."""
        fs, where = filesystem(self.spark, f"{self.path}/versions")
        if not fs.exists(where):
            return self.spark.createDataFrame([], LOG)
        return mutations(self.spark.read.schema(LOGGED).json(f"{self.path}/versions"))


LOG = "version long, table string, op string, detail string"
#: What of a version's file is its log entry.
LOGGED = "version long, log array<struct<table:string,op:string,detail:string>>"


def mutations(versions: DataFrame) -> DataFrame:
    return versions.select("version", F.explode("log").alias("m")).select("version", "m.table", "m.op", "m.detail")


#: Deltas of a table after which the next commit writes it anew.
DELTAS = 8


def _digest(manifest: dict) -> str:
    body = {k: v for k, v in manifest.items() if k != "hash"}
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def _open(spark: SparkSession, path: str, manifest: dict, name: str) -> Table:
    if name not in manifest["tables"]:
        raise NotFound(name)
    about = manifest["tables"][name]
    schema = TableSchema(tuple(Column(*c) for c in about["key"]), tuple(Column(*c) for c in about["values"]), tuple((n, tuple(c)) for n, c in about["indices"]))
    part = lambda name: spark.read.parquet(f"{path}/data/{name}")
    t = Table(part(about["data"]).select(*schema.names), schema)
    deltas = [(part(d["put"]).select(*schema.names) if d["put"] else t.df.limit(0), part(d["gone"]) if d["gone"] else t.df.select(*schema.key_names).limit(0)) for d in about.get("deltas", [])]
    return t.merged(deltas) if deltas else t


@dataclass
class Transaction:
    """Reads see the version it began with and its own writes; nothing is seen by others before ``commit``."""

    store: Store
    base: dict
    pending: dict[str, Table] = field(default_factory=dict)
    mutations: list[tuple[str, str, str]] = field(default_factory=list)
    deltas: dict[str, list[tuple[DataFrame | None, DataFrame | None]]] = field(default_factory=dict)
    closed: bool = False

    def table(self, name: str) -> Table:
        return self.pending.get(name) or _open(self.store.spark, self.store.path, self.base, name)

    def put(self, name: str, table: Table, op: str = "put", detail: str = "") -> None:
        """Replace a whole table."""
        self._change(name, table, op, detail)
        self.deltas.pop(name, None)

    def _change(self, name: str, table: Table, op: str, detail: str) -> None:
        if self.closed:
            raise QueryError("the transaction has ended")
        self.pending[name] = table
        self.mutations.append((name, op, detail))

    def _delta(self, name: str, table: Table, op: str, detail: str, put: DataFrame | None, gone: DataFrame | None) -> None:
        whole = name in self.pending and name not in self.deltas
        self._change(name, table, op, detail)
        if not whole and table.schema.key:
            self.deltas.setdefault(name, []).append((put, gone))

    def upsert(self, name: str, key: tuple, values: tuple = ()) -> None:
        t = self.table(name)
        self._delta(name, t.upsert(key, values), "upsert", json.dumps([key, values], default=str), t._row(key, values), None)

    def upsert_rows(self, name: str, rows: DataFrame) -> None:
        """Many rows by key; they are written by the commit, so they must not change until then."""
        t = self.table(name)
        rows = t.schema.validate(rows.select(*t.schema.names))
        self._delta(name, t.upsert_rows(rows), "upsert_rows", "", rows, None)

    def delete(self, name: str, key: tuple) -> None:
        t = self.table(name)
        keys = [c for c in t.schema.struct() if c.name in t.schema.key_names]
        gone = self.store.spark.createDataFrame([tuple(key)], StructType(keys))
        self._delta(name, t.delete(key), "delete", json.dumps(key, default=str), None, gone)

    def rollback(self) -> None:
        self.pending.clear()
        self.closed = True

    def _written(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.store.path}/data/{name}")
        return name

    def commit(self) -> int:
        """Write what has changed and the log, then claim the next version in one step."""
        if self.closed:
            raise QueryError("the transaction has ended")
        spark, path, version = self.store.spark, self.store.path, self.base["version"] + 1
        if self.store.version() != self.base["version"]:
            raise Conflict("another transaction has committed")
        tables = dict(self.base["tables"])
        for name, t in self.pending.items():
            old = tables.get(name, {}).get("deltas", [])
            if name in self.deltas and len(old) + len(self.deltas[name]) <= DELTAS:
                more = [{"put": self._written(put) if put is not None else None, "gone": self._written(gone) if gone is not None else None} for put, gone in self.deltas[name]]
                tables[name] = tables[name] | {"deltas": [*old, *more]}
                continue
            df = t.df.repartitionByRange(*[F.col(k) for k in t.schema.key_names]).sortWithinPartitions(*t.schema.key_names) if t.schema.key else t.df
            cell = lambda c: [c.name, c.dtype, c.max_len]
            tables[name] = {"data": self._written(df), "key": [cell(c) for c in t.schema.key], "values": [cell(c) for c in t.schema.values], "indices": [[n, list(c)] for n, c in t.schema.indices], "deltas": []}
        manifest = {"version": version, "before": self.base["hash"], "tables": tables, "log": [{"table": t, "op": op, "detail": detail} for t, op, detail in self.mutations]}
        manifest["hash"] = _digest(manifest)
        claim(spark, f"{path}/versions/{version}.json", json.dumps(manifest))
        self.closed = True
        return version


def claim(spark: SparkSession, path: str, text: str) -> None:
    """Create a file that must not be there; ``Conflict`` if it is.

    A local store makes a new name by a hard link, which fails if it is taken; others create without overwriting, as
    their file systems promise to do atomically.
    """
    fs, target = filesystem(spark, path)
    fs.mkdirs(target.getParent())
    if fs.getScheme() == "file":
        draft = target.getParent().toUri().getPath() + f"/.draft-{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(draft, target.toUri().getPath())
        except FileExistsError:
            raise Conflict("another transaction has committed") from None
        finally:
            os.remove(draft)
        return
    try:
        out = fs.create(target, False)
    except Exception as e:
        if fs.exists(target):
            raise Conflict("another transaction has committed") from e
        raise
    out.write(bytearray(text, "utf-8"))
    out.close()


def hash_chain(df: DataFrame, order: str, columns: list[str], block: int = 1000) -> DataFrame:
    """(block, n, payload_hash, chain_hash): rows in blocks of ``order``, each block's hash chained to the one before.

    Blocks are hashed in parallel; one hash for each block then passes one task in order, as a chain must.
    """
    import pyarrow as pa

    row = F.sha2(F.encode(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), "UTF-8"), 256)
    rows = df.select(F.expr(f"CAST({order} DIV {block} AS BIGINT)").alias("block"), F.col(order).alias("o"), row.alias("h"))
    blocks = rows.groupBy("block").agg(F.count("*").alias("n"), F.sha2(F.encode(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda s: s["h"])), "UTF-8"), 256).alias("payload_hash"))

    def chain(batches):
        last = "0" * 64
        for batch in batches:
            out = []
            for h in batch.column(2).to_pylist():
                last = hashlib.sha256((last + h).encode()).hexdigest()
                out.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["block", "n", "payload_hash", "chain_hash"])

    return blocks.repartition(1).sortWithinPartitions("block").mapInArrow(chain, "block long, n long, payload_hash string, chain_hash string")
