"""Exact top-k by inner product: best-first search of M-trees with paged metric nodes.

Inner products become a metric by one more coordinate: with M the greatest norm, x' = (x, sqrt(M^2 - |x|^2)) and
q' = (q, 0), the squared distance |q|^2 + M^2 - 2 q.x falls as the product rises.

1. ``PIVOTS`` rows at most, chosen by hash, divide the space: each row belongs to the nearest pivot, and each part keeps
   the greatest distance of a row to its pivot, its covering radius. A part of more than ``SHARD`` rows is dealt to
   several trees by a hash of the id.
2. Each tree is bulk-loaded; its pages are rows of a table: an inner page holds routing objects with covering radii,
   and every entry its distance to the routing object above.
3. A query first searches the part of its own nearest pivot. The k-th best score found there bounds it: only the
   parts whose pivot, less the covering radius, lies within that distance are searched after, and from that bound on.
   Pages go to the queries that need their part and to no others.
4. In a tree a query visits pages in order of their least possible distance. Entries are skipped by the triangle
   inequality on the stored parent distance before their own distance is computed, then by covering radius,
   until no page can hold one of the k best. Queries of one home are searched together, ``TOGETHER`` at a time.

Queries meet trees in blocks of ``BLOCK``: a task holds one tree and one block, whatever the table's size. The search is
exact, so its recall is 1; how much it spares depends on the data (``cost`` counts): of vectors in clusters most
distances are never computed, of independent components hardly any is spared.

Components must be integers (see ``quantised``). Where products may reach 2**53 they are summed as Python
integers, slower and exact. Scores beyond 64 bits are ranked exactly and given as the nearest 64-bit number. Ties go to
the smaller id. Null vectors and ones with null or non-finite components take no part, nor do null ids;
a component of more than ``HUGE`` once scaled counts as infinite. Vectors meet only those of their own length. All
copies of a row are candidates, but rows of the query's own id are not. Of rows of one id that differ, the shortest
vector (then the least in the order of its bytes) asks. Fewer than k candidates: all of them.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, col, written

SHARD = 16384
LEAF = 512
FANOUT = 16
BLOCK = 4096
PIVOTS = 256
TOGETHER = 2048
EXACT = float(1 << 53)
HUGE = 2.0**500


def quantised(df: DataFrame, vector: str, key: str, scale: int = 64) -> DataFrame:
    """(id, dim, q, norm): floor(scale * component) of the usable rows, as native float64 bytes, and their squared sum."""
    raw = df.where(col(key).isNotNull() & col(vector).isNotNull()).select(col(key).cast("long").alias("id"), col(vector).cast("array<double>").alias("v"))

    def factory():
        def work(rows):
            dims, out, norms = [], [], []
            for v in rows:
                x = v.values
                with np.errstate(over="ignore", invalid="ignore"):
                    x = None if x.null_count else np.floor(x.to_numpy(zero_copy_only=False) * scale)
                    ok = x is not None and bool((np.abs(x) <= HUGE).all())
                dims.append(len(x) if ok else None)
                out.append(x.tobytes() if ok else None)
                norms.append(float(x @ x) if ok else None)
            return [pa.array(dims, pa.int32()), pa.array(out, pa.binary()), pa.array(norms, pa.float64())]

        return work

    return arrow_map(raw, ["v"], "dim int, q binary, norm double", factory, keep=["id"]).where("q IS NOT NULL")


def slack_of(whole, exact: bool):
    """What rounding can take from a distance of squared scale ``whole``."""
    return (1e-9 if exact else 1e-6) * (1 + np.sqrt(whole))


def stacked(cells, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float64).reshape(-1, dim)


def dots(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Exact integer products as float64, or Python integers if they may be large."""
    bound = np.abs(rows).max(initial=0) * np.abs(one).max(initial=0) * max(1, rows.shape[1])
    if bound < EXACT:
        return rows @ one
    return np.array([sum(int(a) * int(b) for a, b in zip(r, one)) for r in rows], object)


class Builder:
    """Bulk load: points go to the nearest of FANOUT routing objects, group by group, until a group fits a page."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float):
        norm = (x * x).sum(1)
        self.ids, self.x, self.pages = ids, x, []
        self.lifted = np.concatenate([x, np.sqrt(np.maximum(top - norm, 0))[:, None]], 1)
        self.grow(np.arange(len(ids)), None)

    def distance(self, at: np.ndarray, router: int | None) -> np.ndarray:
        return np.zeros(len(at)) if router is None else np.sqrt(((self.lifted[at] - self.lifted[router]) ** 2).sum(1))

    def grow(self, at: np.ndarray, router: int | None) -> int:
        page = len(self.pages)
        self.pages.append(None)
        above = self.distance(at, router)
        if len(at) <= LEAF:
            self.pages[page] = (page, True, self.ids[at], self.x[at], above, np.zeros(len(at)), np.zeros(0, np.int64))
            return page
        # farthest-first routing objects
        fan = min(FANOUT, max(2, -(-2 * len(at) // LEAF)))
        chosen = [int(at[0])]
        near, owner = self.distance(at, chosen[0]), np.zeros(len(at), np.int64)
        while len(chosen) < fan and near.max() > 0:
            chosen.append(int(at[near.argmax()]))
            d = self.distance(at, chosen[-1])
            owner[d < near] = len(chosen) - 1
            near = np.minimum(near, d)
        if len(chosen) < fan:  # few distinct points: equal ones are dealt in turn
            groups = [g for i in range(len(chosen)) for g in np.array_split(np.flatnonzero(owner == i), max(1, -(-int((owner == i).sum()) // LEAF)))]
            routers = [int(at[g[0]]) for g in groups]
        else:
            groups, routers = [np.flatnonzero(owner == i) for i in range(fan)], chosen
        radius = np.array([near[g].max(initial=0) for g in groups])
        up = self.distance(np.array(routers), router)
        children = np.array([self.grow(at[g], r) for g, r in zip(groups, routers)])
        self.pages[page] = (page, False, self.ids[routers], self.x[routers], up, radius, children)
        return page


PAGES = "dim int, part int, sub int, page int, leaf boolean, ids binary, x binary, up binary, radius binary, children binary, top double"


class Parts:
    """Of each length: pivots, the greatest squared norm, and (once indexed) each part's covering radius and trees."""

    def __init__(self, points: DataFrame):
        facts = points.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("top"))
        facts = written(facts.withColumn("pivots", F.least(F.lit(PIVOTS), F.ceil(F.col("n") / SHARD)).cast("int")), "facts")
        bound = F.lit(float(1 << 30)) * F.greatest(F.lit(64), 4 * F.col("pivots")) / F.col("n")
        drawn = points.join(F.broadcast(facts), "dim").withColumn("h", F.pmod(F.xxhash64(F.lit(7), "q"), F.lit(1 << 30))).where(F.col("h") <= bound)
        drawn = drawn.groupBy("dim", "q").agg(F.min("h").alias("h"), F.first("pivots").alias("pivots"))
        drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("dim").orderBy("h", "q"))).where(F.col("k") <= F.col("pivots"))
        self.top = {r["dim"]: r["top"] for r in facts.collect()}
        # a length whose vectors' hashes all lie above the bound has one part, around the origin
        self.pivots = {d: np.zeros((1, d)) for d in self.top}
        found: dict[int, list] = {}
        for r in drawn.select("dim", "k", "q").collect():
            found.setdefault(r["dim"], []).append((r["k"], bytes(r["q"])))
        self.pivots |= {d: stacked([q for _, q in sorted(rows)], d) for d, rows in found.items()}
        self.radius: dict[int, np.ndarray] = {}

    def distances(self, x: np.ndarray, dim: int, query: bool) -> np.ndarray:
        """From rows (or queries, which lie where the added coordinate is 0) to the pivots."""
        p, top = self.pivots[dim], self.top[dim]
        xn, up = (x * x).sum(1), np.sqrt(np.maximum(top - (p * p).sum(1), 0))
        own = np.zeros(len(x)) if query else np.sqrt(np.maximum(top - xn, 0))
        return np.sqrt(np.maximum((xn + own**2)[:, None] + (p * p).sum(1) + up**2 - 2 * (x @ p.T + own[:, None] * up), 0))

    def near(self, df: DataFrame, query: bool = False) -> DataFrame:
        """The rows with ``part int`` and ``far double``: the nearest pivot and its distance."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def factory():
            parts = shared.value

            def work(dims, q):
                dims, q = dims.to_numpy(), q.to_pylist()
                part, far = np.zeros(len(q), np.int32), np.zeros(len(q))
                for d in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == d)
                    dist = parts.distances(stacked([q[i] for i in at], d), d, query)
                    part[at] = dist.argmin(1)
                    far[at] = dist.min(1)
                return [pa.array(part), pa.array(far)]

            return work

        return arrow_map(df, ["dim", "q"], "part int, far double", factory)

    def index(self, points: DataFrame) -> DataFrame:
        """Pages of the parts' trees, written to the shared folder."""
        placed = written(self.near(points), "placed")
        sizes = placed.groupBy("dim", "part").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
        sizes = written(sizes.withColumn("subs", F.ceil(F.col("n") / SHARD).cast("int")), "parts")
        self.radius = {d: np.full(len(p), -np.inf) for d, p in self.pivots.items()}
        for r in sizes.collect():
            self.radius[r["dim"]][r["part"]] = r["radius"]
        rows = placed.join(F.broadcast(sizes.select("dim", "part", "subs")), ["dim", "part"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int"))
        tops = dict(self.top)

        def build(table: pa.Table) -> pa.Table:
            dim, part, sub = (table.column(c)[0].as_py() for c in ("dim", "part", "sub"))
            ids = table.column("id").to_numpy()
            x = stacked(table.column("q").to_pylist(), dim)
            order = np.argsort(ids, kind="stable")
            ids, x, top = ids[order], x[order], tops[dim]
            made = [(dim, part, sub, p, leaf, i.astype(np.int64).tobytes(), v.tobytes(), up.tobytes(), r.tobytes(), c.astype(np.int64).tobytes(), top) for p, leaf, i, v, up, r, c in Builder(ids, x, top).pages]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 5, pa.float64()]
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names=[f.split()[0] for f in PAGES.split(", ")])

        return written(rows.select("dim", "part", "sub", "id", "q").groupBy("dim", "part", "sub").applyInArrow(build, PAGES), "pages")

    def others(self, queries: DataFrame) -> DataFrame:
        """Rows (id, dim, q, part as home, bound) once for each part that may hold more of their k best."""
        shared = queries.sparkSession.sparkContext.broadcast(self)

        def factory():
            parts = shared.value

            def work(dims, q, home, bound):
                out = []
                for d, x, h, b in zip(dims.to_pylist(), q.to_pylist(), home.to_pylist(), bound.to_pylist()):
                    x = np.frombuffer(x, np.float64)
                    whole = float(x @ x) + parts.top[d]
                    least = parts.distances(x[None], d, True)[0] - parts.radius[d]
                    reach = math.inf if b is None else math.sqrt(max(0.0, whole - 2 * float(b)))
                    hit = np.flatnonzero((least <= reach + 2 * slack_of(whole, False)) & (parts.radius[d] > -np.inf)).tolist()
                    out.append([p for p in hit if p != h])
                return [pa.array(out, pa.list_(pa.int32()))]

            return work

        return arrow_map(queries, ["dim", "q", "home", "bound"], "parts array<int>", factory).withColumn("part", F.explode("parts")).drop("parts")


class Tree:
    def __init__(self, pages: list[dict]):
        self.top = pages[0]["top"]
        self.pages = {}
        for p in pages:
            ids = np.frombuffer(p["ids"], np.int64)
            x = np.frombuffer(p["x"], np.float64).reshape(len(ids), p["dim"]) if len(ids) else np.zeros((0, p["dim"]))
            self.pages[p["page"]] = (p["leaf"], ids, x, *(np.frombuffer(p[k], np.float64) for k in ("up", "radius")), np.frombuffer(p["children"], np.int64))
        self.computed = 0
        self.largest = max((float(np.abs(x).max(initial=0)) for _, _, x, *_ in self.pages.values()), default=0.0)

    def exact(self, q: np.ndarray) -> bool:
        """Whether all sums of products with q, and norms, are whole numbers that float64 holds."""
        return max(self.largest, float(np.abs(q).max(initial=0))) ** 2 * max(1, q.shape[-1]) < EXACT

    def best(self, own: int, q: np.ndarray, k: int, bound: float = -math.inf) -> list[tuple[int, int]]:
        """(score, id), best first; what lies under ``bound`` may be left out."""
        whole = float(q @ q) + self.top
        slack = float(slack_of(whole, self.exact(q)))
        score, found, reach = np.zeros(0), np.zeros(0, np.int64), math.inf if bound == -math.inf else math.sqrt(max(0.0, whole - 2 * bound)) + slack
        heap: list[tuple[float, int, float | None]] = [(0.0, 0, None)]
        while heap:
            least, page, router = heapq.heappop(heap)
            if least > reach:
                break
            leaf, ids, x, up, radius, children = self.pages[page]
            at = np.arange(len(ids))
            if router is not None and reach < math.inf:
                at = np.flatnonzero(np.abs(router - up) - (0 if leaf else radius) <= reach)
                if not len(at):
                    continue
            self.computed += len(at)
            dot = dots(x if len(at) == len(ids) else x[at], q)
            if leaf:
                ok = ids[at] != own
                score, found = np.concatenate([score, dot[ok]]), np.concatenate([found, ids[at][ok]])
                if len(found) > k:
                    if len(found) > 4 * k and score.dtype != object:
                        enough = score >= np.partition(score, len(score) - k)[len(score) - k]
                        score, found = score[enough], found[enough]
                    order = np.lexsort((found, -score))[:k] if score.dtype != object else np.array(sorted(range(len(found)), key=lambda i: (-score[i], found[i]))[:k])
                    score, found = score[order], found[order]
                if len(found) == k:
                    reach = min(reach, math.sqrt(max(0.0, whole - 2 * float(min(score)))) + slack)
            else:
                d = np.sqrt(np.maximum(whole - 2 * dot.astype(np.float64), 0))
                low = np.maximum(d - radius[at] - slack, 0)
                for i in np.flatnonzero(low <= reach).tolist():
                    heapq.heappush(heap, (float(low[i]), int(children[at[i]]), float(d[i])))
        order = sorted(range(len(found)), key=lambda i: (-score[i], found[i]))
        return [(int(score[i]), int(found[i])) for i in order]


def best_of_many(tree: Tree, own: np.ndarray, q: np.ndarray, k: int, bound: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
    """``Tree.best`` for many queries at once: in each round every query visits its own next page, those of one page together."""
    n, pages = len(q), len(tree.pages)
    bound = np.full(n, -np.inf) if bound is None else bound
    if not tree.exact(q):
        return [tree.best(int(o), x, k, float(b)) for o, x, b in zip(own, q, bound)]
    whole = (q * q).sum(1) + tree.top
    slack = slack_of(whole, True)
    low = np.full((n, pages), np.inf)
    low[:, 0] = 0
    router = np.full((n, pages), np.nan)
    score, found, reach = np.full((n, k), -np.inf), np.full((n, k), -1), np.sqrt(np.maximum(whole - 2 * bound, 0)) + slack
    live = np.arange(n)
    while len(live):
        page = low[live].argmin(1)
        least = low[live, page]
        on = (least <= reach[live]) & (least < np.inf)
        live, page = live[on], page[on]
        low[live, page] = np.inf
        order = np.argsort(page, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(page[order])) + 1):
            if not len(part):
                continue
            p, g = int(page[part[0]]), live[part]
            leaf, ids, x, up, radius, children = tree.pages[p]
            want = np.ones((len(g), len(ids)), bool)
            if p:
                want = np.abs(router[g, p][:, None] - up) - (0 if leaf else radius) <= reach[g][:, None]
            at = np.flatnonzero(want.any(0))
            if not len(at):
                continue
            tree.computed += len(at) * len(g)
            dot = q[g] @ x[at].T
            if leaf:
                dot[ids[at] == own[g][:, None]] = -np.inf
                some = np.flatnonzero((dot >= score[g, -1:]).any(1))
                if len(some):
                    h = g[some]
                    s = np.concatenate([score[h], dot[some]], 1)
                    i = np.concatenate([found[h], np.broadcast_to(ids[at], (len(some), len(at)))], 1)
                    if s.shape[1] > 8 * k:  # all that may be among the k best, ties included
                        cut = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                        m = int((s >= cut).sum(1).max())
                        pick = np.argpartition(-s, min(m, s.shape[1]) - 1, axis=1)[:, :m]
                        s, i = np.take_along_axis(s, pick, 1), np.take_along_axis(i, pick, 1)
                    top = np.lexsort((i, -s), axis=1)[:, :k]
                    score[h], found[h] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
                    reach[h] = np.minimum(reach[h], np.sqrt(np.maximum(whole[h] - 2 * score[h, -1], 0)) + slack[h])
            else:
                d = np.sqrt(np.maximum(whole[g][:, None] - 2 * dot, 0))
                low[g[:, None], children[at]] = np.where(want[:, at], np.maximum(d - radius[at] - slack[g][:, None], 0), np.inf)
                router[g[:, None], children[at]] = d
    return [[(int(s), int(i)) for s, i in zip(a, b) if s > -np.inf] for a, b in zip(score, found)]


FOUND = "query_id long, part int, sub int, vec_id long, score long"


def clipped(score: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, score))


def meet(pages: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, part, sub, vec_id, score, exact) from pages and rows (id, dim, q, home, part, bound): k best of each tree.

    A row of a null query_id counts in ``score`` the distances that its task computed.
    """
    counts = asked.groupBy("dim", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    counts = written(counts, "asked")  # a row for each part
    there = pages.join(F.broadcast(counts), ["dim", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    trees = written(pages.where("page = 0").groupBy("dim", "part").agg(F.max("sub").alias("subs")), "trees")
    asked = asked.join(F.broadcast(counts.join(trees, ["dim", "part"])), ["dim", "part"])
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("blocks")).cast("int")).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs")))).drop("blocks", "subs")
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            tree, part, sub = Tree(left.to_pylist()), left.column("part")[0].as_py(), left.column("sub")[0].as_py()
            right = right.sort_by([("home", "ascending"), ("id", "ascending")])
            own, q = right.column("id").to_numpy(), stacked(right.column("q").to_pylist(), left.column("dim")[0].as_py())
            bound = right.column("bound").to_numpy(zero_copy_only=False).astype(float)
            bound = np.where(np.isnan(bound), -np.inf, bound)
            for at in range(0, len(own), TOGETHER):
                some = slice(at, at + TOGETHER)
                for o, best in zip(own[some].tolist(), best_of_many(tree, own[some], q[some], k, bound[some])):
                    out += [(o, part, sub, i, clipped(s), str(s) if s != clipped(s) else None) for s, i in best]
            out.append((None, part, sub, None, tree.computed, None))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([],) * 6, kinds)], names=["query_id", "part", "sub", "vec_id", "score", "exact"])

    keys = ["dim", "part", "sub", "block"]
    return there.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, FOUND + ", exact string")


def searched(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """What ``meet`` gives, of the queries' home parts and of all others that may hold more; written."""
    parts = Parts(points)
    pages = parts.index(points)
    homes = parts.near(queries, True).drop("far").withColumn("home", F.col("part"))
    homes = written(homes, "homes")
    first = written(meet(pages, homes.withColumn("bound", F.lit(None).cast("double")), k), "home")
    # of each tree that gave k, the least; scores not clipped bound as they are
    full = first.where("query_id IS NOT NULL").groupBy("query_id", "sub").agg(F.count("*").alias("c"), F.min("score").alias("least"))
    bounds = full.where((F.col("c") >= k) & (F.col("least") > -(1 << 63))).groupBy(F.col("query_id").alias("id")).agg(F.max("least").cast("double").alias("bound"))
    second = meet(pages, parts.others(homes.drop("part").join(bounds, "id", "left")), k)
    return first.unionByName(second)


def search(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from rows (id, dim, q, norm)."""
    found = searched(points, queries, k).where("query_id IS NOT NULL")
    # beyond 64 bits the exact number ranks: a positive one by its digits, a negative one the other way round
    digits = F.coalesce(F.length(F.ltrim("exact", F.lit("-"))), F.lit(0)) * F.signum("score")
    text = F.when(F.col("score") > 0, F.col("exact")).otherwise(F.translate("exact", "0123456789", "9876543210"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(digits), F.desc_nulls_last(text), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def asked(df: DataFrame, vector: str, key: str, every: int, scale: int) -> tuple[DataFrame, DataFrame]:
    points = written(quantised(df, vector, key, scale), "points")
    asks = points.where(F.pmod(F.col("id"), F.lit(every)) == 0)
    return points, asks.groupBy("id").agg(F.min(F.struct("dim", "q", "norm")).alias("x")).select("id", "x.*")


def top_k(df: DataFrame, vector: str = "embedding", key: str = "vec_id", every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """The k best of every row whose id is divisible by ``every``, among all rows but its own."""
    return search(*asked(df, vector, key, every, scale), k)


def cost(df: DataFrame, vector: str = "embedding", key: str = "vec_id", every: int = 20, k: int = 20, scale: int = 64) -> float:
    """Distances to rows and routing objects that ``top_k`` computes, as a share of all pairs of query and row."""
    points, queries = asked(df, vector, key, every, scale)
    done = searched(points, queries, k).where("query_id IS NULL").agg(F.sum("score")).first()[0] or 0
    return done / max(1, points.count() * queries.count())
