"""Exact Jaccard self-join on word shingles by T-occurrence search, and removal of near duplicates.

A text's set is its distinct k-word shingles (ASCII letters lower-cased; words end at ASCII white space; a text of
fewer words is one shingle), each a 64-bit hash. Two texts link when den * intersection >= num * union.

1. Shingles met in several texts of one stretch of the corpus are counted over all stretches; the most frequent
   ones are broadcast (``FREQUENT`` at most) and set aside in step 2. Which ones they are changes no result.
2. Sets without them are cut into parts by their hashes, as many as linked sets of that size can differ in, and some
   more, so that linked sets agree in a whole part (pigeonhole; leaving shingles out of both only shrinks their
   difference). As the number of parts must be the same for both, sizes form intervals whose ends stand in the
   ratio den / num, and a set is cut for its own interval and for the next. A part's key is a hash of its shingles.
   A set of which so much is set aside that too many parts are empty is cut a second time with all its shingles;
   of two sets that agree in empty parts only, both are.
3. The sets of a key form a group. Of a stretch of the table keys are sorted and packed before the shuffle, 32 bits and a
   little for each and as many bits for its set as the stretch's ids differ in. What is cut off of a key may bring
   sets together by chance, which the next step mends. Equal groups become one.
4. The sets of a group are compared, each with each: by their sizes, and by how many shingles of each of 512 kinds are
   an odd number, as sets that differ in d shingles differ in at most d of these bits. What may link by that, and the
   texts of a key that more than ``CROWD`` have, are joined to clusters. So texts that share a common line, but little
   else, form no clusters that outgrow the table. Equal sets become one class; only one text of each goes on.
5. The texts of a cluster meet in one task, if they are few; a cluster of more than ``ROWS`` texts or ``UNIT``
   shingles is dealt to blocks of about half of that, and ``LEADERS`` texts of it, chosen by hash, go to every block,
   so that near copies in unlike blocks are connected by the leaders. Only texts that then still stand apart from the
   most of their cluster meet all its texts again: both are dealt to at most ``SPREAD`` blocks, each with each, so a text
   is read a bounded number of times unless more than ``WIDE`` shingles would meet in a block. Where few stand apart
   they are one block, and every text is read twice.
6. A block is searched by DivideSkip: of a query's inverted lists the longest, fewer than the required overlap T, are
   set aside; the others are merged by a heap and their counts, with binary probes of the long lists, decide which
   records reach T. Records already connected to the query are skipped: of linked texts, enough links for the
   connected components are kept, not all pairs. A query's likeliest record is tried first, as a link to it often
   leaves nothing else to ask.
7. Connected components give each document the smallest id reachable.

Collisions of 64-bit hashes inside a cluster are the only inexactness. Defined results: null and word-free texts
have no shingle and no link, their component is their own id. Rows of one id are one node. Rows with a null id are
counted, but link with nothing and have a null component. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_map, col, discard, slices, swept, tidied, written
from .graph import components
from .sharding import numbered

#: Bytes of text hashed at a time.
SPAN = 1 << 19
#: Keys of a stretch of the table, inside of which sets are joined before the shuffle.
STRETCH = 800_000
#: Frequent shingles set aside (8 bytes each are broadcast), and shingles of a stretch in which they are counted.
FREQUENT = 1 << 17
COUNTED = 1_500_000
#: Bits of a key that are kept, shingles for which there is one more range of keys, and ranges at most.
KEPT, RANGE, RANGES = 48, 1_000_000, 1 << 16
#: Bits of a sketch; texts of a key up to which each is compared with each.
SKETCH, CROWD = 512, 4096
#: Texts and shingles up to which a cluster is searched in one task.
ROWS = 128
UNIT = 1_000_000
#: Texts of a larger cluster that go to each of its blocks; blocks to which the texts of a cluster and those that stand
#: apart in it are dealt, each; shingles of a block beyond which there are more.
LEADERS = 4
SPREAD = 16
WIDE = 1_000_000

_rng = np.random.default_rng(2024)
_byte = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_gap = np.zeros(256, bool)
_gap[[0x20, *range(0x09, 0x0E)]] = True
_base = np.uint64(0x9E3779B97F4A7C15)
_inverse = np.uint64(pow(int(_base), -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * SPAN)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_base, _inverse)]
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingles(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _lower[np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)]
    up, down = powers(len(data))
    gap = _gap[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    first, past = edge[::2], edge[1::2]
    total = np.cumsum(_byte[data] * up[: len(data)], dtype=np.uint64)
    words = mixed((total[past - 1] - total[first - 1]) * down[first])
    ends = np.cumsum([1] + [len(r) + 1 for r in raw])
    cut = np.searchsorted(first, ends)
    n = len(words)
    s = np.full(max(0, n - k + 1), np.uint64(k * int(_base) & (1 << 64) - 1))
    for j in range(k):
        s = s * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + len(s)]
    s = mixed(s)
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b - a >= k:
            x = np.sort(s[a : b - k + 1])
            out.append(x[np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))] if len(x) > 1 else x)
        elif b > a:
            one = np.uint64((b - a) * int(_base) & (1 << 64) - 1)
            for w in words[a:b]:
                one = np.uint64((int(one) * 0xC2B2AE3D27D4EB4F + int(w)) & (1 << 64) - 1)
            out.append(mixed(np.array([one])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of equal values of a sorted array."""
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return begin, np.diff(np.concatenate([begin, [len(x)]]))


def intervals(num: int, den: int):
    """Function from a size to its interval, and from an interval to (parts, empty parts that do no harm)."""
    tops = [0]

    def of(n: int) -> int:
        while tops[-1] < n:
            tops.append((tops[-1] + 1) * den // num)
        return int(np.searchsorted(tops, n))

    def parts(i: int) -> tuple[int, int]:
        of(tops[-1] + 1) if i >= len(tops) else None
        apart = (den - num) * 2 * tops[i] // (den + num)
        spare = apart // 5 + 2 if apart else 0
        return apart + 1 + spare, spare

    return of, parts


def keys_of(x: np.ndarray, i: int, m: int, spare: int, salt: int, empties: bool) -> tuple[np.ndarray, bool]:
    """Keys of the parts of a sorted set for interval i, and whether more than ``spare`` parts are empty.

    Sets that agree in nothing but empty parts have m minus the most differences, that is ``spare`` + 1, of them;
    only then, and with ``empties``, do empty parts have keys.
    """
    part = ((x >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    begin = runs(part)[0]
    label = part[begin]
    sums = np.add.reduceat(mixed(x ^ np.uint64(0x5851F42D4C957F2D)), begin) if len(x) else np.zeros(0, np.uint64)
    many = m - len(begin) > spare
    if many and empties:
        label, sums = np.concatenate([label, np.setdiff1d(np.arange(m, dtype=np.uint64), label)]), np.concatenate([sums, np.zeros(m - len(begin), np.uint64)])
    return mixed(sums ^ (label * _base + np.uint64((2 * i + salt + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1))), many


def frequent(docs: DataFrame, k: int, least: int = 3) -> np.ndarray:
    """The shingles met most, of those in ``least`` texts of a stretch or more; sorted."""

    def run(batches):
        held, size = [], 0

        def flush():
            x = np.sort(np.concatenate(held))
            begin, count = runs(x)
            many = count >= least
            return pa.RecordBatch.from_arrays([pa.array(x[begin[many]].view(np.int64)), pa.array(count[many].astype(np.int64))], names=["s", "n"])

        for batch in batches:
            for part in slices(batch, 0, SPAN):
                for x in shingles([t or "" for t in part.column(0).to_pylist()], k):
                    held.append(x)
                    size += len(x)
                if size >= COUNTED:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    found = docs.select("t").mapInArrow(tidied(run), "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "s").limit(FREQUENT).select("s").toArrow()
    return np.sort(rows.column("s").to_numpy().astype(np.int64).view(np.uint64))


def all_keys(x: np.ndarray, often: np.ndarray, of, parts) -> np.ndarray:
    at = of(len(x))
    rare = x
    if len(often):
        near = np.searchsorted(often, x)
        near[near == len(often)] = 0
        rare = x[often[near] != x]
    out, again = [], False
    for j in (at, at + 1):
        keys, many = keys_of(rare, j, *parts(j), 0, False)
        out.append(keys)
        again |= many
    if again:
        out += [keys_of(x, j, *parts(j), 1, True)[0] for j in (at, at + 1)]
    return np.concatenate(out)


def sketch(x: np.ndarray) -> bytes:
    """Whether the shingles of each of ``SKETCH`` kinds are an odd number: a bit for each."""
    return np.packbits(np.bincount((x % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def sets(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, f, s): number of shingles, fingerprint and sketch of the set."""

    def factory():
        def work(texts):
            found = shingles([t or "" for t in texts.to_pylist()], k)
            prints = [blake2b(x, digest_size=16).digest() if len(x) else None for x in found]
            return [pa.array([len(x) for x in found], pa.int64()), pa.array(prints, pa.binary()), pa.array([sketch(x) if len(x) else None for x in found], pa.binary())]

        return work

    return arrow_map(docs, ["t"], "n long, f binary, s binary", factory, keep=["id"], budget=SPAN)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs (node, root) for the nodes that the pairs connect."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if find(x) != x]
    return nodes, [find(x) for x in nodes]


def packed(keys: np.ndarray, owners: np.ndarray) -> tuple[bytes, bytes, bytes, int]:
    """Sorted keys of up to ``KEPT`` bits, as low halves and the steps of the high ones in unary, and their owners by as many bits as the largest takes."""
    high = (keys >> np.uint64(32)).astype(np.int64)
    steps = np.zeros(len(keys) + int(high[-1]), np.uint8)
    steps[high + np.arange(len(keys))] = 1
    width = max(1, int(owners.max()).bit_length())
    bits = (owners[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return keys.astype("<u4").tobytes(), np.packbits(steps).tobytes(), np.packbits(bits.astype(np.uint8)).tobytes(), width


def unpacked(low: bytes, steps: bytes, owners: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(low, "<u4").astype(np.uint64)
    n = len(keys)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(steps, np.uint8)))[:n] - np.arange(n)
    bits = np.unpackbits(np.frombuffer(owners, np.uint8), count=n * width).reshape(n, width)
    return keys | (high.astype(np.uint64) << np.uint64(32)), (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)


def met(keys: np.ndarray, ids: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The different groups of ids that have a key in common, and for larger ones than ``CROWD`` pairs that connect each."""
    order = np.argsort(keys, kind="stable")  # merges the sorted keys of each stretch
    keys, ids = keys[order], ids[order]
    begin, count = runs(keys)
    shared = np.repeat(count, count) > 1
    keys, ids = keys[shared], ids[shared]
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    once = np.ones(len(keys), bool)
    once[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[once], ids[once]
    begin, count = runs(keys)
    crowd = np.repeat(count > CROWD, count)
    pairs = np.unique(np.stack([ids[crowd], np.repeat(ids[begin], count)[crowd]], 1), axis=0)
    several = np.flatnonzero((count > 1) & (count <= CROWD))
    if not len(several):
        return [], pairs[:, 0], pairs[:, 1]
    marks = np.add.reduceat(mixed(ids.view(np.uint64)), begin)
    marks = np.stack([marks[several], ids[begin[several]].view(np.uint64), count[several].astype(np.uint64)], 1)
    several = several[np.unique(marks, axis=0, return_index=True)[1]]
    return [ids[b : b + c] for b, c in zip(begin[several].tolist(), count[several].tolist())], pairs[:, 0], pairs[:, 1]


def candidates(docs: DataFrame, k: int, num: int, den: int, ranges: int) -> DataFrame:
    """(sure, ids): groups of texts that share a key, and pairs that are connected; keys meet in so many ranges."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent(docs, k))
    cut = np.uint64(64 - KEPT)
    base = [-(-(r << KEPT) // ranges) for r in range(ranges + 1)]

    def local(batches):
        (of, parts), often = intervals(num, den), shared.value
        held: dict[bytes, int] = {}
        drawn: list[np.ndarray] = []
        owner: list[bytes] = []
        copies: list[tuple[int, int]] = []
        size = 0
        names = ["r", "first", "width", "low", "steps", "own"]

        def flush():
            nonlocal size
            ids = np.repeat(np.array([held[f] for f in owner], np.int64), [len(x) for x in drawn])
            keys = np.concatenate(drawn) >> cut
            order = np.argsort(keys)
            keys, ids = keys[order], ids[order]
            first = int(ids.min())
            own = ids.view(np.uint64) - np.array([first], np.int64).view(np.uint64)
            at = ((keys * np.uint64(ranges)) >> np.uint64(KEPT)).astype(np.int64)
            begin, count = runs(at)
            rows = []
            for b, c in zip(begin.tolist(), count.tolist()):
                low, steps, who, width = packed(keys[b : b + c] - np.uint64(base[at[b]]), own[b : b + c])
                rows.append((int(at[b]), first, width, low, steps, who))
            same = [(x, held[f]) for f, x in copies if x != held[f]]
            if same:
                rows.append((same[0][0] % ranges, None, None, None, None, np.array(same, np.int64).tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)
            held.clear(), drawn.clear(), owner.clear(), copies.clear()
            size = 0

        for batch in batches:
            for part in slices(batch, 1, SPAN):
                for i, x in zip(part.column(0).to_pylist(), shingles(part.column(1).to_pylist(), k)):
                    if not len(x):
                        continue
                    f = blake2b(x, digest_size=16).digest()
                    copies.append((f, i))
                    if f in held:
                        held[f] = min(held[f], i)
                        continue
                    held[f] = i
                    owner.append(f)
                    drawn.append(all_keys(x, often, of, parts))
                    size += len(drawn[-1])
                if size >= STRETCH:
                    yield from flush()
        if size:
            yield from flush()

    def across(batches):
        at, held = None, []

        def rows(sure, groups):
            ends = np.cumsum([0, *map(len, groups)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(groups), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([sure] * len(groups)), lists], names=["sure", "ids"])

        def done():
            groups, a, b = met(*(np.concatenate(c) for c in zip(*held)))
            if groups:
                yield rows(False, groups)
            a, b = forest(a, b)
            if a:
                yield rows(True, list(zip(a, b)))

        for batch in batches:
            for r, first, width, low, steps, own in zip(*[batch.column(c).to_pylist() for c in range(6)]):
                if low is None:
                    yield rows(True, list(np.frombuffer(own, np.int64).reshape(-1, 2)))
                    continue
                if r != at and held:
                    yield from done()
                    held = []
                at = r
                keys, who = unpacked(low, steps, own, width)
                held.append((keys, (who + np.array([first], np.int64).view(np.uint64)).view(np.int64)))
        if held:
            yield from done()

    dealt = docs.where("id IS NOT NULL AND t IS NOT NULL").select("id", "t").mapInArrow(tidied(local), "r long, first long, width int, low binary, steps binary, own binary")
    return dealt.repartition("r").sortWithinPartitions("r").mapInArrow(tidied(across), "sure boolean, ids array<long>")


def alike(n: np.ndarray, s: np.ndarray, known: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each set (by place) the least place that it may be connected to, by sizes n and sketches s; those not known may link with any."""
    root = np.arange(len(n))
    short = np.bitwise_xor.reduce(s, 1)  # is a sketch of 64 kinds
    for i in range(len(n) - 1):
        j = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if not len(j):
            continue
        most = (n[i] + n[j]) * (den - num)
        ok = (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])) & (np.bitwise_count(short[i] ^ short[j]).astype(np.int64) * (den + num) <= most)
        at = np.flatnonzero(ok)
        ok[at] = np.bitwise_count(s[i] ^ s[j[at]]).sum(1, dtype=np.int64) * (den + num) <= most[at]
        j = j[ok | ~known[j] | ~known[i]]
        if len(j):
            joined = np.unique(root[np.append(j, i)])
            root[np.isin(root, joined)] = joined[0]
    return root


def compared(groups: DataFrame, every_set: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs that connect what may link of each group, and the sure ones."""
    sure = groups.where("sure").select(F.col("ids")[0].alias("a"), F.col("ids")[1].alias("b"))
    members = groups.where("NOT sure").select("ids").distinct().select(F.xxhash64("ids").alias("g"), F.explode("ids").alias("id"))
    members = written(members, "members")
    asked = written(members.select("id").distinct(), "asked")
    few = asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = every_set.where("n > 0").join(F.broadcast(asked) if few else asked, "id")
    # of an id with unlike sets nothing is known
    found = found.groupBy("id").agg(F.first("n").alias("n"), F.when(F.min("f") == F.max("f"), F.first("s")).alias("s"))

    def run(batches):
        at, held = None, []

        def pairs(rows):
            ids, n = np.array([x[0] for x in rows], np.int64), np.array([x[1] for x in rows], np.int64)
            known = np.array([x[2] is not None for x in rows])
            s = np.frombuffer(b"".join(x[2] or bytes(SKETCH // 8) for x in rows), np.uint64).reshape(len(rows), -1)
            root = alike(n, s, known, num, den)
            more = np.flatnonzero(root != np.arange(len(rows)))
            return ids[more], ids[root[more]]

        for batch in batches:
            a, b = [], []
            for g, *row in zip(*[batch.column(c).to_pylist() for c in range(4)]):
                if g != at and held:
                    x, y = pairs(held)
                    a.append(x), b.append(y)
                    held = []
                at = g
                held.append(row)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs(held)], names=["a", "b"])

    rows = members.join(found, "id").select("g", "id", "n", "s").repartition("g").sortWithinPartitions("g", "n", "id")
    return rows.mapInArrow(tidied(run), "a long, b long").union(sure).distinct()


def merge(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Records of sorted lists, in order, with the number of lists each is in, by a heap of the lists' heads."""
    out: list[int] = []
    have: list[int] = []
    for r in heapq.merge(*[x.tolist() for x in lists]):
        if out and out[-1] == r:
            have[-1] += 1
        else:
            out.append(r)
            have.append(1)
    return np.array(out, np.int64), np.array(have, np.int64)


def search(rows: list[np.ndarray], num: int, den: int, guest: list[bool] | None = None, known: list[int] | None = None) -> np.ndarray:
    """For each set (by place) the least place that it is connected to, by links among these sets.

    With ``guest``, only guests are indexed and only the others ask: links between two of one kind are not looked for.
    ``known``: sets of equal numbers are connected from the start.
    """
    m = len(rows)
    order = sorted(range(m), key=lambda i: len(rows[i]))
    sized = [rows[i] for i in order]
    size = np.array([len(x) for x in sized], np.int64)
    root = np.arange(m)
    if known is not None:
        first: dict[int, int] = {}
        root = np.array([first.setdefault(known[i], k) for k, i in enumerate(order)])
    held = np.ones(m, bool) if guest is None else np.array([guest[i] for i in order])
    inside = np.flatnonzero(held)
    every = np.concatenate([sized[i] for i in inside]) if len(inside) else np.zeros(0, np.uint64)
    record = np.repeat(inside, size[inside])
    by = np.argsort(every, kind="stable")  # records of a shingle stay in order
    begin, count = runs(every[by])
    lists, tokens = record[by], every[by][begin]
    rank = np.empty(len(every), np.int64)
    rank[by] = np.arange(len(every)) - np.repeat(begin, count)
    ends = np.cumsum(size * held)

    def linked(i: int, j: int) -> bool:
        x, y = sized[i], sized[j]
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int((y[at] == x).sum())
        return den * both >= num * (len(x) + len(y) - both)

    def union(i: int, j: int) -> None:
        a, b = sorted((int(root[i]), int(root[j])))
        root[root == b] = a

    for q in range(m) if len(every) else ():
        n = int(size[q])
        # sizes that may link; of two indexed sets the later asks
        low, high = int(np.searchsorted(size, -(-n * num // den))), q if guest is None else int(np.searchsorted(size, n * den // num, "right"))
        if guest is not None and held[q]:
            continue
        if not (root[low:high][held[low:high]] != root[q]).any():
            continue
        t = np.searchsorted(tokens, sized[q])
        t[t == len(tokens)] = 0
        there = tokens[t] == sized[q]
        t = t[there]
        long = rank[ends[q] - n : ends[q]] if guest is None else count[t]  # entries that may be asked for
        least = -(-n * num // den)
        need = max(1, -(-num * (n + least) // (num + den)))
        by_length = np.argsort(-long, kind="stable")
        aside, short = by_length[: need - 1], by_length[need - 1 :]
        short = [lists[begin[i] : begin[i] + c] for i, c in zip(t[short].tolist(), long[short].tolist()) if c]
        if not short:
            continue
        # the record met most in the shortest lists first: a link to it often settles the query
        failed: list[int] = []
        while len(failed) < 3:
            some = np.concatenate(short[-8:])
            some = some[(some >= low) & (some < high)]
            some = some[root[some] != root[q]]
            some = some[~np.isin(some, failed)] if failed else some
            if not len(some):
                break
            likely = int(np.bincount(some).argmax())
            if linked(q, likely):
                union(q, likely)
            else:
                failed.append(likely)
        if not (root[low:high][held[low:high]] != root[q]).any():
            continue
        lean = []
        for x in short:
            x = x[(x >= low) & (x < high)]
            x = x[root[x] != root[q]]
            if len(x):
                lean.append(x)
        if not lean:
            continue
        found, have = merge(lean)
        if failed:
            keep = ~np.isin(found, failed)
            found, have = found[keep], have[keep]
        wanted = -(-num * (n + size[found]) // (num + den))
        for left, i in zip(range(len(aside), 0, -1), aside.tolist()):
            ok = have + left >= wanted
            if not ok.all():
                found, have, wanted = found[ok], have[ok], wanted[ok]
            if not len(found):
                break
            x = lists[begin[t[i]] : begin[t[i]] + long[i]]
            if len(x):
                at = np.searchsorted(x, found)
                at[at == len(x)] = 0
                have = have + (x[at] == found)
        for j in found[have >= wanted].tolist() if len(found) else ():
            if root[j] != root[q]:
                union(q, j)
    place = np.array(order, np.int64)
    head: dict[int, int] = {}
    for i in range(m):
        r = int(root[i])
        head[r] = min(head.get(r, m), int(place[i]))
    out = np.empty(m, np.int64)
    out[place] = [head[int(root[i])] for i in range(m)]
    return out


def searched(texts: DataFrame, k: int, num: int, den: int, hosted: bool = False) -> DataFrame:
    """(a, b): links in each unit of rows (id, t, component, i, j, guest, known); with ``hosted``, to guests only."""
    texts = texts.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "id")

    def run(batches):
        unit, ids, rows, guests, known = None, [], [], [], []

        def done():
            head = search(rows, num, den, guests if hosted else None, known if hosted else None)
            a = [ids[i] for i in range(len(ids)) if head[i] != i]
            b = [ids[head[i]] for i in range(len(ids)) if head[i] != i]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for part in slices(batch, 1, SPAN):
                own, t, guest, group, *u = (part.column(c).to_pylist() for c in (0, 1, 5, 6, 2, 3, 4))
                for id_, x, g, c, *at in zip(own, shingles(t, k), guest, group, *u):
                    if at != unit:
                        if len(rows) > 1:
                            yield done()
                        unit, ids, rows, guests, known = at, [], [], [], []
                    if len(x):
                        ids.append(id_), rows.append(x), guests.append(g), known.append(c)
        if len(rows) > 1:
            yield done()

    return texts.select("id", "t", "component", "i", "j", "guest", "known").mapInArrow(tidied(run), "a long, b long")


def every(n) -> Column:
    """All numbers below a column's."""
    return F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1)


def units(docs: DataFrame, nodes: DataFrame, own, guests) -> DataFrame:
    """Texts of the nodes in their units: ``own`` and ``guests`` give each row's arrays of (i, j, guest)."""
    few = nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.where("id IS NOT NULL AND t IS NOT NULL").join(F.broadcast(nodes) if few else nodes, F.col("id") == F.col("node"))
    return texts.select("id", "t", "component", "known", F.explode(F.concat(own, guests)).alias("u")).select("id", "t", "component", "u.i", "u.j", "u.guest", "known")


def seats(i, j, guest: bool):
    """An array of seats from an array of i and one of j, each with each."""
    seat = lambda x, y: F.struct(x.alias("i"), y.alias("j"), F.lit(guest).alias("guest"))
    return F.flatten(F.transform(i, lambda x: F.transform(j, lambda y: seat(x, y))))


def clusters(classes: DataFrame, grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (component, node, n, blocks), and the large clusters (component, blocks, all); written."""
    nodes = written(grouped.join(classes.select(F.col("id").alias("node"), "n"), "node"), "nodes")
    large = nodes.groupBy("component").agg(F.sum("n").alias("all"), F.count("*").alias("rows")).where((F.col("all") > UNIT) | (F.col("rows") > ROWS))
    blocks = F.greatest(F.ceil(F.col("rows") * 2 / ROWS), F.ceil(F.col("all") * 2 / UNIT)).cast("int")
    large = written(large.select("component", blocks.alias("blocks"), "all"), "large")
    few = large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return nodes.join(F.broadcast(large) if few else large, "component", "left").select("component", "node", "n", "blocks"), large


def links(docs: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): the links inside small clusters and blocks, and to the leaders of large clusters."""
    draw = F.xxhash64(F.lit(3), "node")
    leaders = nodes.where("blocks IS NOT NULL").groupBy("component", F.pmod(draw, F.lit(LEADERS))).agg(F.min(F.struct(draw, "node")).alias("x")).select(F.col("x.node").alias("node"), F.lit(True).alias("leads"))
    leaders = written(leaders, "leaders")
    few = leaders.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    nodes = nodes.join(F.broadcast(leaders) if few else leaders, "node", "left").withColumn("known", F.lit(0).cast("long"))
    mine = F.when(F.col("leads"), every(F.col("blocks"))).otherwise(F.array(F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0)).cast("int")))
    return searched(units(docs, nodes, seats(mine, F.array(F.lit(0)), False), F.array().cast("array<struct<i:int,j:int,guest:boolean>>")), k, num, den)


def apart(docs: DataFrame, nodes: DataFrame, large: DataFrame, found: DataFrame, k: int, num: int, den: int) -> DataFrame | None:
    """(a, b): links of the texts of large clusters that stand apart from the most of theirs, to any of it; None without such."""
    now = nodes.where("blocks IS NOT NULL").join(found.withColumnRenamed("component", "now"), "node", "left").withColumn("known", F.coalesce("now", "node")).drop("now", "blocks")
    now = written(now, "now")
    most = now.groupBy("component", "known").agg(F.count("*").alias("c")).groupBy("component").agg(F.max_by("known", F.struct("c", "known")).alias("most"))
    most = written(most, "most")
    few = most.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    now = now.join(F.broadcast(most) if few else most, "component").withColumn("guest", F.col("known") != F.col("most")).drop("most")
    there = now.groupBy("component").agg(F.count("*").alias("rows"), F.sum(F.col("guest").cast("long")).alias("z"), F.sum(F.when(F.col("guest"), F.col("n")).otherwise(0)).alias("out"))
    there = written(there.where("z > 0").join(large.select("component", "all"), "component"), "apart")
    if there.isEmpty():
        return None
    blocks = lambda rows: F.least(F.lit(SPREAD), F.ceil(F.col(rows) / (8 * ROWS)))
    there = there.withColumn("is", F.greatest(blocks("rows"), F.ceil(F.col("all") / WIDE)).cast("int"))
    there = there.select("component", "is", F.greatest(F.least(blocks("z"), F.ceil(SPREAD * SPREAD / F.col("is"))), F.ceil(F.col("out") / WIDE)).cast("int").alias("js"))
    few = there.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    now = now.join(F.broadcast(there) if few else there, "component")
    i, j = F.pmod(F.xxhash64(F.lit(5), "id"), F.col("is")).cast("int"), F.pmod(F.xxhash64(F.lit(6), "id"), F.col("js")).cast("int")
    none = F.array().cast("array<struct<i:int,j:int,guest:boolean>>")
    return searched(units(docs, now, seats(F.array(i), every(F.col("js")), False), F.when(F.col("guest"), seats(every(F.col("is")), F.array(j), True)).otherwise(none)), k, num, den, True)


def link(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(key, n_shingles, component_id), a row for each row of ``df``."""
    docs = df.select(col(key).cast("long").alias("id"), col(text).alias("t"))
    every_set = written(sets(docs, k), "sets")
    classes = every_set.where("n > 0 AND id IS NOT NULL").groupBy("f").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    classes = written(classes, "classes")
    # ids of copies give way to their class's
    copies = every_set.where("n > 0 AND id IS NOT NULL").select("id", "f").join(classes.select("f", F.col("id").alias("rep")), "f").where("id <> rep")
    copies = copies.join(classes.select("id"), "id", "left_anti").groupBy("id").agg(F.min("rep").alias("rep"))
    copies = written(copies, "copies")
    shingled = classes.agg(F.sum("n")).first()[0] or 0
    ranges = min(RANGES, max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shingled // RANGE))
    groups = written(candidates(docs, k, num, den, ranges), "groups")
    swept(docs.sparkSession)
    pairs = shared = written(compared(groups, every_set, num, den), "pairs")
    discard(groups)
    for end in ("a", "b"):
        pairs = pairs.join(copies.select(F.col("id").alias(end), F.col("rep").alias(f"{end}_of")), end, "left").withColumn(end, F.coalesce(f"{end}_of", end)).drop(f"{end}_of")
    nodes, large = clusters(classes, components(pairs))
    discard(shared, copies)
    # rows of one id are one node, though their texts differ
    twice = every_set.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min("f").alias("f"), F.max("f").alias("g")).where("f <> g").select("id")
    tied = every_set.join(twice, "id", "left_semi").join(classes.select("f", F.col("id").alias("rep")), "f").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    near = written(links(docs, nodes, k, num, den).union(tied), "links")
    swept(docs.sparkSession)
    found = components(near)
    if not large.isEmpty():
        more = apart(docs, nodes, large, found, k, num, den)
        found = components(near.union(more)) if more is not None else found
    known = classes.select("f", "id").join(found, F.col("id") == F.col("node"), "left").select(F.col("f").alias("g"), F.coalesce("component", "id").alias("c"))
    out = every_set.select("id", "n", "f").join(known, F.col("f") == F.col("g"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))


def deduplicate(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``df`` without those that a row before them in their component makes redundant.

    Where ids are unique and not null, the row of the smallest id of each component stays. Else every row is a node of its
    own, and of each component the first by (id, hash of the text) stays, null ids last; rows alike in both are the same
    to any result. Rows without a word stay.
    """
    again = df.groupBy(col(key).cast("long").alias("id")).agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").limit(1).count()
    rows, at = df, col(key).cast("long")
    if again:
        by = [col(key).cast("long").asc_nulls_last(), F.md5(F.encode(F.coalesce(col(text), F.lit("")), "UTF-8"))]
        rows, at = written(numbered(df, by, None, "__row"), "rows"), F.col("__row")
    found = link(rows.select(at.alias("__id"), col(text).alias("__t")), "__t", "__id", k, num, den)
    gone = written(found.where("__id <> component_id").select(F.col("__id").alias("__gone")), "gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, at == F.col("__gone"), "left_anti").select(*[col(c) for c in df.columns])
