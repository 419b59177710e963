"""WARC archives: writing with revisit records, an external index merge, reading by the merged index.

1. Payload digests seen more than once get a keeper (the largest id); pages join their keeper by digest, over a
   counted broadcast or, for many digests, salted, so that a hot payload is no hot task.
2. Each task streams its pages into archives (one gzip member for each record) in the shared folder, and writes the
   index of what it wrote as runs sorted by (URL key, timestamp, page): at most ``RUN`` captures a run.
3. Runs are merged externally by loser trees, at most ``FAN`` at a time: the key space of a group of runs is cut at
   sampled keys, and a task merges one range, streaming each run from the row group where the range begins. A pass
   whose result is more than ``FAN`` runs is followed by another. Keys are unique but for repeated rows, so a hot
   URL or host spreads over ranges like any other.
4. Records are read back by file and offset, in the order of each file, and checked against their digests.

Names of files are new for each attempt at a task, and only those that a successful attempt reports are read, so
lost executors and speculative copies do no harm. Files are reached by ``pyarrow.fs`` under ``spark.checkpoint.dir``.

Defined results: null html is an empty payload, null url the key ``-``; of repeated rows with the keeper's id each is a
response; a null id never keeps (with a keeper of its payload it is a revisit, without one a response), and sorts first. Empty tables give no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, join_small, new_path, slices, written

RUN = 100_000
FAN = 64
#: Captures that one merge task aims at.
RANGE = 200_000
#: Keys sampled from each run.
SAMPLES = 16
#: Bytes after which a new archive begins.
ARCHIVE = 256 << 20
#: Payloads from this size on may be revisits.
LEAST = 1000
SOFTWARE = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = pa.schema([("urlkey", pa.string()), ("stamp", pa.int64()), ("page", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("kind", pa.string())])


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def urlkey(url: str | None) -> str:
    """Host reversed, then path and sorted query, all in lower case: captures of one site sort together."""
    if not url:
        return "-"
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    query = "&".join(sorted(u.query.split("&"))) if u.query else ""
    return (",".join(reversed(host.split("."))) + port + ")" + (u.path or "/") + ("?" + query if query else "")).lower()


def stamp_text(stamp: int) -> str:
    import datetime as dt

    return (dt.datetime(2000, 1, 1) + dt.timedelta(seconds=stamp % (10**10))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(url: str | None, page: int | None, stamp: int, payload: bytes, sha1: str, refers: int | None, revisit: bool) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = quote(url or "urn:x-none", safe=":/?#[]@!$&'()*+,;=%~-._")
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{'' if page is None else page}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {stamp_text(stamp)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{refers}>", f"WARC-Profile: {PROFILE}"]
    return SOFTWARE + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, the full payload's length and the payload stored (empty for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] + b"\r\n" != SOFTWARE:
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.decode().partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
    return fields, n, payload


def judged(pages: DataFrame, page: str, url: str, html: str, stamp: str | None) -> DataFrame:
    """(page, url, stamp, payload, sha1, refers, revisit)."""
    raw = F.encode(F.coalesce(col(html), F.lit("")), "UTF-8")
    when = col(stamp).cast("long") if stamp else F.pmod(F.coalesce(col(page).cast("long"), F.lit(0)), F.lit(10**9))
    rows = pages.select(col(page).cast("long").alias("page"), col(url).cast("string").alias("url"), when.alias("stamp"), raw.alias("payload"), F.sha1(raw).alias("sha1"))
    seen = rows.where(F.octet_length("payload") >= LEAST).groupBy("sha1").agg(F.max("page").alias("keeper"), F.count("*").alias("n"))
    again = written(seen.where("n > 1 AND keeper IS NOT NULL").select("sha1", "keeper"), "keepers")
    rows = join_small(rows, again, "sha1")
    revisit = F.col("keeper").isNotNull() & ~F.col("page").eqNullSafe(F.col("keeper"))
    return rows.select("payload", "page", "url", "stamp", "sha1", F.when(revisit, F.col("keeper")).alias("refers"), revisit.alias("revisit"))


MANIFEST = "run string, file string, n long, samples array<struct<urlkey:string,stamp:long,page:long,file:string,start:long>>"


def key_of(row: tuple) -> tuple:
    return (row[0], row[1], -1 if row[2] is None else row[2], row[3], row[4])


def save_run(folder: str, rows, fs: pafs.FileSystem) -> tuple[str, int, list[dict]]:
    """Write sorted index rows; path, count and evenly spaced keys."""
    path = f"{folder}/run-{uuid.uuid4().hex}.parquet"
    n, every, picked, block = 0, 1, [], []
    with pq.ParquetWriter(path, INDEX, filesystem=fs) as out:

        def flush():
            out.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), INDEX)], schema=INDEX))
            block.clear()

        for row in rows:
            if n % every == 0:
                picked.append(row[:5])
                if len(picked) >= 2 * SAMPLES:
                    picked, every = picked[::2], every * 2
            n += 1
            block.append(row)
            if len(block) == 4096:
                flush()
        if block:
            flush()
    return path, n, [dict(zip(("urlkey", "stamp", "page", "file", "start"), p)) for p in picked]


def manifest(rows: list[tuple[str, str, int, list[dict]]]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("urlkey", pa.string()), ("stamp", pa.int64()), ("page", pa.int64()), ("file", pa.string()), ("start", pa.int64())]))
    kinds = [pa.string(), pa.string(), pa.int64(), kind]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["run", "file", "n", "samples"])


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the judged rows; a manifest of index runs. Lazy: write it once (``written``) before use."""

    def run(batches):
        fs, at = store_of(folder)
        fs.create_dir(at, recursive=True)
        out, path, start, held = None, "", 0, []
        for batch in batches:
            for part in slices(batch, 0, 4 << 20):
                for payload, page, url, stamp, sha1, refers, revisit in zip(*[part.column(k).to_pylist() for k in range(7)]):
                    if out is None or start > ARCHIVE:
                        if out:
                            out.close()
                        path, start = f"{at}/part-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(path, compression=None)  # by its name it would be compressed twice
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = z.compress(record(url, page, stamp, payload, sha1, refers, revisit)) + z.flush()
                    out.write(data)
                    held.append((urlkey(url), stamp, page, path, start, len(data), sha1, "revisit" if revisit else "response"))
                    start += len(data)
                    if len(held) == RUN:
                        saved, n, picked = save_run(at, sorted(held, key=key_of), fs)
                        held = []
                        yield manifest([(saved, saved, n, picked)])
        if out:
            out.close()
        if held:
            saved, n, picked = save_run(at, sorted(held, key=key_of), fs)
            yield manifest([(saved, saved, n, picked)])

    return rows.mapInArrow(run, MANIFEST)


class LoserTree:
    """Tournament of k sorted streams: each inner node remembers its match's loser, so a pop replays one path."""

    def __init__(self, streams: list):
        self.streams, self.k = streams, max(1, len(streams))
        self.rows = [next(s, None) for s in streams] or [None]
        self.keys = [None if r is None else key_of(r) for r in self.rows]
        self.tree = [-1] * self.k
        self.winner = self.play(1) if self.k > 1 else 0

    def play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self.play(2 * node), self.play(2 * node + 1)
        winner, loser = (a, b) if self.before(a, b) else (b, a)
        self.tree[node] = loser
        return winner

    def before(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None if x is None and y is None else x is not None and (y is None or (x, a) < (y, b))

    def __iter__(self):
        keys, rows, tree, streams = self.keys, self.rows, self.tree, self.streams
        while keys[w := self.winner] is not None:
            yield rows[w]
            row = next(streams[w], None)
            rows[w], keys[w] = row, None if row is None else key_of(row)
            node = (w + self.k) >> 1
            while node:
                if self.before(tree[node], w):
                    w, tree[node] = tree[node], w
                node >>= 1
            self.winner = w


def stream(files: list[str], fs: pafs.FileSystem, low: tuple | None, high: tuple | None):
    """Index rows of a run (its files follow one another) with low <= key < high; row groups before low aren't read."""
    for file in files:
        with fs.open_input_file(file) as f:
            source = pq.ParquetFile(f)
            for g in range(source.num_row_groups):
                stats = source.metadata.row_group(g).column(0).statistics
                if low and stats is not None and stats.has_min_max and stats.max < low[0]:
                    continue
                if high and stats is not None and stats.has_min_max and stats.min > high[0]:
                    return
                table = source.read_row_group(g)
                for row in zip(*[c.to_pylist() for c in table.columns]):
                    key = key_of(row)
                    if low and key < low:
                        continue
                    if high and key >= high:
                        return
                    yield row


def merge_index(runs: DataFrame, folder: str) -> DataFrame:
    """The captures of all runs in global order: (range_no, pos) and the index's columns.

    The driver holds one entry and SAMPLES keys for each run; the captures stay in files.
    """
    spark = runs.sparkSession
    found = runs.collect()
    level = [([r["file"]], r["n"], [key_of(tuple(s)) for s in r["samples"]]) for r in sorted(found, key=lambda r: r["run"])]
    while True:
        last = len(level) <= FAN
        jobs = []
        for g in range(0, max(1, len(level)), FAN):
            group = level[g : g + FAN]
            keys = sorted(k for _, _, s in group for k in s)
            parts = max(1, min(-(-sum(n for _, n, _ in group) // RANGE), len(keys) or 1))
            bounds = [None, *(keys[len(keys) * i // parts] for i in range(1, parts)), None]
            jobs += [(g // FAN, i, bounds[i], bounds[i + 1], [f for f, _, _ in group]) for i in range(parts)]
        kind = "struct<urlkey:string,stamp:long,page:long,file:string,start:long>"
        work = spark.createDataFrame(jobs, f"g int, i int, low {kind}, high {kind}, runs array<array<string>>").repartition(len(jobs), "g", "i")

        def ranges(batches):
            fs, _ = store_of(folder)
            for batch in batches:
                for job in batch.to_pylist():
                    low, high = (tuple(x.values()) if (x := job[k]) else None for k in ("low", "high"))
                    yield job["g"], job["i"], LoserTree([stream(files, fs, low, high) for files in job["runs"]]), fs

        if last:

            def emit(batches):
                names = ["range_no", "pos", *INDEX.names]
                for _, i, rows, _ in ranges(batches):
                    block, pos = [], 0

                    def made():
                        columns = list(zip(*block))
                        return pa.RecordBatch.from_arrays([pa.array([i] * len(block), pa.int32()), pa.array(range(pos, pos + len(block)), pa.int64()), *[pa.array(c, f.type) for c, f in zip(columns, INDEX)]], names=names)

                    for row in rows:
                        block.append(row)
                        if len(block) == 4096:
                            yield made()
                            pos += len(block)
                            block = []
                    if block:
                        yield made()

            return work.mapInArrow(emit, "range_no int, pos long, urlkey string, stamp long, page long, file string, start long, length long, digest string, kind string")

        def save(batches):
            _, at = store_of(folder)
            for g, i, rows, fs in ranges(batches):
                path, n, picked = save_run(at, rows, fs)
                yield manifest([(f"{g:09d}-{i:09d}", path, n, picked)])

        merged: dict[str, list] = {}
        for r in sorted(written(work.mapInArrow(save, MANIFEST), "runs").collect(), key=lambda r: r["run"]):
            merged.setdefault(r["run"][:9], []).append(r)
        level = [([r["file"] for r in rs if r["n"]], sum(r["n"] for r in rs), [key_of(tuple(s)) for r in rs for s in r["samples"]][:: max(1, len(rs))]) for rs in merged.values()]


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, place long, payload binary"


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that an index names, each read at its offset and checked, with their places; revisits have an empty payload.

    An archive's records are read in the order of the file; ``place`` keeps the captures' order.
    """
    rows = index.select("file", "start", "length", "digest", "place").repartition("file").sortWithinPartitions("file", "start")
    schema = READ if payloads else READ.rpartition(",")[0]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()][: None if payloads else 7]
    names = [x.split()[0] for x in schema.split(", ")]

    def number(urn: str | None) -> int | None:
        digits = urn[len("<urn:x-page:") : -1] if urn else ""
        return int(digits) if digits else None

    def run(batches):
        fs, _ = store_of(folder)
        path, f, out, size = None, None, [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            for file, start, length, digest, place in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                if file != path:
                    if f:
                        f.close()
                    f, path = fs.open_input_file(file), file
                f.seek(start)
                fields, n, payload = parsed(zlib.decompress(f.read(length), 31))
                sha1 = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                kind = fields["warc-type"]
                if sha1 != digest or kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != sha1):
                    raise ValueError(f"{file} is damaged at {start}")
                out.append((number(fields["warc-record-id"]), fields["warc-target-uri"], n, sha1, kind, number(fields.get("warc-refers-to")), place, payload))
                size += len(payload)
                if size > 4 << 20 or len(out) == 4096:
                    yield made()
                    out, size = [], 0
        if out:
            yield made()
        if f:
            f.close()

    return rows.mapInArrow(run, schema)


def archive(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", stamp: str | None = None) -> tuple[DataFrame, str]:
    """Write a table of pages; (globally ordered index, folder of the archives)."""
    folder = new_path(pages.sparkSession, "warc")
    runs = written(write_archives(judged(pages, page, url, html, stamp), folder), "runs")
    return placed(written(merge_index(runs, folder), "index")), folder


def placed(index: DataFrame) -> DataFrame:
    """The index with ``place``, from 0 in its global order: the place in the range, shifted by the ranges before."""
    counts = index.groupBy("range_no").agg(F.count("*").alias("n"))  # a row for each merge task
    before = counts.select("range_no", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range_no")) - F.col("n")).alias("before"))
    return index.join(F.broadcast(before), "range_no").withColumn("place", F.col("pos") + F.col("before")).drop("before")


def merge_sorted(runs: list[list[tuple]]) -> list[tuple]:
    """What the loser tree must give, by a heap (for tests)."""
    return list(heapq.merge(*runs, key=key_of))
