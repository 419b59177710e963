"""Every operator on nulls, empty and long texts, repeated rows, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

from quern.llm import htmltext, langid, media, mixing, mtree, ngrams, pieces, pii, sharding, warc
from quern.llm.queries import PIECES

LONG = "lang und breit " * 30_000
ROWS = [
    (1, "the quick brown fox jumps over the dog", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, "  \n\t ", "de", None), (5, LONG, "de", "a"), (6, LONG, "de", "b"), (1, "the quick brown fox jumps over the dog", "en", "a"),
    (None, "mail me at x.y@z.org", None, "c"), (7, "1234 5678", "en", "a"), (8, "日本語のテキスト ▁ ￿ 😀", None, "c"), (9, "der schnelle braune fuchs springt über den hund", "de", "b"),
]
CLASH = ["score", "rejected", "lang_pred", "size", "rank", "shard", "slot", "ids", "n_tokens", "spans", "id", "t", "n", "f", "u", "v", "s", "a", "b", "node", "component", "copies", "target", "media", "n_bytes", "payload", "page", "stamp", "q", "dim", "block"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(-1) for c in CLASH})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_langid(spark, docs, nothing):
    model = langid.train(docs)
    out = langid.identify(docs, model)
    assert out.count() == len(ROWS) and set(docs.columns) <= set(out.columns)
    got = {r["doc_id"]: r for r in out.collect()}
    for i in (2, 3, 4, 7):
        assert got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0
    assert got[5]["lang_pred"] == got[6]["lang_pred"] == "de" and got[5]["score"] == got[6]["score"] and 0 <= got[8]["score"] <= 1
    empty = langid.train(nothing)
    assert langid.identify(nothing, empty).count() == 0 and {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}


def test_warc(spark, docs, nothing):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("source")).alias("url"), F.col("text").alias("html"), *CLASH)
    index, folder = warc.archive(pages)
    got = warc.read_archives(index, folder).collect()
    assert len(got) == len(ROWS) == index.count()
    by = {r["page_id"]: r for r in got}
    assert by[6]["record_type"] == "response" and by[5]["record_type"] == "revisit" and by[5]["refers_to"] == 6 and by[5]["payload_bytes"] == len(LONG) and by[6]["payload"] == LONG.encode()
    assert by[2]["payload_bytes"] == by[3]["payload_bytes"] == 0
    index, folder = warc.archive(pages.limit(0))
    assert warc.read_archives(index, folder).count() == 0


def test_mixing(spark, docs, nothing):
    rows = mixing.taken(mixing.sized(docs, keep=["doc_id"])).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(nothing).count() == 0 and mixing.taken(mixing.sized(nothing)).count() == 0
    none = docs.withColumn("text", F.lit(None).cast("string"))
    assert {r["taken"] for r in mixing.taken(mixing.sized(none)).collect()} == {0} and mixing.mix(none).count() == 0


def test_ngrams(spark, docs, nothing):
    got = ngrams.link(docs).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["component_id"] == by[6]["component_id"] == 5 and by[2]["n_shingles"] == by[3]["n_shingles"] == by[4]["n_shingles"] == 0 and by[4]["component_id"] == 4 and by[None]["component_id"] is None
    kept = ngrams.deduplicate(docs)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "None", "7", "8", "9"]) and kept.columns == docs.columns
    assert ngrams.link(nothing).count() == 0 and ngrams.deduplicate(nothing).count() == 0


def test_pieces(spark, docs, nothing):
    v = pieces.load(PIECES)
    out = pieces.decode(pieces.encode(docs, v), v)
    assert all(r["decoded"] == r["text"] for r in out.collect()) and out.count() == len(ROWS)
    assert pieces.decode(pieces.encode(nothing, v), v).count() == 0


def test_sharding(spark, docs, nothing):
    got = sharding.assign(docs, 4, order=["doc_id", "text"]).collect()
    per = {}
    for r in got:
        per.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(ROWS) and max(map(len, per.values())) - min(map(len, per.values())) <= 1 and all(sorted(x) == list(range(len(x))) for x in per.values())
    assert sharding.assign(nothing, 4).count() == 0
    few = sharding.assign(docs.limit(2), 40).collect()
    assert len(few) == 2 and {r["slot"] for r in few} == {0}


def test_media(spark, docs, nothing):
    out = media.facts(media.store(docs)).collect()
    assert len(out) == len(ROWS) and len({r["payload_sha256"] for r in out if r["doc_id"] in (2, 3)}) == 1
    by = {r["doc_id"]: r for r in out}
    assert by[5]["feature"] == by[6]["feature"] and by[2]["payload_bytes"] == 192 and by[5]["payload_bytes"] % 192 == 0
    assert media.facts(media.store(nothing)).count() == 0
    t = media.tensors(media.store(docs.limit(1))).first()
    assert len(t["rgb"]) == t["height"] * t["width"] * 3


def test_htmltext(spark, docs, nothing):
    pages = docs.withColumn("html", F.col("text")).withColumn("page_id", F.col("doc_id"))
    out = htmltext.extract(pages, htmltext.train(pages))
    assert out.count() == len(ROWS) and all(r["text"] is not None for r in out.collect())
    assert htmltext.extract(pages.limit(0), htmltext.train(pages.limit(0))).count() == 0


def test_pii(spark, docs, nothing):
    out = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    assert out[2] == out[3] == out[4] == [] and [(x["kind"], x["start"], x["end"]) for x in out[None]] == [("email", 11, 20)]
    red = pii.redact(docs)
    assert red.columns == docs.columns and red.count() == len(ROWS) and red.where("doc_id IS NULL").first()["text"] == "mail me at [EMAIL]"
    assert pii.find(nothing).count() == 0


def test_mtree(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], -1), (1, None, -1), (2, [nan, 1.0], -1), (3, [None, 1.0], -1), (4, [inf, 0.0], -1), (5, [1.0, 1.0], -1), (6, [1.0, 1.0], -1), (6, [1.0, 1.0], -1), (20, [1.0], -1), (None, [1.0, 1.0], -1), (40, [0.5, -1.0], -1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = sorted(map(tuple, mtree.top_k(df).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == [(0, 1, 5, 12288), (0, 2, 6, 12288), (0, 3, 6, 12288), (0, 4, 40, -6144), (40, 1, 5, -2048), (40, 2, 6, -2048), (40, 3, 6, -2048), (40, 4, 0, -6144)]
    assert mtree.top_k(df.limit(0)).count() == 0
