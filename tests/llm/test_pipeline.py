"""The pipeline's stages, each against a brute-force version of its decisions on what it was given."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quern.llm import langid, pieces, pii
from quern.llm.queries import PIECES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = spark.createDataFrame([(100001, "write to jane (at) mail.example.org about the matter of the day", "en", "src0", 10), (100002, None, "en", "src1", 0), (100003, "12 34", None, None, 5), (100004, "", None, "src1", 0)], docs.schema)
    docs.unionByName(more).withColumn("score", F.lit(1)).write.parquet(f"{path}/documents.parquet")
    return path


def copies(rows):
    """How often each document comes, by targets and draws of one's own."""
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    order = sorted({r["source"] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(sizes[r["doc_id"]] for r in rows if r["source"] == s) for s in order}
    weight, full = {s: k % 3 + 1 for k, s in enumerate(order)}, set()
    while True:
        rest, left = sum(total.values()) - 3 * sum(total[s] for s in full), sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and 3 * total[s] * left < weight[s] * rest}
        if not more:
            break
        full |= more
    out = {}
    for r in rows:
        s = r["source"]
        rate = (3.0 * total[s] if s in full else weight[s] * rest / left) / total[s] if total[s] else 0.0
        seed = f"20:{r['doc_id']}:{hashlib.md5((r['text'] or '').encode()).hexdigest()}:1"
        u = int(hashlib.md5(seed.encode()).hexdigest()[:13], 16) / 2**52
        out[r["doc_id"]] = int(rate) + (u < rate - int(rate))
    return out


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, seen[-1], folder)
        out.write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(d.columns == docs.columns for d in seen[:5])
    rows = [d.collect() for d in seen]
    # 1: the model's own rejections go, and hardly any text with letters
    model = langid.train(docs)
    _, _, gone = model.predict([r["text"] for r in rows[0]])
    assert {r["doc_id"] for r in rows[1]} == {r["doc_id"] for r, g in zip(rows[0], gone) if not g} and len(rows[1]) >= len(rows[0]) - 6
    assert not {100002, 100003, 100004} & {r["doc_id"] for r in rows[1]}
    # 2: all pairs
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t))
        return set(zip(*[w[i:] for i in range(5)])) or ({tuple(w)} if w else set())

    sets = sorted((r["doc_id"], shingles(r["text"])) for r in rows[1])
    root = {i: i for i, _ in sets}
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root[i], root[j]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert {r["doc_id"] for r in rows[2]} == {i for i in root if root[i] == i}
    # 3: every text redacted, no row lost
    before = {r["doc_id"]: r["text"] for r in rows[2]}
    assert {r["doc_id"]: r["text"] for r in rows[3]} == {i: pii.redacted(t, pii.spans(t)) for i, t in before.items()}
    assert "[EMAIL]" in {r["doc_id"]: r["text"] for r in rows[3]}[100001] and all(r["n_chars"] == len(r["text"]) for r in rows[3])
    # 4: copies of whole documents, at most three of each
    given = {r["doc_id"]: r for r in rows[3]}
    count = {}
    for r in rows[4]:
        assert r == given[r["doc_id"]]
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert max(count.values()) <= 3 and {i: n for i, n in copies(rows[3]).items() if n} == count
    # 5: the ids decode to the text
    v = pieces.load(PIECES)
    assert len(rows[5]) == len(rows[4]) and all(r["round_trip"] for r in rows[5])
    assert all(v.decode(r["ids"]) == given[r["doc_id"]]["text"] for r in rows[5][:50])


def test_run_and_empty(spark, folder, tmp_path):
    assert pipeline.run(spark, folder).count() > 100
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
