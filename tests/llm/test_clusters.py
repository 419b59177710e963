"""Large clusters: blocks, leaders and texts that stand apart; the registered query by brute force; ids that repeat."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quern.llm import ngrams
from quern.llm.queries import QUERIES

from .test_brute import components, near_copies

SF = "/root/testdata/sf0.001"


def shingled(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def expected(texts, k, num):
    real = [shingled(t, k) for t in texts]
    return real, components(len(texts), lambda i, j: bool(real[i] and real[j]) and 100 * len(real[i] & real[j]) >= num * len(real[i] | real[j]))


@pytest.mark.parametrize("seed,num", [(3, 85), (4, 70)])
def test_only_guests_are_linked_to(seed, num):
    rng = random.Random(seed)
    sets = ngrams.shingles(near_copies(rng, 120), 4)
    real = [set(x.tolist()) for x in sets]
    guest = [rng.random() < 0.2 for _ in sets]
    known = [rng.choice([0, 1, *range(2, 60)]) for _ in sets]
    linked = lambda i, j: known[i] == known[j] or guest[i] != guest[j] and 100 * len(real[i] & real[j]) >= num * len(real[i] | real[j])
    assert ngrams.search(sets, num, 100, guest, known).tolist() == components(len(sets), linked)


def chains(rng, n):
    """A cluster in which each text is near the one before, but far from those long before, with some apart."""
    words = [f"w{i}" for i in range(400)]
    t = [rng.choice(words) for _ in range(90)]
    out = []
    for i in range(n):
        t = t[:]
        t[rng.randrange(90)] = rng.choice(words)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("seed,leaders,wide", [(1, 4, 10**6), (2, 1, 10**6), (3, 1, 400)])
def test_large_clusters_by_brute_force(spark, monkeypatch, seed, leaders, wide):
    monkeypatch.setattr(ngrams, "ROWS", 8)
    monkeypatch.setattr(ngrams, "LEADERS", leaders)
    monkeypatch.setattr(ngrams, "WIDE", wide)
    rng = random.Random(seed)
    texts = chains(rng, 90) + near_copies(rng, 60)
    rng.shuffle(texts)
    real, want = expected(texts, 5, 80)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngrams.link(df).collect()}
    assert [got[i] for i in range(len(texts))] == [(len(x), c) for x, c in zip(real, want)]


def test_texts_of_a_large_cluster_are_read_a_bounded_number_of_times(spark, monkeypatch):
    """Twenty units of near copies and some texts apart: a text is searched once, its leaders and guests apart."""
    monkeypatch.setattr(ngrams, "ROWS", 16)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(320):
        t = base[:]
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(t))
    texts += [" ".join(base[:70] + [f"y{i}-{j}" for j in range(40)]) for i in range(6)]  # near none, though it may share keys
    seen = []
    monkeypatch.setattr(ngrams, "searched", lambda units, *a, real=ngrams.searched: (seen.append(units.count()), real(units, *a))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["component_id"] for r in ngrams.link(df, k=4, num=85).orderBy("doc_id").collect()]
    assert got == expected(texts, 4, 85)[1]
    blocks = 2 * 326 // 16 + 1
    assert seen[0] <= 326 + ngrams.LEADERS * blocks and sum(seen) <= 3 * 326 + ngrams.LEADERS * blocks


def test_registered_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    ids = [r["doc_id"] for r in docs]
    real, want = expected([r["text"] for r in docs], 4, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op4_ngram_join"](spark, SF).collect()}
    assert got == {i: (len(x), ids[c]) for i, x, c in zip(ids, real, want)}


def test_rows_of_one_id_keep_their_texts(spark):
    a, b, c = "one two three four five six seven", "a b c d e f g h i j k", "p q r s t u v w x y z"
    rows = [(1, a, "x"), (1, b, "y"), (1, b, "z"), (None, c, "u"), (None, c, "v"), (2, a, "w"), (3, None, "n"), (3, None, "m"), (None, None, "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    kept = [(r["doc_id"], r["text"]) for r in ngrams.deduplicate(df).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (None, c), (3, None), (3, None), (None, None)], key=str)
    assert sorted(map(str, kept)) == sorted(str((r["doc_id"], r["text"])) for r in ngrams.deduplicate(df.repartition(3)).collect())


def test_merge_counts_lists_at_any_size():
    rng = random.Random(2)
    lists = [sorted(rng.sample(range(300), rng.randint(0, 200))) for _ in range(40)]
    import numpy as np

    found, have = ngrams.merge([np.array(x, np.int64) for x in lists])
    want = {r: sum(r in x for x in lists) for r in set(itertools.chain(*lists))}
    assert dict(zip(found.tolist(), have.tolist())) == want and found.tolist() == sorted(want)
