"""Operators against brute-force versions."""

import itertools
import random
import re

import numpy as np
import pytest

from quern.llm import htmltext, langid, media, mtree, ngrams, pieces, pii, warc
from quern.llm.queries import PIECES, QUERIES

SF = "/root/testdata/sf0.001"


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(n)]


def near_copies(rng, n, words=80):
    vocabulary = [f"w{i}" for i in range(60)]
    shared = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.7:
            t = rng.choice(out).split()
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            out.append(" ".join(t))
        else:
            t = [rng.choice(vocabulary) for _ in range(rng.randint(1, words))]
            out.append(" ".join(t + shared if rng.random() < 0.5 else t))
    return out


@pytest.mark.parametrize("seed,num", [(0, 85), (1, 80), (2, 60)])
def test_search_and_keys(seed, num):
    rng = random.Random(seed)
    sets = ngrams.shingles(near_copies(rng, 150), 4)
    real = [set(x.tolist()) for x in sets]
    linked = lambda i, j: 100 * len(real[i] & real[j]) >= num * len(real[i] | real[j])
    assert ngrams.search(sets, num, 100).tolist() == components(len(sets), linked)
    of, parts = ngrams.intervals(num, 100)
    often = np.sort(np.unique(np.concatenate(sets)[:: 3]))  # whatever is set aside, linked sets share a key
    for aside in (np.zeros(0, np.uint64), often):
        keys = [set(ngrams.all_keys(x, aside, of, parts).tolist()) for x in sets]
        for i, j in itertools.combinations(range(len(sets)), 2):
            if linked(i, j):
                assert keys[i] & keys[j]


def test_link_matches_brute_force(spark):
    rng = random.Random(7)
    texts = near_copies(rng, 120)
    words = [t.lower().split() for t in texts]
    real = [set(zip(*[w[i:] for i in range(5)])) or {tuple(w)} for w in words]
    want = components(len(texts), lambda i, j: 100 * len(real[i] & real[j]) >= 80 * len(real[i] | real[j]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in ngrams.link(df).collect()}
    assert [got[i]["component_id"] for i in range(len(texts))] == want and [got[i]["n_shingles"] for i in range(len(texts))] == [len(x) for x in real]


def test_loser_tree_and_passes(spark, monkeypatch):
    rng = random.Random(3)
    runs = [sorted([(rng.choice("abc"), rng.randint(0, 3), rng.choice([None, 1, 2]), f"f{k}", i, 1, "", "") for i in range(rng.randint(0, 9))], key=warc.key_of) for k in range(7)]
    for k in range(8):
        assert list(warc.LoserTree([iter(r) for r in runs[:k]])) == warc.merge_sorted(runs[:k])
    monkeypatch.setattr(warc, "FAN", 2)
    monkeypatch.setattr(warc, "RANGE", 5)
    rows = [(i, f"http://h{i % 3}.org/{i % 7}", "x" * (1200 if i % 4 else 3)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    index, folder = warc.archive(pages)
    got = [(r["urlkey"], r["stamp"], r["page"]) for r in index.orderBy("range_no", "pos").collect()]
    assert got == sorted((warc.urlkey(u), i, i) for i, u, _ in rows)
    back = {r["page_id"]: r for r in warc.read_archives(index, folder).collect()}
    keeper = max(i for i in range(60) if i % 4)
    assert all(back[i]["record_type"] == ("revisit" if i % 4 and i != keeper else "response") for i in range(60)) and back[1]["refers_to"] == keeper


def test_mtree_matches_brute_force():
    rng = np.random.default_rng(0)
    x = np.floor(rng.standard_normal((3000, 6)) * 20)
    x[100:1400] = x[7]  # one very common vector
    ids = rng.permutation(3000)
    top = float((x * x).sum(1).max())
    pages = [dict(page=p, leaf=leaf, ids=i.astype(np.int64).tobytes(), x=v.tobytes(), up=u.tobytes(), radius=r.tobytes(), children=c.astype(np.int64).tobytes(), dim=6, top=top) for p, leaf, i, v, u, r, c in mtree.Builder(ids, x, top).pages]
    tree = mtree.Tree(pages)
    many = mtree.best_of_many(tree, ids[:60], x[:60], 20)
    for j in range(60):
        s = x @ x[j]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[j]][:20]
        want = [(int(s[i]), int(ids[i])) for i in order]
        assert tree.best(int(ids[j]), x[j], 20) == want == many[j]
    huge = np.array([[2.0**40, 1.0], [2.0**40, 2.0]])
    assert mtree.dots(huge, huge[0]).tolist() == [2**80 + 1, 2**80 + 2]


def viterbi(v, text):
    """Over the whole text, every pair of ends."""
    marked = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
    best = [(0.0, [])]
    for end in range(1, len(marked) + 1):
        options = []
        for start in range(max(0, end - 16), end):
            s = v.score.get(marked[start:end])
            if s is not None:
                options.append((best[start][0] + s, best[start][1] + [v.ids[marked[start:end]]]))
        if marked[end - 1] not in v.score:
            options.append((best[end - 1][0] + v.unknown, best[end - 1][1] + [v.bytes[b] for b in marked[end - 1].encode()]))
        top = max(o[0] for o in options)
        best.append(next(o for o in options if o[0] == top))
    return best[-1][1]


def test_viterbi_and_round_trip():
    v = pieces.load(PIECES)
    rng = random.Random(5)
    texts = ["", " ", "  two  spaces ", "a\nb\t c\r\n", "▁literal ▁", "日本語 😀", "the them then theme", "x" * 100] + ["".join(rng.choice("thea nd\n.é日") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    coded = [np.frombuffer(b, np.int32).tolist() for b in v.encode(texts)]
    assert [v.decode(c) for c in coded] == texts
    for t, c in zip(texts, coded):
        if pieces.MARK not in t:
            assert c == viterbi(v, t)
    assert coded == [np.frombuffer(v.encode([t])[0], np.int32).tolist() for t in texts]
    assert v.decode([-1, 10**6, None]) == ""


def test_matches_library_lattice():
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    import sentencepiece

    m = proto.ModelProto()
    with open(PIECES, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1  # the same pieces and scores, searched as a unigram lattice
    sp = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    v = pieces.load(PIECES)
    for text in ("the", "and then", "theme park", "Reading", "in on at"):
        assert np.frombuffer(v.encode([text])[0], np.int32).tolist() == sp.nbest_encode_as_ids(text, 3)[0]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_pii_base_matches_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        t = "".join(rng.choice("a.@1+-23 b(9") for _ in range(rng.randint(0, 40)))
        found = [(k, a, b) for k, a, b in pii.detect(t)]
        assert [(a, b) for k, a, b in found if k == 0] == [m.span() for m in EMAIL.finditer(t)]
        assert [(a, b) for k, a, b in found if k == 1] == [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    assert len(list(pii.emails("a" * 200_000))) == 0 and len(list(pii.emails("a" * 200_000 + "@b.c"))) == 1


@pytest.mark.parametrize(
    "text,found",
    [
        ("write to john dot smith at example dot com now", ["john dot smith at example dot com"]), ("jane (at) mail.example.org or bob[at]x[dot]io", ["jane (at) mail.example.org", "bob[at]x[dot]io"]), ("joe@exаmple.com", ["joe@exаmple.com"]),
        ("plus four four seven seven zero zero nine zero zero one two three", ["plus four four seven seven zero zero nine zero zero one two three"]), ("one nine two dot one six eight dot one dot two", ["one nine two dot one six eight dot one dot two"]), ("jo​hn@exam​ple.com", ["jo​hn@exam​ple.com"]),
        ("look at example.com today", []), ("see you at noon. dot com", []), ("one two three four", []), ("Привет мир", []), ("4111 1111 1111 1112", []),
    ],
)
def test_pii_disguises(text, found):
    assert [text[s["start"] : s["end"]] for s in pii.spans(text) if not s["base"]] == found


def test_media_round_trip_and_batches():
    rng = np.random.default_rng(0)
    payloads = [media.padded(bytes(rng.integers(0, 256, n, dtype=np.uint8))) for n in (0, 1, 191, 192, 193, 5000, 70000)]
    images = media.write(payloads)
    for p, m, (im, c, x) in zip(payloads, images, media.read(images)):
        assert media.payload(im, c) == p
        ((one, d, y),) = media.read([m])
        assert (x == y).all() and media.write([p]) == [m] and (media.tensor(one, y) == media.tensor(im, x)).all()


class BitWriter:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> i) & 1 for i in range(n - 1, -1, -1)]

    def done(self):
        self.bits += [1] * (-len(self.bits) % 8)
        return np.packbits(self.bits).tobytes().replace(b"\xff", b"\xff\x00")


def symbol(w, table, s):
    code, length = table
    w.put(int(code[s]), int(length[s]))


def ac_first(w, c, low, high, al):
    r = 0
    for k in range(low, high + 1):
        v = abs(int(c[k])) >> al
        if not v:
            r += 1
            continue
        while r > 15:
            symbol(w, (media.AC_CODE, media.AC_LEN), 0xF0)
            r -= 16
        n = v.bit_length()
        symbol(w, (media.AC_CODE, media.AC_LEN), r << 4 | n)
        w.put(v if c[k] > 0 else (1 << n) - 1 - v, n)
        r = 0
    if r:
        symbol(w, (media.AC_CODE, media.AC_LEN), 0)


def ac_refine(w, c, low, high, al):
    last = max((k for k in range(low, high + 1) if abs(int(c[k])) >> al == 1), default=-1)
    r, held = 0, []
    for k in range(low, high + 1):
        v = abs(int(c[k])) >> al
        if not v:
            r += 1
            continue
        while r > 15 and k <= last:
            symbol(w, (media.AC_CODE, media.AC_LEN), 0xF0)
            [w.put(b, 1) for b in held]
            held, r = [], r - 16
        if v > 1:
            held.append(v & 1)
            continue
        symbol(w, (media.AC_CODE, media.AC_LEN), r << 4 | 1)
        w.put(int(c[k] > 0), 1)
        [w.put(b, 1) for b in held]
        held, r = [], 0
    if r or held:
        symbol(w, (media.AC_CODE, media.AC_LEN), 0)
        [w.put(b, 1) for b in held]


@pytest.mark.parametrize("gray", [False, True])
def test_decoder_on_a_plain_encoder(gray):
    """Sparse signed coefficients, spectral bands, two refinements, odd sizes: scans by a scalar encoder."""
    rng = np.random.default_rng(4)
    width, height = 37, 21
    frame = [(1, 0x11)] if gray else [(1, 0x22), (2, 0x11), (3, 0x11)]
    probe = media.Image(width, height, [(1, 1)] if gray else [(2, 2), (1, 1), (1, 1)], [np.ones(64, np.int64)] * len(frame), [], b"")
    coefs = []
    for k in range(len(frame)):
        c, r, oc, orr = probe.grid(k)
        a = np.where(rng.random((r, c, 64)) < 0.2, rng.integers(-40, 41, (r, c, 64)), 0)
        a[orr:, :, 1:] = 0
        a[:, oc:, 1:] = 0
        coefs.append(a)
    out = [b"\xff\xd8", media.DQT, b"\xff\xc2" + (8 + 3 * len(frame)).to_bytes(2, "big") + b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(frame)]) + b"".join(bytes([i, s, 0]) for i, s in frame), media.DC_DHT, media.AC_DHT]
    base = [int(sum(np.prod(a.shape[:2]) for a in coefs[:k])) for k in range(len(coefs))]
    flat = np.concatenate([a.reshape(-1, 64) for a in coefs])

    def scan(parts, low, high, past, al, every, code):
        order = media.scan_order(probe, media.Scan(parts, low, high, past, al, every, [], None, []))
        unit = 1 if len(parts) == 1 else 6
        total = len(order) // unit
        step = every or total
        intervals = []
        for at in range(0, total, step):
            w, last = BitWriter(), [0, 0, 0]
            for b in order[at * unit : min(total, at + step) * unit]:
                code(w, flat[b], last, max(k for k in range(len(base)) if base[k] <= b))
            intervals.append(w.done())
        out.append(media.sos([(p + 1, 0) for p in parts], low, high, past << 4 | al, every) + media.joined(intervals))

    def dc(w, c, last, comp, al=1):
        v = int(c[0]) >> al
        d, last[comp] = v - last[comp], v
        n = abs(d).bit_length()
        symbol(w, (media.DC_CODE, media.DC_LEN), n)
        w.put(d if d >= 0 else d + (1 << n) - 1, n)

    parts = list(range(len(frame)))
    scan(parts, 0, 0, 0, 1, 2, dc)
    for k in parts:
        scan([k], 1, 5, 0, 2, 3, lambda w, c, *_: ac_first(w, c, 1, 5, 2))
        scan([k], 6, 63, 0, 2, 0, lambda w, c, *_: ac_first(w, c, 6, 63, 2))
    for al in (1, 0):
        for k in parts:
            scan([k], 1, 63, al + 1, al, 4, lambda w, c, *_, al=al: ac_refine(w, c, 1, 63, al))
    scan(parts, 0, 0, 1, 0, 5, lambda w, c, *_: w.put(int(c[0]) & 1, 1))
    ((im, got, x),) = media.read([b"".join([*out, b"\xff\xd9"])])
    assert (got == flat).all()
    # the samples against a float inverse transform
    natural = np.zeros((len(flat), 64))
    natural[:, media.ZIGZAG] = flat
    u = np.arange(8)
    basis = np.where(u == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * u[None] + 1) * u[:, None] * np.pi / 16)
    want = np.clip(np.einsum("nuv,ux,vy->nxy", natural.reshape(-1, 8, 8), basis, basis) + 128, 0, 255).reshape(-1, 64)
    assert np.abs(want - x.astype(float)).max() <= 1.01 and media.tensor(im, x).shape == (height, width, 3)


def test_html_cases():
    trees = htmltext.fit([])
    page = '<html><head><title>T</title><style>x</style></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">B</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, and so on, you know.</p></div><article><h1>A title &amp; more</h1><p>First   para<br>graph, with <b>bold</b> words. It goes on for a while.<p>Second one &eacute;, unclosed. It says something too.<div class="ad">Buy this now.</div><p>Third paragraph, the last one. It ends here.</article><section class="comments"><h3>Comments</h3><p>I disagree with all of this, really. It is long enough.</p></section><form><label>Name</label><input></form><footer>&copy; Us</footer>'
    assert htmltext.texts(trees, [page]) == ["A title & more\nFirst para graph, with bold words. It goes on for a while.\nSecond one é, unclosed. It says something too.\nThird paragraph, the last one. It ends here."]
    assert htmltext.texts(trees, ["", "<", "<p", "<!-- x", "<div>" * 3000]) == ["", "<", "", "", ""]
    rng = random.Random(12)
    words = ["The cat sat on the mat.", "It rained a lot yesterday in town.", "Prices, they said, rose again.", "We saw it."]
    good = 0
    for _ in range(150):
        source, said = htmltext.generated(rng, words)
        p = htmltext.parse(source)
        y = htmltext.truth(p, said)
        good += htmltext.texts(trees, [source])[0] == "\n".join(p.runs[i] for i in p.runs if y[i])
    assert good >= 140


def test_langid_splits_long_texts(monkeypatch):
    texts = ["über den wolken muss die freiheit " * 20, "", "a", "123 ñandú"]
    whole = [langid.counted(t) for t in texts]
    monkeypatch.setattr(langid, "SPAN", 37)
    for (a, n), t in zip(whole, texts):
        b, m = langid.counted(t)
        assert (a == b).all() and (n == m).all()


def test_langid_held_out_accuracy(spark):
    got = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").where("held_out")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(lang, "doc_id").selectExpr("avg(int(lang = lang_pred)) AS right", "avg(int(rejected)) AS gone").first()
    assert rows["right"] >= 0.97 and rows["gone"] <= 0.02


@pytest.mark.parametrize("name", ["op2_warc", "op3_mix", "op4_ngram_join", "op5_top_k", "op7_shards"])
def test_sql(spark, name):
    import duckdb

    from quern.llm.queries import SQL

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    found = c.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=str) == sorted(found.fetchall(), key=str)


def test_shards_by_brute_force(spark):
    rows = QUERIES["op7_shards"](spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    per: dict[int, list] = {}
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(d["text"].encode()) + 16 and r["grown_shard"] is None
        per.setdefault(r["shard"], []).append((r["slot"], d["source"]))
    sizes = [len(x) for x in per.values()]
    assert len(rows) == len(docs) and len(per) == 40 and max(sizes) - min(sizes) <= 1
    for x in per.values():
        assert sorted(s for s, _ in x) == list(range(len(x)))
    # every prefix of shards holds each source in proportion, to a row of each end
    for source in {d["source"] for d in docs.values()}:
        total, so_far, seen = sum(d["source"] == source for d in docs.values()), 0, 0
        for k in range(40):
            so_far += sum(s == source for _, s in per[k])
            seen += len(per[k])
            assert abs(so_far - total * seen / len(rows)) <= 1.5
