"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is the mean of the embeddings of its letter n-grams (2 to 4 code points of the lower-cased text, a word's
edges counting as one code point), each hashed to a bucket. Embeddings and the softmax are trained together by
stochastic gradient descent in numpy on a bounded, hash-chosen sample of labelled rows. As the model is linear,
it is folded into one row of logits for each bucket, so prediction is a gather and a sum over the whole text.

Rejection is calibrated on rows kept out of the training: a temperature is fitted to their likelihood, and the
least accepted score is their ``alpha`` quantile, so of texts like those labelled at most about ``alpha`` are
rejected. Buckets never trained have zero logits: a score of 1/K or less is rejected (if K is over 1), and so is a text
most of whose n-grams fall in buckets never trained, beyond the share that unlike n-grams hit by chance.

Defined results: null text, or text with no letter: ``und``, score 0, rejected. Equal texts get equal results.
Repeated rows and null ids pass through. No labelled row at all: every text is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, col, written

#: 2 to the power of BITS buckets.
BITS = 17
ORDERS = (2, 3, 4)
WIDTH = 16
#: Code points that one pass of the feature kernel handles.
SPAN = 300_000
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def buckets(x: np.ndarray):
    """(bucket, last position) of every n-gram in code points, where 0 stands for all that is no letter."""
    x = x.astype(np.uint32)
    for n in ORDERS:
        if len(x) < n:
            continue
        m = len(x) - n + 1
        h, ok = x[:m] * np.uint32(0x01000193), np.ones(m, bool)
        for k in range(1, n):
            part = x[k : k + m]
            h = (h ^ part) * np.uint32(0x01000193) + np.uint32(n)
            ok &= part != 0 if k < n - 1 else True
        if n == 2:
            ok &= (x[:m] | x[1 : m + 1]) != 0
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        at = np.flatnonzero(ok)
        yield (h[at] >> np.uint32(32 - BITS)).astype(np.int64), at + (n - 1)


def pieces(texts: list[str]):
    """Parts of (code points, document of each stretch): whole texts, several in a part, long ones over many parts.

    Parts of one text overlap by the longest n-gram less one, and the caller is told how many leading positions
    were seen before.
    """
    table, over = letters(), max(ORDERS) - 1
    parts: list[tuple[int, np.ndarray]] = []
    held = 0
    for i, text in enumerate(texts):
        x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.concatenate([[0], np.where(table[x], x, 0), [0]]).astype(np.uint32)
        if held + len(x) > SPAN and parts:
            yield parts, 0
            parts, held = [], 0
        if len(x) > SPAN:
            for at in range(0, len(x), SPAN):
                yield [(i, x[max(0, at - over) : at + SPAN])], min(at, over)
            continue
        parts.append((i, x))
        held += len(x)
    if parts:
        yield parts, 0


def features(texts: list[str]):
    """(document, bucket) arrays of every n-gram of the texts, part by part."""
    for parts, seen in pieces(texts):
        x = np.concatenate([p for _, p in parts])
        starts = np.cumsum([0] + [len(p) for _, p in parts])
        ids = np.array([i for i, _ in parts])
        for b, last in buckets(x):
            if seen:
                fresh = last >= seen
                b, last = b[fresh], last[fresh]
            # an n-gram across two texts would start with the closing 0 of one: both edges are 0, so none but (0, 0, ...) spans them
            yield ids, starts, b, last


@dataclass
class Model:
    labels: list[str]
    logits: np.ndarray
    temperature: float
    threshold: float
    seen: np.ndarray
    least_seen: float

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, n-grams and n-grams in trained buckets of each text."""
        total, count, seen = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts)), np.zeros(len(texts))
        for ids, starts, b, last in features(texts):
            if not len(b):
                continue
            cut = np.searchsorted(last, starts)
            full = np.flatnonzero(np.diff(cut))
            total[ids[full]] += np.add.reduceat(self.logits[b], cut[full], axis=0, dtype=np.float64)
            seen[ids[full]] += np.add.reduceat(self.seen[b], cut[full], dtype=np.int64)
            count[ids[full]] += np.diff(cut)[full]
        return total, count, seen

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Labels, scores, whether rejected."""
        if not self.labels:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        total, count, seen = self.sums([t or "" for t in texts])
        z = total / np.maximum(count, 1)[:, None] / self.temperature
        p = np.exp(z - z.max(1, keepdims=True, initial=-np.inf))
        p /= p.sum(1, keepdims=True)
        best, known = p.argmax(1), count > 0
        score = np.where(known, p[np.arange(len(best)), best], 0.0)
        return [self.labels[k] if ok else "und" for k, ok in zip(best, known)], score, ~known | self.rejects(score, seen / np.maximum(count, 1))

    def rejects(self, score: np.ndarray, share: np.ndarray) -> np.ndarray:
        k = len(self.labels)
        return (score < self.threshold) | (share < self.least_seen) | (score <= (1 + 1e-9) / k if k > 1 else False)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    found = [b for _, _, b, _ in features([text])]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], calibration: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 3, rate: float = 0.5, alpha: float = 0.001, seed: int = 11) -> Model:
    """Stochastic gradient descent, one text a step, the rate falling to nothing; then temperature and threshold."""
    labels = sorted({r[0] for r in rows})
    k, rng = len(labels), np.random.default_rng(seed)
    if not k:
        return Model([], np.zeros((1 << BITS, 0), np.float32), 1.0, 1.0, np.zeros(1 << BITS, bool), 1.0)
    at = {x: i for i, x in enumerate(labels)}
    e = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    w, seen, step, steps = np.zeros((WIDTH, k), np.float32), np.zeros(1 << BITS, bool), 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, b, n = rows[i]
            step += 1
            if not len(b):
                continue
            lr, share = rate * (1 - (step - 1) / steps), (n / n.sum()).astype(np.float32)
            h = share @ e[b]
            z = h @ w
            g = np.exp(z - z.max())
            g /= g.sum()
            g[at[label]] -= 1
            back = w @ g
            w -= lr * np.outer(h, g)
            # the mean spreads a text's step over its n-grams; scaling by their number keeps the step of each alike
            e[b] -= np.float32(lr * min(len(b), 32)) * np.outer(share, back)
            seen[b] = True
    logits = np.where(seen[:, None], e @ w, 0).astype(np.float32)
    like = [(at[x], b, n / n.sum()) for x, b, n in calibration if x in at and len(b)]
    held = [(x, n @ logits[b]) for x, b, n in like]
    by_chance = (1 + float(seen.mean())) / 2
    if not held:
        return Model(labels, logits, 1.0, 0.0, seen, by_chance)
    shares = np.sort([float(n @ seen[b]) for _, b, n in like])
    least_seen = min(by_chance, float(shares[int(alpha * len(shares))]) - 1e-9)
    y, z = np.array([x for x, _ in held]), np.array([v for _, v in held])

    slack = 1 / (len(y) + 2)  # smoothed targets, as in Platt scaling: a faultless sample doesn't ask for certainty

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        own = (1 - slack) * s[np.arange(len(y)), y] + slack * s.mean(1)
        return float(np.mean(np.log(np.exp(s).sum(1)) - own))

    temperature = float(min(np.geomspace(0.02, 20, 121), key=loss))
    s = np.exp((z - z.max(1, keepdims=True)) / temperature)
    top = np.sort((s / s.sum(1, keepdims=True)).max(1))
    return Model(labels, logits, temperature, float(top[int(alpha * len(top))]), seen, least_seen)


def train(df: DataFrame, text: str = "text", label: str = "lang", order: str = "doc_id", per_label: int = 800, labels: int = 1000, seed: int = 11) -> Model:
    """Fit on about ``per_label`` hash-chosen rows of each label; whole texts; one in five calibrates.

    Of labels, the ``labels`` most frequent are learnt (ties by code point). Of a label's rows, those are chosen whose
    hash of ``order`` and text lies under a bound set from the label's count; rows alike in both count once, and at
    most 2 * ``per_label`` of a label, those of the least hash, are kept, all before anything is sent to the
    driver. It gets at most 2**BITS pairs for each. Nothing else is sorted or shuffled but counts.
    """
    rows = df.where(col(label).isNotNull() & col(text).isNotNull()).select(col(text).alias("t"), col(label).cast("string").alias("y"), F.pmod(F.xxhash64(F.lit(seed), col(order).cast("string"), col(text)), F.lit(1 << 30)).alias("h"))
    sizes = rows.groupBy("y").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.encode("y", "UTF-8")).limit(labels)
    bounds = written(sizes.select("y", (F.lit(float(1 << 30)) * F.least(F.lit(1.0), per_label / F.col("n"))).alias("bound")), "labels")
    chosen = rows.join(F.broadcast(bounds), "y").where("h < bound").groupBy("y", "h").agg(F.min("t").alias("t"))
    chosen = chosen.withColumn("k", F.row_number().over(Window.partitionBy("y").orderBy("h"))).where(F.col("k") <= 2 * per_label)

    def factory():
        def work(texts):
            found = [counted(t) for t in texts.to_pylist()]
            return [pa.array([b.astype(np.int32).tobytes() for b, _ in found], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary())]

        return work

    got = sorted((r["y"], r["h"], bytes(r["b"]), bytes(r["n"])) for r in arrow_map(chosen, ["t"], "b binary, n binary", factory, keep=["y", "h"]).toLocalIterator())
    kept = [(h, (y, np.frombuffer(b, np.int32).astype(np.int64), np.frombuffer(n, np.int32).astype(np.int64))) for y, h, b, n in got]
    apart = [r for h, r in kept if h % 5 == 0]
    return fit([r for h, r in kept if h % 5] or apart, apart, seed=seed)


def identify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` with ``lang_pred string, score double, rejected boolean``; one pass, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2**BITS rows of one float for each label

    def factory():
        m = shared.value

        def work(texts):
            y, s, out = m.predict(texts.to_pylist())
            return [pa.array(y, pa.string()), pa.array(s, pa.float64()), pa.array(out, pa.bool_())]

        return work

    return arrow_map(df, [text], "lang_pred string, score double, rejected boolean", factory, keep)
