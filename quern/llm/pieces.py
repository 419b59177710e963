"""SentencePiece encoding and decoding by shared-prefix Viterbi search.

A text is marked as SentencePiece does (a space becomes the mark U+2581, one mark is put before), and cut into
marked words: a run of marks and what follows it. No piece of the vocabulary reaches over such a cut (checked when
the model is read; else whole texts are words), so the best segmentation of a text is that of its words. The
distinct words of a batch that were not met before are sorted, which makes them a trie: a prefix common to a word
and those before it has its forward score computed once. Short words take numpy, a level of that trie at a time: the
pieces that end at each prefix come from a trie of the reversed pieces in a hash table, and all prefixes of a length
get their scores from those of the shorter ones. Words longer than ``SHORT`` go depth-first, a character at a time.

The score of a segmentation is the sum of its pieces' scores in the model file; of equal scores the longer last
piece wins. A character that no piece covers costs ten less than the least score, and is emitted as the
pieces of its UTF-8 bytes. Decoding gives back every text exactly: a literal U+2581 is emitted as bytes, too.

The model file is read, never trained; its path is a parameter, and what is broadcast is its vocabulary.

Defined results: null text: null ids, 0 tokens; empty text: no ids; null ids decode to null; ids outside of the
vocabulary, and null ones, decode to nothing. Words kept between batches are bounded by ``2 * CACHE``.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

MARK = "▁"
#: Words of each of the two generations that a worker keeps.
CACHE = 60_000
#: Longest word that is kept, and that takes numpy.
SHORT = 40
#: Words that numpy takes at once.
STACK = 16_384
UNKNOWN = 10.0


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    #: N normal, B byte, C control or unknown, - unused
    kinds: str
    cache: dict[str, bytes] = field(default_factory=dict, repr=False)
    older: dict[str, bytes] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"pieces": self.pieces, "scores": self.scores, "kinds": self.kinds}

    def __setstate__(self, state):
        self.__init__(**state)

    def __post_init__(self):
        self.score = {p: s for p, s, k in zip(self.pieces, self.scores, self.kinds) if k == "N"}
        self.single = {p: s for p, s in self.score.items() if len(p) == 1}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == "N"}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == "B"}
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no pieces for bytes")
        self.unknown = min(s for s, k in zip(self.scores, self.kinds) if k == "N" and s > -1e8) - UNKNOWN
        # lengths of the pieces that end in a pair of characters, the shortest first
        ends: dict[str, set[int]] = {}
        for p in self.score:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        self.ends = {k: tuple(sorted(v)) for k, v in ends.items()}
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.score if len(p) > 1))
        whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.score)
        self.words = re.compile(r"(?s).+" if whole else f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        self.spoken = [b"" if k in "C-" else bytes([int(p[3:5], 16)]) if k == "B" else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self.literal = array("i", [self.bytes[b] for b in MARK.encode()]).tobytes()
        self._reversed()

    def _reversed(self) -> None:
        """The trie of the reversed pieces: a hash table from (state, character) to the next state, and each state's piece."""
        step: dict[int, int] = {}
        ends: dict[int, int] = {}
        for p, i in self.ids.items():
            at = 0
            for c in reversed(p):
                at = step.setdefault(at << 21 | ord(c), len(step) + 1)
            ends[at] = i
        self.piece = np.full(len(step) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.cost = np.array([self.scores[i] if i >= 0 else self.unknown for i in self.piece])
        self.shift = np.uint64(64 - max(8, (8 * len(step)).bit_length()))
        keys, states = np.fromiter(step, np.int64, len(step)), np.fromiter(step.values(), np.int32, len(step))
        self.keys = np.full((1 << 64 - int(self.shift)) + len(step), -1, np.int64)
        self.next = np.zeros(len(self.keys), np.int32)
        slots = self._slots(keys)
        while len(keys):  # of the keys that want a free slot one gets it, the others look at the next
            free = np.flatnonzero(self.keys[slots] < 0)
            own, first = np.unique(slots[free], return_index=True)
            self.keys[own], self.next[own] = keys[free[first]], states[free[first]]
            left = self.keys[slots] != keys
            keys, states, slots = keys[left], states[left], slots[left] + 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def _follow(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The state after each character, 0 where no piece goes on."""
        keys = states.astype(np.int64) << 21 | chars
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.next[slots], 0)
        more = np.flatnonzero((found != keys) & (found >= 0))
        while len(more):
            at = slots[more] + 1
            slots[more], found = at, self.keys[at]
            hit = found == keys[more]
            out[more[hit]] = self.next[at[hit]]
            more = more[~hit & (found >= 0)]
        return out

    def segment(self, words: list[str], into: dict[str, bytes]) -> None:
        """The ids of sorted, distinct words."""
        long = [w for w in words if len(w) > SHORT]
        short = [w for w in words if len(w) <= SHORT] if long else words
        for k in range(0, len(short), STACK):
            self._by_level(short[k : k + STACK], into)
        if long:
            self._by_depth(long, into)

    def _by_level(self, words: list[str], into: dict[str, bytes]) -> None:
        """Breadth-first over the trie that the words make: all prefixes of a length at once."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        width = int(size.max())
        chars = np.ascontiguousarray(np.array(words, f"<U{width}").view(np.uint32).reshape(n, width).T)
        inside = np.arange(width)[:, None] < size
        # a prefix is new if it isn't one of the word before
        new = inside.copy()
        new[:, 1:] &= ~np.logical_and.accumulate((chars[:, 1:] == chars[:, :-1]) & inside[:, :-1])
        flat, codes = np.flatnonzero(new), chars.ravel().astype(np.int64)
        # pieces that end at each new prefix: its place in ``flat``, their length, their state; one character always does
        here, at, states = np.arange(len(flat)), flat, np.zeros(len(flat), np.int32)
        nodes, lengths, found = [], [], []
        for length in range(1, width + 1):
            states = self._follow(states, codes[at])
            hit = np.flatnonzero(self.piece[states] >= 0) if length > 1 else slice(None)
            nodes.append(here[hit])
            found.append(states[hit])
            lengths.append(np.full(len(found[-1]), length, np.int64))
            on = np.flatnonzero((states > 0) & (at >= n))
            if not len(on):
                break
            here, at, states = here[on], at[on] - n, states[on]
        nodes, lengths, found = np.concatenate(nodes), np.concatenate(lengths), np.concatenate(found)
        order = np.argsort(nodes, kind="stable")  # of one prefix the shorter pieces first
        nodes, lengths, found = nodes[order], lengths[order], found[order]
        starts = np.searchsorted(nodes, np.arange(len(flat)))
        before, costs = flat[nodes] + n - lengths * n, self.cost[found]
        levels = np.searchsorted(flat, np.arange(width + 1) * n).tolist()
        heads = [*starts.tolist(), len(nodes)]
        # forward scores of the prefixes of each word, the empty one first; the candidate that each takes
        forward, taken = np.zeros((width + 1) * n), np.zeros(width * n, np.int64)
        for d in range(width):
            a, b = levels[d], levels[d + 1]
            x, y = heads[a], heads[b]
            scores = forward[before[x:y]] + costs[x:y]
            first = starts[a:b] - x
            best = np.maximum.reduceat(scores, first)
            top = np.flatnonzero(scores == np.repeat(best, np.diff(np.append(first, y - x))))
            last = top[np.append(np.flatnonzero(np.diff(nodes[x:y][top])), len(top) - 1)]  # of equal scores the longer piece
            rows = np.flatnonzero(inside[d])
            owner = np.cumsum(new[d][rows]) - 1
            forward[(d + 1) * n + rows], taken[d * n + rows] = best[owner], (x + last)[owner]
        # back from the ends of the words, a piece of each at a time
        words_of, back = np.flatnonzero(size), []
        end = (size[words_of] - 1) * n + words_of
        while len(words_of):
            c = taken[end]
            back.append((words_of, self.piece[found[c]], codes[end]))
            end = end - lengths[c] * n
            words_of, end = words_of[end >= 0], end[end >= 0]
        owners, ids, last = (np.concatenate([x[k] for x in reversed(back)]) for k in range(3))
        order = np.argsort(owners, kind="stable")
        owners, ids = owners[order], ids[order]
        if (ids < 0).any():  # a character that no piece covers is spelt in bytes
            spelt = [chr(c).encode() if i < 0 else b"" for i, c in zip(ids.tolist(), last[order].tolist())]
            times = np.array([len(s) or 1 for s in spelt])
            ids, owners = np.repeat(ids, times), np.repeat(owners, times)
            ids[ids < 0] = [self.bytes[b] for s in spelt for b in s]
        raw, cuts = ids.astype(np.int32).tobytes(), (4 * np.searchsorted(owners, np.arange(n + 1))).tolist()
        into.update(zip(words, [raw[i:j] for i, j in zip(cuts, cuts[1:])]))

    def _by_depth(self, words: list[str], into: dict[str, bytes]) -> None:
        """Depth-first over the trie that the sorted, distinct words make."""
        score, ends, single, unknown, ids = self.score.get, self.ends.get, self.single.get, self.unknown, self.ids.get
        forward, came, last = [0.0], [0], ""
        for word in words:
            n, at = len(word), 0
            limit = min(n, len(last))
            if word[:limit] == last[:limit]:
                at = limit
            else:
                while word[at] == last[at]:
                    at += 1
            del forward[at + 1 :], came[at + 1 :]
            for end in range(at + 1, n + 1):
                start = end - 1
                best = forward[start] + single(word[start], unknown)
                if start:
                    for length in ends(word[end - 2 : end], ()):
                        if length > end:
                            break
                        found = score(word[end - length : end])
                        if found is not None:
                            found += forward[end - length]
                            if found >= best:  # of equal scores the longer piece
                                best, start = found, end - length
                forward.append(best)
                came.append(start)
            out, end = [], n
            while end:
                start = came[end]
                piece = ids(word[start:end])
                if piece is None:
                    out += [self.bytes[b] for b in reversed(word[start].encode())]
                else:
                    out.append(piece)
                end = start
            out.reverse()
            into[word] = array("i", out).tobytes()
            last = word

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as native 32-bit integers."""
        if len(self.cache) > CACHE:  # two generations: words that come again move to the young one
            self.cache, self.older = {}, self.cache
        cache, older, find = self.cache, self.older, self.words.findall
        split = []
        for text in texts:
            parts = text.split(MARK) if MARK in text else [text]
            parts = [p.replace(" ", MARK) for p in parts]
            parts[0] = MARK + parts[0] if text else ""
            split.append([find(p) for p in parts])
        fresh = set().union(*chain.from_iterable(split))
        fresh.difference_update(cache)
        if older:
            again = fresh & older.keys()
            cache.update((w, older[w]) for w in again)
            fresh -= again
        self.segment(sorted(fresh), cache)
        get = cache.__getitem__
        out = [self.literal.join([b"".join(map(get, words)) for words in parts]) for parts in split]
        for w in [w for w in fresh if len(w) > SHORT]:  # these are not kept
            del cache[w]
        return out

    def decode(self, ids: list[int]) -> str:
        spoken, n = self.spoken, len(self.spoken)
        try:
            raw = b"".join(map(spoken.__getitem__, ids)) if not ids or min(ids) >= 0 else None
        except (IndexError, TypeError):
            raw = None
        if raw is None:
            raw = b"".join(spoken[i] for i in ids if i is not None and 0 <= i < n)
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def load(path: str) -> Vocabulary:
    """Read a SentencePiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    kinds = "".join("B" if sp.is_byte(i) else "C" if sp.is_control(i) or sp.is_unknown(i) else "-" if sp.is_unused(i) else "N" for i in range(n))
    return Vocabulary([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kinds)


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None, check: bool = False) -> DataFrame:
    """The rows with ``ids array<int>`` and ``n_tokens long``; one pass over whole texts, no shuffle.

    With ``check`` the ids are decoded in the same pass: ``decoded_bytes long`` and ``round_trip boolean``, whether
    the text came back (null ids for null text did).
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def factory():
        v = shared.value

        def work(texts):
            rows = texts.to_pylist()
            found = v.encode([t or "" for t in rows])
            counts = np.array([len(b) // 4 for b in found], np.int64)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(found), np.int32))
            mask = pa.array([t is None for t in rows])
            out = [pa.ListArray.from_arrays(pa.array(ends), values, mask=mask), pa.array(counts)]
            if check:
                back = [None if t is None else v.decode(np.frombuffer(b, np.int32).tolist()) for t, b in zip(rows, found)]
                out += [pa.array([None if x is None else len(x.encode()) for x in back], pa.int64()), pa.array([x == t for x, t in zip(back, rows)], pa.bool_())]
            return out

        return work

    more = ", decoded_bytes long, round_trip boolean" if check else ""
    return arrow_map(df, [text], "ids array<int>, n_tokens long" + more, factory, keep, budget=500_000)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The rows with ``decoded string``."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def factory():
        v = shared.value

        def work(rows):
            return [pa.array([None if not x.is_valid else v.decode(x.values.to_pylist()) for x in rows], pa.string())]

        return work

    return arrow_map(df, [ids], "decoded string", factory, keep)
