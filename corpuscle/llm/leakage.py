"""Evaluation items that occur, whole or in part, in the documents of a corpus."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.lookalike import pieces_of
from corpuscle.session import spread

BITS, BLOCKS, RADIUS = 64, 4, 15
#: Weighted share of an item window's words that a document window must hold to be aligned.
LEAST_SHARE = 0.5
#: Share of the item's words a passage must span, and what an altered word costs in the alignment (a kept one gives 1).
LEAST_SPAN, ALTERED_COST = 0.5, 3
#: Share of the passage's weight that must be kept, where a word weighs its rarity squared: sentences of the same frame keep the frame, but not the names, numbers and nouns.
LEAST_WEIGHT = 0.77
#: Items looked for in one pass over the corpus; their index takes about 60 kB an item on each Python worker.
BLOCK_ITEMS = 5_000

_WORD = re.compile(r"[^\W_]+")
_JOINTS = re.compile(r"(?<=[^\W_])['’‘ʼ-](?=[^\W_])")
_MARKS = re.compile(r"\[\s*[0-9]{1,3}\s*\]|[(\[]\s*sic\s*!?\s*[)\]]")


class _Fold(dict):
    """Code point -> what of it counts when words are compared; filled as characters occur."""

    def __missing__(self, c: int) -> str:
        parts = unicodedata.normalize("NFKD", pieces_of(chr(c)))
        self[c] = kept = "".join(pieces_of(x) for x in parts if unicodedata.category(x)[0] != "M").casefold()
        return kept


_FOLD = _Fold()


def words_of(text: str) -> list[str]:
    """The words of a text without case, accents, width, look-alike letters, signs without ink and punctuation.

    Hyphens and apostrophes within a word vanish, as copies often drop them; footnote numbers and "sic" in brackets are marks, not words.
    """
    return _WORD.findall(_JOINTS.sub("", _MARKS.sub(" ", text.translate(_FOLD))))


def window_size(n_words: int) -> int:
    """Words in the windows of an item of ``n_words``: of the sizes 3, 4, 5, 6, 7, 9, 11, 14, 17, 21 ... the largest within 0.85 of half the item."""
    most, size = max(1.0, 0.85 * math.ceil(n_words / 2)), 1.0
    while size * 1.25 <= most:
        size *= 1.25
    return max(1, int(size))


class _Vectors(dict):
    """Word -> its 64 signs; drops all when full, so that endless vocabularies fit."""

    MOST = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        bits = np.frombuffer(hashlib.blake2b(word.encode(), digest_size=8).digest(), np.uint64)[0]
        self[word] = bits
        return bits


_VECTORS = _Vectors()


def fingerprints(bits: np.ndarray, weights: np.ndarray, size: int, at: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """SimHash of the windows of ``size`` words that start at the ascending places ``at``: of the words' 64-bit hashes, the bits set in more than half by weight (small whole numbers)."""
    prints = np.zeros(len(at), np.uint64)
    for lo in range(0, len(bits), step):
        i, j = np.searchsorted(at, [lo, lo + step])
        if i < j:
            heavy = weights[lo : lo + step + size].astype(np.uint8)
            ones = np.unpackbits(bits[lo : lo + step + size].view(np.uint8).reshape(-1, 8), axis=1) * heavy[:, None]
            sums = np.zeros((len(ones) + 1, BITS + 1), np.int32)
            np.cumsum(ones, axis=0, out=sums[1:, :BITS])
            np.cumsum(heavy, out=sums[1:, BITS])
            here = at[i:j] - lo
            inside = sums[here + size] - sums[here]
            prints[i:j] = np.packbits(inside[:, :BITS] * 2 > inside[:, BITS:], axis=1).view(np.uint64).ravel()
    return prints


class HammingIndex:
    """Finds all stored fingerprints within ``radius``: of ``BLOCKS`` blocks one lies within radius // BLOCKS of the stored block, and each stored block is listed under all such values."""

    def __init__(self, stored: np.ndarray, radius: int = RADIUS) -> None:
        self.stored, self.radius, self.width = stored, radius, BITS // BLOCKS
        near = [0] + [sum(1 << b for b in c) for k in range(1, radius // BLOCKS + 1) for c in combinations(range(self.width), k)]
        near = np.array(near, np.uint64)
        self.starts, self.ids = [], []
        for b in range(BLOCKS):
            keys = (self.block(stored, b)[:, None] ^ near[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            self.starts.append(np.searchsorted(keys[order], np.arange((1 << self.width) + 1, dtype=np.uint64)))
            self.ids.append((order // len(near)).astype(np.int32))

    def block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)

    def within(self, prints: np.ndarray, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``prints``, position in ``stored``) of all pairs within the radius, each once."""
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(prints), step):
            part = prints[at : at + step]
            for b in range(BLOCKS):
                keys = self.block(part, b).astype(np.int64)
                first, count = self.starts[b][keys], self.starts[b][keys + 1] - self.starts[b][keys]
                who = np.repeat(np.arange(len(part)), count)
                place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
                other = self.ids[b][place]
                near = np.bitwise_count(part[who] ^ self.stored[other]) <= self.radius
                found.append((who[near] + at) * np.int64(len(self.stored)) + other[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.stored)), pairs % max(1, len(self.stored))


class Rarity:
    """What the words of all items weigh: rare ones more, in comparisons as they are, in fingerprints in steps from 1 to 8; words of no item as the rarest."""

    def __init__(self, texts: Iterable[str | None]) -> None:
        held: Counter = Counter()
        n = 0
        for t in texts:
            if t and (w := words_of(t)):
                n += 1
                held.update(set(w))
        self.number = {x: k for k, x in enumerate(sorted(held))}
        self.weight = np.array([math.log(n / held[x]) + 0.02 for x in self.number])


class Items:
    """The evaluation items of one pass, ready to be looked for; made on the executors, with the weights of all items, so that no result depends on the passes."""

    def __init__(self, items: list[tuple[int, str]], rarity: Rarity, radius: int = RADIUS) -> None:
        texts = [(i, w) for i, t in items if i is not None and t and (w := words_of(t))]
        self.ids, self.words = [i for i, _ in texts], [w for _, w in texts]
        self.number, self.weight = rarity.number, rarity.weight
        self.steps = np.append(np.ceil(8 * self.weight / max(self.weight, default=1)), 8).astype(np.int64)
        self.coded = [np.array([self.number[x] for x in w], np.int64) for w in self.words]
        by_size: dict[int, list[tuple[int, int, np.uint64]]] = {}
        for k, w in enumerate(self.words):
            half = math.ceil(len(w) / 2)
            size = min(half, window_size(len(w)))
            at = np.arange(0, len(w) - size + 1, max(1, (half - size) // 2))
            prints = fingerprints(np.array([_VECTORS[x] for x in w], np.uint64), self.steps[self.coded[k]], size, at)
            by_size.setdefault(size, []).extend(zip([k] * len(at), at.tolist(), prints))
        self.by_size = {}
        for size, found in sorted(by_size.items()):
            k, o, p = (np.array(x) for x in zip(*found))
            windows = np.stack([self.coded[i][j : j + size] for i, j in zip(k, o)])
            weight = np.array([[0 if x in r[:i] else self.weight[x] for i, x in enumerate(r)] for r in windows.tolist()])
            self.by_size[size] = (k, windows, weight, HammingIndex(p.astype(np.uint64), radius))

    def leaked(self, texts: list[str]) -> list[tuple[int, int]]:
        """(position of the text, position of the item) of the texts that hold an item."""
        docs = [words_of(t) if t else [] for t in texts]
        lengths = np.array([len(d) for d in docs])
        starts = np.cumsum(lengths) - lengths
        flat = [x for d in docs for x in d]
        bits = np.array([_VECTORS[x] for x in flat], np.uint64)
        coded = np.array([self.number.get(x, -1) for x in flat], np.int64)
        doc_of = np.repeat(np.arange(len(docs)), lengths)
        known = np.concatenate([[0.0], np.cumsum(np.append(self.weight, 0.0)[coded])])
        places: dict[tuple[int, int], list[int]] = {}
        for size, (item, windows, weights, index) in self.by_size.items():
            if len(flat) < size:
                continue
            need = LEAST_SHARE * weights.sum(1)
            most = known[size:] - known[:-size]  # what a window can share with any item's window
            at = np.flatnonzero((doc_of[: len(most)] == doc_of[size - 1 :]) & (most >= need.min() - 1e-6))
            here, stored = index.within(fingerprints(bits, self.steps[coded], size, at))
            at = at[here]
            may = most[at] >= need[stored] - 1e-6
            at, stored = at[may], stored[may]
            for lo in range(0, len(at), 20_000):
                a, s = at[lo : lo + 20_000], stored[lo : lo + 20_000]
                held = (windows[s][:, :, None] == coded[a[:, None] + np.arange(size)][:, None, :]).any(2)
                close = (weights[s] * held).sum(1) >= need[s]
                for x, k in zip(a[close].tolist(), item[s[close]].tolist()):
                    places.setdefault((int(doc_of[x]), k), []).append(x)
        found = []
        for (doc, k), at in places.items():
            n, lo, hi = len(self.words[k]), starts[doc], starts[doc] + lengths[doc]
            at.sort()
            groups = np.split(np.array(at), np.flatnonzero(np.diff(at) > 2 * n) + 1)
            weights = self.weight[self.coded[k]] ** 2
            if any(spans(self.coded[k], coded[max(lo, g[0] - 2 * n) : min(hi, g[-1] + 2 * n)], weights) for g in groups):
                found.append((doc, k))
        return found


def spans(item: np.ndarray, place: np.ndarray, weights: np.ndarray) -> bool:
    """Whether a local alignment of the words of a place with those of an item holds a passage of it.

    Of the alignment (kept words 1, altered, missing and extra ones minus ``ALTERED_COST``) each better region is looked at: it must span ``LEAST_SPAN`` of the item's
    words, and its kept words must have ``LEAST_WEIGHT`` of the weight of those it spans. Scores are held with the first item
    word and the kept weight of their region, so that one pass over the item is enough.
    """
    m = len(place)
    ramp = np.arange(m + 1) * ALTERED_COST
    score, first, kept = np.zeros(m + 1), np.zeros(m + 1, np.int64), np.zeros(m + 1)
    before = np.concatenate([[0.0], np.cumsum(weights)])
    best = 0.0
    for i, word in enumerate(item):
        same = place == word
        step, begun, held = np.zeros(m + 1), np.full(m + 1, i), np.zeros(m + 1)
        step[1:] = score[:-1] + np.where(same, 1, -ALTERED_COST)
        begun[1:] = np.where(score[:-1] > 0, first[:-1], i)
        held[1:] = np.where(score[:-1] > 0, kept[:-1], 0.0) + weights[i] * same
        down = score - ALTERED_COST
        use = down > step
        step, begun, held = np.where(use, down, step), np.where(use, first, begun), np.where(use, kept, held)
        rise = step + ramp
        source = np.maximum.accumulate(np.where(rise == np.maximum.accumulate(rise), np.arange(m + 1), 0))
        score = np.maximum(rise[source] - ramp, 0)
        first, kept = begun[source], held[source]
        top = int(score.argmax())
        if score[top] > best:
            best = score[top]
            if i - first[top] + 1 >= LEAST_SPAN * len(item) and kept[top] >= LEAST_WEIGHT * (before[i + 1] - before[first[top]]):
                return True
    return False


#: The items of the last pass a Python worker took part in.
_READY: dict[str, Items] = {}


def leaked_items(docs: DataFrame, items: DataFrame, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(``doc_id``, ``item_id``) of the documents whose ``text`` holds in one place, in order, at least half of an item's words, of which few are altered.

    Case, punctuation, blanks, accents, width, look-alike letters and signs without ink make no difference. Rows of either
    table with a null id, and null, empty or wordless texts, hold and are nothing; a repeated id counts once. Texts are taken
    whole. Empty tables give an empty result, and other columns are ignored.

    Method: windows of all texts, sized by the items (0.7 to 0.85 of half an item), at every word, get 64-bit SimHash fingerprints of their words, rare ones weighing up to 8 times as much as common ones. A
    multi-index over the items' windows (every second word or so, so that any half of an item holds several) finds every pair within ``radius`` bits: the 64 bits are 4 blocks, one of which must lie within
    radius // 4. Pairs whose window shares at least half of the item window's words, weighted by rarity among items, are
    aligned exactly, and the aligned passage must keep most of its weight; windows whose words, all counted, weigh too little to share half with any item are not looked up. A shingle is a single word here, as one word in ten may be altered; with five words, half of the shingles
    of a true passage would be gone. The corpus is read once for every ``block_items`` items and not shuffled but for the distinct result; texts of items, not
    documents, go to the executors, which index them once a worker. Words weigh what they do among all items, so the passes change no row.
    """
    spark = docs.sparkSession
    items = items.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    rarity = Rarity(r.text for r in items.toLocalIterator())
    blocks = max(1, math.ceil(items.count() / block_items))
    found = None
    for b in range(blocks):
        part = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        sent, name = spark.sparkContext.broadcast((part, rarity)), uuid.uuid4().hex

        def look(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            if name not in _READY:
                _READY.clear()
                _READY[name] = Items(*sent.value, radius)
            block = _READY[name]
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    rows = batch.slice(lo, 512)
                    ids = rows.column(0)
                    pairs = block.leaked(rows.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([d for d, _ in pairs], pa.int64())), pa.array([block.ids[k] for _, k in pairs], pa.int64())], names=["doc_id", "item_id"])

        one = spread(docs.where("doc_id is not null and text is not null").select("doc_id", "text")).mapInArrow(look, "doc_id long, item_id long")
        found = one if found is None else found.unionByName(one)
    return found.distinct()
