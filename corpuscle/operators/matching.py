"""Every occurrence of every dictionary key in texts, with candidates, options and events."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.normalize import normalize_spans
from corpuscle.operators.automaton import LEFTMOST_FIRST, LEFTMOST_LONGEST, STANDARD, Matcher, find
from corpuscle.operators.skew import skew_join
from corpuscle.session import BROADCAST_ROWS, materialize, small

#: Keys up to which the dictionary goes to the executors as one automaton; beyond that texts meet it by a join.
BROADCAST_KEYS = 300_000
#: Of the join: characters of a long key that are looked up first, bits a key gets in the filter, and the most one filter may take (keys beyond that are taken in slices).
ANCHOR, BITS_A_KEY, FILTER_BYTES = 6, 24, 128 << 20


def automaton(keys: list[tuple[str, int]], how: str = "overlapping", first: bool = False):
    """A function from a normalized text to its occurrences (start, end, surface_id) in characters.

    Overlapping search runs in the native automaton where that library is installed, else in ours; both give the same.
    """
    if how == "overlapping":
        try:
            import ahocorasick
        except ImportError:
            pass
        else:
            native = ahocorasick.Automaton()
            for key, sid in keys:
                native.add_word(key, (len(key), sid))
            native.make_automaton()
            return lambda text: ((end + 1 - n, end + 1, sid) for end, (n, sid) in native.iter(text)) if len(native) else ()
    kind = STANDARD if how != "leftmost" else LEFTMOST_FIRST if first else LEFTMOST_LONGEST
    own = Matcher([k for k, _ in keys], [sid for _, sid in keys], kind)
    return lambda text: find(own, text, how)


def _spans_schema(docs: DataFrame, key: str) -> str:
    return f"{key} {docs.schema[key].dataType.simpleString()}, start int, end int, surface_id long"


def find_by_automaton(docs: DataFrame, dictionary: DataFrame, key: str, text: str, how: str = "overlapping", first: bool = False, most: int | None = None) -> DataFrame:
    """Occurrences by an automaton of the whole dictionary, built once on each Python worker; a dictionary of more than ``BROADCAST_KEYS`` keys is refused.

    With ``most`` only the first so many of each text, by start, end and surface: the search of a text stops as soon as they are certain.
    """
    keys = [(r.surface_key, r.surface_id) for r in dictionary.select("surface_key", "surface_id").limit(BROADCAST_KEYS + 1).collect()]
    if len(keys) > BROADCAST_KEYS:
        raise ValueError(f"an automaton may have {BROADCAST_KEYS} keys; larger dictionaries take find_by_join")
    keys.sort(key=lambda k: k[1])
    longest = max((len(k) for k, _ in keys), default=0)
    sent, name = docs.sparkSession.sparkContext.broadcast(keys), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _built(name, lambda: automaton(sent.value, how, first))
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                rows = batch.slice(lo, 200)
                who, begin, end, found = [], [], [], []
                for i, t in enumerate(rows.column(1).to_pylist()):
                    norm, starts, ends = normalize_spans(t)
                    hits = list(search(norm)) if most is None else _first_hits(search(norm), longest, most)
                    if hits:
                        a, b, ids = zip(*hits)
                        a, b, ids = starts[np.array(a)], ends[np.array(b) - 1], np.array(ids, np.int64)
                        if most is not None:
                            kept = np.lexsort((ids, b, a))[:most]
                            a, b, ids = a[kept], b[kept], ids[kept]
                        who.append(np.full(len(ids), i))
                        begin.append(a)
                        end.append(b)
                        found.append(ids)
                if who:
                    columns = [rows.column(0).take(pa.array(np.concatenate(who))), *[pa.array(np.concatenate(x)) for x in (begin, end, found)]]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "end", "surface_id"])

    return docs.where(F.col(text).isNotNull()).select(key, text).mapInArrow(scan, _spans_schema(docs, key))


_BUILT: dict[str, object] = {}


def _built(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once a Python worker; the last one is kept."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = make()
    return _BUILT[name]


def _first_hits(hits: Iterator, longest: int, most: int) -> list:
    """Hits, which come by end, until ``most`` of them start before any that could still come: a later one starts no more than ``longest`` before the place reached."""
    taken, check = [], most
    for hit in hits:
        taken.append(hit)
        if len(taken) >= check:
            if sum(a < hit[1] - longest - 1 for a, _, _ in taken) >= most:
                break
            check = len(taken) + most
    return taken


_BASE = 0x9E3779B97F4A7C15
_UNDO = pow(_BASE, -1, 1 << 64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Hashes:
    """64-bit hashes of any stretches of a text, from sums that are made once; the same characters have the same hash wherever they stand."""

    def __init__(self, points: np.ndarray) -> None:
        one = np.ones(1, np.uint64)
        powers = np.cumprod(np.concatenate([one, np.full(len(points), _BASE, np.uint64)]))
        self.undo = np.cumprod(np.concatenate([one, np.full(len(points), _UNDO, np.uint64)]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers[:-1])])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        x = (self.sums[start + length] - self.sums[start]) * self.undo[start]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def _word_and_bits(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Which word of a filter a hash falls to, and its four bits in there."""
    bits = np.zeros(len(hashes), np.uint64)
    for k in range(4):
        bits |= np.uint64(1) << ((hashes >> np.uint64(6 * k)) & np.uint64(63))
    return ((hashes >> np.uint64(32)) % np.uint64(words)).astype(np.int64), bits


def key_filter(keys: DataFrame, words: int) -> np.ndarray:
    """A filter of 64-bit words over whole keys, and the first ``ANCHOR`` characters of longer ones; what it denies is none of them."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lengths = np.array([len(t) for t in texts], np.int64)
            hashes, starts = Hashes(code_points("".join(texts))), np.cumsum(lengths) - lengths
            long = lengths > ANCHOR
            both = np.concatenate([hashes.of(starts, lengths), hashes.of(starts[long], ANCHOR) ^ np.uint64(1)])
            word, bits = _word_and_bits(both, words)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    got = keys.select("surface_key").mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(words, np.uint64)
    filled[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return filled


def find_by_join(docs: DataFrame, dictionary: DataFrame, key: str, text: str, how: str = "overlapping", first: bool = False, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Occurrences by a join of stretches of text with keys: for dictionaries of any size.

    A stretch of a length that keys have moves only if a filter over whole keys passes it, so that about as many rows are shuffled as there are
    occurrences, each with its few characters; the join with the keys settles which are true, and AQE splits keys that are found very often. Keys beyond ``filter_bytes`` of
    filter are taken in slices by hash, for each of which the texts are read again. ``how`` and ``first`` choose occurrences that don't overlap, as the
    automaton would: one sort within each text.
    """
    keys = dictionary.where("surface_key != ''").select("surface_key", "surface_id")
    n, lengths = keys.agg(F.count("*"), F.collect_set(F.length("surface_key"))).first()
    slices = max(1, math.ceil(n * BITS_A_KEY / 8 / filter_bytes))
    kind = docs.schema[key].dataType.simpleString()
    found = None
    for part in range(slices):
        some = keys if slices == 1 else keys.where(F.pmod(F.xxhash64("surface_key"), F.lit(slices)) == part)
        words = max(16, math.ceil(n / slices * 1.05 * BITS_A_KEY / 64))
        sent = docs.sparkSession.sparkContext.broadcast((key_filter(some, words), sorted(lengths)))
        spread = docs.where(F.col(text).isNotNull()).select(key, text).mapInArrow(_stretches(sent, key), f"{key} {kind}, surface_key string, _a int, _b int, start int, `end` int")
        met = spread.join(some.hint("shuffle_hash") if n > BROADCAST_KEYS else some, "surface_key")
        found = met if found is None else found.unionByName(met)
    if how != "overlapping":
        found = _apart(found, key, how, first)
    return found.select(key, "start", "end", "surface_id")


def passing(words: np.ndarray, lengths: list[int], whole: str, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of texts of these sizes, which ``whole`` has one after the other, the stretches that the filter passes, some of one length at a time: the length, their places and the number of the text of each."""

    def passed(hashes: np.ndarray) -> np.ndarray:
        word, bits = _word_and_bits(hashes, len(words))
        return (words[word] & bits) == bits

    of = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(of))  # characters from here to the end of the text
    hashes, at = Hashes(code_points(whole)), np.arange(len(of))
    anchored = at[left > ANCHOR]
    anchored = anchored[passed(hashes.of(anchored, ANCHOR) ^ np.uint64(1))]
    for n in lengths:
        some = anchored if n > ANCHOR else at
        some = some[left[some] >= n]
        some = some[passed(hashes.of(some, n))]
        for k in range(0, len(some), 10_000):
            i = some[k : k + 10_000]
            yield n, i, of[i]


def _stretches(sent, key: str) -> Callable:
    """The stretches of texts that the filter passes."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lengths = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                rows = batch.slice(lo, 200)
                spans = [normalize_spans(t) for t in rows.column(1).to_pylist()]
                sizes = np.array([len(s[0]) for s in spans], np.int64)
                whole = "".join(s[0] for s in spans)
                if not whole:
                    continue
                starts, ends = (np.concatenate([s[k] for s in spans]) for k in (1, 2))
                begins = np.cumsum(sizes) - sizes
                for n, i, of in passing(words, lengths, whole, sizes):
                    first = begins[of]
                    texts = pa.array([whole[x : x + n] for x in i.tolist()], pa.string())
                    columns = [rows.column(0).take(pa.array(of)), texts, *[pa.array(x.astype(np.int32)) for x in (i - first, i - first + n, starts[i], ends[i + n - 1])]]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "surface_key", "_a", "_b", "start", "end"])

    return stretches


def _apart(found: DataFrame, key: str, how: str, first: bool) -> DataFrame:
    """Of all occurrences of each text those that don't overlap: ``standard`` by end, then longest; ``leftmost`` by start, then longest or ``first`` in the dictionary; texts that occur twice are told apart by nothing and count once."""
    order = ["_b", "_a", "surface_id"] if how == "standard" else ["_a", "surface_id", F.desc("_b")] if first else ["_a", F.desc("_b"), "surface_id"]
    columns = [key, "_a", "_b", "start", "end", "surface_id"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, end = object(), 0
        for batch in batches:
            kept = []
            for i, (t, a, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                if t != text:
                    text, end = t, 0
                if a >= end:
                    kept.append(i)
                    end = b
            yield batch.take(pa.array(kept, pa.int64()))

    ordered = found.select(*columns).repartition(key).sortWithinPartitions(key, *order)
    return ordered.mapInArrow(pick, ordered.schema)


def find_matches(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", method: str = "auto", how: str = "overlapping", first: bool = False) -> DataFrame:
    """Every occurrence of every key in every text: ``key``, ``start``, ``end`` (UTF-16 units of the text as it is), ``surface_id``.

    Texts are normalized by the contract of the keys, whole. A bag: a code point that folds to several characters may give an occurrence
    twice, and repeated rows of ``docs`` give theirs again. Null and empty texts have none; an empty dictionary gives an empty result.
    ``auto`` takes the automaton up to ``BROADCAST_KEYS`` keys, else the join. ``how`` is ``overlapping`` for all, ``longest_per_end``, ``standard``
    or ``leftmost`` (``first``: the key given first wins, not the longest); of the last two, the join counts texts of one key as one text.
    """
    if method == "auto":
        method = "automaton" if dictionary.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else "join"
    if method == "automaton":
        return find_by_automaton(docs, dictionary, key, text, how, first)
    if how == "longest_per_end":
        return longest_per_end(find_by_join(docs, dictionary, key, text), key)
    return find_by_join(docs, dictionary, key, text, how, first)


def with_candidates(matches: DataFrame, dictionary: DataFrame, include_disambiguation: bool = True, most: int | None = None, most_keys: int = BROADCAST_ROWS) -> DataFrame:
    """Matches with ``shard_id`` and their candidates ``qids``: without disambiguations if so asked, then the first ``most`` (0 counts as 1); matches left without candidates go.

    ``dictionary`` has ``candidates``. Filters and caps apply once a key, not once a match. Up to ``most_keys`` keys are broadcast; more meet the matches by a
    join in which the keys that hold most of them are taken apart.
    """
    left = F.col("candidates")
    if not include_disambiguation:
        left = F.filter(left, lambda c: ~c["disambiguation"])
    if most is not None:
        left = F.slice(left, 1, max(1, most))
    kept, fits = small(dictionary.select("surface_id", "shard_id", left.alias("qids")).where(F.size("qids") > 0), most_keys)
    met = matches.join(kept, "surface_id") if fits else skew_join(materialize(matches, "matches"), kept, "surface_id")
    return met.select(*[c for c in matches.columns if c != "surface_id"], "surface_id", "shard_id", "qids")


def in_order(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """The matches of each text together, by start, end, surface; texts come in no order, so that nothing is sorted beyond what one task holds."""
    return matches.repartition(key).sortWithinPartitions(key, "start", "end", "surface_id")


def longest_per_end(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of the matches that end at one place of a text the longest; ties go to the least surface."""
    best = F.min(F.struct("start", "surface_id")).alias("_best")
    return matches.groupBy(key, "end").agg(best).select(key, F.col("_best.start").alias("start"), "end", F.col("_best.surface_id").alias("surface_id"))


def match_counts(docs: DataFrame, matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``key``, ``matches``) of every text, 0 included."""
    counted = matches.groupBy(key).agg(F.count("*").alias("matches"))
    return docs.select(key).distinct().join(counted, key, "left").select(key, F.coalesce("matches", F.lit(0)).alias("matches"))


def events(docs: DataFrame, matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """(``key``, ``seq``, ``line``): for each text its matches in order as JSON lines, then one line that it is done.

    The lines of one text are numbered within it; the closing line's number is the count, so no text is sorted as a whole by one task for
    more than its own matches.
    """
    body = F.to_json(F.struct(F.lit("match").alias("type"), F.struct("start", "end", "surface_id", "shard_id", "qids").alias("match")))
    order = Window.partitionBy(key).orderBy("start", "end", "surface_id")
    lines = matches.select(key, (F.row_number().over(order) - 1).alias("seq"), body.alias("line"))
    done = match_counts(docs, matches, key).select(
        key, F.col("matches").cast("int").alias("seq"), F.to_json(F.struct(F.lit("done").alias("type"), F.struct("matches").alias("stats"))).alias("line")
    )
    return lines.unionByName(done)


def first_matches(docs: DataFrame, dictionary: DataFrame, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first ``most`` matches of each text by start, end and surface, as a consumer that stops early would take them; with an automaton the search of a text stops there."""
    if dictionary.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return find_by_automaton(docs, dictionary, key, text, most=most)
    order = Window.partitionBy(key).orderBy("start", "end", "surface_id")
    return find_by_join(docs, dictionary, key, text).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")
