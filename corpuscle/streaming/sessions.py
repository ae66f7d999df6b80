"""Sessions: a client starts, sends a text in chunks and ends; occurrences across chunks are found."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpuscle.functions.normalize import Normalizer
from corpuscle.operators.matching import BITS_A_KEY, BROADCAST_KEYS, FILTER_BYTES, automaton, key_filter, passing
from corpuscle.session import materialize

OUTPUT = "session_id string, seq long, part int, line string"


class Lookup:
    """The dictionary on an executor: the search, and shard and candidates of each surface."""

    def __init__(self, rows: list[tuple[str, int, int, list[tuple[str, int, bool]]]]) -> None:
        self.search = automaton([(k, sid) for k, sid, _, _ in rows])
        self.known = {sid: (shard, candidates) for _, sid, shard, candidates in rows}
        self.longest = max((len(k) for k, *_ in rows), default=1)

    def candidates(self, sid: int, options: dict) -> list[dict]:
        found = [{"qid": q, "qid_number": n, "disambiguation": d} for q, n, d in self.known[sid][1] if options.get("include_disambiguation", True) or not d]
        most = options.get("max_candidates_per_surface")
        return found if most is None else found[: max(1, most)]


@dataclass
class Session:
    """What is kept of a session between chunks: the normalizer, the end of the text a key could still begin in, and the count."""

    options: dict = field(default_factory=dict)
    seen: bool = False
    normalizer: Normalizer = field(default_factory=Normalizer)
    tail: list[tuple[str, int, int]] = field(default_factory=list)
    matches: int = 0

    @property
    def closed(self) -> bool:
        """Whether nothing is left that a later message could need: no text under way, options as at first."""
        return not self.seen and not self.options

    def window(self, text: str, longest: int) -> tuple[list[tuple[str, int, int]], int]:
        """The kept end of the text with a chunk after it, and how much of that was kept; a new end is kept."""
        self.seen = True
        new = self.normalizer.feed(text)
        old, spans = len(self.tail), self.tail + new
        self.tail = spans[max(0, len(spans) - longest + 1) :] if longest > 1 else []
        return spans, old

    def chunk(self, text: str, lookup: Lookup) -> Iterator[dict]:
        spans, old = self.window(text, lookup.longest)
        found = sorted((spans[a][1], spans[b - 1][2], sid) for a, b, sid in lookup.search("".join(c for c, _, _ in spans)) if b > old)
        for start, end, sid in found:
            if qids := lookup.candidates(sid, self.options):
                self.matches += 1
                yield {"type": "match", "match": {"start": start, "end": end, "surface_id": sid, "shard_id": lookup.known[sid][0], "qids": qids}}
        yield {"type": "ack", "received_chars": self.normalizer.offset}

    def reset(self) -> None:
        """Forget the text; options stay."""
        self.seen = False
        self.normalizer, self.tail, self.matches = Normalizer(), [], 0


def answer(session: Session, payload: str | None, lookup: Lookup) -> Iterator[dict]:
    """The events a client gets for one message: ``{"type": "start", "options": ...}``, ``{"type": "chunk", "text": ...}`` or ``{"type": "end"}``. Anything else is answered by an error, and the session lives on."""
    try:
        message = json.loads(payload or "")
        kind = message["type"]
        if kind == "start":
            options = message.get("options") or {}
            most = options.get("max_candidates_per_surface")
            if not isinstance(options.get("include_disambiguation", True), bool) or not (most is None or type(most) is int and most >= 0):
                raise ValueError("malformed options")
            session.reset()
            session.options = options
            yield {"type": "started"}
        elif kind == "chunk":
            text = message["text"]
            if not isinstance(text, str):
                raise ValueError("text must be a string")
            yield from session.chunk(text, lookup)
        elif kind == "end":
            yield {"type": "done", "stats": {"matches": session.matches}}
            session.reset()
        else:
            raise ValueError(f"unknown type {kind!r}")
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        yield {"type": "error", "message": str(e) or type(e).__name__}


def interrupted(reason: str) -> str:
    """The line that tells a client of a stop before its text ended."""
    return json.dumps({"type": "interrupted", "reason": reason})


def _rows(dictionary: DataFrame) -> list[tuple]:
    """The dictionary's rows for ``Lookup``; one of more than ``BROADCAST_KEYS`` keys is refused, as every process would have to hold it."""
    rows = dictionary.select("surface_key", "surface_id", "shard_id", "candidates").orderBy("surface_id").limit(BROADCAST_KEYS + 1).collect()
    if len(rows) > BROADCAST_KEYS:
        raise ValueError(f"a dictionary for streams may have {BROADCAST_KEYS} keys")
    return [(r[0], r[1], r[2], [(c.qid, c.qid_number, c.disambiguation) for c in r[3]]) for r in rows]


def lookup(dictionary: DataFrame) -> Lookup:
    """The dictionary in this process."""
    return Lookup(_rows(dictionary))


def _lookup(dictionary: DataFrame):
    """The dictionary for the executors."""
    return dictionary.sparkSession.sparkContext.broadcast(_rows(dictionary))


_READY: dict[int, Lookup] = {}


def _ready(sent) -> Lookup:
    """The lookup of a broadcast, built once a Python worker."""
    rows = sent.value
    if id(rows) not in _READY:
        _READY.clear()
        _READY[id(rows)] = Lookup(rows)
    return _READY[id(rows)]


def _stored(session: Session) -> tuple:
    n = session.normalizer
    tail = session.tail
    return (
        json.dumps(session.options), session.seen, n.offset, n.begun, n.pending and n.pending[0], n.pending and n.pending[1],
        "".join(c for c, _, _ in tail), [a for _, a, _ in tail], [b for _, _, b in tail], session.matches,
    )


def _restored(row: tuple, kind: type[Session]) -> Session:
    options, seen, offset, begun, low, high, text, starts, ends, matches = row
    pending = None if low is None else (low, high)
    return kind(json.loads(options), seen, Normalizer(offset, begun, pending), list(zip(text, starts, ends)), matches)


STATE = "options string, seen boolean, offset long, begun boolean, pending_start long, pending_end long, tail string, starts array<long>, ends array<long>, matches long"


class _Windowed(Session):
    """A session whose chunks are not searched but given on, for a join with the dictionary."""

    def chunk(self, text: str, lookup: _Sieve) -> Iterator[dict]:
        spans, old = self.window(text, lookup.longest)
        yield {"type": "window", "spans": spans, "old": old}
        yield {"type": "ack", "received_chars": self.normalizer.offset}


@dataclass
class _Sieve:
    """What a stream needs of a dictionary of any size: a filter over its keys, and their lengths."""

    words: np.ndarray
    lengths: list[int]

    @property
    def longest(self) -> int:
        return max(self.lengths, default=1)


# A message answered without a search: its answer but for matches, with the text to search. Of these, stretches that may be keys, and the answers again. On a stream ``n`` numbers the messages
# of a session in a micro-batch from 0 if nothing is kept of the session, so that there is no count to look for, else from 1.
_WINDOWS = "session_id string, seq long, n long, line string, disambiguations boolean, most int, text string, old int, base long, starts binary, ends binary"
_STRETCHES = "session_id string, seq long, n long, line string, disambiguations boolean, most int, surface_key string, start long, end long"
_STARTED, _DONE = json.dumps({"type": "started"}), json.dumps({"type": "done", "stats": {"matches": 0}})
_MOST = (1 << 31) - 1
# The only store of Spark's for a stream with two states.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _answers(who: str, seq: int, n: int, session: Session, payload: str | None, lookup: Lookup) -> list[tuple]:
    """Rows of ``OUTPUT`` for one message."""
    return [(who, seq, i, json.dumps(e, ensure_ascii=False)) for i, e in enumerate(answer(session, payload, lookup))]


def _window(who: str, seq: int, n: int, session: Session, payload: str | None, lookup: _Sieve) -> list[tuple]:
    """The row of ``_WINDOWS`` for one message, the ``n``-th."""
    *window, event = answer(session, payload, lookup)
    spans, old = (window[0]["spans"], window[0]["old"]) if window else ([], 0)
    base = spans[0][1] if spans else 0
    starts, ends = (np.array([s[k] - base for s in spans], np.int32).tobytes() for k in (1, 2))
    most = session.options.get("max_candidates_per_surface")
    most = _MOST if most is None else min(max(1, most), _MOST)
    text = "".join(c for c, _, _ in spans)
    return [(who, seq, n, json.dumps(event, ensure_ascii=False), session.options.get("include_disambiguation", True), most, text, old, base, starts, ends)]


def _sifted(sent) -> Callable:
    """Rows of ``_STRETCHES`` from those of ``_WINDOWS``: the stretches that end in new text and pass the filter, without a line, and each line with its session for a key, so that lines are spread."""
    names = _names(_STRETCHES)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                rows = batch.slice(lo, 1000)
                none = pa.nulls(rows.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*rows.columns[:6], rows.column(0), none, none], names=names)
                texts = rows.column(6).to_pylist()
                whole, sizes = "".join(texts), np.array([len(t) for t in texts], np.int64)
                if not whole:
                    continue
                old, base = (rows.column(k).to_numpy() for k in (7, 8))
                starts, ends = (np.frombuffer(b"".join(rows.column(k).to_pylist()), np.int32) for k in (9, 10))
                begins = np.cumsum(sizes) - sizes
                for n, i, of in passing(sieve.words, sieve.lengths, whole, sizes):
                    new = i - begins[of] + n > old[of]
                    i, of = i[new], of[new]
                    stretches = pa.array([whole[x : x + n] for x in i.tolist()], pa.string())
                    take = pa.array(of)
                    of_message = [rows.column(k).take(take) for k in (0, 1, 2)] + [pa.nulls(len(i), pa.string())] + [rows.column(k).take(take) for k in (4, 5)]
                    yield pa.RecordBatch.from_arrays([*of_message, stretches, *[pa.array(base[of] + x) for x in (starts[i], ends[i + n - 1])]], names=names)

    return sift


def _met(stretches: DataFrame, known: DataFrame) -> DataFrame:
    """Lines as they are, and stretches that are keys with candidates left, by one join of both."""
    keys = known.select(F.col("surface_key").alias("_key"), "surface_id", "shard_id", "candidates")
    met = stretches.join(keys.hint("merge"), F.col("line").isNull() & (F.col("surface_key") == F.col("_key")), "left")
    listed = F.filter("candidates", lambda c: F.col("disambiguations") | ~F.coalesce(c["disambiguation"], F.lit(False)))
    kept = met.withColumn("_qids", F.slice(listed, F.lit(1), F.col("most"))).where(F.col("line").isNotNull() | (F.size("_qids") > 0))
    qids = F.transform("_qids", lambda c: F.struct(c["qid"].alias("qid"), c["qid_number"].alias("qid_number"), c["disambiguation"].alias("disambiguation")))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("start", "end", "surface_id", "shard_id")]
    return kept.select("session_id", "seq", "n", "line", *numbers, F.to_json(qids, {"ignoreNullFields": "false"}).alias("qids"))


#: The order of ``_met`` rows of a session: messages, in each its matches, then its line.
_ORDER = ["n", "closing", "start", "end", "surface_id"]


@dataclass
class _Count:
    """Answers of one session from ``_met`` rows in order: matches are numbered in their message and counted in their text."""

    matches: int = 0
    part: int = 0

    def answered(self, who: str, seq: int, line: str | None, start: int, end: int, sid: int, shard: int, qids: str | None) -> tuple:
        part = self.part
        if line is None:
            self.part, self.matches = part + 1, self.matches + 1
            line = json.dumps({"type": "match", "match": {"start": start, "end": end, "surface_id": sid, "shard_id": shard, "qids": json.loads(qids)}}, ensure_ascii=False)
            return who, seq, part, line
        self.part = 0
        if line == _DONE:
            line = json.dumps({"type": "done", "stats": {"matches": self.matches}})
            self.matches = 0
        elif line in (_STARTED, interrupted("idle")):
            self.matches = 0
        return who, seq, part, line


class _Counting(StatefulProcessor):
    """``_Count`` on a stream: the state of a session is its count, kept while it isn't 0."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.matches = handle.getValueState("matches", "matches long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        answer_row = Row(*_names(OUTPUT))
        ordered = sorted(rows, key=lambda r: (r[2], r[3] is not None, *r[4:7]))  # as _ORDER
        before = self.matches.get() if ordered[0][2] else None
        counted = _Count(before[0] if before else 0)
        for r in ordered:
            yield answer_row(*counted.answered(key[0], r[1], *r[3:]))
        if counted.matches:
            self.matches.update((counted.matches,))
        elif before:
            self.matches.clear()

    def close(self) -> None:
        pass


def _sieve(known: DataFrame):
    """The filter for the executors: of ``BITS_A_KEY`` bits a key, less where it would take more than ``FILTER_BYTES``; then more stretches move, and the join denies them."""
    keys = known.where("surface_key != ''").select("surface_key")
    n, lengths = keys.agg(F.count("*"), F.collect_set(F.length("surface_key"))).first()
    words = min(max(16, math.ceil(n * 1.05 * BITS_A_KEY / 64)), FILTER_BYTES // 8)
    return known.sparkSession.sparkContext.broadcast(_Sieve(key_filter(keys, words), sorted(lengths)))


def _taken(dictionary: DataFrame, method: str) -> tuple[DataFrame, bool]:
    """The dictionary written once, and whether it is for a join."""
    known = materialize(dictionary.select("surface_key", "surface_id", "shard_id", "candidates"), "stream-dictionary")
    return known, method == "join" or method == "auto" and known.count() > BROADCAST_KEYS


def match_stream(messages: DataFrame, dictionary: DataFrame, idle: str | None = None, method: str = "auto") -> DataFrame:
    """Answers to a stream of (``session_id`` string, ``seq`` long, ``payload`` string): ``session_id``, ``seq``, ``part`` (order of the answers to one message), ``line`` (JSON).

    Messages of a session are taken by ``seq`` within a micro-batch and batch after batch; the state of a session is the end of its text, no longer than
    the longest key, its offsets, options and count. It is removed when the session's text has ended and it has no options, and, if ``idle`` is given, after so
    much processing time without a message, which is answered by an interruption (``seq`` -1); a stream with a timeout runs until it is stopped, so none is
    set by default. Null sessions are left out.

    ``auto`` takes the automaton up to ``BROADCAST_KEYS`` keys, else the join, for which each micro-batch reads the dictionary and the count is a state of its
    own; a checkpoint is of one of the two, so where a dictionary may grow past that name the ``method``.
    """
    known, join = _taken(dictionary, method)
    messages = messages.where("session_id is not null")
    wait = idle and int(pd.Timedelta(idle).total_seconds() * 1000)
    if not join:
        return _stepped(messages, OUTPUT, _lookup(known), _ready, Session, _answers, (0, interrupted("idle")), wait)
    sent = _sieve(known)
    gone = (1, interrupted("idle"), True, _MOST, "", 0, 0, b"", b"")
    windows = _stepped(messages, _WINDOWS, sent, lambda sent: sent.value, _Windowed, _window, gone, wait)

    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    met = _met(windows.mapInArrow(_sifted(sent), _STRETCHES), known)
    return met.groupBy("session_id").transformWithState(_Counting(), OUTPUT, "append", "none")


def _stepped(messages: DataFrame, schema: str, sent, ready: Callable, kind: type[Session], respond: Callable, gone: tuple, wait: int | None) -> DataFrame:
    """What ``respond`` makes of each message of a stream and the state of its session; ``gone`` ends the row of a session that timed out."""
    names = _names(schema)

    def step(key, parts: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], -1, *gone)], columns=names)
            return
        lookup = ready(sent)
        session, first = (_restored(state.get, kind), 1) if state.exists else (kind(), 0)
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        out = [row for n, (seq, payload) in enumerate(zip(rows["seq"], rows["payload"]), first) for row in respond(key[0], seq, n, session, payload, lookup)]
        if not session.closed:
            state.update(_stored(session))
            if wait:
                state.setTimeoutDuration(wait)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    return messages.groupBy("session_id").applyInPandasWithState(step, schema, STATE, "append", "ProcessingTimeTimeout" if wait else "NoTimeout")


def match_sessions(messages: DataFrame, dictionary: DataFrame, method: str = "auto") -> DataFrame:
    """The same answers for messages that are all there: each session's messages pass through one task in order, never held together."""
    known, join = _taken(dictionary, method)
    ordered = messages.where("session_id is not null").select("session_id", "seq", "payload").repartition("session_id").sortWithinPartitions("session_id", "seq")
    if not join:
        return ordered.mapInArrow(_replayed(OUTPUT, _lookup(known), _ready, Session, _answers), OUTPUT)
    sent = _sieve(known)
    windows, sift = _replayed(_WINDOWS, sent, lambda sent: sent.value, _Windowed, _window), _sifted(sent)
    met = _met(ordered.mapInArrow(lambda batches: sift(windows(batches)), _STRETCHES), known).withColumn("closing", F.col("line").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counted = None, _Count()
        for batch in batches:
            out = []
            for who, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if who != current:
                    current, counted = who, _Count()
                out.append(counted.answered(who, *row))
            yield _record(out, OUTPUT)

    columns = ["session_id", "seq", "line", "start", "end", "surface_id", "shard_id", "qids"]
    return met.repartition("session_id").sortWithinPartitions("session_id", *_ORDER).select(*columns).mapInArrow(count, OUTPUT)


def _replayed(schema: str, sent, ready: Callable, kind: type[Session], respond: Callable) -> Callable:
    """What ``respond`` makes of messages that come by session, in order."""

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, current, session, n = ready(sent), None, kind(), 0
        for batch in batches:
            out = []
            for who, seq, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if who != current:
                    current, session = who, kind()
                out += respond(who, seq, n, session, payload, lookup)
                n += 1
            if out:
                yield _record(out, schema)

    return replay


_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(_names(schema))
    kinds = [_KINDS[c.split()[1]] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_names(schema))


def chunks_of(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 100) -> DataFrame:
    """Documents as messages: a start, chunks of ``size`` code points, an end."""
    message = lambda **x: F.to_json(F.struct(*[v.alias(k) for k, v in x.items()]))
    whole = F.coalesce(F.col(text), F.lit(""))
    n = F.ceil(F.length(whole) / size).cast("int")
    chunks = F.transform(F.sequence(F.lit(1), n), lambda i: message(type=F.lit("chunk"), text=F.substring(whole, (i - 1) * size + 1, F.lit(size))))
    parts = F.concat(F.array(message(type=F.lit("start"))), F.when(n > 0, chunks).otherwise(F.array()), F.array(message(type=F.lit("end"))))
    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("session_id"), F.posexplode(parts).alias("seq", "payload")).withColumn("seq", F.col("seq").cast("long"))
