"""Subject areas of documents, from topic models and the terms that stand for a subject."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm import topics as lda
from corpuscle.llm.lookalike import pieces_of
from corpuscle.session import scratch, small, spread

#: Documents a term must occur in to be looked at.
LEAST_DOCS = 4
#: The model is fitted on at most so many terms, the most frequent ones of at most this share of the documents; all others are placed by the documents they stand in.
MODEL_TERMS, MOST_SHARE = 50_000, 0.2
#: Topics a subject, and topics that no label starts.
EACH, BACKGROUND = 2, 10
#: Top terms of a topic that are inspected, and the share of them, by how telling they are, that must speak for a subject, and be twice what chance gives it.
TOP, OF_TOP = 30, 0.3
#: A term is struck from a subject if labelled documents say that surely less than this share of it, or than so many times the subject's share of all, is of the subject.
STRUCK, STRUCK_TIMES = 0.2, 2.5
#: Share of a modelled term that must fall to a subject's topics; share of the subject in the rest of the documents a term stands in (also as a multiple of the usual share), more for terms outside the model.
OWNED, BELONGS, TIMES, BELONGS_REST = 0.22, 0.12, 2.5, 0.3
#: Where subjects are so few that the usual share is high, multiples of it ask for no more than this.
ENOUGH = 0.35
#: How much of its share among a modelled term's subjects a subject must keep in the rest of its documents.
AGREES = 0.6
#: A term belongs to no other subject from this share of all its subjects on.
ALONE = 0.75
#: Words that the topic proportions must give a subject in a sentence.
LEAST_WORDS = 0.9
#: Terms of subjects that are sent to the executors as arrays; more meet the sentences by a join.
MOST_THINGS = 500_000
NONE = "none"

_WORD = re.compile(r"[^\W\d_]{2,}")
_SENTENCE = re.compile(r"[.!?。！？…]+(?=\s|$)|(?<=[。！？])")


class _Fold(dict):
    def __missing__(self, c: int) -> str:
        self[c] = kept = pieces_of(chr(c)) or ""
        return kept


_FOLD = _Fold()


def sentences_of(text: str, cut: int | None) -> list[list[list[str]]]:
    """The words of each sentence, by side: a text is cut before character ``cut`` if that lies in it."""
    sides = [text[:cut], text[cut:]] if cut is not None and 0 < cut < len(text) else [text]
    clean = lambda s: unicodedata.normalize("NFC", s if s.isascii() else s.translate(_FOLD))
    return [[w for s in _SENTENCE.split(clean(side)) if (w := _WORD.findall(s))] for side in sides]


def _cut(docs: DataFrame):
    return F.col("tgt_start").cast("int") if "tgt_start" in docs.columns else F.lit(None).cast("int")


class _Tokens(dict):
    """Word -> twice a 62-bit code of its small letters, plus 1 if it is in small letters; ``terms`` leads back from codes."""

    MOST = 300_000

    def __init__(self) -> None:
        self.terms: dict[int, str] = {}

    def __missing__(self, word: str) -> int:
        small = word.lower()
        code = term_code(small)
        self.terms[code] = small
        self[word] = token = 2 * code + (small == word)
        return token

    def shrink(self) -> None:
        if len(self) > self.MOST:
            self.clear()
            self.terms.clear()


def term_code(term: str) -> int:
    return int.from_bytes(hashlib.blake2b(term.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 2


def encode(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts as codes, from one pass over them, written to the shared folder.

    First (``uid``, ``doc_id``, ``sents``): the codes of the words of each sentence. Second (``code``, ``term``, ``n``, ``n_small``, ``n_both``): of each
    lower-case word the documents with it, those where it stands in small letters, and those where both sides have it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"kind int, uid long, doc_id {kind}, sents array<array<long>>, term struct<code: long, term: string, n: long, n_small: long, n_both: long>"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        uid = TaskContext.get().partitionId() << 33
        sents_type = pa.list_(pa.list_(pa.int64()))
        term_type = pa.struct([("code", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("n_small", pa.int64()), ("n_both", pa.int64())])
        names = ["kind", "uid", "doc_id", "sents", "term"]
        for batch in batches:
            tokens.shrink()
            flat, words, sides, sentences = [], [0], [], [0]
            for text, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for k, side in enumerate(sentences_of(text, cut)):
                    for s in side:
                        flat.extend(map(tokens.__getitem__, s))
                        words.append(len(flat))
                        sides.append(k)
                sentences.append(len(sides))
            flat = np.array(flat, np.int64)
            n, codes = batch.num_rows, flat >> 1
            sents = pa.ListArray.from_arrays(pa.array(sentences, pa.int32()), pa.ListArray.from_arrays(pa.array(words, pa.int32()), pa.array(codes)))
            ids = np.arange(uid, uid + n)
            uid += n
            nothing = pa.nulls(n, term_type)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(ids), batch.column(0), sents, nothing], names=names)
            known, inverse = np.unique(codes, return_inverse=True)
            if not len(known):
                continue
            of = np.repeat(np.arange(len(sides)), np.diff(words))
            row = np.repeat(np.arange(n), np.diff(sentences))[of]
            held = row * len(known) + inverse
            second = np.array(sides, np.int64)[of] > 0
            each = (np.unique(held), np.unique(held[(flat & 1) == 1]), np.intersect1d(held[~second], held[second]))
            counts = [pa.array(np.bincount(x % len(known), minlength=len(known))) for x in each]
            term = pa.StructArray.from_arrays([pa.array(known), pa.array([tokens.terms[c] for c in known.tolist()], pa.string()), *counts], fields=list(term_type))
            k = len(known)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, batch.column(0).type), pa.nulls(k, sents_type), term], names=names)

    path = scratch(docs.sparkSession, "encoded")
    spread(docs.where("text is not null").select("doc_id", "text", _cut(docs).alias("cut"))).mapInArrow(code, schema).write.partitionBy("kind").parquet(path)
    rows = docs.sparkSession.read.schema(schema).parquet(path)
    terms = rows.where("kind = 1").select("term.*").groupBy("code").agg(F.min("term").alias("term"), *[F.sum(c).alias(c) for c in ("n", "n_small", "n_both")])
    return rows.where("kind = 0").select("uid", "doc_id", "sents"), terms


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of sentences of words: the words, each word's sentence, each sentence's row."""
    rows = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    sents = column.flatten()
    words = sents.flatten().to_numpy(zero_copy_only=False)
    return words, np.repeat(np.arange(len(sents)), sents.value_lengths().to_numpy(zero_copy_only=False)), rows


def is_name(n, n_small, n_both):
    """Whether a term is a name, by its counts (columns or arrays): in capitals wherever it occurs, and equal on both sides of pairs; rare terms may stray by a standard error."""
    root = n**0.5
    return (n_small < 0.1 * n + 0.3 * root) & (n_both >= 0.4 * n - 0.49 * root) & (n_both > 0)


@dataclass
class Model:
    """The fitted topics: codes of the terms in ascending order with their texts, weights and topic parameters, and the class each topic is mapped to (the last is none)."""

    subjects: list[str]
    codes: np.ndarray
    terms: list[str]
    weights: np.ndarray
    lam: np.ndarray
    of_topic: np.ndarray
    struck: np.ndarray

    def owned(self) -> np.ndarray:
        """By term and subject: the share that falls to the subject's topics, without what is struck."""
        share = (self.classes().T @ self.lam / self.lam.sum(0)).T[:, : len(self.subjects)]
        return np.where(self.struck, 0.0, share)

    def classes(self) -> np.ndarray:
        return np.eye(len(self.subjects) + 1)[self.of_topic]

    def top_terms(self, n: int = TOP) -> np.ndarray:
        """By topic the terms that tell it most from the others, first the most telling."""
        return np.argsort(-telling(self.lam), axis=1, kind="stable")[:, :n]

    def looked_up(self, words: np.ndarray) -> np.ndarray:
        """The number of each word's term, -1 outside the model."""
        return look_up(self.codes, words)


def look_up(codes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The places of ``words`` in the ascending ``codes``, -1 where they aren't."""
    if not len(codes):
        return np.full(len(words), -1)
    at = np.searchsorted(codes, words).clip(max=len(codes) - 1)
    return np.where(codes[at] == words, at, -1)


def telling(lam: np.ndarray) -> np.ndarray:
    inside = lam / lam.sum(1, keepdims=True)
    return inside * np.log(inside / (lam.sum(0) / lam.sum()))


def _distinct(row: np.ndarray, at: np.ndarray, n: int) -> tuple[pa.ListArray, np.ndarray]:
    """Of numbers and their rows: the distinct numbers of each of ``n`` rows, and the key (row and number) of each."""
    pairs = np.unique(row.astype(np.int64) << 32 | at)
    ends = np.searchsorted(pairs >> 32, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs & 0xFFFFFFFF, pa.int32())), pairs


def modelled_words(sents: DataFrame, codes: np.ndarray, parts: int = lda.PARTS) -> DataFrame:
    """(``doc_id``, ``words``, ``part``): each document's distinct terms of the model, by their place in ``codes``, and its part of the corpus; written by part."""
    sent = sents.sparkSession.sparkContext.broadcast(codes)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, of, row = _flat(batch.column(1))
            at = look_up(sent.value, words)
            lists, _ = _distinct(row[of[at >= 0]], at[at >= 0], batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "words"])

    kind = sents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, words array<int>"
    path = scratch(sents.sparkSession, "features")
    words = sents.select("doc_id", "sents").mapInArrow(look, schema)
    words.withColumn("part", F.pmod(F.xxhash64("doc_id", "words"), F.lit(parts)).cast("int")).write.partitionBy("part").parquet(path)
    return sents.sparkSession.read.schema(schema + ", part int").parquet(path)


def label_counts(features: DataFrame, marks: DataFrame, n_terms: int, n_classes: int) -> np.ndarray:
    """Labelled documents by class and modelled term; one with several labels counts in parts."""
    marked = features.join(small(marks)[0], "doc_id").select("words", "labels", (1 / F.size("labels")).alias("each"))
    pairs = marked.select("labels", "each", F.explode("words").alias("t")).select("t", "each", F.explode("labels").alias("c"))
    got = pairs.groupBy("t", "c").agg(F.sum("each").alias("n")).toPandas()
    counts = np.zeros((n_classes, n_terms))
    counts[got.c.to_numpy(), got.t.to_numpy()] = got.n.to_numpy()
    return counts


def wilson(hits: np.ndarray, total: np.ndarray, z: float) -> np.ndarray:
    """The bound of a share that lies ``z`` standard errors up (down if negative); 1 (0) of nothing."""
    n = np.maximum(total, 1e-9)
    p = hits / n
    bound = (p + z * z / (2 * n) + z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return np.where(total > 0, bound, float(z > 0))


def fit_model(sents: DataFrame, terms: DataFrame, asked: DataFrame, subjects: list[str], model_terms: int = MODEL_TERMS, each: int = EACH, background: int = BACKGROUND, seed: int = 11) -> Model | None:
    """The topics of all documents, each subject's mapped to it by their top terms; None with fewer terms than topics.

    Labelled documents give the topics of a subject their first terms, and inspect the result: a topic is mapped to the
    subject its top terms speak for, whichever it began with, and terms that labelled documents surely do not hold for the subject's are struck from it.
    """
    n_docs = sents.count()
    n, rare = F.col("n"), (F.col("n") <= MOST_SHARE * n_docs) | (F.col("n") < 50)
    vocabulary = terms.where((n >= LEAST_DOCS) & rare & ~is_name(n, F.col("n_small"), F.col("n_both"))).orderBy(F.desc("n"), "code").limit(model_terms).toPandas()
    vocabulary = vocabulary.sort_values("code", ignore_index=True)
    n_topics, v, s = each * len(subjects) + background, len(vocabulary), len(subjects)
    if v < n_topics or not s:
        return None
    codes, held = vocabulary.code.to_numpy(np.int64), vocabulary.n.to_numpy(float)
    classes = [*subjects, NONE]
    marks = asked.groupBy("doc_id").agg(F.transform(F.collect_set("subject"), lambda x: F.array_position(F.lit(classes), x).cast("int") - 1).alias("labels"))
    features = modelled_words(sents, codes)
    marked = label_counts(features, marks, v, s + 1)
    total, base = marked.sum(0), (marked.sum(1) + 1) / (marked.sum() + s + 1)

    weights = np.log(n_docs / held).clip(0.1)
    weights /= weights.mean()
    surely = np.minimum(wilson(marked, total, -1) / base[:, None], 20) + 0.1
    surely[-1] = 1
    start = [surely[k % s if k < each * s else s] for k in range(n_topics)]
    noise = np.random.default_rng(seed).gamma(10, 0.1, (n_topics, v))
    lam, _ = lda.fit(features, weights, held / held.mean() * np.stack(start) * noise * n_docs / n_topics / 20 + lda.ETA)

    lift = (marked + 3 * base[:, None]) / (total + 3) / base[:, None]
    top = np.argsort(-telling(lam), axis=1, kind="stable")[:, :TOP]
    weigh = np.take_along_axis(telling(lam), top, 1).clip(1e-12)
    said = (lift[:, top] / lift[:, top].sum(0) * weigh).sum(2) / weigh.sum(1)
    of_topic = np.where((said.argmax(0) < s) & (said.max(0) >= max(OF_TOP, 2 / (s + 1))), said.argmax(0), s)
    struck = wilson(marked[:s], total, 2) < np.maximum(np.minimum(STRUCK_TIMES * base[:s, None], ENOUGH), STRUCK)
    return Model(subjects, codes, vocabulary.term.tolist(), weights, lam, of_topic, struck.T)


class _Proportions:
    """A model made ready on an executor."""

    def __init__(self, model: Model) -> None:
        self.model, self.beta, self.classes = model, lda.expected(model.lam), model.classes()

    def of_words(self, words: np.ndarray, of: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct modelled terms of each sentence: their sentences, terms, and by class the share of each that its document's topic proportions give."""
        at = self.model.looked_up(words)
        pairs = np.unique(of[at >= 0].astype(np.int64) << 32 | at[at >= 0])
        of, at = pairs >> 32, pairs & 0xFFFFFFFF
        lists, keys = _distinct(row[of], at, n_rows)
        shares = lda.class_shares(lists, self.beta, self.model.weights, self.classes)
        return of, at, shares[np.searchsorted(keys, row[of].astype(np.int64) << 32 | at)]


def rest_shares(sents: DataFrame, model: Model) -> DataFrame:
    """(``code``, ``n_sents``, ``s0`` ...): of every term, modelled or not, the sum by class of what the topic proportions say of the rest of the documents it stands in.

    The rest of a document are its other sentences, so that words that only stand together don't speak for each other. Code -1 sums over all sentences.
    """
    sent = sents.sparkSession.sparkContext.broadcast(model)
    c = len(model.subjects) + 1
    names = ["code", "n_sents", *[f"s{k}" for k in range(c)]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = _Proportions(sent.value)
        for batch in batches:
            words, of, row = _flat(batch.column(0))
            if not len(words):
                continue
            sentence, term, share = ready.of_words(words, of, row, batch.num_rows)
            mass, whole = np.zeros((len(row), c)), np.zeros((batch.num_rows, c))
            for k in range(c):
                mass[:, k] = np.bincount(sentence, share[:, k] * ready.model.weights[term], minlength=len(row))
                whole[:, k] = np.bincount(row, mass[:, k], minlength=batch.num_rows)
            others = np.maximum(whole[row] - mass, 0)
            total = others.sum(1)
            known = total > 0.5
            others /= np.maximum(total, 1e-9)[:, None]
            codes, inverse = np.unique(words, return_inverse=True)
            pairs = np.unique(of.astype(np.int64) * len(codes) + inverse)
            s, t = pairs // len(codes), pairs % len(codes)
            s, t = s[known[s]], t[known[s]]
            sums = [np.bincount(t, others[s, k], minlength=len(codes)) for k in range(c)]
            n = np.bincount(t, minlength=len(codes)).astype(float)
            columns = [np.append(n, known.sum()), *[np.append(x, others[known, k].sum()) for k, x in enumerate(sums)]]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(codes, -1)), *[pa.array(x) for x in columns]], names=names)

    schema = "code long, " + ", ".join(f"{x} double" for x in names[1:])
    return sents.select("sents").mapInArrow(count, schema).groupBy("code").agg(*[F.sum(x).alias(x) for x in names[1:]])


def subject_terms(sents: DataFrame, terms: DataFrame, model: Model) -> DataFrame:
    """(``code``, ``share``, ``n``): the terms that stand for things of subjects; ``share`` has their share by subject, 0 where they don't belong.

    A modelled term belongs where its topics and the rest of its documents say so, one outside the model where the rest of its documents says so more strongly.
    """
    spark, s = sents.sparkSession, len(model.subjects)
    path = scratch(spark, "rest")
    rest_shares(sents, model).write.parquet(path)
    rest = spark.read.parquet(path)
    of_all = rest.where("code = -1").first()
    if of_all is None or not of_all["n_sents"]:
        return spark.createDataFrame([], "code long, share array<double>, n long")
    base = np.array([of_all[f"s{k}"] for k in range(s + 1)]) / of_all["n_sents"]
    owned = spark.createDataFrame(list(zip(model.codes.tolist(), model.owned().tolist())), "code long, owned array<double>")
    asked = terms.where((F.col("n") >= LEAST_DOCS) & ~is_name(F.col("n"), F.col("n_small"), F.col("n_both"))).select("code", "n")
    joined = asked.join(rest, "code").join(F.broadcast(owned), "code", "left").select("code", "n", "n_sents", F.array(*[f"s{k}" for k in range(s)]).alias("sums"), "owned")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            around = (np.array(batch.column(3).to_pylist(), float).reshape(n, s) + 3 * base[:s]) / (batch.column(2).to_numpy() + 3)[:, None]
            own = np.array([x or [np.nan] * s for x in batch.column(4).to_pylist()], float).reshape(n, s)
            outside = np.isnan(own)
            inside = lambda x: x / np.maximum(x.sum(1, keepdims=True), 1e-9)
            own_says = outside | (own >= OWNED) & (inside(around) >= AGREES * inside(own))
            belongs = own_says & (around >= np.minimum(TIMES * base[:s], ENOUGH)) & (around >= 1.5 * base[:s]) & (around >= np.where(outside, BELONGS_REST, BELONGS))
            share = np.where(belongs, np.where(outside, around, own), 0)
            share /= np.maximum(share.sum(1, keepdims=True), 1e-9)
            mine = np.flatnonzero(belongs.any(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(mine)), pa.array(share[mine].tolist(), pa.list_(pa.float64())), batch.column(1).take(pa.array(mine))], names=["code", "share", "n"])

    path = scratch(spark, "things")
    joined.mapInArrow(decide, "code long, share array<double>, n long").write.parquet(path)
    return spark.read.schema("code long, share array<double>, n long").parquet(path)


@dataclass
class Things:
    """Terms of subjects in ascending order of their codes, with the thing each stands for and its shares by subject."""

    codes: np.ndarray
    units: np.ndarray
    shares: np.ndarray

    @classmethod
    def of(cls, rows: DataFrame, n_subjects: int) -> Things:
        got = rows.toPandas().sort_values("code", ignore_index=True)
        return cls(got.code.to_numpy(np.int64), got.unit.to_numpy(np.int64), np.array(got.share.tolist(), float).reshape(len(got), n_subjects))


def _marks(column: pa.ListArray, things: Things | None, marks: pa.ListArray | None, n_subjects: int) -> tuple[np.ndarray, ...]:
    """The terms of subjects in sentences, in order: sentence (of the batch), place in it, code, unit, shares; looked up in ``things``, else from the joined ``marks``."""
    if things is not None:
        words, of, _ = _flat(column)
        at = look_up(things.codes, words)
        hit = np.flatnonzero(at >= 0)
        first = np.searchsorted(of, of[hit])
        return of[hit], hit - first, words[hit], things.units[at[hit]], things.shares[at[hit]]
    before = np.cumsum(np.append(0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    n = marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = marks.flatten()
    of = before[np.repeat(np.arange(len(column)), n)] + flat.field("s").to_numpy(zero_copy_only=False)
    shares = np.array(flat.field("share").to_pylist(), float).reshape(len(flat), n_subjects)
    return of, *[flat.field(x).to_numpy(zero_copy_only=False) for x in ("at", "code", "unit")], shares


def _with_marks(sents: DataFrame, units: DataFrame) -> DataFrame:
    """``sents`` with ``marks``, the terms of subjects each holds, by a join on the term: for more of them than executors should hold."""
    spread = sents.select("uid", F.posexplode("sents").alias("s", "_words")).select("uid", "s", F.posexplode("_words").alias("at", "code"))
    held = spread.join(units, "code").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("s", "at", "code", "unit", "share"))).alias("marks"))
    return sents.join(held, "uid", "left")


def neighbours(rows: DataFrame, things: Things | None, n_subjects: int) -> DataFrame:
    """(``a``, ``b``, ``k``): how often two terms of subjects follow each other with at most one word between, over all sentences."""
    sent = rows.sparkSession.sparkContext.broadcast(things)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, at, code, _, _ = _marks(batch.column(0), sent.value, batch.column(1) if batch.num_columns > 1 else None, n_subjects)
            found = []
            for gap in (1, 2):
                near = (of[:-gap] == of[gap:]) & (at[gap:] - at[:-gap] <= 2) & (code[:-gap] != code[gap:])
                found.append(np.stack([code[:-gap][near], code[gap:][near]]))
            pairs, k = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(k.astype(np.int64))], names=["a", "b", "k"])

    columns = ["sents"] if things is not None else ["sents", "marks"]
    return rows.select(*columns).mapInArrow(count, "a long, b long, k long").groupBy("a", "b").agg(F.sum("k").alias("k"))


def with_units(things: DataFrame, pairs: DataFrame) -> DataFrame:
    """``things`` with ``unit``, the least code among the terms bound to each other; all pairs that are bound count, and links over several terms are followed for three steps.

    Two terms are bound if they follow each other in at least half of the documents of the more frequent one, or in 0.8 of the rarer one's and 0.3 of the other's.
    """
    held = lambda c, n: things.select(F.col("code").alias(c), F.col("n").alias(n))
    most, least = F.greatest("na", "nb"), F.least("na", "nb")
    bound = pairs.join(held("a", "na"), "a").join(held("b", "nb"), "b").where((F.col("k") >= 0.5 * most) | (F.col("k") >= 0.8 * least) & (F.col("k") >= 0.3 * most))
    links = bound.select("a", "b").unionByName(bound.select(F.col("b").alias("a"), F.col("a").alias("b")))
    units = things.withColumn("unit", F.col("code"))
    for _ in range(3):
        other = links.join(units.select(F.col("code").alias("b"), F.col("unit").alias("_u")), "b").groupBy(F.col("a").alias("code")).agg(F.min("_u").alias("_u"))
        units = units.join(other, "code", "left").select("code", "share", "n", F.least("unit", "_u").alias("unit"))
    return units


def assign(rows: DataFrame, model: Model, things: Things | None) -> DataFrame:
    """(``doc_id``, ``subject``) by the topic proportions of each document, sentence by sentence.

    A sentence has the subjects to whose topics its document's proportions give at least ``LEAST_WORDS`` of its words. Then the exact check: it must hold two or more
    things of the subject, one of them of no other subject, or more things of it than of any other.
    """
    sent = rows.sparkSession.sparkContext.broadcast((model, things))
    s = len(model.subjects)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, things = sent.value
        ready = _Proportions(model)
        for batch in batches:
            words, of, row = _flat(batch.column(1))
            sentence, _, share = ready.of_words(words, of, row, batch.num_rows)
            place, _, code, unit, shares = _marks(batch.column(1), things, batch.column(2) if batch.num_columns > 2 else None, s)
            given, held, sole = np.zeros((len(row), s)), np.zeros((len(row), s), np.int64), np.zeros((len(row), s), bool)
            beyond = model.looked_up(code) < 0
            units, number = np.unique(unit, return_inverse=True)
            for k in range(s):
                given[:, k] = np.bincount(sentence, share[:, k], minlength=len(row)) + np.bincount(place[beyond], shares[beyond, k], minlength=len(row))
                mine = shares[:, k] > 0
                held[:, k] = np.bincount(np.unique(place[mine] * max(1, len(units)) + number[mine]) // max(1, len(units)), minlength=len(row))
                sole[:, k] = np.bincount(place[mine], shares[mine, k] >= ALONE, minlength=len(row)) >= 1
            ranked = np.sort(np.pad(held, ((0, 0), (1, 0))), axis=1)
            elsewhere = np.where(held == ranked[:, -1:], ranked[:, -2:-1], ranked[:, -1:])
            at, subject = np.nonzero((given >= LEAST_WORDS) & (held >= 2) & (sole | (held > elsewhere)))
            found = np.unique(row[at] * s + subject)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found // s)), pa.array([model.subjects[k] for k in (found % s).tolist()], pa.string())], names=["doc_id", "subject"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "sents"] if things is not None else ["doc_id", "sents", "marks"]
    return rows.select(*columns).mapInArrow(look, f"doc_id {kind}, subject string").where("doc_id is not null").distinct()


def _asked(labels: DataFrame) -> tuple[DataFrame, list[str]]:
    asked = labels.where("doc_id is not null and subject is not null").select("doc_id", "subject").distinct()
    return asked, sorted(r.subject for r in asked.select("subject").distinct().collect() if r.subject != NONE)


def document_subjects(docs: DataFrame, labels: DataFrame, model_terms: int = MODEL_TERMS, most_things: int = MOST_THINGS) -> DataFrame:
    """(``doc_id``, ``subject``) of the subjects each document is about: at least one sentence deals with two or more things of the subject.

    Works in any mixture of languages whose words occur beside each other in documents. Subjects are those of ``labels``
    (``doc_id``, ``subject``; ``none`` for documents without), which may be few and partly wrong; without labels, or with too few
    terms to model, the result is empty. Null ids, and null, empty or wordless texts, give no row, a repeated row counts once more in the
    corpus and once in the result. Columns other than ``doc_id``, ``text`` and, if there, ``tgt_start`` are ignored.

    Method: a latent Dirichlet model is fitted by online steps over all documents, in as many passes at every size; the topics of
    a subject start from its labelled documents, and each topic is mapped to the subject its top terms speak for. The topic
    proportions of a document give each of its words to subjects. Subjects are assigned where the words given to one
    subject within a sentence are enough, as a single sentence decides; that these are two different things of it is then checked exactly.
    A thing is a term that the topics of the subject own and that stands in documents whose other sentences are of the subject;
    words bound to each other ("interest rates") are one thing, names (in capitals wherever they occur, and equal on both sides of a pair) are none.
    The model holds the ``model_terms`` most frequent terms; all others, however rare or frequent, are placed by the proportions of the documents they
    stand in, as a table on the executors. Texts are read once, their codes four times, the terms of the model ``topics.PASSES`` times.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked, subjects = _asked(labels)
    sents, terms = encode(docs)
    model = fit_model(sents, terms, asked, subjects, model_terms)
    if model is None:
        return spark.createDataFrame([], f"doc_id {kind}, subject string")
    things = subject_terms(sents, terms, model)
    s = len(subjects)
    fits = things.limit(most_things + 1).count() <= most_things
    if fits:
        plain = Things.of(things.withColumn("unit", F.col("code")), s)
        return assign(sents, model, Things.of(with_units(things, neighbours(sents, plain, s)), s))
    bare = _with_marks(sents, things.withColumn("unit", F.col("code")))
    return assign(_with_marks(sents, with_units(things, neighbours(bare, None, s))), model, None)


def topic_terms(docs: DataFrame, labels: DataFrame, n: int = TOP) -> DataFrame:
    """(``topic``, ``subject``, ``rank``, ``term``, ``kept``): the top terms of each topic, the subject it is mapped to (``none`` if to no one), and whether labelled documents let the term stand."""
    spark = docs.sparkSession
    asked, subjects = _asked(labels)
    sents, terms = encode(docs)
    model = fit_model(sents, terms, asked, subjects)
    rows = []
    if model is not None:
        for k, top in enumerate(model.top_terms(n).tolist()):
            c = int(model.of_topic[k])
            name = [*subjects, NONE][c]
            rows += [(k, name, i, model.terms[t], c == len(subjects) or not bool(model.struck[t, c])) for i, t in enumerate(top, 1)]
    return spark.createDataFrame(rows, "topic int, subject string, rank int, term string, kept boolean")


def subject_counts(assigned: DataFrame) -> DataFrame:
    """Documents per subject."""
    return assigned.groupBy("subject").agg(F.count("*").alias("n_docs"))
