import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import subjects, topics

N = 600


def test_digamma():
    for x, want in ((0.02, -50.5447893), (0.1, -10.4237549), (1.0, -0.5772157), (2.5, 0.7031566), (300.0, 5.7021149)):
        assert topics.digamma(np.array([x]))[0] == pytest.approx(want, abs=1e-6)


def start(terms, k=4, seed=1):
    return np.random.default_rng(seed).gamma(10, 0.1, (k, terms))


@pytest.fixture(scope="module")
def docs(spark):
    """Each document has a word of its own, one of its kind and, every tenth, none at all."""
    rows = [(i, [[N + i % 4, i]] if i % 10 else []) for i in range(N)]
    sents = spark.createDataFrame(rows, "doc_id long, sents array<array<long>>")
    return subjects.modelled_words(sents, np.arange(N + 4))


def test_every_pass_visits_every_document(docs):
    assert docs.groupBy().agg(F.count_distinct("part")).first()[0] == topics.PARTS
    first = start(N + 4)
    fitted, seen = topics.fit(docs, np.full(N + 4, 5.0), first, passes=1)
    assert len(seen) == topics.PARTS and sum(seen) == N - N // 10
    # What the words would weigh if nothing had held them: so it is for those of the empty documents alone.
    left_out = first
    for step in range(topics.PARTS):
        rate = (topics.OFFSET + step + 1) ** -topics.DECAY
        left_out = (1 - rate) * left_out + rate * topics.ETA
    gained = (fitted - left_out).sum(0)[:N] > 0.1
    assert gained.tolist() == [i % 10 > 0 for i in range(N)]
    _, seen = topics.fit(docs, np.ones(N + 4), first, passes=3)
    assert [sum(seen[k : k + topics.PARTS]) for k in range(0, len(seen), topics.PARTS)] == [N - N // 10] * 3


def test_passes_do_not_depend_on_size(spark, monkeypatch):
    """``fit_model`` leaves the passes to ``fit``, which makes as many at every size."""
    asked = []
    fit = topics.fit
    monkeypatch.setattr(subjects.lda, "fit", lambda *a, **k: asked.append(fit(*a, **k)) or asked[-1])
    labels = spark.createDataFrame([(0, "a"), (1, "b")], "doc_id long, subject string")
    for n in (60, 2_500):
        text = F.concat_ws(" ", *[F.element_at(F.array(*[F.lit(f"w{a}{b}") for b in "abcdefgh"]), (F.hash("id", F.lit(a)) % 4 + 5).cast("int")) for a in "abcdefgh"])
        sents, terms = subjects.encode(spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text")))
        subjects.fit_model(sents, terms, labels, ["a", "b"])
    (_, small), (_, large) = asked
    assert len(small) == len(large) == topics.PASSES * topics.PARTS
    assert sum(small) == topics.PASSES * 60 and sum(large) == topics.PASSES * 2_500


def test_shares(spark):
    """Words of one topic are given to it, a shared word to the topic of its document."""
    lam = np.array([[90.0, 90, 0.02, 50], [0.02, 0.02, 90, 50]])
    column = pa.array([[0, 1, 3], [2, 3], [], None], pa.list_(pa.int32()))
    got = topics.class_shares(column, topics.expected(lam), np.ones(4), np.eye(2))
    assert got.argmax(1).tolist() == [0, 0, 0, 1, 1] and np.allclose(got.sum(1), 1, atol=1e-3)
