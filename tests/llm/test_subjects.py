import random

import numpy as np
import pytest

from corpuscle.llm import subjects

RNG = random.Random(3)
THINGS = {s: {lang: [f"{s[:3]}{lang}{'abcdefghij'[i]}{'klmnopqrst'[i]}" for i in range(10)] for lang in ("en", "fr")} for s in ("law", "sport", "music")}
GENERIC = {lang: [f"gen{lang}{c}z" for c in "abcdefghij"] for lang in ("en", "fr")}
FRAMES = {"en": "the {} followed the {} in {}", "fr": "les {} ont suivi les {} à {}"}


def make(n):
    docs, truth, labels = [], {}, []
    for d in range(n):
        about = RNG.choice([*THINGS, None])
        sides = {"en": [], "fr": []}
        for k in range(RNG.randint(2, 4)):
            pool = about if k == 0 else RNG.choice([about, None])
            a, b = RNG.sample(range(10), 2)
            name = RNG.choice(["Zuvo", "Kela", "Miro"]) + RNG.choice("abcdefghij")
            for lang, out in sides.items():
                words = THINGS[pool][lang] if pool else GENERIC[lang]
                out.append(FRAMES[lang].format(words[a], words[b], name).capitalize() + ".")
        if RNG.random() < 0.2:  # a single thing in passing
            other = RNG.choice(list(THINGS))
            for lang, out in sides.items():
                out.append(FRAMES[lang].format(THINGS[other][lang][1], GENERIC[lang][2], "Zuvo").capitalize() + ".")
        first = " ".join(sides["en"])
        docs.append((d, first + "\n" + " ".join(sides["fr"]), len(first), "clash"))
        truth[d] = {about} - {None}
        if d % 5 == 0:
            labels.append((d, about or "none" if RNG.random() < 0.93 else "law", "x"))
    return docs, truth, labels


DOCS = "doc_id long, text string, tgt_start int, subject string"
LABELS = "doc_id long, subject string, text string"


@pytest.fixture(scope="module")
def found(spark):
    docs, truth, labels = make(1500)
    extra = [(None, docs[0][1], None, "x"), (9001, None, 1, "x"), (9002, "", 5, "x"), (9003, "!!! 12", -3, "x"), docs[1]]
    labels += [(None, "law", ""), (1, None, ""), (5, "none", ""), (5, "none", ""), (123_456, "sport", "")]
    got = subjects.document_subjects(spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels, LABELS))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return truth, set(rows)


def test_accuracy(found):
    truth, rows = found
    want = {(d, s) for d, ss in truth.items() for s in ss}
    right = len(want & rows)
    assert right >= 0.95 * len(want) and right >= 0.95 * len(rows), (right, len(want), len(rows))
    assert not {d for d, _ in rows} & {None, 9001, 9002, 9003}


def test_nothing(spark):
    docs, _, labels = make(30)
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)  # noqa: E741
    assert subjects.document_subjects(d.limit(0), l).count() == 0
    assert subjects.document_subjects(d, l.limit(0)).count() == 0


def test_sentences():
    assert subjects.sentences_of("One two. Three\nfour? 12 x", None) == [[["One", "two"], ["Three", "four"]]]
    assert subjects.sentences_of("ab cd.ef gh", 5) == [[["ab", "cd"]], [["ef", "gh"]]]
    assert subjects.sentences_of("", 0) == [[]]
    long = "wort " * 100_000
    assert len(subjects.sentences_of(long, None)[0][0]) == 100_000


def few_terms():
    """Terms 1 and 2 belong to a and b, 3 to b and c, 4 to a alone, 5 to b alone, 6 to none; a topic for each of a, b, c and none."""
    belongs = np.array([[1, 1, 0, 0], [1, 1, 0, 0], [0, 1, 1, 0], [1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1]], float)
    lam = belongs.T * 1000 + 0.02
    codes = np.arange(1, 7)
    model = subjects.Model(["a", "b", "c"], codes, list("uvwxyz"), np.ones(6), lam, np.arange(4), np.zeros((6, 3), bool))
    shares = belongs[:5, :3] / belongs[:5, :3].sum(1, keepdims=True)
    return model, subjects.Things(codes[:5], codes[:5], shares)


SENTS = "doc_id long, sents array<array<long>>"


def test_rule(spark):
    model, things = few_terms()
    sents = [(1, [[1, 2]]), (2, [[1, 3]]), (3, [[1, 4]]), (4, [[1], [4]]), (5, [[4, 4]]), (6, [[6, 99]]), (7, [[5, 3, 1, 4]]), (8, None), (9, []), (10, [[5], [5, 1]]), (None, [[1, 4]])]
    got = subjects.assign(spark.createDataFrame(sents, SENTS), model, things)
    assert sorted(tuple(r) for r in got.collect()) == [(2, "b"), (3, "a"), (7, "a"), (7, "b"), (10, "b")]


def test_the_topics_decide(spark):
    """With topics that tell nothing apart no document has enough words of a subject."""
    model, things = few_terms()
    model.lam = np.ones_like(model.lam)
    assert subjects.assign(spark.createDataFrame([(3, [[1, 4]]), (10, [[5, 1]])], SENTS), model, things).count() == 0
    assert (few_terms()[0].owned()[3] > 0.9).tolist() == [True, False, False]


def test_bound_words(spark):
    """1 and 2 always follow each other, 2 and 3 too: one thing; 4 stands beside 1 now and then."""
    things = spark.createDataFrame([(c, [1.0], 10) for c in (1, 2, 3, 4)], "code long, share array<double>, n long")
    rows = spark.createDataFrame([(0, [[1, 2, 3], [9, 9, 4]])] * 9 + [(1, [[4, 1, 7], [1, 7, 7, 4]])], SENTS)
    plain = subjects.Things(np.array([1, 2, 3, 4]), np.array([1, 2, 3, 4]), np.ones((4, 1)))
    pairs = subjects.neighbours(rows, plain, 1)
    assert {(r.a, r.b): r.k for r in pairs.collect()} == {(1, 2): 9, (2, 3): 9, (1, 3): 9, (4, 1): 1}
    assert {r.code: r.unit for r in subjects.with_units(things, pairs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_terms_beyond_the_model_and_beyond_executors(spark):
    docs, truth, labels = make(900)
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)  # noqa: E741
    want = {(k, s) for k, ss in truth.items() for s in ss}
    whole = {tuple(r) for r in subjects.document_subjects(d, l).collect()}
    joined = {tuple(r) for r in subjects.document_subjects(d, l, most_things=0).collect()}
    assert joined == whole
    few = {tuple(r) for r in subjects.document_subjects(d, l, model_terms=50).collect()}
    assert len(few & want) >= 0.9 * len(want) and len(few & want) >= 0.9 * len(few), (len(few & want), len(few), len(want))


def test_top_terms(spark):
    docs, _, labels = make(900)
    rows = subjects.topic_terms(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), 5).collect()
    named = {r.subject for r in rows}
    assert {"law", "music"} <= named
    first = [(r.subject[:3], r.term[:3]) for r in rows if r.subject != "none" and r["rank"] == 1]
    assert sum(a == b for a, b in first) >= 0.75 * len(first), first
