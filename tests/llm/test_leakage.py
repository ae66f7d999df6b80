import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.llm import leakage

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("bcdfglmnprstv") + RNG.choice("aeiou") for _ in range(RNG.randint(2, 4))) for _ in range(800)]
ITEMS = [[RNG.choice(WORDS) for _ in range(RNG.randint(24, 70))] for _ in range(40)]


def filler(n):
    return [RNG.choice(WORDS[:400]) for _ in range(n)]


def leaked(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {tuple(r) for r in leakage.leaked_items(d, i).collect()}


def test_passages(spark):
    docs, want = [], set()
    for k, item in enumerate(ITEMS):
        n = len(item)
        start = RNG.randint(0, n - round(0.65 * n))
        passage = item[start : start + round(0.65 * n)]
        for p in range(5, len(passage), 11):
            passage[p] = "altered"
        docs.append((k, " ".join([*filler(30), *passage, *filler(20)]), "x"))
        want.add((k, k))
        docs.append((1000 + k, " ".join([*filler(20), *item[: round(0.35 * n)], *filler(20)]), "x"))  # a quotation
        docs.append((2000 + k, " ".join(filler(80)), "x"))
        docs.append((3000 + k, " ".join([*filler(9), *(w if i % 3 else RNG.choice(WORDS) + "x" for i, w in enumerate(item)), *filler(9)]), "x"))  # one word in three is another
    items = [(k, " ".join(w)) for k, w in enumerate(ITEMS)]
    assert leaked(spark, docs, items) == want
    # The passes over the corpus change nothing.
    d, i = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked_items(d, i, block_items=7).collect()} == want


def test_forms_of_characters(spark):
    item = "The café near Zulu keeps 119 coins, for the trials in a green jar until dawn breaks"
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isalnum() and c.isascii() else c for c in item)
    other = item.upper().replace("É", "É").replace(" ", " *\n ").replace("NEAR", "NE​AR").replace("coins", "соins")
    docs = [(1, wide, ""), (2, other, ""), (3, "x " * 50_000 + item + " y" * 50_000, ""), (4, None, ""), (5, "", ""), (6, "!!!", ""), (None, item, ""), (1, wide, "")]
    items = [(9, item), (8, None), (7, ""), (None, item), (6, "...")]
    assert leaked(spark, docs, items) == {(1, 9), (2, 9), (3, 9)}
    assert leaked(spark, [], items) == set() and leaked(spark, docs, []) == set()


def test_frames_and_marks(spark):
    def item(a, b, c, n):
        return f"{a} garde {n} pièces pour les {b} dans un bocal de {c} mais les {b}eurs ne dépassaient jamais le nombre de {n + 9} et seul {c}a savait lequel pesait davantage"

    items = [(k, item(*(f"{w}{k}" for w in ("nom", "chose", "lieu")), 100 + k)) for k in range(20)]
    docs = [
        (100, "x y z " + item("autre", "rien", "ailleurs", 7) + " x y", ""),
        (3, items[3][1].replace("pièces pour", "pièces (sic) pour [12]").replace("dans un", "* dans -- un"), ""),
        (200, "How many: combien en reste-t-il le soir si l'on compte Pofa Pehu aussi, de nos jours encore?".replace("-", "").replace("'", ""), ""),
    ]
    items.append((50, "Combien en reste-t-il le soir si l'on compte Pofa Pehu aussi, de nos jours encore?"))
    assert leaked(spark, docs, items) == {(3, 3), (200, 50)}


@settings(deadline=None)
@given(st.integers(0, 15), st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), unique=True, max_size=20))
def test_index_misses_nothing(radius, print_, bits):
    other = print_
    for b in bits:
        other ^= 1 << b
    index = leakage.HammingIndex(np.array([print_, 5], np.uint64), radius)
    at, stored = index.within(np.array([other], np.uint64))
    assert ((0, 0) in set(zip(at.tolist(), stored.tolist()))) == (len(bits) <= radius)


@settings(deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 12), st.integers(1, 9))
def test_fingerprints_by_step(words, size, step):
    bits = np.array([leakage._VECTORS[str(w)] for w in words], np.uint64)
    at = np.arange(0, len(words) - size + 1)
    weights = np.array([1 + w % 8 for w in words])
    got = leakage.fingerprints(bits, weights, size, at, step).tolist()
    part = lambda x, i: x[i : i + size].tolist()
    want = [sum(1 << b for b in range(64) if 2 * sum((x >> b & 1) * w for x, w in zip(part(bits, i), part(weights, i))) > sum(part(weights, i))) for i in at]
    swapped = lambda x: sum((x >> b & 1) << (b // 8 * 8 + 7 - b % 8) for b in range(64))
    assert got == want or [swapped(x) for x in got] == want


def brute_span(item, place):
    """The same alignment cell by cell."""
    n, m, p = len(item), len(place), leakage.ALTERED_COST
    score = [[(0, i) for _ in range(m + 1)] for i in range(n + 1)]
    best, spanned = 0, False
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            s = score[i - 1][j - 1][0] + (1 if item[i - 1] == place[j - 1] else -p)
            s = max(0, s, score[i - 1][j][0] - p, score[i][j - 1][0] - p)
            score[i][j] = (s, 0)
            best = max(best, s)
    return best


@settings(deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=14), st.lists(st.integers(0, 5), max_size=20))
def test_spans_need_a_good_alignment(item, place):
    if leakage.spans(np.array(item), np.array(place, np.int64), np.ones(len(item))):
        assert brute_span(item, place) >= 1
    if len(item) >= 2 and any(place[i : i + len(item)] == item for i in range(len(place))):
        assert leakage.spans(np.array(item), np.array(place), np.ones(len(item)))


@pytest.mark.parametrize("n,size", [(1, 1), (30, 11), (36, 14), (70, 28), (200, 69)])
def test_window_size(n, size):
    assert abs(leakage.window_size(n) - size) <= 2 and leakage.window_size(n) <= max(1, 0.85 * (n + 1) / 2)
