import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpuscle.functions.normalize import Normalizer, normalize_key, normalize_spans

PAIRS = [
    (" Ａlàn＿Turing ", "alan turing"),
    ("Jean‑Paul Sartre", "jean paul sartre"),
    ("西格蒙德·弗洛伊德", "西格蒙德 弗洛伊德"),
    ("Café", "cafe"),
    ("Straße", "strasse"),
    ("C++", "c++"),
    ("C#", "c#"),
    ("R&B", "r&b"),
    ("《北京大学》", "北京大学"),
    ("​﻿", None),
    ("A_B", "a b"),
    ("  A  ", "a"),
    ("   ", None),
    ("", None),
    (None, None),
    ("Ｗｉｋｉ_Title", "wiki title"),
    ("İstanbul", "istanbul"),
    ("Alan​Turing", "alanturing"),
    ("A---B", "a b"),
    ("① theorem", "1 theorem"),
    ("Alpha_(letter)", "alpha letter"),
    ("Ｃ＋＋", "c++"),
    ("Ｃ＃", "c"),
    ("R＆B", "r b"),
    ("가", "가"),
    ("が", "か"),
    ("ͅ", "ι"),
    ("½", "1⁄2"),
    ("$5", "$5"),
    ("a￹b", "a b"),
    ("…", None),
    ("℃", "°c"),
    ("ﬁ", "fi"),
    ("ı", "ı"),
]


@pytest.mark.parametrize("text,key", PAIRS)
def test_pairs(text, key):
    assert normalize_key(text) == key


def test_spans():
    norm, starts, ends = normalize_spans("Ａ​B")
    assert (norm, starts.tolist(), ends.tolist()) == ("ab", [0, 2], [1, 3])
    norm, starts, ends = normalize_spans("x😀ß")
    assert (norm, starts.tolist(), ends.tolist()) == ("x😀ss", [0, 1, 3, 3], [1, 3, 4, 4])


def test_a_blank_has_the_span_of_the_last_of_its_run():
    _, starts, ends = normalize_spans("a - b")
    assert (starts.tolist(), ends.tolist()) == ([0, 3, 4], [1, 4, 5])


@given(st.text(max_size=40))
def test_properties(text):
    key = normalize_key(text)
    norm, starts, ends = normalize_spans(text)
    assert (norm or None) == key
    assert [(c, int(a), int(b)) for c, a, b in zip(norm, starts, ends)] == Normalizer().feed(text)
    assert key is None or normalize_key(key) == key
    assert key is None or not any(unicodedata.category(c)[0] == "M" for c in key)


@given(st.text(alphabet="aB -_é😀​ß́", max_size=25), st.lists(st.integers(0, 25), max_size=4))
def test_chunks_change_nothing(text, cuts):
    whole = Normalizer().feed(text)
    cuts = sorted(min(c, len(text)) for c in cuts)
    parts = Normalizer()
    assert [x for a, b in zip([0, *cuts], [*cuts, len(text)]) for x in parts.feed(text[a:b])] == whole
    assert [(c, int(a), int(b)) for c, a, b in zip(*normalize_spans(text))] == whole
