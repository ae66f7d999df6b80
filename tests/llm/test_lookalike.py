import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.llm import lookalike


def plain(text):
    """The same form without tables and joins."""
    return unicodedata.normalize("NFC", "".join(map(lookalike.pieces_of, text))).strip(" ")


def forms(spark, texts):
    df = spark.createDataFrame([(t, "clash") for t in texts], "text string, _text string")
    return {r["text"]: r["form"] for r in lookalike.screen_forms(df, []).collect()}


ALIKE = [
    ("Café", "Café"), ("paypal", "раураl"), ("ＡＢ　ｃ", "AB c"), ("a​b", "ab"), ("a b", "a b"), ("ﬁn", "fin"), ("ⅷ", "viii"), ("ë", "ё"), ("ï", "ї"),
    ("ガ", "ガ"), ("ｶﾞ", "ガ"), ("ニ", "二"), ("ệ", "ệ"), ("각", "각"), ("가", "가"), ("  x ﻿", "x"), ("x️", "x"), ("a‑b", "a-b"), ("Kelvin K", "Kelvin K"), ("郎", "郎"), ("ɡо", "go"),
]
DIFFERENT = [("cafe", "café"), ("A", "a"), ("ab", "a b"), ("a-b", "a_b"), ("aa", "a"), ("a b", "a_b"), ("x²", "x2"), ("и", "й"), ("①", "1"), ("´", "'"), ("a  b", "a b")]


def test_pairs(spark):
    got = forms(spark, {t for p in ALIKE + DIFFERENT for t in p})
    assert [p for p in ALIKE if got[p[0]] != got[p[1]]] == []
    assert [p for p in DIFFERENT if got[p[0]] == got[p[1]]] == []
    assert all(got[t] == plain(t) for t in got)


MARKS = "".join(map(chr, (0x301, 0x323, 0x302, 0x308, 0x327, 0x3099, 0x345, 0x5B0)))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aeouκЕカ각각ােো Ç﻿" + MARKS), st.characters(exclude_categories=["Cs"], exclude_characters="\0")), max_size=12), min_size=200, max_size=300))
def test_like_the_plain_form(spark, texts):
    got = forms(spark, texts)
    assert {t: f for t, f in got.items() if f != plain(t)} == {}
    again = forms(spark, list(got.values()))
    assert {f: g for f, g in again.items() if f != g} == {}


def test_nulls_empties_and_long_texts(spark):
    long = "é" * 50_000 + "​"
    got = forms(spark, [None, "", "​", " ", long, "x", "x"])
    assert got == {"": "", "​": "", " ": "", long: "é" * 50_000, "x": "x"}
    assert lookalike.screen_forms(spark.createDataFrame([], "text string"), []).count() == 0


def test_pairs_of_a_table(spark):
    df = spark.createDataFrame([("t", "ab"), ("t", "а​b"), ("t", "ab"), ("u", "аb"), ("t", "ＡＢ"), ("t", None)], "ref_table string, text string")
    got = [tuple(r) for r in lookalike.alike_pairs(lookalike.screen_forms(df, ["ref_table"]), ["ref_table"]).collect()]
    assert got == [("t", "ab", "а​b")]


@pytest.mark.parametrize("name", ["decompositions", "compositions"])
def test_tables_are_bounded(name):
    assert len(getattr(lookalike, name)()) < 40_000


def test_values_of(spark):
    a = spark.createDataFrame([("x", 1)], "title string, text int")
    assert [tuple(r) for r in lookalike.values_of({"page": (a, "title")}).collect()] == [("page", "x")]
    assert F is not None
