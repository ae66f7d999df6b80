import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuscle.operators.automaton import LEFTMOST_FIRST, LEFTMOST_LONGEST, Matcher, find


def rows(it):
    return [tuple(m) for m in it]


def in_bytes(text, it):
    at = [0]
    for c in text:
        at.append(at[-1] + len(c.encode()))
    return [(at[m.start], at[m.end], m.value) for m in it]


def test_documented_matches():
    assert rows(Matcher(["bcd", "ab", "a"]).find_overlapping("abcd")) == [(0, 1, 2), (0, 2, 1), (1, 4, 0)]
    assert rows(Matcher(["bcd", "ab", "a"]).find("abcd")) == [(0, 1, 2), (1, 4, 0)]
    assert rows(Matcher(["ab", "a", "abcd"], kind=LEFTMOST_LONGEST).find_leftmost("abcd")) == [(0, 4, 2)]
    assert rows(Matcher(["ab", "a", "abcd"], kind=LEFTMOST_FIRST).find_leftmost("abcd")) == [(0, 2, 0)]
    assert in_bytes("世界中に", Matcher(["世界", "世", "世界中に"], kind=LEFTMOST_FIRST).find_leftmost("世界中に")) == [(0, 6, 0)]
    assert in_bytes("全世界中に", Matcher(["全世界", "世界", "に"]).find("全世界中に")) == [(0, 9, 0), (12, 15, 2)]
    assert in_bytes("全世界中に", Matcher(["全世界", "世界", "に"]).find_overlapping("全世界中に")) == [(0, 9, 0), (3, 9, 1), (12, 15, 2)]
    assert in_bytes("我在北京大学", Matcher(["北京", "北京大学", "大学"]).find_overlapping("我在北京大学")) == [(6, 12, 0), (6, 18, 1), (12, 18, 2)]
    assert rows(Matcher(["a", "ab", ""]).find_longest_per_end("ab")) == [(0, 0, 2), (0, 1, 0), (0, 2, 1)]


def test_empty_pattern():
    text, patterns = "いあabcÆæう", ["a", "æ", "あ", ""]
    every = [(x, x, 3) for x in (0, 3, 6, 7, 8, 9, 11, 13, 16)]
    assert in_bytes(text, Matcher(patterns).find(text)) == every
    assert in_bytes(text, Matcher(patterns).find_overlapping(text)) == sorted([*every, (3, 6, 2), (6, 7, 0), (11, 13, 1)], key=lambda m: (m[1], m[0]))
    found = in_bytes(text, Matcher(patterns, kind=LEFTMOST_LONGEST).find_leftmost(text))
    assert found == [(0, 0, 3), (3, 6, 2), (6, 7, 0), (8, 8, 3), (9, 9, 3), (11, 13, 1), (16, 16, 3)]


def test_wrong_kind_values_and_repeats():
    with pytest.raises(ValueError):
        list(Matcher(["a"]).find_leftmost("a"))
    with pytest.raises(ValueError):
        list(Matcher(["a"], kind=LEFTMOST_FIRST).find("a"))
    with pytest.raises(ValueError):
        Matcher(["a"], kind="other")
    assert rows(Matcher(["a", "a"], values=["x", "y"]).find_overlapping("a")) == [(0, 1, "x"), (0, 1, "y")]
    assert rows(Matcher([b"ab"]).find_overlapping(b"xab")) == [(1, 3, 0)]
    assert rows(Matcher([]).find_overlapping("abc")) == []


def test_stepper_and_saving():
    made = Matcher.load(Matcher(["ab", "b"]).save())
    assert made.describe()["states"] == 4 and made.describe()["patterns"] == 2
    step, got = made.stepper(), []
    for c in "abb":
        step.consume(c)
        got += rows(step.matches())
    assert got == rows(made.find_overlapping("abb"))


WORDS = st.lists(st.text(alphabet="ab", min_size=1, max_size=4), min_size=1, max_size=6, unique=True)


@given(WORDS, st.text(alphabet="abc", max_size=20))
def test_against_brute_force(words, text):
    every = [(i, i + len(w), k) for i in range(len(text)) for k, w in enumerate(words) if text.startswith(w, i)]
    assert sorted(find(Matcher(words), text, "overlapping")) == sorted(every)
    best: dict = {}
    for a, b, k in every:
        if b not in best or a < best[b][0]:
            best[b] = (a, b, k)
    assert rows(find(Matcher(words), text, "longest_per_end")) == [best[b] for b in sorted(best)]

    def apart(order):
        out, at = [], 0
        while left := [m for m in every if m[0] >= at]:
            out.append(min(left, key=order))
            at = out[-1][1]
        return out

    assert rows(find(Matcher(words), text, "standard")) == apart(lambda m: (m[1], m[0]))
    assert rows(find(Matcher(words, kind=LEFTMOST_LONGEST), text, "leftmost")) == apart(lambda m: (m[0], -m[1]))
    assert rows(find(Matcher(words, kind=LEFTMOST_FIRST), text, "leftmost")) == apart(lambda m: (m[0], m[2]))


@settings(deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=8), st.text("abc", max_size=30), st.booleans())
def test_leftmost_against_brute_force(patterns, text, longest):
    kind = LEFTMOST_LONGEST if longest else LEFTMOST_FIRST
    want, at = [], 0
    while at < len(text):
        here = [(k, p) for k, p in enumerate(patterns) if text.startswith(p, at)]
        if not here:
            at += 1
            continue
        k, p = max(here, key=lambda x: (len(x[1]), -x[0])) if longest else here[0]
        want.append((at, at + len(p), k))
        at += len(p)
    assert [tuple(m) for m in Matcher(patterns, kind=kind).find_leftmost(text)] == want
    made = Matcher.load(Matcher(patterns, kind=kind).save())
    assert [tuple(m) for m in made.find_leftmost(text)] == want


@settings(deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=4), min_size=1, max_size=5), st.text("ab", max_size=20))
def test_plain_search_in_steps(patterns, text):
    made = Matcher(patterns)
    step, got = made.find_stepper(), []
    for ch in text:
        step.consume(ch)
        got += step.matches()
    assert got == list(made.find(text))


@pytest.mark.parametrize("data", [b"", b"{}", b"[1]", b"\xff", b'{"kind": "other", "patterns": [], "values": []}', b'{"kind": "standard", "patterns": ["a"], "values": []}'])
def test_damaged(data):
    with pytest.raises(ValueError):
        Matcher.load(data)
    assert list(Matcher.load(Matcher([b"ab", b""], [7, "x"]).save()).find_overlapping(b"ab")) == list(Matcher([b"ab", b""], [7, "x"]).find_overlapping(b"ab"))
