import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpuscle.llm import packing


@given(st.lists(st.integers(1, 2048), min_size=1, max_size=300))
def test_pack(lengths):
    lengths = np.array(lengths)
    sequence, tier, offset = packing.pack(lengths)
    for k in range(sequence.max() + 1):
        mine = np.flatnonzero(sequence == k)
        order = mine[np.argsort(offset[mine])]
        assert lengths[mine].sum() <= packing.CAPACITY
        assert offset[order].tolist() == (np.cumsum(lengths[order]) - lengths[order]).tolist()
    assert all(packing.TIERS[t] >= n and (t == 0 or packing.TIERS[t - 1] < n) for t, n in zip(tier, lengths))
    # No two sequences would fit into one.
    room = np.sort(np.bincount(sequence, weights=lengths))
    assert len(room) < 2 or room[0] + room[1] > packing.CAPACITY


@given(st.lists(st.integers(1, 2048), min_size=1, max_size=400), st.integers(1, 20))
def test_groups(lengths, size):
    lengths = np.array(lengths)
    sequence, _, _ = packing.pack(lengths)
    groups = packing.step_groups(sequence, lengths, size)
    counts = np.bincount(groups)
    assert counts.max() - counts.min() <= 1 and counts.max() <= size and len(groups) == sequence.max() + 1


def test_documents(spark):
    rows = [(i, "word " * (i % 90 + 1), "x") for i in range(1, 2000)] + [(5000, "a b c " * 9000, "x"), (5001, None, "x"), (5002, "", "x"), (7, "repeated", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = packing.packed_sequences(docs, cell_pieces=700).toPandas()
    tokenizer = packing._tokenizer(packing.VOCABULARY)
    for doc, text in ((5000, "a b c " * 9000), (50, "word " * 51)):
        part = got[got.doc_id == doc].sort_values("piece_no")
        assert part.token_start.tolist() == list(range(0, len(tokenizer.encode_ordinary(text)), 2048)) and part.token_end.iloc[-1] == len(tokenizer.encode_ordinary(text))
    assert got[got.doc_id.isin([5001, 5002])].sequence_id.isna().all() and len(got[got.doc_id == 7]) == 2 and got.doc_id.isna().sum() == 1
    placed = got.dropna(subset=["sequence_id"])
    size = (placed.token_end - placed.token_start).groupby(placed.sequence_id).sum()
    assert size.max() <= 2048 and size.sum() / (2048 * len(size)) > 0.97
    assert placed.doc_id.nunique() == 2000
    groups = placed.groupby("step_group").sequence_id.nunique()
    assert groups.max() <= packing.GROUP_SEQUENCES
    report = packing.packing_report(packing.packed_sequences(docs)).first()
    assert report["n_least"] <= report["n_sequences"] <= report["n_least"] + 1


def test_nothing(spark):
    assert packing.packed_sequences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [2047, 2048, 2049])
def test_capacity(spark, n):
    text = " a" * n
    got = packing.packed_sequences(spark.createDataFrame([("x", text)], "doc_id string, text string")).collect()
    assert len(got) == (1 if n <= 2048 else 2) and sum(r["token_end"] - r["token_start"] for r in got) == n
