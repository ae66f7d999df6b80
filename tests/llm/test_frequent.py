from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuscle.llm import frequent


@given(st.lists(st.integers(0, 30), max_size=400), st.integers(1, 50))
def test_undercount_is_bounded(values, width):
    table = frequent.LossyTable(np.int64)
    for lo in range(0, len(values), width):
        part = np.array(values[lo : lo + width], np.int64)
        table.add(part, len(part) == width)
    truth, kept = Counter(values), dict(zip(table.items.tolist(), zip(table.counts.tolist(), table.deltas.tolist())))
    assert table.bounds == len(values) // width
    for x, n in truth.items():
        low, delta = kept.get(x, (0, table.bounds))
        assert low <= n <= low + delta


def test_memory_stays_small():
    table, rng = frequent.LossyTable(np.int64), np.random.default_rng(1)
    for _ in range(200):
        table.add(rng.integers(0, 1 << 60, 1000), True)
        assert len(table.items) <= 1000


def test_intervals(spark):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 5 == 0, 7).when(F.col("id") % 97 == 0, None).otherwise(F.col("id")).alias("a"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit(1), F.lit(1), F.lit(None), F.col("id"))).otherwise(F.lit(None)).cast("array<long>").alias("b"),
    )
    found = frequent.frequent_items(rows.repartition(5), {"a": F.array("a"), "b": F.array_distinct("b")}, 0.1, width=500).collect()
    said = {(r["field_name"], r["item"]): r for r in found}
    assert set(said) == {("a", 7), ("b", 1)}
    for key, n in ((("a", 7), 12_001), (("b", 1), 20_000)):
        assert said[key]["count_low"] <= n <= said[key]["count_high"] and said[key]["n_rows"] == 60_000


def test_texts_ties_and_nothing(spark):
    rows = spark.createDataFrame([("x",), ("y",), ("x",), ("y",), (None,)], "s string")
    got = {r["item"] for r in frequent.frequent_items(rows, {"s": F.array("s")}, 0.4).collect()}
    assert got == {"x", "y"}
    assert frequent.frequent_items(rows.limit(0), {"s": F.array("s")}, 0.4).count() == 0
    assert frequent.frequent_items(rows.where("s is null"), {"s": F.array("s")}, 0.4).count() == 0
