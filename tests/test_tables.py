from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpuscle.operators import references, skew, snapshots

PAGE = "wiki string, dump_date string, page_id long, title string, qid long, loaded_at timestamp, _g string, n int"


def pages(spark, rows):
    return spark.createDataFrame([(w, d, k, t, q, datetime(2026, 1, 1 + at), "clash", 1) for w, d, k, t, q, at in rows], PAGE)


def changes(spark, rows, **kw):
    return sorted(tuple(r) for r in snapshots.snapshot_changes(pages(spark, rows), **kw).collect())


def expected(rows):
    last = {}
    for w, d, k, t, q, at in rows:
        if w is not None and d is not None and k is not None:
            new = (at, t is not None, t or "", q is not None, q or 0, (t, q))
            last[w, d, k] = max(last.get((w, d, k), new), new)
    dates = {}
    for w, d, _ in last:
        dates.setdefault(w, set()).add(d)
    out = []
    for w, ds in dates.items():
        ds = sorted(ds)
        for a, b in zip(ds, ds[1:]):
            old = {k: v[-1] for (x, d, k), v in last.items() if (x, d) == (w, a)}
            new = {k: v[-1] for (x, d, k), v in last.items() if (x, d) == (w, b)}
            for k in old.keys() | new.keys():
                kind = "added" if k not in old else "removed" if k not in new else "changed" if old[k] != new[k] else None
                if kind:
                    out.append((w, b, k, kind))
    return sorted(out)


def test_changes_between_snapshots(spark):
    rows = [
        ("en", "20260101", 1, "a", 1, 0), ("en", "20260101", 2, None, 2, 0), ("en", "20260101", 3, "c", None, 0), ("en", "20260101", 4, "d", 4, 0),
        ("en", "20260201", 1, "a", 1, 1), ("en", "20260201", 2, "", 2, 1), ("en", "20260201", 3, "c", 0, 1), ("en", "20260201", 5, "e", 5, 1),
        ("en", "20260201", 1, "late", 1, 0), ("de", "20260101", 9, "x", 9, 0), ("de", "20260301", 9, "x", 9, 0), ("fr", "20260101", 1, "a", 1, 0),
        (None, "20260101", 1, "a", 1, 0), ("en", None, 1, "a", 1, 0), ("en", "20260201", None, "a", 1, 0),
    ]
    want = [("en", "20260201", 2, "changed"), ("en", "20260201", 3, "changed"), ("en", "20260201", 4, "removed"), ("en", "20260201", 5, "added")]
    assert changes(spark, rows) == want == expected(rows)
    assert changes(spark, []) == []


def test_ties_take_the_greatest_values(spark):
    rows = [("en", "1", 1, "a", 1, 0), ("en", "2", 1, "b", 1, 1), ("en", "2", 1, "a", 1, 1), ("en", "2", 1, "b", 1, 1)]
    assert changes(spark, rows) == [("en", "2", 1, "changed")]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["en", "de", None]), st.sampled_from(["1", "2", "3"]), st.integers(-5, 40), st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, None]), st.integers(0, 5)), max_size=80))
def test_any_snapshots(spark, rows):
    assert changes(spark, rows, key_range=8, mean_chunk=3) == expected(rows)


def test_text_keys(spark):
    rows = [("g", "1", f"k{i}", "v", i) for i in range(50)] + [("g", "2", f"k{i}", "v" if i != 7 else "w", i) for i in range(1, 51)]
    df = spark.createDataFrame(rows, "wiki string, dump_date string, page_id string, title string, loaded_at int")
    got = sorted(tuple(r)[2:] for r in snapshots.snapshot_changes(df, values=["title"]).collect())
    assert got == [("k0", "removed"), ("k50", "added"), ("k7", "changed")]


@pytest.mark.parametrize("filter_bytes", [references.FILTER_BYTES, 1])
def test_orphans(spark, filter_bytes):
    page = spark.createDataFrame([("20260101", 1, "x"), ("20260101", 1, "y"), ("20260201", 1, "x"), ("20260101", 2, "x"), ("20260101", None, "x"), (None, 1, "x"), ("20260101", 77, "x")], "dump_date string, qid long, valid_from string")
    flags = spark.createDataFrame(
        [("Q1", "20260101", "20260201"), ("Q1", "20260101", "20260201"), ("Q2", "20260102", None), ("P2", "20200101", None), ("Q02", "20200101", None), ("Q77", None, None), (None, "20200101", None)],
        "qid string, valid_from string, valid_to string",
    )
    got = sorted(tuple(r) for r in references.orphan_references({"page": page}, flags, filter_bytes=filter_bytes).collect())
    assert got == [("page", "20260101", 2), ("page", "20260101", 77), ("page", "20260201", 1)]
    report = {tuple(r) for r in references.orphan_report({"page": page}, flags).collect()}
    assert report == {("page", "20260101", 3, 2), ("page", "20260201", 1, 1)}
    assert references.orphan_references({"page": page.limit(0)}, flags, filter_bytes=filter_bytes).count() == 0
    assert references.orphan_references({"page": page}, flags.limit(0), filter_bytes=filter_bytes).count() == 4


def test_overlapping_spans_of_one_first_day(spark):
    page = spark.createDataFrame([("20260301", 1)], "dump_date string, qid long")
    spans = spark.createDataFrame([("Q1", "20260101", "20260201"), ("Q1", "20260101", None)], "qid string, valid_from string, valid_to string")
    assert references.orphan_references({"page": page}, spans).count() == 0


@pytest.mark.parametrize("blocks", [1, 5])
def test_no_known_key_is_denied(spark, blocks):
    keys = spark.range(0, 1200, 3).selectExpr("id as qid")
    bloom = references.bloom_blocks(keys, "qid", blocks)
    tested = references.maybe_known(spark.range(0, 5000).selectExpr("id as qid"), bloom, "qid", blocks)
    assert tested.where("qid % 3 = 0 and qid < 1200 and not _maybe").count() == 0
    assert tested.where("(qid % 3 != 0 or qid >= 1200) and _maybe").count() < 150


@pytest.mark.parametrize("filter_bytes", [references.FILTER_BYTES, 1])
def test_the_filter_is_used_at_every_size(spark, filter_bytes):
    refs = spark.range(3000).selectExpr("'20260101' as dump_date", "id as qid")
    flags = spark.range(0, 3000, 2).selectExpr("concat('Q', id) as qid", "'20260101' as valid_from", "cast(null as string) as valid_to")
    found = references.orphan_references({"page": refs}, flags, filter_bytes=filter_bytes)
    assert found.count() == 1500 and found.where("qid % 2 = 0").count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_words" in plan and ("strategy=broadcast" in plan) == (filter_bytes > 1)


def edges(spark):
    rows = [("hot", i % 7) for i in range(600)] + [("hot", None)] * 5 + [(f"k{i}", i) for i in range(300)] + [(None, 1)] * 40 + [("only nulls", None)]
    return spark.createDataFrame(rows, "key string, qid long")


def test_key_profile(spark):
    got = {r.key: (r.n_rows, r.n_partners) for r in skew.key_profile(edges(spark), "key", "qid").collect()}
    assert got["hot"] == (605, 7) and got["only nulls"] == (1, 0) and got["k3"] == (1, 1) and None not in got and len(got) == 302
    assert skew.key_profile(edges(spark).limit(0), "key", "qid").count() == 0
    assert skew.key_profile(edges(spark).where("key is null"), "key", "qid").count() == 0


@pytest.mark.parametrize("most", [1000, 0])
def test_skew_join(spark, most):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4)], "key string, qid long")
    got = skew.skew_join(edges(spark), right, "key", most=most)
    assert got.columns == ["key", "qid", "qid_right"]
    assert got.groupBy("key", "qid_right").count().orderBy("key", "qid_right").collect() == [("hot", 1, 605), ("hot", 2, 605), ("k1", 3, 1)]


def test_equal_rows_of_a_hot_key_are_dealt_evenly(spark):
    left = spark.range(10_000).selectExpr("if(id % 10 = 0, 'b', 'a') as key", "1 as n")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, m long")
    met = skew.salted_join(left, right, "key", 500)
    assert {(r.key, r["count"]) for r in met.groupBy("key").count().collect()} == {("a", 9000), ("b", 1000)}
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
    parts = left.where("key = 'a'").selectExpr("pmod(monotonically_increasing_id(), 18) as salt").groupBy("salt").count()
    assert parts.count() == 18 and parts.agg({"count": "max"}).first()[0] <= 1.1 * 500
    assert skew.salted_join(left.limit(0), right, "key", 500).count() == 0


def test_a_page_delivered_very_often(spark):
    rows = [("en", d, 7, f"t{i % 3}", i, i % 20) for d in ("20260101", "20260201") for i in range(500)] + [("en", "20260201", 8, "x", 1, 0)]
    assert changes(spark, rows) == expected(rows) == [("en", "20260201", 8, "added")]


def test_sketch_of_several_columns(spark):
    heavy, n = skew.all_heavy_keys(edges(spark), ["key", "qid"], 0.1)
    assert n == 946 and "hot" in {r[0] for r in heavy["key"].collect()} and set(range(7)) >= {r[0] for r in heavy["qid"].collect()} - set(range(7, 300))
    heavy, n = skew.all_heavy_keys(edges(spark).limit(0), ["key", "qid"])
    assert n == 0 and heavy["key"].count() == 0


def shuffles(df):
    """Shuffles of a plan, without those below what is kept in memory."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hash" in line or "Exchange range" in line or "Exchange Round" in line for line in plan.split("InMemoryRelation")[0].splitlines())


def test_snapshots_shuffle_once(spark):
    rows = [("en", d, k, "t", k, 0) for d in ("1", "2") for k in range(50)]
    assert shuffles(snapshots.snapshot_changes(pages(spark, rows))) == 2  # the other one brings hot keys to one row each


def test_no_product_of_rows(spark):
    refs = spark.createDataFrame([("20260101", 1)], "dump_date string, qid long")
    flags = spark.createDataFrame([("Q1", "20260101", None)], "qid string, valid_from string, valid_to string")
    plan = references.orphan_references({"page": refs}, flags)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
