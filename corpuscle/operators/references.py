"""References to records that do not exist at the time of the reference."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a parent key gets in the filter, hash functions used, 64-bit words a block of the filter has, and the most that is broadcast of it.
BITS_A_KEY, HASHES, BLOCK_WORDS, FILTER_BYTES = 10, 4, 64, 16 << 20


def reference_rows(tables: dict[str, DataFrame], key: str = "qid", period: str = "dump_date") -> DataFrame:
    """(``ref_table``, ``period``, ``key``) of the rows of several tables; rows without key or period refer to nothing that could be checked."""
    parts = [df.select(F.lit(name).alias("ref_table"), F.col(period).alias(period), F.col(key).cast("long").alias(key)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).where(F.col(key).isNotNull() & F.col(period).isNotNull())


def parent_rows(parents: DataFrame, key: str = "qid", prefix: str = "Q") -> DataFrame:
    """(``key``, ``valid_from``, ``valid_to``) of the parent rows: text ids other than ``prefix`` and a plain decimal number, and rows without a first day, are no parents."""
    number = F.expr(f"try_cast(substring({key}, {len(prefix) + 1}) as long)")
    plain = parents.select(number.alias(key), F.col(key).alias("_text"), "valid_from", "valid_to")
    return plain.where((F.concat(F.lit(prefix), F.col(key).cast("string")) == F.col("_text")) & F.col("valid_from").isNotNull()).drop("_text")


def parent_spans(rows: DataFrame, key: str = "qid") -> DataFrame:
    """For each parent key and first day the last day up to which it holds (null: without end); repeated rows fall together before any shuffle."""
    spans = rows.groupBy(key, "valid_from").agg(F.max("valid_to").alias("valid_to"), F.bool_or(F.col("valid_to").isNull()).alias("_open"))
    return spans.select(key, "valid_from", F.when(~F.col("_open"), F.col("valid_to")).alias("valid_to"))


def _block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), F.col(key)), F.lit(blocks))


def _places(key: str) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), F.col(key)), F.lit(64 * BLOCK_WORDS)).cast("int") for i in range(1, HASHES + 1)]


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """A Bloom filter over a column of long keys as rows (``_block``, ``_words``): a key has all its bits in one block, whose words are an array; absent blocks hold no key."""
    spread = keys.select(_block(key, blocks).alias("_block"), F.explode(F.array(*_places(key))).alias("p"))
    words = spread.groupBy("_block", F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, p & 63)")).alias("bits"))
    listed = words.groupBy("_block").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m"))
    return listed.select("_block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("_words"))


def maybe_known(refs: DataFrame, filter_blocks: DataFrame, key: str, blocks: int) -> DataFrame:
    """``refs`` with ``_maybe``: false proves that the filter was built without the key. One join with the filter, however many bits are tested."""
    set_bits = [F.getbit(F.get("_words", F.shiftright(p, 6)), p.bitwiseAND(63)) == 1 for p in _places(key)]
    met = refs.withColumn("_block", _block(key, blocks)).join(filter_blocks, "_block", "left")
    return met.select(*refs.columns, F.coalesce(reduce(lambda a, b: a & b, set_bits), F.lit(False)).alias("_maybe"))


def orphan_references(
    tables: dict[str, DataFrame],
    parents: DataFrame,
    key: str = "qid",
    period: str = "dump_date",
    prefix: str = "Q",
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """Distinct (``ref_table``, ``period``, ``key``) for which no row of ``parents`` holds at the period.

    A parent row of id ``prefix`` and number holds from ``valid_from`` to the day before ``valid_to``, or without end. Null keys
    and periods are no references. With no parents every reference is an orphan; with no references the result is empty. Other
    columns, also of equal names, are ignored, and repeated rows count once.

    Method: a Bloom filter of 10 bits a key over all parent keys, cut into blocks by key hash. Up to ``filter_bytes`` it is broadcast, once,
    and tested where the references are read; a larger one, of any size, meets the distinct references by block. A reference it
    denies is an orphan for certain and never meets the parents; the others are held exactly against the spans of their key. References and spans are made
    distinct, partly before they move, so that a key has at most one row a table and period, and one a first day, however many rows it had.
    """
    refs, rows = reference_rows(tables, key, period), parent_rows(parents, key, prefix)
    blocks = max(1, math.ceil(parents.count() * BITS_A_KEY / (64 * BLOCK_WORDS)))
    bloom = bloom_blocks(rows, key, blocks)
    if blocks * BLOCK_WORDS * 8 <= filter_bytes:
        # The flag follows from the key; as an aggregate it stays above the shuffle, which both kinds of reference then share.
        tested = maybe_known(refs, F.broadcast(bloom), key, blocks).groupBy("ref_table", period, key).agg(F.bool_or("_maybe").alias("_maybe"))
    else:
        tested = maybe_known(refs.distinct(), bloom, key, blocks)
    covered = (F.col(f"s.{key}") == F.col(f"r.{key}")) & (F.col("s.valid_from") <= F.col(f"r.{period}")) & (F.col("s.valid_to").isNull() | (F.col("s.valid_to") > F.col(f"r.{period}")))
    exact = tested.where("_maybe").drop("_maybe").alias("r").join(parent_spans(rows, key).alias("s"), covered, "left_anti")
    return tested.where(~F.col("_maybe")).drop("_maybe").unionByName(exact)


def orphan_report(tables: dict[str, DataFrame], parents: DataFrame, key: str = "qid", period: str = "dump_date", prefix: str = "Q") -> DataFrame:
    """Per table and period: distinct keys referred to, and how many of them had no parent then."""
    refs = reference_rows(tables, key, period).distinct().groupBy("ref_table", period).agg(F.count("*").alias("n_keys"))
    lost = orphan_references(tables, parents, key, period, prefix).groupBy("ref_table", period).agg(F.count("*").alias("n_orphans"))
    return refs.join(lost, ["ref_table", period], "left").select("ref_table", period, "n_keys", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"))
