"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.operators.skew import heavy_keys
from corpuscle.session import small

#: Share of all rows from which a key is brought to one row a snapshot before it moves.
HOT_SHARE = 0.02

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _digest(parts: Sequence[Column], salt: int) -> Column:
    """64 bits of a row; null and empty differ."""
    said = [x for p in parts for x in (p.isNull(), p)]
    return F.xxhash64(F.lit(salt), *said)


def snapshot_changes(
    rows: DataFrame,
    group: str = "wiki",
    version: str = "dump_date",
    key: str = "page_id",
    values: Sequence[str] = ("title", "qid"),
    latest_by: str = "loaded_at",
    key_range: int = 512,
    mean_chunk: int = 32,
) -> DataFrame:
    """Records added, removed or changed between neighbouring snapshots of each ``group``.

    A snapshot is all rows of one (``group``, ``version``); of several rows with one ``key`` the one with the latest
    ``latest_by`` counts, and among equally late ones the greatest ``values`` (null least). Rows without group, version or key
    identify no record and are left out. Values are compared exactly, null being a value. The first snapshot of a group gives
    nothing. An empty table gives an empty result, and columns not named here are ignored.

    Method: each snapshot, sorted by key, is cut into chunks at keys whose hash says so, so that a chunk's bounds depend on what
    it holds and an added or removed key moves only the bounds beside it. Chunks with equal digests (two 64-bit sums and the
    count) on both sides are discarded; the rows of the rest meet by key. Keys that a sketch finds to hold many rows are brought to one row a
    snapshot before they move. Everything after the one shuffle of the others, by group and range of ``key_range`` keys, stays in its partition: a range holds at most ``key_range`` keys a snapshot, so that neither a large
    group nor a long history ends in one task. Keys other than integers are sorted by their hash.

    Result: ``group``, ``version`` (the later one), ``key``, ``change_kind`` = added, removed or changed.
    """
    ordered = isinstance(rows.schema[key].dataType, _INTEGERS)
    order = F.col(key).cast("long") if ordered else F.xxhash64(key)
    named = rows.where(F.col(group).isNotNull() & F.col(version).isNotNull() & F.col(key).isNotNull())

    around = Window.partitionBy("_g").orderBy("_v")
    versions = (
        named.select(F.col(group).alias("_g"), F.col(version).alias("_v"))
        .distinct()
        .select("_g", "_v", F.lag("_v").over(around).alias("_before"), F.lead("_v").over(around).alias("_after"))
    )
    versions, _ = small(versions)

    spread = named.select(
        F.col(group).alias("_g"),
        F.floor(order / F.lit(key_range) if ordered else F.shiftright(order, 40)).alias("_range"),
        F.col(version).alias("_v"),
        F.col(key).alias("_k"),
        order.alias("_o"),
        F.struct(F.col(latest_by).alias("_at"), F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(values)]).alias("_values")).alias("_row"),
    )
    # A key delivered very often is brought to one row a snapshot before it moves.
    hot = F.broadcast(heavy_keys(named, key, HOT_SHARE))
    often = spread.join(hot, F.col("_k") == F.col("_heavy"), "left_semi").groupBy("_g", "_range", "_v", "_k", "_o").agg(F.max("_row").alias("_row"))
    spread = spread.join(hot, F.col("_k") == F.col("_heavy"), "left_anti").unionByName(often).repartition("_g", "_range")
    records = spread.groupBy("_g", "_range", "_v", "_o", "_k").agg(F.max("_row").alias("_row")).select("_g", "_range", "_v", "_o", "_k", F.col("_row._values").alias("_values"))

    # A bound follows from the key alone: both snapshots cut at it wherever both hold it.
    bound = F.when(F.pmod(F.xxhash64(F.lit(7), "_o"), F.lit(mean_chunk)) == 0, F.col("_o"))
    upto = Window.partitionBy("_g", "_range", "_v").orderBy("_o").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cells = [F.col("_k"), *[F.col(f"_values.v{i}") for i in range(len(values))]]
    chunks = (
        records.withColumn("_chunk", F.max(bound).over(upto))
        .groupBy("_g", "_range", "_chunk", "_v")
        .agg(
            F.struct(F.bit_xor(_digest(cells, 1)).alias("a"), F.bit_xor(_digest(cells, 2)).alias("b"), F.count("*").alias("n")).alias("_digest"),
            F.collect_list(F.struct("_k", "_values")).alias("_rows"),
        )
        .join(versions, ["_g", "_v"])
    )
    beside = Window.partitionBy("_g", "_range", "_chunk").orderBy("_v")
    same = lambda other, own: F.coalesce((F.col(f"{other}._v") == F.col(own)) & (F.col(f"{other}._digest") == F.col("_digest")), F.lit(False))
    head = F.struct("_v", "_digest")
    open_chunks = (
        chunks.withColumn("_lag", F.lag(head).over(beside))
        .withColumn("_lead", F.lead(head).over(beside))
        .withColumn(
            "_sides",
            F.filter(
                F.array(
                    F.struct(F.when(~same("_lag", "_before"), F.when(F.col("_before").isNotNull(), F.col("_v"))).alias("at"), F.lit(True).alias("late")),
                    F.struct(F.when(~same("_lead", "_after"), F.col("_after")).alias("at"), F.lit(False).alias("late")),
                ),
                lambda s: s["at"].isNotNull(),
            ),
        )
        .where(F.size("_sides") > 0)
    )
    sides = open_chunks.select("_g", "_range", "_rows", F.explode("_sides").alias("_side")).select("_g", "_range", "_side", F.explode("_rows").alias("_r"))
    old = F.max(F.when(~F.col("_late"), F.struct("_values")))
    new = F.max(F.when(F.col("_late"), F.struct("_values")))
    met = (
        sides.select("_g", "_range", F.col("_side.at").alias("_v"), F.col("_side.late").alias("_late"), F.col("_r._k").alias("_k"), F.col("_r._values").alias("_values"))
        .groupBy("_g", "_range", "_v", "_k")
        .agg(old.alias("_old"), new.alias("_new"))
    )
    kind = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    )
    return met.select(F.col("_g").alias(group), F.col("_v").alias(version), F.col("_k").alias(key), kind.alias("change_kind")).where("change_kind is not null")


def change_counts(changes: DataFrame, group: str = "wiki", version: str = "dump_date") -> DataFrame:
    """Changes per group, later snapshot and kind."""
    return changes.groupBy(group, version, "change_kind").agg(F.count("*").alias("n_records"))
