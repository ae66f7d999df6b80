"""Per-key results and joins where a handful of keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpuscle.session import BROADCAST_ROWS, small

#: Share of all rows from which a key is processed apart from the others, and rows of such a key that one task of a salted join takes.
HEAVY_SHARE, ROWS_A_SALT = 0.005, 500_000


def heavy_keys(rows: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """A superset of the non-null keys with more than ``share`` of all rows: at most 1 / ``share`` of them, by a counter sketch in one pass."""
    found = rows.select(F.col(key).alias("k")).where("k is not null").freqItems(["k"], share).first()
    return _as_heavy(rows, key, found[0] if found else [])


def _as_heavy(rows: DataFrame, key: str, found: list | None) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(k,) for k in found or [] if k is not None], f"_heavy {kind}")


def all_heavy_keys(rows: DataFrame, keys: list[str], share: float = HEAVY_SHARE) -> tuple[dict[str, DataFrame], int]:
    """``heavy_keys`` of several columns, and the number of rows, from one pass; a null takes a place in the sketch like a key."""
    asked = rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    seen = Observation()
    found = asked.observe(seen, F.count(F.lit(1)).alias("n")).freqItems([f"k{i}" for i in range(len(keys))], share).first()
    return {k: _as_heavy(rows, k, found[i] if found else []) for i, k in enumerate(keys)}, seen.get["n"]


def key_profile(rows: DataFrame, key: str, partner: str, share: float = HEAVY_SHARE, heavy: DataFrame | None = None) -> DataFrame:
    """For every non-null value of ``key``: ``key``, ``n_rows``, ``n_partners`` (distinct non-null ``partner``), ``is_heavy``.

    Null keys give no row; a key whose partners are all null has 0 of them. Exact for all keys: the sketch only decides which
    way a key goes. Rows of heavy keys are found by a broadcast join with the at most 1 / ``share`` candidates and are counted
    per (key, partner) before they move, so that such a key is spread by its partners and arrives as counts. The other keys,
    none of which holds more than ``share``, take an ordinary shuffle by key. An empty table gives an empty result. ``heavy`` saves the pass of the sketch.
    """
    pairs = rows.select(F.col(key).alias("_k"), F.col(partner).alias("_p")).where("_k is not null")
    heavy = F.broadcast(heavy_keys(rows, key, share) if heavy is None else heavy)
    many = (
        pairs.join(heavy, F.col("_k") == F.col("_heavy"), "left_semi")
        .groupBy("_k", "_p")
        .agg(F.count("*").alias("_n"))
        .groupBy("_k")
        .agg(F.sum("_n").alias("n_rows"), F.count("_p").alias("n_partners"))
    )
    few = (
        pairs.join(heavy, F.col("_k") == F.col("_heavy"), "left_anti")
        .repartition("_k")
        .groupBy("_k")
        .agg(F.count("*").alias("n_rows"), F.count_distinct("_p").alias("n_partners"))
    )
    said = lambda part, apart: part.select(F.col("_k").alias(key), "n_rows", "n_partners", F.lit(apart).alias("is_heavy"))
    return said(many, True).unionByName(said(few, False))


def salted_join(left: DataFrame, right: DataFrame, key: str, rows_a_salt: int = ROWS_A_SALT) -> DataFrame:
    """Inner equi-join of few keys with many rows: each key of ``left`` is dealt row by row, evenly, to as many parts as its count asks for, and meets the rows of ``right`` in each."""
    parts = left.groupBy(key).agg(F.ceil(F.count("*") / rows_a_salt).cast("int").alias("_parts"))
    parts, _ = small(parts)
    # By place, not by content, so that equal rows are dealt like others.
    dealt = left.withColumn("_place", F.monotonically_increasing_id()).join(parts, key).withColumn("_salt", F.pmod("_place", "_parts").cast("int"))
    each = right.join(parts, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.drop("_place", "_parts").join(each, [key, "_salt"]).drop("_salt")


def skew_join(left: DataFrame, right: DataFrame, key: str, share: float = HEAVY_SHARE, most: int = BROADCAST_ROWS, rows_a_salt: int = ROWS_A_SALT) -> DataFrame:
    """Inner equi-join on ``key`` where few keys hold most rows of ``left``; null keys meet nothing.

    Rows of heavy left keys meet the right rows of those keys by broadcast if these are at most ``most``; else by a salted join, in which each
    key is spread over as many tasks as it has ``rows_a_salt`` rows. All other keys take an ordinary
    shuffle join. ``key`` appears once; other columns of ``right`` that clash with ``left`` get the suffix ``_right``.
    """
    renamed = right
    for c in right.columns:
        if c != key and c in left.columns:
            renamed = renamed.withColumnRenamed(c, f"{c}_right")
    heavy = F.broadcast(heavy_keys(left, key, share))
    is_heavy = lambda df, how: df.join(heavy, df[key] == heavy["_heavy"], how)
    partner, fits = small(is_heavy(renamed, "left_semi"), most)
    hot = is_heavy(left, "left_semi")
    met = hot.join(partner, key) if fits else salted_join(hot, partner, key, rows_a_salt)
    return met.unionByName(is_heavy(left, "left_anti").join(is_heavy(renamed, "left_anti"), key))
