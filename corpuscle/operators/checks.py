"""What a dictionary holds, and what is wrong with it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.normalize import UNICODE_VERSION
from corpuscle.functions.text import DISAMBIGUATION, qid_number

CONTRACT = f"per code point: delete, separate, NFKC, full case fold, NFD without marks; Unicode {UNICODE_VERSION}"


def metadata(dictionary: DataFrame, flags: DataFrame) -> DataFrame:
    """One row: contract, keys, entities known, entities that are disambiguations, shards."""
    keys = dictionary.agg(F.count("*").alias("surface_count"), F.count_distinct("shard_id").alias("shard_count"))
    known = flags.agg(F.count("*").alias("qid_count"), F.coalesce(F.sum(F.col("flags").bitwiseAND(DISAMBIGUATION)), F.lit(0)).alias("disambiguation_count"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(keys).join(one(known), "_one").select(F.lit(CONTRACT).alias("surface_normalization"), "surface_count", "qid_count", "disambiguation_count", "shard_count")


def violations(surfaces: DataFrame) -> DataFrame:
    """(``surface_id``, ``problem``) of a delivered dictionary (``surface_id``, ``surface_key``, ``qids`` as ``Q1|Q2``, ``qid_count``).

    Problems: ``empty_key``, ``bad_qid`` (an entry that is no entity id), ``wrong_count``, ``repeated_id``, ``repeated_key``. A row may have several; repeated rows report
    once each id. Null columns count as empty.
    """
    listed = F.filter(F.split(F.coalesce("qids", F.lit("")), r"\|"), lambda q: q != "")
    row_problems = F.array_compact(
        F.array(
            F.when(F.coalesce("surface_key", F.lit("")) == "", "empty_key"),
            F.when(F.exists(listed, lambda q: qid_number(q).isNull()), "bad_qid"),
            F.when(~F.size(listed).eqNullSafe(F.col("qid_count")), "wrong_count"),
        )
    )
    own = surfaces.select("surface_id", F.explode(row_problems).alias("problem"))
    repeated = surfaces.groupBy("surface_id").count().where("count > 1").select("surface_id", F.lit("repeated_id").alias("problem"))
    twice = surfaces.where("surface_key is not null").groupBy("surface_key").agg(F.count_distinct("surface_id").alias("n"), F.min("surface_id").alias("surface_id"))
    return reduce(DataFrame.unionByName, [own, repeated, twice.where("n > 1").select("surface_id", F.lit("repeated_key").alias("problem"))]).distinct()
