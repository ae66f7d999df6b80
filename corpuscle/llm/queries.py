"""Queries of the operators on training text, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import frequent, leakage, lookalike, packing, subjects
from corpuscle.session import materialize, small, table

#: Share of all rows from which p2_found reports a value.
FOUND_SHARE = 0.005


def p2_intervals(spark: SparkSession, d: str) -> DataFrame:
    fields = {
        "surface_id": F.array("surface_id"),
        "qid": F.array_distinct(F.col("qids.qid_number")),
    }
    return frequent.frequent_items(table(spark, d, "text_match"), fields, FOUND_SHARE)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_intervals(spark, d).select("field_name", "item")


def p2_checked(spark: SparkSession, d: str) -> DataFrame:
    """The items of the intervals with their exact counts, from a second pass, and whether the interval holds it."""
    rows, found = table(spark, d, "text_match"), small(p2_intervals(spark, d))[0]
    values = rows.select(F.lit("surface_id").alias("field_name"), F.col("surface_id").alias("item"))
    values = values.unionByName(rows.select(F.lit("qid").alias("field_name"), F.explode(F.array_distinct("qids.qid_number")).alias("item")))
    exact = values.join(found, ["field_name", "item"]).groupBy("field_name", "item", "count_low", "count_high", "n_rows").agg(F.count("*").alias("n_exact"))
    return exact.where(F.col("n_exact") >= FOUND_SHARE * F.col("n_rows")).select("field_name", "item", "n_exact", F.col("n_exact").between(F.col("count_low"), F.col("count_high")).alias("inside"))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    columns = {"page": (table(spark, d, "page"), "title"), "surface_source": (table(spark, d, "surface_source"), "surface_key")}
    return lookalike.screen_forms(lookalike.values_of(columns), ["ref_table"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.alike_pairs(p4_forms(spark, d), ["ref_table"])


def p4_checked(spark: SparkSession, d: str) -> DataFrame:
    """By table: values, values whose form is not its own form, and plain spellings (full-width digits and blanks replaced) that got several forms."""
    forms = p4_forms(spark, d)
    plain = F.trim(F.translate("text", "０１２３４５６７８９\u00a0\u3000", "0123456789  "))
    again = lookalike.screen_forms(forms.select("ref_table", F.col("form").alias("text")), ["ref_table"])
    unstable = again.where("text != form").groupBy("ref_table").agg(F.count("*").alias("n_unstable"))
    split = forms.groupBy("ref_table", plain.alias("plain")).agg(F.count_distinct("form").alias("k")).where("k > 1").groupBy("ref_table").agg(F.count("*").alias("n_split"))
    values = forms.groupBy("ref_table").agg(F.count("*").alias("n_values"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return values.join(unstable, "ref_table", "left").join(split, "ref_table", "left").select("ref_table", "n_values", zero("n_unstable"), zero("n_split"))


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """One row: texts placed, texts whose pieces don't follow each other, sequences too full or with pieces that overlap or leave a gap, and whether there are few enough sequences."""
    placed = materialize(p6_packing(spark, d), "packed")
    size = F.col("token_end") - F.col("token_start")
    texts = placed.groupBy("doc_id").agg(F.sum(size).alias("n"), F.max("token_end").alias("last"), F.count_distinct("piece_no").alias("k"), F.count("*").alias("m"))
    sequences = placed.where("sequence_id is not null").groupBy("sequence_id").agg(
        F.sum(size).alias("n"), F.max(F.col("position") + size).alias("last"), F.count_distinct("position").alias("k"), F.count("*").alias("m")
    )
    broken = F.count_if((F.col("n") != F.col("last")) | (F.col("k") != F.col("m")))
    a = texts.agg(F.count("*").alias("n_texts"), broken.alias("broken_texts")).withColumn("_one", F.lit(1))
    b = sequences.agg(
        F.count_if(F.col("n") > packing.CAPACITY).alias("too_full"),
        broken.alias("broken_sequences"),
        (F.count("*") <= F.ceil(F.sum("n") / packing.CAPACITY) * 1.01 + 1).alias("well_filled"),
    ).withColumn("_one", F.lit(1))
    return a.join(b, "_one").drop("_one")


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_sequences(table(spark, d, "documents"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p6_packing(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents"), table(spark, d, "subject_label"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_counts(p8_found(spark, d))


def p8_topics(spark: SparkSession, d: str) -> DataFrame:
    return subjects.topic_terms(table(spark, d, "documents"), table(spark, d, "subject_label"))


QUERIES = {f.__name__: f for f in (p2_found, p2_intervals, p2_checked, p4_found, p4_forms, p4_checked, p6_packing, p6_report, p6_checked, p7_found, p8_found, p8_counts, p8_topics)}
_P2 = """
WITH v AS (SELECT 'surface_id' AS field_name, surface_id AS item FROM text_match WHERE surface_id IS NOT NULL
  UNION ALL SELECT 'qid', unnest(list_distinct([x.qid_number for x in qids])) FROM text_match)
"""
_FREQUENT = "FROM v WHERE item IS NOT NULL GROUP BY field_name, item HAVING count(*) >= 0.005 * (SELECT count(*) FROM text_match)"
ORACLES = {
    "p2_found": f"{_P2} SELECT field_name, item {_FREQUENT}",
    "p2_checked": f"{_P2} SELECT field_name, item, count(*) AS n_exact, true AS inside {_FREQUENT}",
    "p4_checked": """
WITH v AS (SELECT 'page' AS ref_table, title AS text FROM page UNION SELECT 'surface_source', surface_key FROM surface_source)
SELECT ref_table, count(*) AS n_values, CAST(0 AS BIGINT) AS n_unstable, CAST(0 AS BIGINT) AS n_split FROM v WHERE text IS NOT NULL GROUP BY ref_table""",
    "p6_checked": """SELECT count(DISTINCT doc_id) AS n_texts, CAST(0 AS BIGINT) AS broken_texts, CAST(0 AS BIGINT) AS too_full, CAST(0 AS BIGINT) AS broken_sequences,
  true AS well_filled FROM documents""",
}
