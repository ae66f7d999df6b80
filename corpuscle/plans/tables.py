"""Queries of the general table operators, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import references, skew, snapshots
from corpuscle.session import table

#: Share of all rows from which p5_found reports a key.
FOUND_SHARE = 0.01


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "page"))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_counts(p1_found(spark, d))


def _references(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    return {t: table(spark, d, t) for t in ("page", "surface_source")}, table(spark, d, "qid_flags")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(*_references(spark, d))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(*_references(spark, d))


def _profiles(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    edges = table(spark, d, "surface_source")
    heavy, total = skew.all_heavy_keys(edges, ["surface_key", "qid"])
    by_key = skew.key_profile(edges, "surface_key", "qid", heavy=heavy["surface_key"]).withColumnRenamed("surface_key", "key_text")
    by_qid = skew.key_profile(edges, "qid", "surface_key", heavy=heavy["qid"]).withColumn("key_text", F.col("qid").cast("string"))
    said = lambda part, field: part.select(F.lit(field).alias("key_field"), "key_text", "n_rows", "n_partners")
    return said(by_key, "surface_key").unionByName(said(by_qid, "qid")), total


def p5_keys(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d)[0]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    keys, total = _profiles(spark, d)
    return keys.where(F.col("n_rows") >= FOUND_SHARE * total).select("key_field", "key_text")


def p5_join(spark: SparkSession, d: str) -> DataFrame:
    """Edges with the dictionary entry of their key: rows a surface, through the join that copes with heavy keys."""
    keys = table(spark, d, "surface_qids").select("surface_key", "surface_id").distinct()
    met = skew.skew_join(table(spark, d, "surface_source").select("surface_key", "qid"), keys, "surface_key")
    return met.groupBy("surface_id").agg(F.count("*").alias("n_edges"), F.sum("qid").alias("sum_qid"))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p3_found, p3_report, p5_found, p5_keys, p5_join)}

_P1 = """
WITH r AS (SELECT wiki, dump_date, page_id, title, qid FROM page WHERE wiki IS NOT NULL AND dump_date IS NOT NULL AND page_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY wiki, dump_date, page_id ORDER BY loaded_at DESC NULLS LAST, title DESC NULLS LAST, qid DESC NULLS LAST) = 1),
v AS (SELECT wiki, dump_date, lead(dump_date) OVER (PARTITION BY wiki ORDER BY dump_date) AS nxt FROM (SELECT DISTINCT wiki, dump_date FROM r)),
o AS (SELECT r.*, v.nxt FROM r JOIN v USING (wiki, dump_date) WHERE v.nxt IS NOT NULL),
n AS (SELECT r.* FROM r WHERE EXISTS (SELECT 1 FROM v WHERE v.wiki = r.wiki AND v.nxt = r.dump_date)),
found AS (SELECT coalesce(n.wiki, o.wiki) AS wiki, coalesce(n.dump_date, o.nxt) AS dump_date, coalesce(n.page_id, o.page_id) AS page_id,
  CASE WHEN o.page_id IS NULL THEN 'added' WHEN n.page_id IS NULL THEN 'removed'
       WHEN o.title IS DISTINCT FROM n.title OR o.qid IS DISTINCT FROM n.qid THEN 'changed' END AS change_kind
  FROM o FULL JOIN n ON o.wiki = n.wiki AND o.nxt = n.dump_date AND o.page_id = n.page_id)
"""
_P3 = """
WITH refs AS (SELECT 'page' AS ref_table, dump_date, qid FROM page UNION SELECT 'surface_source', dump_date, qid FROM surface_source),
asked AS (SELECT * FROM refs WHERE qid IS NOT NULL AND dump_date IS NOT NULL),
found AS (SELECT * FROM asked a WHERE NOT EXISTS (SELECT 1 FROM qid_flags f WHERE f.qid = 'Q' || a.qid AND f.valid_from <= a.dump_date
  AND (f.valid_to IS NULL OR f.valid_to > a.dump_date)))
"""
_P5 = """
WITH keys AS (
  SELECT 'surface_key' AS key_field, surface_key AS key_text, count(*) AS n_rows, count(DISTINCT qid) AS n_partners
  FROM surface_source WHERE surface_key IS NOT NULL GROUP BY surface_key
  UNION ALL
  SELECT 'qid', CAST(qid AS VARCHAR), count(*), count(DISTINCT surface_key) FROM surface_source WHERE qid IS NOT NULL GROUP BY qid)
"""
ORACLES = {
    "p1_found": _P1 + "SELECT * FROM found WHERE change_kind IS NOT NULL",
    "p1_counts": _P1 + "SELECT wiki, dump_date, change_kind, count(*) AS n_records FROM found WHERE change_kind IS NOT NULL GROUP BY ALL",
    "p3_found": _P3 + "SELECT * FROM found",
    "p3_report": _P3 + """SELECT ref_table, dump_date, count(*) AS n_keys, count(f.qid) AS n_orphans
  FROM asked LEFT JOIN (SELECT ref_table, dump_date, qid FROM found) f USING (ref_table, dump_date, qid) GROUP BY ALL""",
    "p5_keys": _P5 + "SELECT * FROM keys",
    "p5_found": _P5 + "SELECT key_field, key_text FROM keys WHERE n_rows >= 0.01 * (SELECT count(*) FROM surface_source)",
    "p5_join": """SELECT k.surface_id, count(*) AS n_edges, CAST(sum(e.qid) AS BIGINT) AS sum_qid
  FROM surface_source e JOIN (SELECT DISTINCT surface_key, surface_id FROM surface_qids) k USING (surface_key) GROUP BY k.surface_id""",
}
