"""Readers of SQL-text and JSON entity dumps, and a writer that renders rows as such a dump."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FIELD = re.compile(r"((?:'(?:[^'\\]|\\.)*'|[^',)])*)([,)])", re.S)
_QUOTED = re.compile(r"'((?:[^'\\]|\\.)*)'", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)
_BETWEEN = re.compile(r"[,\s]*")
# Escapes of the dump format; any other character stands for itself.
_ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a"}
_ASCII_BLANKS = " \t\n\f\r"


def _value(raw: str) -> str:
    outside = _QUOTED.sub("", raw)
    if "NULL" in outside:
        return ""
    plain = _QUOTED.sub(lambda m: _ESCAPE.sub(lambda e: _ESCAPES.get(e[1], e[1]), m[1]), raw)
    return plain.strip(_ASCII_BLANKS)


def parse_tuples(values: str) -> Iterator[list[str]]:
    """The tuples of a VALUES list as texts: NULL is empty, fields are trimmed, two quotes in a row join what they part; a tuple without end is dropped."""
    at = _BETWEEN.match(values).end()
    while at < len(values):
        if values[at] != "(":
            raise ValueError(f"expected a tuple at character {at}")
        at, fields, end = at + 1, [], ""
        while end != ")":
            m = _FIELD.match(values, at)
            if not m:
                return
            fields.append(_value(m[1]))
            at, end = m.end(), m[2]
        yield fields
        at = _BETWEEN.match(values, at).end()


def read_insert_values(spark: SparkSession, path: str, table: str, limit: int | None = None) -> DataFrame:
    """(``fields`` array<string>) of the INSERT lines of ``table`` in plain or compressed text files; bytes that are no UTF-8 become U+FFFD.

    A gzip file is one task; dumps of many files, or bzip2 ones, spread. ``limit`` bounds the tuples taken (a debug limit).
    """
    start = f"INSERT INTO `{table}` VALUES "

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.column(0).to_pylist():
                rows = list(parse_tuples(line))
                for lo in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(rows[lo : lo + 10_000], pa.list_(pa.string()))], names=["fields"])

    lines = spark.read.text(path).where(F.col("value").startswith(start))
    values = lines.select(F.rtrim(F.make_valid_utf8(F.substring("value", len(start) + 1, 1 << 30)), F.lit(";")).alias("values"))
    rows = values.mapInArrow(parse, "fields array<string>")
    return rows if limit is None else rows.limit(limit)


def _field(n: int, kind: str = "string") -> Column:
    """Field ``n``; a number that is none is an error, as in the dumps it stands for a damaged file."""
    return F.element_at("fields", n + 1).cast(kind)


def read_page(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(``page_id``, ``namespace``, ``title``) of a page dump; rows of fewer than 4 fields are left out."""
    rows = read_insert_values(spark, path, "page", limit).where(F.size("fields") >= 4)
    return rows.select(_field(0, "long").alias("page_id"), _field(1, "int").alias("namespace"), _field(2).alias("title"))


def read_page_props(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(``page_id``, ``propname``, ``value``, ``ord``) of a page property dump; ``ord`` follows the order of the file."""
    rows = read_insert_values(spark, path, "page_props", limit).where(F.size("fields") >= 2)
    value = F.when(F.size("fields") >= 3, F.get("fields", F.lit(2)))
    return rows.select(_field(0, "long").alias("page_id"), _field(1).alias("propname"), value.alias("value"), F.monotonically_increasing_id().alias("ord"))


def read_redirect(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(``from_id``, ``namespace``, ``target_title``) of a redirect dump."""
    rows = read_insert_values(spark, path, "redirect", limit).where(F.size("fields") >= 3)
    return rows.select(_field(0, "long").alias("from_id"), _field(1, "int").alias("namespace"), _field(2).alias("target_title"))


_VALUE = T.StructType([T.StructField("value", T.StringType())])
_ID = T.StructType([T.StructField("id", T.StringType())])
_CLAIM = T.StructType([T.StructField("mainsnak", T.StructType([T.StructField("datavalue", T.StructType([T.StructField("value", _ID)]))]))])
ENTITY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), _VALUE)),
        T.StructField("aliases", T.MapType(T.StringType(), T.ArrayType(_VALUE))),
        T.StructField("sitelinks", T.MapType(T.StringType(), T.StructType([T.StructField("title", T.StringType())]))),
        T.StructField("claims", T.StructType([T.StructField("P31", T.ArrayType(_CLAIM))])),
    ]
)


def read_entities(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One row an entity of a JSON array dump, one entity a line; only the fields that are used are kept. A line that is no JSON is an error.

    Lines are cleaned of blanks and closing commas; brackets and empty lines are skipped. bzip2 files are read in parts.
    ``limit`` counts entities with a valid item id, as other kinds are skipped later anyway.
    """
    line = F.rtrim(F.rtrim(F.trim(F.col("value"))), F.lit(","))
    rows = spark.read.text(path).select(line.alias("line")).where(~F.col("line").isin("", "[", "]"))
    parsed = rows.select(F.from_json("line", ENTITY, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    if limit is None:
        return parsed
    from corpuscle.functions.text import qid_number

    return parsed.where(qid_number(F.col("id")).isNotNull()).limit(limit)


def _literal(value: Column, quoted: bool) -> Column:
    if not quoted:
        return F.coalesce(value.cast("string"), F.lit("NULL"))
    text = value
    for plain, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\0")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))


def write_insert_values(rows: DataFrame, path: str, table: str, a_line: int = 1000) -> None:
    """Render ``rows`` as the INSERT lines of a dump, gzip-compressed, ``a_line`` tuples a line at most."""
    cells = [_literal(F.col(f.name), isinstance(f.dataType, T.StringType)) for f in rows.schema.fields]
    tuples = rows.select(F.concat(F.lit("("), F.concat_ws(",", *cells), F.lit(")")).alias("t"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = batch.column(0).to_pylist()
            lines = [f"INSERT INTO `{table}` VALUES {','.join(got[i : i + a_line])};" for i in range(0, len(got), a_line)]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    tuples.mapInArrow(join, "value string").write.mode("overwrite").option("compression", "gzip").text(path)
