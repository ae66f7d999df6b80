"""Table files of the dictionary, and side files that describe what was written."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.text import qid_number, qid_number_strict, qid_text, tsv_escape, tsv_unescape

_TSV = {"sep": "\t", "header": True, "quote": "", "escape": "", "enforceSchema": False, "mode": "FAILFAST", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": "", "nullValue": "\0"}


def write_surfaces_tsv(surfaces: DataFrame, path: str) -> None:
    """``surface_key``, ``qids`` (``Q1|Q2``), ``qid_count`` in the byte order of the keys; each file has the header."""
    listed = F.array_join(F.transform("qids", qid_text), "|")
    out = surfaces.orderBy("surface_key").select(tsv_escape(F.col("surface_key")).alias("surface_key"), listed.alias("qids"), F.col("qid_count").cast("string").alias("qid_count"))
    out.write.mode("overwrite").options(sep="\t", header=True, quote="", escape="", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_surfaces_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The table back: key, entities in the order of the file, count. A wrong header, an empty key or a malformed entity is an error."""
    rows = spark.read.options(**_TSV).schema("surface_key string, qids string, qid_count int").csv(path)
    key = F.when(F.coalesce(F.col("surface_key"), F.lit("")) == "", F.raise_error(F.lit("empty surface key"))).otherwise(tsv_unescape(F.col("surface_key")))
    numbers = F.transform(F.filter(F.split("qids", r"\|"), lambda q: q != ""), qid_number_strict)
    return rows.select(key.alias("surface_key"), numbers.alias("qids"), "qid_count")


def write_flags_tsv(flags: DataFrame, path: str) -> None:
    """``qid``, ``flags`` by ascending number."""
    flags.orderBy("qid").select(qid_text(F.col("qid")).alias("qid"), "flags").write.mode("overwrite").options(sep="\t", header=True).csv(path)


def read_flags_tsv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.options(**_TSV).schema("qid string, flags int").csv(path)
    return rows.select(qid_number_strict(F.col("qid")).alias("qid"), "flags")


def _files(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path as it knows it)."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(where)


def publish(dictionary: DataFrame, path: str, facts: DataFrame | None = None) -> None:
    """Write the dictionary by shard, with its side file (``facts``, one row), under a hidden name, then rename the folder to that of a new version.

    Readers take the last version, so they see the old one or the new one, data and side file together, at any time; the version that was in use stays for readers
    that have it open, older ones are removed. The rename is atomic on HDFS and local disks.
    """
    spark, root = dictionary.sparkSession, path.rstrip("/")
    name = f"version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    dictionary.repartitionByRange("surface_id").sortWithinPartitions("surface_id").write.partitionBy("shard_id").parquet(f"{root}/.{name}/data")
    if facts is not None:
        facts.coalesce(1).write.json(f"{root}/.{name}/manifest")
    system, hidden = _files(spark, f"{root}/.{name}")
    if not system.rename(hidden, _files(spark, f"{root}/{name}")[1]):
        raise OSError(f"cannot publish {name} under {root}")
    for old in _versions(spark, root)[:-2]:
        system.delete(_files(spark, f"{root}/{old}")[1], True)


def _versions(spark: SparkSession, path: str) -> list[str]:
    system, root = _files(spark, path)
    found = [status.getPath().getName() for status in system.listStatus(root)] if system.exists(root) else []
    return sorted(name for name in found if name.startswith("version-"))


def current_version(spark: SparkSession, path: str) -> str | None:
    """The version of a published dictionary that is in use; None if there is none."""
    return (_versions(spark, path) or [None])[-1]


def open_dictionary(spark: SparkSession, path: str, contract: str | None = None, validate: bool = True) -> DataFrame:
    """The published dictionary in use; ``ValueError`` if there is none, if its side file names another normalization contract than ``contract``, or if it is not whole.

    Whole: shards from 0 on, each an unbroken range of ids that begins where the one before ends, and as many keys as the side file says.
    """
    version = current_version(spark, path)
    if version is None:
        raise ValueError(f"no dictionary is published under {path}")
    rows = spark.read.parquet(f"{path.rstrip('/')}/{version}/data")
    said = read_manifest(spark, path).first() if contract is not None or _has_manifest(spark, path, version) else None
    if contract is not None and (said is None or said["surface_normalization"] != contract):
        raise ValueError("the dictionary was made under another normalization contract")
    if validate:
        shards = rows.groupBy("shard_id").agg(F.min("surface_id").alias("first"), F.max("surface_id").alias("last"), F.count("*").alias("n")).orderBy("shard_id").collect()
        expected = 0
        for number, shard in enumerate(shards):
            if shard.shard_id != number or shard["first"] != expected or shard["last"] - shard["first"] + 1 != shard.n:
                raise ValueError(f"shard {shard.shard_id} does not follow the shards before it")
            expected = shard["last"] + 1
        if said is not None and "surface_count" in said and said["surface_count"] != expected:
            raise ValueError(f"{expected} keys where the side file says {said['surface_count']}")
    return rows


def _has_manifest(spark: SparkSession, path: str, version: str) -> bool:
    system, where = _files(spark, f"{path.rstrip('/')}/{version}/manifest")
    return system.exists(where)


def stamped(facts: DataFrame, **said: object) -> DataFrame:
    """One row of counts and settings, with the time of writing."""
    return facts.withColumns({k: F.lit(v if isinstance(v, (int, str, bool)) else json.dumps(v)) for k, v in said.items()} | {"generated_at_unix": F.lit(int(time.time()))})


def write_manifest(facts: DataFrame, path: str, **said: object) -> None:
    """One JSON line beside a table."""
    stamped(facts, **said).coalesce(1).write.mode("overwrite").json(path.rstrip("/") + "_manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The side file of a table, or of the version of a published dictionary that is in use."""
    version = current_version(spark, path)
    return spark.read.json(f"{path.rstrip('/')}/{version}/manifest" if version else path.rstrip("/") + "_manifest")


def checksums(spark: SparkSession, path: str, piece: int = 8 << 20) -> DataFrame:
    """(``file``, ``md5``, ``bytes``) of the files under a path, named from there on, of any size: each is read piece by piece where a task runs; hidden files are left out."""
    system, root = _files(spark, path)
    if system.getFileStatus(root).isFile():
        listed = [(root.getName(), root.toString())]
    else:
        found, listed, cut = system.listFiles(root, True), [], len(root.toString()) + 1
        while found.hasNext():
            where = found.next().getPath().toString()
            if not any(part[0] in "._" for part in where[cut:].split("/")):
                listed.append((where[cut:], where))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for where in batch.column(1).to_pylist():
                uri = "file://" + where[5:] if where.startswith("file:/") and not where.startswith("file://") else where
                if uri.startswith("file://"):
                    files, at = pafs.LocalFileSystem(), uri[7:]
                else:
                    files, at = pafs.FileSystem.from_uri(uri)
                total, size = hashlib.md5(), 0
                with files.open_input_stream(at) as stream:
                    while data := stream.read(piece):
                        total.update(data)
                        size += len(data)
                rows.append((total.hexdigest(), size))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.string()), (1, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["file", "md5", "bytes"])

    names = spark.createDataFrame(listed, "file string, path string")
    return names.repartition(max(1, len(listed)), "file").mapInArrow(digest, "file string, md5 string, bytes long")


def delivered(rows: DataFrame) -> DataFrame:
    """A delivered dictionary table (``qids`` as ``Q1|Q2``) as edges (``surface_key``, ``qid``); entries that are no entity ids are dropped."""
    return rows.select("surface_key", F.explode(F.split("qids", r"\|")).alias("_q")).select("surface_key", qid_number(F.col("_q")).alias("qid")).where("qid is not null and surface_key is not null")


def write_lines(events: DataFrame, path: str, key: str = "doc_id") -> None:
    """Event lines as text files, the lines of each text together and in order."""
    events.repartition(key).sortWithinPartitions(key, "seq").select("line").write.mode("overwrite").text(path)
