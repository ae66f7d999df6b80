"""The build from dump files to a published dictionary, and what can be asked of one."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions.normalize import normalize_spans
from corpuscle.operators import checks, dictionary, matching
from corpuscle.session import materialize
from corpuscle.sources import dumps, tables
from corpuscle.streaming.sessions import _lookup, _ready

WIKIS = ("zhwiki", "enwiki")


def targets(spark: SparkSession, out: str, wikis: Sequence[str] = WIKIS, components: Sequence[str] = T.COMPONENTS, date: str = "latest") -> DataFrame:
    """(``component``, ``wiki``, ``url``, ``path``) of the dump files a build reads; the entity dump is one for all wikis.

    Empty lists, an empty wiki, an unknown component or a malformed date are a ``ValueError``.
    """
    if not wikis or not components or any(not w.strip() for w in wikis):
        raise ValueError("at least one component and one named wiki are needed")
    if not (date == "latest" or len(date) == 8 and date.isascii() and date.isdigit()):
        raise ValueError(f"date must be latest or YYYYMMDD, not {date}")
    known = [c.replace("-", "_") if c in ("page-props", "wikidata-entities") else c for c in components]
    if unknown := set(known) - set(T.COMPONENTS):
        raise ValueError(f"unknown components: {sorted(unknown)}")
    rows = [(i, c, w, date) for i, c in enumerate(known) for w in ([None] if c == "wikidata_entities" else wikis)]
    planned = spark.createDataFrame(rows, "n int, component string, wiki string, date string")
    args = (F.col("component"), F.col("wiki"), F.col("date"))
    folder = F.when(F.col("wiki").isNull(), F.lit("wikidatawiki")).otherwise(F.col("wiki"))
    path = F.concat_ws("/", F.lit(out.rstrip("/")), folder, F.col("date"), T.dump_file(*args))
    return planned.select("component", "wiki", T.dump_url(*args).alias("url"), path.alias("path"))


def preprocess(spark: SparkSession, dump_dir: str, out: str, wikis: Sequence[str] = WIKIS, date: str = "latest", limit: int | None = None) -> None:
    """Read the dumps of ``targets`` under ``dump_dir`` and write ``out``/surface_qids and ``out``/qid_flags as TSV, with the counts of each stage beside."""
    paths = {(r.component, r.wiki): r.path for r in targets(spark, dump_dir, wikis, date=date).collect()}
    edges, flags, all_pages, redirects = [], [], [], []
    for wiki in wikis:
        pages = materialize(
            dictionary.attach_props(dictionary.articles(dumps.read_page(spark, paths["page", wiki], limit)), dumps.read_page_props(spark, paths["page_props", wiki], limit)), "pages"
        )
        led = dictionary.redirect_surfaces(pages, dumps.read_redirect(spark, paths["redirect", wiki], limit))
        edges += [dictionary.title_surfaces(pages), led]
        flags.append(dictionary.page_flags(pages))
        all_pages.append(pages)
        redirects.append(led)
    entities = dumps.read_entities(spark, paths["wikidata_entities", None], limit)
    surfaces = materialize(dictionary.surface_qids(*edges, dictionary.entity_surfaces(entities, wikis)), "surfaces")
    known = materialize(dictionary.qid_flags(*flags, dictionary.entity_flags(entities)), "flags")
    tables.write_surfaces_tsv(surfaces, f"{out}/surface_qids")
    tables.write_flags_tsv(known, f"{out}/qid_flags")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    stages = dictionary.stage_counts(union(all_pages), union(redirects), entities, wikis)
    tables.write_manifest(stages.agg(F.map_from_entries(F.collect_list(F.struct("stage", "n"))).alias("stages")), f"{out}/surface_qids", wikis=",".join(wikis), date=date)


def compile_dictionary(spark: SparkSession, preprocessed: str, out: str, shard_size: int = dictionary.SHARD_SIZE) -> None:
    """Number, shard, check and publish what ``preprocess`` wrote: ``out``/dictionary by shard with candidates, ``out``/qids, and a side file."""
    surfaces, flags = tables.read_surfaces_tsv(spark, f"{preprocessed}/surface_qids"), tables.read_flags_tsv(spark, f"{preprocessed}/qid_flags")
    if wrong := surfaces.where("size(qids) != qid_count").limit(1).count():
        raise ValueError(f"counts that don't fit their entities: {wrong}")
    known = materialize(dictionary.attach_flags(dictionary.with_surface_ids(surfaces, shard_size), flags), "dictionary")
    used = materialize(dictionary.referenced_qids(known, flags), "qids")
    used.repartitionByRange("qid").sortWithinPartitions("qid").write.mode("overwrite").parquet(f"{out}/qids")
    tables.publish(known, f"{out}/dictionary", tables.stamped(checks.metadata(known, used), shard_size=shard_size))


def open_runtime(spark: SparkSession, data_dir: str | None = None) -> DataFrame:
    """The dictionary published under ``data_dir``, else under $CORPUSCLE_DATA_DIR; refused if made under another normalization contract."""
    where = data_dir or os.environ.get("CORPUSCLE_DATA_DIR")
    if not where:
        raise ValueError("no data folder is named")
    return tables.open_dictionary(spark, f"{where}/dictionary", checks.CONTRACT)


def match_texts(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text", include_disambiguation: bool = True, most: int | None = None) -> DataFrame:
    """Matches of texts with candidates, in order."""
    found = matching.find_matches(docs, known, key, text)
    return matching.in_order(matching.with_candidates(found, known, include_disambiguation, most), key)


def register_matcher(known: DataFrame, name: str = "match_text") -> None:
    """Make the matcher known to SQL: ``name``(text) gives an array of (start, end, surface_id) in order; for dictionaries that fit an executor."""
    spark = known.sparkSession
    sent = _lookup(known)

    @F.pandas_udf("array<struct<start: int, `end`: int, surface_id: long>>")
    def match_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lookup = _ready(sent)
        for texts in parts:
            out = []
            for t in texts:
                norm, starts, ends = normalize_spans(t or "")
                found = sorted((int(starts[a]), int(ends[b - 1]), sid) for a, b, sid in lookup.search(norm))
                out.append([{"start": a, "end": b, "surface_id": sid} for a, b, sid in found])
            yield pd.Series(out)

    spark.udf.register(name, match_text)
