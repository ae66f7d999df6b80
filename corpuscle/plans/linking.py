"""Queries of the dictionary build and of matching, with the SQL each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions.normalize import normalized, normalized_spans
from corpuscle.operators import checks, dictionary, matching
from corpuscle.plans.linking_sql import ORACLES  # noqa: F401
from corpuscle.session import scratch, table
from corpuscle.sources import dumps, tables
from corpuscle.streaming import sessions

WIKIS = ("enwiki", "dewiki")
SHARD = 1_000


# Inputs in the shape of the dumps, rendered from the tables.


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """The latest record of each page, with an id that is unique over all wikis."""
    rows = table(spark, d, "page").where("wiki is not null and page_id is not null")
    last = Window.partitionBy("wiki", "page_id").orderBy(F.desc("dump_date"), F.desc("loaded_at"), F.desc_nulls_last("title"), F.desc_nulls_last("qid"))
    wikis = rows.select("wiki").distinct().select("wiki", F.row_number().over(Window.orderBy("wiki")).alias("n"))  # one row a wiki
    latest = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return latest.join(wikis, "wiki").select("wiki", (F.col("page_id") * 1000 + F.col("n")).alias("page_id"), F.coalesce("title", F.lit("")).alias("title"), "qid", "is_disambiguation")


def _page_dump(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "dump-page")
    pages = _pages(spark, d)
    render = lambda key, namespace: pages.select(key.alias("page_id"), F.lit(namespace).alias("namespace"), "title", F.lit(0).alias("redirect"))
    rows = render(F.col("page_id"), 0).union(render(F.col("page_id") + 500, 4))  # each page has a talk page, which is none of the dictionary
    dumps.write_insert_values(rows, path, "page")
    return dumps.read_page(spark, path)


def _props_dump(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "dump-page-props")
    pages = _pages(spark, d)
    items = pages.where("qid is not null").select("page_id", F.lit("wikibase_item").alias("propname"), T.qid_text(F.col("qid")).alias("value"))
    lists = pages.where("is_disambiguation").select("page_id", F.lit("disambiguation"), F.lit(""))
    other = pages.select("page_id", F.lit("displaytitle"), "title").union(pages.select(-F.col("page_id"), F.lit("wikibase_item"), F.lit("Q1")))
    dumps.write_insert_values(items.union(lists).union(other), path, "page_props")
    return dumps.read_page_props(spark, path)


def _joined_pages(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.attach_props(dictionary.articles(_page_dump(spark, d)), _props_dump(spark, d))


def _redirect_dump(spark: SparkSession, d: str) -> DataFrame:
    """Each page leads to the title of the next one of its wiki."""
    path = scratch(spark, "dump-redirect")
    follow = F.lead("title").over(Window.partitionBy("wiki").orderBy("page_id"))
    led = _pages(spark, d).select("page_id", F.lit(0).alias("namespace"), follow.alias("target")).where("target is not null")
    rows = led.union(led.select("page_id", F.lit(4), F.lit("elsewhere")))  # and one to another namespace, which is dropped
    dumps.write_insert_values(rows, path, "redirect")
    return dumps.read_redirect(spark, path)


def _with_wiki(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("wiki", F.col(key) % 1000)


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Entity dump of the delivered dictionary: an entity's keys as labels, aliases and sitelinks."""
    path = scratch(spark, "dump-entities")
    edges = tables.delivered(table(spark, d, "surface_qids"))
    flags = _flags(spark, d).where(F.col("flags").bitwiseAND(1) == 1).select("qid", F.lit("Q4167410").alias("kind"))
    label = lambda c: F.struct(c.alias("value"))
    by_qid = edges.groupBy("qid").agg(F.min("surface_key").alias("a"), F.max("surface_key").alias("b"), F.array_sort(F.collect_set("surface_key")).alias("all")).join(flags, "qid", "left")
    claim = F.struct(F.struct(F.struct(F.struct(F.col("kind").alias("id")).alias("value")).alias("datavalue")).alias("mainsnak"))
    entity = F.struct(
        T.qid_text(F.col("qid")).alias("id"),
        F.create_map(F.lit("en"), label(F.col("a")), F.lit("fr"), label(F.lit("left out"))).alias("labels"),
        F.create_map(F.lit("de"), F.transform("all", label)).alias("aliases"),
        F.create_map(F.lit("enwiki"), F.struct(F.col("b").alias("title"))).alias("sitelinks"),
        F.struct(F.when(F.col("kind").isNotNull(), F.array(claim)).alias("P31")).alias("claims"),
    )
    body = by_qid.select(F.concat(F.to_json(entity), F.lit(",")).alias("value"))
    spark.createDataFrame([("[",), ("]",), ('{"id":"P31"},',)], "value string").unionByName(body).write.option("compression", "bzip2").text(path)
    return dumps.read_entities(spark, path)


def _flags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qid_flags").select(T.qid_number(F.col("qid")).alias("qid"), "flags")
    return dictionary.qid_flags(rows)


def _surfaces(spark: SparkSession, d: str) -> DataFrame:
    edges = dictionary.with_keys(tables.delivered(table(spark, d, "surface_qids")).withColumnRenamed("surface_key", "_raw"), "_raw")
    return dictionary.surface_qids(edges)


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.with_surface_ids(_surfaces(spark, d), SHARD)


def _linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, the dictionary with candidates, and all matches."""
    docs = table(spark, d, "documents")
    known = dictionary.attach_flags(_dictionary(spark, d), _flags(spark, d))
    return docs, known, matching.find_matches(docs, known)


# Functions


def normalize_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", normalized(F.col("text")).alias("norm"))


def normalize_keys(spark, d):
    return table(spark, d, "surface_qids").select("surface_id", normalized(F.col("surface_key")).alias("norm"))


def normalize_spans(spark, d):
    return table(spark, d, "documents").select("doc_id", normalized_spans(F.col("text")).alias("s")).where("s.norm != ''").select("doc_id", "s.norm", "s.starts", "s.ends")


def utf16_lengths(spark, d):
    return table(spark, d, "surface_source").select("edge_id", T.utf16_length(F.col("surface_key")).alias("n_utf16"))


def tsv_escapes(spark, d):
    escaped = table(spark, d, "documents").select("doc_id", T.tsv_escape(F.col("text")).alias("escaped"))
    return escaped.withColumn("back", T.tsv_unescape(F.col("escaped")))


def tsv_roundtrip(spark, d):
    path = scratch(spark, "surfaces-tsv")
    tables.write_surfaces_tsv(_surfaces(spark, d), path)
    return tables.read_surfaces_tsv(spark, path)


def flags_roundtrip(spark, d):
    path = scratch(spark, "flags-tsv")
    tables.write_flags_tsv(_flags(spark, d), path)
    return tables.read_flags_tsv(spark, path)


def qid_parse(spark, d):
    number = T.qid_number(F.col("qid"))
    return table(spark, d, "qid_flags").select("qid", "valid_from", number.alias("number"), T.qid_text(number).alias("back"), T.is_disambiguation(F.col("flags")).alias("disambiguation"))


def dump_targets(spark, d):
    rows = table(spark, d, "page").select("wiki", "dump_date").where("wiki is not null and dump_date is not null").distinct()
    rows = rows.unionByName(rows.select("wiki").distinct().withColumn("dump_date", F.lit("latest"))).where(T.is_dump_date(F.col("dump_date")))
    parts = rows.withColumn("part", F.explode(T.split_option(F.lit(" page, redirect,,page-props,wikidata_entities"))))
    known = parts.select("wiki", "dump_date", T.component(F.col("part")).alias("component"))
    args = (F.col("component"), F.col("wiki"), F.col("dump_date"))
    return known.select("wiki", T.wiki_language(F.col("wiki")).alias("lang"), "dump_date", "component", T.dump_file(*args).alias("file"), T.dump_url(*args).alias("url"))


def file_checksums(spark, d):
    return tables.checksums(spark, d)


# Build


def dump_pages(spark, d):
    return dictionary.articles(_page_dump(spark, d))


def page_props_pivot(spark, d):
    return _joined_pages(spark, d)


def redirect_targets(spark, d):
    pages, redirects = _with_wiki(_joined_pages(spark, d), "page_id"), _with_wiki(_redirect_dump(spark, d), "from_id")
    return dictionary.resolve_redirects(pages, redirects, ["wiki"]).select("from_id", "title", "qid")


def title_surfaces(spark, d):
    """Titles and redirects of all wikis, one after the other."""
    pages, redirects = _with_wiki(_joined_pages(spark, d), "page_id"), _with_wiki(_redirect_dump(spark, d), "from_id")
    return dictionary.title_surfaces(pages).unionByName(dictionary.redirect_surfaces(pages, redirects, ["wiki"]))


def entity_surfaces(spark, d):
    return dictionary.entity_surfaces(_entities(spark, d), WIKIS)


def entity_flags(spark, d):
    return dictionary.entity_flags(_entities(spark, d))


def surface_dictionary(spark, d):
    edges = dictionary.with_keys(tables.delivered(table(spark, d, "surface_qids")).withColumnRenamed("surface_key", "_raw"), "_raw")
    return dictionary.surface_qids(edges, entity_surfaces(spark, d))


def merged_flags(spark, d):
    return dictionary.qid_flags(_flags(spark, d), dictionary.page_flags(_joined_pages(spark, d)))


def surface_ids(spark, d):
    return _dictionary(spark, d).select("surface_id", "shard_id", "surface_key", "qids", "utf16_len")


def shard_stats(spark, d):
    return dictionary.shard_stats(_dictionary(spark, d))


def referenced_qids(spark, d):
    return dictionary.referenced_qids(_surfaces(spark, d), _flags(spark, d))


def surface_offsets(spark, d):
    return dictionary.surface_offsets(_dictionary(spark, d))


def candidates(spark, d):
    return dictionary.attach_flags(_dictionary(spark, d), _flags(spark, d)).select("surface_id", F.to_json("candidates").alias("candidates"))


def char_codes(spark, d):
    return dictionary.char_codes(_surfaces(spark, d))


def stage_counts(spark, d):
    return dictionary.stage_counts(_joined_pages(spark, d), title_surfaces(spark, d), _entities(spark, d), WIKIS)


def dictionary_metadata(spark, d):
    return checks.metadata(_dictionary(spark, d), dictionary.referenced_qids(_surfaces(spark, d), _flags(spark, d))).drop("surface_normalization")


def dictionary_doctor(spark, d):
    return checks.violations(table(spark, d, "surface_qids"))


# Matching


def match_overlapping(spark, d):
    return matching.in_order(_linked(spark, d)[2])


def match_by_join(spark, d):
    return matching.find_matches(table(spark, d, "documents"), _dictionary(spark, d), method="join")


def _counted(matches: DataFrame) -> DataFrame:
    return matches.select("doc_id", "start", "end", "surface_id", "shard_id", F.array_join(F.transform("qids", lambda q: q["qid"]), "|").alias("qids"))


def match_candidates(spark, d):
    _, known, found = _linked(spark, d)
    return _counted(matching.with_candidates(found, known))


def match_no_disambiguation(spark, d):
    _, known, found = _linked(spark, d)
    return _counted(matching.with_candidates(found, known, include_disambiguation=False))


def match_cap_1(spark, d):
    _, known, found = _linked(spark, d)
    return _counted(matching.with_candidates(found, known, most=1))


def match_cap_0(spark, d):
    _, known, found = _linked(spark, d)
    return _counted(matching.with_candidates(found, known, most=0))


def match_counts(spark, d):
    docs, _, found = _linked(spark, d)
    return matching.match_counts(docs, found)


def match_events(spark, d):
    docs, known, found = _linked(spark, d)
    return matching.events(docs, matching.with_candidates(found, known))


def match_first(spark, d):
    return matching.first_matches(table(spark, d, "documents"), _dictionary(spark, d), 2)


def match_longest_per_end(spark, d):
    return matching.longest_per_end(_linked(spark, d)[2])


def _kind(how: str, first: bool = False):
    def query(spark, d):
        return matching.find_matches(table(spark, d, "documents"), _dictionary(spark, d), how=how, first=first)

    return query


def match_sessions(spark, d):
    """Documents sent in chunks of 100 characters, all there."""
    known = dictionary.attach_flags(_dictionary(spark, d), _flags(spark, d))
    return _matches_of(sessions.match_sessions(sessions.chunks_of(table(spark, d, "documents")), known))


def _matches_of(lines: DataFrame) -> DataFrame:
    event = F.from_json("line", "type string, match struct<start: int, `end`: int, surface_id: long>")
    found = lines.withColumn("e", event).where("e.type = 'match'")
    return found.select(F.col("session_id").cast("long").alias("doc_id"), "e.match.start", "e.match.end", "e.match.surface_id")


def stream_sessions(spark, d):
    """The same through Structured Streaming: micro-batches of files, state by session, answers appended to a table."""
    known = dictionary.attach_flags(_dictionary(spark, d), _flags(spark, d))
    source, out, point = (scratch(spark, x) for x in ("messages", "answers", "stream-state"))
    messages = sessions.chunks_of(table(spark, d, "documents"))
    late = F.col("seq") >= 3
    for part in (messages.where(~late), messages.where(late)):  # two deliveries, so that state is carried over
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(messages.schema).parquet(source)
        query = sessions.match_stream(stream, known).writeStream.format("parquet").option("path", out).option("checkpointLocation", point).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    return _matches_of(spark.read.schema(sessions.OUTPUT).parquet(out))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_documents, normalize_keys, normalize_spans, utf16_lengths, tsv_escapes, tsv_roundtrip, flags_roundtrip, qid_parse, dump_targets, file_checksums,
        dump_pages, page_props_pivot, redirect_targets, title_surfaces, entity_surfaces, entity_flags, surface_dictionary, merged_flags,
        surface_ids, shard_stats, referenced_qids, surface_offsets, candidates, char_codes, stage_counts, dictionary_metadata, dictionary_doctor,
        match_overlapping, match_by_join, match_candidates, match_no_disambiguation, match_cap_1, match_cap_0, match_counts, match_events, match_first,
        match_longest_per_end, match_sessions, stream_sessions,
    )
} | {
    "match_standard": _kind("standard"),
    "match_leftmost_longest": _kind("leftmost"),
    "match_leftmost_first": _kind("leftmost", True),
}
