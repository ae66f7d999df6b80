"""From dumps to the dictionary: surface keys with their entities, flags, ids, shards and offsets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.normalize import normalized
from corpuscle.functions.text import DISAMBIGUATION, DISAMBIGUATION_QID, is_disambiguation, qid_number, qid_text, utf16_length, wiki_language
from corpuscle.session import materialize, small

SHARD_SIZE = 250_000


def articles(page: DataFrame) -> DataFrame:
    """Pages of the main namespace."""
    return page.where(F.col("namespace") == 0).select("page_id", "title")


def attach_props(pages: DataFrame, props: DataFrame) -> DataFrame:
    """``pages`` with ``qid`` and ``is_disambiguation`` from their properties.

    The last ``wikibase_item`` by ``ord`` wins, and clears the qid if it is no item id; one without a value is skipped. Any ``disambiguation`` property
    sets the flag. Pages without properties stay, properties of unknown pages are dropped. The properties are brought to one row a
    page, partly before the shuffle, and joined once.
    """
    item = (F.col("propname") == "wikibase_item") & F.col("value").isNotNull()
    used = props.where(F.col("propname").isin("wikibase_item", "disambiguation"))
    by_page = used.groupBy("page_id").agg(
        F.max_by(F.struct(qid_number(F.col("value")).alias("n")), F.when(item, F.col("ord"))).alias("_item"),
        F.coalesce(F.bool_or(F.col("propname") == "disambiguation"), F.lit(False)).alias("_dis"),
    )
    joined = pages.join(by_page, "page_id", "left")
    return joined.select(*pages.columns, F.col("_item.n").alias("qid"), F.coalesce("_dis", F.lit(False)).alias("is_disambiguation"))


def with_keys(rows: DataFrame, text: str) -> DataFrame:
    """``surface_key`` from a text column; rows whose key would be empty are dropped."""
    return rows.withColumn("surface_key", normalized(F.col(text))).where(F.col("surface_key").isNotNull())


def title_surfaces(pages: DataFrame) -> DataFrame:
    """(``surface_key``, ``qid``) of the titles of pages with an entity."""
    return with_keys(pages.where(F.col("qid").isNotNull()), "title").select("surface_key", "qid")


def resolve_redirects(pages: DataFrame, redirects: DataFrame, wiki: Sequence[str] = ()) -> DataFrame:
    """(``wiki`` columns, ``from_id``, ``title``, ``qid``): the title of a redirecting page with the entity of the page it leads to, one step far.

    Both pages must be known main-namespace pages, within one wiki if ``wiki`` names the column; targets without an entity give nothing. If
    several pages have the target's title, the one with the least ``page_id`` counts.
    """
    keys = list(wiki)
    source = pages.select(*keys, F.col("page_id").alias("from_id"), "title")
    target = pages.groupBy(*keys, F.col("title").alias("target_title")).agg(F.min_by(F.struct("qid"), "page_id").alias("_target"))
    led = redirects.where(F.col("namespace") == 0).select(*keys, "from_id", "target_title")
    found = led.join(source, [*keys, "from_id"]).join(target, [*keys, "target_title"])
    return found.select(*keys, "from_id", "title", F.col("_target.qid").alias("qid")).where("qid is not null")


def redirect_surfaces(pages: DataFrame, redirects: DataFrame, wiki: Sequence[str] = ()) -> DataFrame:
    """(``surface_key``, ``qid``) of the titles of redirecting pages."""
    return with_keys(resolve_redirects(pages, redirects, wiki), "title").select("surface_key", "qid")


def wiki_scope(wikis: Sequence[str]) -> tuple[list[str], list[str]]:
    """Languages and sitelink keys of some wikis, sorted."""
    return sorted({w[:-4] for w in wikis if w.endswith("wiki") and len(w) > 4}), sorted(set(wikis))


def entity_surfaces(entities: DataFrame, wikis: Sequence[str]) -> DataFrame:
    """Distinct (``surface_key``, ``qid``) of labels and aliases in the languages of ``wikis`` and of their sitelink titles; entities other than items are skipped."""
    languages, sites = wiki_scope(wikis)
    asked = lambda name, keys: [F.col(name)[k] for k in keys]
    texts = [x["value"] for x in asked("labels", languages)] + [x["title"] for x in asked("sitelinks", sites)]
    lists = [F.transform(F.coalesce(x, F.array()), lambda v: v["value"]) for x in asked("aliases", languages)]
    all_texts = F.array_compact(F.concat(F.array(*texts).cast("array<string>"), *[x.cast("array<string>") for x in lists]))
    named = entities.select(qid_number(F.col("id")).alias("qid"), F.explode(F.array_distinct(all_texts)).alias("_text")).where(F.col("qid").isNotNull())
    return with_keys(named, "_text").select("surface_key", "qid").distinct()


def entity_flags(entities: DataFrame) -> DataFrame:
    """(``qid``, ``flags``) of every item: an item any of whose kinds is the one of disambiguation pages has the flag."""
    kinds = F.coalesce(F.col("claims.P31.mainsnak.datavalue.value.id"), F.array().cast("array<string>"))
    lists = F.coalesce(F.exists(kinds, lambda k: qid_number(k) == DISAMBIGUATION_QID), F.lit(False))
    return entities.select(qid_number(F.col("id")).alias("qid"), F.when(lists, DISAMBIGUATION).otherwise(0).alias("flags")).where(F.col("qid").isNotNull())


def page_flags(pages: DataFrame) -> DataFrame:
    """(``qid``, ``flags``) of the pages with an entity."""
    return pages.where(F.col("qid").isNotNull()).select("qid", F.when(F.col("is_disambiguation"), DISAMBIGUATION).otherwise(0).alias("flags"))


def surface_qids(*edges: DataFrame) -> DataFrame:
    """(``surface_key``, ``qids``, ``qid_count``): the union of edge tables, each key with its distinct entities ascending.

    Edges with a null key or entity are dropped. Repeated edges fall together before the shuffle, so a key that holds many rows
    moves as its distinct entities.
    """
    union = reduce(DataFrame.unionByName, [e.select("surface_key", F.col("qid").cast("long").alias("qid")) for e in edges])
    distinct = union.where("surface_key is not null and qid is not null").distinct()
    return distinct.groupBy("surface_key").agg(F.sort_array(F.collect_list("qid")).alias("qids")).withColumn("qid_count", F.size("qids"))


def qid_flags(*sources: DataFrame) -> DataFrame:
    """(``qid``, ``flags``): flags of several sources joined bit by bit; an entity known without flags has 0."""
    union = reduce(DataFrame.unionByName, [s.select(F.col("qid").cast("long").alias("qid"), F.col("flags").cast("int").alias("flags")) for s in sources])
    return union.where("qid is not null").groupBy("qid").agg(F.bit_or(F.coalesce("flags", F.lit(0))).alias("flags"))


def number_rows(rows: DataFrame, order: str, name: str) -> DataFrame:
    """``rows`` sorted by ``order`` with their place in that order, from 0, as ``name``.

    A range sort spreads the rows; what each part holds is counted, and the sums of the parts before give each part its first
    number. No part sees more than its own rows.
    """
    placed = materialize(rows.orderBy(order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    first, _ = small(sizes)
    known = placed.withColumn("_part", part)
    return known.join(first, "_part").select((F.col("_first") + F.col("_at") - F.shiftleft("_part", 33)).alias(name), *rows.columns)


def with_surface_ids(surfaces: DataFrame, shard_size: int = SHARD_SIZE) -> DataFrame:
    """The dictionary: ``surface_id`` (place in the byte order of the keys), ``shard_id`` (blocks of ``shard_size`` ids), key, entities and ``utf16_len``."""
    numbered = number_rows(surfaces, "surface_key", "surface_id")
    return numbered.withColumn("shard_id", F.floor(F.col("surface_id") / shard_size).cast("int")).withColumn("utf16_len", utf16_length(F.col("surface_key")))


def shard_stats(dictionary: DataFrame) -> DataFrame:
    """Per shard: first id, keys, id after the last, and bytes of the keys."""
    return dictionary.groupBy("shard_id").agg(
        F.min("surface_id").alias("surface_start"),
        F.count("*").alias("surface_count"),
        (F.max("surface_id") + 1).alias("surface_end"),
        F.sum(F.octet_length("surface_key")).alias("pattern_bytes"),
    )


def referenced_qids(dictionary: DataFrame, flags: DataFrame) -> DataFrame:
    """(``qid``, ``flags``) of the entities that some key leads to; unknown ones have 0, others are dropped."""
    used = dictionary.select(F.explode("qids").alias("qid")).distinct()
    return used.join(flags, "qid", "left").select("qid", F.coalesce("flags", F.lit(0)).alias("flags"))


def surface_offsets(dictionary: DataFrame) -> DataFrame:
    """(``surface_id``, ``offset``, ``length``): where each key's entities begin if all lists are laid end to end.

    The sum over all keys before is split: lists are summed per block of ids, the blocks before each block are summed, and only
    within a block the keys follow each other.
    """
    block = F.floor(F.col("surface_id") / 10_000).alias("_block")
    sized = dictionary.select("surface_id", F.size("qids").alias("length"), block)
    upto = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block of ids
    blocks = sized.groupBy("_block").agg(F.sum("length").alias("_n")).select("_block", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_block").orderBy("surface_id").rowsBetween(Window.unboundedPreceding, -1)
    joined = sized.join(small(blocks)[0], "_block")
    return joined.select("surface_id", (F.col("_first") + F.coalesce(F.sum("length").over(within), F.lit(0))).alias("offset"), "length")


def attach_flags(dictionary: DataFrame, flags: DataFrame) -> DataFrame:
    """The dictionary with ``candidates``: its entities in order, with text id and whether they are disambiguations; unknown entities are none."""
    listed = dictionary.select("surface_id", F.posexplode("qids").alias("_at", "qid")).join(flags, "qid", "left")
    candidate = F.struct(qid_text(F.col("qid")).alias("qid"), F.col("qid").alias("qid_number"), is_disambiguation(F.col("flags")).alias("disambiguation"))
    found = listed.groupBy("surface_id").agg(F.sort_array(F.collect_list(F.struct("_at", candidate.alias("c")))).alias("_all"))
    return dictionary.join(found.select("surface_id", F.col("_all.c").alias("candidates")), "surface_id")


def char_codes(keys: DataFrame, text: str = "surface_key") -> DataFrame:
    """(``ch``, ``freq``, ``code``): characters by falling frequency, then code point, numbered from 0; there are only so many characters."""
    counted = keys.select(F.explode(F.split(text, "")).alias("ch")).where("ch != ''").groupBy("ch").agg(F.count("*").alias("freq"))
    order = Window.orderBy(F.desc("freq"), "ch")
    return counted.select("ch", "freq", (F.row_number().over(order) - 1).alias("code"))


def stage_counts(pages: DataFrame, redirects: DataFrame, entities: DataFrame, wikis: Sequence[str]) -> DataFrame:
    """(``stage``, ``n``): how many rows each stage of the build saw and kept."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
    parts = [
        one(pages, "pages"),
        one(pages.where("qid is not null"), "pages_with_qid"),
        one(pages.where("is_disambiguation"), "disambiguation_pages"),
        one(redirects, "redirect_surfaces"),
        one(entities.where(qid_number(F.col("id")).isNotNull()), "entities"),
        one(entity_surfaces(entities, wikis), "entity_surfaces"),
    ]
    return reduce(DataFrame.unionByName, parts)


def languages(wikis: DataFrame) -> DataFrame:
    """Wikis with their language."""
    return wikis.select("wiki", wiki_language(F.col("wiki")).alias("lang"))
