"""Scalar functions as column expressions: ids, escapes, dates, names of dump files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest id number a key may have.
MOST_QID = 2**32 - 1
#: Flag of entities that only list meanings, and the entity such entities are instances of.
DISAMBIGUATION, DISAMBIGUATION_QID = 1, 4_167_410
COMPONENTS = ("page", "redirect", "page_props", "wikidata_entities")
DUMPS = "https://dumps.wikimedia.org"


def utf16_length(text: Column) -> Column:
    """UTF-16 units of a text."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def tsv_escape(text: Column) -> Column:
    r"""``\``, tab, newline and return as two characters each."""
    for plain, escaped in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def tsv_unescape(text: Column) -> Column:
    """The reverse; other escapes, and a backslash at the end, stay as they are."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\.|[^\\]+|\\$"), F.lit(0))
    plain = lambda p: F.when(p == "\\\\", "\\").when(p == "\\t", "\t").when(p == "\\n", "\n").when(p == "\\r", "\r").otherwise(p)
    return F.array_join(F.transform(parts, plain), "")


def qid_number(text: Column) -> Column:
    """The number of ``Q<number>`` up to ``MOST_QID``; null for anything else."""
    number = F.when(text.rlike(r"^Q\+?[0-9]+\z"), F.substring(text, 2, 1 << 30).try_cast("decimal(38,0)"))
    return F.when(number <= MOST_QID, number.cast("long"))


def qid_number_strict(text: Column) -> Column:
    """The same, but what is no such id is an error."""
    said = F.concat(F.lit("invalid entity id "), F.coalesce(text, F.lit("null")))
    return F.coalesce(qid_number(text), F.raise_error(said).cast("long"))


def qid_text(number: Column) -> Column:
    return F.concat(F.lit("Q"), number.cast("string"))


def is_disambiguation(flags: Column) -> Column:
    return F.coalesce(flags.bitwiseAND(DISAMBIGUATION) != 0, F.lit(False))


def is_dump_date(text: Column) -> Column:
    """``latest`` or eight digits."""
    return text.rlike(r"^(latest|[0-9]{8})\z")


def split_option(text: Column) -> Column:
    """The parts of a comma-separated option, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")


def component(text: Column) -> Column:
    """The component of a name; dashes may stand for its underscores; null if unknown."""
    name = F.when(text.isin("page-props", "wikidata-entities"), F.replace(text, F.lit("-"), F.lit("_"))).otherwise(text)
    return F.when(name.isin(*COMPONENTS), name)


def wiki_language(wiki: Column) -> Column:
    """``en`` of ``enwiki``; null for names without a language before ``wiki``."""
    return F.when(wiki.rlike(r"^.+wiki\z"), F.regexp_extract(wiki, r"^(.+)wiki\z", 1))


def dump_file(part: Column, wiki: Column, date: Column) -> Column:
    """File name of a component's dump."""
    entities = F.when(date == "latest", "latest-all.json.bz2").otherwise(F.concat(F.lit("wikidata-"), date, F.lit("-all.json.bz2")))
    return F.when(part == "wikidata_entities", entities).otherwise(F.concat_ws("-", wiki, date, F.concat(part, F.lit(".sql.gz"))))


def dump_url(part: Column, wiki: Column, date: Column) -> Column:
    """Where a component's dump is published."""
    name = dump_file(part, wiki, date)
    folder = F.when(date == "latest", F.lit("wikidatawiki/entities")).otherwise(F.concat(F.lit("wikidatawiki/entities/"), date))
    return F.concat_ws("/", F.lit(DUMPS), F.when(part == "wikidata_entities", folder).otherwise(F.concat_ws("/", wiki, date)), name)
