"""One form for texts that look the same on screen."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Letters that look the same, each with the letter it is replaced by. Applied after decomposition, so that accents stay.
_ALIKE = {
    "Cyrillic small": ("аеорсухіјѕһӏԁԛԝ", "aeopcyxijshldqw"),
    "Cyrillic capital": ("АВЕКМНОРСТУХЅІЈӀԚԜ", "ABEKMHOPCTYXSIJIQW"),
    "Greek small": ("ονρϲϳ", "ovpcj"),
    "Greek capital": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϿ", "ABEZHIKMNOPTYXCC"),
    "Armenian": ("սօհոցզյՕՍՏ", "uohngqjOUS"),
    "Latin": ("ɡɑ", "ga"),
    "hyphens": ("‐‑", "--"),
    "kana and han": ("二へ口力工夕卜八", "ニヘロカエタトハ"),
}
# Blanks besides the space separators; signs of category Cf that have ink; fillers without ink outside Cf.
_BLANKS = "\t\n\v\f\r\x85  ⠀"
_INKED_FORMAT = {0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD, *range(0x600, 0x606)}
_INKLESS = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
# Decompositions that change how a character looks.
_OTHER_LOOKS = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>")
_LONG_S = "ſ"


@lru_cache(1)
def _alike() -> dict[str, str]:
    assert all(len(a) == len(b) for a, b in _ALIKE.values())
    return {x: y for a, b in _ALIKE.values() for x, y in zip(a, b)}


@lru_cache(1)
def _seconds() -> frozenset[str]:
    """Starters that compose with what stands before them."""
    found = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in range(0x110000):
        d = unicodedata.decomposition(chr(c))
        if d and d[0] != "<" and len(d.split()) == 2 and not unicodedata.combining(s := chr(int(d.split()[1], 16))):
            found.add(s)
    return frozenset(found)


def _blank(ch: str) -> bool:
    return ch in _BLANKS or unicodedata.category(ch) == "Zs"


def _inkless(ch: str) -> bool:
    return ord(ch) in _INKLESS or unicodedata.category(ch) in ("Cc", "Cf") and ord(ch) not in _INKED_FORMAT


def pieces_of(ch: str) -> str:
    """What a single character becomes before marks are ordered: nothing, a blank, or its decomposition in common letters."""
    if _blank(ch):
        return " "
    if _inkless(ch):
        return ""
    if ch in _alike():
        return _alike()[ch]
    kind, _, rest = unicodedata.decomposition(ch).rpartition("> ")
    if 0xAC00 <= ord(ch) <= 0xD7A3:
        return unicodedata.normalize("NFD", ch)
    if not rest or kind + ">" in _OTHER_LOOKS or ch == _LONG_S:
        return ch
    parts = [chr(int(x, 16)) for x in rest.split()]
    if kind and len(parts) > 1 and _blank(parts[0]):
        return ch  # an accent that stands alone
    return "".join(map(pieces_of, parts))


@lru_cache(1)
def decompositions() -> list[tuple[int, list[tuple[str, int, bool]]]]:
    """(code point, [(character, combining class, whether it composes with a starter before it)]) of all code points that don't stay as they are; fixed by Unicode."""
    rows = []
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        new = pieces_of(ch)
        if new != ch or unicodedata.combining(ch) or ch in _seconds():
            rows.append((c, [(x, unicodedata.combining(x), x in _seconds()) for x in new]))
    return rows


@lru_cache(1)
def compositions() -> list[tuple[str, dict[str, str]]]:
    """(starter, {starter and marks in order: the character they compose to}) of all characters that composition makes."""
    found: dict[str, dict[str, str]] = {}
    for c in range(0x110000):
        ch = chr(c)
        if 0xD800 <= c < 0xE000 or not (0xAC00 <= c <= 0xD7A3 or unicodedata.decomposition(ch) and unicodedata.decomposition(ch)[0] != "<"):
            continue
        if unicodedata.normalize("NFC", ch) == ch and len(full := unicodedata.normalize("NFD", ch)) > 1:
            found.setdefault(full[0], {})[full] = ch
    return sorted(found.items())


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Both mappings for broadcast: at most as many rows as Unicode has characters that change."""
    a = spark.createDataFrame(decompositions(), "_cp int, _pieces array<struct<sub: string, ccc: int, second: boolean>>")
    b = spark.createDataFrame(compositions(), "_starter string, _composed map<string, string>")
    return F.broadcast(a), F.broadcast(b)


def screen_forms(values: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Distinct (``keys``, ``text``) with ``form``: equal for texts that look the same, else different.

    Width, code point composition, characters without ink, kinds of blank, look-alike letters, and blanks at either end make no
    difference; case, accents, hyphens, underscores, letters and the number of blanks inside do. The form of a form is itself.
    Null texts have no form and are left out; an empty text, or one without ink, has the empty form. Texts are processed whole,
    however long; other columns are ignored.

    Method: the distinct texts are exploded to positioned code points, which a broadcast join replaces by their pieces; a running count
    of starters gives each mark its cluster, in which marks are ordered by class and recomposed with their starter; the
    clusters rebuild the text. From the shuffle by digest on, all of it stays in one partition, and a text travels once, not
    with each of its characters.
    """
    spark = values.sparkSession
    replaced, composed = _tables(spark)
    ident = [*keys, "_d1", "_d2"]
    chars = (
        values.select(*keys, F.col(text).alias("_text"))
        .where("_text is not null")
        .distinct()
        .withColumns({"_d1": F.xxhash64("_text"), "_d2": F.xxhash64(F.lit(1), "_text")})
        .repartition(*ident)
        .select(*ident, "_text", F.posexplode(F.concat(F.array(F.lit("")), F.split("_text", ""))).alias("_pos", "_ch"))
        .withColumn("_text", F.when(F.col("_pos") == 0, F.col("_text")))
        .withColumn("_cp", F.when(F.col("_ch") == "", -1).otherwise(F.ascii("_ch")))
    )
    own = F.array(F.struct(F.col("_ch").alias("sub"), F.lit(0).alias("ccc"), F.lit(False).alias("second")))
    pieces = (
        chars.join(replaced, "_cp", "left")
        .select(*ident, "_text", "_pos", F.posexplode(F.coalesce("_pieces", own)).alias("_k", "_p"))
        .select(*ident, "_text", "_pos", "_k", "_p.sub", "_p.ccc", "_p.second")
    )
    order = Window.partitionBy(*ident).orderBy("_pos", "_k")
    opens = (F.col("ccc") == 0) & ~(F.col("second") & (F.lag("ccc", 1, 1).over(order) == 0))
    clusters = (
        pieces.withColumn("_opens", opens.cast("int"))
        .withColumn("_at", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(*ident, "_at")
        .agg(F.sort_array(F.collect_list(F.struct("ccc", "_pos", "_k", "sub"))).alias("_parts"), F.max("_text").alias("_text"))
        .withColumn("_starter", F.when(F.size("_parts") > 1, F.col("_parts")[0]["sub"]))
        .join(composed, "_starter", "left")
    )

    def join(state, part):
        longer = F.concat(state["key"], part["sub"])
        fits = (state["last"] < part["ccc"]) & F.col("_composed").isNotNull() & F.map_contains_key("_composed", longer)
        left = F.when(part["ccc"] == 0, 1000).otherwise(part["ccc"])
        return F.when(fits, F.struct(longer.alias("key"), state["rest"].alias("rest"), state["last"].alias("last"))).otherwise(
            F.struct(state["key"].alias("key"), F.concat(state["rest"], part["sub"]).alias("rest"), left.alias("last"))
        )

    start = F.struct(F.col("_starter").alias("key"), F.lit("").alias("rest"), F.lit(-1).alias("last"))
    folded = F.aggregate(F.slice("_parts", 2, F.size("_parts")), start, join, lambda s: F.concat(F.coalesce(F.try_element_at("_composed", s["key"]), s["key"]), s["rest"]))
    whole = (
        clusters.select(*ident, "_at", "_text", F.when(F.size("_parts") == 1, F.col("_parts")[0]["sub"]).otherwise(folded).alias("_piece"))
        .groupBy(*ident)
        .agg(F.max("_text").alias(text), F.sort_array(F.collect_list(F.struct("_at", "_piece"))).alias("_all"))
    )
    return whole.select(*keys, text, F.trim(F.array_join(F.col("_all._piece"), "")).alias("form"))


def values_of(columns: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(``ref_table``, ``text``) of several text columns, one after the other."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("ref_table"), F.col(c).alias("text")) for name, (df, c) in columns.items()])


def alike_pairs(forms: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """All pairs of different texts with one form: ``text_a`` < ``text_b`` in UTF-8 byte order. ``screen_forms`` itself gives the classes in one row a text."""
    a = forms.select(*keys, "form", F.col(text).alias("text_a"))
    b = forms.select(*keys, "form", F.col(text).alias("text_b"))
    return a.join(b, [*keys, "form"]).where("text_a < text_b").select(*keys, "text_a", "text_b")
