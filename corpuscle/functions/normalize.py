"""The normalization contract of dictionary keys and texts.

Each code point is mapped by itself: deleted if it has no place in a key, a blank if it separates, else folded (NFKC, full case folding, NFD) without
combining marks. Then blanks fall together and those at the ends go. As the map is per code point, it is a table; it is filled as
code points occur. The result depends on the Unicode version of Python, which ``UNICODE_VERSION`` names.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNICODE_VERSION = unicodedata.unidata_version

# Fixed values of the contract: ranges of code points that vanish, in order.
_DELETED = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0100, 0xE01EF),
)
# Fixed values of the contract: punctuation that stays, symbols that separate, and the general categories that separate.
_KEPT = "+#&"
_SYMBOLS = "|`~=<>"
_SEPARATING = frozenset("Pc Pd Ps Pe Pi Pf Po Zs Zl Zp Cc Cf Cs Co Cn".split())


def is_deleted(ch: str) -> bool:
    return any(lo <= ord(ch) <= hi for lo, hi in _DELETED)


def is_separator(ch: str) -> bool:
    """Blanks included."""
    return ch not in _KEPT and (ch in _SYMBOLS or unicodedata.category(ch) in _SEPARATING)


def _settle(ch: str) -> str | None:
    """The fate of a character in each stage: '' dropped, ' ' a blank, None to be folded on."""
    if is_deleted(ch):
        return ""
    return " " if is_separator(ch) else None


def fold(ch: str) -> str:
    """What one code point becomes; blanks are not yet joined."""
    fate = _settle(ch)
    if fate is not None:
        return fate
    out = []
    for x in unicodedata.normalize("NFKC", ch).casefold():
        fate = "" if unicodedata.category(x)[0] == "M" else _settle(x)
        if fate is not None:
            out.append(fate)
            continue
        for y in unicodedata.normalize("NFD", x):
            fate = "" if unicodedata.category(y)[0] == "M" else _settle(y)
            out.append(y if fate is None else fate)
    return "".join(out)


class _Table(dict):
    def __missing__(self, c: int) -> str:
        self[c] = out = fold(chr(c))
        return out


_TABLE = _Table()
_BLANKS = re.compile(" +")


def normalize_key(text: str | None) -> str | None:
    """The key of a text; None if nothing is left."""
    if text is None:
        return None
    return _BLANKS.sub(" ", text.translate(_TABLE)).strip(" ") or None


@dataclass
class Normalizer:
    """Normalizes a text in chunks: a blank is held back until more than blanks follows, and its span is that of the last blank of its run."""

    offset: int = 0
    begun: bool = False
    pending: tuple[int, int] | None = None

    def feed(self, chunk: str) -> list[tuple[str, int, int]]:
        """(character, start, end) of what is settled, offsets in UTF-16 units of the whole text."""
        out: list[tuple[str, int, int]] = []
        at = self.offset
        for ch in chunk:
            end = at + (2 if ord(ch) > 0xFFFF else 1)
            for x in _TABLE[ord(ch)]:
                if x == " ":
                    if self.begun:
                        self.pending = (at, end)
                    continue
                if self.pending:
                    out.append((" ", *self.pending))
                    self.pending = None
                out.append((x, at, end))
                self.begun = True
            at = end
        self.offset = at
        return out


def normalize_spans(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The key of a text ('' if none) with the UTF-16 start and end in the text of each of its characters; as ``Normalizer`` gives, but for a whole text at once."""
    source = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mapped = [_TABLE[c] for c in source.tolist()]
    folded = np.frombuffer("".join(mapped).encode("utf-32-le", "surrogatepass"), np.uint32)
    inked = np.flatnonzero(folded != 32)
    if not len(inked):
        return "", np.zeros(0, np.int32), np.zeros(0, np.int32)
    folded = folded[: inked[-1] + 1]
    keep = folded != 32
    keep[inked[0] : -1] |= keep[inked[0] + 1 :]  # of each run of blanks the last, but none before the first letter
    of = np.repeat(np.arange(len(source)), [len(m) for m in mapped])[: len(folded)][keep]
    ends = np.cumsum(1 + (source > 0xFFFF), dtype=np.int32)
    starts = ends - 1 - (source > 0xFFFF).astype(np.int32)
    return folded[keep].tobytes().decode("utf-32-le", "surrogatepass"), starts[of], ends[of]


SPANS = T.StructType([T.StructField("norm", T.StringType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(T.StringType())
def normalized(texts: pd.Series) -> pd.Series:
    """Column function: the key, null if nothing is left."""
    return texts.map(normalize_key)


@F.pandas_udf(SPANS)
def normalized_spans(texts: pd.Series) -> pd.DataFrame:
    """Column function: the key with the span of each character; nulls give an empty one."""
    rows = [normalize_spans(t or "") for t in texts]
    return pd.DataFrame({"norm": [r[0] for r in rows], "starts": [r[1] for r in rows], "ends": [r[2] for r in rows]})


def register(spark: SparkSession) -> None:
    """Make the column functions known to SQL."""
    spark.udf.register("normalize_key", normalized)
    spark.udf.register("normalize_spans", normalized_spans)
