"""Filling sequences of fixed capacity with texts of varying length."""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import materialize

CAPACITY = 2048
#: Context sizes of the tiers, shortest first; the last is the capacity.
TIERS = (256, 512, 1024, CAPACITY)
#: Pieces packed together in one task, and sequences in a step group.
CELL_PIECES, GROUP_SEQUENCES = 20_000, 16
#: Vocabulary file of the tokenizer (ranks), and the pattern that splits text before the merges.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def _tokenizer(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``doc_id``, ``n_tokens``) of every row's whole text; null texts have none. The driver's vocabulary file goes to the executors."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(SparkFiles.get(name))
        for batch in batches:
            lengths = [len(tokenizer.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, docs.select("doc_id", F.lit(0).cast("long").alias("n_tokens")).schema)


def pack(lengths: np.ndarray, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, tier, offset) of each piece.

    A piece belongs to the shortest tier that holds it. Tiers take their turn from the longest on: a tier's pieces, longest first,
    fill the tightest gap that longer tiers and this one have left, and open a new sequence where none is wide enough. A bit
    mask over the gap sizes in use finds the tightest gap at once.
    """
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tier = np.searchsorted(np.array(tiers), lengths)
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = opened = 0
    for i in np.lexsort((-lengths, -tier)).tolist():
        n = int(lengths[i])
        wide = mask >> n
        if wide:
            gap = n + (wide & -wide).bit_length() - 1
            k = gaps[gap].pop()
            if not gaps[gap]:
                mask ^= 1 << gap
        else:
            gap, k = capacity, opened
            opened += 1
        sequence[i], offset[i] = k, capacity - gap
        if gap > n:
            gaps[gap - n].append(k)
            mask |= 1 << (gap - n)
    return sequence, tier, offset


def step_groups(sequence: np.ndarray, lengths: np.ndarray, group: int = GROUP_SEQUENCES) -> np.ndarray:
    """A group for each sequence, of equal sizes but for one, and of nearly equal attention cost (the sum of squared piece lengths): dealt to and fro, dearest first."""
    n = int(sequence.max()) + 1
    cost = np.bincount(sequence, weights=lengths.astype(float) ** 2, minlength=n)
    groups = math.ceil(n / group)
    place = np.arange(n)
    turn, at = place // groups, place % groups
    dealt = np.empty(n, np.int64)
    dealt[np.argsort(-cost, kind="stable")] = np.where(turn % 2 == 0, at, groups - 1 - at)
    return dealt


def packed_sequences(
    docs: DataFrame,
    capacity: int = CAPACITY,
    tiers: tuple[int, ...] = TIERS,
    vocabulary: str = VOCABULARY,
    cell_pieces: int = CELL_PIECES,
    group: int = GROUP_SEQUENCES,
) -> DataFrame:
    """The sequence of every text, or of every piece of the texts longer than ``capacity`` tokens.

    Every row of ``docs`` is placed once, repeated and equal ids included: a text of up to ``capacity`` tokens whole, a longer
    one as pieces of ``capacity`` tokens and a rest. Rows without tokens (null or empty text) take no room: they have the one piece
    0 of 0 tokens and a null ``sequence_id``. Null ids are kept. An empty table gives an empty result; other columns are
    ignored.

    Method: pieces are routed to tiers of context sizes; each tier fills the gaps of the longer ones before it opens sequences of
    its own; then the sequences are dealt into step groups of equal cost. Pieces are spread by hash over cells of about ``cell_pieces``,
    however the texts are distributed, and each cell is packed by itself, leaving a few sequences partly empty a cell, under
    one in a hundred. The token counts are kept as a table in the shared folder, so that texts are tokenized once.

    Result: ``doc_id``, ``piece_no``, ``token_start``, ``token_end`` (of the text), ``sequence_id``, ``position`` (of the piece's first token in
    the sequence), ``tier`` (its context size), ``step_group``.
    """
    counts = materialize(token_counts(docs, vocabulary), "token-counts")
    last = F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity))
    pieces = (
        counts.select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("_row"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece_no"))
        .withColumn("token_start", F.col("piece_no").cast("long") * capacity)
        .withColumn("token_end", F.least("n_tokens", F.col("token_start") + capacity))
        .drop("n_tokens")
    )
    n = counts.select(F.sum(last + 1)).first()[0] or 1
    cells = math.ceil(n / cell_pieces)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece_no int, token_start long, token_end long, sequence_id long, position long, tier int, step_group long"

    def place(part: pd.DataFrame) -> pd.DataFrame:
        lengths = (part["token_end"] - part["token_start"]).to_numpy()
        sequence, tier, offset = pack(lengths, capacity, tiers)
        base = int(part["_cell"].iloc[0]) << 32
        return part[["doc_id", "piece_no", "token_start", "token_end"]].assign(
            sequence_id=base + sequence, position=offset, tier=np.array(tiers, np.int32)[tier], step_group=base + step_groups(sequence, lengths, group)[sequence]
        )

    # By row, not by id: of a written table the row numbers stay, and one id on many rows is spread as well.
    filled = pieces.where("token_end > token_start").withColumn("_cell", F.pmod(F.xxhash64("_row", "piece_no"), F.lit(cells))).drop("_row")
    empty = pieces.where("token_end = token_start").select(
        "doc_id", "piece_no", "token_start", "token_end", F.lit(None).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("position"), F.lit(tiers[0]).alias("tier"), F.lit(None).cast("long").alias("step_group")
    )
    return filled.groupBy("_cell").applyInPandas(place, schema).unionByName(empty)


def packing_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: pieces, tokens, sequences, the least number of sequences that could hold the tokens, and the share of room that is filled."""
    return placed.agg(
        F.count("*").alias("n_pieces"),
        F.sum(F.col("token_end") - F.col("token_start")).alias("n_tokens"),
        F.count_distinct("sequence_id").alias("n_sequences"),
    ).select(
        "n_pieces",
        "n_tokens",
        "n_sequences",
        F.ceil(F.col("n_tokens") / capacity).alias("n_least"),
        (F.col("n_tokens") / (F.col("n_sequences") * capacity)).alias("filled"),
    )
