"""Most frequent items of a column in bounded memory, by lossy counting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.session import materialize, small

#: Rows between two prunings; an item is undercounted by at most one for each of them.
WIDTH = 16_384


class LossyTable:
    """Counts of one part: sorted items, each with its count and the most occurrences it may have had before it was kept."""

    def __init__(self, kind) -> None:
        self.items, self.counts, self.deltas, self.bounds = np.array([], dtype=kind), np.array([], np.int64), np.array([], np.int64), 0

    def add(self, values: np.ndarray, prune: bool) -> None:
        """Count the values of one bucket; at its boundary drop what can't have occurred more often than there were boundaries."""
        if len(values):
            items, counts = np.unique(values, return_counts=True)
            at = np.searchsorted(self.items, items)
            known = np.zeros(len(items), bool)
            inside = at < len(self.items)
            known[inside] = self.items[at[inside]] == items[inside]
            self.counts[at[known]] += counts[known]
            fresh = ~known
            self.items = np.concatenate([self.items, items[fresh]])
            self.counts = np.concatenate([self.counts, counts[fresh]])
            self.deltas = np.concatenate([self.deltas, np.full(int(fresh.sum()), self.bounds, np.int64)])
            self._keep(np.argsort(self.items, kind="stable"))
        if prune:
            self.bounds += 1
            self._keep(np.flatnonzero(self.counts + self.deltas > self.bounds))

    def _keep(self, where: np.ndarray) -> None:
        self.items, self.counts, self.deltas = self.items[where], self.counts[where], self.deltas[where]


def part_summaries(rows: DataFrame, fields: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """The summary of each part of ``rows``: (``field_name``, ``item``, ``count``, ``delta``, ``bounds``, ``n_rows``), and one line without item a field for the part as a whole."""
    asked = rows.select(*[c.alias(n) for n, c in fields.items()])
    kinds = {asked.schema[n].dataType.elementType for n in fields}
    assert len(kinds) == 1, "fields counted together hold items of one type"
    item = kinds.pop()
    schema = T.StructType([T.StructField("field_name", T.StringType()), T.StructField("item", item), *[T.StructField(c, T.LongType()) for c in ("count", "delta", "bounds", "n_rows")]])
    names, kind = list(fields), np.int64 if isinstance(item, T.LongType) else object

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held = {n: LossyTable(kind) for n in names}, {n: [] for n in names}
        seen = since = 0

        def close(prune: bool) -> None:
            for n in names:
                tables[n].add(np.concatenate(held[n]) if held[n] else np.array([], kind), prune)
                held[n].clear()

        for batch in batches:
            for n, column in zip(names, batch.columns):
                values = column.flatten().drop_null()
                if len(values):
                    held[n].append(values.to_numpy(zero_copy_only=False).astype(kind, copy=False))
            seen, since = seen + batch.num_rows, since + batch.num_rows
            if since >= width:
                close(True)
                since = 0
        close(False)
        if not seen:
            return
        for n, t in tables.items():
            items = pa.array([*t.items.tolist(), None], batch.schema.field(n).type.value_type)
            k = len(items)
            whole = lambda x: np.append(np.zeros(k - 1, np.int64), x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([n] * k, pa.string()), items, pa.array(np.append(t.counts, 0)), pa.array(np.append(t.deltas, 0)), pa.array(np.full(k, t.bounds)), pa.array(whole(seen))],
                names=schema.names,
            )

    return asked.mapInArrow(summarize, schema)


def frequent_items(rows: DataFrame, fields: dict[str, Column], share: float, width: int = WIDTH) -> DataFrame:
    """Items that may occur in at least ``share`` of all rows, with an interval that holds their true count for certain.

    ``fields`` names array columns, each a row's items; an item counts once for each time a row's array holds it, so pass
    distinct arrays to count rows. Null items and null arrays are no items, yet their rows belong to the total. No item with
    ``share`` of the rows is missing; one below it appears only if its interval reaches the share. An empty table gives an empty
    result; ties are all reported.

    Method: lossy counting in every part, in buckets of at least ``width`` rows: at each boundary the entries that can't have
    occurred more often than there were boundaries are dropped, and a new entry notes how often it may have been dropped
    before. A part keeps about ``width`` x log(rows / ``width``) entries for any number of distinct items. The summaries are merged by summing counts and
    deltas; a part that lacks an item adds its number of boundaries to the item's upper end. One pass over ``rows``, and a hot
    item is one entry a part.

    Result: ``field_name``, ``item``, ``count_low``, ``count_high``, ``n_rows`` (the total).
    """
    parts = materialize(part_summaries(rows, fields, width), "lossy")
    totals, _ = small(parts.where("item is null").groupBy("field_name").agg(F.sum("bounds").alias("_bounds"), F.sum("n_rows").alias("n_rows")))
    merged = parts.where("item is not null").groupBy("field_name", "item").agg(F.sum("count").alias("count_low"), (F.sum("delta") - F.sum("bounds")).alias("_over"))
    return (
        merged.join(totals, "field_name")
        .select("field_name", "item", "count_low", (F.col("count_low") + F.col("_over") + F.col("_bounds")).alias("count_high"), "n_rows")
        .where(F.col("count_high") >= share * F.col("n_rows"))
    )
