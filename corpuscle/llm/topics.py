"""Latent Dirichlet topics of documents, fitted by online steps that together visit every document in every pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Passes over all documents, and parts of the corpus (by hash, one step each) a pass goes through; the same at every size.
PASSES, PARTS = 4, 4
#: Dirichlet parameters of documents and topics; offset and exponent of the learning rate.
ALPHA, ETA = 0.1, 0.02
OFFSET, DECAY = 1, 0.6
#: A document's proportions are settled when they change by less than this on average (of a weight of up to 100), or after so many rounds; padded words handled at once.
SETTLED, ROUNDS, AREA = 2e-3, 60, 20_000


def digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers."""
    low = 1 / x + 1 / (x + 1) + 1 / (x + 2) + 1 / (x + 3) + 1 / (x + 4)
    x = x + 5
    y = 1 / (x * x)
    return np.log(x) - x.dtype.type(0.5) / x - y * (1 / 12 - y * (1 / 120 - y / 252)) - low


def expected(lam: np.ndarray) -> np.ndarray:
    """exp(E[log p(term | topic)]) by term and topic, with one more row of zeros for padding, of the topics' parameters (by topic and term)."""
    beta = np.exp(digamma(lam) - digamma(lam.sum(1))[:, None])
    return np.vstack([beta.T, np.zeros((1, len(lam)))]).astype(np.float32)


def _mixtures(column: pa.ListArray, beta: np.ndarray, weights: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Of documents of like length at a time: their rows, words (padded), places of these in the flattened column, and exp(E[log]) of the topic parameters."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts, order = np.cumsum(sizes) - sizes, np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    weights = np.append(weights, 0).astype(np.float32)
    at = len(order)
    while at:
        longest = int(sizes[order[at - 1]])
        rows = order[max(0, at - max(1, AREA // longest)) : at]
        at -= len(rows)
        words = np.full((len(rows), longest), len(beta) - 1)
        inside = np.arange(longest) < sizes[rows][:, None]
        places = starts[rows][:, None] + np.arange(longest)
        words[inside] = flat[places[inside]]
        of_words, count = beta[words], weights[words]
        total = count.sum(1)
        gamma = np.repeat((ALPHA + total / beta.shape[1])[:, None], beta.shape[1], axis=1)
        live, part, near, now, least = np.arange(len(rows)), of_words, count, gamma, SETTLED * np.maximum(1, total / 100)
        for _ in range(ROUNDS):
            # The sum of a document's gamma stays, so its share in E[log] is a factor that cancels out.
            theta = np.exp(digamma(now))
            ratio = near / (np.matmul(part, theta[:, :, None])[:, :, 0] + 1e-30)
            new = ALPHA + theta * np.matmul(ratio[:, None, :], part)[:, 0]
            moves = np.abs(new - now).mean(1) >= least[live]
            gamma[live] = now = new
            n_moving = np.count_nonzero(moves)
            if not n_moving:
                break
            if n_moving < 0.8 * len(live):
                live = live[moves]
                part, near, now = of_words[live], count[live], new[moves]
        yield rows, words, places, inside, np.exp(digamma(gamma))


def fit(docs: DataFrame, weights: np.ndarray, lam: np.ndarray, passes: int = PASSES, parts: int = PARTS) -> tuple[np.ndarray, list[int]]:
    """The topics' parameters (by topic and term), from the first ones ``lam`` on, and how many documents each step read, ``parts`` steps a pass.

    ``docs`` has ``words``, the distinct numbers of each document's terms, which index ``weights``, and ``part``, which a step takes whole: a table written
    by ``part`` is read once a pass. Documents without words say nothing and are not counted. Sums by term meet on the
    executors; only those of the terms reach the driver.
    """
    context, n_terms, topics = docs.sparkSession.sparkContext, len(weights), len(lam)
    sizes = dict(docs.where(F.size("words") > 0).groupBy("part").count().collect())
    n_docs, seen = sum(sizes.values()), []
    for step in range(passes * parts):
        if not (n := sizes.get(step % parts, 0)):
            seen.append(0)
            continue
        sent = context.broadcast((expected(lam), weights))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            beta, weights = sent.value
            sums, read = np.zeros((len(beta), topics)), 0
            padded = np.append(weights, 0)
            for batch in batches:
                for rows, words, _, _, theta in _mixtures(batch.column(0), beta, weights):
                    read += len(rows)
                    ratio = padded[words] / (np.matmul(beta[words], theta[:, :, None])[:, :, 0] + 1e-30)
                    order = np.argsort(words, axis=None, kind="stable")
                    flat = words.ravel()[order]
                    first = np.flatnonzero(np.diff(flat, prepend=-1))
                    each = ratio.ravel()[order, None] * theta[order // words.shape[1]]
                    sums[flat[first]] += np.add.reduceat(each, first, axis=0)
            sums *= beta
            sums[-1, 0] = read  # the row of padding carries the documents read
            t = np.flatnonzero(sums.any(1))
            yield from _by_term(t, sums[t])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((n_terms + 1, topics))
            for batch in batches:
                np.add.at(sums, batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, topics))
            t = np.flatnonzero(sums.any(1))
            yield from _by_term(t, sums[t])

        kind = "t int, n array<double>"
        got = docs.where(F.col("part") == step % parts).select("words").mapInArrow(count, kind).repartition("t").mapInArrow(add, kind).toArrow()
        sums = np.zeros((n_terms + 1, topics))
        sums[got.column("t").to_numpy()] = got.column("n").combine_chunks().flatten().to_numpy().reshape(-1, topics)
        sent.destroy()
        seen.append(int(sums[-1, 0]))
        rate = (OFFSET + step + 1) ** -DECAY
        lam = (1 - rate) * lam + rate * (sums[:-1].T * (n_docs / n) + ETA)
    return lam, seen


def _by_term(t: np.ndarray, sums: np.ndarray, step: int = 5_000) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(t), step):
        part = sums[lo : lo + step]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * part.shape[1], pa.int32()), pa.array(part.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(t[lo : lo + step], pa.int32()), lists], names=["t", "n"])


def class_shares(column: pa.ListArray, beta: np.ndarray, weights: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """For each word of the flattened column what share of it falls to each class, by its document's topic proportions; ``classes`` says by topic and class where a topic counts."""
    shares = np.zeros((len(column.flatten()), classes.shape[1]), np.float32)
    classes = classes.astype(np.float32)
    for _, words, places, inside, theta in _mixtures(column, beta, weights):
        each = beta[words] * theta[:, None, :]
        each /= each.sum(2, keepdims=True) + 1e-30
        shares[places[inside]] = (each @ classes)[inside]
    return shares
