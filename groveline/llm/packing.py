"""Packing into optimal length buckets.

Dynamic programming over the corpus's histogram of lengths sets the bucket boundaries at which padding is least; inside a bucket
each batch takes as many documents as the token budget holds at the bucket's length. The histogram is exact: one row on the driver
for each length that occurs, of which a corpus of N words has less than the square root of 2 N (their sum is N at most), 16 bytes each.

Defined results: a null or wordless text has length 0 and is packed with the shortest; a document longer than the budget has a
batch of its own; repeated rows are packed as rows of their own; an empty table gives an empty result; other columns are not read
unless ``carry`` names them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.llm.common import n_words, numbered, written


def cheapest(left: np.ndarray, length: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least of left[i] + length[j] * (before[j + 1] - before[i]) over i <= j, and the first i that gives it.

    The best i never falls as j grows; so the middle j of a range is settled first and bounds the search of both its halves. All
    ranges of one depth are settled at once.
    """
    n = len(length)
    cost, choice = np.empty(n), np.empty(n, np.int64)
    first, last = np.array([0]), np.array([n - 1])  # ranges of j
    low, high = np.array([0]), np.array([n - 1])  # and of i for them
    while len(first):
        j = (first + last) // 2
        stop = np.minimum(high, j)
        width = stop - low + 1
        begin = np.cumsum(width) - width
        i = np.arange(width.sum()) - np.repeat(begin - low, width)
        all_costs = left[i] + np.repeat(length[j], width) * (np.repeat(before[j + 1], width) - before[i])
        least = np.minimum.reduceat(all_costs, begin)
        hit = np.where(all_costs == np.repeat(least, width), i, n)
        cost[j], choice[j] = least, np.minimum.reduceat(hit, begin)
        first, last, low, high = np.concatenate([first, j + 1]), np.concatenate([j - 1, last]), np.concatenate([low, choice[j]]), np.concatenate([choice[j], high])
        some = first <= last
        first, last, low, high = first[some], last[some], low[some], high[some]
    return cost, choice


def boundaries(length: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """The lengths of at most ``buckets`` buckets that pad least. length, count: the lengths that occur, ascending, and their documents.

    best[j] is the least padded total of the first j lengths with the buckets so far; padding is that less the constant sum of lengths.
    """
    n = len(length)
    length = length.astype(np.float64)
    before = np.concatenate([[0], np.cumsum(count)]).astype(np.float64)
    best, cut = length * before[1:], []
    for _ in range(min(buckets, n) - 1):
        best, choice = cheapest(np.concatenate([[0.0], best[:-1]]), length, before)
        cut.append(choice)
    ends, j = [], n - 1
    for choice in reversed(cut):
        ends.append(int(length[j]))
        j = int(choice[j]) - 1
        if j < 0:
            break
    else:
        ends.append(int(length[j]))
    return sorted(set(ends))


def pack(docs: DataFrame, buckets: int = 16, budget: int = 65_536, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch (gapless in the bucket), place (in the batch), padding for each document."""
    slim = written(docs.select("doc_id", *carry, n_words(F.col("text")).alias("n_tokens")))
    counts = slim.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("rows")).toArrow().sort_by("n_tokens")
    length, rows = counts.column("n_tokens").to_numpy(), counts.column("rows").to_numpy()
    ends = boundaries(length, rows, buckets) if len(length) else [0]
    bucket, longest = F.lit(0), F.lit(ends[-1])
    for e in ends[:-1]:
        bucket = bucket + (F.col("n_tokens") > e).cast("int")
    for e in reversed(ends[:-1]):
        longest = F.when(F.col("n_tokens") <= e, F.lit(e)).otherwise(longest)
    placed = numbered(slim.withColumn("bucket", bucket).withColumn("bucket_len", longest.cast("long")), "bucket", int(rows.sum()))
    each = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    return placed.select("doc_id", *carry, "n_tokens", "bucket", "bucket_len", F.floor(F.col("slot") / each).cast("long").alias("batch"), (F.col("slot") % each).cast("long").alias("place"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))
