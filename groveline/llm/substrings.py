"""Substring dedup by level-wise doubling over word windows.

A window of ``window`` words is a candidate as long as a part of it repeats: first its least part of 8 words, then that part
extended to 16 words, to 32, and last the whole window. Parts that occur once at a level are dropped with their windows, and only
what survives is extended. Each level compares the parts at equal places under the key of the level before.

Defined results: a null or wordless text has no words and nothing removed; repeated rows repeat each other's windows; an empty
table gives an empty result; other columns are not read. Texts are handled whole, whatever their length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.llm import hashing, repeats

GRAM = 8


def twice(*columns: np.ndarray) -> np.ndarray:
    """Which rows have another that is equal in all columns."""
    order = np.lexsort(columns)
    same = np.ones(max(0, len(order) - 1), bool)
    for c in columns:
        same &= c[order[1:]] == c[order[:-1]]
    out = np.zeros(len(order), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def doubled(s: repeats.Stretches) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, first token) of each window that another stretch, or this one, has too."""
    starts = s.length - s.window + 1
    row = np.repeat(np.arange(len(starts)), starts)
    start = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
    part, length, prefix = s.anchor[row], s.gram, hashing.Prefix(s.values)
    while len(row):
        length = min(2 * length, s.window)
        part = np.minimum(part, start + s.window - length)
        at = s.offsets[row] + part
        kept = twice(prefix.of(at, at + length), part - start, s.key[row])
        row, start, part = row[kept], start[kept], part[kept]
        if length == s.window:
            break
    return row, start


def dedup(docs: DataFrame, window: int = 35, bits: int = 64, **limits) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) for each document."""
    rows = repeats.keyed(docs, bits)
    found = repeats.find_repeats(rows, "word", window, GRAM, doubled, **limits)
    out = repeats.removed(rows, found, "word", window)
    return out.select("doc_id", F.col("n_tokens").alias("n_words"), "n_removed", "kept_sha256")
