"""Exact substring dedup by column-wise construction of a collection's transform.

Stretches that share a key (see repeats) are a collection, set out around the gram that they share, so that equal strings of ``window``
bytes stand in the same columns. They come from a written table in the shared folder, which each task reads in order. Columns are read from the last to the
first. Each round inserts one symbol of each stretch in front of its suffix: a stable sort of the former order by the new
symbol gives the order of the longer suffixes (the column of the Burrows-Wheeler transform is the symbols in the former order), and
the common prefix of neighbours is one more than the least common prefix between their former places. A suffix that has ``window``
bytes in common with a neighbour begins a string that occurs elsewhere. Suffixes of different columns are never merged into one
order: under one key they can't share ``window`` bytes, and the order of one column is all that a round needs.

Defined results: a null text is empty; a text shorter than the window loses nothing; repeated rows repeat each other; an empty
table gives an empty result; other columns are not read. Texts are handled whole, whatever their length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.llm import repeats

GRAM = 64
NONE = 256


def columns(s: repeats.Stretches) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, first byte) of each string of s.window bytes that another stretch, or column-equal place, has too."""
    m, width, left = len(s.key), 2 * s.window - s.gram, s.window - s.gram
    begin = left - s.anchor  # the column of a stretch's first byte
    group = np.unique(s.key, return_inverse=True)[1].astype(np.int64)
    symbols = np.full((width, m), NONE, np.int16)
    for i in range(0, m, 2048):  # some stretches at a time, for the memory that places take
        some = slice(i, min(m, i + 2048))
        row = np.repeat(np.arange(some.start, some.stop), s.length[some])
        at = np.arange(s.offsets[some.start], s.offsets[some.stop])
        symbols[begin[row] + at - s.offsets[row], row] = s.values[at]
    found_row, found_start = [], []
    order = np.argsort(group, kind="stable")
    common = np.zeros(m, np.int64)
    for column in range(width - 1, -1, -1):
        symbol = symbols[column][order]
        key = group[order] * 512 + symbol
        to = np.argsort(key, kind="stable")
        sorted_key = key[to]
        same = np.flatnonzero((sorted_key[1:] == sorted_key[:-1]) & (sorted_key[1:] % 512 != NONE))
        new = np.zeros(m, np.int64)
        if len(same):
            a, b = to[same] + 1, to[same + 1] + 1  # the least of common[a:b], for neighbours that keep their order
            bounded = np.append(common, 0)
            new[same + 1] = 1 + np.minimum.reduceat(bounded, np.stack([a, b], 1).ravel())[::2]
        order, common = order[to], new
        hit = common >= s.window
        if hit.any():
            hit[:-1] |= hit[1:]
            rows = order[hit]
            found_row.append(rows)
            found_start.append(column - begin[rows])
    return np.concatenate([*found_row, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*found_start, np.empty(0, np.int64)]).astype(np.int64)


def _found(docs: DataFrame, window: int, bits: int, limits: dict) -> tuple[DataFrame, DataFrame]:
    rows = repeats.keyed(docs, bits)
    return rows, repeats.find_repeats(rows, "byte", window, min(GRAM, window), columns, **limits)


def dedup(docs: DataFrame, window: int = 200, bits: int = 64, **limits) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the kept bytes) for each document."""
    rows, found = _found(docs, window, bits, limits)
    return repeats.removed(rows, found, "byte", window).select("doc_id", F.col("n_tokens").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def deduped(docs: DataFrame, window: int = 200, bits: int = 64, **limits) -> DataFrame:
    """``docs`` with the text that is left; a null text stays null, a character that is cut in two becomes U+FFFD."""
    _, found = _found(docs, window, bits, limits)
    return repeats.left_over(docs, repeats.named(docs, "doc_id", "text", bits=bits), found, "byte", window)
