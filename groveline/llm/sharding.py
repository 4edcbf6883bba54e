"""Sharding by a minimax contiguous partition of ordered atomic groups.

Equal texts form a group, groups stand in the order of a hash of their text, and the smallest capacity is searched at which a
greedy cut needs no more than the asked number of shards. All group sizes never meet in one place: the driver holds sums over
ranges of the hash, a bounded number of them, and asks for finer sums only where a cut may fall, until the cut is exact.

Defined results: a null text counts as no bytes and stands with the empty texts; repeated rows are rows of their own and stay
together; an empty table gives an empty result; a group larger than all else gets a shard of its own; shards may stay empty if
there are fewer groups; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.llm.common import numbered, written

#: Bits of the hash that tell the first ranges apart, and by which a range is split: at most 2**14 rows, and 64 for each range split.
FIRST_BITS, MORE_BITS = 14, 6


class Cells:
    """Sums over ranges of the hash in ascending order. A cell is atomic if it holds one group only."""

    def __init__(self, cells: dict[int, tuple[int, int, int, int]]):
        self.at = sorted(cells)
        rows = [cells[k] for k in self.at]
        self.size, self.atomic, self.shift = [r[0] for r in rows], [r[1] == r[2] for r in rows], [r[3] for r in rows]
        self.end = list(accumulate(self.size))

    def cuts(self, capacity: int, shards: int, whole: bool) -> list[tuple[int, int]] | None:
        """Greedy ends of the shards as (cell, sum before the cut); None if the shards don't reach the end.
        ``whole``: no cell is cut, so the true ends are at these or later; else cells that aren't atomic are cut anywhere: at these or earlier."""
        total, done, ends = self.end[-1], 0, []
        for _ in range(shards):
            cell = bisect_right(self.end, done + capacity)
            before = self.end[cell - 1] if cell else 0
            done = done + capacity if cell < len(self.at) and not whole and not self.atomic[cell] else max(before, done)
            ends.append((cell, done))
            if done >= total:
                return ends
        return None

    def least(self, shards: int, whole: bool) -> int:
        low, high = -(-self.end[-1] // shards), self.end[-1]
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.cuts(mid, shards, whole) is not None else (mid + 1, high)
        return low


def bounds(slim: DataFrame, shards: int) -> tuple[list[int], int, int]:
    """(hash at which each shard but the first begins, smallest capacity, rows)."""
    sums = (F.sum("size").cast("long").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("rows"))
    shift = 64 - FIRST_BITS
    first = slim.groupBy(F.shiftright("key", shift).alias("cell")).agg(*sums).collect()
    if not first:
        return [], 0, 0
    rows = sum(r["rows"] for r in first)
    cells = {r["low"]: (r["size"], r["low"], r["high"], shift) for r in first}
    while True:
        now = Cells(cells)
        sure, hope = now.least(shards, True), now.least(shards, False)
        early, late = now.cuts(hope, shards, True), now.cuts(sure, shards, False)
        if sure == hope:
            break
        early = early or [(c, 0) for c, _ in _stuck(now, hope, shards)]
        split = {i for (a, _), (b, _) in zip(early, late, strict=False) for i in range(a, min(b + 1, len(now.at)))}
        split |= {i for i, s in enumerate(now.size) if s > hope}
        split = {i for i in split if not now.atomic[i]}
        if not split:
            break
        for shift in {now.shift[i] for i in split}:
            own = [now.at[i] for i in split if now.shift[i] == shift]
            finer = max(0, shift - MORE_BITS)
            found = slim.where(F.shiftright("key", shift).isin([k >> shift for k in own])).groupBy(F.shiftright("key", finer).alias("cell")).agg(*sums).collect()
            for k in own:
                del cells[k]
            cells |= {r["low"]: (r["size"], r["low"], r["high"], finer) for r in found}
    ends = now.cuts(sure, shards, True)
    return [now.at[c] for c, _ in ends if c < len(now.at)], sure, rows


def _stuck(cells: Cells, capacity: int, shards: int) -> list[tuple[int, int]]:
    """Earliest ends at a capacity that whole cells can't meet."""
    done, ends = 0, []
    for _ in range(shards):
        cell = bisect_right(cells.end, done + capacity)
        done = max(done, cells.end[cell - 1] if cell else 0)
        ends.append((cell, done))
    return ends


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each document, under the law ``bytes``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = written(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.xxhash64(text).alias("key")))
    begins, _, rows = bounds(slim, shards)
    where = F.lit(0)
    for b in begins:
        where = where + (F.col("key") >= F.lit(b)).cast("int")
    out = numbered(slim.withColumn("shard", where), "shard", rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
