"""Exact top-k by inner product on a bit-sliced index.

Components become integers; a block of rows holds, for each dimension and bit, a bitmap over its rows. A query adds the slices of all
dimensions, each once for every set bit of its own component, with carry-save adders over bitmaps; that gives the slices of all
rows' scores. From the most significant slice downward the rows that may still be among the best k are narrowed; ties at the
boundary go to the smallest ids exactly, as rows stand in the order of their ids.

Queries meet rows in blocks: each task has one block of rows and one of queries. Blocks have bounded sizes, their number grows.

Defined results: vectors that are null, or hold a null or non-finite component, and rows without an id, take no part; a shorter
vector counts as padded by zeros; rows with one id are rows of their own, as queries (which then have a ranking each) and as
candidates, and equal rows too, of which no more are indexed than a ranking can show; ties beyond the id go to the smaller hash of the vector; a
query with fewer other rows than k gets them all; an empty table gives an empty result; other columns are not read. Components
beyond 64 bits stand at the limits of a long, as do scores in the result; scores are compared exactly inside a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groveline.llm.common import spread, written
from groveline.llm.hashing import tidy

SCALE = 256
ROWS = 1 << 16
QUERIES = 4096


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, x, the integers of each vector that takes part, and mark, a hash of them, once for equal rows, with their number."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    # beyond the range of a long the floor stands at its limits
    x = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(F.lit(SCALE) * x.cast("double"), F.lit(2.0**63)), F.lit(-(2.0**63)))).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return rows.groupBy("vec_id", "x").agg(F.count(F.lit(1)).alias("copies")).withColumn("mark", F.xxhash64("x"))


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids ascending, marks, integers as rows) of one block; shorter vectors are padded."""
    column = table.column("x").combine_chunks()
    flat, at = np.asarray(column.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))]).astype(np.int64)
    ids, marks = table.column("vec_id").to_numpy(), table.column("mark").to_numpy()
    out = np.zeros((len(ids), max(1, int(np.diff(at).max(initial=0)))), np.int64)
    row = np.repeat(np.arange(len(ids)), np.diff(at))
    out[row, np.arange(len(flat)) - at[row]] = flat
    order = np.lexsort((marks, ids))
    return ids[order], marks[order], out[order]


class Index:
    """Bit slices of one block. low, bits: least value and number of slices of each dimension."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, low: np.ndarray, bits: np.ndarray, slices: np.ndarray):
        self.ids, self.marks, self.low, self.bits, self.slices = ids, marks, low, bits, slices
        self.first = np.cumsum(bits) - bits
        self.inverse = ~slices
        rows = np.zeros(slices.shape[1] * 64, np.uint8)
        rows[: len(ids)] = 1
        self.all = np.packbits(rows, bitorder="little").view(np.uint64)

    @staticmethod
    def built(ids: np.ndarray, marks: np.ndarray, values: np.ndarray) -> Index:
        low = values.min(0)
        shifted = values.view(np.uint64) - low.view(np.uint64)  # right modulo 2**64, and no difference reaches that
        bits = np.array([int(v).bit_length() for v in shifted.max(0)])
        words = -(-len(ids) // 64)
        slices = np.zeros((int(bits.sum()), words * 8), np.uint8)
        at = 0
        for d, n in enumerate(bits):
            for j in range(n):
                packed = np.packbits((shifted[:, d] >> np.uint64(j) & np.uint64(1)).astype(np.uint8), bitorder="little")
                slices[at, : len(packed)] = packed
                at += 1
        return Index(ids, marks, low, bits, slices.view(np.uint64))

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices of the scores, least first; what is to be added to each score)."""
        heap: list[list[np.ndarray]] = []
        constant = 0
        for d, q in enumerate(query.tolist()):
            n = int(self.bits[d]) if d < len(self.bits) else 0
            if not q or d >= len(self.bits):
                continue
            own = self.slices if q > 0 else self.inverse
            constant += q * (int(self.low[d]) + (0 if q > 0 else (1 << n) - 1))
            size = abs(q)
            for w in range(size.bit_length()):
                if size >> w & 1:
                    while len(heap) < w + n:
                        heap.append([])
                    for j in range(n):
                        heap[w + j].append(own[self.first[d] + j])
        out = []
        w = 0
        while w < len(heap):
            level = heap[w]
            if len(level) > 1 and w + 1 == len(heap):
                heap.append([])
            while len(level) > 2:
                a, b, c = level.pop(), level.pop(), level.pop()
                t = a ^ b
                a = a & b
                a |= t & c
                t ^= c
                level.insert(0, t)
                heap[w + 1].append(a)
            if len(level) == 2:
                a, b = level
                heap[w + 1].append(a & b)
                level[:] = [a ^ b]
            out.append(level[0] if level else None)
            w += 1
        return out, constant

    def top(self, query_id: int, mark: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows but the query's own, in no order."""
        slices, constant = self.scores(query)
        maybe = self.all.copy()
        own = int(np.searchsorted(self.ids, query_id))
        while own < len(self.ids) and self.ids[own] == query_id and self.marks[own] != mark:
            own += 1
        if own < len(self.ids) and self.ids[own] == query_id:
            maybe[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        sure = np.zeros_like(maybe)
        count = 0
        for s in reversed(slices):
            if s is None:
                continue
            hit = maybe & s
            n = count + int(np.bitwise_count(hit).sum())
            if n > k:
                maybe = hit
            else:
                sure |= hit
                count = n
                maybe &= ~s
                if n == k:
                    break
        rows = _places(sure)
        rows = np.concatenate([rows, _places(maybe)[: k - len(rows)]])
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        score = [constant] * len(rows)
        for w, s in enumerate(slices):
            if s is not None:
                score = [v + (int(b) << w) for v, b in zip(score, s[word] >> bit & np.uint64(1), strict=True)]
        return [(int(self.ids[r]), v) for r, v in zip(rows, score, strict=True)]


def _places(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    if not len(words):
        return np.empty(0, np.int64)
    bits = np.unpackbits(bitmap[words].view(np.uint8), bitorder="little").reshape(len(words), 64)
    row, bit = np.nonzero(bits)
    return words[row] * 64 + bit


LONG = (1 << 63) - 1


def search(vectors: DataFrame, every: int = 50, k: int = 5, rows: int = ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the k best other rows."""
    table = written(quantised(vectors))
    asked = table.where(F.pmod("vec_id", F.lit(every)) == 0)
    # a ranking shows k rows and leaves the query's own out: of more equal rows, the rest can't come in
    shown = table.withColumn("nth", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k + 1)).cast("int")))).select("vec_id", "mark", "x")
    total, number = shown.count(), asked.count()
    blocks = max(1, -(-total // rows))
    # enough query blocks to keep some dozens of tasks busy, none above its bound
    chunks = max(1, -(-number // QUERIES), min(24 // blocks, -(-number // 32)))

    def packed(t: pa.Table) -> pa.Table:
        x = Index.built(*matrix(t))
        made = {"ids": x.ids, "marks": x.marks, "low": x.low, "bits": x.bits.astype(np.int64), "slices": x.slices}
        return pa.table({"block": t.column("block")[:1], **{c: pa.array([v.tobytes()], pa.binary()) for c, v in made.items()}})

    def chunk(t: pa.Table) -> pa.Table:
        ids, marks, values = matrix(t)
        made = {"query_ids": ids, "query_marks": marks, "queries": values}
        return pa.table({"chunk": t.column("chunk")[:1], **{c: pa.array([v.tobytes()], pa.binary()) for c, v in made.items()}})

    part = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("vec_id", "mark"), F.lit(n)).cast("int")).groupBy(name)
    index = written(part(shown, blocks, "block").applyInArrow(tidy(packed), "block int, ids binary, marks binary, low binary, bits binary, slices binary"))
    queries = written(part(asked.select("vec_id", "mark", "x"), chunks, "chunk").applyInArrow(tidy(chunk), "chunk int, query_ids binary, query_marks binary, queries binary"))

    def best(t: pa.Table) -> pa.Table:
        one = t.slice(0, 1).to_pylist()[0]
        ids, marks, low, bits, query_ids, query_marks, values = (np.frombuffer(one[c], np.int64) for c in ("ids", "marks", "low", "bits", "query_ids", "query_marks", "queries"))
        x = Index(ids, marks, low, bits, np.frombuffer(one["slices"], np.uint64).reshape(int(bits.sum()), -1) if bits.sum() else np.zeros((0, -(-len(ids) // 64)), np.uint64))
        out = [(q, m, i, max(-LONG - 1, min(LONG, s))) for q, m, v in zip(query_ids.tolist(), query_marks.tolist(), values.reshape(len(query_ids), -1), strict=True) for i, s in x.top(q, m, v, k)]
        return pa.table({n: pa.array([r[j] for r in out], pa.int64()) for j, n in enumerate(("query_id", "query_mark", "vec_id", "score"))})

    # rows of the pairs are whole blocks, a bounded set of queries against a bounded set of rows each
    pairs = index.crossJoin(queries).groupBy("block", "chunk").applyInArrow(tidy(best), "query_id long, query_mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_mark").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    copies = asked.select(F.col("vec_id").alias("_q"), F.col("mark").alias("_m"), "copies")
    # a query of which there are equal rows has its ranking as often
    both = ranked.join(copies, (F.col("query_id") == F.col("_q")) & (F.col("query_mark") == F.col("_m")))
    return spread(both.select("query_id", "rank", "vec_id", "score", "copies"), "copies", "_nth").select("query_id", "rank", "vec_id", "score")
