"""Nearest-neighbour and similarity graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groveline.operators.distances import COLUMNS, KERNELS, all_pairs, blocks, centred, each_pair, paired, summed

#: Rows that an estimate gets at once, and the columns of which the least is looked at first.
ROWS, GROUP = 256, 16


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1))[:, None]
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _by_cosine(x: np.ndarray, y: np.ndarray) -> tuple[Callable, float, Callable]:
    a, b = (-_unit(x)).astype(np.float32), _unit(y).astype(np.float32)
    return lambda i, j: a[i] @ b[j].T, (x.shape[1] + 8) * 2.0**-22, lambda d: d - 1


def _by_square(x: np.ndarray, y: np.ndarray) -> tuple[Callable, float, Callable]:
    """Squares of the distances, as one product of matrices, in units of the greatest row's; the rows are moved to around 0 first."""
    far, width = max(float((m * m).sum(1).max(initial=0)) for m in (x, y)), x.shape[1]
    middle = y.mean(0) if len(y) else 0.0
    x, y = x - middle, y - middle
    n, m = (x * x).sum(1)[:, None], (y * y).sum(1)[:, None]
    most = float(max(n.max(initial=0), m.max(initial=0)))
    if not (1e-200 < most and max(most, far) < 1e200):
        return lambda i, j: KERNELS["euclidean"](x[i], y[j]), 1e-9 * (1 + float(np.sqrt(most))), lambda d: d
    n, m = n / most, m / most
    # a few rows that are far from all others would leave too little of 32 bits for these
    kind, off = (np.float32, (width + 8) * 2.0**-20) if min(np.median(n), np.median(m)) > 0.01 else (np.float64, 4e-9)
    a, b = (v.astype(kind) for v in (np.hstack([x * (-2 / most), n, np.ones_like(n)]), np.hstack([y, np.ones_like(m), m])))
    return lambda i, j: a[i] @ b[j].T, off + 1e-12 * far / most, lambda d: d * d / most


def _by_steps(x: np.ndarray, y: np.ndarray) -> tuple[Callable, float, Callable]:
    """Sums of differences in whole steps, from the sums of the lesser ones: |a - b| = a + b - 2 min(a, b). Off by what the steps leave."""
    width = x.shape[1]
    low, high = (float(f([f(m) for m in (x, y) if m.size] or [0.0])) for f in (np.min, np.max))
    steps = 32767 // max(1, width)
    if steps < 64 or not 0 < high - low < np.inf:
        return lambda i, j: KERNELS["manhattan"](x[i], y[j]), 1e-9 * width * max(abs(low), abs(high)), lambda d: d
    unit = (high - low) / steps
    if unit == 0 or (high - low) / unit > steps + 0.25:
        return lambda i, j: KERNELS["manhattan"](x[i], y[j]), 1e-9 * width * max(abs(low), abs(high)), lambda d: d
    exact = [(m - low) / unit for m in (x, y)]
    a, b = (np.rint(m).astype(np.int16) for m in exact)
    off = sum(float(np.abs(m - s).sum(1).max(initial=0)) for m, s in zip(exact, (a, b), strict=True))
    p, q = (m.sum(1, dtype=np.int64).astype(np.float32) for m in (a, b))
    lesser = summed(np.minimum)

    def estimate(i: slice, j: slice) -> np.ndarray:
        m = lesser(a[i], b[j]).astype(np.float32)
        m *= -2
        m += p[i, None]
        m += q[None, j]
        return m

    return estimate, 1.001 * off + 1e-12 * width * max(abs(low), abs(high)) / unit, lambda d: d / unit


def _pairwise(f: Callable) -> Callable:
    """f over pairs of rows, some at a time."""
    return lambda x, y, p, q: np.concatenate([f(x[p[i : i + 8192]], y[q[i : i + 8192]]) for i in range(0, len(p), 8192)] or [np.empty(0)])


def _one_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    return 1 - np.divide((a * b).sum(1), n, out=np.zeros_like(n), where=n > 0)


def _one_euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(1))


#: Metrics for which a quick estimate names the rows that can be among the nearest: the estimate of a slice of rows and columns, how
#: far it may be off and what it is for a distance, and the distance of single pairs.
ESTIMATES: dict[str, tuple[Callable, Callable]] = {
    "cosine": (_by_cosine, _one_cosine),
    "correlation": (lambda x, y: _by_cosine(centred(x), centred(y)), lambda a, b: _one_cosine(centred(a), centred(b))),
    "euclidean": (_by_square, _one_euclidean), "standardized_euclidean": (_by_square, _one_euclidean),
    "manhattan": (_by_steps, lambda a, b: np.abs(a - b).sum(1)),
}


def _under(m: np.ndarray, limit: np.ndarray, best: np.ndarray, more: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns of m at or under the limit and their values, with the limit and the best that m leaves.

    best: of each row the least values of different columns so far, or values that are no less. Columns are looked at in groups: the
    groups' least values bound the k-th best, and only groups that reach under the limit are looked into.
    """
    rows, columns = m.shape
    k = best.shape[1]
    group = GROUP if columns % GROUP == 0 and columns >= 2 * k * GROUP else 1
    cut = m.reshape(rows, group, columns // group)
    least = cut.min(1)
    best = np.concatenate([best, least], 1)
    best = np.partition(best, k - 1, 1)[:, :k]
    limit = np.minimum(limit, more(best.max(1).astype(np.float64)))
    p, g = np.nonzero(least <= limit[:, None])
    some = cut[p, :, g]
    hit, at = np.nonzero(some <= limit[p, None])
    return p[hit], at * (columns // group) + g[hit], some[hit, at], limit, best


def nearest(metric: str, x: np.ndarray, y: np.ndarray, same: bool, k: int, within: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of x, rows of y, distances to 12 decimals: the k nearest of each row of x, ties to the first of y. same: not a row itself.

    within: for each row of x a distance beyond which no row of y is wanted. It and the k-th best estimate among the columns so far,
    with twice the estimate's error, bound what can still be among a row's nearest; only of that the distance itself is computed and
    put in order.
    """
    odd = not (np.isfinite(x).all() and np.isfinite(y).all())
    quick, one = (None, None) if odd else ESTIMATES.get(metric, (None, None))
    estimate, off, scale = quick(x, y) if quick else (lambda i, j: KERNELS[metric](x[i], y[j]), 1e-9, lambda d: d)
    for i in range(0, len(x), ROWS):
        found, limit, best = [], None, None
        for j in range(0, len(y), COLUMNS):
            m = estimate(slice(i, i + ROWS), slice(j, j + COLUMNS))
            if odd:
                m[np.isnan(m)] = np.inf
            if same and (own := np.arange(max(i, j), min(i + len(m), j + m.shape[1]))).size:
                m[own - i, own - j] = np.inf
            if limit is None:
                tiny = 1e-6 if m.dtype == np.float32 else 1e-9
                more = lambda v, tiny=tiny: v + 2 * off + tiny * (1 + np.abs(v))
                limit = np.full(len(m), np.inf) if within is None else more(scale(within[i : i + ROWS]))
                best = np.full((len(m), k), np.inf, m.dtype)
            p, q, v, limit, best = _under(m, limit, best, more)
            found.append((p, q + j, v))
        p, q, d = (np.concatenate([f[c] for f in found] or [np.empty(0, np.int64)]) for c in range(3))
        if len(p):
            can = d <= limit[p]
            p, q, d = p[can] + i, q[can], d[can].astype(np.float64)
        if same:
            p, q, d = (v[p != q] for v in (p, q, d))
        d = np.round(_pairwise(one)(x, y, p, q) if one else d, 12)
        order = np.lexsort((q, d, p))
        p, q, d = p[order], q[order], d[order]
        keep = np.arange(len(p)) - np.searchsorted(p, p) < k
        yield p[keep], q[keep], d[keep]


class _Held:
    """The k nearest of a block's rows among the blocks that a task has met so far, and how far the last of them is."""

    def __init__(self, ids: pa.Array, k: int):
        self.ids, self.k, self.found = ids, k, []
        self.best = np.full((len(ids), k), np.inf)

    def within(self) -> np.ndarray:
        return self.best.max(1)

    def add(self, near: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], ids: pa.Array) -> None:
        parts = list(near)
        p, q, d = (np.concatenate([n[c] for n in parts] or [np.empty(0, np.int64)]) for c in range(3))
        new = np.full_like(self.best, np.inf)
        new[p, np.arange(len(p)) - np.searchsorted(p, p)] = d
        self.best = np.partition(np.concatenate([self.best, new], 1), self.k - 1, 1)[:, : self.k]
        can = d <= self.within()[p]
        self.found.append(pa.table({"p": p[can], "neighbor_compound_id": ids.take(pa.array(q[can])), "distance": d[can].astype(np.float64)}))

    def rows(self) -> pa.Table:
        t = pa.concat_tables(self.found)
        t = t.filter(pa.array(t.column("distance").to_numpy() <= self.within()[t.column("p").to_numpy()])).sort_by([("p", "ascending"), ("distance", "ascending"), ("neighbor_compound_id", "ascending")])
        p = t.column("p").to_numpy()
        t = t.filter(pa.array(np.arange(len(p)) - np.searchsorted(p, p) < self.k))
        return pa.table({"compound_id": self.ids.take(t.column("p").combine_chunks()), "neighbor_compound_id": t.column("neighbor_compound_id"), "distance": t.column("distance")})


def knn(df: DataFrame, key: str, metric: str, k: int = 10, table: DataFrame | None = None) -> DataFrame:
    """compound_id, neighbor_compound_id, neighbor_rank, distance: the k nearest others of each row, or all others if fewer.

    Distances count to 12 decimals; ties go to the smaller id. A task goes through pairs of blocks and takes what a row's k best are
    so far to the next block; it leaves k rows for each row of its blocks to be shuffled. table: what ``blocks`` has made of df, where
    several graphs of it are made.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for one, a, x, two, b, y in each_pair(batches):
            if one != last:
                if held:
                    yield from held.rows().to_batches()
                last, held = one, _Held(a, k)
            held.add(nearest(metric, x, y, one == two, k, held.within()), b)  # b is in order of its ids
        if held:
            yield from held.rows().to_batches()

    near = paired(blocks(df, key) if table is None else table, True).mapInArrow(run, f"compound_id {kind}, neighbor_compound_id {kind}, distance double")
    order = Window.partitionBy("compound_id").orderBy("distance", "neighbor_compound_id")
    return near.withColumn("neighbor_rank", F.row_number().over(order)).where(F.col("neighbor_rank") <= k).select("compound_id", "neighbor_compound_id", "neighbor_rank", "distance")


def with_property(edges: DataFrame, compounds: DataFrame, key: str = "compound_id") -> DataFrame:
    """Edges with both ends' property and the difference."""
    own = compounds.select(F.col(key).alias("compound_id"), "property")
    other = compounds.select(F.col(key).alias("neighbor_compound_id"), F.col("property").alias("neighbor_property"))
    return edges.join(own, "compound_id").join(other, "neighbor_compound_id").withColumn("abs_delta_property", F.abs(F.col("property") - F.col("neighbor_property")))


def top_k_graph(edges: DataFrame, k: int) -> DataFrame:
    """a, b, weight with a < b: pairs of which one is among the other's k nearest; weight is the similarity."""
    one = edges.where(F.col("neighbor_rank") <= k).select(F.least("compound_id", "neighbor_compound_id").alias("a"), F.greatest("compound_id", "neighbor_compound_id").alias("b"), (1 - F.col("distance")).alias("weight"))
    return one.groupBy("a", "b").agg(F.max("weight").alias("weight"))


def mutual_graph(edges: DataFrame, k: int) -> DataFrame:
    """a, b, weight with a < b: pairs that are both among the other's k nearest."""
    near = edges.where(F.col("neighbor_rank") <= k).select(F.least("compound_id", "neighbor_compound_id").alias("a"), F.greatest("compound_id", "neighbor_compound_id").alias("b"), (1 - F.col("distance")).alias("weight"))
    return near.groupBy("a", "b").agg(F.max("weight").alias("weight"), F.count(F.lit(1)).alias("_n")).where("_n = 2").drop("_n")


def full_graph(df: DataFrame, key: str, metric: str, floor: float | None = None) -> DataFrame:
    """a, b, weight of every pair, or of those with a similarity of ``floor``."""
    return all_pairs(df, key, metric, floor=floor).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), (1 - F.col("distance")).alias("weight"))


def threshold_graph(df: DataFrame, key: str, metric: str, threshold: float) -> DataFrame:
    return full_graph(df, key, metric, threshold)
