"""N-gram Jaccard join by PartEnum signatures.

Sets fall into bands by size; a pair with the asked similarity is in one band or in neighbouring ones, and differs in at most k
elements, k following from the band. The band's element domain is cut by a hash into n1 parts, each cut again into n2, and the
subsets of n2 - k2 second-level parts are enumerated, where n1 * (k2 + 1) > k: some first-level part holds at most k2 differences,
so some subset holds none, and both sets give it one signature.

A part that is empty in both sets would agree without saying anything. There are therefore more parts than needed, spare ones, and
signatures of empty subsets are left out; a set with more empty parts than are spare also gives its prefix elements as signatures
(the elements up to which two similar sets must share one), and so does its partner in any pair at stake. Spare parts that a set
hasn't used up so let it leave signatures that very many sets share: its similar sets meet it elsewhere.

Each signature is shuffled once, with its set's node, and those of one set only are dropped as they arrive. Sets that are equal are
one node: a 64-bit hash, and a second one where two different sets have the first in common. In each bucket of a signature all are
compared with the one that shares most signatures. Where a bucket still holds several components after that, its members are compared
by parity bitmaps, which bound their difference from below. Pairs that the bitmaps leave possible are checked on whole sets.

Defined results: a null or wordless text has an empty set and no links; a text with fewer words than a shingle is one shingle;
repeated rows link; a null doc_id links and is never a component's id unless all are null; an empty table gives an empty result;
other columns are not read (``one_of_each`` hands them on; they must have an order, for rows with equal id and text). Texts are
handled whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groveline.llm import hashing
from groveline.llm.common import discard, written
from groveline.llm.components import components, joined
from groveline.llm.repeats import Sieve

GOLD, SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


@dataclass(frozen=True)
class Scheme:
    """Sizes and signature counts at ``percent`` similarity. Bands grow by ``ratio``; sets are named by ``node_bits`` of a hash."""

    words: int = 4
    percent: int = 85
    ratio: float = 1.5
    n2: int = 2
    k2: int = 1
    node_bits: int = 64

    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        return _bands(max(self.ratio, 105 / self.percent))

    def parts(self, low: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first-level parts, spare places, k) for bands of these least and greatest sizes.

        A place is a part that can be agreed on: a second-level part where subsets are single parts (k differences spoil at most k
        of them), else a first-level part. There are so many spare places as the smallest set in the band leaves empty by chance.
        """
        k = 2 * greatest * (100 - self.percent) // (100 + self.percent)
        single = self.n2 - self.k2 == 1
        places = k + 1 if single else k // (self.k2 + 1) + 1
        share = 1 / places if single else (self.n2 - self.k2) / (self.n2 * places)
        empty = places * np.minimum(1.0, (1 if single else len(self.subsets())) * np.exp(-self.percent / 100 * low * share))
        spare = np.ceil(empty + 2 * np.sqrt(empty)).astype(np.int64)
        return -(-(places + spare) // self.n2) if single else places + spare, spare, k

    def subsets(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.n2), self.n2 - self.k2))


@lru_cache(maxsize=4)
def _bands(ratio: float) -> tuple[np.ndarray, np.ndarray]:
    low, high = [], []
    at = 1
    while at < 1 << 40:
        low.append(at)
        high.append(max(at, int(at * ratio)))
        at = high[-1] + 1
    return np.array(low), np.array(high)


def sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements ascending within each row, offsets of the rows) of the rows' distinct shingles."""
    w, _, _, at = hashing.words(data, offsets, lower=True)
    count = np.diff(at)
    prefix = hashing.Prefix(w)
    start = np.arange(len(w))
    row = hashing.rows_of(at)
    keep = (start + words <= at[row + 1]) | ((count[row] < words) & (start == at[row]))
    start, row = start[keep], row[keep]
    grams = prefix.of(start, np.minimum(start + words, at[row + 1]))
    order = np.lexsort((grams, row))
    grams, row = grams[order], row[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    return grams[new], np.searchsorted(row[new], np.arange(len(offsets)))


def set_hash(elements: np.ndarray, offsets: np.ndarray, seed: np.uint64 = GOLD) -> np.ndarray:
    """One number for each row, the same for equal sets; 0 for empty sets."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashing.mix(elements ^ seed), dtype=np.uint64)])
    size = np.diff(offsets).astype(np.uint64)
    return np.where(size > 0, hashing.mix(sums[offsets[1:]] - sums[offsets[:-1]] + size * seed) | np.uint64(1), np.uint64(0))


class Names:
    """The node of each set: a hash of it, and another hash where two different sets have the first in common."""

    def __init__(self, bits: int = 64, other: dict[int, int] | None = None):
        self.mask, self.other = np.uint64((1 << bits) - 1), other or {}

    def both(self, elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (set_hash(elements, offsets) & self.mask).view(np.int64), set_hash(elements, offsets, SECOND).view(np.int64)

    def of(self, elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        node, second = self.both(elements, offsets)
        if self.other:
            node = np.array([self.other.get(s, n) for n, s in zip(node.tolist(), second.tolist(), strict=True)], np.int64)
        return node


def signatures(elements: np.ndarray, offsets: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, room) of all rows. room: the band's number and how many of the row's signatures in that band may be left
    unused without losing a pair, as band * 2**16 + count; -1 where none may."""
    low, high = scheme.bands()
    size = np.diff(offsets)
    rows = np.flatnonzero(size > 0)
    band = np.searchsorted(high, size[rows])
    up = 100 * size[rows] >= scheme.percent * low[band + 1]  # near enough to the next band to have a partner there
    who, where = np.concatenate([rows, rows[up]]), np.concatenate([band, band[up] + 1])
    n1, spare, k = scheme.parts(low[where], high[where])
    who, where, n1, spare = who[k > 0], where[k > 0], n1[k > 0], spare[k > 0]  # with no difference allowed, sets that link are one node
    parts = n1 * scheme.n2
    base = np.concatenate([[0], np.cumsum(parts)])
    length = size[who]
    entry = np.repeat(np.arange(len(who)), length)
    which = np.arange(len(entry)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(offsets[who], length)
    e = elements[which]
    part = ((hashing.mix(e * GOLD) >> np.uint64(32)) * parts[entry].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    slot = base[entry] + part
    order = np.argsort(slot, kind="stable")
    total = np.zeros(base[-1], np.uint64)
    filled = np.zeros(base[-1], bool)
    if len(order):
        edge = np.flatnonzero(np.concatenate([[True], np.diff(slot[order]) > 0]))
        used = slot[order][edge]
        total[used] = np.add.reduceat(hashing.mix(e[order] + GOLD), edge)
        filled[used] = True
    owner = np.repeat(np.arange(len(who)), n1)  # of each first-level part
    local = np.arange(len(owner)) - np.repeat(np.cumsum(n1) - n1, n1)
    two, some = total.reshape(-1, scheme.n2), filled.reshape(-1, scheme.n2)
    out_of, out_sig = [], []
    single = scheme.n2 - scheme.k2 == 1
    empty = np.zeros(len(owner), np.int64)
    for number, subset in enumerate(scheme.subsets()):
        have = some[:, subset].any(1)
        empty = empty + ~have if single else empty | ~have
        tag = hashing.mix(((where[owner] * 64 + number).astype(np.uint64) << np.uint64(40)) + local.astype(np.uint64) + np.uint64(1))
        mixed = tag.copy()
        for p in subset:
            mixed = hashing.mix(mixed + two[:, p])
        out_of.append(owner[have])
        out_sig.append(mixed[have])
    left = spare - np.bincount(owner, empty, minlength=len(who)).astype(np.int64)
    room = np.where(left >= 0, where * (1 << 16) + np.minimum(left, (1 << 16) - 1), -1)
    rest = np.unique(who[left < 0])
    n = size[rest] - -(-scheme.percent * size[rest] // 100) + 1
    row = np.repeat(rest, n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + offsets[row]
    prefix = hashing.mix(elements[at] ^ np.uint64(0x5851F42D4C957F2D))
    of = np.concatenate(out_of).astype(np.int64)
    return np.concatenate([who[of], row]), np.concatenate([*out_sig, prefix]), np.concatenate([room[of], np.full(len(row), -1, np.int64)])


def _described(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, rid, node and second (null for an empty set), n_shingles, and the set's sketch."""
    names = Names(scheme.node_bits)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = hashing.Texts(batch.column("text"))
            for a, z in texts.groups():
                elements, at = sets(*texts.bytes(a, z), scheme.words)
                (node, second), size = names.both(elements, at), np.diff(at)
                made = [pa.array(node, mask=size == 0), pa.array(second, mask=size == 0), pa.array(size), pa.array(bitmaps(elements, at), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, z - a), batch.column("rid").slice(a, z - a), *made], ["doc_id", "rid", "node", "second", "n_shingles", "sketch"])

    return docs.mapInArrow(hashing.tidy(each), "doc_id long, rid long, node long, second long, n_shingles long, sketch binary")


def _names(described: DataFrame, scheme: Scheme) -> Names:
    """What tells sets with one hash apart: two rows of the driver for each collision, of 64 bits some 3 among 10**10 sets."""
    clash = described.where("node IS NOT NULL").groupBy("node").agg(F.min("second").alias("_a"), F.max("second").alias("_b")).where("_a != _b").select(F.col("node").alias("_n"), "_a")
    others = described.join(F.broadcast(clash), (F.col("node") == F.col("_n")) & (F.col("second") != F.col("_a"))).select("second").distinct().collect()
    return Names(scheme.node_bits, {r["second"]: r["second"] for r in others})


def _signed(docs: DataFrame, scheme: Scheme, names: Names) -> DataFrame:
    """(sig, node, room). Copies of a set that one task meets give their signatures once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = hashing.Texts(batch.column("text"))
            for a, z in texts.groups():
                elements, at = sets(*texts.bytes(a, z), scheme.words)
                node = names.of(elements, at)
                new = np.array([n not in seen and not seen.add(n) for n in node.tolist()], bool)
                row, sig, room = signatures(elements, at, scheme)
                keep = new[row]
                yield pa.RecordBatch.from_arrays([pa.array(sig[keep].view(np.int64)), pa.array(node[row[keep]]), pa.array(room[keep].astype(np.int32))], ["sig", "node", "room"])

    return docs.select("text").mapInArrow(hashing.tidy(each), "sig long, node long, room int")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of (sig, node): those whose signature another node has too, once each."""
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]  # the last row, until what follows it is seen
    known = False  # whether its signature has been seen with another node
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, node, room = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("sig", "node", "room"), strict=True))
        same = sig[1:] == sig[:-1]
        new = np.concatenate([[True], ~same | (node[1:] != node[:-1])])
        sig, node, room = sig[new], node[new], room[new]
        same = sig[1:] == sig[:-1]
        before = np.concatenate([[known], same])
        hit = before[:-1] | same
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][hit]) for x in (sig, node, room)], ["sig", "node", "room"])
        held, known = [sig[-1:], node[-1:], room[-1:]], bool(before[-1])
    if known:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["sig", "node", "room"])


def _members(docs: DataFrame, scheme: Scheme, names: Names) -> DataFrame:
    """(sig, node, room) of the signatures that several nodes have, written, without what may be left unused.

    Each signature is shuffled once. A pair of similar sets agrees on more places than either has spare ones; so a set may leave
    crowded buckets if these are no more than the spare places that it hasn't used for empty parts: its pairs meet elsewhere.
    """
    dealt = _signed(docs, scheme, names).repartition("sig").sortWithinPartitions("sig", "node")
    members = written(dealt.mapInArrow(hashing.tidy(_shared), "sig long, node long, room int"))
    crowded = written(members.groupBy("sig").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CROWD).select("sig"))
    if crowded.limit(1).count():
        band = F.shiftright("room", 16).alias("band")
        inside = members.join(crowded, "sig").where("room >= 0")
        leaving = inside.groupBy("node", band).agg(F.count(F.lit(1)).alias("_n"), F.min(F.col("room").bitwiseAND(0xFFFF)).alias("_room")).where("_n <= _room").select(F.col("node").alias("_node"), "band")
        stay = members.join(crowded, "sig").join(leaving, (F.col("node") == F.col("_node")) & (F.shiftright("room", 16) == F.col("band")), "left_anti")
        fewer = written(members.join(crowded, "sig", "left_anti").unionByName(stay))
        discard(members)
        members = fewer
    discard(crowded)
    return members


def _texts(wanted: DataFrame, docs: DataFrame, scheme: Scheme, names: Names) -> DataFrame:
    """node, zip, size: a compressed text of each wanted node. wanted: node and a row that has it."""
    sieve = Sieve(wanted)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(sieve.test(batch.column("rid").to_numpy())))
            texts = hashing.Texts(batch.column("text"))
            for a, z in texts.groups():
                node = names.of(*sets(*texts.bytes(a, z), scheme.words))
                raw = [bytes(texts.data[x:y]) for x, y in zip(texts.offsets[a:z], texts.offsets[a + 1 : z + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node), batch.column("rid").slice(a, z - a), pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in raw], pa.binary()), pa.array([len(t) for t in raw], pa.int64())], ["node", "rid", "zip", "size"])

    texts = docs.select("rid", "text").mapInArrow(hashing.tidy(packed), "node long, rid long, zip binary, size long")
    return wanted.select("node", "rid").join(texts, ["node", "rid"]).dropDuplicates(["node"]).select("node", "zip", "size")


def _checked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, scheme: Scheme, names: Names) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough, written. nodes: node and a row that has it."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(ends.join(nodes.select("node", "rid"), "node"))
    texts = written(_texts(wanted, docs, scheme, names))
    side = lambda c: texts.select(F.col("node").alias(c), F.col("zip").alias(f"zip_{c}"), F.col("size").alias(f"size_{c}"))
    both = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)

        def elements(zipped: bytes, size: int) -> np.ndarray:
            data = np.frombuffer(pa.decompress(zipped, decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
            return sets(data, np.array([0, len(data)]), scheme.words)[0]

        for batch in batches:
            kept = []
            for a, za, na, zb, nb in zip(*(batch.column(c).to_pylist() for c in ("a", "zip_a", "size_a", "zip_b", "size_b")), strict=True):
                if last[0] != a:
                    last = (a, elements(za, na))
                x, y = last[1], elements(zb, nb)
                both = len(x) + len(y)
                common = both - len(np.union1d(x, y))
                kept.append(100 * common >= scheme.percent * (both - common))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    out = written(both.mapInArrow(hashing.tidy(each), "a long, b long"))
    discard(wanted, texts)
    return out


def bitmaps(elements: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For each row the parity of its elements' hashes, in 2 to 4 bits for each element, a power of two.

    The bits in which two rows differ are at most as many as the elements in which they differ. A bitmap folds to half its length by
    the exclusive or of its halves.
    """
    size = np.diff(offsets)
    width = np.array([max(64, 2 << int(n).bit_length()) for n in size], np.int64)
    base = np.concatenate([[0], np.cumsum(width)])
    row = hashing.rows_of(offsets)
    place = base[row] + ((hashing.mix(elements + GOLD) >> np.uint64(20)).astype(np.int64) & (width[row] - 1))
    bits = (np.bincount(place, minlength=base[-1]) & 1).astype(np.uint8)
    data = np.packbits(bits, bitorder="little").tobytes()
    return [data[a // 8 : z // 8] for a, z in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


class Sketches:
    """The bitmaps of a task's nodes, each as wide as it is and folded once, in one matrix for each width."""

    def __init__(self, node: np.ndarray, size: np.ndarray, maps: list[bytes]):
        order = np.argsort(node, kind="stable")
        self.node, self.size = node[order], size[order]
        words = np.array([len(m) // 8 for m in maps], np.int64)[order]
        self.words, self.matrix, self.place = words, {}, {}
        for w in np.unique(words).tolist():
            own = np.flatnonzero(words == w)
            m = np.frombuffer(b"".join(maps[order[i]] for i in own), np.uint64).reshape(len(own), w)
            self._add(w, own, m)
            if w > 1:
                self._add(w // 2, own, m[:, : w // 2] ^ m[:, w // 2 :])

    def _add(self, width: int, own: np.ndarray, m: np.ndarray) -> None:
        place = self.place.setdefault(width, np.full(len(self.node), -1, np.int64))
        before = self.matrix.get(width, np.empty((0, width), np.uint64))
        place[own] = len(before) + np.arange(len(own))
        self.matrix[width] = np.concatenate([before, m])

    def of(self, node: np.ndarray) -> np.ndarray:
        """The places of nodes that are here."""
        return np.searchsorted(self.node, node)

    def near(self, x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs of places those whose sizes and bitmaps leave the similarity possible, and their least difference."""
        low, high = np.minimum(self.size[x], self.size[y]), np.maximum(self.size[x], self.size[y])
        can = 100 * low >= percent * high
        x, y = x[can], y[can]
        width = np.minimum(self.words[x], self.words[y])
        out = []
        for w in np.unique(width).tolist():
            own = np.flatnonzero(width == w)
            m, place = self.matrix[w], self.place[w]
            step = max(1, (1 << 20) // w)
            for i in range(0, len(own), step):
                a, b = x[own[i : i + step]], y[own[i : i + step]]
                apart = np.bitwise_count(m[place[a]] ^ m[place[b]]).sum(1, dtype=np.int64)
                keep = apart * (100 + percent) <= (self.size[a] + self.size[b]) * (100 - percent)
                out.append((a[keep], b[keep], apart[keep]))
        return tuple(np.concatenate([o[j] for o in out] or [np.empty(0, np.int64)]) for j in range(3))


def centre_pairs(edge: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places: in each bucket the member that stands in most buckets here, with every other. edge: where buckets begin."""
    degree = np.bincount(at)
    count = np.diff(edge)
    bucket = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((-at, degree[at], bucket))
    first = at[order[edge[1:] - 1]]
    x, y = first[bucket], at
    return x[x != y], y[x != y]


def bucket_pairs(first: int, n: int, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of one bucket of n rows, or of two of its blocks of ``first`` and n - first rows, some at a time."""
    if first == n:
        if n <= 64:
            x, y = np.triu_indices(n, 1)
            yield at[x], at[y]
            return
        for i in range(0, n, 64):
            x, y = np.meshgrid(np.arange(i, min(n, i + 64)), np.arange(i, n), indexing="ij")
            yield at[x[x < y]], at[y[x < y]]
        return
    for i in range(0, first, 64):
        x, y = np.meshgrid(at[i : min(first, i + 64)], at[first:n], indexing="ij")
        yield x.ravel(), y.ravel()


#: Stands among the picked pairs for pairs that were left for a later round; no node is 0.
MORE = (0, 0)


def picked(pairs: set[tuple[float, int, int, int, int]], most: int) -> list[tuple[int, int]]:
    """The pairs to check first: of each two components the ``most`` nearest; with 0, the nearest that would join all that can be joined."""
    out, up, count = [], {}, {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for _, a, b, p, q in sorted(pairs):
        if most:
            key = (min(p, q), max(p, q))
            count[key] = count.get(key, 0) + 1
            if count[key] <= most:
                out.append((a, b))
        elif find(p) != find(q):
            up[find(p)] = find(q)
            out.append((a, b))
    return out if len(out) == len(pairs) else [*out, MORE]


def _comparer(most: int, percent: int):
    """What a task does with its buckets and pairs of blocks. most: -1 for all against the buckets' centres, else see ``picked``."""

    def each(t: pa.Table, sketches: pa.Table) -> pa.Table:
        s = Sketches(sketches.column("of_node").to_numpy(), sketches.column("size").to_numpy(), sketches.column("sketch").to_pylist())
        sig, low, high = (t.column(c).to_numpy() for c in ("sig", "low", "high"))
        second = t.column("i").to_numpy() != low
        order = np.lexsort((second, high, low, sig))
        sig, low, high, second = sig[order], low[order], high[order], second[order]
        at = s.of(t.column("node").to_numpy()[order])
        edge = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True]]))
        if most < 0:
            x, y = centre_pairs(edge, at)
            x, y = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1) if len(x) else (x, y)
            x, y, _ = s.near(x, y, percent)
            return pa.table({"a": pa.array(s.node[x]), "b": pa.array(s.node[y])})
        component = np.zeros(len(s.node), np.int64)
        component[at] = t.column("component").to_numpy()[order]
        found: set[tuple[float, int, int, int, int]] = set()
        some: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def compare() -> None:
            x, y = (np.concatenate([p[j] for p in some]) for j in (0, 1))
            keep = component[x] != component[y]
            x, y = x[keep], y[keep]
            if len(x):
                x, y = np.divmod(np.unique(np.minimum(x, y) * len(s.node) + np.maximum(x, y)), len(s.node))
            x, y, apart = s.near(x, y, percent)
            share = apart / (s.size[x] + s.size[y])
            found.update(zip(share.tolist(), s.node[x].tolist(), s.node[y].tolist(), component[x].tolist(), component[y].tolist(), strict=True))
            some.clear()

        for begin, end in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            one = int((~second[begin:end]).sum())
            if low[begin] != high[begin] and not 0 < one < end - begin:
                continue
            for pair in bucket_pairs(one, end - begin, at[begin:end]):
                some.append(pair)
                waiting += len(pair[0])
                if waiting > 1 << 20:
                    compare()
                    waiting = 0
        if some:
            compare()
        out = picked(found, most)
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return each


#: Rows of a bucket's block: a larger bucket is compared block by block. Rows that a task gets. Members that make a bucket crowded.
BLOCK, TASK, CROWD = 1024, 32_768, 256


def _compared(placed: DataFrame, nodes: DataFrame, most: int, scheme: Scheme) -> DataFrame:
    """(a, b), written: what _comparer finds. placed: sig, lead, blocks, node, component."""
    rows = placed.count()
    block = F.pmod(F.xxhash64(F.lit(2), "node"), F.col("blocks")).cast("int")
    dealt = placed.withColumn("i", block)
    if most < 0:
        dealt = dealt.select("sig", "lead", "node", "component", "i", F.col("i").alias("low"), F.col("i").alias("high"))
    else:
        dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("sig", "lead", "node", "component", "i", F.least("i", "j").alias("low"), F.greatest("i", "j").alias("high"))
    # buckets with one least member share most others too: in one task, a member's bitmap comes once for all of them
    task = F.pmod(F.xxhash64("lead", "low", "high"), F.lit(max(1, -(-rows // TASK)))).cast("int")
    dealt = dealt.select(task.alias("task"), "sig", "node", "component", "i", "low", "high")
    maps = dealt.select(F.col("task").alias("of_task"), F.col("node").alias("of_node")).distinct().join(nodes.select("node", "size", "sketch"), F.col("of_node") == F.col("node")).select("of_task", "of_node", "size", "sketch")
    return written(dealt.groupBy("task").cogroup(maps.groupBy("of_task")).applyInArrow(hashing.tidy(_comparer(most, scheme.percent)), "a long, b long").distinct())


def _linked_nodes(members: DataFrame, docs: DataFrame, nodes: DataFrame, scheme: Scheme, names: Names) -> DataFrame:
    """(node, component) of the nodes that are linked with another.

    Buckets with the same members are one. In each block of a bucket all members are first compared with its centre. Buckets that
    hold several components after that are compared block by block by bitmaps, and only pairs that can be similar are checked:
    first those that would join the most, then of each two components that are still apart the nearest few, and more in each
    round, until all that could link has been checked.
    """
    alike = members.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("h2"), F.min("node").alias("lead")).where("n > 1")
    buckets = alike.groupBy("n", "h1", "h2").agg(F.min("sig").alias("sig"), F.min("lead").alias("lead")).select("sig", "n", "lead", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = written(members.select("sig", "node").join(buckets, "sig"))
    discard(members)
    tested = _compared(placed.withColumn("component", F.col("node")), nodes, -1, scheme)
    label = components(_checked(tested, docs, nodes, scheme, names))
    for most in (0, 8, 64, 4096, 1 << 62):
        now = placed.where("n > 2").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = now.groupBy("sig").agg(F.min("component").alias("_x"), F.max("component").alias("_y")).where("_x != _y").select("sig")
        apart = written(now.join(several, "sig"))
        if not apart.limit(1).count():
            break
        possible = _compared(apart, nodes, most, scheme)
        discard(apart)
        last = possible.where("a = 0").limit(1).count() == 0
        found = written(possible.where("a != 0").join(tested, ["a", "b"], "left_anti"))
        discard(possible)
        if found.limit(1).count():
            links = _checked(found, docs, nodes, scheme, names)
            tested = written(tested.unionByName(found))
            if links.limit(1).count():
                label = joined(label, links)
        if last:
            break
    return label


def linked(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """doc_id, rid, n_shingles, component, component_id for each row of docs; rid: hash of doc_id and text, component: a node of it."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("rid"))
    described = written(_described(rows, scheme))
    names = _names(described, scheme)
    if names.other:
        described = described.withColumn("node", F.when(F.col("second").isin(list(names.other)), F.col("second")).otherwise(F.col("node")))
    nodes = written(described.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("rid").alias("rid"), F.max("n_shingles").alias("size"), F.first("sketch").alias("sketch")))
    label = _linked_nodes(_members(rows, scheme, names), rows, nodes, scheme, names)
    placed = nodes.select("node", "least").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = placed.select("node", "component").join(least, "component").select(F.col("node").alias("_node"), "component", "component_id")
    out = described.select("doc_id", "rid", "node", "n_shingles").join(of_node, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", "rid", "n_shingles", F.coalesce("component", "rid").alias("component"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def join(docs: DataFrame, scheme: Scheme = Scheme()) -> DataFrame:
    """doc_id, n_shingles, component_id for each document."""
    return linked(docs, scheme).drop("rid", "component")


def one_of_each(docs: DataFrame, scheme: Scheme = Scheme(words=5, percent=80)) -> DataFrame:
    """``docs`` with one row of each component: the one with the least doc_id, and of rows that share it the least row.

    Only rows that may go are shuffled: all others are taken as they are read.
    """
    found = written(linked(docs, scheme).select("doc_id", "rid", "component", (F.col("n_shingles") == 0).alias("wordless")))
    first = found.groupBy("component", "wordless").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("f"))
    stay = written(first.select(F.col("f.doc_id").alias("doc"), F.col("f.rid").alias("stay")))
    once = found.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("rid")
    sure = once.join(stay, F.col("rid") == F.col("stay"), "left_semi")
    unsure = written(found.select("rid").distinct().join(sure, "rid", "left_anti"))
    sieve = Sieve(unsure)

    @F.arrow_udf("boolean")
    def may_go(rid: pa.Array) -> pa.Array:
        return pa.array(sieve.test(rid.to_numpy()))

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"))
    packed = packed.withColumn("may_go", may_go("rid"))
    some = packed.where("may_go").join(stay, (F.col("rid") == F.col("stay")) & F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi")
    rows = packed.where("NOT may_go").select("row").unionByName(some.groupBy("doc_id", "rid").agg(F.min("row").alias("row")).select("row"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
