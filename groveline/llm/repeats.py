"""Windows of a text's tokens that start anywhere else too: what the two substring operators share.

Each run of windows is keyed by its least gram (see hashing.minimizers): equal windows have equal keys, and stand at equal places
around the gram. Only keys that occur twice or more go on. Under a key, runs whose whole stretch of tokens is equal are one kind; so
groups of copies, of whatever size, weigh as one kind. The operator's method then gets the kinds key by key, those that occur more
than once set out twice, and says which of their windows are repeated; what it says of a kind holds for all its runs.

A key with more kinds than one task should hold is taken apart by grams of twice the length: its kinds are treated as texts of
their own, and handed on under the keys that these grams give. A gram as long as the window leaves one kind only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groveline.llm import hashing
from groveline.llm.common import discard, written

def named(df: DataFrame, *columns: str, bits: int = 64) -> Column:
    """A 64-bit name of each row of ``df`` by these columns: a hash, and another hash where the first stands for different rows.

    The driver holds two numbers for each such collision, some 3 among 10**10 rows. ``bits``: of the first hash, for tests.
    """
    one, two = F.shiftrightunsigned(F.xxhash64(*columns), 64 - bits), F.xxhash64(F.lit(1), *columns)
    both = df.select(one.alias("one"), two.alias("two"))
    clash = both.groupBy("one").agg(F.min("two").alias("a"), F.max("two").alias("b")).where("a != b").select(F.col("one").alias("_one"), "a")
    other = [r["two"] for r in both.join(F.broadcast(clash), F.col("one") == F.col("_one")).where("two != a").select("two").distinct().collect()]
    return F.when(two.isin(other), two).otherwise(one) if other else one


def keyed(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, text and a name of the row. Rows with equal id and text have one, and are found to repeat each other."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), named(docs, "doc_id", "text", bits=bits).alias("rid"))


def tokens(data: np.ndarray, offsets: np.ndarray, by: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values of the first hash, of the second, offsets of the rows' tokens)."""
    if by == "byte":
        return hashing.byte_values(0)[data], hashing.byte_values(1)[data], offsets
    if by == "hash":  # eight bytes each
        w = np.frombuffer(data.tobytes(), np.uint64)
        return w, w, offsets // 8
    w, _, _, at = hashing.words(data, offsets)
    return w, w, at


def runs(docs: DataFrame, by: str, window: int, gram: int, sieve: Sieve | None = None) -> DataFrame:
    """(h, ph, rid, pos): key, hash of the stretch, and first start * 2**8 + starts - 1 of each run of windows that the sieve lets through."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rid = hashing.Texts(batch.column("text")), batch.column("rid").to_numpy()
            for a, z in texts.groups():
                v0, v1, at = tokens(*texts.bytes(a, z), by)
                grams = hashing.Prefix(v0).window(gram)
                row, first, last, least = hashing.minimizers(grams, at, gram, window)
                h = grams[least].view(np.int64)
                if sieve is not None:
                    hit = sieve.test(h)
                    row, first, last, h = row[hit], first[hit], last[hit], h[hit]
                if not len(row):
                    continue
                ph = hashing.Prefix(v1, 1).of(first, last + window)
                pos = (first - at[row]) * 256 + (last - first)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (h, ph.view(np.int64), rid[a + row], pos)], ["h", "ph", "rid", "pos"])

    return docs.select("rid", "text").mapInArrow(hashing.tidy(each), "h long, ph long, rid long, pos long")


def again(docs: DataFrame, by: str, window: int, gram: int) -> DataFrame:
    """The runs whose key occurs more than once, written."""
    keys = written(runs(docs, by, window, gram).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("key")))
    # the keys are a table of their own here, so that a key with very many runs is a skewed join, which is split
    return written(runs(docs, by, window, gram, Sieve(keys, "key")).join(keys, F.col("h") == F.col("key"), "left_semi"))


class Sieve:
    """A set of 64-bit keys as a bitmap of eight bits or more for each: lets through every key that is in it, and few others.

    The bitmap is broadcast, so it is at most ``most_bits`` long (32 MB); of more keys than half of that none is made, and all rows
    go through to the join that follows. That changes what is shuffled, never a result.
    """

    def __init__(self, keys: DataFrame, column: str = "rid", most_bits: int = 1 << 28):
        n = keys.count()
        self.n_bits, self.bits = 1 << min(most_bits.bit_length() - 1, max(15, (8 * n).bit_length())), None
        if 2 * n > most_bits:
            return
        place = keys.select((F.pmod(F.col(column), F.lit(self.n_bits)) + 1).alias("p"))  # positions count from 1
        maps = place.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
        bits = np.zeros(self.n_bits // 8, np.uint8)
        for r in maps:
            bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
        self.bits = keys.sparkSession.sparkContext.broadcast(bits.tobytes())

    def test(self, rid: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(rid), bool)
        bits, p = np.frombuffer(self.bits.value, np.uint8), rid % self.n_bits
        return (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)


def _raw(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def pieces(docs: DataFrame, kinds: DataFrame, by: str, window: int) -> DataFrame:
    """``kinds`` (h, ph, n, rid, pos of one run) with their tokens: piece, bytes or word hashes of 8 bytes."""
    sieve = Sieve(kinds)
    wanted = kinds.groupBy("rid").agg(F.collect_list(F.struct("h", "ph", "n", "pos")).alias("of"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # of equal rows, a task hands on one
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            hit = sieve.test(rid)
            hit[hit] = [r not in done and not done.add(r) for r in rid[hit].tolist()]
            for part in parts(batch.filter(pa.array(hit))):
                yield _packed(part)

    texts = docs.select("rid", "text").mapInArrow(hashing.tidy(packed), "rid long, zip binary, size long").dropDuplicates(["rid"])
    both = wanted.hint("shuffle_hash").join(texts, "rid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for rid, of, zipped, size in zip(*(batch.column(c).to_pylist() for c in ("rid", "of", "zip", "size")), strict=True):
                data = np.frombuffer(pa.decompress(zipped, decompressed_size=size, codec="zstd"), np.uint8) if size else np.empty(0, np.uint8)
                values = data if by == "byte" else data.view(np.uint64) if by == "hash" else hashing.words(data, np.array([0, len(data)]))[0]
                for x in of:
                    first = x["pos"] >> 8
                    part = values[first : first + (x["pos"] & 255) + window].tobytes()
                    for k, v in zip(rows, (x["h"], x["ph"], x["n"], rid, x["pos"], part), strict=True):
                        k.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(r, pa.int64()) for r in rows[:5]), pa.array(rows[5], pa.binary())], ["h", "ph", "n", "rid", "pos", "piece"])

    return both.select("rid", "of", "zip", "size").mapInArrow(hashing.tidy(cut), "h long, ph long, n long, rid long, pos long, piece binary")


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw = _raw(batch.column("text"))
    return pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([pa.compress(t, codec="zstd", asbytes=True) for t in raw], pa.binary()), pa.array([len(t) for t in raw], pa.int64())], ["rid", "zip", "size"])


def union_of(pos: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (first, stop) of the tokens that the windows of the runs at pos cover."""
    pos = np.sort(pos)
    first, stop = pos >> 8, (pos >> 8) + (pos & 255) + window
    reach = np.maximum.accumulate(stop)
    new = np.concatenate([[True], first[1:] > reach[:-1]])
    return first[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(pos) - 1]])]


def without(text: bytes, spans: tuple[np.ndarray, np.ndarray], by: str) -> tuple[bytes, int, int, int]:
    """(what is left, tokens, tokens removed, removed runs) of a text."""
    first, stop = spans
    if by == "byte":
        edges = np.concatenate([[0], np.stack([first, stop], 1).ravel(), [len(text)]]).astype(int)
        return b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)), len(text), int((stop - first).sum()), len(first)
    words = text.split()
    edges = np.concatenate([[0], np.stack([first, stop], 1).ravel(), [len(words)]]).astype(int)
    return b" ".join(w for a, z in zip(edges[::2], edges[1::2], strict=True) for w in words[a:z]), len(words), int((stop - first).sum()), len(first)


NO_SPANS = (np.empty(0, np.int64), np.empty(0, np.int64))


def spans_of(found: DataFrame) -> DataFrame:
    """A row for each text that loses something, with the runs of windows that go."""
    return found.groupBy("rid").agg(F.collect_list("pos").alias("at")).select(F.col("rid").alias("_r"), "at")


def removed(docs: DataFrame, found: DataFrame, by: str, window: int) -> DataFrame:
    """doc_id, n_tokens, n_removed, n_spans, kept_sha256 of every row of ``docs``.

    Only the texts of rows that the sieve lets through are shuffled, compressed; the others' results are made as they are read.
    """
    sieve = Sieve(found)
    schema = "doc_id long, rid long, n_tokens long, n_removed long, n_spans long, kept_sha256 string"

    def result(text: bytes, at: tuple[np.ndarray, np.ndarray]) -> tuple:
        kept, n, gone, k = without(text, at, by)
        return n, gone, k, hashlib.sha256(kept).hexdigest()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts(whole):
                hit = sieve.test(batch.column("rid").to_numpy())
                texts = _raw(batch.column("text"))
                made = [(None,) * 4 if h else result(t, NO_SPANS) for t, h in zip(texts, hit, strict=True)]
                zipped = [pa.compress(t, codec="zstd", asbytes=True) if h else None for t, h in zip(texts, hit, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), *_columns(made), pa.array(zipped, pa.binary()), pa.array([len(t) for t in texts], pa.int64())], [*_NAMES, "zip", "size"])

    seen = docs.select("doc_id", "rid", "text").mapInArrow(hashing.tidy(first), schema + ", zip binary, size long")
    both = seen.join(spans_of(found).hint("shuffle_hash"), F.col("rid") == F.col("_r"), "left").drop("_r")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            made = []
            for i, zipped in enumerate(cols["zip"]):
                if zipped is None:
                    made.append(tuple(cols[c][i] for c in _NAMES[2:]))
                else:
                    size, at = cols["size"][i], cols["at"][i]
                    text = pa.decompress(zipped, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
                    made.append(result(text, union_of(np.array(at, np.int64), window) if at else NO_SPANS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), *_columns(made)], _NAMES)

    return both.mapInArrow(hashing.tidy(second), schema)


def left_over(docs: DataFrame, rid: Column, found: DataFrame, by: str, window: int) -> DataFrame:
    """``docs`` with the text that is left. Rows that the sieve holds back lose nothing and are taken as they are read."""
    sieve = Sieve(found)

    @F.arrow_udf("boolean")
    def loses(rid: pa.Array) -> pa.Array:
        return pa.array(sieve.test(rid.to_numpy()))

    @F.arrow_udf("string")
    def kept(text: pa.Array, at: pa.Array) -> pa.Array:
        both = zip(text.to_pylist(), at.to_pylist(), strict=True)
        return pa.array([t if p is None or t is None else without(t.encode(), union_of(np.array(p, np.int64), window), by)[0].decode("utf-8", "replace") for t, p in both], pa.string())

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), rid.alias("rid"))
    packed = packed.withColumn("loses", loses("rid"))
    some = packed.where("loses").join(spans_of(found), F.col("rid") == F.col("_r"), "left").withColumn("text", kept(F.col("row").getField("text"), "at"))
    rows = packed.where("NOT loses").select("row", F.col("row").getField("text").alias("text")).unionByName(some.select("row", "text"))
    return rows.select(*[(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def parts(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch some rows at a time, for the memory that single texts take."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


_NAMES = ["doc_id", "rid", "n_tokens", "n_removed", "n_spans", "kept_sha256"]


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]


def joined_up(piece: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first start, starts) of the runs that windows make up, each given at least once."""
    both = np.unique((piece.astype(np.int64) << 8) + start)
    new = np.flatnonzero(np.concatenate([[True], np.diff(both) != 1])[: len(both)])
    return both[new] >> 8, both[new] & 255, np.diff(np.concatenate([new, [len(both)]]))


def compared(found: DataFrame, by: str, window: int, gram: int, compare, per_task: int) -> DataFrame:
    """(h, ph, n, rid, pos, at): the windows of the kinds that repeat, at being first start * 2**8 + starts - 1 within the kind.

    ``compare`` gets whole keys, about ``per_task`` kinds at a time. A kind that occurs more than once is set out twice.
    """
    tasks = max(1, -(-found.count() // per_task))
    dtype = np.uint8 if by == "byte" else np.uint64

    def each(table: pa.Table) -> pa.Table:
        place = np.arange(len(table))
        place = np.concatenate([place, np.flatnonzero(table.column("n").to_numpy() > 1)])
        both = table.take(pa.array(place)).combine_chunks()
        raw = hashing.Texts(both.column("piece"))
        stretch = Stretches(raw.data.view(np.uint8)[: raw.offsets[-1]].tobytes(), raw.offsets, dtype, both.column("h").to_numpy().view(np.uint64), window, gram)
        piece, start = compare(stretch)
        first = piece < len(table)
        piece, start, length = joined_up(piece[first], start[first])
        return table.select(["h", "ph", "n", "rid", "pos"]).take(pa.array(piece)).append_column("at", pa.array(start * 256 + length - 1))

    dealt = found.select(F.pmod(F.xxhash64("h"), F.lit(tasks)).cast("int").alias("task"), "h", "ph", "n", "rid", "pos", "piece")
    return dealt.groupBy("task").applyInArrow(hashing.tidy(each), "h long, ph long, n long, rid long, pos long, at long")


class Stretches:
    """Stretches of tokens under keys, each set out around the first gram that hashes to its key."""

    def __init__(self, data: bytes, offsets: np.ndarray, dtype, key: np.ndarray, window: int, gram: int, some: int = 1 << 20):
        self.values = np.frombuffer(data, dtype)
        self.offsets = (offsets - offsets[0]) // np.dtype(dtype).itemsize
        self.key, self.window, self.gram = key, window, gram
        self.length = np.diff(self.offsets)
        self.anchor = np.empty(len(key), np.int64)
        first = 0
        while first < len(key):  # some tokens at a time, for the memory that hashes take
            stop = max(first + 1, int(np.searchsorted(self.offsets, self.offsets[first] + some, "right")) - 1)
            at = self.offsets[first : stop + 1]
            values = self.values[at[0] : at[-1]]
            grams = hashing.Prefix(values if dtype is np.uint64 else hashing.byte_values(0)[values]).window(gram)
            row = hashing.rows_of(at - at[0])
            hits = np.flatnonzero(grams == key[first:stop][row[: len(grams)]])
            rows, where = np.unique(row[hits], return_index=True)
            assert len(rows) == stop - first, "a stretch without the gram of its key"
            self.anchor[first:stop] = hits[where] - (at[:-1] - at[0])
            first = stop


def find_repeats(docs: DataFrame, by: str, window: int, gram: int, compare, most_kinds: int = 20_000, per_task: int = 6000) -> DataFrame:
    """(rid, pos), written: runs of windows, within the texts of docs(rid, text), that start anywhere else too."""
    seen = again(docs, by, window, gram)
    kinds = written(seen.groupBy("h", "ph").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "pos")).alias("one")).select("h", "ph", "n", "one.rid", "one.pos"))
    crowded = written(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_kinds).select(F.col("h").alias("key")))
    some = crowded.limit(1).count() > 0
    own = written(pieces(docs, kinds, by, window))
    few = written(own.join(crowded, F.col("h") == F.col("key"), "left_anti")) if some else own
    verdict = written(compared(few, by, window, gram, compare, per_task))
    if some:
        many = written(own.join(crowded, F.col("h") == F.col("key"), "left_semi"))
        many = written(many.withColumn("kind", named(many, "h", "ph")))
        texts = many.select(F.col("kind").alias("rid"), F.col("piece").alias("text"))
        texts = written(texts.unionByName(many.where("n > 1").select(F.col("kind").alias("rid"), F.col("piece").alias("text"))))
        deeper = find_repeats(texts, "byte" if by == "byte" else "hash", window, min(window, 2 * gram), compare, most_kinds, per_task)
        verdict = written(verdict.unionByName(many.drop("piece").join(deeper.select(F.col("rid").alias("kind"), F.col("pos").alias("at")).distinct(), "kind").select("h", "ph", "n", "rid", "pos", "at")))
        discard(few, many, texts)
    moved = lambda c: (F.shiftright(c, 8) + F.shiftright("at", 8)) * 256 + F.col("at").bitwiseAND(255)
    copies = seen.join(verdict.where("n > 1").select(F.col("h").alias("_h"), F.col("ph").alias("_p"), "at"), (F.col("h") == F.col("_h")) & (F.col("ph") == F.col("_p")))
    found = written(verdict.where("n = 1").select("rid", moved("pos").alias("pos")).unionByName(copies.select("rid", moved("pos").alias("pos"))))
    discard(seen, kinds, crowded, own, verdict)
    return found
