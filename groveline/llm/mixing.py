"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources get whole numbers of blocks by highest quotients; a source's blocks go to its shards by highest quotients too; inside a
shard a seeded permutation picks which blocks of the source's stream of words are taken. A quota beyond the stream takes it whole
as often as it fits and picks blocks for the rest. A stream's last block may be short, and of the last block picked only as many
words are taken as are due, so that every quota fits its streams. A source whose target is all that may be repeated is taken whole
that often; where a source's streams have hardly room for their blocks, its words are dealt in proportion.

Defined results: a null or wordless text has size 0 and nothing is taken; a null source is a source of its own and comes last;
a source without words has target 0; repeated rows are documents of their own; an empty table gives an empty result; columns
other than the three that are named are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groveline.llm.common import SPACE, n_words, spread, written

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: A source is spread over so many shards that each of its streams has this many blocks.
STREAM_BLOCKS = 64
#: Sources whose rows are broadcast, some 10 MB; of more, they are joined by shuffles.
MOST_SENT = 100_000


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int]) -> list[int]:
    """Seats by highest quotients w / (2n + 1), none beyond its cap; ties to the earlier."""
    at = lambda d: [min(c, int(w / d + 0.5)) for w, c in zip(weights, caps, strict=True)]
    low, high = 0.0, 2.0 * max([1.0, *weights]) + 1
    if sum(caps) <= seats:
        return list(caps)
    for _ in range(200):  # a divisor below which more seats would go out than there are
        mid = (low + high) / 2
        low, high = (mid, high) if mid and sum(at(mid)) > seats else (low, mid)
    got = at(high)
    heap = [(-w / (2 * n + 1), i) for i, (w, n, c) in enumerate(zip(weights, got, caps, strict=True)) if n < c and w > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def targets(sizes: Sequence[int], weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> list[float]:
    """Shares of all sizes by weight; what is beyond ``max_repeat`` times a source's size is reshared until none is above."""
    share = [weights[i % len(weights)] for i in range(len(sizes))]
    caps = [max_repeat * s for s in sizes]
    fixed: set[int] = set()
    while True:
        left = sum(sizes) - sum(caps[i] for i in fixed)
        total = sum(w for i, w in enumerate(share) if i not in fixed)
        now = [float(caps[i]) if i in fixed else left * w / total for i, w in enumerate(share)]
        above = {i for i in range(len(sizes)) if i not in fixed and now[i] > caps[i]}
        if not above:
            return now
        fixed |= above


def plan(rows: DataFrame, name: list[str], weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 17, shard_tokens: int = 8_000_000) -> tuple[DataFrame, DataFrame, int]:
    """(documents placed in their shard's stream of words, what each stream gives, block length in words).

    rows: columns that name a document, its source and size; equal rows become one with their number in ``copies``, which
    stand one after another in the stream. A stream is one source in one shard. Shards grow in number with the corpus, so that a
    stream stays near ``shard_tokens`` words at most and a hot source is spread over all of them; a small source has fewer, down to
    one. The driver holds one row for each source, some 100 bytes.
    """
    spark = rows.sparkSession
    slim = written(rows.groupBy(*name, "source", "size").agg(F.count(F.lit(1)).alias("copies")))
    words = F.col("size") * F.col("copies")
    found = {r["source"]: int(r["size"]) for r in slim.groupBy("source").agg(F.sum(words).alias("size")).collect()}
    names = sorted((s for s in found if s is not None)) + [None] * (None in found)
    sizes = [found[s] for s in names]
    total, wanted = sum(sizes), targets(sizes, weights, max_repeat) if sizes else []
    block = max(16, min(1024, total >> 16))
    quota = sainte_lague(wanted, round(sum(wanted) / block), [-(-max_repeat * s // block) for s in sizes])
    due = [max_repeat * s if w >= max_repeat * s else min(q * block, max_repeat * s) for s, w, q in zip(sizes, wanted, quota, strict=True)]
    most = max(1, -(-total // shard_tokens))
    shards = [max(1, min(most, s // (STREAM_BLOCKS * block))) for s in sizes]
    schema = T.StructType([T.StructField("_source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("quota", T.LongType()), T.StructField("due", T.LongType()), T.StructField("shards", T.IntegerType())])
    by_source = spark.createDataFrame([*zip(names, sizes, wanted, quota, due, shards, strict=True)], schema)
    sent = F.broadcast if len(names) <= MOST_SENT else (lambda df: df)

    placed = slim.join(sent(by_source.select("_source", "shards")), F.col("source").eqNullSafe(F.col("_source")), "left")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), *name), F.col("shards")).cast("int")).drop("_source", "shards")
    streams = placed.groupBy("source", "shard").agg(F.sum(words).alias("words"))
    streams = streams.join(sent(by_source), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "shards")
    # a source's blocks to its shards: the rounded share, then the highest quotients more or the lowest less
    ideal = F.col("quota") * F.col("words") / F.col("source_size")
    cap = F.floor(F.lit(max_repeat) * F.col("words") / block)
    own = Window.partitionBy("source")
    streams = streams.withColumn("first", F.when(F.col("words") > 0, F.least(F.floor(ideal + 0.5), cap)).otherwise(0).cast("long"))
    room = F.sum(cap).over(own) - 2 * F.count(F.lit(1)).over(own)
    streams = streams.withColumn("tight", F.col("due") > room * block)
    streams = streams.withColumn("short", F.col("quota") - F.sum("first").over(own)).withColumn("ideal", ideal)
    step = F.explode(F.sequence(F.lit(1), F.ceil(F.abs("short") * F.col("words") / F.greatest(F.col("source_size"), F.lit(1))).cast("int") + 2)).alias("k")
    more = streams.where("short != 0 AND words > 0 AND NOT tight").select("source", "shard", "words", "first", "short", cap.alias("cap"), step)
    more = more.where("(short > 0 AND first + k <= cap) OR (short < 0 AND first - k >= 0)")
    quotient = F.when(F.col("short") > 0, -F.col("words") / (2 * (F.col("first") + F.col("k")) - 1)).otherwise(F.col("words") / (2 * (F.col("first") - F.col("k")) + 1))
    ranked = more.withColumn("_r", F.row_number().over(Window.partitionBy("source").orderBy(quotient, "shard", "k"))).where("_r <= abs(short)")
    change = ranked.groupBy(F.col("source").alias("_s"), F.col("shard").alias("_h")).agg(F.sum(F.signum("short")).cast("long").alias("change"))
    streams = streams.join(change, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")), "left")
    dealt = (F.col("first") + F.coalesce(F.col("change"), F.lit(0))) * block
    give = F.when(F.col("tight") & (F.col("words") > 0), F.least(F.floor(F.col("words") * (F.col("due") / F.col("source_size"))), max_repeat * F.col("words"))).otherwise(dealt)
    streams = streams.select("source", "shard", "source_size", "target", "words", give.alias("give"))
    streams = streams.withColumn("whole", F.when(F.col("words") > 0, F.floor(F.col("give") / F.col("words"))).otherwise(0).cast("long"))
    streams = streams.withColumn("rest", (F.col("give") - F.col("whole") * F.col("words")).cast("long"))
    streams = streams.withColumn("blocks", F.ceil(F.col("words") / block).cast("long"))
    # i -> (step * i + shift) mod blocks is a permutation if step and blocks have no common factor: a prime above them that doesn't divide them
    streams = streams.withColumn("shift", F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.greatest(F.col("blocks"), F.lit(1))))
    start = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), *name), *name, "size")
    placed = placed.withColumn("end", F.sum(words).over(start.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.select(*name, "source", "size", "copies", "shard", (F.col("end") - words).alias("start"))
    return placed, streams, block


#: Primes for the step of the permutation; a stream of blocks that is a multiple of one takes the next.
STEPS = (611_953, 746_773, 871_061, 960_019)


def place(block_no):
    """The place of a block in the seeded permutation of its stream's blocks."""
    n = F.col("blocks")
    step = F.coalesce(*[F.when(n % p != 0, F.lit(p)) for p in STEPS], F.lit(1))
    return F.pmod(step * block_no + F.col("shift"), F.greatest(n, F.lit(1)))


def picked(block_no, block: int):
    """How many of a block's words are taken, from its first on: blocks go by their places until the rest of the stream's words is met."""
    last = F.col("blocks") - 1
    missing = F.col("blocks") * block - F.col("words")  # in the last block
    before = place(block_no) * block - F.when(place(last) < place(block_no), missing).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(block) - F.when(block_no == last, missing).otherwise(0), F.col("rest") - before))


def joined(placed: DataFrame, streams: DataFrame) -> DataFrame:
    """A row for each document, copies too, with what its stream gives."""
    each = spread(placed, "copies", "nth").withColumn("start", F.col("start") + F.col("nth") * F.col("size"))
    right = streams.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "source_size", "target", "words", "whole", "rest", "blocks", "shift")
    return each.join(right, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")), "left").drop("_s", "_h")


def runs(block: int):
    """Array of (from, to): the document's words, counted from 0, that the picked blocks cover."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    inside = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    end = F.col("start") + F.col("size")
    spans = F.transform(inside, lambda b: F.struct((F.greatest(b * block, F.col("start")) - F.col("start")).alias("from"), (F.least(b * block + picked(b, block), end) - F.col("start")).alias("to")))
    return F.filter(spans, lambda r: r["from"] < r["to"])


def mix(docs: DataFrame, **params) -> DataFrame:
    """doc_id, size, source_size, target, taken for each document; see the module for the method."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), "source", n_words(F.col("text")).alias("size"))
    placed, streams, block = plan(rows, ["doc_id", "mark"], **params)
    part = F.aggregate(runs(block), F.lit(0).cast("long"), lambda a, r: a + r["to"] - r["from"])
    return joined(placed, streams).select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, **params) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each whole pass over a document's text, and one of the words that
    the picked blocks cover, joined by one space (the text itself if they cover it all). Rows with nothing taken are left out.

    Documents are known by 128 bits of hash of all their columns, so that the mix follows from what they hold, however they are
    partitioned; the columns must be of kinds that can be hashed (no maps).
    """
    every = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*every).alias("row"), F.xxhash64(*every).alias("h1"), F.xxhash64(F.lit(1), *every).alias("h2"), "source", n_words(F.col("text")).alias("size"))
    placed, streams, block = plan(keyed.select("h1", "h2", "source", "size"), ["h1", "h2"], **params)
    cut = joined(placed, streams).select("h1", "h2", "size", "whole", runs(block).alias("runs"))
    cut = cut.withColumn("part", F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["to"] - r["from"])).where("size > 0 AND (whole > 0 OR part > 0)")
    one = keyed.select("h1", "h2", "row").groupBy("h1", "h2").agg(F.first("row").alias("row"))  # equal documents: the plan says how often each is taken
    rows = one.withColumn("text", F.col("row").getField("text")).join(cut.select(F.col("h1").alias("_1"), F.col("h2").alias("_2"), "size", "whole", "part", "runs"), (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")))
    some = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(F.filter(F.split(F.col("text"), SPACE), lambda w: w != ""), (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")))), " ")
    passes = F.when(F.col("whole") > 0, F.array_repeat("text", F.col("whole").cast("int"))).otherwise(F.array().cast("array<string>"))
    last = F.when(F.col("part") == 0, F.array().cast("array<string>")).otherwise(F.array(F.when(F.col("part") == F.col("size"), F.col("text")).otherwise(some)))
    out = rows.select("row", F.explode(F.concat(passes, last)).alias("text"))
    return out.select(*[(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
