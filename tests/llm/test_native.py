"""Sharding, quality rules, packing and mixing against brute force."""

import binascii
import random
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from groveline.llm import common, mixing, packing, quality, sharding
from tests.llm.helpers import WORD, corpus, documents


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows)


def test_shards(spark, rows, docs):
    got = {r["doc_id"]: r for r in sharding.shard(docs, 5).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        b = (text or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (len(b) + 1, binascii.crc32(b), "bytes", None)
    slots = defaultdict(list)
    for r in got.values():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    where = {}
    for i, text, *_ in rows:
        assert where.setdefault(text or "", got[i]["shard"]) == got[i]["shard"]
    # the capacity is the least at which any cut of the ordered groups works
    keys = {r["doc_id"]: r["k"] for r in docs.selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS k").collect()}
    groups = Counter()
    for i, text, *_ in rows:
        groups[keys[i]] += len((text or "").encode()) + 1
    sizes, load = [groups[k] for k in sorted(groups)], Counter()
    for r in got.values():
        load[r["shard"]] += r["size"]
    best = [float("inf")] * (len(sizes) + 1)
    best[0] = 0
    for _ in range(5):
        best = [min([best[j]] + [max(best[i], sum(sizes[i:j])) for i in range(j)]) for j in range(len(sizes) + 1)]
    assert max(load.values()) == best[-1]


def test_shards_refine(spark, monkeypatch):
    """With few first ranges the cuts must be found by splitting them, also beside one huge group."""
    monkeypatch.setattr(sharding, "FIRST_BITS", 2)
    monkeypatch.setattr(sharding, "MORE_BITS", 2)
    rng = random.Random(5)
    rows = [(i, "x" * rng.randint(0, 90) if i % 3 else "the same text " * 5, "en", "s") for i in range(300)]
    docs = documents(spark, rows)
    slim = docs.selectExpr("doc_id", "cast(octet_length(text) + 1 as long) AS size", "xxhash64(text) AS key")
    _, capacity, n = sharding.bounds(slim, 7)
    groups = Counter()
    for r in slim.collect():
        groups[r["key"]] += r["size"]
    sizes = [groups[k] for k in sorted(groups)]

    def fits(c):
        shards, now = 1, 0
        for s in sizes:
            if s > c:
                return False
            shards, now = (shards + 1, s) if now + s > c else (shards, now + s)
        return shards <= 7

    assert n == 300 and fits(capacity) and not fits(capacity - 1)


def test_quality_counts(rows, docs):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, text, *_ in rows:
        t, w = text or "", WORD.findall(text or "")
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeated = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        failed = len(w) < 20 or 100 * len(repeated) > 30 * len(w)
        r = got[i]
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")] == [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), failed]
        assert not (r["kept"] and failed)


def test_quality_fit_finds_bad_rules_votes():
    """Drawn from two known classes, the fit gives each pattern the side that made it more often."""
    rng = random.Random(1)
    patterns = Counter()
    for _ in range(5000):
        good = rng.random() < 0.85
        patterns[tuple(rng.choices((-1, 0, 1), (1, 20, 79) if good else (60, 20, 20))[0] for _ in range(4))] += 1
    prior, weights = quality.fit(sorted(patterns.items()), 4)
    assert 1.2 < prior < 2.3
    assert all(w[-1] < -2 and w[1] > 0.5 for w in weights)


def test_quality_fit_is_the_maximisation_document_by_document():
    rng = np.random.default_rng(3)
    good = rng.random(800) < 0.7
    votes = np.where(good[:, None], rng.choice([-1, 0, 1], (800, 3), p=[0.1, 0.3, 0.6]), rng.choice([-1, 0, 1], (800, 3), p=[0.7, 0.2, 0.1]))
    patterns = Counter(map(tuple, votes.tolist()))
    prior, weights = quality.fit(sorted(patterns.items()), 3)
    own = {True: np.array([1.0, 1, 2]), False: np.array([2.0, 1, 1])}
    p = {c: np.stack([x / x.sum()] * 3) for c, x in own.items()}
    share = 0.5
    for _ in range(2000):
        like = {c: np.prod([p[c][j][votes[:, j] + 1] for j in range(3)], 0) for c in p}
        post = share * like[True] / (share * like[True] + (1 - share) * like[False])
        share = (1 + post.sum()) / (2 + len(post))
        for c, w in ((True, post), (False, 1 - post)):
            m = np.stack([own[c] + [w[votes[:, j] == v].sum() for v in (-1, 0, 1)] for j in range(3)])
            p[c] = m / m.sum(1, keepdims=True)
    assert prior == pytest.approx(np.log(share / (1 - share)), abs=1e-5)
    for j in range(3):
        assert [weights[j][v] for v in (-1, 0, 1)] == pytest.approx(np.log(p[True][j] / p[False][j]), abs=1e-5)


def test_quality_verdict_agrees_with_labels_beyond_the_base(spark):
    """Among labelled documents that pass the base thresholds, most bad ones are dropped and hardly any good one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = quality.judge(docs).join(labels, "doc_id").where("NOT base_failed").select("kept", "quality").collect()
    bad, good = [r["kept"] for r in seen if not r["quality"]], [r["kept"] for r in seen if r["quality"]]
    assert len(bad) > 20 and sum(bad) < 0.1 * len(bad) and sum(good) > 0.98 * len(good)


def test_packing(rows, docs):
    got = packing.pack(docs, buckets=4, budget=200).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    batches = defaultdict(list)
    for r in got:
        assert 0 <= r["padding"] == r["bucket_len"] - r["n_tokens"]
        batches[r["bucket"], r["batch"]].append(r)
    for b in batches.values():
        assert sorted(r["place"] for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0]["bucket_len"] <= 200


@pytest.mark.parametrize("buckets", [1, 2, 3, 5])
def test_boundaries_are_optimal(buckets):
    rng = random.Random(buckets)
    lengths = sorted(rng.sample(range(60), 9))
    count = [rng.randint(1, 9) for _ in lengths]
    cost = lambda ends: sum(n * min(e for e in ends if e >= x) for x, n in zip(lengths, count, strict=True))
    best = min(cost({*c, lengths[-1]}) for c in product(lengths, repeat=buckets - 1)) if buckets > 1 else cost({lengths[-1]})
    ends = packing.boundaries(np.array(lengths), np.array(count), buckets)
    assert len(ends) <= buckets and cost(ends) == best


def test_boundaries_of_many_long_lengths():
    """Lengths far above a thousand words, against every choice tried one by one."""
    rng = np.random.default_rng(5)
    length = np.unique(rng.integers(1, 60_000, 400))
    count = rng.integers(1, 50, len(length))
    before = np.concatenate([[0], np.cumsum(count)])
    best = [0.0] + [float("inf")] * len(length)
    for _ in range(6):
        best = [min([best[j]] + [best[i] + length[j - 1] * (before[j] - before[i]) for i in range(j)]) for j in range(len(length) + 1)]
    ends = np.array(packing.boundaries(length, count, 6))
    assert len(ends) <= 6 and (count * ends[np.searchsorted(ends, length)]).sum() == best[-1]


def test_numbers_of_rows_that_are_equal(spark, monkeypatch):
    """Most rows are copies of one; its copies are made by many tasks, and numbers don't depend on partitions."""
    monkeypatch.setattr(common, "CHUNK", 7)
    rows = [(1, "a")] * 500 + [(i, "a" if i % 3 else "b") for i in range(40)] + [(None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, g string")
    got = [tuple(r) for r in common.numbered(df, "g", len(rows), per_bucket=50).collect()]
    assert sorted(got, key=str) == sorted((tuple(r) for r in common.numbered(df.repartition(5), "g", len(rows), per_bucket=50).collect()), key=str)
    assert Counter(r[:2] for r in got) == Counter(rows)
    for g in ("a", "b", None):
        own = [r[2] for r in got if r[1] == g]
        assert sorted(own) == list(range(len(own)))


def test_sainte_lague_by_hand():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(1, 6)
        w, caps, seats = [rng.random() * 9 for _ in range(n)], [rng.randint(0, 9) for _ in range(n)], rng.randint(0, 30)
        want = [0] * n
        for _ in range(min(seats, sum(caps))):
            i = max((i for i in range(n) if want[i] < caps[i]), key=lambda i: w[i] / (2 * want[i] + 1))
            want[i] += 1
        assert mixing.sainte_lague(w, seats, caps) == want


def test_mix(rows, docs):
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    again = {r["doc_id"]: r for r in mixing.mix(docs.repartition(7)).collect()}
    assert got == again and len(got) == len(rows)
    size = Counter()
    for i, text, _, source in rows:
        size[source] += len(WORD.findall(text or ""))
    names = sorted(s for s in size if s is not None) + [None]
    target = dict(zip(names, mixing.targets([size[s] for s in names]), strict=True))
    taken = Counter()
    for i, text, _, source in rows:
        r = got[i]
        assert r["size"] == len(WORD.findall(text or "")) and r["source_size"] == size[source] and r["target"] == target[source]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 48 for s in names)


def test_small_sources_get_their_targets_over_many_shards(spark):
    """With more shards than a small source has documents, and streams shorter than a block."""
    sizes = {"a": 9, "b": 61, "c": 300, "d": 4_000, "e": 40_000, None: 20_000}
    rows = [(k * 100_000 + i, "w " * min(20, n - i), "en", s) for k, (s, n) in enumerate(sizes.items()) for i in range(0, n, 20)]
    docs = documents(spark, rows)
    out = mixing.mix(docs, shard_tokens=100).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()
    assert {r["source"]: r["max(source_size)"] for r in out} == sizes
    assert {r["source"] for r in out if r["max(target)"] == 3 * r["max(source_size)"]} >= {"a", "b", "c"}
    for r in out:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= (0 if r["max(target)"] == 3 * r["max(source_size)"] else 16)
    total = mixing.mixed(docs, shard_tokens=100).groupBy("source").agg({"text": "count"}).count()
    assert total == len(sizes)


def test_targets_stop_at_three_times_the_size():
    assert mixing.targets([10, 1000, 1000]) == [30.0, (2010 - 30) * 2 / 3, (2010 - 30) / 3]
    assert mixing.targets([0, 5]) == [0.0, 5.0] and mixing.targets([]) == []


def test_mixed_texts_follow_the_plan(rows, docs):
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    texts = {r[0]: WORD.findall(r[1] or "") for r in rows}
    total = Counter()
    for r in out.collect():
        w = WORD.findall(r["text"])
        assert w and len(w) <= len(texts[r["doc_id"]])
        total[r["doc_id"]] += len(w)
    assert sum(total.values()) == pytest.approx(sum(plan.values()), rel=0.05)


def test_mixed_follows_from_content_alone(spark, rows):
    """Copies of rows among the documents, columns named like the operator's, and other partitions each time."""
    docs = documents(spark, [*rows, *rows[:9], *rows[:9], *([rows[4]] * 30)]).withColumnsRenamed({"size": "row", "key": "h1", "shard": "copies", "words": "runs"})
    got = [sorted(map(str, mixing.mixed(d).collect())) for d in (docs, docs.repartition(7), docs.orderBy("text"))]
    assert got[0] == got[1] == got[2] and mixing.mixed(docs).columns == docs.columns
    plan = mixing.mix(docs).groupBy("doc_id").agg({"taken": "sum"}).collect()
    taken = Counter()
    for r in mixing.mixed(docs).collect():
        taken[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert sum(r["sum(taken)"] for r in plan) == pytest.approx(sum(taken.values()), rel=0.05)


def test_empty_tables(docs):
    none = docs.where("false")
    for f in (sharding.shard, quality.judge, packing.pack, mixing.mix, mixing.mixed):
        assert f(none).collect() == []


def test_null_and_repeated_rows(spark):
    docs = documents(spark, [(None, None, None, None), (None, "a b", None, None), (5, "a b", "en", "x"), (5, "a b", "en", "x")])
    for f in (sharding.shard, quality.judge, packing.pack, mixing.mix):
        assert f(docs).count() == 4
