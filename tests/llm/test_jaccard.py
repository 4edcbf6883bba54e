"""The n-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from groveline.llm import components as linking
from groveline.llm import jaccard
from groveline.llm.components import components, joined
from tests.llm.helpers import corpus, documents


def shingles(text, words):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in w]
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def by_pairs(rows, words=4, percent=85):
    sets = [shingles(r[1], words) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for r, g in zip(rows, group, strict=True):
        least[g] = min(least.get(g, r[0]), r[0])
    return sorted((r[0], len(s), least[g]) for r, s, g in zip(rows, sets, group, strict=True))


def variants(seed):
    """Chains and stars of texts at and around the threshold, short texts among them."""
    rng = random.Random(seed)
    rows = list(corpus(seed=seed, n=40))
    for size in (3, 7, 8, 12, 30, 90, 300):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
            w = w + [f"t{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, size // 15))]
            rows.append((1000 + len(rows), " ".join(x.upper() if rng.random() < 0.2 else x for x in w), "en", "s"))
            base = w if rng.random() < 0.4 else base
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "percent", "bits"), [(4, 85, 64), (5, 80, 64), (4, 85, 5)])
def test_join(spark, words, percent, bits):
    """With names of 5 bits, most sets have a name in common with others."""
    rows = variants(words)
    got = jaccard.join(documents(spark, rows), jaccard.Scheme(words=words, percent=percent, node_bits=bits))
    want = by_pairs(rows, words, percent)
    assert sorted(map(tuple, got.collect())) == want
    assert len({r[2] for r in want}) < len(want) - 20


@pytest.mark.parametrize(("n2", "k2"), [(2, 1), (3, 1), (3, 2)])
def test_every_near_pair_shares_a_signature(n2, k2):
    rng = np.random.default_rng(n2 + k2)
    scheme = jaccard.Scheme(n2=n2, k2=k2)
    for _ in range(300):
        size = int(rng.integers(1, 120))
        a = rng.integers(0, 1 << 63, size, np.uint64)
        b = np.concatenate([a[int(rng.integers(0, size // 8 + 1)) :], rng.integers(0, 1 << 63, int(rng.integers(0, size // 10 + 1)), np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        row, sig, room = jaccard.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), scheme)
        if 100 * common >= 85 * (len(a) + len(b) - common) and (len(a) != common or len(b) != common):
            both = set(sig[row == 0]) & set(sig[row == 1])
            assert both
            for r, band in {(r, b) for r, b in zip(row[room >= 0], room[room >= 0] >> 16, strict=True)}:
                # leaving as many signatures as there is room for, the shared ones first, another shared one is left
                own = (row == r) & (room >= 0) & (room >> 16 == band)
                if (other := set(sig[(row != r) & (room >= 0) & (room >> 16 == band)])) and 100 * common >= 85 * (len(a) + len(b) - common):
                    assert len(set(sig[own]) & other) > int(room[own][0] & 0xFFFF)


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(100):
        size = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, len(a) + 1)) :], rng.integers(0, 1 << 63, int(rng.integers(1, 200)), np.uint64)]))
        maps = jaccard.bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        s = jaccard.Sketches(np.array([4, 9]), np.array([len(a), len(b)]), maps)
        one, two = s.of(np.array([4])), s.of(np.array([9]))
        _, _, apart = s.near(one, two, 0)
        assert (apart <= len(np.setxor1d(a, b))).all()
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            assert len(s.near(one, two, 80)[0]) == 1


def test_join_by_blocks(spark, monkeypatch):
    """Chains and rings inside one bucket, which the check against the centre leaves apart, with buckets of many blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "TASK", 8)
    monkeypatch.setattr(jaccard, "CROWD", 5)
    rng = random.Random(77)
    base = [f"b{i}" for i in range(140)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(140), rng.randint(1, 4)):
            w[k] = f"y{rng.randint(0, 40)}"
        rows.append((i, " ".join(w), "en", "s"))
    got = jaccard.join(documents(spark, rows))
    want = by_pairs(rows)
    assert sorted(map(tuple, got.collect())) == want and len({r[2] for r in want}) > 1


def test_components(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(25)] + [(200, i) for i in range(201, 260)]
    group = {x: x for p in pairs for x in p}
    for a, b in pairs:
        low, high = sorted((group[a], group[b]))
        group = {k: low if v == high else v for k, v in group.items()}
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == group


def test_joined(spark):
    """Links that come later join components, lengthen them and make new ones, and say what is known already."""
    rng = random.Random(9)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(100, 101), (101, 102)]
    later = [(102, 90), (rng.randint(0, 60), 70), (70, 71), (200, 201), (100, 102), (5, 6), (6, 7), (30, 90)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got = joined(components(table(pairs)), table(later)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, components(table(pairs + later)).collect()))


def test_links_are_followed_once(spark, monkeypatch):
    """The rounds in large groups follow the links that each has found, not all links again."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "TASK", 8)
    checked, followed = [], []
    check, follow = jaccard._checked, linking.components
    monkeypatch.setattr(jaccard, "_checked", lambda *a: (out := check(*a), checked.append(out.count()))[0])
    for module in (jaccard, linking):
        monkeypatch.setattr(module, "components", lambda links: (followed.append(links.count()), follow(links))[1])
    rng = random.Random(77)
    base = [f"b{i}" for i in range(140)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(140), rng.randint(1, 4)):
            w[k] = f"y{rng.randint(0, 40)}"
        rows.append((i, " ".join(w), "en", "s"))
    assert sorted(map(tuple, jaccard.join(documents(spark, rows)).collect())) == by_pairs(rows)
    assert sum(x > 0 for x in checked) > 1 and sum(followed) <= sum(checked)


def test_one_of_each_and_edges(spark):
    rows = [(3, "a b c d e f g h", "en", "s"), (1, "A b c d e f g h", "de", "s"), (1, "A b c d e f g h", "de", "s"), (7, None, None, None), (8, "", None, None), (None, "z y x", None, None), (None, "q", None, None), (9, "z y x", None, None)]
    docs = documents(spark, rows)
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["lang"], r["text"]) for r in out.collect()) == sorted([("1", "de", "A b c d e f g h"), ("7", None, None), ("8", None, ""), ("None", None, "q"), ("9", None, "z y x")], key=str)
    assert jaccard.join(docs.where("false")).collect() == []
    got = sorted(((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()), key=str)
    assert got == [("1", 5, 1), ("1", 5, 1), ("3", 5, 1), ("7", 0, 7), ("8", 0, 8), ("9", 1, 9), ("None", 1, 9), ("None", 1, None)]


def test_one_of_each_with_clashing_names(spark):
    """Columns named like those that the operator uses; of rows with equal id and text the least stays."""
    rows = [(i, t, "en", s) for i, t, s in ((1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (1, "a b c d e f", "w"), (3, "q r s", "z"), (4, None, "z"))]
    docs = documents(spark, rows).withColumnsRenamed({"size": "rid", "key": "_stay", "shard": "row", "words": "may_go"})
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns and sorted((r["doc_id"], r["source"], r["rid"], r["_stay"]) for r in out.collect()) == [(1, "w", 7, "k"), (3, "z", 7, "k"), (4, "z", 7, "k")]
