"""The two substring operators, and what they share, against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from groveline.llm import hashing, substrings, suffixes
from groveline.llm.queries import ORACLES
from tests.llm.helpers import corpus, documents


@pytest.fixture(scope="module")
def rows():
    return corpus(seed=9, n=80)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return documents(spark, rows)


def covered(sequences, window):
    seen = Counter(tuple(s[i : i + window]) for s in sequences for i in range(len(s) - window + 1))
    return [{i + k for i in range(len(s) - window + 1) if seen[tuple(s[i : i + window])] > 1 for k in range(window)} for s in sequences]


def by_words(rows, window):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    for (i, *_), w, gone in zip(rows, words, covered(words, window), strict=True):
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        yield i, len(w), len(gone), hashlib.sha256(kept).hexdigest()


def by_bytes(rows, window):
    texts = [(t or "").encode() for _, t, *_ in rows]
    for (i, *_), b, gone in zip(rows, texts, covered(texts, window), strict=True):
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        yield i, len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("limits", [{}, {"most_kinds": 1, "bits": 4}, {"most_kinds": 2}, {"per_task": 5}])
def test_words(rows, docs, limits):
    assert sorted(map(tuple, substrings.dedup(docs, **limits).collect())) == sorted(by_words(rows, 35))


@pytest.mark.parametrize("limits", [{}, {"most_kinds": 1, "bits": 4}, {"most_kinds": 2}, {"per_task": 5}])
def test_bytes(rows, docs, limits):
    assert sorted(map(tuple, suffixes.dedup(docs, **limits).collect())) == sorted(by_bytes(rows, 200))


def test_periodic_and_overlapping(spark):
    rng = random.Random(4)
    unit = "".join(rng.choice("abc ") for _ in range(37))
    rows = [(0, "a" * 600, None, None), (1, unit * 20, None, None), (2, "é" * 150 + unit * 9 + "é" * 40, None, None), (3, "x y " * 80, None, None), (4, "a" * 199, None, None), (5, "a" * 200, None, None)]
    docs = documents(spark, rows)
    assert sorted(map(tuple, suffixes.dedup(docs).collect())) == sorted(by_bytes(rows, 200))
    assert sorted(map(tuple, substrings.dedup(docs).collect())) == sorted(by_words(rows, 35))


def test_copies_of_rows_and_ids(spark):
    text = " ".join(str(i) for i in range(100))
    rows = [(1, text, None, None), (1, text, None, None), (None, text + " tail", None, None), (None, "short", None, None)]
    docs = documents(spark, rows)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, suffixes.dedup(docs).collect()), key=key) == sorted(by_bytes(rows, 200), key=key)
    assert sorted(map(tuple, substrings.dedup(docs).collect()), key=key) == sorted(by_words(rows, 35), key=key)


def test_empty_and_kept_texts(rows, docs):
    assert substrings.dedup(docs.where("false")).collect() == [] and suffixes.dedup(docs.where("false")).collect() == []
    out = suffixes.deduped(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    want = {i: h for i, _, _, _, h in by_bytes(rows, 200)}
    texts = {i: t for i, t, *_ in rows}
    for i, t in got.items():
        assert (t is None) == (texts[i] is None)
        if t and "�" not in t:
            assert hashlib.sha256(t.encode()).hexdigest() == want[i]


def test_sql_says_the_same(rows):
    db = duckdb.connect()
    db.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    assert sorted(db.execute(ORACLES["op7_doubled_windows"]).fetchall()) == sorted(by_words(rows, 35))
    assert sorted(db.execute(ORACLES["op8_columnwise_suffixes"]).fetchall()) == sorted(by_bytes(rows, 200))


def test_clashing_names(spark, rows, docs):
    """Columns named like those that the operator uses go through."""
    named = docs.withColumnsRenamed({"size": "rid", "key": "kept", "shard": "row", "words": "_rid"})
    out = suffixes.deduped(named)
    assert out.columns == named.columns and out.count() == len(rows)
    assert {r["rid"] for r in out.collect()} == {7}


def test_words_of_batches():
    texts = [None, "", " a\tB\x0bcé ", "Ab", "b\n", "x" * 3000]
    t = hashing.Texts(pa.array(["skip", *texts])[1:])
    data, offsets = t.bytes(0, len(t))
    h, start, stop, at = hashing.words(data, offsets, lower=True)
    got = [[bytes(data[a:z]) for a, z in zip(start[at[i] : at[i + 1]], stop[at[i] : at[i + 1]], strict=True)] for i in range(len(texts))]
    assert got == [(x or "").encode().split() for x in texts]
    assert len(set(h.tolist())) == len({w.lower() for ws in got for w in ws})


def test_minimizers_depend_on_the_window_only():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 3, 400).astype(np.uint64)
    offsets = np.array([0, 100, 100, 130, 400])
    grams = hashing.Prefix(values).window(5)
    row, first, last, least = hashing.minimizers(grams, offsets, 5, 20)
    place = {}
    for r, a, z, q in zip(row, first, last, least, strict=True):
        assert offsets[r] <= a <= z <= offsets[r + 1] - 20
        for p in range(a, z + 1):
            assert p <= q <= p + 15 and place.setdefault(tuple(values[p : p + 20]), q - p) == q - p
    assert sum(last - first + 1) == 81 + 0 + 11 + 251
