"""Each stage of the pipeline on its own input, and the whole."""

import hashlib

import corpus_pipeline as pipeline
from groveline.llm import langid
from tests.llm.helpers import WORD, corpus, documents
from tests.llm.test_jaccard import by_pairs
from tests.llm.test_repeats import by_bytes

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, monkeypatch):
    monkeypatch.setattr(langid, "Shape", lambda: SMALL)
    rows = [r for r in corpus(seed=12, n=50) if r[1]]
    rows.append((999, "%% 12 34 ##", "en", "src0"))
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")

    kept = pipeline.language(spark, docs, "")
    assert kept.columns == docs.columns
    kept = [tuple(r)[:4] for r in kept.collect()]
    assert 999 not in [r[0] for r in kept] and len(kept) >= len(rows) - 4

    docs = documents(spark, kept).select("doc_id", "text", "lang", "source", "n_chars")
    one = [tuple(r)[:4] for r in pipeline.near_duplicates(spark, docs, "").collect()]
    groups = by_pairs(kept, 5, 80)
    assert sorted(r[0] for r in one) == sorted({g for _, _, g in groups})

    docs = documents(spark, one).select("doc_id", "text", "lang", "source", "n_chars")
    left = [tuple(r)[:4] for r in pipeline.repeated_passages(spark, docs, "").collect()]
    want = {i: h for i, _, _, _, h in by_bytes(one, 200)}
    assert all(hashlib.sha256(t.encode()).hexdigest() == want[i] for i, t, *_ in left if "�" not in t)

    docs = documents(spark, left).select("doc_id", "text", "lang", "source", "n_chars")
    mixed = pipeline.source_mix(spark, docs, "")
    assert mixed.columns == docs.columns
    mixed = [tuple(r)[:4] for r in mixed.collect()]
    words = {i: len(WORD.findall(t)) for i, t, *_ in left}
    assert all(sum(len(WORD.findall(t)) for j, t, *_ in mixed if j == i) <= 3 * n for i, n in words.items())

    docs = documents(spark, mixed).select("doc_id", "text", "lang", "source", "n_chars")
    out = pipeline.packed(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out) == sorted((i, len(WORD.findall(t))) for i, t, *_ in mixed)


def test_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(langid, "Shape", lambda: SMALL)
    documents(spark, corpus(seed=13, n=40)).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() > 20


SMALL = langid.Shape(hidden=6, rows=200, window=48, batch=48, steps=40)
