"""Language ID, page differencing and top-k search against brute force."""

import random
import zlib

import numpy as np
import pytest

from groveline.llm import bitsliced, langid, pagediff
from groveline.llm.queries import read
from tests.llm.helpers import documents

DATA = "/root/testdata/sf0.01"
SMALL = langid.Shape(hidden=8, rows=600, window=64, batch=96, steps=90)


def test_gradient_by_differences():
    shape = langid.Shape(hidden=3)
    w = {k: v.astype(np.float64) for k, v in langid.start(shape, 3).items()}
    rng = np.random.default_rng(0)
    data, label, weight = rng.integers(0, 5, (6, 4)).astype(np.uint8), rng.integers(0, 3, 4), rng.random(4) + 0.5
    _, grad = langid.loss_and_gradient(w, data, label, weight)
    for name, x in w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) if name[1:2] != "x" or k else int(data[0, 0]) for k, n in enumerate(x.shape))
            keep, ends = x[at], []
            for move in (1e-5, -1e-5):
                x[at] = keep + move
                ends.append(langid.loss_and_gradient(w, data, label, weight)[0])
            x[at] = keep
            assert grad[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-6)


def test_stretches_are_read_one_by_one():
    shape = langid.Shape(hidden=4, stretch=7)
    w = langid.start(shape, 3)
    texts = ["1234é6789ab".encode(), b"abc", b"", b"hello world, a longer text", b"1234567", b"12345678"]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = langid.probabilities(w, data, at, shape, width=3)
    for i, t in enumerate(texts):
        total = np.zeros(3)
        ends = [k - (k < len(t) and t[k] & 0xC0 == 0x80) for k in range(0, len(t), 7)] + [len(t)]
        for k, end in zip(ends[:-1], ends[1:], strict=True):
            part = np.frombuffer(t[k:end], np.uint8)
            total += langid.position_sums(w, part[:, None], np.array([len(part)]))[0]
        assert np.allclose(got[i], total / max(1, len(t)), atol=1e-5)


def test_languages(spark):
    docs = read(spark, DATA, "documents")
    got = {r["doc_id"]: r for r in langid.identify(docs, SMALL).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert set(got) == set(lang) and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == lang[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_edges(spark):
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "123 %% --", "de", "s"), (None, "the and of", None, "s"), (5, "und der die", None, "s")]
    docs = documents(spark, rows)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs.where("doc_id IS NULL OR doc_id = 5"), SMALL).collect()}
    assert got == {None: "und", 5: "und"}
    rows += [(10 + i, "the and of it is that" if i % 2 else "le les des une est que", "en" if i % 2 else "fr", "s") for i in range(60)]
    docs = documents(spark, rows)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.Shape(hidden=6, steps=60, batch=32)).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "und" and got[11][0] == "en" and got[10][0] == "fr"
    assert langid.identify(docs.where("false"), SMALL).collect() == []
    kept = langid.known(docs, shape=langid.Shape(hidden=6, steps=60, batch=32))
    assert kept.columns == docs.columns and {1, 2, 3}.isdisjoint(r["doc_id"] for r in kept.collect())
    named = docs.withColumnsRenamed({"size": "_row", "key": "score", "shard": "held_out", "words": "_text"})
    kept = langid.known(named, shape=langid.Shape(hidden=6, steps=60, batch=32))
    assert kept.columns == named.columns and {r["_row"] for r in kept.collect()} == {7}


def test_sample_of_rows_with_few_ids_and_of_rare_languages(spark):
    """Whole texts, each different row once, languages alike, whatever the ids and partitions."""
    shape = langid.Shape(rows=20, sample_bytes=4000)
    learned = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(learned[i % 3], f"text number {i} " * (1 + i % 5), "en", "s") for i in range(300)] + [(learned[4], "the same", "de", "s")] * 900 + [(learned[5], f"selten {i}", "de", "s") for i in range(4)]
    rows += [(learned[6], "x" * 9000, "fr", "s"), (learned[7], "y" * 9000, "fr", "s"), (learned[8], "", "it", "s"), (learned[9], None, "it", "s")]
    docs = documents(spark, rows)
    got = langid.sample(docs, shape)
    assert sorted(got) == sorted(langid.sample(docs.repartition(9), shape))
    assert {(lang, text.decode()) for lang, text in got} <= {(r[2], r[1]) for r in rows}
    per = {lang: [t for x, t in got if x == lang] for lang in ("en", "de", "fr", "it")}
    assert len(per["en"]) == 7 and sorted(per["de"]) == sorted([b"the same", *(b"selten %d" % i for i in range(4))]) and len(per["fr"]) == 1 and not per["it"]


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in range(2))
        shared = [x for x, s in zip(a, pagediff.common_lines(a, b), strict=True) if s]
        rest = iter(b)
        assert all(x in rest for x in shared) and len(shared) == longest(a, b)


@pytest.mark.parametrize(
    ("source", "lines"),
    [
        ("", []),
        ("just text &amp; more", ["just text & more"]),
        ("<p>a<b>b</b>c<br>d<p>e &#233;&eacute;&lt;x&gt;", ["abc", "d", "e éé<x>"]),
        ("<head><title>t</title></head><script>var a='<p>no</p>'</script><style>p{}</style><div>x\n\t y</div>z<!-- <p>c</p> -->", ["x y", "z"]),
        ("a < b <i>and</i> c <1", ["a < b and c <1"]),
        ("<ul><li>one<li>two</ul><table><tr><td>1<td>2</table>", ["one", "two", "1", "2"]),
        ("<p>x<textarea>no</textarea><p>unclosed <a href='/x>y'>link", ["x", "unclosed link"]),
    ],
)
def test_lines(source, lines):
    assert pagediff.cut(source).lines == lines


def test_pages(spark):
    menu, foot = "<div><a href=/a>Home page</a></div><div>All our topics</div>", "<div>Imprint of the site</div>"
    page = lambda i: f"<html><body>{menu}<div class='cookie-notice'>We use cookies {i}</div><p>Story {i} begins&nbsp;here.</p><p>It  ends {i}.</p>{foot}</body></html>"
    article = "<body><nav>menu x</nav><header>Top</header><article><h1>Head</h1><p>One <b>two</b>.</p><div class='comments'><p>first!</p></div><aside>see also</aside></article><form>Name <input></form><footer>f</footer>"
    rows = [(i, f"http://h.example/de/{i}", page(i)) for i in range(5)] + [(10, "http://x.example/1", article), (11, "http://x.example/1", article), (12, None, None), (13, "odd", ""), (None, None, "<p>q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pagediff.extract(pages).collect()}
    assert [got[i] for i in range(5)] == [f"Story {i} begins here. It ends {i}." for i in range(5)]
    assert got[10] == got[11] == "Head One two." and got[12] == got[13] == "" and got[None] == "q"
    assert {r["page_id"]: r["text"] for r in pagediff.extract(pages, cell=2).collect()}[2].startswith("Story 2 begins here.")
    assert pagediff.extract(pages.where("false")).collect() == []


def test_pages_of_the_tables(spark):
    """Here the article element holds the whole article; it is the truth to meet."""
    import html
    import re

    pages = read(spark, DATA, "pages")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pagediff.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<b>|</b>", "", re.sub(r"</?(p|h1|br|li|ul)>", " ", body))).split())
        assert got[r["page_id"]] == (text, len(text))


def extracted(spark, rows, **params):
    return {r["page_id"]: r["text"] for r in pagediff.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), **params).collect()}


def test_pages_differ_inside_article_and_main(spark):
    """What neighbours repeat goes inside the elements too, but for paragraphs of an article; what none has stays outside them."""
    page = lambda tag, i: f"<body><{tag}><div>Listen to this page</div><p>Body {i}.</p><p>Cited.</p><div>Own box {i}</div></{tag}><article><p>Teaser {i}</p></article><div>Rest {i}</div><div>All our topics</div></body>"
    for tag, cited in (("article", " Cited."), ("main", ""), ("div", "")):
        got = extracted(spark, [(i, f"http://h.example/{i}", page(tag, i)) for i in range(3)])
        assert got == {i: f"Body {i}.{cited} Own box {i} Teaser {i} Rest {i}" for i in range(3)}


def test_pages_with_the_article_in_a_box_named_like_a_sidebar(spark):
    """A layout word in a name decides only as long as something else is left; comments never become the article."""
    page = lambda i: f"<div class='side-story'><h1>Head {i}</h1><p>Body {i}.</p></div><div class=comments><p>I, reader {i}, think that this is far too short.</p></div><div class='side'>Box {i}</div>"
    both = lambda i: f"<div class='side-story'><p>Beside {i} and more of it</p></div><article class='banner-story'><p>Body {i}.</p></article>"
    assert extracted(spark, [(i, f"http://h.example/{i}", page(i)) for i in range(3)]) == {i: f"Head {i} Body {i}." for i in range(3)}
    assert extracted(spark, [(i, f"http://h.example/{i}", both(i)) for i in range(3)]) == {i: f"Body {i}." for i in range(3)}


def test_common_lines_of_long_pages():
    """Beyond what whole tables of bits would allow for."""
    a = [i for i in range(30_000) if i % 7]
    b = [i for i in range(30_000) if i % 5]
    assert [x for x, s in zip(a, pagediff.common_lines(a, b), strict=True) if s] == [i for i in range(30_000) if i % 5 and i % 7]


def test_pages_of_templates_and_among_copies(spark):
    """Ten unmarked lines of a template beside five of the page are no copy; beyond a run of copies the next page is met."""
    menu = "".join(f"<div>Topic {k}</div>" for k in range(10))
    page = lambda i, n: f"<body>{menu}" + "".join(f"<div>Story {i} has line {k}</div>" for k in range(n)) + "<div>Imprint</div></body>"
    text = lambda i, n: " ".join(f"Story {i} has line {k}" for k in range(n))
    assert extracted(spark, [(i, f"http://h.example/{i}", page(i, 5)) for i in range(4)]) == {i: text(i, 5) for i in range(4)}
    copies = [(i, f"http://h.example/c/{i}", page(9, 30)) for i in range(5)]
    near = [(5, "http://h.example/c/5", page(9, 30).replace("line 7<", "line seven<"))]
    got = extracted(spark, [*copies, *near, (6, "http://h.example/z", page(6, 5))])
    assert got == {**{i: text(9, 30) for i in range(5)}, 5: text(9, 30).replace("line 7 ", "line seven "), 6: text(6, 5)}


def test_pages_meet_the_same_neighbours_in_cells_of_any_size(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        parts = [f"Line {rng.randint(0, 5)} of {i // 12}" for _ in range(rng.randint(0, 4))]
        body = parts + [f"Own {i} {k}" for k in range(rng.choice((0, 1, 6)))]
        if i and rng.random() < 0.4:
            rows.append((i, f"http://h{i // 50}.example/{'abc'[i % 3]}/{rng.randint(0, 200)}", rows[-1][2] if rng.random() < 0.7 else rows[0][2]))
        else:
            rows.append((i, f"http://h{i // 50}.example/{rng.choice('abcd')}/{rng.randint(0, 200)}", "".join(f"<div>{x}</div>" for x in body)))
    rows += [(200 + i, f"http://h0.example/b/same/{i}", "<div>Line 1</div><div>one</div>") for i in range(9)] + [(300 + i, "http://h1.example/b", None) for i in range(5)]
    whole = extracted(spark, rows)
    assert len(whole) == len(rows) and sum(t != "" for t in whole.values()) > 60
    assert extracted(spark, rows, cell=1) == extracted(spark, rows, cell=3) == whole
    pages = {i: f"<div>Part {i // 2}</div><div>Story {i}</div>" for i in range(40)}
    rows = [(i, f"http://h.example/{i // 2:02}/{i * 37 % 41:02}-story", p) for i, p in pages.items()]
    assert extracted(spark, rows, cell=2) == {i: f"Story {i}" for i in pages}


def by_product(rows, k=5, every=50):
    x = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for n, (q, u) in enumerate(x):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(u, v, strict=False)), i) for m, (i, v) in enumerate(x) if m != n)
            yield from ((q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k]))


@pytest.mark.parametrize("rows", [1 << 16, 37])
def test_top_k(spark, rows):
    rng = np.random.default_rng(rows)
    data = [(int(i), [float(c) for c in rng.normal(0, 0.02 if i % 3 else 1.5, 6)]) for i in rng.permutation(200) - 40]
    data += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, [1.0] * 6), (350, [0.0] * 6), (400, []), (401, [0.5, 0.5])]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in data], "vec_id long, embedding array<float>, score int, rank int").repartition(5)
    got = sorted(map(tuple, bitsliced.search(vectors, rows=rows).collect()))
    assert got == sorted(by_product(data))


def test_top_k_small(spark):
    schema = "vec_id long, embedding array<float>"
    assert bitsliced.search(spark.createDataFrame([], schema)).collect() == []
    assert bitsliced.search(spark.createDataFrame([(50, [1.0])], schema)).collect() == []
    got = bitsliced.search(spark.createDataFrame([(50, [1.0]), (50, [1.0]), (3, [1.0]), (2, [1.0])], schema)).collect()
    assert sorted(map(tuple, got)) == [(50, 1, 2, 65536)] * 2 + [(50, 2, 3, 65536)] * 2 + [(50, 3, 50, 65536)] * 2


def test_top_k_of_rows_with_one_id(spark, monkeypatch):
    """Rows of one id with other vectors, very many equal rows, as queries too, and components of any size."""
    schema = "vec_id long, embedding array<float>"
    rows = [(50, [1.0]), (50, [0.5]), (3, [1.0]), (3, [9.0]), *[(7, [2.0])] * 40, *[(100, [-1.0])] * 9]
    got = sorted(map(tuple, bitsliced.search(spark.createDataFrame(rows, schema)).collect()))
    assert got == sorted(by_product(rows))
    rows = [(50, [3e9, -1.0]), (1, [2e9, 5.0]), (2, [-3e9, 0.25]), (100, [1e-3, 7.0]), (4, [1e6, 1e6])]
    got = sorted(map(tuple, bitsliced.search(spark.createDataFrame(rows, schema)).collect()))
    limit = (1 << 63) - 1
    assert got == sorted((q, r, i, max(-limit - 1, min(limit, s))) for q, r, i, s in by_product(rows))
    wide = [(50, [3e38]), (1, [2.0]), (2, [-2.0])]
    assert [r["vec_id"] for r in sorted(bitsliced.search(spark.createDataFrame(wide, schema)).collect(), key=lambda r: r["rank"])] == [1, 2]


def test_top_k_of_the_tables(spark):
    vectors = read(spark, DATA, "embeddings")
    data = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    assert sorted(map(tuple, bitsliced.search(vectors).collect())) == sorted(by_product(data))
