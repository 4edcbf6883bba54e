"""The queries opN_<name> of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groveline.llm import bitsliced, jaccard, langid, mixing, packing, pagediff, quality, sharding, substrings, suffixes
from groveline.llm.common import read


def op1_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op2_bidirectional_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op3_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.extract(read(spark, sf_dir, "pages"))


def op4_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.search(read(spark, sf_dir, "embeddings"))


def op5_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op6_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents")).drop("p_good")


def op7_doubled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(read(spark, sf_dir, "documents"))


def op8_columnwise_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(read(spark, sf_dir, "documents"))


def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_partenum_join, op2_bidirectional_gru, op3_page_differencing, op4_bit_sliced_topk, op5_minimax_shards, op6_weak_supervision, op7_doubled_windows, op8_columnwise_suffixes, op9_length_buckets, op10_sainte_lague_mix)}

# The same in SQL, where SQL can say it. Elsewhere tests/llm holds the queries against brute force.
WORDS = "w AS (SELECT doc_id, unnest(list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), 1) AS i FROM documents)"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP1 = f"""
WITH RECURSIVE {WORDS.format(text=LOWER)}, n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
  g AS (SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM w),
  s AS (SELECT DISTINCT doc_id, s FROM g JOIN n USING (doc_id) WHERE i <= greatest(n - 3, 1)), z AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * c >= 85 * (x.k + y.k - c)), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), m AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(z.k, 0)::BIGINT AS n_shingles, coalesce(m.root, d.doc_id) AS component_id FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id"""
OP4 = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5"""
OP7 = f"""
WITH {WORDS.format(text="coalesce(text, '')")}, n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
  g AS (SELECT doc_id, i, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h FROM w),
  r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM g JOIN n USING (doc_id) WHERE i <= n - 34) WHERE c > 1),
  k AS (SELECT w.doc_id, w.i, word, max(r.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.i = w.i),
  o AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN o USING (doc_id)"""

OP8 = """
WITH b AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS y FROM documents), n AS (SELECT r, doc_id, y, hex(y) AS x, octet_length(y)::BIGINT AS n FROM b),
  w AS (SELECT r, i, md5(array_slice(y, i + 1, i + 200)) AS h FROM (SELECT r, y, unnest(range(0, n - 199)) AS i FROM n)),
  s AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY 1 HAVING count(*) > 1)),
  e AS (SELECT r, i, coalesce(i > lag(i) OVER v + 200, true) AS fresh FROM s WINDOW v AS (PARTITION BY r ORDER BY i)),
  g AS (SELECT r, i, sum(fresh::INTEGER) OVER (PARTITION BY r ORDER BY i) AS k FROM e), t AS (SELECT r, k, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY 1, 2),
  o AS (SELECT r, sum(z - a)::BIGINT AS gone, count(*) AS spans FROM t GROUP BY 1),
  c AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS z FROM t UNION ALL SELECT r, max(z), NULL FROM t GROUP BY 1),
  k AS (SELECT c.r, string_agg(CASE WHEN c.z IS NULL THEN substr(x, 2 * a + 1) ELSE substr(x, 2 * a + 1, 2 * (c.z - a)) END, '' ORDER BY a) AS kept FROM c JOIN n ON n.r = c.r GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM n LEFT JOIN o ON o.r = n.r LEFT JOIN k ON k.r = n.r"""

ORACLES: dict[str, str] = {"op1_partenum_join": OP1, "op4_bit_sliced_topk": OP4, "op7_doubled_windows": OP7, "op8_columnwise_suffixes": OP8}
