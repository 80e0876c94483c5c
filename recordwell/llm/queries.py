"""The registered queries of this folder: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_blocks, bpe, hnsw, html_extract, langid, minhash, packed_output, packing, prefix_trie, quality_rules, toxicity, url_trust, whitening
from .byte_tokens import read_vocabulary
from .shared import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return read_vocabulary(public_tokenizers.path(name))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_blocks.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_packed_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_output.manifest(packed_output.write_matrices(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encoded(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json")))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.scored(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op10_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judged(table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_langid": op2_langid,
    "op3_minhash": op3_minhash,
    "op4_hnsw": op4_hnsw,
    "op5_packed_output": op5_packed_output,
    "op6_bpe": op6_bpe,
    "op7_packing": op7_packing,
    "op8_html_extract": op8_html_extract,
    "op9_quality": op9_quality,
    "op10_url_trust": op10_url_trust,
    "op11_whitening": op11_whitening,
    "op12_toxicity": op12_toxicity,
    "op13_prefix_trie": op13_prefix_trie,
}

_REACH = "reach AS (SELECT k AS a, k AS b FROM node UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)"

#: Models and token ids can't be said in SQL; op10's verdicts beyond its rules are a fixed point of sums.
SQL: dict[str, str] = {
    "op1_ann": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op3_minhash": """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda k: array_to_string(ws[k:k + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)), node AS (SELECT doc_id AS k FROM documents), """
    + _REACH
    + """
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) m ON m.a = d.doc_id""",
    "op4_hnsw": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93), node AS (SELECT vec_id AS k FROM embeddings), """
    + _REACH
    + """
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, c AS component_id, c = vec_id AS kept FROM embeddings JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) m ON m.a = vec_id""",
    "op13_prefix_trie": """WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) - 1 AS BIGINT) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
-- CRC-32 of the decimal id: a table of the 256 bytes' remainders, then a byte at a time.
crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS r),
n AS (SELECT c, max(i) + 1 AS n, (SELECT xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(c AS VARCHAR), k, 1)) AS BIGINT))), lambda a, b: xor(a // 256, r[xor(a % 256, b) + 1])), 4294967295) FROM crc) % 9 AS h FROM t GROUP BY c),
h AS (SELECT n.c, n.n, n.h, n.c - n.c % 5 AS b, least(n.h, coalesce(m.n, 0)) AS lent FROM n LEFT JOIN n m ON m.c = n.c - n.c % 5),
s AS (SELECT h.c, t.i + 1 AS d, t.role, t.text FROM h JOIN t ON t.c = h.b AND t.i < h.h UNION ALL SELECT h.c, h.lent + t.i - h.h + 1, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.i >= h.h),
p AS (SELECT c, 0 AS d, '' AS k, 0 AS size FROM h UNION ALL SELECT c, d, string_agg(concat(strlen(role), ':', role, strlen(text), ':', text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING), strlen(text) FROM s),
x AS (SELECT c, d, sha256(k) AS k, size, d = max(d) OVER (PARTITION BY c) AS last FROM p),
node AS (SELECT d, k, min(c) AS c, count(*) AS n, any_value(size) AS size, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '')) AS ends FROM x GROUP BY d, k),
up AS (SELECT DISTINCT a.d, a.k, b.k AS pk FROM x a JOIN x b ON a.c = b.c AND b.d = a.d - 1), kid AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM up GROUP BY 1, 2),
under AS (SELECT DISTINCT a.d, a.k, b.d AS bd, b.k AS bk FROM x a JOIN x b ON a.c = b.c AND b.d >= a.d),
total AS (SELECT u.d, u.k, sum((m.n - 1) * m.size) AS saved, count(*) FILTER (WHERE kid.n IS NULL) AS leaves FROM under u JOIN node m ON m.d = u.bd AND m.k = u.bk LEFT JOIN kid ON kid.d = u.bd AND kid.k = u.bk GROUP BY 1, 2)
SELECT node.c AS conv_id, CAST(node.d AS BIGINT) AS depth, pn.c AS parent_conv_id, node.n AS n_convs, coalesce(kid.n, 0) AS n_children, total.leaves AS n_leaves, CAST(total.saved AS BIGINT) AS saved_tokens, node.ends AS ends_sha256
FROM node JOIN total USING (d, k) LEFT JOIN kid USING (d, k) LEFT JOIN up ON up.d = node.d AND up.k = node.k LEFT JOIN node pn ON pn.d = node.d - 1 AND pn.k = up.pk""",
}
