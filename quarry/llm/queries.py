"""Registered queries of the training-data operators and their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import byte_bpe, byte_cnn, embedding_dedup, exact_dedup, html_extract, line_dedup, ngram_join, packing, prefix_trie, spelling, toxicity, url_filter, warc
from quarry.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, count_col="n_dropped")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_ngram_join, op3_toxicity, op4_line_dedup, op5_html_extract, op6_packing, op7_embedding_dedup, op8_exact_dedup, op9_byte_bpe, op10_url_filter,
                                  op11_prefix_trie, op12_spelling, op13_quality)}

ORACLES = {
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS digest FROM pages),
        h AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS head FROM p)
        SELECT page_id, octet_length(b) AS payload_bytes, digest AS payload_digest,
               CASE WHEN octet_length(b) < 1000 OR page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN octet_length(b) >= 1000 AND page_id <> head THEN head END AS refers_to
        FROM h
    """,
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                          regexp_replace(coalesce(text, ''), '[ \\t-\\r]', '', 'g') AS b FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY b ORDER BY length(t) DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY b) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY b ORDER BY length(t) DESC, doc_id) AS kept,
               sha256(b) AS text_sha256
        FROM d
    """,
    "op11_prefix_trie": """
        WITH d AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
                   FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i
              FROM d),
        crc AS (SELECT c, xor(4294967295, list_reduce(
                    list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                    lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                             lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
                FROM (SELECT DISTINCT c FROM d)),
        t AS (SELECT crc.c, 0 AS part, b.i, b.role, b.text FROM crc JOIN o b ON b.c = crc.c - crc.c % 5 AND b.i <= h
              UNION ALL
              SELECT crc.c, 1, o.i, o.role, o.text FROM crc JOIN o ON o.c = crc.c AND o.i > h),
        p AS (SELECT c, 0 AS depth, '' AS k, 0 AS bytes FROM crc
              UNION ALL
              SELECT c, row_number() OVER w, string_agg(sha256(length(role) || ':' || role || text), '') OVER w,
                     octet_length(encode(text)) FROM t WINDOW w AS (PARTITION BY c ORDER BY part, i)),
        q AS (SELECT *, max(depth) OVER (PARTITION BY c) AS n, lag(k) OVER (PARTITION BY c ORDER BY depth) AS up FROM p),
        g AS (SELECT k, any_value(depth) AS depth, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs,
                     any_value(bytes) AS bytes,
                     sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = depth), '')) AS ends_sha256
              FROM q GROUP BY k),
        ch AS (SELECT up, count(*) AS n FROM g WHERE up IS NOT NULL GROUP BY up),
        f AS (SELECT g.*, coalesce(ch.n, 0) AS n_children FROM g LEFT JOIN ch ON ch.up = g.k),
        s AS (SELECT q.k, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved_tokens
              FROM f JOIN q ON q.c = f.conv_id AND q.depth <= f.depth GROUP BY q.k)
        SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children,
               s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
        FROM f JOIN s ON s.k = f.k LEFT JOIN f u ON u.k = f.up
    """,
    "op12_spelling": """
        WITH runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS i,
                             unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[A-Za-z\\x{00C0}-\\x{00FF}]+')) AS r
                      FROM documents),
        g AS (SELECT i, r, count(*) AS k, hex(encode(i || ':' || r)) AS x FROM runs WHERE length(r) >= 5 GROUP BY ALL),
        t AS (SELECT list(list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1))) ORDER BY c) AS crc
              FROM range(256) s(c)),
        h AS (SELECT r, k, xor(4294967295, list_reduce(
                  list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT)),
                  lambda s, b: xor(s >> 8, crc[(xor(s, b) & 255) + 1]))) AS h
              FROM g, t),
        w AS (SELECT CASE WHEN h % 97 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM h),
        v AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
        d AS (SELECT word, n, unnest(range(length(word))) AS j FROM v),
        e AS (SELECT word, n, j, left(word, j) || substr(word, j + 2) AS less FROM d),
        pairs AS (SELECT a.word AS a, b.word AS b FROM e a JOIN e b ON a.less = b.less AND a.j = b.j AND a.word <> b.word
                  UNION SELECT e.word, v.word FROM e JOIN v ON v.word = e.less
                  UNION SELECT v.word, e.word FROM e JOIN v ON v.word = e.less),
        near AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-v.n, hex(encode(b)))) AS best, max(v.n) AS best_n
                 FROM pairs JOIN v ON v.word = b GROUP BY a),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form,
                     CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n
              FROM v LEFT JOIN near USING (word)),
        way AS (WITH RECURSIVE c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
                SELECT c.word, c.at AS root FROM c JOIN f ON f.word = c.at WHERE f.form IS NULL)
        SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM f JOIN way USING (word)
    """,
}
