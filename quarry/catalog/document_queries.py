"""Registered document-text operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog.inputs import SQL_WS, SQL_WS_CLASS, sql_lit, table
from quarry.operators import documents as D
from quarry.operators import keywords as K

CHUNK_MAX = 500
SEARCH_QUERY = "Reth stouea"
KEYWORD_QUERY = "the lytionat erenan ouan"
QUESTION = "What does the document say about the orders?"


# -- derived inputs ----------------------------------------------------------------------
def order_docs(spark, d):
    """One text per line item (map only, no grouping, so no key can gather
    rows into one task): cells split by two spaces or by a tab, a one-cell
    candidate line inside the first run, and a plain line that ends the
    first table for every third line number. ``doc_id`` is the order key,
    so several texts may share it."""
    li = table(spark, d, "lineitem")
    ln = F.col("l_linenumber")
    s = lambda c: F.col(c).cast("string")
    text = F.concat_ws(
        "\n",
        F.concat_ws("  ", s("l_partkey"), s("l_suppkey"), s("l_returnflag")),
        F.lit("  lone"),
        F.concat_ws("\t", s("l_orderkey"), s("l_linestatus")),
        F.when(ln % 3 == 0, F.lit("subtotal for the order"))
        .otherwise(F.concat_ws("  ", s("l_linenumber"), s("l_returnflag"))),
        F.concat_ws("\t", s("l_suppkey"), s("l_linenumber")))
    return li.select(F.col("l_orderkey").alias("doc_id"), text.alias("text"))


ORDER_DOCS_SQL = """(SELECT row_number() OVER () AS uid, l_orderkey AS doc_id, concat_ws(chr(10),
    concat_ws('  ', CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_returnflag),
    '  lone',
    concat_ws(chr(9), CAST(l_orderkey AS VARCHAR), l_linestatus),
    CASE WHEN l_linenumber % 3 = 0 THEN 'subtotal for the order'
         ELSE concat_ws('  ', CAST(l_linenumber AS VARCHAR), l_returnflag) END,
    concat_ws(chr(9), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR))) AS text
  FROM lineitem)"""
DOCUMENTS_SQL = "(SELECT doc_id AS uid, doc_id, text FROM documents)"


def paragraph_docs(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))


PARAGRAPH_DOCS_SQL = "(SELECT doc_id AS uid, doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)"


# -- Spark side ------------------------------------------------------------------------------
def text_tables(spark, d):
    return D.text_tables(order_docs(spark, d))


def chunk_text(spark, d):
    return D.chunk_text(paragraph_docs(spark, d), CHUNK_MAX)


def sentence_search(spark, d):
    return D.sentence_search(table(spark, d, "documents"), SEARCH_QUERY)


def keyword_hits(spark, d):
    return D.keyword_hits(table(spark, d, "documents"), KEYWORD_QUERY)


def keyword_questions(spark, d):
    """Every document against every benchmark item as a question."""
    return K.keyword_hits(table(spark, d, "documents"), table(spark, d, "benchmark"),
                          question_id_col="item_id", question_col="text")


def doc_stats(spark, d):
    a = D.doc_stats(order_docs(spark, d)).select(F.lit("orders").alias("source"), "*")
    b = D.doc_stats(table(spark, d, "documents")).select(F.lit("documents").alias("source"), "*")
    return a.unionByName(b)


def qa_context(spark, d):
    a = D.qa_context(order_docs(spark, d), QUESTION).select(F.lit("orders").alias("source"), "*")
    b = D.qa_context(table(spark, d, "documents"), QUESTION).select(F.lit("documents").alias("source"), "*")
    return a.unionByName(b)


QUERIES = {
    "text_tables": text_tables, "chunk_text": chunk_text, "sentence_search": sentence_search,
    "keyword_hits": keyword_hits, "keyword_questions": keyword_questions, "doc_stats": doc_stats, "qa_context": qa_context,
}


# -- DuckDB oracle -------------------------------------------------------------------------------
def _not_blank(x: str) -> str:
    return f"trim({x}, {SQL_WS}) <> ''"


def sql_table_rows(docs: str) -> str:
    """(doc_id, table_no, row_no, row_text) by line islands and windows."""
    return f"""(WITH sp AS (SELECT uid, doc_id, string_split(text, chr(10)) AS arr FROM {docs} d),
ln AS (SELECT uid, doc_id, arr, unnest(generate_series(1, len(arr))) AS i FROM sp),
c AS (SELECT uid, doc_id, i, arr[i] AS line,
        contains(arr[i], '  ') OR contains(arr[i], chr(9)) AS cand,
        list_filter(regexp_split_to_array(arr[i], '(?:{SQL_WS_CLASS}){{2,}}|\\t'), lambda x: {_not_blank('x')}) AS cells
      FROM ln),
r AS (SELECT uid, doc_id, i, CASE WHEN cand AND len(cells) > 1 THEN array_to_string(cells, '|') END AS row_text,
        sum(CASE WHEN cand THEN 0 ELSE 1 END) OVER (PARTITION BY uid ORDER BY i) AS island
      FROM c),
v AS (SELECT * FROM r WHERE row_text IS NOT NULL)
SELECT uid, doc_id, CAST(dense_rank() OVER (PARTITION BY uid ORDER BY island) AS INTEGER) AS table_no,
       CAST(row_number() OVER (PARTITION BY uid, island ORDER BY i) AS INTEGER) AS row_no, row_text
FROM v)"""


def sql_chunks(docs: str, max_chars: int) -> str:
    """(uid, doc_id, chunk_no, chunk) by a recursive walk over paragraphs."""
    return f"""(WITH RECURSIVE p AS (
  SELECT uid, doc_id, string_split_regex(coalesce(text, ''), '\\n\\n+') AS pars FROM {docs} d),
walk(uid, doc_id, i, n, pars, cur, chunk_no) AS (
  SELECT uid, doc_id, 1, len(pars), pars, length(pars[1]), 1 FROM p
  UNION ALL
  SELECT uid, doc_id, i + 1, n, pars,
    CASE WHEN cur + length(pars[i + 1]) > {max_chars} AND cur > 0 THEN length(pars[i + 1])
         ELSE cur + CASE WHEN cur > 0 THEN 2 ELSE 0 END + length(pars[i + 1]) END,
    CASE WHEN cur + length(pars[i + 1]) > {max_chars} AND cur > 0 THEN chunk_no + 1 ELSE chunk_no END
  FROM walk WHERE i < n),
g AS (SELECT uid, any_value(doc_id) AS doc_id, chunk_no, max(chunk_no) OVER (PARTITION BY uid) AS last_no,
        trim(string_agg(pars[i], chr(10) || chr(10) ORDER BY i), {SQL_WS}) AS chunk
      FROM walk GROUP BY uid, chunk_no)
SELECT uid, doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, chunk FROM g
WHERE NOT (chunk_no = last_no AND chunk = ''))"""


def _sql_hit(x: str, query: str) -> str:
    terms = [query.lower()] + D.keywords(query)
    return "(" + " OR ".join(f"contains(lower({x}), {sql_lit(t)})" for t in terms) + ")"


def sql() -> dict[str, str]:
    q = {}
    q["text_tables"] = f"SELECT doc_id, table_no, row_no, row_text FROM {sql_table_rows(ORDER_DOCS_SQL)} t"
    q["chunk_text"] = f"SELECT doc_id, chunk_no, chunk FROM {sql_chunks(PARAGRAPH_DOCS_SQL, CHUNK_MAX)} c"
    q["sentence_search"] = f"""WITH s AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: {_not_blank('x')}) AS sents FROM documents),
e AS (SELECT doc_id, sents, unnest(generate_series(1, len(sents))) AS i FROM s),
h AS (SELECT doc_id, i, sents[i] AS sent, CASE WHEN i > 1 THEN sents[i - 1] END AS prev,
        CASE WHEN i < len(sents) THEN sents[i + 1] END AS nxt
      FROM e WHERE {_sql_hit('sents[i]', SEARCH_QUERY)})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS hit_no,
  array_to_string(list_filter([coalesce(prev, ''), sent, coalesce(nxt, '')], lambda x: {_not_blank('x')}), '. ') AS context
FROM h"""
    kws = D.keywords(KEYWORD_QUERY)
    found = " + ".join(f"CASE WHEN contains(lower(text), {sql_lit(w)}) THEN 1 ELSE 0 END" for w in kws)
    q["keyword_hits"] = f"""SELECT doc_id, CAST({found} AS INTEGER) AS keywords_found FROM documents
WHERE {found} > 0"""
    q["keyword_questions"] = f"""WITH k AS (SELECT * FROM (SELECT DISTINCT item_id AS question_id,
  unnest(regexp_split_to_array(lower(text), '{SQL_WS_CLASS}+')) AS word FROM benchmark) w WHERE length(word) > 3),
h AS (SELECT doc_id, word FROM documents JOIN (SELECT DISTINCT word FROM k) x ON contains(lower(text), word))
SELECT doc_id, question_id, CAST(count(*) AS INTEGER) AS keywords_found FROM h JOIN k USING (word) GROUP BY ALL"""
    stats = []
    for src, docs in (("orders", ORDER_DOCS_SQL), ("documents", DOCUMENTS_SQL)):
        stats.append(f"""SELECT {sql_lit(src)} AS source, d.doc_id, CAST(NULL AS INTEGER) AS pages,
  CAST(length(d.text) AS INTEGER) AS text_length, CAST(coalesce(t.n, 0) AS INTEGER) AS tables_found
FROM {docs} d LEFT JOIN (SELECT uid, count(DISTINCT table_no) AS n FROM {sql_table_rows(docs)} x GROUP BY uid) t
  ON t.uid = d.uid""")
    q["doc_stats"] = "\nUNION ALL\n".join(stats)
    qa = []
    for src, docs in (("orders", ORDER_DOCS_SQL), ("documents", DOCUMENTS_SQL)):
        qa.append(f"""SELECT {sql_lit(src)} AS source, d.doc_id,
  'You are analyzing a PDF document with unknown pages and ' || length(d.text) || ' characters.'
  || chr(10) || chr(10) || 'User question: "' || {sql_lit(QUESTION)} || '"' || chr(10) || chr(10)
  || 'PDF Content (complete text in chunks):' || chr(10) || chr(10)
  || coalesce(c.body, '') || coalesce(tb.body, '') || {sql_lit(D.QA_TAIL)} AS context
FROM {docs} d
LEFT JOIN (SELECT uid, string_agg(chr(10) || '--- Chunk ' || chunk_no || '/' || n || ' ---' || chr(10) || chunk || chr(10), '' ORDER BY chunk_no) AS body
           FROM (SELECT *, count(*) OVER (PARTITION BY uid) AS n FROM {sql_chunks(docs, D.QA_CHUNK)} k) k2
           GROUP BY uid) c ON c.uid = d.uid
LEFT JOIN (SELECT uid, chr(10) || chr(10) || 'Tables found in PDF (first 5):' || chr(10)
             || string_agg(chr(10) || 'Table ' || table_no || ':' || chr(10) || rows_text || chr(10), '' ORDER BY table_no) AS body
           FROM (SELECT uid, table_no, string_agg(row_text, chr(10) ORDER BY row_no) AS rows_text
                 FROM {sql_table_rows(docs)} t WHERE table_no <= 5 GROUP BY uid, table_no) t2
           GROUP BY uid) tb ON tb.uid = d.uid""")
    q["qa_context"] = "\nUNION ALL\n".join(qa)
    return q
