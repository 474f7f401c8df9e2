"""Operators on document text: table detection, paragraph chunking,
sentence search with context, keyword test, question-context assembly.

Every operator works inside its row with Spark's array and pattern functions,
so nothing is shuffled and the work is linear in the text: no fold carries a
list along, and a document is never exploded into lines that must be re-sorted
by a window.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.cells import WS_CHARS, WS_CLASS

# --- fixed values: the reference's text rules -----------------------------------
LINE_BREAK = "\n"
CELL_SPLIT = "(?:" + WS_CLASS + "){2,}|\t"      # two or more white space, or a tab
ROW_JOIN = "|"
PARAGRAPH_SPLIT = "\n\n+"
PARAGRAPH_JOIN = "\n\n"
DEFAULT_CHUNK = 10000
QA_CHUNK = 15000
SENTENCE_SPLIT = "[.!?]+"
CONTEXT_JOIN = ". "
KEYWORD_MIN_LEN = 4            # words longer than 3 characters
QA_TABLES = 5
QA_HEAD = ("You are analyzing a PDF document with {pages} pages and {chars} characters.\n\n"
           "User question: \"{question}\"\n\nPDF Content (complete text in chunks):\n\n")
QA_CHUNK_HEAD = "\n--- Chunk {i}/{n} ---\n"
QA_TABLES_HEAD = "\n\nTables found in PDF (first 5):\n"
QA_TABLE_HEAD = "\nTable {i}:\n"
QA_TAIL = ("\n\nPlease answer the user's question based on the complete PDF content above. "
           "Be accurate, specific, and cite relevant information from the document. "
           "If you need to quote something, use the exact text from the PDF.")
# ----------------------------------------------------------------------------------


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _explode(df: DataFrame, arr: str, pos: str, out: str) -> DataFrame:
    """posexplode that keeps the array expression evaluated once: the outer
    form stops Catalyst from inferring a ``size(arr) > 0`` filter and pushing
    it (with the whole text fold) below the projection; empty arrays are
    dropped after the generator instead."""
    keep = [c for c in df.columns if c != arr]
    return (df.select(*keep, F.posexplode_outer(arr).alias(pos, out))
            .where(F.col(pos).isNotNull()))


# -- E2: tables in text ---------------------------------------------------------------
def tables_in_text(text) -> Column:
    """``array<array<string>>``: the tables of a text, each a list of rows
    whose cells are joined by ``|``.

    A line holding two spaces or a tab is a candidate; its cells are the
    non-blank pieces split on two or more white space or a tab, and it is a
    row if it has more than one cell. A candidate with one cell neither adds
    a row nor ends the table; any other line ends it.

    Linear: every line becomes its row, an empty line if it ends a table, or
    nothing; joined by line breaks once, the tables are what lies between empty
    lines, since a row is never empty and holds no line break.
    """
    t = F.coalesce(_col(text), F.lit(""))
    kept = F.filter(F.transform(F.split(t, LINE_BREAK, -1), lambda ln: F.when(
        ln.contains("  ") | ln.contains("\t"), _row(ln)).otherwise(F.lit(""))), lambda x: x.isNotNull())
    parts = F.split(F.array_join(kept, LINE_BREAK), PARAGRAPH_SPLIT, -1)
    tables = F.filter(F.transform(parts, lambda p: F.filter(F.split(p, LINE_BREAK, -1), lambda r: r != "")),
                      lambda rows: F.size(rows) > 0)
    # fast path: a text with no two spaces and no tab has no candidate line
    return F.when(t.contains("  ") | t.contains("\t"), tables).otherwise(F.array().cast("array<array<string>>"))


def _row(line: Column) -> Column:
    cells = F.filter(F.split(line, CELL_SPLIT, -1), lambda c: _trim(c) != "")
    return F.when(F.size(cells) > 1, F.array_join(cells, ROW_JOIN))


def text_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Long form ``(doc_id, table_no, row_no, row_text)``, numbered from 1."""
    t = docs.select(F.col(id_col).alias("doc_id"), tables_in_text(text_col).alias("tables"))
    t = _explode(t, "tables", "ti", "rows")
    t = t.select("doc_id", (F.col("ti") + 1).cast("int").alias("table_no"), "rows")
    return _explode(t, "rows", "ri", "row_text").select(
        "doc_id", "table_no", (F.col("ri") + 1).cast("int").alias("row_no"), "row_text")


# -- E3: chunking -----------------------------------------------------------------------
def chunks_of(text, max_chars: int = DEFAULT_CHUNK) -> Column:
    """``array<string>``: paragraphs (split on blank lines) packed greedily.

    A chunk is closed when its length plus the next paragraph's exceeds
    ``max_chars`` and it is not empty (the joining blank line is not
    counted, so a chunk may exceed the limit; a long paragraph is never
    cut). Chunks are trimmed; a last chunk of white space is dropped.

    Linear, with no accumulator: joined by blank lines, a chunk of several
    paragraphs has at most ``max_chars`` + 2 characters, as the last joint isn't
    counted. So the next chunk is the longest run up to there that ends at a blank
    line or at the end, and the whole first paragraph if there is none.
    """
    pars = F.split(F.coalesce(_col(text), F.lit("")), PARAGRAPH_SPLIT, -1)
    # an empty paragraph at the start is joined by nothing
    whole = F.array_join(F.when(F.element_at(pars, 1) == "", F.slice(pars, 2, F.size(pars))).otherwise(pars), PARAGRAPH_JOIN)
    stop = "(?=\\n\\n|\\z)"
    found = F.regexp_extract_all(whole, F.lit(f"(?s)(.{{1,{max_chars + 2}}}{stop}|.+?{stop})(?:\\n\\n)?"), F.lit(1))
    last = F.try_element_at(found, F.lit(-1))
    # an empty paragraph at the end closes a chunk that is over the limit
    closed = (F.element_at(pars, -1) == "") & ~F.endswith(last, F.lit(PARAGRAPH_JOIN))
    ended = F.when((F.size(found) > 0) & (_trim(last) == "") & ~closed, F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))))
    return F.transform(F.coalesce(ended, found), _trim)


def chunk_text(docs: DataFrame, max_chars: int = DEFAULT_CHUNK, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``(doc_id, chunk_no, chunk)``, numbered from 1."""
    c = docs.select(F.col(id_col).alias("doc_id"), chunks_of(text_col, max_chars).alias("chunks"))
    return _explode(c, "chunks", "i", "chunk").select(
        "doc_id", (F.col("i") + 1).cast("int").alias("chunk_no"), "chunk")


# -- E4/E5: sentence search and keywords -----------------------------------------------------
def keywords(query: str) -> list[str]:
    """Words of the lower-cased query longer than three characters."""
    return [w for w in re.split("[" + re.escape(WS_CHARS) + "]+", query.lower())
            if len(w) >= KEYWORD_MIN_LEN]


def _hits(lowered: Column, query: str) -> Column:
    q = query.lower()
    out = lowered.contains(F.lit(q))
    for w in keywords(query):
        out = out | lowered.contains(F.lit(w))
    return out


def sentence_hits(text, query: str) -> Column:
    """``array<string>``: for each sentence that contains the query or one
    of its keywords, the previous, matching and next sentence joined by
    ``. `` (missing neighbours left out). Neighbours come from shifted
    copies zipped in, so no lambda indexes an outer array."""
    sents = F.filter(F.split(F.coalesce(_col(text), F.lit("")), SENTENCE_SPLIT, -1),
                     lambda s: _trim(s) != "")
    n = F.size(sents)
    prev = F.concat(F.array(F.lit("")), F.slice(sents, 1, F.greatest(n - 1, F.lit(0))))
    nxt = F.concat(F.slice(sents, 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit("")))
    trio = F.zip_with(F.zip_with(sents, prev, lambda s, p: F.struct(s.alias("s"), p.alias("p"))),
                      nxt, lambda sp, x: F.struct(sp["s"].alias("s"), sp["p"].alias("p"), x.alias("n")))
    ctx = F.transform(trio, lambda t: F.when(
        _hits(F.lower(t["s"]), query),
        F.array_join(F.filter(F.array(t["p"], t["s"], t["n"]), lambda x: _trim(x) != ""),
                     CONTEXT_JOIN)))
    return F.filter(ctx, lambda x: x.isNotNull())


def sentence_search(docs: DataFrame, query: str, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(doc_id, hit_no, context)``."""
    h = docs.select(F.col(id_col).alias("doc_id"), sentence_hits(text_col, query).alias("hits"))
    return _explode(h, "hits", "i", "context").select(
        "doc_id", (F.col("i") + 1).cast("int").alias("hit_no"), "context")


def keyword_hits(docs: DataFrame, query: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(doc_id, keywords_found)`` for documents whose lower-cased text
    contains at least one keyword of the query."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    found = sum((F.when(low.contains(F.lit(w)), F.lit(1)).otherwise(F.lit(0))
                 for w in keywords(query)), F.lit(0))
    return (docs.select(F.col(id_col).alias("doc_id"), found.cast("int").alias("keywords_found"))
            .where(F.col("keywords_found") > 0))


# -- E1/E6: document stats and question context ------------------------------------------------
def doc_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              pages_col: str | None = None) -> DataFrame:
    """``(doc_id, pages, text_length, tables_found)``."""
    pages = F.col(pages_col).cast("int") if pages_col else F.lit(None).cast("int")
    return docs.select(F.col(id_col).alias("doc_id"), pages.alias("pages"),
                       F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("text_length"),
                       F.size(tables_in_text(text_col)).alias("tables_found"))


def qa_context(docs: DataFrame, question: str, max_chars: int = QA_CHUNK, id_col: str = "doc_id",
               text_col: str = "text", pages_col: str | None = None) -> DataFrame:
    """``(doc_id, context)``: the question prompt of one document: counts,
    the question, every chunk numbered ``i/n``, the first five tables and
    the closing instructions."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pages = (F.coalesce(F.col(pages_col).cast("string"), F.lit("unknown")) if pages_col
             else F.lit("unknown"))
    # chunks and tables are columns of their own: read in several places below,
    # they stay so in the plan and are cut once per document, not once per chunk
    parts = docs.select(F.col(id_col).alias("doc_id"), pages.alias("pages"), F.length(text).alias("chars"),
                        chunks_of(text, max_chars).alias("chunks"),
                        F.slice(tables_in_text(text), 1, QA_TABLES).alias("tables"))
    chunks, tables = F.col("chunks"), F.col("tables")
    n = F.size(chunks).cast("string")
    given = {"pages": F.col("pages"), "chars": F.col("chars").cast("string"), "question": F.lit(question)}
    head = F.concat(*[given[x] if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"\{(\w+)\}", QA_HEAD))])
    body = F.array_join(F.transform(chunks, lambda c, i: F.concat(
        F.lit("\n--- Chunk "), (i + 1).cast("string"), F.lit("/"), n, F.lit(" ---\n"), c,
        F.lit("\n"))), "")
    tables_txt = F.when(F.size(tables) > 0, F.concat(
        F.lit(QA_TABLES_HEAD),
        F.array_join(F.transform(tables, lambda t, i: F.concat(
            F.lit("\nTable "), (i + 1).cast("string"), F.lit(":\n"), F.array_join(t, "\n"),
            F.lit("\n"))), ""))).otherwise(F.lit(""))
    return parts.select("doc_id", F.concat(head, body, tables_txt, F.lit(QA_TAIL)).alias("context"))
