"""Chunking over all documents.

The driver documents hold no blank lines, headings or question lines, so some
queries first turn short lines into headings, questions or paragraph breaks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine.operators import chunking as C
from corpus_engine.plans.corpus import corpus_summary as summarise
from corpus_engine.registry import query, sql
from corpus_engine.sources.tables import load_table

_HEADED_DUCK = (
    r"regexp_replace(regexp_replace(text, '(?m)^(.{1,30}[.])$', '### \1', 'g'), "
    r"'(?m)^([^#].{31,60}[.])$', '## \1', 'g')"
)


def _documents(spark, d, *more):
    return load_table(spark, d, "documents", ["doc_id", "text", *more], spread=True)


def headed(documents):
    """Documents whose short lines have become headings of two levels."""
    text = F.regexp_replace("text", r"(?m)^(.{1,30}[.])$", "### $1")
    return documents.withColumn("text", F.regexp_replace(text, r"(?m)^([^#].{31,60}[.])$", "## $1"))


_SECTIONS_SQL = f"""
  l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line,
               unnest(range(0, len(string_split(t, chr(10))))) AS pos
        FROM (SELECT doc_id, {_HEADED_DUCK} AS t FROM documents)),
  h AS (SELECT *, length(regexp_extract(line, '^(#{{2,6}})\\s+.+$', 1)) AS level,
               trim(regexp_extract(line, '^#{{2,6}}\\s+(.+)$', 1)) AS title FROM l),
  n AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER w AS no,
               max(CASE WHEN level = 2 THEN pos END) OVER w AS p2,
               max(CASE WHEN level = 3 THEN pos END) OVER w AS p3
        FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  s AS (SELECT n.doc_id, no, string_agg(line, chr(10) ORDER BY pos) AS content,
               any_value(p2) AS p2, any_value(p3) AS p3
        FROM n WHERE level = 0 GROUP BY n.doc_id, no
        HAVING {sql.trim('string_agg(line, chr(10) ORDER BY pos)')} <> ''),
  named AS (SELECT s.doc_id, no, content, nullif(concat_ws(' > ', a.title,
                CASE WHEN s.p3 > coalesce(s.p2, -1) THEN b.title END), '') AS heading_path
        FROM s LEFT JOIN h a ON a.doc_id = s.doc_id AND a.pos = s.p2
               LEFT JOIN h b ON b.doc_id = s.doc_id AND b.pos = s.p3),
  whole AS (SELECT doc_id, 0 AS no, {_HEADED_DUCK} AS content, CAST(NULL AS VARCHAR) AS heading_path
        FROM documents WHERE {sql.trim('text')} <> '' AND doc_id NOT IN (SELECT doc_id FROM named)),
  sec AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS INT) AS section_no,
                 heading_path, content FROM (SELECT doc_id, no, content, heading_path FROM named
                 UNION ALL SELECT doc_id, no, content, heading_path FROM whole))"""


@query(f"WITH {_SECTIONS_SQL} SELECT doc_id, section_no, heading_path, md5(content) AS digest FROM sec")
def split_sections(spark, d):
    return C.split_sections(headed(_documents(spark, d))).select(
        "doc_id", "section_no", "heading_path", F.md5("content").alias("digest")
    )


@query(
    f"""WITH {_SECTIONS_SQL} SELECT heading_path, count(*) AS sections, count(DISTINCT doc_id) AS documents
        FROM sec GROUP BY heading_path"""
)
def heading_breadcrumbs(spark, d):
    return (
        C.split_sections(headed(_documents(spark, d)))
        .groupBy("heading_path")
        .agg(F.count("*").alias("sections"), F.countDistinct("doc_id").alias("documents"))
    )


@query(f"SELECT doc_id, CAST({sql.boundary('text')} AS INT) AS boundary FROM documents")
def sentence_boundary(spark, d):
    return _documents(spark, d).select(
        "doc_id", C.sentence_boundary(F.col("text"), C.TARGET_CHARS).alias("boundary")
    )


@query(
    f"""WITH RECURSIVE p AS (
      SELECT doc_id, string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\n+') AS ps,
             length(replace(text, chr(10), chr(10) || chr(10))) AS size FROM documents),
    fold AS (
      SELECT doc_id, 0 AS i, '' AS cur, CAST(NULL AS VARCHAR) AS piece FROM p WHERE size > 2000
      UNION ALL
      SELECT doc_id, i + 1,
        CASE WHEN NOT full_ THEN CASE WHEN cur = '' THEN para ELSE cur || chr(10) || chr(10) || para END
             WHEN big THEN right(head, 200) || CASE WHEN rest = '' THEN '' ELSE chr(10) || chr(10) || rest END
                  || chr(10) || chr(10) || para
             ELSE right(cur, 200) || chr(10) || chr(10) || para END,
        CASE WHEN NOT full_ THEN NULL WHEN big THEN CASE WHEN length(head) >= 80 THEN head END ELSE cur END
      FROM (SELECT f.doc_id, f.i, f.cur, p.ps[f.i + 1] AS para, length(f.cur) > 2000 AS big,
              length(f.cur) + length(p.ps[f.i + 1]) > 2000 AND length(f.cur) > 0 AS full_,
              {sql.trim(f"left(f.cur, {sql.boundary('f.cur')})")} AS head,
              {sql.trim(f"substr(f.cur, {sql.boundary('f.cur')} + 1)")} AS rest
            FROM fold f JOIN p ON p.doc_id = f.doc_id WHERE f.i < len(p.ps))),
    last AS (SELECT fold.* FROM fold JOIN p ON p.doc_id = fold.doc_id WHERE i = len(p.ps) AND {sql.trim('cur')} <> ''),
    pieces AS (
      SELECT doc_id, i, 0 AS part, piece FROM fold WHERE piece IS NOT NULL
      UNION ALL SELECT doc_id, i + 1, 1, cur FROM last WHERE length(cur) <= 2000
      UNION ALL SELECT doc_id, i + 1, 1, {sql.trim(f"left(cur, {sql.boundary('cur')})")} FROM last WHERE length(cur) > 2000
      UNION ALL SELECT doc_id, i + 1, 2, {sql.trim(f"substr(cur, {sql.boundary('cur')} + 1)")} FROM last WHERE length(cur) > 2000
      UNION ALL SELECT p.doc_id, 0, 0, replace(text, chr(10), chr(10) || chr(10)) FROM p
        JOIN documents USING (doc_id) WHERE size <= 2000)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, part) - 1 AS INT) AS piece_no,
           CAST(length(piece) AS INT) AS chars, md5(piece) AS digest FROM pieces
    WHERE i = 0 OR part = 0 OR length(piece) >= 80 OR piece IN (SELECT cur FROM last WHERE length(cur) <= 2000)"""
)
def split_by_size(spark, d):
    text = F.regexp_replace("text", "\n", "\n\n")
    return (
        _documents(spark, d)
        .select("doc_id", F.posexplode(C.split_by_size(text)).alias("piece_no", "piece"))
        .select("doc_id", "piece_no", F.length("piece").alias("chars"), F.md5("piece").alias("digest"))
    )


_ASKING = r"regexp_replace(text, '(?m)^(.{16,90})[.]$', '\1?', 'g')"


@query(
    f"""WITH l AS (SELECT doc_id, {sql.trim('unnest(string_split(t, chr(10)))')} AS line,
                 unnest(range(0, len(string_split(t, chr(10))))) AS pos
          FROM (SELECT doc_id, {_ASKING} AS t FROM documents)),
    g AS (SELECT *, sum(CASE WHEN q THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp
          FROM (SELECT *, line LIKE '%?' AND length(line) > 15 AS q FROM l)),
    pairs AS (SELECT doc_id, grp, max(CASE WHEN q THEN line END) AS question,
                string_agg(CASE WHEN NOT q AND line <> '' THEN line END, ' ' ORDER BY pos) AS answer
              FROM g WHERE grp > 0 GROUP BY doc_id, grp),
    kept AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM pairs WHERE answer IS NOT NULL)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INT) AS pair_no,
           md5('Q: ' || question || chr(10) || 'A: ' || answer) AS digest FROM kept WHERE n >= 3"""
)
def faq_pairs_lines(spark, d):
    asking = F.regexp_replace("text", r"(?m)^(.{16,90})[.]$", "$1?")
    return (
        _documents(spark, d)
        .withColumn("text", asking)
        .select("doc_id", F.posexplode(C.question_pairs(F.col("text"))).alias("pair_no", "pair"))
        .select("doc_id", "pair_no", F.md5("pair").alias("digest"))
    )


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
       m AS (SELECT doc_id, line, i, regexp_full_match(line, '.{1,60}[.]') AS q FROM l WHERE line <> ''),
       n AS (SELECT *, sum(q::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM m),
       p AS (SELECT doc_id, n, max(line) FILTER (WHERE q) AS q, string_agg(line, chr(10) || 'A: ' ORDER BY i) FILTER (WHERE NOT q) AS a
             FROM n WHERE n > 0 GROUP BY 1, 2)
       SELECT doc_id, CAST(n - 1 AS INT) AS pair_no, md5('Q: ' || trim(q) || coalesce(chr(10) || 'A: ' || trim(a), '')) AS digest
       FROM p QUALIFY count(*) OVER (PARTITION BY doc_id) >= 2"""
)
def faq_pairs_marked(spark, d):
    """Marked pairs: short lines as questions, the lines below as answers."""
    marked = F.regexp_replace("text", r"(?m)^(.{1,60}[.])$", "Q: $1")
    marked = F.regexp_replace(marked, r"(?m)^(?!Q: )(.+)$", "A: $1")
    return (
        _documents(spark, d)
        .withColumn("text", marked)
        .select("doc_id", F.posexplode(C.marked_pairs(F.col("text"))).alias("pair_no", "pair"))
        .select("doc_id", "pair_no", F.md5("pair").alias("digest"))
    )


@query("SELECT doc_id, '[' || lang || ' > ' || source || ']' AS prefix, '[' || source || ']' AS short FROM documents")
def chunk_prefix(spark, d):
    return load_table(spark, d, "documents", ["doc_id", "lang", "source"]).select(
        "doc_id",
        C.chunk_prefix(F.col("lang"), F.col("source")).alias("prefix"),
        C.chunk_prefix(F.lit(""), F.col("source")).alias("short"),
    )


@query(
    f"""WITH c AS ({sql.plain_chunks('documents', 'doc_id, source')})
        SELECT doc_id, chunk_index, md5(content) AS digest, snippet, token_count FROM c"""
)
def chunk_pages(spark, d):
    return C.chunk_pages(_documents(spark, d)).select(
        "doc_id", "chunk_index", F.md5("content").alias("digest"), "snippet", "token_count"
    )


@query(
    f"""WITH c AS ({sql.plain_chunks('documents', 'doc_id, source')})
        SELECT doc_id, chunk_index, token_count FROM c WHERE NOT {sql.boilerplate('content')}"""
)
def filter_boilerplate_chunks(spark, d):
    return C.filter_boilerplate_chunks(C.chunk_pages(_documents(spark, d))).select(
        "doc_id", "chunk_index", "token_count"
    )


@query(
    f"""WITH c AS ({sql.plain_chunks('documents', 'doc_id, lang, source')}),
        k AS (SELECT *, {sql.norm_hash('content')} AS hash FROM c WHERE NOT {sql.boilerplate('content')}),
        b AS (SELECT hash FROM k GROUP BY hash HAVING count(DISTINCT source) >= 3)
        SELECT lang, count(*) AS chunks, count(DISTINCT doc_id) AS documents,
               CAST(sum(token_count) AS BIGINT) AS tokens
        FROM k WHERE hash NOT IN (SELECT hash FROM b) GROUP BY lang"""
)
def corpus_summary(spark, d):
    return summarise(spark, d)
