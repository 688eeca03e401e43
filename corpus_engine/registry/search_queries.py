"""Retrieval over all vectors and documents.

Chunks are the documents that have a vector, sites their languages. The query
vectors are the centroids per label; the query words come from ``benchmark``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.functions.vectors import cosine_similarity as cosine, norm
from corpus_engine.operators import embedding as B
from corpus_engine.operators import keyword as K
from corpus_engine.operators import ranking as L
from corpus_engine.operators import search as S
from corpus_engine.operators import vector_index as V
from corpus_engine.plans import retrieval as R
from corpus_engine.registry import query, sql
from corpus_engine.runtime import durable, scratch_path, top_per_group
from corpus_engine.sources.tables import load_table, spread_small

_T = 0.2


def chunks(spark, d):
    documents = load_table(spark, d, "documents", ["doc_id", "text", "lang"])
    vectors = load_table(spark, d, "embeddings", ["vec_id", "embedding", "label"])
    return vectors.join(documents, F.col("vec_id") == F.col("doc_id")).select(
        F.col("vec_id").alias("chunk_id"),
        F.col("doc_id").alias("page_id"),
        F.col("lang").alias("agent_id"),
        F.col("lang").alias("language"),
        "label",
        "embedding",
        F.col("text").alias("content"),
        F.left("text", F.lit(40)).alias("snippet"),
        (1 + F.col("label") / 10).alias("rank_weight"),
    )


_INDEXES: dict[tuple, K.KeywordIndex] = {}


def index(spark, d):
    """The keyword index of all documents, without stop words; stored once per state of the table's files."""
    docs = load_table(spark, d, "documents", ["doc_id", "text", "lang", "_metadata"], spread=False)
    file = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    state = docs.select(file.cast("decimal(20,0)").alias("f")).agg(F.sum("f")).first()[0]
    key = (spark.sparkContext.applicationId, d, state)
    if key not in _INDEXES:
        rows = spread_small(docs.drop("_metadata")).select(
            F.col("doc_id").alias("chunk_id"), F.col("lang").alias("agent_id"), F.col("text").alias("content")
        )
        _INDEXES[key] = K.write_index(K.build_index(rows, stop_words=False), scratch_path(spark, "index"))
    return _INDEXES[key]


def centroids(rows):
    """Mean vector per site and label."""
    return (
        rows.select("agent_id", "label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("agent_id", "label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("agent_id", "label")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("embedding"))
    )


def queries(spark, d):
    """One query per benchmark text and site: two of its words, a label's centroid."""
    items = load_table(spark, d, "benchmark", ["item_id", "text"]).select(
        "item_id",
        (F.col("item_id") % 10).cast("int").alias("label"),
        F.expr(_WORDS.replace("list_extract", "element_at")).alias("query_text"),
    )
    # searches use their queries several times
    return durable(
        items.join(centroids(chunks(spark, d)), "label").select(
            F.concat_ws("-", "item_id", "agent_id").alias("query_id"), "agent_id", "embedding", "query_text"
        )
    )


_WORDS = "list_extract(split(text, ' '), 2) || ' ' || list_extract(split(text, ' '), 4)"

_BASE = f"""
  c AS (SELECT vec_id AS chunk_id, lang AS agent_id, label, CAST(embedding AS DOUBLE[]) AS v, text AS content,
               1 + label / 10.0 AS rank_weight FROM embeddings JOIN documents ON vec_id = doc_id),
  x AS (SELECT agent_id, label, unnest(v) AS x, unnest(range(0, len(v))) AS pos FROM c),
  m AS (SELECT agent_id, label, list(x ORDER BY pos) AS v
        FROM (SELECT agent_id, label, pos, avg(x) AS x FROM x GROUP BY ALL) GROUP BY agent_id, label),
  q AS (SELECT item_id || '-' || agent_id AS query_id, agent_id, v,
               {_WORDS.replace("split(", "string_split(")} AS query_text
        FROM benchmark JOIN m ON item_id % 10 = label)"""

_SEM = """
  sim AS (SELECT query_id, chunk_id, list_cosine_similarity(q.v, c.v) AS similarity
          FROM q JOIN c ON q.agent_id = c.agent_id),
  sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank
          FROM sim WHERE similarity > {t}
          QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) <= {k})"""

_KW = r"""
  w AS (SELECT chunk_id, agent_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM (
          SELECT doc_id AS chunk_id, lang AS agent_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'),
                 lambda s: s <> '') AS t FROM documents)),
  qt AS (SELECT DISTINCT query_id, agent_id, unnest(list_filter(regexp_split_to_array(lower(query_text),
                 '[^\p{L}\p{N}]+'), lambda s: s <> '')) AS term FROM q),
  qn AS (SELECT query_id, count(*) AS n FROM qt GROUP BY query_id),
  hit AS (SELECT query_id, chunk_id, w.term, pos FROM w JOIN qt ON w.agent_id = qt.agent_id AND w.term = qt.term),
  mt AS (SELECT query_id, chunk_id, n FROM hit JOIN qn USING (query_id)
         GROUP BY query_id, chunk_id, n HAVING count(DISTINCT term) = n),
  adj AS (SELECT hit.*, n, lag(term) OVER u AS t0, lag(pos) OVER u AS p0 FROM hit JOIN mt USING (query_id, chunk_id)
          WINDOW u AS (PARTITION BY query_id, chunk_id ORDER BY pos)),
  kw AS (SELECT query_id, chunk_id, sum(CASE WHEN n = 1 THEN 0.1 WHEN t0 <> term THEN 0.1 / (pos - p0)
           ELSE 0 END) AS keyword_rank FROM adj GROUP BY query_id, chunk_id)"""

_HYBRID = """
  kw2 AS (SELECT * FROM kw QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY keyword_rank DESC, chunk_id) <= {k2}),
  hy AS (SELECT query_id, chunk_id, similarity, coalesce(keyword_rank, 0) AS keyword_rank,
           (0.7 * similarity + 0.3 * coalesce(keyword_rank, 0)) * rank_weight AS score
         FROM sem LEFT JOIN kw2 USING (query_id, chunk_id) JOIN c USING (chunk_id)),
  top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hy
          QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {k})"""


def _hybrid_sql(k):
    return ",".join([_BASE, _SEM.format(t=_T, k=2 * k), _KW, _HYBRID.format(k2=2 * k, k=k)])


@query(
    f"""WITH {_BASE} SELECT chunk_id, round(list_cosine_similarity(m.v, c.v), 6) AS similarity
        FROM m JOIN c USING (agent_id, label)"""
)
def cosine_similarity(spark, d):
    """Each chunk against the centroid of its own group."""
    rows = chunks(spark, d)
    mean = centroids(rows).withColumnRenamed("embedding", "v")
    return rows.join(mean, ["agent_id", "label"]).select(
        "chunk_id", F.round(cosine(F.col("v"), F.col("embedding")), 6).alias("similarity")
    )


@query(
    f"""WITH {_BASE}, {_SEM.format(t=_T, k=5)}
        SELECT query_id, chunk_id, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM sem"""
)
def vector_search(spark, d):
    return S.vector_search(queries(spark, d), chunks(spark, d), _T, 5).withColumn(
        "similarity", F.round("similarity", 6)
    )


@query()
def ann_search(spark, d):
    """Approximate neighbours; the share of the exact ones is tested apart."""
    return S.ann_search(queries(spark, d), chunks(spark, d), 5, _T).withColumn(
        "similarity", F.round("similarity", 6)
    )


@query(
    f"""WITH {_BASE}, {_SEM.format(t=_T, k=5)}
        SELECT count(*) AS exact_hits, true AS found_most, true AS compared_few FROM sem"""
)
def ann_quality(spark, d):
    """Whether nine tenths of the exact hits are found while comparing less than a fifth of the pairs.

    A tenth of a site, or four times the hits asked for, is compared, so the share is
    measured on sites of 200 vectors and more.
    """
    q, c = queries(spark, d), durable(chunks(spark, d).select("chunk_id", "agent_id", "embedding"))
    exact = durable(S.vector_search(q, c, _T, 5))
    hits = durable(S.ann_hits(q, c, 5))
    best = top_per_group(hits, ["query_id"], [F.col("similarity").desc(), F.col("chunk_id")], 5)
    found = exact.join(best, ["query_id", "chunk_id"]).agg(F.count("*").alias("found"))
    sizes = c.groupBy("agent_id").agg(F.count("*").alias("size")).filter("size >= 200")
    large = q.select("query_id", "agent_id").join(sizes, "agent_id")
    per_block = hits.groupBy("query_id", "block").agg(F.first("compared").alias("compared"))
    counts = [
        exact.agg(F.count("*").alias("n")).withColumn("of", F.lit("exact")),
        found.select(F.col("found").alias("n"), F.lit("found").alias("of")),
        per_block.join(large, "query_id").agg(F.sum("compared").alias("n")).withColumn("of", F.lit("compared")),
        large.agg(F.sum("size").alias("n")).withColumn("of", F.lit("pairs")),
    ]
    named = {n: F.max(F.when(F.col("of") == n, F.col("n"))) for n in ("exact", "found", "compared", "pairs")}
    return reduce(DataFrame.unionByName, counts).agg(
        named["exact"].alias("exact_hits"),
        (named["found"] >= 0.9 * named["exact"]).alias("found_most"),
        F.coalesce(named["compared"] < 0.2 * named["pairs"], F.lit(True)).alias("compared_few"),
    )


_CLUSTERED = _BASE.replace(
    "CAST(embedding AS DOUBLE[]) AS v",
    """list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + CASE WHEN i - 1 = label * 6 % len(embedding)
         THEN 3 ELSE 0 END) AS v""",
)


def _clustered(rows):
    """Vectors with structure: each leans towards an axis of its label."""
    axis = F.col("label") * 6 % F.size("embedding")
    leaning = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == axis, 3.0).otherwise(0.0))
    return rows.withColumn("embedding", leaning)


@query(
    f"""WITH {_CLUSTERED}, {_SEM.format(t=_T, k=5)}
        SELECT count(*) AS exact_hits, true AS found_most, true AS read_few FROM sem"""
)
def index_quality(spark, d):
    """Whether the stored index finds nine tenths of the exact hits in cells that hold under a fifth of the vectors.

    The given vectors have no clusters, so each is moved towards an axis of its label.
    """
    c = durable(_clustered(chunks(spark, d)).select("chunk_id", "agent_id", "label", "embedding"))
    q = durable(
        centroids(c).select(F.concat_ws("-", "label", "agent_id").alias("query_key"), "agent_id", "label", "embedding")
    )
    items = load_table(spark, d, "benchmark", ["item_id"]).withColumn("label", (F.col("item_id") % 10).cast("int"))
    asked = durable(items.join(q, "label").select(F.concat_ws("-", "item_id", "agent_id").alias("query_id"), "agent_id", "embedding"))
    path = scratch_path(spark, "vectors")
    book = V.fit_codebook(c, cells=20)
    V.write_index(c, book, path)
    exact = durable(S.vector_search(asked, c, _T, 5))
    found = V.index_search(asked, path, book, 5, _T, probes=2)
    both = exact.join(found, ["query_id", "chunk_id"]).agg(F.count("*").alias("found"))
    share = V.read_share(path, asked, book, 2).withColumn("one", F.lit(1))
    counts = exact.agg(F.count("*").alias("exact_hits")).withColumn("one", F.lit(1))
    return counts.join(both.withColumn("one", F.lit(1)), "one").join(share, "one").select(
        "exact_hits",
        (F.col("found") >= 0.9 * F.col("exact_hits")).alias("found_most"),
        (F.col("read") < 0.2 * F.col("stored")).alias("read_few"),
    )


@query(
    r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'),
                          lambda s: s <> '') AS t FROM documents),
       w AS (SELECT doc_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM t),
       p AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first, max(pos) AS last FROM w GROUP BY doc_id, term)
       SELECT term, count(*) AS documents, CAST(sum(n) AS BIGINT) AS occurrences,
              CAST(sum(first) AS BIGINT) AS first_sum, CAST(sum(last) AS BIGINT) AS last_sum FROM p GROUP BY term"""
)
def postings(spark, d):
    docs = load_table(spark, d, "documents", ["doc_id", "text"], spread=True)
    p = K.postings(docs, "doc_id", "text", stop_words=False)
    return p.groupBy("term").agg(
        F.count("*").alias("documents"),
        F.sum(F.size("positions")).alias("occurrences"),
        F.sum(F.element_at("positions", 1)).alias("first_sum"),
        F.sum(F.element_at("positions", -1)).alias("last_sum"),
    )


@query(
    r"""WITH t AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'),
                          lambda s: s <> '') AS t FROM documents),
       p AS (SELECT lang, doc_id, term, count(*) AS tf FROM (SELECT lang, doc_id, unnest(t) AS term FROM t) GROUP BY ALL)
       SELECT lang AS agent_id, count(DISTINCT term) AS terms, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS positions,
              CAST(max(tf) AS BIGINT) AS most FROM p GROUP BY lang"""
)
def keyword_index(spark, d):
    """Size of the stored index per site; the first query of a session builds it."""
    built = index(spark, d)
    held = built.postings.groupBy("agent_id").agg(
        F.count("*").alias("postings"), F.sum(F.size("positions")).alias("positions")
    )
    blocks = built.blocks.groupBy("agent_id").agg(
        F.countDistinct("term").alias("terms"), F.max("most").cast("long").alias("most")
    )
    return held.join(blocks, "agent_id").select("agent_id", "terms", "postings", "positions", "most")


@query(
    f"""WITH {_BASE}, {_KW},
        top AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM kw
                QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY keyword_rank DESC, chunk_id) <= 16)
        SELECT query_id, chunk_id, round(keyword_rank, 6) AS keyword_rank, true AS within FROM top"""
)
def keyword_top(spark, d):
    """The best sixteen of each query by block bounds; never more chunks are ranked than match."""
    q, built = queries(spark, d), index(spark, d)
    matches = K.keyword_match(q, built, stop_words=False).groupBy("query_id").agg(F.count("*").alias("n"))
    top = K.keyword_top(q, built, 16, stop_words=False).join(matches, "query_id")
    return top.select(
        "query_id", "chunk_id", F.round("keyword_rank", 6).alias("keyword_rank"), (F.col("ranked") <= F.col("n")).alias("within")
    )


@query(f"WITH {_BASE}, {_KW} SELECT query_id, chunk_id FROM mt")
def keyword_match(spark, d):
    return K.keyword_match(queries(spark, d), index(spark, d), stop_words=False)


_FORMS = r"""
  i AS (SELECT item_id, lang AS agent_id, list_transform([2, 3, 5, 7], lambda k: list_filter(regexp_split_to_array(
          lower(string_split(replace(text, chr(10), ' '), ' ')[k]), '[^\p{L}\p{N}]+'), lambda s: s <> '')[1]) AS q
        FROM benchmark, (SELECT DISTINCT lang FROM documents)),
  has AS (SELECT DISTINCT agent_id, chunk_id, term FROM w),
  phrase AS (SELECT DISTINCT item_id, i.agent_id, x.chunk_id FROM i JOIN w x ON x.agent_id = i.agent_id AND x.term = q[1]
             JOIN w y ON y.chunk_id = x.chunk_id AND y.pos = x.pos + 1 AND y.term = q[2]),
  either AS (SELECT DISTINCT item_id, i.agent_id, chunk_id FROM i JOIN has ON has.agent_id = i.agent_id AND term IN (q[1], q[3])),
  without AS (SELECT item_id, i.agent_id, chunk_id FROM i JOIN has ON has.agent_id = i.agent_id AND term IN (q[1], q[3], q[4])
              GROUP BY ALL HAVING bool_or(term = q[1]) AND bool_or(term = q[4]) AND NOT bool_or(term = q[3]))"""


@query(
    f"""WITH {_KW[: _KW.index('qt AS')].rstrip().rstrip(',')}, {_FORMS}
        SELECT item_id || '-' || agent_id || '-phrase' AS query_id, chunk_id FROM phrase
        UNION ALL SELECT item_id || '-' || agent_id || '-or', chunk_id FROM either
        UNION ALL SELECT item_id || '-' || agent_id || '-not', chunk_id FROM without"""
)
def keyword_match_forms(spark, d):
    """Phrases, alternatives, and three words of which one must not occur."""
    sites = load_table(spark, d, "documents", ["lang"]).distinct().withColumnRenamed("lang", "agent_id")
    items = load_table(spark, d, "benchmark", ["item_id", "text"])
    word = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    w2, w3, w5, w7 = (F.get(word, k - 1) for k in (2, 3, 5, 7))
    quote, space = F.lit('"'), F.lit(" ")
    forms = F.array(
        F.struct(F.lit("phrase").alias("form"), F.concat(quote, w2, space, w3, quote).alias("query_text")),
        F.struct(F.lit("or").alias("form"), F.concat(w2, F.lit(" OR "), w5).alias("query_text")),
        F.struct(F.lit("not").alias("form"), F.concat(w2, F.lit(" -"), w5, space, w7).alias("query_text")),
    )
    asked = items.select("item_id", F.inline(forms))
    asked = asked.withColumn("one", F.lit(1)).join(sites.withColumn("one", F.lit(1)), "one")  # a handful of sites
    asked = asked.select(F.concat_ws("-", "item_id", "agent_id", "form").alias("query_id"), "agent_id", "query_text")
    return K.keyword_match(durable(asked), index(spark, d), stop_words=False)


@query(f"WITH {_BASE}, {_KW} SELECT query_id, chunk_id, round(keyword_rank, 6) AS keyword_rank FROM kw")
def cover_density_rank(spark, d):
    return K.keyword_rank(queries(spark, d), index(spark, d), stop_words=False).withColumn(
        "keyword_rank", F.round("keyword_rank", 6)
    )


@query(
    f"""WITH {_BASE}, {_SEM.format(t=_T, k=16)}, {_KW}
        SELECT query_id, chunk_id, round(similarity, 6) AS similarity,
               round(coalesce(keyword_rank, 0), 6) AS keyword_rank
        FROM sem LEFT JOIN kw USING (query_id, chunk_id)"""
)
def hybrid_join(spark, d):
    q, c = queries(spark, d), chunks(spark, d)
    joined = S.hybrid_join(
        S.vector_search(q, c, _T, 16).drop("rank"),
        K.keyword_rank(q, index(spark, d), stop_words=False),
        ["query_id", "chunk_id"],
    )
    return joined.withColumn("similarity", F.round("similarity", 6)).withColumn(
        "keyword_rank", F.round("keyword_rank", 6)
    )


@query(
    f"""WITH {_hybrid_sql(8)} SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, round(similarity, 6) AS similarity,
          round(keyword_rank, 6) AS keyword_rank, round(score, 6) AS combined_score FROM top"""
)
def hybrid_search(spark, d):
    hits = S.hybrid_search(queries(spark, d), chunks(spark, d), index(spark, d), 8, _T, stop_words=False)
    return hits.select(
        "query_id", "chunk_id", "rank", F.round("similarity", 6).alias("similarity"),
        F.round("keyword_rank", 6).alias("keyword_rank"), F.round("combined_score", 6).alias("combined_score"),
    )


def _pages(spark, d):
    return load_table(spark, d, "pages", ["page_id", "url", "html"]).select(
        "page_id", "url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title")
    )


_PAGES = "p AS (SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages)"


@query(
    f"""WITH {_hybrid_sql(8)}, {_PAGES} SELECT query_id, chunk_id, CAST(rank AS INT) AS rank,
          round(score, 6) AS combined_score, coalesce(url, '') AS url, coalesce(title, '') AS title
        FROM top LEFT JOIN p ON chunk_id = page_id"""
)
def search_knowledge(spark, d):
    hits = R.search_knowledge(queries(spark, d), chunks(spark, d), index(spark, d), _pages(spark, d), "data", _T, stop_words=False)
    return hits.select(
        "query_id", "chunk_id", "rank", F.round("combined_score", 6).alias("combined_score"), "url", "title"
    )


@query(
    f"""WITH {_BASE}, {_SEM.format(t=_T, k=5)}, {_PAGES} SELECT query_id, chunk_id, coalesce(url, '') AS url,
          coalesce(title, '') AS title FROM sem LEFT JOIN p ON chunk_id = page_id"""
)
def attach_pages(spark, d):
    c = chunks(spark, d)
    hits = S.vector_search(queries(spark, d), c, _T, 5).join(c.select("chunk_id", "page_id"), "chunk_id")
    return L.attach_pages(hits, _pages(spark, d)).select("query_id", "chunk_id", "url", "title")


_RANKED = f"""{_BASE}, {_SEM.format(t=_T, k=15)},
  n AS (SELECT query_id, count(*) AS n FROM sem GROUP BY query_id),
  ix AS (SELECT query_id, n, [CAST(n - 1 AS BIGINT), 2, 99, 2, -1, 0, n // 2] AS ix FROM n),
  r AS (SELECT query_id, unnest(ix) AS i, unnest(range(0, 7)) AS place, n FROM ix),
  pl AS (SELECT query_id, i, min(place) AS place FROM r WHERE i >= 0 AND i < n AND n > 6 GROUP BY query_id, i),
  rr AS (SELECT sem.query_id, chunk_id, similarity, row_number() OVER (PARTITION BY sem.query_id
           ORDER BY place NULLS LAST, sem.rank) AS rank
         FROM sem LEFT JOIN pl ON pl.query_id = sem.query_id AND pl.i = sem.rank - 1),
  r6 AS (SELECT * FROM rr WHERE rank <= 6)"""


def _reranked(spark, d):
    c = chunks(spark, d)
    hits = S.vector_search(queries(spark, d), c, _T, 15).withColumn("orig", F.col("rank") - 1).drop("rank")
    n = F.count("*")
    ranking = hits.groupBy("query_id").agg(
        F.array(n - 1, F.lit(2), F.lit(99), F.lit(2), F.lit(-1), F.lit(0), F.floor(n / 2)).alias("indices")
    )
    return L.rerank(hits.join(c.select("chunk_id", "page_id", "snippet", "content"), "chunk_id"), ranking, 6)


@query(f"WITH {_RANKED} SELECT query_id, chunk_id, CAST(rank AS INT) AS rank FROM r6")
def rerank(spark, d):
    return _reranked(spark, d).select("query_id", "chunk_id", "rank")


@query(
    f"""WITH {_RANKED}, {_PAGES} SELECT query_id, chunk_id, url, title,
          CASE WHEN left(text, 40) = '' THEN left(text, 150) ELSE left(text, 40) END AS snippet
        FROM r6 JOIN p ON page_id = chunk_id JOIN documents ON doc_id = chunk_id WHERE rank <= 5"""
)
def citations(spark, d):
    return L.citations(_reranked(spark, d), _pages(spark, d)).select(
        "query_id", "chunk_id", "url", "title", "snippet"
    )


# the same re-ranking over the hybrid hits of the chat preset
_ANSWER = f"""{_hybrid_sql(15)},
  {_RANKED[_RANKED.index("n AS (SELECT query_id"):].replace("sem", "top").replace("similarity", "score")}"""


def _by_place(hits):
    """A list that moves the last hit to the front and names places that do not exist."""
    n = F.count("*")
    indices = F.array(n - 1, F.lit(2), F.lit(99), F.lit(2), F.lit(-1), F.lit(0), F.floor(n / 2))
    return hits.groupBy("query_id").agg(indices.alias("indices"))


@query(
    f"""WITH {_ANSWER}, {_PAGES} SELECT query_id, chunk_id, url, title,
          CASE WHEN left(text, 40) = '' THEN left(text, 150) ELSE left(text, 40) END AS snippet
        FROM r6 JOIN p ON page_id = chunk_id JOIN documents ON doc_id = chunk_id WHERE rank <= 5"""
)
def answer_context(spark, d):
    """The sources of a chat answer: hybrid search, re-ranking, citations."""
    cited = R.answer_context(
        queries(spark, d), chunks(spark, d), index(spark, d), _pages(spark, d), _by_place, _T, stop_words=False
    )
    return cited.select("query_id", "chunk_id", "url", "title", "snippet")


@query(
    f"""WITH w AS (SELECT doc_id, lang, source, len({sql.words('text')}) AS n FROM documents)
        SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE 64 END AS dim, CASE WHEN n = 0 THEN 0.0 ELSE 1.0 END AS norm FROM w"""
)
def embed(spark, d):
    """Vectors of all documents by hashed words; a text without words fails."""
    docs = load_table(spark, d, "documents", ["doc_id", "text"], spread=True)
    out = B.embed(docs, "text", B.hashed_words(64))
    size = F.coalesce(F.size("embedding"), F.lit(0))
    return out.select(
        "doc_id",
        F.when(size > 0, size).otherwise(0).alias("dim"),
        F.coalesce(F.round(norm(F.col("embedding")), 6), F.lit(0.0)).alias("norm"),
    )


_DIM = 16


@query(
    f"""WITH w AS (SELECT doc_id, source, length(text) AS size, {sql.words('text')} AS w FROM documents),
       n AS (SELECT *, floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 100) AS block FROM w),
       f AS (SELECT *, bool_or(size % 97 = 0) OVER (PARTITION BY source, block) OR len(w) = 0 AS failed FROM n),
       g AS (SELECT *, avg(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS lost FROM f),
       r AS (SELECT doc_id, CASE WHEN len(w) = 0 OR size % 97 = 0 OR failed AND lost >= 0.5 THEN [] ELSE
               list_transform(range(0, {_DIM}), lambda i: len(list_filter(w, lambda x: (31 * length(x) + unicode(x)) % {_DIM} = i))) END AS v FROM g),
       s AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM r)
       SELECT doc_id, len(v) AS dim, coalesce(list_sum(list_transform(v, lambda x, i: i * CAST(round(1000 * x / size) AS BIGINT))), 0) AS digest FROM s"""
)
def embed_pages(spark, d):
    """Documents as the chunks of their source; calls that hold a text of a forbidden length fail, and are retried."""
    docs = load_table(spark, d, "documents", ["doc_id", "text", "source"])
    order = Window.partitionBy("source").orderBy("doc_id")
    chunks = docs.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("int"))
    # words as the counterpart splits them
    chunks = chunks.withColumn("text", F.lower("text"))
    out = B.embed_pages(chunks, "text", B.word_shapes(_DIM), page="source")
    weighted = F.transform("embedding", lambda x, i: (i + 1) * F.round(1000 * x).cast("bigint"))
    total = F.aggregate(weighted, F.lit(0).cast("bigint"), lambda a, x: a + x)
    size = F.coalesce(F.size("embedding"), F.lit(0))
    return out.select("doc_id", F.greatest(size, F.lit(0)).alias("dim"), F.coalesce(total, F.lit(0)).alias("digest"))
