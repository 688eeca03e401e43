"""Text, hash and label functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_engine import schema
from corpus_engine.functions import text as T
from corpus_engine.functions import vectors as V
from corpus_engine.registry import query, sql
from corpus_engine.sources.tables import load_table


def _documents(spark, directory, *columns):
    return load_table(spark, directory, "documents", ["doc_id", *(columns or ("text",))], spread=True)


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return _documents(spark, d).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query(f"SELECT doc_id, {sql.norm_hash('text')} AS hash FROM documents")
def normalized_hash(spark, d):
    return _documents(spark, d).select("doc_id", T.normalized_hash(F.col("text")).alias("hash"))


@query(f"SELECT doc_id, {sql.tokens('text')} AS tokens FROM documents")
def estimate_tokens(spark, d):
    return _documents(spark, d).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, {sql.snippet('text')} AS snippet FROM documents")
def snippet(spark, d):
    return _documents(spark, d).select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query(
    "SELECT doc_id, source || ' - ' || lang || ': ' || "
    + sql.trim(
        r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '#{1,6}"
        + T.WS
        + r"', '', 'g'), '\*\*(.*?)\*\*', '\1', 'g'), '\*(.*?)\*', '\1', 'g'), "
        r"'\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '`([^`]+)`', '\1', 'g')"
    )
    + " AS embedding_text FROM documents"
)
def embedding_text(spark, d):
    return _documents(spark, d, "text", "source", "lang").select(
        "doc_id",
        T.embedding_text(F.col("text"), F.col("source"), F.col("lang")).alias("embedding_text"),
    )


@query(
    f"""WITH w AS (SELECT doc_id, {sql.words('text')} AS w FROM documents),
    s AS (SELECT doc_id, {sql.shingles('w')} AS s FROM w)
    SELECT doc_id, CAST(len(s) AS INT) AS shingles,
           md5(array_to_string(list_sort(s), '|')) AS digest FROM s"""
)
def shingles(spark, d):
    return (
        _documents(spark, d)
        .select("doc_id", T.shingles(F.col("text")).alias("s"))
        .select(
            "doc_id",
            F.size("s").alias("shingles"),
            F.md5(F.array_join(F.sort_array("s"), "|")).alias("digest"),
        )
    )


@query(
    f"""WITH w AS (SELECT doc_id, {sql.words('text')} AS a, {sql.words('left(text, length(text) // 2)')} AS b
                  FROM documents),
    s AS (SELECT doc_id, {sql.shingles('a')} AS a, {sql.shingles('b')} AS b FROM w)
    SELECT doc_id, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE
      CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))) END, 6) AS jaccard
    FROM s"""
)
def jaccard(spark, d):
    half = F.left(F.col("text"), F.floor(F.length(F.col("text")) / 2).cast("int"))
    return (
        _documents(spark, d)
        .select("doc_id", T.shingles(F.col("text")).alias("a"), T.shingles(half).alias("b"))
        .select("doc_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))
    )


@query(f"SELECT doc_id, {sql.boilerplate('text')} AS boilerplate FROM documents")
def is_likely_boilerplate(spark, d):
    return _documents(spark, d).select("doc_id", T.is_likely_boilerplate(F.col("text")).alias("boilerplate"))


@query(
    """SELECT code, CASE WHEN code LIKE 'en%' THEN 'english' WHEN code LIKE 'de%' THEN 'german'
         WHEN code LIKE 'fr%' THEN 'french' WHEN code LIKE 'es%' THEN 'spanish'
         ELSE 'simple' END AS config, count(*) AS documents
       FROM (SELECT lang || '-' || source AS code FROM documents
             UNION ALL SELECT source FROM documents) GROUP BY 1, 2"""
)
def fts_language(spark, d):
    codes = _documents(spark, d, "lang", "source").select(
        F.explode(F.array(F.concat_ws("-", "lang", "source"), F.col("source"))).alias("code")
    )
    return codes.groupBy("code", T.fts_language(F.col("code")).alias("config")).agg(
        F.count("*").alias("documents")
    )


@query(
    "SELECT doc_id, "
    + sql.trim("left(translate(text, '\"\\' || chr(10) || chr(13), '    '), 200)")
    + " AS value FROM documents"
)
def sanitize_value(spark, d):
    return _documents(spark, d).select("doc_id", T.sanitize_value(F.col("text")).alias("value"))


@query(
    "SELECT conv_id, turn, "
    + " OR ".join(f"contains(lower(text), '{w}')" for w in T.FRESHNESS_WORDS)
    + " AS fresh FROM conversations"
)
def needs_fresh_data(spark, d):
    turns = load_table(spark, d, "conversations", ["conv_id", "turn", "text"])
    return turns.select("conv_id", "turn", T.needs_fresh_data(F.col("text")).alias("fresh"))


@query(
    "SELECT doc_id, CASE WHEN text = '' THEN true WHEN "
    + " OR ".join(f"contains(lower(text), '{w}')" for w in T.BROWSER_TOKENS)
    + " THEN false ELSE "
    + " OR ".join(f"contains(lower(text), '{w}')" for w in T.BOT_TOKENS)
    + " END AS bot FROM documents"
)
def is_likely_bot(spark, d):
    return _documents(spark, d).select("doc_id", T.is_likely_bot(F.col("text")).alias("bot"))


@query(
    """SELECT event_id, CASE event_type
         WHEN 'click' THEN '10.0.' || user_id || '.7'
         WHEN 'error' THEN '192.168.0.' || user_id
         WHEN 'signup' THEN '127.0.0.1' ELSE 'fe80::' || user_id END AS ip
       FROM events"""
)
def client_ip(spark, d):
    events = load_table(spark, d, "events", ["event_id", "event_type", "user_id"])
    kind = F.col("event_type")
    forwarded = (
        F.when(kind == "click", F.concat(F.lit(" 10.0."), F.col("user_id"), F.lit(".7, 10.1.1.1")))
        .when(kind.isin("view", "purchase"), F.concat(F.lit("fe80::"), F.col("user_id")))
        .when(kind == "error", F.lit("unknown, 10.1.1.1"))
    )
    real = F.when(kind == "error", F.concat(F.lit("192.168.0."), F.col("user_id"))).otherwise(F.lit("n/a"))
    return events.select("event_id", T.client_ip(forwarded, real).alias("ip"))


@query(
    """SELECT CASE WHEN value / 20 >= 0.7 THEN 'high' WHEN value / 20 >= 0.4 THEN 'medium'
         ELSE 'low' END AS band, CAST(floor(value / 20 * 100 + 0.5) AS BIGINT) AS percent,
         count(*) AS events FROM events GROUP BY 1, 2"""
)
def confidence_band(spark, d):
    c = F.col("value") / 20
    return (
        load_table(spark, d, "events", ["value"])
        .groupBy(T.confidence_band(c).alias("band"), T.confidence_percent(c).alias("percent"))
        .agg(F.count("*").alias("events"))
    )


@query(
    """SELECT p_partkey, replace(p_brand, 'gemini-', '') || '-' || lower(p_type) || '-gemini-x' AS label
       FROM part"""
)
def model_label(spark, d):
    name = F.concat(F.lit("gemini-"), "p_brand", F.lit("-"), F.lower("p_type"), F.lit("-preview-gemini-x"))
    return load_table(spark, d, "part", ["p_partkey", "p_brand", "p_type"]).select(
        "p_partkey", T.model_label(name).alias("label")
    )


@query("SELECT conv_id, turn, left(text, 100) AS title FROM conversations")
def conversation_title(spark, d):
    return load_table(spark, d, "conversations", ["conv_id", "turn", "text"]).select(
        "conv_id", "turn", T.conversation_title(F.col("text")).alias("title")
    )


@query(
    """SELECT event_id,
         CASE event_type WHEN 'click' THEN 'a' || event_id WHEN 'view' THEN '' ELSE event_type END AS answer,
         CASE event_type WHEN 'click' THEN round(value / 20, 6) ELSE 0.5 END AS confidence,
         event_type <> 'click' AS sources_only, event_type = 'view' AS needs_recrawl,
         CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS citations
       FROM events"""
)
def parse_structured_answer(spark, d):
    kind = F.col("event_type")
    raw = (
        F.when(
            kind == "click",
            F.concat(
                F.lit('{"answer": "a'), F.col("event_id"), F.lit('", "confidence": '), F.col("value") / 20,
                F.lit(', "answered_from_sources_only": false, "citations": [{"url": "u"}]}'),
            ),
        )
        .when(kind == "view", F.lit('{"confidence": "high", "needs_recrawl": true}'))
        .otherwise(kind)
    )
    answer = load_table(spark, d, "events", ["event_id", "event_type", "value"]).select(
        "event_id", T.parse_structured_answer(raw).alias("a")
    )
    return answer.select(
        "event_id",
        "a.answer",
        F.round("a.confidence", 6).alias("confidence"),
        F.col("a.answered_from_sources_only").alias("sources_only"),
        F.col("a.needs_recrawl").alias("needs_recrawl"),
        F.size("a.citations").alias("citations"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def extract_props(spark, d):
    return load_table(spark, d, "events", ["event_id", "props"]).select(
        "event_id", T.extract_prop(F.col("props"), "k", "bigint").alias("k")
    )


@query(
    """WITH v AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (label + 1))) AS x,
                        unnest(range(0, len(embedding))) AS pos FROM embeddings),
       n AS (SELECT vec_id, sqrt(sum(x * x)) AS size FROM v GROUP BY vec_id)
       SELECT vec_id, CAST(pos AS INT) AS pos, round(x / size, 6) AS value FROM v JOIN n USING (vec_id)"""
)
def normalize_vector(spark, d):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 1))
    return (
        load_table(spark, d, "embeddings", ["vec_id", "embedding", "label"])
        .select("vec_id", F.posexplode(V.normalize_vector(scaled)).alias("pos", "value"))
        .select("vec_id", "pos", F.round("value", 6).alias("value"))
    )


@query("SELECT vec_id, len(embedding) = 64 AS valid FROM embeddings")
def valid_embedding(spark, d):
    return load_table(spark, d, "embeddings", ["vec_id", "embedding"]).select(
        "vec_id", V.valid_embedding(F.col("embedding"), 64).alias("valid")
    )


@query(
    """SELECT role, event_type, hours, count(*) AS n,
         concat_ws(',', CASE WHEN role NOT IN ('user', 'assistant', 'system') THEN 'role' END,
           CASE WHEN event_type NOT IN ('chat', 'crawl', 'embed', 'share_view', 'agent_created') THEN 'event_type' END,
           CASE WHEN hours NOT BETWEEN 1 AND 8760 THEN 'hours' END) AS violations
       FROM (SELECT role, 'chat' AS event_type, CAST(turn AS BIGINT) AS hours FROM conversations
             UNION ALL SELECT 'user', event_type, user_id FROM events)
       GROUP BY ALL"""
)
def validate_enums(spark, d):
    turns = load_table(spark, d, "conversations", ["role", "turn"]).select(
        "role", F.lit("chat").alias("event_type"), F.col("turn").alias("hours")
    )
    events = load_table(spark, d, "events", ["event_type", "user_id"]).select(
        F.lit("user").alias("role"), "event_type", F.col("user_id").alias("hours")
    )
    counted = turns.unionByName(events).groupBy("role", "event_type", "hours").agg(F.count("*").alias("n"))
    checked = schema.validate_enums(
        counted,
        {"role": "message_role", "event_type": "usage_event"},
        {"hours": schema.FREQUENCY_HOURS},
    )
    return checked.withColumn("violations", F.array_join("violations", ","))


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                        unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents),
       k AS (SELECT *, {sql.trim('line')} AS t,
               row_number() OVER (PARTITION BY doc_id, {sql.trim('line')} ORDER BY pos) AS rn FROM l)
       SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest, count(*) AS lines
       FROM k WHERE rn = 1 OR t = '' GROUP BY doc_id"""
)
def dedupe_lines(spark, d):
    clean = T.dedupe_lines(F.col("text"))
    return (
        _documents(spark, d)
        .select("doc_id", clean.alias("clean"))
        .select(
            "doc_id",
            F.md5("clean").alias("digest"),
            F.size(F.split("clean", "\n")).cast("bigint").alias("lines"),
        )
    )


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1998-01-01'")
def load_table_filtered(spark, d):
    """A scan whose filter and columns reach the Parquet reader."""
    late = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    return load_table(spark, d, "orders", ["o_orderkey", "o_totalprice"], (F.col("o_orderstatus") == "F") & late)
