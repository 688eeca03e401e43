"""The operators of this subpackage as queries with production parameters."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.llm import (
    byte_bpe,
    chat_format,
    context_tree,
    decontamination,
    html_extraction,
    language_id,
    lexical_search,
    ngram_join,
    quality,
    structure_repair,
    suffix_dedup,
    token_counts,
    toxicity,
)
from corpus_engine.llm.common import remainder
from corpus_engine.runtime import durable
from corpus_engine.sources.tables import load_table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKEN_LIMIT = 4096

QUERIES = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = load_table(spark, d, "documents", ["doc_id", "text"])
    counted = token_counts.count_tokens(docs, PIECES)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query
def op2_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    docs = load_table(spark, d, "documents", ["doc_id", "text"])
    encoded = byte_bpe.encode_texts(docs, BYTE_RANKS, public_tokenizers.PATTERN).drop("text")
    decoded = byte_bpe.decode_ids(encoded, BYTE_RANKS, public_tokenizers.PATTERN)
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = load_table(spark, d, "documents", ["doc_id", "text"])
    cut = suffix_dedup.remove_repeats(docs)
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return cut.select(
        "doc_id",
        n_bytes.alias("n_bytes"),
        (n_bytes - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op4_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = load_table(spark, d, "documents", ["doc_id", "text", "lang"])
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = language_id.fit(docs, ~held_out, PIECES, order=F.xxhash64("doc_id", "text"))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op5_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = load_table(spark, d, "documents", ["doc_id", "text", "lang", "source"])
    return quality.judge(docs).drop("lang", "source")


@query
def op6_context_tree(spark: SparkSession, d: str) -> DataFrame:
    docs = load_table(spark, d, "documents", ["doc_id", "text"])
    held_out = remainder(F.col("doc_id"), 7) == 2
    model = context_tree.fit(docs, ~held_out)
    scored = context_tree.score_texts(docs.withColumn("held_out", held_out), model)
    return scored


@query
def op7_decontamination(spark: SparkSession, d: str) -> DataFrame:
    docs = load_table(spark, d, "documents", ["doc_id", "text"])
    benchmark = load_table(spark, d, "benchmark", ["item_id", "text"])
    judged = decontamination.decontaminate(docs, benchmark)
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


SQL["op7_decontamination"] = decontamination.ORACLE


def fit_toxicity(spark: SparkSession, documents: DataFrame, d: str):
    """A network from the labels of documents that are not held out."""
    labels = load_table(spark, d, "labels", ["doc_id", "toxic"])
    return toxicity.fit(documents, labels, remainder(F.col("doc_id"), 5) != 0)


@query
def op8_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    docs = load_table(spark, d, "documents", ["doc_id", "text"])
    return ngram_join.near_copies(docs).select("doc_id", "class_id", "n_links")


@query
def op9_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = load_table(spark, d, "documents", ["doc_id", "text", "lang"])
    scored = toxicity.score_texts(docs.drop("lang"), fit_toxicity(spark, docs, d))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query
def op10_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    pages = load_table(spark, d, "pages", ["page_id", "url", "html"])
    extracted = html_extraction.extract(pages, html_extraction.fit(pages))
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: A conversation whose texts look like the template's own control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query
def op11_chat_format(spark: SparkSession, d: str) -> DataFrame:
    rows = load_table(spark, d, "conversations", ["conv_id", "turn", "role", "text"])
    control = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], rows.schema)
    windows = chat_format.format_conversations(rows.unionByName(control), PIECES)
    return chat_format.read_back(windows)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with a fault in five of twenty, chosen by a checksum of their key."""
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    rows = rows.select("conv_id", "turn", *(F.coalesce(c, space).alias(c) for c in ("role", "text")))
    rows = rows.withColumn("fault", F.crc32(key.cast("binary")) % 20).filter("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
    rows = rows.withColumn("text", text.otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    copies = F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))
    return rows.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")


@query
def op12_structure_repair(spark: SparkSession, d: str) -> DataFrame:
    original = load_table(spark, d, "conversations", ["conv_id", "turn", "role", "text"])
    rows = damaged(original)
    plans = durable(structure_repair.plan_repairs(rows))
    digests = structure_repair.conversation_digests(structure_repair.apply_repairs(rows, plans))
    ids = original.select(F.col("conv_id").alias("id")).distinct()
    found = plans.drop("edits", "inserted").withColumnRenamed("conv_id", "plan_id")
    out = ids.join(found, ids.id.eqNullSafe(found.plan_id), "left").join(
        digests, ids.id.eqNullSafe(digests.conv_id), "left"
    )
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        F.col("id").alias("conv_id"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


@query
def op13_lexical_search(spark: SparkSession, d: str) -> DataFrame:
    docs = load_table(spark, d, "documents", ["doc_id", "text"])
    items = load_table(spark, d, "benchmark", ["item_id", "text"])
    return lexical_search.search(lexical_search.build_index(docs), items)


SQL["op13_lexical_search"] = lexical_search.ORACLE


@query
def pipeline(spark: SparkSession, d: str) -> DataFrame:
    return corpus_pipeline.run(spark, d)


if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
