"""Keyword postings, web-style matching and proximity ranks.

Words are matched as they are, without stemming, so ranks are close to but not
the same as those of a database with stemmers.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpus_engine.functions.collections import let
from corpus_engine.functions.text import fts_language
from corpus_engine.runtime import durable, top_per_group

_NOT_WORD = r"[^\p{L}\p{N}]+"
_CLAUSE = r'-?"[^"]*"|\S+'

#: Blocks of each length stratum of a stored index.
BLOCKS = 16
#: Query terms up to which the Parquet reader is told their names; the join decides in any case.
NAMED_TERMS = 2000
#: Possible matches up to which one pass over all of them costs less than two passes by bounds.
RANK_ALL = 1_000_000

# Fixed value: weight of an occurrence in the default class.
WEIGHT = 0.1

# text search configurations for which Spark ships stop words
STOP_WORD_CONFIGS = (
    "danish", "dutch", "english", "finnish", "french", "german", "hungarian", "italian",
    "norwegian", "portuguese", "russian", "spanish", "swedish", "turkish",
)


def tokens(text: Column) -> Column:
    """Lower-case words in order."""
    return F.filter(F.split(F.lower(text), _NOT_WORD), lambda w: w != "")


def stop_word_table(spark: SparkSession) -> DataFrame:
    """``(config, term)``; a fixed vocabulary of some three thousand words."""
    rows = [
        (config, word)
        for config in STOP_WORD_CONFIGS
        for word in StopWordsRemover.loadDefaultStopWords(config)
    ]
    return spark.createDataFrame(rows, "config string, term string")


def _runs(ordered: Column) -> Column:
    """``(term, positions)`` of each term of an array of ``(term, pos)`` in order."""
    begins = F.transform(
        ordered, lambda x, i: F.when((i == 0) | (F.get(ordered, i - 1)["term"] != x["term"]), i + 1)
    )

    def cut(starts: Column) -> Column:
        def run(begin: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(ordered) + 1)
            places = F.transform(F.slice(ordered, begin, end - begin), lambda x: x["pos"])
            return F.struct(F.get(ordered, begin - 1)["term"].alias("term"), places.alias("positions"))

        return F.transform(starts, run)

    return let(F.filter(begins, lambda i: i.isNotNull()), cut)


def term_positions(
    chunks: DataFrame, keep: list[str], text_col: str = "content", stop_words: bool = True
) -> DataFrame:
    """``keep``, ``term`` and its sorted ``positions`` (from 1); stop words keep their positions.

    A chunk's words combine within its row, by one sort, and nothing is moved. Only rows
    that are equal in ``keep`` are brought together afterwards.
    """
    config = fts_language(F.col("language")) if stop_words else F.lit("simple")

    def of(some: DataFrame) -> DataFrame:
        placed = F.transform(tokens(F.col(text_col)), lambda w, i: F.struct(w.alias("term"), (i + 1).alias("pos")))
        rows = some.select(*keep, config.alias("config"), F.explode_outer(let(F.sort_array(placed), _runs)).alias("_run"))
        rows = rows.filter(F.col("_run").isNotNull()).select(*keep, "config", "_run.*")
        if stop_words:
            # a fixed vocabulary, so the broadcast cannot grow with the data
            rows = rows.join(F.broadcast(stop_word_table(chunks.sparkSession)), ["config", "term"], "left_anti")
        return rows.select(*keep, "term", "positions")

    repeated = chunks.groupBy(*keep).count().filter("count > 1").drop("count")
    repeated = durable(repeated.toDF(*[f"_{i}" for i in range(len(keep))]))
    if repeated.isEmpty():
        return of(chunks)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(keep)])
    merged = (
        of(chunks.join(repeated, same, "left_semi"))
        .groupBy(*keep, "term")
        .agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    )
    return of(chunks.join(repeated, same, "left_anti")).unionByName(merged)


def postings(
    chunks: DataFrame, chunk_id: str = "chunk_id", text_col: str = "content", stop_words: bool = True
) -> DataFrame:
    """``(chunk_id, term, positions)``; the words of a chunk combine in its map task."""
    return term_positions(chunks, [chunk_id], text_col, stop_words)


def query_clauses(queries: DataFrame, stop_words: bool = True) -> DataFrame:
    """Web-style query text as rows of clause terms.

    Unquoted words must all occur, quoted phrases must occur word for word,
    ``or`` separates alternatives and a leading ``-`` excludes.
    """
    pieces = F.regexp_extract_all("query_text", F.lit(_CLAUSE), F.lit(0))

    def numbered(ps: Column) -> Column:
        rows = F.transform(
            ps,
            lambda p, i: F.struct(
                F.size(F.filter(F.slice(ps, F.lit(1), i), lambda x: F.lower(x) == "or")).alias("group_no"),
                p.startswith("-").alias("negated"),
                tokens(p).alias("terms"),
                (F.lower(p) == "or").alias("is_or"),
            ),
        )
        return F.array_distinct(F.filter(rows, lambda r: ~r["is_or"] & (F.size(r["terms"]) > 0)))

    clauses = queries.select(
        "query_id", "agent_id", F.posexplode(let(pieces, numbered)).alias("clause_no", "c")
    ).select("query_id", "agent_id", "clause_no", "c.group_no", "c.negated", "c.terms")
    terms = clauses.select(
        "*", F.posexplode("terms").alias("offset", "term")
    ).drop("terms")
    if stop_words:
        # queries are read as English whatever the chunk language
        english = stop_word_table(queries.sparkSession).filter("config = 'english'").select("term")
        terms = terms.join(F.broadcast(english), "term", "left_anti")
    sizes = terms.groupBy("query_id", "clause_no").agg(F.count("*").alias("n_terms"))
    needed = (
        terms.filter(~F.col("negated"))
        .groupBy("query_id", "group_no")
        .agg(F.countDistinct("clause_no").alias("n_clauses"))
    )
    return terms.join(sizes, ["query_id", "clause_no"]).join(needed, ["query_id", "group_no"])


@dataclass(frozen=True)
class KeywordIndex:
    """A stored index: postings in the order of term, site and block, and a summary of each block."""

    postings: DataFrame  # agent_id, term, block, chunk_id, positions
    blocks: DataFrame  # agent_id, term, block, chunks, most: the highest number of occurrences


def _block(words: Column, chunk_id: Column) -> Column:
    """Chunks of like length share blocks, so that a block's highest count says something."""
    stratum = F.floor(4 * F.log2(words + 1)).cast("int")
    return stratum * BLOCKS + F.pmod(F.xxhash64(chunk_id), F.lit(BLOCKS)).cast("int")


def build_index(chunks: DataFrame, text_col: str = "content", stop_words: bool = True) -> DataFrame:
    """Postings of every chunk: ``(agent_id, term, block, chunk_id, positions)``."""
    placed = chunks.withColumn("block", _block(F.length(text_col), F.col("chunk_id")))
    rows = term_positions(placed, ["chunk_id", "agent_id", "block"], text_col, stop_words)
    return rows.select("agent_id", "term", "block", "chunk_id", "positions")


def write_index(index: DataFrame, path: str) -> KeywordIndex:
    """Store postings sorted by term and site within each file, in as many files as they fill.

    Row-group statistics then tell which parts hold a term. The summary has a row per
    (site, term, block). Rows are dealt by hash: ranges would be sampled first, and each
    sample takes all texts apart once more. A term's blocks are spread, so a frequent
    term is not one task's.
    """
    # terms first: they differ early, which makes the sort cheap
    spark, order = index.sparkSession, ["term", "agent_id", "block"]
    index.repartition(*order).sortWithinPartitions(*order).write.parquet(f"{path}/postings")
    postings = spark.read.schema(index.schema).parquet(f"{path}/postings")
    count = F.count("*").alias("chunks"), F.max(F.size("positions")).alias("most")
    blocks = postings.groupBy(*order).agg(*count)
    blocks.sortWithinPartitions(*order).write.parquet(f"{path}/blocks")
    return KeywordIndex(postings, spark.read.parquet(f"{path}/blocks"))


def _asked(queries: DataFrame, stop_words: bool) -> DataFrame:
    """Query terms with ``required``, the number of terms an alternative needs."""
    terms = query_clauses(queries, stop_words)
    required = F.count_if(~F.col("negated")).over(Window.partitionBy("query_id", "group_no"))
    return durable(terms.withColumn("required", required))


def _of_terms(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Index rows of the query terms; few terms are named to the Parquet reader."""
    some = asked.select("term").distinct().limit(NAMED_TERMS + 1).collect()
    return rows.filter(F.col("term").isin([r.term for r in some])) if len(some) <= NAMED_TERMS else rows


def _key(agent_id: Column, term: Column) -> Column:
    """A site's term as one string; a term holds no space, so no two are equal."""
    return F.concat(agent_id.cast("string"), F.lit(" "), term)


def _plans(asked: DataFrame, index: KeywordIndex) -> DataFrame:
    """``(query_id, anchors, groups)``: what a chunk must hold, one row per query.

    The anchor of an alternative is the needed term that the fewest chunks hold; a chunk
    without it cannot match, so chunks and queries meet on anchors only.
    """
    held = _of_terms(index.blocks, asked).groupBy("agent_id", "term").agg(F.sum("chunks").alias("held"))
    entries = asked.join(held, ["agent_id", "term"], "left").withColumn("key", _key(F.col("agent_id"), F.col("term")))
    group = ["query_id", "group_no", "n_clauses", "required"]
    rarity = F.struct(F.coalesce("held", F.lit(0)).alias("held"), "key")
    clauses = entries.groupBy(*group, "clause_no", "negated", "n_terms").agg(
        F.collect_list(F.struct("key", "offset")).alias("terms"), F.min(F.when(~F.col("negated"), rarity)).alias("rare")
    )
    needed = F.flatten(F.collect_list(F.when(~F.col("negated"), F.col("terms")["key"])))
    groups = clauses.groupBy(*group).agg(
        F.collect_list(F.struct("clause_no", "negated", "n_terms", "terms")).alias("clauses"),
        needed.alias("needed"),
        F.min("rare")["key"].alias("anchor"),
    )
    return durable(
        groups.groupBy("query_id").agg(
            F.collect_set("anchor").alias("anchors"),
            F.collect_list(F.struct("n_clauses", "required", "needed", "clauses")).alias("groups"),
        )
    )


def _held(asked: DataFrame, index: KeywordIndex, plans: DataFrame, picks: DataFrame | None) -> DataFrame:
    """``(chunk_id, blocks, keys, back, places, key)``: the asked terms of each chunk, a row for each anchor among them.

    ``keys`` are sorted, ``places`` are their positions and ``back`` are the keys from the end.
    """
    on = ["agent_id", "term"] if picks is None else ["agent_id", "term", "block"]
    terms = (asked if picks is None else asked.join(picks, "query_id")).select(*on).distinct()
    anchors = plans.select(F.explode("anchors").alias("key")).distinct().withColumn("anchor", F.lit(True))
    terms = terms.withColumn("key", _key(F.col("agent_id"), F.col("term"))).join(anchors, "key", "left")
    rows = _of_terms(index.postings, asked).join(durable(terms), on)
    # each posting moves once, however many queries ask for it
    held = (
        rows.select("chunk_id", "block", "key", "anchor", "positions")
        .repartition("chunk_id")
        .groupBy("chunk_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("key", "positions"))).alias("held"),
            F.collect_set(F.when(F.col("anchor"), F.col("key"))).alias("anchors"),
            F.collect_set("block").alias("blocks"),
        )
    )
    keys = F.col("held")["key"]
    held = held.select(
        "chunk_id", "blocks", "anchors", keys.alias("keys"), F.reverse(keys).alias("back"), F.col("held")["positions"].alias("places")
    )
    return held.select("chunk_id", "blocks", "keys", "back", "places", F.explode_outer("anchors").alias("key"))


def _evaluated(
    asked: DataFrame,
    index: KeywordIndex,
    value: Callable[[Column], Column],
    picks: DataFrame | None = None,
    floors: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, chunk_id, value)`` of all matches: the sum of ``value`` over the alternatives that match.

    ``value`` gets the sorted ``(start, clause_no)`` of an alternative's clauses. A match is
    found within the row of its chunk; no pair of a query and a chunk is moved or grouped.
    Few queries reach the chunks as a broadcast. ``picks`` (query_id, block) names the
    blocks to look into. ``floors`` (query_id, floor) drops chunks whose counts rule out
    that rank before any position is looked at.
    """
    plans = _plans(asked, index)
    held = _held(asked, index, plans, picks)
    wanted = plans
    if picks is not None:
        wanted = wanted.join(picks.groupBy("query_id").agg(F.collect_set("block").alias("picked")), "query_id")
    if floors is not None:
        wanted = wanted.join(floors, "query_id")
    wanted = durable(wanted.withColumn("key", F.explode("anchors")))
    pairs = held.join(wanted, "key")
    # a chunk that holds several anchors of a query meets it once
    pairs = pairs.filter(F.get(F.filter("anchors", lambda a: F.array_contains("keys", a)), 0) == F.col("key"))
    if picks is not None:
        pairs = pairs.filter(F.arrays_overlap("blocks", "picked"))

    def lists(key: Column) -> Column:
        """Positions of a key, one list for each row of the index."""
        first = F.array_position("keys", key)
        run = F.size("keys") + 2 - F.array_position("back", key) - first
        return F.when(first > 0, F.slice("places", first.cast("int"), run.cast("int"))).otherwise(
            F.array().cast("array<array<int>>")
        )

    def starts(clause: Column) -> Column:
        """Where all terms of a clause are in their places."""
        each = F.transform(
            clause["terms"], lambda t: F.transform(F.flatten(lists(t["key"])), lambda p: p - t["offset"])
        )
        n = clause["n_terms"].cast("int")

        def whole(ordered: Column) -> Column:
            def first_of_n(x: Column, i: Column) -> Column:
                end = F.get(ordered, i + n - 1).eqNullSafe(x) & ~F.get(ordered, i + n).eqNullSafe(x)
                return end & ~F.get(ordered, i - 1).eqNullSafe(x)

            return F.filter(ordered, first_of_n)

        return let(F.sort_array(F.flatten(each)), whole)

    def of_group(group: Column) -> Column:
        def judged(clauses: Column) -> Column:
            here = F.filter(clauses, lambda c: ~c["negated"] & (F.size(c["starts"]) > 0))
            excluded = F.exists(clauses, lambda c: c["negated"] & (F.size(c["starts"]) > 0))
            found = F.size(F.array_distinct(F.transform(here, lambda c: c["clause_no"]))) == group["n_clauses"]

            def entry(c: Column) -> Column:
                return F.transform(c["starts"], lambda s: F.struct(s.alias("start"), c["clause_no"].alias("clause_no")))

            return F.when(~excluded & found, value(F.sort_array(F.flatten(F.transform(here, entry)))))

        def placed(c: Column) -> Column:
            return F.struct(c["clause_no"].alias("clause_no"), c["negated"].alias("negated"), starts(c).alias("starts"))

        return let(F.transform(group["clauses"], placed), judged)

    def present(group: Column) -> Column:
        return F.aggregate(group["needed"], F.lit(0), lambda n, key: n + F.size(lists(key)))

    def bound(group: Column) -> Column:
        least = F.array_min(F.flatten(F.transform(group["needed"], lambda k: F.transform(lists(k), F.size))))
        return rank_bound(group["n_clauses"], least)

    def total(values: Column) -> Column:
        return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x))

    def of_chunk(complete: Column) -> Column:
        def matching() -> Column:
            return let(F.filter(F.transform(complete, of_group), lambda v: v.isNotNull()), total)

        if floors is None:
            return matching()
        return F.when(F.aggregate(complete, F.lit(0.0), lambda a, g: a + bound(g)) >= F.col("floor"), matching())

    complete = F.filter("groups", lambda g: present(g) == g["required"])
    # the outer form computes the value once
    found = pairs.select("query_id", "chunk_id", F.explode_outer(F.array(let(complete, of_chunk))).alias("value"))
    return found.filter(F.col("value").isNotNull())


def rank_bound(n_clauses: Column, least: Column) -> Column:
    """The highest rank that counts allow, a little rounded up.

    A cover weighs at most ``WEIGHT``. One occurrence of the rarest term lies in at most
    as many minimal covers as there are clauses.
    """
    return WEIGHT * n_clauses * least * (1 + 1e-9)


def keyword_match(queries: DataFrame, index: KeywordIndex, stop_words: bool = True) -> DataFrame:
    """``(query_id, chunk_id)`` of all indexed chunks that satisfy a query."""
    return _evaluated(_asked(queries, stop_words), index, lambda entries: F.lit(0.0)).select("query_id", "chunk_id")


def cover_density(entries: Column) -> Column:
    """Sum over minimal covers of ``weight / (1 + words between the hits)``.

    A cover is a shortest stretch that holds every clause. One pass keeps the
    last hit of each clause; a cover ends where the oldest of them moves on.
    """

    def covers(es: Column) -> Column:
        clauses = F.array_distinct(F.transform(es, lambda e: e["clause_no"]))
        none = F.lit(None).cast("struct<pos: int, i: int>")
        start = F.struct(
            F.transform(clauses, lambda c: F.struct(c.alias("clause_no"), none.alias("at"))).alias("last"),
            F.lit(-(1 << 30)).alias("begin"),
            F.lit(0).alias("i"),
            F.lit(0.0).alias("score"),
        )

        def step(acc: Column, e: Column) -> Column:
            here = F.struct(e["start"].alias("pos"), acc["i"].alias("i"))
            last = F.transform(
                acc["last"],
                lambda l: F.struct(
                    l["clause_no"].alias("clause_no"),
                    F.when(l["clause_no"] == e["clause_no"], here).otherwise(l["at"]).alias("at"),
                ),
            )
            return let(last, lambda ls: advance(acc, e, ls))

        def advance(acc: Column, e: Column, ls: Column) -> Column:
            complete = ~F.exists(ls, lambda l: l["at"].isNull())
            oldest = F.array_min(F.transform(ls, lambda l: l["at"]))
            gap = (e["start"] - oldest["pos"]) - (acc["i"] - oldest["i"])
            noise = F.when(gap < 0, (acc["i"] - oldest["i"]) / 2).otherwise(gap.cast("double"))
            new = complete & (oldest["pos"] > acc["begin"])
            return F.struct(
                ls.alias("last"),
                F.when(new, oldest["pos"]).otherwise(acc["begin"]).alias("begin"),
                (acc["i"] + 1).alias("i"),
                (acc["score"] + F.when(new, WEIGHT / (noise + 1)).otherwise(F.lit(0.0))).alias("score"),
            )

        return F.aggregate(es, start, step, lambda acc: acc["score"])

    return let(entries, covers)


def _ranked(
    asked: DataFrame, index: KeywordIndex, picks: DataFrame | None = None, floors: DataFrame | None = None
) -> DataFrame:
    return _evaluated(asked, index, cover_density, picks, floors).withColumnRenamed("value", "keyword_rank")


def keyword_rank(queries: DataFrame, index: KeywordIndex, stop_words: bool = True) -> DataFrame:
    """``(query_id, chunk_id, keyword_rank)`` of all matching indexed chunks."""
    return _ranked(_asked(queries, stop_words), index)


def keyword_top(queries: DataFrame, index: KeywordIndex, k: int, stop_words: bool = True) -> DataFrame:
    """``(query_id, chunk_id, keyword_rank, ranked)``: the ``k`` best of :func:`keyword_rank` by block bounds.

    The summary bounds the ranks of each block. The blocks with the highest bounds are
    ranked until they may hold ``2k`` matches; of the others only those blocks, and in
    them those chunks, are ranked whose bound reaches the k-th rank found. Equal ranks
    go by chunk. ``ranked`` counts the chunks that were ranked for the query. Where the
    summary promises at most ``RANK_ALL`` matches in all, they are ranked in one pass.
    """
    asked = _asked(queries, stop_words)
    blocks = _of_terms(index.blocks, asked)
    bounds = (
        blocks.join(asked.filter("not negated"), ["agent_id", "term"])
        .groupBy("query_id", "group_no", "n_clauses", "required", "block")
        .agg(F.count("*").alias("present"), F.min("most").alias("least"), F.min("chunks").alias("chunks"))
        .filter(F.col("present") == F.col("required"))
        .groupBy("query_id", "block")
        .agg(F.sum(rank_bound(F.col("n_clauses"), F.col("least"))).alias("bound"), F.max("chunks").alias("chunks"))
    )
    best = [F.col("keyword_rank").desc(), F.col("chunk_id")]
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    bounds = durable(bounds.withColumn("before", F.sum("chunks").over(order) - F.col("chunks")))
    if (bounds.agg(F.sum("chunks")).first()[0] or 0) <= RANK_ALL:
        found = _ranked(asked, index).withColumn("ranked", F.count("*").over(Window.partitionBy("query_id")))
        return top_per_group(found, ["query_id"], best, k).drop("rn")
    first = durable(_ranked(asked, index, bounds.filter(F.col("before") < 2 * k).select("query_id", "block")))
    kth = top_per_group(first, ["query_id"], best, k).filter(F.col("rn") == k)
    floors = bounds.select("query_id").distinct().join(kth, "query_id", "left")
    floors = durable(floors.select("query_id", F.coalesce("keyword_rank", F.lit(0.0)).alias("floor")))
    rest = bounds.filter(F.col("before") >= 2 * k).join(floors, "query_id").filter("bound >= floor")
    second = _ranked(asked, index, rest.select("query_id", "block"), floors)
    found = durable(first.unionByName(second))
    ranked = found.groupBy("query_id").agg(F.count("*").alias("ranked"))
    return top_per_group(found, ["query_id"], best, k).drop("rn").join(ranked, "query_id")
