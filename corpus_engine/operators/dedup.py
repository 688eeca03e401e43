"""Boilerplate detection across pages, exact and near.

Copies are counted per normalised hash; Spark pre-aggregates (hash, page) in the
map tasks, so a hash that holds a third of all chunks costs one row per page and
task. Near copies are found with prefix filtering: two sets with Jaccard
similarity of at least ``t`` must share one of the first ``|x| - ceil(t|x|) + 1``
shingles of any common order, here the order of rising frequency. Candidates are
then checked exactly, so nothing is lost or guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_engine.functions.text import normalized_hash, shingles, words
from corpus_engine.functions.urls import normalize_url
from corpus_engine.runtime import durable, top_per_group

# Pages that make a text boilerplate, and the near-copy threshold.
MIN_PAGES = 3
THRESHOLD = 0.85

#: Boilerplate sets of a prefix shingle that a text is compared with before all others.
FIRST_SETS = 8


def text_key(content: str) -> Column:
    """Normalised hash as a join key.

    It is never null: for a nullable key a join adds a null test, which would
    be pushed into the scan and compute the hash a second time.
    """
    return F.coalesce(normalized_hash(F.col(content)), F.lit(""))


def exact_boilerplate(
    df: DataFrame, content: str = "content", page: str = "page_url", min_pages: int = MIN_PAGES
) -> DataFrame:
    """Hashes seen on ``min_pages`` distinct pages or more."""
    return (
        df.select(text_key(content).alias("hash"), F.col(page).alias("_page"))
        .groupBy("hash")
        .agg(F.countDistinct("_page").alias("pages"))
        .filter(F.col("pages") >= min_pages)
    )


def _prefix_length(n: Column, threshold: float) -> Column:
    return n - F.ceil(n * F.lit(threshold)) + 1


def near_boilerplate(
    df: DataFrame,
    content: str = "content",
    page: str = "page_url",
    threshold: float = THRESHOLD,
    min_pages: int = MIN_PAGES,
    common_hashes: DataFrame | None = None,
) -> DataFrame:
    """Hashes of rarer texts that nearly equal a boilerplate text.

    Four passes over the texts, none of which writes them: count copies (saved by
    ``common_hashes``), take the boilerplate texts, count each rarer text's shingles that
    boilerplate knows, and take those shingles of texts with enough of them. From there on shingles are numbers, copies of a text are one
    row, boilerplate texts of equal shingles are one set, and a text that matches one of
    the first sets is done. (``explode_outer``, because a plain ``explode`` makes the optimizer
    test the array's size first and so compute the shingles twice.)
    """
    hashed = df.select(text_key(content).alias("hash"), F.col(content).alias("text"))
    if common_hashes is None:
        common_hashes = durable(exact_boilerplate(df, content, page, min_pages).select("hash"))

    def sets(side: DataFrame) -> DataFrame:
        return side.select("hash", shingles(F.col("text")).alias("s")).withColumn("n", F.coalesce(F.size("s"), F.lit(0)))

    common = durable(
        sets(hashed.join(common_hashes, "hash", "left_semi").groupBy("hash").agg(F.min("text").alias("text")))
    )
    rare = hashed.join(common_hashes, "hash", "left_anti")

    # how many boilerplate texts hold each shingle, and its number; nothing else can
    # match. As a written table its size is known, so Spark broadcasts it only when small.
    frequency = common.select(F.explode("s").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("df"))
    frequency = durable(frequency.withColumn("id", F.monotonically_increasing_id()))

    def known(side: DataFrame) -> DataFrame:
        """Per text its shingles known to boilerplate, rarest first."""
        return (
            side.select("hash", "n", F.explode_outer("s").alias("shingle"))
            .join(frequency, "shingle")
            .groupBy("hash", "n")
            .agg(F.sort_array(F.collect_set(F.struct("df", "id"))).alias("known"))
            .withColumn("known", F.transform("known", lambda k: k["id"]))
        )

    # |x n y| >= t|x|, so a match has that many known shingles at least. All texts are
    # first counted by 64-bit hashes, of which equal ones can only make a count too high.
    numbers = durable(frequency.select(F.xxhash64("shingle").alias("h")).distinct())
    key = F.xxhash64("hash").alias("key")
    hits = sets(rare).select(key, "n", F.explode_outer(F.transform("s", lambda g: F.xxhash64(g))).alias("h"))
    hits = hits.join(numbers, "h", "left_semi").groupBy("key", "n").count()
    likely = durable(hits.filter(F.col("count") >= F.col("n") * threshold).select("key").distinct())
    rare = sets(rare.withColumn("key", key).join(likely, "key", "left_semi"))
    near_rare = durable(known(rare).filter(F.size("known") >= F.col("n") * threshold))
    folded = (
        known(common).groupBy(F.array_sort("known").alias("all")).agg(F.first("known").alias("known"), F.first("n").alias("m"))
    )
    folded = durable(folded.withColumn("set", F.monotonically_increasing_id()))

    # unknown shingles come first in the order, so they use up the prefix; a prefix row
    # holds numbers only, as with its whole set a long text would count by its square
    take = _prefix_length(F.col("n"), threshold) - (F.col("n") - F.size("known"))
    rare_prefix = near_rare.select("hash", "n", F.explode(F.slice("known", F.lit(1), take.cast("int"))).alias("id"))
    head = F.slice("known", F.lit(1), _prefix_length(F.col("m"), threshold).cast("int"))
    common_prefix = folded.select("set", "m", F.explode(head).alias("id"))

    def matched(rare_side: DataFrame, common_side: DataFrame) -> DataFrame:
        """Rare texts that one of the sets sharing a prefix shingle nearly equals."""
        both = F.size(F.array_intersect("known", "all"))
        pairs = (
            rare_side.hint("merge").join(common_side, "id")
            .filter((F.col("m") >= F.col("n") * threshold) & (F.col("n") >= F.col("m") * threshold))
            .select("hash", "set")
            .distinct()
        )
        return (
            pairs.hint("merge").join(folded.select("set", "m", "all").hint("merge"), "set")
            .join(near_rare.hint("merge"), "hash")
            .filter(both / (F.col("n") + F.col("m") - both) >= threshold)
            .select("hash")
            .distinct()
        )

    # texts near many sets mostly match one of the first, so only the others see them all
    first = durable(matched(rare_prefix, top_per_group(common_prefix, ["id"], [F.col("set")], FIRST_SETS).drop("rn")))
    near = first.unionByName(matched(rare_prefix.join(first, "hash", "left_anti"), common_prefix))
    # texts too short for a shingle all count as equal
    if common.filter("n = 0").isEmpty():
        return near
    short = (
        hashed.filter(F.size(words(F.col("text"))) < 3)
        .join(common_hashes, "hash", "left_anti")
        .select("hash")
        .distinct()
    )
    return near.unionByName(short)


def boilerplate_hashes(df: DataFrame, content: str = "content", page: str = "page_url") -> DataFrame:
    """Exact and near boilerplate hashes, with the kind of each."""
    exact = durable(exact_boilerplate(df, content, page).select("hash"))
    near = near_boilerplate(df, content, page, common_hashes=exact)
    return exact.withColumn("kind", F.lit("exact")).unionByName(near.withColumn("kind", F.lit("near")))


def remove_boilerplate(
    df: DataFrame, hashes: DataFrame, content: str = "content"
) -> DataFrame:
    """Rows whose normalised text is not boilerplate.

    The anti join keeps the chunk side streaming, so the runtime skew split
    applies when one hash is very frequent.
    """
    return (
        df.withColumn("_hash", text_key(content))
        .join(hashes.select(F.col("hash").alias("_hash")), "_hash", "left_anti")
        .drop("_hash")
    )


def dedupe_urls(df: DataFrame, url: str = "url", order: str = "page_id") -> DataFrame:
    """First row of each normalised URL.

    ``min_by`` pre-aggregates in the map tasks; a window would move every copy.
    """
    rest = [c for c in df.columns if c not in (url,)]
    picked = F.min_by(F.struct(url, *rest), F.col(order))
    return (
        df.groupBy(normalize_url(F.col(url)).alias("normalized_url"))
        .agg(picked.alias("_row"))
        .select("normalized_url", "_row.*")
    )
