"""Per-key timelines cut into slices, so that no key has to fit one task.

Each slice of a key is worked on alone; a small table with one row per key and
slice carries what a slice must know of the earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
_MIN = 60_000_000

# The limits of each entry point (events, window).
RATE_LIMITS = {
    "chat": (30, _MIN),
    "chat_session": (60, _MIN),
    "share_view": (100, 60 * _MIN),
    "agent_creation": (10, 60 * _MIN),
    "crawl_trigger": (5, 60 * _MIN),
    "passcode": (5, _MIN),
}

# Times to live in seconds.
TTL_SECONDS = {"embedding": 3600, "search": 900, "response": 1800}


def slice_of(ts: Column, size_us: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(size_us))


def previous_version(
    df: DataFrame,
    keys: list[str],
    time: str,
    value: str,
    name: str = "previous_markdown",
    size_us: int = 30 * DAY_US,
) -> DataFrame:
    """``df`` with the ``value`` of the row before, by time within each key."""
    sliced = df.withColumn("_slice", slice_of(F.col(time), size_us))
    inside = Window.partitionBy(*keys, "_slice").orderBy(time)
    rows = sliced.withColumn("_before", F.lag(F.struct(value)).over(inside))
    # the last value of each slice, handed to the next slice that exists
    ends = sliced.groupBy(*keys, "_slice").agg(F.max_by(F.struct(value), time).alias("_end"))
    carried = ends.withColumn(
        "_carry", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_slice"))
    ).select(*keys, "_slice", "_carry")
    return (
        rows.join(carried, [*keys, "_slice"])
        .withColumn(name, F.coalesce("_before", "_carry")[value])
        .drop("_slice", "_before", "_carry")
    )


def failure_streaks(
    events: DataFrame,
    opens_at: int = 10,
    key: str = "key",
    time: str = "ts",
    tie: str = "event_id",
    ok: str = "ok",
    size_us: int = DAY_US,
) -> DataFrame:
    """Failures with ``streak``, the failures in a row so far, and ``open``."""
    sliced = events.withColumn("_slice", slice_of(F.col(time), size_us))
    order = Window.partitionBy(key, "_slice").orderBy(time, tie)
    to_here = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = sliced.withColumn("_run", F.sum(F.col(ok).cast("int")).over(to_here))
    in_run = Window.partitionBy(key, "_slice", "_run").orderBy(time, tie)
    rows = rows.withColumn(
        "_in_slice", F.sum((~F.col(ok)).cast("int")).over(in_run.rowsBetween(Window.unboundedPreceding, 0))
    )
    # failures behind the last success of each slice
    last_ok = F.max(F.when(F.col(ok), F.struct(time, tie)))
    ends = sliced.groupBy(key, "_slice").agg(last_ok.alias("_last_ok"))
    tails = (
        sliced.join(ends, [key, "_slice"])
        .filter(~F.col(ok) & (F.col("_last_ok").isNull() | (F.struct(time, tie) > F.col("_last_ok"))))
        .groupBy(key, "_slice")
        .agg(F.count("*").alias("_tail"))
    )
    by_slice = Window.partitionBy(key).orderBy("_slice")
    summary = (
        ends.join(tails, [key, "_slice"], "left")
        .withColumn("_tail", F.coalesce("_tail", F.lit(0)))
        .withColumn("_since", F.sum(F.col("_last_ok").isNotNull().cast("int")).over(by_slice))
        .withColumn("_out", F.sum("_tail").over(Window.partitionBy(key, "_since").orderBy("_slice")))
        .withColumn("_carry", F.coalesce(F.lag("_out").over(by_slice), F.lit(0)))
        .select(key, "_slice", "_carry")
    )
    streak = F.col("_in_slice") + F.when(F.col("_run") == 0, F.col("_carry")).otherwise(0)
    return (
        rows.filter(~F.col(ok))
        .join(summary, [key, "_slice"])
        .withColumn("streak", streak)
        .withColumn("open", F.col("streak") >= opens_at)
        .drop("_slice", "_run", "_in_slice", "_carry")
    )


def sliding_counts(
    events: DataFrame, window_us: int, key: str = "key", time: str = "ts"
) -> DataFrame:
    """Events with ``in_window``: events of the key in the trailing window.

    An event exactly ``window_us`` old is out; events of equal time count for
    each other. Events are first counted per key and instant, and each count is
    also sent to the next slice, whose window may reach back to it.
    """
    instants = (
        events.groupBy(key, F.unix_micros(time).alias("_us")).agg(F.count("*").alias("_n"))
    )
    here = F.floor(F.col("_us") / F.lit(window_us))
    copies = instants.select(
        key, "_us", "_n", F.explode(F.array(F.struct(here.alias("s"), F.lit(True).alias("own")), F.struct((here + 1).alias("s"), F.lit(False).alias("own")))).alias("c")
    )
    trailing = Window.partitionBy(key, "c.s").orderBy("_us").rangeBetween(-(window_us - 1), 0)
    counted = (
        copies.withColumn("in_window", F.sum("_n").over(trailing))
        .filter("c.own")
        .select(key, "_us", "in_window")
    )
    return (
        events.withColumn("_us", F.unix_micros(time)).join(counted, [key, "_us"]).drop("_us")
    )


def over_limit(events: DataFrame, most: int, window_us: int, key: str = "key", time: str = "ts") -> DataFrame:
    """Events with ``in_window`` and ``allowed``: at most ``most`` of the key in the trailing window.

    All requests count, refused ones too, so that the log alone decides and no key
    has to be worked through in order.
    """
    return sliding_counts(events, window_us, key, time).withColumn("allowed", F.col("in_window") <= most)


def openings(events: DataFrame, opens_at: int = 10, **columns) -> DataFrame:
    """The failure at which each run of failures reaches ``opens_at``."""
    return failure_streaks(events, opens_at, **columns).filter(F.col("streak") == opens_at)


def cache_key(*parts: Column) -> Column:
    """Cache key of the given string columns."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def repeats_within(
    events: DataFrame, ttl_us: int, keys: list[str], time: str = "ts", size_us: int = DAY_US
) -> DataFrame:
    """Events with ``hit``: the same key was asked for less than ``ttl_us`` before."""
    rows = events.withColumn("_us", F.unix_micros(time))
    rows = previous_version(rows, keys, time, "_us", "_earlier", size_us)
    return rows.withColumn("hit", F.coalesce(F.col("_us") - F.col("_earlier") < ttl_us, F.lit(False))).drop("_us", "_earlier")
