"""Array helpers that stay linear (or n log n) in the array length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``.

    An expression of outer columns that is named inside a lambda is evaluated
    again for each element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def distinct_in_order(items: Column, key: Callable[[Column], Column], keep_blank: bool) -> Column:
    """Items whose ``key`` occurs for the first time, by one sort on the key."""
    tagged = F.transform(
        items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))
    )

    def firsts(ordered: Column) -> Column:
        shifted = F.concat(
            F.array(F.lit(None).cast("string")),
            F.transform(F.slice(ordered, F.lit(1), F.size(ordered) - 1), lambda s: s["k"]),
        )
        kept = F.filter(
            F.zip_with(
                ordered,
                shifted,
                lambda s, before: F.struct(
                    s["i"].alias("i"),
                    s["x"].alias("x"),
                    (
                        ~s["k"].eqNullSafe(before) | (F.lit(keep_blank) & (s["k"] == ""))
                    ).alias("first"),
                ),
            ),
            lambda s: s["first"],
        )
        return F.transform(F.sort_array(kept), lambda s: s["x"])

    return F.when(items.isNull(), None).otherwise(let(F.sort_array(tagged), firsts))


def explode_once(df: DataFrame, keep: list[str], items: Column, pos: str, item: str) -> DataFrame:
    """``posexplode`` of a costly array.

    For the plain form the optimizer adds a filter on the array's size, which
    computes the array a second time; the outer form has no such filter.
    """
    rows = df.select(*keep, F.posexplode_outer(items).alias(pos, item))
    return rows.filter(F.col(pos).isNotNull())
