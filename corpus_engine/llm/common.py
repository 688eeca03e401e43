"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import string
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_engine.runtime import bound_batches


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def field(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def give_back() -> None:
    """Return what this process has freed to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def give_back_driver(spark: SparkSession) -> None:
    """Let the driver, its Python and its JVM, return what it has freed to the system.

    The JVM is asked through its management interface for what ``jcmd`` calls
    ``System.trim_native_heap``; one that cannot do it stays as it is.
    """
    give_back()
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    kind, management = jvm.java.lang.Class.forName, jvm.javax.management
    types = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    signature, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    given = [
        management.ObjectName("com.sun.management:type=DiagnosticCommand"),
        "systemTrimNativeHeap",
        array(jvm.java.lang.Object, 0),
        array(jvm.java.lang.String, 0),
    ]
    for i in range(4):
        signature[i], values[i] = kind(types[i]), given[i]
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    try:
        kind("javax.management.MBeanServer").getMethod("invoke", signature).invoke(server, values)
    except Py4JJavaError:
        pass


def tidy(run: Callable[[Iterator], Iterator[pd.DataFrame]]) -> Callable[[Iterator], Iterator[pd.DataFrame]]:
    """``run``, and then the memory that it has freed is given back.

    Python workers outlive their tasks; idle ones count to their executor's memory.
    """

    def whole(batches: Iterator) -> Iterator[pd.DataFrame]:
        yield from run(batches)
        give_back()

    return whole


def per_row(
    make: Callable[[], Callable[[list], pd.DataFrame]],
    schema: str,
    *inputs: Column,
) -> Column:
    """A struct column that Python computes batch by batch.

    ``make`` runs once per task and returns the function of one batch, which gets
    a list of values for each input. The column is marked as non-deterministic so
    that the optimizer neither moves nor repeats it.
    """

    @tidy
    def rows(batches):
        fn = make()
        for batch in batches:
            yield fn(*(list(column) for column in batch))

    @F.pandas_udf(schema)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        yield from rows(batches)

    @F.pandas_udf(schema)
    def run_one(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from rows((batch,) for batch in batches)

    bound_batches(SparkSession.active())
    udf = run_one if len(inputs) == 1 else run
    return udf.asNondeterministic()(*inputs)


def text_blocks(texts: list[str | None], limit: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Cut a batch into runs of about ``limit`` characters; a text is never cut.

    Gives the index of the first text and the texts, a null as empty text.
    """
    start, block, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if block and size + len(text) > limit:
            yield start, block
            start, block, size = i, [], 0
        block.append(text)
        size += len(text)
    if block:
        yield start, block
