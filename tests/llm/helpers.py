"""Helpers of the tests in this folder."""

from corpus_engine.llm.queries import QUERIES, SQL
from corpus_engine.registry import Query
from tests.oracle import compare, connect

SMALL = "/root/testdata/sf0.001"


def against_sql(spark, name: str, directory: str = SMALL) -> None:
    assert compare(spark, connect(directory), Query(name, QUERIES[name], SQL[name]), directory) is None
