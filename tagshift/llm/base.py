"""Registry of the package's queries and small pieces that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: separators of words: the ASCII white space
SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that Spark computes once for each row.

    Behind an ordinary projection the optimizer may copy an expression into the functions that use
    it, where it would run anew for every element of an array; a generator is never copied.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(packed)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also inside the functions of arrays."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
