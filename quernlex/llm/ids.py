"""Ids as longs in their own order, where a table's ids aren't that already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from quernlex.session import written


def whole_numbers(docs: DataFrame, id_col: str) -> bool:
    return isinstance(docs.schema[id_col].dataType, ByteType | ShortType | IntegerType | LongType)


def plain_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether ids are whole numbers, none of them null or repeated."""
    if not whole_numbers(docs, id_col):
        return False
    found = docs.select(F.col(id_col).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    return not found.where("i is null or n > 1").limit(1).count()


def free_name(docs: DataFrame, name: str) -> str:
    """A column name like this one that docs doesn't have."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


def numbered_rows(docs: DataFrame, id_col: str, text_col: str, into: str) -> DataFrame:
    """docs, written down, with a number for each row: in the order of ids, nulls first, then of hashes of texts."""
    ordered = docs.orderBy(F.col(id_col).asc_nulls_first(), F.xxhash64(F.col(text_col)))
    return written(ordered.withColumn(into, F.monotonically_increasing_id()))


def numbered_ids(docs: DataFrame, id_col: str, into: str) -> DataFrame:
    """docs with the place of each row's id among all different ids; null stays null. Ids may be of any type with an order."""
    key = free_name(docs, "_id")
    ids = written(docs.select(F.col(id_col).alias(key)).where(F.col(key).isNotNull()).distinct().orderBy(key).withColumn(into, F.monotonically_increasing_id()))
    rows = docs.withColumn(key, F.col(id_col))
    return rows.join(ids, key, "left").drop(key)
