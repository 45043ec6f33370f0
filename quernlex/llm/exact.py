"""Exact deduplication: one row stays of all rows with equal texts.

Rows are grouped by a 128-bit content hash together with the bytes of the text, so the hash
decides where a text goes and the comparison of bytes, inside the group, excludes collisions.
The first aggregation runs before the shuffle: a text with thousands of copies leaves each
input partition once, whatever share of all rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from quernlex.llm.components import salt
from quernlex.session import written


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stays: str = "smallest") -> DataFrame:
    """The rows that stay, with their columns as they are: one for each different text.

    stays: "smallest" or "largest" id. A null text counts as empty; rows with a null id stay
    only where no copy has an id. Rows repeated with one id are told apart by their other
    columns, and equal rows count as one. Column names may be any; columns that have no order
    (maps) aren't told apart by. An empty table gives an empty one.
    """
    ids = F.col(id_col)
    rank = F.struct(
        ids.isNotNull().alias("has") if stays == "largest" else ids.isNull().alias("has"),
        ids.alias("id"),
        *[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(docs.schema.fields) if f.name not in (id_col, text_col) and not isinstance(f.dataType, MapType)],
        F.col(text_col).isNull().alias("null_text"),
    )
    pick = F.max_by if stays == "largest" else F.min_by
    body = F.coalesce(F.col(text_col), F.lit(""))
    # the text is in the key and so isn't carried in the row a second time
    slim = F.struct(*[(F.col(f"`{c}`").isNull() if c == text_col else F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    grouped = docs.groupBy(content_hash(body).alias("h"), body.alias("body")).agg(pick(slim, rank).alias("row"))
    return grouped.select(
        *[
            (F.when(F.col(f"row.c{i}"), F.lit(None)).otherwise(F.col("body")) if c == text_col else F.col(f"row.c{i}")).alias(c)
            for i, c in enumerate(docs.columns)
        ]
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stays: str = "smallest") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts (null counts as empty, nothing is normalised) the row with the smallest or,
    with stays="largest", the largest id stays. A null id never beats another; a group of null
    ids only has a null keep_id and keeps one of its rows. Of rows repeated with the id that
    stays, one is kept. Texts may be of any length. Empty tables give no rows. Other columns of
    docs are not read, so their names may be any.

    A group's copies are dealt to several places by their ids and, as ids may be null or
    repeated, by the input partition that they come from; what is known of the group goes to each place.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("body"), content_hash(body).alias("h"))
    pick = F.max if stays == "largest" else F.min
    sha = F.sha2(F.encode(F.col("body"), "UTF-8"), 256)
    groups = (
        rows.groupBy("h", "body")
        .agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", sha.alias("text_sha256"), "keep_id", "group_size")
    )
    # written down, so that the partition numbers that the places go by are the same for both its uses
    members = written(rows.select("doc_id", "h", sha.alias("text_sha256"), salt(F.col("doc_id"), F.spark_partition_id()).alias("place")))
    places = members.groupBy("h", "text_sha256", "place").agg(pick("doc_id").alias("best")).join(groups, ["h", "text_sha256"])
    # of the places, at most SALTS for a group, the first that has the id that stays
    has = F.when(F.col("best").eqNullSafe(F.col("keep_id")), F.col("place"))
    places = places.withColumn("owner", F.min(has).over(Window.partitionBy("h", "text_sha256"))).drop("best")
    joined = members.join(places, ["h", "text_sha256", "place"])
    # which of the rows repeated with one id is the one: part of a group of copies only where ids repeat
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("place") == F.col("owner"))
    turn = F.row_number().over(Window.partitionBy("h", "text_sha256", "place", "doc_id").orderBy("place"))
    return joined.select("doc_id", "keep_id", "group_size", (best & (turn == 1)).alias("kept"), "text_sha256")
