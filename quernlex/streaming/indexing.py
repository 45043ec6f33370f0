"""Incremental indexing: new pages in a landing folder become chunks in the index, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernlex.functions.embedding import embed
from quernlex.operators.chunking import chunks
from quernlex.session import checkpoint
from quernlex.sources.store import PAGES, titles


def index_new_pages(spark: SparkSession, landing: str, index: str, state: str) -> StreamingQuery:
    """Starts a query over Parquet pages that land; whole documents are to land in one file set.

    A batch overwrites its own folder, so one that is run again after a failure adds nothing
    twice. read_batches() reads all of them as one index.
    """

    def add(batch: DataFrame, number: int) -> None:
        made = chunks(batch).join(titles(batch), "document_name").withColumn("embedding", embed(F.col("text")))
        made.write.mode("overwrite").parquet(f"{index}/batch={number}")

    pages = spark.readStream.schema(PAGES).parquet(landing)
    return pages.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()


def read_batches(spark: SparkSession, index: str) -> DataFrame:
    """All batches as an index; of a document that landed again the last batch holds.

    Ordinals go by batch, then by document and chunk.
    """
    rows = spark.read.parquet(index)
    last = rows.groupBy("document_name").agg(F.max("batch").alias("batch"))
    rows = rows.join(last, ["document_name", "batch"])
    return checkpoint(rows.orderBy("batch", "document_name", "chunk_no").withColumn("ordinal", F.monotonically_increasing_id())).drop("batch")
