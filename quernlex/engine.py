"""One object for the whole path: pages to index, questions to results, answers to checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlex.functions.embedding import embed, embed_all
from quernlex.operators import answers, graph, retrieval
from quernlex.operators.chunking import chunks
from quernlex.operators.extraction import cross_references, definitions
from quernlex.session import checkpoint, ship
from quernlex.sources import store


class Engine:
    """embedder: an expression of a text; or ask, which gives the vectors of a list of texts."""

    def __init__(self, spark: SparkSession, embedder: Callable[[Column], Column] = embed, ask: Callable[[list[str]], list[list[float]]] | None = None) -> None:
        self.spark, self.embedder, self.ask = ship(spark), embedder, ask
        self.index: DataFrame | None = None
        self.bm25: retrieval.Bm25 | None = None

    def use(self, index: DataFrame) -> Engine:
        self.index = index
        self.bm25 = retrieval.Bm25(index)
        return self

    def _vectors(self, texts: DataFrame) -> DataFrame:
        """text, embedding: each different text once."""
        if self.ask is not None:
            return embed_all(texts, self.ask)
        return texts.select("text").where("text is not null").distinct().withColumn("embedding", self.embedder(F.col("text")))

    def build(self, pages: DataFrame) -> Engine:
        """Chunks pages, annotates and embeds them; the index's order is document, then chunk."""
        made = chunks(pages).join(store.titles(pages), "document_name")
        # numbers rise with the sort, which is by ranges: no task has all documents
        made = checkpoint(made.orderBy("document_name", "chunk_no").withColumn("ordinal", F.monotonically_increasing_id()))
        return self.use(checkpoint(self._annotated(made).join(self._vectors(made), "text")))

    def _annotated(self, made: DataFrame) -> DataFrame:
        """With the provisions that each chunk refers to, and the terms it defines, in their order."""
        refs = cross_references(made, ["chunk_id"])
        terms = definitions(made, ["chunk_id"]).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("defpos", "term"))).alias("t"))
        terms = terms.select("chunk_id", F.transform("t", lambda x: x["term"]).alias("defined_terms"))
        return made.join(refs, "chunk_id", "left").join(terms, "chunk_id", "left")

    def add(self, rows: DataFrame) -> Engine:
        """Appends chunks (text and any other columns of an index); texts that the index has aren't embedded again.

        Missing chunk ids become chunk_<n>, counted on from the index's size; ids may repeat, as in any append.
        """
        have = self.index
        start, last = (0, -1) if have is None else have.agg(F.count(F.lit(1)), F.coalesce(F.max("ordinal"), F.lit(-1))).first()
        numbered = checkpoint(rows.withColumn("_n", F.monotonically_increasing_id()))
        numbered = numbered.withColumn("ordinal", F.col("_n") + last + 1)
        given = F.col("chunk_id") if "chunk_id" in rows.columns else F.lit(None).cast("string")
        numbered = numbered.withColumn("chunk_id", F.coalesce(given, F.concat(F.lit("chunk_"), F.col("_n") + start))).drop("_n", "embedding")
        if have is None:
            return self.use(checkpoint(numbered.join(self._vectors(numbered), "text")))
        cached = have.select("text", "embedding").groupBy("text").agg(F.first("embedding").alias("embedding"))
        fresh = self._vectors(numbered.select("text").join(cached, "text", "left_anti"))
        known = cached.join(numbered.select("text").distinct(), "text", "left_semi").select("text", "embedding")
        return self.use(checkpoint(have.unionByName(numbered.join(known.unionByName(fresh), "text"), allowMissingColumns=True)))

    def save(self, path: str, name: str = "default") -> Engine:
        if self.index is None:
            raise ValueError("there is no index")
        store.write_index(self.index, path, name)
        return self

    def load(self, path: str, name: str = "default") -> bool:
        """Whether there is an index of that name; it is used from now on."""
        found = store.read_index(self.spark, path, name)
        if found is not None:
            self.use(found)
        return found is not None

    def search(self, questions: DataFrame, k: int = 10, expand: bool = False, where: Column | None = None) -> DataFrame:
        """query_id, rank, scores, the chunk's columns, expansion and its reason, for questions (query_id, text)."""
        if self.index is None:
            raise ValueError("there is no index")
        asked = questions.join(self._vectors(questions), "text", "left")
        found = checkpoint(retrieval.retrieve(asked, self.index, k, where, self.bm25))
        none = F.lit(None).cast("string")
        rows = found.withColumns({"expansion": none, "expansion_reason": none})
        if expand:
            more = graph.expand(found, questions, self.index).join(found.groupBy("query_id").agg(F.max("rank").alias("last")), "query_id")
            zero = F.lit(0.0)
            rows = rows.unionByName(more.select("query_id", "ordinal", zero.alias("vector_score"), zero.alias("bm25_score"), "combined_score", (F.col("last") + F.col("place")).alias("rank"), "expansion", "expansion_reason"))
        return rows.join(self.index.drop("embedding"), "ordinal")

    def describe(self) -> str:
        """The corpus in a phrase."""
        return answers.NOTHING if self.index is None else answers.corpus_description(self.index).first()["description"]

    def answer(self, questions: DataFrame, backend: Callable[[str, str], str] = answers.quoting_backend, k: int = 10) -> tuple[DataFrame, DataFrame]:
        """Answers (query_id, answer), and the verdict on each provision they cite."""
        found = checkpoint(self.search(questions, k, expand=True))
        said = checkpoint(answers.answers(questions, answers.contexts(found), backend))
        given = said.select(F.col("query_id").alias("answer_id"), F.col("answer").alias("text"))
        return said, graph.verify(given, found.withColumnRenamed("query_id", "answer_id"), self.index)
