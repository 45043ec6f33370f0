"""Test questions made from an index, and their automatic annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernlex.functions.sizes import broadcast_if_small
from quernlex.functions.text import is_word
from quernlex.operators.extraction import key_terms

# Terms too common to name a section.
WEAK_TERMS = "not under that they their them which what there here this with without than then some any each other must may shall will would".split()
FACT_FORMS = ("What does the {d} say about {t}?", "What rule does the {d} set out for {t}?")
# The questions that an evaluation set begins with, and the forms and topics of all others.
HYPOTHETICAL = (
    "Can an employer require an employee to work overtime?",
    "How much annual leave is an employee entitled to?",
    "What are the rules for personal/carer's leave?",
    "When is an employee entitled to redundancy pay?",
    "What constitutes unfair dismissal?",
    "Can employees request flexible working arrangements?",
    "How much notice is required to terminate employment?",
    "How often must employees be paid?",
)
TOPICS = ("leave", "hours", "pay", "termination", "agreement")
TOPIC_FORMS = ("What are the rules regarding {t} in the Fair Work Act?", "Explain the provisions about {t}", "How does the Act handle {t}?")
CROSS_REFERENCE = (
    ("According to the definition of 'employee', what conditions must be met?", ("definition", "employee")),
    ("What is the definition of 'modern award' and where is it referenced?", ("definition", "modern award")),
    ("How do sections 31 and 32 interact regarding national employment standards?", ("section_31", "section_32")),
)
CONNECTION = "How are the provisions about unfair dismissal connected to other relevant sections?"
SEED = 17


def allocation(n: int) -> dict[str, int]:
    fact, hypothetical = int(0.4 * n), int(0.35 * n)
    return {"fact": fact, "hypothetical": hypothetical, "cross-reference": n - fact - hypothetical}


def section_terms(chunks: DataFrame, per_chunk: int = 30) -> DataFrame:
    """section_number, term, n_sections, place: terms of each section, the most specific first."""
    terms = key_terms(chunks.where("section_number is not null").select("section_number", "chunk_id", "text"), ["section_number", "chunk_id"], per_chunk)
    good = terms.where((F.col("term") != F.lower("section_number")) & ~F.col("term").isin(WEAK_TERMS) & is_word(F.col("term"))).select("section_number", "term").distinct()
    spread = good.groupBy("term").agg(F.count(F.lit(1)).alias("n_sections"))
    place = F.row_number().over(Window.partitionBy("section_number").orderBy("n_sections", "term"))
    return good.join(spread, "term").withColumn("place", place)


def fact_queries(chunks: DataFrame, count: int, seed: int = SEED) -> DataFrame:
    """query_id, query_text, query_type, difficulty, expected_sections, expected_documents: two questions on
    each of up to `count` sections, drawn by seeded hashes, `count` at most."""
    draw = F.xxhash64("section_number", F.lit(seed))
    one = chunks.where("section_number is not null").groupBy("section_number").agg(F.min_by("document_name", F.xxhash64("chunk_id", F.lit(seed))).alias("d"))
    picked = one.orderBy(draw, "section_number").limit(count)
    named = picked.join(section_terms(chunks).where("place = 1").select("section_number", "term"), "section_number", "left")
    i = F.row_number().over(Window.orderBy(draw, "section_number")) - 1  # at most `count` rows by now
    named = named.withColumns({"i": i, "t": F.coalesce("term", F.lit("this matter"))})
    texts = [F.struct(F.lit(j).alias("j"), F.concat(*[x for p in form.replace("{d}", "\0d\0").replace("{t}", "\0t\0").split("\0") if p for x in [F.col(p) if p in ("d", "t") else F.lit(p)]]).alias("q")) for j, form in enumerate(FACT_FORMS)]
    rows = named.select("i", "section_number", "d", F.explode(F.array(*texts)).alias("x"))
    return rows.where(2 * F.col("i") + F.col("x.j") < count).select(
        F.concat(F.lit("fact_"), "i", F.lit("_"), "x.j").alias("query_id"), F.col("x.q").alias("query_text"), F.lit("fact").alias("query_type"), F.lit("easy").alias("difficulty"), F.array("section_number").alias("expected_sections"), F.array("d").alias("expected_documents")
    )


def filled_queries(spark: SparkSession, count: int, kind: str, document: str, seed: int = SEED) -> DataFrame:
    """Questions that expect one document: the fixed ones of their kind, then topics in forms drawn by seeded hashes
    (hypothetical) or one question again and again (cross-reference)."""
    none = F.array().cast("array<string>")
    numbered = spark.range(count)
    i = F.col("id").cast("int")
    if kind == "hypothetical":
        fixed, expected = HYPOTHETICAL, none
        filled = [form.format(t=t) for form in TOPIC_FORMS for t in TOPICS]
        rest = F.element_at(F.array(*map(F.lit, filled)), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(len(filled))).cast("int") + 1)
    else:
        fixed, rest = [q for q, _ in CROSS_REFERENCE], F.lit(CONNECTION)
        expected = F.coalesce(F.get(F.array(*[F.array(*map(F.lit, e)) for _, e in CROSS_REFERENCE]), i), none)
    text = F.coalesce(F.get(F.array(*map(F.lit, fixed)), i), rest)
    short, level = ("hypo", "medium") if kind == "hypothetical" else ("cross", "hard")
    return numbered.select(
        F.concat(F.lit(f"{short}_"), "id").alias("query_id"), text.alias("query_text"), F.lit(kind).alias("query_type"), F.lit(level).alias("difficulty"), expected.alias("expected_sections"), F.array(F.lit(document)).alias("expected_documents")
    )


def evaluation_set(chunks: DataFrame, n: int, document: str, seed: int = SEED) -> DataFrame:
    a = allocation(n)
    spark = chunks.sparkSession
    return fact_queries(chunks, a["fact"], seed).unionByName(filled_queries(spark, a["hypothetical"], "hypothetical", document)).unionByName(filled_queries(spark, a["cross-reference"], "cross-reference", document))


def annotate(queries: DataFrame, chunks: DataFrame, full: bool = False) -> DataFrame:
    """query_id, chunk_id, relevance_score: 2 for an expected section or document, 1 for part of a section id.

    Only relevant pairs are made, by joins on sections, documents and parts of section ids; with
    full=True the irrelevant pairs too, with 0, which is the whole product.
    """
    c = chunks.select("chunk_id", "document_name", "section_number")
    by_section = queries.select("query_id", F.explode("expected_sections").alias("s")).join(c.where("section_number is not null"), F.col("s") == F.col("section_number"))
    by_document = queries.select("query_id", F.explode("expected_documents").alias("d")).join(c, F.col("d") == F.col("document_name"))
    two = by_section.select("query_id", "chunk_id").union(by_document.select("query_id", "chunk_id")).distinct().withColumn("relevance_score", F.lit(2))
    # every substring of the distinct section ids, which are short
    ids = c.select("section_number").where("section_number <> ''").distinct()
    n = F.length("section_number")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(F.col("section_number"), i, k))))
    parts = ids.select("section_number", F.explode(F.array_distinct(parts)).alias("s"))
    one = queries.select("query_id", F.explode("expected_sections").alias("s")).join(parts, "s").join(c, "section_number").select("query_id", "chunk_id").distinct()
    one = one.join(two, ["query_id", "chunk_id"], "left_anti").withColumn("relevance_score", F.lit(1))
    found = two.unionByName(one)
    if not full:
        return found
    every = broadcast_if_small(queries.select("query_id")).crossJoin(c.select("chunk_id"))
    return every.join(found, ["query_id", "chunk_id"], "left").withColumn("relevance_score", F.coalesce("relevance_score", F.lit(0)))
