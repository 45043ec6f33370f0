"""Queries over a small corpus of statutes that is made from the documents, a block for each of their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlex.functions.text import visible_length
from quernlex.operators import answers, chunking, extraction, graph, metrics, synthesis
from quernlex.plans.registry import query
from quernlex.session import table

_BLOCKS = """
b0 AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
b AS (SELECT doc_id * 100000 + i AS ordinal, 'act_' || doc_id AS document_name, 'act_' || doc_id || '_chunk_' || i AS chunk_id, CAST(i AS VARCHAR) AS section_number,
  CASE WHEN i % 7 = 0 THEN '1' END AS schedule, 'Sample Act ' || (1990 + doc_id % 30) AS document_title,
  line || chr(10) || 'See section ' || (i % 5 + 1) || ' and Schedule 1, or sections 2 to 4 of the Spam Act 2003.' || chr(10) || 'widget' || i || ' means a part.' AS text FROM b0)
"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).withColumn("i", F.col("p") + 1)
    name = F.concat(F.lit("act_"), "doc_id")
    text = F.concat("line", F.lit("\nSee section "), (F.col("i") % 5 + 1).cast("string"), F.lit(" and Schedule 1, or sections 2 to 4 of the Spam Act 2003.\nwidget"), "i", F.lit(" means a part."))
    return rows.select(
        (F.col("doc_id") * 100000 + F.col("i")).alias("ordinal"),
        name.alias("document_name"),
        F.concat(name, F.lit("_chunk_"), "i").alias("chunk_id"),
        F.col("i").cast("string").alias("section_number"),
        F.array(F.col("i").cast("string")).alias("sections"),
        F.when(F.col("i") % 7 == 0, "1").alias("schedule"),
        F.concat(F.lit("Sample Act "), (1990 + F.col("doc_id") % 30).cast("string")).alias("document_title"),
        text.alias("text"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four blocks a page, each under a heading and a line of its own words: its number in letters."""
    name = F.translate("section_number", "0123456789", "abcdefghij")
    b = blocks(spark, sf_dir).withColumn("body", F.concat("section_number", F.lit(" Heading of "), name, F.lit("\nIn "), name, F.lit(" this holds.\n"), "text"))
    page = F.floor((F.col("section_number").cast("int") - 1) / 4).cast("int") + 1
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "body")))
    return b.groupBy("document_name", page.alias("page_number")).agg(F.array_join(F.transform(rows, lambda x: x["body"]), "\n").alias("text"))


@query(
    "WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"
    " SELECT 'd' || doc_id AS document_name, CAST(i - 1 AS BIGINT) AS line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l"
)
def line_split_offsets(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("document_name"), F.lit(1).alias("page_number"), "text")
    return chunking.lines(p).select("document_name", F.col("line_no").cast("long").alias("line_no"), "start")


@query()
def chunk_rows(spark, sf_dir):
    return chunking.chunks(pages(spark, sf_dir))


@query(
    f"WITH {_BLOCKS}, t AS (SELECT document_name, CAST(section_number AS INT) AS i, section_number, section_number || ' Heading of ' || translate(section_number, '0123456789', 'abcdefghij') || chr(10) || 'In ' || translate(section_number, '0123456789', 'abcdefghij') || ' this holds.' || chr(10) || text AS body FROM b),"
    " o AS (SELECT *, coalesce(sum(length(body) + 1) OVER (PARTITION BY document_name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t)"
    " SELECT document_name, section_number, 'Heading of ' || translate(section_number, '0123456789', 'abcdefghij') AS heading, 'section' AS chunk_type, CAST(start AS BIGINT) AS start_char, CAST(start + length(body) AS BIGINT) AS end_char,"
    " CAST((i - 1) // 4 + 1 AS BIGINT) AS page_number, CAST(length(regexp_replace(body, '\\s+', '', 'g')) AS BIGINT) AS visible FROM o"
)
def chunk_materialise(spark, sf_dir):
    """A section's chunks together: where they begin and end, and the characters in them."""
    made = chunking.chunks(pages(spark, sf_dir))
    return made.groupBy("document_name", "section_number", "heading", "chunk_type").agg(
        F.min("start_char").alias("start_char"),
        F.max("end_char").alias("end_char"),
        F.min(F.array_min("page_numbers")).cast("long").alias("page_number"),
        F.sum(visible_length(F.col("text"))).cast("long").alias("visible"),
    )


@query(
    f"WITH {_BLOCKS} SELECT document_name, CAST(sum(length(regexp_replace(section_number || 'Headingof' || translate(section_number, '0123456789', 'abcdefghij') || 'In' || translate(section_number, '0123456789', 'abcdefghij') || 'thisholds.' || text, '\\s+', '', 'g'))) AS BIGINT) AS visible FROM b GROUP BY document_name"
)
def chunk_partition_invariant(spark, sf_dir):
    made = chunking.chunks(pages(spark, sf_dir))
    return made.groupBy("document_name").agg(F.sum(visible_length(F.col("text"))).cast("long").alias("visible"))


@query(
    f"WITH {_BLOCKS}, r AS (SELECT ordinal, unnest([{{'n': 1, 'section': CAST(CAST(section_number AS INT) % 5 + 1 AS VARCHAR), 'schedule': NULL, 'act': NULL}}, {{'n': 2, 'section': NULL, 'schedule': '1', 'act': NULL}},"
    " {'n': 3, 'section': '2', 'schedule': NULL, 'act': 'Spam Act 2003'}, {'n': 4, 'section': '3', 'schedule': NULL, 'act': 'Spam Act 2003'}, {'n': 5, 'section': '4', 'schedule': NULL, 'act': 'Spam Act 2003'}]) AS x FROM b)"
    " SELECT ordinal, CAST(x.n AS BIGINT) AS n, x.section AS section, x.schedule AS schedule, x.act AS act FROM r"
)
def parse_references(spark, sf_dir):
    from pyspark.sql import Window

    refs = extraction.references(blocks(spark, sf_dir).select("ordinal", "text"))
    n = F.row_number().over(Window.partitionBy("ordinal").orderBy("refpos")).cast("long")
    return refs.select("ordinal", n.alias("n"), "section", "schedule", "act")


@query(f"WITH {_BLOCKS} SELECT ordinal, 'widget' || section_number AS term, 'a part.' AS definition_text FROM b")
def definitions(spark, sf_dir):
    return extraction.definitions(blocks(spark, sf_dir), ["ordinal"]).select("ordinal", "term", "definition_text")


@query(
    f"WITH {_BLOCKS}, x AS (SELECT *, CAST(CAST(section_number AS INT) % 5 + 1 AS VARCHAR) AS s FROM b)"
    " SELECT chunk_id, CASE WHEN s = section_number THEN 'Schedule 1' ELSE s || ',Schedule 1' END AS cross_references FROM x"
)
def cross_references(spark, sf_dir):
    return extraction.cross_references(blocks(spark, sf_dir), ["chunk_id"]).select("chunk_id", F.array_join("cross_references", ",").alias("cross_references"))


@query(
    f"WITH {_BLOCKS}, k AS (SELECT document_name, schedule, section_number AS section, ordinal FROM b UNION ALL SELECT document_name, schedule, NULL, ordinal FROM b)"
    " SELECT document_name, schedule, section, min(ordinal) AS ordinal FROM k GROUP BY ALL"
)
def first_chunk_index(spark, sf_dir):
    return graph.first_chunks(blocks(spark, sf_dir))


@query(f"WITH {_BLOCKS} SELECT DISTINCT document_name, schedule, CASE WHEN schedule IS NULL THEN section_number END AS section FROM b")
def provision_keys(spark, sf_dir):
    return graph.provision_keys(blocks(spark, sf_dir))


def _results(spark, sf_dir):
    """Of every document, its second block as the one result of one query."""
    b = blocks(spark, sf_dir).where("section_number = '2'")
    return b.select(F.col("document_name").alias("query_id"), "ordinal", F.lit(1).alias("rank"), F.lit(0.5).alias("combined_score"))


@query(
    f"""WITH {_BLOCKS}, q AS (SELECT document_name, ordinal FROM b WHERE section_number = '2'),
    c AS (SELECT q.document_name, min(b.ordinal) AS ordinal, 1 AS n, 'cited as s 3 by ' || q.document_name || '_chunk_2' AS expansion_reason FROM q JOIN b ON b.document_name = q.document_name AND b.section_number = '3' GROUP BY q.document_name
    UNION ALL SELECT q.document_name, min(b.ordinal), 2, 'cited as Schedule 1 by ' || q.document_name || '_chunk_2' FROM q JOIN b ON b.document_name = q.document_name AND b.schedule = '1' GROUP BY q.document_name)
    SELECT document_name AS query_id, ordinal, row_number() OVER (PARTITION BY document_name ORDER BY n) AS place, expansion_reason, 0.25::DOUBLE AS combined_score FROM c"""
)
def expand_cross_refs(spark, sf_dir):
    r = _results(spark, sf_dir)
    asked = r.select("query_id", F.lit("what").alias("text"))
    out = graph.expand(r, asked, blocks(spark, sf_dir))
    return out.select("query_id", "ordinal", F.col("place").cast("long").alias("place"), "expansion_reason", "combined_score")


@query(
    f"""WITH {_BLOCKS}, q AS (SELECT document_name FROM b WHERE section_number = '2'), d AS (SELECT b.document_name AS query_id, b.ordinal, 'defines ''widget' || section_number || '''' AS expansion_reason
    FROM b JOIN q USING (document_name) WHERE section_number IN ('1', '5', '10')) SELECT * FROM d"""
)
def expand_definitions(spark, sf_dir):
    r = _results(spark, sf_dir)
    asked = r.select("query_id", F.lit("a widget1, a Widget5 or widget10s and widget5x").alias("text"))
    return graph.expand(r, asked, blocks(spark, sf_dir)).where("expansion = 'definition'").select("query_id", "ordinal", "expansion_reason")


@query(
    f"""WITH {_BLOCKS}, q AS (SELECT DISTINCT document_name, document_title FROM b), l AS (SELECT document_name AS answer_id, unnest([{{'label': 's 1', 'n': '1'}}, {{'label': 's 2', 'n': '2'}}, {{'label': 's 9999', 'n': '9999'}}]) AS x FROM q)
    SELECT answer_id, x.label AS label, CASE WHEN x.n = '1' THEN 'supported' WHEN x.n = '2' THEN CASE WHEN (SELECT count(*) FROM b WHERE section_number = '2') > 0 THEN 'outside_retrieved' ELSE 'not_in_corpus' END ELSE 'not_in_corpus' END AS verdict FROM l
    UNION ALL SELECT document_name, 's 1 of the ' || document_title, 'supported' FROM q UNION ALL SELECT document_name, 's 1 of the Other Act 2001', 'not_in_corpus' FROM q"""
)
def verify_citations(spark, sf_dir):
    b = blocks(spark, sf_dir)
    got = b.where("section_number = '1'").withColumn("answer_id", F.col("document_name"))
    text = F.concat(F.lit("Under s 1 of the "), "document_title", F.lit(" and s 1 of the Other Act 2001. But s 1, ss 2 or s 9999 apply, as s 1 says."))
    return graph.verify(got.select("answer_id", text.alias("text")), got, b).select("answer_id", "label", "verdict")


@query(
    f"WITH {_BLOCKS}, q AS (SELECT DISTINCT section_number AS s FROM b)"
    " SELECT 'section_' || s AS query_id, chunk_id, CASE WHEN s = section_number THEN 2 ELSE 1 END AS relevance_score FROM q JOIN b ON contains(section_number, s)"
    " UNION ALL SELECT 'document_' || document_name, chunk_id, 2 FROM b"
)
def auto_annotate(spark, sf_dir):
    """A question for each section and one for each document of the blocks."""
    b = blocks(spark, sf_dir)
    none = F.array().cast("array<string>")
    sections = b.select("section_number").distinct().select(F.concat(F.lit("section_"), "section_number").alias("query_id"), F.array("section_number").alias("expected_sections"), none.alias("expected_documents"))
    documents = b.select("document_name").distinct().select(F.concat(F.lit("document_"), "document_name").alias("query_id"), none.alias("expected_sections"), F.array("document_name").alias("expected_documents"))
    return synthesis.annotate(sections.unionByName(documents), b)


_ASKED = f"""WITH {_BLOCKS}, n AS (SELECT count(*) AS n, CAST(trunc(CAST(0.4 AS DOUBLE) * count(*)) AS BIGINT) AS fact, CAST(trunc(CAST(0.35 AS DOUBLE) * count(*)) AS BIGINT) AS hypo FROM documents),
s AS (SELECT count(DISTINCT section_number) AS sections FROM b)"""


def _asked(spark, sf_dir, document):
    """As many test questions as there are documents."""
    b = blocks(spark, sf_dir)
    return b, synthesis.evaluation_set(b, table(spark, sf_dir, "documents").count(), document)


@query(f"{_ASKED} SELECT 'fact' AS query_type, least(fact, 2 * sections) AS n FROM n, s UNION ALL SELECT 'hypothetical', hypo FROM n UNION ALL SELECT 'cross-reference', n - fact - hypo FROM n")
def query_type_distribution(spark, sf_dir):
    """Fact questions stop at two for each section."""
    _, q = _asked(spark, sf_dir, "act_3")
    return q.groupBy("query_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_ASKED} SELECT n - fact AS n FROM n")
def queries_without_relevant(spark, sf_dir):
    """Fact questions expect a section that there is; the others a document that there isn't."""
    b, q = _asked(spark, sf_dir, "no_such_act")
    return q.join(synthesis.annotate(q, b), "query_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"{_ASKED}, c AS (SELECT count(*) AS chunks FROM b WHERE document_name = 'act_3') SELECT 'hypothetical' AS query_type, hypo * chunks AS n FROM n, c UNION ALL SELECT 'cross-reference', (n - fact - hypo) * chunks FROM n, c"
)
def annotations_of_documents(spark, sf_dir):
    """Of the questions that expect a document, every chunk of it is relevant."""
    b, q = _asked(spark, sf_dir, "act_3")
    notes = synthesis.annotate(q, b).where("relevance_score = 2").join(q.where("query_type <> 'fact'").select("query_id", "query_type"), "query_id")
    return notes.groupBy("query_type").agg(F.count(F.lit(1)).alias("n"))


_SHORT = ", ".join(repr(x) for x in [*extraction.STOP_WORDS])
_WEAK = ", ".join(repr(x) for x in synthesis.WEAK_TERMS)


@query(
    f"""WITH {_BLOCKS}, w AS (SELECT chunk_id, section_number, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM (SELECT chunk_id, section_number, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS l FROM b)),
    t AS (SELECT chunk_id, section_number, pos, regexp_replace(raw, '^[.,;:!?()"'']+|[.,;:!?()"'']+$', '', 'g') AS term FROM w),
    c AS (SELECT chunk_id, section_number, term, count(*) AS n, min(pos) AS pos FROM t WHERE length(term) > 2 AND term NOT IN ({_SHORT}) GROUP BY ALL),
    k AS (SELECT section_number, term FROM c QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, pos) <= 30),
    g AS (SELECT DISTINCT section_number, term FROM k WHERE term <> lower(section_number) AND term NOT IN ({_WEAK}) AND regexp_full_match(term, '\\p{{L}}+([''‐-―]\\p{{L}}+)*')),
    f AS (SELECT term, count(*) AS n_sections FROM g GROUP BY term)
    SELECT section_number, term, n_sections, row_number() OVER (PARTITION BY section_number ORDER BY n_sections, term) AS place FROM g JOIN f USING (term)"""
)
def section_term_specificity(spark, sf_dir):
    """The terms of every section, from the blocks as they are."""
    t = synthesis.section_terms(blocks(spark, sf_dir))
    return t.select("section_number", "term", F.col("n_sections").cast("long").alias("n_sections"), F.col("place").cast("long").alias("place"))


@query(
    f"WITH {_BLOCKS}, t AS (SELECT document_title AS t, min(ordinal) AS o FROM b GROUP BY ALL), l AS (SELECT list('the ' || t ORDER BY o) AS l FROM t)"
    " SELECT array_to_string(l[1:len(l) - 1], ', ') || ' and ' || l[len(l)] AS description FROM l"
)
def corpus_description(spark, sf_dir):
    return answers.corpus_description(blocks(spark, sf_dir))


@query(
    f"WITH {_BLOCKS} SELECT document_name AS query_id, string_agg('[' || section_number || '] ' || document_name || ' - Section ' || section_number || chr(10) || 'Type: section' || chr(10) || 'Text: ' || text, chr(10) || chr(10) ORDER BY ordinal) AS context FROM b GROUP BY ALL"
)
def context_format(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return answers.contexts(b.select(F.col("document_name").alias("query_id"), F.col("section_number").cast("int").alias("rank"), "document_name", "section_number", F.lit("section").alias("chunk_type"), "text", F.lit(None).cast("string").alias("expansion_reason")))


@query(f"WITH {_BLOCKS} SELECT ordinal, document_title || CASE WHEN schedule IS NOT NULL THEN ', Schedule 1, clause ' ELSE ', s ' END || section_number AS title FROM b")
def source_titles(spark, sf_dir):
    return blocks(spark, sf_dir).withColumn("part_of_section", F.lit(None).cast("string")).select("ordinal", answers.source_title().alias("title"))


def _section_run(spark, sf_dir):
    b = blocks(spark, sf_dir)
    run = b.select(F.col("document_name").alias("query_id"), F.col("section_number").cast("int").alias("rank"), "document_name", "sections", "section_number", "schedule")
    names = b.select("document_name").distinct()
    gold = names.select(F.col("document_name").alias("query_id"), F.col("document_name").alias("act"), F.explode(F.array(F.lit("2"), F.lit("7"))).alias("section"))
    return run, gold


_SECTION = f"""WITH {_BLOCKS}, q AS (SELECT document_name, count(*) AS n, CAST(count(*) FILTER (section_number = '2') AS DOUBLE) AS two FROM b GROUP BY ALL), k AS (SELECT unnest([1, 3, 5, 10]) AS k),
s AS (SELECT document_name AS query_id, CAST(k AS BIGINT) AS k, true AS doc_hit, CASE WHEN k >= 2 THEN two / k ELSE 0 END AS precision, CASE WHEN k >= 2 THEN two / 2 ELSE 0 END AS recall, two / 2 AS rr FROM q, k)"""


@query(f"{_SECTION} SELECT query_id, k, doc_hit, round(precision, 9) AS precision, round(recall, 9) AS recall, round(rr, 9) AS rr FROM s")
def section_score(spark, sf_dir):
    out = metrics.section_scores(*_section_run(spark, sf_dir))
    return out.select("query_id", F.col("k").cast("long").alias("k"), "doc_hit", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "rr")])


@query(f"{_SECTION} SELECT k, round(avg(CAST(doc_hit AS INT)), 4) AS doc_hit, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(rr), 4) AS mrr FROM s GROUP BY k")
def section_summary(spark, sf_dir):
    return metrics.section_summary(metrics.section_scores(*_section_run(spark, sf_dir))).withColumn("k", F.col("k").cast("long"))
