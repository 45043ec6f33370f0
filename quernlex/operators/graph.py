"""The graph of provisions: lookup tables, expansion of results along it, and checks of citations.

index: ordinal, chunk_id, text, document_name, section_number, sections, schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlex.functions.sizes import SMALL_ROWS, broadcast_if_small
from quernlex.functions.text import YEAR, normal_act, same_act, term_pattern
from quernlex.operators import extraction
from quernlex.session import written

MOST_REFERENCES = MOST_DEFINITIONS = 3


def own_sections(upper: bool = True) -> Column:
    own = F.when(F.size("sections") > 0, F.col("sections")).otherwise(F.array("section_number"))
    return F.filter(F.transform(own, lambda s: F.upper(s)) if upper else own, lambda s: s.isNotNull() & (s != ""))


def _among(rows: DataFrame, keys: DataFrame | None) -> DataFrame:
    """rows with one of these keys (schedule, section), or all."""
    if keys is None:
        return rows
    some = broadcast_if_small(keys.select(F.col("schedule").alias("_s"), F.col("section").alias("_n")).distinct())
    return rows.join(some, F.col("schedule").eqNullSafe(F.col("_s")) & F.col("section").eqNullSafe(F.col("_n")), "left_semi")


def first_chunks(index: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """document_name, schedule, section, ordinal: the first chunk of each provision; section null for a schedule or document.

    among: rows with the schedules and sections that are asked for, if not all are.
    """
    keys = F.concat(F.array(F.lit(None).cast("string")), own_sections())
    rows = index.select("document_name", "schedule", "ordinal", F.explode(keys).alias("section"))
    return _among(rows, among).groupBy("document_name", "schedule", "section").agg(F.min("ordinal").alias("ordinal"))


def _resolved(refs: DataFrame, index: DataFrame) -> DataFrame:
    """refs (document_name, schedule, section, ...) with `target`, the ordinal they point to, or null."""
    first = first_chunks(index, refs).select(F.col("document_name").alias("_d"), F.col("schedule").alias("_s"), F.col("section").alias("_n"), F.col("ordinal").alias("target"))
    on = (F.col("document_name") == F.col("_d")) & F.col("schedule").eqNullSafe(F.col("_s")) & F.col("section").eqNullSafe(F.col("_n"))
    return refs.join(first, on, "left").drop("_d", "_s", "_n")


def expand(results: DataFrame, queries: DataFrame, index: DataFrame, most_references: int = MOST_REFERENCES, most_definitions: int = MOST_DEFINITIONS) -> DataFrame:
    """query_id, ordinal, expansion, expansion_reason, combined_score, place: chunks that the results need.

    results: query_id, ordinal, rank, combined_score. First the provisions that results cite, in
    order of rank and mention; then definitions of terms in the query or the results. What is
    there already isn't added again. The score is half the least retrieved.
    """
    hits = written(broadcast_if_small(results.select("query_id", "ordinal", "rank")).join(index.select("ordinal", "chunk_id", "document_name", "text", F.col("sections"), "section_number"), "ordinal"))
    refs = extraction.references(hits.select("query_id", "rank", "chunk_id", "document_name", own_sections().alias("own"), "text"))
    refs = refs.where("act is null and (section is null or not array_contains(own, section))")
    label = F.when(F.col("section").isNotNull(), F.concat(F.lit("s "), "section")).otherwise(F.concat(F.lit("Schedule "), "schedule"))
    reason = F.concat(F.lit("cited as "), label, F.lit(" by "), "chunk_id")
    cited = _resolved(refs, index).where("target is not null").select("query_id", F.col("target").alias("ordinal"), "rank", "refpos", reason.alias("expansion_reason"))
    cited = cited.join(results.select("query_id", "ordinal"), ["query_id", "ordinal"], "left_anti")
    cited = cited.groupBy("query_id", "ordinal").agg(F.min(F.struct("rank", "refpos", "expansion_reason")).alias("x")).select("query_id", "ordinal", "x.*")
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "refpos"))
    cited = cited.withColumn("n", at).where(F.col("n") <= most_references).select("query_id", "ordinal", F.lit("cross_reference").alias("expansion"), "expansion_reason", "n")

    # only documents among the results can define anything here; where these are many, terms travel in place of all texts
    among, some = index.select("ordinal", "document_name", "text"), hits.select("document_name").distinct()
    if some.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        among = among.join(F.broadcast(some), "document_name", "left_semi")
    terms = extraction.definitions(among, ["ordinal", "document_name"])
    terms = terms.withColumn("pattern", term_pattern(F.col("term")))
    bodies = hits.groupBy("query_id", "document_name").agg(F.min("rank").alias("seen"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("body"))
    asked = bodies.join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    low = F.lower("term")
    near = F.contains(F.lower("body"), low) | F.contains(F.lower("question"), low)
    found = asked.join(terms, "document_name").where(near).withColumn("asked", F.expr("question rlike pattern")).where(F.col("asked") | F.expr("body rlike pattern"))
    found = written(found.select("query_id", "document_name", "ordinal", "defpos", "term", "asked", "seen", F.col("target_schedule").alias("schedule"), F.upper("target_section").alias("section")))
    pointing = F.col("section").isNotNull() | F.col("schedule").isNotNull()
    pointed = _resolved(found.where(pointing), index).withColumn("to", F.coalesce("target", "ordinal")).drop("target")
    found = pointed.unionByName(found.where(~pointing).withColumn("to", F.col("ordinal")))
    there = results.select("query_id", F.col("ordinal").alias("to")).union(cited.select("query_id", "ordinal"))
    found = found.join(there, ["query_id", "to"], "left_anti")
    order = F.struct((~F.col("asked")).alias("a"), (-F.size(F.split("term", " "))).alias("b"), (-F.length("term")).alias("c"), F.col("seen").alias("d"), F.col("ordinal").alias("e"), F.col("defpos").alias("f"), F.col("term").alias("term"))
    found = found.groupBy("query_id", "to").agg(F.min(order).alias("x"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("x"))
    defined = found.withColumn("n", place).where(F.col("n") <= most_definitions)
    defined = defined.select("query_id", F.col("to").alias("ordinal"), F.lit("definition").alias("expansion"), F.concat(F.lit("defines '"), "x.term", F.lit("'")).alias("expansion_reason"), (F.col("n") + most_references).alias("n"))
    scores = results.groupBy("query_id").agg((F.min("combined_score") / 2).alias("combined_score"))
    both = cited.unionByName(defined).join(scores, "query_id")
    return both.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("n"))).drop("n")


def provision_keys(chunks: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """document_name, schedule, section: what can be cited; clauses of a schedule are no sections.

    among: rows with the schedules and sections that are asked for, if not all are.
    """
    keyed = F.coalesce("schedule", F.lit("")) != ""
    none = F.lit(None).cast("string")
    keys = F.when(keyed, F.array(F.struct(F.upper("schedule").alias("schedule"), none.alias("section")))).otherwise(F.transform(own_sections(), lambda s: F.struct(none.alias("schedule"), s.alias("section"))))
    rows = chunks.select("document_name", F.explode(keys).alias("x")).select("document_name", "x.*")
    return _among(rows, among).distinct()


def document_titles(chunks: DataFrame) -> DataFrame:
    """document_name, title (normalised): the document_title, else the name with blanks; first seen holds."""
    given = F.col("document_title") if "document_title" in chunks.columns else F.lit(None).cast("string")
    title = F.coalesce(F.when(given != "", given), F.replace("document_name", F.lit("_"), F.lit(" ")))
    first = chunks.groupBy("document_name").agg(F.min_by(title, "ordinal").alias("title"))
    return first.select("document_name", normal_act(F.col("title")).alias("title"))


def verify(answers: DataFrame, retrieved: DataFrame, corpus: DataFrame) -> DataFrame:
    """answer_id, label, verdict, refpos for each provision that an answer (answer_id, text) cites.

    retrieved: answer_id and the columns of chunks. verdict is supported, outside_retrieved or
    not_in_corpus. A reference without an Act may be to any document.
    """
    refs = extraction.references(answers.select("answer_id", "text")).withColumn("label", extraction.reference_label()).withColumn("named", normal_act(F.col("act")))
    refs = refs.withColumn("turn", F.row_number().over(Window.partitionBy("answer_id", "label").orderBy("refpos"))).where("turn = 1").drop("turn", "act")
    refs = written(refs)  # it is gone over again and again
    titles = document_titles(corpus)
    # what is cited is looked up once for all answers: a document's keys stand under its title, so nothing multiplies
    wanted = refs.select("named", "schedule", "section").distinct()
    keys = provision_keys(corpus, wanted).join(titles, "document_name", "left")
    keys = written(keys.select("title", F.col("schedule").alias("ks"), F.col("section").alias("kn")).distinct())
    on_key = F.col("schedule").eqNullSafe(F.col("ks")) & F.col("section").eqNullSafe(F.col("kn"))
    acts = wanted.select("named").where("named is not null").distinct()
    bare = lambda c: F.regexp_replace(c, YEAR, "")
    named = acts.withColumn("bare", bare(F.col("named"))).join(keys.select("title").distinct().withColumn("bare", bare(F.col("title"))), "bare").where(same_act(F.col("named"), F.col("title"))).select("named", "title")
    free = wanted.where("named is null").join(keys.select("ks", "kn").distinct(), on_key, "left_semi")
    known = wanted.join(named, "named").withColumnRenamed("title", "kt")
    bound = known.join(keys, on_key & (F.col("kt") == F.col("title")), "left_semi").select("named", "schedule", "section")
    there = free.unionByName(bound).distinct().select(F.col("named").alias("tn"), F.col("schedule").alias("ts"), F.col("section").alias("tc"), F.lit(True).alias("there"))
    on_all = F.col("named").eqNullSafe(F.col("tn")) & F.col("schedule").eqNullSafe(F.col("ts")) & F.col("section").eqNullSafe(F.col("tc"))
    own = _keys_by_answer(retrieved, wanted).join(titles, "document_name", "left")
    own = own.groupBy(F.col("answer_id").alias("ra"), F.col("schedule").alias("ks"), F.col("section").alias("kn")).agg(F.collect_set("title").alias("titles"))
    out = refs.join(own, (F.col("answer_id") == F.col("ra")) & on_key, "left").join(broadcast_if_small(there), on_all, "left")
    here = F.col("titles").isNotNull() & (F.col("named").isNull() | F.exists("titles", lambda t: same_act(F.col("named"), t)))
    verdict = F.when(here, "supported").when(F.col("there"), "outside_retrieved").otherwise("not_in_corpus")
    return out.select("answer_id", "label", verdict.alias("verdict"), "refpos")


def _keys_by_answer(retrieved: DataFrame, among: DataFrame | None = None) -> DataFrame:
    both = F.to_json(F.struct("answer_id", "document_name"))
    keys = provision_keys(retrieved.withColumn("document_name", both), among)
    kinds = f"answer_id {retrieved.schema['answer_id'].dataType.simpleString()}, document_name string"
    return keys.withColumn("x", F.from_json("document_name", kinds)).select("x.answer_id", "x.document_name", "schedule", "section")


def report_lines(checks: DataFrame) -> DataFrame:
    """answer_id, lines: a short report of verify() for each answer that cites anything."""
    listed = lambda v: F.transform(F.array_sort(F.collect_list(F.when(F.col("verdict") == v, F.struct("refpos", "label")))), lambda x: x["label"])
    g = checks.groupBy("answer_id").agg(listed("supported").alias("s"), listed("outside_retrieved").alias("o"), listed("not_in_corpus").alias("n"))
    lines = F.array(
        F.concat(F.lit("Section references: "), F.size("s"), F.lit(" found in the retrieved text.")),
        F.when(F.size("o") > 0, F.concat(F.lit("  Not in the retrieved text, though in the indexed Acts: "), F.array_join("o", ", "))),
        F.when(F.size("n") > 0, F.concat(F.lit("  Not in the indexed Acts: "), F.array_join("n", ", "))),
    )
    return g.select("answer_id", F.array_compact(lines).alias("lines"))
