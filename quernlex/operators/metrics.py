"""Retrieval metrics over a run (query_id, chunk_id, rank) and judgements, in long format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlex.functions.text import document_matches

KS = (1, 3, 5, 10)


def judgements(annotations: DataFrame) -> DataFrame:
    """query_id, chunk_id, relevance_score: of repeated annotations the one with the largest seq."""
    last = F.max_by("relevance_score", "seq") if "seq" in annotations.columns else F.max("relevance_score")
    return annotations.groupBy("query_id", "chunk_id").agg(last.alias("relevance_score"))


def _judged(run: DataFrame, annotations: DataFrame, threshold: int, totals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """totals: query_id, total, where they are known without a row for each relevant pair; annotations then need those of the run only."""
    relevant = judgements(annotations).where(F.col("relevance_score") >= threshold)
    marked = relevant.select("query_id", "chunk_id", F.lit(1).alias("rel"))
    hits = run.select("query_id", "chunk_id", "rank").join(marked, ["query_id", "chunk_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    queries = run.select("query_id").union((annotations if totals is None else totals).select("query_id")).distinct()
    if totals is None:
        totals = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"))
    totals = queries.join(totals, "query_id", "left")
    return hits, totals.select("query_id", F.coalesce("total", F.lit(0)).alias("total"))


def at_k(run: DataFrame, annotations: DataFrame, ks: tuple[int, ...] = KS, threshold: int = 1, totals: DataFrame | None = None) -> DataFrame:
    """query_id, k, precision, recall, f1.

    Precision is over what was retrieved within k, 0 for nothing. Recall is 1 where nothing is
    relevant. F1 is 0 where both are.
    """
    hits, totals = _judged(run, annotations, threshold, totals)
    counts = hits.groupBy("query_id").agg(*[x for k in ks for x in (F.sum(F.when(F.col("rank") <= k, F.col("rel"))).alias(f"h{k}"), F.count(F.when(F.col("rank") <= k, 1)).alias(f"n{k}"))])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(f"h{k}", F.lit(0)).alias("hits"), F.coalesce(f"n{k}", F.lit(0)).alias("n")) for k in ks]))
    rows = totals.join(counts, "query_id", "left").select("query_id", "total", each.alias("x")).select("query_id", "total", "x.*")
    rows = rows.withColumns(
        {
            "precision": F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(F.lit(0.0)),
            "recall": F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("hits") / F.col("total")),
        }
    )
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both < 1e-10, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / both)
    return rows.select("query_id", "k", "precision", "recall", f1.alias("f1"))


def by_rank(run: DataFrame, annotations: DataFrame, threshold: int = 1, totals: DataFrame | None = None) -> DataFrame:
    """query_id, reciprocal_rank, average_precision, num_relevant, num_retrieved, has_relevant.

    Average precision is 0 for nothing retrieved, else 1 where nothing is relevant.
    """
    from pyspark.sql import Window

    hits, totals = _judged(run, annotations, threshold, totals)
    seen = F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank"))
    per = hits.withColumn("seen", seen).groupBy("query_id").agg(
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rel") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("gain"),
        F.count(F.lit(1)).alias("n"),
    )
    rows = totals.join(per, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ap = F.when(F.col("n") == 0, F.lit(0.0)).when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("gain") / F.col("total"))
    return rows.select(
        "query_id",
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        ap.alias("average_precision"),
        F.col("total").alias("num_relevant"),
        F.col("n").alias("num_retrieved"),
        (F.col("total") > 0).alias("has_relevant"),
    )


def overall(per_k: DataFrame, per_query: DataFrame, aggregate: str = "mean") -> DataFrame:
    """metric, value: means, or upper medians, over queries per k; mrr and map are always means."""
    if aggregate not in ("mean", "median"):
        raise ValueError(f"unknown aggregate: {aggregate}")

    def middle(x: str) -> Column:
        return F.avg(x) if aggregate == "mean" else F.element_at(F.array_sort(F.collect_list(x)), F.floor(F.count(x) / 2).cast("int") + 1)

    sums = per_k.groupBy("k").agg(*[middle(x).alias(x) for x in ("precision", "recall", "f1")], F.avg("precision").alias("p"), F.avg("recall").alias("r"))
    named = [F.struct(F.concat(F.lit(f"{x}@"), "k").alias("metric"), F.col(x).alias("value")) for x in ("precision", "recall", "f1")]
    rows = sums.select(F.explode(F.array(*named)).alias("x")).select("x.*")
    ten = per_k.where("k = 10").agg(F.coalesce(F.avg("precision"), F.lit(0.0)).alias("overall_precision"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("overall_recall"))
    whole = per_query.agg(F.avg("reciprocal_rank").alias("mrr"), F.avg("average_precision").alias("map"), F.count(F.lit(1)).alias("n"))
    tail = whole.crossJoin(ten).where("n > 0").select(F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("value")) for x in ("mrr", "map", "overall_precision", "overall_recall")])).alias("x"))
    return rows.unionByName(tail.select("x.*"))


def chunk_sections(chunks: DataFrame) -> Column:
    """Upper-cased section ids of a chunk; none for a chunk of a schedule."""
    own = F.when(F.size("sections") > 0, F.col("sections")).otherwise(F.array_compact(F.array("section_number")))
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(F.col("schedule"), F.lit("")) != "", empty).otherwise(F.transform(F.coalesce(own, empty), lambda s: F.upper(s)))


def section_scores(results: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """query_id, k, doc_hit, precision, recall, rr against gold labels (query_id, act, section or null).

    results: query_id, rank, document_name, sections, section_number, schedule. Precision is
    over k whatever was retrieved; recall counts distinct gold sections; rr looks at the first
    max(ks) results. Section metrics are null for queries whose gold names no section.
    """
    most = max(ks)
    rows = results.where(F.col("rank") <= most).select("query_id", "rank", "document_name", chunk_sections(results).alias("own"))
    g = gold.select("query_id", "act", F.upper("section").alias("section"))
    pairs = rows.join(g, "query_id").where(document_matches(F.col("document_name"), F.col("act")))
    exact = F.col("section").isNotNull() & F.array_contains("own", F.col("section"))
    pairs = pairs.select("query_id", "rank", "act", F.when(exact, F.col("section")).alias("section"))
    totals = g.groupBy("query_id").agg(F.countDistinct(F.when(F.col("section").isNotNull(), F.struct("act", "section"))).alias("total"))
    hit = F.col("section").isNotNull()
    sums = pairs.groupBy("query_id").agg(
        *[
            x
            for k in ks
            for x in (
                F.max((F.col("rank") <= k).cast("int")).alias(f"d{k}"),
                F.countDistinct(F.when(hit & (F.col("rank") <= k), F.col("rank"))).alias(f"c{k}"),
                F.countDistinct(F.when(hit & (F.col("rank") <= k), F.struct("act", "section"))).alias(f"s{k}"),
            )
        ],
        F.min(F.when(hit, F.col("rank"))).alias("first"),
    )
    labelled = F.col("total") > 0
    fields = lambda k: F.struct(
        F.lit(k).alias("k"),
        (F.coalesce(f"d{k}", F.lit(0)) > 0).alias("doc_hit"),
        F.when(labelled, F.coalesce(f"c{k}", F.lit(0)) / F.lit(float(k))).alias("precision"),
        F.when(labelled, F.coalesce(f"s{k}", F.lit(0)) / F.col("total")).alias("recall"),
    )
    out = totals.join(sums, "query_id", "left").select("query_id", F.when(labelled, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("rr"), F.explode(F.array(*map(fields, ks))).alias("x"))
    return out.select("query_id", "x.*", "rr")


def section_summary(scores: DataFrame) -> DataFrame:
    """k, doc_hit over all questions and section metrics over labelled ones, to four places."""
    mean = lambda x: F.round(F.avg(x), 4).alias(x)
    return scores.groupBy("k").agg(F.round(F.avg(F.col("doc_hit").cast("double")), 4).alias("doc_hit"), mean("precision"), mean("recall"), F.round(F.avg("rr"), 4).alias("mrr"))


def routing(results: DataFrame, expected: DataFrame) -> DataFrame:
    """hit_1, hit_3, n: shares of probe queries (query_id, expected_document) routed to their document."""
    right = results.join(expected, "query_id").where(F.col("document_name") == F.col("expected_document"))
    best = right.groupBy("query_id").agg(F.min("rank").alias("first"))
    per = expected.select("query_id").join(best, "query_id", "left")
    share = lambda k: F.round(F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 3)
    return per.agg(share(1).alias("hit_1"), share(3).alias("hit_3"), F.count(F.lit(1)).alias("n"))


def target_met(metrics: DataFrame, target: float = 0.9) -> bool:
    row = metrics.where("metric = 'overall_precision'").first()
    return bool(row and row["value"] >= target)
