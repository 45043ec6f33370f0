"""Evaluation drivers: gold questions, automatic test questions and routing probes, each in one batch of searches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernlex.engine import Engine
from quernlex.operators import metrics, synthesis
from quernlex.session import checkpoint
from quernlex.sources import store

TARGET = 0.9
PROBE_K = 5


def evaluate_gold(engine: Engine, questions: DataFrame, gold: DataFrame, ks: tuple[int, ...] = metrics.KS) -> tuple[DataFrame, DataFrame]:
    """Scores of each question and k, and their summary: one search of max(ks) results for all questions, not expanded.

    questions: query_id, text. gold: query_id, act, section (null for a question about an Act as a whole).
    """
    found = checkpoint(engine.search(questions.select("query_id", "text"), max(ks)))
    scores = checkpoint(metrics.section_scores(found, gold, ks))
    return scores, metrics.section_summary(scores)


def gold_report(engine: Engine, gold_path: str, out: str | None = None, ks: tuple[int, ...] = metrics.KS) -> dict:
    """header, summary and results of a gold set in JSON; written to `out` if named."""
    questions, gold = store.read_gold_questions(engine.spark, gold_path), store.read_gold(engine.spark, gold_path)
    scores, summary = evaluate_gold(engine, questions, gold, ks)
    report = {
        "gold_set": {"path": gold_path, **store.read_gold_header(engine.spark, gold_path)},
        "summary": [r.asDict() for r in summary.orderBy("k").collect()],
        "results": [r.asDict() for r in scores.orderBy("query_id", "k").collect()],  # as many as gold questions and ks
    }
    if out:
        store.write_text(engine.spark, out, json.dumps(report, indent=2, default=str) + "\n")
    return report


def auto_report(engine: Engine, n: int, document: str, folder: str | None = None, seed: int = synthesis.SEED, ks: tuple[int, ...] = metrics.KS) -> dict:
    """Makes n test questions from the index, annotates and asks them; with a folder, writes them, metrics.json and report.json."""
    if engine.index is None:
        raise ValueError("there is no index")
    queries = checkpoint(synthesis.evaluation_set(engine.index, n, document, seed))
    notes = checkpoint(synthesis.annotate(queries, engine.index))
    found = checkpoint(engine.search(queries.select("query_id", F.col("query_text").alias("text")), max(ks)))
    run = found.select("query_id", "chunk_id", "rank")
    overall = metrics.overall(metrics.at_k(run, notes, ks), metrics.by_rank(run, notes))
    measured = {r["metric"]: r["value"] for r in overall.collect()}
    kinds = {r["query_type"]: r["count"] for r in queries.groupBy("query_type").count().collect()}
    bare = queries.select("query_id").join(notes.where("relevance_score >= 1"), "query_id", "left_anti").count()
    size = engine.index.agg(F.countDistinct("document_name").alias("d"), F.count(F.lit(1)).alias("c")).first()
    total = sum(kinds.values())
    report = {
        "summary": {
            "num_documents": size["d"],
            "num_chunks": size["c"],
            "num_queries": total,
            "query_type_distribution": kinds,
            "num_annotations": total * size["c"],  # every pair has a judgement; only relevant ones are kept as rows
            "queries_without_relevant_chunks": bare,
        },
        "metrics": measured,
    }
    if folder:
        store.write_evaluation_set(queries, notes, folder)
        store.write_text(engine.spark, f"{folder}/metrics.json", json.dumps(measured, indent=2))
        store.write_text(engine.spark, f"{folder}/report.json", json.dumps(report, indent=2))
    return report


def report_text(report: dict, target: float = TARGET, ks: tuple[int, ...] = metrics.KS) -> list[str]:
    """An automatic evaluation's report as lines, with the target met or missed."""
    m, s = report["metrics"], report["summary"]
    out = [f"{s['num_documents']} documents, {s['num_chunks']} chunks, {s['num_queries']} questions"]
    out += [f"  {kind}: {n}" for kind, n in sorted(s["query_type_distribution"].items())]
    out.append(f"  without a relevant chunk: {s['queries_without_relevant_chunks']}")
    out.append("  k  precision  recall  F1")
    for k in ks:
        if f"precision@{k}" in m:
            out.append(f"{k:>3}  {m[f'precision@{k}']:9.3f}  {m[f'recall@{k}']:6.3f}  {m[f'f1@{k}']:.3f}")
    out += [f"{name}: {m.get(name, 0.0):.3f}" for name in ("mrr", "map", "overall_precision", "overall_recall")]
    met = m.get("overall_precision", 0.0) >= target
    return [*out, f"precision@10 {'reaches' if met else 'is below'} the target of {target:.2f}"]


def probe(engine: Engine, questions: DataFrame, out: str | None = None, k: int = PROBE_K) -> dict:
    """How often questions (query_id, text, expected_document) find their document first, or among the first three."""
    found = checkpoint(engine.search(questions.select("query_id", "text"), k))
    rates = metrics.routing(found, questions.select("query_id", "expected_document")).first().asDict()
    rows = found.select("query_id", "rank", "document_name", "section_number", F.round("combined_score", 4).alias("score")).orderBy("query_id", "rank")
    report = {"k": k, **rates, "results": [r.asDict() for r in rows.collect()]}  # k rows a question
    if out:
        store.write_text(engine.spark, out, json.dumps(report, indent=2) + "\n")
    return report
