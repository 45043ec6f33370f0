"""The command line: python -m quernlex process|query|chat|evaluate|sections|probe|menu."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from quernlex import evaluation, menu
from quernlex.backends import BACKENDS, get_llm
from quernlex.chat import Conversation, Terminal
from quernlex.engine import Engine
from quernlex.functions.embedding import posting
from quernlex.sources import store


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quernlex", description="Search and answers over structured legal text")
    modes = top.add_subparsers(dest="mode", required=True)

    def mode(name: str, what: str) -> argparse.ArgumentParser:
        m = modes.add_parser(name, help=what)
        m.add_argument("--output-dir", default="data/processed", help="where chunks and indexes are")
        m.add_argument("--index-name", default="default")
        m.add_argument("--embedding-url", help="a service with /embeddings; offline without")
        m.add_argument("--embedding-model", default="default")
        return m

    def source(m: argparse.ArgumentParser, required: bool) -> None:
        given = m.add_mutually_exclusive_group(required=required)
        given.add_argument("--pdfs", nargs="+", help="PDF files")
        given.add_argument("--pages", help="a Parquet table of pages")

    source(mode("process", "make chunks and an index"), True)
    query = mode("query", "search an index")
    query.add_argument("--query", required=True)
    query.add_argument("--k", type=int, default=10)
    query.add_argument("--expand", action="store_true", help="add cited provisions and definitions")
    chat = mode("chat", "ask questions")
    chat.add_argument("--query", help="one question; a conversation without")
    chat.add_argument("--k", type=int, default=10)
    chat.add_argument("--backend", choices=sorted(BACKENDS))
    chat.add_argument("--no-rag", action="store_true", help="answer without the index")
    auto = mode("evaluate", "ask questions made from the index")
    source(auto, False)
    auto.add_argument("--num-queries", type=int, default=100)
    auto.add_argument("--document", default="fair_work_act_2009", help="the document that general questions expect")
    auto.add_argument("--eval-dir", default="data/evaluation")
    auto.add_argument("--no-print", action="store_true")
    sections = mode("sections", "ask the questions of a gold set")
    sections.add_argument("--gold", required=True)
    sections.add_argument("--out", default="results/section_eval.json")
    routes = mode("probe", "see whether questions find their documents")
    routes.add_argument("--questions", required=True, help="JSON lines of query_id, text, expected_document")
    routes.add_argument("--out", default="results/retrieval_probe.json")
    modes.add_parser("menu", help="choose what to do")
    return top


def pages_of(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    return spark.read.parquet(given.pages) if given.pages else store.read_pdfs(spark, given.pdfs)


def engine_of(spark: SparkSession, given: argparse.Namespace, load: bool) -> Engine:
    import os

    ask = posting(given.embedding_url, given.embedding_model, os.environ.get("OPENAI_API_KEY", "")) if given.embedding_url else None
    engine = Engine(spark, ask=ask)
    if load and not engine.load(given.output_dir, given.index_name):
        raise SystemExit(f"There is no index {given.index_name} in {given.output_dir}.")
    return engine


def run(spark: SparkSession, given: argparse.Namespace, write=print) -> None:
    fresh = given.mode == "process" or (given.mode == "evaluate" and (given.pdfs or given.pages))
    needs = not fresh and not (given.mode == "chat" and given.no_rag)
    engine = engine_of(spark, given, needs)
    if fresh:
        engine.build(pages_of(spark, given)).save(given.output_dir, given.index_name)
        store.write_chunks(engine.index.drop("embedding"), given.output_dir)
        write(f"{engine.index.count()} chunks of {engine.describe()}")
    if given.mode == "query":
        asked = spark.createDataFrame([("q", given.query)], "query_id string, text string")
        found = engine.search(asked, given.k, given.expand).select("rank", "document_name", "section_number", "combined_score", "expansion", "text").orderBy("rank")
        for r in found.collect():
            write(json.dumps(r.asDict(), ensure_ascii=False))
    elif given.mode == "chat":
        talk = Conversation(engine, get_llm(given.backend), given.k)
        terminal = Terminal(talk, not given.no_rag, write=write)
        terminal.question(given.query) if given.query else terminal.run()
    elif given.mode == "evaluate":
        report = evaluation.auto_report(engine, given.num_queries, given.document, given.eval_dir)
        for line in () if given.no_print else evaluation.report_text(report):
            write(line)
    elif given.mode == "sections":
        for row in evaluation.gold_report(engine, given.gold, given.out)["summary"]:
            write(json.dumps(row))
    elif given.mode == "probe":
        questions = spark.read.schema("query_id string, text string, expected_document string").json(given.questions)
        report = evaluation.probe(engine, questions, given.out)
        write(json.dumps({x: report[x] for x in ("hit_1", "hit_3", "n")}))


def main(argv: Sequence[str] | None = None) -> None:
    given = parser().parse_args(argv)
    if given.mode == "menu":
        menu.Menu().run()
        return
    spark = SparkSession.builder.appName("quernlex").getOrCreate()
    try:
        run(spark, given)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
