"""Stores, backends, chat, evaluation and the command line, over a small made-up statute."""

import json

import pytest
from pyspark.sql import functions as F

from quernlex import evaluation, menu
from quernlex.__main__ import parser, run
from quernlex.backends import BACKENDS, ChatEndpoint, CitingEndpoint, LocalModel, Quoting, ServiceError, document_block, get_llm
from quernlex.chat import Conversation, Terminal, described
from quernlex.engine import Engine
from quernlex.functions.embedding import embed, embed_all, posting
from quernlex.operators import answers, metrics, synthesis
from quernlex.sources import store
from quernlex.streaming.indexing import index_new_pages, read_batches

BODY = "the keeper of a lamp must keep it lit from dusk until the last boat is home"
PAGES = [
    ("lamp_act", 1, f"Lamp Act 2020\n1 Lamps\n{BODY}, as section 3 says of beacons\n2 Harbours\nharbour means a place where many boats lie safe\n3 Signals\nflags fly at noon, and a flare is sent up in every storm that comes"),
    ("oil_act", 1, f"Oil Regulations 1999\n7 Barrels\noil is kept in barrels of oak, and no barrel stands near a flame\n8 Wicks\na wick is cut each day, {BODY}"),
]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark).build(spark.createDataFrame(PAGES, "document_name string, page_number int, text string"))


def asked(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, text string")


def test_save_and_load(spark, engine, tmp_path):
    engine.save(str(tmp_path), "x")
    other = Engine(spark)
    assert not other.load(str(tmp_path), "y") and other.load(str(tmp_path), "x")
    with pytest.raises(ValueError):
        Engine(spark).search(asked(spark, "lamp"))
    with pytest.raises(ValueError):
        Engine(spark).save(str(tmp_path))
    one, two = ([(r["chunk_id"], r["rank"]) for r in e.search(asked(spark, "lamp oil")).orderBy("rank").collect()] for e in (engine, other))
    assert one == two and len(one) == 5
    store.write_chunks(engine.index.drop("embedding"), str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/chunks").count() == spark.read.json(f"{tmp_path}/chunks_json").count() == 5
    assert engine.describe() == "the Lamp Act 2020 and the Oil Regulations 1999"


def test_adding_chunks_embeds_each_text_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def ask(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    rows = lambda *t: spark.createDataFrame([(x, "d") for x in t], "text string, document_name string")
    e = Engine(spark, ask=ask).add(rows("a", "bb", "a"))
    assert calls.value == 2 and sorted(r["chunk_id"] for r in e.index.collect()) == sorted(f"chunk_{r['ordinal']}" for r in e.index.collect())
    e.add(rows("bb", "ccc"))
    assert calls.value == 3
    got = e.index.collect()
    assert len(got) == 5 and len({r["ordinal"] for r in got}) == 5 and all(r["embedding"][0] == len(r["text"]) for r in got)


def test_embedding_service(spark):
    def shy(texts):
        if len(texts) > 1:
            raise OSError("one at a time")
        return [[1.0 if texts[0] == "a" else 0.0]]

    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string").coalesce(1)
    assert sorted(map(tuple, embed_all(df, shy).collect())) == [("a", [1.0]), ("b", [0.0])]

    def broken(texts):
        raise OSError("down")

    with pytest.raises(Exception, match="down"):
        embed_all(df, broken).collect()
    with pytest.raises(ValueError):
        posting("http://x", "m", "")


def test_offline_embedder(spark):
    import re
    import zlib

    texts = ["the cat and the dog", "", None, "Ünter THE the 12"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", embed(F.col("text"), 16).alias("v")).collect()
    for r in got:
        want = [1.0] + [0.0] * 15
        for w in re.findall("[a-z]+", (texts[r["i"]] or "").lower()):
            want[1 + zlib.crc32(w.encode()) % 15] += 1
        assert r["v"] == want


def test_gold_set(spark, engine, tmp_path):
    gold = {
        "name": "lamps", "status": "draft",
        "questions": [
            {"id": "a", "question": "who keeps a lamp lit until the last boat is home", "gold": [{"act": "lamp_act", "section": "1"}]},
            {"id": "b", "question": "barrels of oak", "gold": [{"act": "oil_act", "section": "7"}], "sources": [{"section": "7", "url": "u", "heading": "h"}]},
            {"id": "c", "question": "flags at noon", "gold": [{"act": "oil_act", "section": None}]},
        ],
    }
    (tmp_path / "gold.json").write_text(json.dumps(gold))
    report = evaluation.gold_report(engine, f"{tmp_path}/gold.json", f"{tmp_path}/out/report.json", (1, 3))
    assert json.loads((tmp_path / "out" / "report.json").read_text()) == report
    assert report["gold_set"]["name"] == "lamps" and report["gold_set"]["status"] == "draft"
    rows = {(r["query_id"], r["k"]): r for r in report["results"]}
    assert rows["b", 1]["recall"] == 1.0 and rows["c", 1]["recall"] is None and len(rows) == 6
    assert {r["k"] for r in report["summary"]} == {1, 3}
    questions = {r["query_id"]: r["n_sources"] for r in store.read_gold_questions(spark, f"{tmp_path}/gold.json").collect()}
    assert questions == {"a": 0, "b": 1, "c": 0}


def test_automatic_evaluation(spark, engine, tmp_path):
    report = evaluation.auto_report(engine, 20, "lamp_act", str(tmp_path / "eval"))
    s = report["summary"]
    assert s["query_type_distribution"] == {"fact": 8, "hypothetical": 7, "cross-reference": 5} and s["num_chunks"] == 5 and s["num_annotations"] == 100
    assert s["queries_without_relevant_chunks"] == 0 and json.loads((tmp_path / "eval" / "report.json").read_text()) == report
    assert json.loads((tmp_path / "eval" / "metrics.json").read_text()) == report["metrics"]
    queries, notes = store.read_evaluation_set(spark, str(tmp_path / "eval"))
    assert queries.count() == 20 and {r["relevance_score"] for r in notes.collect()} <= {1, 2}
    assert store.read_evaluation_set(spark, str(tmp_path)) is None
    lines = evaluation.report_text(report)
    assert lines[0] == "2 documents, 5 chunks, 20 questions" and lines[-1].startswith("precision@10 ")
    assert evaluation.report_text(report, 0.0)[-1] == "precision@10 reaches the target of 0.00"


def test_made_questions(spark):
    hypo = synthesis.filled_queries(spark, 12, "hypothetical", "d").orderBy("query_id").collect()
    assert len(hypo) == 12 and {r["query_text"] for r in hypo} >= set(synthesis.HYPOTHETICAL)
    forms = {f.format(t=t) for f in synthesis.TOPIC_FORMS for t in synthesis.TOPICS}
    assert {r["query_text"] for r in hypo} - set(synthesis.HYPOTHETICAL) <= forms
    cross = {r["query_id"]: r for r in synthesis.filled_queries(spark, 5, "cross-reference", "d").collect()}
    assert cross["cross_2"]["expected_sections"] == ["section_31", "section_32"] and cross["cross_4"]["query_text"] == synthesis.CONNECTION and cross["cross_4"]["expected_sections"] == []
    assert synthesis.filled_queries(spark, 2, "cross-reference", "d").count() == 2


def test_probe(spark, engine, tmp_path):
    questions = spark.createDataFrame([("1", "barrels of oak", "oil_act"), ("2", "flags fly at noon", "lamp_act"), ("3", "barrels", "lamp_act")], "query_id string, text string, expected_document string")
    report = evaluation.probe(engine, questions, f"{tmp_path}/probe.json", 2)
    assert report["n"] == 3 and report["hit_1"] == 0.667 and json.loads((tmp_path / "probe.json").read_text()) == report


def test_replies():
    spans = [{"type": "char_location", "document_index": 1, "cited_text": "x"}, {"type": "page_location", "document_index": 7}, {"type": "char_location", "document_index": 1}]
    reply = answers.read_reply({"model": "m", "stop_reason": "end_turn", "content": [{"type": "thinking"}, {"type": "text", "text": " Lit. ", "citations": spans}, {"type": "text", "text": "Out."}]})
    assert reply.text == "Lit. [2]Out." and len(reply.citations) == 2 and not reply.refused and not reply.fallback
    cut = answers.read_reply({"stop_reason": "max_tokens", "content": [{"type": "fallback"}, {"type": "text", "text": "half", "citations": None}]})
    assert cut.truncated and cut.text.startswith("half\n\n") and cut.fallback
    no = answers.read_reply({"stop_reason": "refusal", "stop_details": {"category": "x"}, "content": [{"type": "text", "text": "partly"}], "usage": {"iterations": [{"type": "fallback_message"}]}})
    assert no.refused and no.refusal == "x" and "partly" not in no.text and no.citations == [] and no.fallback
    assert answers.read_reply({}).text == ""


def test_backends(monkeypatch):
    for name in ("CHAT_BACKEND", "CHAT_BASE_URL", "OPENAI_CHAT_BASE_URL", "CHAT_MODEL", "OPENAI_CHAT_MODEL", "CLAUDE_MODEL", "CLAUDE_EFFORT"):
        monkeypatch.delenv(name, raising=False)
    assert isinstance(get_llm(), LocalModel) and isinstance(get_llm("quote"), Quoting)
    monkeypatch.setenv("OPENAI_CHAT_BASE_URL", "http://there/v1")
    sent = []

    def post(url, headers, body):
        sent.append((url, body))
        return {"choices": [{"message": {"content": None}}]}

    chat = get_llm(post=post)
    assert isinstance(chat, ChatEndpoint) and chat.generate("hi", [{"role": "user", "content": "a"}], "sys") == ""
    url, body = sent[0]
    assert url == "http://there/v1/chat/completions" and body["model"] == "local" and [m["role"] for m in body["messages"]] == ["system", "user", "user"] and body["temperature"] == 0.2
    monkeypatch.setenv("CHAT_BACKEND", "QUOTE")
    assert isinstance(get_llm(), Quoting) and isinstance(get_llm("openai"), ChatEndpoint)
    for bad in (lambda: get_llm("nobody"), lambda: CitingEndpoint(), lambda: CitingEndpoint("m", "loud"), lambda: LocalModel("some/model-GGUF")):
        with pytest.raises(ValueError):
            bad()
    turns = LocalModel.turns("q", [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "sys")
    assert [t["role"] for t in turns] == ["user", "assistant", "user"] and turns[0]["content"] == "sys\n\na"

    def cite(url, headers, body):
        sent.append((url, body))
        return {"stop_reason": "end_turn", "content": [{"type": "text", "text": "yes"}]}

    c = CitingEndpoint("m", post=cite)
    assert c.generate("q") == "yes" and "system" not in sent[-1][1]
    assert c.answer_with_documents("q", [{"title": "t", "text": "x", "expansion_reason": "cited as s 1"}], system="s").text == "yes"
    content = sent[-1][1]["messages"][-1]["content"]
    assert content[0]["citations"] == {"enabled": True} and "cited as s 1" in content[0]["context"] and content[-1] == {"type": "text", "text": "q"} and "temperature" not in sent[-1][1]
    assert "context" not in document_block({"title": "t", "text": "x"}) and set(BACKENDS) == {"claude", "openai", "gemma", "quote"}
    with pytest.raises(ServiceError):
        ChatEndpoint("http://127.0.0.1:9").generate("q")


def test_conversation(spark, engine):
    heard = []

    class Echo:
        def generate(self, prompt, history=None, system=None):
            heard.append((prompt, list(history), system))
            return "s 1 and s 99 apply"

    talk = Conversation(engine, Echo(), k=2, exchanges=1)
    first = talk.ask("who keeps the lamp lit")
    assert {"1", "8"} <= {x["section_number"] for x in first["sources"]} and first["checks"] == [{"label": "s 1", "verdict": "supported"}, {"label": "s 99", "verdict": "not_in_corpus"}]
    assert BODY in heard[0][0] and "Lamp Act 2020" in heard[0][2] and heard[0][1] == []
    talk.ask("and then", retrieve=False)
    talk.ask("why", retrieve=False)
    assert [m["content"] for m in heard[2][1]] == ["and then", "s 1 and s 99 apply"] and len(talk.history) == 6
    assert described(first)[0] == "Sources" and any("s 99" in x for x in described(first))

    class Reader:
        def answer_with_documents(self, question, sources, history=None, system=None):
            return answers.Reply("lit [1]", [{"document_index": 0, "cited_text": "x " * 100}], "end_turn", "m", None, True)

    result = Conversation(engine, Reader()).ask("lamp")
    assert result["citations"] and any(x.endswith("...") for x in described(result)) and "Another model answered: m" in described(result)


def test_terminal(engine):
    class Failing:
        def generate(self, prompt, history=None, system=None):
            if "bad" in prompt:
                raise ServiceError("no luck")
            return "fine"

    said, lines = [], iter(["/help", "", "/rag", "/rag off", "/rag maybe", "bad one", "good " + "x" * 200, "/history", "/clear", "/history", "/nothing", "/quit", "never read"])
    Terminal(Conversation(engine, Failing()), read=lambda _: next(lines), write=said.append).run()
    text = "\n".join(said)
    assert "That failed: no luck" in text and "fine" in said and "Nothing was said yet." in said and "/nothing is no command" in text and "/rag takes on or off." in said
    assert any(x.endswith("...") and len(x) < 120 for x in said) and next(lines) == "never read"
    Terminal(Conversation(engine, Failing()), read=lambda _: (_ for _ in ()).throw(EOFError), write=said.append).run()


def test_command_line(spark, tmp_path):
    at = str(tmp_path / "pages")
    spark.createDataFrame(PAGES, "document_name string, page_number int, text string").write.parquet(at)
    out, said = str(tmp_path / "out"), []
    go = lambda *a: run(spark, parser().parse_args([*a, "--output-dir", out]), said.append)
    with pytest.raises(SystemExit):
        go("query", "--query", "lamp")
    go("process", "--pages", at)
    assert said == ["5 chunks of the Lamp Act 2020 and the Oil Regulations 1999"]
    go("query", "--query", "barrels of oak", "--k", "1")
    assert json.loads(said[-1])["section_number"] == "7"
    go("chat", "--query", "barrels of oak", "--backend", "quote", "--k", "1")
    assert any("oil is kept in barrels" in x for x in said)
    go("evaluate", "--num-queries", "4", "--document", "lamp_act", "--eval-dir", str(tmp_path / "eval"))
    assert "precision@10" in said[-1] and (tmp_path / "eval" / "report.json").exists()
    with pytest.raises(SystemExit):
        parser().parse_args(["process"])


def test_menu():
    assert menu.parse_selection("all", 3) == [0, 1, 2] and menu.parse_selection("3, 1-2 2", 3) == [2, 0, 1] and menu.parse_selection("", 3) == []
    for bad in ("4", "0", "x", "2-1", "1-x"):
        with pytest.raises(ValueError):
            menu.parse_selection(bad, 3)
    assert menu.command("query", query="a b", k=3, expand=False, out=None, no_rag=True, pdfs=["x", "y"])[3:] == ["query", "--query", "a b", "--k", "3", "--no-rag", "--pdfs", "x", "y"]
    started, said = [], []
    lines = iter(["9", "2", "lamps", "4", "3", "n", "1", "", "5"])
    menu.Menu(lambda _: next(lines), said.append, started.append, "/nowhere/*.pdf").run()
    assert started[0][3:] == ["query", "--query", "lamps", "--k", "4"] and started[1][3:] == ["chat", "--no-rag"] and len(started) == 2 and "9 is no choice" in said


def test_pages_that_land(spark, tmp_path):
    landing, index = str(tmp_path / "landing"), str(tmp_path / "index")
    rows = [(d, n, t, 1.0, 1.0) for d, n, t in PAGES]
    for part in (rows[:1], rows[1:], rows[:1]):
        spark.createDataFrame(part, store.PAGES).write.mode("append").parquet(landing)
        index_new_pages(spark, landing, index, str(tmp_path / "state")).awaitTermination()
    got = read_batches(spark, index)
    assert got.count() == 5 and len({r["ordinal"] for r in got.collect()}) == 5
    found = Engine(spark).use(got).search(asked(spark, "barrels of oak"), 1).first()
    assert found["section_number"] == "7"


def test_prompts():
    text = answers.system_prompt("the Lamp Act 2020")
    assert "the Lamp Act 2020" in text and text.count("\n") == 8
    assert [m["role"] for m in answers.messages("q", [{"role": "user", "content": "a"}])] == ["system", "user", "user"]
    assert metrics.KS == (1, 3, 5, 10)
