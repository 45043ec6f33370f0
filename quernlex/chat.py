"""Conversations over an index, and a terminal for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from quernlex.engine import Engine
from quernlex.operators import answers, graph
from quernlex.session import checkpoint

COMMANDS = {
    "/help": "list the commands",
    "/clear": "forget the conversation",
    "/history": "show its last messages",
    "/rag on|off": "answer from the index, or without it",
    "/quit": "leave",
}


class Conversation:
    """Questions and answers, one after another; each answer comes with its sources and a check of what it cites."""

    def __init__(self, engine: Engine, backend, k: int = 10, exchanges: int = 3) -> None:
        self.engine, self.backend, self.k, self.exchanges = engine, backend, k, exchanges
        self.history: list[dict] = []
        self.corpus = engine.describe()
        self.system = answers.system_prompt(self.corpus)

    def recent(self) -> list[dict]:
        """The last exchanges; none for 0 or fewer."""
        return self.history[-2 * self.exchanges :] if self.exchanges > 0 else []

    def ask(self, question: str, retrieve: bool = True) -> dict:
        """response, sources, citations, checks, lines and how the service ended; only this question is searched for."""
        spark = self.engine.spark
        found = None
        sources: list[dict] = []
        if retrieve:
            asked = spark.createDataFrame([("q", question)], "query_id string, text string")
            found = checkpoint(self.engine.search(asked, self.k, expand=True).withColumn("title", answers.source_title()))
            shown = ("rank", "chunk_id", "document_name", "section_number", "title", "text", "expansion", "expansion_reason")
            sources = [r.asDict() for r in found.select(*shown).orderBy("rank").collect()]  # k and its expansions
        reply = answers.Reply("")
        if retrieve and hasattr(self.backend, "answer_with_documents"):
            reply = self.backend.answer_with_documents(question, sources, history=self.recent(), system=self.system)
        else:
            context = answers.contexts(found).first() if sources else None
            if retrieve:
                prompt = f"Answer from the extracts alone, name the sections, and say so where they have no answer.\n\nQuestion: {question}\n\nExtracts:\n{context['context'] if context else ''}\n\nAnswer:"
            else:
                prompt = f"A question about legislation: {question}\n\nAnswer:"
            reply.text = self.backend.generate(prompt, history=self.recent(), system=self.system)
        self.history += [{"role": "user", "content": question}, {"role": "assistant", "content": reply.text}]
        checks, lines = self.check(reply.text, [s["chunk_id"] for s in sources])
        return {"query": question, "response": reply.text, "sources": sources, "citations": reply.citations, "checks": checks, "lines": lines, "model": reply.model, "stop_reason": reply.stop_reason, "fallback": reply.fallback}

    def check(self, answer: str, chunk_ids: list[str]) -> tuple[list[dict], list[str]]:
        """Verdicts on the provisions that an answer cites, against what was retrieved and the whole index."""
        index = self.engine.index
        if index is None:
            return [], []
        given = self.engine.spark.createDataFrame([("a", answer)], "answer_id string, text string")
        got = index.where(F.col("chunk_id").isin(chunk_ids)).withColumn("answer_id", F.lit("a"))
        verdicts = graph.verify(given, got, index).orderBy("refpos")
        lines = graph.report_lines(verdicts).first()
        return [r.asDict() for r in verdicts.select("label", "verdict").collect()], list(lines["lines"]) if lines else []


def described(result: dict) -> list[str]:
    """The lines under an answer: its sources, the passages it cites, and the check."""
    out = []
    if result["sources"]:
        out.append("Sources")
        for i, s in enumerate(result["sources"], 1):
            why = f" (added: {s['expansion']})" if s["expansion"] else ""
            out.append(f"  {i}. {s['title']}{why}")
    if result["citations"]:
        out.append("Passages")
        for c in result["citations"]:
            text = " ".join(c.get("cited_text", "").split())
            out.append(f"  {c['document_index'] + 1}. {text if len(text) <= 120 else text[:117] + '...'}")
    if result["fallback"]:
        out.append(f"Another model answered: {result['model']}")
    return out + result["lines"]


class Terminal:
    """Reads questions and commands until /quit or the end of input."""

    def __init__(self, conversation: Conversation, retrieve: bool = True, read: Callable[[str], str] = input, write: Callable[[str], None] = print) -> None:
        self.conversation, self.retrieve, self.read, self.write = conversation, retrieve, read, write

    def run(self) -> None:
        self.write(f"Questions about {self.conversation.corpus}. /help lists the commands.")
        while True:
            try:
                line = self.read("> ").strip()
            except (EOFError, KeyboardInterrupt):
                return
            if line.startswith("/"):
                if not self.command(*line.split()):
                    return
            elif line:
                self.question(line)

    def question(self, line: str) -> None:
        try:
            result = self.conversation.ask(line, self.retrieve)
        except Exception as e:  # a question that fails doesn't end the conversation
            self.write(f"That failed: {e}")
            return
        for text in (result["response"], *described(result)):
            self.write(text)

    def command(self, name: str, *given: str) -> bool:
        """Whether to go on."""
        name = name.lower()
        if name == "/quit":
            return False
        if name == "/help":
            for x, what in COMMANDS.items():
                self.write(f"{x:12} {what}")
        elif name == "/clear":
            self.conversation.history.clear()
            self.write("The conversation is forgotten.")
        elif name == "/history":
            for m in self.conversation.history[-10:]:
                text = m["content"]
                self.write(f"{m['role']}: {text if len(text) <= 100 else text[:100] + '...'}")
            if not self.conversation.history:
                self.write("Nothing was said yet.")
        elif name == "/rag":
            if given and given[0].lower() in ("on", "off"):
                self.retrieve = given[0].lower() == "on"
            self.write(f"Answers come from {'the index' if self.retrieve else 'the model alone'}." if not given or given[0].lower() in ("on", "off") else "/rag takes on or off.")
        else:
            self.write(f"{name} is no command; /help lists them.")
        return True
