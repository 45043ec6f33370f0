"""Answer services: any endpoint for chat, one that cites documents, a local model, and the offline default.

Services are asked over HTTP with the standard library. `post` (url, headers, body) -> reply, all
JSON, can be given in its place. A backend has generate(prompt, history, system); one that reads
documents also has answer_with_documents(question, sources, history, system).
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence

from quernlex.operators.answers import Reply, messages, quoting_backend, read_reply

Post = Callable[[str, dict, dict], dict]
EFFORTS = ("low", "medium", "high", "xhigh", "max")


class ServiceError(RuntimeError):
    """A service's failure, in words for the person who asks."""


def http_post(url: str, headers: dict, body: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=600) as reply:
            return json.load(reply)
    except urllib.error.HTTPError as e:
        reasons = {401: "The service doesn't accept the key.", 404: f"The service doesn't know the model {body.get('model')}.", 429: "The service asks to wait before the next question."}
        raise ServiceError(reasons.get(e.code, f"The service failed with status {e.code}: {e.reason}")) from e
    except urllib.error.URLError as e:
        raise ServiceError(f"The service can't be reached: {e.reason}") from e


def first_set(*names: str) -> str | None:
    """The first of these environment variables that isn't empty."""
    return next((os.environ[n] for n in names if os.environ.get(n)), None)


class Quoting:
    """Offline: answers with the first extract, word for word."""

    def generate(self, prompt: str, history: Sequence[dict] | None = None, system: str | None = None) -> str:
        return quoting_backend("", prompt.partition("Extracts:\n")[2].partition("\n\nAnswer:")[0])


class ChatEndpoint:
    """Any service with /chat/completions."""

    def __init__(self, base_url: str | None = None, model: str | None = None, max_tokens: int = 1024, temperature: float = 0.2, post: Post = http_post) -> None:
        self.base_url = base_url or first_set("CHAT_BASE_URL", "OPENAI_CHAT_BASE_URL") or "https://api.openai.com/v1"
        self.model = model or first_set("CHAT_MODEL", "OPENAI_CHAT_MODEL") or "local"
        self.max_tokens, self.temperature, self.post = max_tokens, temperature, post

    def chat(self, turns: list[dict], max_tokens: int | None = None) -> str:
        body = {"model": self.model, "messages": turns, "max_tokens": self.max_tokens if max_tokens is None else max_tokens, "temperature": self.temperature}
        key = os.environ.get("OPENAI_API_KEY") or "local"
        reply = self.post(f"{self.base_url.rstrip('/')}/chat/completions", {"Authorization": f"Bearer {key}"}, body)
        return (reply["choices"][0]["message"].get("content") or "").strip()

    def generate(self, prompt: str, history: Sequence[dict] | None = None, system: str | None = None) -> str:
        return self.chat(messages(prompt, list(history or []), system))


def document_block(source: dict) -> dict:
    """A retrieved chunk (title, text, expansion_reason) as a document that can be cited."""
    block = {"type": "document", "source": {"type": "text", "media_type": "text/plain", "data": source["text"]}, "title": source["title"], "citations": {"enabled": True}}
    if source.get("expansion_reason"):
        block["context"] = f"Not retrieved itself; added because it {source['expansion_reason']}."
    return block


class CitingEndpoint:
    """A service with /v1/messages that reads documents and cites passages of them."""

    def __init__(self, model: str | None = None, effort: str | None = None, max_tokens: int = 16_000, base_url: str = "https://api.anthropic.com", post: Post = http_post) -> None:
        self.model = model or first_set("CLAUDE_MODEL")
        if not self.model:
            raise ValueError("name a model, or set CLAUDE_MODEL")
        self.effort = effort or first_set("CLAUDE_EFFORT") or "high"
        if self.effort not in EFFORTS:
            raise ValueError(f"effort is one of {', '.join(EFFORTS)}")
        self.max_tokens, self.base_url, self.post = max_tokens, base_url, post

    def _ask(self, content, history, system) -> Reply:
        body = {"model": self.model, "max_tokens": self.max_tokens, "messages": [*(history or []), {"role": "user", "content": content}], "output_config": {"effort": self.effort}}
        if system:
            body["system"] = system
        headers = {"x-api-key": os.environ.get("ANTHROPIC_API_KEY", ""), "anthropic-version": "2023-06-01"}
        return read_reply(self.post(f"{self.base_url.rstrip('/')}/v1/messages", headers, body))

    def generate(self, prompt: str, history: Sequence[dict] | None = None, system: str | None = None) -> str:
        return self._ask(prompt, history, system).text

    def answer_with_documents(self, question: str, sources: Sequence[dict], history: Sequence[dict] | None = None, system: str | None = None) -> Reply:
        return self._ask([*map(document_block, sources), {"type": "text", "text": question}], history, system)


class LocalModel:
    """A model of the transformers library, loaded at the first question."""

    def __init__(self, model: str | None = None, max_tokens: int = 512, temperature: float = 0.0) -> None:
        self.model = model or first_set("LOCAL_CHAT_MODEL") or "google/gemma-2-2b-it"
        if self.model.lower().endswith(".gguf") or "gguf" in self.model.lower().rsplit("/", 1)[-1].split("-"):
            raise ValueError("GGUF files are for a server of their own: run one and name its endpoint")
        self.max_tokens, self.temperature, self._made = max_tokens, temperature, None

    @staticmethod
    def turns(prompt: str, history: Sequence[dict] | None, system: str | None) -> list[dict]:
        """Messages without a system role: its text leads the first question."""
        lead, *rest = messages(prompt, list(history or []), system)
        first, *others = rest
        return [{**first, "content": f"{lead['content']}\n\n{first['content']}"}, *others]

    def generate(self, prompt: str, history: Sequence[dict] | None = None, system: str | None = None) -> str:
        if self._made is None:
            from transformers import pipeline  # not a dependency of this package

            self._made = pipeline("text-generation", model=self.model)
        how = {"do_sample": True, "temperature": self.temperature} if self.temperature > 0 else {"do_sample": False}
        said = self._made(self.turns(prompt, history, system), max_new_tokens=self.max_tokens, return_full_text=False, **how)
        return said[0]["generated_text"].strip()


BACKENDS = {"claude": CitingEndpoint, "openai": ChatEndpoint, "gemma": LocalModel, "quote": Quoting}


def get_llm(backend: str | None = None, **how):
    """The backend of that name, or of CHAT_BACKEND; else the endpoint that the environment names, else the local model."""
    name = (backend or os.environ.get("CHAT_BACKEND") or "").strip().lower()
    if not name:
        name = "openai" if first_set("CHAT_BASE_URL", "OPENAI_CHAT_BASE_URL") else "gemma"
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name!r}: there are {', '.join(BACKENDS)}")
    return BACKENDS[name](**how)
