"""Clients of model services over HTTP, by the names ``openai`` and ``ollama``; nothing is sent unless one is asked for by name."""

from __future__ import annotations

import json
import os
import urllib.request

from quire.operators import enrich


def _asked(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    sent = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(sent, timeout=timeout) as answer:
        return json.load(answer)


class OpenAI:
    """Chat completions; also of servers that speak the same protocol. The key is taken from OPENAI_API_KEY where none is given."""

    def __init__(self, model: str = "gpt-4o-mini", key: str | None = None, base_url: str = "https://api.openai.com/v1", temperature: float = 0.0, timeout: float = 120.0) -> None:
        self.model, self.key, self.base_url, self.temperature, self.timeout = model, key, base_url.rstrip("/"), temperature, timeout

    def answer(self, prompt: str, history: list[dict] | None = None) -> tuple[str, bool]:
        """The text, and whether it came to its end."""
        key = self.key or os.environ.get("OPENAI_API_KEY")
        body = {"model": self.model, "messages": [*(history or []), {"role": "user", "content": prompt}], "temperature": self.temperature}
        first = _asked(f"{self.base_url}/chat/completions", body, {"Authorization": f"Bearer {key}"} if key else {}, self.timeout)["choices"][0]
        return first["message"]["content"], first.get("finish_reason") != "length"

    def chat(self, prompt: str) -> str:
        return self.answer(prompt)[0]

    def count_tokens(self, text: str) -> int:
        try:
            import tiktoken

            return len(tiktoken.encoding_for_model(self.model).encode(text, disallowed_special=()))
        except Exception:  # no such library, or its vocabulary isn't at hand
            return len(text) // 4


class Ollama:
    def __init__(self, model: str = "llama3", base_url: str = "http://localhost:11434", temperature: float = 0.0, timeout: float = 300.0) -> None:
        self.model, self.base_url, self.temperature, self.timeout = model, base_url.rstrip("/"), temperature, timeout

    def answer(self, prompt: str, history: list[dict] | None = None) -> tuple[str, bool]:
        """The text, and whether it came to its end."""
        body = {"model": self.model, "messages": [*(history or []), {"role": "user", "content": prompt}], "stream": False, "options": {"temperature": self.temperature}}
        out = _asked(f"{self.base_url}/api/chat", body, {}, self.timeout)
        return out["message"]["content"], out.get("done_reason") != "length"

    def chat(self, prompt: str) -> str:
        return self.answer(prompt)[0]

    def count_tokens(self, text: str) -> int:
        return len(text) // 4


enrich.register("openai", OpenAI)
enrich.register("ollama", Ollama)
