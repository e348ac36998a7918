"""Completers for hosted language models; their libraries are imported only when used, and nothing stands in for a missing one."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass


class ProviderUnavailable(RuntimeError):
    """A provider that can't be used as things stand."""


@dataclass(frozen=True)
class Usage:
    prompt: int = 0
    cached: int = 0
    reply: int = 0

    def __add__(self, other: Usage) -> Usage:
        return Usage(self.prompt + other.prompt, self.cached + other.cached, self.reply + other.reply)

    @property
    def cache_hit_rate(self) -> float:
        return self.cached / self.prompt if self.prompt else 0.0


class ChatCompleter:
    """Calls a chat client at temperature 0 and counts its tokens.

    send(model, prompt) returns (text, Usage)."""

    def __init__(self, send: Callable[[str, str], tuple[str, Usage]], model: str):
        self.send, self.model, self.usage = send, model, Usage()

    def __call__(self, prompt: str) -> str:
        text, used = self.send(self.model, prompt)
        self.usage += used
        return text


def openai_compatible(model: str | None = None, env=os.environ) -> ChatCompleter:
    """A completer for servers that speak the OpenAI chat protocol."""
    model = model or env.get("WIDEGRAIN_LLM_MODEL")
    if not model or not env.get("OPENAI_API_KEY"):
        raise ProviderUnavailable("set OPENAI_API_KEY and WIDEGRAIN_LLM_MODEL")
    try:
        import openai
    except ImportError as e:
        raise ProviderUnavailable("the openai library isn't installed") from e
    client = openai.OpenAI()

    def send(name: str, prompt: str) -> tuple[str, Usage]:
        r = client.chat.completions.create(model=name, messages=[{"role": "user", "content": prompt}], temperature=0)
        return r.choices[0].message.content or "", Usage(r.usage.prompt_tokens, 0, r.usage.completion_tokens)

    return ChatCompleter(send, model)


def anthropic_messages(model: str | None = None, env=os.environ) -> ChatCompleter:
    """A completer for servers that speak the messages protocol."""
    model = model or env.get("WIDEGRAIN_LLM_MODEL")
    if not model or not env.get("ANTHROPIC_API_KEY"):
        raise ProviderUnavailable("set ANTHROPIC_API_KEY and WIDEGRAIN_LLM_MODEL")
    try:
        import anthropic
    except ImportError as e:
        raise ProviderUnavailable("the anthropic library isn't installed") from e
    client = anthropic.Anthropic()

    def send(name: str, prompt: str) -> tuple[str, Usage]:
        r = client.messages.create(model=name, max_tokens=2000, temperature=0, messages=[{"role": "user", "content": prompt}])
        return "".join(b.text for b in r.content if b.type == "text"), Usage(r.usage.input_tokens, getattr(r.usage, "cache_read_input_tokens", 0) or 0, r.usage.output_tokens)

    return ChatCompleter(send, model)
