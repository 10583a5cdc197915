"""Settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    root: str
    embeddings: tuple[str, str, str]  # url, model, key
    rerank: tuple[str, str, str]
    chat: tuple[str, str, str]

    @staticmethod
    def enabled(service: tuple[str, str, str]) -> bool:
        return bool(service[0] and service[1])

    @property
    def identity(self) -> str:
        return os.path.join(self.root, "identity.txt")


def load(env: Mapping[str, str] = os.environ) -> Config:
    """LARKSPUR_ROOT, and LARKSPUR_{EMBEDDINGS,RERANK,LLM}_{URL,MODEL,API_KEY}; a missing key is the embeddings'."""
    get = lambda name: env.get(f"LARKSPUR_{name}", "")
    first = get("EMBEDDINGS_API_KEY")
    service = lambda name: (get(f"{name}_URL"), get(f"{name}_MODEL"), get(f"{name}_API_KEY") or first)
    root = get("ROOT") or os.path.join(env.get("HOME", "."), ".larkspur")
    return Config(root, service("EMBEDDINGS"), service("RERANK"), service("LLM"))
