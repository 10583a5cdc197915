"""Models as injected callables: HTTP clients for embedding, chat and reranking services, and an offline embedder."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from larkspur.functions.text import STOPWORDS

Post = Callable[[str, dict, str], dict]
RETRIED = (408, 429)


def post(url: str, body: dict, key: str = "", timeout: float = 60) -> dict:
    """POSTs JSON and returns the answer's."""
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as answer:
        return json.loads(answer.read())


def passing(error: Exception) -> bool:
    """Whether another attempt may help: a network or parse error, a timeout, a rate limit, a server's error."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code in RETRIED or error.code >= 500
    return isinstance(error, (OSError, ValueError))


def retried(call: Callable[[], dict], attempts: int, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Tries again after n * n seconds, if the error may pass."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception as error:  # noqa: BLE001
            if n == attempts or not passing(error):
                raise
            sleep(n * n)
    raise AssertionError


@dataclass(frozen=True)
class Embedder:
    """Vectors of texts from a service that takes {input, model} and returns {data: [{embedding, index}]}."""

    url: str
    model: str
    key: str = ""
    send: Post = post
    sleep: Callable[[float], None] = time.sleep

    def batch(self, texts: list[str]) -> list[list[float]]:
        """All vectors in the texts' order; a missing one is an error."""
        if not texts:
            return []
        answer = retried(lambda: self.send(self.url, {"input": texts, "model": self.model}, self.key), 4, self.sleep)
        found = {x["index"]: x["embedding"] for x in answer.get("data", [])}
        if any(not found.get(i) for i in range(len(texts))):
            raise ValueError("the service left vectors out")
        return [found[i] for i in range(len(texts))]

    def adaptive(self, texts: list[str]) -> list[list[float]]:
        """Halves a batch that fails; a single text that fails makes the whole batch fail."""
        try:
            return self.batch(texts)
        except Exception:
            if len(texts) < 2:
                raise
            half = len(texts) // 2
            return self.adaptive(texts[:half]) + self.adaptive(texts[half:])

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return self.adaptive(texts)


@dataclass(frozen=True)
class Chat:
    """A completion of one user message."""

    url: str
    model: str
    key: str = ""
    most: int = 100
    send: Post = post

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "max_tokens": self.most}
        return retried(lambda: self.send(self.url, body, self.key), 3)["choices"][0]["message"]["content"].strip()


@dataclass(frozen=True)
class Reranker:
    """Scores of documents for a query; one that the service leaves out has 0."""

    url: str
    model: str
    key: str = ""
    send: Post = post

    def __call__(self, query: str, documents: list[str]) -> list[float]:
        if not documents:
            return []
        answer = retried(lambda: self.send(self.url, {"model": self.model, "query": query, "documents": documents}, self.key), 3)
        scores = [0.0] * len(documents)
        for x in answer.get("results", []):
            if 0 <= x["index"] < len(scores):
                scores[x["index"]] = float(x["relevance_score"])
        return scores


@dataclass(frozen=True)
class HashEmbedder:
    """An offline embedder: signed hashes of words and their character trigrams, of unit length."""

    dimension: int = 256

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                parts = [word, *(f" {word} "[k : k + 3] for k in range(len(word)))] if word not in STOPWORDS else []
                for part in parts:
                    h = int.from_bytes(hashlib.blake2b(part.encode(), digest_size=8).digest(), "little")
                    out[i, h % self.dimension] += 1 if h >> 63 else -1
            norm = np.linalg.norm(out[i])
            out[i] /= norm or 1
        return out.tolist()


def embed_all(pending: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 64, workers: int | None = None) -> DataFrame:
    """Rows (drawer_id, vector, failed) of drawers (drawer_id, content), in batches; the rows of a batch that fails, and
    empty vectors, are marked failed and have none, so a loop over them ends."""

    def run(parts):
        for part in parts:
            for i in range(0, len(part), batch):
                some = part.iloc[i : i + batch]
                try:
                    vectors = [list(v) if len(v) else None for v in embed(some["content"].tolist())]
                except Exception:  # noqa: BLE001  other batches go on
                    vectors = [None] * len(some)
                yield pd.DataFrame({"drawer_id": some["drawer_id"], "vector": vectors, "failed": [v is None for v in vectors]})

    rows = pending.select("drawer_id", "content")
    return (rows.repartition(workers) if workers else rows).mapInPandas(run, "drawer_id long, vector array<float>, failed boolean")
