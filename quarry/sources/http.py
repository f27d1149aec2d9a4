"""Embedding and reranking over HTTP, for the tasks that call them, and the check of a caller's key."""

from __future__ import annotations

import hmac
import json
import math
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from .services import RateLimiter, retry

#: Answers that may be followed by another try: too many calls, not available.
BUSY = (429, 503)


def post(url: str, key: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def _lost(e: Exception) -> bool:
    """No answer, or none yet: anything but an answer with a status that is not BUSY."""
    return e.code in BUSY if isinstance(e, urllib.error.HTTPError) else isinstance(e, (urllib.error.URLError, OSError))


@dataclass
class HttpEmbedder:
    """Vectors from POST <base>/v1/embeddings, put in order by their index, of `dim` numbers each.

    Calls are tried again after delays when the service is busy or out of reach; a refusal (429) slows its task down, and
    each task keeps to its share of the calls a minute (`per_minute`, divided by services.shared_out)."""

    base: str
    key: str
    model: str
    dim: int
    timeout: float = 120.0
    delays: tuple[float, ...] = (1.0, 3.0)
    per_minute: int = 200
    window: float = 60.0
    _limiter: RateLimiter | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_limiter": None}  # each Python worker counts its own calls

    def embed(self, texts: list[str]) -> list[list[float]]:
        self._limiter = limiter = self._limiter or RateLimiter(self.per_minute, window=self.window)
        if not texts:
            return []

        def call() -> dict:
            limiter.wait()
            try:
                answer = post(f"{self.base.rstrip('/')}/v1/embeddings", self.key, {"model": self.model, "input": texts}, self.timeout)
            except urllib.error.HTTPError as e:
                if e.code == 429:
                    limiter.refused()
                raise
            limiter.accepted()
            return answer

        found = sorted(retry(call, self.delays, _lost)["data"], key=lambda x: x["index"])
        vectors = [x["embedding"] for x in found]
        if len(vectors) != len(texts):
            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
        for i, v in enumerate(vectors):
            if len(v) != self.dim:
                raise ValueError(f"text {i} has a vector of {len(v)} numbers instead of {self.dim}")
        return vectors


@dataclass
class HttpReranker:
    """Relevance from POST <base>/rerank: a number a text, NaN for those that are not among the best; None if it fails."""

    base: str
    key: str
    model: str = "rerank-2"
    top: int = 15
    timeout: float = 30.0
    delays: tuple[float, ...] = (1.0, 2.0)

    def __call__(self, query: str, texts: list[str]) -> list[float] | None:
        body = {"model": self.model, "query": query, "documents": texts, "top_n": self.top}
        try:
            answer = retry(lambda: post(f"{self.base.rstrip('/')}/rerank", self.key, body, self.timeout), self.delays, _lost)
            out = [math.nan] * len(texts)
            for x in answer.get("results") or []:
                out[x["index"]] = float(x["relevance_score"])
        except (OSError, ValueError, KeyError, IndexError, TypeError):
            return None
        return out


def authorised(header: str | None, key: str) -> bool:
    """Whether an Authorization header carries the key as a bearer token; the comparison takes the same time for all."""
    if not header or not header.startswith("Bearer "):
        return False
    return hmac.compare_digest(header[7:].encode(), key.encode())
