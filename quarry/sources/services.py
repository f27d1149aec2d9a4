"""Embedding and reranking services behind small interfaces, with retries and a rate limit.

Services run inside mapInPandas on batches of texts, so a cluster's tasks call
them side by side and no text passes through the driver."""

from __future__ import annotations

import copy
import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """An offline stand-in: word hashes summed into a unit vector."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out


def retry(call: Callable[[], object], delays: tuple[float, ...], again: Callable[[Exception], bool], sleep: Callable[[float], None] = time.sleep) -> object:
    """call(), tried once more after each delay while its error allows it."""
    for delay in (*delays, None):
        try:
            return call()
        except Exception as e:
            if delay is None or not again(e):
                raise
            sleep(delay)
    raise AssertionError


class RateLimiter:
    """At most `per_minute` calls in a minute (window) after a first delay; each refusal doubles the wait, one cool-down, then an end."""

    def __init__(self, per_minute: int = 200, warm_up: float = 0.0, cool_down: float = 60.0, most_refusals: int = 5, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, window: float = 60.0):
        self.per_minute, self.cool_down, self.most_refusals, self.clock, self.sleep, self.window = per_minute, cool_down, most_refusals, clock, sleep, window
        self.calls: list[float] = []
        self.refusals, self.cooled, self.ready = 0, False, clock() + warm_up

    def wait(self) -> None:
        now = self.clock()
        if now < self.ready:
            self.sleep(self.ready - now)
        now = self.clock()
        self.calls = [t for t in self.calls if now - t < self.window]
        if len(self.calls) >= self.per_minute:
            self.sleep(self.window - (now - self.calls[0]))
        self.calls.append(self.clock())

    def refused(self) -> None:
        self.refusals += 1
        if self.refusals < self.most_refusals:
            self.sleep(2.0**self.refusals)
        elif not self.cooled:
            self.cooled, self.refusals = True, 0
            self.sleep(self.cool_down)
        else:
            raise RuntimeError("rate limit: still refused after the cool-down")

    def accepted(self) -> None:
        self.refusals = 0


def shared_out(rows: DataFrame, embedder: Embedder) -> tuple[DataFrame, Embedder]:
    """Rows in lanes, and an embedder for a lane: where it may make `per_minute` calls, each of n lanes makes an n-th of them.

    A lane is one task, so all tasks together keep to the budget, however many run at once."""
    budget = getattr(embedder, "per_minute", None)
    if not budget:
        return rows, embedder
    lanes = max(1, min(budget, rows.sparkSession.sparkContext.defaultParallelism))
    own = copy.copy(embedder)
    own.per_minute = budget // lanes
    return rows.repartition(lanes), own


def embed_missing(rows: DataFrame, embedder: Embedder, batch: int = 48) -> DataFrame:
    """Rows with an embedding wherever it was null, made from semantic_content, else content."""
    schema = rows.schema
    missing, embedder = shared_out(rows.where("embedding IS NULL"), embedder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            todo = [i for i, v in enumerate(frame["embedding"]) if v is None]
            made = list(frame["embedding"])
            for a in range(0, len(todo), batch):
                part = todo[a : a + batch]
                texts = [frame["semantic_content"].iloc[i] or frame["content"].iloc[i] or "" for i in part]
                vectors = embedder.embed(texts)
                if len(vectors) != len(part) or any(len(v) != embedder.dim for v in vectors):
                    raise ValueError("the embedder returned vectors of another number or size")
                for i, v in zip(part, vectors, strict=True):
                    made[i] = v
            frame["embedding"] = pd.Series(made, index=frame.index, dtype=object)
            yield frame

    have = rows.where("embedding IS NOT NULL")
    return have.unionByName(missing.mapInPandas(run, schema))


def reranker(score: Callable[[str, list[str]], list[float] | None], queries: DataFrame) -> Callable[[DataFrame, int], DataFrame]:
    """A reranking step from a function of (query, texts); None from it leaves a query's order, cut to the number kept;
    texts without a number (NaN) go.

    Groups are a query's pool, which the pipeline bounds before."""

    def step(pool: DataFrame, keep: int) -> DataFrame:
        joined = pool.join(queries.select("qid", F.col("query").alias("_query")), "qid")

        def one(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("pos")
            texts = [a if isinstance(a, str) and a.strip() else b for a, b in zip(frame["lexical_content"], frame["content"], strict=True)]
            found = score(frame["_query"].iloc[0], texts)
            if found is not None:
                frame = frame.assign(score=[float(x) for x in found]).dropna(subset=["score"]).sort_values(["score", "pos"], ascending=[False, True], kind="stable")
            frame = frame.head(keep)
            return frame.assign(pos=range(1, len(frame) + 1)).drop(columns="_query")

        return joined.groupBy("qid").applyInPandas(one, pool.schema)

    return step

