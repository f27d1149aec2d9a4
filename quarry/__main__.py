"""Command line: index a folder, show its status, search, list sources."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from quarry.api import Service
from quarry.config import CODE_EXTENSIONS, CONFIG_EXTENSIONS, load
from quarry.sources import sync
from quarry.sources.http import HttpEmbedder, HttpReranker
from quarry.sources.services import HashEmbedder, reranker


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("command", choices=["index", "status", "search", "sources", "stats"])
    p.add_argument("target", nargs="?", default="", help="a folder, or the query of a search")
    p.add_argument("--store-path", required=True)
    p.add_argument("--store", default="default")
    p.add_argument("--project", default="default")
    p.add_argument("--extensions", default=",".join((*CODE_EXTENSIONS, *CONFIG_EXTENSIONS, "md", "txt")))
    p.add_argument("--force", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--export-plan")
    p.add_argument("--limit", type=int)
    p.add_argument("--embedding-url", help="base of an embedding service; without it vectors are word hashes")
    p.add_argument("--embedding-model", default="")
    p.add_argument("--embedding-key-variable", default="EMBEDDING_KEY", help="the environment variable that holds the service's key")
    p.add_argument("--rerank", action="store_true", help="rerank by the same service")
    p.add_argument("--mode", choices=["hybrid", "semantic", "lexical"], default="hybrid")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    config, key = load(), os.environ.get(a.embedding_key_variable, "")
    embedder = HttpEmbedder(a.embedding_url, key, a.embedding_model, config.vector_dim, per_minute=config.embed_per_minute) if a.embedding_url else HashEmbedder()
    service = Service(spark, a.store_path, config, embedder)
    if a.rerank and a.embedding_url:
        asked = spark.createDataFrame([(0, a.target)], "qid long, query string")
        service.rerank = reranker(HttpReranker(a.embedding_url, key, top=config.rerank_top), asked)
    extensions = [e.strip() for e in a.extensions.split(",") if e.strip()]
    if a.command == "index":
        planned = service.plan(a.target, a.store, a.project, extensions, a.force)
        if a.export_plan:
            sync.export(planned[0], a.export_plan)
        done = sync.counters(planned[0]) if a.dry_run else service.index(a.target, a.store, a.project, extensions, a.force, planned)
        print(json.dumps(done.first().asDict()))
    elif a.command == "status":
        planned, _ = service.plan(a.target, a.store, a.project, extensions)
        for r in sync.status(planned).toLocalIterator():
            print(f"{r['status']:<11}{r['doc_path']}")
    elif a.command == "search":
        found = service.search(a.store, a.target, a.limit, project_id=a.project, mode=a.mode)
        for r in found.collect():  # at most the result limit
            print(f"── {r['source']}  [{r['score']:.4f}]\n{r['content']}\n")
    else:
        for r in (service.sources if a.command == "sources" else service.stats)(a.store, a.project).toLocalIterator():
            print(json.dumps(r.asDict()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
