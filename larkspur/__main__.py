"""Commands over a store: python -m larkspur COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from larkspur import config
from larkspur.memory import Memory, tools
from larkspur.models import Chat, Embedder, HashEmbedder
from larkspur.operators.lexical import rendered


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larkspur")
    p.add_argument("--root")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("init")
    mine = commands.add_parser("mine")
    mine.add_argument("folder")
    mine.add_argument("--wing")
    search = commands.add_parser("search")
    search.add_argument("query")
    for name in ("wing", "room", "session-ids"):
        search.add_argument(f"--{name}")
    search.add_argument("--mode", default="hybrid")
    search.add_argument("--limit", type=int, default=5)
    search.add_argument("--recency", type=float, default=0)
    for name in ("hnsw", "views", "per-type", "query2doc"):
        search.add_argument(f"--{name}", action="store_true")
    commands.add_parser("status")
    wake = commands.add_parser("wake-up")
    wake.add_argument("--wing")
    commands.add_parser("reindex")
    benchmark = commands.add_parser("benchmark")
    benchmark.add_argument("--drawers", type=int, default=1000)
    benchmark.add_argument("--queries", type=int, default=10)
    kg = commands.add_parser("kg").add_subparsers(dest="action", required=True)
    for name in ("add", "invalidate"):
        k = kg.add_parser(name)
        for x in ("subject", "predicate", "object"):
            k.add_argument(x)
        k.add_argument("--from", dest="valid_from", default="")
        k.add_argument("--to", dest="valid_to", default="")
    for name in ("query", "timeline"):
        k = kg.add_parser(name)
        k.add_argument("entity")
        k.add_argument("--as-of")
        k.add_argument("--direction", default="both")
    kg.add_parser("stats")
    commands.add_parser("serve", help="tools as JSON lines: {tool, arguments} in, {text} out")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    c = config.load()
    spark = SparkSession.builder.appName("larkspur").getOrCreate()
    embed = Embedder(*c.embeddings) if c.enabled(c.embeddings) else HashEmbedder()
    memory = Memory(spark, a.root or c.root, embed, Chat(*c.chat, most=80) if c.enabled(c.chat) else None)
    if a.command == "benchmark":
        from larkspur import benchmark

        print(json.dumps(benchmark.run(spark, a.drawers, queries=a.queries)))
    elif a.command == "mine":
        print(json.dumps(memory.mine(a.folder, a.wing)))
    elif a.command == "search":
        sessions = [x.strip() for x in (a.session_ids or "").split(",") if x.strip()]
        found = memory.search(a.query, a.mode, a.limit, a.wing, a.room, sessions or None, a.hnsw, a.views, a.per_type, a.recency, a.query2doc)
        for row in rendered(found).orderBy("rank").collect():
            print(row.line, end="\n\n")
    elif a.command == "wake-up":
        print(memory.wake_up(a.wing))
    elif a.command == "reindex":
        print(memory.reindex())
    elif a.command == "serve":
        offered = tools(memory)
        for line in sys.stdin:
            asked = json.loads(line)
            print(json.dumps({"text": offered[asked["tool"]](asked.get("arguments", {}))}), flush=True)
    elif a.command == "kg":
        if a.action == "add":
            memory.add_fact(a.subject, a.predicate, a.object, a.valid_from, a.valid_to).show(truncate=False)
        elif a.action == "invalidate":
            memory.end_fact(a.subject, a.predicate, a.object, a.valid_to)
        else:
            {"query": lambda: memory.facts(a.entity, a.as_of, a.direction), "timeline": lambda: memory.timeline(a.entity), "stats": memory.fact_stats}[a.action]().show(truncate=False)
    else:
        memory.status().show()
        memory.wings().show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
