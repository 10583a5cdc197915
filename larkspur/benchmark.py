"""Timings of a made-up store: taking in, indexing, lexical, exact, graph and hybrid search."""

from __future__ import annotations

import tempfile
import time

import numpy as np
from pyspark.sql import SparkSession

from larkspur.memory import Memory
from larkspur.operators import ann, fusion, lexical, vector

TOPICS = ("tide pools", "stone bridges", "night trains", "paper maps", "river ferries", "clock towers", "salt marshes", "glass roofs", "copper mines", "wind mills", "old harbours", "snow fences")


def run(spark: SparkSession, drawers: int = 1000, dim: int = 64, queries: int = 10, root: str | None = None) -> dict[str, float]:
    """Seconds by step; those of searches are for all queries together."""
    took: dict[str, float] = {}

    def timed(name: str, work):
        began = time.perf_counter()
        out = work()
        took[name] = round(time.perf_counter() - began, 4)
        return out

    memory = Memory(spark, root or tempfile.mkdtemp(prefix="larkspur-benchmark-"))
    n = len(TOPICS)
    rows = [(f"Note {i} compares {TOPICS[i % n]} with {TOPICS[i // n % n]} for the travel journal.", "journal", f"room{i % 7}") for i in range(drawers)]
    items = spark.createDataFrame(rows, "content string, wing string, room string")
    timed("insert", lambda: memory.add(items))
    stored = memory.tables.read("drawers")
    index = timed("index", lambda: lexical.stored(lexical.postings(stored, corpus=True)))
    rng = np.random.default_rng(42)
    ids = [r.drawer_id for r in stored.select("drawer_id").collect()]
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, rng.normal(size=(len(ids), dim)))], "drawer_id long, vector array<float>").cache()
    asked = spark.createDataFrame([(q, f"where are the {TOPICS[q % n]}", x.tolist()) for q, x in enumerate(rng.normal(size=(queries, dim)))], "query_id long, query string, query_vector array<float>").cache()
    vectors.count(), asked.count()
    timed("bm25", lambda: lexical.bm25(index, asked, 10).collect())
    timed("scan", lambda: vector.search(vectors, asked, 10).collect())
    graph = ann.build(vectors).cache()
    timed("graph_build", graph.count)
    timed("graph", lambda: ann.search(graph, asked, 10).collect())
    timed("hybrid", lambda: fusion.hybrid(index, vectors, asked, 10).collect())
    for t in (vectors, asked, graph):
        t.unpersist()
    return took
