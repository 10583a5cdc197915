"""The store as an object: taking in, searching, facts, summaries; and its tools for programs."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.models import embed_all
from larkspur.operators import ann, classify, fusion, graph, lexical, store, vector
from larkspur.plans import layers
from larkspur.session import ship
from larkspur.sources import conversations, files
from larkspur.sources.tables import Tables

Embed = Callable[[list[str]], list[list[float]]]


class Memory:
    """All methods return DataFrames or small values; tables change by new versions."""

    def __init__(self, spark: SparkSession, root: str, embed: Embed | None = None, complete: Callable[[str], str] | None = None):
        self.spark, self.root, self.embed, self.complete = ship(spark), root.rstrip("/"), embed, complete
        self.tables = Tables(spark, root)

    # Taking in.

    def add_wing(self, name: str, kind: str = "general", keywords: str = "") -> None:
        wings = self.tables.read("wings")
        new = self.spark.createDataFrame([(wings.count() + 1, name, kind, keywords)], wings.schema)
        self.tables.append("wings", store.add_names(wings, new, ["name"]))

    def add(self, items: DataFrame) -> int:
        """Adds items (content, wing, room[, hall, source_file, source_type]); returns how many were new."""
        since, state = self.tables.state()
        stored = self.tables.parts("drawers", state.get("drawers", []))
        last = stored.agg(F.coalesce(F.max("drawer_id"), F.lit(0))).first()[0]
        new = store.add_drawers(stored, items.withColumn("drawer_id", F.monotonically_increasing_id()))
        part = self.tables.write("drawers", new.withColumn("drawer_id", F.lit(last + 1) + F.col("drawer_id")))
        new = self.tables.parts("drawers", [part])
        n = new.count()
        if n:  # drawers and their postings count at once or not at all
            index = self.tables.write("postings", lexical.postings(new), "term")
            self.tables.commit(since, {"drawers": self.tables.longer("drawers", part), "postings": self.tables.longer("postings", index, "term")})
        return n

    def drawer(self, drawer_id: int) -> DataFrame:
        """The drawer of that id, or no row."""
        return store.got(self.tables.read("drawers"), self.spark.createDataFrame([(drawer_id,)], "drawer_id long"))

    def mine(self, folder: str, wing: str | None = None) -> dict:
        """Takes in the text files below a folder."""
        wing = wing or os.path.basename(folder.rstrip("/"))
        self.add_wing(wing, "project")
        found = files.read_files(self.spark, folder)
        rooms = store.detect_rooms(found, "path", "content").withColumnRenamed("path", "p")
        items = found.join(rooms, F.col("path") == F.col("p")).select("content", F.lit(wing).alias("wing"), "room", F.col("path").alias("source_file"))
        processed = found.count()
        created = self.add(items)
        return {"processed": processed, "created": created, "duplicates": processed - created}

    def add_conversations(self, texts: DataFrame, wing: str, room: str = "sessions") -> int:
        """Takes in conversation files (path, content) as three views each."""
        turns = conversations.parse(texts).withColumnRenamed("path", "conv_id")
        views = conversations.views(turns).select("content", F.lit(wing).alias("wing"), F.lit(room).alias("room"), "hall", F.col("conv_id").alias("source_file"), F.lit("conversation").alias("source_type"))
        self.add_wing(wing)
        return self.add(views)

    def reindex(self, batch: int = 64) -> int:
        """Embeds what has no embedding yet, once; what the model fails at stays pending. Returns the number done."""
        if not self.embed:
            raise ValueError("no embedder")
        done = self.tables.read("embeddings")
        new = embed_all(store.pending(self.tables.read("drawers"), done), self.embed, batch).filter("not failed")
        before = done.count()
        self.tables.append("embeddings", new.select("drawer_id", "vector", F.lit(before).alias("seq")))
        return self.tables.read("embeddings").count() - before

    # Searching.

    def search(self, query: str, mode: str = "hybrid", limit: int = 5, wing: str | None = None, room: str | None = None, sessions: list[str] | None = None,
               hnsw: bool = False, views: bool = False, per_type: bool = False, recency: float = 0, query2doc: bool = False) -> DataFrame:
        """Results of one query: hybrid, vector, or for any other mode lexical. An unknown wing is an error, a room
        counts within a wing only, and the graph index knows no filters."""
        stored = self.tables.read("drawers")
        if wing is not None and stored.filter(F.col("wing") == wing).isEmpty() and self.tables.read("wings").filter(F.col("name") == wing).isEmpty():
            raise ValueError(f"no wing {wing}")
        if hnsw and sessions:
            raise ValueError("the graph index can't be narrowed to sessions")
        narrowed = lexical.scope(stored, wing, room, sessions)
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        index, vectors = self.tables.read("postings"), store.latest(self.tables.read("embeddings"), ["drawer_id"], "seq")
        if mode in ("vector", "hybrid") and self.embed:
            v = self.embed([query])[0] if query.strip() else []
            asked = self.spark.createDataFrame([(0, query, [float(x) for x in v])], "query_id long, query string, query_vector array<float>")
            if query2doc and self.complete:
                asked = fusion.expanded(asked, self.complete, self.embed)
        elif mode in ("vector", "hybrid"):
            raise ValueError("no embedder")
        if mode == "vector":
            if hnsw:
                found = ann.search(ann.load_or_build(self.spark, f"{self.root}/ann", vectors), asked, limit)
            elif views:
                found = fusion.multiview(vectors, stored, asked, limit, narrowed).select("query_id", "drawer_id", "score", "rank")
            else:
                found = vector.search(vectors, asked, limit, narrowed)
        elif mode == "hybrid":
            weight = fusion.type_weight(classify.question_type(F.col("query"))) if per_type else 0.5
            found = fusion.hybrid(index, vectors, asked, limit, weight, narrowed)
        else:
            found = lexical.bm25(index, asked, limit, narrowed)
        if recency:
            found = fusion.recency(found, recency)
        return lexical.hydrated(found, stored, limit <= lexical.BROADCAST_TERMS).orderBy("rank")

    # Facts.

    def add_fact(self, subject: str, predicate: str, obj: str, valid_from: str = "", valid_to: str = "", check: bool = True) -> DataFrame:
        """Adds a fact; returns the open facts that it contradicts, which don't keep it out."""
        triples, entities = self.tables.read("triples"), self.tables.read("entities")
        fact = self.spark.createDataFrame([(triples.count(), subject, predicate, obj, valid_from, valid_to)], "seq long, subject string, predicate string, object string, valid_from string, valid_to string")
        found = graph.conflicts(triples, fact) if check else graph.conflicts(triples.limit(0), fact)
        self.tables.append("entities", graph.named_entities(fact).join(entities.select("entity_id"), "entity_id", "left_anti"))
        self.tables.append("triples", graph.new_triples(triples, fact))
        return found

    def end_fact(self, subject: str, predicate: str, obj: str, ended: str = "") -> None:
        ends = self.spark.createDataFrame([(subject, predicate, obj, ended)], "subject string, predicate string, object string, ended string")
        self.tables.replace("triples", graph.invalidated(self.tables.read("triples"), ends))

    def facts(self, name: str, as_of: str | None = None, direction: str = "both") -> DataFrame:
        asked = self.spark.createDataFrame([(name, as_of)], "name string, as_of string")
        return graph.about(self.tables.read("triples"), self.tables.read("entities"), asked, direction)

    def timeline(self, name: str) -> DataFrame:
        return graph.timeline(self.tables.read("triples"), self.tables.read("entities"), name)

    def fact_stats(self) -> DataFrame:
        return graph.stats(self.tables.read("triples"), self.tables.read("entities"))

    # Summaries.

    def status(self) -> DataFrame:
        return store.status(self.tables.read("drawers"), self.tables.read("triples"), self.tables.read("entities"))

    def wings(self) -> DataFrame:
        return store.wing_breakdown(self.tables.read("wings").withColumnRenamed("name", "wing"), self.tables.read("drawers"), self.tables.read("embeddings").select("drawer_id").distinct()).orderBy("wing")

    def rooms(self, wing: str) -> DataFrame:
        return self.tables.read("drawers").filter(F.col("wing") == wing).groupBy("room").agg(F.count("*").alias("drawers")).orderBy("room")

    def tunnels(self, a: str | None = None, b: str | None = None) -> DataFrame:
        return store.tunnels(self.tables.read("drawers"), a, b)

    def wake_up(self, wing: str | None = None) -> str:
        wings = self.tables.read("wings").withColumnRenamed("name", "wing")
        return layers.wake_up(wings, self.tables.read("drawers"), layers.identity(os.path.join(self.root, "identity.txt")), wing).first()[0]


def tools(memory: Memory) -> dict[str, Callable[[dict], str]]:
    """Functions of string arguments that return text. They differ from Memory's methods: five results, an unknown wing
    doesn't filter, contents are whole, and facts aren't checked."""

    def sessions(raw) -> list[str]:
        return [str(x).strip() for x in (raw if isinstance(raw, list) else str(raw or "").split(",")) if str(x).strip()]

    def search(a: dict) -> str:
        known = {r[0] for r in memory.tables.read("wings").select("name").collect()} | {r[0] for r in memory.tables.read("drawers").select("wing").distinct().collect()}
        wing = a.get("wing") if a.get("wing") in known else None
        mode = a.get("mode") or ("hybrid" if memory.embed else "bm25")
        rows = memory.search(str(a.get("query", "")), mode, 5, wing, a.get("room") or None, sessions(a.get("session_ids")) or None).collect()
        return "\n\n".join(f"[{r.rank}] {r.wing} / {r.room} ({r.score:.3f})\n{r.content}" for r in rows) or "No results."

    def add(a: dict) -> str:
        row = [(str(a.get("content", "")), str(a.get("wing", "general")), str(a.get("room", "general")), str(a.get("hall", "facts")))]
        memory.add_wing(row[0][1])
        return "added" if memory.add(memory.spark.createDataFrame(row, "content string, wing string, room string, hall string")) else "duplicate"

    def lines(df: DataFrame) -> str:
        return "\n".join("  ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in df.collect())

    def add_fact(a: dict) -> str:
        memory.add_fact(*(str(a.get(k, "")) for k in ("subject", "predicate", "object", "valid_from", "valid_to")), check=False)
        return "added"

    return {
        "search": search, "add_drawer": add, "get_drawer": lambda a: lines(memory.drawer(int(a.get("id", 0)))), "status": lambda a: lines(memory.status()), "wake_up": lambda a: memory.wake_up(a.get("wing") or None),
        "kg_query": lambda a: lines(memory.facts(str(a.get("entity", "")), a.get("as_of") or None)), "kg_add": add_fact,
        "list_wings": lambda a: lines(memory.wings()), "list_rooms": lambda a: lines(memory.rooms(str(a.get("wing", "")))),
    }
