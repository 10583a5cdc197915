"""Approximate vector search: navigable small-world graphs, one a shard, built and searched in parallel.

A shard's graph is a row of a table (dim, ids, vectors, links), so an index is saved and loaded like any table; a search
visits all shards and re-scores what they find by the exact cosine.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.lexical import top

LINKS, BEAM_BUILD, BEAM = 16, 200, 64
SHARD, QUERY_BLOCK = 20_000, 2000  # a graph has at most about SHARD nodes
SMALL = 1000  # nodes that BEAM is wide enough for
GRAPH = "shard long, dim int, ids array<long>, vectors array<float>, links binary"


GONE = -(1 << 63)


def wide(nodes: int) -> int:
    """The width of a search that keeps its recall in a graph of so many nodes: a beam of one width finds fewer of the
    nearest the larger the graph."""
    return math.ceil(BEAM * math.sqrt(max(1.0, nodes / SMALL)))


class Graph:
    """Layered proximity graph over unit vectors."""

    def __init__(self, dim: int, seed: int = 42):
        self.dim, self.rng = dim, np.random.default_rng(seed)
        self.ids: list[int] = []
        self.vectors = np.empty((0, dim), np.float32)
        self.levels: list[list[list[int]]] = []  # a node's neighbours by layer
        self.entry = -1

    def fill(self, ids: list[int], vectors: np.ndarray) -> Graph:
        """Adds nodes; a vector is brought to unit length. An id that is there already is replaced: its old node stays
        as a stop on the way, but is found no more."""
        again = set(map(int, ids)).intersection(self.ids)
        self.ids = [GONE if x in again else x for x in self.ids]
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        self.vectors = np.vstack([self.vectors, vectors / np.where(norms > 0, norms, 1)]).astype(np.float32)
        for x in ids:
            self.ids.append(int(x))
            self._link(len(self.ids) - 1)
        return self

    def _link(self, node: int) -> None:
        layers = int(-math.log(1 - self.rng.random()) / math.log(LINKS)) + 1
        self.levels.append([[] for _ in range(layers)])
        if self.entry < 0:
            self.entry = node
            return
        highest, near = len(self.levels[self.entry]), [self.entry]
        for layer in range(highest - 1, -1, -1):
            found = self._walk(self.vectors[node], near, 1 if layer >= layers else BEAM_BUILD, layer)
            near = [n for _, n in found]
            if layer < layers:
                for n in near[:LINKS]:
                    self.levels[node][layer].append(n)
                    back = self.levels[n][layer]
                    back.append(node)
                    most = LINKS * (2 if layer == 0 else 1)
                    if len(back) > most:
                        order = np.argsort(-(self.vectors[back] @ self.vectors[n]), kind="stable")[:most]
                        self.levels[n][layer] = [back[i] for i in order]
        if layers > highest:
            self.entry = node

    def _walk(self, q: np.ndarray, start: list[int], beam: int, layer: int) -> list[tuple[float, int]]:
        """The nearest nodes of a layer, nearest first, by best-first search."""
        seen = set(start)
        open_ = [(1 - float(self.vectors[n] @ q), n) for n in start]
        heapq.heapify(open_)
        best = [(-d, n) for d, n in open_]
        heapq.heapify(best)
        while open_:
            d, n = heapq.heappop(open_)
            if len(best) >= beam and d > -best[0][0]:
                break
            fresh = [x for x in self.levels[n][layer] if x not in seen] if layer < len(self.levels[n]) else []
            if fresh:
                seen.update(fresh)
                for far, x in zip((1 - self.vectors[fresh] @ q).tolist(), fresh):
                    if len(best) < beam or far < -best[0][0]:
                        heapq.heappush(open_, (far, x))
                        heapq.heappush(best, (-far, x))
                        if len(best) > beam:
                            heapq.heappop(best)
        return sorted((-d, n) for d, n in best)

    def search(self, q: np.ndarray, k: int, beam: int | None = None) -> list[tuple[int, float]]:
        """(id, distance) of about the k nearest."""
        beam = wide(len(self.ids)) if beam is None else beam
        norm = np.linalg.norm(q)
        if self.entry < 0 or len(q) != self.dim or not norm:
            return []
        q, near = np.asarray(q, np.float32) / norm, [self.entry]
        for layer in range(len(self.levels[self.entry]) - 1, 0, -1):
            near = [self._walk(q, near, 1, layer)[0][1]]
        gone = self.ids.count(GONE)
        return [(self.ids[n], d) for d, n in self._walk(q, near, max(beam, k + gone), 0) if self.ids[n] != GONE][:k]

    def dump(self) -> bytes:
        """Links as 32-bit integers: entry, then for each node its number of layers and each layer's neighbours."""
        out = [self.entry]
        for node in self.levels:
            out.append(len(node))
            for layer in node:
                out += [len(layer), *layer]
        return np.array(out, "<i4").tobytes()

    @classmethod
    def load(cls, dim: int, ids: list[int], vectors: np.ndarray, blob: bytes) -> Graph:
        if len(blob) % 4 or len(vectors) != len(ids):
            raise ValueError("the graph is damaged")
        g, at, data = cls(dim), 1, np.frombuffer(blob, "<i4").tolist()
        g.ids, g.vectors, g.entry = list(ids), np.asarray(vectors, np.float32), data[0]
        for _ in ids:
            layers, at = data[at], at + 1
            node = []
            for _ in range(layers):
                n = data[at]
                node.append(data[at + 1 : at + 1 + n])
                at += 1 + n
            g.levels.append(node)
        return g


def build(vectors: DataFrame, shards: int | None = None) -> DataFrame:
    """The index of vectors (drawer_id, vector): a row a shard and length; of so many shards at least, more if their
    graphs would have over SHARD nodes."""
    rows = vectors.filter("vector is not null").select("drawer_id", "vector", F.size("vector").alias("dim")).filter("dim > 0")
    n = max(shards or 1, -(-rows.count() // SHARD))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("drawer_id").drop_duplicates("drawer_id", keep="last")
        g = Graph(int(key[1])).fill(part["drawer_id"].tolist(), np.array(part["vector"].tolist(), np.float32))
        return pd.DataFrame({"shard": [key[0]], "dim": [key[1]], "ids": [g.ids], "vectors": [g.vectors.ravel()], "links": [g.dump()]})

    return rows.groupBy(F.pmod(F.xxhash64("drawer_id"), F.lit(n)).alias("shard"), "dim").applyInPandas(run, GRAPH)


def search(index: DataFrame, queries: DataFrame, limit: int = 5, beam: int | None = None) -> DataFrame:
    """Rows (query_id, drawer_id, score: the cosine with the unit vector that the index holds, rank) for queries
    (query_id, query_vector). Blocks of QUERY_BLOCK queries go to every shard; the index is scanned once, so an index that
    isn't stored is built once."""
    limit = limit if limit > 0 else 5
    asked = queries.filter(F.size("query_vector") > 0).select("query_id", "query_vector")
    kind = queries.schema["query_id"].dataType.simpleString()
    blocks, shared = max(1, -(-asked.count() // QUERY_BLOCK)), []
    for k in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).collect()
        shared.append(queries.sparkSession.sparkContext.broadcast(([r.query_id for r in block], [r.query_vector for r in block])))

    def run(batches):
        for part in batches:
            for row in part.itertuples():
                g = Graph.load(row.dim, list(row.ids), np.array(row.vectors).reshape(-1, row.dim), row.links)
                place = {x: i for i, x in enumerate(g.ids)}
                for block in shared:
                    found = []
                    for name, q in zip(*block.value):
                        near = [i for i, _ in g.search(np.array(q), limit, beam)]
                        if near:
                            scores = g.vectors[[place[i] for i in near]].astype(float) @ (np.array(q, float) / np.linalg.norm(q))
                            found += zip([name] * len(near), near, scores.tolist())
                    yield pd.DataFrame(found, columns=["query_id", "drawer_id", "score"])

    return top(index.mapInPandas(run, f"query_id {kind}, drawer_id long, score double"), limit)


def listing(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows (name, bytes) of saved indexes by name: the links' and vectors' sizes."""
    out = spark.createDataFrame([], "name string, bytes long")
    for name, path in sorted(paths.items()):
        sizes = spark.read.schema(GRAPH).parquet(path).agg(F.coalesce(F.sum(F.octet_length("links") + 4 * F.size("vectors")), F.lit(0)).cast("long").alias("bytes"))
        out = out.unionByName(sizes.select(F.lit(name).alias("name"), "bytes"))
    return out.orderBy("name")


def size(index: DataFrame) -> DataFrame:
    return index.groupBy("dim").agg(F.sum(F.size("ids")).alias("size"))


def load_or_build(spark: SparkSession, path: str, vectors: DataFrame) -> DataFrame:
    """The saved index if it holds as many vectors as there are, else a new one, which is saved."""
    try:
        saved = spark.read.schema(GRAPH).parquet(path)
        held = saved.agg(F.sum(F.size("ids"))).first()[0] or 0
    except Exception:  # noqa: BLE001  nothing saved yet
        held = -1
    if held != vectors.filter("vector is not null").count():
        build(vectors).write.mode("overwrite").parquet(path)
    return spark.read.schema(GRAPH).parquet(path)
