"""Dense vectors: exact cosine search, means, and the binary codec."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.lexical import top
from larkspur.sources.shared import saved

#: A query table goes to all tasks only up to so many rows; more are dealt in blocks of that many.
QUERY_BLOCK = 2000

#: Scores that a task computes at a time: queries times rows.
CELLS = 1_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one is empty or zero or the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def search(vectors: DataFrame, queries: DataFrame, limit: int = 5, filtered: DataFrame | None = None) -> DataFrame:
    """Rows (query_id, drawer_id, score, rank) of the vectors (drawer_id, vector) nearest to queries (query_id,
    query_vector). Each task keeps the best of its own rows for every query; contents aren't read.

    Up to QUERY_BLOCK queries go to the tasks once, as a matrix. Beyond that the vectors are packed to blocks, and each
    block meets each block of queries.
    """
    limit = limit if limit > 0 else 5
    spark = vectors.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, drawer_id long, score double"
    rows = vectors.filter("vector is not null").select(F.col("drawer_id").cast("long"), "vector")
    if filtered is not None:
        rows = rows.join(filtered.select("drawer_id"), "drawer_id", "left_semi")
    asked = queries.filter(F.size("query_vector") > 0).select("query_id", "query_vector")
    few = asked.limit(QUERY_BLOCK + 1).collect()
    if len(few) <= QUERY_BLOCK:
        shared = spark.sparkContext.broadcast(([r.query_id for r in few], [r.query_vector for r in few]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, block = shared.value
            block, best = matrix(block), Best(names, limit)
            for batch in pieces(batches, len(names), CELLS):
                if names:
                    best.add(batch.column(0).to_numpy(), cosines(block, arrays(batch.column(1))))
            yield from best.rows(pa.from_numpy_dtype(np.int64), "drawer_id")

        return top(rows.mapInArrow(scan, schema), limit)
    blocks = -(-asked.count() // QUERY_BLOCK)
    packed = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct("query_id", "query_vector")).alias("asked"))
    number = F.pmod(F.xxhash64("drawer_id"), F.lit(max(1, -(-rows.count() // QUERY_BLOCK))))
    held = saved(rows.groupBy(number.alias("number")).agg(F.collect_list(F.struct("drawer_id", "vector")).alias("held")), "vectors")
    pairs = held.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))).join(packed, "b").select("held", "asked")

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, asked in zip(*(batch.column(c) for c in (0, 1))):
                held, asked = held.as_py(), asked.as_py()
                best, block = Best([q["query_id"] for q in asked], limit), matrix([q["query_vector"] for q in asked])
                for i, j in steps(len(held), len(asked), CELLS):
                    best.add(np.array([r["drawer_id"] for r in held[i:j]], np.int64), cosines(block, [r["vector"] for r in held[i:j]]))
                yield from best.rows(pa.int64(), "drawer_id")

    return top(pairs.mapInArrow(both, schema), limit)


def steps(rows: int, queries: int, cells: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose scores for all queries are so many cells at most, but one row at least."""
    size = max(1, cells // max(1, queries))
    return ((i, min(i + size, rows)) for i in range(0, rows, size))


def pieces(batches: Iterator[pa.RecordBatch], queries: int, cells: int) -> Iterator[pa.RecordBatch]:
    """Batches in steps, so that a task's memory doesn't grow with the number of queries."""
    return (batch.slice(i, j - i) for batch in batches for i, j in steps(batch.num_rows, queries, cells))


def matrix(queries: list) -> list[np.ndarray]:
    """Vectors of queries as arrays, once for all steps."""
    return [np.array(q, float) for q in queries]


def arrays(column: pa.Array) -> list | np.ndarray:
    """A column of lists as a matrix if they are of one length and hold no null, else as a list."""
    sizes = pc.list_value_length(column).to_numpy()
    flat = column.flatten()
    if len(sizes) and (sizes == sizes[0]).all() and sizes[0] and not flat.null_count:
        return flat.to_numpy().astype(float).reshape(len(sizes), -1)
    return column.to_pylist()


class Best:
    """The best rows of each of some queries, ties to the smaller name; scores are compared at 12 places."""

    def __init__(self, queries: list, limit: int):
        self.queries, self.limit = queries, limit
        self.names: list[np.ndarray | None] = [None] * len(queries)
        self.scores = [np.empty(0)] * len(queries)
        self.least = np.full(len(queries), -np.inf)  # what a score has to reach

    def add(self, names: np.ndarray, scores: np.ndarray) -> None:
        """scores: queries x names; a score of nan counts as none."""
        near = np.round(scores, 12)
        for q in np.flatnonzero((near >= self.least[:, None]).any(axis=1)):
            some = np.flatnonzero(near[q] >= self.least[q])
            if len(some) > 4 * self.limit:
                bound = np.partition(near[q][some], len(some) - self.limit)[len(some) - self.limit]
                some = some[near[q][some] >= bound]
            both = np.concatenate([self.scores[q], scores[q][some]])
            all_names = names[some] if self.names[q] is None else np.concatenate([self.names[q], names[some]])
            order = np.lexsort((all_names, -np.round(both, 12)))[: self.limit]
            self.scores[q], self.names[q] = both[order], all_names[order]
            if len(order) == self.limit:
                self.least[q] = np.round(both[order[-1]], 12)

    def rows(self, kind: pa.DataType, name: str) -> Iterator[pa.RecordBatch]:
        if sum(map(len, self.scores)):
            queries = pa.array([x for x, s in zip(self.queries, self.scores) for _ in s])
            yield pa.RecordBatch.from_arrays([queries, pa.array(np.concatenate([n for n in self.names if n is not None]).tolist(), kind), pa.array(np.concatenate(self.scores))], names=["query_id", name, "score"])


def cosines(queries: list, vectors: list | np.ndarray) -> np.ndarray:
    """Cosines of all queries with all vectors; 0 where they aren't defined."""
    out = np.zeros((len(queries), len(vectors)))
    sizes = np.array([len(v) for v in vectors])
    for dim in {len(q) for q in queries}:
        qs, vs = [i for i, q in enumerate(queries) if len(q) == dim], np.flatnonzero(sizes == dim)
        if dim and len(vs):
            a, b = np.array([queries[i] for i in qs], float), vectors if isinstance(vectors, np.ndarray) else np.array([vectors[i] for i in vs], float)
            norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[np.ix_(qs, vs)] = np.where(norms > 0, a @ b.T / norms, 0.0)
    return out


def mean_vectors(rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """Rows (key, vector): the mean of each key's vectors by component; null if their lengths differ."""
    sums = rows.select(key, F.size(vector).alias("n"), F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"), F.min("n").alias("a"), F.max("n").alias("z"))
    out = sums.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"), F.min("a").alias("a"), F.max("z").alias("z"))
    return out.select(key, F.when(F.col("a") == F.col("z"), F.transform("v", lambda x: x.x)).alias("vector"))


def mean_of_two(a: Column, b: Column) -> Column:
    """Mean of two vectors; null if their lengths differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: (x.cast("double") + y.cast("double")) / 2))


def encode(vector: list[float] | None) -> bytes | None:
    """Binary form: length, big-endian, then little-endian 32-bit floats; an empty vector has none."""
    return struct.pack(">I", len(vector)) + np.asarray(vector, "<f4").tobytes() if vector is not None and len(vector) else None


def decode(blob: bytes | None) -> list[float] | None:
    if not blob:
        return None
    if len(blob) < 4 or len(blob) != 4 + 4 * struct.unpack(">I", blob[:4])[0]:
        raise ValueError("the blob's length doesn't fit its header")
    return np.frombuffer(blob, "<f4", offset=4).tolist()


def coded(column: Column, back: bool = False) -> Column:
    """The codec as a column: vectors to binary, or back."""
    function = decode if back else encode

    def run(v: pd.Series) -> pd.Series:
        return v.map(function, na_action="ignore")

    return F.pandas_udf(run, "array<float>" if back else "binary", F.PandasUDFType.SCALAR)(column)
