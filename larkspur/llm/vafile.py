"""Exact top-k search by inner product over a vector-approximation file.

The file has two tables of blocks of some thousand vectors: quantised cells (one byte a component), and the exact
integer vectors. Queries come in blocks too. A search scans the cells of every block for bounds of each query's
scores. Each query's k-th highest lower bound over all blocks then leaves few candidates; these, and nothing else, ask
the exact table: where a block stands, a query reads exact vectors in the order of their upper bounds until its k-th
result is certain.

floor(scale * x) is kept as a double, which holds it exactly. Sums run in float32, float64 or int64, whichever a bound
proves exact; beyond that in Python's integers. Vectors of large components are dealt to blocks of their own by size,
so that they slow nothing else.

Defined cases: a vector that is null, or holds a null or non-finite component (scaled ones included), or has a null id
takes no part; vectors are compared within their length only, empty ones included (score 0); a query's own id is no
candidate; equal scores rank by id; candidates that repeat a row count as often; an id that repeats among the queries
asks once, with its least vector; a score beyond 63 bits counts as 2^63 - 1 of its sign; an empty table gives no rows;
other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import saved

BLOCK = 8192
QUERIES = 4096
CELLS = 64
#: Queries whose candidates in one block are answered by one task.
ANSWERS = 4096
#: Components of ordinary vectors are smaller; others are dealt by their size in bits.
ORDINARY = float(1 << 20)
LONGEST = (1 << 63) - 1
PLACE = ["dim", "size", "block"]


def scaled_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """Rows (id, dim, size class, vector array<double>) of the vectors that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    fit = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = df.filter(fit).select(F.col(key).cast("long").alias("id"), v.alias("vector"))
    largest = F.coalesce(F.array_max(F.transform("vector", lambda x: F.abs(x))), F.lit(0.0))
    size = F.when(largest < ORDINARY, 0).otherwise(1 + F.floor(F.log2(largest) / 16)).cast("int")
    return rows.select("id", F.size("vector").alias("dim"), size.alias("size"), "vector")


def matrix(table: pa.Table, dim: int) -> np.ndarray:
    return np.floor(table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(table.num_rows, dim)


def build(vectors: DataFrame, n: int, cells: int = CELLS) -> DataFrame:
    """The file: rows (dim, size, block, n, ids, low and width of each dimension's cells, cells, exact), all binary, of
    at most about BLOCK vectors, dealt by hash."""
    blocks = max(1, -(-n // BLOCK))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        exact = matrix(table, dim)
        low = exact.min(0)
        width = np.maximum(np.floor((exact.max(0) - low) / cells) + 1, 1)
        cell = np.clip((exact - low) // width, 0, 255).astype(np.uint8)
        one = {"n": pa.array([table.num_rows], pa.int32()), "ids": [table["id"].to_numpy().astype("<i8").tobytes()], "low": [low.tobytes()], "width": [width.tobytes()], "cells": [cell.tobytes()], "exact": [exact.tobytes()]}
        return pa.table({c: pa.array([x.as_py()], x.type) for c, x in zip(PLACE, key)} | one)

    kept = dealt.groupBy(*PLACE).applyInArrow(pack, "dim int, size int, block long, n int, ids binary, low binary, width binary, cells binary, exact binary")
    return saved(kept, "vafile")


def scanned(q: np.ndarray, own: np.ndarray, ids: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(query's place, its k highest lower bounds, candidates, their upper bounds by falling order) of one block."""
    reach = np.abs(q).max(initial=1) * max(np.abs(low).max(initial=1), np.abs(low + width * 256).max(initial=1)) * max(1, q.shape[1])
    near_exact = reach < 1 << 53
    if near_exact:
        kind = np.float32 if reach < 1 << 24 else np.float64
        floor = (low + cells * width).astype(kind).T
        up, down = np.maximum(q, 0) @ (width - 1), np.minimum(q, 0) @ (width - 1)
    for i in range(0, len(q), 128):
        part = (q[i : i + 128].astype(kind) @ floor).astype(np.float64) if near_exact else None
        for j in range(i, min(i + 128, len(q))):
            others = np.flatnonzero(ids != own[j])
            if not len(others):
                continue
            if not near_exact:  # no bound is told apart from rounding: all are candidates
                yield j, np.empty(0), others, np.full(len(others), np.inf)
                continue
            lower, upper = part[j - i][others] + down[j], part[j - i][others] + up[j]
            m = min(k, len(others))
            best = np.partition(lower, len(lower) - m)[len(lower) - m :]
            some = np.flatnonzero(upper >= best.min())
            some = some[np.argsort(-upper[some], kind="stable")]
            yield j, best, others[some], upper[some]


def products(q: np.ndarray, exact: np.ndarray) -> list[int] | np.ndarray:
    """Inner products, exact, as far as a long reaches."""
    reach = np.abs(q).max(initial=1) * np.abs(exact).max(initial=1) * max(1, len(q))
    if reach < 1 << 53:
        return (exact @ q).astype(np.int64)
    if reach < 1 << 62:
        return exact.astype(np.int64) @ q.astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([max(-LONGEST, min(LONGEST, sum(a * int(b) for a, b in zip(whole, row)))) for row in exact], np.int64)


def answered(q: np.ndarray, ids: np.ndarray, exact: np.ndarray, places: np.ndarray, upper: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of a query's k best in a block, ties to the smaller id; reads exact vectors in the order of their
    upper bounds until no other can be better than the k-th."""
    got, read = np.empty(0, np.int64), 0
    while read < len(places) and (len(got) < k or upper[read] >= np.partition(got, len(got) - k)[len(got) - k]):
        some = places[read : read + 4 * k]
        got = np.concatenate([got, products(q, exact[some])])
        read += len(some)
    order = np.lexsort((ids[places[:read]], -got))[:k]
    return ids[places[:read]][order], got[order]


def search(df: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank from 1, vec_id, score long): each query row's k highest inner products with all others.

    is_query is a condition on the column id, which holds the key.
    """
    vectors = scaled_vectors(df, key, vector, scale)
    sizes = vectors.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    file = build(vectors, sizes[0])
    query_blocks = max(1, -(-sizes[1] // QUERIES))
    asked = vectors.filter(is_query).groupBy("dim", "id").agg(F.min("vector").alias("vector"))
    asked = asked.groupBy("id").agg(F.min(F.struct("dim", "vector")).alias("least")).select("id", "least.*")
    asked = asked.withColumn("queries", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        own = table["id"].to_numpy().astype("<i8").tobytes()
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "queries": pa.array([key[1].as_py()], pa.int32()), "own": [own], "asked": [matrix(table, key[0].as_py()).tobytes()]})

    packed = saved(asked.groupBy("dim", "queries").applyInArrow(pack, "dim int, queries int, own binary, asked binary"), "queries")
    cells = file.select(*PLACE, "ids", "low", "width", "cells").withColumn("queries", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    pairs = cells.join(packed, ["dim", "queries"]).repartition(max(1, query_blocks * -(-sizes[0] // BLOCK)), "queries", "block")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim, own, ids = row["dim"], np.frombuffer(row["own"], "<i8"), np.frombuffer(row["ids"], "<i8")
                q = np.frombuffer(row["asked"], "<f8").reshape(len(own), dim)
                low, width = np.frombuffer(row["low"], "<f8"), np.frombuffer(row["width"], "<f8")
                out = {c: [] for c in _SCANNED.names}
                for j, best, places, upper in scanned(q, own, ids, low, width, np.frombuffer(row["cells"], np.uint8).reshape(len(ids), dim), k):
                    one = (dim, row["size"], row["block"], int(own[j]), q[j].tobytes(), best.tolist(), places.astype("<i4").tobytes(), upper.tobytes(), float(upper[0]))
                    for c, x in zip(out, one):
                        out[c].append(x)
                    if len(out["id"]) >= 1000:
                        yield pa.RecordBatch.from_pydict(out, schema=_SCANNED)
                        out = {c: [] for c in _SCANNED.names}
                yield pa.RecordBatch.from_pydict(out, schema=_SCANNED)

    near = saved(pairs.mapInArrow(scan, "dim int, size int, block long, id long, q binary, lower array<double>, places binary, upper binary, most double"), "candidates")
    bounds = near.select(F.col("id").alias("b"), F.explode("lower").alias("lower"))
    bounds = bounds.withColumn("n", F.row_number().over(W.partitionBy("b").orderBy(F.desc("lower")))).filter(F.col("n") <= k)
    bounds = bounds.groupBy("b").agg(F.min("lower").alias("lower"), F.count("*").alias("n")).filter(F.col("n") == k).select("b", F.col("lower").alias("bound"))
    left = near.drop("lower").join(bounds, F.col("id") == F.col("b"), "left").drop("b")
    left = saved(left.withColumn("bound", F.coalesce("bound", F.lit(float("-inf")))).filter("most >= bound").drop("most"), "survivors")

    salts = left.groupBy(*PLACE).agg(F.ceil(F.count("*") / ANSWERS).cast("int").alias("salts"))
    left = left.join(salts, PLACE).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")
    exact = file.select(*PLACE, "ids", "exact").join(salts, PLACE).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def answer(key: tuple, some: pa.Table, block: pa.Table) -> pa.Table:
        found = []
        if block.num_rows:
            ids = np.frombuffer(block["ids"][0].as_py(), "<i8")
            whole = np.frombuffer(block["exact"][0].as_py(), "<f8").reshape(len(ids), key[0].as_py())
            for row in some.select(["id", "q", "places", "upper", "bound"]).to_pylist():
                upper = np.frombuffer(row["upper"], "<f8")
                n = int((upper >= row["bound"]).sum())  # they fall
                a, b = answered(np.frombuffer(row["q"], "<f8"), ids, whole, np.frombuffer(row["places"], "<i4")[:n], upper[:n], k)
                found.append((np.full(len(a), row["id"]), a, b))
        return pa.table({c: np.concatenate([x[i] for x in found]) if found else np.empty(0, np.int64) for i, c in enumerate(("query_id", "vec_id", "score"))})

    by = [*PLACE, "salt"]
    found = left.groupBy(*by).cogroup(exact.groupBy(*by)).applyInArrow(answer, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_SCANNED = pa.schema([("dim", pa.int32()), ("size", pa.int32()), ("block", pa.int64()), ("id", pa.int64()), ("q", pa.binary()), ("lower", pa.list_(pa.float64())), ("places", pa.binary()), ("upper", pa.binary()), ("most", pa.float64())])
