"""Fusion and re-scoring of ranked lists (query_id, drawer_id, score, rank)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators import lexical, vector
from larkspur.operators.lexical import top

K = 60
#: Weight of the lexical list by question type.
TYPE_WEIGHTS = {"knowledge-update": 0.30, "single-session-preference": 0.70, "temporal-reasoning": 0.70, "multi-session": 0.70, "single-session-user": 0.90, "single-session-assistant": 0.90}
OTHER_WEIGHT = 0.7


def fused(lexical_list: DataFrame, vector_list: DataFrame, weight: Column | float, limit: int, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Weighted reciprocal ranks: weight / (60 + lexical rank) + (1 - weight) / (60 + vector rank), a missing rank
    counting nothing. A weight may be a column of the lists; it is held within 0 and 1."""
    w = F.greatest(F.least(F.lit(weight) if isinstance(weight, (int, float)) else weight, F.lit(1.0)), F.lit(0.0))
    extra = [c for c in lexical_list.columns if c not in ("drawer_id", "score", "rank")]
    both = lexical_list.select(*extra, "drawer_id", (w / (K + F.col("rank"))).alias("s")).unionByName(vector_list.select(*extra, "drawer_id", ((1 - w) / (K + F.col("rank"))).alias("s")))
    scores = both.groupBy(*extra, "drawer_id").agg(F.sum("s").alias("score"))
    rank = F.row_number().over(W.partitionBy(*extra).orderBy(F.desc(F.round("score", 12)), "drawer_id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= limit)


def hybrid(index: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int = 5, weight: Column | float = 0.5, filtered: DataFrame | None = None) -> DataFrame:
    """Fusion of the lexical and the vector list, each of 4 * limit rows; queries (query_id, query, query_vector)."""
    limit = limit if limit > 0 else 5
    a = lexical.bm25(index, queries, 4 * limit, filtered)
    b = vector.search(vectors, queries, 4 * limit, filtered)
    if isinstance(weight, Column):
        weights = queries.select("query_id", weight.alias("weight"))
        a, b = a.join(weights, "query_id"), b.join(weights, "query_id")
        return fused(a, b, F.col("weight"), limit).drop("weight")
    return fused(a, b, weight, limit)


def type_weight(question_type: Column, weights: dict[str, float] | None = None) -> Column:
    table = F.create_map(*(F.lit(x) for pair in (weights or TYPE_WEIGHTS).items() for x in pair))
    return F.coalesce(F.element_at(table, question_type), F.lit(OTHER_WEIGHT))


def sweep(lexical_list: DataFrame, vector_list: DataFrame, weights: list[float], limit: int) -> DataFrame:
    """The fused list for each of some weights, in one plan: (query_id, weight, drawer_id, score, rank)."""
    each = F.explode(F.array(*map(F.lit, weights))).alias("weight")
    return fused(lexical_list.select("*", each), vector_list.select("*", each), F.col("weight"), limit)


def recency(ranked: DataFrame, weight: float) -> DataFrame:
    """Adds weight times an id's place between the least and the greatest id of its query's list, and ranks anew; a
    list of one row or one id stays."""
    by = W.partitionBy("query_id")
    low, high = F.min("drawer_id").over(by), F.max("drawer_id").over(by)
    bonus = F.when(high > low, weight * (F.col("drawer_id") - low) / (high - low)).otherwise(0.0)
    return top(ranked.withColumn("score", F.col("score") + bonus).drop("rank"), 1 << 30)


def collapsed(pool: DataFrame, limit: int, source: str = "source_file") -> DataFrame:
    """Of each query and source the best row; rows without a source stand for themselves."""
    own = F.coalesce(F.when(F.col(source) != "", F.col(source)), F.concat(F.lit("__drawer_"), F.col("drawer_id").cast("string")))
    best = F.row_number().over(W.partitionBy("query_id", own).orderBy(F.desc(F.round("score", 12)), "drawer_id"))
    return top(pool.withColumn("_n", best).filter("_n = 1").drop("_n", "rank"), limit)


def multiview(vectors: DataFrame, stored: DataFrame, queries: DataFrame, limit: int = 5, filtered: DataFrame | None = None) -> DataFrame:
    """Vector search over several views of each source: from a pool of max(12 * limit, 20), the best view a source."""
    limit = limit if limit > 0 else 5
    pool = vector.search(vectors, queries, max(12 * limit, 20), filtered)
    return collapsed(pool.join(stored.select("drawer_id", "source_file"), "drawer_id", "left"), limit)


def merged_views(scored: DataFrame, weights: dict[str, float], mode: str, limit: int) -> DataFrame:
    """Sessions by views: rows (query_id, source_file, hall, score) become (query_id, source_file, score, rank) by the
    sum or the maximum of weighted scores. With the maximum a session counts only above 0. Other halls add 0."""
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    weighted = F.coalesce(F.element_at(table, F.col("hall")), F.lit(0.0)) * F.col("score")
    sums = scored.groupBy("query_id", "source_file").agg((F.max if mode == "max" else F.sum)(weighted).alias("score"))
    return top(sums.filter("score > 0") if mode == "max" else sums, limit, "source_file")


def session_search(views: DataFrame, queries: DataFrame, weights: dict[str, float], mode: str, limit: int) -> DataFrame:
    """merged_views of all views (source_file, hall, vector) for queries (query_id, query_vector), without their pairs:
    a task reads the views of its sessions in order, keeps one figure a query and session, and of these the best.
    Views without a source are passed over. The queries go to the tasks in blocks, one scan of the views each."""
    spark = views.sparkSession
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = queries.filter(F.size("query_vector") > 0).select("query_id", "query_vector")
    blocks = max(1, -(-asked.count() // vector.QUERY_BLOCK))
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    rows = views.filter("vector is not null and source_file is not null").select("source_file", F.coalesce(F.element_at(table, F.col("hall")), F.lit(0.0)).alias("weight"), "vector")
    rows = rows.repartition("source_file").sortWithinPartitions("source_file")
    cells, joint = vector.CELLS, np.maximum if mode == "max" else np.add

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, block = shared.value
            block, best = vector.matrix(block), vector.Best(names, limit)

            def add(sessions: list[str], scores: np.ndarray) -> None:
                if len(sessions) and names:
                    best.add(np.array(sessions), np.where(scores > 0, scores, np.nan) if mode == "max" else scores)

            open_session, figures = None, None
            for batch in vector.pieces(batches, len(names), cells):
                sessions = batch.column(0).to_pylist()
                scores = vector.cosines(block, vector.arrays(batch.column(2))) * batch.column(1).to_numpy()
                starts = [0, *(i for i in range(1, len(sessions)) if sessions[i] != sessions[i - 1])]
                merged, found = joint.reduceat(scores, starts, axis=1), [sessions[i] for i in starts]
                if open_session == found[0]:
                    merged[:, 0] = joint(merged[:, 0], figures)
                elif open_session is not None:
                    add([open_session], figures[:, None])
                add(found[:-1], merged[:, :-1])
                open_session, figures = found[-1], merged[:, -1]
            if open_session is not None:
                add([open_session], figures[:, None])
            yield from best.rows(pa.string(), "source_file")

        return run

    out = None
    for k in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast(([r.query_id for r in block], [r.query_vector for r in block]))
        part = rows.mapInArrow(scan(shared), f"query_id {kind}, source_file string, score double")
        out = part if out is None else out.unionByName(part)
    return top(out, limit, "source_file")


def blended(sessions: DataFrame, lexical_list: DataFrame, weight: float, limit: int) -> DataFrame:
    """(1 - weight) times the sessions' scores plus weight / (60 + rank of the session's first drawer in the lexical
    list (query_id, source_file, rank)); sessions of either list. Without weight the list stays, and so does an empty
    one."""
    if weight <= 0:
        return sessions
    first = lexical_list.groupBy("query_id", "source_file").agg(F.min("rank").alias("r"))
    known = sessions.select("query_id").distinct()
    both = sessions.select("query_id", "source_file", "score").join(first.join(known, "query_id", "left_semi"), ["query_id", "source_file"], "full_outer")
    score = (1 - weight) * F.coalesce("score", F.lit(0.0)) + F.coalesce(weight / (K + F.col("r")), F.lit(0.0))
    return top(both.select("query_id", "source_file", score.alias("score")), limit, "source_file")


def reranked(results: DataFrame, scorer: Callable[[str, list[str]], list[float]], cut: int = 10, gate: Column | None = None) -> DataFrame:
    """Scores of a model in place of the first stage's: results (query_id, query, drawer_id, content, score, rank).
    Lists of one row stay, and so does a list where the gate is false or the model fails."""
    allowed = results.withColumn("_gate", gate if gate is not None else F.lit(True))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        if len(part) > 1 and part["_gate"].iloc[0]:
            try:
                part = part.assign(score=scorer(part["query"].iloc[0], [x.encode("utf-8", "replace")[:1500].decode("utf-8", "ignore") for x in part["content"]]))
                part = part.sort_values(["score", "drawer_id"], ascending=[False, True])
            except Exception:  # noqa: BLE001  a failing model leaves the first stage's order
                pass
        return part.assign(rank=range(1, len(part) + 1)).head(cut).drop(columns="_gate")

    return allowed.groupBy("query_id").applyInPandas(run, results.schema)


#: Question types whose lists are worth a second stage.
GATED = ("temporal-reasoning", "knowledge-update")


def gated(question_type: Column) -> Column:
    return question_type.isin(*GATED)


def expanded(queries: DataFrame, complete: Callable[[str], str], embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Pseudo-document expansion: the query's vector becomes the mean of itself and of a generated answer's vector; if
    the model fails it stays."""

    def run(batches):
        for part in batches:
            vectors = []
            for q, v in zip(part["query"], part["query_vector"]):
                try:
                    other = embed([complete(q)])[0]
                    vectors.append([(a + b) / 2 for a, b in zip(v, other)] if len(v) == len(other) else list(v))
                except Exception:  # noqa: BLE001  the plain query still works
                    vectors.append(list(v))
            yield part.assign(query_vector=vectors)

    return queries.mapInPandas(run, queries.schema)
