"""Inverted index and lexical retrieval, for many queries in one plan.

The score of a document is the sum over query terms, repeated ones repeatedly, of idf * 2.5 tf / (tf + 1.5), where tf is
relative and idf = ln((N - df + 0.5) / (df + 0.5)) is at least 0. N and df speak of the whole index, whatever the
filters. A document that shares only terms of idf 0 is found all the same, with score 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.text import first_bytes, term_counts, term_frequencies, words
from larkspur.sources.shared import saved

#: Terms of queries that are broadcast, and terms that a scan is filtered by, at most.
BROADCAST_TERMS, LISTED_TERMS = 200_000, 500

#: Pairs of queries and documents that a task scores if all documents match, and tasks at most.
PAIRS, TASKS = 500_000, 2000


@dataclass
class Index:
    """A stored index: rows (term, drawer_id, tf), and the number of documents in it."""

    postings: DataFrame
    total: int


def postings(docs: DataFrame, key: str = "drawer_id", text: str = "content", corpus: bool = False) -> DataFrame:
    """Rows (term, drawer_id, tf): the index. corpus: count each document's terms where it is, which writes a table."""
    return term_frequencies(docs, key, text, corpus).select("term", F.col(key).alias("drawer_id"), "tf")


def stored(index: DataFrame) -> Index:
    """Writes postings and counts the documents once. A corpus' postings come in runs of documents that are sorted by
    term, so a query skips the pages of other terms; they aren't dealt or sorted anew."""
    rows = saved(index, "index")
    return Index(rows, rows.select("drawer_id").distinct().count())


def statistics(docs: DataFrame, key: str = "drawer_id", text: str = "content") -> DataFrame:
    """One row (total_docs, avg_doc_len) over the documents that have terms."""
    sizes = docs.select(key, F.size(words(F.col(text))).alias("n")).groupBy(key).agg(F.sum("n").alias("n")).filter("n > 0")  # a word is a term
    return sizes.agg(F.count("*").alias("total_docs"), F.avg("n").alias("avg_doc_len"))


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """Rows (query_id, term, qtf)."""
    return term_counts(queries, key, text).withColumnRenamed("n", "qtf")


def bm25(index: DataFrame | Index, queries: DataFrame, limit: int = 5, filtered: DataFrame | None = None) -> DataFrame:
    """Rows (query_id, drawer_id, score, rank from 1) of the best documents of each query, ties by id.

    The queries' terms go to the postings: as a filter of the scan and by broadcast if there are few, else by a join. df
    is counted of these terms only, and N too of an index that isn't stored. Their postings are dealt by document, as many
    to a task as bounds its pairs with queries, before they meet the queries, so that only each task's best pairs move.
    filtered: a table of drawer_id that narrows what is found, but not N and df.
    """
    limit = limit if limit > 0 else 5
    asked = query_terms(queries).withColumnRenamed("term", "t")
    few = False
    if isinstance(index, Index):
        rows, asked = index.postings, saved(asked, "asked")
        n, each = asked.agg(F.count("*"), F.countDistinct("query_id")).first()
        if few := n <= BROADCAST_TERMS:
            terms = asked.select("t").distinct().limit(LISTED_TERMS + 1).collect()
            if len(terms) <= LISTED_TERMS:
                rows = rows.filter(F.col("term").isin([r.t for r in terms]))
        total = F.lit(index.total)
    else:
        rows, total = index, F.col("total")
        asked = asked.crossJoin(index.agg(F.countDistinct("drawer_id").alias("total")))  # one row
    sent = F.broadcast if few else lambda df: df
    counts = rows.select("term").join(sent(asked.select("t").distinct()), F.col("term") == F.col("t"), "left_semi").groupBy(F.col("term").alias("d")).agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((total - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.0))
    asked = asked.join(counts, F.col("t") == F.col("d")).select("query_id", "t", (F.col("qtf") * idf).alias("w"))
    if few:
        wanted = rows.join(sent(asked.select("t").distinct()), F.col("term") == F.col("t"), "left_semi")
        rows = wanted.repartition(min(TASKS, 1 + index.total * each // PAIRS), "drawer_id")
    found = rows.join(sent(asked), F.col("term") == F.col("t")).select("query_id", "drawer_id", (F.col("w") * F.col("tf") * 2.5 / (F.col("tf") + 1.5)).alias("s"))
    if filtered is not None:
        found = found.join(filtered.select("drawer_id"), "drawer_id", "left_semi")
    return top(found.groupBy("query_id", "drawer_id").agg(F.sum("s").alias("score")), limit)


def postings_by(docs: DataFrame, store: str) -> DataFrame:
    """A stored table of rows (store, term, drawer_id, tf) of documents (store, drawer_id, content) of many stores."""
    return saved(term_frequencies(docs, "drawer_id", "content", True, (store,)).select(store, "term", "drawer_id", "tf"), "postings")


def bm25_by(index: DataFrame, queries: DataFrame, store: str, limit: int = 5) -> DataFrame:
    """bm25 of queries (query_id, query, store) each within its own store, whose N and df count there; all stores in one
    plan. df is counted of the stores' queries' terms only."""
    asked = saved(query_terms(queries).join(queries.select("query_id", F.col(store).alias("s")), "query_id").withColumnRenamed("term", "t"), "asked")
    sent = F.broadcast if asked.count() <= BROADCAST_TERMS else lambda df: df
    same = (F.col(store) == F.col("s")) & (F.col("term") == F.col("t"))
    counts = index.select(store, "term").join(sent(asked.select("s", "t").distinct()), same, "left_semi").groupBy(F.col(store).alias("c"), F.col("term").alias("d")).agg(F.count("*").alias("df"))
    sizes = index.groupBy(F.col(store).alias("z")).agg(F.countDistinct("drawer_id").alias("total"))
    weight = F.col("qtf") * F.greatest(F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.0))
    asked = asked.join(counts, (F.col("s") == F.col("c")) & (F.col("t") == F.col("d"))).join(sizes, F.col("s") == F.col("z")).select("query_id", "s", "t", weight.alias("w"))
    scores = index.join(sent(asked), same).groupBy("query_id", "drawer_id").agg(F.sum(F.col("w") * F.col("tf") * 2.5 / (F.col("tf") + 1.5)).alias("score"))
    return top(scores, limit)


def top(scores: DataFrame, limit: int, by: str = "drawer_id") -> DataFrame:
    """Ranks within each query and keeps the best; ties by id, on scores rounded to 12 places so that the order of
    sums doesn't decide."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), by))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= limit)


def scope(stored: DataFrame, wing: str | None = None, room: str | None = None, sessions: list[str] | None = None) -> DataFrame | None:
    """The drawer ids that the filters leave, or None without filters; a room counts only within a wing."""
    out = stored
    if wing is not None:
        out = out.filter(F.col("wing") == wing)
        if room is not None:
            out = out.filter(F.col("room") == room)
    if sessions:
        out = out.filter(F.col("source_file").isin(sessions))
    return out.select("drawer_id") if out is not stored else None


def hydrated(ranked: DataFrame, stored: DataFrame, few: bool = False) -> DataFrame:
    """Adds the drawers' columns to ranked rows only. few: the ranked rows are known to be few, so that their ids go to
    the drawers and contents of others aren't moved."""
    columns = [c for c in ("content", "wing", "room", "hall", "source_file") if c in stored.columns]
    ids = ranked.select("drawer_id").distinct()
    kept = stored.select("drawer_id", *columns).join(F.broadcast(ids) if few else ids, "drawer_id", "left_semi")
    return ranked.join(kept, "drawer_id", "left")


def rendered(results: DataFrame) -> DataFrame:
    """Result lines: rank, place, score, file name and a snippet of 200 bytes."""
    snippet = F.when(F.octet_length("content") > 200, F.concat(first_bytes(F.col("content"), 200), F.lit("..."))).otherwise(F.col("content"))
    line = F.format_string("[%d] %s / %s  (score: %.3f)\n    Source: %s\n    %s", F.col("rank"), F.coalesce("wing", F.lit("")), F.coalesce("room", F.lit("")), F.col("score"), F.regexp_extract("source_file", "[^/]*$", 0), F.translate(snippet, "\n", " "))
    return results.select("query_id", "rank", line.alias("line"))
