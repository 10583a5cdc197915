"""Retrieval quality: hits of ranked results, recall at k, confusion, best weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of an answer that don't count, and what separates its words.
UNIMPORTANT = "the a an is was are and or of to in on for at by with as it this that which who what my your his her their be have has had do does".split()
BETWEEN = "[ ,.;:!?\"']+"
SHARE = 0.6
CUTS = (1, 5, 10)


def contains_answer(content: Column, answer: Column) -> Column:
    """Whether a text holds an answer: as a whole, or 60 % of its words that count (over two bytes, none of the
    unimportant ones, repeated ones repeatedly). An empty answer is held by every text."""
    text, wanted = F.lower(F.coalesce(content, F.lit(""))), F.lower(F.coalesce(answer, F.lit("")))
    words = F.filter(F.split(wanted, BETWEEN), lambda w: (F.octet_length(w) > 2) & ~w.isin(UNIMPORTANT))
    hits = F.filter(words, lambda w: F.contains(text, w))
    return F.contains(text, wanted) | ((F.size(words) > 0) & (F.size(hits) / F.greatest(F.size(words), F.lit(1)) >= SHARE))


def normal_answer(answer: Column) -> Column:
    """An answer (variant) as text: a string trimmed and in lower case, a list's values joined by spaces and treated so,
    any other value's text."""
    kind = F.schema_of_variant(answer)
    text = F.when(kind == "STRING", F.variant_get(answer, "$", "string")).when(
        kind.startswith("ARRAY"), F.array_join(F.transform(F.try_variant_get(answer, "$", "array<variant>"), lambda x: F.variant_get(x, "$", "string")), " ")
    ).otherwise(answer.cast("string"))
    return F.lower(F.trim(text))


def first_hits(results: DataFrame, hit: Column) -> DataFrame:
    """Rows (query_id, first: rank of the first hit or null)."""
    return results.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("first"))


def recall(queries: DataFrame, first: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per cent of queries with a hit among the first 1, 5 and 10, optionally by columns of the queries. A query
    without results has none."""
    rows = queries.join(first, "query_id", "left")
    shares = [F.round(100 * F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))), 6).alias(f"r{k}") for k in CUTS]
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *shares)


def scoped(results: DataFrame, haystack: DataFrame, cut: int = 10) -> DataFrame:
    """Results whose source is in the query's haystack (query_id, source_file), ranked anew, cut."""
    from larkspur.operators.lexical import top

    return top(results.drop("rank").join(haystack, ["query_id", "source_file"], "left_semi"), cut)


def best_weights(sweep: DataFrame, by: str) -> DataFrame:
    """For each value of a column the weight with the best r5, the smallest of equal ones: (by, weight, r5)."""
    return sweep.groupBy(by).agg(F.max_by("weight", F.struct("r5", -F.col("weight"))).alias("weight"), F.max("r5").alias("r5"))


def confusion(predictions: DataFrame) -> DataFrame:
    """Rows (predicted, actual, n)."""
    return predictions.groupBy("predicted", "actual").agg(F.count("*").alias("n"))


def expected_by_class(counts: DataFrame, rates: DataFrame) -> DataFrame:
    """Expected hits if each question got its predicted type's weight: n times the rate (predicted, actual, rate),
    rounded, summed."""
    return counts.join(rates, ["predicted", "actual"]).agg(F.sum(F.round(F.col("n") * F.col("rate"))).alias("expected"), F.sum("n").alias("n"))


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.round(F.avg((F.col("predicted") == F.col("actual")).cast("double")), 6).alias("accuracy"), F.count("*").alias("n"))


def evidence_hit(source: Column, evidence: Column) -> Column:
    """Whether one of a result's comma-separated ids is among the evidence."""
    return F.coalesce(F.arrays_overlap(F.split(source, ","), evidence), F.lit(False))


def lenient_and_strict(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows (query_id, first, first_latest): ranks of the first hit of any evidence, and of the latest one. evidence
    (query_id, source_file, position)."""
    latest = evidence.groupBy("query_id").agg(F.max_by("source_file", "position").alias("latest"))
    marked = results.join(evidence.select("query_id", "source_file", F.lit(True).alias("hit")).distinct(), ["query_id", "source_file"], "left").join(latest, "query_id", "left")
    return marked.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.min(F.when(F.col("source_file") == F.col("latest"), F.col("rank"))).alias("first_latest"))


def by_size(rows: DataFrame) -> DataFrame:
    """Hits by context size and over all (size null): rows (context_size, hit) give (context_size, n, hits, percent)."""
    sums = rows.rollup("context_size").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))
    return sums.withColumn("percent", F.round(F.when(F.col("n") > 0, 100 * F.col("hits") / F.col("n")).otherwise(0.0), 6))
