"""Question types by patterns and by anchors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.operators.vector import cosine, mean_vectors

USER = "single-session-user"
BROADCAST_TYPES = 1000

# The patterns in the order of their trial, and the anchors' phrases. They decide the labels.
PATTERNS = (
    (r"(?i)\b(remind me|you (mentioned|recommended|suggested|told|said)|previous (chat|conversation|discussion)|going back to our|our (previous|earlier))\b", "single-session-assistant"),
    (r"(?i)\bcan you (recommend|suggest)|please (recommend|suggest)|what (are some|would you)\b", "single-session-preference"),
    (r"(?i)\bwhich .* (first|earlier|later|before|after)\b", "temporal-reasoning"),
    (r"(?i)\b(first|last|before|after|earliest|latest|how (many|long) (days|weeks|months|years|hours))\b", "temporal-reasoning"),
    (r"(?i)^\s*how many\b", "multi-session"),
)
ANCHORS = {
    "knowledge-update": (
        "What is the current value of X now, after recent updates?",
        "How many times have I done X up to now in total?",
        "What is my latest score / record / count for X?",
        "How often do I do X these days, compared to before?",
        "Where did X end up moving to or what is X's current status?",
    ),
    "temporal-reasoning": (
        "When did X happen, and what happened first or last?",
        "How many days or weeks before / after did X occur?",
        "Which event came first, X or Y?",
        "What did I do earliest or latest in the timeline?",
    ),
    "single-session-preference": (
        "Can you recommend something for me based on my preferences?",
        "What would you suggest as a good fit for what I like?",
        "Please recommend a hotel, restaurant, or activity.",
    ),
    "single-session-assistant": (
        "Remind me about that thing you mentioned earlier.",
        "Going back to our previous chat, what did you suggest?",
        "What was the recommendation you made last time?",
    ),
    "multi-session": (
        "How many distinct projects, items, or activities have I dealt with overall?",
        "Across all our sessions combined, what is the total count?",
        "Sum up across our chats how many things of type X.",
    ),
    "single-session-user": (
        "What is some specific fact about me that I mentioned before?",
        "What did I tell you about a single event or detail?",
        "Where did I go, what did I redeem, what is my degree?",
    ),
}


def question_type(question: Column) -> Column:
    """The first pattern's type that matches; else, and for an empty question, the user's. Word ends are ASCII's, as
    Java's would see letters beyond them."""
    q = F.trim(F.coalesce(question, F.lit("")))
    out = None
    for pattern, name in PATTERNS:
        ascii_ends = pattern.replace(r"\b", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")
        out = F.when(q.rlike(ascii_ends), name) if out is None else out.when(q.rlike(ascii_ends), name)
    return out.otherwise(USER)


def prepared(spark: SparkSession, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """anchor_means of the fixed phrases, embedded by a model."""
    phrases = [(t, p) for t, some in ANCHORS.items() for p in some]
    rows = [(t, [float(x) for x in v]) for (t, _), v in zip(phrases, embed([p for _, p in phrases]))]
    return anchor_means(spark.createDataFrame(rows, "type string, vector array<float>"))


def anchor_means(anchors: DataFrame) -> DataFrame:
    """Rows (type, vector): the mean of each type's anchor vectors (type, vector)."""
    return mean_vectors(anchors, "type")


def nearest_anchor(queries: DataFrame, means: DataFrame) -> DataFrame:
    """Rows (query_id, type): the type whose mean is nearest by cosine, of those of the query's length; ties by type;
    the user's type for an empty vector and without means. means has one row a type and is broadcast if there are at
    most BROADCAST_TYPES."""
    means = means.withColumnRenamed("vector", "mean")
    few = F.broadcast(means) if means.limit(BROADCAST_TYPES + 1).count() <= BROADCAST_TYPES else means
    pairs = queries.join(few, F.size("query_vector") == F.size("mean"), "left")
    similarity = F.when(F.col("mean").isNotNull() & (F.size("query_vector") > 0), cosine(F.col("query_vector"), F.col("mean")))
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round("s", 12)), "type"))
    out = pairs.withColumn("s", similarity).withColumn("_n", best).filter("_n = 1")
    return out.select("query_id", F.when(F.col("s").isNotNull(), F.col("type")).otherwise(USER).alias("type"))
