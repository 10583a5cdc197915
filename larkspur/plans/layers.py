"""Context texts: an identity, a summary of wings and rooms, and both together."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def identity(path: str) -> str:
    """The identity layer of a text file; empty without one."""
    if not os.path.exists(path):
        return ""
    with open(path, encoding="utf-8") as f:
        text = f.read().strip()
    return f"## L0 — IDENTITY\n{text}" if text else ""


def summary_lines(wings: DataFrame, stored: DataFrame, wing: str | None = None, rooms: int = 5, recent: int = 5) -> DataFrame:
    """Rows (part, name, line) in the order of a summary: a line a wing with its largest rooms, then the newest
    drawers, which no wing narrows. Ties among rooms go by name."""
    counts = stored.groupBy("wing", "room").agg(F.count("*").alias("n"))
    place = F.row_number().over(W.partitionBy("wing").orderBy(F.desc("n"), "room"))
    best = counts.withColumn("place", place).filter(F.col("place") <= rooms)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "room", "n"))), lambda x: F.format_string("%s(%d)", x.room, x.n))
    best = best.groupBy(F.col("wing").alias("w")).agg(F.array_join(listed, " | ").alias("rooms"))
    shown = wings if wing is None else wings.filter(F.col("wing") == wing)
    head = F.concat(F.upper("wing"), F.lit("("), F.coalesce("type", F.lit("general")), F.lit(")"), F.when(F.col("keywords") != "", F.concat(F.lit(" | "), F.col("keywords"))).otherwise(F.lit("")))
    line = F.concat(head, F.when(F.col("rooms").isNotNull(), F.concat(F.lit("\n  ROOMS: "), F.col("rooms"))).otherwise(F.lit("")))
    parts = shown.join(best, F.col("wing") == F.col("w"), "left").select(F.lit(1).alias("part"), F.col("wing").alias("name"), line.alias("line"))
    newest = stored.select("drawer_id", "wing", "room", "hall", "source_file").orderBy(F.desc("drawer_id")).limit(recent)
    newest = newest.select(F.lit(3).alias("part"), F.format_string("%020d", F.lit(1 << 62) - F.col("drawer_id")).alias("name"), F.format_string("  %s/%s [%s] %s", "wing", "room", "hall", "source_file").alias("line"))
    titles = stored.sparkSession.createDataFrame([(0, "", "## L1 — CRITICAL FACTS"), (2, "", "RECENT:")], "part int, name string, line string")
    return titles.unionByName(parts).unionByName(newest)


def summary(wings: DataFrame, stored: DataFrame, wing: str | None = None) -> DataFrame:
    """One row (text). Its rows are one a wing; the text is made for a prompt."""
    lines = summary_lines(wings, stored, wing)
    return lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "name", "line"))), lambda x: x.line), "\n").alias("text"))


def wake_up(wings: DataFrame, stored: DataFrame, identity_text: str = "", wing: str | None = None) -> DataFrame:
    """The identity, if any, a blank line, and the summary."""
    head = F.lit(identity_text + "\n\n" if identity_text else "")
    return summary(wings, stored, wing).select(F.concat(head, F.col("text")).alias("text"))
