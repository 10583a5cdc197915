"""The hierarchical store: wings hold rooms, rooms hold drawers; a drawer's content is kept once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.functions.text import document_terms

DRAWER = "drawer_id long, content string, content_hash string, wing string, room string, hall string, source_file string, source_type string"


def content_hash(content: Column, source_file: Column, hall: Column) -> Column:
    """Identity of a drawer: SHA-256 of content, source and hall with zero bytes between."""
    zero = F.lit("\0")
    return F.sha2(F.concat(F.coalesce(content, F.lit("")), zero, F.coalesce(source_file, F.lit("")), zero, F.coalesce(hall, F.lit(""))), 256)


def drawers(items: DataFrame) -> DataFrame:
    """New drawers of items (drawer_id, content, wing, room[, hall, source_file, source_type]): defaults filled in, of
    items of one hash the one with the least id. Wing and room are no part of the hash."""
    for name, value in (("hall", "facts"), ("source_file", ""), ("source_type", "file")):
        items = items.withColumn(name, F.coalesce(F.when(F.col(name) != "", F.col(name)), F.lit(value)) if name in items.columns else F.lit(value))
    hashed = items.withColumn("content_hash", content_hash(F.col("content"), F.col("source_file"), F.col("hall")))
    first = F.row_number().over(W.partitionBy("content_hash").orderBy("drawer_id"))
    return hashed.withColumn("_n", first).filter("_n = 1").drop("_n")


def add_drawers(stored: DataFrame, items: DataFrame) -> DataFrame:
    """Those of the items' drawers whose hash isn't stored yet."""
    return drawers(items).join(stored.select("content_hash"), "content_hash", "left_anti")


def add_variants(stored: DataFrame, items: DataFrame, halls: list[str]) -> DataFrame:
    """A drawer for each named column of an item that holds a text, the column's name being its hall. Ids are the
    item's id times the number of halls, plus the hall's place."""
    parts = F.filter(F.array(*(F.struct(F.lit(h).alias("hall"), F.lit(i).alias("i"), F.col(h).alias("content")) for i, h in enumerate(halls))), lambda x: F.coalesce(x.content, F.lit("")) != "")
    rows = items.withColumn("_v", F.explode(parts)).withColumn("drawer_id", F.col("drawer_id") * len(halls) + F.col("_v.i"))
    return add_drawers(stored, rows.withColumn("content", F.col("_v.content")).withColumn("hall", F.col("_v.hall")).drop("_v", *halls))


def add_names(stored: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-if-absent: rows of names whose keys aren't stored, of equal keys the one with the least id."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy("id"))
    return names.withColumn("_n", first).filter("_n = 1").drop("_n").join(stored.select(*keys), keys, "left_anti")


def detect_rooms(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, room): the two most frequent stems joined by a hyphen, ties by stem; without terms `general`."""
    ranked = F.struct((-F.col("n")).alias("n"), "term")
    names = document_terms(df, key, text, best=2).groupBy(F.col(key).alias("_k")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(ranked)), lambda x: x.term), "-").alias("room"))
    return df.select(key).join(names, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("room", F.lit("general")).alias("room"))


def list_drawers(stored: DataFrame, wing: str | None = None, room: str | None = None) -> DataFrame:
    """Drawers newest first; ids stand for the order of creation. A room needs a wing."""
    out = stored
    if wing is not None:
        out = out.filter(F.col("wing") == wing)
        if room is not None:
            out = out.filter(F.col("room") == room)
    return out.orderBy(F.desc("drawer_id"))


def got(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """Drawers by id: a point lookup for each row of ids (drawer_id); unknown ids give none."""
    return stored.join(ids.select("drawer_id").distinct(), "drawer_id", "left_semi")


def status(stored: DataFrame, triples: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """One row of counts: wings, rooms, drawers, entities, triples."""
    out = stored.agg(F.countDistinct("wing").alias("wings"), F.countDistinct("wing", "room").alias("rooms"), F.count("*").alias("drawers"))
    for name, table in (("entities", entities), ("triples", triples)):
        out = out.crossJoin(table.agg(F.count("*").alias(name))) if table is not None else out.withColumn(name, F.lit(0).cast("long"))
    return out


def wing_breakdown(wings: DataFrame, stored: DataFrame, embedded: DataFrame) -> DataFrame:
    """Rows (wing, drawers, embedded) for all wings, empty ones too. embedded: a table of drawer ids."""
    marked = stored.select("wing", "drawer_id").join(embedded.select("drawer_id", F.lit(1).alias("e")), "drawer_id", "left")
    sums = marked.groupBy("wing").agg(F.count("*").alias("drawers"), F.count("e").alias("embedded"))
    return wings.select("wing").join(sums, "wing", "left").select("wing", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("drawers", "embedded")))


def tunnels(stored: DataFrame, wing_a: str | None = None, wing_b: str | None = None) -> DataFrame:
    """Rooms whose name occurs in several wings: (room, wings sorted, drawers), optionally only those in both wings
    named. Partial sums by (room, wing) go before those by room."""
    by = stored.groupBy("room", "wing").agg(F.count("*").alias("n"))
    out = by.groupBy("room").agg(F.sort_array(F.collect_set("wing")).alias("wings"), F.sum("n").alias("drawers")).filter(F.size("wings") > 1)
    for wing in (wing_a, wing_b):
        if wing is not None:
            out = out.filter(F.array_contains("wings", wing))
    return out.orderBy(F.desc("drawers"), "room")


def pending(stored: DataFrame, embedded: DataFrame, limit: int | None = None) -> DataFrame:
    """Drawers without an embedding, by id."""
    out = stored.join(embedded.select("drawer_id"), "drawer_id", "left_anti").orderBy("drawer_id")
    return out.limit(limit) if limit else out


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert by append: of each key's rows the last one."""
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return log.withColumn("_n", last).filter("_n = 1").drop("_n")
