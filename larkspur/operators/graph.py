"""Temporal knowledge graph: entities, and triples with validity intervals as ISO dates (null: open)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def entity_id(name: Column) -> Column:
    return F.lower(F.replace(F.trim(name), F.lit(" "), F.lit("_")))


def predicate(name: Column) -> Column:
    """Normal form of a predicate; not trimmed."""
    return F.lower(F.replace(name, F.lit(" "), F.lit("_")))


def put_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by id; new (seq, name, type, properties), of equal ids the last."""
    rows = new.select(entity_id(F.col("name")).alias("entity_id"), "name", F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("properties", F.lit("{}")).alias("properties"), "seq")
    last = F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("seq")))
    rows = rows.withColumn("_n", last).filter("_n = 1").drop("_n", "seq")
    return entities.join(rows.select("entity_id"), "entity_id", "left_anti").unionByName(rows)


def named_entities(facts: DataFrame) -> DataFrame:
    """Rows (entity_id, name, type, properties): the subjects and objects of facts (seq, subject, predicate, object),
    each under the name that it had first."""
    ends = facts.select(F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("subject").alias("name")), F.struct(F.lit(1).alias("end"), F.col("object").alias("name")))).alias("e"), "seq")
    ends = ends.groupBy(entity_id(F.col("e.name")).alias("entity_id")).agg(F.min_by("e.name", F.struct("seq", "e.end")).alias("name"))
    return ends.select("entity_id", "name", F.lit("unknown").alias("type"), F.lit("{}").alias("properties"))


def normal_facts(facts: DataFrame) -> DataFrame:
    """Facts in normal form; an empty date is null, confidence is 1."""
    date = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return facts.select("seq", entity_id(F.col("subject")).alias("subject"), predicate(F.col("predicate")).alias("predicate"), entity_id(F.col("object")).alias("object"), date("valid_from"), date("valid_to"), F.lit(1.0).alias("confidence"))


def new_triples(stored: DataFrame, facts: DataFrame) -> DataFrame:
    """The facts that become triples: not those that an open triple, stored or earlier among the facts, says already.
    A fact that is closed from the start hides no later one. Of open ones the first is an aggregate, so a fact that is
    said very often is a row a task."""
    same = ["subject", "predicate", "object"]
    rows = normal_facts(facts).join(stored.filter("valid_to is null").select(*same).distinct(), same, "left_anti")
    first = rows.filter("valid_to is null").groupBy(*same).agg(F.min(F.struct("seq", "valid_from", "valid_to", "confidence")).alias("first"))
    closed = rows.filter("valid_to is not null").join(first, same, "left").filter("first is null or seq < first.seq")
    rows = first.select(*same, "first.*").unionByName(closed.drop("first"))
    key = F.concat_ws("\0", *same, F.col("seq").cast("string"))
    return rows.select(F.concat(F.lit("t_"), F.md5(key)).alias("triple_id"), *same, "valid_from", "valid_to", "confidence")


def invalidated(triples: DataFrame, ends: DataFrame) -> DataFrame:
    """Closes the open triples that ends (subject, predicate, object, ended) name; without a date they end today."""
    date = F.coalesce(F.when(F.col("ended") != "", F.col("ended")), F.date_format(F.current_date(), "yyyy-MM-dd"))
    ends = ends.select(entity_id(F.col("subject")).alias("s"), predicate(F.col("predicate")).alias("p"), entity_id(F.col("object")).alias("o"), date.alias("e")).groupBy("s", "p", "o").agg(F.min("e").alias("e"))
    same = (F.col("subject") == F.col("s")) & (F.col("predicate") == F.col("p")) & (F.col("object") == F.col("o"))
    return triples.join(ends, same & F.col("valid_to").isNull(), "left").withColumn("valid_to", F.coalesce("valid_to", "e")).drop("s", "p", "o", "e")


def as_of(date: Column | str | None) -> Column:
    """Whether a triple holds at a date, both ends included; always without a date."""
    if date is None:
        return F.lit(True)
    d = F.lit(date) if isinstance(date, str) else date
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= d)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= d))


def about(triples: DataFrame, entities: DataFrame, asked: DataFrame, direction: str = "both") -> DataFrame:
    """Triples about the asked entities (name, as_of or null): (asked, direction, subject_name, predicate, object_name,
    valid_from, valid_to, current). The asked side bears the asker's spelling. A triple whose other end is unknown
    drops out. A loop shows twice, once a direction."""
    asked = asked.select(F.col("name").alias("asked"), entity_id(F.col("name")).alias("id"), "as_of")
    holds = F.col("as_of").isNull() | as_of(F.col("as_of"))
    parts = []
    for name, own, other in (("outgoing", "subject", "object"), ("incoming", "object", "subject")):
        if direction in (name, "both"):
            found = triples.join(asked, (F.col(own) == F.col("id")) & holds).join(entities.select(F.col("entity_id").alias("e"), F.col("name").alias("other")), F.col(other) == F.col("e"))
            ends = {own: F.col("asked"), other: F.col("other")}
            parts.append(found.select("asked", F.lit(name).alias("direction"), ends["subject"].alias("subject_name"), "predicate", ends["object"].alias("object_name"), "valid_from", "valid_to", F.col("valid_to").isNull().alias("current")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def timeline(triples: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    """All triples with the entity at either end, by date, undated ones last; both names as stored."""
    own = entity_id(F.lit(name))
    a, b = (entities.select(F.col("entity_id").alias(f"{x}_id"), F.col("name").alias(f"{x}_name")) for x in ("subject", "object"))
    out = triples.filter((F.col("subject") == own) | (F.col("object") == own)).join(a, F.col("subject") == F.col("subject_id")).join(b, F.col("object") == F.col("object_id"))
    return out.select("subject_name", "predicate", "object_name", "valid_from", "valid_to", F.col("valid_to").isNull().alias("current")).orderBy(F.asc_nulls_last("valid_from"), "subject_name", "predicate", "object_name")


def stats(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: entities, triples, current, expired."""
    t = triples.agg(F.count("*").alias("triples"), F.count(F.when(F.col("valid_to").isNull(), 1)).alias("current"))
    return entities.agg(F.count("*").alias("entities")).crossJoin(t).withColumn("expired", F.col("triples") - F.col("current"))


def conflicts(triples: DataFrame, facts: DataFrame) -> DataFrame:
    """Open triples that say of a fact's subject and predicate another object: (seq, subject, predicate, object,
    other)."""
    new = normal_facts(facts).select("seq", "subject", "predicate", "object")
    old = triples.filter("valid_to is null").select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("other"))
    return new.join(old, (F.col("subject") == F.col("s")) & (F.col("predicate") == F.col("p")) & (F.col("object") != F.col("other"))).drop("s", "p")


def contradictions(triples: DataFrame) -> DataFrame:
    """Subjects and predicates with several open objects: (subject, predicate, objects). One row a subject and
    predicate instead of all pairs."""
    objects = triples.filter("valid_to is null").groupBy("subject", "predicate").agg(F.sort_array(F.collect_set("object")).alias("objects"))
    return objects.filter(F.size("objects") > 1)


def reach(triples: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """Rows (start, entity, hops): what open triples lead to from the start entities (entity_id), breadth first."""
    edges = triples.filter("valid_to is null").select(F.col("subject").alias("u"), F.col("object").alias("v"))
    edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    seen = start.select(F.col("entity_id").alias("start"), F.col("entity_id").alias("entity"), F.lit(0).alias("hops"))
    last = seen
    for k in range(1, hops + 1):
        step = last.join(edges, F.col("entity") == F.col("u")).select("start", F.col("v").alias("entity"), F.lit(k).alias("hops")).distinct()
        last = step.join(seen, ["start", "entity"], "left_anti")
        seen = seen.unionByName(last)
    return seen
