"""Retrieval measured on the three kinds of question sets, from their JSON files to recall.

Each function takes the table that the reader of sources.files gives, and searches all its questions in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import evaluate, lexical
from larkspur.sources import conversations
from larkspur.sources.shared import saved


def numbered(rows: DataFrame, *by: str) -> DataFrame:
    """Adds drawer_id: a hash of the columns that name a row."""
    return rows.withColumn("drawer_id", F.xxhash64(*by))


def sessions(questions: DataFrame, scoped: bool = False, cut: int = 10) -> DataFrame:
    """Rows (measure, type or null for all, n, r1, r5, r10): whether a result holds the answer (measure text), and whether
    it is an answer's session (measure session). All sessions are one store, each once; scoped: a question's results are
    narrowed to its own sessions."""
    both = F.arrays_zip(F.col("haystack_session_ids").alias("id"), F.col("haystack_sessions").alias("turns"))
    held = questions.select("question_id", F.explode(both).alias("s")).select("question_id", "s.id", "s.turns")
    once = held.groupBy("id").agg(F.first("turns").alias("turns"))
    turns = once.select(F.col("id").alias("conv_id"), F.posexplode("turns").alias("turn", "t")).select("conv_id", "turn", F.col("t.role").alias("speaker"), F.col("t.content").alias("content"))
    drawers = saved(numbered(conversations.whole_sessions(turns).withColumnRenamed("conv_id", "source_file"), "source_file"), "sessions")
    index = lexical.stored(lexical.postings(drawers, corpus=True))
    asked = questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("query"), F.col("question_type").alias("type"), evaluate.normal_answer(F.col("answer")).alias("answer"), "answer_session_ids")
    found = lexical.bm25(index, asked.select("query_id", "query"), 5 * cut if scoped else cut).join(drawers.select("drawer_id", "source_file", "content"), "drawer_id")
    if scoped:
        found = evaluate.scoped(found, held.select(F.col("question_id").alias("query_id"), F.col("id").alias("source_file")).distinct(), cut)
    found = saved(found.join(asked.select("query_id", "answer", "answer_session_ids"), "query_id"), "found")
    out = None
    for measure, hit in (("text", evaluate.contains_answer(F.col("content"), F.col("answer"))), ("session", F.array_contains("answer_session_ids", F.col("source_file")))):
        first = evaluate.first_hits(found, hit)
        every = evaluate.recall(asked, first).withColumn("type", F.lit(None).cast("string"))
        part = evaluate.recall(asked, first, ["type"]).unionByName(every).select(F.lit(measure).alias("measure"), "type", "n", *(f"r{k}" for k in evaluate.CUTS))
        out = part if out is None else out.unionByName(part)
    return out


def dialogues(samples: DataFrame, size: int = 20, cut: int = 10) -> DataFrame:
    """Rows (category or null for all, n, r1, r5, r10): whether a result's messages are among a question's evidence.
    Each sample is a store of its own, of chunks of so many messages in the order of its sessions."""
    message = "struct<speaker:string,dia_id:string,text:string,blip_caption:string,query:string>"
    parts = samples.select("sample_id", F.explode("conversation").alias("name", "value")).withColumn("session", conversations.session_number(F.col("name"))).filter("session is not null")
    rows = parts.select("sample_id", "session", F.posexplode(F.try_variant_get("value", "$", f"array<{message}>")).alias("at", "m"))
    rows = rows.select("sample_id", F.concat_ws("/", "sample_id", "session").alias("session"), F.col("at").alias("position"), F.col("m.dia_id").alias("id"), "m.speaker", "m.text", F.col("m.blip_caption").alias("caption"), "m.query")
    chunks = conversations.chunks(rows.drop("sample_id"), size).withColumn("store", F.regexp_extract("session", "^(.*)/", 1))
    chunks = saved(numbered(chunks, "session", "chunk"), "chunks")
    qa = samples.select("sample_id", F.posexplode("qa").alias("at", "q"))
    asked = qa.select(F.concat_ws("/", "sample_id", "at").alias("query_id"), F.col("sample_id").alias("store"), F.col("q.question").alias("query"), F.col("q.category").alias("category"), F.col("q.evidence").alias("evidence"))
    found = lexical.bm25_by(lexical.postings_by(chunks, "store"), asked, "store", cut).join(chunks.select("drawer_id", "source_file"), "drawer_id").join(asked.select("query_id", "evidence"), "query_id")
    first = evaluate.first_hits(found, evaluate.evidence_hit(F.col("source_file"), F.col("evidence")))
    every = evaluate.recall(asked, first).withColumn("category", F.lit(None).cast("int"))
    return evaluate.recall(asked, first, ["category"]).unionByName(every).select("category", "n", *(f"r{k}" for k in evaluate.CUTS))


def evidence_cases(cases: DataFrame, cut: int = 10) -> DataFrame:
    """Rows (context_size or null for all, n, hits, percent, strict_hits, strict_percent): whether the first result is a
    conversation with evidence, and whether it is the latest of them. Each case is a store of its own."""
    cases = saved(cases.withColumn("store", F.monotonically_increasing_id()), "cases")
    held = cases.select("store", F.posexplode("conversations").alias("position", "c")).select("store", "position", F.col("c.id").alias("source_file"), F.col("c.containsEvidence").alias("evidence"), "c.messages")
    text = F.array_join(F.transform("messages", lambda m: F.concat(m.speaker, F.lit(": "), m.text)), "\n")
    drawers = saved(numbered(held.select("store", "position", "source_file", "evidence", text.alias("content")), "store", "position"), "drawers")
    asked = cases.select("store", "contextSize", F.posexplode("evidenceItems").alias("at", "e")).select(F.concat_ws("/", "store", "at").alias("query_id"), "store", F.col("contextSize").alias("context_size"), F.col("e.question").alias("query"))
    found = lexical.bm25_by(lexical.postings_by(drawers, "store"), asked, "store", cut).join(drawers.select("drawer_id", "source_file"), "drawer_id")
    evidence = asked.join(drawers.filter("evidence").select("store", "source_file", "position"), "store").select("query_id", "source_file", "position")
    ranks = asked.join(evaluate.lenient_and_strict(found, evidence), "query_id", "left")
    hit = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    lenient = evaluate.by_size(ranks.select("context_size", hit("first").alias("hit")))
    strict = evaluate.by_size(ranks.select("context_size", hit("first_latest").alias("hit"))).select(F.col("context_size").alias("s"), F.col("hits").alias("strict_hits"), F.col("percent").alias("strict_percent"))
    return lenient.join(strict, F.col("context_size").eqNullSafe(F.col("s"))).drop("s")
