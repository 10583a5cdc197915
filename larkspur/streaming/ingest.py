"""Documents that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from larkspur.functions import text
from larkspur.memory import Memory
from larkspur.operators import store


def into(stream: DataFrame, memory: Memory, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Adds a stream of items (content, wing, room[, ...]) to a store, batch by batch; a batch writes its own drawers and
    postings and commits them at once. A batch that is run again adds nothing, as contents are kept once."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: memory.add(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def fresh(stream: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Items of a stream whose hash hasn't come within the watermark."""
    hashed = stream.withColumn("content_hash", store.content_hash(F.col("content"), F.col("source_file"), F.col("hall")))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])


def term_rates(stream: DataFrame, time: str = "ts", window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Words per window of a stream with times and contents, late ones within the delay included."""
    words = stream.withWatermark(time, delay).select(time, F.explode(text.words(F.col("content"))).alias("word"))
    return words.groupBy(F.window(time, window), "word").count()
