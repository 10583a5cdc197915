"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Only DataFrame functions. Each document draws an exponential key divided by its quality weight; within a source the
documents follow in the order of their keys, and sizes are prefix-summed up to the source's token budget. Complete
epochs over a source precede that fractional selection.

The prefix sums are split: keys are cut into bins at quantiles, sizes are summed by (source, bin), and a window runs
within each (source, bin), so that no task gets a whole source. A key that many rows share is cut further by the order
of its ties. Of each source only its cut-off goes back to the documents: one row a source, broadcast if there are at
most BROADCAST_SOURCES of them, else joined. The sources themselves are ranked by range partitions and filled by sums.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own and the last; a null
doc_id draws the key of the text "null"; repeated rows draw one key and are told apart by their place in the input,
which therefore has to read alike twice, as a table of files does; an empty table gives an empty mix; other columns'
names don't matter, rows are packed before columns are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import WORD, saved, shards

#: Weights of sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its size.
MOST = 3
SEED = "mix"
BROADCAST_SOURCES = 20_000
UNIT = float(1 << 48)
#: Quantiles at which keys are cut, and parts of a key that repeats.
KNOTS, PARTS = 256, 256


def sampling_key(key: Column, size: Column, chars: Column) -> Column:
    """Exponential key over quality weight. The weight falls with the mean word length's distance from 6."""
    digest = F.md5(F.concat(F.lit(SEED), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / UNIT
    weight = 1 / (1 + F.abs(chars / F.greatest(size, F.lit(1)) - 7) / 7)
    return -F.log(uniform) / weight


def drawn(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Rows (row: the input's columns, source, size, draw: key and ties' order)."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.select(F.struct("*").alias("row"), F.col(source).alias("source"), F.col(key).alias("key"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("size"), F.length(t).alias("chars"))
    draw = F.struct(sampling_key(F.col("key"), F.col("size"), F.col("chars")).alias("at"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"))
    return out.select("row", "source", "size", draw.alias("draw"))


def ranked(sources: DataFrame, by: Column) -> DataFrame:
    """Adds n, each row's place from 0 in that order; by range partitions, whose sizes alone meet in one task."""
    rows = saved(sources.repartitionByRange(by).sortWithinPartitions(by).withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = sizes.select("part", (F.sum("rows").over(W.orderBy("part")) - F.col("rows")).alias("before"))
    out = rows.withColumn("p", part).join(F.broadcast(before), F.col("p") == F.col("part"))
    return out.withColumn("n", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).select(*sources.columns, "n")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Rows (source, source_size, target) from (source, source_size): shares of the total by weight, at most MOST
    times the source's size, the excess reshared by weight until none is above.

    Each round is one sum over the sources: those that the last level fills are capped, the rest shares what is left.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    out = ranked(sizes, F.col("source").asc_nulls_last()).withColumn("weight", weight.cast("double")).withColumn("cap", MOST * F.col("source_size"))
    out = saved(out.select("source", "source_size", "weight", "cap"), "weights")
    level, open_before = 0.0, None
    while True:
        free = F.col("cap") / F.col("weight") >= level
        total, capped, rest, open_now = out.agg(F.sum("source_size"), F.sum(F.when(~free, F.col("cap")).otherwise(0)), F.sum(F.when(free, F.col("weight"))), F.count(F.when(free, 1))).first()
        if not open_now or open_now == open_before:
            break
        level, open_before = (total - capped) / rest, open_now
    return out.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def bin_of(at: Column, tie: Column, knots: list[float], bins: int) -> Column:
    """Number of a key's bin, rising with (at, tie): even ones lie between the knots, cut to equal widths; a key that
    is a knot has bins of its own, by ties."""
    if not knots:
        return F.lit(0).cast("long")
    each = max(1, -(-bins // len(knots)))
    array = F.array(*map(F.lit, knots))
    below = F.size(F.filter(array, lambda x: x < at))
    low, high = F.get(array, below - 1), F.get(array, below)
    within = F.least(F.floor((at - low) / (high - low) * each), F.lit(each - 1))
    part = F.when(at == high, F.shiftright(tie, 56) + 128).otherwise(F.coalesce(within, F.lit(0)))
    return ((2 * below + F.coalesce(at == high, F.lit(False)).cast("int")).cast("long") * max(PARTS, each) + part).cast("long")


def cutoffs(rows: DataFrame, bins: int) -> DataFrame:
    """Rows (source, source_size, target, epochs, cutoff: the last draw taken once more, or null) of rows (source,
    size, draw)."""
    at = [i / KNOTS for i in range(1, KNOTS)]
    knots = sorted(set(rows.agg(F.percentile_approx("draw.at", at)).first()[0] or []))
    rows = rows.withColumn("bin", bin_of(F.col("draw.at"), F.col("draw.tie"), knots, bins))
    sums = saved(rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    per_source = targets(sums.groupBy("source").agg(F.sum("bin_size").alias("source_size")))
    epochs = F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")))
    per_source = saved(per_source.withColumn("epochs", F.coalesce(epochs, F.lit(0))), "sources")
    # Only the bin in which a source's budget ends is read row by row.
    plan = few(per_source.select(F.col("source").alias("s"), (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget")))
    offset = F.sum("bin_size").over(W.partitionBy("source").orderBy("bin")) - F.col("bin_size")
    bounds = sums.select("source", "bin", "bin_size", offset.alias("offset")).join(plan, F.col("source").eqNullSafe(F.col("s"))).filter("offset <= budget")
    ends = bounds.groupBy("source").agg(F.max(F.struct("bin", "offset", "budget")).alias("end")).select(F.col("source").alias("s"), F.col("end.bin").alias("b"), F.col("end.offset").alias("offset"), F.col("end.budget").alias("budget"))
    inside = rows.join(few(saved(ends, "ends")), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") <= F.col("b")))
    before = F.sum("size").over(W.partitionBy("source").orderBy("draw").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size") + F.col("offset")
    last = inside.filter("bin = b").select("source", "size", "draw", "budget", before.alias("before")).filter((F.col("before") + F.col("size") / 2 <= F.col("budget")) & (F.col("size") > 0))
    earlier = inside.filter((F.col("bin") < F.col("b")) & (F.col("size") > 0))
    last = last.select("source", "draw").unionByName(earlier.select("source", "draw")).groupBy(F.col("source").alias("s")).agg(F.max("draw").alias("cutoff"))
    return per_source.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def few(sources: DataFrame) -> DataFrame:
    """The rows of a table of one row a source, to be broadcast if they are counted as few."""
    return F.broadcast(sources) if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else sources


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (row: the input's columns, size, source, source_size, target, times: how often the mix takes the row)."""
    rows = drawn(df, key, text, source)
    plan = saved(cutoffs(saved(rows.select("source", "size", "draw"), "draws"), shards(df, 4, 64)), "cutoffs").withColumnRenamed("source", "s")
    once_more = F.coalesce(F.col("draw") <= F.col("cutoff"), F.lit(False)).cast("long")
    times = F.when(F.col("size") > 0, F.col("epochs") + once_more).otherwise(0)
    return rows.join(few(plan), F.col("source").eqNullSafe(F.col("s"))).select("row", "size", "source", "source_size", "target", times.cast("long").alias("times"))


def mixed_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The input's rows, with its columns, each as often as the mix takes it."""
    taken = mixed(df, key, text, source).filter("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("n")).select("row.*")
