"""Quality rules by distribution divergence: a document's character classes and common words against its language's.

Only DataFrame functions. References are estimated from trusted rows: of each language the shares of the character
classes, and of the RANKS commonest words, counted over all its trusted texts. Then each document is judged by itself in
one pass without shuffle, so skew can't matter there; the counts are summed up in each task before they are dealt out.

Defined cases: a null text has no words and fails the base rule; a text shorter than a guard isn't held against that
histogram; a language (null is one) with fewer than LEAST trusted rows is held against the character classes of all
trusted rows, and against no words; with fewer than LEAST trusted rows in all the classes are CLASSES; 5-word windows are
compared by 64-bit hashes; repeated rows are judged alike; clashing names of other columns are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import WORD, saved

#: Shares of character classes in running prose where nothing is trusted: white space, A-Z, 0-9, symbols, other ASCII
#: punctuation, the rest.
CLASSES = (0.16, 0.025, 0.005, 0.0005, 0.0295, 0.78)
RANKS, LEAST = 8, 30

#: Largest distances of a kept document, and the smallest texts that they are held against. The common words' is a share
#: of the distance of a text with none of them: trusted texts of sf0.1 reach 0.84 of it, the 99 % point is 0.63.
CLASS_DISTANCE, COMMON_SHARE = 0.20, 0.92
CLASS_CHARS, COMMON_WORDS = 100, 60
BROADCAST_LANGUAGES = 20_000

SYMBOLS = "#*$%&|<>"


def js_distance(counts: Column, total: Column, shares: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of an array of counts, with their total, from an array of
    shares; null if the total is 0. The arrays are arguments of one expression, so they are made once."""
    whole = F.when(total > 0, total.cast("double"))

    def term(c: Column, q: Column) -> Column:
        p = c / whole
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) / 2 + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0) / 2

    out = F.aggregate(F.zip_with(counts, shares, term), F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.sqrt(F.greatest(out, F.lit(0.0))))


def _only(c: Column, outside: str) -> Column:
    return F.length(F.regexp_replace(c, outside, ""))


def _dense(t: Column) -> Column:
    return F.regexp_replace(t, "[\\x20\\x09-\\x0D]+", "")


def references(trusted: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (lang, every, classes, listed words, shares) from trusted rows: one a language, and one with every = true
    whose classes are those of all; only those of LEAST rows or more."""
    rows = trusted.select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    dense = rows.select("lang", F.length("t").alias("chars"), _dense(F.col("t")).alias("d"))
    counts = dense.select("lang", (F.col("chars") - F.length("d")).alias("c0"), _only(F.col("d"), "[^A-Z]+").alias("c1"), _only(F.col("d"), "[^0-9]+").alias("c2"), _only(F.col("d"), "[^#*$%&|<>]+").alias("c3"), _only(F.col("d"), "[^!-/:-@\\[-`{-~]+").alias("a"), F.length("d").alias("n"))
    names = [f"c{i}" for i in range(len(CLASSES))]
    counts = counts.withColumn("c4", F.col("a") - F.col("c3")).withColumn("c5", F.col("n") - F.col("c1") - F.col("c2") - F.col("a"))
    sums = saved(counts.groupBy("lang").agg(F.count("*").alias("rows"), *(F.sum(c).alias(c) for c in names)), "classes")
    every = sums.agg(*(F.sum(c).alias(c) for c in ("rows", *names))).select(F.lit(None).cast("string").alias("lang"), F.lit(True).alias("every"), "rows", *names)
    sums = sums.select("lang", F.lit(False).alias("every"), "rows", *names).unionByName(every).filter(F.col("rows") >= LEAST)
    total = F.lit(0).cast("long")
    for c in names:
        total = total + F.col(c)
    sums = sums.filter(total > 0).select("lang", "every", F.array(*(F.col(c) / total for c in names)).alias("classes"))

    words = rows.select("lang", F.explode(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).alias("word")).groupBy("lang", F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    words = saved(words, "words")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = words.withColumn("rank", rank).filter(F.col("rank") <= RANKS).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"))
    all_words = words.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("all"))
    top = top.join(all_words, F.col("lang").eqNullSafe(F.col("l")))
    top = top.select("l", F.transform("top", lambda x: x.word).alias("listed"), F.array_max(F.transform("top", lambda x: F.octet_length(x.word))).alias("longest"), F.concat(F.transform("top", lambda x: x.n / F.col("all")), F.array(1 - F.aggregate("top", F.lit(0).cast("long"), lambda s, x: s + x.n) / F.col("all"))).alias("shares"))
    return saved(sums.join(top, ~F.col("every") & F.col("lang").eqNullSafe(F.col("l")), "left").drop("l"), "references")


def measured(df: DataFrame, trusted: DataFrame | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (row: the input's columns, the base figures, class_js, common_js: a share of the distance without any of the
    words, base_failed, kept). trusted: rows to estimate the references from."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = df.select(F.struct("*").alias("row"), F.col(lang).cast("string").alias("lang"), F.length(t).alias("chars"), words.alias("words"), _dense(t).alias("dense"), lines.alias("lines"))

    general = F.array(*map(F.lit, CLASSES))
    if trusted is None:
        out = out.withColumns({"classes": general, "listed": F.lit(None).cast("array<string>"), "longest": F.lit(0), "shares": F.lit(None).cast("array<double>")})
    else:
        known = references(trusted, text, lang)
        every = known.filter("every").select("classes").first()
        if every:
            general = F.array(*map(F.lit, every[0]))
        known = known.filter("not every").select(F.col("lang").alias("l"), F.col("classes").alias("own"), "listed", "longest", "shares")
        few = F.broadcast(known) if known.count() <= BROADCAST_LANGUAGES else known
        out = out.join(few, F.col("lang").eqNullSafe(F.col("l")), "left").drop("l").withColumn("classes", F.coalesce("own", general)).drop("own")

    dense = F.col("dense")
    short = F.when(F.col("listed").isNotNull(), F.transform(F.filter("words", lambda x: F.octet_length(x) <= F.col("longest")), lambda x: F.lower(x)))
    out = out.select("*", short.alias("short"))
    out = out.select(
        "row", "chars", "classes", "listed", "shares", F.size("words").alias("n"), F.length(dense).alias("word_chars"),
        _only(dense, "[^#*$%&|<>]+").alias("symbols"), _only(dense, "[^A-Z]+").alias("upper"), _only(dense, "[^0-9]+").alias("digits"), _only(dense, "[^!-/:-@\\[-`{-~]+").alias("ascii"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("dup_lines"), F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"),
        F.filter(F.transform("short", lambda x: F.array_position("listed", x) - 1), lambda x: x >= 0).alias("common"),
    )
    at = lambda i: F.get("hashes", i)
    windows = F.when(F.col("n") >= 5, F.transform(F.sequence(F.lit(0), F.greatest(F.col("n") - 5, F.lit(0))), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2), at(i + 3), at(i + 4))))
    out = out.withColumns({"windows": windows, "hits": F.transform(F.sequence(F.lit(0), F.size("listed") - 1), lambda k: F.size(F.filter("common", lambda x: x == k)))})
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    out = out.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("sorted", lambda x, i: F.coalesce(x.h == F.get("sorted", i - 1).h, F.lit(False)) | F.coalesce(x.h == F.get("sorted", i + 1).h, F.lit(False)))
    places = F.sort_array(F.transform(twice, lambda x: x.i))
    covered = F.aggregate(
        places, F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s.n + F.least(F.lit(5), i - s.last)).alias("n")), lambda s: s.n,
    )
    classes = [F.col("chars") - F.col("word_chars"), F.col("upper"), F.col("digits"), F.col("symbols"), F.col("ascii") - F.col("symbols")]
    classes.append(F.col("word_chars") - F.col("upper") - F.col("digits") - F.col("ascii"))
    long = lambda c: c.cast("long")
    none = F.transform("shares", lambda q, i: F.when(i == F.size("shares") - 1, 1).otherwise(0))
    figures = F.struct(
        long(F.col("n")).alias("n_words"), long(F.col("word_chars")).alias("word_chars"), long(F.col("symbols")).alias("n_symbols"),
        long(F.col("dup_lines")).alias("n_dup_lines"), long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
        F.when(F.col("chars") >= CLASS_CHARS, js_distance(F.array(*classes), F.col("chars"), F.col("classes"))).alias("class_js"),
        F.when(F.col("listed").isNotNull() & (F.col("n") >= COMMON_WORDS), js_distance(F.concat("hits", F.array(F.col("n") - F.size("common"))), F.col("n"), F.col("shares")) / js_distance(none, F.lit(1), F.col("shares"))).alias("common_js"),
    )
    # A filter on what a generator puts out can't be pushed below it, into the making of the arrays.
    out = out.select("row", F.inline(F.array(figures)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    near = (F.coalesce("class_js", F.lit(0.0)) <= CLASS_DISTANCE) & (F.coalesce("common_js", F.lit(0.0)) <= COMMON_SHARE)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & near)


def kept_rows(df: DataFrame, trusted: DataFrame | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The input's rows, with its columns, that the rules keep."""
    return measured(df, trusted, text, lang).filter("kept").select("row.*")
