"""Text functions: words, a light suffix stemmer, term frequencies. All but the terms of a corpus are column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.sources.shared import saved

# The stop words of the index. They decide which terms exist.
STOPWORDS = (
    "a an and are as at be by for from has he in is it its of on or that the to was were will with you your this but "
    "had have his her not she they we been can do did does each get got how i if into just me my no our out so some than "
    "them then there these those up what when which who whom why would about after all also any because before between "
    "both could during few more most other over same should such through too under very where"
).split()

#: Broadcast the keys that several documents have only if there are no more.
BROADCAST_KEYS = 500_000

#: Words that a step of document_terms counts, but at least one document's; words whose stems a worker remembers.
STEP_WORDS, REMEMBERED = 1_000_000, 300_000

#: A run of letters and decimal digits.
SEPARATOR = r"[^\p{L}\p{Nd}]+"


def words(text: Column) -> Column:
    """The words of a text that are at least two bytes long and no stop words, in order, unstemmed."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR)
    return F.filter(parts, lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOPWORDS))


def letter_classes(word: Column) -> Column:
    """A string of V and C by letter: y is a consonant at the start and after a vowel; a non-ASCII letter counts as
    several consonants, as its bytes do."""
    c = F.regexp_replace(F.regexp_replace(word, "[^\\x00-\\x7F]", "bb"), "[aeiou]", "V")
    c = F.regexp_replace(F.regexp_replace(c, "[^Vy]", "C"), "^y", "C")
    for _ in range(3):
        c = F.replace(F.replace(c, F.lit("Cy"), F.lit("CV")), F.lit("Vy"), F.lit("VC"))
    return c


def let(value: Column, function: Callable[[Column], Column]) -> Column:
    """function of a value that is computed once: a lambda's argument isn't inlined, so the expression stays small."""
    return F.transform(F.array(value), function)[0]


def stem(word: Column) -> Column:
    """The stem of a word: plural endings, then -eed, -ed and -ing with repair of what remains."""
    cut = lambda c, n: F.substring(c, F.lit(1), F.length(c) - n)

    def repaired(b: Column, c: Column) -> Column:
        last = F.right(b, F.lit(1))
        double = (last == F.substring(b, -2, 1)) & last.rlike("[a-z0-9]") & c.endswith("C") & (F.length(b) >= 2)
        short = c.rlike("^C*V+C+V*$") & c.endswith("CVC") & ~last.isin("w", "x", "y")
        out = F.when(b.endswith("at") | b.endswith("bl") | b.endswith("iz"), F.concat(b, F.lit("e")))
        return out.when(double & ~last.isin("l", "s", "z"), cut(b, 1)).when(short, F.concat(b, F.lit("e"))).otherwise(b)

    def verb(a: Column) -> Column:
        eed = F.when(letter_classes(cut(a, 3)).contains("VC"), cut(a, 1)).otherwise(a)
        bare = F.when(a.endswith("ed"), cut(a, 2)).when(a.endswith("ing"), cut(a, 3))
        whole = let(bare, lambda b: F.when(b.rlike("[aeiou]|.y"), let(letter_classes(b), lambda c: repaired(b, c))).otherwise(a))
        return F.when(a.endswith("eed"), eed).when(a.endswith("ed") | a.endswith("ing"), whole).otherwise(a)

    def singular(w: Column) -> Column:
        return F.when(w.endswith("sses") | w.endswith("ies"), cut(w, 2)).when(w.endswith("ss"), w).when(w.endswith("s"), cut(w, 1)).otherwise(w)

    return let(word, lambda w: F.when(F.octet_length(w) <= 2, w).otherwise(let(singular(w), verb)))


def stemmed(df: DataFrame, word: str, name: str) -> DataFrame:
    """Adds the stem of a word."""
    return df.withColumn(name, stem(F.col(word)))


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, word, n) of the unstemmed words."""
    return df.select(key, F.explode(words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, term, n). Equal words of a document are counted before they are stemmed. For small tables and plans
    that mustn't write: each document's words are stemmed where they are."""
    return stemmed(word_counts(df, key, text), "word", "term").groupBy(key, "term").agg(F.sum("n").alias("n"))


def plain_stem(word: str) -> str:
    """stem of one word in Python."""

    def classes(w: str) -> str:
        c = re.sub("[aeiou]", "V", re.sub("[^\\x00-\\x7F]", "bb", w))
        c = re.sub("^y", "C", re.sub("[^Vy]", "C", c))
        for _ in range(3):
            c = c.replace("Cy", "CV").replace("Vy", "VC")
        return c

    if len(word.encode()) <= 2:
        return word
    a = word[:-2] if word.endswith(("sses", "ies")) else word[:-1] if word.endswith("s") and not word.endswith("ss") else word
    if a.endswith("eed"):
        return a[:-1] if "VC" in classes(a[:-3]) else a
    if not a.endswith(("ed", "ing")):
        return a
    b = a[:-2] if a.endswith("ed") else a[:-3]
    if not re.search("[aeiou]|.y", b):
        return a
    if b.endswith(("at", "bl", "iz")):
        return b + "e"
    c, last = classes(b), b[-1:]
    if len(b) >= 2 and b[-2] == last and re.search("[a-z0-9]", last) and c.endswith("C") and last not in "lsz":
        return b[:-1]
    return b + "e" if re.search("^C*V+C+V*$", c) and c.endswith("CVC") and last not in "wxy" else b


def _row_terms(df: DataFrame, key: str, text: str, carry: tuple[str, ...], best: int | None) -> DataFrame:
    """document_terms where each row is a document. The rows of a step are sorted by term, so that pages of a file that
    is written of them hold few terms."""
    kept = [key, *carry]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def step(batch: pa.RecordBatch, sizes: np.ndarray, stems: dict[str, str]) -> pa.RecordBatch:
        coded = batch.column(len(kept)).flatten().dictionary_encode()
        if len(stems) > REMEMBERED:
            stems.clear()
        terms = [stems[w] if w in stems else stems.setdefault(w, plain_stem(w)) for w in coded.dictionary.to_pylist()]
        ordered = sorted(set(terms))
        place = {t: i for i, t in enumerate(ordered)}
        codes = np.array([place[t] for t in terms])[coded.indices.to_numpy()]
        pairs, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(ordered) + codes, return_counts=True)
        row, term = np.divmod(pairs, len(ordered))
        if best is not None:
            order = np.lexsort((term, -n, row))
            first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))])[row[order]]
            order = order[np.arange(len(order)) - first < best]
        else:
            order = np.lexsort((row, term))
        row, term, n = row[order], term[order], n[order]
        columns = [batch.column(i).take(pa.array(row)) for i in range(len(kept))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(ordered).take(pa.array(term)), pa.array(n), pa.array(sizes[row])], names=[*kept, "term", "n", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, str] = {}
        for batch in batches:
            sizes = pc.list_value_length(batch.column(len(kept))).to_numpy()
            steps = np.cumsum(sizes) // STEP_WORDS if len(sizes) else sizes
            starts = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist(), len(sizes)]
            for i, j in zip(starts, starts[1:]):
                if sizes[i:j].sum():
                    yield step(batch.slice(i, j - i), sizes[i:j].astype(np.int64), stems)

    return df.select(*kept, words(F.col(text)).alias("_words")).mapInArrow(run, f"{kinds}, term string, n long, total long")


def document_terms(df: DataFrame, key: str, text: str, carry: tuple[str, ...] = (), best: int | None = None) -> DataFrame:
    """Rows (key, *carry, term, n, total: the document's number of words) of a corpus; best: only so many terms of each
    document, the most frequent ones, ties by term.

    A row's words are counted where they are, without a shuffle. Rows of one key are one document: their keys are found
    first, and only their counts are added up by key; each of the rows carries its own columns."""
    again = saved(df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_key"), "again")
    repeated = again.count()
    if not repeated:
        return _row_terms(df, key, text, carry, best)
    keys = F.broadcast(again) if repeated <= BROADCAST_KEYS else again
    same = F.col(key).eqNullSafe(F.col("_key"))
    several = df.join(keys, same, "left_semi")
    counts = _row_terms(several, key, text, (), None).groupBy(key, "term").agg(F.sum("n").alias("n")).withColumn("total", F.sum("n").over(W.partitionBy(key)))
    if best is not None:
        counts = counts.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "term"))).filter(F.col("_rank") <= best).drop("_rank")
    if carry:
        counts = counts.withColumnRenamed(key, "_key").join(several.select(key, *carry), same).drop("_key")
    return _row_terms(df.join(keys, same, "left_anti"), key, text, carry, best).unionByName(counts.select(key, *carry, "term", "n", "total"))


def term_frequencies(df: DataFrame, key: str, text: str, corpus: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, term, tf): a term's share of its document's terms. corpus: by document_terms, which writes a table and
    can carry columns."""
    if corpus:
        return document_terms(df, key, text, carry).select(key, *carry, "term", (F.col("n") / F.col("total")).alias("tf"))
    counts = term_counts(df, key, text)
    return counts.select(key, "term", (F.col("n") / F.sum("n").over(W.partitionBy(key))).alias("tf"))


def session_ids(raw: Column) -> Column:
    """A comma-separated list's non-blank parts, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def first_bytes(text: Column, n: int = 1500) -> Column:
    """At most n bytes of a text, whole characters."""
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, n).cast("string")), "\uFFFD+$", ""))


def human_bytes(n: Column) -> Column:
    """A size in units of 1024 with one decimal; plain bytes below that."""
    e = F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double")) / 10 + 1e-12).cast("int")
    unit = F.element_at(F.array(*map(F.lit, "KMGTPE")), F.greatest(e, F.lit(1)))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.format_string("%.1f %sB", F.bround(n / F.pow(F.lit(1024.0), e), 1), unit))
