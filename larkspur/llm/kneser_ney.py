"""Quality classifier: an interpolated modified Kneser-Ney model of words and pairs of words, trained on trusted texts.

A text's words, A-Z lower-cased, stand between a mark of its begin and one of its end. Pairs (v, w) are counted over the
trusted texts in shards by v, where each context's total and discounts are at hand; each shard sends the words that
follow in it to shards by word, which count the contexts that a word has (its continuations) and answer with that count.
From these a shard derives the probability of each of its pairs. The model is a sum: every word adds the log of its
continuation probability and, as a context, that of its back-off weight; a pair that training has seen adds what it
differs by. So a document's score is a join of its words and pairs with the counts' shards (see sharded.sums), and no
table goes to the driver but 1 / HOT of the commonest entries and a bitmap of fixed size.

A document's perplexity per word, the end included, is held against MARGIN times the QUANTILE of trusted documents of
its language (of all languages, where one has fewer than LEAST of them). One trusted document in FOLDS isn't trained
on; the quantiles are those of these. It is trained on all other trusted texts (TRAINED, if it is set, bounds their
characters), all documents are scored, and all held-out ones make the quantiles. Tables and shuffles that were needed
for the fit only are deleted before the documents are scored.

Defined cases: a null or empty text is scored as its end alone; a null language is a language of its own; words that
hold zero bytes are words as others; without trusted texts every word has probability 1 and all documents are kept;
repeated rows are judged alike, each on its own; a null key isn't trusted; an empty table gives no rows; other columns
aren't read. Words and pairs are told apart by 48-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import sharded
from larkspur.llm.common import discarded, fold, released, saved
from larkspur.llm.sharded import BEGIN, END, pack, pack_sorted, slices, unpack, unpack_sorted

QUANTILE, MARGIN, LEAST, FOLDS = 0.99, 1.1, 30, 5
#: Characters of trusted texts that are trained on, about, at most: an even share of their rows; None: all.
TRAINED: int | None = None
BROADCAST_KEYS = 500_000
#: Pairs that a task holds before it sends them.
HELD = 3_000_000


def pair_ids(v: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    """Ids of pairs, in the shard of their first words; 48 bits."""
    with np.errstate(over="ignore"):
        x = (v ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F) + w * np.uint64(0x165667B19E3779F9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    if bits:
        x = (v >> np.uint64(64 - bits)) << np.uint64(64 - bits) | x >> np.uint64(bits)
    return x & np.uint64(0xFFFFFFFFFFFF0000)


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, words, each one's text) of all texts."""
    words = [sharded.word_ids(t) for t in texts]
    v = np.concatenate([x for w in words for x in ([BEGIN], w)]) if words else np.empty(0, np.uint64)
    w = np.concatenate([x for w in words for x in (w, [END])]) if words else np.empty(0, np.uint64)
    return v.astype(np.uint64), w.astype(np.uint64), np.repeat(np.arange(len(texts)), [len(x) + 1 for x in words])


def unique_pairs(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs and the sums of their counts."""
    order = np.lexsort((w, v))
    v, w = v[order], w[order]
    start = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])) if len(v) else np.empty(0, np.int64)
    return v[start], w[start], np.add.reduceat(n[order], start) if len(start) else n


def tally(count: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((count == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken off counts of 0, 1, 2, and 3 or more."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    at = lambda k, a, b: min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a and b else k / 2
    return np.array([0.0, at(1, n1, n2), at(2, n2, n3), at(3, n3, n4)])


def _pairs(bits: int):
    """Packed rows (bucket, contexts, lengths of their runs, words, counts) of a task's pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            v, w, n = unique_pairs(*(np.concatenate(x) for x in zip(*held)))
            cut = list(slices(v, bits))
            columns = [[], [], [], []]
            for _, s in cut:
                contexts, lengths = np.unique(v[s], return_counts=True)
                for c, x in zip(columns, (pack_sorted(contexts), pack(lengths.astype(np.uint32)), pack(w[s]), pack(n[s].astype(np.int64)))):
                    c.append(x)
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in cut], pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "contexts", "lengths", "words", "counts"])

        for batch in batches:
            texts = [sharded.prepared(t) for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if x]
            for i, j in fold(texts, len):
                v, w, _ = sequences(texts[i:j])
                held.append(unique_pairs(v, w, np.ones(len(v), np.int64)))
                size += len(held[-1][0])
                if size > HELD:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


PAIRS = "bucket long, contexts binary, lengths binary, words binary, counts binary"


def _read_pairs(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.repeat(unpack_sorted(row["contexts"]), unpack(row["lengths"], np.uint32)), unpack(row["words"], np.uint64), unpack(row["counts"], np.int64)


def _shard(key: tuple, part: pa.Table) -> pa.Table:
    """A shard's pairs, from all tasks."""
    v, w, n = unique_pairs(*(np.concatenate(x) for x in zip(*map(_read_pairs, part.to_pylist()))))
    contexts, lengths = np.unique(v, return_counts=True)
    one = {"contexts": pack_sorted(contexts), "lengths": pack(lengths.astype(np.uint32)), "words": pack(w), "counts": pack(n)}
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), **{c: pa.array([x], pa.binary()) for c, x in one.items()}, "total": pa.array([int(n.sum())], pa.int64()), "tally": pa.array([tally(n)], pa.list_(pa.int64()))})


def _followers(bits: int):
    """Rows (bucket of the words, asker, words, the asker's number of contexts of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, n = np.unique(unpack(row["words"], np.uint64), return_counts=True)
                cut = list(slices(words, bits))
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in cut], pa.int64()), pa.array([row["bucket"]] * len(cut), pa.int64()), pa.array([pack_sorted(words[s]) for _, s in cut], pa.binary()), pa.array([pack(n[s].astype(np.int64)) for _, s in cut], pa.binary())], names=["bucket", "asker", "words", "n"])

    return run


def _continuations(key: tuple, part: pa.Table) -> pa.Table:
    """The shard's words with the numbers of their contexts, for itself (about: null) and for each asker (about: this
    shard, in the order of the asker's words)."""
    asked, n = [unpack_sorted(x) for x in part["words"].to_pylist()], [unpack(x, np.int64) for x in part["n"].to_pylist()]
    words, total = sharded.added(asked, n)
    bucket = key[0].as_py()
    out = {"bucket": [bucket, *part["asker"].to_pylist()], "about": [None, *[bucket] * len(asked)], "words": [pack_sorted(words), *[None] * len(asked)]}
    out["n"] = [pack(total), *(pack(total[np.searchsorted(words, x)]) for x in asked)]
    out |= {"total": [int(total.sum()), *[0] * len(asked)], "distinct": [len(words), *[0] * len(asked)], "tally": [tally(total), *[None] * len(asked)]}
    return pa.Table.from_pydict(out, schema=_CONTINUED)


_CONTINUED = pa.schema([("bucket", pa.int64()), ("about", pa.int64()), ("words", pa.binary()), ("n", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64()), ("tally", pa.list_(pa.int64()))])


class Model:
    """A fitted model: table (bucket, ids, values; common ids and values), the log of an unknown word's probability,
    common entries, and the bitmap of the table's ids."""

    def __init__(self, table: DataFrame, unknown: float, bits: int):
        self.table, self.unknown, self.bits = table, unknown, bits
        found = table.select("common").filter("common is not null").collect()  # 2 * HOT entries at most
        ids, values = ([unpack(r.common[k], kind) for r in found] for k, kind in ((0, np.uint64), (1, np.float32)))
        ids, values = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((ids, np.uint64), (values, np.float32)))
        order = np.argsort(ids)
        self.hot = ids[order], values[order]
        self.known = sharded.id_map(table, bits)


def fit(rows: DataFrame, bits: int) -> Model:
    """The model of the texts of rows (t, learn) where learn holds."""
    pairs = rows.select("t", "learn").mapInArrow(_pairs(bits), PAIRS).groupBy("bucket").applyInArrow(_shard, PAIRS + ", total long, tally array<long>")
    pairs = saved(pairs, "pairs")
    released(rows.sparkSession)
    followers = pairs.select("bucket", "words").mapInArrow(_followers(bits), "bucket long, asker long, words binary, n binary")
    continued = followers.groupBy("bucket").applyInArrow(_continuations, "bucket long, about long, words binary, n binary, total long, distinct long, tally array<long>")
    continued = saved(continued, "continuations")
    tallies = lambda t: [F.sum(F.col("tally")[k]) for k in range(4)]
    total, *n2 = (x or 0 for x in pairs.agg(F.sum("total"), *tallies(pairs)).first())
    contexts, words, *n1 = (x or 0 for x in continued.agg(F.sum("total"), F.sum("distinct"), *tallies(continued)).first())
    off2, off1 = discounts(*n2), discounts(*n1)
    taken = n1[0] * off1[1] + n1[1] * off1[2] + (words - n1[0] - n1[1]) * off1[3]
    unknown = (taken / contexts if contexts else 1.0) / (words + 1)
    common = max(1, total // sharded.HOT)

    def values(key: tuple, part: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.to_pylist()
        ids, logs, often = [], [], []
        chance = lambda n: (n - off1[np.minimum(n, 3)]) / contexts + unknown
        for row in answers:
            if row["about"] is None:
                ids.append(unpack_sorted(row["words"]))
                logs.append(np.log10(chance(unpack(row["n"], np.int64))) - np.log10(unknown))
        for row in part.to_pylist():
            v, w, n = _read_pairs(row)
            distinct, place = np.unique(w, return_inverse=True)
            follow = np.concatenate([unpack(r["n"], np.int64) for r in sorted((r for r in answers if r["about"] is not None), key=lambda r: r["about"])])
            lower = chance(follow)[place]
            off = off2[np.minimum(n, 3)]
            start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            size = np.diff(np.append(start, len(v)))
            all_, free = np.add.reduceat(n, start), np.add.reduceat(off, start)
            weight = np.repeat(free / all_, size) * lower
            pair = pair_ids(v, w, int(bits))
            ids += [v[start], pair]
            logs += [np.log10(free / all_), np.log10((n - off) / np.repeat(all_, size) + weight) - np.log10(weight)]
            often += [v[start][all_ >= common], pair[n >= common]]
        ids, logs = sharded.added(ids, logs)
        often = np.unique(np.concatenate(often)) if often else np.empty(0, np.uint64)
        listed = [pack(often), pack(logs[np.searchsorted(ids, often)].astype(np.float32))] if len(often) else None
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([pack_sorted(ids)], pa.binary()), "values": pa.array([pack(logs.astype(np.float32))], pa.binary()), "common": pa.array([listed], pa.list_(pa.binary()))})

    answers = continued.select("bucket", "about", "words", "n")
    table = pairs.select(*(c.split()[0] for c in PAIRS.split(", "))).groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(values, "bucket long, ids binary, values binary, common array<binary>")
    table = saved(table, "kneser-ney")
    discarded(pairs, continued)
    del pairs, followers, continued, answers
    released(rows.sparkSession)
    return Model(table, float(np.log10(unknown)), bits)


def ids_of(bits: int):
    def ids(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of the words, the begin included, and of the pairs."""
        v, w, text = sequences(texts)
        yield np.concatenate([w, np.full(len(texts), BEGIN), pair_ids(v, w, bits)]), np.concatenate([text, np.arange(len(texts)), text])

    return ids


def scored(rows: DataFrame, head, model: Model) -> DataFrame:
    """Rows (head, logp: log10, n_words: the end included) of rows with a text column t."""
    out = sharded.sums(rows, head, F.col("t"), ids_of(model.bits), 1, model.table.withColumn("type", F.lit("<f4")), model.bits, model.hot, model.known)
    n = ((F.col("size")[0]) / 2).cast("long")  # a word and a pair for each word, the end included; and the begin
    return out.select("head", (F.col("total")[0] + n * F.lit(model.unknown)).alias("logp"), n.alias("n_words"))


def classify(df: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (key long, lang, trusted, n_words, perplexity, threshold, kept). trusted: a table whose first column holds
    the keys of trusted rows."""
    ids = saved(trusted.select(F.col(trusted.columns[0]).cast("long").alias("id")).filter("id is not null").distinct().withColumn("good", F.lit(True)), "trusted")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids
    draw = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) / float(1 << 30) if TRAINED else F.lit(0.0)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"), draw.alias("draw")).join(ids, F.col("key") == F.col("id"), "left")
    held = F.pmod(F.xxhash64("key"), F.lit(FOLDS)) == 0
    rows = rows.select("key", "lang", F.coalesce("good", F.lit(False)).alias("trusted"), "t", "draw")
    bits = sharded.shard_bits(df)
    learn = F.coalesce(F.col("trusted") & ~held, F.lit(False))
    if TRAINED:
        size = rows.filter(learn).agg(F.sum(F.length("t"))).first()[0] or 0
        learn &= F.col("draw") < F.lit(TRAINED / max(size, 1))
    model = fit(rows.select("t", learn.alias("learn")), bits)
    found = scored(rows, F.struct("key", "lang", "trusted"), model)
    found = saved(found.select("head.*", "n_words", F.pow(F.lit(10.0), -F.col("logp") / F.col("n_words")).alias("perplexity")), "perplexity")
    sure = found.filter(F.col("trusted") & held)
    quantile = F.percentile_approx("perplexity", QUANTILE, 10_000)
    by_lang = sure.groupBy(F.col("lang").alias("l")).agg(quantile.alias("q"), F.count("*").alias("n")).filter(F.col("n") >= LEAST)
    overall = sure.agg(quantile).first()[0]
    out = found.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    threshold = F.coalesce("q", F.lit(overall).cast("double")) * MARGIN
    return out.select(F.col("key").alias(key), "lang", "trusted", "n_words", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(True)).alias("kept"))
