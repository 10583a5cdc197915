"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent.

A text's letters are lower-cased, all else becomes a space; each run of 1 to 4 characters is hashed to a bucket. The
mean of the buckets' embeddings goes through a linear layer. Training is numpy on the driver, over a sample of labelled
texts, whole ones: at most EACH a language and SAMPLE in all, the languages taking turns, and at most SAMPLE_CHARS
characters, counted before any text reaches the driver. Prediction covers every whole text. As the layer is linear,
prediction sums each bucket's logits (a table of fixed size, broadcast) instead of embeddings, a piece at a time.

A third of the sample is kept from training: on it a temperature calibrates the probabilities, and sets the rejection
threshold: what all wrong predictions there stay below (MOST, if none is wrong), but no more than the REJECT quantile
of right ones.

Defined cases: a text that is null or has no letter (other numerals, marks and signs aren't letters) is `und` with
score 0 and rejected; a labelled text longer than SAMPLE_CHARS can't be learned from; if no labelled row can be learned
from, all are `und`; a tie goes to the language that sorts first; repeated rows are predicted alike; clashing names of
other columns don't matter, rows are packed first.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import fold, remembers

#: Rows that are learned from, at most: in all, and of one language.
SAMPLE, EACH, SPARE = 4000, 1000, 4
BUCKETS = 1 << 16
DIMENSION = 16
EPOCHS, BATCH, RATE = 5, 32, 0.1
REJECT, MOST = 0.001, 0.5
NONE = "und"
#: At most so many sampled characters reach the driver; a row beyond is passed over whole.
SAMPLE_CHARS = 30_000_000
#: Characters of a text that are hashed at once.
PIECE = 500_000


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def spaced(text: str) -> np.ndarray:
    """A text's code points, lower-cased, each run of others than letters one space; one space before and, if there is
    a letter, three at least after."""
    code = np.frombuffer(f" {text.lower()}   ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, np.uint32(32))
    kept = letter | np.concatenate([[True], letter[:-1]])
    return np.concatenate([code[kept], np.full(2 if letter.any() else 3, 32, np.uint32)])


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of the joined texts, one column per order, and each text's first place. A text's n-grams
    don't reach into the next text: three spaces lie between."""
    clean = [spaced(t) for t in texts]
    return buckets(np.concatenate([*clean, np.full(3, 32, np.uint32)])), np.cumsum([0, *map(len, clean)])


def buckets(padded: np.ndarray) -> np.ndarray:
    """Buckets of the n-grams of each order that begin at each code point but the last three."""
    n = len(padded) - 3
    columns, key = np.empty((n, 4), np.uint16), np.zeros(n, np.uint32)
    with np.errstate(over="ignore"):
        for order in range(4):
            key = key * np.uint32(0x01000193) + padded[order : order + n] * np.uint32(0x9E3779B1) + np.uint32(order + 1)
            mixed = key ^ (key >> np.uint32(15))
            mixed *= np.uint32(0x85EBCA6B)
            columns[:, order] = mixed >> np.uint32(16)
    return columns


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        """Logits of each text; a text without a letter gets nan."""
        clean = [spaced(t) for t in texts]
        starts = np.cumsum([0, *map(len, clean)])
        padded = np.concatenate([*clean, np.full(3, 32, np.uint32)])
        sums = np.zeros((len(texts), len(self.languages)))
        for a in range(0, int(starts[-1]), PIECE):
            columns = buckets(padded[a : a + PIECE + 3])
            total = np.zeros((len(columns), len(self.languages)), np.float32)
            for order in range(columns.shape[1]):
                total += self.logits[columns[:, order]]
            first = int(np.searchsorted(starts, a, "right")) - 1
            cut = np.unique(np.concatenate([[0], starts[(starts > a) & (starts < a + len(columns))] - a]))
            sums[first : first + len(cut)] += np.add.reduceat(total, cut, axis=0, dtype=np.float64)
        sums = sums / (4 * np.diff(starts))[:, None] + self.bias
        sums[np.diff(starts) <= 4] = np.nan
        return sums

    def probabilities(self, texts: list[str]) -> np.ndarray:
        z = self.scores(texts) / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model | None:
    """SGD over embeddings and layer; every third text calibrates."""
    usable = [(t, x) for t, x in zip(texts, labels) if any(map(str.isalpha, t))]
    languages = sorted({x for _, x in usable})
    if not languages:
        return None
    index = {x: i for i, x in enumerate(languages)}
    bags = []
    for t, x in usable:
        columns, _ = features([t])
        b, c = np.unique(columns, return_counts=True)
        bags.append((b.astype(np.int64), (c / c.sum()).astype(np.float32), index[x]))
    learn = [b for i, b in enumerate(bags) if i % 3 or len(bags) < 6]
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (DIMENSION, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    # Steps are divided by the root of the sum of a value's squared slopes, which keeps them bounded at any sample size.
    table_sums, layer_sums, bias_sums = np.full_like(table, 1e-6), np.full_like(layer, 1e-6), np.full_like(bias, 1e-6)
    counts = np.bincount([y for *_, y in learn], minlength=len(languages))
    weight = np.where(counts > 0, len(learn) / (len(languages) * np.maximum(counts, 1)), 0).astype(np.float32)
    steps = EPOCHS * max(1, -(-len(learn) // BATCH))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(learn))
        for i in range(0, len(order), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            some = [learn[j] for j in order[i : i + BATCH]]
            mean = np.stack([w @ table[b] for b, w, _ in some])
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = np.array([c for *_, c in some])
            p[np.arange(len(y)), y] -= 1
            p *= weight[y][:, None]
            back = p @ layer.T
            for value, sums, slope in ((layer, layer_sums, mean.T @ p / len(some)), (bias, bias_sums, p.sum(0) / len(some))):
                sums += slope**2
                value -= rate * slope / np.sqrt(sums)
            for (b, w, _), g in zip(some, back):
                slope = w[:, None] * g
                table_sums[b] += slope**2
                table[b] -= rate * slope / np.sqrt(table_sums[b])
    model = Model(languages, table @ layer, bias.astype(np.float64))
    held = [i for i in range(len(usable)) if i % 3 == 0] or list(range(len(usable)))
    z = np.concatenate([model.scores([usable[i][0] for i in held[a:b]]) for a, b in fold(held, lambda i: len(usable[i][0]))])
    y = np.array([index[usable[i][1]] for i in held])
    model.temperature = min(np.geomspace(0.02, 20, 60), key=lambda t: _loss(z / t, y))
    p = np.exp(z / model.temperature - (z / model.temperature).max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right, sure = p.argmax(1) == y, p.max(1)
    most = float(np.quantile(sure[right], REJECT)) if right.any() else 0.0
    wrong = sure[~right & (sure < most)]
    model.threshold = min(most, float(np.nextafter(wrong.max(), 2)) if len(wrong) else MOST)
    return model


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    z = z - z.max(1, keepdims=True)
    return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]))


def fit(df: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Trains on a sample of the rows that fulfil the condition and have a text and a language, rows that repeat a key,
    text and language taken once: of each language the EACH rows of the least hashes, of these the first, second and so
    on of all languages until there are SAMPLE. Before rows are ranked, hashes that are surely too large are left out:
    about SPARE times EACH of a language stay."""
    digest = F.struct(F.xxhash64(F.col(key).cast("string"), F.lit("langid")).alias("a"), F.xxhash64(F.col(text)).alias("b"))
    rows = df.filter(learnable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(digest.alias("h"), F.col(lang).cast("string").alias("l"), F.length(text).alias("n"), F.col(text).alias("t"))
    sizes = rows.groupBy(F.col("l").alias("s")).agg(F.approx_count_distinct("h").alias("size"))
    share = F.least(F.lit(1.0), SPARE * EACH / F.col("size"))
    near = rows.select("h", "l", "n").join(sizes, F.col("l") == F.col("s")).filter((share >= 1) | (F.col("h.a") <= ((2 * share - 1) * float(1 << 63)).cast("long")))
    turns = near.select("h", "l", "n").distinct().withColumn("turn", F.row_number().over(W.partitionBy("l").orderBy("h"))).filter(F.col("turn") <= EACH)
    chosen, total = [], 0
    for r in turns.orderBy("turn", "h", "l").limit(SAMPLE).collect():
        if total + r.n <= SAMPLE_CHARS:
            total += r.n
            chosen.append((r.h.a, r.h.b, r.l))
    if not chosen:
        return None
    wanted = F.broadcast(df.sparkSession.createDataFrame(chosen, "a long, b long, wanted string"))
    found = rows.join(wanted, (F.col("h.a") == F.col("a")) & (F.col("h.b") == F.col("b")) & (F.col("l") == F.col("wanted")))
    found = found.groupBy("h", "l").agg(F.first("t").alias("t"))
    sample = sorted((r.h.a, r.h.b, r.t, r.l) for r in found.collect())
    return train([x[2] for x in sample], [x[3] for x in sample])


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Rows (row: the input's columns, lang_pred, score, rejected)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembers("langid", lambda: None)
        m = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in fold(texts, len, 500_000):
                lang, score = [NONE] * (j - i), [0.0] * (j - i)
                if m:
                    p = m.probabilities(texts[i:j])
                    for r in np.flatnonzero(~np.isnan(p[:, 0])):
                        lang[r], score[r] = m.languages[int(p[r].argmax())], float(p[r].max())
                rejected = [x == NONE or s < m.threshold for x, s in zip(lang, score)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lang), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["row", "lang_pred", "score", "rejected"])

    packed = df.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
