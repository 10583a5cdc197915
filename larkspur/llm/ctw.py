"""LM scoring by context-tree weighting.

Each byte is eight binary decisions, each under the context of the bytes before it: none, one, two, three, four, and
after white space eight of them (DEEP), as the begin of a word is what the words before tell most about. The decisions
that were made under a context are counted over all training texts; a Krichevsky-Trofimov estimate of the counts is a
node's own probability, and a node mixes it, half and half at first, with the product of the next longer contexts. What
mixing has learned from training is each node's weight, so a text's code length is the sum over its bytes of mixtures
across all depths. Counts don't depend on an order of texts, so the tree is built by levels from sums.

Grams (a context and its next byte) are 64-bit ids: the last four bytes, mixed, then 24 bits of a hash of the four
before (0 where there are none), then the byte. The mixed bytes tell the shard, so each four-byte context has its longer
ones at hand, and a frequent one is as good as any; groups of the shorter contexts hold distinct grams only. A shard
first sends what its four-byte contexts give to the shorter ones; their weights come back by gram; then it has the
probability of each of its grams. Beside it runs the base model: words with add-one estimates from sharded counts. A
document's two scores are sums over its grams and words, answered by the shards (see sharded.sums); only the commonest
entries, a bounded number, go to every task.

Defined cases: a null text is the empty text, scored as its end alone; a zero byte in a text is a byte like the mark of
its end; without training texts every bit costs one; repeated rows are scored each; a null key stays null; a long text
is read in pieces; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import sharded
from larkspur.llm.common import saved
from larkspur.llm.sharded import END, pack, pack_sorted, unpack, unpack_sorted

#: Bytes of the longest contexts, and of those that every place has.
DEEP, PLAIN = 8, 4
#: Bytes of text whose grams are made at once.
PIECE = 250_000
#: The training bytes divided by this is the least count of a common gram.
HOT_GRAMS = 1 << 19
#: The training words divided by this is the least count of a common word.
HOT_WORDS = 1 << 17
HALF = np.log(0.5)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers, in 64 bits."""
    x = x * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)
    x ^= x >> np.uint64(16)
    return x * np.uint64(0x85EBCA6B) & np.uint64(0xFFFFFFFF)


def unmix32(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(pow(0x85EBCA6B, -1, 1 << 32)) & np.uint64(0xFFFFFFFF)
    x ^= x >> np.uint64(16)
    return x * np.uint64(pow(0x9E3779B1, -1, 1 << 32)) & np.uint64(0xFFFFFFFF)


def gram_ids(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of the grams of all bytes of the texts and of their ends, with the texts' numbers, in pieces."""
    pieces, size = [], 0
    for k, t in enumerate(texts):
        whole = bytes(DEEP) + t + b"\0"
        for a in range(0, len(whole) - DEEP, PIECE):
            pieces.append((k, whole[a : a + PIECE + DEEP]))
            size += len(pieces[-1][1])
            if size >= PIECE:
                yield _piece(pieces)
                pieces, size = [], 0
    if pieces:
        yield _piece(pieces)


def _piece(pieces: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(x for _, x in pieces), np.uint8)
    lengths = np.array([len(x) for _, x in pieces])
    own = np.ones(len(data), bool)
    starts = np.cumsum(lengths) - lengths
    for j in range(DEEP):
        own[starts + j] = False
    at = np.flatnonzero(own)
    context = np.zeros(len(data) - PLAIN, np.uint64)
    for j in range(PLAIN):  # the nearest byte is the lowest
        context = context << np.uint64(8) | data[j : j + len(context)].astype(np.uint64)
    ids = mix32(context[at - PLAIN]) << np.uint64(32) | data[at].astype(np.uint64)
    deep = np.flatnonzero(_SPACE[data[at - 1]])
    before = context[at[deep] - DEEP] + np.uint64(1)
    before = before * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    ids[deep] |= before << np.uint64(8)
    return ids, np.repeat([k for k, _ in pieces], lengths - DEEP)


# Decisions. Entries (group, byte, n) are sorted by group and byte; at bit b the runs of equal groups and upper bits of
# the byte are the nodes.


def starts_of(group: np.ndarray, byte: np.ndarray) -> list[np.ndarray]:
    """The nodes' first entries for each bit."""
    new = np.concatenate([[True], group[1:] != group[:-1]])
    out = []
    for b in range(8):
        upper = byte >> np.uint64(8 - b)
        out.append(np.flatnonzero(new | np.concatenate([[True], upper[1:] != upper[:-1]])))
    return out


def decisions(start: np.ndarray, byte: np.ndarray, n: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) of the nodes of bit b."""
    bit = (byte >> np.uint64(7 - b) & np.uint64(1)).astype(np.int64)
    ones = np.add.reduceat(n * bit, start)
    return np.add.reduceat(n, start) - ones, ones


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence; x > 0."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


_SMALL = 4096
_AT_HALF, _AT_ONE = (log_gamma(np.arange(_SMALL) + x) for x in (0.5, 1.0))


def _log_gamma_of(n: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    out = table[np.minimum(n, _SMALL - 1).astype(np.int64)]
    large = n >= _SMALL
    if large.any():
        out[large] = log_gamma(n[large] + plus)
    return out


def own_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of decisions."""
    return _log_gamma_of(zeros, _AT_HALF, 0.5) + _log_gamma_of(ones, _AT_HALF, 0.5) - _log_gamma_of(zeros + ones, _AT_ONE, 1.0) - np.log(np.pi)


def mixed_log(own: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log of a node's mixture of its own probability and that of the longer contexts; the weight of its own."""
    total = np.logaddexp(HALF + own, HALF + longer)
    return total, np.exp(HALF + own - total)


# Contexts of up to four bytes, in groups by the last two; 255 nodes each, in the order of their prefixes.


def nodes(counts: np.ndarray) -> np.ndarray:
    """Decisions (0, 1) at the 255 nodes of the bits of a byte; counts: n x 256."""
    n = len(counts)
    return np.concatenate([counts.reshape(n, 1 << b, 2, -1).sum(-1) for b in range(8)], axis=1).astype(np.float64)


def node_log(d: np.ndarray) -> np.ndarray:
    return own_log(d[..., 0], d[..., 1])


_BITS = np.arange(256)[:, None] >> np.arange(7, -1, -1) & 1
_PATH = np.array([[(1 << b) - 1 + (x >> (8 - b)) for b in range(8)] for x in range(256)])


def tree(grams: np.ndarray, n: np.ndarray, deep: np.ndarray) -> tuple[list, list, list, np.ndarray, np.ndarray]:
    """The tree of a group of grams (four bytes, then the next): for four, three and two bytes the places of the next
    longer contexts' suffixes, decisions and weights; the top's log and byte counts. deep: for each gram and bit the
    log of the product of the contexts beyond four bytes."""
    places, choices, weights, total, counts = [], [], [], None, None
    below, place = grams >> 8, None
    for depth in (4, 3, 2):
        contexts, place = np.unique(below & ((1 << 8 * depth) - 1), return_inverse=True)
        new = np.zeros((len(contexts), 256))
        longer = np.zeros((len(contexts), 255))
        if depth == 4:
            np.add.at(new, (place, grams & 255), n)
            longer[place[:, None], _PATH[grams & 255]] = deep
        else:
            np.add.at(new, place, counts)
            np.add.at(longer, place, total)
        d = nodes(new)
        total, weight = mixed_log(node_log(d), longer)
        counts, below = new, contexts
        places.append(place)
        choices.append(d)
        weights.append(weight)
    return places, choices, weights, total, counts


def _group(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams, n = part["gram"].to_numpy(), part["n"].to_numpy()
    deep = part["deep"].combine_chunks().flatten().to_numpy().reshape(-1, 8)
    order = np.argsort(grams)
    return grams[order], n[order], deep[order]


def _tops(key: tuple, part: pa.Table) -> pa.Table:
    grams, n, deep = _group(part)
    *_, total, counts = tree(grams, n, deep)
    return pa.table({"last": pa.array([int(grams[0] >> 8 & 255)], pa.int64()), "log": [total[0].tobytes()], "counts": [counts[0].tobytes()]})


def _second(key: tuple, part: pa.Table) -> pa.Table:
    """The context of one byte from those of two."""
    counts = sum(np.frombuffer(x, np.float64) for x in part["counts"].to_pylist())
    longer = sum(np.frombuffer(x, np.float64) for x in part["log"].to_pylist())
    total, weight = mixed_log(node_log(nodes(counts[None]))[0], longer)
    return pa.table({"last": pa.array([key[0].as_py()], pa.int64()), "log": [total.tobytes()], "weight": [weight.tobytes()], "counts": [counts.tobytes()]})


# Shards.


def _read(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return unpack_sorted(part["ids"][0].as_py()), unpack(part["counts"][0].as_py(), np.int64)


def _shorter(key: tuple, part: pa.Table) -> pa.Table:
    """A shard's grams of four bytes: (gram, n, deep)."""
    ids, n = _read(part)
    byte = ids & np.uint64(255)
    short = ids >> np.uint64(32) << np.uint64(8) | byte
    entries, place = np.unique(short, return_inverse=True)
    counts = np.zeros(len(entries), np.int64)
    np.add.at(counts, place, n)
    deep = np.empty((len(entries), 8))
    long_starts = starts_of(ids >> np.uint64(8), byte)
    short_starts = starts_of(entries >> np.uint64(8), entries & np.uint64(255))
    for b in range(8):
        node = np.zeros(len(entries), np.int64)
        node[short_starts[b][1:]] = 1
        node = np.cumsum(node)
        logs = own_log(*decisions(long_starts[b], byte, n, b))
        deep[:, b] = np.bincount(node[place[long_starts[b]]], logs, int(node[-1]) + 1)[node]
    grams = (unmix32(entries >> np.uint64(8)) << np.uint64(8) | entries & np.uint64(255)).astype(np.int64)
    return pa.table({"gram": grams, "n": counts, "deep": pa.ListArray.from_arrays(pa.array(np.arange(0, deep.size + 1, 8, dtype=np.int32)), pa.array(deep.ravel()))})


def fit(counts: DataFrame, bits: int) -> DataFrame:
    """Rows (bucket, ids, values: log10 of a gram's last byte's probability, common: ids and values) from the counts'
    shards."""
    short = saved(counts.select("bucket", "ids", "counts").groupBy("bucket").applyInArrow(_shorter, "gram long, n long, deep array<double>"), "grams")
    group = F.shiftright("gram", 8).bitwiseAND(0xFFFF)
    tops = short.groupBy(group.alias("suffix")).applyInArrow(_tops, "last long, log binary, counts binary")
    rows = tops.groupBy("last").applyInArrow(_second, "last long, log binary, weight binary, counts binary").collect()  # 256 at most
    upper = {r["last"]: (nodes(np.frombuffer(r["counts"])[None])[0], np.frombuffer(r["weight"])) for r in rows}
    root_counts = sum((np.frombuffer(r["counts"]) for r in rows), np.zeros(256))
    root = nodes(root_counts[None])[0]
    _, root_weight = mixed_log(node_log(root[None])[0], sum((np.frombuffer(r["log"]) for r in rows), np.zeros(255)))
    common = max(1, int(root_counts.sum()) // HOT_GRAMS)

    def likely(d: np.ndarray, at: np.ndarray, byte: np.ndarray) -> np.ndarray:
        d = d[at[:, None], _PATH[byte]]
        chosen = np.take_along_axis(d, _BITS[byte][..., None], -1)[..., 0]
        return (chosen + 0.5) / (d.sum(-1) + 1)

    def shares(key: tuple, part: pa.Table) -> pa.Table:
        """For each gram and bit what the contexts of up to four bytes say, and what is left to longer ones."""
        grams, n, deep = _group(part)
        places, choices, weights, *_ = tree(grams, n, deep)
        byte, zero = grams & 255, np.zeros(len(grams), np.int64)
        one, weight = upper[int(grams[0] >> 8 & 255)]
        said, left = np.zeros((len(grams), 8)), np.ones((len(grams), 8))
        levels = [(root[None], root_weight[None], zero), (one[None], weight[None], zero)]
        place, own = np.arange(len(grams)), []
        for up, d, w in zip(places, choices, weights):
            place = up[place]
            own.append((d, w, place))
        for d, w, at in [*levels, *reversed(own)]:
            mix = w[at[:, None], _PATH[byte]]
            said += left * mix * likely(d, at, byte)
            left *= 1 - mix
        bucket = (mix32((grams >> 8).astype(np.uint64)) >> np.uint64(32 - bits)).astype(np.int64) if bits else zero
        lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, 8, dtype=np.int32)), pa.array(a.ravel().astype(np.float32)))
        return pa.table({"bucket": bucket, "gram": grams, "said": lists(said), "left": lists(left)})

    known = short.groupBy(group.alias("suffix")).applyInArrow(shares, "bucket long, gram long, said array<float>, left array<float>")

    def values(key: tuple, part: pa.Table, shorter: pa.Table) -> pa.Table:
        ids, n = _read(part)
        byte = ids & np.uint64(255)
        grams = (unmix32(ids >> np.uint64(32)) << np.uint64(8) | byte).astype(np.int64)
        have = shorter["gram"].to_numpy()
        order = np.argsort(have)
        place = order[np.searchsorted(have[order], grams)]
        said, left = (shorter[c].combine_chunks().flatten().to_numpy().reshape(-1, 8) for c in ("said", "left"))
        logs = np.zeros(len(ids))
        for b, start in enumerate(starts_of(ids >> np.uint64(8), byte)):
            zeros, ones = decisions(start, byte, n, b)
            size = np.diff(np.append(start, len(ids)))
            chosen = np.where(byte >> np.uint64(7 - b) & np.uint64(1) > 0, np.repeat(ones, size), np.repeat(zeros, size))
            logs += np.log10(said[place, b] + left[place, b] * (chosen + 0.5) / np.repeat(zeros + ones + 1, size))
        often = n >= common
        listed = [pack(ids[often]), pack(logs[often].astype(np.float32))] if often.any() else None
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([pack_sorted(ids)], pa.binary()), "values": pa.array([pack(logs.astype(np.float32))], pa.binary()), "common": pa.array([listed], pa.list_(pa.binary()))})

    out = counts.select("bucket", "ids", "counts").groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(values, "bucket long, ids binary, values binary, common array<binary>")
    return saved(out, "ctw")


# The base model.


def word_ids(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of the words and of the ends."""
    words = [sharded.word_ids(t) for t in texts]
    if words:
        yield np.concatenate([*words, np.full(len(words), END)]), np.concatenate([np.repeat(np.arange(len(words)), [len(w) for w in words]), np.arange(len(words))])


def _estimates(common: int):
    """Rows (bucket, ids, values, common) of the words' counts c: log10(c + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, ids, counts in zip(*(batch.column(c).to_pylist() for c in range(3))):
                n = unpack(counts, np.int64)
                logs = np.log10(n + 1.0)
                listed = [pack(unpack_sorted(ids)[n >= common]), pack(logs[n >= common])] if (n >= common).any() else None
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([ids], pa.binary()), pa.array([pack(logs)], pa.binary()), pa.array([listed], pa.list_(pa.binary()))], names=["bucket", "ids", "values", "common"])

    return run


def both_ids(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for kind, ids_of in enumerate((word_ids, gram_ids)):
        for ids, owner in ids_of(texts):
            yield ids, 2 * owner + kind


def commonest(table: DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The common entries that a table lists."""
    found = table.select("common").filter("common is not null").collect()
    ids, values = ([unpack(r.common[k], t) for r in found] for k, t in ((0, np.uint64), (1, kind)))
    return np.concatenate([np.empty(0, np.uint64), *ids]), np.concatenate([np.empty(0), *values])


def score(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", flag: str = "learned") -> DataFrame:
    """Rows (key long, flag, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).

    score is the log10 probability that the context tree gives to a text's bytes and its end.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("t"), learn.alias("learn"))
    bits = sharded.shard_bits(df)
    trees = fit(sharded.count(rows, gram_ids, bits, every=True), bits)
    counts = sharded.count(rows, word_ids, bits)
    total, distinct = (x or 0 for x in counts.agg(F.sum("total"), F.sum("distinct")).first())
    words = saved(counts.select("bucket", "ids", "counts").mapInArrow(_estimates(max(1, total // HOT_WORDS)), "bucket long, ids binary, values binary, common array<binary>"), "estimates")
    (ids, values), (gram_hot, gram_values) = commonest(words, "<f8"), commonest(trees, "<f4")
    ids, values = np.concatenate([ids, gram_hot]), np.concatenate([values, gram_values])
    order = np.argsort(ids)
    table = words.withColumn("type", F.lit("<f8")).unionByName(trees.withColumn("type", F.lit("<f4")))
    out = sharded.sums(rows, F.struct("key", "learn"), F.col("t"), both_ids, 2, table, bits, (ids[order], values[order]))
    base = F.col("total")[0] - F.col("size")[0] * F.lit(float(np.log10(total + distinct + 1)))
    return out.select(
        F.col("head.key").alias(key), F.col("head.learn").alias(flag), F.col("size")[0].alias("n_tokens"), F.col("found")[0].alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"), F.col("total")[1].alias("score"), (-F.col("total")[1] / F.lit(float(np.log10(2))) / F.col("size")[1]).alias("bits_per_byte"),
    )
