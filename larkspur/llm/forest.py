"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

Each text's word 5-grams are a set; its signature is TREES labels of DEEPEST MinHash values. A tree is a prefix trie of
its labels: they are sorted over range partitions, so a node of the trie is a run of rows that share a prefix, and its
size is the run's length. A run that touches the edge of a partition is completed by one row of each such partition.

In a tree, texts under one node are candidates. All texts' prefixes are shortened until pairs at the threshold meet in
some tree with the target recall. Then, level by level, the prefixes of those texts are shortened further that have so
many neighbours that more than LOSS missed links would be expected of them. Candidates that the signatures' agreement
doesn't rule out (SIGMA standard deviations; None: all) are then compared by their whole sets.

Texts with equal sets are one class from the start: only one of them goes on, with the number of copies. Where many
different texts, or much text, meet under a node, they are cut into blocks, and each pair of blocks is a group of
bounded size. A pair is counted at the first level and in the first tree where it meets, in one group, and leaves it
only as sums and a spanning forest; no pairs are returned. Each stage is dealt by group, and read as a sorted stream.

Defined cases: a null or wordless text has no links and a class of its own; a text of under 5 words is one gram; a row
with a null key takes part, and a class without any key has a null id; repeated rows are copies; rows of one key with
different texts are different texts; an empty table gives no rows; other columns aren't read. A worker holds one text
at a time beyond STEP_CHARS characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkspur.llm.common import fold, remembers, saved, small_batches
from larkspur.llm.components import components
from larkspur.llm.shingles import forget, shingle_set

#: The recall of pairs at the threshold, and the missed links that may be expected of one text.
THRESHOLD, RECALL = 0.8, 0.9999
LOSS = 1e-3
TREES, DEEPEST = 16, 8
#: Texts, and bytes of their sets, that a block holds on the average at most.
BLOCK, BLOCK_BYTES = 1024, 16_000_000
SIGMA = 6
#: Pairs of texts that a worker compares at a time.
STRIP = 4_000_000
#: Broadcast the texts that are compared only if there are no more.
BROADCAST_KEYS = 500_000

_RNG = np.random.default_rng(20240101)
_A = _RNG.integers(1, 1 << 63, TREES * DEEPEST, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TREES * DEEPEST, np.uint64)


def expected_recall(depth: int, threshold: float = THRESHOLD, trees: int = TREES) -> float:
    return 1 - (1 - threshold**depth) ** trees


def shortened(threshold: float = THRESHOLD, target: float = RECALL) -> int:
    """The longest prefix that reaches the target recall."""
    depth = DEEPEST
    while depth > 1 and expected_recall(depth, threshold) < target:
        depth -= 1
    return depth


def signature(grams: np.ndarray) -> np.ndarray:
    """TREES x DEEPEST MinHash values as 16 bits; big-endian, so that bytes sort as values do. A least value is small, the
    more so the longer the text, so its upper bits agree by chance; it is mixed before they are taken."""
    out = np.full(TREES * DEEPEST, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(grams), 4096):
            out = np.minimum(out, (grams[i : i + 4096, None] * _A + _B).min(0))
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (out >> np.uint64(48)).astype(">u2")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    remembers("words", forget)
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for i, j in fold(texts, lambda t: len(t or "")):
            prints, labels, sizes = [], [], []
            for t in texts[i:j]:
                grams = shingle_set(t or "")
                prints.append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                labels.append(signature(grams).tobytes() if len(grams) else None)
                sizes.append(len(grams))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(prints, pa.binary()), pa.array(labels, pa.binary()), pa.array(sizes, pa.int64())], names=["key", "hash", "fp", "labels", "grams"])


def raw(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column without nulls, one after the other."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)


# The forest: runs of a sorted stream (part, tree, label, rep, copies, grams, short).


def tries(classes: DataFrame) -> DataFrame:
    """Rows (part, tree, label, rep, copies, grams): the labels of all trees, sorted over range partitions."""
    rows = classes.select(F.sequence(F.lit(0), F.lit(TREES - 1)).alias("trees"), "labels", "rep", "copies", "grams")
    rows = rows.select(F.explode("trees").alias("tree"), "labels", "rep", "copies", "grams")
    rows = rows.select("tree", F.substring("labels", F.col("tree") * (2 * DEEPEST) + 1, F.lit(2 * DEEPEST)).alias("label"), "rep", "copies", "grams")
    rows = rows.repartitionByRange("tree", "label").sortWithinPartitions("tree", "label")
    return saved(rows.select(F.spark_partition_id().alias("part"), "*"), "tries")


def _nodes(depth: int):
    """Rows of the runs that share a prefix of that length, with the run's figures: whole runs of several rows, one of
    them short, and all that touch the edge of a part, which may go on in another."""

    def out(rows: pa.Table, starts: np.ndarray, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        run = np.zeros(n, np.int64)
        run[starts[1:]] = 1
        run = np.cumsum(run)
        size, short = np.bincount(run), np.bincount(run, rows["short"].to_numpy(zero_copy_only=False).astype(float)) > 0
        mass, bulk = (np.bincount(run, rows[c].to_numpy()).astype(np.int64) for c in ("copies", "grams"))
        kept = np.flatnonzero((edges | (short & (size > 1)))[run])
        if len(kept):
            at = run[kept]
            prefix = rows.select(["label"]).take(kept)["label"].to_pylist()
            first = np.zeros(n, bool)
            first[starts] = True
            yield from pa.table({
                "tree": rows["tree"].to_numpy()[kept], "prefix": pa.array([x[: 2 * depth] for x in prefix], pa.binary()), "rep": rows["rep"].to_numpy()[kept], "short": rows["short"].to_numpy(zero_copy_only=False)[kept],
                "size": size[at], "mass": mass[at], "bulk": bulk[at], "any": short[at], "edge": edges[at], "first": first[kept],
            }).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the open run
        last, edge = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            part, tree = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            label = raw(batch.column(2)).reshape(-1, 2 * DEEPEST)[:, : 2 * depth]
            table = pa.Table.from_batches([batch])
            new = np.ones(len(part), bool)
            other = np.ones(len(part), bool)
            other[1:] = part[1:] != part[:-1]
            new[1:] = other[1:] | (tree[1:] != tree[:-1]) | (label[1:] != label[:-1]).any(1)
            if last is not None:
                other[0] = part[0] != last[0]
                new[0] = other[0] or tree[0] != last[1] or label[0].tobytes() != last[2]
            starts = np.flatnonzero(new)
            if held and not len(starts):
                held.append(table)
                continue
            if held:
                whole = pa.concat_tables([*held, table.slice(0, starts[0])])
                yield from out(whole, np.array([0]), np.array([edge or bool(other[starts[0]])]))
            if len(starts) > 1:
                a, z = int(starts[0]), int(starts[-1])
                edges = other[starts[:-1]] | other[starts[1:]]
                edges[0] |= last is None
                yield from out(table.slice(a, z - a), starts[:-1] - a, edges)
            edge = bool(other[starts[-1]]) or (last is None and len(starts) == 1)
            held = [table.slice(int(starts[-1]))]
            last = (part[-1], tree[-1], label[-1].tobytes())
        if held:
            yield from out(pa.concat_tables(held), np.array([0]), np.array([True]))

    return run


def _met(forest: DataFrame, depth: int) -> DataFrame:
    """Rows (depth, tree, prefix, size, mass, bulk, rep, short) of the nodes at that depth that several texts have, one
    of the short ones among them; mass counts copies, bulk bytes of sets."""
    figures = "size long, mass long, bulk long, any boolean"
    rows = forest.select("part", "tree", "label", "rep", "copies", "grams", "short")
    nodes = saved(rows.mapInArrow(_nodes(depth), f"tree int, prefix binary, rep long, short boolean, {figures}, edge boolean, first boolean"), "nodes")
    # A part has two edges, so these sums are few: two rows a part at most.
    cut = nodes.filter("edge and first").groupBy(F.col("tree").alias("t"), F.col("prefix").alias("p"))
    cut = F.broadcast(cut.agg(F.sum("size").alias("s"), F.sum("mass").alias("m"), F.sum("bulk").alias("b"), F.max("any").alias("a")).filter("s > 1 and a"))
    crossing = nodes.filter("edge").join(cut, (F.col("tree") == F.col("t")) & (F.col("prefix") == F.col("p")))
    crossing = crossing.select("tree", "prefix", "rep", "short", F.col("s").alias("size"), F.col("m").alias("mass"), F.col("b").alias("bulk"))
    met = nodes.filter("not edge").select(*crossing.columns).unionByName(crossing)
    return met.select(F.lit(depth).alias("depth"), "tree", "prefix", "size", "mass", (8 * F.col("bulk")).alias("bulk"), "rep", "short")


def groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first n columns of a sorted stream."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in range(n))))
        starts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for i, j in zip([0, *starts], [*starts, len(keys)]):
            if held and keys[i] != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(i, j - i))
            last = keys[i]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _prefixes(s: np.ndarray, depth: int) -> np.ndarray:
    """The prefixes of labels (texts, TREES, DEEPEST) as numbers (TREES, texts, words of 64 bits)."""
    out = s.transpose(1, 0, 2).copy()
    out[..., depth:] = 0
    return out.view(np.uint64)[..., : -(-depth // 4)]


def _candidates(table: pa.Table, longest: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs that this group has to compare: one of them has a prefix this short, first met at this
    level and in this tree, not ruled out. In strips of bounded size; only pairs first met here have their signatures
    compared."""
    depth, tree, a, b = (table[c][0].as_py() for c in ("depth", "tree", "a", "b"))
    short = table["short"].to_numpy()
    s = np.frombuffer(b"".join(table["labels"].to_pylist()), ">u2").astype(np.uint16).reshape(-1, TREES, DEEPEST)
    block = table["block"].to_numpy()
    left = np.flatnonzero(block == a)
    right = left if a == b else np.flatnonzero(block == b)
    here, deeper = _prefixes(s, depth), _prefixes(s, depth + 1) if depth < longest else None
    s = s.reshape(len(s), -1)
    same = lambda p, rows: (p[rows][:, None] == p[right][None]).all(-1) if p.shape[-1] > 1 else p[rows] == p[right].T
    step = max(1, STRIP // max(1, len(right)))
    for k in range(0, len(left), step):
        rows = left[k : k + step]
        ok = (short[rows][:, None] | short[right][None]) & same(here[tree], rows)
        for t in range(tree):
            ok &= ~same(here[t], rows)
        if deeper is not None:
            for t in range(TREES):
                ok &= ~same(deeper[t], rows)
        i, j = np.nonzero(ok)
        if a == b:
            i, j = i[k + i < j], j[k + i < j]
        i, j = rows[i], right[j]
        width = STRIP // s.shape[1]
        agree = [(s[i[x : x + width]] == s[j[x : x + width]]).mean(1) >= least for x in range(0, len(i), width)]
        if agree and (agree := np.concatenate(agree)).any():
            yield i[agree], j[agree]


def _needed(depth: int, least: float):
    """Keeps the rows of each group that take part in a pair to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembers("pairs", lambda: None)
        for table in groups(batches, 6):
            part = np.zeros(table.num_rows, bool)
            for i, j in _candidates(table, depth, least):
                part[i] = part[j] = True
            if part.any():
                yield from table.take(np.flatnonzero(part)).to_batches()

    return run


def intersections(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at i and j: pair by pair, or if there are many pairs by products of
    incidence matrices over the elements that several sets have."""
    (left, i), (right, j) = (np.unique(x, return_inverse=True) for x in (i, j))
    n = len(left) + len(right)
    if len(i) < 4 * n:
        return np.array([len(np.intersect1d(sets[left[a]], sets[right[b]], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    chosen = [sets[x] for x in (*left, *right)]
    owner = np.repeat(np.arange(n), [len(x) for x in chosen])
    values, place, counts = np.unique(np.concatenate(chosen), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    shared = counts[place] > 1
    owner, place = owner[shared], number[place[shared]]
    total = np.zeros((len(left), len(right)), np.float32)
    width = max(1, 16_000_000 // n)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        x, y = np.searchsorted(place, [at, at + width])
        m = np.zeros((n, min(width, int(place[y - 1]) + 1 - at)), np.float32)
        m[owner[x:y], place[x:y] - at] = 1
        total += m[: len(left)] @ m[len(left) :].T
    return total[i, j].astype(np.int64)


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The places' roots after these links too; each root is the root of itself."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        up = np.arange(len(root))
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
        root = up[root]


def _verify(depth: int, least: float, threshold: float):
    """Rows (rep, root of its part of the group's forest, links: copies of the texts that it is linked to)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembers("pairs", lambda: None)
        for table in groups(batches, 6):
            sets = [np.frombuffer(x, "<u8") for x in table["grams"].to_pylist()]
            size = np.array([len(x) for x in sets])
            copies, rep = table["copies"].to_numpy(), table["rep"].to_numpy()
            links, root = np.zeros(len(rep)), np.arange(len(rep))
            for i, j in _candidates(table, depth, least):
                both = intersections(sets, i, j)
                ok = both >= threshold * (size[i] + size[j] - both) - 1e-9
                i, j = i[ok], j[ok]
                links += np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
                root = _joined(root, i, j)
            kept = np.flatnonzero(links)
            if len(kept):
                yield pa.RecordBatch.from_arrays([pa.array(rep[kept]), pa.array(rep[root[kept]]), pa.array(links[kept].astype(np.int64))], names=["rep", "root", "links"])

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    remembers("words", forget)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for i, j in fold(texts, lambda t: len(t or "")):
            grams = [shingle_set(t or "").astype("<u8").tobytes() for t in texts[i:j]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(grams, pa.binary())], names=["id", "grams"])


def levels(classes: DataFrame, depth: int, threshold: float) -> DataFrame:
    """_met at that depth, and at smaller ones for the texts whose neighbours need them."""
    forest = tries(classes)
    out, flagged = None, forest.withColumn("short", F.lit(True))
    while True:
        met = saved(_met(flagged, depth), "met")
        out = met if out is None else out.unionByName(met)
        near = F.max("mass") / threshold**depth  # a neighbour at the threshold shares a prefix this often
        short = met.filter("short").groupBy("rep").agg((near * (1 - expected_recall(depth, threshold))).alias("loss")).filter(F.col("loss") > LOSS)
        short = saved(short.select(F.col("rep").alias("s"), F.lit(True).alias("short")), "short")
        n = short.count()
        if depth == 1 or not n:
            return out
        depth -= 1
        if n <= BROADCAST_KEYS:  # the rows stay where they are, sorted
            flagged = forest.join(F.broadcast(short), F.col("rep") == F.col("s"), "left")
        else:
            flagged = forest.join(short, F.col("rep") == F.col("s"), "left").repartitionByRange("tree", "label").sortWithinPartitions("tree", "label")
            flagged = saved(flagged.withColumn("part", F.spark_partition_id()), "tries")
        flagged = flagged.withColumn("short", F.coalesce("short", F.lit(False)))


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def members(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, target: float = RECALL, sigma: float | None = SIGMA) -> DataFrame:
    """Rows (key long, hash: text_hash of the text, component: a number of the row's connected component, null for a
    text without words, n_links long), one for each input row. Key and hash identify a text."""
    depth = shortened(threshold, target)
    least = 0.0 if sigma is None else threshold - sigma * (threshold * (1 - threshold) / (TREES * DEEPEST)) ** 0.5
    docs = df.select(F.col(key).cast("long").alias("key"), text_hash(F.col(text)).alias("hash"), F.col(text).alias("t"))
    signed = saved(docs.mapInArrow(_sign, "key long, hash long, fp binary, labels binary, grams long"), "signed")
    classes = signed.filter("fp is not null").groupBy("fp").agg(F.min(F.struct("key", "hash")).alias("one"), F.count("*").alias("copies"), F.first("labels").alias("labels"), F.first("grams").alias("grams"))
    classes = saved(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    met = levels(classes, depth, threshold)
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.least(F.ceil(F.col("bulk") / BLOCK_BYTES), F.col("size")))
    met = met.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("rep", "tree"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("depth", "tree", F.xxhash64("prefix").alias("bucket"), F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "rep", "short")
    met = met.withColumn("group", F.xxhash64("depth", "tree", "bucket", "a", "b"))
    signs = classes.select(F.col("rep").alias("r"), "labels")
    one = "group long, depth int, tree int, bucket long, a int, b int, block int, rep long, short boolean, labels binary"
    met = met.join(signs, F.col("rep") == F.col("r")).select(*(x.split()[0] for x in one.split(", ")))
    dealt = lambda x: x.repartition("group").sortWithinPartitions("group", "depth", "tree", "bucket", "a", "b")
    needed = saved(dealt(met).mapInArrow(_needed(depth, least), one), "needed")

    keys = needed.select("rep").distinct().join(classes.select(F.col("rep").alias("r"), "one", "copies"), F.col("rep") == F.col("r"))
    keys = saved(keys.select("rep", F.col("one.key").alias("k"), F.col("one.hash").alias("h"), "copies"), "keys")
    few = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    grams = docs.join(few, F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h"))).select("rep", "t").mapInArrow(_grams, "id long, grams binary")
    grams = grams.groupBy("id").agg(F.first("grams").alias("grams")).join(keys.select("rep", "copies"), F.col("id") == F.col("rep")).select("id", "grams", "copies")
    whole = needed.join(grams, F.col("rep") == F.col("id")).drop("id")
    linked = saved(dealt(whole).mapInArrow(_verify(depth, least, threshold), "rep long, root long, links long"), "linked")

    parts = components(linked.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = linked.groupBy(F.col("rep").alias("r")).agg(F.sum("links").alias("links"))
    ranked = classes.select("fp", "rep", "copies").join(counts, F.col("rep") == F.col("r"), "left").join(parts, F.col("rep") == F.col("node"), "left")
    ranked = ranked.select(F.col("fp").alias("f"), F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = signed.select("key", "hash", "fp").join(ranked, F.col("fp") == F.col("f"), "left")
    return out.select("key", "hash", "component", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def join(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, target: float = RECALL, sigma: float | None = SIGMA) -> DataFrame:
    """Rows (key long, class_id long, n_links long), one for each input row: the least key of the row's connected
    component, and the number of other rows whose sets have a similarity of the threshold or more."""
    with small_batches(df.sparkSession):
        rows = saved(members(df, key, text, threshold, target, sigma), "members")
    least = rows.filter("component is not null").groupBy(F.col("component").alias("c")).agg(F.min("key").alias("class_id"))
    out = rows.join(least, F.col("component") == F.col("c"), "left")
    return out.select(F.col("key").alias(key), F.when(F.col("component").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"), "n_links")


def firsts(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each class, with its columns: of the least key (nulls last), then of the least other columns. Rows
    without words are all kept."""
    with small_batches(df.sparkSession):
        rows = saved(members(df, key, text, **how), "members")
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("k"), F.col("hash").alias("h"))
    chosen = rows.filter("component is not null").groupBy("component").agg(F.min(order).alias("least")).select(F.col("least.k").alias("k"), F.col("least.h").alias("h"))
    worded = F.coalesce(F.col("row").getField(text), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    packed = df.select(F.struct(*df.columns).alias("row"), F.col(key).cast("long").alias("key"), text_hash(F.col(text)).alias("hash"))
    found = packed.filter(worded).join(chosen, F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")), "left_semi")
    first = F.row_number().over(W.partitionBy("key", "hash").orderBy("row"))  # rows that repeat a key and a text
    return found.withColumn("n", first).filter("n = 1").select("row.*").unionByName(packed.filter(~worded).select("row.*"))
