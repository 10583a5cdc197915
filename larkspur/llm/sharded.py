"""Figures by 64-bit id in shards, and sums of them over texts.

A table has a row a shard: (bucket: the ids' upper bits, ids sorted, values), packed. Texts don't come to the table, nor
the table to the texts: a task asks each shard for the ids of a chunk of its texts, sorted, each with the texts that hold
it, as one packed row; the shard answers with sums by text, and a chunk's answers meet in one small group. Ids that are
very common are answered where the texts are, from a broadcast list of HOT at most; ids that a bitmap of fixed size
rules out aren't asked for. Both only spare work: any id that isn't listed goes to its shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import fold, saved, shards

CHUNK = 8_000_000
#: Words that a worker remembers.
MEMORY = 500_000
#: A total divided by HOT is the least count of a common id, so there are no more of them.
HOT = 1 << 20
#: Bits of the map of ids.
MAP_BITS = 27
SHARD_MB, LEAST_SHARDS = 16, 32

BEGIN, END = np.uint64(1 << 16), np.uint64(2 << 16)
_known: dict[bytes, int] = {}


def prepared(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def word_ids(text: bytes) -> np.ndarray:
    """48-bit hashes, in the upper bits, of the words between white space."""
    words = text.split()
    fresh = set(words).difference(_known)
    if len(_known) + len(fresh) > MEMORY:
        _known.clear()
        fresh = set(words)
    _known.update(zip(fresh, map(xxhash.xxh3_64_intdigest, fresh)))
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words)) & np.uint64(0xFFFFFFFFFFFF0000)


def shard_bits(df: DataFrame) -> int:
    """Upper bits that tell shards apart; one shard for each SHARD_MB of a table."""
    return (shards(df, SHARD_MB, LEAST_SHARDS) - 1).bit_length()


def pack(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, distinct, start, count) of ids."""
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    return order, s[start], start, np.diff(np.append(start, len(s)))


def slices(distinct: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """(bucket, places) of sorted ids."""
    bucket = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(distinct), np.int64)
    if len(bucket):
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for i, j in zip(starts, [*starts[1:], len(bucket)]):
            yield int(bucket[i]), slice(int(i), int(j))


_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Listed:
    """Common ids and their values in an open table: a look-up is about one random read, where a search is twenty."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        bits = max(4, (2 * len(ids)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.ids, self.values, self.probes = np.full(1 << bits, _NONE), np.zeros(1 << bits), 0
        left = np.flatnonzero(ids != _NONE)
        while len(left):
            slot = (self._slots(ids[left]) + self.probes) & self.mask
            free = np.flatnonzero(self.ids[slot] == _NONE)
            slot, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.ids[slot], self.values[slot] = ids[left[placed]], values[left[placed]]
            left = np.delete(left, placed)
            self.probes += 1

    def _slots(self, ids: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((ids ^ (ids >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is listed, the slot of its value) of each id."""
        slot = self._slots(ids)
        at = self.ids[slot]
        hit = (at == ids) & (at != _NONE)
        open_ = np.flatnonzero(~hit & (at != _NONE))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            at = self.ids[slot[open_]]
            hit[open_] = at == ids[open_]
            open_ = open_[~hit[open_] & (at != _NONE)]
        return hit, slot


_listed: dict[str, Listed] = {}


def listed(name: str, ids: np.ndarray, values: np.ndarray) -> Listed:
    """One table a worker; the last few are kept."""
    if name not in _listed:
        while len(_listed) > 1:
            _listed.pop(next(iter(_listed)))
        _listed[name] = Listed(ids, values)
    return _listed[name]


def added(ids: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ids and the sums of their values."""
    both = np.concatenate(ids) if ids else np.empty(0, np.uint64)
    order, distinct, start, _ = runs(both)
    v = np.concatenate(values) if values else np.empty(0)
    return distinct, np.add.reduceat(v[order], start) if len(start) else v


Ids = Callable[[list[bytes]], Iterator[tuple[np.ndarray, np.ndarray]]]


def count(rows: DataFrame, ids_of: Ids, bits: int, every: bool = False) -> DataFrame:
    """Rows (bucket, ids, counts, total, distinct), one a shard, of the ids of the texts of rows (t, learn) where learn
    holds. A task adds up its own before it sends them. every: the ids of the other texts too, counted as 0."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            ids, n = added([a for a, _ in held], [b for _, b in held])
            cut = list(slices(ids, bits))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in cut], pa.int64()), pa.array([pack_sorted(ids[s]) for _, s in cut], pa.binary()), pa.array([pack(n[s].astype(np.int64)) for _, s in cut], pa.binary())], names=["bucket", "ids", "counts"])

        for batch in batches:
            for flag in (1, 0) if every else (1,):
                texts = [prepared(t) for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if x == flag]
                for i, j in fold(texts, len, CHUNK):
                    for ids, _ in ids_of(texts[i:j]):
                        distinct, n = np.unique(ids, return_counts=True)
                        held.append((distinct, n * flag))
                        if sum(len(a) for a, _ in held) > 4_000_000:
                            held = [added([a for a, _ in held], [b for _, b in held])]
                            if len(held[0][0]) > 3_000_000:
                                yield out()
                                held = []
        if held:
            yield out()

    def add(key: tuple, part: pa.Table) -> pa.Table:
        ids, n = added([unpack_sorted(x) for x in part["ids"].to_pylist()], [unpack(x, np.int64) for x in part["counts"].to_pylist()])
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([pack_sorted(ids)], pa.binary()), "counts": pa.array([pack(n)], pa.binary()), "total": pa.array([int(n.sum())], pa.int64()), "distinct": pa.array([len(n)], pa.int64())})

    parts = rows.select("t", "learn").mapInArrow(own, "bucket long, ids binary, counts binary")
    return saved(parts.groupBy("bucket").applyInArrow(add, "bucket long, ids binary, counts binary, total long, distinct long"), "counts")


def id_map(table: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the ids' upper MAP_BITS bits; each shard makes its own part of it."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                flags = np.zeros(1 << (MAP_BITS - bits), np.uint8)
                flags[(unpack_sorted(ids) >> np.uint64(64 - MAP_BITS)).astype(np.int64) - (bucket << (MAP_BITS - bits))] = 1
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([pack(np.packbits(flags))], pa.binary())], names=["bucket", "flags"])

    if bits > MAP_BITS - 3:
        return np.full(1 << (MAP_BITS - 3), 255, np.uint8)  # shards of less than a byte each: nothing is ruled out
    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    size = 1 << (MAP_BITS - 3 - bits)
    for r in table.select("bucket", "ids").mapInArrow(part, "bucket long, flags binary").toLocalIterator():
        out[r.bucket * size : (r.bucket + 1) * size] = unpack(r.flags, np.uint8)
    return out


def sums(rows: DataFrame, head: Column, text: Column, ids_of: Ids, width: int, table: DataFrame, bits: int, hot: tuple[np.ndarray, np.ndarray], known: np.ndarray | None = None) -> DataFrame:
    """Rows (head, total array<double>, found array<long>, size array<long>) of a table of texts: for each of width
    kinds of ids the sum of the values, the number of ids that the table has, and their number.

    ids_of(texts) gives ids and their owners, a text's number times width, plus the kind, in pieces of bounded size.
    table: rows (bucket, ids, values, type of the values), one or more a shard. hot: ids and values.
    Rows of one task are numbered in their order, so the input has to read alike if a task is run again.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((uuid.uuid4().hex, *hot, known))
    kind = rows.select(head.alias("head")).schema["head"].dataType
    packed = rows.select(head.alias("head"), text.alias("t"), F.spark_partition_id().alias("part"))
    request = f"bucket long, chunk long, n long, ids binary, counts binary, owners binary, heads array<{kind.simpleString()}>"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, hot_ids, hot_values, flags = shared.value
        common, number = listed(name, hot_ids, hot_values), None
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(2)[0].as_py() << 32 if number is None else number
            texts = [prepared(t) for t in batch.column(1).to_pylist()]
            for i, j in fold(texts, len, CHUNK):
                n = (j - i) * width
                total, found, size, rest = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64), []
                for ids, owner in ids_of(texts[i:j]):
                    size += np.bincount(owner, minlength=n)
                    if len(hot_ids):
                        hit, slot = common.find(ids)
                        total += np.bincount(owner[hit], common.values[slot[hit]], n)
                        found += np.bincount(owner[hit], minlength=n)
                        ids, owner = ids[~hit], owner[~hit]
                    if flags is not None:
                        at = (ids >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                        may = (flags[at >> 3] >> (7 - (at & 7))) & 1 > 0
                        ids, owner = ids[may], owner[may]
                    rest.append((ids, owner.astype(np.uint32)))
                order, distinct, start, counts = runs(np.concatenate([x for x, _ in rest]) if rest else np.empty(0, np.uint64))
                owner = np.concatenate([x for _, x in rest])[order] if rest else np.empty(0, np.uint32)
                cut = list(slices(distinct, bits))
                ends = [(int(start[s.start]), int(start[s.stop - 1] + counts[s.stop - 1])) for _, s in cut]
                # The first row is the chunk's own: its heads, and what is known of them already.
                heads = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i))
                heads = pa.concat_arrays([heads, pa.nulls(len(cut), heads.type)])
                yield pa.RecordBatch.from_arrays([
                    pa.array([number % (1 << bits), *(b for b, _ in cut)], pa.int64()), pa.array([number] * (len(cut) + 1), pa.int64()), pa.array([n] * (len(cut) + 1), pa.int64()),
                    pa.array([pack(total), *(pack_sorted(distinct[s]) for _, s in cut)], pa.binary()), pa.array([pack(found), *(pack(counts[s].astype(np.uint32)) for _, s in cut)], pa.binary()),
                    pa.array([pack(size), *(pack(owner[a:z]) for a, z in ends)], pa.binary()), heads,
                ], names=["bucket", "chunk", "n", "ids", "counts", "owners", "heads"])
                number += 1

    def answer(key: tuple, part: pa.Table, shard: pa.Table) -> pa.Table:
        """A shard's sums for each chunk: owners, totals and numbers; a chunk's own row passes."""
        tables = [(unpack_sorted(r["ids"]), unpack(r["values"], r["type"])) for r in shard.to_pylist()]
        out = {"ids": [], "counts": [], "owners": []}
        for own, ids, counts, owners in zip(pc.is_valid(part["heads"]).to_pylist(), *(part[c].to_pylist() for c in out)):
            if not own:
                ids, counts, owners = unpack_sorted(ids), unpack(counts, np.uint32), unpack(owners, np.uint32)
                hit, v = np.zeros(len(ids), bool), np.zeros(len(ids))
                for have, value in tables:
                    if len(have):
                        place = np.minimum(np.searchsorted(have, ids), len(have) - 1)
                        here = have[place] == ids
                        hit |= here
                        v[here] = value[place[here]]
                owners = owners[np.repeat(hit, counts)]
                some, at = np.unique(owners, return_inverse=True)
                ids, counts, owners = pack(np.bincount(at, np.repeat(v[hit], counts[hit]), len(some))), pack(np.bincount(at, minlength=len(some))), pack(some)
            for c, x in zip(out, (ids, counts, owners)):
                out[c].append(x)
        return pa.table({"chunk": part["chunk"], "n": part["n"], **{c: pa.array(x, pa.binary()) for c, x in out.items()}, "heads": part["heads"]})

    dealt = packed.mapInArrow(ask, request).groupBy("bucket").cogroup(table.select("bucket", "ids", "values", "type").groupBy("bucket"))
    answers = dealt.applyInArrow(answer, request.replace("bucket long, ", ""))

    def finish(key: tuple, part: pa.Table) -> pa.Table:
        total = found = size = heads = None
        for k, own in enumerate(pc.is_valid(part["heads"]).to_pylist()):
            if own:
                heads = part["heads"].slice(k, 1).combine_chunks().flatten()
                size = unpack(part["owners"][k].as_py(), np.int64)
        if heads is None:
            raise RuntimeError("a chunk's texts are numbered anew: its input doesn't read alike twice")
        total, found = np.zeros(len(size)), np.zeros(len(size), np.int64)
        for own, ids, counts, owners in zip(pc.is_valid(part["heads"]).to_pylist(), *(part[c].to_pylist() for c in ("ids", "counts", "owners"))):
            if own:
                total += unpack(ids, np.float64)
                found += unpack(counts, np.int64)
            else:
                owners = unpack(owners, np.uint32)
                total[owners] += unpack(ids, np.float64)
                found[owners] += unpack(counts, np.int64)
            lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, len(a) + 1, width, dtype=np.int32)), pa.array(a))
        return pa.table({"head": heads, "total": lists(total), "found": lists(found), "size": lists(size)})

    return answers.groupBy("chunk").applyInArrow(finish, f"head {kind.simpleString()}, total array<double>, found array<long>, size array<long>")
