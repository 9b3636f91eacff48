"""Line deduplication: sharded cuckoo filters over exact reference-count tables.

State is two tables. ``refcounts`` holds, for every line key, in how many documents it stands (exact). ``filters``
holds, per shard of the key space, a cuckoo filter over the keys whose count reached the threshold, with those keys
themselves; the number of shards follows the number of keys. Inserting or deleting documents changes counts, and moves
keys into or out of the filters, so that a deletion undoes an insertion, and an insertion a deletion: counts may be
negative in between. Lines are looked up in the filter first; a hit is confirmed by the exact key. Where filters and
keys are too large to broadcast, filters alone are, in blocks of shards, and only lines with a hit are joined with the
exact keys.

A key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased, held as a 128-bit hash.

Defined results: a null or empty text is one empty line; empty keys are never dropped; each row counts as a document
of its own, also where ``doc_id`` is null or repeated; a document that loses all its lines keeps the empty text; an
empty table gives an empty table. Other columns pass through; on a name clash the operator's ``n_lines`` and
``n_dropped`` replace the input's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formweave.llm.shared import checkpointed, others, slices

BLANKS = b" \t\n\x0b\x0c\r"
#: Shards of the key space at least, each with a filter of its own, and keys of a shard on average at most.
SHARDS, SHARD_KEYS = 256, 1 << 15
#: Filters and their keys are broadcast up to this many bytes; beyond it filters alone are, in blocks of that size.
BROADCAST_BYTES = 64 << 20
#: Distinct keys that a task holds before it hands on its partial counts.
HELD_KEYS = 200_000
SLOTS = 4
KICKS = 500


def line_keys(text: str) -> tuple[list[bytes], list[bytes]]:
    """Lines of a text, and the 16-byte key of each (empty for an empty line)."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    bare = [x.strip(BLANKS).lower() for x in lines]
    return lines, [xxhash.xxh3_128_digest(x) if x else b"" for x in bare]


def _two_longs(keys: bytes) -> np.ndarray:
    return np.frombuffer(keys, "<i8").reshape(-1, 2)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}

    def flush() -> pa.RecordBatch:
        keys = _two_longs(b"".join(held))
        out = pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(np.fromiter(held.values(), np.int64, len(held)))], names=["k0", "k1", "n"])
        held.clear()
        return out

    for batch in batches:
        for value in batch.column(0):
            for key in set(line_keys(value.as_py() or "")[1]):
                if key:
                    held[key] = held.get(key, 0) + 1
            if len(held) >= HELD_KEYS:
                yield flush()
    if held:
        yield flush()


def count_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``k0, k1, n_docs``: the documents that hold each line key. Pre-aggregated in each task, then summed."""
    part = docs.select(F.col(text)).mapInArrow(_partial_counts, "k0 long, k1 long, n long")
    return part.groupBy("k0", "k1").agg(F.sum("n").alias("n_docs"))


class Cuckoo:
    """A cuckoo filter over 16-byte keys: 16-bit fingerprints, four slots a bucket."""

    def __init__(self, n_buckets: int, table: np.ndarray | None = None):
        self.n = n_buckets
        self.table = np.zeros((n_buckets, SLOTS), np.uint16) if table is None else table

    @staticmethod
    def for_keys(keys: np.ndarray) -> Cuckoo:
        n = 1
        while n * SLOTS * 0.85 < len(keys):
            n *= 2
        while True:
            out = Cuckoo(n)
            if all(map(out._put, *(x.tolist() for x in out.places(keys, n)))):
                return out
            n *= 2

    @staticmethod
    def places(keys: np.ndarray, n: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and the two buckets of each key."""
        u = keys[:, 1].astype(np.uint64)
        mark = (u % np.uint64(65535) + np.uint64(1)).astype(np.uint64)
        last = np.asarray(n, np.uint64) - np.uint64(1)
        one = (u >> np.uint64(20)) & last
        return mark.astype(np.uint16), one.astype(np.int64), (one ^ Cuckoo._jump(mark, last)).astype(np.int64)

    @staticmethod
    def _jump(mark: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (mark * np.uint64(0x5BD1E995)) & last

    def insert(self, key: np.ndarray) -> bool:
        return self._put(*(int(x[0]) for x in self.places(key[None, :], self.n)))

    def _put(self, mark: int, one: int, two: int) -> bool:
        """Whether the mark found a place; if not, all others are back in theirs."""
        for b in (one, two):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = mark
                return True
        at, moved = one, []
        for kick in range(KICKS):
            slot = kick % SLOTS
            moved.append((at, slot))
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at ^= int(self._jump(np.uint64(mark), np.uint64(self.n - 1)))
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        for at, slot in reversed(moved):
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
        return False

    def delete(self, key: np.ndarray) -> bool:
        mark, one, two = (x[0] for x in self.places(key[None, :], self.n))
        for b in (one, two):
            at = np.flatnonzero(self.table[b] == mark)
            if len(at):
                self.table[b, at[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(keys, self.n)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)


_FILTER = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("n_buckets", T.IntegerType()), T.StructField("slots", T.BinaryType()), T.StructField("keys", T.BinaryType())])


def _ordered(keys: np.ndarray) -> np.ndarray:
    return keys[np.lexsort((keys[:, 1], keys[:, 0]))]


def _row(shard: int, cuckoo: Cuckoo, keys: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "n_buckets": [cuckoo.n], "slots": [cuckoo.table.astype("<u2").tobytes()], "keys": [_ordered(keys).astype("<i8").tobytes()]})


def shards_for(n_keys: int) -> int:
    """A power of two."""
    n = SHARDS
    while n * SHARD_KEYS < n_keys:
        n *= 2
    return n


def _shard(n_shards: int) -> Column:
    return F.pmod(F.col("k0"), F.lit(n_shards)).cast("int").alias("shard")


def build_filters(refcounts: DataFrame, min_docs: int, n_shards: int = SHARDS) -> DataFrame:
    """One row per shard that has keys in at least ``min_docs`` documents."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf[["k0", "k1"]].to_numpy(np.int64)
        return _row(int(pdf["shard"].iloc[0]), Cuckoo.for_keys(keys), keys)

    return refcounts.where(F.col("n_docs") >= min_docs).select(_shard(n_shards), "k0", "k1").groupBy("shard").applyInPandas(build, _FILTER)


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, min_docs: int, n_shards: int = SHARDS) -> DataFrame:
    """``filters`` with the keys that crossed ``min_docs`` between two count tables inserted or deleted."""
    was, now = before.select("k0", "k1", F.col("n_docs").alias("was")), after.select("k0", "k1", F.col("n_docs").alias("now"))
    full = was.join(now, ["k0", "k1"], "full_outer").select("k0", "k1", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("was", "now")))
    moved = full.where((F.col("was") >= min_docs) != (F.col("now") >= min_docs)).select(_shard(n_shards), "k0", "k1", (F.col("now") >= min_docs).alias("enters"))

    def apply(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if not len(new):
            return old
        shard = int(new["shard"].iloc[0])
        keys = _two_longs(old["keys"].iloc[0]) if len(old) else np.zeros((0, 2), np.int64)
        cuckoo = Cuckoo(int(old["n_buckets"].iloc[0]), np.frombuffer(old["slots"].iloc[0], "<u2").reshape(-1, SLOTS).copy()) if len(old) else Cuckoo(1)
        change, enters = new[["k0", "k1"]].to_numpy(np.int64), new["enters"].to_numpy(bool)
        gone = {k.tobytes() for k in change[~enters]}
        for k in change[~enters]:
            cuckoo.delete(k)
        keys = np.array([k for k in keys if k.tobytes() not in gone], np.int64).reshape(-1, 2)
        keys = np.concatenate([keys, change[enters]])
        if not all(cuckoo.insert(k) for k in change[enters]):
            cuckoo = Cuckoo.for_keys(keys)
        return _row(shard, cuckoo, keys) if len(keys) else old.iloc[:0]

    return filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(apply, _FILTER)


class Lookup:
    """Shards side by side, for whole arrays of keys."""

    def __init__(self, rows: list[tuple[int, int, bytes, bytes]], n_shards: int):
        self.n_shards, self.buckets, self.at = n_shards, np.ones(n_shards, np.int64), np.zeros(n_shards, np.int64)
        slots, at = [np.zeros((1, SLOTS), np.uint16)], 1  # shards without keys look into the first, empty bucket
        for shard, n, table, _ in rows:
            self.buckets[shard], self.at[shard] = n, at
            slots.append(np.frombuffer(table, "<u2").reshape(-1, SLOTS))
            at += n
        self.slots = np.concatenate(slots)
        keys = np.concatenate([_two_longs(r[3]) for r in rows]) if rows else np.zeros((0, 2), np.int64)
        self.keys = np.ascontiguousarray(keys).view([("a", "<i8"), ("b", "<i8")]).reshape(-1)
        self.keys = np.sort(self.keys, order=["a", "b"])

    def maybe(self, joined: bytes) -> np.ndarray:
        """Which keys the filters hold, or take for one that they hold."""
        keys = _two_longs(joined)
        shard = np.mod(keys[:, 0], self.n_shards)
        mark, one, two = Cuckoo.places(keys, self.buckets[shard])
        at = self.at[shard]
        return ((self.slots[at + one] == mark[:, None]) | (self.slots[at + two] == mark[:, None])).any(axis=1)

    def holds(self, joined: bytes) -> np.ndarray:
        out = self.maybe(joined)
        if out.any() and len(self.keys):
            asked = np.ascontiguousarray(_two_longs(joined)[out]).view(self.keys.dtype).reshape(-1)
            place = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            out[out] = self.keys[place] == asked
        return out


def _without(lines: list[bytes], drop: np.ndarray) -> str:
    return b"\n".join(x for x, d in zip(lines, drop.tolist(), strict=True) if not d).decode("utf-8", "surrogatepass")


@dataclass
class LineIndex:
    """Incremental, reversible line deduplication."""

    refcounts: DataFrame
    filters: DataFrame
    min_docs: int = 10
    n_shards: int = SHARDS

    @staticmethod
    def build(docs: DataFrame, min_docs: int = 10, text: str = "text") -> LineIndex:
        refcounts = count_lines(docs, text)
        frequent = checkpointed(refcounts.where(F.col("n_docs") >= min_docs))
        n_shards = shards_for(frequent.count())
        return LineIndex(refcounts, build_filters(frequent, min_docs, n_shards), min_docs, n_shards)

    def _changed(self, docs: DataFrame, sign: int, text: str) -> LineIndex:
        delta = count_lines(docs, text).select("k0", "k1", (F.col("n_docs") * sign).alias("n_docs"))
        after = checkpointed(self.refcounts.unionByName(delta).groupBy("k0", "k1").agg(F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") != 0))
        n_shards = shards_for(after.where(F.col("n_docs") >= self.min_docs).count())
        if n_shards > self.n_shards:
            return LineIndex(after, checkpointed(build_filters(after, self.min_docs, n_shards)), self.min_docs, n_shards)
        return LineIndex(after, checkpointed(update_filters(self.filters, self.refcounts, after, self.min_docs, self.n_shards)), self.min_docs, self.n_shards)

    def insert(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._changed(docs, 1, text)

    def delete(self, docs: DataFrame, text: str = "text") -> LineIndex:
        return self._changed(docs, -1, text)

    def apply(self, docs: DataFrame, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """``docs`` without the lines of the filters' keys, with ``n_lines`` and ``n_dropped``."""
        filters = checkpointed(self.filters)
        size = filters.agg(F.sum(F.length("slots") + F.length("keys"))).first()[0] or 0
        return self._broadcast(filters, docs, text) if size <= broadcast_bytes else self._joined(filters, docs, text, broadcast_bytes)

    def _broadcast(self, filters: DataFrame, docs: DataFrame, text: str) -> DataFrame:
        spark = docs.sparkSession
        rows = spark.sparkContext.broadcast([tuple(r) for r in filters.select("shard", "n_buckets", "slots", "keys").collect()])
        keep = others(docs, "n_lines", "n_dropped")
        schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        made: list[Lookup] = []
        n_shards = self.n_shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not made:
                made.append(Lookup(rows.value, n_shards))
            for batch in batches:
                column = batch.column(keep.index(text))
                for start, part in slices(v.as_py() for v in column):
                    kept, n_lines, n_dropped = [], [], []
                    split = [line_keys(t) for t in part]
                    full = [k for _, keys in split for k in keys if k]
                    held = made[0].holds(b"".join(full)) if full else np.zeros(0, bool)
                    at = 0
                    for t, (lines, keys) in zip(part, split, strict=True):
                        has = np.fromiter(map(bool, keys), bool, len(keys))
                        drop, n = np.zeros(len(keys), bool), int(has.sum())
                        drop[has] = held[at : at + n]
                        at += n
                        kept.append(_without(lines, drop) if drop.any() else t)
                        n_lines.append(len(lines))
                        n_dropped.append(int(drop.sum()))
                    cut = batch.slice(start, len(part))
                    arrays = [pa.array(kept, batch.schema.field(i).type) if c == text else cut.column(i) for i, c in enumerate(keep)]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*keep, "n_lines", "n_dropped"])

        return docs.select(*keep).mapInArrow(run, schema)

    def _blocks(self, filters: DataFrame, most: int) -> list[list[int]]:
        """Runs of shards whose filters have ``most`` bytes at most, or are one shard."""
        out, size = [], most
        for shard, n in sorted(tuple(r) for r in filters.select("shard", F.length("slots")).collect()):
            if size + n > most:
                out.append([])
                size = 0
            out[-1].append(shard)
            size += n
        return out

    def _joined(self, filters: DataFrame, docs: DataFrame, text: str, most: int) -> DataFrame:
        """The way for filters too large to broadcast with their keys: lines with a hit meet the exact keys in a join."""
        keep = others(docs, "n_lines", "n_dropped")
        rows = checkpointed(docs.select(*keep).withColumn("__row", F.monotonically_increasing_id()))
        n_shards = self.n_shards

        def hits(block: list[int]) -> DataFrame:
            own = filters.where(F.col("shard").isin(block)).select("shard", "n_buckets", "slots").collect()
            shared = docs.sparkSession.sparkContext.broadcast([(*r, b"") for r in own])
            made: list[Lookup] = []

            def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                if not made:
                    made.append(Lookup(shared.value, n_shards))
                for batch in batches:
                    for row, value in zip(batch.column(0), batch.column(1), strict=True):
                        own: dict[bytes, list[int]] = {}
                        for i, k in enumerate(line_keys(value.as_py() or "")[1]):
                            if k:
                                own.setdefault(k, []).append(i)
                        if not own:
                            continue
                        joined = b"".join(own)
                        may = made[0].maybe(joined)
                        if may.any():
                            keys = _two_longs(joined)[may]
                            at = [x for x, m in zip(own.values(), may.tolist(), strict=True) if m]
                            yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(at)), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(at, pa.list_(pa.int32()))], names=["__row", "k0", "k1", "at"])

            return checkpointed(rows.select("__row", text).mapInArrow(lines, "__row long, k0 long, k1 long, at array<int>"))

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for value in batch.column(0):
                    keys = _two_longs(value.as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())], names=["k0", "k1"])

        found = reduce(DataFrame.unionByName, [hits(block) for block in self._blocks(filters, most)])
        drop = found.join(filters.select("keys").mapInArrow(exact, "k0 long, k1 long"), ["k0", "k1"], "left_semi")
        drop = drop.groupBy("__row").agg(F.flatten(F.collect_list("at")).alias("__drop"))
        split = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
        places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))  # by hash, in order
        out = rows.join(drop, "__row", "left").withColumn("__lines", split).withColumn("__gone", F.coalesce(F.col("__drop"), F.array().cast("array<int>")))
        kept = F.when(F.size("__gone") == 0, F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(F.transform(places, lambda i: F.get(F.col("__lines"), i)), "\n"))
        out = out.withColumn("__kept", kept).withColumns({"n_lines": F.size("__lines").cast("long"), "n_dropped": F.size("__gone").cast("long")})
        return out.select(*(F.col("__kept").alias(c) if c == text else F.col(c) for c in keep), "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, min_docs: int = 10, text: str = "text") -> DataFrame:
    """``docs`` without every line whose key stands in at least ``min_docs`` documents."""
    return LineIndex.build(docs, min_docs, text).apply(docs, text)
