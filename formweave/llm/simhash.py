"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at ``RADIUS`` = 3 or fewer differing bits are linked. Two balls of half the radius (one bit) meet
exactly when the fingerprints are within two bits: every fingerprint emits its 65 variants within one bit, variants
are shuffled, and all that share one are linked in a chain (they need no further check, and at most 65 different
fingerprints can share a variant). For pairs at exactly three bits, one of the two 32-bit halves differs in one bit
at most; each fingerprint emits, for each half, that half as it is and its 32 variants within one bit; colliding
pairs of different components are verified by their distance. A ball of radius two on the whole fingerprint would
do without halves, at 2,081 variants instead of 66. A half that many fingerprints share makes large buckets: these are
split into cells of at most about ``CELL`` by ``CELL`` fingerprints, the fingerprints with that very half against all.

Defined results: null or wordless texts have fingerprint zero and link like any other; texts of fewer words than the
shingle width are one shingle; repeated rows share a component; ``component_id`` is the least non-null ``doc_id`` of
the component (null if all are null); an empty table gives an empty table. Only ``doc_id`` and the text are read, so
further columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formweave.llm.graph import components
from formweave.llm.shared import SMALL_ROWS, checkpointed

RADIUS = 3
#: Fingerprints of either side in a cell of a bucket.
CELL = 4096
_BLOCK = 1 << 16
_PAIRS = 1 << 11


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats counted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return hashed(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    n, ones = len(first), np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        h = np.fromiter((hashed(joined[a:b], 42) for a, b in zip(first[at : at + _BLOCK], last[at : at + _BLOCK], strict=True)), np.uint64, min(_BLOCK, n - at))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(v.as_py(), width) for v in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col(text)).mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


def _within_two(prints: DataFrame) -> DataFrame:
    """Edges between fingerprints that share a variant within one bit."""
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    balls = _spread(prints.select("fp")).select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    return balls.select(F.col("fp").alias("a"), before.alias("b")).where("b is not null").distinct()


def _half(side: int) -> Column:
    half = F.call_function("shiftrightunsigned", F.col("fp"), F.lit(32)) if side else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    return half + F.lit(side << 32)


def _ball(half: Column) -> Column:
    """The 33 buckets of a half: itself, and its variants within one bit."""
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.transform(flips, lambda m: F.struct(half.bitwiseXOR(m).alias("bucket"), (m == 0).alias("exact")))


def _spread(rows: DataFrame) -> DataFrame:
    """A small table over as many tasks as a shuffle has, for what is about to grow."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *rows.columns[:1])


def _hot(labelled: DataFrame, cell: int) -> DataFrame:
    """``bucket, n_own, n_other``: in how many cells either side of a large bucket falls.

    A bucket has at most 33 halves, so a large one has a half that a 33rd of its fingerprints share.
    """
    shared = labelled.select(F.explode(F.array(_half(0), _half(1))).alias("half")).groupBy("half").agg(F.count("*").alias("n")).where(F.col("n") * 33 > cell)
    met = shared.select("n", F.explode(_ball(F.col("half"))).alias("k")).groupBy("k.bucket").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("k.exact"), F.col("n")).otherwise(0)).alias("own"))
    cells = lambda c: F.ceil((F.col(c) + cell) / cell).cast("int")  # noqa: E731  the halves that are not listed add less than a cell
    return met.select("bucket", cells("own").alias("n_own"), cells("n").alias("n_other"))


def _halves(labelled: DataFrame, cell: int) -> DataFrame:
    """``bucket, cell, own, other, fp, label``: each half as it is (``own``), and within one bit (``other``)."""
    hot = checkpointed(_hot(labelled, cell))
    rows = _spread(labelled).select("fp", "label", F.explode(F.concat(_ball(_half(0)), _ball(_half(1)))).alias("k")).select("k.bucket", "k.exact", "fp", "label")
    plain = F.struct(F.lit(0).alias("cell"), F.col("exact").alias("own"), F.lit(True).alias("other"))
    if not hot.limit(1).count():
        return rows.select("bucket", plain.alias("c"), "fp", "label").select("bucket", "c.*", "fp", "label")
    rows = rows.join(F.broadcast(hot) if hot.count() <= SMALL_ROWS else hot, "bucket", "left")
    at = lambda n, salt: F.pmod(F.xxhash64("fp", F.lit(salt)), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.transform(upto("n_other"), lambda j: F.struct((at("n_own", 1) * F.col("n_other") + j).alias("cell"), F.lit(True).alias("own"), F.lit(False).alias("other")))
    other = F.transform(upto("n_own"), lambda i: F.struct((i * F.col("n_other") + at("n_other", 2)).alias("cell"), F.lit(False).alias("own"), F.lit(True).alias("other")))
    cells = F.when(F.col("n_own").isNull(), F.array(plain)).when(F.col("exact"), F.concat(own, other)).otherwise(other)
    return rows.select("bucket", F.explode(cells).alias("c"), "fp", "label").select("bucket", "c.*", "fp", "label")


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of labels in a cell that some pair of their fingerprints links. Rows come sorted by bucket and cell."""
    rest: list[np.ndarray] | None = None

    def pairs(cols: list[np.ndarray]) -> np.ndarray:
        bucket, cell, own, other, fp, label = cols
        cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(cell) != 0)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
        mixed = (np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)) & np.logical_or.reduceat(own, starts)
        out = []
        for s, e in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
            left, right = s + np.flatnonzero(own[s:e]), s + np.flatnonzero(other[s:e])
            for at in range(0, len(left), _PAIRS):
                one = left[at : at + _PAIRS]
                for to in range(0, len(right), _PAIRS):
                    two = right[to : to + _PAIRS]
                    near = np.bitwise_count(fp[one, None].view(np.uint64) ^ fp[None, two].view(np.uint64)) <= RADIUS
                    i, j = np.nonzero(near & (label[one, None] != label[None, two]))
                    if len(i):
                        out.append(np.unique(np.stack([label[one][i], label[two][j]], axis=1), axis=0))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    for pdf in frames:
        cols = [pdf[c].to_numpy() for c in ("bucket", "cell", "own", "other", "fp", "label")]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        last = int(np.argmax(same))  # the last cell may go on
        rest = [c[last:] for c in cols]
        if last:
            yield pd.DataFrame(pairs([c[:last] for c in cols]), columns=["a", "b"])
    if rest is not None and len(rest[0]):
        yield pd.DataFrame(pairs(rest), columns=["a", "b"])


def fingerprint_components(prints: DataFrame, cell: int = CELL) -> DataFrame:
    """``fp, label`` for the different fingerprints of ``prints`` (column fp): equal labels are linked."""
    prints = prints.select("fp").distinct()
    near = components(_within_two(prints))
    labelled = checkpointed(prints.join(near, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("label", "fp").alias("label")))
    rows = _halves(labelled, cell)
    sorted_rows = rows.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")
    far = components(sorted_rows.mapInPandas(_verified, "a long, b long"))
    far = far.select(F.col("node").alias("label"), F.col("label").alias("top"))
    return labelled.join(far, "label", "left").select("fp", F.coalesce("top", "label").alias("label"))


def near_duplicates(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per input row."""
    rows = checkpointed(fingerprints(docs, text, width))
    prints = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = fingerprint_components(prints)
    members = prints.join(labels, "fp")
    tops = members.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = members.join(tops, "label").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(ids, "fp").select("doc_id", shown.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the least ``doc_id`` (null last), then of the least text hash.

    Rows that repeat a ``doc_id`` with unlike texts belong to different components, and each component keeps a row.
    """
    keyed = docs.withColumns({"__none": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0)), "__mark": F.xxhash64(F.col(text))})
    key = ["__none", "__id", "__mark"]
    rows = checkpointed(fingerprints(keyed.select(F.struct(*key).alias("doc_id"), F.col(text)), text).select("doc_id.*", "fp"))
    prints = checkpointed(rows.groupBy("fp").agg(F.min(F.struct(*key)).alias("least")))
    least = prints.join(fingerprint_components(prints), "fp").groupBy("label").agg(F.min("least").alias("least"))
    kept = checkpointed(least.select("least.*"))
    return keyed.join(kept, key, "left_semi").dropDuplicates(key).select(*docs.columns)
