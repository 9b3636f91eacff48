"""Quality rules: word and line counts, and the perplexity of a modified Kneser-Ney n-gram model.

The model is over characters as they stand (case, digits and marks are kept), of order ``ORDER``. Every n-gram of every
document that passes the base rules is counted: tasks count theirs, Spark sums the counts, and Spark joins turn them into
interpolated probabilities and back-off weights (discounts D1, D2, D3+ per order; lower orders from continuation
counts). No n-gram is left out, so the model grows with the corpus. It is stored as sorted arrays of hashes with their
values, in blocks of about ``BLOCK_ENTRIES`` entries; a position of a text looks into one block only, that of the two
characters before it, so that a block is all that a worker holds. With one block, documents are scored in one pass;
with more, each block gives partial sums by the hash of the text, and Spark adds them up. All blocks share the entries
of one and two characters, at most as many as there are pairs of characters.

A document's log-perplexity is taken per word: the text's negative log-probability over its words. Bands: per language
(column ``lang``, null being one of its own), over documents that pass the base rules. A mean over n words varies by
about 1/sqrt(n), so a document's distance from the median is taken times the square root of its words, counted up to
the language's ``LONG`` quantile (longer documents differ by their subject however long they are); with the quartiles
of these distances, documents below ``q2 - WIDTH * (q2 - q1)`` or above ``q2 + WIDTH * (q3 - q2)`` are rejected.
For languages whose documents are all but alike, each side is at least ``LEAST_WIDTH``, in nats at one word.

Defined results: a null text has no words and fails the base rules; repeated rows are judged alike; null ``doc_id``
and ``lang`` values are kept as they are; where no document passes the base rules, none is kept; texts are worked on
``SLICE`` characters at a time, whatever their length; an empty table gives an empty table; of clashing names, the
operator's win.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formweave.llm.shared import checkpointed, others, slices, with_small

ORDER = 5
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
WIDTH, LEAST_WIDTH, LONG = 5.0, 5.0, 0.9
#: Characters that are worked on at once, different n-grams that a task holds, and entries of a block of the model.
SLICE, HELD, BLOCK_ENTRIES = 1 << 19, 1 << 19, 1 << 22
#: Fixed value: characters that count as symbols.
MARKS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
#: A text is read as if it followed empty lines.
_BEFORE = "\n" * (ORDER - 1)
_PROBABILITY, _WEIGHT = 1, 2


def _mixed(h: np.ndarray) -> np.ndarray:
    """``h`` with its bits spread, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def hashed(columns: list[np.ndarray], kind: int = _PROBABILITY) -> np.ndarray:
    """A 64-bit hash of each row of characters (one array a place), apart for every kind and length."""
    h = _mixed(np.full(len(columns[0]), kind * 16 + len(columns), np.uint64))
    for c in columns:
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += c
    return _mixed(h)


def _different(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of ``h``, and where in it each different value starts and ends."""
    order = np.argsort(h)
    ranked = h[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(h) else np.zeros(0, np.int64)
    return order, starts, np.append(starts[1:], len(h))


def block_of(first: np.ndarray, second: np.ndarray, n_blocks: int) -> np.ndarray:
    """The block of what follows two characters."""
    return (hashed([first, second], 0) % np.uint64(n_blocks)).astype(np.int64)


@dataclass
class Places:
    """The places of some texts: their characters, each text behind empty lines, as windows of ``ORDER`` characters."""

    x: np.ndarray
    #: The windows that end within a text, and the number of the text that each of these belongs to.
    inside: np.ndarray
    owner: np.ndarray

    def columns(self, order: int, windows: np.ndarray | None = None) -> list[np.ndarray]:
        """The last ``order`` characters of the windows, one array a place."""
        n = len(self.x) - ORDER + 1
        own = [self.x[i : i + n] for i in range(ORDER - order, ORDER)]
        return [c[self.inside] for c in own] if windows is None else [c[windows] for c in own]

    def hashes(self) -> np.ndarray:
        n = len(self.x) - ORDER + 1
        return hashed([self.x[i : i + n] for i in range(ORDER)])[self.inside]

    def windows(self) -> np.ndarray:
        return np.flatnonzero(self.inside)


def _coded(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def places(texts: list[str]) -> Iterator[Places]:
    """Runs of whole texts with about ``SLICE`` characters; a longer text comes alone, piece by piece."""

    def made(run: list[str], first: int) -> Places:
        lengths = np.fromiter(map(len, run), np.int64, len(run))
        x = _coded(_BEFORE + _BEFORE.join(run))
        inside = np.ones(len(x) - ORDER + 1, bool)
        between = np.cumsum(lengths[:-1] + ORDER - 1) - (ORDER - 1)
        for i in range(ORDER - 1):
            inside[between + i] = False
        return Places(x, inside, np.repeat(np.arange(first, first + len(run)), lengths))

    run: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        if run and size + len(t) > SLICE:
            yield made(run, i - len(run))
            run, size = [], 0
        if len(t) <= SLICE:
            run.append(t)
            size += len(t)
            continue
        x = _coded(_BEFORE + t)
        for a in range(0, len(t), SLICE):
            part = x[a : a + SLICE + ORDER - 1]
            n = len(part) - ORDER + 1
            yield Places(part, np.ones(n, bool), np.full(n, i))
        run, size = [], 0
    if run:
        yield made(run, len(texts) - len(run))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of ``window`` words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    code = np.zeros(n, np.uint64)
    for i in range(window):
        code *= np.uint64(0x9E3779B97F4A7C15)
        code += ids[i : i + n]
    ranked = np.sort(code)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0
    _, inverse, times = np.unique(code, return_inverse=True, return_counts=True)
    start = times[inverse] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += start
    edge[window : window + n] -= start
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    chars = len(text) - sum(map(text.count, _SPACE))
    return len(words), chars, len(data) - len(data.translate(None, MARKS.encode())), len(lines) - len(set(lines)), repeated_words(words)


def fails(counts: tuple[int, int, int, int, int]) -> bool:
    return counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]


def count_ngrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """``gram, n`` over all documents that pass the base rules: counted in the tasks, summed by Spark."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, n, grams = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, starts, _ = _different(keys)
        first = order[starts]
        return keys[first], np.add.reduceat(n[order], starts) if len(starts) else n, grams[first]

    def rows(n: np.ndarray, grams: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(n), 1 << 16):
            own = grams[a : a + (1 << 16)]
            joined = own.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            shown = [joined[i : i + ORDER] for i in range(0, len(joined), ORDER)]
            yield pa.RecordBatch.from_arrays([pa.array(shown, pa.string()), pa.array(n[a : a + len(own)])], names=["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, part in slices(v.as_py() for v in batch.column(0)):
                for p in places([t for t in part if not fails(base_counts(t))]):
                    h, windows = p.hashes(), p.windows()
                    order, starts, ends = _different(h)
                    first = order[starts]
                    held = [merged([*held, (h[first], ends - starts, np.stack(p.columns(ORDER, windows[first]), axis=1))])]
                    if len(held[0][0]) > HELD:
                        yield from rows(*held.pop()[1:])
        for own in held:
            yield from rows(*own[1:])

    return docs.select(F.col(text)).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _cut(discounts: list[float]) -> Column:
    return F.when(F.col("n") == 1, discounts[0]).when(F.col("n") == 2, discounts[1]).otherwise(discounts[2])


def _discounts(levels: dict[int, DataFrame]) -> dict[int, list[float]]:
    """Per order: D1, D2 and D3+ from the numbers of n-grams counted once to four times."""
    counts = [df.agg(F.lit(k).alias("k"), *(F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))) for k, df in levels.items()]
    out = {}
    for k, n1, n2, n3, n4 in reduce(DataFrame.unionAll, counts).collect():
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        raw = 1 - 2 * y * n2 / max(n1, 1), 2 - 3 * y * n3 / max(n2, 1), 3 - 4 * y * n4 / max(n3, 1)
        out[k] = [max(0.05, min(d, i * 0.95)) for i, d in enumerate(raw, 1)]
    return out


def entries(counts: DataFrame) -> tuple[DataFrame, float]:
    """``kind, chars, value`` of a model, and the log-probability of a character that was never seen.

    Entries are the log-probabilities of n-grams of each order and the log-weights of their contexts. Tables of the
    lower orders come from the next higher one; contexts and shorter n-grams are met by equi-joins.
    """
    levels = {ORDER: checkpointed(counts)}
    for k in range(ORDER - 1, 0, -1):  # in how many different ways an n-gram is continued to the left
        levels[k] = checkpointed(levels[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")))
    discounts = _discounts(levels)
    cut = _cut(discounts[1])
    total, saved, n_chars = levels[1].agg(F.sum("n"), F.sum(cut), F.count("*")).first()
    unseen = (saved / total if total else 1.0) / ((n_chars or 0) + 1)
    below = levels[1].select("gram", ((F.col("n") - cut) / F.lit(total or 1) + F.lit(unseen)).alias("p"))
    out = [below.select(F.lit(_PROBABILITY).alias("kind"), F.col("gram").alias("chars"), F.log("p").alias("value"))]
    for k in range(2, ORDER + 1):
        cut = _cut(discounts[k])
        context = F.substring("gram", 1, k - 1)
        weights = checkpointed(levels[k].groupBy(context.alias("context")).agg(F.sum("n").alias("total"), (F.sum(cut) / F.sum("n")).alias("weight")))
        rows = levels[k].select("gram", "n", context.alias("context"), F.substring("gram", 2, k - 1).alias("suffix"))
        rows = rows.join(weights, "context").join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        below = checkpointed(rows.select("gram", ((F.col("n") - cut) / F.col("total") + F.col("weight") * F.col("below")).alias("p")))
        out.append(below.select(F.lit(_PROBABILITY).alias("kind"), F.col("gram").alias("chars"), F.log("p").alias("value")))
        out.append(weights.select(F.lit(_WEIGHT).alias("kind"), F.col("context").alias("chars"), F.log("weight").alias("value")))
    return reduce(DataFrame.unionByName, out), math.log(unseen)


@dataclass
class Block:
    """Sorted hashes and their values: one of ``n_blocks`` blocks of a model."""

    keys: np.ndarray
    values: np.ndarray
    unseen: float
    number: int = 0
    n_blocks: int = 1

    def _found(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, asked), max(len(self.keys) - 1, 0))
        return (self.keys[at] == asked, self.values[at]) if len(self.keys) else (np.zeros(len(asked), bool), np.zeros(len(asked)))

    def log_probabilities(self, p: Places, windows: np.ndarray) -> np.ndarray:
        """Of the last characters of windows, backing off where an n-gram is missing."""
        out, left = np.zeros(len(windows)), np.arange(len(windows))
        for order in range(ORDER, 0, -1):
            hit, value = self._found(hashed(p.columns(order, windows[left])))
            out[left[hit]] += value[hit]
            left = left[~hit]
            if not len(left):
                return out
            if order > 1:  # the context's weight, where it was seen
                seen, value = self._found(hashed(p.columns(order, windows[left])[:-1], _WEIGHT))
                out[left[seen]] += value[seen]
        out[left] += self.unseen
        return out

    def sums(self, texts: list[str]) -> np.ndarray:
        """Each text's log-probability, over the places that belong to this block."""
        out = np.zeros(len(texts))
        for p in places(texts):
            h, windows, owner = p.hashes(), p.windows(), p.owner
            if self.n_blocks > 1:
                before = p.columns(3)
                mine = block_of(before[0], before[1], self.n_blocks) == self.number
                h, windows, owner = h[mine], windows[mine], owner[mine]
            order, starts, ends = _different(h)
            logs = np.empty(len(h))
            logs[order] = np.repeat(self.log_probabilities(p, windows[order[starts]]), ends - starts)
            out += np.bincount(owner, logs, len(texts))
        return out


@dataclass
class Model:
    """A table ``block, key, value`` (block -1: in all), for ``n_blocks`` blocks."""

    rows: DataFrame
    unseen: float
    n_blocks: int

    def block(self, number: int) -> Block:
        """A block's arrays; its size is bounded by ``BLOCK_ENTRIES`` on average."""
        own = self.rows.where(F.col("block").isin(number, -1)).select("key", "value").toArrow()
        keys, values = own.column("key").to_numpy().view(np.uint64), own.column("value").to_numpy()
        order = np.argsort(keys)
        return Block(keys[order], values[order], self.unseen, number, self.n_blocks)


def train(docs: DataFrame, text: str = "text", block_entries: int = BLOCK_ENTRIES) -> Model:
    found, unseen = entries(count_ngrams(docs, text))
    found = checkpointed(found)
    n_blocks = max(1, -(-found.count() // block_entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, value = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            chars = np.array(batch.column(1).to_pylist(), object)
            size = np.fromiter(map(len, chars), np.int64, len(chars))
            for a, n in sorted(set(zip(kind.tolist(), size.tolist(), strict=True))):
                own = np.flatnonzero((kind == a) & (size == n))
                x = np.frombuffer("".join(chars[own]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
                columns = [x[:, i] for i in range(n)]
                before = columns if a == _WEIGHT else columns[:-1]
                block = block_of(before[-2], before[-1], n_blocks) if len(before) > 1 else np.full(len(own), -1)
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(hashed(columns, a).view(np.int64)), pa.array(value[own].astype(np.float32))], names=["block", "key", "value"])

    return Model(checkpointed(found.mapInArrow(run, "block int, key long, value float")), unseen, n_blocks)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _summed(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """``__h0, __h1, __sum``: the log-probability of every different text, block by block."""
    parts = []
    for number in range(model.n_blocks):
        shared = docs.sparkSession.sparkContext.broadcast(model.block(number))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, part in slices(v.as_py() for v in batch.column(0)):
                    h = _text_hashes(part)
                    yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(shared.value.sums(part))], names=["__h0", "__h1", "__sum"])

        parts.append(checkpointed(docs.select(F.col(text)).mapInArrow(run, "__h0 long, __h1 long, __sum double").groupBy("__h0", "__h1").agg(F.max("__sum").alias("__sum"))))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts).groupBy("__h0", "__h1").agg(F.sum("__sum").alias("__sum"))


def _text_hashes(texts: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts), "<i8").reshape(-1, 2).copy()


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the base counts, ``base_failed`` and ``log_perplexity`` (null without words)."""
    made = (*_COUNTS, "base_failed", "log_perplexity")
    keep = others(docs, *made, "kept")
    rest = [c for c in keep if c != text]
    one = docs.sparkSession.sparkContext.broadcast(model.block(0)) if model.n_blocks == 1 else None
    found = ("__sum",) if one else ("__h0", "__h1")
    schema = T.StructType(
        [docs.schema[c] for c in rest] + [T.StructField(c, T.LongType()) for c in _COUNTS] + [T.StructField("base_failed", T.BooleanType())]
        + [T.StructField(c, T.DoubleType() if one else T.LongType()) for c in found]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(v.as_py() for v in batch.column(keep.index(text))):
                counts = [base_counts(t) for t in part]
                more = [pa.array(one.value.sums(part))] if one else [pa.array(x) for x in _text_hashes(part).T.copy()]
                own = [batch.column(keep.index(c)).slice(start, len(part)) for c in rest]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True)), pa.array(list(map(fails, counts))), *more], names=schema.names)

    rows = docs.select(*keep).mapInArrow(run, schema)
    if not one:
        rows = rows.join(_summed(docs, model, text), ["__h0", "__h1"])
    per_word = F.when(F.col("n_words") > 0, F.round(-F.col("__sum") / F.col("n_words"), 6))
    return rows.withColumn("log_perplexity", per_word).select(*rest, *made)


def _distance() -> Column:
    """The distance from the median log-perplexity ``__mid``, in nats at one word."""
    return (F.col("log_perplexity") - F.col("__mid")) * F.sqrt(F.least("n_words", "__most").cast("double"))


def bands(scored: DataFrame, lang: str = "lang") -> DataFrame:
    """``__of, __mid, __most, __low, __high``: a language's median, its cap of words, and the distances between which documents are kept."""
    good = scored.where(~F.col("base_failed"))
    mids = checkpointed(good.groupBy(F.col(lang).alias("__of")).agg(F.percentile_approx("log_perplexity", 0.5, 5000).alias("__mid"), F.percentile_approx("n_words", LONG, 5000).alias("__most")))
    q = F.percentile_approx(_distance(), [0.25, 0.5, 0.75], 5000)
    rows = with_small(good, mids, lang, "__of").groupBy("__of", "__mid", "__most").agg(q.alias("q"))
    q1, q2, q3 = (F.col("q")[i] for i in range(3))
    return rows.select("__of", "__mid", "__most", (q2 - F.greatest(WIDTH * (q2 - q1), F.lit(LEAST_WIDTH))).alias("__low"), (q2 + F.greatest(WIDTH * (q3 - q2), F.lit(LEAST_WIDTH))).alias("__high"))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """``docs`` without its text, with the base counts, ``base_failed``, ``log_perplexity`` and ``kept``."""
    scored = checkpointed(score(docs, train(docs, text, block_entries), text))
    rows = with_small(scored, checkpointed(bands(scored.select(F.col(lang), "base_failed", "log_perplexity", "n_words"), lang)), lang, "__of")
    kept = ~F.col("base_failed") & F.coalesce(_distance().between(F.col("__low"), F.col("__high")), F.lit(False))
    return rows.withColumn("kept", kept).drop("__of", "__mid", "__most", "__low", "__high")
