"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's non-letters become single spaces, letters are lower-cased, and its UTF-8 bytes give all n-grams of 2 to 4
bytes, hashed into ``BUCKETS``. Their embeddings are averaged and a linear layer scores the languages. Embeddings and
layer are trained together in numpy by stochastic gradient descent on a bounded sample of labelled rows (whole texts,
drawn by hash): about ``SAMPLE_ROWS``, and ``LANGUAGE_ROWS`` of each language at least, with expected features of
``SAMPLE_BYTES`` at most. A part of the sample is held back, and on it the softmax temperature is fitted.

Rejection is calibrated on the held part too. A softmax over known languages is often sure of an unknown one, so a
text is also held against its predicted language: the mean log-frequency of its n-grams in that language's sample,
whose distance from the language's median shrinks as 1/sqrt(n), is taken times sqrt(n); n counts up to ``typical``,
the held documents' median, as long documents differ by their subject however long they are. Documents whose distance
is further below the median than ``REJECT_WIDTH`` quartile distances of the held documents are rejected, as are those
whose confidence is below that which ``REJECT_SHARE`` of the held documents fall short of (0.5 at most).

At scoring time embeddings and layer are multiplied out, so that a text's score is the mean of table rows. Texts of
more than ``LONG`` bytes are counted into buckets piece by piece, whatever their length.

Defined results: a null text, or one without letters, is ``und`` with score 0 and rejected; rows with null language
teach nothing; without any labelled row everything is ``und``; rows with null ``doc_id`` are scored like others;
repeated rows get equal results; an empty table gives an empty table. Input columns pass through; on a name clash
``lang_pred``, ``score`` and ``rejected`` replace the input's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formweave.llm.shared import others, slices

BUCKETS = 1 << 16
DIMENSIONS = 16
GRAMS = (2, 3, 4)
#: Expected number of labelled rows in the training sample.
SAMPLE_ROWS = 3000
#: Expected number of rows of each language in the sample at least, or all of its rows.
LANGUAGE_ROWS = 300
#: Bytes of features in the sample, as expected from the texts' lengths.
SAMPLE_BYTES = 256 << 20
LONG = 1 << 20
EPOCHS = 6
RATE = 0.5
REJECT_SHARE, REJECT_WIDTH = 0.001, 60.0
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def _letters(text: str) -> bytes:
    """Lower-case letters with single spaces between and around; empty without letters."""
    bare = _NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {bare} ".encode("utf-8", "surrogatepass") if any(map(str.isalpha, bare)) else b""  # not for ² or ½ alone


def _hashes(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at each place."""
    size = len(data) - n + 1
    h = np.full(size, n, np.uint32)
    for i in range(n):
        h *= np.uint32(0x01000193)
        h ^= data[i : i + size]
    h *= np.uint32(0x9E3779B1)
    return (h >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1)


def _gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams, and how many fall into each."""
    data = np.frombuffer(_letters(text), np.uint8)
    if len(data) <= 1 << 14:
        found = [_hashes(data, n) for n in GRAMS if len(data) >= n]
        return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    counts = np.zeros(BUCKETS, np.int64)
    for n in GRAMS:
        for a in range(0, len(data) - n + 1, LONG):
            counts += np.bincount(_hashes(data[a : a + LONG + n - 1], n), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    langs: list[str]
    #: Score of each bucket for each language, one row a language.
    table: np.ndarray
    temperature: float
    threshold: float
    #: Log-frequency of each bucket in each language, and per language: median, and the least distance that is kept.
    frequency: np.ndarray
    median: np.ndarray
    least: np.ndarray
    #: n-grams up to which a text's distance counts as more certain.
    typical: float

    def judged(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's best language, its calibrated probability (0 without letters), and whether it is rejected."""
        best, sure, far = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
        clean = [_letters(t) for t in texts]
        short = [i for i, c in enumerate(clean) if len(c) <= LONG]
        self._short([clean[i] for i in short], short, best, sure, far)
        for i in sorted(set(range(len(texts))).difference(short)):
            at, n = _gram_counts(texts[i])
            p = _softmax(self.table[:, at].astype(np.float64) @ n / n.sum() / self.temperature)
            best[i], sure[i] = p.argmax(), p.max()
            far[i] = (self.frequency[best[i], at].astype(np.float64) @ n / n.sum() - self.median[best[i]]) * np.sqrt(min(n.sum(), self.typical))
        sure = np.round(sure, 6)
        return best, sure, (sure < self.threshold) | (sure == 0) | (far < self.least[best])

    def _short(self, clean: list[bytes], own: list[int], best: np.ndarray, sure: np.ndarray, far: np.ndarray) -> None:
        lengths = np.fromiter(map(len, clean), np.int64, len(clean))
        ends = np.cumsum(lengths)
        starts, data = ends - lengths, np.frombuffer(b"".join(clean), np.uint8)
        total, n_grams, met = np.zeros((len(clean), len(self.langs))), np.zeros(len(clean)), []
        for n in GRAMS:
            has = np.flatnonzero(lengths >= n)
            if not len(has):
                continue
            at = _hashes(data, n)
            cuts = np.stack([starts[has], ends[has] - n + 1], axis=1).reshape(-1)
            cuts = cuts[:-1] if cuts[-1] >= len(at) else cuts
            for k in range(len(self.langs)):
                total[has, k] += np.add.reduceat(self.table[k][at].astype(np.float64), cuts)[::2]
            n_grams[has] += lengths[has] - n + 1
            met.append((has, at, cuts, n))
        some = np.flatnonzero(n_grams > 0)
        if not len(some):
            return
        p = _softmax(total[some] / n_grams[some, None] / self.temperature)
        mine = np.asarray(own)[some]
        best[mine], sure[mine] = p.argmax(axis=1), p.max(axis=1)
        language, logs = np.zeros(len(clean), np.int64), np.zeros(len(clean))
        language[some] = p.argmax(axis=1)
        for has, at, cuts, _ in met:
            of = np.repeat(language * BUCKETS, lengths)[: len(at)]
            logs[has] += np.add.reduceat(self.frequency.reshape(-1)[of + at].astype(np.float64), cuts)[::2]
        far[mine] = (logs[some] / n_grams[some] - self.median[language[some]]) * np.sqrt(np.minimum(n_grams[some], self.typical))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model:
    """A model from (language, buckets, counts) of each labelled text."""
    langs = sorted({r[0] for r in rows})
    if not rows:
        return Model([], np.zeros((0, BUCKETS), np.float32), 1.0, 0.0, np.zeros((0, BUCKETS), np.float32), np.zeros(0), np.zeros(0), 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    n_held = len(rows) // 5
    held, learn = order[:n_held], order[n_held:]
    label = np.array([langs.index(r[0]) for r in rows])
    weight = len(learn) / (len(langs) * np.maximum(np.bincount(label[learn], minlength=len(langs)), 1))
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    layer, seen = np.zeros((DIMENSIONS, len(langs))), np.zeros(BUCKETS, bool)
    steps, step = max(1, EPOCHS * len(learn)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn).tolist():
            _, at, n = rows[i]
            share = n / n.sum()
            mean = share @ vectors[at]
            error = _softmax(mean @ layer)
            error[label[i]] -= 1
            error *= RATE * (1 - step / steps) * min(weight[label[i]], 5.0)
            back = layer @ error
            layer -= np.outer(mean, error)
            vectors[at] -= np.outer(share * min(len(at), 256), back)
            seen[at] = True
            step += 1
    vectors[~seen] = 0  # n-grams that were never seen say nothing
    table = (vectors @ layer).T.astype(np.float32)
    score = np.array([table[:, rows[i][1]] @ (rows[i][2] / rows[i][2].sum()) for i in (held if n_held else learn)])
    truth = label[held if n_held else learn]
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(_softmax(score / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(score / temperature)
    frequency, median, least, typical = _typical(rows, label, learn, held if n_held else learn, p.argmax(axis=1), len(langs))
    return Model(langs, table, temperature, float(min(0.5, np.quantile(p.max(axis=1), REJECT_SHARE))), frequency, median, least, typical)


def _typical(rows: list[tuple[str, np.ndarray, np.ndarray]], label: np.ndarray, learn: np.ndarray, held: np.ndarray, predicted: np.ndarray, n_langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Log-frequencies by language, and from held documents medians, the least distances that are kept, and the typical length."""
    counts = np.zeros((n_langs, BUCKETS))
    for i in learn.tolist():
        counts[label[i], rows[i][1]] += rows[i][2]
    frequency = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)
    n = np.array([rows[i][2].sum() for i in held])
    mean = np.array([frequency[k, rows[i][1]].astype(np.float64) @ rows[i][2] for i, k in zip(held.tolist(), predicted.tolist(), strict=True)]) / n
    middle = lambda own: np.median(mean[own]) if own.any() else 0.0
    median = np.array([middle(predicted == k) for k in range(n_langs)])
    typical = float(np.median(n))
    far = (mean - median[predicted]) * np.sqrt(np.minimum(n, typical))
    least = np.full(n_langs, -np.inf)
    for k in range(n_langs):
        own = far[predicted == k] if (predicted == k).sum() >= 20 else far  # too few to tell: by all languages
        if len(own) >= 20:
            q1, q2 = np.quantile(own, [0.25, 0.5])
            least[k] = q2 - REJECT_WIDTH * max(q2 - q1, 0.5)
    return frequency, median, least, typical


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model learned from about ``sample_rows`` rows for which ``learn`` holds and text and language are not null.

    Languages of which these would be fewer than ``LANGUAGE_ROWS`` add rows up to that number.
    """
    usable = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    size = F.least(F.lit(6 * BUCKETS), 18 * (F.octet_length(F.col(text)) + 2))  # of a text's features, at most
    per = usable.groupBy(F.col(lang).cast("string").alias("own")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()  # one row a language
    n = sum(r["n"] for r in per)
    if not n:
        return fit([])
    drawn = F.pmod(F.xxhash64("doc_id", F.col(text)), F.lit(1 << 50))  # fine enough for 10**14 rows
    shares = {r["own"]: min(1.0, max(sample_rows / n, LANGUAGE_ROWS / r["n"])) for r in per}
    fits = min(1.0, sample_bytes / max(1.0, sum(shares[r["own"]] * r["bytes"] for r in per)))
    bound = F.create_map(*[F.lit(x) for own, share in shares.items() for x in (own, int(share * fits * (1 << 50)))])
    picked = usable.where(drawn < F.element_at(bound, F.col(lang).cast("string")))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, value in zip(batch.column(0), batch.column(1), strict=True):
                at, n = _gram_counts(value.as_py() or "")
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([own.as_py()]), pa.array([at.astype("<u2").tobytes()]), pa.array([n.astype("<u4").tobytes()])], names=["lang", "at", "n"])

    rows = picked.select(F.col(lang).cast("string"), text).mapInArrow(features, "lang string, at binary, n binary").collect()
    rows = sorted((r.lang, bytes(r.at), bytes(r.n)) for r in rows)  # the order of partitions does not matter
    return fit([(x, np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(n, "<u4").astype(np.float64)) for x, at, n in rows])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats a language
    keep = others(docs, "lang_pred", "score", "rejected")
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for start, part in slices(v.as_py() for v in batch.column(keep.index(text))):
                best, sure, odd = m.judged(part) if m.langs else (np.zeros(len(part), np.int64), np.zeros(len(part)), np.ones(len(part), bool))
                names = [m.langs[b] if s > 0 else "und" for b, s in zip(best.tolist(), sure.tolist(), strict=True)]
                cut = batch.slice(start, len(part))
                arrays = [*cut.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64()), pa.array(odd)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "lang_pred", "score", "rejected"])

    return docs.select(*keep).mapInArrow(run, schema)
