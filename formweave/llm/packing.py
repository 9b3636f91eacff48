"""Best-fit packing of tokenized documents into sequences of bounded length.

Documents become pieces of at most ``SEQUENCE`` tokens (only longer ones are cut). Pieces and gaps are both ordered by
size, and matched in bulk-synchronous sweeps: in a sweep, all pieces of the longest size left meet their successor,
the smallest gap that holds them; pieces that want the same gaps are settled by rank (the r-th piece takes the r-th
gap); the gaps shrink; and the sweep repeats. Sizes are integers up to ``SEQUENCE``, so the ordered pieces are runs
of equal size, and a sweep works on whole runs: what the driver handles is a histogram of at most ``SEQUENCE``
numbers, whatever the number of documents.

A piece's rank among those of its length is its place in its task plus the pieces of that length in the tasks before.
Tasks number their pieces as they cut them, and Spark adds up the counts, one row per task and length: pieces are
neither shuffled nor sorted. Each piece then finds its sequence by its rank in the plan of the sweeps.

Defined results: a null or empty text is one piece that holds the end id alone; repeated rows are packed each; null
``doc_id`` values pass through; an empty table gives an empty table. Only ``doc_id`` and the text are read, so other
columns do not matter.
"""

from __future__ import annotations

import array
import bisect
import json
import os
import re
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formweave.llm.shared import SMALL_ROWS, checkpointed, slices

SEQUENCE = 2048
END_ID = 0
#: Chunks of text whose ids a worker remembers, and the longest remembered.
REMEMBERED, REMEMBERED_CHARS = 150_000, 40
_BLANK = re.compile("[ \t\r\n]+")
#: What Python takes for white space and the tokenizer does not.
_SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")
#: A word of Latin letters that lower-casing maps one to one, and marks behind it that are no apostrophe.
_WORD_AND_MARKS = re.compile(r"""([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#$%&*()"\-]*)""")


class WordCodec:
    """Ids of single lower-case words under a byte-level BPE whose words end in a marked symbol.

    The tokenizer's merges are given to a faster encoder as ranks: the mark becomes a zero byte that joins its letter
    before all other merges, so that many words can be encoded in one call and told apart by their last ids.
    """

    def __init__(self, spec: dict):
        import tiktoken

        vocab, mark = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        byte = {c: b for b, c in shown.items()}
        ranks = {bytes([b]): vocab[shown[b]] for b in range(256)}
        ranks |= {bytes([b, 0]): vocab[shown[b] + mark] for b in range(1, 256)}
        for merge in spec["model"]["merges"]:
            token = "".join(merge.split(" ") if isinstance(merge, str) else merge)
            ranks.setdefault(bytes(byte[c] for c in token.removesuffix(mark)) + b"\0" * token.endswith(mark), vocab[token])
        self.ids = np.array(list(ranks.values()), np.uint32)
        self.ends = np.array([len(b) > 1 and b.endswith(b"\0") for b in ranks])
        self.encoder = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks={b: i for i, b in enumerate(ranks)}, special_tokens={})

    @staticmethod
    def suits(spec: dict) -> bool:
        """Whether the tokenizer is one that this stands for: lower case, split at letters, ends marked."""
        model, first = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers") or []]
        return model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and steps == ["NFC", "Replace", "Lowercase"] and r"[\p{L}]+" in str((first[0].get("pattern") or {}).get("Regex"))

    def __call__(self, words: list[str]) -> list[bytes]:
        at = np.array(self.encoder.encode_ordinary("\0".join(words) + "\0"), np.int64)
        cuts, ids = ((np.flatnonzero(self.ends[at]) + 1) * 4).tolist(), self.ids[at].tobytes()
        return [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


class ChunkTokenizer:
    """Ids of whole texts, by way of remembered ids of the chunks between blanks.

    Right for tokenizers that split at white space and drop it, as the default one does. New chunks that are one Latin
    word, with or without marks behind it, go through ``WordCodec`` where it suits the tokenizer, others through the
    tokenizer itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads here
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer, self.known, self.marks = Tokenizer.from_file(path), {}, {"": b""}
        self.codec = WordCodec(spec) if WordCodec.suits(spec) else None

    def _plain(self, chunks: list[str]) -> list[bytes]:
        return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _ids(self, chunks: list[str]) -> dict[str, bytes]:
        simple = [(c, m) for c in chunks if (m := _WORD_AND_MARKS.fullmatch(c))] if self.codec else []
        words = self.codec([m[1].lower() for _, m in simple]) if simple else []
        marks = list({m[2] for _, m in simple if m[2] not in self.marks})
        self.marks.update(zip(marks, self._plain(marks), strict=True))
        out = {c: w + self.marks[m[2]] for (c, m), w in zip(simple, words, strict=True)}
        other = [c for c in chunks if c not in out]
        return out | dict(zip(other, self._plain(other), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers in the machine's order."""
        split = [t.split() if not any(c in t for c in _SEPARATORS) else _BLANK.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if len(self.marks) > REMEMBERED:
            self.marks = {"": b""}
        known = self.known
        new = list(set(chain.from_iterable(split)).difference(known))
        known |= self._ids(new)
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        for c in new:
            if len(c) > REMEMBERED_CHARS:
                del known[c]
        return out


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, text: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, place`` (and ``ids`` on demand) of every document.

    ``place`` counts the pieces of a length within the task ``part``, from 0.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, ChunkTokenizer(path))
        end = np.array([END_ID], "<u4").tobytes()
        part_id, seen = TaskContext.get().partitionId(), [0] * (sequence + 1)
        for batch in batches:
            for start, part in slices((v.as_py() for v in batch.column(1)), 1 << 18):
                row, piece, at, length, crc, place, ids = [], [], [], [], [], [], []
                for i, own in enumerate(encode(part)):
                    own = (own if sys.byteorder == "little" else np.frombuffer(own, ">u4").astype("<u4").tobytes()) + end
                    for k, a in enumerate(range(0, len(own), 4 * sequence)):
                        cut = own[a : a + 4 * sequence]
                        row.append(start + i)
                        piece.append(k)
                        at.append(a // 4)
                        n = len(cut) // 4
                        length.append(n)
                        place.append(seen[n])
                        seen[n] += 1
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(np.frombuffer(cut, "<u4").astype(np.int32))
                arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (at, length, crc)), pa.array([part_id] * len(row), pa.int32()), pa.array(place, pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place", *(["ids"] if with_ids else [])])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.col(text)).mapInArrow(run, schema)


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> np.ndarray:
    """Rows (length, first rank, number, first sequence, offset): where the ranked pieces of each length go.

    ``histogram`` has the number of pieces of each length. Best fit, longest first, on runs of equal size.
    """
    sizes: list[int] = []  # gap sizes that there are, ascending
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # runs (first sequence, number) of each gap size
    out, opened = [], 0

    def put(size: int, first: int, number: int) -> None:
        if not gaps[size]:
            bisect.insort(sizes, size)
        gaps[size].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):
                number = -(-left // (sequence // length))
                put(sequence, opened, number)
                opened += number
                continue
            size = sizes.pop(at)
            runs, gaps[size] = gaps[size], []
            for first, number in runs:  # the r-th piece takes the r-th gap
                taken = min(number, left)
                if taken:
                    out.append((length, rank, taken, first, sequence - size))
                    if size > length:
                        put(size - length, first, taken)
                if taken < number:
                    put(size, first + taken, number - taken)
                rank += taken
                left -= taken
    return np.array(out, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, text: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """Every piece with ``sequence_id`` and ``offset``; pieces of a sequence follow each other without gaps."""
    cut = checkpointed(pieces(docs, text, tokenizer, sequence, with_ids))  # places must not change when a task is run again
    counts = checkpointed(cut.groupBy("length", "part").agg(F.count("*").alias("n")))  # a row per task and length
    moves = plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, sequence)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    before = checkpointed(counts.select("length", "part", before.alias("before")))
    ranked = cut.join(F.broadcast(before) if before.count() <= SMALL_ROWS else before, ["length", "part"])
    # a plan's rows are at most the pairs of piece size and gap size that meet, so bounded by the sequence length
    shared = docs.sparkSession.sparkContext.broadcast(moves)
    names = [c for c in cut.columns if c not in ("part", "place")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = shared.value
        base = int(moves[:, 1].max(initial=0) + moves[:, 2].max(initial=0)) + 1
        starts = moves[:, 0] * base + moves[:, 1]
        order = np.argsort(starts, kind="stable")
        starts, ordered = starts[order], moves[order]
        for batch in batches:
            length, rank = batch.column(len(names) - 1).to_numpy(), batch.column(len(names)).to_numpy()
            move = ordered[np.searchsorted(starts, length * base + rank, "right") - 1]
            arrays = [batch.column(names_at[c]) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(move[:, 3] + rank - move[:, 1]), pa.array(move[:, 4])], names=[*names, "sequence_id", "offset"])

    asked = [c for c in names if c != "length"]
    names_at = {c: i for i, c in enumerate([*asked, "length"])}
    schema = ", ".join(f"{n} {k}" for n, k in cut.dtypes if n in names) + ", sequence_id long, offset long"
    return ranked.select(*asked, "length", (F.col("place") + F.col("before")).alias("rank")).mapInArrow(run, schema.replace("offset", "`offset`"))
