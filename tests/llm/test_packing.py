import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from formweave.llm import packing


def test_pieces_hold_each_document_once(docs):
    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs, sequence=64, with_ids=True).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d in docs.collect():
        ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert [i for r in own for i in r.ids] == ids
        assert all(r.piece == k and r.start == 64 * k and r.length == len(r.ids) for k, r in enumerate(own))
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
        assert all(r.length == 64 for r in own[:-1])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.02 * sum(r.length for r in rows) / 64 + 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    moves = packing.plan(histogram, 40)
    used, ranks = {}, {}
    for length, rank, number, first, offset in moves.tolist():
        for i in range(number):
            used.setdefault(first + i, []).append((offset, length))
            ranks.setdefault(length, []).append(rank + i)
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    for s in used.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 40
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(40 - n)
    assert len(used) <= len(gaps)
    assert sorted(sum(x for _, x in s) for s in used.values()) == sorted(40 - g for g in swept(lengths, 40) if g < 40)


def swept(lengths, size):
    """What remains of each gap, piece by piece: sweeps over the longest pieces left, each gap of the successor size taking one."""
    gaps = []
    for n in sorted(set(lengths), reverse=True):
        left = lengths.count(n)
        while left:
            fit = [g for g in gaps if g >= n]
            if not fit:
                gaps += [size] * -(-left // (size // n))
                continue
            own = [i for i, g in enumerate(gaps) if g == min(fit)][:left]
            for i in own:
                gaps[i] -= n
            left -= len(own)
    return gaps


def test_whole_placement_against_sweeps_by_piece(docs):
    rows = packing.pack(docs.repartition(7), sequence=64).collect()
    filled = {}
    for r in rows:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert sorted(filled.values()) == sorted(64 - g for g in swept([r.length for r in rows], 64))
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_a_very_long_text_and_hot_lengths(spark):
    texts = ["word " * 30_000, *["same text"] * 500, *["other, text"] * 300, "x" * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(9)
    rows = packing.pack(df).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and {r.doc_id for r in rows} == set(range(len(texts)))
    assert len({r.sequence_id for r in rows}) == -(-sum(r.length for r in rows) // 2048)


def test_odd_tables(spark, empty):
    assert packing.pack(empty).collect() == []
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "a <|endoftext|> b c d é", 3)], "doc_id long, text string, length long")
    rows = packing.pack(odd).collect()
    assert sorted(r.length for r in rows)[:3] == [1, 1, 1] and len({r.sequence_id for r in rows}) == 1
    ids = Tokenizer.from_file(packing.default_tokenizer()).encode("a <|endoftext|> b c d é", add_special_tokens=False).ids
    assert max(rows, key=lambda r: r.length).ids_crc32 == zlib.crc32(np.array([*ids, 0], "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.characters(codec="utf-8"), max_size=30), st.text("abcdefghimnorstuyABCDEéèüñßØÿ.,'!#-|$ \n", max_size=60), st.text("etaoinshrdlu", min_size=1, max_size=25))))
def test_chunks_give_the_tokenizers_ids(texts):
    encode = packing._TOKENIZERS.setdefault("test", packing.ChunkTokenizer(packing.default_tokenizer())) if "test" not in packing._TOKENIZERS else packing._TOKENIZERS["test"]
    found = [np.frombuffer(x, np.uint32).tolist() for x in encode(texts)]
    assert found == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_random_letters():
    encode = packing.ChunkTokenizer(packing.default_tokenizer())
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéèäöüßñçà"), rng.integers(1, 20))) for _ in range(30_000)]
    fast = encode.codec(words)
    assert fast == encode._plain(words)
