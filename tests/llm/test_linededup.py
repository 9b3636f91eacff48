import hashlib

import numpy as np
from pyspark.sql import functions as F

from formweave.llm import linededup

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, least):
    held, keys = {}, []
    for text in rows:
        lines = (text or "").split("\n")
        own = [x.strip(BLANKS).encode().lower() for x in lines]
        keys.append((lines, own))
        for k in set(own):
            held[k] = held.get(k, 0) + 1
    return [(len(lines), sum(1 for k in own if k and held[k] >= least), "\n".join(x for x, k in zip(lines, own) if not k or held[k] < least)) for lines, own in keys]


def result(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in df.collect()}


def expected(docs, least=10):
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    return {r.doc_id: x for r, x in zip(rows, brute([r.text for r in rows], least), strict=True)}


def same(found, wanted):
    assert {k: (a, b, c or "") for k, (a, b, c) in found.items()} == wanted


def test_against_brute_force(docs):
    same(result(linededup.dedup_lines(docs)), expected(docs))
    same(result(linededup.dedup_lines(docs, 2)), expected(docs, 2))


def test_way_without_broadcast(docs):
    index = linededup.LineIndex.build(docs, 2)
    same(result(index.apply(docs, broadcast_bytes=-1)), expected(docs, 2))  # a block for every shard
    same(result(index.apply(docs, broadcast_bytes=100)), expected(docs, 2))
    assert 1 < len(index._blocks(index.filters, 100)) < index.filters.count()
    # a filter that holds nothing lets no line through to the exact keys
    empty = index.filters.withColumn("slots", F.lit(bytes(8))).withColumn("n_buckets", F.lit(1))
    for most in (-1, 1 << 30):
        assert sum(x[1] for x in result(linededup.LineIndex(index.refcounts, empty, 2).apply(docs, broadcast_bytes=most)).values()) == 0


def test_shards_grow_with_keys(docs, monkeypatch):
    monkeypatch.setattr(linededup, "SHARDS", 2)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 8)
    index = linededup.LineIndex.build(docs.where("doc_id % 4 = 0"), 2)
    grown = index.insert(docs.where("doc_id % 4 <> 0"))
    assert 2 <= index.n_shards < grown.n_shards
    for most in (-1, 1 << 30):
        same(result(grown.apply(docs, broadcast_bytes=most)), expected(docs, 2))


def test_deletion_before_insertion(docs):
    some = docs.where("doc_id % 3 = 0")
    index = linededup.LineIndex.build(docs, 3)
    back = index.delete(some).delete(some).insert(some).insert(some)
    assert sorted(map(tuple, back.refcounts.collect())) == sorted(map(tuple, index.refcounts.collect()))
    same(result(back.apply(docs)), expected(docs, 3))


def test_deletion_undoes_insertion(docs):
    first, more = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    index = linededup.LineIndex.build(first, 3)
    grown = index.insert(more)
    same(result(grown.apply(docs)), expected(docs, 3))
    back = grown.delete(more)
    assert sorted(map(tuple, back.refcounts.collect())) == sorted(map(tuple, index.refcounts.collect()))
    assert sorted(bytes(r["keys"]) for r in back.filters.collect()) == sorted(bytes(r["keys"]) for r in index.filters.collect())
    same(result(back.apply(first)), expected(first, 3))


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys, rest = rng.integers(-(2**62), 2**62, (3000, 2)), rng.integers(-(2**62), 2**62, (20000, 2))
    cuckoo = linededup.Cuckoo.for_keys(keys)
    assert cuckoo.contains(keys).all() and cuckoo.contains(rest).mean() < 0.002
    for k in keys[:1500]:
        assert cuckoo.delete(k)
    assert cuckoo.contains(keys[1500:]).all() and cuckoo.contains(keys[:1500]).mean() < 0.01


def test_odd_tables(spark, empty):
    assert linededup.dedup_lines(empty).collect() == []
    odd = spark.createDataFrame([(None, "a", 1), (None, "a", 2), (3, None, 3), (3, None, 3), (4, "", 5)], "doc_id long, text string, n_lines long")
    found = linededup.dedup_lines(odd, 2)
    assert found.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert sorted((r.text, r.n_lines, r.n_dropped) for r in found.collect()) == [("", 1, 0)] * 3 + [("", 1, 1)] * 2


def test_query_hash(docs):
    from formweave.llm import queries

    df = linededup.dedup_lines(docs).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    wanted = {k: hashlib.sha256(v[2].encode()).hexdigest() for k, v in expected(docs).items()}
    assert {r.doc_id: r.h for r in df.collect()} == wanted
    assert "op9_line_dedup" in queries.queries()


def test_a_full_cuckoo_filter_stays_as_it_was():
    keys = np.random.default_rng(2).integers(-(2**62), 2**62, (40, 2))
    cuckoo = linededup.Cuckoo(4)
    held = []
    for k in keys:
        before = cuckoo.table.copy()
        if cuckoo.insert(k):
            held.append(k)
        else:
            assert (cuckoo.table == before).all()
    assert 12 <= len(held) <= 16 and cuckoo.contains(np.array(held)).all()
