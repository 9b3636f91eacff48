import re

import numpy as np
import xxhash

from formweave.llm import simhash


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids):
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(least.get(top(i), d), d)
    return [least[top(i)] for i in range(len(prints))]


def test_query_against_brute_force(docs):
    rows = docs.collect()
    prints = [brute_print(r.text) for r in rows]
    comps = brute_components(prints, [r.doc_id for r in rows])
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(rows, prints, comps, strict=True)}


def test_components_of_fingerprints(spark):
    rng = np.random.default_rng(5)
    prints = []
    for _ in range(60):
        base = int(rng.integers(0, 2**63))
        for _ in range(6):
            prints.append(base)
            for bit in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                base ^= 1 << int(bit)
    prints = sorted(set(prints))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    found = {r.fp: r.label for r in simhash.fingerprint_components(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    comps = brute_components(prints, list(range(len(prints))))
    groups, wanted = {}, {}
    for p, c in zip(signed, comps, strict=True):
        wanted.setdefault(c, set()).add(p)
        groups.setdefault(found[p], set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_one_of_each_group_stays(docs):
    rows = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    kept = [r.doc_id for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(kept) == sorted(set(rows.values()))


def test_odd_tables(spark, empty):
    assert simhash.near_duplicates(empty).collect() == []
    odd = spark.createDataFrame([(None, None, 1), (5, "", 2), (7, "a b c d", 3), (7, "a b c d", 3), (9, "A  b\tC d", 4)], "doc_id long, text string, fp long")
    found = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert found == [(0, 5), (5, 5), (7, 7), (7, 7), (9, 7)]
    assert sorted(r.doc_id or 0 for r in simhash.drop_near_duplicates(odd).collect()) == [5, 7]
    alone = spark.createDataFrame([(None, "x y z one two", 1), (None, "x y z one two", 1), (3, "p q r s t", 2), (3, "quite other words than those", 2)], "doc_id long, text string, fp long")
    assert sorted((r.doc_id or 0, r.text[:1]) for r in simhash.drop_near_duplicates(alone).collect()) == [(0, "x"), (3, "p"), (3, "q")]


def test_large_buckets_are_split(spark):
    rng = np.random.default_rng(8)
    half = int(rng.integers(0, 2**32))
    near = [(half ^ (1 << int(rng.integers(0, 4))) * int(rng.integers(0, 2))) << 32 | int(x) for x in rng.integers(0, 2**15, 1200) * 2**11]
    prints = sorted({p - 2**64 if p >= 2**63 else p for p in near})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    assert simhash._hot(df, 64).agg({"n_own": "max", "n_other": "max"}).first()[0] > 4
    split, whole = ({r.fp: r.label for r in simhash.fingerprint_components(df, n).collect()} for n in (64, 1 << 20))
    comps = brute_components([p % 2**64 for p in prints], list(range(len(prints))))
    assert len(set(comps)) > 1
    for found in (split, whole):
        assert len({(found[p], c) for p, c in zip(prints, comps, strict=True)}) == len(set(comps)) == len(set(found.values()))
