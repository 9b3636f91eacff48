import random
import re

from formweave.llm import mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets(spark):
    rng = random.Random(2)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 5, 100, 1000, 40000]) for s in ["a", "b", "ä", "Z", "c", None][: rng.randint(1, 6)]}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: r.target for r in mixing.targets(df).collect()}
        wanted = brute_targets(sizes)
        assert found.keys() == wanted.keys()
        assert all(abs(found[s] - wanted[s]) < 1e-6 * (1 + wanted[s]) for s in wanted), (sizes, found, wanted)


def test_mix(docs):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == size
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == sum(x["size"] for x in own) for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2 + 1
        assert all(r.taken <= 3 * r["size"] and r.taken == r.epochs * r["size"] for r in own)
        assert max(r.epochs for r in own) - min(r.epochs for r in own) <= 1


def test_documents_follow_the_mix(docs):
    epochs = {r.doc_id: r.epochs for r in mixing.mix(docs).collect()}
    found = {}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {d: n for d, n in epochs.items() if n}


def test_odd_tables(spark, empty):
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
    odd = spark.createDataFrame([(None, None, None, 1), (1, "", "a", 2), (1, "", "a", 2), (None, "x y", "a", 3), (None, "x y", "a", 3), (4, "z", None, 1)], "doc_id long, text string, source string, key long")
    rows = mixing.mix(odd).collect()
    assert len(rows) == 6 and sum(r["size"] for r in rows) == 5
    assert mixing.mixed_documents(odd).columns == odd.columns
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(blank).collect()] == [0, 0]
