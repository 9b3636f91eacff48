import math
import re
from collections import Counter

import numpy as np

from formweave.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), dup, len(covered)


def test_counts_against_brute_force(docs):
    texts = [r.text for r in docs.collect()] + ["a b c d e " * 4 + "x", "a a a a a a a", "# <b> & é\n# <b> & é\n\n\n", " \x0b\x0c é\u00a0b \u2003"]
    for t in texts:
        assert quality.base_counts(t or "") == brute(t), t


def naive_model(texts):
    """Modified Kneser-Ney by dictionaries of strings: ``p(character, four characters before it)``."""
    order = quality.ORDER
    levels = {order: Counter()}
    for t in texts:
        padded = "\n" * (order - 1) + t
        levels[order].update(padded[i : i + order] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts, contexts = {}, {}
    for k, level in levels.items():
        n1, n2, n3, n4 = (sum(v == i for v in level.values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        raw = (1 - 2 * y * n2 / max(n1, 1), 2 - 3 * y * n3 / max(n2, 1), 3 - 4 * y * n4 / max(n3, 1))
        cuts[k] = [max(0.05, min(d, i * 0.95)) for i, d in enumerate(raw, 1)]
        contexts[k] = {}
        for g, n in level.items():
            total, saved = contexts[k].get(g[:-1], (0, 0.0))
            contexts[k][g[:-1]] = total + n, saved + cuts[k][min(n, 3) - 1]

    def p(c, before):
        k = len(before) + 1
        if before and before not in contexts[k]:
            return p(c, before[1:])
        total, saved = contexts[k][before]
        n = levels[k].get(before + c, 0)
        below = p(c, before[1:]) if before else 1 / (len(levels[1]) + 1)
        return (n - cuts[k][min(n, 3) - 1] if n else 0) / total + saved / total * below

    return p


def naive_log_probability(p, text):
    padded = "\n" * (quality.ORDER - 1) + text
    return sum(math.log(p(padded[i + quality.ORDER - 1], padded[i : i + quality.ORDER - 1])) for i in range(len(text)))


def test_model_against_a_naive_one(spark, docs, monkeypatch):
    texts = [r.text or "" for r in docs.collect()]
    p = naive_model([t for t in texts if not quality.fails(brute(t))])
    asked = [*texts[:25], "", "never seen: \u4e2d\u6587 \U0001f600 ÄÖ", "x" * 3000, max(texts, key=len)]
    expected = [naive_log_probability(p, t) for t in asked]
    whole = quality.train(docs).block(0).sums(asked)
    assert np.allclose(whole, expected, rtol=1e-5, atol=1e-4), [(a, b, t[:30]) for a, b, t in zip(whole, expected, asked, strict=True) if abs(a - b) > 1e-3]
    split = quality.train(docs, block_entries=800)
    assert split.n_blocks > 2
    monkeypatch.setattr(quality, "SLICE", 1 << 10)  # and texts that are longer than a slice
    monkeypatch.setattr(quality, "HELD", 1 << 9)
    assert np.allclose(sum(split.block(i).sums(asked) for i in range(split.n_blocks)), expected, rtol=1e-5, atol=1e-4)


def test_probabilities_sum_to_one():
    p = naive_model(["the cat sat on the mat and the dog", "a cat and a dog on a mat"])
    chars = sorted(set("the cat sat on the mat and the dog")) + ["?"]
    for before in ("the ", "zzzz", "n th", "\n\n\n\n"):
        assert math.isclose(sum(p(c, before) for c in chars), 1, rel_tol=1e-9)


def test_blocks_give_the_same_verdicts(spark, docs):
    one, more = ({(r.doc_id, r.n_words): (r.kept, round(r.log_perplexity or 0, 4)) for r in quality.judge(docs, block_entries=n).collect()} for n in (1 << 22, 900))
    assert one == more


def test_bands_against_brute_force(spark, docs):
    rows = [r.asDict() for r in quality.judge(docs).collect()]
    lower = lambda values, q: sorted(values)[max(0, math.ceil(q * len(values)) - 1)]
    for lang in {r["lang"] for r in rows}:
        own = [r for r in rows if r["lang"] == lang]
        good = [r for r in own if not r["base_failed"]]
        mid = lower([r["log_perplexity"] for r in good], 0.5)
        most = lower([r["n_words"] for r in good], quality.LONG)
        far = lambda r: (r["log_perplexity"] - mid) * math.sqrt(min(r["n_words"], most))  # noqa: E731, B023
        q1, q2, q3 = (lower([far(r) for r in good], q) for q in (0.25, 0.5, 0.75))
        low, high = q2 - max(quality.WIDTH * (q2 - q1), quality.LEAST_WIDTH), q2 + max(quality.WIDTH * (q3 - q2), quality.LEAST_WIDTH)
        assert all(r["kept"] == (not r["base_failed"] and low <= far(r) <= high) for r in own)


def test_gibberish_is_rejected_and_text_kept(spark, docs):
    rng = np.random.default_rng(1)
    junk = [(1000 + i, " ".join("".join(rng.choice(list("qxzjkvw¤§{}~^0"), 9)) for _ in range(60)), "en") for i in range(3)]
    text = "the people of the town went to the river and the boats were there in the morning when they came back "
    clean = [(i, " ".join(rng.permutation(text.split())) + " " + " ".join(rng.permutation(text.split())), "en" if i % 3 else None) for i in range(300)]
    rows = {r.doc_id: r for r in quality.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert not any(rows[1000 + i].kept for i in range(3))
    assert all(rows[i].kept for i in range(300) if not rows[i].base_failed) and sum(rows[i].base_failed for i in range(300)) < 30


def test_odd_tables(spark, empty):
    assert quality.judge(empty).collect() == []
    odd = spark.createDataFrame([(None, None, None, 5), (1, "", "en", 5), (1, "", "en", 5), (2, "a b c d e f g h i j k", None, 5)], "doc_id long, text string, lang string, kept long")
    rows = quality.judge(odd).collect()
    assert len(rows) == 4 and sum(r.kept for r in rows) == 1 and sum(r.base_failed for r in rows) == 3


def test_labelled_junk_of_ordinary_letters_is_rejected(spark):
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("etaoinshrdlu"), rng.integers(2, 9), p=[0.15, 0.12, 0.1, 0.1, 0.1, 0.09, 0.08, 0.08, 0.06, 0.05, 0.04, 0.03])) for _ in range(300)]
    written = lambda n: " ".join(rng.choice(vocab, n))
    good = [(i, written(int(rng.integers(12, 900)))) for i in range(400)]
    junk = [(1000 + i, " | ".join(written(2).upper() + str(rng.integers(10, 99)) for _ in range(150))) for i in range(4)]
    rows = {r.doc_id: r for r in quality.judge(spark.createDataFrame([(i, t, "en") for i, t in good + junk], "doc_id long, text string, lang string")).collect()}
    assert not any(rows[i].base_failed or rows[i].kept for i, _ in junk)
    assert sum(rows[i].kept for i, _ in good if not rows[i].base_failed) >= 398 - sum(rows[i].base_failed for i, _ in good)
