import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formweave.llm import langid, queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_held_out_accuracy(spark):
    rows = queries.op3_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)
    assert sum(r.rejected for r in rows) <= 0.02 * len(rows)


def test_odd_tables(spark, empty):
    taught = spark.createDataFrame([(i, t, x, 1.0) for i in range(40) for t, x in (("the cat and the dog went home", "en"), ("le chat et le chien sont là", "fr"))], "doc_id long, text string, lang string, score double")
    model = langid.train(taught, F.lit(True))
    asked = spark.createDataFrame([(1, None), (2, ""), (3, "12 !! 7 ²½"), (4, "the dog and the cat"), (None, "le chien et le chat"), (6, "дом " * 5), (7, "a")], "doc_id long, text string")
    rows = {r.doc_id: r for r in langid.predict(asked, model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(rows[i].rejected and rows[i].score == 0 for i in (1, 2, 3))
    assert rows[4].lang_pred == "en" and rows[None].lang_pred == "fr"
    assert rows[6].score < rows[4].score and rows[7].lang_pred in ("en", "fr")
    assert langid.predict(taught, model).columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    nothing = langid.train(empty, F.lit(True))
    assert {r.lang_pred for r in langid.predict(asked, nothing).collect()} == {"und"} and langid.predict(empty, nothing).collect() == []


def test_rare_languages_are_learned(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 2000 == 0, "дом и сад ").otherwise("the house and the garden "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 2000 == 0, "ru").otherwise("en").alias("lang"))
    model = langid.train(rows, F.lit(True), sample_rows=100)
    asked = spark.createDataFrame([(1, "сад и дом"), (2, "the garden")], "doc_id long, text string")
    assert model.langs == ["en", "ru"] and [r.lang_pred for r in langid.predict(asked, model).orderBy("doc_id").collect()] == ["ru", "en"]


def naive(model, text):
    """Language, confidence and distance by plain loops over the bytes of a text."""
    bare = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    data = f" {' '.join(bare)} ".encode()
    grams = []
    for n in langid.GRAMS:
        for i in range(len(data) - n + 1):
            h = n
            for b in data[i : i + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
            grams.append(h * 0x9E3779B1 >> 16 & langid.BUCKETS - 1)
    scores = [sum(float(row[g]) for g in grams) / len(grams) / model.temperature for row in model.table]
    total = sum(math.exp(x - max(scores)) for x in scores)
    best = max(range(len(scores)), key=lambda k: scores[k])
    far = (sum(float(model.frequency[best, g]) for g in grams) / len(grams) - model.median[best]) * math.sqrt(min(len(grams), model.typical))
    return best, 1 / total, far


def a_model():
    texts = {"en": "the and of that with this is a house in the garden", "fr": "le la et des que une est la maison dans le jardin", "ru": "дом и сад это не все что есть в нем"}
    return langid.fit([(k, *langid._gram_counts(" ".join(random.Random(i).sample(t.split(), 6)))) for i in range(60) for k, t in texts.items()])


def test_predictions_against_naive_loops(monkeypatch):
    model = a_model()
    assert np.isfinite(model.least).all()
    asked = ["the house", "le jardin et la maison, 12 fois!", "дом-сад", "Ünïcode x", "q" * 300, "the and of " * 40]
    for long in (1 << 20, 16):  # whole, and piece by piece
        monkeypatch.setattr(langid, "LONG", long)
        best, sure, odd = model.judged(asked)
        for i, t in enumerate(asked):
            k, p, far = naive(model, t)
            assert (best[i], odd[i]) == (k, far < model.least[k] or p < model.threshold) and math.isclose(sure[i], p, abs_tol=1e-5)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(random.Random(1).choice(["the", "house", "été", "сад"]) + str(i) for i in range(9000))
    whole = langid._gram_counts(text)
    monkeypatch.setattr(langid, "LONG", 1000)
    assert all((a == b).all() for a, b in zip(whole, langid._gram_counts(text), strict=True))
    data = np.frombuffer(langid._letters(text), np.uint8)
    at, n = np.unique(np.concatenate([langid._hashes(data, k) for k in langid.GRAMS]), return_counts=True)
    assert (whole[0] == at).all() and (whole[1] == n).all()


def test_batches_do_not_matter():
    model = a_model()
    texts = ["the and", "", "le la une", "x", "été"]
    together, alone = model.judged(texts), [model.judged([t]) for t in texts]
    assert [list(x) for x in zip(*together, strict=True)] == [[x[0] for x in one] for one in alone]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("left_out", ["fr", "es"])
def test_a_language_that_was_never_seen_is_rejected(spark, left_out):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null and length(text) > 100")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = langid.train(docs, (F.col("lang") != left_out) & (part != 1))
    rows = langid.predict(docs, model).withColumn("held", part == 1).collect()
    out = [r.rejected for r in rows if r.lang == left_out]
    known = [r.rejected for r in rows if r.lang not in (left_out, None) and r.held]
    assert left_out not in model.langs and sum(out) >= 0.95 * len(out) and sum(known) <= 0.02 * len(known)


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat(concat(sha2(cast(id as string), 256), ' '), 40)").alias("text"), F.lit("en").alias("lang"))
    taught = []
    real = langid.fit
    monkeypatch.setattr(langid, "fit", lambda rows, *a: taught.append(len(rows)) or real(rows, *a))
    langid.train(rows, F.lit(True))
    langid.train(rows, F.lit(True), sample_bytes=1 << 20)
    assert taught[0] == 400 and 0 < taught[1] < 60
