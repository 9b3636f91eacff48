import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from formweave.functions import fuzzy, text


def scores(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    a, b = F.col("a"), F.col("b")
    return [(r.r, r.t, r.s) for r in df.select("i", fuzzy.ratio(a, b).alias("r"), fuzzy.token_set_ratio(a, b).alias("t"), fuzzy.similarity(a, b).alias("s")).orderBy("i").collect()]


RATIOS = [("NUM", "Num", 33), ("LEVEL", "Level", 20), ("EMETTEUR", "Émetteur", 0), ("003", "03", 80), ("003", "00", 80), ("3", "0", 0), ("numero de document", "numero", 50), ("zone / niveau", "niveau", 63), ("titre du dessin", "titre", 50), ("doc", "n°doc", 75), ("coden", "code", 89), ("code", "cod", 86), ("coden", "cod", 75), ("", "", 0), ("", "a", 0)]


def test_golden_ratios(spark):
    assert [r for r, _, _ in scores(spark, [p[:2] for p in RATIOS])] == [p[2] for p in RATIOS]


def test_golden_similarities(spark):
    pairs = [("numero de document", "numero"), ("zone / niveau", "niveau"), ("doc", "n° doc"), ("emeteur", "emetteur"), ("projet", "phase")]
    assert [s for _, _, s in scores(spark, pairs)] == [99, 99, 99, 93, 36]


def lcs(a, b):
    row = [0] * (len(a) + 1)
    for c in b:
        new = [0]
        for j, x in enumerate(a, 1):
            new.append(max(row[j], new[-1], row[j - 1] + (x == c)))
        row = new
    return row[-1]


def test_random_ratios(spark):
    import random

    rng = random.Random(1)
    pairs = [tuple("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 12))) for _ in range(2)) for _ in range(200)]
    found = scores(spark, pairs)
    assert [r for r, _, _ in found] == [int(200 * lcs(a, b) / (len(a) + len(b)) + 0.5) if a or b else 0 for a, b in pairs]
    assert found == scores(spark, [(b, a) for a, b in pairs]) and all(0 <= x <= 100 for r in found for x in r[:2])


def evaluate(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normal_forms(spark):
    assert evaluate(spark, text.normalize_label, ["  Numéro \n de\tDocument :: ", "ÉTAT:", None, " \t", "a:b :"]) == ["numero de document", "etat", "", "", "a:b"]
    assert evaluate(spark, text.normalize_value, ["003", "00", "O11", " RDC ", "0", None]) == ["3", "0", "o11", "rdc", "0", ""]
    assert evaluate(spark, text.simplify, ["N° doc., É-tage", None]) == ["n doc e tage", ""]
    assert evaluate(spark, text.word_count, ["", None, "a  b\nc", "\n x "]) == [0, 0, 3, 1]
    assert evaluate(spark, text.zone, [" Bottom-Right ", "unknown", "", None]) == ["bottom-right", None, None, None]
    assert evaluate(spark, text.strip_code_fence, ["```json\n{}\n```", "{}", "```\n{\"a\":1}\n``` tail"]) == ["{}", "{}", '{"a":1}']
    assert evaluate(spark, text.truncated, ["x" * 501, "x" * 500]) == ["x" * 500 + "…", "x" * 500]


def test_predicates(spark):
    assert evaluate(spark, text.is_short_code, ["A1", "", "--", "a b c d", "x" * 15, None]) == [True, False, False, False, False, False]
    assert evaluate(spark, text.looks_like_phone, ["01 23 45 67", "123456", None]) == [True, False, False]
    assert evaluate(spark, text.looks_like_postal, ["75013 Paris", "a\n75013", "750131", None]) == [True, False, False, False]
    assert evaluate(spark, lambda c: text.contains_any(text.fold(c), text.ID_LABELS), ["Pilote", "Indice", "Nom", None]) == [True, True, False, False]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=12), min_size=1, max_size=8))
def test_normalizing_twice_changes_nothing(values):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or pytest.skip("no session")
    once = evaluate(spark, text.normalize_value, values)
    assert evaluate(spark, text.normalize_value, once) == once
    marks = evaluate(spark, text.without_marks, values)
    assert marks == ["".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c)[0] != "M") for v in values]


def test_whole_texts_against_brute_force(spark, tmp_path):
    from formweave.plans import forms

    long = "Étage  premier\r\n" * 300 + "Ünï\tcödé — 12 :\n"
    texts = [None, "", " \n\t ", "Zone : ", long, "x" * 70 + " É\x0b\x0cà  Ñ:", "word " * 5000 + "ÀÉ:: "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in forms.text_functions(spark, str(tmp_path)).collect()}
    blanks = " \t\n\x0b\x0c\r"
    squeezed = lambda s, keep: " ".join("".join(c if keep(c) else " " for c in s).split(" ")).split()
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        folded = "".join(c for c in unicodedata.normalize("NFD", t or "") if unicodedata.category(c)[0] != "M").lower()
        label = " ".join(squeezed(folded, lambda c: c not in blanks)).rstrip(":").strip()
        simple = " ".join(squeezed(folded, lambda c: c in "abcdefghijklmnopqrstuvwxyz0123456789"))
        words = len(squeezed(t or "", lambda c: c not in blanks))
        assert (rows[i].folded, rows[i].label_form, rows[i].simple_form, rows[i].n_words, rows[i].value_form) == (folded, label, simple, words, f"{i}"), i
        part = t if t is None or i % 2 == 0 else t[:400]
        assert rows[i].cut == (part if part is None or len(part) <= 500 else part[:500] + "…")
        assert rows[i].readable == (t if len((t or "").strip(blanks)) >= 200 else "") and rows[i].retryable == (500 + i % 6 in (502, 503, 504))
