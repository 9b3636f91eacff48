import re

import regex
from pyspark.sql import functions as F

from formweave.llm import pii
from formweave.llm.shared import checkpointed

KEY = "k"
ROWS = [
    (1, "Mail that.92@mail2.example.com or THAT.92@mail2.example.com, ip 152.143.123.131."),
    (2, "Call +1 (523) 555-1055 or +1-523-555-1055; card 4111 1111 1111 1111 and 4111111111111111 and 4785380592391139."),
    (3, "Mme Dupont, Mr. John Smith and Mr. JOHN SMITH met Г-жа Иванова and Κος Παππάς. SSN 123-45-6789, DE89 3704 0044 0532 0130 00"),
    (4, None), (5, ""), (6, "Nothing here, version 1.2.3 of 2024-01-05, total 1234567."), (None, "x@y.example.com"), (7, "other.1@mail2.example.com"),
]


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 % 10 + d * 2 // 10 for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_types_formats_and_coreference(spark):
    rows = {r.doc_id: r for r in pii.replace(spark.createDataFrame(ROWS, "doc_id long, text string"), KEY).collect()}
    one = re.fullmatch(r"Mail (\S+@\S+\.example\.org) or (\S+@\S+), ip (\d+)\.(\d+)\.(\d+)\.(\d+)\.", rows[1].text)
    assert one and one[1] == one[2] and all(0 < int(x) < 256 for x in one.groups()[2:]) and rows[1].n_entities == 3
    two = re.fullmatch(r"Call (\+1 \(\d{3}\) 555-\d{4}) or (\+1-\d{3}-555-\d{4}); card (4\d{3} \d{4} \d{4} \d{4}) and (4\d{15}) and (4\d{15})\.", rows[2].text)
    digits = [re.sub(r"\D", "", x) for x in two.groups()]
    assert digits[0] == digits[1] and digits[2] == digits[3] != digits[4] and luhn(digits[2]) and not {"5235551055"} & {d[1:] for d in digits}
    three = re.fullmatch(r"Mme (\w+), Mr. (\w+ \w+) and Mr. ([A-Z ]+) met Г-жа ([а-яА-Я]+) and Κος ([\u0370-\u03ff]+)\. SSN (\d{3}-\d{2}-\d{4}), DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", rows[3].text)
    assert three and three[2].upper() == three[3] and three[2].split()[0].endswith(tuple(pii.ENDINGS["latin"]["m"])) and three[6] != "123-45-6789"
    assert rows[4].text is None and rows[5].text == "" and rows[6].text == ROWS[5][1] and [rows[i].n_entities for i in (4, 5, 6)] == [0, 0, 0]
    assert rows[7].text.split("@")[1] == one[1].split("@")[1] and rows[7].text != one[1]
    assert rows[None].n_entities == 1 and "y.example.com" not in rows[None].text


def test_surrogates_stay_distinct(spark):
    names = spark.range(1200).select(F.lit("ssn").alias("kind"), F.lpad(F.col("id").cast("string"), 4, "0").alias("norm")).unionByName(spark.range(1000).select(F.lit("ip").alias("kind"), F.concat(F.lit("9.9."), (F.col("id") / 200).cast("int"), F.lit("."), F.col("id") % 200).alias("norm")))
    entities = checkpointed(names)
    fixed = {(r.kind, r.norm): r.surrogate for r in pii.exceptions(entities, KEY).collect()}
    assert fixed  # four digits leave many collisions
    first = entities.select("kind", "norm", pii.surrogate_norm(F.col("kind"), F.col("norm"), F.lit(0), KEY).alias("s")).collect()
    final = {(r.kind, r.norm): fixed.get((r.kind, r.norm), r.s) for r in first}
    assert len({(k, s) for (k, _), s in final.items()}) == len(final)
    assert not {(k, s) for (k, _), s in final.items()} & set(final)


def test_exceptions_reach_the_texts(spark, monkeypatch):
    real = pii.surrogate_norm
    monkeypatch.setattr(pii, "surrogate_norm", lambda kind, norm, attempt, key: F.when((attempt == 0) & (kind == "email"), F.lit("same@one.example.org")).otherwise(real(kind, norm, attempt, key)))
    df = spark.createDataFrame([(i, f"mail p{i % 6}@a.example.com and p{(i + 1) % 6}@a.example.com") for i in range(12)], "doc_id long, text string")
    texts = [r.text for r in pii.replace(df, KEY).orderBy("doc_id").collect()]
    mails = [re.findall(r"\S+@\S+", t) for t in texts]
    assert len({m for own in mails for m in own}) == 6 and mails[0] == mails[6] and mails[0][1] == mails[1][0]


def test_crowded_kinds_do_not_run_out(spark, monkeypatch):
    monkeypatch.setattr(pii, "ATTEMPTS", 30)
    # half of all numbers of two digits
    names = spark.range(50).select(F.lit("ssn").alias("kind"), F.lpad(F.col("id").cast("string"), 2, "0").alias("norm"))
    entities = checkpointed(names)
    fixed = {r.norm: r.surrogate for r in pii.exceptions(entities, KEY).collect()}
    first = entities.select("norm", pii.surrogate_norm(F.lit("ssn"), F.col("norm"), F.lit(0), KEY).alias("s")).collect()
    final = {r.norm: fixed.get(r.norm, r.s) for r in first}
    assert len(set(final.values())) == 50 and all(k != v for k, v in final.items())
    # names grow longer instead
    name = lambda at: spark.range(1).select(pii.surrogate_norm(F.lit("family"), F.lit("dupont"), F.lit(at), KEY).alias("s")).first().s
    assert [len(name(at)) for at in (0, 1, 7, 8, 16)] == [2 * n for n in (4, 5, 5, 6, 7)]


def test_full_formats_are_permuted(spark, monkeypatch):
    monkeypatch.setattr(pii, "ATTEMPTS", 3)
    phones = [f"{p}{i:02d}" for p, n in (("12", 100), ("34", 99), ("56", 80), ("78", 1)) for i in range(n)] + [f"9{i:09d}"[:3] + f"555{i:04d}" for i in range(40)]
    names = spark.createDataFrame([("phone", x) for x in phones] + [("email", f"a{i}@b.org") for i in range(20)], "kind string, norm string")
    entities = checkpointed(names)
    fixed = {(r.kind, r.norm): r.surrogate for r in pii.exceptions(entities, KEY).collect()}
    first = entities.select("kind", "norm", pii.surrogate_norm(F.col("kind"), F.col("norm"), F.lit(0), KEY).alias("s")).collect()
    final = {(r.kind, r.norm): fixed.get((r.kind, r.norm), r.s) for r in first}
    assert len({(k, s) for (k, _), s in final.items()}) == len(final) and all(n != s for (_, n), s in final.items())
    assert all(len(n) == len(s) and n[:2] == s[:2] for (k, n), s in final.items() if k == "phone" and len(n) == 4)


def test_the_last_free_place_may_be_the_entity_itself(spark):
    settled = [("ssn", str(i), str(i % 9 + 1 if i else 0)) for i in range(1, 10)]  # 1-9 have each other's places; 0 is left
    rows = checkpointed(spark.createDataFrame(settled, "kind string, norm string, surrogate string"))
    real = checkpointed(spark.createDataFrame([("ssn", str(i), True) for i in range(10)], "kind string, surrogate string, real boolean"))
    moved = {r.norm: r.surrogate for r in pii.by_rank(spark.createDataFrame([("ssn", "0")], "kind string, norm string"), rows, real, KEY).collect()}
    final = {n: s for _, n, s in settled} | moved
    assert len(moved) == 2 and len(set(final.values())) == 10 and all(n != s for n, s in final.items())


def test_iban_check_digits(spark):
    def valid(x):
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1

    rows = [(i, x) for i, x in enumerate(["DE89370400440532013000", "GB29NWBK60161331926819", "DE00370400440532013000", "FR1420041010050500013M02606"])]
    made = [r.s for r in spark.createDataFrame(rows, "i long, norm string").orderBy("i").select(pii.surrogate_norm(F.lit("iban"), F.col("norm"), F.lit(0), KEY).alias("s")).collect()]
    assert [valid(s) for s in made] == [True, True, False, True]
    assert all(len(s) == len(x) and s[:2] == x[:2] and s != x and [c.isdigit() for c in s] == [c.isdigit() for c in x] for s, (_, x) in zip(made, rows, strict=True))


def test_keys_and_odd_tables(spark, empty):
    df = spark.createDataFrame([(1, "a@b.example.com", 3)] * 2, "doc_id long, text string, n_entities long")
    a, b = (pii.replace(df, k).collect() for k in ("k1", "k2"))
    assert a[0].text == a[1].text != b[0].text and a[0].n_entities == 1 and len(a) == 2
    assert pii.replace(empty, KEY).collect() == []


def test_detection_is_linear_in_long_texts(spark):
    df = spark.createDataFrame([(1, "a" * 300_000), (2, "1" * 200_000), (3, "Abc" * 100_000)], "doc_id long, text string")
    assert [r.n_entities for r in pii.replace(df, KEY).collect()] == [0, 0, 0]


NAMED = [
    "Mrs Anna Smith wrote. Anna Smith and Dr Smith and Mr Smith agreed, and ANNA too; Smith's idea, not a smith's.",
    "Dr Paul Smith-Jones met Prof Jones. Smith-Jones said Paul left; paul did not. Nothing of Smith.",
    "Herr Müller und Frau Anna Müller-Lüdenscheid. Müller kam. Annas Haus.",
    "Prof Anna Weber, Mme Anna Weber. Weber, (Anna)!",
    "Mr. JOHN O'Neil and O'NEIL, John.", "Г-жа Анна Иванова и Иванова. Анна.", "Anna Smith alone is no name here.",
]


def expected_names(text):
    """Titled names, and all words with capitals that are among theirs, by plain rules: (start, end, role, word)."""
    title, word = pii.TITLE, pii.WORD
    last, long_last, given = set(), set(), {}
    for m in regex.finditer(rf"(?<!\p{{L}})({title})\.? ({word}(?: {word}){{0,2}})", text):
        words = m[2].lower().split(" ")
        gender = "f" if m[1] in ("Mrs", "Frau", "Mme", "Г-жа") else "m" if m[1] in ("Mr", "Herr") else ""
        last.add(words[-1])
        long_last |= {words[-1]} if len(words) > 1 else set()
        for w in words[:-1]:
            given[w] = max(given.get(w, ""), gender, key=lambda g: (g != "", g == "m"))
    family = long_last | (last - set(given))
    out = []
    for m in regex.finditer(rf"(?<!\p{{L}}){word}", text):
        low = m[0].lower()
        if low in family or low in given:
            out.append((m.start(), m.end(), "family" if low in family else f"given:{given[low]}", low))
    return out


def test_names_against_brute_force(spark):
    rows = pii.replace(spark.createDataFrame(list(enumerate(NAMED)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    mapping = {}
    for before, row in zip(NAMED, rows, strict=True):
        at, pattern, found = 0, "", expected_names(before)
        for start, end, _, _ in found:
            pattern += re.escape(before[at:start]) + r"(\w+)"
            at = end
        match = re.fullmatch(pattern + re.escape(before[at:]), row.text)
        assert match, (before, row.text)
        for (start, end, role, low), new in zip(found, match.groups(), strict=True):
            assert mapping.setdefault((role, low), new.lower()) == new.lower() != low
            assert new.isupper() == before[start:end].isupper()
            if role[6:]:
                assert any(new.lower().endswith(e) for x in pii.ENDINGS.values() for e in x[role[6:]])
    assert len(set(mapping.values())) == len(mapping)
    assert rows[0].n_entities == 6 and rows[6].text == NAMED[6] and rows[6].n_entities == 0
    one = re.match(r"Mrs (\w+) (\w+) wrote. \1 \2 and Dr \2 and Mr \2 agreed", rows[0].text)
    assert one and "Smith" not in rows[0].text


def test_every_entity_gets_one_surrogate_of_its_own(spark, docs):
    rows = [(i, f"{r.text or ''} {extra}") for i, (r, extra) in enumerate(zip(docs.collect(), ["a1@b.example.com, 10.1.2.3", "call +49 30 1234567 or 4111-1111-1111-1111", "Mr Karl Braun. Braun", ""] * 60, strict=False))]
    out = pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    seen = {}
    joined = "|".join(f"(?:{p})" for p in pii.PATTERNS.values())
    for (_, before), r in zip(rows, out, strict=True):
        found = [m[0] for m in regex.finditer(joined, before)]
        new = [m[0] for m in regex.finditer(joined, r.text)]
        assert len(found) == len(new) and "Braun" not in r.text
        for a, b in zip(found, new, strict=True):
            assert seen.setdefault(a, b) == b != a
    assert len(set(seen.values())) == len(seen) >= 4
