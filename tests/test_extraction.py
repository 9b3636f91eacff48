import json

import pytest
from pyspark.sql import functions as F

from formweave.operators import extraction, geometry

READING = "request_id string, doc_id long, stage string, sample_idx int, response string"
PAGE = "request_id string, doc_id long, large boolean, text_chars int, zone string, region struct<x:double,y:double,w:double,h:double>"


def answer(pairs, found=True, assignments=None, chat=False):
    body = json.dumps({"cartoucheFound": found, "fields": [{"label": a, "value": b} for a, b in pairs]} | ({"assignments": [dict(zip(("field", "label", "value"), x, strict=True)) for x in assignments]} if assignments else {}))
    return json.dumps({"choices": [{"message": {"content": f"```json\n{body}\n```"}}]} if chat else {"document_annotation": body})


def request(*fields):
    return json.dumps({"projectCode": "p", "other": 1, "fields": [{"name": n, "labels": x, "allowedValues": [{"code": c, "libelle": y} for c, y in codes]} for n, x, codes in fields]})


def run(spark, requests, readings, pages=None, **more):
    calls = spark.createDataFrame([(r, d, x) for (r, d), x in requests.items()], "request_id string, doc_id long, request string")
    pages = spark.createDataFrame([(*k, *pages.get(k, (False, 0, None, None))) for k in requests] if pages else [(*k, False, 0, None, None) for k in requests], PAGE)
    found = extraction.extract(calls, pages, spark.createDataFrame([(*k, s, i, x) for (*k, s, i), x in readings.items()], READING), **more)
    return found, {(r.request_id, r.doc_id): json.loads(r.response) for r in found.responses.collect()}


PHASE = ("spec_char1", ["Phase", "Pha"], [("EXE", "Exécution"), ("DOE", "Dossier")])


def test_golden_answers(spark):
    free = request(("f", ["Bâtiment"], []))
    asked = {("a", 1): request(PHASE), ("a", 2): request(PHASE), ("b", 3): free, ("c", 4): request(("z", ["Zone"], [])), ("d", 5): request(("z_lot", ["Lot"], []), ("a_phase", ["Phase"], []))}
    read = {("a", 1, "full", 0): answer([("Phase", "EXE"), ("Echelle", "1/50")]), ("a", 2, "full", 0): answer([("Phase", "ZZZ")], chat=True), ("b", 3, "full", 0): answer([("Bâtiment", "BtA")]), ("c", 4, "full", 0): answer([("Phase", "EXE")]), ("d", 5, "full", 0): answer([("Phase", "EXE"), ("Lot", "03")])}
    _, got = run(spark, asked, read)
    assert got["a", 1] == {
        "cartoucheFound": True, "mode": "SINGLE_PAGE", "corner": None, "qualityPassed": True,
        "fields": [{"name": "spec_char1", "value": "EXE", "status": "AUTO_VALIDATED", "rawLabel": "Phase", "matchScore": 100, "referenceCode": "EXE", "referenceLabel": "Exécution", "referenceScore": 100}],
        "unclassifiedPairs": [{"label": "Echelle", "value": "1/50"}],
    }
    one = lambda k: got[k]["fields"][0]
    assert (one(("a", 2))["status"], one(("a", 2))["value"], one(("a", 2))["referenceCode"]) == ("TO_REVIEW", "ZZZ", None) and got["a", 2]["unclassifiedPairs"] == []
    assert (one(("b", 3))["status"], one(("b", 3))["value"]) == ("TO_REVIEW", "BtA")
    assert (one(("c", 4))["status"], one(("c", 4))["value"]) == ("MISSING", None)
    assert [f["name"] for f in got["d", 5]["fields"]] == ["z_lot", "a_phase"]


def test_nothing_read_gives_missing_fields(spark):
    asked = {("a", i): request(PHASE) for i in range(4)} | {("e", 9): '{"fields": []}'}
    read = {("a", 1, "full", 0): None, ("a", 2, "full", 0): "no json", ("a", 3, "full", 0): answer([], found=False)}
    large = {k: (True, 0, "top-left", None) for k in asked}
    for pages, mode in ((None, "SINGLE_PAGE"), (large, "NEEDS_TILING")):
        found, got = run(spark, asked, read, pages)
        assert {x["mode"] for x in got.values()} == {mode} and not any(x["cartoucheFound"] for x in got.values())
        assert all([f["status"] for f in got["a", i]["fields"]] == ["MISSING"] for i in range(4)) and got["e", 9]["fields"] == []
        assert found.fields.count() == 4 and found.leftovers.count() == 0
    assert got["a", 0]["corner"] == "top-left"


def test_proposals_samples_and_enrichment(spark):
    pairs = [("NUMERO DE DOCUMENT", "PRO120"), ("Niv", "N+2"), ("Ind", "A"), ("Zone", "A")]
    asked = {("a", 1): request(("numero", ["numero"], []), ("niveau", ["Level"], []), ("indice", ["indice"], []), ("zone", ["zone"], []))}
    said = [("numero", "NUMERO DE DOCUMENT", "PRO120"), ("niveau", "Level", "never read"), ("indice", "Ind", "A")]
    read = {("a", 1, "full", i): x for i, x in enumerate([answer(pairs[:1]), answer(pairs, assignments=said), answer([], found=False), None, answer([*pairs, ("x", "y")])])}
    registry = spark.createDataFrame([(0, ["Niveau", "Niv", "Level"])], "field_idx int, synonyms array<string>")
    found, got = run(spark, asked, read, registry=registry)
    rows = {f["name"]: (f["value"], f["status"], f["matchScore"]) for f in got["a", 1]["fields"]}
    assert rows == {"numero": ("PRO120", "TO_REVIEW", 99), "niveau": ("N+2", "TO_REVIEW", 100), "indice": ("A", "TO_REVIEW", 67), "zone": ("A", "TO_REVIEW", 100)}
    assert got["a", 1]["unclassifiedPairs"] == []


def test_the_same_document_for_two_requests(spark):
    pairs = [("Phase", "EXE"), ("Lot", "03")]
    asked = {("a", 1): request(("x", ["Phase"], [("DOE", "d")])), ("b", 1): request(("x", ["Lot"], [("03", "three")]))}
    _, got = run(spark, asked, {(r, 1, "full", 0): answer(pairs) for r in "ab"})
    one = {r: got[r, 1]["fields"][0] for r in "ab"}
    assert [(one[r]["value"], one[r]["status"], one[r]["referenceLabel"]) for r in "ab"] == [("EXE", "TO_REVIEW", None), ("03", "AUTO_VALIDATED", "three")]
    assert [got[r, 1]["unclassifiedPairs"][0]["label"] for r in "ab"] == ["Lot", "Phase"]


def test_routes(spark):
    block = [("Phase", "EXE"), ("Lot", "03"), ("Indice", "B"), ("Numero", "12")]
    panel = [("Architecte", "Cabinet"), ("Tel", "01 02 03 04 05"), ("Adresse", "rue x"), ("Fax", "0102030405"), ("Mail", "a@b")]
    asked = {("a", i): request(("f", ["Phase"], [])) for i in range(1, 6)}
    box = (0.1, 0.1, 0.2, 0.2)
    read = {
        ("a", 1, "corner:bottom-right", 0): answer(panel), ("a", 1, "corner:bottom-left", 0): answer(block),  # the block that speaks of what is asked
        ("a", 2, "boxed", 0): answer(panel[:2]), ("a", 2, "corner:top-left", 0): answer([]),  # no corner passes
        ("a", 3, "corner:top-left", 0): answer([]),
        ("a", 4, "text", 0): answer(block), ("a", 4, "full", 0): answer(panel),
        ("a", 5, "boxed", 0): answer(block), ("a", 5, "full", 0): answer(panel),
    }
    pages = {("a", 1): (True, 0, None, None), ("a", 2): (True, 0, "unknown", box), ("a", 3): (True, 0, " Middle-Left ", None), ("a", 4): (False, 500, None, None), ("a", 5): (False, 0, "unknown", box)}
    _, got = run(spark, asked, read, pages)
    how = {i: (x["mode"], x["corner"], x["qualityPassed"]) for (_, i), x in got.items()}
    assert how == {1: ("TWO_PASS_CROP", "bottom-left", True), 2: ("TWO_PASS_CROP", "top-left", False), 3: ("NEEDS_TILING", "middle-left", False), 4: ("TEXT_LAYER", None, True), 5: ("TWO_PASS_CROP", "top-left", True)}
    _, off = run(spark, asked, read, pages, text_layer=False, locate=False)
    assert off["a", 4]["mode"] == off["a", 5]["mode"] == "SINGLE_PAGE" and off["a", 2]["mode"] == "NEEDS_TILING"


def test_located(spark):
    place = lambda corner, box, found=True: json.dumps({"document_annotation": json.dumps({"cartoucheFound": found, "corner": corner, "rotation": "90-cw", "box": dict(zip(("left", "top", "right", "bottom"), box, strict=True))})})
    said = [("a", 1, 0, place("top-center", (0.1, 0.1, 0.3, 0.3))), ("a", 1, 1, place(" Top-Left", (0.6, 0.7, 1.2, 0.95))), ("a", 1, 2, place("top-left", (0, 0, 0.1, 0.1))), ("a", 2, 0, None), ("a", 3, 0, place("unknown", (0, 0, 0, 0), False))]
    pages = spark.createDataFrame([("a", i, True, 0) for i in (1, 2, 3)], "request_id string, doc_id long, large boolean, text_chars int")
    rows = extraction.located(pages, spark.createDataFrame(said, "request_id string, doc_id long, sample_idx int, response string")).orderBy("doc_id").collect()
    assert [(r.zone, r.found, r.rotation) for r in rows] == [("top-left", True, "90-cw"), (None, None, None), ("unknown", False, "90-cw")]
    assert [round(x, 3) for x in rows[0].region] == [0.58, 0.68, 0.42, 0.29] and rows[1].region is None and rows[2].region is None


@pytest.mark.parametrize(("degrees", "expected"), [(0, (0.1, 0.2, 0.3, 0.4)), (90, (0.2, 0.6, 0.4, 0.3)), (180, (0.6, 0.4, 0.3, 0.4)), (270, (0.4, 0.1, 0.4, 0.3))])
def test_regions_of_turned_pages(spark, degrees, expected):
    row = spark.range(1).select(geometry.unturned(geometry.region(*map(F.lit, (0.1, 0.2, 0.3, 0.4))), F.lit(degrees)).alias("r")).first().r
    assert [round(x, 6) for x in row] == list(expected)
