import pytest
from pyspark.sql import functions as F

from formweave.operators import linkage, validation


def link(spark, pairs, targets, least=80, proposals=None):
    p = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(pairs)], "doc_id long, pair_idx int, label string, value string")
    t = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(targets)], "target_idx int, name string")
    s = spark.createDataFrame([(i, j, x) for i, (_, xs) in enumerate(targets) for j, x in enumerate(xs)], "target_idx int, syn_idx int, synonym string")
    if proposals is None:
        fields, left = linkage.classify(p, t, s, least)
    else:
        a = spark.createDataFrame([(1, i, *x) for i, x in enumerate(proposals)], "doc_id long, asg_idx int, field string, label string, value string")
        fields, left = linkage.classify_with_proposals(p, a, t, s, least)
    rows = fields.orderBy("target_idx").collect()
    assert len(rows) == len(targets)
    assert linkage.linkage_misses(fields, left, s, least).count() == 0
    kept = sorted(r.pair_idx for r in left.collect())
    assert sorted([r.pair_idx for r in rows if r.pair_idx is not None] + kept) == list(range(len(pairs)))
    return [(r.name, r.value, r.status, r.score) for r in rows], kept


R, M = "TO_REVIEW", "MISSING"


@pytest.mark.parametrize(("pairs", "targets", "least", "expected"), [
    ([("DATE", ""), ("DATE", "13/07/2012")], [("DATE", ["DATE"])], 80, [("DATE", "13/07/2012", R, 100)]),
    ([("DATE", "")], [("DATE", ["DATE"])], 80, [("DATE", "", R, 100)]),
    ([("Affaire", "54B")], [("ZONE", ["Zone"])], 80, [("ZONE", None, M, 0)]),
    ([("code", "X"), ("cod", "Y")], [("ALPHA", ["coden"]), ("BETA", ["code"])], 70, [("ALPHA", "Y", R, 75), ("BETA", "X", R, 100)]),
    ([("Indice", "B")], [("Indice", ["Indice"]), ("Indice", ["Indice"])], 80, [("Indice", "B", R, 100), ("Indice", None, M, 0)]),
    ([("NUMERO DE DOCUMENT", "PRORFR120"), ("Zone / Niveau", "N+2"), ("Titre du Dessin", "Plan RDC")], [("Numéro", ["Numéro"]), ("Niveau", ["Niveau"]), ("Titre", ["Titre"])], 80, [("Numéro", "PRORFR120", R, 99), ("Niveau", "N+2", R, 99), ("Titre", "Plan RDC", R, 99)]),
    ([("Doc", "X-1")], [("LONG", ["N° Doc"]), ("DOC", ["Doc"])], 80, [("LONG", None, M, 0), ("DOC", "X-1", R, 100)]),
    ([("Doc", "X-1")], [("NONE", []), ("BLANK", [" "])], 80, [("NONE", None, M, 0), ("BLANK", None, M, 0)]),
])
def test_golden_classification(spark, pairs, targets, least, expected):
    assert link(spark, pairs, targets, least)[0] == expected


@pytest.mark.parametrize(("pairs", "targets", "proposals", "expected", "left"), [
    ([("NUMERO DE DOCUMENT", "PRORFR120"), ("Phase", "EXE")], [("numero", ["numero"])], [("numero", "NUMERO DE DOCUMENT", "PRORFR120")], [("numero", "PRORFR120", R, 99)], [1]),
    ([("PROJET", "FUTUR PALAIS")], [("phase", ["phase"])], [("phase", "PROJET", "FUTUR PALAIS")], [("phase", None, M, 0)], [0]),
    ([("Phase", "EXE")], [("numero", ["numero"])], [("numero", "Numero", "never read")], [("numero", None, M, 0)], [0]),
    ([("Ind.", "A"), ("Zone", "A")], [("indice", ["indice", "ind"]), ("zone", ["zone"])], [("indice", "Ind.", "A")], [("indice", "A", R, 99), ("zone", "A", R, 100)], []),
])
def test_golden_proposals(spark, pairs, targets, proposals, expected, left):
    found, kept = link(spark, pairs, targets, proposals=proposals)
    assert ([x[:3] for x in found], kept) == ([x[:3] for x in expected], left)


def test_repeated_names_share_a_result(spark):
    pairs = spark.createDataFrame([(1, 0, "Indice", "B"), (1, 1, "Indice", "C"), (2, 0, "Ind", "D"), (2, 1, "Indice", "E")], "doc_id long, pair_idx int, label string, value string")
    targets = spark.createDataFrame([(0, "Indice"), (1, "Indice"), (2, "Lot")], "target_idx int, name string")
    synonyms = spark.createDataFrame([(0, 0, "Indice"), (1, 0, "Indice")], "target_idx int, syn_idx int, synonym string")
    proposals = spark.createDataFrame([(2, 0, "Indice", "Ind", "D")], "doc_id long, asg_idx int, field string, label string, value string")
    fields, left = linkage.classify_with_proposals(pairs, proposals, targets, synonyms)
    assert [(r.doc_id, r.target_idx, r.value) for r in fields.orderBy("doc_id", "target_idx").collect()] == [(1, 0, "B"), (1, 1, "B"), (1, 2, None), (2, 0, "D"), (2, 1, "D"), (2, 2, None)]
    assert [(r.doc_id, r.value) for r in left.collect()] == [(2, "E")]


def test_golden_validation(spark):
    codes = spark.createDataFrame([("PHASE", 0, "EXE", "Exécution"), ("PHASE", 1, "APS", "x"), ("LOT", 0, "02", "b"), ("LOT", 1, "03", "Terrassements"), ("TYPE", 0, "O11", "o"), ("NIVEAU", 0, "RDC", "r"), ("LOT", 2, " ", "blank")], "field string, ord int, code string, libelle string")
    rows = [("PHASE", "EXE", R), ("PHASE", "999", R), ("EMETTEUR", "CPI", R), ("LOT", "003", R), ("TYPE", "O11", R), ("NIVEAU", "rdc", R), ("PHASE", "", R), ("PHASE", None, M)]
    fields = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "target_idx int, name string, value string, status string")
    found = [(r.status, r.code, r.code_score, r.value) for r in validation.validate(fields, codes).orderBy("target_idx").collect()]
    ok = "AUTO_VALIDATED"
    assert found == [(ok, "EXE", 100, "EXE"), (R, None, None, "999"), (R, None, None, "CPI"), (ok, "03", 100, "003"), (ok, "O11", 100, "O11"), (ok, "RDC", 100, "rdc"), (R, None, None, ""), (M, None, None, None)]


def test_enrichment_grows_in_order(spark):
    registry = spark.createDataFrame([(0, ["Phase", "Stade"]), (1, ["Stade", "Etape"]), (2, ["Lot"])], "field_idx int, synonyms array<string>")
    labels = spark.createDataFrame([("a", ["phases", "", "phases"]), ("b", ["x"]), ("c", [])], "name string, labels array<string>")
    found = {r.name: r.synonyms for r in validation.enrich(labels, registry).collect()}
    assert found == {"a": ["phases", "Phase", "Stade", "Etape"], "b": ["x"], "c": []}


def test_each_pair_is_used_once(spark):
    import random

    rng = random.Random(3)
    words = ["date", "datum", "lot", "lots", "zone", "zones", "indice"]
    for _ in range(4):
        link(spark, [(rng.choice(words), rng.choice(["", "v"])) for _ in range(8)], [(f"T{i}", rng.sample(words, 2)) for i in range(4)], 70)


def test_empty_pairs(spark):
    empty = spark.createDataFrame([], "doc_id long, pair_idx int, label string, value string")
    targets, synonyms = spark.createDataFrame([(0, "A")], "target_idx int, name string"), spark.createDataFrame([(0, 0, "a")], "target_idx int, syn_idx int, synonym string")
    fields, left = linkage.classify(empty, targets, synonyms)
    assert fields.collect() == [] and left.where(F.lit(True)).collect() == []
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    one = spark.createDataFrame([(2, 0, "A", "x")], empty.schema)
    fields, _ = linkage.classify(one, targets, synonyms, docs=docs)
    assert [(r.doc_id, r.value, r.status, r.score) for r in fields.orderBy("doc_id").collect()] == [(1, None, M, 0), (2, "x", R, 100)]
    none = spark.createDataFrame([], "doc_id long, asg_idx int, field string, label string, value string")
    fields, left = linkage.classify_with_proposals(empty, none, targets, synonyms, docs=docs)
    assert [(r.doc_id, r.status) for r in fields.orderBy("doc_id").collect()] == [(1, M), (2, M)] and left.count() == 0


def scoped(spark):
    """Two requests that use the same places for other fields, and a document that both ask for."""
    pairs = [("r1", 1, 0, "Zone", "Z"), ("r1", 1, 1, "Lot", "3"), ("r2", 1, 0, "Zone", "Z"), ("r2", 1, 1, "Lot", "3"), ("r2", 2, 0, "Lots", "4")]
    targets = [("r1", 0, "ZONE"), ("r1", 1, "LOT"), ("r2", 0, "LOT"), ("r2", 1, "ZONE")]
    synonyms = [("r1", 0, 0, "Zone"), ("r1", 1, 0, "Nothing"), ("r2", 0, 0, "Lot"), ("r2", 1, 0, "Other")]
    frames = [(pairs, "request_id string, doc_id long, pair_idx int, label string, value string"), (targets, "request_id string, target_idx int, name string"), (synonyms, "request_id string, target_idx int, syn_idx int, synonym string"), ([("r1", 1), ("r2", 1), ("r2", 2), ("r2", 3), ("r3", 4)], "request_id string, doc_id long")]
    return [spark.createDataFrame(*x) for x in frames]


def test_requests_are_kept_apart(spark):
    pairs, targets, synonyms, docs = scoped(spark)
    proposals = spark.createDataFrame([("r1", 1, 0, "LOT", "Lot", "3"), ("r2", 2, 0, "LOT", "Lots", "4")], "request_id string, doc_id long, asg_idx int, field string, label string, value string")
    for ask in (lambda p, a, t, s, d: linkage.classify(p, t, s, docs=d), lambda p, a, t, s, d: linkage.classify_with_proposals(p, a, t, s, docs=d)):
        both = ask(pairs, proposals, targets, synonyms, docs)
        for i, keys in enumerate((["doc_id", "target_idx"], ["doc_id", "pair_idx"])):
            for r in ("r1", "r2", "r3"):
                own = ask(*(x.where(F.col("request_id") == r).drop("request_id") for x in (pairs, proposals, targets, synonyms, docs)))[i]
                together = both[i].where(F.col("request_id") == r).drop("request_id")
                assert own.columns == together.columns and own.orderBy(*keys).collect() == together.orderBy(*keys).collect()
    fields = linkage.classify(pairs, targets, synonyms, docs=docs)[0]
    assert sorted((r.request_id, r.doc_id, r.name, r.value) for r in fields.where("value is not null").collect()) == [("r1", 1, "ZONE", "Z"), ("r2", 1, "LOT", "3"), ("r2", 2, "LOT", "4")]
    assert linkage.linkage_misses(fields, linkage.classify(pairs, targets, synonyms, docs=docs)[1], synonyms).count() == 0
    with pytest.raises(ValueError):
        linkage.classify(pairs.drop("request_id"), targets, synonyms)


def test_codes_are_kept_apart(spark):
    fields = spark.createDataFrame([("p1", 1, "PHASE", "EXE", R), ("p2", 2, "PHASE", "EXE", R), ("p3", 3, "PHASE", "EXE", R)], "project string, doc_id long, name string, value string, status string")
    codes = spark.createDataFrame([("p1", "PHASE", 0, "APD", "x"), ("p2", "PHASE", 0, "EXE", "two")], "project string, field string, ord int, code string, libelle string")
    assert [(r.project, r.status, r.code_label) for r in validation.validate(fields, codes).orderBy("project").collect()] == [("p1", R, None), ("p2", "AUTO_VALIDATED", "two"), ("p3", R, None)]
    with pytest.raises(ValueError):
        validation.validate(fields.drop("project"), codes)


def test_linkage_plans_have_no_cartesian_product(spark):
    links = linkage.classify(*scoped(spark)[:3])[0]
    plans = [links, linkage.candidates(*(scoped(spark)[i] for i in (0, 2)))]
    for df in plans:
        assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
