from pyspark.sql import functions as F

from formweave.operators import consensus, geometry, routing, scoring


def test_consensus(spark):
    cases = [[(True, 9), (False, 0), (True, 11)], [(True, 77), (True, 19), (True, 25)], [(False, 0), (False, 0), (True, 5)], [(True, 4)]]
    rows = [(c, i, f, n) for c, samples in enumerate(cases) for i, (f, n) in enumerate(samples)]
    found = {r.call_id: (r.sample_idx, r.found) for r in consensus.extraction_consensus(spark.createDataFrame(rows, "call_id long, sample_idx int, found boolean, n_pairs int")).collect()}
    assert found == {0: (0, True), 1: (2, True), 2: (0, False), 3: (0, True)}
    corners = [["top-center", "top-left", "top-left"], ["Bottom-Right", " bottom-right ", "top-left"]]
    rows = [(c, i, True, x) for c, xs in enumerate(corners) for i, x in enumerate(xs)]
    located = {r.call_id: (r.sample_idx, r.corner) for r in consensus.location_consensus(spark.createDataFrame(rows, "call_id long, sample_idx int, found boolean, corner string")).collect()}
    assert located == {0: (1, "top-left"), 1: (0, "bottom-right")}
    failed = spark.createDataFrame([(1, False), (1, True), (2, False)], "call_id long, ok boolean")
    assert [r.call_id for r in consensus.failed_calls(failed).collect()] == [2]


def test_scores_and_plausibility(spark):
    block = [("Phase", "EXE"), ("Indice", "A"), ("Lot", "03"), ("Niveau", "RDC"), ("Zone", "Z1")]
    panel = [("Maîtrise d'ouvrage", "12 rue des Fleurs 75013 Paris"), ("Contact", "a@b.fr"), ("Tél", "01 23 45 67 89")]
    legend = [("Mur", ""), ("Porte", ""), ("Lot", "")]
    rows = [(d, i, a, b) for d, ps in enumerate([block, panel, legend, [("T", "one very long title indeed that goes on")]]) for i, (a, b) in enumerate(ps)]
    pairs = spark.createDataFrame(rows, "doc_id long, pair_idx int, label string, value string")
    docs = spark.createDataFrame([(i, i != 5) for i in range(5)] + [(9, True)], "doc_id long, found boolean")
    found = {r.doc_id: r for r in scoring.document_scores(docs, pairs).collect()}
    assert found[0].score == 15 and found[1].score < 0 and found[0].plausible and not found[2].plausible and not found[3].plausible and found[9].n_pairs == 0
    hints = {r.doc_id: r.mentions for r in scoring.mentions(docs, pairs, spark.createDataFrame([("phase du projet",)], "label string")).collect()}
    assert hints[0] and not hints[1]
    assert all(r.mentions for r in scoring.mentions(docs, pairs, spark.createDataFrame([], "label string")).collect())


def one(spark, column):
    r = spark.range(1).select(column.alias("r")).first().r
    return r if r is None or isinstance(r, str) else tuple(round(v, 6) for v in r)


def test_geometry(spark):
    n = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, geometry.from_box(*n(0.60, 0.70, 1.20, 0.95))) == (0.6, 0.7, 0.4, 0.25)
    assert one(spark, geometry.from_box(*n(0.6, 0.7, 0.5, 0.9))) is None and one(spark, geometry.from_box(*n(0.6, 0.7, 0.605, 0.9))) is None
    assert one(spark, geometry.expanded(geometry.region(*n(0.90, 0.10, 0.08, 0.20)), F.lit(0.05))) == (0.85, 0.05, 0.15, 0.3)
    assert one(spark, geometry.within(geometry.for_zone(F.lit("bottom-left")), geometry.region(*n(0, 0, 0.775, 0.540)))) == (0, 0.324, 0.31, 0.216)
    assert one(spark, geometry.for_zone(F.lit("top-center"))) == (0.15, 0, 0.7, 0.4) and one(spark, geometry.for_zone(F.lit("unknown"))) == (0, 0, 1, 1)
    assert one(spark, geometry.zone_of(geometry.region(*n(0.7, 0.7, 0.3, 0.3)))) == "bottom-right"


def test_ink_and_turns(spark):
    ink = [(1, x, y, 0) for x in range(0, 300, 10) for y in range(0, 400, 10)] + [(1, 399, 799, 0), (2, 5, 5, 255)]
    pixels = spark.createDataFrame(ink, "img_id long, x int, y int, level int")
    sizes = spark.createDataFrame([(1, 400, 800), (2, 10, 10)], "img_id long, width int, height int")
    rows = {r.img_id: r for r in geometry.ink_bounds(pixels, sizes).collect()}
    assert (rows[1].x, rows[1].y) == (0, 0) and abs(rows[1].w - 0.74) < 0.02 and abs(rows[1].h - 0.5) < 0.02
    assert (rows[2].x, rows[2].y, rows[2].w, rows[2].h) == (0, 0, 1, 1)
    dot = spark.createDataFrame([(1, 0, 0, 7)], "img_id long, x int, y int, level int")
    frame = spark.createDataFrame([(1, 4, 3)], "img_id long, width int, height int")
    assert [tuple(geometry.turned(dot, frame, F.lit(d)).first())[1:3] for d in (0, 90, 180, 270, 45)] == [(0, 0), (2, 0), (3, 2), (0, 3), (0, 0)]
    assert geometry.cropped(dot, frame, geometry.region(*[F.lit(v) for v in (0.5, 0.0, 0.5, 1.0)])).count() == 0


def test_routing(spark):
    box = (0.1, 0.1, 0.2, 0.2)
    pages = spark.createDataFrame([(1, True, 0, None, None, None), (2, True, 0, "top-left", box, None), (3, True, 0, None, None, None), (4, False, 300, None, None, None), (5, False, 10, None, None, None), (6, True, 0, None, None, "top-left"), (7, True, 0, "unknown", box, None), (8, True, 0, " Top-Right ", None, None)], "doc_id long, large boolean, text_chars int, zone string, region struct<x:double,y:double,w:double,h:double>, forced string")
    readings = [
        (1, "corner:bottom-right", 3, -5, True, False), (1, "corner:bottom-left", 5, 9, True, False), (2, "boxed", 2, 0, False, False), (2, "corner:top-left", 0, 0, False, False), (3, "corner:top-left", 0, 0, False, False),
        (4, "text", 9, 1, True, True), (5, "full", 1, 0, False, False), (6, "corner:top-left", 3, 0, True, False),
        (7, "boxed", 0, 0, False, True), (7, "corner:top-left", 5, 0, False, False),  # empty, but with proposals: it speaks of what is asked
        (8, "corner:top-right", 4, 2, True, False), (8, "corner:bottom-right", 4, 2, True, False),  # equals: the located corner comes first
    ]
    df = spark.createDataFrame(readings, "doc_id long, stage string, n_pairs int, score int, passes boolean, mentions boolean")
    found = {r.doc_id: (r["mode"], r.corner, r.quality_passed, r.attempts) for r in routing.route(pages, df).collect()}
    crop = "TWO_PASS_CROP"
    assert found == {1: (crop, "bottom-left", True, 4), 2: (crop, "top-left", False, 1), 3: ("NEEDS_TILING", "unknown", False, 0), 4: ("TEXT_LAYER", None, True, 1), 5: ("SINGLE_PAGE", None, True, 1), 6: (crop, "top-left", True, 1), 7: (crop, "top-left", False, 1), 8: (crop, "top-right", True, 4)}
    unseen = pages.withColumn("found", F.lit(False))
    assert routing.route(unseen, df).where("doc_id = 8").first().corner == "bottom-right"
    off = {r.doc_id: (r["mode"], r.corner) for r in routing.route(pages, df, text_layer=False, locate=False, forced=False).collect()}
    assert off[4] == ("SINGLE_PAGE", None) and off[6] == (crop, "top-left") and off[7] == (crop, "top-left") and off[8] == (crop, "bottom-right") and off[2] == ("NEEDS_TILING", "unknown")


def test_mentions_by_request(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2)], "request_id string, doc_id long")
    pairs = spark.createDataFrame([(r, 1, "Phase") for r in "abc"] + [("d", 2, "x")], "request_id string, doc_id long, label string")
    labels = spark.createDataFrame([("a", "phase"), ("b", "lot"), ("c", None), ("d", "x y")], "request_id string, label string")
    hints = scoring.mentions(docs.unionByName(spark.createDataFrame([("e", 9)], docs.schema)), pairs, labels)
    assert {r.request_id: r.mentions for r in hints.collect()} == {"a": True, "b": False, "c": False, "d": True, "e": True}
    assert "CartesianProduct" not in hints._jdf.queryExecution().executedPlan().toString()
    said = scoring.mentions(docs, pairs, labels, spark.createDataFrame([("b", 1)], "request_id string, doc_id long"))
    assert {r.request_id: r.mentions for r in said.collect()} == {"a": True, "b": True, "c": False, "d": True}
