import json

import pytest
from pyspark.sql import functions as F

from formweave.operators.validation import active_synonyms
from formweave.sources import tables


def test_code_tables(spark, tmp_path):
    folder = tmp_path / "projects/p1/reference_tables"
    folder.mkdir(parents=True)
    (folder / "LOT.csv").write_text('﻿code,libelle\n 03 ,"Terre, roche"\n\n,none\n04,Gros\n', encoding="utf-8")
    (folder / "BAD.csv").write_text("a,b\n1,2\n")
    assert [tuple(r) for r in tables.code_table(spark, str(folder / "LOT.csv")).orderBy("ord").collect()] == [(0, "03", "Terre, roche"), (2, "04", "Gros")]
    for bad in (lambda: tables.code_table(spark, str(folder / "BAD.csv")), lambda: tables.code_tables(spark, str(tmp_path))):
        with pytest.raises(Exception, match="needs the columns code and libelle"):
            bad().collect()
    (folder / "BAD.csv").unlink()
    (folder / "SWAPPED.csv").write_text('libelle,other,code\r\n"two\nlines",x, A \r\nonly libelle\r\n"say ""x""",,B\r\n', encoding="utf-8")
    (folder / "EMPTY.csv").write_text("a,b\n\n")
    (tmp_path / "projects/p 2/reference_tables").mkdir(parents=True)
    (tmp_path / "projects/p 2/reference_tables/BAD.csv").write_text("a,b\n1,2\n")
    found = [tuple(r) for r in tables.code_tables(spark, str(tmp_path)).orderBy("field", "ord").drop("ord").collect()]
    assert found == [("p1", "LOT", "03", "Terre, roche"), ("p1", "LOT", "04", "Gros"), ("p1", "SWAPPED", "A", "two\nlines"), ("p1", "SWAPPED", "B", 'say "x"')]
    names = spark.createDataFrame([("ok_1",), ("../x",), (None,), ("a\n",)], "n string")
    assert [r.x for r in names.select(tables.is_safe_segment(F.col("n")).alias("x")).collect()] == [True, False, False, False]


def test_synonyms(spark):
    rows = tables.synonyms_from(spark, {"A": {"confirmed": ["x", " "], "hypothesis": None}, "B": {}, "C": {"hypothesis": ["y"]}}).collect()
    assert [tuple(r) for r in rows] == [(0, "A", "confirmed", 0, "x"), (2, "C", "hypothesis", 0, "y")]


def test_synonym_file(spark):
    content = "# a note\nfields:\n  PHASE:\n    confirmed: [Phase, Pha, ' ', null, 3]\n    hypothesis: []\n  LOT:\n    confirmed: [Lot]\n    hypothesis: [Discipline]\n  NONE:\n"
    rows = tables.synonyms_yaml(spark, content)
    assert [(r.field, r.synonyms) for r in tables.registry_of(rows).orderBy("field_idx").collect()] == [("PHASE", ["Phase", "Pha", "3"]), ("LOT", ["Lot"])]
    both = tables.registry_of(rows, True)
    assert [r.synonyms for r in both.where("field = 'LOT'").collect()] == [["Lot", "Discipline"]]
    names = spark.createDataFrame([("LOT",), ("lot",), ("NONE",)], "name string")
    assert {r.name: r.synonyms for r in tables.registry_lookup(names, both).collect()} == {"LOT": ["Lot", "Discipline"], "lot": None, "NONE": None}
    for bad in ("other: 1", "fields: [a]", "- a", ""):
        with pytest.raises(ValueError):
            tables.synonyms_yaml(spark, bad)
    lists = spark.createDataFrame([(["a"], None), (None, ["b"])], "c array<string>, h array<string>")
    shown = lists.select(active_synonyms(F.col("c"), F.col("h"), True).alias("x"), active_synonyms(F.col("c"), F.col("h"), False).alias("y")).collect()
    assert [(r.x, r.y) for r in shown] == [(["a"], ["a"]), (["b"], [])]


def test_requests_and_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.pdf").write_bytes(b"")
    request = json.dumps({"projectCode": "P", "extra": 1, "fields": [{"name": "f", "labels": ["l"], "allowedValues": [{"code": "1", "libelle": "one"}, {"code": " "}]}, {"name": "f", "allowedValues": []}, {"name": "g"}]})
    requests = spark.createDataFrame([(f"file:{tmp_path}/a.pdf", request), (f"file:{tmp_path}/b.pdf", request)], "path string, request string")
    found = {r.path[-5:]: r.error for r in tables.uploads(spark, str(tmp_path), requests).collect()}
    assert found == {"a.pdf": None, "b.pdf": "empty file"}
    fields = tables.request_fields(spark.createDataFrame([(7, request)], "request_id long, request string"))
    assert [(r.name, r.labels) for r in fields.orderBy("target_idx").collect()] == [("f", ["l"]), ("f", []), ("g", [])]
    assert [tuple(r) for r in tables.request_codes(fields).collect()] == [(7, "f", 0, "1", "one")]
    said = spark.createDataFrame([(1, request), (2, "{"), (3, " "), (4, None), (5, '{"fields": []}')], "request_id long, request string")
    assert sorted(r.request_id for r in tables.unreadable_requests(said).collect()) == [2, 3, 4]


def test_responses(spark):
    good = '{"cartoucheFound":true,"fields":[{"label":"a","value":"b"}]}'
    answers = [json.dumps({"document_annotation": good}), json.dumps({"choices": [{"message": {"content": f"```json\n{good}\n```"}}]}), json.dumps({"document_annotation": good[:20]}), "no json"]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, response string")
    rows = df.withColumn("r", tables.parsed_response(F.col("response"))).orderBy("i").collect()
    assert [bool(r.r and r.r.fields) for r in rows] == [True, True, False, False]
    bodies = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, body string")
    stored = bodies.limit(1).select(F.sha2("body", 256).alias("key"), F.lit("r").alias("response"))
    hits, misses = tables.replay(bodies, stored)
    assert [r.doc_id for r in hits.collect()] == [1] and [r.doc_id for r in misses.collect()] == [2]
    twice = stored.unionByName(stored)  # a key that is stored twice
    assert tables.replay(bodies, twice)[0].count() == 1 and tuple(tables.replay_counts(bodies, twice).first()) == (1, 1)
    texts = spark.createDataFrame([("x" * 200,), (" " + "x" * 199,), (None,)], "t string")
    assert [len(r.x) for r in texts.select(tables.readable_text(F.col("t")).alias("x")).collect()] == [200, 0, 0]


def test_bodies_and_images(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xd8abc"), 'a "b"\n', ["A", "B"]), (bytearray(b"\x89PNG"), "", [])], "c binary, t string, names array<string>")
    full, bare = tables.Options("m", "system", 9, "low", 0.5, 0, "low"), tables.Options("m")
    schema = tables.annotation_format(F.col("names"))
    rows = df.select(tables.text_body(full, schema, F.lit("p"), F.col("t")).alias("a"), tables.image_body(bare, schema, F.lit("p"), F.col("c")).alias("b"), tables.ocr_body(bare, schema, F.lit("p"), F.col("c")).alias("o"), tables.data_uri(F.col("c")).alias("u")).collect()
    assert [r.u.split(";")[0] for r in rows] == ["data:image/jpeg", "data:image/png"]
    a, b, o = ([json.loads(r[c]) for r in rows] for c in "abo")
    assert list(a[0]) == ["model", "response_format", "max_completion_tokens", "reasoning_effort", "temperature", "seed", "messages"]
    assert a[0]["messages"] == [{"role": "system", "content": "system"}, {"role": "user", "content": 'p\n\na "b"\n'}] and (a[0]["temperature"], a[0]["seed"]) == (0.5, 0)
    assert list(b[0]) == ["model", "response_format", "messages"]
    assert b[1]["messages"][1]["content"] == [{"type": "text", "text": "p"}, {"type": "image_url", "image_url": {"url": rows[1].u}}]
    assert o[0]["document"] == {"type": "image_url", "image_url": rows[0].u} and o[0]["include_image_base64"] is False
    with_names, without = (x["response_format"]["json_schema"] for x in a)
    assert with_names["strict"] and with_names["schema"]["required"] == ["cartoucheFound", "fields", "assignments"] and not with_names["schema"]["additionalProperties"]
    assert with_names["schema"]["properties"]["assignments"]["items"]["properties"]["field"]["enum"] == ["A", "B"]
    assert without["schema"]["required"] == ["cartoucheFound", "fields"] and set(without["schema"]["properties"]) == {"cartoucheFound", "fields"}
    place = json.loads(tables.location_format(["top-left"], ["none"]))["json_schema"]["schema"]
    assert place["required"] == ["cartoucheFound", "box", "corner", "rotation"] and place["properties"]["box"]["required"] == ["left", "top", "right", "bottom"]


def test_text_layers(spark):
    def extract(content):
        if content.startswith(b"!"):
            raise RuntimeError("no such format")
        return content.decode() if content else None

    files = spark.createDataFrame([("a", b"x" * 250), ("b", b"!" * 300), ("c", b" " * 300 + b"y"), ("d", None), ("e", b"")], "path string, content binary")
    assert {r.path: len(r.text) for r in tables.text_layers(files, extract).collect()} == {"a": 250, "b": 0, "c": 0, "d": 0, "e": 0}


def test_token_usage(spark):
    df = spark.createDataFrame([('{"usage":{"prompt_tokens":3,"completion_tokens_details":{"reasoning_tokens":2}}}',), ("{}",), (None,)], "r string")
    assert [r.u and tuple(r.u) for r in df.select(tables.token_usage(F.col("r")).alias("u")).collect()] == [(3, -1, 2), None, None]


def test_stream(spark, tmp_path):
    from formweave.streaming.forms import link_stream

    schema = "doc_id long, pair_idx int, label string, value string"
    spark.createDataFrame([(1, 0, "Lot", "3"), (2, 0, "Other", "x")], schema).write.parquet(str(tmp_path / "in"))
    targets = spark.createDataFrame([(0, "LOT")], "target_idx int, name string")
    synonyms = spark.createDataFrame([(0, 0, "lot")], "target_idx int, syn_idx int, synonym string")
    codes = spark.createDataFrame([("LOT", 0, "03", "x")], "field string, ord int, code string, libelle string")
    link_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), targets, synonyms, codes, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.doc_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "AUTO_VALIDATED"), (2, "MISSING")]
