"""The whole way from readings of documents to validated fields and a JSON answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formweave.operators import consensus, geometry, linkage, routing, scoring, validation
from formweave.sources import tables
from formweave.sources.stage import staged

_NO_FIELDS, _NO_PROPOSALS = "array<struct<label:string,value:string>>", "array<struct<field:string,label:string,value:string>>"


@dataclass
class Extraction:
    #: One row per call and field asked for, validated.
    fields: DataFrame
    #: The pairs that no field took.
    leftovers: DataFrame
    #: One row per call: mode, corner, quality_passed, attempts, stage, found.
    analyses: DataFrame
    #: One row per call: the JSON answer.
    responses: DataFrame


def located(pages: DataFrame, locations: DataFrame) -> DataFrame:
    """``pages`` with ``zone``, ``region``, ``rotation`` and ``found`` from samples of the locating call.

    ``locations`` has the keys of ``pages``, sample_idx and response; ``pages`` has large and, on demand, ink (the
    region of the page that is drawn on). Samples without an answer do not vote.
    """
    keys = [c for c in ("request_id", "doc_id") if c in pages.columns]
    said = locations.withColumn("x", tables.parsed_response(F.col("response"), tables.LOCATION))
    samples = said.select(F.struct(*keys).alias("call_id"), "sample_idx", F.col("response").isNotNull().alias("ok"), F.col("x.cartoucheFound").alias("found"), "x.corner")
    chosen = consensus.location_consensus(samples).select("call_id.*", "sample_idx", "corner", "found")
    rows = chosen.join(said.select(*keys, "sample_idx", "x"), [*keys, "sample_idx"])
    box = geometry.from_box(*(F.col(f"x.box.{c}") for c in ("left", "top", "right", "bottom")))
    rows = pages.drop("zone", "region", "rotation", "found").join(rows.select(*keys, F.col("corner").alias("zone"), "found", F.col("x.rotation").alias("rotation"), box.alias("box")), keys, "left")
    ink = F.col("ink") if "ink" in pages.columns else F.lit(None).cast("struct<x:double,y:double,w:double,h:double>")
    return rows.withColumn("region", geometry.target_region(F.col("box"), ink, F.col("large"))).drop("box")


def extract(calls: DataFrame, pages: DataFrame, readings: DataFrame, registry: DataFrame | None = None, least: int = linkage.LABEL_THRESHOLD, least_code: int = validation.CODE_THRESHOLD, **switches: bool) -> Extraction:
    """Fields, leftovers and answers of every call.

    ``calls`` has request_id, doc_id and request (JSON): the same request may stand beside several documents, and a
    document may be asked for by several requests. ``pages`` is what ``routing.route`` takes, by request_id and
    doc_id. ``readings`` has request_id, doc_id, stage, sample_idx and response (as the reader answered; null: the
    call failed). ``registry`` (field_idx, synonyms) widens the labels of requests.

    Samples of a stage vote; stages are scored and the route is chosen; proposals and fuzzy assignment link the
    chosen reading's pairs to the request's fields; values are looked up in the request's own codes. A call for
    which nothing was read gives all its fields as MISSING.
    """
    keys = ["request_id", "doc_id"]
    requests = calls.groupBy("request_id").agg(F.min("request").alias("request"))
    asked = staged(tables.request_fields(requests))
    wide = validation.enrich(asked.select("request_id", "target_idx", "name", "labels"), registry) if registry is not None else asked.select("request_id", "target_idx", "name", F.col("labels").alias("synonyms"))
    wide = staged(wide)
    synonyms = wide.select("request_id", "target_idx", F.posexplode("synonyms").alias("syn_idx", "synonym"))
    codes = tables.request_codes(asked)

    parsed = readings.withColumn("x", tables.parsed_response(F.col("response")))
    samples = parsed.select(F.struct(*keys, "stage").alias("call_id"), "sample_idx", F.col("response").isNotNull().alias("ok"), F.col("x.cartoucheFound").alias("found"), F.coalesce(F.size("x.fields"), F.lit(0)).alias("n_pairs"), "x")
    samples = samples.withColumn("n_pairs", F.greatest("n_pairs", F.lit(0)))
    voted = consensus.extraction_consensus(samples)
    fields, said = F.coalesce("x.fields", F.array().cast(_NO_FIELDS)), F.coalesce("x.assignments", F.array().cast(_NO_PROPOSALS))
    voted = staged(voted.select("call_id.*", "found", fields.alias("fields"), said.alias("assignments")))
    # a stage is a document of its own here
    stage_id = F.struct("doc_id", "stage").alias("doc_id")
    labels = wide.select("request_id", F.explode_outer("synonyms").alias("label"))
    hints = scoring.mentions(voted.select("request_id", stage_id), voted.select("request_id", stage_id, F.explode("fields").alias("p")).select("request_id", "doc_id", "p.label"), labels, voted.where(F.size("assignments") > 0).select("request_id", stage_id))
    scored = voted.withColumns(scoring.reading_scores(F.col("found"), F.col("fields")))
    scored = scored.join(hints.select("request_id", "doc_id.*", "mentions"), [*keys, "stage"])
    analyses = routing.route(pages.join(calls.select(*keys).distinct(), keys, "left_semi"), scored.select(*keys, "stage", "n_pairs", "score", "passes", "mentions"), **switches)
    chosen = staged(analyses.join(voted, [*keys, "stage"], "left"))

    pairs = chosen.select(*keys, F.posexplode("fields").alias("pair_idx", "p")).select(*keys, "pair_idx", "p.label", F.coalesce("p.value", F.lit("")).alias("value"))
    proposals = chosen.select(*keys, F.posexplode("assignments").alias("asg_idx", "a")).select(*keys, "asg_idx", "a.*")
    links = linkage.link(pairs, asked.select("request_id", "target_idx", "name"), synonyms, calls.select(*keys).distinct(), proposals, least, by_name=True)
    checked = staged(validation.validate(links.fields(), codes, least_code))
    seen = chosen.select(*keys, "mode", "corner", "quality_passed", "attempts", "stage", F.coalesce("found", F.lit(False)).alias("found"))
    left = links.leftovers()
    return Extraction(checked, left, seen, tables.response_rows(checked, left, seen))
