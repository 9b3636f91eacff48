"""Sources and sinks: code tables, synonym lists, uploads, requests, and stored reader responses."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.functions.text import cache_key, is_blank, strip, strip_code_fence
from formweave.operators.validation import active_synonyms

EXTRACTION = "struct<cartoucheFound:boolean,fields:array<struct<label:string,value:string>>,assignments:array<struct<field:string,label:string,value:string>>>"
LOCATION = "struct<cartoucheFound:boolean,corner:string,rotation:string,box:struct<left:double,top:double,right:double,bottom:double>>"
REQUEST = "struct<projectCode:string,fields:array<struct<name:string,labels:array<string>,allowedValues:array<struct<code:string,libelle:string>>>>>"
_SAFE = "[A-Za-z0-9_-]+"


@dataclass(frozen=True)
class Options:
    """What a reader is asked with, beside schema and prompt."""

    model: str
    system: str = ""
    max_tokens: int = 0
    effort: str = ""
    temperature: float = -1.0
    seed: int = -1
    detail: str = ""


def _csv_rows(path: str, content: str) -> list[tuple[int, str, str]]:
    """(ord, code, libelle) of a CSV file's text, by the names in its header; rows without code are skipped."""
    # a mark at the start, blank lines, blanks around cells, and quoted commas and line ends are all allowed
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(content.removeprefix("\ufeff"), newline=""), skipinitialspace=True)]
    rows = [r for r in rows if any(r)]
    if len(rows) < 2:
        return []
    head = rows[0]
    if not {"code", "libelle"} <= set(head):
        raise ValueError(f"{path} needs the columns code and libelle, its header is {head}")
    code, libelle = head.index("code"), head.index("libelle")
    cell = lambda r, i: r[i] if i < len(r) else ""
    return [(i, cell(r, code), cell(r, libelle)) for i, r in enumerate(rows[1:]) if cell(r, code)]


def _parsed_files(files: DataFrame) -> DataFrame:
    """``path, ord, code, libelle`` of whole CSV files (path, value); a file is one code table, and read in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, value in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                rows = _csv_rows(path, value or "")
                columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["path", "ord", "code", "libelle"])

    return files.select("path", "value").mapInArrow(run, "path string, ord int, code string, libelle string")


def code_table(spark: SparkSession, path: str) -> DataFrame:
    """``ord, code, libelle`` of a CSV file with a header; missing columns fail the query."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return _parsed_files(files).select("ord", "code", "libelle")


def is_safe_segment(name: Column) -> Column:
    return F.coalesce(name.rlike(f"^{_SAFE}$") & ~name.contains("\n"), F.lit(False))


def code_tables(spark: SparkSession, root: str) -> DataFrame:
    """``project, field, ord, code, libelle`` of all ``<root>/projects/<project>/reference_tables/<field>.csv``.

    Files whose project or field has other characters than letters, digits, ``_`` and ``-`` are no code tables. A
    file whose header lacks a column fails the query, as a table that is silently empty would validate nothing.
    """
    files = spark.read.text(f"{root}/projects/*/reference_tables/*.csv", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    part = lambda i: F.regexp_extract("path", rf"/projects/({_SAFE})/reference_tables/({_SAFE})\.csv$", i)
    rows = _parsed_files(files.where(part(1) != ""))
    return rows.select(part(1).alias("project"), part(2).alias("field"), "ord", "code", "libelle")


def synonyms_from(spark: SparkSession, fields: dict[str, dict[str, list[str] | None]]) -> DataFrame:
    """``field_idx, field, kind, syn_idx, synonym`` of a parsed synonym list, in its order, without blanks."""
    rows = [(i, name, kind, j, s) for i, (name, lists) in enumerate(fields.items()) for kind in ("confirmed", "hypothesis") for j, s in enumerate(x for x in (lists or {}).get(kind) or [] if x and x.strip())]
    return spark.createDataFrame(rows, "field_idx int, field string, kind string, syn_idx int, synonym string")


def synonyms_yaml(spark: SparkSession, content: str) -> DataFrame:
    """``synonyms_from`` of a YAML text with the root key ``fields``."""
    try:
        import yaml
    except ImportError as missing:
        raise ImportError("reading YAML needs the yaml module; synonyms_from takes a parsed list") from missing
    document = yaml.safe_load(content)
    fields = document.get("fields") if isinstance(document, dict) else None
    if not isinstance(fields, dict):
        raise ValueError("the root key fields is missing or no mapping")
    lists = lambda body: {k: [str(x) for x in body[k] if x is not None] for k in ("confirmed", "hypothesis") if isinstance(body.get(k), list)}
    return synonyms_from(spark, {str(n): lists(body) if isinstance(body, dict) else {} for n, body in fields.items()})


def registry_of(synonyms: DataFrame, with_hypotheses: bool = False) -> DataFrame:
    """``field_idx, field, synonyms`` from rows of ``synonyms_from``: each field's active list, in order.

    A field without synonyms has no row there, and none here: nothing can match it.
    """
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("syn_idx", "synonym")))), lambda x: x["synonym"])
    both = synonyms.groupBy("field_idx", "field").agg(listed("confirmed").alias("confirmed"), listed("hypothesis").alias("hypothesis"))
    return both.select("field_idx", "field", active_synonyms(F.col("confirmed"), F.col("hypothesis"), with_hypotheses).alias("synonyms"))


def registry_lookup(names: DataFrame, registry: DataFrame) -> DataFrame:
    """``names`` (name) with the ``synonyms`` of the field that has exactly that name, null where there is none."""
    return names.join(registry.select(F.col("field").alias("name"), "synonyms"), "name", "left")


def uploads(spark: SparkSession, path: str, requests: DataFrame) -> DataFrame:
    """Files with their parsed request (``requests`` has path and request); ``error`` says why a row is refused.

    Spark's reader leaves empty files out, so a request whose file is not read is refused as one for an empty file.
    """
    files = spark.read.format("binaryFile").load(path)
    rows = files.join(requests, "path", "full_outer").withColumn("parsed", F.from_json("request", REQUEST))
    error = F.when(F.coalesce("length", F.lit(0)) == 0, "empty file").when(is_blank(F.col("request")), "no request").when(F.col("parsed").isNull() | F.col("parsed.fields").isNull(), "unreadable request")
    return rows.withColumn("error", error)


def request_fields(requests: DataFrame) -> DataFrame:
    """``request_id, target_idx, name, labels, allowed`` of JSON requests (request_id, request).

    Requests that cannot be read give no rows; ``unreadable_requests`` tells which.
    """
    parsed = requests.withColumn("r", F.from_json("request", REQUEST))
    allowed = F.filter(F.coalesce("f.allowedValues", F.array().cast("array<struct<code:string,libelle:string>>")), lambda v: ~is_blank(v["code"]))
    return parsed.select("request_id", F.posexplode("r.fields").alias("target_idx", "f")).select("request_id", "target_idx", "f.name", F.coalesce("f.labels", F.array().cast("array<string>")).alias("labels"), allowed.alias("allowed"))


def unreadable_requests(requests: DataFrame) -> DataFrame:
    """The requests (request_id, request) that are blank or no JSON of a request."""
    return requests.where(is_blank(F.col("request")) | F.from_json("request", REQUEST)["fields"].isNull())


def request_codes(fields: DataFrame) -> DataFrame:
    """``request_id, field, ord, code, libelle``: of names asked twice, the last list that is not empty counts."""
    last = fields.where(F.size("allowed") > 0).groupBy("request_id", "name").agg(F.max_by("allowed", "target_idx").alias("allowed"))
    return last.select("request_id", F.col("name").alias("field"), F.posexplode("allowed").alias("ord", "v")).select("request_id", "field", "ord", "v.code", "v.libelle")


def data_uri(content: Column) -> Column:
    """An image as a data URI, its type told by the first bytes."""
    kind = F.when(F.hex(F.substring(content, 1, 2)) == "FFD8", "jpeg").otherwise("png")
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64(content))


def annotation_format(targets: Column, name: str = "extraction") -> Column:
    """The strict schema of a reading as JSON text; with targets (array of names), proposals are asked for as well."""

    def schema(names: str | None) -> str:
        text = {"type": "string"}
        record = lambda **of: {"type": "object", "properties": of, "required": list(of), "additionalProperties": False}
        of = {"cartoucheFound": {"type": "boolean"}, "fields": {"type": "array", "items": record(label=text, value=text)}}
        if names:
            of["assignments"] = {"type": "array", "items": record(field={"type": "string", "enum": names}, label=text, value=text)}
        return json.dumps({"type": "json_schema", "json_schema": {"name": name, "schema": record(**of), "strict": True}}, separators=(",", ":"))

    with_names = F.replace(F.lit(schema("@names@")), F.lit('"@names@"'), F.to_json(targets))
    return F.when(F.coalesce(F.size(targets), F.lit(0)) > 0, with_names).otherwise(F.lit(schema(None)))


def location_format(zones: list[str], rotations: list[str], name: str = "location") -> str:
    """The strict schema of a locating answer."""
    sides = {c: {"type": "number"} for c in ("left", "top", "right", "bottom")}
    record = lambda of: {"type": "object", "properties": of, "required": list(of), "additionalProperties": False}
    of = {"cartoucheFound": {"type": "boolean"}, "box": record(sides), "corner": {"type": "string", "enum": zones}, "rotation": {"type": "string", "enum": rotations}}
    return json.dumps({"type": "json_schema", "json_schema": {"name": name, "schema": record(of), "strict": True}}, separators=(",", ":"))


def _chat(options: Options, schema: Column, content: Column) -> Column:
    """A chat body whose user message is the JSON text ``content``; options that are blank, negative or zero are left out."""
    lit = lambda v: F.lit(v)
    parts = [
        F.concat(lit('"model":'), _json_text(lit(options.model))),
        F.concat(lit('"response_format":'), schema),
        *([lit(f'"max_completion_tokens":{options.max_tokens}')] if options.max_tokens > 0 else []),
        *([F.concat(lit('"reasoning_effort":'), _json_text(lit(options.effort)))] if options.effort.strip() else []),
        *([lit(f'"temperature":{options.temperature}')] if options.temperature >= 0 else []),
        *([lit(f'"seed":{options.seed}')] if options.seed >= 0 else []),
        F.concat(lit('"messages":[{"role":"system","content":'), _json_text(lit(options.system)), lit('},{"role":"user","content":'), content, lit("}]")),
    ]
    return F.concat(lit("{"), F.concat_ws(",", *parts), lit("}"))


def _json_text(text: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def text_body(options: Options, schema: Column, prompt: Column, text: Column) -> Column:
    """A request that reads a document's text layer."""
    return _chat(options, schema, _json_text(F.concat(prompt, F.lit("\n\n"), text)))


def image_body(options: Options, schema: Column, prompt: Column, image: Column) -> Column:
    """A request that reads an image, in the chat form."""
    detail = F.concat(F.lit(',"detail":'), _json_text(F.lit(options.detail))) if options.detail.strip() else F.lit("")
    parts = F.concat(F.lit('[{"type":"text","text":'), _json_text(prompt), F.lit('},{"type":"image_url","image_url":{"url":'), _json_text(data_uri(image)), detail, F.lit("}}]"))
    return _chat(options, schema, parts)


def ocr_body(options: Options, schema: Column, prompt: Column, image: Column) -> Column:
    """A request that reads an image, in the document form."""
    lit = lambda v: F.lit(v)
    return F.concat(
        lit('{"model":'), _json_text(lit(options.model)), lit(',"document_annotation_format":'), schema, lit(',"document_annotation_prompt":'), _json_text(prompt),
        lit(',"include_image_base64":false,"document":{"type":"image_url","image_url":'), _json_text(data_uri(image)), lit("}}"),
    )


def token_usage(response: Column) -> Column:
    """Tokens of the prompt, the answer and the reasoning that a response reports (-1, -1 and 0 where it does not)."""
    count = lambda path, default: F.coalesce(F.get_json_object(response, path).cast("int"), F.lit(default))
    named = F.struct(count("$.usage.prompt_tokens", -1).alias("prompt"), count("$.usage.completion_tokens", -1).alias("completion"), count("$.usage.completion_tokens_details.reasoning_tokens", 0).alias("reasoning"))
    return F.when(F.get_json_object(response, "$.usage").isNotNull(), named)


def parsed_response(response: Column, schema: str = EXTRACTION) -> Column:
    """What a reader answered, from either of the two forms; null where it cannot be read."""
    direct = F.get_json_object(response, "$.document_annotation")
    chat = strip_code_fence(F.get_json_object(response, "$.choices[0].message.content"))
    return F.from_json(F.coalesce(direct, chat), schema)


def replay(bodies: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored responses by the hash of the request body, and the bodies that have none.

    ``responses`` (key, response) counts once per key: of several, the least non-null.
    """
    keyed = bodies.withColumn("key", cache_key(F.col("body")))
    stored = responses.groupBy("key").agg(F.min("response").alias("response"))
    return keyed.join(stored, "key"), keyed.join(stored, "key", "left_anti")


def replay_counts(bodies: DataFrame, responses: DataFrame) -> DataFrame:
    """``hits, misses``: one row."""
    found, missed = replay(bodies, responses)
    both = found.select(F.lit(1).alias("hit")).unionAll(missed.select(F.lit(0).alias("hit")))
    return both.agg(F.count_if(F.col("hit") == 1).alias("hits"), F.count_if(F.col("hit") == 0).alias("misses"))


def readable_text(text: Column, least: int = 200) -> Column:
    """A text layer that is long enough to be used, else empty."""
    return F.when(F.length(strip(text)) >= least, text).otherwise("")


def text_layers(files: DataFrame, extract: Callable[[bytes], str | None], least: int = 200) -> DataFrame:
    """``path, text`` of whole files (path, content): what ``extract`` finds in a file, if it is long enough, else empty.

    ``extract`` brings the format's library with it; a file that it cannot read has no text.
    """

    def found(content: bytes | None) -> str:
        try:
            return extract(bytes(content or b"")) or ""
        except Exception:  # noqa: BLE001  whatever the library raises, the other ways of reading remain
            return ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([found(v.as_py()) for v in batch.column(1)], pa.string())], names=["path", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, text string").select("path", readable_text(F.col("text"), least).alias("text"))


def response_rows(fields: DataFrame, left: DataFrame, analyses: DataFrame | None = None, duration_ms: Column | None = None) -> DataFrame:
    """``doc_id, response`` (and request_id): one JSON answer per document; members without a value are null.

    Fields stand in the order asked, pairs in the order read; without pairs the list is empty, not absent. With
    ``analyses`` (mode, corner, quality_passed, found), these come first.
    """
    keys = [c for c in ("request_id", "doc_id") if c in fields.columns]
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    own = [c for c in ("code", "code_label", "code_score") if c in fields.columns]
    asked = fields.groupBy(*keys).agg(ordered("target_idx", "name", "value", "status", "label", "score", *own).alias("f"))
    rest = left.groupBy(*keys).agg(ordered("pair_idx", "label", "value").alias("p"))
    shown = {"name": "name", "value": "value", "status": "status", "label": "rawLabel", "score": "matchScore", "code": "referenceCode", "code_label": "referenceLabel", "code_score": "referenceScore"}
    listed = F.transform("f", lambda x: F.struct(*(x[c].alias(n) for c, n in shown.items() if c in ("name", "value", "status", "label", "score", *own))))
    pairs = F.coalesce(F.transform("p", lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"))), F.array().cast("array<struct<label:string,value:string>>"))
    body = [listed.alias("fields"), pairs.alias("unclassifiedPairs")]
    rows = asked.join(rest, keys, "left")
    if analyses is not None:
        rows = analyses.select(*keys, "mode", "corner", "quality_passed", "found").join(rows, keys, "left")
        rows = rows.withColumn("f", F.coalesce("f", F.array().cast(asked.schema["f"].dataType)))
        body = [F.col("found").alias("cartoucheFound"), F.col("mode"), F.col("corner"), F.col("quality_passed").alias("qualityPassed"), listed.alias("fields"), pairs.alias("unclassifiedPairs")]
    if duration_ms is not None:
        body.append(duration_ms.cast("long").alias("durationMs"))
    return rows.select(*keys, F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("response"))
