"""Queries over forms that are derived from the star-schema tables, with their SQL for DuckDB."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formweave.functions import fuzzy, text
from formweave.operators import consensus, extraction, geometry, linkage, routing, scoring, validation
from formweave.sources import tables
from formweave.sources.stage import shared_folder, staged

#: The fields asked for, with their synonyms.
TARGETS = {"STATUS": ["Status", "Statut", "État"], "PRIORITY": ["Priority", "Priorité"], "SEGMENT": ["Segment", "Market"], "NATION": ["Nation", "Country"], "ZONE": ["Zone"]}
#: Label variants by order key.
VARIANTS = {
    0: ["Status", "STATUT :", "Order status", "État"], 1: ["Priority", "Priorité :", "Prio rity", "N° priority"], 2: ["Segment", "Market segment", "SEGMENT", "Mkt"], 3: ["Nation", "Country / Nation", "Pays", "NATION :"],
    4: ["Status", "Remarks", "Status priority", "Segment nation"],
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TARGET_ROWS = [(i, n) for i, n in enumerate(TARGETS)]
_SYNONYM_ROWS = [(i, j, s) for i, n in enumerate(TARGETS) for j, s in enumerate(TARGETS[n])]
_CODE_ROWS = [("STATUS", i, c, c) for i, c in enumerate("OFP")] + [("PRIORITY", i, str(i), f"level {i}") for i in range(1, 6)] + [("SEGMENT", i, c, c.title()) for i, c in enumerate(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"])]

def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, pair_idx, label, value``: five pairs for each order, read off one scan."""
    orders, customer, nation = (_read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    key = F.col("o_orderkey")
    label = lambda i: F.element_at(F.array(*map(F.lit, VARIANTS[i])), (key % 4 + 1).cast("int"))
    first = F.substring("o_orderpriority", 1, 1)
    values = [
        F.when(key % 3 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")), F.when(key % 2 == 0, F.concat(F.lit("00"), first)).otherwise(first),
        F.when(key % 7 == 0, "").when(key % 2 == 0, F.lower("c_mktsegment")).otherwise(F.concat(F.lit(" "), "c_mktsegment")), F.col("n_name"), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("note "), (key % 97).cast("string"))),
    ]
    rows = F.array(*(F.struct(F.lit(i).alias("pair_idx"), label(i).alias("label"), v.alias("value")) for i, v in enumerate(values)))
    return joined.select(key.alias("doc_id"), F.explode(rows).alias("p")).select("doc_id", "p.*")


def _targets(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(_TARGET_ROWS, "target_idx int, name string"), spark.createDataFrame(_SYNONYM_ROWS, "target_idx int, syn_idx int, synonym string")


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.createDataFrame(_CODE_ROWS, "field string, ord int, code string, libelle string")
    nations = _read(spark, sf_dir, "nation").select(F.lit("NATION").alias("field"), F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("code"), F.initcap("n_name").alias("libelle"))
    return fixed.unionByName(nations)


def link_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: each form's fields, linked and validated."""
    fields, _ = linkage.classify(staged(forms(spark, sf_dir)), *_targets(spark))
    return validation.validate(fields, _codes(spark, sf_dir)).select("doc_id", "target_idx", "name", "label", "value", "score", "synonym", "status", "code", "code_score")


def link_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.classify(staged(forms(spark, sf_dir)), *_targets(spark))[1].select("doc_id", "pair_idx", "label", "value")


def linkage_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misses by the threshold of linking: none where it is the one they are judged by, some where only equal labels link."""
    targets, synonyms = _targets(spark)
    pairs = staged(forms(spark, sf_dir))

    def counted(least: int) -> DataFrame:
        fields, left = linkage.classify(pairs, targets, synonyms, least)
        return linkage.linkage_misses(fields, left, synonyms).agg(F.lit(least).alias("least"), F.count("*").alias("n_misses"))

    return counted(linkage.LABEL_THRESHOLD).unionByName(counted(100))


def link_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals drawn from the forms: right ones, ones for the wrong field, and invented values."""
    pairs = staged(forms(spark, sf_dir))
    names = F.array(*map(F.lit, TARGETS))
    wrong = (F.col("pair_idx") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)) % len(TARGETS)
    value = F.when((F.col("doc_id") % 4 == 0) & (F.col("pair_idx") == 1), "invented").otherwise(F.upper("value"))
    proposals = pairs.where("pair_idx < 4").select("doc_id", F.col("pair_idx").alias("asg_idx"), F.element_at(names, wrong + 1).alias("field"), "label", value.alias("value"))
    fields, _ = linkage.classify_with_proposals(pairs, proposals, *_targets(spark))
    return fields.select("doc_id", "target_idx", "name", "label", "value", "score", "status")


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions over whole texts, null ones too."""
    t = F.col("text")
    v = F.concat(F.lit("00"), F.col("doc_id").cast("string"), F.lit(" :"))
    cut = F.when(F.col("doc_id") % 2 == 0, t).otherwise(F.substring(t, 1, 400))  # shorter ones are not cut
    return _read(spark, sf_dir, "documents").select(
        "doc_id", text.normalize_label(t).alias("label_form"), text.normalize_value(v).alias("value_form"), text.simplify(t).alias("simple_form"), text.fold(t).alias("folded"), text.word_count(t).alias("n_words"),
        text.truncated(cut).alias("cut"), tables.readable_text(t).alias("readable"), text.is_retryable((F.lit(500) + F.col("doc_id") % 6).cast("int")).alias("retryable"),
    )


def value_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = forms(spark, sf_dir)
    v, label = F.col("value"), F.col("label")
    return rows.select("doc_id", "pair_idx", text.is_short_code(v).alias("short_code"), text.looks_like_phone(F.concat(v, F.lit(" "), F.col("doc_id").cast("string"))).alias("phone"), text.looks_like_postal(F.concat(F.lit("F "), F.col("doc_id").cast("string"), F.lit(" X"))).alias("postal"), text.contains_any(text.fold(label), text.ID_LABELS).alias("id_label"))


def fuzzy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _read(spark, sf_dir, "nation").select(F.lower("n_name").alias("w")).unionByName(_read(spark, sf_dir, "region").select(F.lower("r_name").alias("w"))).unionByName(_read(spark, sf_dir, "part").select(F.lower("p_type").alias("w"))).distinct()
    other = _read(spark, sf_dir, "nation").select(F.lower(F.concat(F.lit("the "), "n_name")).alias("x"))
    a, b = F.col("w"), F.col("x")
    return words.join(F.broadcast(other)).select("w", "x", fuzzy.ratio(a, b).alias("ratio"), fuzzy.token_set_ratio(a, b).alias("token_set"), fuzzy.similarity(a, b).alias("similarity"))


def synonym_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.array(F.element_at(F.array(*[F.lit(v) for x in VARIANTS.values() for v in x]), (F.col("n_nationkey") % 20 + 1).cast("int")), F.lit(" ")).alias("labels"))
    registry = spark.createDataFrame([(i, TARGETS[n]) for i, n in enumerate(TARGETS)], "field_idx int, synonyms array<string>")
    return validation.enrich(names, registry).select("name", F.array_join("synonyms", "|").alias("synonyms"))


def registry_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact lookups in a registry written as YAML, once with and once without hypotheses."""
    body = "\n".join(f"  {n}:\n    confirmed: {list(x[:1])}\n" + (f"    hypothesis: {list(x[1:])}\n" if len(x) > 1 else "") for n, x in TARGETS.items())
    rows = tables.synonyms_yaml(spark, f"fields:\n{body}  EMPTY:\n    confirmed: ['', ' ']\n  NOTHING:\n")
    asked = _read(spark, sf_dir, "nation").select(F.element_at(F.array(*map(F.lit, [*TARGETS, "EMPTY", "status"])), (F.col("n_nationkey") % 7 + 1).cast("int")).alias("name"), "n_nationkey")
    found = [tables.registry_lookup(asked, tables.registry_of(rows, flag)).withColumn("hypotheses", F.lit(flag)) for flag in (False, True)]
    return found[0].unionByName(found[1]).select("n_nationkey", "name", "hypotheses", F.array_join("synonyms", "|").alias("synonyms"))


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = forms(spark, sf_dir)
    docs = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 11 != 0).alias("found"))
    return scoring.document_scores(docs, pairs)


def label_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return scoring.mentions(docs, forms(spark, sf_dir), spark.createDataFrame([("country",), ("Mkt",)], "label string"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    corner = F.element_at(F.array(*map(F.lit, ["Bottom-Right", " bottom-right ", "top-left", "unknown", ""])), (F.pmod(F.col("conv_id") * 3 + F.col("turn") * F.col("turn"), F.lit(5)) + 1).cast("int"))
    return rows.select(F.col("conv_id").alias("call_id"), F.col("turn").cast("int").alias("sample_idx"), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3)) != 0).alias("found"), F.pmod(F.length("text"), F.lit(37)).cast("int").alias("n_pairs"), ((F.pmod(F.col("conv_id") * 5 + F.col("turn"), F.lit(7)) != 0) & (F.col("conv_id") % 10 != 3)).alias("ok"), corner.alias("corner"))


def extraction_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.extraction_consensus(_samples(spark, sf_dir)).select("call_id", "sample_idx", "found", "n_pairs")


def location_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.location_consensus(_samples(spark, sf_dir))


def failed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.failed_calls(_samples(spark, sf_dir))


def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey")
    side = lambda m, d: (k % m) / F.lit(float(d))
    box = geometry.from_box(side(101, 100), side(89, 100), side(97, 80), side(83, 70))
    rows = rows.select("l_orderkey", "l_linenumber", box.alias("box"), (k % 2 == 0).alias("large"), geometry.for_zone(F.element_at(F.array(*map(F.lit, [*geometry.ZONES, "unknown"])), (k % 10 + 1).cast("int"))).alias("ink")).where("box is not null")
    rows = rows.withColumn("target", geometry.target_region(F.col("box"), F.col("ink"), F.col("large")))
    r6 = lambda c: F.floor(F.col(c) * 1000000 + F.lit(0.5))  # noqa: E731  millionths
    return rows.select("l_orderkey", "l_linenumber", *(r6(f"box.{c}").alias(f"box_{c}") for c in "xywh"), geometry.zone_of(F.col("box")).alias("zone"), geometry.named_zone(text.zone(F.element_at(F.array(*map(F.lit, ["", " Top-Left ", "unknown", "bottom-center"])), (F.col("l_linenumber") % 4 + 1).cast("int"))), F.col("box")).alias("named"), *(r6(f"target.{c}").alias(f"target_{c}") for c in "xywh"))


def corner_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and readings that between them reach every row of the decision."""
    orders = _read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    zones = F.array(*map(F.lit, ["top-left", "bottom-right", "unknown"]))
    corner = geometry.region(*((k % m / F.lit(20.0)) for m in (7, 11)), F.lit(0.2), F.lit(0.3))
    pages = orders.select(k.alias("doc_id"), (k % 3 != 0).alias("large"), (k % 6 * 60).cast("int").alias("text_chars"), F.element_at(zones, (k % 7 % 3 + 1).cast("int")).alias("zone"), F.when(k % 2 == 0, corner).alias("region"), F.when(k % 23 == 0, "top-left").alias("forced"), (k % 19 != 0).alias("found"))
    stages = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(i).alias("i")) for i, s in enumerate(["text", "boxed", "full", *(f"corner:{c}" for c in routing.CORNERS)])))
    n = lambda m, step: (F.col("doc_id") * step + F.col("i") * 31) % m
    readings = orders.select(k.alias("doc_id"), F.explode(stages).alias("s")).select("doc_id", "s.*")
    # every 41st page has no corner readings, every 43rd only empty ones
    readings = readings.where(~((F.col("doc_id") % 41 == 0) & (F.col("i") > 2)))
    pairs = F.when((F.col("doc_id") % 43 == 0) & (F.col("i") > 0), 0).otherwise(n(6, 17)).cast("int")
    readings = readings.select("doc_id", "stage", pairs.alias("n_pairs"), n(9, 29).cast("int").alias("score"), ((n(5, 7) == 0) & (pairs > 0)).alias("passes"), ((n(3, 11) == 0) & (pairs > 0)).alias("mentions"))
    return routing.route(pages, readings)


def routing_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages go each way, with the text layer, locating and forced zones switched off in turn."""
    keys = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    k = F.col("doc_id")
    pages = keys.select("doc_id", (k % 2 == 0).alias("large"), F.lit(300).alias("text_chars"), F.lit("top-left").alias("zone"), F.when(k % 3 == 0, geometry.region(*map(F.lit, (0.1, 0.1, 0.2, 0.2)))).alias("region"), F.when(k % 5 == 0, "top-right").alias("forced"))
    stages = {"text": k % 7 == 0, "boxed": k % 2 == 0, "full": F.lit(False), "corner:top-left": k % 11 == 0, "corner:top-right": k % 4 == 0}
    rows = F.array(*(F.struct(F.lit(s).alias("stage"), c.alias("good")) for s, c in stages.items()))
    readings = keys.select("doc_id", F.explode(rows).alias("s")).select("doc_id", "s.stage", F.lit(4).alias("n_pairs"), F.lit(4).alias("score"), F.col("s.good").alias("passes"), F.col("s.good").alias("mentions"))
    ways = {"none": {}, "text_layer": {"text_layer": False}, "locate": {"locate": False, "text_layer": False}, "forced": {"forced": False, "text_layer": False}}
    counted = [routing.route(pages, readings, **x).groupBy("mode", "corner").agg(F.count("*").alias("n")).withColumn("off", F.lit(name)) for name, x in ways.items()]
    return reduce(DataFrame.unionByName, counted).select("off", "mode", "corner", "n")


def page_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels cropped to a corner and turned, by image."""
    rows = _read(spark, sf_dir, "lineitem")
    pixels = rows.select((F.col("l_suppkey") % 20).alias("img_id"), (F.col("l_orderkey") % 24).alias("x"), (F.col("l_partkey") % 18).alias("y"), (F.col("l_linenumber") * 30).alias("level")).distinct()
    sizes = spark.range(20).select(F.col("id").alias("img_id"), F.lit(24).alias("width"), F.lit(18).alias("height"))
    degrees = F.element_at(F.array(*map(F.lit, (0, 90, 180, 270, 45))), (F.col("img_id") % 5 + 1).cast("int"))
    turned = geometry.turned(pixels, sizes, degrees)
    upright = F.col("img_id") % 5 % 2 == 0
    swapped = sizes.select("img_id", F.when(upright | (F.col("img_id") % 5 == 4), F.col("width")).otherwise(F.col("height")).alias("width"), F.when(upright | (F.col("img_id") % 5 == 4), F.col("height")).otherwise(F.col("width")).alias("height"))
    return geometry.cropped(turned, swapped, geometry.region(*map(F.lit, (0.25, 0.5, 0.5, 0.5))))


def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, resolutions and turned regions of pages made up from orders."""
    k = F.col("o_orderkey")
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", (k % 40 * 100 + 72).cast("double").alias("w"), (k % 25 * 72 + 144).cast("double").alias("h"))
    mm = geometry.page_long_side_mm(F.col("w"), F.col("h"))
    region = geometry.region(k % 5 / F.lit(8.0), k % 3 / F.lit(8.0), F.lit(0.25), F.lit(0.5))
    degrees = (k % 4 * 90).cast("int")
    turned = geometry.unturned(region, degrees)
    r6 = lambda c: F.floor(c * 1000000 + F.lit(0.5))
    return rows.select("o_orderkey", r6(mm).alias("long_side"), geometry.is_large(mm).alias("large"), r6(geometry.render_dpi(F.lit(2200.0), mm, F.lit(300.0))).alias("dpi"), *(r6(turned[c]).alias(f"turned_{c}") for c in "xywh"))


def ink_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    pixels = rows.select((F.col("l_suppkey") % 50).alias("img_id"), ((F.col("l_orderkey") % 40) + F.col("l_suppkey") % 50).alias("x"), (F.col("l_partkey") % 30 + F.col("l_suppkey") % 40).alias("y"), (F.col("l_linenumber") * 60).alias("level"))
    sizes = spark.range(50).select(F.col("id").alias("img_id"), F.lit(120).alias("width"), F.lit(100).alias("height"))
    out = geometry.ink_bounds(pixels.distinct(), sizes)
    return out.select("img_id", *(F.floor(F.col(c) * 1000000 + F.lit(0.5)).alias(c) for c in "xywh"))


def response_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies answered from stored responses; a third has none, and every fifth answer cannot be read."""
    docs = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("body "), F.col("o_orderkey").cast("string")).alias("body"), "o_orderstatus")
    content = F.to_json(F.struct(F.lit(True).alias("cartoucheFound"), F.array(F.struct(F.lit("Status").alias("label"), F.col("o_orderstatus").alias("value"))).alias("fields")))
    fenced = F.concat(F.lit("```json\n"), F.when(F.col("doc_id") % 5 == 0, F.substring(content, 1, 20)).otherwise(content), F.lit("\n```"))
    stored = docs.where("doc_id % 3 <> 0").select(text.cache_key(F.col("body")).alias("key"), F.to_json(F.struct(F.array(F.struct(F.struct(fenced.alias("content")).alias("message"))).alias("choices"))).alias("response"))
    hits, misses = tables.replay(docs.select("doc_id", "body"), stored)
    read = hits.withColumn("r", tables.parsed_response(F.col("response"))).select("doc_id", "key", F.lit(True).alias("hit"), F.coalesce("r.cartoucheFound", F.lit(False)).alias("found"), F.get("r.fields", F.lit(0))["value"].alias("value"))
    return read.unionByName(misses.select("doc_id", "key", F.lit(False).alias("hit"), F.lit(False).alias("found"), F.lit(None).cast("string").alias("value")))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code tables read from CSV files, which are written from star tables: other column orders, a mark, blank lines, quoted line ends."""
    root = f"{shared_folder(spark)}/codes/{uuid.uuid4().hex}"
    nations = sorted((r.n_nationkey, r.n_name) for r in _read(spark, sf_dir, "nation").collect())
    regions = sorted((r.r_regionkey, r.r_name) for r in _read(spark, sf_dir, "region").collect())
    _put(spark, f"{root}/projects/p1/reference_tables/NATION.csv", "\ufefflibelle, extra ,code\r\n" + "".join(f'"{n}, {k}",x, {n}\r\n\r\n' for k, n in nations))
    _put(spark, f"{root}/projects/p2/reference_tables/REGION.csv", "code,libelle\n" + "".join(f'{n},"{n}\nno. {k}"\n,none\n' for k, n in regions))
    _put(spark, f"{root}/projects/p2/reference_tables/HEAD_ONLY.csv", "a,b\n\n")
    _put(spark, f"{root}/projects/p 3/reference_tables/REGION.csv", "a,b\n1,2\n")
    return tables.code_tables(spark, root).withColumn("ord", F.row_number().over(Window.partitionBy("project", "field").orderBy("ord")))


def _put(spark: SparkSession, path: str, content: str) -> None:
    """A file in a folder that only Spark may be able to write."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content.encode()))
    out.close()


def reader_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of the three forms, with prompts and schemas, and the keys they are stored by."""
    k = F.col("o_orderkey")
    field = F.struct(F.col("o_orderstatus").alias("name"), F.when(k % 2 == 0, F.array(F.col("o_orderpriority"), F.lit('say "x"'))).otherwise(F.array().cast("array<string>")).alias("labels"))
    rows = _read(spark, sf_dir, "orders").select(k.alias("doc_id"), F.when(k % 3 == 0, F.array().cast("array<struct<name:string,labels:array<string>>>")).otherwise(F.array(field)).alias("targets"), F.encode(F.when(k % 5 == 0, F.lit("image")).otherwise(F.col("o_orderstatus")), "utf-8").alias("image"))
    names = F.transform("targets", lambda t: t["name"])
    schema, prompt = tables.annotation_format(names), text.read_prompt("Read.", "\nFill:\n", F.col("targets"))
    hint = text.locate_prompt("Find.", " Labels: ", F.flatten(F.transform("targets", lambda t: F.transform(t["labels"], lambda x: F.concat(F.lit(" "), x)))), ".")
    options = tables.Options("m-1", "be exact", 900, "low", 0.0, 7, "high")
    plain = tables.Options("m-2", "", 0, " ", -1.0, -1, "")
    bodies = {"text_body": tables.text_body(options, schema, prompt, F.concat(F.lit('line\n"'), F.col("doc_id").cast("string"))), "image_body": tables.image_body(options, schema, prompt, F.col("image")), "plain_body": tables.image_body(plain, F.lit(tables.location_format(["top-left", "unknown"], ["none", "180"])), hint, F.col("image")), "ocr_body": tables.ocr_body(options, schema, prompt, F.col("image"))}
    out = rows.select("doc_id", *(b.alias(n) for n, b in bodies.items()))
    return out.select("*", *(text.cache_key(F.col(n)).alias(n.replace("body", "key")) for n in bodies))


def replay_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of a store that holds some keys twice, and the tokens its answers report."""
    docs = _read(spark, sf_dir, "orders").select(F.concat(F.lit("body "), F.col("o_orderkey").cast("string")).alias("body"), "o_orderkey")
    usage = F.when(F.col("o_orderkey") % 2 == 0, F.format_string('{"usage":{"prompt_tokens":%d,"completion_tokens":7}}', "o_orderkey")).otherwise("{}")
    stored = docs.where("o_orderkey % 3 <> 0").select(text.cache_key(F.col("body")).alias("key"), usage.alias("response"))
    stored = stored.unionByName(stored.where("key < '8'"))
    counts = tables.replay_counts(docs, stored)
    found = tables.replay(docs, stored)[0].withColumn("u", tables.token_usage(F.col("response")))
    tokens = found.agg(F.count("u").alias("n_usage"), F.sum("u.prompt").alias("prompt"), F.sum("u.completion").alias("completion"), F.sum("u.reasoning").alias("reasoning"))
    return counts.join(tokens)  # one row each


#: Requests that use the same places of fields for other names, labels and codes.
_REQUESTS = {
    "r0": [("STATUS", ["Status", "Statut", "État"], ["O", "F", "P"]), ("NATION", ["Nation", "Country"], []), ("STATUS", ["Segment"], [])],
    "r1": [("PRIORITY", ["Priority", "Priorité"], ["1", "2", "3"]), ("STATUS", ["Order status"], ["X", " "]), ("LOT", ["Lot"], ["BUILDING"])],
    "r2": [("ZONE", ["Nation"], ["FRANCE", "CHINA"]), ("PRIORITY", [], ["1"]), ("SEGMENT", ["Segment", " ", "Market"], ["building", "Household"])],
}


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, pages and readings of the forms: every 13th was read empty, every 17th cannot be parsed, every 19th failed."""
    body = {r: json.dumps({"projectCode": "p", "fields": [{"name": n, "labels": x, "allowedValues": [{"code": c, "libelle": f"{r} {c}"} for c in codes]} for n, x, codes in fields]}, ensure_ascii=False) for r, fields in _REQUESTS.items()}
    request = F.concat(F.lit("r"), F.col("doc_id") % 3).alias("request_id")
    docs = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    calls = docs.select(request, "doc_id", F.element_at(F.create_map(*[F.lit(x) for kv in body.items() for x in kv]), request).alias("request"))
    pages = calls.select("request_id", "doc_id", F.lit(False).alias("large"), F.when(F.col("doc_id") % 4 == 0, 300).otherwise(0).alias("text_chars"), F.lit(None).cast("string").alias("zone"), F.lit(None).cast("struct<x:double,y:double,w:double,h:double>").alias("region"))
    fields = forms(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pair_idx", "label", "value"))).alias("f"))
    fields = fields.withColumn("f", F.transform(F.when(F.col("doc_id") % 13 == 0, F.filter("f", lambda x: F.lit(False))).otherwise(F.col("f")), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"))))
    said = F.transform(F.slice("f", 1, 1), lambda x: F.struct(F.lit("STATUS").alias("field"), x["label"].alias("label"), x["value"].alias("value")))
    text_stage = F.col("doc_id") % 4 == 0
    content = F.to_json(F.struct(F.lit(True).alias("cartoucheFound"), F.col("f").alias("fields"), F.when(text_stage, said).alias("assignments")))
    content = F.when(F.col("doc_id") % 17 == 0, F.substring(content, 1, 30)).otherwise(content)
    answer = F.when(F.col("doc_id") % 19 != 0, F.to_json(F.create_map(F.lit("document_annotation"), content)))
    stage = F.explode(F.when(text_stage, F.array(F.lit("text"), F.lit("full"))).otherwise(F.array(F.lit("full")))).alias("stage")
    readings = fields.select(request, "doc_id", F.lit(0).alias("sample_idx"), answer.alias("response"), stage)
    return calls, pages, readings


def extract_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way, over three requests: validated fields with how their document was read."""
    found = extraction.extract(*_calls(spark, sf_dir))
    how = found.analyses.select("request_id", "doc_id", "mode", "found")
    return found.fields.join(how, ["request_id", "doc_id"]).select("request_id", "doc_id", "target_idx", "name", "label", "value", "score", "synonym", "status", "code", "code_label", "code_score", "mode", "found")


def extract_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON answers of the same calls."""
    return extraction.extract(*_calls(spark, sf_dir)).responses


def project_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values looked up in the code tables of their own project only."""
    k = F.col("c_custkey")
    fields = _read(spark, sf_dir, "customer").select((k % 3).cast("string").alias("project"), k.alias("doc_id"), F.lit("SEGMENT").alias("name"), F.when(k % 5 == 0, F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("s"))).otherwise(F.col("c_mktsegment")).alias("value"), F.lit(linkage.TO_REVIEW).alias("status"))
    codes = spark.createDataFrame([("0", "SEGMENT", 0, "BUILDING", "zero"), ("1", "SEGMENT", 0, "building", "one"), ("1", "SEGMENT", 1, "MACHINERY", "one"), ("2", "OTHER", 0, "BUILDING", "two")], "project string, field string, ord int, code string, libelle string")
    return validation.validate(fields, codes).select("project", "doc_id", "value", "status", "code", "code_label", "code_score")


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    link_fields, link_leftovers, linkage_misses, link_proposals, extract_forms, extract_responses, project_codes, text_functions, value_predicates, fuzzy_scores, synonym_enrichment, registry_synonyms,
    document_scores, label_mentions, extraction_consensus, location_consensus, failed_calls, page_regions, page_pixels, page_sizes, corner_routing, routing_switches, ink_bounds, response_replay, replay_counters,
    reader_requests, code_files,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
