"""Scores and plausibility of what was read in a document: aggregates over its pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions.fuzzy import token_set_ratio
from formweave.functions.text import CONTACT_TERMS, ID_LABELS, contains_any, fold, is_blank, is_short_code, looks_like_phone, looks_like_postal, simplify, word_count
from formweave.sources.stage import sized

LEAST_PAIRS, MOST_WORDS, HINT_THRESHOLD = 3, 6, 85


def pair_score(label: Column, value: Column) -> Column:
    """+2 for an identification label, +1 for a short code, -3 for a contact, -1 for more than five words."""
    terms = contains_any(F.concat_ws("\n", fold(label), fold(value)), CONTACT_TERMS)
    contact = terms | looks_like_phone(value) | F.coalesce(value.contains("@"), F.lit(False)) | looks_like_postal(value)
    points = [(contains_any(fold(label), ID_LABELS), 2), (is_short_code(value), 1), (contact, -3), (word_count(value) > 5, -1)]
    return sum((F.when(c, n).otherwise(0) for c, n in points), F.lit(0))


def short_filled(label: Column, value: Column) -> Column:
    return ~is_blank(value) & (word_count(label) <= MOST_WORDS) & (word_count(value) <= MOST_WORDS)


def document_scores(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``doc_id, n_pairs, score, plausible`` for each row of ``docs`` (doc_id, found)."""
    per = pairs.groupBy("doc_id").agg(F.count("*").alias("n_pairs"), F.sum(pair_score(F.col("label"), F.col("value"))).alias("score"), F.count_if(short_filled(F.col("label"), F.col("value"))).alias("n_short"))
    rows = docs.join(per, "doc_id", "left").na.fill(0, ["n_pairs", "score", "n_short"])
    return rows.select("doc_id", "n_pairs", "score", _plausible(F.col("found"), F.col("n_pairs"), F.col("n_short")).alias("plausible"))


def _plausible(found: Column, n_pairs: Column, n_short: Column) -> Column:
    return F.coalesce(found, F.lit(False)) & (n_pairs >= LEAST_PAIRS) & (n_short >= LEAST_PAIRS)


def reading_scores(found: Column, fields: Column) -> dict[str, Column]:
    """``n_pairs``, ``score`` and ``passes`` of one reading, from its array of label and value."""
    known = F.coalesce(fields, F.array().cast("array<struct<label:string,value:string>>"))
    score = F.aggregate(F.transform(known, lambda p: pair_score(p["label"], p["value"])), F.lit(0), lambda acc, x: acc + x)
    n_short = F.size(F.filter(known, lambda p: short_filled(p["label"], p["value"])))
    return {"n_pairs": F.size(known), "score": score, "passes": _plausible(found, F.size(known), n_short)}


def mentions(docs: DataFrame, pairs: DataFrame, labels: DataFrame, with_proposals: DataFrame | None = None) -> DataFrame:
    """``doc_id, mentions``: whether some pair's label hints at one of ``labels`` (column label), or nothing is asked for.

    Where ``labels`` carries ``request_id``, so must the other tables, and a document is held against the labels of
    its own request; a request without rows in ``labels`` asks for nothing, one with null labels hints at nothing.
    Documents in ``with_proposals`` count as well. Different labels are scored once.
    """
    scope = ["request_id"] if "request_id" in labels.columns else []
    keys = [*scope, "doc_id"]
    asked = sized(labels.select(*scope, simplify(F.col("label")).alias("b")).distinct().withColumn("__on", F.lit(1)))
    seen = pairs.select(*scope, "label").distinct().withColumn("a", simplify(F.col("label"))).withColumn("__on", F.lit(1))
    met = seen.join(asked, ["__on", *scope]).where((F.col("a") != "") & (F.col("b") != ""))
    close = met.select("a", "b").distinct().where(token_set_ratio(F.col("a"), F.col("b")) >= HINT_THRESHOLD)
    near = met.join(close, ["a", "b"]).select(*scope, "label").distinct()
    hit = pairs.join(sized(near), [*scope, "label"]).select(*keys)
    hit = (hit.unionByName(with_proposals.select(*keys)) if with_proposals is not None else hit).distinct().withColumn("hit", F.lit(True))
    found = docs.select(*keys).join(hit, keys, "left")
    if scope:
        found = found.join(sized(asked.select(*scope).distinct().withColumn("asks", F.lit(True))), scope, "left")
    else:
        found = found.withColumn("asks", F.lit(bool(asked.limit(1).count())))
    return found.select(*keys, (F.coalesce("hit", F.lit(False)) | F.coalesce(~F.col("asks"), F.lit(True))).alias("mentions"))
