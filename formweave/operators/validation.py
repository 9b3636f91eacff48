"""Looking up field values in code tables, and widening labels by known synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions.fuzzy import cannot_reach, ratio
from formweave.functions.text import is_blank, normalize_label, normalize_value
from formweave.operators.linkage import AUTO_VALIDATED, TO_REVIEW
from formweave.sources.stage import sized, staged

CODE_THRESHOLD = 85


def validate(fields: DataFrame, codes: DataFrame, least: int = CODE_THRESHOLD) -> DataFrame:
    """``fields`` with ``code``, ``code_label`` and ``code_score`` of the nearest code, the first of equals.

    ``codes`` has field, ord, code and libelle, and ``request_id`` or ``project`` where tables belong to one: a value
    is then looked up in the tables of its own request or project only, and ``fields`` must carry that column. Only a
    field under review with a value is looked up; a value without a code near enough is kept as it is. Different
    values are normalized and scored once; ``fields`` is read twice.
    """
    scope = [c for c in ("request_id", "project") if c in codes.columns]
    missing = [c for c in scope if c not in fields.columns]
    if missing:
        raise ValueError(f"codes are kept by {missing}, which the fields do not carry")
    keys = [*scope, "name"]
    asked = fields.where((F.col("status") == TO_REVIEW) & ~is_blank(F.col("value"))).select(*keys, "value").distinct().withColumn("__v", normalize_value(F.col("value")))
    table = sized(codes.where(~is_blank(F.col("code"))).select(*scope, F.col("field").alias("name"), "ord", "code", "libelle", normalize_value(F.col("code")).alias("__c")))
    asked = staged(asked.join(table.select(*keys).distinct(), keys, "left_semi"))  # the values that have a table
    met = asked.select(*keys, "__v").distinct().join(table, keys).where(~cannot_reach(F.col("__v"), F.col("__c"), least))
    scored = met.withColumn("s", ratio(F.col("__v"), F.col("__c"))).where(F.col("s") >= least)
    best = scored.groupBy(*keys, "__v").agg(F.max_by(F.struct("code", "libelle", "s"), F.struct("s", -F.col("ord"))).alias("__b"))
    hits = asked.join(best, [*keys, "__v"]).select(*keys, "value", "__b")
    rows = fields.join(sized(hits), [*keys, "value"], "left").withColumn("__b", F.when(F.col("status") == TO_REVIEW, F.col("__b")))
    status = F.when(F.col("__b").isNotNull(), AUTO_VALIDATED).otherwise(F.col("status"))
    kept = [c for c in fields.columns if c != "status"]
    return rows.select(*kept, status.alias("status"), F.col("__b.code").alias("code"), F.col("__b.libelle").alias("code_label"), F.col("__b.s").alias("code_score"))


def enrich(labels: DataFrame, registry: DataFrame, least: int = 80) -> DataFrame:
    """``labels`` with ``synonyms`` for its ``labels`` array: the caller's, widened by the registry's fields they match.

    ``registry`` has field_idx and synonyms (array). Fields are tried in order, and what one adds counts for the next.
    Different label lists are widened once. The registry is one row after aggregation.
    """
    own = F.array_distinct(F.filter(F.coalesce("labels", F.array().cast("array<string>")), lambda x: ~is_blank(x)))
    rows = labels.withColumn("__own", own)
    ordered = registry.groupBy().agg(F.array_sort(F.collect_list(F.struct("field_idx", "synonyms"))).alias("registry"))

    def step(now: Column, field: Column) -> Column:
        near = F.exists(now, lambda a: F.exists(field["synonyms"], lambda b: ratio(normalize_label(a), normalize_label(b)) >= least))
        return F.when(near, F.array_distinct(F.concat(now, field["synonyms"]))).otherwise(now)

    wide = rows.select("__own").distinct().join(F.broadcast(ordered)).select("__own", F.aggregate("registry", F.col("__own"), step).alias("synonyms"))
    return rows.join(sized(wide), "__own").select(*(c for c in labels.columns if c not in ("labels", "synonyms")), "synonyms")


def active_synonyms(confirmed: Column, hypothesis: Column, with_hypotheses: bool) -> Column:
    """The confirmed list, and on demand the hypotheses behind it; null lists are empty."""
    known = [F.coalesce(x, F.array().cast("array<string>")) for x in ((confirmed, hypothesis) if with_hypotheses else (confirmed,))]
    return F.concat(*known)
