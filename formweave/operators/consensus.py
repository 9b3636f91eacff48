"""Consensus over repeated readings of one call. A failed sample has ``ok`` false and does not vote."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formweave.functions.text import zone


def _camps(samples: DataFrame) -> DataFrame:
    """Samples that worked, with whether most found something (a tie counts as found), in the majority's camp."""
    good = samples.where(F.coalesce("ok", F.lit(True))) if "ok" in samples.columns else samples
    good = good.withColumn("found", F.coalesce("found", F.lit(False)))
    all_of = Window.partitionBy("call_id")
    most = 2 * F.sum(F.col("found").cast("int")).over(all_of) >= F.count("*").over(all_of)
    return good.withColumn("majority", most).where(F.col("found") == F.col("majority"))


def extraction_consensus(samples: DataFrame) -> DataFrame:
    """``call_id, sample_idx, found, n_pairs`` and further columns: the low median by number of pairs in the majority's camp."""
    order = Window.partitionBy("call_id").orderBy("n_pairs", "sample_idx")
    camp = _camps(samples.withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0))))
    place, size = F.row_number().over(order), F.count("*").over(Window.partitionBy("call_id"))
    return camp.withColumn("place", place).withColumn("size", size).where(F.col("place") == F.floor((F.col("size") - 1) / 2) + 1).drop("place", "size", "majority", "ok")


def location_consensus(samples: DataFrame) -> DataFrame:
    """``call_id, sample_idx, found, corner``: the first sample with the most frequent zone (ties: seen first)."""
    camp = _camps(samples).withColumn("corner", F.coalesce(zone(F.col("corner")), F.lit("unknown")))
    votes = camp.groupBy("call_id", "found", "corner").agg(F.count("*").alias("n"), F.min("sample_idx").alias("sample_idx"))
    best = votes.groupBy("call_id").agg(F.max_by(F.struct("sample_idx", "found", "corner"), F.struct("n", -F.col("sample_idx"))).alias("x"))
    return best.select("call_id", "x.*")


def failed_calls(samples: DataFrame) -> DataFrame:
    """Calls of which no sample worked."""
    return samples.groupBy("call_id").agg(F.max(F.coalesce("ok", F.lit(False))).alias("any")).where("not any").select("call_id")
