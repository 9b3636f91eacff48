"""Linkage over a stream of pairs: each micro-batch holds whole documents and is linked like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from formweave.operators.linkage import classify
from formweave.operators.validation import validate


def link_stream(pairs: DataFrame, targets: DataFrame, synonyms: DataFrame, codes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Validated fields of each micro-batch, written under ``out`` by batch number, so that a repeated batch overwrites itself."""

    def each(batch: DataFrame, number: int) -> None:
        fields, _ = classify(batch, targets, synonyms)
        validate(fields, codes).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pairs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
