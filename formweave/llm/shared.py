"""Helpers that several training-data operators use."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.sources.stage import SMALL_ROWS, dropped
from formweave.sources.stage import staged as checkpointed

#: A word, in Java's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def others(df: DataFrame, *made: str) -> list[str]:
    """Columns of ``df`` without those an operator makes itself: on a clash the operator's column wins."""
    low = {m.lower() for m in made}
    return [c for c in df.columns if c.lower() not in low]


def slices(texts: Iterable[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Runs of consecutive texts (null: empty) with about ``most`` characters each, with the first one's place."""
    start, run, size = 0, [], 0
    for t in texts:
        t = t or ""
        if run and size + len(t) > most:
            yield start, run
            start, run, size = start + len(run), [], 0
        run.append(t)
        size += len(t)
    if run:
        yield start, run


def with_small(rows: DataFrame, small: DataFrame, key: str, small_key: str, how: str = "left") -> DataFrame:
    """``rows`` joined, nulls being equal, with a checkpointed table that has one narrow row per value of the key.

    It is broadcast up to ``SMALL_ROWS`` rows; beyond, it is joined, and AQE splits a hot key.
    """
    side = F.broadcast(small) if small.count() <= SMALL_ROWS else small
    return rows.join(side, F.col(key).eqNullSafe(F.col(small_key)), how)


__all__ = ["SMALL_ROWS", "WORD", "checkpointed", "dropped", "others", "slices", "table", "text_or_empty", "with_small"]
