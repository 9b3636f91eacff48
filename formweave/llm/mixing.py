"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Every document has an exponential key, -ln(u) / quality, u being a hash of the document; within a source, documents
are taken in the order of their keys until the prefix sum of their sizes reaches the source's budget. A budget above
the source's size takes every document for as many complete epochs as fit, and only the rest is drawn by key.

Prefix sums are taken by radix: keys fall into ``FAN`` coarse bins of equal probability, sums per bin show in which
bin the budget ends, that bin is split into ``FAN`` fine bins likewise, and only the documents of the one fine bin
in which a source's budget ends are sorted. No source is ever sorted in one task.

The document whose prefix sum crosses the budget is taken if that comes nearer to it. The quality weight is the share
of letters and blanks in the text, 0.05 at least.

Defined results: a null text has size 0 and a document of size 0 is taken for 0 words; null sources form one source,
the last in order; null ``doc_id`` values and repeated rows are drawn like others (the key hashes id and text); an
empty table gives an empty table. Rows equal in id and text have equal keys and are drawn together, all or none, so
that a source may miss its target by half the words of such a block (of a single document else). The operator reads
``doc_id``, source and text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formweave.llm.shared import WORD, checkpointed, text_or_empty, with_small

#: The weights that sources have in turn.
WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its size.
MOST_EPOCHS = 3
FAN = 128


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def quality(text: str = "text") -> Column:
    """The share of letters and blanks, 0.05 at least."""
    whole = text_or_empty(text)
    return F.greatest(F.lit(0.05), F.length(F.regexp_replace(whole, r"[^\p{L} \n]", "")) / F.greatest(F.length(whole), F.lit(1)))


def _share(text: str, doc_id: str) -> Column:
    """A number in (0, 1) that depends on the document alone."""
    seed = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(":"), text_or_empty(text)))
    return (F.conv(F.substring(seed, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: budgets that fill up to ``MOST_EPOCHS`` sizes.

    With sources in the order of size over weight, the first ones are capped as long as the rest's common level
    exceeds their cap; the level then is what remains, over the remaining weight. One row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight)
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns({
        "total": F.sum("source_size").over(all_rows),
        "weights": F.sum("weight").over(all_rows),
        "size_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    level = (F.col("total") - MOST_EPOCHS * F.col("size_before")).cast("double") / (F.col("weights") - F.col("weight_before")).cast("double")
    free = F.when(level * F.col("weight") <= MOST_EPOCHS * F.col("source_size"), level)
    rows = rows.withColumn("level", F.min_by(free, F.when(free.isNotNull(), F.col("weight_before"))).over(all_rows))
    cap = (MOST_EPOCHS * F.col("source_size")).cast("double")
    return rows.select("source", "source_size", F.coalesce(F.least(cap, F.col("level") * F.col("weight")), cap).alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _by_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``rows`` with the columns of a checkpointed table that has one row per source."""
    return with_small(rows, per_source.withColumnRenamed("source", "of"), "source", "of", "inner").drop("of")


def _ending(budget: DataFrame, sums: DataFrame, bin_name: str, left: str) -> DataFrame:
    """``budget`` with the bin in which each source's budget ends, and what is left of the budget there."""
    upto = F.sum("words").over(Window.partitionBy("source").orderBy(bin_name))
    joined = budget.join(sums.withColumn("upto", upto).withColumnRenamed("source", "of"), _same("source", "of"), "left")
    ends = F.min(F.when(F.col("upto") > F.col(left), F.struct(F.col(bin_name).alias("bin"), (F.col(left) - F.col("upto") + F.col("words")).alias("left"))))
    keys = budget.columns
    return joined.groupBy(*keys).agg(ends.alias("end")).select(*keys, F.coalesce("end.bin", F.lit(FAN)).alias(f"end_{bin_name}"), F.coalesce("end.left", F.lit(0.0)).alias(f"left_{bin_name}"))


def _keyed(docs: DataFrame, source: str, text: str, doc_id: str) -> DataFrame:
    """``docs`` with struct ``k``: source, size, key, its bins, and the order of documents in a bin."""
    u, weight = _share(text, doc_id), quality(text)
    spread = F.lit(1.0) - F.pow(u, 1 / weight)  # rises with the key, in (0, 1)
    bins = F.least(F.floor(spread * (FAN * FAN)), F.lit(FAN * FAN - 1)).cast("int")
    order = F.struct((-F.log(u) / weight).alias("key"), F.coalesce(F.col(doc_id).cast("string"), F.lit("-")).alias("tie"))
    return docs.withColumn("__k", F.struct(F.col(source).alias("source"), word_count(text).alias("size"), bins.alias("bins"), order.alias("order")))


def _flat(keyed: DataFrame, *more: Column) -> DataFrame:
    bins = F.col("__k.bins")
    return keyed.select(*more, F.col("__k.source").alias("source"), F.col("__k.size").alias("size"), F.floor(bins / FAN).cast("int").alias("coarse"), (bins % FAN).alias("fine"), F.col("__k.order").alias("order"))


def _cuts(base: DataFrame) -> DataFrame:
    """One row per source: its size and target, its complete epochs, and where in the order of keys its draw ends."""
    sums = checkpointed(base.groupBy("source", "coarse").agg(F.sum("size").alias("words")))
    budget = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = budget.withColumn("full", full).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    budget = checkpointed(_ending(budget, sums, "coarse", "rest"))
    inside = _by_source(base, budget).where(F.col("coarse") == F.col("end_coarse"))
    ends = checkpointed(_ending(budget, inside.groupBy("source", "fine").agg(F.sum("size").alias("words")), "fine", "left_coarse"))
    last = _by_source(base, ends).where((F.col("coarse") == F.col("end_coarse")) & (F.col("fine") == F.col("end_fine")))
    tied = last.groupBy("source", "order", "left_fine").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("order"))
    tied = tied.withColumn("upto", upto).where(F.col("upto") - F.col("words") / 2.0 <= F.col("left_fine"))
    cut = tied.groupBy(F.col("source").alias("of")).agg(F.max("order").alias("cut"))
    return checkpointed(ends.join(cut, _same("source", "of"), "left").select("source", "source_size", "target", "full", "end_coarse", "end_fine", "cut"))


def _epochs() -> Column:
    """How often a document is taken, given its place and its source's row."""
    at, end = F.struct("coarse", "fine"), F.struct(F.col("end_coarse").alias("coarse"), F.col("end_fine").alias("fine"))
    drawn = (at < end) | ((at == end) & F.coalesce(F.col("order") <= F.col("cut"), F.lit(False)))
    return (F.col("full") + F.when(drawn, 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, epochs``: one row per document.

    ``taken`` counts words, repeats included: whole documents are taken, ``epochs`` times.
    """
    base = checkpointed(_flat(_keyed(docs, source, text, doc_id), F.col(doc_id).alias("doc_id")))
    rows = _by_source(base, _cuts(base)).withColumn("epochs", _epochs())
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("epochs")).alias("taken"), "epochs")


def mixed_documents(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents themselves, each row as often as the mix takes it."""
    keyed = _keyed(docs, source, text, doc_id)
    cuts = _cuts(checkpointed(_flat(keyed)))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc")
    rows = _by_source(_flat(keyed, whole), cuts).withColumn("__n", _epochs()).where("__n > 0")
    copies = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    return copies.select(*(F.col("__doc").getField(c).alias(c) for c in docs.columns))
