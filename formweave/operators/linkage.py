"""Linking the pairs read in a document to the fields asked for.

Inputs: ``pairs`` (doc_id, pair_idx, label, value), ``targets`` (target_idx, name), ``synonyms`` (target_idx, syn_idx,
synonym), and on demand ``docs`` (doc_id): the documents that get rows, also those in which no pair was read. Without
``docs``, these are the documents of ``pairs``.

Where ``targets`` carries ``request_id``, so must all other tables: every document is linked within its request, to
the targets and synonyms of that request only, and all results carry ``request_id``. A document that two requests ask
for is linked for each of them.

A label is scored once for each different synonym, and pairs meet the scores by an equi-join on the label; ``pairs`` is
read twice for this, so that a costly one should be staged. Pairs, scores, proposals and documents then meet in one
shuffle by document; a document's row holds all that follows from it, and fields and leftovers are read off that row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formweave.functions.fuzzy import similarity
from formweave.functions.text import is_blank, normalize_label
from formweave.sources.stage import sized, staged

LABEL_THRESHOLD, PROPOSAL_THRESHOLD = 80, 60
MISSING, TO_REVIEW, AUTO_VALIDATED = "MISSING", "TO_REVIEW", "AUTO_VALIDATED"
_PAIR = "struct<pair_idx:int,label:string,value:string,options:array<struct<target_idx:int,score:int,synonym:string>>>"
_PROPOSAL = "struct<asg_idx:int,field:string,label:string,value:string>"
_CHOSEN = "array<struct<target_idx:int,pair_idx:int,score:int,synonym:string,label:string,value:string>>"


def _scope(targets: DataFrame, *tables: DataFrame | None) -> list[str]:
    """The columns that keep requests apart; all tables must carry them if the targets do."""
    scope = ["request_id"] if "request_id" in targets.columns else []
    for df in tables:
        if df is not None and ("request_id" in df.columns) != bool(scope):
            raise ValueError("either all tables carry request_id or none")
    return scope


def scored_labels(labels: DataFrame, synonyms: DataFrame, least: int) -> DataFrame:
    """``label, target_idx, score, synonym``: each label's best synonym of each target, the first of equals.

    With ``request_id`` in ``synonyms``, labels meet the synonyms of their own request.
    """
    scope = _scope(synonyms, labels)
    plain = labels.select(*scope, "label", normalize_label(F.col("label")).alias("a")).where("a <> ''")
    words = sized(synonyms.select(*scope, "target_idx", "syn_idx", "synonym", normalize_label(F.col("synonym")).alias("b")).where("b <> ''"))
    known = words.select(*scope, "b").distinct()
    asked = plain.select(*scope, "a").distinct().withColumn("__on", F.lit(1)).join(known.withColumn("__on", F.lit(1)), ["__on", *scope])
    pairs = asked.select("a", "b").distinct()
    scores = pairs.withColumn("score", similarity(F.col("a"), F.col("b"))).where(F.col("score") >= least)
    best = plain.join(scores, "a").join(words, ["b", *scope]).groupBy(*scope, "label", "target_idx").agg(F.max_by(F.struct("score", "synonym"), F.struct("score", -F.col("syn_idx"))).alias("x"))
    return best.select(*scope, "label", "target_idx", "x.score", "x.synonym")


def candidates(pairs: DataFrame, synonyms: DataFrame, least: int = LABEL_THRESHOLD) -> DataFrame:
    """``doc_id, pair_idx, target_idx, score, synonym`` and the pair, for all pairs that may stand for a target."""
    scope = _scope(synonyms, pairs)
    return pairs.join(scored_labels(pairs.select(*scope, "label").distinct(), synonyms, least), ["label", *scope])


def _assigned(options: Column, done: Column) -> Column:
    """Greedy one-to-one choice: best score first, then pairs with a value, then order of targets and pairs."""

    def take(taken: Column, x: Column) -> Column:
        used = F.exists(taken, lambda y: (y["target_idx"] == x["target_idx"]) | (y["pair_idx"] == x["pair_idx"]))
        own = F.struct(*(x[c].alias(c) for c in ("target_idx", "pair_idx", "score", "synonym", "label", "value")))
        return F.when(used, taken).otherwise(F.array_append(taken, own))

    return F.aggregate(F.array_sort(options), done, take)


def _resolved(proposals: Column, pairs: Column, targets: Column, least: int) -> Column:
    """The proposals that a read pair bears out, in their order.

    A proposal counts if its field is asked for and still free, its value is not blank, and an unused pair has the
    same value (with the same label rather than another); the pair's label must score ``least`` for the field.
    """

    def step(done: Column, x: Column) -> Column:
        target = F.get(F.filter(targets, lambda t: t["name"] == x["field"]), F.lit(0))["target_idx"]
        free = F.filter(pairs, lambda p: (p["norm"] == x["norm"]) & ~F.exists(done, lambda y: y["pair_idx"] == p["pair_idx"]))
        same = F.filter(free, lambda p: p["plain"] == x["plain"])
        pair = F.coalesce(F.get(same, F.lit(0)), F.get(free, F.lit(0)))
        option = F.get(F.filter(pair["options"], lambda o: (o["target_idx"] == target) & (o["score"] >= least)), F.lit(0))
        good = target.isNotNull() & ~F.exists(done, lambda y: y["target_idx"] == target) & option.isNotNull()
        own = F.struct(target.alias("target_idx"), pair["pair_idx"].alias("pair_idx"), option["score"].alias("score"), option["synonym"].alias("synonym"), pair["label"].alias("label"), pair["value"].alias("value"))
        return F.when(F.coalesce(good, F.lit(False)), F.array_append(done, own)).otherwise(done)

    return F.aggregate(F.filter(proposals, lambda x: ~is_blank(x["value"])), F.array().cast(_CHOSEN), step)


@dataclass
class Links:
    """One staged row per document: ``pairs`` read, ``chosen`` pairs of targets, and the ``targets`` asked for."""

    rows: DataFrame
    scope: list[str]
    by_name: bool

    def fields(self) -> DataFrame:
        """One row per document and target, in the order asked; targets without a pair are MISSING with score 0.

        By name, targets that repeat a name all show what the first of them got.
        """

        def shown(t: Column) -> Column:
            first = F.get(F.filter("targets", lambda u: u["name"].eqNullSafe(t["name"])), F.lit(0))["target_idx"] if self.by_name else t["target_idx"]
            x = F.get(F.filter("chosen", lambda c: c["target_idx"] == first), F.lit(0))
            return F.struct(t["target_idx"].alias("target_idx"), t["name"].alias("name"), x["pair_idx"].alias("pair_idx"), x["label"].alias("label"), x["value"].alias("value"), F.coalesce(x["score"], F.lit(0)).alias("score"), x["synonym"].alias("synonym"))

        rows = self.rows.select(*self.scope, "doc_id", F.explode(F.transform("targets", shown)).alias("f")).select(*self.scope, "doc_id", "f.*")
        return rows.withColumn("status", F.when(F.col("pair_idx").isNull(), MISSING).otherwise(TO_REVIEW))

    def leftovers(self) -> DataFrame:
        """The pairs that no target took."""
        free = F.filter("pairs", lambda p: ~F.exists("chosen", lambda c: c["pair_idx"] == p["pair_idx"]))
        return self.rows.select(*self.scope, "doc_id", F.explode(free).alias("p")).select(*self.scope, "doc_id", "p.pair_idx", "p.label", "p.value")


def link(pairs: DataFrame, targets: DataFrame, synonyms: DataFrame, docs: DataFrame | None = None, proposals: DataFrame | None = None, least: int = LABEL_THRESHOLD, by_name: bool = False) -> Links:
    """Proposals (doc_id, asg_idx, field, label, value) first; the fuzzy assignment serves what remains."""
    scope = _scope(targets, pairs, synonyms, docs, proposals)
    floor = min(least, PROPOSAL_THRESHOLD) if proposals is not None else least
    scores = scored_labels(pairs.select(*scope, "label").distinct(), synonyms, floor)
    option = F.struct(F.col("target_idx").cast("int").alias("target_idx"), F.col("score").cast("int").alias("score"), "synonym")
    scored = sized(scores.groupBy(*scope, "label").agg(F.array_sort(F.collect_list(option)).alias("options")))
    read = pairs.join(scored, ["label", *scope], "left")
    pair = F.struct(F.col("pair_idx").cast("int").alias("pair_idx"), "label", "value", "options").cast(_PAIR)
    none = lambda kind: F.lit(None).cast(kind)
    rows = read.select(*scope, "doc_id", pair.alias("pair"), none(_PROPOSAL).alias("proposal"))
    if proposals is not None:
        proposal = F.struct(F.col("asg_idx").cast("int").alias("asg_idx"), "field", "label", "value").cast(_PROPOSAL)
        rows = rows.unionByName(proposals.select(*scope, "doc_id", none(_PAIR).alias("pair"), proposal.alias("proposal")))
    if docs is not None:
        rows = rows.unionByName(docs.select(*scope, "doc_id", none(_PAIR).alias("pair"), none(_PROPOSAL).alias("proposal")))
    grouped = rows.groupBy(*scope, "doc_id").agg(F.array_sort(F.collect_list("pair")).alias("pairs"), F.array_sort(F.collect_list("proposal")).alias("proposals"))
    if docs is not None and proposals is not None:  # a proposal for a document that is not asked for makes no row
        grouped = grouped.join(docs.select(*scope, "doc_id").distinct(), [*scope, "doc_id"], "left_semi")
    asked = targets.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(F.col("target_idx").cast("int").alias("target_idx"), "name"))).alias("targets"))
    grouped = grouped.join(sized(asked), scope, "left") if scope else grouped.join(F.broadcast(asked))  # without scope: one row
    grouped = grouped.withColumn("targets", F.coalesce("targets", F.array().cast("array<struct<target_idx:int,name:string>>")))
    start: Column = F.array().cast(_CHOSEN)
    if proposals is not None:
        said = F.transform("proposals", lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value"), normalize_label(x["value"]).alias("norm"), normalize_label(x["label"]).alias("plain")))
        seen = F.when(F.size("proposals") > 0, F.transform("pairs", lambda p: F.struct(p["pair_idx"].alias("pair_idx"), p["label"].alias("label"), p["value"].alias("value"), p["options"].alias("options"), normalize_label(p["value"]).alias("norm"), normalize_label(p["label"]).alias("plain"))))
        grouped = grouped.withColumn("__said", said).withColumn("__seen", seen)
        grouped = grouped.withColumn("first", F.when(F.size("proposals") > 0, _resolved(F.col("__said"), F.col("__seen"), F.col("targets"), PROPOSAL_THRESHOLD)).otherwise(start))
    else:
        grouped = grouped.withColumn("first", start)

    def offered(p: Column) -> Column:
        good = F.filter(F.coalesce(p["options"], F.array().cast("array<struct<target_idx:int,score:int,synonym:string>>")), lambda o: o["score"] >= least)
        return F.transform(good, lambda o: F.struct((-o["score"]).alias("s"), is_blank(p["value"]).alias("blank"), o["target_idx"].alias("target_idx"), p["pair_idx"].alias("pair_idx"), o["score"].alias("score"), o["synonym"].alias("synonym"), p["label"].alias("label"), p["value"].alias("value")))

    options = F.flatten(F.transform("pairs", offered))
    if by_name and proposals is not None:  # a name that a proposal has served asks no more, also where it is repeated
        served = F.transform("first", lambda c: F.get(F.filter("targets", lambda t: t["target_idx"] == c["target_idx"]), F.lit(0))["name"])
        grouped = grouped.withColumn("__served", F.transform(F.filter("targets", lambda t: F.array_contains(served, t["name"])), lambda t: t["target_idx"]))
        options = F.filter(options, lambda o: ~F.array_contains("__served", o["target_idx"]))
    rows = grouped.withColumn("__options", options).withColumn("chosen", _assigned(F.col("__options"), F.col("first")))
    bare = F.transform("pairs", lambda p: F.struct(p["pair_idx"].alias("pair_idx"), p["label"].alias("label"), p["value"].alias("value")))
    return Links(staged(rows.select(*scope, "doc_id", bare.alias("pairs"), "chosen", "targets")), scope, by_name)


def classify(pairs: DataFrame, targets: DataFrame, synonyms: DataFrame, least: int = LABEL_THRESHOLD, docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fields and leftover pairs. A repeated name is a target of its own."""
    links = link(pairs, targets, synonyms, docs, least=least)
    return links.fields(), links.leftovers()


def classify_with_proposals(pairs: DataFrame, proposals: DataFrame, targets: DataFrame, synonyms: DataFrame, least: int = LABEL_THRESHOLD, docs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fields and leftover pairs, proposals first; names count once.

    Targets that repeat a name all show what the first of them got; what the others took is no leftover.
    """
    links = link(pairs, targets, synonyms, docs, proposals, least, by_name=True)
    return links.fields(), links.leftovers()


def linkage_misses(fields: DataFrame, left: DataFrame, synonyms: DataFrame, least: int = LABEL_THRESHOLD) -> DataFrame:
    """Fields that are missing although a leftover pair of their document carries their label."""
    scope = _scope(synonyms, fields, left)
    keys = [*scope, "doc_id", "target_idx"]
    return fields.where(F.col("status") == MISSING).join(candidates(left, synonyms, least).select(*keys), keys, "left_semi")


__all__ = ["Links", "candidates", "classify", "classify_with_proposals", "link", "linkage_misses", "scored_labels"]
