"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, ranked by score, one text a path.

DataFrame functions only. A node points to its parent. The table of (node, ancestor) is joined with itself, so that
the distance to the known ancestor doubles each round, until every node has its root; depth and the sum of scores
along the path come with it. Leaves are ranked by that sum, and the nodes of the chosen paths are found by following
the same ancestors down the rounds, each round a join. The number of rounds is the logarithm of the depth.

The template: ``<|role|>``, a line end, the text, ``<|end|>``, a line end. Inside texts, a backslash is put behind
each backslash and between the first two characters of ``<|``, ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]``; inside
roles also behind each ``|``. Dropping every such backslash gives the text back. The loss mask is a list of spans
of the formatted text, one for each assistant text.

Defined results: null texts and roles count as empty; rows of null tree id form one tree; nodes whose parent is not
in the tree are roots; nodes that only lead to each other in a circle have no root and no path; of rows that repeat
a node, the least (by parent, then score, then role and text) counts; an empty table gives an empty table; only the
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formweave.llm.shared import checkpointed

END = "<|end|>\n"
_CONTROL = r"\\|<(?=\||/?s>)|\[(?=/?INST\])"


def escaped(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _CONTROL + r"|\|" * role, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.|\z)", "$1")


def _turn(role: Column, text: Column) -> tuple[Column, Column]:
    """What stands before a text, and the text."""
    return F.concat(F.lit("<|"), escaped(role, True), F.lit("|>\n")), escaped(text)


def paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """``tree, leaf, node, depth, rank``: the nodes of each tree's ``top`` best paths (all: None).

    ``nodes`` has tree (string), node, parent and score.
    """
    one = nodes.groupBy("tree", "node").agg(F.min(F.struct("parent", "score")).alias("x")).select("tree", "node", F.col("x.parent").alias("parent"), F.coalesce("x.score", F.lit(0.0)).alias("score"))
    known = one.select("tree", F.col("node").alias("up"), F.lit(True).alias("there"))
    linked = one.withColumnRenamed("parent", "up").join(known, ["tree", "up"], "left")
    step = checkpointed(linked.select("tree", "node", F.when(F.col("there"), F.col("up")).alias("up"), "score", F.lit(1).cast("long").alias("steps")))
    rounds, most = [], 2 * step.count() + 2
    reach = 1
    while True:
        rounds.append(step.where("up is not null").select("tree", "node", "up"))
        if reach > most or not rounds[-1].limit(1).count():
            break
        above = step.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("steps").alias("steps2"))
        moved = step.where("up is not null").join(above, ["tree", "up"])
        moved = moved.select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("steps") + F.col("steps2")).alias("steps"))
        step = checkpointed(step.where("up is null").unionByName(moved))
        reach *= 2
    rooted = step.where("up is null").select("tree", "node", "score", (F.col("steps") - 1).alias("depth"))
    inner = rounds[0].select("tree", F.col("up").alias("node")).distinct()
    leaves = rooted.join(inner, ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node"))
    leaves = leaves.withColumn("rank", rank)
    marked = leaves.where(F.col("rank") <= top) if top else leaves
    marked = checkpointed(marked.select("tree", F.col("node").alias("leaf"), "node", "depth", "rank"))
    for i, ups in enumerate(rounds[:-1]):  # distances 1, 2, 4 ... reach every ancestor
        higher = marked.join(ups, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("depth") - (1 << i)).alias("depth"), "rank")
        marked = checkpointed(marked.unionByName(higher))
    return marked


def format_trees(turns: DataFrame, top: int | None = 1) -> DataFrame:
    """``tree, leaf, rank, formatted, loss_spans``: one row per chosen path.

    ``turns`` has tree, node, parent, score, role and text. ``loss_spans`` holds start and end (exclusive, code
    points) of each assistant text in ``formatted``.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("null"))
    rows = turns.select(key.alias("tree"), F.col("tree").alias("own"), "node", "parent", F.col("score").cast("double").alias("score"), "role", "text")
    before, body = _turn(F.col("role"), F.col("text"))
    texts = rows.select("tree", "node", "own", "parent", "score", F.coalesce("role", F.lit("")).alias("role"), before.alias("before"), body.alias("body"))
    rank = F.row_number().over(Window.partitionBy("tree", "leaf", "node").orderBy("parent", "score", "role", "body"))
    chosen = paths(rows.select("tree", "node", "parent", "score"), top).join(texts, ["tree", "node"]).withColumn("__n", rank).where("__n = 1")
    size = F.length("before") + F.length("body") + F.lit(len(END))
    order = Window.partitionBy("tree", "leaf").orderBy("depth")
    placed = chosen.withColumn("at", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.withColumn("start", F.col("at") + F.length("before")).withColumn("end", F.col("start") + F.length("body"))
    turn = F.struct("depth", F.concat("before", "body", F.lit(END)).alias("turn"), F.col("role").alias("role"), "start", "end")
    grouped = placed.groupBy("tree", "leaf").agg(F.first("own").alias("own"), F.first("rank").alias("rank"), F.array_sort(F.collect_list(turn)).alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return grouped.select(F.col("own").alias("tree"), "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), mask.alias("loss_spans"))


def linear_turns(conversations: DataFrame) -> DataFrame:
    """Conversations whose rows follow each other by turn, as trees of one branch."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("node", F.row_number().over(order).cast("long")).select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """``turns`` (role, text) and ``loss`` (the text under the mask, unescaped), read from ``formatted``."""
    parts = F.split("formatted", r"<\|end\|>\n", -1)
    heads = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda t: F.struct(F.instr(t, F.lit("|>\n")).alias("cut"), t.alias("t")))
    out = formatted.withColumn("__heads", heads)
    turns = F.transform("__heads", lambda x: F.struct(unescaped(F.substring(x["t"], F.lit(3), x["cut"] - 3)).alias("role"), unescaped(F.substring(x["t"], x["cut"] + 3, F.length(x["t"]))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return out.withColumns({"turns": turns, "loss": loss}).drop("__heads")
