import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from formweave.llm import chat

SCHEMA = "tree long, node long, parent long, score double, role string, text string"


def brute_paths(rows):
    own = {n: (p, s or 0.0) for _, n, p, s, *_ in rows}
    inner = {p for p, _ in own.values()}
    out = []
    for leaf in own:
        if leaf in inner:
            continue
        path, at = [], leaf
        while at in own:
            path.insert(0, at)
            at = own[at][0]
        out.append((-sum(own[n][1] for n in path), leaf, path))
    return [(leaf, path) for _, leaf, path in sorted(out)]


def test_paths_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for tree in range(12):
        for n in range(rng.choice([1, 3, 20, 40])):
            parent = None if n == 0 else rng.choice([max(0, n - 1), rng.randrange(n)])
            rows.append((tree, n, 99 if rng.random() < 0.03 else parent, float(rng.randrange(5)), rng.choice(["user", "assistant", "system"]), f"t{tree}-{n}"))
    df = spark.createDataFrame(rows, SCHEMA)
    for top in (1, 3, None):
        wanted = {}
        for tree in range(12):
            for rank, (leaf, path) in enumerate(brute_paths([r for r in rows if r[0] == tree])[:top], 1):
                wanted[tree, leaf, rank] = [f"t{tree}-{n}" for n in path]
        found = {(r.tree, r.leaf, r["rank"]): [t.text for t in r.turns] for r in chat.read_back(chat.format_trees(df, top)).collect()}
        assert found == wanted


def test_long_branch(spark):
    rows = [(1, n, n - 1, 0.0, "assistant" if n % 2 else "user", "x" * (n % 5)) for n in range(300)]
    (r,) = chat.read_back(chat.format_trees(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(r.turns) == 300 and [t.text for t in r.turns] == [x[5] for x in rows]
    assert r.loss == "".join(x[5] for x in rows if x[4] == "assistant")
    assert [r.formatted[s.start : s.end] for s in r.loss_spans] == [x[5] for x in rows if x[4] == "assistant"]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a|", "r>\\", "<|end|>\n"]), st.lists(st.sampled_from([*"\\|<>/s[]INST\né😀 a", "<|end|>\n", "</s>", "[INST]", "[/INST]", "<s>"]), max_size=12).map("".join)), min_size=1, max_size=30))
def test_round_trip(spark, turns):
    rows = [(1, i, i - 1 if i else None, 0.0, r, t) for i, (r, t) in enumerate(turns)]
    (r,) = chat.read_back(chat.format_trees(spark.createDataFrame(rows, SCHEMA))).collect()
    assert [(t.role, t.text) for t in r.turns] == turns
    assert r.loss == "".join(t for role, t in turns if role == "assistant")
    bodies = r.formatted
    assert len(re.findall(r"<\|end\|>\n", bodies)) == len(turns) and "</s>" not in bodies and "[INST]" not in bodies


def test_odd_tables(spark):
    assert chat.format_trees(spark.createDataFrame([], SCHEMA)).collect() == []
    odd = spark.createDataFrame([(None, 1, None, "assistant", None), (2, None, None, None, "hi"), (2, 5, "x", "user", "hi"), (2, 5, "x", "user", "hi"), (None, 1, None, "assistant", "b")], "conv_id long, turn long, tree string, role string, text string")
    rows = {r.tree: r for r in chat.read_back(chat.format_trees(chat.linear_turns(odd))).collect()}
    assert [(t.role, t.text) for t in rows[None].turns] == [("assistant", ""), ("assistant", "b")]
    assert [(t.role, t.text) for t in rows[2].turns] == [("", "hi"), ("user", "hi"), ("user", "hi")]
    circle = spark.createDataFrame([(1, 1, 2, 0.0, "user", "a"), (1, 2, 1, 0.0, "user", "b"), (1, 3, None, None, "user", "c"), (1, 3, None, None, "user", "d")], SCHEMA)
    assert [r.formatted for r in chat.format_trees(circle).collect()] == ["<|user|>\nc<|end|>\n"]
    assert chat.linear_turns(odd.where(F.lit(False))).collect() == []


def test_very_long_texts_and_rows_without_conversation(spark):
    long = "</s>[INST] <|end|>\\ é😀\n" * 15_000
    rows = [(7, 0, "user", long), (7, 1, "assistant", long), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b"), (8, 0, None, None)]
    found = chat.read_back(chat.format_trees(chat.linear_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    got = {r.tree: ([(t.role, t.text) for t in r.turns], r.loss) for r in found.collect()}
    assert got == {7: ([("user", long), ("assistant", long)], long), None: ([("user", "a"), ("assistant", "b"), ("assistant", "b")], "bb"), 8: ([("", "")], "")}


def test_the_query_adds_its_conversation(spark, tmp_path):
    from formweave.llm import queries

    spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = queries.op8_chat_formatting(spark, str(tmp_path))
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in df.collect()} == {1: (1, 0), -1: (2, 21)}
    assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()
