"""Cover tree, components, chat format and the pipeline."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterwise.llm import chat_format, cover_tree, graph
from meterwise.session import child_names, work_path
from tests.llm.test_text_operators import naive_components


# Components

@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=14))
@settings(max_examples=4, deadline=None)
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    linked = {frozenset(e) for e in edges}
    assert got == dict(zip(nodes, naive_components(nodes, lambda i, j: frozenset((nodes[i], nodes[j])) in linked)))


def test_long_chain_and_null_ends(spark):
    chain = [(i, i + 1) for i in range(40)] + [(None, 3), (5, None), (7, 7)]
    got = graph.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert sorted(tuple(r) for r in got) == [(i, 0) for i in range(41)]


# Vectors

def naive_pairs(rows, threshold):
    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if good(v) else None for _, v, _ in rows]

    def linked(i, j):
        a, b = units[i], units[j]
        return (a is not None and b is not None and rows[i][2] is not None and rows[i][2] == rows[j][2]
                and len(a) == len(b) and float(a @ b) >= threshold)
    n = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    return n, naive_components([r[0] for r in rows], linked)


def vectors(seed=5, n=260, dims=6):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((12, dims))
    return [[float(x) for x in np.float32(base[i % 12] * rng.uniform(0.5, 2) + rng.standard_normal(dims) * rng.choice([0.0, 0.1, 0.4]))]
            for i in range(n)]


@pytest.mark.parametrize("block,centres", [(2048, 1024), (16, 1024), (16, 6)])
def test_near_pairs(spark, monkeypatch, block, centres):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "MAX_CENTRES", centres)
    monkeypatch.setattr(cover_tree, "DENSE", 16)
    monkeypatch.setattr(cover_tree, "LEAF", 2)
    v = vectors()
    rows = [(i, x, None if i % 50 == 49 else i % 2) for i, x in enumerate(v)]
    rows += [(900, None, 0), (901, [], 0), (902, [0.0] * 6, 0), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (904, [float("nan")] * 6, 1),
             (905, [float("inf")] + [0.0] * 5, 1), (906, [1.0, 2.0], 0), (907, v[0], 0), (908, v[0], 0), (909, [-0.0, 1.0, 0.0, 0.0, 0.0, 0.0], 1),
             (910, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame([(i, x, y, "z", "z") for i, x, y in rows],
                               "vec_id long, embedding array<float>, label int, id string, cell string").repartition(3)
    got = {r["vec_id"]: r for r in cover_tree.near_pairs(df).collect()}
    n, least = naive_pairs(rows, 0.93)
    assert len(got) == len(rows)
    for (i, _, _), links, c in zip(rows, n, least):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links, c, i == c), i
    assert cover_tree.near_pairs(df.limit(0)).count() == 0


def test_tree_covers_with_halving_radii():
    points = cover_tree.unit(np.random.default_rng(0).standard_normal((300, 5)))
    tree = cover_tree.CoverTree(points).freeze()
    assert sorted(tree.order) == list(range(300))
    for node, kids in enumerate(tree.children):
        inside = tree.order[tree.low[node]:tree.high[node]]
        assert cover_tree._distance(points[inside], points[tree.centre[node]]).max() <= tree.radius[node] + cover_tree.SLACK
        if kids:
            assert tree.centre[node] in [tree.centre[k] for k in kids]  # nested
            assert all(tree.radius[k] < tree.radius[node] for k in kids)


def test_pruning_loses_no_link():
    rng = np.random.default_rng(2)
    centres = cover_tree.unit(rng.standard_normal((30, 4)))
    a = cover_tree.unit(centres[rng.integers(0, 30, 700)] + rng.standard_normal((700, 4)) * 0.02)
    b = cover_tree.unit(centres[rng.integers(0, 30, 500)] + rng.standard_normal((500, 4)) * 0.02)
    wa, wb = rng.integers(1, 4, 700), rng.integers(1, 4, 500)
    counts, forest = cover_tree.dual_links(a, wa, b, wb, 0.93)
    hits = a @ b.T >= 0.93
    assert (counts == np.concatenate([hits @ wb, hits.T @ wa])).all()
    own, _ = cover_tree.dual_links(a, wa, None, None, 0.93)
    assert (own == (a @ a.T >= 0.93) @ wa).all()


# Chat

CONTROLS = ["\\", "#", "###", "####", "</turn>", "\n", "\n</turn>\n", "### user: ", ": ", "a", "é😀", " ", "\\### Assistant: </turn> ok", "$1", "%2F"]


def chat_rows(seed=11, n=60):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(CONTROLS) for _ in range(rng.randint(0, 6)))
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), text()) for c in range(n) for t in range(rng.randint(1, 4))]
    rows += [(500, 0, "odd: role\n</turn>\n###", "x"), (501, 0, None, None), (501, None, "assistant", None), (502, 1, "assistant", "same"),
             (502, 1, "assistant", "same"), (None, 0, "assistant", "no id"), (503, 0, "assistant", "long # text " * 20_000)]
    return rows


def test_chat_round_trip(spark):
    rows = chat_rows()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, at string, f string").repartition(4)
    formatted = chat_format.format_conversations(df)
    got = {r["conv_id"]: r for r in chat_format.read_back(formatted).collect()}
    assert {r["conv_id"]: r for r in chat_format.turn_digests(chat_format.format_turns(df)).collect()} == got
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        learned = "".join(x for _, _, r, x in turns if r == "assistant")
        told = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256(told.encode()).hexdigest()), c
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest()), c
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


def test_texts_without_controls_stay_as_they_are(spark):
    df = spark.createDataFrame([(1, 0, "user", "plain \\ text"), (1, 1, "assistant", "</turn>")], "conv_id long, turn long, role string, text string")
    row = chat_format.format_conversations(df).first()
    assert row["formatted"] == "### user: plain \\ text\n</turn>\n### assistant: \\</turn>\n</turn>\n"
    assert [tuple(s) for s in row["loss"]] == [(46, 54)] and row["formatted"][46:54] == "\\</turn>"


def test_a_hot_conversation_spans_tasks(spark):
    """A null id holds two thirds of the turns, all at one turn number: offsets follow (turn, role, text) and no
    range of the running sums holds them all."""
    rows = [(None if i % 3 else i, 0, "assistant", f"{i * 7919 % 3001:05d} ###") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    turns = chat_format.format_turns(df)
    placed = chat_format.place_turns(turns)
    got = sorted((r["at"], r["formatted"], tuple(r["loss"])) for r in placed.where("conv_id is null").collect())
    at = 0
    for (where, text, loss), (_, _, _, source) in zip(got, sorted((r for r in rows if r[0] is None), key=lambda r: r[3])):
        assert (where, text[loss[0]:loss[1]].replace("\\###", "###")) == (at, source)
        at += len(text)
    folder = work_path(spark, "ranges")
    before = set(child_names(spark, folder))
    key = "spark.sql.adaptive.coalescePartitions.enabled"     # ranges as small as these would be put together
    spark.conf.set(key, "false")
    try:
        chat_format.place_turns(turns)
    finally:
        spark.conf.unset(key)
    made = (set(child_names(spark, folder)) - before).pop()
    dealt = spark.read.parquet(f"{folder}/{made}")
    assert dealt.where("conv_id is null").select("_range").distinct().count() >= 4
    assert chat_format.turn_digests(turns.limit(0)).count() == 0 and chat_format.place_turns(turns.limit(0)).count() == 0


def test_chat_runs_no_python(spark, sf):
    from meterwise.llm.queries import op6_chat_format
    plan = op6_chat_format(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# Queries

@pytest.mark.parametrize("name", ["op3_cover_tree", "op6_chat_format"])  # the others: test_lines_spelling_tokens.py
def test_oracles(spark, sf, name):
    import __spark_entry__ as entry
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, sf).toPandas()[list(want.columns)]
    key = want.columns[0]
    assert (got.sort_values(key).reset_index(drop=True) == want.sort_values(key).reset_index(drop=True)).all().all()


def test_pipeline(spark, sf):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(stage(spark, docs, sf))
        assert docs.columns == names
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] > counts[3] == counts[4] > 0
    assert docs.where("text rlike '[a-z0-9]@[a-z0-9]+[.][a-z]'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == counts[4]
