"""Text functions, budgets, manifests, rules and retrieval."""

import time

import numpy as np
import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import budget, incremental, manifests, retrieval
from codeloom.plans import rules


def value(spark, column, *given):
    data = spark.createDataFrame([given], ", ".join(f"c{k} string" for k in range(len(given))))
    return data.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, want",
    [("Getter[Headers]", "Getter"), ("a--b", "a_b"), ("__x__", "x"), ("9lives", "n9lives"), ("End", "End_node"), ("(x)", "node"), ("", "node"), ("größe", "größe"), ("class", "class_node")],
)
def test_clean_identifier(spark, name, want):
    assert value(spark, text.clean_identifier(F.col("c0")), name) == want


@pytest.mark.parametrize("message, want", [("Rate_limit hit, quota left", "quota"), ("HTTP 429", "rate_limit"), ("disconnection", None), ("max length is 10", "context_length"), ("Error 4041", None)])
def test_error_class(spark, message, want):
    assert value(spark, text.error_class(F.col("c0")), message) == want


def test_remarks_once_in_order(spark):
    assert value(spark, text.remarks(F.col("c0")), "Not shown. The code shown is not Shown in the excerpt") == ["Not shown", "The code shown", "the excerpt"]


def test_remark_about_a_code_block_is_none(spark):
    assert value(spark, text.remarks(F.col("c0")), "visible in the code block") == []


@pytest.mark.parametrize("path, want", [("a/b.py", "a.b"), ("a/__init__.py", "a"), ("__init__.py", "")])
def test_module_name(spark, path, want):
    assert value(spark, text.module_name(F.col("c0")), path) == want


def test_greedy_fill_goes_on_after_a_skip(spark):
    rows = spark.createDataFrame([("g", 1, "a", 5), ("g", 2, "b", 9), ("g", 3, "c", 0), ("g", 4, "d", 5)], "g string, o int, k string, n int")
    assert budget.greedy_fill(rows, "g", "o", "k", "n", 10).first()["taken"] == ["a", "d"]


def test_long_groups_are_filled_in_rounds(spark):
    rng = random.Random(2)
    n = 2 * budget.ROUND + 500  # one round of small ones that stay, then sizes that fit less and less; one group is null
    rows = [(g, k, f"{g}{k}", rng.choice([0, 1, 1, 2, 900, 40_000]) if k > 100 else rng.choice([900, 2000])) for g in ("a", None) for k in range(n)] + [("b", 1, "b1", None), ("c", 1, "c1", 0)]
    rows += [("same", 1, "twin", 3)] * 5000
    want = {"b": None, "c": []}
    for g in ("a", None, "same"):
        used, taken = 0, []
        for _, _, k, s in sorted(r for r in rows if r[0] == g) if g else sorted((r for r in rows if r[0] is None), key=lambda r: r[1:]):
            if s and used + s <= 100_000:
                used, taken = used + s, [*taken, k]
        want[g] = taken
    found = {r["g"]: r["taken"] for r in budget.greedy_fill(spark.createDataFrame(rows, "g string, o int, k string, n int"), "g", "o", "k", "n", 100_000).collect()}
    assert {g: found.get(g) for g in want} == want


def test_repeats_are_found_by_their_anchors(spark):
    rng = random.Random(7)
    words = ["a", "bb", "ccc", "dd", "e.e", "", "f\tg"]
    line = lambda n: " ".join(rng.choices(words, k=n))
    excerpts = [(rng.choice("xy"), "  " + line(rng.randrange(1, 7)) + rng.choice(["", "\nmore"])) for _ in range(60)] + [("x", ""), ("z", "a bb"), (None, "a")]
    chunks = [(k, rng.choice(["x", "y", "z", None]), rng.choice(["", "\n"]).join([line(rng.randrange(0, 9)), line(3)])) for k in range(400)]
    chunks += [(400, "x", None)]
    lines = {(s, t.strip(" ").split("\n")[0]) for s, t in excerpts if t.strip(" ").split("\n")[0]}
    want = {k for k, s, t in chunks if not any(s == of and s is not None and t is not None and text_ in t for of, text_ in lines)}
    found = budget.drop_repeats(spark.createDataFrame(chunks, "k int, source string, text string"), spark.createDataFrame(excerpts, "source string, text string"))
    assert found.columns == ["k", "source", "text"] and {r["k"] for r in found.collect()} == want and 100 < len(want) < 400


def test_context_without_excerpts_is_not_cut(spark):
    schema = "g string, ord int, source string, text string"
    chunks = spark.createDataFrame([("g", 1, "f", "x" * 50), ("g", 2, "f", "head\nmore")], schema)
    none = spark.createDataFrame([], schema)
    assert len(budget.assemble(none, chunks, "g", 10).first()["taken"]) == 2
    some = spark.createDataFrame([("g", 0, "f", "head\nbody")], schema)
    assert budget.assemble(some, chunks, "g", 20).first()["taken"] == ["head\nbody"]


def test_manifest_tables(spark):
    lines = ["skipped", "[project]", "name = 'x'", "[tool.black]", "line = 1", "[tool.poetry.group.dev.dependencies]", "y = 1"]
    rows = spark.createDataFrame([("pyproject.toml", k, x) for k, x in enumerate(lines)] + [("requirements-dev.txt", 0, "z")], "file string, line_no int, line string")
    kept = [r["line"] for r in manifests.dependency_lines(rows).orderBy("file", "line_no").collect()]
    assert kept == ["[project]", "name = 'x'", "[tool.poetry.group.dev.dependencies]", "y = 1", "z"]


def test_nearest_manifest_stops_at_a_mark(spark):
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "folder string")
    found = manifests.nearest(one("/a/b/c", "/a/d/e", "/x"), one("/a", "/a/b"), one("/a/d"))
    assert {tuple(r) for r in found.collect()} == {("/a/b/c", "/a/b")}


def test_changes(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    then = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", "4")], "path string, content_hash string")
    assert {tuple(r) for r in incremental.classify(now, then).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "new"), ("d", "deleted")}


def test_same_size_edit_in_one_tick_is_a_suspect(spark):
    now = spark.createDataFrame([("a", 10.0, 5), ("b", 10.0, 5)], "path string, mtime double, size long")
    then = spark.createDataFrame([("a", 10.0, 5, 11.0), ("b", 10.0, 5, 20.0)], "path string, mtime double, size long, last_analyzed double")
    assert [r["path"] for r in incremental.suspects(now, then).collect()] == ["a"]


def test_mmr_swaps_an_exact_copy(spark):
    rows = spark.createDataFrame([(1, [0.9, 0.43589, 0.0]), (2, [0.9, 0.43589, 0.0]), (3, [0.8, 0.0, 0.6])], "vec_id long, v array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id long, q array<double>")
    near = retrieval.nearest(asked, rows, 3)
    assert [r["vec_id"] for r in near.orderBy("rank").collect()][:2] == [1, 2]
    assert [r["vec_id"] for r in retrieval.mmr(near, 2).orderBy("rank").collect()] == [1, 3]
    assert retrieval.nearest(asked, rows, 3, 0.85).count() == 2
    assert retrieval.nearest(asked, rows, 3, 0.0).count() == 3


def test_nearest_of_many_questions(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SHARD_ROWS", 700)
    monkeypatch.setattr(retrieval, "BLOCK_QUESTIONS", 400)
    rng = np.random.default_rng(2)
    same = rng.normal(size=8).tolist()
    rows = [(k, same if k % 3 == 0 else rng.normal(size=8).tolist()) for k in range(1800)]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [1.0, None] + [1.0] * 6), (2003, [1.0, 2.0])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, v array<double>")
    asked = frame.where("vec_id < 1200 or vec_id >= 2000").selectExpr("vec_id as query_id", "v as q")  # more than 1000
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round((x[:1200, None] * x).sum(axis=2), 9)
    want = {(q, r + 1, int(c)) for q in range(1200) for r, c in enumerate(np.lexsort([np.arange(1800), -score[q]])[:5])}
    found = retrieval.nearest(asked, frame, 5).select("query_id", "rank", "vec_id", "score").collect()
    assert {(q, r, c) for q, r, c, s in found if q < 1200} == want
    assert {(q, c, s) for q, r, c, s in found if r == 1 and q >= 2000} == {(2000, 0, None), (2001, 0, None), (2002, 0, None), (2003, 2003, 1.0)}
    few = retrieval.nearest(asked.where("query_id = 1"), frame.where("vec_id in (1, 2000, 2003)"), 5)
    assert [(r["vec_id"], r["score"]) for r in few.orderBy("rank").collect()] == [(1, 1.0), (2000, None), (2003, None)]
    assert retrieval.nearest(asked.limit(0), frame, 5).count() == retrieval.nearest(asked, frame.limit(0), 5).count() == 0


def test_split_text():
    pieces = retrieval.split_text("para one\n\n" + "word " * 30 + "\n\nlast", 40, 10)
    assert all(len(p) <= 40 for p in pieces) and "para one" in pieces[0] and pieces[-1].endswith("last")
    assert retrieval.split_text("x" * 95, 40, 10) and retrieval.split_text("", 40, 10) == []


def diagram(spark, kind, *lines):
    return spark.createDataFrame([(1, kind, k, x) for k, x in enumerate(lines, 1)], "diagram_id long, diagram_type string, line_no int, line string")


@pytest.mark.parametrize(
    "kind, lines, want",
    [
        ("architecture", ['graph TD', '  a["x"]', '  b["y"]', "  a --> b"], set()),
        ("architecture", ["graph", "  1a --> b"], {"graph_direction", "node_id_format", "node_definition"}),
        ("architecture", ["graph TD", "  a -- b"], {"edge_syntax"}),
        ("architecture", ["graph TD", '  a["x "y""]'], {"quote_escaping"}),
        ("architecture", ["graph TD", "  a{x}"], {"special_characters"}),
        ("class", ["classDiagram", "  class !x"], {"class_declaration"}),
        ("class", ["graph TD", "  class A {", "  }"], {"syntax_header"}),
        ("sequence", ["sequenceDiagram", "  participant a", "  a->>b: go()"], {"participant_references"}),
        ("sequence", ["sequenceDiagram"], {"empty_diagram"}),
        ("sequence", ["", " "], {"syntax_header", "empty_diagram"}),
    ],
)
def test_rules(spark, kind, lines, want):
    assert {r["rule"] for r in rules.validate(diagram(spark, kind, *lines)).collect()} == want


def test_a_long_name_is_no_trouble(spark):
    began = time.time()
    rules.node_definition(diagram(spark, "architecture", "graph TD", "  " + "x" * 40_000 + " ")).collect()
    assert time.time() - began < 20


def test_disabled_beats_enabled():
    assert rules.enabled("a") and not rules.enabled("a", frozenset("a"), frozenset("a")) and not rules.enabled("b", frozenset("a"))
