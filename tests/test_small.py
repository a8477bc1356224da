"""Small operators that no query reaches."""

import re

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import budget, incremental, retrieval, structure, usage
from codeloom.plans import rules


def test_chunks_under_headers_of_their_sources(spark):
    rows = spark.createDataFrame([("g", 2, "b.py", "two"), ("g", 1, "a.py", "one"), ("g", 3, "", "bare")], "g string, ord int, source string, text string")
    assert budget.labelled(rows, "g").first()["context"] == "# a.py\none\n\n---\n\n# b.py\ntwo\n\n---\n\nbare"


@pytest.mark.parametrize("value, most, want", [("a\nbb\nc", 99, "a\nbb\nc"), ("a\nbb\nc", 4, "a\n... (cut off)"), ("abc", 2, "... (cut off)"), ("a\nb", 3, "a\nb")])
def test_texts_are_cut_after_a_line(spark, value, most, want):
    assert spark.createDataFrame([(value,)], "t string").select(budget.cut_at_line(F.col("t"), most)).first()[0] == want


def test_size_of_a_cache(spark):
    some = spark.createDataFrame([("a", "é"), ("b", "xyz")], "section string, content string")
    assert tuple(incremental.cache_stats(some).first()) == (2, 5) and tuple(incremental.cache_stats(some.limit(0)).first()) == (0, 0)


def test_summary_of_costs(spark):
    events = spark.createDataFrame([("m", 120, 30, False, False), ("m", 120, 30, True, False), ("u", 5, 5, False, True)], "model string, input_tokens long, output_tokens long, cached boolean, estimated boolean")
    prices = spark.createDataFrame([("m", 1.0, 2.0)], "model string, input_per_million double, output_per_million double")
    found = usage.summary(usage.with_cost(usage.by_model(events), prices)).first()
    assert found["requests"] == 3 and abs(found["hit_rate"] - 100 / 3) < 1e-9 and abs(found["cost"] - 360e-6) < 1e-12
    assert found["models"]["m"].asDict() == {"input_tokens": 240, "output_tokens": 60, "requests": 2, "cached_requests": 1, "cost": found["cost"]} and found["models"]["u"]["cost"] == 0


def test_verdicts_on_failures(spark):
    rows = spark.createDataFrame([("file", False, True), ("file", False, True), ("section", False, True), ("section", True, True), ("diagram", False, False), ("x", True, True)], "kind string, ok boolean, required boolean")
    assert {(r["kind"], r["failed"], r["total"], r["verdict"]) for r in structure.failures(rows).collect()} == {("file", 2, 2, "error"), ("section", 1, 2, "warning"), ("diagram", 1, 1, "warning"), ("x", 0, 1, "ok")}


def test_descriptions_of_errors(spark):
    rows = spark.createDataFrame([("own", "s", "K", "m"), (None, "s", "K", "m"), (None, None, "K", "m")], "a string, b string, c string, d string")
    assert [r[0] for r in rows.select(text.error_description(*(F.col(c) for c in "abcd"))).collect()] == ["own", "s: m", "K: m"]


def test_shell_patterns():
    assert re.match(text.glob_pattern("a*/[bc]?.py"), "ax/y/b1.py") and not re.match(text.glob_pattern("a*.py"), "b.py")


@pytest.mark.parametrize("line, kind", [("graph TD", "architecture"), ("flowchart LR", "architecture"), ("classDiagram", "class"), ("sequenceDiagram", "sequence"), ("pie", None)])
def test_types_of_diagrams(spark, line, kind):
    assert spark.createDataFrame([(line,)], "l string").select(rules.detect_type(F.col("l"))).first()[0] == kind


def test_hashed_embeddings_are_units_and_repeat(spark):
    rows = spark.createDataFrame([("a b b",), ("A  b\nB",), ("",), (None,)], "t string").select(retrieval.hashing_embedder(16)("t").alias("v")).collect()
    assert rows[0]["v"] == rows[1]["v"] and abs(sum(x * x for x in rows[0]["v"]) - 1) < 1e-9 and rows[2]["v"] == rows[3]["v"] == [0.0] * 16


def test_prompts(spark):
    row = spark.createDataFrame([("T", "Do it.", ["a", "b"])], "t string, k string, s array<string>")
    assert row.select(structure.prompt(F.col("t"), F.col("k"), F.col("s"))).first()[0] == "# T\n\nDo it.\n\n- a\n- b"
