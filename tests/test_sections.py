"""Excerpts for sections, stores of state and small lookups, on small projects."""

import pytest

from codeloom.operators import calls, facts, incremental, manifests, sections, xref
from codeloom.sources.code_tree import read_tree

FILES = {
    "app": (True, "from .core import Engine\nfrom .core import _Hidden\nimport numpy\n"),
    "app.core": (False, "import os\nfrom app.parts import Wheel\n\nclass Base:\n    def stop(self): return 0\n\nclass Engine(Base):\n    wheel = Wheel\n    spare = Wheel()\n    def start(self):\n        self.stop()\n        self.turn()\n    def turn(self):\n        return read()\n\nclass _Hidden:\n    pass\n\ndef read():\n    return os.getenv('A')\n"),
    "app.parts": (False, "class Round:\n    pass\n\nclass Wheel(Round):\n    pass\n"),
    "tests.test_core": (False, "import os, pytest\nfrom app.core import Engine\n\ndef env():\n    return os.environ\n\ndef test_start():\n    e = Engine()\n    e.start()\n"),
}


def test_candidates_of_sections(spark):
    files = spark.createDataFrame([("p", m, pkg, text) for m, (pkg, text) in FILES.items()], "project string, module string, is_package boolean, content string")
    rows = facts.facts(files).cache()
    defined = calls.definitions(rows)
    order = calls.lineage(calls.class_bases(rows, defined, calls.aliases(rows)))
    found = sections.candidates(rows, files, calls.call_edges(rows), defined, order).cache()
    taken = {r["section"]: r["taken"] for r in sections.contexts(found).collect()}
    core = "app.core."  # turn reaches read, so it comes before stop; of those that reach nothing, the one found first
    assert taken == {
        "overview": ["api", core + "Engine.start", core + "Engine.turn", core + "Engine", core + "Base", core + "_Hidden"],
        "dependencies": ["imports"],
        "key classes and functions": [core + "Engine", core + "Base", core + "_Hidden"],
        "data flow": [core + "Engine.start", core + "Engine.turn", core + "Base.stop", core + "read"],
        "integration points": ["api", core + "Engine.start", core + "Engine.turn", "app.parts.Wheel", "app.parts.Round", core + "read"],
    }
    texts = {r["name"]: r["text"] for r in found.collect()}
    assert texts["api"] == "Names the package exports, by the module that defines them:\napp.core: Engine, _Hidden"
    assert texts["imports"] == "Third-party imports, by module:\napp: numpy"


def test_selection_of_sections(spark):
    names = ["Overview", "Key Classes and Functions", "Data Flow", "Code Quality Insights"]
    asked = spark.createDataFrame([(1, "dataflow"), (1, " "), (2, "code_quality"), (2, "classes"), (3, "KEY-classes-functions"), (4, "nothing")], "request int, name string")
    assert {(r["request"], r["ord"], r["section"]) for r in sections.select_sections(asked, names).collect()} == {(1, 3, names[2]), (2, 4, names[3]), (2, 2, names[1]), (3, 2, names[1]), (4, None, None)}


def test_prompts_about_references(spark):
    prompts = spark.createDataFrame([("p", "a", "Cross things"), ("p", "b", "plain"), ("q", "a", "a reference")], "project string, section string, prompt string")
    found = sections.with_references(prompts, spark.createDataFrame([("p", "REPORT")], "project string, report string"))
    assert {(r["project"], r["section"], r["prompt"]) for r in found.collect()} == {("p", "a", "Cross things\n\n## Cross-references found in the code\n\nREPORT"), ("p", "b", "plain"), ("q", "a", "a reference")}


def test_roots_and_names(spark):
    folders = spark.createDataFrame([("/w/src/pkg/sub",), ("/w/src",), ("/lib",)], "folder string")
    packages = spark.createDataFrame([("/w/src/pkg",), ("/w/src/pkg/sub",)], "folder string")
    assert {tuple(r) for r in manifests.roots(folders, packages).collect()} == {("/w/src/pkg/sub", "/w/src"), ("/w/src", "/w/src"), ("/lib", "/lib")}
    assert [r[0] for r in folders.orderBy("folder").select(manifests.project_name("folder")).collect()] == ["lib", "w", "sub"]


def test_find_components(spark):
    some = spark.createDataFrame([("a", "class"), ("b", "module")], "name string, type string")
    assert xref.find(some, "a").count() == 1 and xref.find(some, kind="module").first()["name"] == "b" and xref.find(some, "a", "module").isEmpty()


def test_first_files_and_empty_trees(spark, tmp_path):
    for name in "cab":
        (tmp_path / f"{name}.py").write_text("x = 1")
    assert [r["path"] for r in read_tree(spark, str(tmp_path), most=2)[0].collect()] == ["a.py", "b.py"]
    (tmp_path / "none").mkdir()
    assert read_tree(spark, str(tmp_path / "none"))[0].count() == 0
    with pytest.raises(Exception, match="holds none of"):
        read_tree(spark, str(tmp_path / "none"), required=True)[0].count()


def test_index_and_sections_are_kept(spark, tmp_path):
    states = incremental.Store(spark, f"{tmp_path}/states", "path string, content_hash string")
    chunks = incremental.Store(spark, f"{tmp_path}/chunks", "path string, text string")
    made = []

    def fresh(due):
        made.append(sorted(r["path"] for r in due.collect()))
        return due.selectExpr("path", "concat(path, content_hash) as text")

    def run(files, **more):
        now = spark.createDataFrame(files, "path string, content_hash string")
        return {tuple(r) for r in incremental.update_index(states, chunks, now, fresh, **more).collect()}

    assert states.read() is None
    assert run([("a", "1"), ("b", "1")]) == {("a", "new"), ("b", "new")}
    assert run([("a", "1"), ("b", "1")]) == {("a", "unchanged"), ("b", "unchanged")}
    assert run([("a", "1"), ("b", "2"), ("c", "1")]) == {("a", "unchanged"), ("b", "changed"), ("c", "new")}
    assert {tuple(r) for r in chunks.read().collect()} == {("a", "a1"), ("b", "b2"), ("c", "c1")}
    run([("c", "1")], refresh=True)
    assert {tuple(r) for r in chunks.read().collect()} == {("c", "c1")} and made == [["a", "b"], ["b", "c"], ["c"]]

    cache = incremental.Store(spark, f"{tmp_path}/sections", "section string, key_hash string, content string")
    calls_ = spark.sparkContext.accumulator(0)

    def model(batches):
        for batch in batches:
            calls_.add(batch.num_rows)
            yield batch

    generate = lambda due: due.mapInArrow(model, due.schema).selectExpr("section", "key_hash", "concat(section, key_hash) as content", "section = 'cut' as truncated")
    wanted = lambda key: spark.createDataFrame([("flow", key), ("cut", key)], "section string, key_hash string")
    runs = [{(r["section"], r["content"], r["cached"]) for r in incremental.run_sections(cache, wanted(k), generate, refresh).collect()} for k, refresh in (("1", False), ("1", False), ("2", False), ("2", True))]
    assert runs == [{("flow", "flow1", False), ("cut", "cut1", False)}, {("flow", "flow1", True), ("cut", "cut1", False)}, {("flow", "flow2", False), ("cut", "cut2", False)}, {("flow", "flow2", False), ("cut", "cut2", False)}]
    assert {tuple(r) for r in cache.read().collect()} == {("flow", "2", "flow2")}
    assert calls_.value == 2 + 1 + 2 + 2  # once for each section that isn't cached


def best_first_by_hand(follow, reach, start, most):
    """Visits by looking through all that is known each time."""
    out, waiting, found = [], [(start, 0)], {start}
    while waiting and len(out) < most:
        at = min(waiting, key=lambda w: (-reach.get(w[0], 0), w[1])) if out else waiting[0]
        waiting.remove(at)
        out.append(at[0])
        for n in follow.get(at[0], []):
            if n not in found:
                found.add(n)
                waiting.append((n, len(found)))
    return out


@pytest.mark.parametrize("whole", [0, 50_000])
def test_walks_of_many_rounds_equal_plain_walks(spark, monkeypatch, whole):
    import random

    from codeloom.operators import graph

    monkeypatch.setattr(graph, "WHOLE", whole)
    rng = random.Random(11)
    edges, reach, starts = [], {}, {}
    for project, n, fan in (("deep", 6, 1), ("wide", 400, 30), ("mixed", 300, 3)):
        starts[project] = 0
        for s in range(n):
            edges += [(project, k, s, rng.randrange(n) if project != "deep" else s + 1) for k in range(rng.randrange(fan + 1) if s else fan + 2)]
        edges += [("deep", 9, s, s + 1) for s in range(n)] if project == "deep" else []
        reach[project] = {k: rng.randrange(6) for k in range(n + 1)}
    follow = {p: {} for p in starts}
    for p, k, s, d in sorted(edges):
        follow[p].setdefault(s, []).append(d)
    args = (
        spark.createDataFrame(edges, "project string, ord int, src long, dst long"),
        spark.createDataFrame([(p, k, r) for p, some in reach.items() for k, r in some.items()], "project string, node long, reach long"),
        spark.createDataFrame([*starts.items(), ("alone", 5)], "project string, node long"),
    )
    for most in (200, 7) if whole else (40,):
        found = {}
        for r in graph.best_first(*args, most).orderBy("project", "ord").collect():
            found.setdefault(r["project"], []).append(r["node"])
        assert found == {p: best_first_by_hand(follow[p], reach[p], 0, most) for p in starts} | {"alone": [5]}


def test_entry_walk_equals_a_plain_walk(spark, sf):
    from codeloom.operators import graph
    from codeloom.plans import tables
    from codeloom.plans.queries import QUERIES

    edges = tables.part_graph(spark, sf)
    reach, starts, follow = {}, {}, {}
    for r in graph.reach(edges).collect():
        reach.setdefault(r["project"], {})[r["node"]] = r["reach"]
    for project, _, src, dst in sorted(map(tuple, edges.collect())):
        follow.setdefault(project, {}).setdefault(src, []).append(dst)
    for project, some in follow.items():
        called = {d for s, those in some.items() for d in those if d != s}
        free = [(-r, n) for n, r in reach[project].items() if r > 0 and n not in called]
        if free:
            starts[project] = min(free)[1]
    found = {}
    for r in QUERIES["entry_walk"](spark, sf).orderBy("project", "ord").collect():
        found.setdefault(r["project"], []).append(r["node"])
    assert found == {p: best_first_by_hand(follow[p], reach[p], start, 200) for p, start in starts.items()}


def test_section_contexts_equal_a_plain_fill(spark, sf):
    from codeloom.plans import tables
    from codeloom.plans.queries import QUERIES

    outlines = {}
    for r in facts.facts(tables.modules(spark, sf).select("project", "module", "is_package", "content")).where("kind = 'outline'").collect():
        outlines.setdefault(r["project"], []).append((r["module"], r["ord"], r["value"]))
    want = {}
    for project, some in outlines.items():
        used, taken, seen = 0, [], []
        for _, _, text in sorted(some):
            if text not in seen:
                seen.append(text)
        for text in seen[:200]:
            if text and used + len(text) <= 12_000:
                used += len(text)
                taken.append(text)
        want[project] = taken
    assert {r["project"]: list(r["taken"]) for r in QUERIES["section_contexts"](spark, sf).collect()} == want


def test_chunks_of_documents(spark, sf):
    """Pieces are within the size, stand in the text in order, leave nothing but white space out and share no more than the overlap."""
    from codeloom.operators.retrieval import split_text
    from codeloom.plans.queries import QUERIES

    docs = {str(r["doc_id"]): r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    found = {}
    for r in QUERIES["chunk_split"](spark, sf).orderBy("source", "chunk").collect():
        found.setdefault(r["source"], []).append(r["n_chars"])
    assert found.keys() == {d for d, t in docs.items() if t.strip()}
    for source, sizes in found.items():
        text, at, end = docs[source], 0, 0
        pieces = split_text(text)
        assert [len(p) for p in pieces] == sizes and max(sizes) <= 2000
        for piece in pieces:
            at = text.index(piece, max(0, end - 200) if end else 0)
            assert not text[end:at].strip() and end - at <= 200
            end = at + len(piece)
        assert not text[end:].strip()


def test_section_hashes_change_with_what_they_depend_on(spark):
    def keys(content, model="m", prompt="ask", settings="", extra=()):
        files = spark.createDataFrame([("p", "a", False, content), ("p", "b", False, "import os\n"), *extra], "project string, module string, is_package boolean, content string")
        asked = spark.createDataFrame([("p", s, s, model, prompt, settings) for s in ("all", "imports", "entities")] + [("none", "all", "all", model, prompt, settings)], "project string, section string, part string, model string, prompt string, settings string")
        rows = facts.facts(files, "entities", "imports")
        return {(r["project"], r["section"]): r["key_hash"] for r in incremental.section_hashes(asked, incremental.part_digests(files, rows)).collect()}

    first = keys("import os\n\ndef f():\n    '''Doc.'''\n")
    assert keys("import os\n\ndef f():\n    '''Doc.'''\n") == first and len(set(first.values())) == 4
    moved = lambda other: {s for (_, s), h in other.items() if h != first["p", s]}
    inside = {k: v for k, v in keys("import os\n\ndef f():\n    '''Doc.'''\n    return 1\n").items() if k[0] == "p"}
    assert moved(inside) == {"all"}
    doc = {k: v for k, v in keys("import os\n\ndef f():\n    '''Other.'''\n").items() if k[0] == "p"}
    assert moved(doc) == {"all", "entities"}
    for more in ({"model": "n"}, {"prompt": "x"}, {"settings": "y"}, {"extra": (("p", "c", False, ""),)}):
        assert moved({k: v for k, v in keys("import os\n\ndef f():\n    '''Doc.'''\n", **more).items() if k[0] == "p"}) == {"all", "imports", "entities"}


def test_hash_only_suspects_all(spark):
    now = spark.createDataFrame([("a", 1.0, 2), ("b", 1.0, 2)], "path string, mtime double, size long")
    known = spark.createDataFrame([("a", 1.0, 2, 100.0)], "path string, mtime double, size long, last_analyzed double")
    assert {r["path"] for r in incremental.suspects(now, known).collect()} == {"b"} and incremental.suspects(now, known, hash_only=True).count() == 2
