"""Facts, names and calls on small projects."""

import random

import pytest

from codeloom.operators import calls, facts, graph, names, sequence
from codeloom.sources.code_tree import read_tree
from codeloom.streaming.changes import apply_batch, follow

FILES = {
    "shop.models": "class Base:\n    def save(self): pass\n\nclass Order(Base):\n    def total(self):\n        return self.lines()\n    def lines(self): return []\n",
    "shop.api": "from .models import Order\nimport shop.models as m\nimport json\n\n"
    "def place(order: Order, other):\n    order.save()\n    order.total()\n    other.total()\n    x = Order()\n    x.lines()\n    json.dumps(1)\n\n"
    "class Api:\n    def __init__(self):\n        self.order = Order()\n    def run(self):\n        self.order.save()\n        place(self.order, None)\n        m.Order()\n\n"
    "class Sub(Api):\n    def run(self):\n        super().run()\n        Api()\n",
}


@pytest.fixture(scope="module")
def rows(spark):
    data = [("p", m, False, t) for m, t in FILES.items()]
    return facts.facts(spark.createDataFrame(data, "project string, module string, is_package boolean, content string")).cache()


def test_entities_are_top_level(rows):
    found = {(r["module"], r["name"], r["flags"]) for r in facts.of_kind(rows, "entity").collect()}
    assert found == {("shop.models", "Base", "class"), ("shop.models", "Order", "class"), ("shop.api", "place", "function"), ("shop.api", "Api", "class"), ("shop.api", "Sub", "class")}


def test_call_edges(rows):
    found = {(r["caller"], r["callee"], r["is_internal"]) for r in calls.call_edges(rows).collect()}
    assert found == {
        ("shop.models.Order.total", "shop.models.Order.lines", True),
        ("shop.api.place", "shop.models.Base.save", True),
        ("shop.api.place", "shop.models.Order.total", True),
        ("shop.api.place", "total", False),
        ("shop.api.place", "shop.models.Order", True),
        ("shop.api.place", "shop.models.Order.lines", True),
        ("shop.api.place", "dumps", False),
        ("shop.api.Api.__init__", "shop.models.Order", True),
        ("shop.api.Api.run", "shop.models.Base.save", True),
        ("shop.api.Api.run", "shop.api.place", True),
        ("shop.api.Api.run", "shop.models.Order", True),
        ("shop.api.Sub.run", "shop.api.Api.run", True),
        ("shop.api.Sub.run", "shop.api.Api.__init__", True),
    }


MORE = """

import shop.models
from shop.models import Order


def make() -> Order: ...


def first(x: Order):
    def inner():
        make()
    x = unknown()
    x.save()
    y = make()
    y.total()
    inner()


def twice():
    json.old()


def twice():
    make()


class Api:
    order = Order()
    @property
    def latest(self) -> "Order": ...
    def old(self): make()
    def old(self): self.order.total()


class Sub(Api):
    def run(self):
        self.order.save()
        self.latest.lines()
"""


def test_calls_of_nested_replaced_and_inherited(spark):
    data = [("p", "shop.models", False, FILES["shop.models"]), ("p", "shop.more", False, MORE), ("p", "bad", False, "  x = 1\n")]
    rows = facts.facts(spark.createDataFrame(data, "project string, module string, is_package boolean, content string")).cache()
    found = {(r["caller"].removeprefix("shop.more."), r["callee"], r["is_internal"]) for r in calls.call_edges(rows).where("caller like 'shop.more.%'").collect()}
    save, total, lines, made = (("shop.models.Base.save", True), ("shop.models.Order.total", True), ("shop.models.Order.lines", True), ("shop.more.make", True))
    assert found == {
        ("first.inner", *made), ("first", *save), ("first", *total), ("first", "unknown", False), ("first", *made), ("first", "inner", False),
        ("twice", *made), ("Api.old", *total), ("Sub.run", *save), ("Sub.run", *lines),
    }
    at = {r["name"]: r["line"] for r in facts.of_kind(rows, "entity").where("module = 'shop.more'").collect()}
    assert at["make"] == MORE.split("\n").index("def make() -> Order: ...") + 1
    assert facts.of_kind(rows, "error").select("module").collect() == [("bad",)]


def test_a_broken_file_is_an_error_row(spark):
    bad = spark.createDataFrame([("p", "m", False, "def (")], "project string, module string, is_package boolean, content string")
    assert [r["kind"] for r in facts.facts(bad).collect()] == ["error"]


@pytest.mark.parametrize(
    "bases, want",
    [
        ([("A", ["B", "C"]), ("B", ["D"]), ("C", ["D"]), ("D", [])], {"A": ["A", "B", "C", "D"]}),
        ([("A", ["A"])], {"A": ["A"]}),
        ([("A", ["B"]), ("B", ["A"])], {"A": ["A", "B"], "B": ["B", "A"]}),
        ([("X", []), ("Y", []), ("A", ["X", "Y"]), ("B", ["Y", "X"]), ("C", ["A", "B"])], {"C": ["C", "A", "X", "Y", "B"]}),
    ],
)
def test_lineage(spark, bases, want):
    data = [("p", c, k, b) for c, bs in bases for k, b in enumerate(bs or [None])]
    found: dict = {}
    for r in calls.lineage(spark.createDataFrame(data, "project string, cls string, ord int, base string")).orderBy("cls", "ord").collect():
        found.setdefault(r["cls"], []).append(r["base"])
    assert {c: found[c] for c in want} == want


def test_placement_order(spark):
    modules = spark.createDataFrame([(m,) for m in ("app", "app.core", "app.core.io", "lib.json")], "module string")
    asked = [("app.core.io", False, i) for i in ("app.core.io.read", ".util", "..missing", "....far", "json", "core.io", "io", "requests.get", "app.nothing")]
    found = {r["imported"]: (r["kind"], r["target"]) for r in names.place_imports(spark.createDataFrame(asked, "module string, is_package boolean, imported string"), modules).collect()}
    assert found == {
        "app.core.io.read": ("internal", "app.core.io"),
        ".util": ("internal", "app.core"),
        "..missing": ("internal", "app"),
        "....far": (None, None),
        "json": ("stdlib", "json"),
        "core.io": ("internal", "app.core.io"),
        "io": ("stdlib", "io"),
        "requests.get": ("third_party", "requests"),
        "app.nothing": ("internal", "app"),
    }


def test_entry_point_leaves_tests_out(spark):
    from codeloom.functions.text import is_test_name

    edges = spark.createDataFrame([("p", "tests.t.run", "a.main"), ("p", "a.main", "a.x"), ("p", "a.x", "a.y"), ("p", "b.go", "a.y")], "project string, src string, dst string")
    assert [tuple(r) for r in graph.entry_points(edges, graph.reach(edges), is_test_name).collect()] == [("p", "a.main", 2)]


def test_tree_keeps_packages_and_prunes(spark, tmp_path):
    for path, text in {"p/__init__.py": "", "p/a.py": "x = 1\r\n", "p/empty.py": "", "p/blank.py": " ", "p/_b.py": "y", "venv/c.py": "z", "q/pyvenv.cfg": "", "q/d.py": "w", "gen/e_gen.py": "v"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_bytes(text.encode())
    (tmp_path / "p/bad.py").write_bytes(b"\xff\xfe")
    (tmp_path / "out.py").symlink_to("/etc/hostname")
    good, bad = read_tree(spark, str(tmp_path), exclude=("*_gen.py",))
    assert {r["path"]: r["content"] for r in good.collect()} == {"p/__init__.py": "", "p/a.py": "x = 1\n", "p/_b.py": "y", "p/blank.py": " "}
    assert {r["path"] for r in bad.collect()} == {"p/empty.py", "p/bad.py"}


def test_batches_of_changes(spark, tmp_path):
    schema = "path string, content_hash string, content string, seen long"
    apply_batch(spark, spark.createDataFrame([("a", "1", "one", 1), ("b", "1", "two", 1)], schema), str(tmp_path), 0, None)
    apply_batch(spark, spark.createDataFrame([("b", "2", "new", 2), ("a", None, None, 2), ("c", "1", "three", 2)], schema), str(tmp_path), 1, 0)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/chunks/batch=1").collect()} == {("b", 0, "new"), ("c", 0, "three")}


def test_stream_of_changes(spark, tmp_path):
    schema = "path string, content_hash string, content string, seen long"
    spark.createDataFrame([("a", "1", "one", 1)], schema).write.parquet(f"{tmp_path}/in")
    follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/chunks/batch=0").collect()} == {("a", 0, "one")}


def test_structure(spark, rows):
    from codeloom.operators import structure

    files = spark.createDataFrame([("p", "shop", True, "from .models import Order\nfrom shop.api import place, Order"), ("p", "shop.models", False, ""), ("p", "shop.api", False, "")], "project string, module string, is_package boolean, content string")
    found = structure.exports(facts.facts(files), files)
    assert [tuple(r) for r in structure.api_map(found).collect()] == [("p", "Names the package exports, by the module that defines them:\nshop.models: Order\nshop.api: place, Order")]
    order = spark.createDataFrame([("p", "B", 0, "B"), ("p", "B", 1, "A"), ("p", "C", 0, "C"), ("p", "C", 1, "A")], "project string, cls string, ord int, base string")
    firsts = spark.createDataFrame([("p", 0, "B"), ("p", 1, "C")], "project string, ord int, cls string")
    assert [r["cls"] for r in structure.key_classes(firsts, order).orderBy("ord").collect()] == ["B", "A", "C"]
    texts = {(r["kind"], r["name"]): r["value"] for r in rows.where("kind in ('outline', 'excerpt')").collect()}
    assert texts["outline", "Order"] == "class Order(Base):\n    def total(self): ...\n    def lines(self): ..."
    assert texts["excerpt", "Base.save"] == "    def save(self): pass"


def test_long_excerpts_are_cut_at_a_line():
    body = "\n".join(f"    x{k} = {k}" for k in range(900))
    found = [f for f in facts.facts_of(f'def f():\n    """First.\n\n    Second.\n    """\n{body}\n') if f[0] == "excerpt"]
    assert len(found) == 1 and len(found[0][4]) <= facts.EXCERPT + 3 and '"""First."""' in found[0][4] and "Second" not in found[0][4] and found[0][4].endswith("\n...")


def test_reach_takes_no_project_into_one_task(spark):
    rng = random.Random(3)
    pairs = [("p", k, k + 1) for k in range(12)] + [("p", rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [("q", 1, 1), ("q", 1, 2), ("q", 1, 2)]
    edges = spark.createDataFrame(pairs, "project string, src long, dst long")
    want = set()
    for project, node in {(p, n) for p, *ends in pairs for n in ends}:
        seen, todo = {node}, [node]
        while todo:
            at = todo.pop()
            fresh = {d for p, s, d in pairs if p == project and s == at} - seen
            seen |= fresh
            todo += fresh
        want.add((project, node, len(seen) - 1))
    found = graph.reach(edges)
    assert {tuple(r) for r in found.collect()} == want
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    capped = {(r["project"], r["node"]): r["reach"] for r in graph.reach(edges, 5).collect()}
    assert all(capped[p, n] == r if r < 5 else 5 <= capped[p, n] <= r for p, n, r in want)
    assert graph.reach(edges.limit(0)).count() == 0


def planned(calls, entry, limit):
    follow, seen, walked = {}, {}, set()
    for caller, ord_, callee in sorted(calls):
        follow.setdefault(caller, []).append(callee)
    own = lambda f: f.rpartition(".")[0]

    def walk(f, level):
        if (f, level) in walked:
            return
        walked.add((f, level))
        for callee in follow.get(f, ()):
            if own(callee) == own(f):
                walk(callee, level)
                continue
            message = (own(f), own(callee), callee.rpartition(".")[2])
            if message not in seen:
                seen[message] = level
            if level < sequence.DEPTH:
                walk(callee, level + 1)

    walk(entry, 1)
    return [(k + 1, level, *m, len(seen) > limit) for k, (m, level) in enumerate(seen.items())][:limit]


def test_sequence_equals_a_walk(spark):
    rng = random.Random(7)
    chains = {"fold": [("A.main", 1, "A.one"), ("A.one", 1, "A.two"), ("A.two", 1, "B.x"), ("A.two", 2, "C.y"), ("C.y", 1, "C.z"), ("C.z", 1, "A.main")]}
    for n in (1, 2, 3):
        chains[f"random{n}"] = [("A.main" if k == 0 else f"{rng.choice('ABC')}.f{rng.randrange(5)}", k, f"{rng.choice('ABC')}.f{rng.randrange(5)}") for k in range(12 * n)]
    calls = spark.createDataFrame([(p, *c) for p, some in chains.items() for c in some], "project string, caller string, ord int, callee string")
    entries = spark.createDataFrame([(p, "A.main") for p in [*chains, "none"]], "project string, node string")
    for limit in (30, 4):
        got = sequence.plan(calls, entries, limit).orderBy("project", "ord").collect()
        for p, some in chains.items():
            assert [tuple(r)[1:] for r in got if r["project"] == p] == planned(some, "A.main", limit), p
    assert [tuple(r)[3:6] for r in got if r["project"] == "fold"] == [("A", "B", "x"), ("A", "C", "y"), ("C", "A", "main")]


def walked(follow, classes, entry, limit):
    """A depth-first planner: classes, else modules, else functions."""
    module = lambda f: f.split(".")[0]
    owner = lambda f: f.rpartition(".")[0] if f.rpartition(".")[0] in classes else None
    for kind, who in (("classes", owner), ("modules", module), ("functions", lambda f: f)):
        drawn, states = {}, set()

        def walk(f, me, level, stack):
            if (f, me, level) in states:
                return
            states.add((f, me, level))
            for callee in follow.get(f, ()):
                made = callee in classes
                if made and not classes[callee]["made"]:
                    continue
                receiver = module(callee) if kind == "modules" else callee if made else who(callee)
                if receiver is None or receiver == me or receiver in classes.get(me, {}).get("above", ()):
                    if not made and callee not in stack:
                        walk(callee, me, level, stack | {callee})
                    continue
                message = (me, receiver, callee.rpartition(".")[2])
                if message not in drawn:
                    drawn[message] = level
                    if level < sequence.DEPTH and not made and callee not in stack:
                        walk(callee, receiver, level + 1, stack | {callee})

        walk(entry, who(entry) or module(entry), 1, frozenset({entry}))
        if drawn:
            return [(kind, k + 1, level, *m, len(drawn) > limit) for k, (m, level) in enumerate(drawn.items())][:limit]
    return []


def test_plan_equals_a_depth_first_planner(spark):
    rng = random.Random(11)
    classes = {"m.A": {"made": True, "above": ("n.C",)}, "m.B": {"made": False, "above": ()}, "n.C": {"made": True, "above": ()}}
    names = [f"{c}.{f}" for c in classes for f in ("x", "y", "z")] + ["m.f", "n.g", "o.h", *classes]
    projects = {f"p{n}": {} for n in range(12)} | {"alone": {"o.h": ["o.i"]}, "plain": {"m.f": ["n.g"], "n.g": ["o.h"]}}
    for n in range(12):
        # later names only, so that what is reached first doesn't hang on which functions are being run
        for caller in ["m.f", *names[:9]]:
            later = names[names.index(caller) + 1 :] if caller != "m.f" else names[:9]
            projects[f"p{n}"][caller] = list(dict.fromkeys(rng.choice(later) for _ in range(rng.randrange(1, 4))))
    calls = [(p, caller, k, callee) for p, some in projects.items() for caller, found in some.items() for k, callee in enumerate(found)]
    known = [(p, f, f.split(".")[0], f.rpartition(".")[0] if f.rpartition(".")[0] in classes else None, f in classes, classes.get(f, {}).get("made", False)) for p in projects for f in [*names, "o.i"]]
    above = [(p, c, b) for p in projects for c, has in classes.items() for b in has["above"]]
    starts = {p: "o.h" if p == "alone" else "m.f" for p in projects}
    args = (
        spark.createDataFrame(calls, "project string, caller string, ord int, callee string"),
        spark.createDataFrame(known, "project string, name string, module string, cls string, is_class boolean, made boolean"),
        spark.createDataFrame(above, "project string, cls string, base string"),
        spark.createDataFrame(list(starts.items()), "project string, node string"),
    )
    for limit in (30, 2):
        got = sequence.plan_calls(*args, limit).orderBy("project", "ord").collect()
        for p, some in projects.items():
            assert [tuple(r)[1:] for r in got if r["project"] == p] == walked(some, classes, starts[p], limit), (p, some)
    assert {r["kind"] for r in got} == {"classes", "modules", "functions"}


CHAINS = """
from shop.models import Order


class Shop:
    def __init__(self):
        self.order = Order()


class Mall:
    def __init__(self):
        self.shop = Shop()
    def run(self):
        self.shop.order.save()


def make() -> Order: ...


def go(s: Shop):
    s.order.total()
    make().lines()
    Order().save()
    unknown().other()
    s.order.missing()
"""


def test_calls_behind_attributes_and_calls(spark):
    data = [("p", "shop.models", False, FILES["shop.models"]), ("p", "shop.chains", False, CHAINS)]
    rows = facts.facts(spark.createDataFrame(data, "project string, module string, is_package boolean, content string"))
    found = {(r["caller"].removeprefix("shop.chains."), r["callee"], r["is_internal"]) for r in calls.call_edges(rows).where("caller like 'shop.chains.%'").collect()}
    order = "shop.models.Order"
    assert found == {
        ("Shop.__init__", order, True), ("Mall.__init__", "shop.chains.Shop.__init__", True), ("Mall.run", "shop.models.Base.save", True),
        ("go", f"{order}.total", True), ("go", "shop.chains.make", True), ("go", f"{order}.lines", True), ("go", order, True), ("go", "shop.models.Base.save", True),
        ("go", "unknown", False), ("go", "other", False), ("go", "missing", False),
    }


def test_graphs_with_lone_nodes(spark):
    from codeloom.plans import diagrams

    edges = spark.createDataFrame([("p", "a.x", "b.y")], "project string, src string, dst string")
    nodes = spark.createDataFrame([("p", "a.x"), ("p", "b.y"), ("p", "a.lone"), ("q", "c"), ("none", None)], "project string, node string")
    groups = spark.createDataFrame([("p", "a.x", "a"), ("p", "a.lone", "a"), ("p", "b.y", "b")], "project string, node string, group string")
    lines = {}
    for r in diagrams.grouped_graph(edges, groups, nodes=nodes).orderBy("project", "ord").collect():
        lines.setdefault(r["project"], []).append(r["line"].strip())
    assert lines == {
        "p": ["graph TD", 'subgraph a__group["a"]', 'a_lone["lone"]', 'a_x["x"]', "end", 'subgraph b__group["b"]', 'b_y["y"]', "end", "a_x --> b_y"],
        "q": ["graph TD", 'subgraph c__group["c"]', 'c["__init__"]', "end"],
        "none": ["graph TD", 'note["nothing to draw"]'],
    }
    assert all(r["project"] == "p" and "lone" not in r["line"] for r in diagrams.grouped_graph(edges, groups).collect())
