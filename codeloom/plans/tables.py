"""Inputs that Spark derives from the given tables for the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_edges(spark, sf_dir) -> DataFrame:
    """(src, dst): customer to supplier, for every line of every order; grows with the tables."""
    t = lambda n: table(spark, sf_dir, n)
    sold = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    return sold.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))


def traders(spark, sf_dir) -> DataFrame:
    """(node, nation): customers and suppliers, named as in ``trade_edges``."""
    t = lambda n: table(spark, sf_dir, n)
    named = lambda kind, n, key, nation: t(n).select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("node"), F.col(nation).alias("n_nationkey"))
    ends = named("c", "customer", "c_custkey", "c_nationkey").unionByName(named("s", "supplier", "s_suppkey", "s_nationkey"))
    return ends.join(F.broadcast(t("nation").select("n_nationkey", F.col("n_name").alias("nation"))), "n_nationkey").select("node", "nation")  # nation: 25 rows at every scale


def part_graph(spark, sf_dir) -> DataFrame:
    """(project, ord, src, dst): a digraph for each brand, part keys modulo 200."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("project"), F.col("p_partkey").alias("ord"), (F.col("p_partkey") % 200).alias("src"), ((3 * F.col("p_partkey") + F.col("p_size")) % 200).alias("dst"))


def part_net(spark, sf_dir) -> DataFrame:
    """(project, src, dst): one project of all parts, each with two edges to any others, so that most reach each other; grows with the table."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    n = p.agg(F.max("k").alias("n"))
    ends = F.explode(F.array((3 * F.col("k") + F.col("s")) % (F.col("n") + 1), (7 * F.col("k") + F.col("s") * F.col("s")) % (F.col("n") + 1)))
    return p.join(F.broadcast(n)).select(F.lit("net").alias("project"), F.col("k").alias("src"), ends.alias("dst"))  # one row


def part_chain(spark, sf_dir) -> DataFrame:
    """(project, ord, src, dst): one project of all parts, each with an edge to a later key; grows with the table."""
    p = table(spark, sf_dir, "part")
    return p.select(F.lit("all").alias("project"), F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("src"), (3 * F.col("p_partkey") + F.col("p_size")).alias("dst"))


def hosts(spark, sf_dir) -> DataFrame:
    """(page_id, name): the host of each page, its labels from the top down as a dotted name."""
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)
    dotted = F.array_join(F.reverse(F.split(host, r"\.")), ".")
    return table(spark, sf_dir, "pages").select("page_id", "url", host.alias("host"), dotted.alias("name"))


def modules(spark, sf_dir) -> DataFrame:
    """(project, module, is_package, content): a Python module written for each part; it imports, extends and calls the module of another."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("project"), F.col("p_partkey").alias("k"), F.col("p_size").alias("s"), F.col("p_name").alias("n"))
    other = (F.col("k") * 3 + F.col("s")) % 200
    text = F.format_string(
        '"""%s."""\nimport os\nfrom pkg%d.m%d import Thing%d\n\n\nclass Thing%d(Thing%d):\n    """A %s."""\n\n    def run(self, other: Thing%d):\n        helper%d()\n        other.stop()\n        return self.step()\n\n    def step(self):\n        return Thing%d()\n\n\ndef helper%d():\n    return os.getcwd()\n',
        "n", other % 5, other, other, "k", other, "n", other, "k", other, "k",
    )
    return p.select("project", F.format_string("pkg%d.m%d", F.col("k") % 5, "k").alias("module"), F.lit(False).alias("is_package"), text.alias("content"), "k", "s", "n")


def part_trees(spark, sf_dir) -> DataFrame:
    """(project, module, is_package, content, j): a Python module for each part, fifty in a project; module j uses 2j + 1 and 2j + 2.

    Even ones build, hold and call parts through attributes, constructors and
    return annotations; odd ones inherit and call their bases.
    """
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.format_string("tree%d", F.floor(k / 50)).alias("project"), (k % 50).cast("int").alias("j"))
    a, b = 2 * F.col("j") + 1, 2 * F.col("j") + 2
    build = "\n\ndef build%d() -> Part%d:\n    return Part%d()\n"
    even = F.format_string(
        "from app.m%d import Part%d\nfrom app.m%d import build%d\n\n\nclass Part%d:\n    def __init__(self):\n        self.left = Part%d()\n\n    def run(self):\n        self.check()\n        self.left.run()\n        right = build%d()\n        right.run()\n\n    def check(self):\n        return 0\n" + build,
        a, a, b, b, "j", a, b, "j", "j", "j",
    )
    odd = F.format_string(
        "from app.m%d import Part%d\n\n\nclass Part%d(Part%d):\n    def run(self):\n        super().run()\n        return helper%d()\n\n\ndef helper%d():\n    return 0\n" + build,
        a, a, "j", a, "j", "j", "j", "j", "j",
    )
    return p.select("project", F.format_string("app.m%d", "j").alias("module"), F.lit(False).alias("is_package"), F.when(F.col("j") % 2 == 0, even).otherwise(odd).alias("content"), "j")


#: What a module does with the class P and the function make of another, by turns; {k} is its own number, {o} the other's.
SHAPES = (
    "def use(e: P):\n    d = e\n    f = d\n    f.start()\n",
    "def use(e: P | int, g: 'None | P', h: P | Part{k}):\n    e.start()\n    g.stop()\n    h.stop()\n",
    "def use(make, *P, **rest):\n    make()\n    P.stop()\n    rest.start()\n",
    "def use():\n    make().again().stop()\n    x = make().again()\n    x.start()\n",
    "class Box:\n    def __init__(this):\n        this.held = make()\n\n    def use(this):\n        with this.held as h:\n            h.start()\n        this.held.twin.stop()\n",
    "def use():\n    x = P()\n    x = Part{k}()\n    x.start()\n",
    "def use(items, pair):\n    for make in items:\n        make()\n    P, _ = pair\n    P.start()\n",
    "class Kid(P):\n    def start(self):\n        super().start()\n        self.stop()\n        self.twin.start()\n",
    "import app.m{o}\n\n\ndef use():\n    app.m{o}.build()\n    app.m{o}.Part{o}.stop(None)\n    app.m{o}.nothing()\n",
    "async def fetch() -> P: ...\n\n\nasync def use():\n    p = await fetch()\n\n    def inner(make):\n        p.stop()\n        make()\n    inner(1)\n",
)


def shaped_modules(spark, sf_dir) -> DataFrame:
    """(project, module, is_package, content): a module for each part, fifty in a project, of the shape that its size says, and a package; it uses the module of another part."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.format_string("set%d", F.floor(k / 50)).alias("project"), k.alias("k"), ((k % 50 * 7 + F.col("p_size")) % 50 + F.floor(k / 50) * 50).alias("o"), (F.col("p_size") % len(SHAPES) + 1).cast("int").alias("shape"))
    number = lambda c: F.col(c).cast("string")
    head = F.format_string("from app.m%d import Part%d as P, build as make\n\n\n", "o", "o")
    own = F.format_string('class Part%d:\n    def start(self): ...\n    def stop(self): ...\n    def again(self) -> "Part%d": ...\n    @property\n    def twin(self) -> P: ...\n\n\ndef build() -> Part%d: ...\n\n\n', "k", "k", "k")
    body = F.element_at(F.array(*map(F.lit, SHAPES)), F.col("shape"))
    text = F.concat(head, own, F.replace(F.replace(body, F.lit("{k}"), number("k")), F.lit("{o}"), number("o")))
    made = p.select("project", F.format_string("app.m%d", "k").alias("module"), F.lit(False).alias("is_package"), text.alias("content"))
    return made.unionByName(p.select("project", F.lit("app").alias("module"), F.lit(True).alias("is_package"), F.lit("").alias("content")).distinct())


def diagram_lines(spark, sf_dir) -> DataFrame:
    """(diagram_id, diagram_type, line_no, line): a small diagram for each part, flawed by turns."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("diagram_id"), F.col("p_partkey").alias("k"), F.col("p_size").alias("s"), F.col("p_name").alias("n"))
    kind = F.element_at(F.array(*map(F.lit, ("architecture", "class", "sequence"))), (F.col("k") % 3 + 1).cast("int"))
    head = F.when(F.col("s") % 10 == 0, "diagram").when(F.col("k") % 3 == 0, F.when(F.col("s") % 4 == 0, "graph").otherwise("graph TD")).when(F.col("k") % 3 == 1, "classDiagram").otherwise("sequenceDiagram")
    graph = F.array(F.format_string('    a%d["%s"]', "k", "n"), F.format_string("    %s --> b%d", F.when(F.col("s") % 5 == 0, F.lit("9x")).otherwise(F.format_string("a%d", "k")), "s"), F.when(F.col("s") % 7 == 0, F.lit("    a -- b")).otherwise(F.lit('    c["say "x""]')))
    cls = F.array(F.when(F.col("s") % 6 == 0, F.lit("    class !bad")).otherwise(F.format_string("    class C%d {", "k")), F.lit("        +run()"), F.lit("    }"))
    seq = F.array(F.format_string("    participant p%d", "k"), F.format_string("    p%d->>q%d: go()", "k", "s"))
    body = F.when(F.col("k") % 3 == 0, graph).when(F.col("k") % 3 == 1, cls).otherwise(seq)
    lines = F.concat(F.array(head), F.when(F.col("s") % 11 == 0, F.array().cast("array<string>")).otherwise(body))
    return p.select("diagram_id", kind.alias("diagram_type"), F.posexplode(lines).alias("at", "line")).select("diagram_id", "diagram_type", (F.col("at") + 1).alias("line_no"), "line")
