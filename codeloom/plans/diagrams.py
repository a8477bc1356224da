"""Graphs as lines of text diagrams: (project, ord, line) in order.

A line's order key is an array: the section first, then names, so that lines
are made by unions and explodes and sorted once at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.text import clean_identifier, quoted_label
from codeloom.operators import graph
from codeloom.operators import names as names_module
from codeloom.operators.store import grows

LIMIT = 50


def _line(rows: DataFrame, section: int, keys: list, text) -> DataFrame:
    key = F.array(*[F.coalesce(k, F.lit("")) for k in keys], *[F.lit("")] * (3 - len(keys)))
    return rows.select("project", F.lit(section).alias("section"), key.alias("key"), text.alias("line"))


def _ordered(parts: list[DataFrame]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, parts).distinct()
    w = Window.partitionBy("project").orderBy("section", "key", "line")
    return rows.select("project", F.row_number().over(w).alias("ord"), "line")


def _heads(projects: DataFrame, header: str) -> DataFrame:
    return _line(projects.select("project").distinct(), 0, [], F.lit(header))


def _node(name, label) -> F.Column:
    return F.concat(F.lit("        "), clean_identifier(name), F.lit('["'), quoted_label(label), F.lit('"]'))


def _edge(a, b) -> F.Column:
    return F.concat(F.lit("    "), clean_identifier(a), F.lit(" --> "), clean_identifier(b))


def _note(edges: DataFrame, limit: int) -> DataFrame:
    n = graph.degrees(edges, ("project",)).groupBy("project").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return _line(n, 9, [], F.lit(f'    truncation_notice["the {limit} most connected nodes"]'))


def grouped_graph(edges: DataFrame, groups: DataFrame, header: str = "graph TD", limit: int = LIMIT, nodes: DataFrame | None = None) -> DataFrame:
    """A graph of ``edges`` (project, src, dst) whose nodes stand in subgraphs by ``groups`` (project, node, group): architecture and call graphs.

    The ``limit`` most connected nodes of each project stay. Nodes and projects
    without edges aren't drawn but with ``nodes`` (project, node): then all count
    as nodes, and a project whose only node is null gets a note instead.
    """
    if nodes is not None:
        return _with_lone(edges, groups, header, limit, nodes)
    return _grouped(edges, groups, header, graph.most_connected(edges, limit, ("project",)), edges, _note(edges, limit))


def _with_lone(edges: DataFrame, groups: DataFrame, header: str, limit: int, nodes: DataFrame) -> DataFrame:
    every = nodes.where("node is not null").select("project", "node").distinct().join(graph.degrees(edges, ("project",)), ["project", "node"], "left").fillna({"degree": 0})
    top = every.withColumn("_k", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("degree"), "node"))).where(F.col("_k") <= limit).drop("_k")
    many = every.groupBy("project").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    note = _line(many, 9, [], F.lit(f'    truncation_notice["the {limit} most connected nodes"]'))
    bare = nodes.select("project").distinct().join(every.select("project").distinct(), "project", "left_anti")
    nothing = _line(bare, 9, [], F.lit('    note["nothing to draw"]'))
    return _grouped(edges, groups, header, top, nodes, note.unionByName(nothing))


def _grouped(edges: DataFrame, groups: DataFrame, header: str, top: DataFrame, projects: DataFrame, notes: DataFrame) -> DataFrame:
    kept = graph.induced(edges, top, ("project",))
    shown = top.join(groups, ["project", "node"], "left").withColumn("group", F.coalesce("group", "node"))
    # a group's own node is its package; others are named within it
    inside = F.col("node").startswith(F.concat("group", F.lit(".")))
    within = F.when(inside, F.expr("substring(node, length(`group`) + 2)")).when(F.col("node") == F.col("group"), F.lit("__init__")).otherwise(F.col("node"))
    opens = _line(shown, 1, [F.col("group"), F.lit("0")], F.concat(F.lit("    subgraph "), clean_identifier(F.col("group")), F.lit('__group["'), quoted_label("group"), F.lit('"]')))
    nodes = _line(shown, 1, [F.col("group"), F.lit("1"), F.col("node")], _node(F.col("node"), within))
    ends = _line(shown, 1, [F.col("group"), F.lit("2")], F.lit("    end"))
    arrows = _line(kept, 2, [F.col("src"), F.col("dst")], _edge(F.col("src"), F.col("dst")))
    return _ordered([_heads(projects, header), opens, nodes, ends, arrows, notes])


def dependency(edges: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Package dependencies from ``edges`` (project, src, dst, kind of dst): internal nodes, third parties in a subgraph, then edges."""
    top = graph.most_connected(edges, limit, ("project",))
    kept = graph.induced(edges, top, ("project",))
    outside = edges.where("kind = 'third_party'").select("project", F.col("dst").alias("node")).distinct()
    inner = top.join(outside, ["project", "node"], "left_anti")
    outer = top.join(outside, ["project", "node"], "left_semi")
    parts = [
        _heads(edges, "graph LR"),
        _line(inner, 1, [F.col("node")], _node(F.col("node"), F.col("node"))),
        _line(outer, 2, [F.lit("0")], F.lit('    subgraph third_party["Third-party"]')),
        _line(outer, 2, [F.lit("1"), F.col("node")], _node(F.col("node"), F.col("node"))),
        _line(outer, 2, [F.lit("2")], F.lit("    end")),
        _line(kept, 3, [F.col("src"), F.col("dst")], _edge(F.col("src"), F.col("dst"))),
        _note(edges, limit),
    ]
    return _ordered(parts)


def class_diagram(classes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Classes of ``classes`` (project, ord, name, base, methods): the first of each cleaned name, its methods, and arrows to its first base.

    The note appears once the limit is reached, and arrows are drawn for all
    classes, also for those that the limit leaves out.
    """
    first = classes.withColumn("id", clean_identifier("name")).groupBy("project", "id").agg(F.min(F.struct("ord", "base", "methods")).alias("_first")).select("project", "id", "_first.ord", "_first.base", "_first.methods")
    w = Window.partitionBy("project").orderBy("ord", "id")
    first = first.withColumn("k", F.row_number().over(w))
    shown = first.where(F.col("k") <= limit)
    key = F.lpad(F.col("k").cast("string"), 9, "0")
    parts = [
        _heads(classes, "classDiagram"),
        _line(shown, 1, [key, F.lit("0")], F.concat(F.lit("    class "), "id", F.lit(" {"))),
        _line(shown.select("project", "k", F.posexplode("methods").alias("m", "method")), 1, [key, F.lit("1"), F.lpad(F.col("m").cast("string"), 9, "0")], F.concat(F.lit("        +"), "method", F.lit("()"))),
        _line(shown, 1, [key, F.lit("2")], F.lit("    }")),
        _line(first.where("base is not null"), 2, [key], F.concat(F.lit("    "), clean_identifier("base"), F.lit(" <|-- "), "id")),
        _line(first.groupBy("project").agg(F.count("*").alias("n")).where(F.col("n") >= limit), 9, [], F.lit(f'    note "the first {limit} classes"')),
    ]
    return _ordered(parts)


def participant_labels(messages: DataFrame, modules: DataFrame, classes: DataFrame) -> DataFrame:
    """(project, name, label) of the senders and receivers of ``messages``: the last part of a class or module, a function's name within its module; the full name where labels clash.

    ``modules``: (project, known); ``classes``: (project, name).
    """
    names = messages.select("project", F.explode(F.array("sender", "receiver")).alias("name")).distinct()
    held = names_module.longest_prefix(names, modules, "name", ("project",))
    whole = classes.select("project", "name").unionByName(modules.select("project", F.col("known").alias("name"))).distinct().withColumn("whole", F.lit(True))
    last, rest = F.element_at(F.split("name", r"\."), -1), F.expr("substring(name, length(match) + 2)")
    some = names.join(grows(held), ["project", "name"], "left").join(grows(whole), ["project", "name"], "left")
    some = some.withColumn("short", F.when(F.col("whole"), last).when(F.col("match").isNotNull(), rest).otherwise(F.col("name")))
    clash = F.count("*").over(Window.partitionBy("project", "short")) > 1
    return some.select("project", "name", F.when(clash, F.col("name")).otherwise(F.col("short")).alias("label"))


def sequence_diagram(messages: DataFrame, labels: DataFrame) -> DataFrame:
    """``messages`` (project, ord, level, sender, receiver, label, truncated) with ``labels`` (project, name, label): participants in order of appearance, then arrows.

    A message that others are nested in activates its receiver until the last of them; a note ends what was truncated.
    """
    seen = messages.select("project", F.explode(F.array(F.struct((F.col("ord") * 2).alias("at"), F.col("sender").alias("name")), F.struct((F.col("ord") * 2 + 1).alias("at"), F.col("receiver").alias("name")))).alias("x")).select("project", "x.*")
    first = seen.groupBy("project", "name").agg(F.min("at").alias("at")).join(labels.withColumnRenamed("label", "shown"), ["project", "name"], "left")
    pad = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    # messages are in order of calls, so those nested in one follow it up to the next of the first level
    outer = F.last(F.when(F.col("level") == 1, F.struct("ord", "receiver")), ignorenulls=True).over(Window.partitionBy("project").orderBy("ord"))
    nested = messages.withColumn("outer", outer).where("level > 1").groupBy("project", F.col("outer.ord").alias("ord"), F.col("outer.receiver").alias("opened")).agg(F.max("ord").alias("until"))
    arrows = messages.join(nested.select("project", "ord", "opened"), ["project", "ord"], "left")
    start = messages.where("truncated").groupBy("project").agg(F.min_by("sender", "ord").alias("start"), F.count("*").alias("n"))
    sign = F.when(F.col("opened").isNotNull(), "->>+").otherwise("->>")
    return _ordered(
        [
            _heads(messages, "sequenceDiagram"),
            _line(first, 1, [pad("at")], F.concat(F.lit("    participant "), clean_identifier("name"), F.lit(" as "), F.coalesce("shown", "name"))),
            _line(arrows, 2, [pad("ord"), F.lit("0")], F.concat(F.lit("    "), clean_identifier("sender"), sign, clean_identifier("receiver"), F.lit(": "), "label", F.lit("()"))),
            _line(nested, 2, [pad("until"), F.lit("1")], F.concat(F.lit("    deactivate "), clean_identifier("opened"))),
            _line(start, 9, [], F.concat(F.lit("    Note over "), clean_identifier("start"), F.lit(": the first "), F.col("n").cast("string"), F.lit(" calls"))),
        ]
    )


def text(lines: DataFrame) -> DataFrame:
    """(project, diagram): all lines of a project as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "line")))
    return lines.groupBy("project").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("diagram"))
