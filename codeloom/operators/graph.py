"""Graphs of edges (src, dst): degrees, top nodes, induced edges, reach, walks.

Degrees, top-k and induced edges are plain aggregations and semi-joins; ``reach``
is in a module of its own. Best-first walks go in rounds over the part of a
project that they can come to.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reach import reach
from .store import grows, kept


def degrees(edges: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, node, degree) over distinct edges; an edge to itself counts twice."""
    some = edges.select(*scope, "src", "dst").distinct()
    ends = some.withColumn("node", F.explode(F.array("src", "dst")))
    return ends.groupBy(*scope, "node").agg(F.count("*").alias("degree"))


def most_connected(edges: DataFrame, k: int = 50, scope: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` nodes of highest degree (in each scope), ties by name."""
    found = degrees(edges, scope)
    if not scope:
        return found.orderBy(F.desc("degree"), "node").limit(k)
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("degree"), "node"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def induced(edges: DataFrame, nodes: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """Distinct edges with both ends among ``nodes`` (node)."""
    some = edges.select(*scope, "src", "dst").distinct()
    left = nodes.select(*scope, F.col("node").alias("src"))
    right = nodes.select(*scope, F.col("node").alias("dst"))
    return some.join(left, [*scope, "src"], "left_semi").join(right, [*scope, "dst"], "left_semi").select(*scope, "src", "dst")


def truncation(edges: DataFrame, k: int = 50, inclusive: bool = False) -> DataFrame:
    """(n_nodes, truncated, note): whether ``k`` nodes cut the graph (or, ``inclusive``, filled the limit)."""
    n = degrees(edges).agg(F.count("*").alias("n_nodes"))
    cut = F.col("n_nodes") >= k if inclusive else F.col("n_nodes") > k
    note = F.when(cut, F.lit(f"the {k} most connected nodes"))
    return n.select("n_nodes", cut.alias("truncated"), note.alias("note"))


def roll_up(edges: DataFrame, nodes: DataFrame, group: str) -> DataFrame:
    """(``group``, target): distinct edges between the groups of their ends, none to itself; a group without edges keeps one row with a null target."""
    a = nodes.select(F.col("node").alias("src"), F.col(group))
    b = nodes.select(F.col("node").alias("dst"), F.col(group).alias("target"))
    found = edges.join(a, "src").join(b, "dst").where(F.col(group) != F.col("target")).select(group, "target").distinct()
    return nodes.select(group).distinct().join(found, group, "left")


def entry_points(edges: DataFrame, reached: DataFrame, is_test=None) -> DataFrame:
    """(project, node, reach): of the nodes that nothing else calls and that reach another, the one that reaches most, ties by name.

    ``is_test`` (column of a name) leaves tests out, both as entries and as callers.
    """
    calls = edges.where("src <> dst")
    nodes = reached.where("reach > 0")
    if is_test is not None:
        calls, nodes = calls.where(~is_test(F.col("src"))), nodes.where(~is_test(F.col("node")))
    free = nodes.join(calls.select("project", F.col("dst").alias("node")).distinct(), ["project", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("reach"), "node"))
    return free.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


#: Projects of at most so many edges are fetched as a whole; one task holds them.
WHOLE = 50_000


def best_first(edges: DataFrame, reached: DataFrame, starts: DataFrame, most: int = 200) -> DataFrame:
    """(project, ord, node): the nodes visited from each project's start, always the known one that reaches most next, ties by discovery.

    Of a project of more than WHOLE edges only what can be among the first ``most`` is fetched: a round walks
    over the edges fetched so far until it comes to a node whose edges are missing,
    and names the nodes that may be visited from there, at most ``most``; their edges
    come by a join, of each node the ``most`` whose ends reach most. So a task holds
    at most ``most`` times ``most`` edges of a round, not a project's.
    """
    kind = edges.schema["src"].dataType.simpleString()
    goals = grows(reached.select("project", F.col("node").alias("dst"), F.col("reach").alias("goal")))
    first = edges.groupBy("project", "src", "dst").agg(F.min("ord").alias("ord"))
    roots = grows(starts.select("project", F.col("node").alias("start")).distinct())
    schema = f"project string, ord int, node {kind}, missing boolean"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        start, asked = pdf["start"].iloc[0], set(pdf["src"])
        some = pdf[pdf["dst"].notna()].sort_values(["src", "ord", "dst"])
        follow = {s: list(zip(g["dst"].astype(pdf["start"].dtype), g["goal"])) for s, g in some.groupby("src")}
        heap, seen, out, found = [(0, 0, start)], {start}, [], 0
        while heap and len(out) < most and heap[0][2] in asked:
            node = heapq.heappop(heap)[2]
            out.append((key[0], len(out) + 1, node, False))
            for other, goal in follow.get(node, ()):
                if other not in seen:
                    seen.add(other)
                    found += 1
                    heapq.heappush(heap, (-goal, found, other))
        if heap and len(out) < most:  # a node's edges are missing; so may be those of what comes after it
            out += [(key[0], 0, n, True) for _, _, n in heapq.nsmallest(most - len(out), heap) if n not in asked]
        return pd.DataFrame(out, columns=["project", "ord", "node", "missing"])

    small = grows(first.groupBy("project").count().where(F.col("count") <= WHOLE))
    asked = roots.select("project", F.col("start").alias("src")).unionByName(first.join(small, "project", "left_semi").join(roots, "project", "left_semi").select("project", "src")).distinct()
    # ends without edges of their own are known to have none
    ends = first.join(small, "project", "left_semi").join(roots, "project", "left_semi").select("project", F.col("dst").alias("src"))
    asked, known = grows(asked.unionByName(ends).distinct()), None
    while True:
        rank = F.row_number().over(Window.partitionBy("project", "src").orderBy(F.desc("goal"), "ord", "dst"))
        fetched = first.join(asked, ["project", "src"], "left_semi").join(goals, ["project", "dst"]).withColumn("_k", rank).where(F.col("_k") <= most).drop("_k")
        fetched = kept(asked.join(fetched, ["project", "src"], "left").select("project", "src", "dst", "ord", "goal"), "fetched")
        known = fetched if known is None else known.unionByName(fetched)
        walked = kept(known.join(roots, "project").groupBy("project").applyInPandas(run, schema), "walk")
        asked = walked.where("missing").select("project", F.col("node").alias("src"))
        if asked.isEmpty():
            return walked.select("project", "ord", "node")


def clashing_labels(names: DataFrame) -> DataFrame:
    """(name, label): the last dotted part where no other name has it, else the full name."""
    short = F.element_at(F.split("name", r"\."), -1)
    n = F.count("*").over(Window.partitionBy("_short"))
    some = names.select("name").distinct().withColumn("_short", short).withColumn("_n", n)
    return some.select("name", F.when(F.col("_n") == 1, F.col("_short")).otherwise(F.col("name")).alias("label"))
