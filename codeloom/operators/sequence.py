"""A sequence of messages from a project's entry point, planned level by level.

What runs a call is a participant: a class, else a module, else the function
itself, whichever kind is the first to give any message (all three are planned
at once, as rows of three modes). A state is a function and the participant
that runs it. Calls inside one participant, to classes it inherits from, and to
functions that have no participant of that mode are folded into it: joins follow
them until nothing new comes, without a new level, and each state keeps its
first place in call order. Calls to others are the level's messages. Rounds of a
level are as many as its longest chain of folded calls; levels are bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import grows, kept

DEPTH = 2
KINDS = ("classes", "modules", "functions")
STATE = ["project", "mode", "caller", "participant"]
MESSAGE = ["project", "mode", "sender", "receiver", "label"]


def participant(function) -> F.Column:
    """A name less its last part."""
    return F.regexp_replace(function, r"\.[^.]+$", "")


def _first(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """The row of least path for each of ``keys``."""
    return rows.groupBy(*keys).agg(F.min(F.struct("path", *more)).alias("_least")).select(*keys, "_least.*")


def _moves(states: DataFrame, steps: DataFrame, above: DataFrame) -> DataFrame:
    """What each state calls, and whether that ``stays`` with its participant."""
    kin = above.select("project", F.col("cls").alias("participant"), F.col("base").alias("receiver"), F.lit(True).alias("kin"))
    moves = states.join(steps, ["project", "mode", "caller"]).join(kin, ["project", "participant", "receiver"], "left")
    stays = F.col("receiver").isNull() | (F.col("receiver") == F.col("participant")) | F.col("kin").isNotNull()
    return moves.withColumns({"stays": stays, "runs": ~F.col("is_class") & ~F.array_contains("stack", F.col("callee")), "path": F.concat("path", F.array("ord"))})


def _enter(moves: DataFrame, who: str) -> DataFrame:
    return moves.select("project", "mode", F.col("callee").alias("caller"), F.col(who).alias("participant"), "path", F.concat("stack", F.array("callee")).alias("stack"))


def _folded(front: DataFrame, steps: DataFrame, above: DataFrame) -> DataFrame:
    """``front`` and all states that folded calls reach from it, each at its least path."""
    known = front = kept(_first(front, STATE, "stack"), "front")
    while not front.isEmpty():
        step = _first(_enter(_moves(front, steps, above).where("stays and runs"), "participant"), STATE, "stack")
        before = known.select(*STATE, F.col("path").alias("before"))
        front = kept(step.join(before, STATE, "left").where("before is null or path < before").drop("before"), "front")
        known = kept(_first(known.unionByName(front), STATE, "stack"), "folded")
    return known


def plan_calls(calls: DataFrame, known: DataFrame, above: DataFrame, entries: DataFrame, limit: int = 30) -> DataFrame:
    """(project, kind, ord, level, sender, receiver, label, truncated): what the ``entries`` (project, node) call.

    ``calls``: (project, caller, ord, callee). ``known``: (project, name, module,
    cls, is_class, made), functions with the class that holds them if any, and
    classes, ``made`` if a constructor is known for them. ``above``: (project,
    cls, base), the classes that each class inherits from.

    A class that is called is a message to it if its constructor is known and it
    isn't the caller's own kind, and isn't followed. Each (sender, receiver,
    label) is drawn once, where it comes first; ``limit`` messages stay, and
    ``truncated`` says whether there were more. ``kind``: what the participants are.
    """
    calls = calls.select("project", "caller", F.col("ord").cast("long").alias("ord"), "callee")
    by_mode = lambda cls: F.posexplode(F.array(cls, F.col("module"), F.col("name"))).alias("mode", "receiver")
    own = F.when(F.col("is_class"), F.col("name")).otherwise(F.col("cls"))
    targets = known.where("not is_class or made").select("project", F.col("name").alias("callee"), "is_class", by_mode(own))
    # a function is its own participant in the last mode, and so is a class that is called
    steps = kept(calls.join(targets, ["project", "callee"]), "steps")
    starts = entries.select("project", F.col("node").alias("name")).join(known.where("not is_class"), ["project", "name"])
    front = starts.select("project", F.col("name").alias("caller"), by_mode(F.coalesce("cls", "module", "name")), F.array(F.lit(0).cast("long")).alias("path"), F.array("name").alias("stack"))
    front = front.withColumn("participant", F.coalesce("receiver", "caller")).drop("receiver")
    found = None
    for level in range(1, DEPTH + 1):
        step = _moves(_folded(front, steps, above), steps, above).where("not stays")
        step = step.withColumns({"sender": F.col("participant"), "label": F.element_at(F.split("callee", r"\."), -1), "level": F.lit(level)})
        step = kept(_first(step, MESSAGE, "callee", "runs", "stack", "level"), "level")
        found = step if found is None else found.unionByName(step)
        front = _enter(step.where("runs"), "receiver")
    chosen = Window.partitionBy("project")
    drawn = _first(found, MESSAGE, "level").withColumn("_kind", F.min("mode").over(chosen)).where("mode = _kind")
    first = drawn.withColumn("ord", F.row_number().over(chosen.orderBy("path", "sender", "receiver", "label"))).where(F.col("ord") <= limit + 1)
    first = first.withColumn("truncated", F.max("ord").over(chosen) > limit).where(F.col("ord") <= limit)
    return first.select("project", F.get(F.array(*map(F.lit, KINDS)), F.col("mode")).alias("kind"), "ord", "level", "sender", "receiver", "label", "truncated")


def plan(calls: DataFrame, entries: DataFrame, limit: int = 30) -> DataFrame:
    """``plan_calls`` where nothing but the names is known: what a name has before its last part is its participant."""
    names = calls.select("project", F.explode(F.array("caller", "callee")).alias("name")).unionByName(entries.select("project", F.col("node").alias("name"))).distinct()
    known = names.select("project", "name", participant(F.col("name")).alias("module"), participant(F.col("name")).alias("cls"), F.lit(False).alias("is_class"), F.lit(False).alias("made"))
    none = known.limit(0).select("project", "cls", F.col("module").alias("base"))
    out = plan_calls(calls, known, none, entries, limit).where(F.col("kind") == KINDS[0])
    return out.drop("kind")


def project_plan(edges: DataFrame, defined: DataFrame, order: DataFrame, limit: int = 30) -> DataFrame:
    """``plan_calls`` from the entry point of each project, by its ``edges`` (call_edges), ``defined`` (definitions) and ``order`` (lineage)."""
    from codeloom.functions.text import is_test_name

    from . import graph

    inits = defined.where((F.col("what") == "method") & F.col("name").endswith(".__init__")).select("project", participant(F.col("qualified")).alias("base"))
    made = order.join(inits, ["project", "base"], "left_semi").select("project", F.col("cls").alias("name"), F.lit(True).alias("made")).distinct()
    is_class = F.col("what") == "class"
    cls = F.when(F.col("what") == "method", participant(F.col("qualified")))
    known = grows(defined.select("project", F.col("qualified").alias("name"), "module", cls.alias("cls"), is_class.alias("is_class")).join(grows(made), ["project", "name"], "left").fillna({"made": False}))
    runs = defined.where(~is_class).select("project", F.col("qualified").alias("dst"))
    reached = kept(edges.select("project", F.col("caller").alias("src"), F.col("callee").alias("dst")).join(runs, ["project", "dst"], "left_semi").distinct(), "reached")
    entries = graph.entry_points(reached, graph.reach(reached), is_test_name)
    calls = edges.where("is_internal").select("project", "caller", "ord", F.col("named").alias("callee"))
    return plan_calls(calls, known, order.where("ord > 0"), entries, limit)
