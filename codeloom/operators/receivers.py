"""The class that each step of ``flow`` holds: rounds of joins over what became final last.

A step is final when its class is known, or when it is known that it has none.
Round 0 settles what files say outright: receivers, annotations, calls of dotted
names, methods behind a class. Each further round takes the steps that still wait,
joins them with the final ones and settles those whose needs are all final; what is
settled is written, and only the rest goes on. There are as many rounds as the
longest chain of steps is long. Attributes that need each other in a circle never
become final: when a round settles nothing, the attributes that wait get what they
have, and the rounds go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facts import of_kind
from .names import Lookup
from .store import grows, kept

_STEP = ["project", "module", "step"]


def steps_of(rows: DataFrame) -> DataFrame:
    found = of_kind(rows, "step")
    return found.select("project", "module", F.col("ord").alias("step"), F.col("flags").alias("kind"), "name", F.split("value", ",").cast("array<int>").alias("needs"))


class Receivers:
    """``final``: (project, module, step, cls); ``gives``: (project, function, cls), what a call of a function gives."""

    def __init__(self, final: DataFrame, gives: DataFrame):
        self.final, self.gives = final, gives


def receivers(rows: DataFrame, lookup: Lookup, order: DataFrame, has: DataFrame, behind: DataFrame) -> Receivers:
    """Works off the steps in ``rows`` (facts).

    ``order``: lineage; ``has``, ``behind``: (project, cls, method, full), the method
    that a class has, or has behind itself.
    """
    steps = kept(steps_of(rows), "steps")
    classes = lookup.known.where("is_class").select("project", F.col("qualified").alias("cls"))

    said = steps.where("kind = 'said'").select(*_STEP, F.explode(F.split("name", ",")).alias("name"))
    said = lookup.resolved(said).where("is_class").groupBy(*_STEP).agg(F.count_distinct("owner").alias("n"), F.max("owner").alias("cls")).where("n = 1").drop("n")
    said = kept(said, "said")
    gives = of_kind(rows, "returns").select("project", "module", F.col("ord").alias("step"), F.concat_ws(".", "module", "owner").alias("function"))
    gives = kept(gives.join(said, _STEP).select("project", "function", "cls"), "gives")

    receiver = steps.where("kind = 'known'").withColumn("cls", F.concat_ws(".", "module", "name")).join(classes, ["project", "cls"], "left_semi").select(*_STEP, "cls")
    made = lookup.resolved(steps.where("kind = 'made'").select(*_STEP, "name"))  # a name that means nothing known makes nothing known
    made = made.join(has.select("project", F.col("cls").alias("through"), F.col("method").alias("last"), "full"), ["project", "through", "last"], "left")
    made = made.withColumn("function", F.coalesce(F.when(F.col("is_function"), F.col("owner")), F.when(F.col("owner").isNull(), F.col("full"))))
    made = made.join(gives, ["project", "function"], "left").select(*_STEP, F.when(F.col("is_class"), F.col("owner")).otherwise(F.col("cls")).alias("cls"))
    inherited = steps.where("kind = 'super'").withColumns({"cls": F.concat_ws(".", "module", F.substring_index("name", ".", 1)), "method": F.substring_index("name", ".", -1)})
    inherited = inherited.join(behind, ["project", "cls", "method"]).select(*_STEP, F.col("full").alias("function")).join(gives, ["project", "function"]).select(*_STEP, "cls")
    base = steps.where("needs is null").select(*_STEP)
    found = said.unionByName(receiver).unionByName(made).unionByName(inherited).where("cls is not null")
    final = kept(base.join(found, _STEP, "left"), "held")

    waiting = kept(steps.where("needs is not null"), "waiting")
    entries = kept(_entries(rows, waiting, order, gives), "entries")
    while not waiting.isEmpty():
        state = kept(_round(waiting, final, entries, has, gives), "held")
        settled = state.where("ready").select(*_STEP, "cls")
        if settled.isEmpty():  # a circle: its attributes make do with what they have
            circle = state.where("kind = 'slot'")
            settled = kept((state if circle.isEmpty() else circle).select(*_STEP, F.when(F.col("kind") == "slot", F.col("so_far")).alias("cls")), "held")
            waiting = kept(waiting.join(settled, _STEP, "left_anti"), "waiting")
        else:
            waiting = state.where("not ready").select(*waiting.columns)
        final = final.unionByName(settled)
    return Receivers(grows(final.where("cls is not null")), gives)


def _entries(rows: DataFrame, waiting: DataFrame, order: DataFrame, gives: DataFrame) -> DataFrame:
    """(project, cls, name, entries): what a class and those behind it have under a name that is asked for, nearest first.

    An entry is a slot (its module and step) or a method, which ends the search; a property gives what it is annotated to return.
    """
    asked = waiting.where("kind = 'attr'").select("project", "name").distinct()
    slots = of_kind(rows, "slot").select("project", F.concat_ws(".", "module", "owner").alias("base"), "name", F.lit(0).alias("late"), F.col("module").alias("at"), F.col("ord").alias("slot"), F.lit(None).cast("string").alias("of"))
    methods = of_kind(rows, "method").where("not contains(owner, '.')").withColumn("function", F.concat_ws(".", "module", "owner", "name")).join(gives, ["project", "function"], "left")
    methods = methods.select("project", F.concat_ws(".", "module", "owner").alias("base"), "name", F.lit(1).alias("late"), F.lit(None).cast("string").alias("at"), F.lit(None).cast("int").alias("slot"), F.when(F.col("flags") == "property", F.col("cls")).alias("of"))
    some = slots.unionByName(methods).join(asked, ["project", "name"], "left_semi").join(order, ["project", "base"])
    return some.groupBy("project", "cls", "name").agg(F.array_sort(F.collect_list(F.struct((2 * F.col("ord") + F.col("late")).alias("rank"), "at", "slot", "of"))).alias("entries"))


def _round(waiting: DataFrame, final: DataFrame, entries: DataFrame, has: DataFrame, gives: DataFrame) -> DataFrame:
    """``waiting`` with ``ready``, ``cls`` and ``so_far`` (the class that the final ones of a step's needs agree on)."""
    known = final.select("project", "module", F.col("step").alias("need"), F.col("cls").alias("of"), F.lit(True).alias("there"))
    each = waiting.select(*_STEP, "kind", F.posexplode("needs").alias("nth", "need")).join(known, ["project", "module", "need"], "left")
    hit, open_ = F.min(F.when(F.col("of").isNotNull(), F.col("nth"))), F.min(F.when(F.col("there").isNull(), F.col("nth")))
    met = each.groupBy(*_STEP).agg(F.count_distinct("of").alias("n"), F.max("of").alias("any"), F.min_by("of", F.when(F.col("of").isNotNull(), F.col("nth"))).alias("nearest"), hit.alias("hit"), open_.alias("open"))
    agreed = F.when(F.col("n") == 1, F.col("any"))
    met = waiting.join(met, _STEP).withColumn("on", F.when(F.col("kind").isin("attr", "result") & F.col("open").isNull(), F.col("any")))

    given = has.join(gives.select("project", F.col("function").alias("full"), F.col("cls").alias("result")), ["project", "full"])
    met = met.join(grows(given.select("project", F.col("cls").alias("on"), F.col("method").alias("name"), "result")), ["project", "on", "name"], "left")

    lead = met.where("kind = 'attr' and on is not null").join(entries.withColumnRenamed("cls", "on"), ["project", "on", "name"])
    lead = lead.select(*_STEP, F.explode("entries").alias("e")).select(*_STEP, "e.rank", "e.at", "e.slot", F.col("e.of").alias("own"))
    slots = final.select("project", F.col("module").alias("at"), F.col("step").alias("slot"), F.col("cls").alias("held"), F.lit(True).alias("there"))
    lead = lead.join(grows(slots), ["project", "at", "slot"], "left")
    ends, waits = F.col("slot").isNull() | F.col("held").isNotNull(), F.col("slot").isNotNull() & F.col("there").isNull()
    lead = lead.groupBy(*_STEP).agg(F.min(F.when(ends, F.col("rank"))).alias("ends"), F.min(F.when(waits, F.col("rank"))).alias("waits"), F.min_by(F.coalesce("held", "own"), F.when(ends, F.col("rank"))).alias("attr"))
    met = met.join(grows(lead), _STEP, "left")

    full = F.col("open").isNull()
    ready = F.when(F.col("kind") == "first", full | (F.col("hit") < F.col("open"))).when(F.col("kind") == "attr", full & (F.col("waits").isNull() | (F.col("ends") < F.col("waits")))).otherwise(full)
    cls = F.when(F.col("kind") == "first", F.col("nearest")).when(F.col("kind") == "attr", F.col("attr")).when(F.col("kind") == "result", F.col("result")).otherwise(agreed)
    return met.select(*waiting.columns, F.coalesce(ready, F.lit(False)).alias("ready"), cls.alias("cls"), agreed.alias("so_far"))
