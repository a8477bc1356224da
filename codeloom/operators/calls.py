"""Who calls whom: callees of call sites as joins over facts.

A call of a dotted name means what the name means in its module (``names.Lookup``);
a call on something that a name, attribute or call holds means the method of the
class that ``receivers`` finds for it, the first along the class's lineage; ``super()``
means the classes behind. A name that the function binds hides what the module calls
by it, whether or not its class is known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .facts import of_kind
from .lineage import lineage
from .names import Lookup
from .receivers import receivers
from .store import grows, kept


#: Groups of facts that ``call_edges`` reads.
GROUPS = ("entities", "calls", "imports")


def _qualified(module, name) -> F.Column:
    return F.concat_ws(".", module, name)


def definitions(rows: DataFrame) -> DataFrame:
    """(project, module, name, qualified, what) of classes, functions and methods."""
    top = of_kind(rows, "entity").select("project", "module", "name", _qualified(F.col("module"), F.col("name")).alias("qualified"), F.col("flags").alias("what"))
    methods = of_kind(rows, "method").select("project", "module", F.concat_ws(".", "owner", "name").alias("name"), _qualified(F.col("module"), F.concat_ws(".", "owner", "name")).alias("qualified"), F.lit("method").alias("what"))
    return top.unionByName(methods).distinct()


def aliases(rows: DataFrame) -> DataFrame:
    """(project, module, name, target): what each imported name stands for; the last binding wins."""
    from codeloom.functions.text import import_base

    found = of_kind(rows, "alias")
    level, plain = F.length(F.regexp_extract("value", r"^(\.*)", 1)), F.regexp_replace("value", r"^\.+", "")
    target = F.when(level > 0, import_base(F.col("module"), F.col("is_package"), plain, level)).otherwise(plain)
    return found.withColumn("target", target).groupBy("project", "module", "name").agg(F.max_by("target", "ord").alias("target"))


def lookup_of(rows: DataFrame, defined: DataFrame, bound: DataFrame) -> Lookup:
    """What the names of bases, annotations and calls mean in the modules of ``rows`` (facts); each name is looked up once."""
    top = defined.where("what in ('class', 'function') or length(name) - length(replace(name, '.', '')) = 1")
    asked = of_kind(rows, "base").select("project", "module", "name")
    asked = asked.unionByName(of_kind(rows, "call").where("flags = 'static'").select("project", "module", F.col("value").alias("name")))
    asked = asked.unionByName(of_kind(rows, "step").where("flags in ('said', 'made')").select("project", "module", F.explode(F.split("name", ",")).alias("name")))
    return Lookup(top, of_kind(rows, "module").select("project", "module"), bound, asked)


def bases_by(lookup: Lookup, rows: DataFrame, defined: DataFrame) -> DataFrame:
    """(project, cls, ord, base) for ``lineage``: bases that are no known class are left out."""
    classes = defined.where("what = 'class'").select("project", F.col("qualified").alias("cls"))
    uses = of_kind(rows, "base").where("not contains(owner, '.')").select("project", "module", F.col("name"), F.col("owner").alias("holder"), F.col("ord").alias("k"))
    found = lookup.resolved(uses).where("is_class")
    found = found.select("project", _qualified(F.col("module"), F.col("holder")).alias("cls"), F.col("k").alias("ord"), F.col("owner").alias("base"))
    return classes.join(grows(found), ["project", "cls"], "left")


def class_bases(rows: DataFrame, defined: DataFrame, bound: DataFrame) -> DataFrame:
    """``bases_by`` for ``rows`` (facts) that may hold no calls."""
    return bases_by(lookup_of(rows, defined, bound), rows, defined)


def call_edges(rows: DataFrame) -> DataFrame:
    """(project, caller, ord, callee, named, is_internal): every call site of ``rows`` (facts) with what it calls.

    A callee that isn't found stays as its last name and is not internal; a
    class that is called means its (inherited) ``__init__`` if there is one,
    and ``named`` is the class itself.
    """
    defined, bound = kept(definitions(rows), "defined"), aliases(rows)
    lookup = lookup_of(rows, defined, bound)
    order = lineage(bases_by(lookup, rows, defined))
    methods = defined.where("what = 'method'").select("project", F.regexp_replace("qualified", r"\.[^.]+$", "").alias("base"), F.substring_index("qualified", ".", -1).alias("method"), F.col("qualified").alias("full"))
    along = order.join(methods, ["project", "base"]).groupBy("project", "cls", "method")
    # the first class of a lineage that has a method, and the first behind the class itself
    both = kept(along.agg(F.min_by("full", "ord").alias("full"), F.min_by("full", F.when(F.col("ord") > 0, F.col("ord"))).alias("behind")), "methods")
    has, behind = both.select("project", "cls", "method", "full"), both.where("behind is not null").select("project", "cls", "method", F.col("behind").alias("full"))
    held = receivers(rows, lookup, order, has, behind)

    sites = of_kind(rows, "call").select("project", "module", _qualified(F.col("module"), F.col("owner")).alias("caller"), "ord", F.col("name").alias("last"), F.col("value").alias("ref"), F.col("flags").alias("mode"))
    own, method = ["project", "module", "caller", "ord"], ["project", "cls", "last"]
    of_class = has.withColumnsRenamed({"method": "last", "full": "found"})
    static = lookup.resolved(sites.where("mode = 'static'").select(*own, F.col("ref").alias("name")))
    static = static.join(of_class.withColumnRenamed("cls", "through"), ["project", "through", "last"], "left").select(*own, F.coalesce("owner", "found").alias("found"))
    path = sites.where("mode = 'path'").withColumn("step", F.col("ref").cast("int")).join(held.final, ["project", "module", "step"]).join(of_class, method).select(*own, "found")
    above = sites.where("mode = 'super'").withColumn("cls", _qualified(F.col("module"), F.col("ref"))).join(behind.withColumnsRenamed({"method": "last", "full": "found"}), method).select(*own, "found")
    met = static.unionByName(path).unionByName(above).where("found is not null")
    out = sites.where("mode = 'bare'").withColumn("found", F.lit(None).cast("string")).unionByName(sites.where("mode <> 'bare'").join(grows(met), own, "left").select(*sites.columns, "found"))
    init = has.where("method = '__init__'").select("project", F.col("cls").alias("found"), F.col("full").alias("init"))
    out = out.join(init, ["project", "found"], "left")
    out = out.select("project", "caller", "ord", F.coalesce("init", "found", "last").alias("callee"), F.coalesce("found", "last").alias("named"), F.col("found").isNotNull().alias("is_internal"))
    first = Window.partitionBy("project", "caller", "callee", "named").orderBy("ord")
    return out.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
