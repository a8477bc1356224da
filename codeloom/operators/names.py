"""Dotted names: suffixes, prefixes and the placement of imports, as joins."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import grows, kept


def _parts(name) -> F.Column:
    return F.split(name, r"\.")


def prefixes(rows: DataFrame, name: str) -> DataFrame:
    """Each row with ``prefix`` and ``n_parts``, once for each dotted prefix of ``name`` (itself included)."""
    n = F.explode(F.sequence(F.lit(1), F.size(_parts(F.col(name)))))
    return rows.withColumn("n_parts", n).withColumn("prefix", F.array_join(F.slice(_parts(F.col(name)), F.lit(1), F.col("n_parts")), "."))


def unique_suffixes(names: DataFrame, name: str = "name", scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, suffix, owner): proper suffixes that exactly one distinct name has."""
    size = F.size(_parts(F.col(name)))
    tails = names.select(*scope, name).distinct().where(size > 1).withColumn("k", F.explode(F.sequence(F.lit(2), size)))
    tails = tails.withColumn("suffix", F.array_join(F.slice(_parts(F.col(name)), F.col("k"), size), "."))
    return tails.groupBy(*scope, "suffix").agg(F.count("*").alias("n"), F.min(name).alias("owner")).where("n = 1").drop("n")


def longest_prefix(rows: DataFrame, names: DataFrame, name: str = "name", scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, name, match): for each distinct name the longest of ``names`` (known) that is a dotted prefix of it."""
    each = prefixes(rows.select(*scope, name).distinct(), name)
    known = names.select(*scope, F.col("known").alias("prefix")).distinct()
    return each.join(grows(known), [*scope, "prefix"]).groupBy(*scope, name).agg(F.max_by("prefix", "n_parts").alias("match"))


def standard_library() -> list[str]:
    return sorted(sys.stdlib_module_names)


def place_imports(imports: DataFrame, modules: DataFrame, scope: tuple[str, ...] = (), standard: list[str] | None = None) -> DataFrame:
    """``imports`` (module, is_package, imported; leading dots kept) with ``kind`` and ``target``.

    In this order: a relative import finds the longest known prefix of its
    absolute name (else null, with kind null); an absolute one its longest known
    prefix, then the standard library, then the one module that has a prefix of
    it as its suffix, then the top name as a third party.
    """
    from codeloom.functions.text import import_base

    standard = standard_library() if standard is None else standard
    level = F.length(F.regexp_extract("imported", r"^(\.*)", 1))
    plain = F.regexp_replace("imported", r"^\.+", "")
    rows = imports.withColumns({"_level": level, "_name": F.when(level > 0, import_base(F.col("module"), F.col("is_package"), plain, level)).otherwise(plain)})
    known = modules.select(*scope, F.col("module").alias("known")).distinct()
    exact = longest_prefix(rows.where("_name is not null"), known, "_name", scope)
    tails = unique_suffixes(known, "known", scope)
    by_tail = longest_prefix(rows.where("_level = 0"), tails.select(*scope, F.col("suffix").alias("known")), "_name", scope).withColumnRenamed("match", "suffix")
    by_tail = by_tail.join(grows(tails), [*scope, "suffix"]).select(*scope, "_name", "owner")
    top = F.element_at(_parts(F.col("_name")), 1)
    out = rows.join(grows(exact), [*scope, "_name"], "left").join(grows(by_tail), [*scope, "_name"], "left")
    absolute = F.col("_level") == 0
    is_standard = top.isin(standard)
    kind = F.when(F.col("match").isNotNull(), "internal").when(absolute & is_standard, "stdlib").when(absolute & F.col("owner").isNotNull(), "internal").when(absolute, "third_party")
    target = F.when(F.col("match").isNotNull(), F.col("match")).when(absolute & is_standard, top).when(absolute & F.col("owner").isNotNull(), F.col("owner")).when(absolute, top)
    return out.select(*imports.columns, kind.alias("kind"), target.alias("target"))


class Lookup:
    """What dotted names mean in a module, by joins that take each name once.

    The head of a name is the module's own class or function, else what the module
    imports under it: the target itself if it is known, else, unless the target is
    the standard library's, the one known name that ends in it. Each further part
    must be known in turn; the last may also be a method of the class before it,
    which ``through`` names, inherited ones included.
    """

    def __init__(self, definitions: DataFrame, modules: DataFrame, aliases: DataFrame, names: DataFrame, standard: list[str] | None = None):
        """``definitions`` (project, module, name, qualified, what), ``modules`` (project, module), ``aliases`` (project, module, name, target); ``names`` (project, module, name) are all that will be asked."""
        self.standard = [*standard_library(), "_typeshed"] if standard is None else standard
        known = definitions.select("project", "qualified", "what").unionByName(modules.select("project", F.col("module").alias("qualified"), F.lit("module").alias("what")))
        known = known.groupBy("project", "qualified").agg(F.max(F.col("what") == "class").alias("is_class"), F.max(F.col("what").isin("function", "method")).alias("is_function"))
        self.known = kept(known, "known")
        own = definitions.where("not contains(name, '.')").select("project", "module", F.col("name").alias("head"), F.col("qualified").alias("own"), F.lit(None).cast("string").alias("target"))
        bound = aliases.select("project", "module", F.col("name").alias("head"), F.lit(None).cast("string").alias("own"), "target")
        self.found = kept(self._found(names.distinct(), own.unionByName(bound)), "names")

    def _heads(self, scope: DataFrame) -> DataFrame:
        """(project, module, head, base): what the single names of ``scope`` (own, else target) mean; those that mean nothing known are left out."""
        scope = scope.groupBy("project", "module", "head").agg(F.max("own").alias("own"), F.max("target").alias("target"))
        inside, outside = scope.where("own is not null").select("project", "module", "head", F.col("own").alias("base")), scope.where("own is null")
        met = outside.join(self.known.select("project", F.col("qualified").alias("target"), F.lit(True).alias("_is")), ["project", "target"], "left")
        exact = met.where("_is").select("project", "module", "head", F.col("target").alias("base"))
        open_ = grows(met.where(F.col("_is").isNull() & ~F.element_at(_parts(F.col("target")), 1).isin(self.standard)).select("project", "module", "head", F.col("target").alias("suffix")))
        size = F.size(_parts(F.col("qualified")))
        tails = self.known.where(size > 1).select("project", "qualified", F.explode(F.sequence(F.lit(2), size)).alias("k"))
        tails = tails.select("project", "qualified", F.array_join(F.slice(_parts(F.col("qualified")), F.col("k"), size), ".").alias("suffix")).join(open_.select("project", "suffix").distinct(), ["project", "suffix"], "left_semi")
        tails = tails.groupBy("project", "suffix").agg(F.count("*").alias("n"), F.min("qualified").alias("base")).where("n = 1").drop("n")
        return inside.unionByName(exact).unionByName(open_.join(tails, ["project", "suffix"]).drop("suffix"))

    def _found(self, names: DataFrame, scope: DataFrame) -> DataFrame:
        names = names.withColumns({"head": F.substring_index("name", ".", 1), "_n": F.size(_parts(F.col("name")))})
        names = names.join(grows(self._heads(scope)), ["project", "module", "head"]).withColumn("full", F.concat("base", F.expr("substr(name, length(head) + 1)")))
        names = names.withColumns({"up": F.when(F.col("_n") > 1, F.expr("substr(full, 1, length(full) - 1 - length(substring_index(name, '.', -1)))")), "last": F.substring_index("name", ".", -1)})
        # parts between the head and the last but one have to be known as well; few names have any
        deep = names.where("_n > 3").select("project", "module", "name", "base", F.explode(F.sequence(F.lit(1), F.col("_n") - 3)).alias("k"))
        deep = deep.withColumn("qualified", F.concat_ws(".", "base", F.array_join(F.slice(_parts(F.col("name")), F.lit(2), F.col("k")), ".")))
        missing = grows(deep.join(self.known, ["project", "qualified"], "left_anti").select("project", "module", "name").distinct())
        names = names.join(missing, ["project", "module", "name"], "left_anti")
        full = self.known.select("project", F.col("qualified").alias("full"), "is_class", "is_function")
        up = self.known.select("project", F.col("qualified").alias("up"), F.col("is_class").alias("_of_class"))
        names = names.join(full, ["project", "full"], "left").join(up, ["project", "up"], "left")
        # a name of two parts hangs on its head, which is known; of more parts the last but one must be
        met = F.col("is_class").isNotNull() & (F.col("_n").isin(1, 2) | F.col("_of_class").isNotNull())
        return names.select(
            "project", "module", "name", F.when(met, F.col("full")).alias("owner"), F.when(met, F.col("is_class")).alias("is_class"), F.when(met, F.col("is_function")).alias("is_function"),
            F.when(~met & F.col("_of_class"), F.col("up")).alias("through"), "last",
        ).where("owner is not null or through is not null")

    def resolved(self, uses: DataFrame) -> DataFrame:
        """``uses`` (project, module, name, ...) whose names mean something known, with ``owner``, ``is_class``, ``is_function`` or else ``through`` and ``last``."""
        return uses.join(self.found, ["project", "module", "name"])
