"""Which excerpts of a project each section of its documentation should see, in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.text import import_base, is_test_name

from . import graph, structure
from .budget import greedy_fill
from .facts import of_kind
from .sequence import participant
from .store import grows, kept

PATH_HEAD = 2


def class_named(uses: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """``uses`` (project, module, name, ...) with ``cls``: the module's own class of that bare name, else the first of its imports that ends in it and is a class (of ``classes``: project, cls); null if none."""
    imports = of_kind(rows, "import").select("project", "module", "ord", "is_package", F.col("name").alias("imported"))
    level, plain = F.length(F.regexp_extract("imported", r"^(\.*)", 1)), F.regexp_replace("imported", r"^\.+", "")
    full = F.when(level > 0, import_base(F.col("module"), F.col("is_package"), plain, level)).otherwise(plain)
    brought = imports.withColumn("cls", full).join(classes.select("project", "cls").distinct(), ["project", "cls"], "left_semi")
    brought = brought.groupBy("project", "module", F.element_at(F.split("cls", r"\."), -1).alias("name")).agg(F.min_by("cls", "ord").alias("_brought"))
    own = classes.select("project", F.col("cls").alias("_own")).distinct()
    found = uses.withColumn("_own", F.concat_ws(".", "module", "name")).join(own.withColumn("_is", F.lit(True)), ["project", "_own"], "left")
    found = found.join(grows(brought), ["project", "module", "name"], "left")
    return found.select(*uses.columns, F.when(F.col("_is"), F.col("_own")).otherwise(F.col("_brought")).alias("cls"))


def main_classes(defined: DataFrame, rows: DataFrame) -> DataFrame:
    """(project, cls, module, name) of the classes that are neither private nor errors."""
    bases = of_kind(rows, "base").groupBy("project", "module", F.col("owner").alias("name")).agg(F.collect_list(F.col("name")).alias("bases"))
    some = defined.where("what = 'class'").select("project", F.col("qualified").alias("cls"), "module", "name").join(bases, ["project", "module", "name"], "left")
    return structure.main_classes(some.withColumn("bases", F.coalesce("bases", F.array().cast("array<string>")))).drop("bases")


def entry_path(edges: DataFrame, defined: DataFrame) -> DataFrame:
    """(project, ord, node): the entry point and the functions that it runs, best first, without tests."""
    runs = defined.where("what <> 'class'").select("project", F.col("qualified").alias("dst"))
    every = edges.select("project", F.col("ord").cast("long").alias("ord"), F.col("caller").alias("src"), F.col("callee").alias("dst")).join(runs, ["project", "dst"], "left_semi")
    every = kept(every.groupBy("project", "src", "dst").agg(F.min("ord").alias("ord")), "reached")
    reached = kept(graph.reach(every), "reach")
    return graph.best_first(every.where(~is_test_name(F.col("dst"))), reached, graph.entry_points(every, reached, is_test_name))


def key_classes(path: DataFrame, exported: DataFrame, used: DataFrame, main: DataFrame, order: DataFrame) -> DataFrame:
    """(project, ord, cls): classes that are ``exported`` (project, ord, cls), in projects without any the most ``used`` (project, cls, users), then main ones that hold functions of ``path``; each followed by its bases, first mention only."""
    keys, shown = main.select("project", "cls"), exported
    ranked = used.join(grows(shown.select("project").distinct()), "project", "left_anti")
    ranked = ranked.withColumn("ord", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("users"), "cls")))
    held = path.withColumn("cls", participant(F.col("node"))).join(keys, ["project", "cls"], "left_semi")
    place = lambda some, side: some.select("project", F.struct(F.lit(side).alias("side"), F.col("ord").cast("long").alias("at")).alias("ord"), "cls")
    firsts = place(shown, 0).unionByName(place(ranked, 0)).unionByName(place(held, 1))
    return structure.key_classes(firsts.groupBy("project", "cls").agg(F.min("ord").alias("ord")), order)


def component_classes(keys: DataFrame, defined: DataFrame, rows: DataFrame, order: DataFrame) -> DataFrame:
    """(project, ord, cls): classes that class attributes of ``keys`` (key_classes) are set to, or to instances of, each followed by its bases."""
    classes = defined.where("what = 'class'").select("project", F.col("qualified").alias("cls"))
    held = of_kind(rows, "component").select("project", "module", F.concat_ws(".", "module", "owner").alias("holder"), F.col("ord").alias("k"), "name")
    uses = held.join(keys.select("project", F.col("cls").alias("holder"), F.col("ord").alias("at")), ["project", "holder"])
    found = class_named(uses, classes, rows).where("cls is not null")
    return structure.key_classes(found.groupBy("project", "cls").agg(F.min(F.struct("at", "k")).alias("ord")), order)


def share(chunks: int = 10, chunk_size: int = 2000) -> int:
    """Most characters of excerpts for a section that is also given so many chunks."""
    return int(structure.SHARE * chunks * chunk_size)


def candidates(rows: DataFrame, files: DataFrame, edges: DataFrame, defined: DataFrame, order: DataFrame, limit: int | None = None) -> DataFrame:
    """(project, section, ord, name, text): all that a section could be given, in order of priority.

    The overview sees the map of exports, the head of the entry path (its first
    functions that have a source) and the key classes; data flow the whole path;
    integration points the map, the path's head, the components of key classes and
    what reads the environment. Test code gives nothing.
    """
    limit = share() if limit is None else limit
    full = F.concat_ws(".", "module", "name")
    tested = ~is_test_name(F.col("module"))
    every, rows, defined = defined, rows.where(tested), defined.where(tested)
    texts = rows.where("kind in ('outline', 'excerpt')").select("project", "kind", full.alias("name"), F.col("value").alias("text"), F.coalesce(F.col("flags") == "env", F.lit(False)).alias("env"))
    path = kept(entry_path(edges, every), "path")
    classes = defined.where("what = 'class'").select("project", F.col("qualified").alias("cls"))
    shown = structure.exports(rows, files)
    nth = F.row_number().over(Window.partitionBy("project").orderBy("at"))
    exported = shown.withColumnRenamed("name", "cls").join(classes, ["project", "cls"], "left_semi").select("project", "cls", nth.alias("ord"))
    main = kept(main_classes(defined, rows), "main")
    used = structure.most_used_classes(edges, main.withColumnRenamed("cls", "qualified"))
    keys = key_classes(path, exported, used, main, order).join(classes, ["project", "cls"], "left_semi")
    keys = kept(keys, "keys")
    parts = component_classes(keys, defined, rows, order)

    def of_text(chosen: DataFrame, kind: str) -> DataFrame:
        return chosen.join(texts.where(F.col("kind") == kind), ["project", "name"]).select("project", "at", "name", "text")

    def of_map(found: DataFrame, name: str) -> DataFrame:
        return found.select("project", F.lit(0).cast("long").alias("at"), F.lit(name).alias("name"), "text")

    at = F.col("ord").cast("long").alias("at")
    functions = of_text(path.select("project", at, F.col("node").alias("name")), "excerpt")
    outlines = lambda some: of_text(some.select("project", at, F.col("cls").alias("name")), "outline")
    ranked = functions.withColumn("_nth", F.row_number().over(Window.partitionBy("project").orderBy("at")))
    head, mapped = ranked.where(F.col("_nth") <= PATH_HEAD).drop("_nth"), of_map(structure.api_map(shown), "api")
    reads = texts.where("env and kind = 'excerpt'").select("project", F.lit(0).cast("long").alias("at"), "name", "text")
    sections = {
        "overview": [mapped, head, outlines(keys)],
        "dependencies": [of_map(structure.third_party_map(rows, files, limit), "imports")],
        "key classes and functions": [outlines(keys)],
        "data flow": [functions],
        "integration points": [mapped, head, outlines(parts), reads],
    }
    out = [some.select("project", F.lit(section).alias("section"), F.struct(F.lit(k).alias("part"), "at", "name").alias("ord"), "name", "text") for section, those in sections.items() for k, some in enumerate(those)]
    return reduce(DataFrame.unionByName, out)


def contexts(found: DataFrame, chunks: int = 10, chunk_size: int = 2000) -> DataFrame:
    """(project, section, taken): names of ``candidates`` in order while their texts fit the structural share; ones met before or empty are skipped."""
    first = found.groupBy("project", "section", "name").agg(F.min(F.struct("ord", "text")).alias("f"))
    sized = kept(first.select(F.struct("project", "section").alias("of"), "name", F.col("f.ord").alias("ord"), F.length("f.text").alias("size")), "sized")  # read twice
    filled = greedy_fill(sized, "of", "ord", "name", "size", share(chunks, chunk_size), structure.CANDIDATES)
    return filled.select("of.project", "of.section", "taken")


def select_sections(asked: DataFrame, sections: list[str]) -> DataFrame:
    """(request, name, ord, section): the ``sections``, a documentation's own short list, that each wish of ``asked`` (request, name) means; section null if it means none.

    A wish is part of a section's name in lower case, or of it without spaces,
    hyphens, underscores and the word "and" between others. Blank wishes are left out.
    """
    low = F.lower(F.trim("name"))
    wishes = asked.where(F.trim("name") != "").withColumns({"_low": low, "_bare": F.regexp_replace(low, "[_-]", "")})
    titles = [(k, t, t.lower(), t.lower().replace(" ", "_").replace("_and_", "_").replace("_", "").replace("-", "")) for k, t in enumerate(sections, 1)]
    every = F.array(*[F.struct(*(F.lit(v).alias(n) for n, v in zip(("ord", "section", "title", "plain"), t))) for t in titles])
    meant = F.filter(every, lambda s: F.contains(s["title"], F.col("_low")) | F.contains(s["plain"], F.col("_bare")))
    return wishes.select("request", "name", F.explode_outer(meant).alias("s")).select("request", "name", "s.ord", "s.section")


def with_references(prompts: DataFrame, reports: DataFrame) -> DataFrame:
    """``prompts`` (project, section, prompt), those about references followed by the project's cross-reference report of ``reports`` (project, report)."""
    about = F.lower("prompt").rlike("reference|cross") & F.col("report").isNotNull()
    text = F.when(about, F.concat_ws("\n\n", "prompt", F.lit("## Cross-references found in the code"), "report")).otherwise(F.col("prompt"))
    return prompts.join(reports, "project", "left").select("project", "section", text.alias("prompt"))
