"""What a section of documentation should see first: candidates in order, under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.text import import_base, is_main_class, is_test_name

from .budget import greedy_fill
from .facts import of_kind
from .names import place_imports
from .store import grows

CANDIDATES, SHARE = 200, 0.6


def documents(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(project, source, ord, text): each file and each of its top-level entities as a document of labelled lines."""
    whole = files.select("project", F.col("module").alias("source"), F.lit(-1).alias("ord"), F.concat_ws("\n", F.concat(F.lit("File: "), "module"), "content").alias("text"))
    methods = of_kind(rows, "method").groupBy("project", "module", F.col("owner").alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("name").alias("m")))), lambda x: x["m"]), ", ").alias("methods"))
    entities = of_kind(rows, "entity").join(methods, ["project", "module", "name"], "left")
    text = F.concat_ws(
        "\n",
        F.concat(F.initcap("flags"), F.lit(": "), "name"),
        F.concat(F.lit("File: "), "module"),
        F.concat(F.lit("Lines: "), F.col("line").cast("string"), F.lit("-"), F.col("end_line").cast("string")),
        F.concat(F.lit("Base: "), "owner"),
        F.concat(F.lit("Methods: "), "methods"),
        F.when(F.col("value") != "", F.concat(F.lit("Docstring: "), "value")),
    )
    return whole.unionByName(entities.select("project", F.col("module").alias("source"), "ord", text.alias("text")))


def top_packages(files: DataFrame) -> DataFrame:
    """Packages of the least depth in each project."""
    depth = F.size(F.split("module", r"\."))
    w = Window.partitionBy("project")
    found = files.where("is_package").withColumn("depth", depth)
    return found.withColumn("least", F.min("depth").over(w)).where("depth = least").drop("depth", "least")


def exports(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(project, name, at): absolute names that top packages import from their own project, test code aside; at: package and place of the first mention."""
    found = of_kind(rows, "import").join(top_packages(files.where(~is_test_name(F.col("module")))).select("project", "module"), ["project", "module"], "left_semi")
    placed = place_imports(found.select("project", "module", "is_package", F.col("name").alias("imported"), "ord"), files.select("project", "module"), ("project",))
    level, plain = F.length(F.regexp_extract("imported", r"^(\.*)", 1)), F.regexp_replace("imported", r"^\.+", "")
    name = F.when(level > 0, import_base(F.col("module"), F.col("is_package"), plain, level)).otherwise(plain)
    return placed.where("kind = 'internal'").groupBy("project", name.alias("name")).agg(F.min(F.struct("module", "ord")).alias("at"))


def api_map(exported: DataFrame) -> DataFrame:
    """(project, text): what the package exports (``exports``), a line for each module that defines some of it."""
    some = exported.where(F.contains("name", F.lit("."))).withColumns({"home": F.regexp_replace("name", r"\.[^.]+$", ""), "short": F.substring_index("name", ".", -1)})
    lines = some.groupBy("project", "home").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "short"))).alias("_names"))
    lines = lines.select("project", "at", F.concat("home", F.lit(": "), F.array_join(F.transform("_names", lambda x: x["short"]), ", ")).alias("line"))
    return _titled(lines, "Names the package exports, by the module that defines them:")


def third_party(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(project, module, names): third-party imports of each module as they are written, first mention first."""
    asked = of_kind(rows, "import").select("project", "module", "is_package", F.col("name").alias("imported"), "ord")
    placed = place_imports(asked, files.select("project", "module"), ("project",)).where("kind = 'third_party'")
    first = placed.groupBy("project", "module", "imported").agg(F.min("ord").alias("ord"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "imported")))
    return first.groupBy("project", "module").agg(F.array_join(F.transform(ordered, lambda x: x["imported"]), ", ").alias("names"))


def third_party_map(rows: DataFrame, files: DataFrame, budget: int) -> DataFrame:
    """(project, text): ``third_party``, test code aside, cut after the last whole line within ``budget``."""
    lines = third_party(rows.where(~is_test_name(F.col("module"))), files).select("project", F.col("module").alias("at"), F.concat("module", F.lit(": "), "names").alias("line"))
    whole = _titled(lines, "Third-party imports, by module:")
    return whole.select("project", F.when(F.length("text") <= budget, F.col("text")).otherwise(F.regexp_replace(F.substring("text", 1, budget), r"\n[^\n]*$", "")).alias("text"))


def _titled(lines: DataFrame, title: str) -> DataFrame:
    """(project, text): ``lines`` (project, at, line) in order under a title."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "line")))
    return lines.groupBy("project").agg(F.concat_ws("\n", F.lit(title), F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("text"))


def most_used_classes(edges: DataFrame, classes: DataFrame, k: int = 10) -> DataFrame:
    """(project, cls, users): classes by how many callers outside them call the class or its methods, ties by name."""
    own = classes.select("project", F.col("qualified").alias("cls"))
    holder = F.explode(F.array_distinct(F.array("callee", F.regexp_replace("callee", r"\.[^.]+$", ""))))
    used = edges.where("is_internal").withColumn("cls", holder).join(grows(own), ["project", "cls"])
    outside = used.where(~F.col("caller").startswith(F.concat("cls", F.lit("."))))
    counts = outside.groupBy("project", "cls").agg(F.count_distinct("caller").alias("users"))
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("users"), "cls"))
    return counts.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def key_classes(firsts: DataFrame, order: DataFrame) -> DataFrame:
    """(project, ord, cls): ``firsts`` (project, ord, cls), each followed by its bases along ``order`` (lineage), first mention only."""
    every = firsts.join(grows(order.select("project", "cls", F.col("ord").alias("k"), "base")), ["project", "cls"])
    place = every.groupBy("project", "base").agg(F.min(F.struct("ord", "k")).alias("at"))
    w = Window.partitionBy("project").orderBy("at", "base")
    return place.select("project", F.row_number().over(w).alias("ord"), F.col("base").alias("cls"))


def main_classes(classes: DataFrame) -> DataFrame:
    """Classes (name, bases) that are neither private nor errors."""
    return classes.where(is_main_class(F.col("name"), F.col("bases")))


def section_context(candidates: DataFrame, chunks: int = 10, chunk_size: int = 2000) -> DataFrame:
    """(project, taken): candidates (project, ord, name, text) in order while they fit the structural share; ones met before or empty are skipped."""
    first = candidates.groupBy("project", "text").agg(F.min("ord").alias("ord"))
    sized = first.withColumn("size", F.length("text"))
    return greedy_fill(sized, "project", "ord", "text", "size", int(SHARE * chunks * chunk_size), CANDIDATES)


def prompt(title, task, sections) -> F.Column:
    """The parts of a prompt in order, parted by blank lines."""
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), task, F.array_join(F.transform(sections, lambda s: F.concat(F.lit("- "), s)), "\n"))


def failures(results: DataFrame) -> DataFrame:
    """(kind, failed, total, verdict) of ``results`` (kind, ok, required): an error if all of a required kind failed, a warning if some did."""
    n = results.groupBy("kind").agg(F.count_if(~F.col("ok")).alias("failed"), F.count("*").alias("total"), F.bool_or("required").alias("required"))
    verdict = F.when((F.col("failed") == F.col("total")) & F.col("required"), "error").when(F.col("failed") > 0, "warning").otherwise("ok")
    return n.select("kind", "failed", "total", verdict.alias("verdict"))
