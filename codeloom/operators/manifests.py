"""Dependency manifests: the nearest ones, and the lines of their dependency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.text import is_dependency_table

from .budget import cut_at_line


def lines(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line_no, line) of each text."""
    return rows.select(*keys, F.posexplode(F.split(F.col(text), "\r\n|\r|\n")).alias("line_no", "line"))


def scoped_lines(rows: DataFrame, keys: list[str], header: str = r"^\s*\[{1,2}\s*([\w\s.\-\"']+?)\s*\]{1,2}\s*(#.*)?$") -> DataFrame:
    """``rows`` (keys, line_no, line) with ``table``, the last header at or before each line; lines before the first are dropped. An array that stands on a line of its own is no header."""
    found = F.when(F.col("line").rlike(header), F.regexp_replace(F.regexp_extract("line", header, 1), "[\\s\"']", ""))
    w = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("table", F.last_value(found, ignoreNulls=True).over(w)).where("table is not null")


def dependency_lines(rows: DataFrame, file: str = "file") -> DataFrame:
    """Lines of tables that declare dependencies; requirements files whole."""
    whole = rows.where(F.col(file).rlike(r"^requirements.*\.txt$")).withColumn("table", F.lit(""))
    tables = scoped_lines(rows.where(F.col(file).isin("pyproject.toml", "setup.cfg")), [file])
    return tables.where(is_dependency_table(F.col(file), F.col("table"))).unionByName(whole)


# Files that declare dependencies.
TABLE_FILES, REQUIREMENTS = ("pyproject.toml", "setup.cfg"), "requirements*.txt"


def read_manifests(spark, folder: str) -> DataFrame:
    """(name, nth, text) of the manifests in ``folder`` itself, in order: of files of tables only those that declare dependencies, without blank ends; files without any are left out.

    Bytes that are no UTF-8 are replaced; links that lead out of the folder are skipped.
    """
    from codeloom.sources.code_tree import tree

    files = tree(spark, folder, names=",".join((*TABLE_FILES, REQUIREMENTS)), flat="true", errors="replace").where("error is null")
    rows = lines(files.select(F.col("path").alias("file"), "content"), ["file"], "content")
    kept = dependency_lines(rows).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_lines"))
    text = F.regexp_replace(F.array_join(F.transform("_lines", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    place = F.coalesce(F.array_position(F.array(*map(F.lit, TABLE_FILES)), F.col("file")).cast("int"), F.lit(0))
    order = F.struct(F.when(place > 0, place).otherwise(len(TABLE_FILES) + 1), "file")
    found = kept.select(F.col("file").alias("name"), text.alias("text"), order.alias("_o")).where("text <> ''")
    return found.select("name", F.row_number().over(Window.orderBy("_o")).alias("nth"), "text")  # a folder's few files


def with_manifests(prompts: DataFrame, manifests: DataFrame, budget: int) -> DataFrame:
    """``prompts`` (project, section, prompt) followed by the project's ``manifests`` (project, nth, name, text) in fences.

    They share ``budget`` characters: the one that crosses it is cut after a whole
    line, those after it are left out. A prompt without manifests stays as it is.
    """
    size = F.length("text")
    before = F.coalesce(F.sum(size).over(Window.partitionBy("project").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = manifests.withColumn("_left", F.lit(budget) - before).where("_left >= 0")
    language = F.when(F.col("name").endswith(".toml"), "toml").when(F.col("name").endswith(".cfg"), "ini").otherwise("text")
    fence = F.concat(F.lit("### "), "name", F.lit("\n\n```"), language, F.lit("\n"), cut_at_line(F.col("text"), F.col("_left")), F.lit("\n```"))
    parts = some.select("project", F.struct("nth", fence.alias("t")).alias("f")).groupBy("project").agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["t"]), "\n\n").alias("_m"))
    intro = F.lit("## Dependency Manifests\n\nNames, extras and versions of dependencies are declared here; of files of tables only those that declare some are shown.")
    return prompts.join(parts, "project", "left").select("project", "section", F.when(F.col("_m").isNull(), F.col("prompt")).otherwise(F.concat_ws("\n\n", "prompt", intro, "_m")).alias("prompt"))


def nearest(folders: DataFrame, manifests: DataFrame, stops: DataFrame) -> DataFrame:
    """(folder, found): the deepest folder at or above each that holds a manifest, not above the first that holds a stop mark.

    ``folders`` (folder), ``manifests`` and ``stops`` (folder): absolute paths.
    """
    parts = F.split("folder", "/")
    up = folders.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    stop = up.join(stops.select(F.col("folder").alias("above")), "above", "left_semi").groupBy("folder").agg(F.max("depth").alias("stop"))
    held = up.join(manifests.select(F.col("folder").alias("above")).distinct(), "above", "left_semi").join(stop, "folder", "left")
    return held.where("stop is null or depth >= stop").groupBy("folder").agg(F.max_by("above", "depth").alias("found"))


def roots(folders: DataFrame, packages: DataFrame) -> DataFrame:
    """(folder, root): where module names start, the nearest folder at or above each of ``folders`` (folder) that is none of ``packages`` (folder, holding an ``__init__.py``)."""
    parts = F.split("folder", "/")
    up = folders.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("above", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    free = up.join(packages.select(F.col("folder").alias("above")).distinct(), "above", "left_anti")
    return free.groupBy("folder").agg(F.max_by("above", "depth").alias("root"))


def project_name(folder) -> F.Column:
    """The last part of an absolute path, or the one before it where that is a layout folder."""
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    last, before = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    # fixed values: folders that hold code and don't name it
    return F.coalesce(F.when(last.isin("src", "lib"), before), last, F.lit("/"))
