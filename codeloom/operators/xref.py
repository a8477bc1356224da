"""Cross-references between components and the files that import them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def registry(components: DataFrame) -> DataFrame:
    """(name, type, defined_in, ord): the first of ``components`` (name, type, defined_in, ord) of each name."""
    first = F.min(F.struct("ord", "defined_in", "type")).alias("first")
    return components.groupBy("name").agg(first).select("name", "first.type", "first.defined_in", "first.ord")


def import_keys(imports: DataFrame) -> DataFrame:
    """(file, key): the base part, the last part and the whole of each of ``imports`` (file, imported)."""
    parts = F.split("imported", r"\.")
    keys = F.array_distinct(F.array(F.element_at(parts, 1), F.element_at(parts, -1), F.col("imported")))
    return imports.select("file", F.explode(keys).alias("key")).where("key <> ''").distinct()


def importers(components: DataFrame, imports: DataFrame) -> DataFrame:
    """``components`` (name, defined_in, ...) with ``n_importers``, the distinct files that import each."""
    used = import_keys(imports).join(components.select(F.col("name").alias("key"), "defined_in"), "key").where("file <> defined_in")
    counts = used.groupBy(F.col("key").alias("name")).agg(F.count_distinct("file").alias("n_importers"))
    return components.join(counts, "name", "left").fillna({"n_importers": 0})


def top_components(counted: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` components of highest importance (twice the importers), in order of registration where equal."""
    return counted.withColumn("importance", 2 * F.col("n_importers")).orderBy(F.desc("importance"), "ord").limit(k)


def file_imports(components: DataFrame, imports: DataFrame) -> DataFrame:
    """(file, targets): the sorted files that define what each file imports; files without any keep an empty list."""
    used = import_keys(imports).join(components.select(F.col("name").alias("key"), "defined_in"), "key").where("file <> defined_in")
    found = used.groupBy("file").agg(F.array_sort(F.collect_set("defined_in")).alias("targets"))
    return imports.select("file").distinct().join(found, "file", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))


def first_in_group(rows: DataFrame, group: str, order: str, k: int = 10) -> DataFrame:
    """The first ``k`` rows of each group with their number, and ``more``: how many are left out."""
    w = Window.partitionBy(group)
    out = rows.withColumns({"number": F.row_number().over(w.orderBy(order)), "more": F.greatest(F.count("*").over(w) - k, F.lit(0))})
    return out.where(F.col("number") <= k)


def ordered_join(rows: DataFrame, group: str, order: str, value: str, separator: str = ", ") -> DataFrame:
    """(``group``, joined): the values of each group in order, as one string."""
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x[value]), separator).alias("joined"))


def neighbours(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``rows`` with ``previous`` and ``next`` of ``value`` in order."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumns({"previous": F.lag(value).over(w), "next": F.lead(value).over(w)})


def find(components: DataFrame, name: str | None = None, kind: str | None = None) -> DataFrame:
    """The rows of ``registry`` of a name, of a type, or of both."""
    return components.where(F.lit(True) if name is None else F.col("name") == name).where(F.lit(True) if kind is None else F.col("type") == kind)


def package_of(name, is_package):
    """The package that a module belongs to: itself if it is one, or stands in none."""
    return F.when(is_package, name).otherwise(F.regexp_replace(name, r"\.[^.]+$", ""))


def package_edges(placed: DataFrame, files: DataFrame) -> DataFrame:
    """(project, src, dst, kind): which packages import which packages or third parties, by ``placed`` imports (``names.place_imports``) of ``files``; none itself."""
    homes = files.select("project", F.col("module").alias("target"), package_of(F.col("module"), F.col("is_package")).alias("_home"))
    met = placed.where("kind in ('internal', 'third_party')").join(homes, ["project", "target"], "left")
    dst = F.when(F.col("kind") == "internal", F.col("_home")).otherwise(F.col("target"))
    edges = met.select("project", package_of(F.col("module"), F.col("is_package")).alias("src"), dst.alias("dst"), "kind")
    return edges.where("src <> dst").distinct()
