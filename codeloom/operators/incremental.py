"""Incremental upkeep: what changed, what stays valid, what to reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored, work_path
from .versions import Conflict, Store

__all__ = ["Conflict", "Store", "cache_stats", "classify", "invalidate", "keep_and_append", "missing", "ordered_hash", "project_key", "reusable", "part_digests", "run_sections", "section_hashes", "suspects", "update_index", "work_path"]
FRESH_SECONDS = 2.0


def suspects(current: DataFrame, known: DataFrame, hash_only: bool = False) -> DataFrame:
    """``current`` (path, mtime, size) that a look at time and size can't call unchanged, or all if ``hash_only``: their contents must be hashed."""
    if hash_only:
        return current
    k = known.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.col("last_analyzed").alias("_a"))
    same = (F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s")) & (F.col("_a") - F.col("mtime") > FRESH_SECONDS)
    return current.join(k, "path", "left").where(~F.coalesce(same, F.lit(False))).select(*current.columns)


def classify(current: DataFrame, known: DataFrame, key: str = "path", value: str = "content_hash") -> DataFrame:
    """(key, status): new, deleted, changed or unchanged, by a full outer join."""
    a = current.select(key, F.col(value).alias("_now"), F.lit(True).alias("_a"))
    b = known.select(key, F.col(value).alias("_then"), F.lit(True).alias("_b"))
    status = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "deleted").when(~F.col("_now").eqNullSafe(F.col("_then")), "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def keep_and_append(stored: DataFrame, fresh: DataFrame, statuses: DataFrame, key: str = "path") -> DataFrame:
    """Rows of ``stored`` whose owner is unchanged, and rows of ``fresh`` whose owner is new or changed."""
    keep = statuses.where("status = 'unchanged'").select(key)
    add = statuses.where("status in ('new', 'changed')").select(key)
    return stored.join(keep, key, "left_semi").unionByName(fresh.join(add, key, "left_semi"))


def ordered_hash(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(``group``, hash): SHA-256 over the group's values in order, each after its order key."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(value), F.lit("")).alias("v"))))
    text = F.array_join(F.transform(parts, lambda x: F.concat(x["o"].cast("string"), F.lit("\u0000"), x["v"], F.lit("\u0000"))), "")
    return rows.groupBy(group).agg(F.sha2(text.cast("binary"), 256).alias("hash"))


def part_digests(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(project, path, part, digest) of ``files`` (project, module, content) by what a section may depend on: ``all`` its content, ``imports``, or ``entities`` (name, kind and docstring of each, by name), from ``rows`` (facts)."""
    path = F.col("module").alias("path")
    digest = lambda v: F.sha2(v.cast("binary"), 256).alias("digest")
    lines = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "\n")
    whole = files.select("project", path, F.lit("all").alias("part"), digest(F.col("content")))
    some = rows.groupBy("project", "module").agg(
        lines(F.when(F.col("kind") == "import", F.col("name"))).alias("imports"),
        lines(F.when(F.col("kind") == "entity", F.concat_ws("\u0000", "name", "flags", "value"))).alias("entities"),
    )
    some = files.select("project", "module").join(some, ["project", "module"], "left")
    parts = [some.select("project", path, F.lit(p).alias("part"), digest(F.coalesce(p, F.lit("")))) for p in ("imports", "entities")]
    return whole.unionByName(parts[0]).unionByName(parts[1])


def section_hashes(sections: DataFrame, parts: DataFrame) -> DataFrame:
    """(project, section, key_hash): ``sections`` (project, section, part, model, prompt, settings) with a hash of all that their text depends on.

    The key changes with the model, the prompt sent, the other settings, a file
    that comes or goes, or a file's ``part`` (``part_digests``). Digests of files
    are combined in two levels, 256 groups by path, so no row gathers a project.
    """
    list_ = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))), lambda x: F.concat_ws("\u0000", x["k"], x["v"])), "\n")
    grouped = parts.withColumn("_g", F.substring(F.md5(F.col("path").cast("binary")), 1, 2)).groupBy("project", "part", "_g").agg(F.sha2(list_("path", "digest").cast("binary"), 256).alias("_d"))
    whole = grouped.groupBy("project", "part").agg(list_("_g", "_d").alias("_files"))
    met = sections.join(whole, ["project", "part"], "left")
    text = F.concat_ws("\u0000", "model", "prompt", "settings", F.coalesce("_files", F.lit("")))
    return met.select("project", "section", F.sha2(text.cast("binary"), 256).alias("key_hash"))


def reusable(sections: DataFrame, cache: DataFrame) -> DataFrame:
    """``sections`` (section, key_hash) whose cached content is still valid."""
    return sections.join(cache.select("section", "key_hash"), ["section", "key_hash"], "left_semi")


def missing(sections: DataFrame, cache: DataFrame) -> DataFrame:
    return sections.join(cache.select("section", "key_hash"), ["section", "key_hash"], "left_anti")


def invalidate(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """``cache`` (section, depends_on array) without entries that depend on a changed path."""
    hit = cache.select("section", F.explode("depends_on").alias("path")).join(changed.select("path"), "path", "left_semi").select("section").distinct()
    return cache.join(hit, "section", "left_anti")


def project_key(path):
    return F.substring(F.sha2(path.cast("binary"), 256), 1, 16)


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))


def update_index(states: Store, chunks: Store, current: DataFrame, fresh, refresh: bool = False) -> DataFrame:
    """Bring ``chunks`` up to date with ``current`` (path, content_hash) and give (path, status).

    ``fresh`` makes chunks (path, ...) of the paths it is given. Without a table
    that can be read, or to ``refresh``, all are made anew; if nothing changed,
    nothing is written. If another writer is faster ``Conflict`` is raised, and
    states never tell of chunks that aren't there: they are written last.
    """
    at = [max(s.versions(), default=0) for s in (states, chunks)]
    known, held = (None, None) if refresh else (states.read(), chunks.read())
    if known is None or held is None:
        statuses = current.select("path", F.lit("new").alias("status"))
        chunks.write(fresh(current), at[1])
    else:
        statuses = classify(current, known)
        if statuses.where("status <> 'unchanged'").isEmpty():
            return statuses
        due = current.join(statuses.where("status in ('new', 'changed')").select("path"), "path", "left_semi")
        chunks.write(keep_and_append(held, fresh(due), statuses), at[1])
    states.write(current, at[0])
    return statuses


def run_sections(cache: Store, sections: DataFrame, generate, refresh: bool = False) -> DataFrame:
    """(section, key_hash, content, cached) of ``sections`` (section, key_hash): cached content while its key is valid, else what ``generate`` gives (section, key_hash, content, truncated).

    Content that was cut off is not cached; to ``refresh`` reads no cache but fills it.
    """
    held = cache.read()
    old = None if held is None or refresh else held.join(sections.select("section", "key_hash"), ["section", "key_hash"], "left_semi")
    due = sections if old is None else missing(sections, old)
    made = stored(generate(due), "made")  # a model is asked once; what is cached is what is returned
    whole = made.where("not truncated").select("section", "key_hash", "content")
    kept = whole if held is None else held.join(whole.select("section"), "section", "left_anti").select("section", "key_hash", "content").unionByName(whole)
    cache.write(kept)
    out = made.select("section", "key_hash", "content", F.lit(False).alias("cached"))
    return out if old is None else out.unionByName(old.select("section", "key_hash", "content", F.lit(True).alias("cached")))
