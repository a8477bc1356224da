"""Scalar text functions as column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a diagram reads as keywords where an identifier goes.
RESERVED_WORDS = (
    "call class classdef end flowchart graph href linkstyle style subgraph "
    "callback click cssclass link namespace note "
    "activate actor alt and autonumber box break create critical deactivate destroy details else "
    "links loop opt over par participant properties rect title"
).split()

# Error classes, tried in this order, as whole words of the message.
ERROR_CLASSES = [
    ("quota", r"quota|billing"),
    ("rate_limit", r"rate limit(?:s|ed)?|too many requests|429"),
    ("auth", r"api key|authentication|unauthorized|401"),
    ("timeout", r"timeout|timed out"),
    ("connection", r"connection"),
    ("context_length", r"context length|maximum context|max(?:imum)? length|too long"),
    ("overloaded", r"overloaded|529"),
    ("not_found", r"not found|404"),
]

# Phrases by which prose talks about its own source excerpts.
REMARKS = [
    r"\bthe code (?:shown|shows|provided)\b",
    r"\bcode (?:is|are) shown\b",
    r"\bvisible in (?:the|this) (?:code|context|excerpts?)\b(?! block| example)",
    r"\b(?:the|these) (?:code )?excerpts?\b",
    r"\bthe (?:provided|given|retrieved) (?:code|context)\b",
    r"\b(?:the|this) context (?:shows?|shown|does not show)\b",
    r"\bnot shown\b",
]


def clean_identifier(name) -> Column:
    """A name as an identifier: cut at the first bracket, other signs to single
    underscores, none at the ends, ``n`` before a digit, ``_node`` after a
    reserved word, ``node`` for nothing."""
    c = F.regexp_replace(name, r"(?s)[\[(].*$", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)\W", "_"), "_+", "_")
    c = F.regexp_replace(c, "^_|_$", "")
    c = F.when(c.rlike(r"^(?U)\d"), F.concat(F.lit("n"), c)).otherwise(c)
    c = F.when(F.lower(c).isin(RESERVED_WORDS), F.concat(c, F.lit("_node"))).otherwise(c)
    return F.when(c == "", F.lit("node")).otherwise(c)


def quoted_label(text) -> Column:
    return F.translate(text, '"', "'")


def section_key(name) -> Column:
    """Lower case, hyphens and blanks to underscores, ``_and_`` to one underscore."""
    return F.replace(F.translate(F.lower(name), "- ", "__"), F.lit("_and_"), F.lit("_"))


def error_class(message) -> Column:
    """The first class whose pattern the message holds as whole words; null if none."""
    text = F.translate(F.lower(message), "_-", "  ")
    out = F.lit(None).cast("string")
    for name, pattern in reversed(ERROR_CLASSES):
        out = F.when(text.rlike(rf"\b(?:{pattern})\b"), F.lit(name)).otherwise(out)
    return out


def error_description(own, provider_summary, kind, message) -> Column:
    """The own message, else the provider's summary before the message, else type and message."""
    return F.coalesce(own, F.concat_ws(": ", F.coalesce(provider_summary, kind), message))


def remarks(text) -> Column:
    """Phrases about excerpts in order of first appearance, each once whatever its case."""
    found = F.regexp_extract_all(text, F.lit("(?i)" + "|".join(REMARKS)), F.lit(0))
    lowered = F.transform(found, F.lower)
    return F.filter(found, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def first_paragraph(text) -> Column:
    return F.element_at(F.split(F.trim(text), "\n\n", 2), 1)


def token_estimate(text) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def module_name(path) -> Column:
    """Dotted name of a path relative to the project's root; a package for its ``__init__``."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "(^|/)__init__$", "")
    return F.translate(F.regexp_replace(bare, "^/|/$", ""), "/", ".")


def import_base(module, is_package, imported, level) -> Column:
    """Absolute name of a relative import, null if it climbs out of the project."""
    parts = F.split(module, r"\.")
    up = level - F.when(is_package, F.lit(1)).otherwise(F.lit(0))
    keep = F.size(parts) - up
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0))), ".")
    return F.when(keep < 0, None).otherwise(F.concat_ws(".", F.when(base != "", base), F.when(imported != "", imported)))


def glob_pattern(pattern: str) -> str:
    """A shell pattern as a regular expression (``*`` crosses ``/``)."""
    import fnmatch

    return fnmatch.translate(pattern)


def is_test_name(dotted) -> Column:
    """Whether any dotted part is conftest, test or tests, or begins with ``test_``."""
    return F.exists(F.split(dotted, r"\."), lambda p: p.isin("conftest", "test", "tests") | p.startswith("test_"))


def is_main_class(name, bases) -> Column:
    """Neither private nor an error: no base ends in Error, Exception or Warning."""
    return ~name.startswith("_") & ~F.exists(bases, lambda b: b.rlike("(Error|Exception|Warning)$"))


def is_dependency_table(file, table) -> Column:
    """Whether a manifest's table declares dependencies."""
    named = table.isin("build-system", "project", "project.optional-dependencies", "dependency-groups")
    poetry = table.rlike(r"^(tool\.poetry\.(.+\.)?dependencies|tool\.poetry\.extras)$")
    return F.when(file == "setup.cfg", table.isin("options", "options.extras_require")).otherwise(named | poetry)
