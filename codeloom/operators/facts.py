"""Facts of Python source, read file by file in Arrow batches.

``facts(files)`` (project, path, module, is_package, content) gives rows
(project, module, kind, ord, name, owner, value, line, end_line, flags):

* ``entity``: top-level classes and functions (value: docstring, owner: first base, flags: class or function)
* ``method``: methods of top-level classes (owner: class; flags: static, property)
* ``base``: bases of every class in order (owner: class)
* ``import``: dotted names as written, leading dots kept
* ``alias``: a name bound by an import (value: what it stands for)
* ``call``: the calls of a function's body in order of evaluation, each callee
  once (owner: function by qualified name in the module, name: last part, flags
  and value: how it is looked up, see ``flow.Flow.site``); a nested function is a
  caller of its own, ``outer.inner``
* ``step``, ``slot``, ``returns``: what names, attributes (owner: class, name:
  attribute) and calls of functions (owner: function) hold, see ``flow``; ord is
  the step's number
* ``component``: the bare name that a class attribute is set to, or to a call of (owner: class)
* ``excerpt``: the source of each function (value), its docstring cut to the
  first paragraph, at most EXCERPT characters; flags: env if it reads the environment
* ``outline``: a class's head, summary and the heads of its public methods
  (value), at most OUTLINE characters
* ``module``, ``error``: the file parses, or it doesn't

Of definitions that share a name in one body the last counts for calls, types
and bases; ``entity``, ``excerpt`` and ``outline`` list all. Lines are the
file's own. A file nested too deeply to walk has no ``call``, ``step`` and ``slot``.

Everything that needs more than one file is done by joins on these rows.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flow import FUNCTIONS, Flow, decorators, members

EXCERPT, OUTLINE = 2500, 1500
SCHEMA = "kind string, ord int, name string, owner string, value string, line int, end_line int, flags string"


#: What a group of kinds is read for; a query that needs one group doesn't make the others.
GROUPS = ("entities", "calls", "texts", "imports")
BATCH = 8192


def _dotted(node) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _cap(text: str, most: int) -> str:
    return text if len(text) <= most else text[: text.rfind("\n", 0, most) + 1] + "..."


def _summary(node) -> str:
    return (ast.get_docstring(node) or "").split("\n\n")[0]


def _excerpt(node, lines: list[str]) -> str:
    doc = node.body[0] if ast.get_docstring(node) is not None else None
    if doc is None:
        return _cap("\n".join(lines[node.lineno - 1 : node.end_lineno]), EXCERPT)
    mark = f'{" " * doc.col_offset}"""{_summary(node)}"""'
    return _cap("\n".join([*lines[node.lineno - 1 : doc.lineno - 1], mark, *lines[doc.end_lineno : node.end_lineno]]), EXCERPT)


def _head(node, lines: list[str]) -> str:
    first = node.body[0]
    if first.lineno == node.lineno:  # all on one line
        return lines[node.lineno - 1].encode()[: first.col_offset].decode().rstrip()
    return "\n".join(lines[node.lineno - 1 : first.lineno - 1]).rstrip()


def _outline(node, lines: list[str]) -> str:
    parts = [_head(node, lines)]
    if summary := _summary(node):
        parts.append(f'    """{summary}"""')
    for inner in node.body:
        if isinstance(inner, (ast.FunctionDef, ast.AsyncFunctionDef)) and (not inner.name.startswith("_") or inner.name == "__init__"):
            parts.append(f"{_head(inner, lines)} ...")
    return _cap("\n".join(parts), OUTLINE)


def _reads_environment(node) -> bool:
    return any(isinstance(n, ast.Attribute) and _dotted(n) in ("os.environ", "os.getenv") for n in ast.walk(node))


def _texts(body, owner: str | None, lines: list[str]):
    for k, node in enumerate(body):
        name = f"{owner}.{node.name}" if owner and hasattr(node, "name") else getattr(node, "name", None)
        if isinstance(node, ast.ClassDef):
            yield "outline", k, name, owner, _outline(node, lines), node.lineno, node.end_lineno, None
            yield from _texts(node.body, name, lines)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield "excerpt", k, name, owner, _excerpt(node, lines), node.lineno, node.end_lineno, "env" if _reads_environment(node) else ""


def _last(body) -> list:
    """(place, node) of functions and classes of a body, without those that a later one replaces, and of all else."""
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    last = {n.name: k for k, n in enumerate(body) if isinstance(n, kinds)}
    return [(k, n) for k, n in enumerate(body) if not isinstance(n, kinds) or last[n.name] == k]


def _class(node, owner: str | None):
    name = f"{owner}.{node.name}" if owner else node.name
    for k, base in enumerate(node.bases):
        yield "base", k, _dotted(base) or ast.unparse(base), name, ast.unparse(base), node.lineno, node.end_lineno, None
    for k, inner in _last(node.body):
        if isinstance(inner, FUNCTIONS):
            said = decorators(inner)
            flags = "static" if "staticmethod" in said else "property" if said & {"property", "cached_property"} else ""
            named = members(inner.returns) if inner.returns else []
            yield "method", k, inner.name, name, named[0] if len(named) == 1 else None, inner.lineno, inner.end_lineno, flags
        elif isinstance(inner, ast.ClassDef):
            yield from _class(inner, name)
        if isinstance(inner, (ast.Assign, ast.AnnAssign)):
            held = inner.value.func if isinstance(inner.value, ast.Call) else inner.value
            if isinstance(held, ast.Name):
                yield "component", k, held.id, name, None, inner.lineno, inner.end_lineno, None


def _entities(tree):
    for k, node in enumerate(tree.body):
        if isinstance(node, ast.ClassDef):
            first = ast.unparse(node.bases[0]) if node.bases else None
            yield "entity", k, node.name, first, ast.get_docstring(node) or "", node.lineno, node.end_lineno, "class"
        elif isinstance(node, FUNCTIONS):
            yield "entity", k, node.name, None, ast.get_docstring(node) or "", node.lineno, node.end_lineno, "function"
    for _, node in _last(tree.body):
        if isinstance(node, ast.ClassDef):
            yield from _class(node, None)


def _calls(tree):
    try:
        yield from list(Flow().rows(tree))
    except RecursionError:
        return


def _imports(tree):
    k = 0
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                yield "import", k, a.name, None, None, node.lineno, node.end_lineno, None
                yield "alias", k, a.asname or a.name.partition(".")[0], None, a.name if a.asname else a.name.partition(".")[0], node.lineno, node.end_lineno, None
                k += 1
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                dots, base = "." * node.level, node.module or ""
                full = f"{dots}{base}" if a.name == "*" else f"{dots}{base}{'.' if base else ''}{a.name}"
                yield "import", k, full, None, None, node.lineno, node.end_lineno, None
                if a.name != "*":
                    yield "alias", k, a.asname or a.name, None, full, node.lineno, node.end_lineno, None
                k += 1


def facts_of(content: str, groups: tuple[str, ...] = GROUPS):
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError) as e:
        yield "error", 0, type(e).__name__, None, str(e), 0, 0, None
        return
    yield "module", 0, None, None, None, 0, 0, None
    if "entities" in groups:
        yield from _entities(tree)
    if "calls" in groups:
        yield from _calls(tree)
    if "texts" in groups:
        yield from _texts(tree.body, None, content.split("\n"))
    if "imports" in groups:
        yield from _imports(tree)


def facts(files: DataFrame, *groups: str) -> DataFrame:
    """Facts of ``files`` (project, module, is_package, content), all or those of some GROUPS."""
    slim = files.select("project", "module", F.col("is_package").cast("boolean").alias("is_package"), "content")
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def read(batches):
        for batch in batches:
            found, of = [], []

            def full():
                files_ = batch.select(["project", "module", "is_package"]).take(pa.array(of, pa.int32()))
                columns = [pa.array(c, t) for c, t in zip(zip(*found), types)]
                return pa.RecordBatch.from_arrays([*files_.columns, *columns], names=[*files_.schema.names, *names])

            for k, content in enumerate(batch.column("content").to_pylist()):
                some = list(facts_of(content or "", groups or GROUPS))
                found += some
                of += [k] * len(some)
                if len(found) >= BATCH:
                    yield full()
                    found, of = [], []
            if found:
                yield full()

    # few input partitions would leave most cores without work: parsing costs far more than moving
    cores = files.sparkSession.sparkContext.defaultParallelism
    if slim.rdd.getNumPartitions() < cores:
        slim = slim.repartition(cores, "project", "module")
    kind = files.schema["project"].dataType.simpleString()
    return slim.mapInArrow(read, f"project {kind}, module string, is_package boolean, {SCHEMA}")


def of_kind(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("kind") == kind).drop("kind")
