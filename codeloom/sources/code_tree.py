"""A Python data source that lists and reads source trees.

``spark.read.format("code_tree").option("path", root).option("exclude", "docs,*_gen.py").load()``

The walk never enters the pruned folders, folders that hold ``pyvenv.cfg`` or
names and relative paths that match a pattern, and skips links that lead out of
the root; with ``flat`` it looks at the root's own files only. One partition reads
FILES files, in Arrow batches. Rows: path, is_package, content, content_hash (of the
raw bytes), mtime, size, read_at, error. A file that can't be decoded, or is empty
and no ``__init__.py``, is a row with an error; with ``errors=replace`` what can't be
decoded is replaced, and empty files stand.

Filters on path and is_package choose among the listed paths, those on mtime and
size are answered by a look at the file's state; a file that they leave out is
never opened.
"""

from __future__ import annotations

import fnmatch
import hashlib
import operator
import os
import time

import pyarrow as pa
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Folders that hold no source of the project itself.
PRUNED = frozenset(
    ".bzr .direnv .eggs .git .hg .ipynb_checkpoints .mypy_cache .nox .pytest_cache .ruff_cache "
    ".svn .tox .venv __pycache__ __pypackages__ _build build dist node_modules site-packages venv".split()
)
FILES = 64
SCHEMA = "path string, is_package boolean, content string, content_hash string, mtime double, size long, read_at double, error string"


def matches(name: str, relative: str, patterns: list[str]) -> bool:
    return any(fnmatch.fnmatch(name, p) or fnmatch.fnmatch(relative, p) for p in patterns)


def inside(path: str, root: str) -> bool:
    """Whether a path, its links followed, stays below the root."""
    real, top = os.path.realpath(path), os.path.realpath(root)
    return os.path.exists(real) and (real == top or real.startswith(top + os.sep))


def walk(root: str, patterns: list[str], names: list[str], flat: bool = False) -> list[str]:
    """Relative paths in order."""
    found = []
    for folder, folders, files in os.walk(root):
        relative = os.path.relpath(folder, root)
        at = lambda n: n if relative == "." else f"{relative}/{n}"
        folders[:] = [] if flat else sorted(d for d in folders if d not in PRUNED and not matches(d, at(d), patterns) and not os.path.exists(os.path.join(folder, d, "pyvenv.cfg")))
        found += [at(f) for f in files if any(fnmatch.fnmatch(f, n) for n in names) and not matches(f, at(f), patterns) and inside(os.path.join(folder, f), root)]
    return sorted(found)


def is_package(path: str) -> bool:
    return os.path.basename(path) == "__init__.py"


def read_one(root: str, path: str, wanted=lambda stat: True, errors: str = "strict") -> tuple | None:
    """One file's row, null if its state is not ``wanted``."""
    full = os.path.join(root, path)
    package = is_package(path)
    try:
        stat = os.stat(full)
        if not wanted({"mtime": stat.st_mtime, "size": stat.st_size}):
            return None
        with open(full, "rb") as f:
            raw = f.read()
        text = raw.decode("utf-8", errors).replace("\r\n", "\n").replace("\r", "\n")
        error = None if text or package or errors == "replace" else "empty file"
    except (OSError, UnicodeDecodeError) as e:
        return (path, package, None, None, None, None, time.time(), str(e)) if wanted({"mtime": None, "size": None}) else None
    return path, package, text, hashlib.sha256(raw).hexdigest(), stat.st_mtime, stat.st_size, time.time(), error


#: Filters that are answered without opening a file. None counts as no match, as a comparison with null does.
TESTS = {
    ds.EqualTo: operator.eq,
    ds.GreaterThan: operator.gt,
    ds.GreaterThanOrEqual: operator.ge,
    ds.LessThan: operator.lt,
    ds.LessThanOrEqual: operator.le,
    ds.In: lambda v, those: v in those,
    ds.StringStartsWith: str.startswith,
    ds.StringEndsWith: str.endswith,
    ds.StringContains: lambda v, part: part in v,
}


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.patterns = [p for p in options.get("exclude", "").split(",") if p]
        self.names = [p for p in options.get("names", "*.py").split(",") if p]
        self.required = options.get("required", "false").lower() == "true"
        self.flat = options.get("flat", "false").lower() == "true"
        self.errors = options.get("errors", "strict")
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in TESTS and len(column) == 1 and column[0] in ("path", "is_package", "mtime", "size"):
                self.tests.append((column[0], type(f), f.value))
            elif isinstance(f, ds.IsNotNull) and column in (("path",), ("is_package",)):
                continue
            else:
                yield f

    def passes(self, values: dict) -> bool:
        """Whether what is known of a file so far meets all tests of it."""
        return all(values[c] is not None and TESTS[kind](values[c], value) for c, kind, value in self.tests if c in values)

    def partitions(self):
        paths = walk(self.root, self.patterns, self.names, self.flat)
        if not paths and self.required:
            raise FileNotFoundError(f"{self.root} holds none of {', '.join(self.names)}")
        paths = [p for p in paths if self.passes({"path": p, "is_package": is_package(p)})]
        return [_Files(paths[a : a + FILES]) for a in range(0, len(paths), FILES)] or [_Files([])]

    def read(self, partition: _Files):
        rows = [r for path in partition.paths if (r := read_one(self.root, path, self.passes, self.errors)) is not None]
        types = [pa.string(), pa.bool_(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)


class CodeTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def tree(spark, root: str, **options):
    """All rows of a source tree; lets Spark hand filters to Python sources."""
    spark.dataSource.register(CodeTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("code_tree").options(path=root, **options).load()


def read_tree(spark, root: str, exclude: tuple[str, ...] = (), names: tuple[str, ...] = ("*.py",), most: int | None = None, required: bool = False):
    """(good, rejected) rows of a source tree.

    ``most``: only so many good rows, the first by path. ``required``: a tree
    without any such file is an error.
    """
    rows = tree(spark, root, exclude=",".join(exclude), names=",".join(names), required=str(required))
    good = rows.where("error is null").drop("error")
    return good if most is None else good.orderBy("path").limit(most), rows.where("error is not null").select("path", "error")
