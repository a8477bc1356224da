"""Filters in the source, manifests of a folder, manifests under a budget."""

import os

from pyspark.sql import functions as F

from codeloom.operators import manifests
from codeloom.sources import code_tree
from codeloom.sources.code_tree import tree


def test_a_filtered_read_opens_only_files_that_pass(spark, tmp_path):
    for k in range(6):
        folder = tmp_path / ("pkg" if k % 2 else "lib")
        folder.mkdir(exist_ok=True)
        (folder / f"m{k}.py").write_text("x = 1\n" * (k + 1))
    (tmp_path / "pkg/__init__.py").write_text("")
    os.utime(tmp_path / "pkg/m5.py", (1000, 1000))
    # a file that would be opened in vain can't be read: its row would carry an error
    for name in ("lib/m0.py", "lib/m2.py", "pkg/m1.py", "pkg/m5.py"):
        os.unlink(tmp_path / name)
        os.mkfifo(tmp_path / name)
        os.utime(tmp_path / name, (1000, 1000))
    rows = tree(spark, str(tmp_path))
    paths = lambda df: sorted(r["path"] for r in df.where("error is null").collect())
    big = rows.where("startswith(path, 'pkg/') and size > 10 and mtime > 2000.5")
    assert paths(big) == ["pkg/m3.py"]
    assert paths(rows.where(F.col("path").isin("lib/m4.py", "none.py"))) == ["lib/m4.py"]
    assert paths(rows.where("is_package")) == ["pkg/__init__.py"]
    assert paths(rows.where("endswith(path, '4.py') or path = 'pkg/m3.py'").where("contains(path, 'm') and size >= 5 and mtime > 2000.5")) == ["lib/m4.py", "pkg/m3.py"]


def test_tests_of_what_is_known_so_far(tmp_path):
    reader = code_tree._Reader({"path": str(tmp_path)})
    ds = code_tree.ds
    left = list(reader.pushFilters([ds.EqualTo(("path",), "a"), ds.GreaterThan(("size",), 3), ds.EqualTo(("content",), "x"), ds.Not(ds.EqualTo(("path",), "b")), ds.IsNotNull(("path",))]))
    assert [type(f) for f in left] == [ds.EqualTo, ds.Not]
    assert reader.passes({"path": "a", "is_package": False}) and not reader.passes({"path": "b", "is_package": False})
    assert reader.passes({"mtime": 1.0, "size": 4}) and not reader.passes({"mtime": 1.0, "size": 3}) and not reader.passes({"mtime": None, "size": None})


def test_manifests_of_a_folder(spark, tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out/requirements.txt").write_text("outside")
    home = tmp_path / "home"
    home.mkdir()
    (home / "sub").mkdir()
    (home / "sub/requirements.txt").write_text("deeper")
    (home / "pyproject.toml").write_text('[tool.black]\nline = 1\n[project]\nname = "a"\n[ dependency-groups ]\nx = []\n')
    (home / "setup.cfg").write_text("[metadata]\nname = a\n")
    (home / "requirements-dev.txt").write_bytes(b"pytest \xff\n\n")
    (home / "requirements.txt").symlink_to(tmp_path / "out/requirements.txt")
    found = [tuple(r) for r in manifests.read_manifests(spark, str(home)).orderBy("nth").collect()]
    assert found == [("pyproject.toml", 1, '[project]\nname = "a"\n[ dependency-groups ]\nx = []'), ("requirements-dev.txt", 2, "pytest \ufffd")]


def test_manifests_share_a_budget(spark):
    prompts = spark.createDataFrame([("p", "deps", "Ask"), ("q", "deps", "Ask")], "project string, section string, prompt string")
    some = spark.createDataFrame([("p", 1, "pyproject.toml", "a\nbb"), ("p", 2, "setup.cfg", "cc\ndd\nee"), ("p", 3, "requirements.txt", "f")], "project string, nth int, name string, text string")
    tail = lambda budget: manifests.with_manifests(prompts, some, budget).where("project = 'p'").first()["prompt"].split("shown.")[1]
    assert tail(99).count("###") == 3
    assert tail(9) == "\n\n### pyproject.toml\n\n```toml\na\nbb\n```\n\n### setup.cfg\n\n```ini\ncc\n... (cut off)\n```"
    assert tail(4).endswith("### setup.cfg\n\n```ini\n... (cut off)\n```")
    assert manifests.with_manifests(prompts, some, 9).where("project = 'q'").first()["prompt"] == "Ask"


def test_packages_belong_to_themselves(spark):
    from codeloom.operators import names, xref

    files = spark.createDataFrame([("p", "a", True), ("p", "a.x", False), ("p", "a.sub", True), ("p", "a.sub.y", False), ("p", "top", False)], "project string, module string, is_package boolean")
    imports = [("p", "a.x", False, "a.sub"), ("p", "a.sub", True, ".y"), ("p", "a.sub.y", False, "a.x"), ("p", "a", True, "numpy"), ("p", "top", False, "a.sub.y"), ("p", "a.x", False, "top")]
    placed = names.place_imports(spark.createDataFrame(imports, "project string, module string, is_package boolean, imported string"), files, ("project",))
    found = {(r["src"], r["dst"], r["kind"]) for r in xref.package_edges(placed, files).collect()}
    assert found == {("a", "a.sub", "internal"), ("a.sub", "a", "internal"), ("a", "numpy", "third_party"), ("top", "a.sub", "internal"), ("a", "top", "internal")}


def test_an_array_on_a_line_is_no_header(spark):
    rows = spark.createDataFrame([("f", k, x) for k, x in enumerate(["[project]", "x = [", "  ['a', 'b'],", "]", "[[tool.x]] # more", "y"])], "file string, line_no int, line string")
    assert [r["table"] for r in manifests.scoped_lines(rows, ["file"]).orderBy("line_no").collect()] == ["project"] * 4 + ["tool.x"] * 2
