"""The entry module, with and without the training-data operators."""

import os
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "codeloom.llm") or name.startswith("codeloom.llm."):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_imports_without_them():
    subprocess.run([sys.executable, "-c", WITHOUT], check=True, cwd=ROOT)


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_counts_every_line(spark, sf, duck):
    # every supplier's degree is its number of customers over all orders, whatever their price, quantity and status
    want = dict(duck.sql("select 's' || l_suppkey, count(distinct o_custkey) from lineitem join orders on l_orderkey = o_orderkey group by 1").fetchall())
    found = {r["node"]: r["degree"] for r in __spark_entry__.entry(spark).collect()}
    assert sorted(found.values()) == sorted(want.values())[-10:] and all(want[n] == d for n, d in found.items())
