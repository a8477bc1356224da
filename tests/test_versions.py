"""Versions of stored tables: crashes, rival writers, damage, age."""

import os
import shutil

import pytest

from codeloom.operators.versions import Conflict, Store


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def values(store):
    found = store.read()
    return None if found is None else sorted(r["v"] for r in found.collect())


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), "v long")
    assert store.read() is None and store.versions() == []
    assert store.write(rows(spark, 1)) == 1 and values(store) == [1]

    # a job that dies between its rows and its version leaves the table as it was
    rows(spark, 9).write.parquet(str(tmp_path / "t/rows-lost"))
    assert values(store) == [1] and store.versions() == [1]

    # of two writers each gets a version of its own; one that is based on an older one is refused
    rival = Store(spark, str(tmp_path / "t"), "v long")
    claims, once = rival._claim, []

    def late(version, folder):
        if not once:
            once.append(store.write(rows(spark, 2)))
        return claims(version, folder)

    rival._claim = late
    assert rival.write(rows(spark, 3)) == 3 and once == [2] and values(store) == [3]
    with pytest.raises(Conflict):
        store.write(rows(spark, 4), based_on=2)
    assert values(store) == [3] and store.write(rows(spark, 5), based_on=3) == 4

    # damaged rows, rows that are gone and a version cut short are passed over
    data = next((tmp_path / store._folder(4)).glob("part-*"))
    data.write_bytes(data.read_bytes()[:20])
    (data.parent / f".{data.name}.crc").unlink(missing_ok=True)
    assert values(store) == [3]
    shutil.rmtree(store._folder(3))
    assert values(store) == [2]
    for name in os.listdir(tmp_path / "t/versions"):
        if name.isdigit() and int(name) < 3:
            (tmp_path / "t/versions" / name).write_bytes(b"rows-none")
            (tmp_path / "t/versions" / f".{name}.crc").unlink(missing_ok=True)
    assert store.read() is None and store.write(rows(spark, 6)) == 5 and values(store) == [6]


def test_old_versions_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), "v long")
    for v in range(4):
        store.write(rows(spark, v))
    rows(spark, 9).write.parquet(str(tmp_path / "t/rows-lost"))
    assert store.expire(keep=2, age=3600) == 0 and store.versions() == [4, 3, 2, 1]
    assert store.expire(keep=2, age=-60) == 3 and store.versions() == [4, 3] and values(store) == [3]
    assert store.write(rows(spark, 7)) == 5 and values(store) == [7]
