"""Compare a Spark result with rows of another engine."""

import math

import pandas as pd


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        return plain(v.item())
    return v


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(plain(v) for v in r)) for r in frame.astype(object).itertuples(index=False))


def same(spark_frame, other):
    a, b = spark_frame.toPandas(), other
    assert sorted(a.columns) == sorted(b.columns)
    assert rows_of(a) == rows_of(b)
