"""Token usage and its cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_model(events: DataFrame) -> DataFrame:
    """Sums of ``events`` (model, input_tokens, output_tokens, cached, estimated) for each model."""
    return events.groupBy("model").agg(
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        F.count("*").alias("requests"),
        F.count_if("cached").alias("cached_requests"),
        F.bool_or("estimated").alias("estimated"),
    )


# How models say that an answer stopped at the output limit.
LIMIT_REASONS = {"stop_reason": "max_tokens", "finish_reason": "length"}


def is_truncated(reported) -> F.Column:
    """Whether what a model reported of an answer (a map of strings) says that it was cut off; null counts as not."""
    said = [F.coalesce(F.try_element_at(reported, F.lit(k)) == v, F.lit(False)) for k, v in LIMIT_REASONS.items()]
    return said[0] | said[1]


def by_run(events: DataFrame) -> DataFrame:
    """(run, input_tokens, output_tokens, truncated) of ``events`` (run, input_tokens, output_tokens, reported): sums, and whether any answer was cut off."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    return events.groupBy("run").agg(*sums, F.bool_or(is_truncated(F.col("reported"))).alias("truncated"))


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` with ``cost`` from ``prices`` (model, input_per_million, output_per_million); an unknown model costs 0 and is not ``priced``."""
    found = usage.join(prices, "model", "left")
    cost = (F.col("input_tokens") * F.col("input_per_million") + F.col("output_tokens") * F.col("output_per_million")) / 1e6
    return found.select(*usage.columns, F.coalesce(cost, F.lit(0.0)).alias("cost"), F.col("input_per_million").isNotNull().alias("priced"))


def totals(costed: DataFrame) -> DataFrame:
    """One row: total cost, requests, and the share of cached requests in percent (0 without requests)."""
    rate = F.coalesce(F.try_divide(100.0 * F.sum("cached_requests"), F.sum("requests")), F.lit(0.0))
    return costed.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), rate.alias("hit_rate"))


def summary(costed: DataFrame) -> DataFrame:
    """One row: totals and a map of the models' figures."""
    entry = F.struct("model", F.struct("input_tokens", "output_tokens", "requests", "cached_requests", "cost").alias("figures"))
    return totals(costed).crossJoin(costed.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("models")))
