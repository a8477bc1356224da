"""Tables that grow with the input are joined by sorting: a broadcast passes through the driver."""

import pytest

import __spark_entry__


def plans(spark, run):
    """The plans of all that ``run`` executes, where Spark broadcasts whatever it takes for smaller than 1 GB by its files."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    asked = {"spark.sql.autoBroadcastJoinThreshold": "1g", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    try:
        run()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = store.executionsList(before, store.executionsCount() - before)
    return [found.apply(k).physicalPlanDescription() for k in range(found.size())]


@pytest.mark.parametrize("name", ["tree_calls", "reach_net", "call_graph_diagram", "sequence_diagrams", "section_excerpts"])
def test_no_growing_table_is_broadcast(spark, tmp_path, name):
    folder = str(tmp_path)
    spark.range(60).selectExpr("id as p_partkey", "'Brand#1' as p_brand", "'a part' as p_name", "cast(id % 50 + 1 as int) as p_size").write.parquet(f"{folder}/part.parquet")
    found = plans(spark, lambda: __spark_entry__.queries()[name](spark, folder).write.format("noop").mode("overwrite").save())
    assert found and not [p for p in found if "BroadcastHashJoin" in p]
