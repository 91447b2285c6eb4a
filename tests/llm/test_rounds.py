"""What rounds of joins carry on."""

from foliant.llm.ngramjoin import connect


def test_size_estimates_do_not_grow_with_the_rounds(spark):
    """op6_line_dedup: a checkpoint keeps the plan's estimate, whose digits doubled with each round and filled the driver."""
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b")
    now = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        roots = connect(edges)
        size = int(str(roots._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        assert {(r.node, r.root) for r in roots.collect()} == {(k, 0) for k in range(201)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", now)
    assert size.bit_length() < 64


def test_no_links(spark):
    assert connect(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
