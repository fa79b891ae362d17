import asyncio
import threading
import time

import pytest
from pyspark.sql import functions as F

from graphloom.errors import CancelledError
from graphloom.graph import PropertyGraph
from graphloom.schema import NodeType, Registry
from graphloom.streaming import Cancellation, rows, rows_async


def test_rows(spark):
    df = spark.range(5).selectExpr("id AS _nid", "array('N') AS _labels", "id AS x")
    q = PropertyGraph(spark, Registry().add(NodeType("N")), {"N": df}, {}).nodes("N").where(lambda n: n.x > 1)
    assert sorted(r["x"] for r in rows(q)) == [2, 3, 4]

    async def collect():
        return [r["x"] async for r in rows_async(q)]

    assert sorted(asyncio.run(collect())) == [2, 3, 4]


def test_cancellation(spark):
    df = spark.range(2, numPartitions=2).selectExpr("id AS _nid", "array('N') AS _labels", "id AS x")
    graph = PropertyGraph(spark, Registry().add(NodeType("N")), {"N": df}, {})

    @F.udf("long")
    def slow(x):
        time.sleep(60)
        return x

    token = Cancellation(spark)
    assert token.run(lambda: graph.nodes("N").count()) == 2
    with pytest.raises(ZeroDivisionError):
        token.run(lambda: 1 // 0)
    threading.Timer(3, token.cancel).start()
    began = time.monotonic()
    with pytest.raises(CancelledError):
        token.run(lambda: graph.nodes("N").select(lambda n: slow(n.x)).to_list())
    assert time.monotonic() - began < 40
    with pytest.raises(CancelledError):
        token.run(lambda: 1)
    assert graph.nodes("N").count() == 2
