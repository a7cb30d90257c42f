"""Plans of chained aggregates, whatever the length of the chain."""

import uuid

from pyspark.sql import functions as F

from loomstream.streaming import live
from loomstream.streaming.live import Aggregate

KIND = "grp string, lamport bigint, node string, stream_nr bigint, offset bigint, value bigint, anti boolean"


def test_plan_grows_no_faster_than_the_chain(spark):
    """A micro-batch is planned anew, so what its plan repeats is paid with every slice."""
    batch = spark.createDataFrame([("g", 1, "n", 0, 0, 5, False)], KIND)

    def size(n: int) -> int:
        step = live.aggregating(Aggregate("last"), *(Aggregate("sum", lambda v: v + 1) for _ in range(n - 1)))
        path = f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
        subscription = live.Subscription(path, step)
        subscription._take(batch, 0)
        new = step(batch, subscription._state(spark, 0), 1)
        return len(new._jdf.queryExecution().optimizedPlan().toString())

    one, two, three = (size(n) for n in (1, 2, 3))
    assert two - one < 2 * one and three - two < 2 * (two - one), (one, two, three)


def test_long_chain_says_what_its_last_aggregate_gives(spark):
    chain = live.aggregating(Aggregate("last"), *(Aggregate("sum", lambda v: v + 1) for _ in range(3)))
    subscription = live.Subscription(f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}", chain)
    for k, value in enumerate((5, 7, 7)):
        subscription._take(spark.createDataFrame([("g", k, "n", 0, k, value, False)], KIND), k)
    said = [(r["type"], int(r["value"])) for r in subscription.said(spark).orderBy("seq").collect()]
    assert said == [("event", 8), ("antiEvent", 8), ("event", 10)]
