"""What subscriptions say: the results, what is taken back, and where it is kept."""

import uuid

import pytest
from pyspark.sql import functions as F

from loomstream.operators.offsets import OffsetMap
from loomstream.streaming import live
from loomstream.streaming.live import Aggregate

KIND = "grp string, lamport bigint, node string, stream_nr bigint, offset bigint, value {}, anti boolean"


@pytest.fixture
def feed(spark):
    """Feeds batches of (lamport, value[, anti]) one after another; gives the lines of each batch."""

    def run(step, *batches, kind="bigint", grp="g"):
        path = f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
        subscription, out = live.Subscription(path, step), []
        for k, rows in enumerate(batches):
            full = [(grp, at, "n", 0, at, value, bool(anti)) for at, value, *rest in rows for anti in (rest[0] if rest else False,)]
            subscription._take(spark.createDataFrame(full, KIND.format(kind)), k)
            lines = [r for r in subscription.said(spark).collect() if k * live.LINES <= r["seq"] < (k + 1) * live.LINES]
            out.append([r for r in sorted(lines, key=lambda r: (r["seq"], r["lamport"] if "lamport" in r else 0))])
        return out

    return run


def shown(batches):
    mark = {"event": "", "antiEvent": "!", "diagnostic": "#"}
    return [[mark[r["type"]] + str(r["message"] if r["type"] == "diagnostic" else r["value"]) for r in b] for b in batches]


def test_last_takes_back(feed):
    got = feed(live.aggregating(Aggregate("last")), [(1, 1), (2, 2)], [(3, 2)], [(4, 3)], [(5, 4)])
    assert shown(got) == [["2"], [], ["!2", "3"], ["!3", "4"]]


def test_chained_sum_stays(feed):
    chain = live.aggregating(Aggregate("last"), Aggregate("sum", lambda v: F.lit(1)))
    assert shown(feed(chain, [(1, 2)], [(2, 3)], [(3, 4)])) == [["1"], [], []]
    follow = live.aggregating(Aggregate("last"), Aggregate("sum"))
    assert shown(feed(follow, [(1, 2)], [(2, 3)], [(3, 3)])) == [["2"], ["!2", "3"], []]


def test_chained_max_ends(feed):
    chain = live.aggregating(Aggregate("last"), Aggregate("max", lambda v: F.lit(3)))
    got = feed(chain, [(1, 1)], [(2, 2)], [(3, 9)])
    assert shown(got) == [["3"], ["#anti-input cannot be processed in MAX()"], []]
    assert got[1][0]["severity"] == "error"


@pytest.mark.parametrize(("kind", "said"), [
    ("first", [["2"], [], [], []]), ("last", [["2"], ["!2", "1"], ["!1", "4"], ["!4", "3"]]), ("min", [["2"], ["!2", "1"], [], []]), ("max", [["2"], [], ["!2", "4"], []]),
])
def test_one_value_a_batch(feed, kind, said):
    assert shown(feed(live.aggregating(Aggregate(kind)), [(1, 2)], [(2, 1)], [(3, 4)], [(4, 3)])) == said


def test_sum_and_product_invert(feed):
    assert shown(feed(live.aggregating(Aggregate("sum")), [(1, 5), (2, 7)], [(1, 5, True)], [(2, 7, True)], [(3, 0)])) == [["12"], ["!12", "7"], ["#no value added", "!7"], ["0"]]
    assert shown(feed(live.aggregating(Aggregate("product")), [(1, 3), (2, 4)], [(3, 0)], [(3, 0, True)], [(1, 3, True)])) == [["12.0"], ["!12.0", "0.0"], ["!0.0", "12.0"], ["!12.0", "4.0"]]


def test_texts_and_truth_values(feed):
    assert shown(feed(live.aggregating(Aggregate("max")), [(1, "b"), (2, "a")], [(3, "ba")], kind="string")) == [["b"], ["!b", "ba"]]
    assert shown(feed(live.aggregating(Aggregate("first")), [(2, True)], [(1, False)], kind="boolean")) == [["True"], ["!True", "False"]]


def test_sum_and_product_of_truth_values(feed):
    """OR and AND, by counts of what decides; anti-inputs are taken from the counts."""
    some = feed(live.aggregating(Aggregate("sum")), [(1, False)], [(2, True), (3, True)], [(2, True, True)], [(3, True, True)], [(1, False, True)], kind="boolean")
    assert shown(some) == [["False"], ["!False", "True"], [], ["!True", "False"], ["#no value added", "!False"]]
    every = feed(live.aggregating(Aggregate("product")), [(1, True)], [(2, False), (3, False)], [(2, False, True)], [(3, False, True)], kind="boolean")
    assert shown(every) == [["True"], ["!True", "False"], [], ["!False", "True"]]
    chain = live.aggregating(Aggregate("last"), Aggregate("sum", lambda v: v > 2), Aggregate("product"))
    assert shown(feed(chain, [(1, 1)], [(2, 3)], [(3, 4)], [(4, 0)])) == [["False"], ["!False", "True"], [], ["!True", "False"]]


def test_limit_gives_back_until_used_up(feed):
    got = feed(live.limiting(2), [(1, 1)], [(1, 1, True), (2, 2)], [(3, 3), (4, 4)], [(5, 5, True)])
    assert shown(got) == [["1"], ["!1", "2"], ["3"], ["#anti-input cannot be processed in saturated LIMIT"]]


def test_monotonic_ends_with_time_travel(feed):
    got = feed(live.monotonic((4, "n", 0)), [(6, 1), (5, 2)], [(8, 3), (3, 4), (4, 9)], [(9, 5)])
    assert [[(r["type"], r["lamport"], r["caught_up"]) for r in b] for b in got] == [[("event", 5, False), ("event", 6, True)], [("timeTravel", 3, False)], []]


def test_a_batch_that_runs_again_says_the_same(spark):
    path = f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
    subscription = live.Subscription(path, live.aggregating(Aggregate("sum")))
    rows = spark.createDataFrame([("g", 1, "n", 0, 0, 5, False)], KIND.format("bigint"))
    for version in (0, 1, 1):
        subscription._take(rows, version)
    assert [(r["type"], int(r["value"])) for r in subscription.said(spark).orderBy("seq").collect()] == [("event", 5), ("antiEvent", 5), ("event", 10)]


def test_live_part_goes_on_after_what_is_known(spark):
    """An event newer than what was known, but covered by the lower bound, never comes."""
    path = f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
    make = lambda *at: spark.createDataFrame([("g", k, "n", 0, k, k, False) for k in at], KIND.format("bigint"))
    subscription = live.Subscription(path, live.monotonic())
    after = subscription.catch_up(make(0, 1, 2), OffsetMap({("n", 0): 3}))
    assert after.offset(("n", 0)) == 3
    make(0, 1, 2, 3, 4, 5).write.parquet(f"{path}/in")
    said = subscription.run(spark.readStream.schema(make(0).schema).parquet(f"{path}/in"), after)
    assert [r["lamport"] for r in said.orderBy("lamport").collect()] == [4, 5]


def test_cached_state_below_new_events(spark):
    events = spark.createDataFrame([("g", k, "n", 0, k, k, False) for k in range(6)], KIND.format("bigint"))
    late = lambda known, at: [r["lamport"] for r in live.time_travel_before(events, OffsetMap(known), (at, "n", 0)).collect()]
    assert late({("n", 0): 3}, 5) == [4] and late({("n", 0): 5}, 5) == [] and late({("n", 0): 3}, 3) == []


def test_subscriptions_take_events_to_the_last(spark, monkeypatch):
    """More events than 10,000, in slices with gaps between their lamports."""
    from loomstream.plans import queries as plans

    monkeypatch.setattr(plans, "SLICE", 2_000)
    lamport = F.col("id") * 3 + F.when(F.col("id") > 9_000, 50_000).otherwise(0) + 1
    e = spark.range(0, 12_000).select(
        lamport.alias("lamport"), F.lit("n0").alias("node"), F.lit(0).cast("bigint").alias("stream_nr"), F.col("id").alias("offset"), F.array(F.lit("x")).alias("tags"),
        F.struct((F.col("id") % 7).alias("k"), F.lit("error").alias("event_type")).alias("payload"),
    )
    said = plans.subscribed(spark, live.monotonic(), plans.slices_of(plans.inputs(e)))
    assert [tuple(r) for r in said.groupBy("type").agg(F.count("*")).collect()] == [("event", 12_000)]
    summed = plans._net(plans.subscribed(spark, live.aggregating(Aggregate("sum")), plans.slices_of(plans.inputs(e))))
    assert int(summed.first()["value"]) == sum(i % 7 for i in range(12_000))
    assert plans.subscribed(spark, live.monotonic(), plans.slices_of(plans.inputs(e.where("false")))).count() == 0


def test_chunks_as_they_come(feed, spark):
    """Batches of 5, 0 and 2 events in chunks of two, each in order of key whatever the order in the batch."""
    got = feed(live.chunking(2), [(9, 90), (1, 10), (5, 50), (3, 30), (7, 70)], [], [(4, 40), (2, 20)])
    chunks = [[(r["seq"] % live.LINES, r["lamport"], r["value"]) for r in b] for b in got]
    assert chunks == [[(0, 1, 10), (0, 3, 30), (1, 5, 50), (1, 7, 70), (2, 9, 90)], [], [(0, 2, 20), (0, 4, 40)]]
    rows = spark.createDataFrame([(0, "a", 0, 3), (0, "a", 0, 4), (0, "b", 0, 0), (1, "a", 0, 5)], "seq bigint, node string, stream_nr bigint, offset bigint")
    bounds = sorted(tuple(r) for r in live.delivered_bounds(rows).collect())
    assert bounds == [(0, "a", 0, 2, 4, 2), (0, "b", 0, -1, 0, 1), (1, "a", 0, 4, 5, 1)]
    with pytest.raises(ValueError):
        live.chunking(0)
