"""Sub-queries over whole tables, by brute force."""

from pyspark.sql import functions as F

from loomstream.functions.values import it
from loomstream.operators import subqueries, tags as S
from loomstream.operators.frame import EventFrame


def frame(spark, values):
    rows = [(i, "n0", 0, i, ["x"], "a", True, (v,)) for i, v in enumerate(values, 1)]
    kind = "lamport bigint, node string, stream_nr bigint, offset bigint, tags array<string>, app_id string, is_local boolean, payload struct<k:bigint>"
    df = spark.createDataFrame(rows, kind).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    return EventFrame.of(df, S.tag("x"))


def test_counts_above_need_no_pairs(spark):
    inner = [(i * 7919) % 1009 - 300 for i in range(700)] + [5] * 40 + [None]
    outer = [(i * 131) % 1500 - 500 for i in range(400)] + [5, 5, None]
    got = subqueries.nest_count_above(frame(spark, outer), "n", frame(spark, inner), it.k, it.k).df
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()
    found = {r[0]: r[1] for r in got.select(F.col("__key.lamport"), "__b_n").collect()}
    bad = lambda x: x is None or x < 0  # noqa: E731  (a number below 0 is in error)
    assert found == {i: 0 if bad(a) else sum(not bad(b) and b > a for b in inner) for i, a in enumerate(outer, 1)}


def test_counts_above_nothing(spark):
    got = subqueries.nest_count_above(frame(spark, [1, 2]), "n", frame(spark, [None]), it.k, it.k).df
    assert [r[0] for r in got.select("__b_n").collect()] == [0, 0]


def test_as_of_reaches_all_errors(spark):
    from loomstream.plans import queries as plans

    errors = spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("event_type = 'error'").count()
    assert plans.Q["subquery_as_of"](spark, "/root/testdata/sf0.01").count() == errors


def tagged(spark, rows):
    full = [(i, "n0", 0, i, tags, "a", True, (k,)) for i, k, tags in rows]
    kind = "lamport bigint, node string, stream_nr bigint, offset bigint, tags array<string>, app_id string, is_local boolean, payload struct<k:bigint>"
    return EventFrame.of(spark.createDataFrame(full, kind).withColumn("ts", F.lit("2024-01-01").cast("timestamp")))


def test_tags_of_other_kinds_are_no_rows_to_join(spark):
    """Every inner event has the tag ``item``; only what begins as the computed tag does is exploded."""
    from loomstream.functions.values import text

    outer = tagged(spark, [(k, k, ["x"]) for k in range(1, 6)])
    inner = tagged(spark, [(100 + k, k, ["item", f"a:{k % 3}"]) for k in range(30)])
    rows, _, _ = subqueries._by_tag(outer, inner, (text("a:", it.k),), None, it.k)
    assert rows.count() == 30 and {r["__it"] for r in rows.collect()} == {"a:0", "a:1", "a:2"}
    got = subqueries.nest(outer, "n", inner, on_tags=(text("a:", it.k),), select=it.k, limit=4).df
    assert {r[0]: r[1] for r in got.select("__key.lamport", "__b_n").collect()} == {1: [1, 4, 7, 10], 2: [2, 5, 8, 11], 3: [], 4: [], 5: []}


def test_three_levels(spark):
    """Each value names the tag of the next: 2, 3, 1 under a1, a2, a3."""
    from loomstream.functions.values import spread, text, var

    f = tagged(spark, [(1, 2, ["a1"]), (2, 3, ["a2"]), (3, 1, ["a3"])])
    level = lambda outer, name: subqueries.join_rows(outer.let(name, it.k), f, (text("a", it.k),), select=it)
    third = level(level(f, "x"), "y")
    got = third.df.select(F.col("__b_x"), F.col("__b_y"), F.col("__v.k")).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 3), (2, 3, 1), (3, 1, 2)]


def test_lamports_beyond_32_bits(spark):
    from loomstream.functions.values import text

    inner = tagged(spark, [(2**40, 7, ["a1"]), (2**40 + 1, 8, ["a1"])])
    got = subqueries.join_rows(tagged(spark, [(1, 1, ["x"])]), inner, (text("a", it.k),), select=it.k)
    assert sorted(r[0] for r in got.rows().collect()) == [7, 8]


def test_products_are_exact(spark):
    import math
    import random

    from loomstream.functions.values import product

    r = random.Random(1)
    for values in ([3037000499, 3037000499], [2**31, 2**32], [0, 2**40, 2**40], [3] * 39, [3] * 40, *([r.randrange(1, 2 ** (62 // n)) for _ in range(n)] for n in (3, 12, 31))):
        f = tagged(spark, [(i, v, ["x"]) for i, v in enumerate(values, 1)]).aggregate(product(it.k))
        whole = math.prod(values)
        assert [x[0] for x in f.rows().collect()] == ([whole] if whole < 2**63 else [])
        assert [x["message"] for x in f.diagnostics().collect()] == ([] if whole < 2**63 else ["integer overflow"])


def over_arrays(spark, rows):
    """Events with an array ``xs`` and a number ``k``."""
    full = [(i, "n0", 0, i, ["x"], "a", True, row) for i, row in enumerate(rows, 1)]
    kind = "lamport bigint, node string, stream_nr bigint, offset bigint, tags array<string>, app_id string, is_local boolean, payload struct<xs:array<bigint>,k:bigint>"
    return EventFrame.of(spark.createDataFrame(full, kind).withColumn("ts", F.lit("2024-01-01").cast("timestamp")))


def test_array_of_the_row(spark):
    from loomstream.functions.values import spread, var

    rows = [([3, 9, 4, 7], 2), ([], 1), ([1, 1], 8)]
    f = subqueries.nest_array(over_arrays(spark, rows), "n", (spread(it.xs), it.k), where=it > var("outer").k, select=it - var("outer").k, limit=2)
    assert "Join" not in f.df._jdf.queryExecution().optimizedPlan().toString()
    want = {i: [x - k for x in [*xs, k] if x > k][:2] for i, (xs, k) in enumerate(rows, 1)}
    assert {r[0]: r[1] for r in f.df.select("__key.lamport", "__b_n").collect()} == want == {1: [1, 7], 2: [], 3: []}
    assert f.diagnostics().count() == 0


def test_errors_over_an_array_are_the_rows(spark):
    from loomstream.functions.values import spread

    rows = [([5, 1, 9], 0), ([9, 5, 1], 0), ([9, 9], 0)]
    three = lambda **k: subqueries.nest_array(over_arrays(spark, rows), "n", (spread(it.xs),), select=it - 4, **k)
    assert {r[0]: r[1] for r in three().df.select("__key.lamport", "__b_n").collect()} == {3: [5, 5]}
    assert sorted((r["lamport"], r["stage"], r["message"]) for r in three().diagnostics().collect()) == [(1, "sub-query", "integer overflow"), (2, "sub-query", "integer overflow")]
    assert {r[0]: r[1] for r in three(limit=2).df.select("__key.lamport", "__b_n").collect()} == {2: [5, 1], 3: [5, 5]}  # the error lies beyond the limit
    wrong = three(where=it + 1)
    assert wrong.df.count() == 0 and {r["message"] for r in wrong.diagnostics().collect()} == {"Number is not a boolean"}
    scalar = subqueries.nest_array(over_arrays(spark, rows), "n", (spread(it.k),))
    assert scalar.df.count() == 0 and {r["message"] for r in scalar.diagnostics().collect()} == {"cannot spread a value of type Number"}
