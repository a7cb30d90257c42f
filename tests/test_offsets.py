"""Offset maps, retention units, tag expressions: rules that need no table."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstream.operators import tags as S
from loomstream.operators.frame import EventFrame
from loomstream.operators.offsets import OffsetMap
from loomstream.operators.writing import bytes_of, seconds_of
from loomstream.sources.events import user_events

maps = st.dictionaries(st.tuples(st.sampled_from("abc"), st.integers(0, 2)), st.integers(0, 9), max_size=5).map(OffsetMap)


def events_of(m: OffsetMap) -> set:
    return {(stream, k) for stream in ((n, s) for n in "abc" for s in range(3)) for k in range(m.offset(stream) + 1)}


@settings(max_examples=60, deadline=None)
@given(maps, maps)
def test_offset_maps_are_sets_of_events(a, b):
    x, y = events_of(a), events_of(b)
    assert events_of(a | b) == x | y and events_of(a & b) == x & y
    assert a - b == len(x - y) and a.size == len(x)
    assert a.compare(b) == (0 if x == y else -1 if x < y else 1 if x > y else None)
    assert (a <= b) == (x <= y)


@settings(max_examples=40, deadline=None)
@given(maps, st.sampled_from("abc"), st.integers(0, 2), st.integers(0, 9))
def test_including_and_excluding(m, node, nr, offset):
    stream = (node, nr)
    assert m.including(stream, offset).contains(stream, offset)
    assert not m.excluding(stream, offset).contains(stream, offset)


def test_unknown_streams_hold_nothing():
    assert not OffsetMap({}).contains(("a", 0), 0) and OffsetMap({}).offset(("a", 0)) == -1


def test_units_of_retention():
    assert bytes_of("2MB") == 2_000_000 and bytes_of("2MiB") == 2 << 20
    assert seconds_of("3d") == 3 * 86400
    for wrong in ("3", "d", "3 parsecs"):
        with pytest.raises(ValueError):
            seconds_of(wrong)


def test_selections_are_reduced():
    x, y = S.tag("x"), S.tag("y")
    assert str(x | x & y) == str(x)
    assert str(x & (y | x)) == str(x)


def test_bad_tags_are_refused():
    with pytest.raises(ValueError):
        S.tag("")


def test_places_need_no_window_over_all(spark, monkeypatch):
    import random

    from loomstream.operators import offsets

    monkeypatch.setattr(offsets, "STEP", 4)
    r = random.Random(1)
    rows = [(g, n, r.randrange(9)) for g in "ab" for n in r.sample(range(2_000), 300)]
    table = spark.createDataFrame(rows, "g string, n bigint, x int").repartition(5)
    for down in (False, True):
        got = {(x["g"], x["n"]): x["__at"] for x in offsets.placed(table, "n", by=("g",), descending=down).collect()}
        for g in "ab":
            own = sorted((n for h, n, _ in rows if h == g), reverse=down)
            assert [got[g, n] for n in own] == list(range(300))


def test_selections_reach_the_scan(spark, capsys):
    from loomstream.plans import queries as plans

    for name, pushed in (("scan_tag", "EqualTo(event_type,purchase)"), ("scan_key", "GreaterThanOrEqual(event_id,499)"), ("scan_app", "EqualTo(event_type,error)")):
        plans.Q[name](spark, "/root/testdata/sf0.001").explain("formatted")
        assert pushed in capsys.readouterr().out.split("PushedFilters")[1].split("ReadSchema")[0]


def test_of_one_key_the_older_event_stays(spark):
    from loomstream.operators.offsets import merged

    kind = "lamport bigint, node string, stream_nr bigint, offset bigint, ts timestamp, x int"
    a = spark.createDataFrame([(1, "n", 0, 0, None, 1), (2, "n", 0, 1, None, 2)], kind)
    b = spark.createDataFrame([(2, "n", 0, 1, None, 3), (3, "n", 0, 2, None, 4)], kind)
    assert sorted(r["x"] for r in merged(a, b).collect()) == [1, 2, 4]


def test_own_application_and_last_line(spark):
    with pytest.raises(ValueError):
        S.own_app.predicate()
    assert str(S.own_app) == "appId(me)" and str((S.own_app | S.tag("x")).called_by("a.b")) == "appId(a.b) | 'x'"
    assert (S.own_app & S.app_id("a")).called_by("b").alternatives == ()
    known = user_events(spark, "/root/testdata/sf0.001", offsets=True)
    nothing = EventFrame.of(known.limit(0)).response(known.limit(0)).collect()
    assert [json.loads(r["line"]) for r in nothing] == [{"type": "offsets", "offsets": {}}]
    last = EventFrame.of(known.limit(0)).response(known).collect()
    assert len(last) == 1 and sum(n + 1 for n in json.loads(last[0]["line"])["offsets"].values()) == known.count()
