"""Parts that need no session."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern import session
from quern.operators.binpack import first_fit_decreasing
from quern.operators.series import Params
from quern.plans import log_language, object_language, retention, series_language, stack_language


def naive_ffd(items, capacity):
    rooms, out = [], []
    for s in sorted(items, reverse=True):
        for i, r in enumerate(rooms):
            if r >= s:
                rooms[i] -= s
                out.append((s, i))
                break
        else:
            rooms.append(capacity - s)
            out.append((s, len(rooms) - 1))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 50).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=150))))
def test_first_fit_decreasing_is_the_naive_one(case):
    capacity, items = case
    segments, opened = first_fit_decreasing(Counter(items), capacity)
    got = sorted((s.size, s.first_bin + k // s.per_bin) for s in segments for k in range(s.per_bin * s.bins))
    assert got == naive_ffd(items, capacity)
    assert opened == len({b for _, b in got})


def test_first_fit_decreasing_edges():
    assert first_fit_decreasing({}, 5) == ([], 0)
    assert first_fit_decreasing({0: 3}, 5)[1] == 1
    with pytest.raises(ValueError):
        first_fit_decreasing({6: 1}, 5)


def test_series_language():
    q = series_language.parse(" aggregate( maximum , rollup(median_absolute_deviation, counters(a, :x=1:y=2:), 1.5m) ) ")
    assert q.how == "maximum" and q.of.lookback == 90_000_000 and q.of.of.names == ("a", ":x=1:y=2:")
    assert series_language.parse("acosh(tanh(counters(m)))").how == "acosh"
    for bad in ("", "counters()", "aggregate(nope, counters(a))", "rollup(mean, counters(a))", "time(never)", "counters(a) counters(b)", "counters(a"):
        with pytest.raises(series_language.QueryError):
            series_language.parse(bad)


def test_params():
    with pytest.raises(ValueError):
        Params(0, 10, 5).back(3)
    with pytest.raises(ValueError):
        Params(10, 10, 5)
    assert Params(100, 220, 60).steps == 2
    assert Params.rendering(1, 10_000_000, 3).step == 3_000_000


def test_log_language_normal_form():
    q = log_language.parse('{"a": [1 or 2, "x"], "b", "c": {"d": true,},}')
    assert len(log_language.conjunctions(q)) == 2
    assert ("$.a[]", log_language.Leaf("x")) in log_language.conjunctions(q)[0]
    for bad in ("{", '{"a" 1}', "or", "[1 2]", ""):
        with pytest.raises(log_language.QueryError):
            log_language.parse(bad)


def test_retention_language():
    assert retention.parse("any(versions = 2, all(ttl_micros = 5, versions = 1),)") == retention.AnyOf((retention.Versions(2), retention.AllOf((retention.Ttl(5), retention.Versions(1)))))
    for bad in ("versions = 0", "any()", "versions 2", "versions = 2 x", "ttl = 3"):
        with pytest.raises(retention.PolicyError):
            retention.parse(bad)


SCHEMA = 'table A (string id = 1) @ 1 { breakout uint64 n = 2; object o = 3 { bytes16 h = 1; }; map string m = 4 { join b = 1 on B(m); }; } table B (string id = 1) @ 2 { string body = 2; }'


def test_schema():
    schema = object_language.parse_schema(SCHEMA)
    assert object_language.describe_keys(schema)[1] == "(1:A:TableID, 1:id:string, 2:n:uint64)"
    assert object_language.compatible(schema, schema) == []
    assert object_language.describe_keys(schema)[3] == "(1:A:TableID, 1:id:string, 4:m:map<string>)"
    assert object_language.parse_schema(object_language.schema_text(schema)) == schema
    proto = object_language.protobuf_text(schema)
    assert proto.startswith('syntax = "proto2";\n\nmessage A {\n    optional string id = 1;\n    optional uint64 n = 2;\n    message O {\n') and "    map<string, MValue> m = 4;\n" in proto
    assert object_language.camel_case("some_odd__name_") == "SomeOddName"
    assert object_language.entry_of(schema, (1, 1, 2)) == ("A", "id", "n") and object_language.entry_of(schema, (1, 1, 4)) == ("A", "id", "m")
    assert [object_language.entry_of(schema, n) for n in ((), (3,), (1, 2), (1, 1, 9), (1, 1, 3, 1), (1, 1, 4, 1))] == [None] * 6
    changed = object_language.parse_schema(SCHEMA.replace("uint64 n", "string n"))
    assert object_language.compatible(schema, changed) == ["1.2: uint64 became string"]
    for bad in (SCHEMA.replace("B(m)", "C(m)"), SCHEMA.replace("n = 2", "n = 3"), SCHEMA.replace("@ 2", "@ 1"), SCHEMA.replace("string id = 1) @ 2", "fixed32 id = 1) @ 2"), "table"):
        with pytest.raises(object_language.SchemaError):
            object_language.parse_schema(bad)


def test_rewriter():
    r = stack_language.Rewriter()
    r.add_rule("SWAP $op TWICE", "$op TWICE SWAP")
    assert r.optimize("1 2 SWAP [3 +] TWICE 4 *") == stack_language.parse("1 2 [3 +] TWICE SWAP 4 *")
    r.add_rule("SWAP", "SWAP")
    assert r.optimize("SWAP") == ("SWAP",)
    with pytest.raises(stack_language.StackError):
        r.add_rule("a $x", "$y")
    with pytest.raises(stack_language.StackError):
        stack_language.parse("a ] b")


def test_a_cluster_names_its_own_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
    Session.conf = {"spark.checkpoint.dir": "hdfs://shared"}
    assert session.shared_dir(Session()) == "hdfs://shared"
