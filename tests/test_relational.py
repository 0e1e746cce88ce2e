import pytest

from loomspan.errors import EngineError
from loomspan.functions.aggregates import int_avg
from loomspan.operators import relational as rel

AGG6 = [(1, 1, 3, "E"), (2, 1, 3, "G"), (3, 1, 4, "A"), (4, 2, 4, "G"), (5, 2, 5, "G"), (6, 2, 5, "G")]
LEFT4 = [(1, 2), (3, 4), (5, 6), (7, 8)]
RIGHT5 = [(1, 2, 3), (2, 3, 4), (3, 4, 5), (4, 5, 6), (5, 6, 7)]


@pytest.fixture
def agg6(spark):
    return spark.createDataFrame(AGG6, "c1 int, c2 int, c3 int, c4 string")


@pytest.fixture
def pair(spark):
    return spark.createDataFrame(LEFT4, "a1 int, a2 int"), spark.createDataFrame(RIGHT5, "b1 int, b2 int, b3 int")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_scalar_aggregates(agg6):
    df = rel.aggregate(agg6, [], [(f, "c1", f) for f in ("count", "sum", "max", "min", "avg")])
    assert rows(df) == [(6, 21, 6, 1, 3)]
    df = rel.aggregate(agg6, [], [("count", "c4", "n"), ("max", "c4", "hi"), ("min", "c4", "lo"), ("sum", "c2", "s")])
    assert rows(df) == [(6, "G", "A", 9)]


def test_grouped_aggregates(agg6):
    df = rel.aggregate(agg6, ["c2", "c3"], [("count", "c4", "n"), ("max", "c1", "hi")])
    assert rows(df) == [(1, 3, 2, 2), (1, 4, 1, 3), (2, 4, 1, 4), (2, 5, 2, 6)]
    assert len(rows(rel.aggregate(agg6, ["c3"], [("count", "c1", "n")]))) == 3
    assert rows(rel.aggregate(agg6, ["c2"], [("count", "c1", "n"), ("sum", "c1", "s")])) == [(1, 3, 6), (2, 3, 15)]
    assert rows(rel.aggregate(agg6, ["c2"], [])) == [(1,), (2,)]


def test_aggregates_refuse_strings_and_unknown_functions(agg6):
    for f in ("sum", "avg"):
        with pytest.raises(EngineError):
            rel.aggregate(agg6, [], [(f, "c4", "v")])
    with pytest.raises(EngineError):
        rel.aggregate(agg6, [], [("median", "c1", "v")])


def test_aggregate_over_no_rows(agg6):
    df = rel.aggregate(agg6.where("c1 > 100"), [], [("count", "c1", "n"), ("sum", "c1", "s"), ("avg", "c1", "m"), ("max", "c4", "hi")])
    assert rows(df) == [(0, None, None, None)]


def test_aggregate_twice_gives_the_same(agg6):
    df = rel.aggregate(agg6, ["c2"], [("sum", "c1", "s")])
    assert rows(df) == rows(df)


def test_string_min_and_max_are_plain(spark):
    df = spark.createDataFrame([("b",), ("a",), ("7",)], "s string")
    assert rows(rel.aggregate(df, [], [("min", "s", "lo"), ("max", "s", "hi")])) == [("7", "b")]


def test_int_avg_truncates_toward_zero(spark):
    assert spark.createDataFrame([(-7,), (0,)], "a int").agg(int_avg("a")).first()[0] == -3


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
def test_joins_match_nested_loops(pair, op):
    left, right = pair
    expected = sorted(a + b for a in LEFT4 for b in RIGHT5 if rel.COMPARE[op](a[0], b[0]))
    assert rows(rel.join(left, right, ("a1", op, "b1"))) == expected


def test_join_on_different_ordinals(pair):
    left, right = pair
    assert rows(rel.join(left, right, ("a1", "=", "b2"))) == [(3, 4, 2, 3, 4), (5, 6, 4, 5, 6)]


def test_join_counts_of_the_fixture(pair):
    left, right = pair
    assert [rel.join(left, right, ("a1", op, "b1")).count() for op in (">", "<", "<=")] == [11, 6, 9]


@pytest.mark.parametrize("hint, node", [("broadcast", "BroadcastHashJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin")])
def test_join_hints(pair, hint, node):
    left, right = pair
    df = rel.join(left, right, ("a1", "=", "b1"), hint)
    assert node in df._jdf.queryExecution().executedPlan().toString()
    assert rows(df) == [(1, 2, 1, 2, 3), (3, 4, 3, 4, 5), (5, 6, 5, 6, 7)]


def test_filters(pair, agg6):
    _, right = pair
    assert rows(rel.filter_compare(right, "b1", "=", 3)) == [(3, 4, 5)]
    assert rows(rel.filter_compare(right, "b1", rel.FLIPPED[">"], 3)) == [(1, 2, 3), (2, 3, 4)]
    assert rows(rel.filter_compare(agg6, "c4", "=", "A")) == [(3, 1, 4, "A")]
    assert rel.filter_all(right).count() == 5
    with pytest.raises(EngineError):
        rel.filter_compare(agg6, "c4", "=", 1)


def test_filter_and_columns_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = rel.project(rel.filter_compare(df, "l_linenumber", ">", 3), ["l_orderkey"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_linenumber,3)" in plan and "l_comment" not in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan
