import random

import pytest

from loomspan.errors import EngineError
from loomspan.operators.mdindex import MDIndex

INDEX2 = [(2, 4, 11), (6, 6, 7), (3, 15, 9), (8, 21, 3), (8, 7, 15), (18, 7, 15), (12, 13, 9), (10, 21, 3), (9, 5, 16), (19, 5, 19), (20, 3, 6)]
TREE6 = [(5, 4), (2, 6), (13, 3), (3, 1), (10, 2), (8, 7)]
TREE7 = [(5, 23), (6, 28), (8, 24), (10, 28), (9, 26), (10, 30), (7, 22), (9, 18), (6, 24), (8, 32), (9, 20), (7, 32), (7, 27), (18, 30), (11, 22), (17, 31), (13, 28), (16, 24), (19, 26), (10, 28), (14, 27), (18, 23), (17, 22), (18, 24)]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def tree5(spark):
    return spark.createDataFrame(INDEX2, "x0 int, x1 int, x2 int")


@pytest.mark.parametrize("kind", ["KD", "R"])
def test_eq_and_range(tree5, kind):
    index = MDIndex(tree5, ["x1", "x2"], kind)
    assert rows(index.eq((4, 11))) == [(2, 4, 11)]
    assert rows(index.eq((7, 15))) == [(8, 7, 15), (18, 7, 15)]
    assert rows(index.range((7, 3), (16, 15))) == sorted(r for r in INDEX2 if 7 <= r[1] <= 16 and 3 <= r[2] <= 15)
    assert rows(index.range((4, 2), (7, 16))) == [(2, 4, 11), (6, 6, 7), (8, 7, 15), (9, 5, 16), (18, 7, 15)]
    assert rows(MDIndex(tree5, ["x0", "x1", "x2"], kind).range((18, 3, 6), (20, 7, 19))) == [(18, 7, 15), (19, 5, 19), (20, 3, 6)]
    assert rows(index.knn((7, 15), 2)) == [(8, 7, 15), (18, 7, 15)]
    assert rows(index.knn((7, 16), 3)) == [(8, 7, 15), (9, 5, 16), (18, 7, 15)]
    assert index.exists((7, 15)) and not index.exists((7, 16))
    assert index.without((7, 15)).count() == 9
    assert index.with_rows(tree5).eq((7, 15)).count() == 4


def test_columns_in_any_order(tree5):
    assert rows(MDIndex(tree5, ["x2", "x1"]).eq((15, 7))) == [(8, 7, 15), (18, 7, 15)]


@pytest.mark.parametrize(
    "point, k, expected",
    [
        ((9, 4), 1, [(10, 2)]),
        ((9, 4), 2, [(8, 7), (10, 2)]),
        ((9, 4), 3, [(5, 4), (8, 7), (10, 2)]),
        ((9, 4), 5, [(3, 1), (5, 4), (8, 7), (10, 2), (13, 3)]),
        ((5, 6), 2, [(2, 6), (5, 4)]),
        ((5, 6), 100, sorted(TREE6)),
    ],
)
def test_knn_tree6(spark, point, k, expected):
    assert rows(MDIndex(spark.createDataFrame(TREE6, "x int, y int"), ["x", "y"]).knn(point, k)) == expected


@pytest.mark.parametrize(
    "point, k, expected",
    [
        ((10, 28), 3, [(10, 28), (10, 28), (10, 30)]),
        ((7, 18), 3, [(7, 22), (9, 18), (9, 20)]),
        ((3, 25), 3, [(5, 23), (6, 24), (6, 28)]),
        ((15, 29), 2, [(13, 28), (14, 27)]),
        ((1, 2), 2, [(9, 18), (9, 20)]),
    ],
)
def test_knn_tree7(spark, point, k, expected):
    assert rows(MDIndex(spark.createDataFrame(TREE7, "x int, y int"), ["x", "y"], "R").knn(point, k)) == expected


def test_random_against_brute_force_and_batches(spark):
    rng = random.Random(4)
    data = [(i, rng.randrange(65536), rng.randrange(65536)) for i in range(400)]
    index = MDIndex(spark.createDataFrame(data, "id int, x int, y int"), ["x", "y"])
    points = [(p, rng.randrange(65536), rng.randrange(65536)) for p in range(6)]
    near = {p: sorted(data, key=lambda r: ((r[1] - x) ** 2 + (r[2] - y) ** 2, r[1], r[2], r[0]))[:5] for p, x, y in points}
    for p, x, y in points[:2]:
        assert [tuple(r) for r in index.knn((x, y), 5).collect()] == near[p]
    found = index.knn_join(spark.createDataFrame(points, "point_id int, x int, y int"), 5).orderBy("point_id", "rank").collect()
    assert [(r["point_id"], r["id"]) for r in found] == [(p, r[0]) for p in range(6) for r in near[p]]


def test_nulls_and_far_coordinates(spark):
    df = spark.createDataFrame([(None, 1), (2147483647, -2147483648), (5, 5)], "x int, y int")
    assert rows(MDIndex(df, ["x", "y"]).knn((0, 0), 5)) == [(5, 5), (2147483647, -2147483648)]


def test_layout_keeps_rows_and_prunes(spark, tmp_path):
    df = spark.range(2000).selectExpr("cast(id % 50 as int) x", "cast(id div 50 as int) y")
    index = MDIndex(df, ["x", "y"]).write_layout(str(tmp_path / "z"), 4)
    assert index.range((3, 4), (6, 9)).count() == 24
    plan = index.range((3, 4), (6, 9))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,3)" in plan


def test_refusals(tree5, spark):
    words = spark.createDataFrame([("a", 1)], "s string, n int")
    for f in (
        lambda: MDIndex(tree5, ["x1"], "R"),
        lambda: MDIndex(tree5, []),
        lambda: MDIndex(tree5, ["nope"]),
        lambda: MDIndex(tree5, ["x1"], "B"),
        lambda: MDIndex(tree5, ["x1", "x2"]).knn((1, 2), 0),
        lambda: MDIndex(tree5, ["x1", "x2"]).eq((1,)),
        lambda: MDIndex(words, ["s"]).knn(("a",), 1),
        lambda: MDIndex(words, ["s", "n"], "R"),
    ):
        with pytest.raises(EngineError):
            f()
    assert MDIndex(words, ["s"]).eq(("a",)).count() == 1


def test_knn_join_matches_brute_force(spark):
    import random

    rng = random.Random(3)
    data = [(rng.randrange(12), rng.randrange(12), rng.choice(["a", "b", None]), i) for i in range(400)] + [(None, 1, "z", 900)]
    df = spark.createDataFrame(data, "x int, y int, s string, i int").repartition(5)
    points = [(p, rng.randrange(-3, 15), rng.randrange(-3, 15)) for p in range(25)] + [(99, None, 3)]
    given = spark.createDataFrame(points, "point_id int, x int, y int")
    expected = []
    for p, px, py in points:
        if px is None:
            continue
        near = sorted(((x - px) ** 2 + (y - py) ** 2, x, y, s is not None, s or "", i) for x, y, s, i in data if x is not None)[:7]
        expected += [(p, r + 1, d, x, y, i) for r, (d, x, y, _, _, i) in enumerate(near)]
    for bound in (10_000, 4):
        found = MDIndex(df, ["x", "y"]).knn_join(given, 7, bound=bound).select("point_id", "rank", "d2", "x", "y", "i")
        assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert MDIndex(df, ["x", "y"]).knn_join(given.where("false"), 3).count() == 0
    assert MDIndex(df.where("false"), ["x", "y"]).knn_join(given, 3).count() == 0
    halves = df.selectExpr("x / 2.0d as x", "i")
    assert MDIndex(halves, ["x"]).knn_join(spark.createDataFrame([(1, 0.25)], "point_id int, x double"), 1).first()["d2"] == 0.0625
