import pytest

from loomspan.engine import Engine
from loomspan.errors import EngineError
from loomspan.plans.sql import run_select
from loomspan.schema import parse_create_table
from loomspan.sources import generator


@pytest.fixture
def lookup(spark):
    tables = {
        "a": spark.createDataFrame([(1, 2), (3, 4), (5, 6), (7, 8)], "a1 int, a2 int"),
        "b": spark.createDataFrame([(1, 1, 3, "E"), (2, 1, 3, "G"), (3, 1, 4, "A"), (4, 2, 4, "G"), (5, 2, 5, "G"), (6, 2, 5, "G")], "c1 int, c2 int, c3 int, c4 string"),
        "c": spark.createDataFrame([(1, 2, 3), (2, 3, 4), (3, 4, 5), (4, 5, 6), (5, 6, 7)], "c1 int, c2 int, c3 int"),
    }

    def get(name):
        if name not in tables:
            raise EngineError(f"Missing table {name}")
        return tables[name]

    return get


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(
    "sql, expected",
    [
        ("select * from c where c1 = 3", [(3, 4, 5)]),
        ("select * from c where 3 > c.c1", [(1, 2, 3), (2, 3, 4)]),
        ("select * from b where c4 = 'A'", [(3, 1, 4, "A")]),
        ("select c2, count(c1), sum(c1) from b group by c2", [(1, 3, 6), (2, 3, 15)]),
        ("select avg(b.c1) as m from b", [(3,)]),
        ("select a1, c2 from a join c on a.a1 = c.c2", [(3, 2 + 1), (5, 5)]),
        ("select a1, c2 from a join c on c.c2 = a.a1", [(3, 3), (5, 5)]),
        ("select a.a1, c.c1, b.c1 from a join c on a.a1 = c.c1 join b on b.c1 = c.c1", [(1, 1, 1), (3, 3, 3), (5, 5, 5)]),
        ("select x.c1 as l, y.c1 as r from c as x join c as y on x.c1 = y.c2", [(2, 1), (3, 2), (4, 3), (5, 4)]),
        ("select a1 from a join c on a1 < c1 where c2 = 6", [(1,), (3,)]),
        ("select c1 from c where (c1 > 1 and c1 < 4) or c3 = 7", [(2,), (3,), (5,)]),
        ("select c2 from b group by c2", [(1,), (2,)]),
        ("select c1 from c where c1 > -1 and c1 <> 2 and c1 <= 3", [(1,), (3,)]),
    ],
)
def test_selects(lookup, sql, expected):
    assert rows(run_select(sql, lookup)) == expected


def test_output_names(lookup):
    assert run_select("select c2, sum(c1), max(c4) as top from b group by c2", lookup).columns == ["c2", "sum_c1", "top"]


@pytest.mark.parametrize(
    "sql",
    [
        "select distinct a1 from a", "select a1 from a order by a1", "select a1 from a limit 1", "select a1 from a union select a1 from a",
        "select count(*) from a", "select count(distinct a1) from a", "select sum(c4) from b", "select upper(c4) from b", "select a1 + 1 from a",
        "select a1 from a, c", "select a1 from a left join c on a1 = c1", "select a1 from a cross join c", "select c1 from b join c on b.c1 = c.c1",
        "select nope from a", "select a1 from nope", "select a1, count(a2) from a", "select a1 from a where sum(a1) > 1", "select a1 from a where a1 in (1)",
        "select a1 from a where a1 = 'x'", "select a1 from a having a1 > 1", "select * from (select a1 from a)", "with t as (select 1) select * from t",
        "insert into a values (1, 2)", "select a.* from a", "select *, a1 from a", "select x.y.z from a", "select a1 from a; select a1 from a", "", "select sum(a1) over (a2) from a",
        "select a1 from a join c on a1 = c1 and a2 = c2", "select a1 from a where not a1 = 1",
    ],
)
def test_refused(lookup, sql):
    with pytest.raises(EngineError):
        run_select(sql, lookup)


def test_create_table_rules():
    assert parse_create_table("create table t (a int primary key, b varchar(9))").primary_key == ["a"]
    assert parse_create_table("create table t (a int, b int, primary key (a, b))").primary_key == ["a", "b"]
    for bad in (
        "create table t (a int)", "create table t (a int primary key, b int primary key)", "create table t (a int, primary key (a), primary key (a))",
        "create table t (a int primary key, primary key (a))", "create table t (a bigint primary key)", "create table x.t (a int primary key)", "create table t (a int primary key, a int)",
    ):
        with pytest.raises(EngineError):
            parse_create_table(bad)


@pytest.fixture
def engine(spark):
    Engine(spark).reset()  # what an earlier run left in the warehouse
    made = Engine(spark)
    made.run("\\r loomspan_test")
    made.run("\\c loomspan_test")
    yield made
    made.reset()


def test_script_end_to_end(engine, tmp_path):
    data = tmp_path / "index2.csv"
    data.write_bytes(b"\xef\xbb\xbf2,4,11\r\n6,6,7\r\n8,7,15\r\n18,7,15\r\n9,5,16\r\n")
    out = engine.script(
        f"create table test (a int primary key, b int, c int); \\i {data} test; \\dt; \\createIndex R ind test (b,c);"
        " \\useIndex R EQ ind test (7,15)"
    )
    assert out[2] == "test" and sorted(out[4].split("\n")) == ["18,7,15", "8,7,15"]
    assert sorted(engine.run("\\useIndex R RANGE ind test (4,2);(7,11)").split("\n")) == ["2,4,11", "6,6,7"]
    assert engine.run("\\useIndex R KNN ind test (7,16) 1") == "8,7,15"
    assert engine.run("select max(b), count(a) from test") == "7,5"
    engine.import_csv(str(data), "test")
    assert engine.run("select count(test.a) from test") == "10" and engine.version == 2
    assert "loomspan_test" in engine.run("\\l")
    with pytest.raises(EngineError):
        engine.run("create table test (a int primary key)")
    with pytest.raises(EngineError):
        engine.run("\\r loomspan_test")
    with pytest.raises(EngineError):
        engine.run("\\nope")
    engine.delete("test", "a = 2")
    engine.update("test", "b", "b + 1", "a = 6")
    assert engine.run("select sum(b) from test where a = 6") == "14"
    assert engine.run("select count(a) from test") == "8"


def test_csv_strings_and_malformed_rows(engine, tmp_path):
    (tmp_path / "s.csv").write_text('1,,x\n2,"q,r",y\n')
    engine.run("create table s (a int primary key, b varchar(5))")
    engine.run(f"\\i {tmp_path}/s.csv s")
    assert sorted(engine.run("select * from s").split("\n")) == ["1,", "2,q,r"]
    (tmp_path / "bad.csv").write_text("3,ok\nx,bad\n")
    with pytest.raises(Exception, match="Malformed record"):
        engine.import_csv(f"{tmp_path}/bad.csv", "s")
    assert engine.run("select count(a) from s") == "2"
    engine.import_csv(f"{tmp_path}/bad.csv", "s", skip_malformed=True)
    assert engine.run("select count(a) from s") == "3"


def test_saved_queries(engine, tmp_path):
    engine.run("create table t (a int primary key, b int)")
    engine.insert("t", [(1, 2), (1, 3)])
    plan = tmp_path / "q.json"
    engine.run(f"\\convert {plan} | select a, sum(b) from t group by a")
    engine.run(f"\\register {plan} q1")
    assert "q1" in engine.run("\\dq")
    engine.run("\\runFull q1 cache 7")
    assert engine.saved.queries["q1"].watermark == 7
    engine.saved.begin("q1")
    with pytest.raises(EngineError):
        engine.run("\\runFull q1")
    with pytest.raises(EngineError):
        engine.reset()
    engine.saved.finish("q1", None)
    with pytest.raises(EngineError):
        engine.run(f"\\register {plan} q1")


def test_generator(spark, engine, tmp_path):
    df = generator.generate(spark, 5000)
    assert df.columns == ["id", "ia1", "ia2", "ia3", "ia4", "sa1", "sa2", "sa3", "sa4"]
    assert df.select("ia1").distinct().count() == 10 and df.select("sa2").distinct().count() == 100
    assert df.selectExpr("min(length(sa1)) >= 10 and max(length(sa4)) <= 29").first()[0]
    engine.run(f"\\generate {tmp_path}/g 20")
    with pytest.raises(EngineError):
        engine.run(f"\\generate {tmp_path}/g 20")
    assert generator.random_ints(spark, 2, 10).where("f0 < 0").count() == 0


def test_short_and_long_records(engine, tmp_path):
    engine.run("create table s (a int primary key, b varchar(9), c varchar(9))")
    (tmp_path / "ok.csv").write_text('1,,\n2,x,y,z,more\n3,"q,r",\n4,"",""\n')
    engine.import_csv(f"{tmp_path}/ok.csv", "s")
    assert sorted(engine.run("select * from s").split("\n")) == ["1,,", "2,x,y", "3,q,r,", "4,,"]
    (tmp_path / "short.csv").write_text('5,a,b\n6\n7,x\n8,"a,b"\nx,a,b\n')
    with pytest.raises(Exception, match="Malformed record"):
        engine.import_csv(f"{tmp_path}/short.csv", "s")
    engine.import_csv(f"{tmp_path}/short.csv", "s", skip_malformed=True)
    assert sorted(engine.run("select a from s where a > 4").split("\n")) == ["5"]


def test_state_outlives_the_engine(engine, spark, tmp_path):
    engine.run("create table t (a int primary key, b int)")
    engine.insert("t", [(1, 2), (3, 4)])
    engine.run("\\createIndex KD ind t (a,b)")
    engine.run(f"\\convert {tmp_path}/q.json | select a from t")
    engine.run(f"\\register {tmp_path}/q.json q")
    engine.run("\\runFull q")
    spark.sql("drop table if exists loomspan_gone")
    again = Engine(spark)
    again.run("\\c loomspan_test")
    assert again.version == engine.version == 1 and again.saved.queries["q"].watermark == 1
    assert again.run("\\useIndex KD EQ ind t (3,4)") == "3,4"
    again.insert("t", [(5, 6)])
    assert again.run("\\runPartial q") == "5" and again.run("\\runPartial q cache 0 1") in ("1\n3", "3\n1")
    assert again.run("\\runPartial q") == ""
    again.run("\\close")
    assert spark.catalog.currentDatabase() == "default"
    again.reset()
    assert not spark.catalog.databaseExists("loomspan_test") and Engine(spark).version == 0
    engine.made = []


def test_forgotten_tables_are_declared_again(engine, spark):
    from loomspan.plans.state import warehouse

    engine.run("create table f (a int primary key, b varchar(3))")
    engine.insert("f", [(1, "x")])
    schema = spark.table("f").schema
    path = f"{warehouse(spark)}/loomspan_test.db/f"
    rows = spark.table("f").collect()
    spark.sql("drop table f")
    spark.createDataFrame(rows, schema).write.parquet(path)
    again = Engine(spark)
    again.run("\\c loomspan_test")
    assert again.run("select * from f") == "1,x"


def test_views_and_updates(engine):
    engine.run("create table t (a int primary key, b int)")
    engine.insert("t", [(1, 2), (1, 3), (2, 5)])
    engine.materialize("v", "select a, sum(b) as s from t group by a")
    assert engine.outdated() == [] and not engine.refresh("v")
    engine.update("t", "b", "b * 10", "a = 2")
    engine.delete("t", "b = 3")
    assert engine.outdated() == ["v"] and engine.refresh("v") and engine.outdated() == []
    assert sorted(engine.run("select * from v").split("\n")) == ["1,2", "2,50"]
    assert engine.table("t").schema["a"].metadata["constraint"] == "PrimaryKey"
    with pytest.raises(EngineError):
        engine.refresh("t")


def test_names_that_look_joined_do_not_collide(spark):
    one = spark.createDataFrame([(1, 2)], "b__c int, k int")
    two = spark.createDataFrame([(3, 2)], "c int, k int")
    get = {"a": one, "a__b": two}.__getitem__
    assert rows(run_select("select b__c, c from a join a__b on a.k = a__b.k", get)) == [(1, 3)]
    with pytest.raises(EngineError):
        run_select("select c from a where 1 = 1", get)
