"""Registered queries of the relational and index operators, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.errors import EngineError
from loomspan.functions.zorder import z_layout
from loomspan.operators import changes
from loomspan.operators import relational as rel
from loomspan.operators.mdindex import MDIndex
from loomspan.plans.sql import run_select
from loomspan.session import table
from loomspan.sources import csv_io, generator
from loomspan.streaming.incremental import new_since

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


@query(
    "join_filter_groupby",
    """select o_orderpriority, cast(count(l_linenumber) as bigint) as n_lines,
       cast(sum(l_linenumber) as bigint) as sum_line, min(l_quantity) as min_qty, max(l_quantity) as max_qty,
       cast(sum(l_linenumber) // count(l_linenumber) as bigint) as int_avg_line
       from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 25 group by o_orderpriority""",
)
def join_filter_groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = rel.filter_compare(table(spark, sf_dir, "lineitem"), "l_quantity", ">", 25)
    joined = rel.join(lines, table(spark, sf_dir, "orders"), ("l_orderkey", "=", "o_orderkey"))
    return rel.aggregate(
        joined,
        ["o_orderpriority"],
        [
            ("count", "l_linenumber", "n_lines"),
            ("sum", "l_linenumber", "sum_line"),
            ("min", "l_quantity", "min_qty"),
            ("max", "l_quantity", "max_qty"),
            ("avg", "l_linenumber", "int_avg_line"),
        ],
    )


def _simple(name: str, sql: str, f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(lambda t: table(spark, sf_dir, t))
    ORACLE_SQL[name] = sql


_simple("scan_nation", "select * from nation", lambda t: t("nation"))
_simple(
    "project_alias",
    "select c_custkey as id, c_name as nm from customer",
    lambda t: rel.project(t("customer"), [("c_custkey", "id"), ("c_name", "nm")]),
)
for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _simple(f"filter_{_name}", f"select * from part where p_size {_op} 25", lambda t, op=_op: rel.filter_compare(t("part"), "p_size", op, 25))
_simple("filter_literal_left", "select * from part where 10 > p_size", lambda t: run_select("select * from part where 10 > p_size", t))
_simple(
    "filter_string",
    "select * from customer where c_mktsegment = 'BUILDING'",
    lambda t: rel.filter_compare(t("customer"), "c_mktsegment", "=", "BUILDING"),
)
_simple("filter_string_order", "select * from nation where n_name >= 'M'", lambda t: rel.filter_compare(t("nation"), "n_name", ">=", "M"))
_simple("filter_true", "select * from region", lambda t: rel.filter_all(t("region")))
_simple(
    "filter_and",
    "select p_partkey, p_size from part where p_size > 10 and p_size <= 20 and p_partkey < 1000",
    lambda t: run_select("select p_partkey, p_size from part where p_size > 10 and p_size <= 20 and p_partkey < 1000", t),
)
_simple(
    "filter_or",
    "select p_partkey, p_size from part where p_size = 1 or p_size = 50 or (p_size > 20 and p_partkey < 50)",
    lambda t: run_select("select p_partkey, p_size from part where p_size = 1 or p_size = 50 or (p_size > 20 and p_partkey < 50)", t),
)
_JOIN = "select o_orderkey, l_linenumber, o_totalprice, l_quantity from orders join lineitem on {} where o_totalprice > 100000"


def _orders_lines(t: Callable[[str], DataFrame], hint: str | None = None, reverse: bool = False) -> DataFrame:
    left, right, on = t("orders"), t("lineitem"), ("o_orderkey", "=", "l_orderkey")
    if reverse:
        left, right, on = right, left, ("l_orderkey", "=", "o_orderkey")
    return rel.join(left, right, on, hint).where("o_totalprice > 100000").select("o_orderkey", "l_linenumber", "o_totalprice", "l_quantity")


_simple("join_equi", _JOIN.format("o_orderkey = l_orderkey"), _orders_lines)
_simple("join_equi_reversed", _JOIN.format("l_orderkey = o_orderkey"), lambda t: _orders_lines(t, reverse=True))
for _hint, _name in (("broadcast", "join_broadcast"), ("shuffle_hash", "join_shuffle_hash"), ("merge", "join_sort_merge")):
    _simple(
        _name,
        "select n_name, r_name from nation join region on n_regionkey = r_regionkey",
        lambda t, h=_hint: rel.join(t("nation"), t("region"), ("n_regionkey", "=", "r_regionkey"), h).select("n_name", "r_name"),
    )
_simple(
    "join_diff_ordinals",
    "select n_nationkey, n_name, c_custkey from nation join customer on n_nationkey = c_nationkey",
    lambda t: rel.join(t("nation"), t("customer"), ("n_nationkey", "=", "c_nationkey")).select("n_nationkey", "n_name", "c_custkey"),
)
for _name, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("ne", "<>")):
    _simple(
        f"join_theta_{_name}",
        f"select n_nationkey, r_regionkey from nation join region on n_regionkey {_op} r_regionkey",
        lambda t, op=_op: rel.join(t("nation"), t("region"), ("n_regionkey", op, "r_regionkey")).select("n_nationkey", "r_regionkey"),
    )
_simple(
    "join_three_way",
    "select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    lambda t: rel.join(rel.join(t("customer"), t("nation"), ("c_nationkey", "=", "n_nationkey")), t("region"), ("n_regionkey", "=", "r_regionkey")).select("c_custkey", "n_name", "r_name"),
)
_simple(
    "join_self",
    "select a.n_nationkey as left_key, b.n_nationkey as right_key from nation a join nation b on a.n_regionkey = b.n_regionkey",
    lambda t: rel.join(
        rel.project(t("nation"), [("n_nationkey", "left_key"), ("n_regionkey", "left_region")]),
        rel.project(t("nation"), [("n_nationkey", "right_key"), ("n_regionkey", "right_region")]),
        ("left_region", "=", "right_region"),
    ).select("left_key", "right_key"),
)
_ONE = {"count": "cast(count(p_size) as bigint)", "sum": "cast(sum(p_size) as bigint)", "min": "min(p_size)", "max": "max(p_size)", "avg": "cast(sum(p_size) // count(p_size) as bigint)"}
for _name, _sql in _ONE.items():
    _simple(f"agg_{'int_avg' if _name == 'avg' else _name}", f"select {_sql} as v from part", lambda t, n=_name: rel.aggregate(t("part"), [], [(n, "p_size", "v")]))
_simple(
    "agg_string_minmax",
    "select min(n_name) as lo, max(n_name) as hi, cast(count(n_name) as bigint) as n from nation",
    lambda t: rel.aggregate(t("nation"), [], [("min", "n_name", "lo"), ("max", "n_name", "hi"), ("count", "n_name", "n")]),
)
_simple(
    "agg_empty_input",
    "select cast(count(p_size) as bigint) as n, cast(sum(p_size) as bigint) as s, max(p_size) as hi from part where p_size < 0",
    lambda t: rel.aggregate(t("part").where("p_size < 0"), [], [("count", "p_size", "n"), ("sum", "p_size", "s"), ("max", "p_size", "hi")]),
)
_simple(
    "agg_negative_int_avg",
    "select cast(sum(-p_size) // count(p_size) as bigint) as v from part",
    lambda t: rel.aggregate(t("part").select((-F.col("p_size")).alias("m")), [], [("avg", "m", "v")]),
)
_simple(
    "groupby_one",
    "select c_mktsegment, cast(count(c_custkey) as bigint) as n from customer group by c_mktsegment",
    lambda t: rel.aggregate(t("customer"), ["c_mktsegment"], [("count", "c_custkey", "n")]),
)
_simple(
    "groupby_multi",
    "select l_returnflag, l_linestatus, cast(count(l_orderkey) as bigint) as n from lineitem group by l_returnflag, l_linestatus",
    lambda t: rel.aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"], [("count", "l_orderkey", "n")]),
)
_simple(
    "groupby_multi_aggs",
    """select l_returnflag, cast(count(l_linenumber) as bigint) as n, cast(sum(l_linenumber) as bigint) as s, min(l_shipdate) as lo,
       max(l_quantity) as hi, cast(sum(l_linenumber) // count(l_linenumber) as bigint) as m from lineitem group by l_returnflag""",
    lambda t: rel.aggregate(
        t("lineitem"),
        ["l_returnflag"],
        [("count", "l_linenumber", "n"), ("sum", "l_linenumber", "s"), ("min", "l_shipdate", "lo"), ("max", "l_quantity", "hi"), ("avg", "l_linenumber", "m")],
    ),
)
_simple("groupby_keys_only", "select distinct o_orderstatus, o_orderpriority from orders", lambda t: rel.aggregate(t("orders"), ["o_orderstatus", "o_orderpriority"], []))
_P3 = ["l_linenumber", "l_partkey", "l_suppkey"]
_L = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _lines(t: Callable[[str], DataFrame]) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


_AT = "select p_size, p_partkey from part where p_partkey = 1"


def _at(t: Callable[[str], DataFrame]) -> tuple[int, int]:
    """The point of the first part: one row comes to the driver."""
    return tuple(t("part").where("p_partkey = 1").select("p_size", "p_partkey").first())


_simple("md_eq_2d", f"select * from part where (p_size, p_partkey) in ({_AT})", lambda t: MDIndex(t("part"), ["p_size", "p_partkey"]).eq(_at(t)))
_simple("md_eq_r", f"select * from part where (p_size, p_partkey) in ({_AT})", lambda t: MDIndex(t("part"), ["p_partkey", "p_size"], "R").eq(_at(t)[::-1]))
_simple("md_eq_string", "select * from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3", lambda t: MDIndex(t("customer"), ["c_mktsegment", "c_nationkey"]).eq(("BUILDING", 3)))
_simple(
    "md_range_string",
    "select * from customer where c_mktsegment between 'B' and 'H' and c_nationkey between 3 and 9",
    lambda t: MDIndex(t("customer"), ["c_mktsegment", "c_nationkey"]).range(("B", 3), ("H", 9)),
)
_simple(
    "md_with_rows",
    "select * from nation where n_nationkey between 2 and 30 union all select n_nationkey + 20, n_name, n_regionkey from nation where n_nationkey + 20 between 2 and 30",
    lambda t: MDIndex(t("nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])
    .with_rows(t("nation").select((F.col("n_nationkey") + 20).cast("int").alias("n_nationkey"), "n_name", "n_regionkey"))
    .range((2,), (30,)),
)
_simple(
    "md_layout",
    "select p_partkey, p_size from part where p_size between 10 and 20 and p_partkey between 50 and 900",
    lambda t: MDIndex(z_layout(t("part").select("p_partkey", "p_size"), ["p_size", "p_partkey"], 8), ["p_size", "p_partkey"]).range((10, 50), (20, 900)),
)
_simple("md_eq_dups", "select * from part where p_size = 7", lambda t: MDIndex(t("part"), ["p_size"]).eq((7,)))
_simple(
    "md_range_2d",
    "select * from part where p_size between 10 and 20 and p_partkey between 50 and 900",
    lambda t: MDIndex(t("part"), ["p_size", "p_partkey"]).range((10, 50), (20, 900)),
)
_simple(
    "md_range_3d",
    f"select {_L} from lineitem where l_linenumber between 2 and 4 and l_partkey between 100 and 600 and l_suppkey between 5 and 50",
    lambda t: MDIndex(_lines(t), _P3, "R").range((2, 100, 5), (4, 600, 50)),
)
_simple(
    "md_knn_2d",
    "select p_partkey, p_size from part order by (p_size - 25) * (p_size - 25) + (p_partkey - 500) * (p_partkey - 500), p_size, p_partkey limit 10",
    lambda t: MDIndex(t("part").select("p_partkey", "p_size"), ["p_size", "p_partkey"]).knn((25, 500), 10),
)
_simple(
    "md_knn_3d",
    f"""select {_L} from lineitem order by (l_linenumber - 3) * (l_linenumber - 3) + (l_partkey - 300) * (l_partkey - 300) + (l_suppkey - 20) * (l_suppkey - 20),
        l_linenumber, l_partkey, l_suppkey, l_orderkey limit 5""",
    lambda t: MDIndex(_lines(t), _P3, "R").knn((3, 300, 20), 5),
)
_simple("md_knn_k_gt_n", "select * from region", lambda t: MDIndex(t("region"), ["r_regionkey"]).knn((2,), 1000))
_simple(
    "md_knn_join",
    """select point_id, cast(rank as int) as rank, d2, p_partkey, p_size from (
         select s_suppkey as point_id, p_partkey, p_size, cast((p_size - s_nationkey) * (p_size - s_nationkey) + (p_partkey - s_suppkey) * (p_partkey - s_suppkey) as bigint) as d2,
         row_number() over (partition by s_suppkey order by (p_size - s_nationkey) * (p_size - s_nationkey) + (p_partkey - s_suppkey) * (p_partkey - s_suppkey), p_size, p_partkey) as rank
         from supplier cross join part) where rank <= 3""",
    lambda t: MDIndex(t("part").select("p_partkey", "p_size"), ["p_size", "p_partkey"]).knn_join(
        t("supplier").select(F.col("s_suppkey").alias("point_id"), F.col("s_nationkey").alias("p_size"), F.col("s_suppkey").alias("p_partkey")), 3
    ),
)
_simple(
    "md_exists",
    f"select (select count(*) > 0 from part where (p_size, p_partkey) in ({_AT})) as there, (select count(*) > 0 from part where p_size = -7 and p_partkey = 1) as missing",
    lambda t: t("part").sparkSession.createDataFrame(
        [(MDIndex(t("part"), ["p_size", "p_partkey"]).exists(_at(t)), MDIndex(t("part"), ["p_size", "p_partkey"]).exists((-7, 1)))], "there boolean, missing boolean"
    ),
)
_simple("rows_deleted", "select * from part where not (p_size > 10 and p_partkey < 1000)", lambda t: rel.delete(t("part"), "p_size > 10 and p_partkey < 1000"))
_simple(
    "rows_updated",
    "select n_nationkey, n_name, case when n_regionkey = 1 then n_regionkey + 10 else n_regionkey end as n_regionkey from nation",
    lambda t: rel.update(t("nation").select("n_nationkey", "n_name", "n_regionkey"), "n_regionkey", "n_regionkey + 10", "n_regionkey = 1"),
)
_simple("in_memory_rows", "select * from (values (1, 'x'), (2, '')) as v(a, b)", lambda t: csv_io.from_rows(t("region").sparkSession, [(1, "x"), (2, "")], "a int, b string"))
_simple("md_without", "select * from part where not (p_size = 7)", lambda t: MDIndex(t("part"), ["p_size"]).without((7,)))


def _log(t: Callable[[str], DataFrame]) -> DataFrame:
    op = F.when(F.col("event_id") % 7 == 0, "D").otherwise("U").alias("op")
    return t("events").select("user_id", F.col("event_id").alias("ts"), op, "event_type")


_LOG = "(select user_id, event_id as ts, case when event_id % 7 = 0 then 'D' else 'U' end as op, event_type from events)"
_LAST = "row_number() over (partition by user_id order by ts desc) = 1"
_simple(
    "changes_as_of",
    f"select user_id, ts, event_type from {_LOG} where ts <= 800 qualify {_LAST} and op <> 'D'",
    lambda t: changes.as_of(_log(t), ["user_id"], 800),
)
_simple("changes_diff", f"select * from {_LOG} where ts >= 100 and ts < 300", lambda t: changes.diffs(_log(t), 100, 300))
_simple(
    "changes_compact",
    f"(select * from {_LOG} where ts <= 500 qualify {_LAST}) union all select * from {_LOG} where ts > 500",
    lambda t: changes.compact(_log(t), ["user_id"], 500),
)
_simple(
    "changes_take_last",
    f"select user_id, event_type from {_LOG} qualify {_LAST}",
    lambda t: changes.merge(_log(t), ["user_id"], "event_type"),
)
_SQL = "select n.n_name, count(c.c_custkey) as customers, avg(c.c_custkey) as mean_key from customer as c join nation as n on n.n_nationkey = c.c_nationkey where c.c_custkey > 100 and (n.n_name <> 'FRANCE' or c.c_custkey < 500) group by n.n_name"
_simple(
    "sql_facade",
    _SQL.replace("avg(c.c_custkey)", "cast(sum(c.c_custkey) // count(c.c_custkey) as bigint)").replace("count(c.c_custkey) as", "cast(count(c.c_custkey) as bigint) as"),
    lambda t: run_select(_SQL, t),
)
_simple("changes_keys_upto", f"select distinct user_id from {_LOG} where ts <= 50", lambda t: changes.keys_upto(_log(t), ["user_id"], 50))
_simple("changes_keys_between", f"select distinct user_id from {_LOG} where ts >= 100 and ts < 150", lambda t: changes.keys_between(_log(t), ["user_id"], 100, 150))
_simple("changes_new_since", f"select * from {_LOG} where ts > 100 and ts <= 300", lambda t: new_since(_log(t), 100, 300))
_simple(
    "changes_add_delta",
    f"select user_id, ts, op, event_type from {_LOG} union all select n_nationkey, 5000000, 'U', n_name from nation",
    lambda t: changes.add_delta(_log(t), t("nation").select(F.col("n_nationkey").alias("user_id"), F.col("n_name").alias("event_type")), 5_000_000),
)
_simple("changes_last_update", f"select max(ts) as ts from {_LOG}", lambda t: t("events").sparkSession.createDataFrame([(changes.last_update(_log(t)),)], "ts bigint"))
for _name, _text in {
    "sql_wildcard": "select * from region",
    "sql_self_join": "select x.n_name as one, y.n_name as two from nation as x join nation as y on x.n_regionkey = y.n_regionkey where x.n_nationkey < y.n_nationkey",
    "sql_three_way": "select c.c_custkey, n.n_name, r.r_name from customer as c join nation as n on c.c_nationkey = n.n_nationkey join region as r on r.r_regionkey = n.n_regionkey where r.r_name <> 'ASIA'",
    "sql_theta": "select n.n_nationkey, r.r_regionkey from nation as n join region as r on n.n_regionkey <= r.r_regionkey",
}.items():
    _simple(_name, _text, lambda t, q=_text: run_select(q, t))

_REFUSE = (
    "select distinct n_name from nation", "select n_name from nation order by n_name", "select n_name from nation limit 1", "select n_name from nation union select r_name from region",
    "select count(*) from nation", "select n_name from nation, region", "select n_name from nation left join region on n_regionkey = r_regionkey", "select n_name from nation where n_nationkey in (1)",
    "select n_name from nation where not n_nationkey = 1", "select n_name from nation where sum(n_nationkey) > 1", "select n_nationkey + 1 from nation", "select n_name, count(n_nationkey) from nation",
    "select * from (select n_name from nation)", "with t as (select 1) select * from t", "insert into nation values (1)", "delete from nation", "select n_name from nation where n_name = 1", "select sum(n_name) from nation",
)


def _refused(t: Callable[[str], DataFrame]) -> DataFrame:
    rows = []
    for k, q in enumerate(_REFUSE):
        try:
            run_select(q, t)
            rows.append((k, False))
        except EngineError:
            rows.append((k, True))
    return t("nation").sparkSession.createDataFrame(rows, "statement int, refused boolean")


_simple("sql_refusals", f"select cast(i as int) as statement, true as refused from range({len(_REFUSE)}) as r(i)", _refused)
_simple(
    "generated_table",
    "select cast(1000 as bigint) as n, cast(10 as bigint) as c1, cast(100 as bigint) as c2, cast(10 as bigint) as d1, cast(100 as bigint) as d2, true as bounded",
    lambda t: generator.generate(t("region").sparkSession, 1000).agg(
        F.count("*").alias("n"), F.countDistinct("ia1").alias("c1"), F.countDistinct("ia2").alias("c2"), F.countDistinct("sa1").alias("d1"),
        F.countDistinct("sa2").alias("d2"), ((F.max("ia4") < 10_000) & (F.min("ia1") >= 0) & (F.min(F.length("sa3")) >= 10) & (F.max(F.length("sa4")) <= 29)).alias("bounded"),
    ),
)
_simple(
    "random_ints",
    "select cast(500 as bigint) as n, true as bounded",
    lambda t: generator.random_ints(t("region").sparkSession, 2, 500).agg(F.count("*").alias("n"), ((F.min("f0") >= 0) & (F.max("f1") < 2147483647)).alias("bounded")),
)
