from pyspark.sql import functions as F

from loomspan.operators import changes
from loomspan.streaming import incremental

LOG = [("k1", 1, "U", "a"), ("k1", 3, "U", "b"), ("k2", 2, "U", "c"), ("k2", 4, "D", None), ("k3", 5, "U", "d")]
KIND = "key string, ts int, op string, value string"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_as_of_diffs_and_compaction(spark):
    log = spark.createDataFrame(LOG, KIND)
    assert rows(changes.as_of(log, ["key"], 3)) == [("k1", 3, "b"), ("k2", 2, "c")]
    assert rows(changes.as_of(log, ["key"], 9)) == [("k1", 3, "b"), ("k3", 5, "d")]
    assert [r[1] for r in rows(changes.diffs(log, 2, 4))] == [3, 2]
    assert changes.compact(log, ["key"], 4).count() == 3
    assert rows(changes.as_of(changes.compact(log, ["key"], 4), ["key"], 9)) == rows(changes.as_of(log, ["key"], 9))
    assert changes.last_update(log) == 5 and changes.last_update(log.where("ts > 9")) is None


def test_merges(spark):
    log = spark.createDataFrame(LOG, KIND)
    assert dict(rows(changes.merge(log, ["key"], "value")))["k1"] == "b"
    assert changes.merge(log, ["key"], "value", "none").count() == 5
    assert dict(rows(changes.merge(log, ["key"], "value", F.count("value"))))["k1"] == 2
    assert incremental.new_since(log, 2, 4).count() == 2


def test_stream_runs_each_file_once(spark, tmp_path):
    source, seen = str(tmp_path / "log"), []
    for turn in range(2):
        spark.createDataFrame(LOG[turn * 2 : turn * 2 + 2], KIND).coalesce(1).write.mode("append").parquet(source)
        stream = incremental.stream_log(spark, source, KIND)
        incremental.run_available(stream, lambda df, i: seen.append(df.count()), str(tmp_path / "check"))
    assert sum(seen) == 4


def test_windowed_counts(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:01' ts, 'x' k union all select timestamp'2024-01-01 00:07:01', 'x'")
    assert [r["n"] for r in incremental.windowed_counts(df, "ts", "k", "5 minutes", "1 minute").orderBy("start").collect()] == [1, 1]


def test_keys_deltas_and_outdated_logs(spark):
    log = spark.createDataFrame(LOG, KIND)
    assert rows(changes.keys_upto(log, ["key"], 2)) == [("k1",), ("k2",)]
    assert rows(changes.keys_between(log, ["key"], 3, 5)) == [("k1",), ("k2",)]
    more = changes.add_delta(log, spark.createDataFrame([("k3",), ("k9",)], "key string"), 7, "D")
    more = changes.add_delta(more, spark.createDataFrame([("k4", "e")], "key string, value string"), 8)
    assert rows(changes.as_of(more, ["key"], 9)) == [("k1", 3, "b"), ("k4", 8, "e")]
    assert rows(changes.read_key(more, {"key": "k3"}, 6)) == [("k3", 5, "U", "d")] and changes.read_key(more, {"key": "k7"}, 9).count() == 0
    assert changes.outdated({"old": log, "new": more, "none": log.where("false")}, 8) == ["old"]
