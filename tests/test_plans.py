import io

import duckdb
import pytest

import __spark_entry__
from tidemark.cli import Session, main
from tidemark.model import Options
from tidemark.operators import reads, resolve
from tidemark.plans import queries
from tidemark.plans.logs import customers, events_log
from tidemark.sources.store import Database
from tidemark.streaming.ingest import into, running_latest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(found.columns)) for r in found.collect()]
    if sql := queries.ORACLES.get(name):
        want = duck.sql(sql)
        assert sorted(want.columns) == sorted(found.columns)
        order = [want.columns.index(c) for c in sorted(want.columns)]
        assert sorted(map(str, rows)) == sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_are_ordered(spark):
    keys = [r.key for r in reads.scan(events_log(spark, SF)).collect()]
    assert keys == sorted(keys) and keys


def plan(frame):
    return frame._jdf.queryExecution().toString()


def test_key_predicates_reach_the_scan(spark):
    log = customers(spark, SF)
    assert "GreaterThanOrEqual(c_name,b)" in plan(reads.scan(log, "b", "c"))
    assert "StringStartsWith(c_name,Cust)" in plan(reads.scan_prefix(log, "Cust"))
    p = plan(resolve.visible(log))
    assert p.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


def test_value_filters_stay_above_resolution(spark):
    rows = [("a", 1, False, "old"), ("a", 2, True, ""), ("b", 1, False, "x"), ("b", 2, False, "y")]
    log = spark.createDataFrame(rows, "key string, sequence long, tombstone boolean, value string")
    assert resolve.visible(log).where("value = 'old' OR value = 'x'").count() == 0


def test_command_line(spark, tmp_path):
    out = io.StringIO()
    db = Database(spark, str(tmp_path), Options(sync_writes=False))
    script = ["put a hello there world\n", "get a\n", "begin\n", "begin\n", "put b 1\n", "get b\n", "delete a\n", "commit\n", "get a\n", "scan a z\n", "put c\n", "get c\n", "scan a z x\n", "prefix c 1\n", "commit\n", "begin\n", "put  x\n", "abort\n", "stats\n", "what\n", "flush\n", "compact\n", "get \n", "begin\n", "quit\n", "get a\n"]
    assert Session(db, out).run(script) == 0
    said = out.getvalue().splitlines()
    for line in ("hello there world", "(not found)", "b = 1", "committed 2", "c = ", "error: a batch is open already", "error: no batch is open", "error: 'x' is no limit", "unknown command; type 'help'", "sequence=4", "error: key is empty", "the open batch is discarded"):
        assert line in said, line
    assert main([]) == 2


def test_a_failed_commit_keeps_the_batch(spark, tmp_path):
    out = io.StringIO()
    db = Database(spark, str(tmp_path), Options(sync_writes=False, max_value_bytes=3))
    Session(db, out).run(["begin\n", "put a long\n", "put b ok\n", "commit\n", "abort\n", "get b\n"])
    assert "error: value has more than 3 bytes" in out.getvalue() and "batch discarded" in out.getvalue()
    assert db.stats().sequence == 0


def test_streaming_ingest_is_idempotent(spark, tmp_path):
    source, db = tmp_path / "in", Database(spark, str(tmp_path / "db"), Options(sync_writes=False))
    schema = "key string, value string, n long"
    spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("a", None, 3)], schema).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    for checkpoint in ("one", "two"):  # the second query has lost its checkpoint and repeats batch 0
        stream.writeStream.foreachBatch(into(db, "n", "first")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
    assert db.scan() == [("b", "2")] and db.stats().sequence == 3
    # another stream's batch 0 is another batch; a reopened store knows both
    db = Database(spark, str(tmp_path / "db"), Options(sync_writes=False))
    spark.createDataFrame([("c", "3", 1)], schema).coalesce(1).write.parquet(str(tmp_path / "more"))
    more = spark.readStream.schema(schema).parquet(str(tmp_path / "more"))
    for checkpoint in ("three", "four"):
        more.writeStream.foreachBatch(into(db, "n", "second")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
    assert db.scan() == [("b", "2"), ("c", "3")] and db.stats().sequence == 4 and db.streams == {"first": 0, "second": 0}


def test_running_latest(spark, tmp_path):
    schema = "key string, sequence long, tombstone boolean, value string"
    spark.createDataFrame([("a", 2, False, "new"), ("a", 1, False, "old"), ("b", 1, True, "")], schema).write.parquet(str(tmp_path / "in"))
    q = running_latest(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT key, sequence, value FROM latest").collect())) == [("a", 2, "new"), ("b", 1, "")]
