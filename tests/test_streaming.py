"""Extensions: liveness from a stream, late batches merged as they arrive."""

from __future__ import annotations

from conftest import AS_OF
from surety.operators.gaps import feed_gaps
from surety.streaming.liveness import heartbeat, start_liveness
from surety.plans.assess import current_liabilities, late_path
from surety.sources.sinks import replace_feeds
from surety.streaming.upsert import ledger_path, start_late_upserts, version_of
from test_boundaries import debt


def test_liveness(spark, lending, thresholds, tmp_path):
    lending.liabilities.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(lending.liabilities.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    seen = []
    q = start_liveness(
        stream, "RAW.LIABILITIES", thresholds, f"{tmp_path}/cp",
        lambda df, epoch: seen.append({r.feed_name: (r.record_count, r.trust_status) for r in df.collect()}),
        lambda: AS_OF)
    q.awaitTermination(120)
    assert len(seen) >= 3
    assert seen[-1] == {"BUREAU_EQ": (113, "PASS"), "BUREAU_TU": (53, "FAIL")}


def test_late_upserts(spark, make, tmp_path):
    path = f"{tmp_path}/facts"
    facts = make([debt("1", 500), debt("2", 500)]).liabilities
    replace_feeds(facts, path)
    for n, rows in enumerate(([debt("1", 2, "5.00")], [debt("3", 2), debt("1", 1, "6.00")])):
        make(rows).liabilities.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(facts.schema).parquet(f"{tmp_path}/in")
        start_late_upserts(stream, path, f"{tmp_path}/cp").awaitTermination(120)
    rows = current_liabilities(spark, path).collect()
    got = {r.liability_id: str(r.outstanding_balance) for r in rows}
    assert len(rows) == 3 and got == {"1": "6.00", "2": "1000.00", "3": "1000.00"}


def test_versions_rise_over_streams_and_new_checkpoints(spark, make, tmp_path):
    """A second stream, then a fresh checkpoint of the first: both count from epoch 0, and yet the newest figures win."""
    path = f"{tmp_path}/facts"
    facts = make([debt("1", 500)]).liabilities
    replace_feeds(facts, path)

    def deliver(folder, checkpoint, *rows):
        make(list(rows)).liabilities.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{folder}")
        start_late_upserts(spark.readStream.schema(facts.schema).parquet(f"{tmp_path}/{folder}"), path,
                           f"{tmp_path}/{checkpoint}").awaitTermination(120)

    def figures():
        return {r.liability_id: str(r.outstanding_balance) for r in current_liabilities(spark, path).collect()}

    deliver("a", "cp1", debt("1", 5, "5.00"))
    deliver("a", "cp1", debt("1", 4, "6.00"))
    assert figures() == {"1": "6.00"}
    deliver("b", "cp2", debt("1", 3, "7.00"), debt("2", 3, "1.00"), debt("2", 3, "1.00"))
    assert figures() == {"1": "7.00", "2": "1.00"}
    deliver("c", "cp3", debt("1", 2, "8.00"))
    assert figures() == {"1": "8.00", "2": "1.00"}


def test_a_replayed_epoch_keeps_its_version(spark, tmp_path):
    path = f"{tmp_path}/facts"
    assert [version_of(spark, path, s, e) for s, e in (("x", 0), ("x", 1), ("y", 0), ("x", 1), ("y", 0), ("x", 0))] == [0, 1, 2, 1, 2, 0]
    # two streams that took one number: the later name moves on, also when asked again
    spark.createDataFrame([("y", 5, 9), ("z", 5, 9)], "stream string, epoch long, version long").write.mode("append").parquet(ledger_path(path))
    assert [version_of(spark, path, s, 5) for s in ("z", "y", "z")] == [10, 9, 10]


def test_repeated_rows_within_the_watermark_count_once(spark, make, tmp_path):
    path = f"{tmp_path}/facts"
    facts = make([debt("9", 500)]).liabilities
    replace_feeds(facts, path)
    for n in range(2):
        make([debt("1", 2, "5.00"), debt(f"x{n}", 1)]).liabilities.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(facts.schema).parquet(f"{tmp_path}/in")
        start_late_upserts(stream, path, f"{tmp_path}/cp", event_time="loaded_at", within="2 hours").awaitTermination(120)
    kept = spark.read.parquet(late_path(path)).filter("liability_id = '1'")
    assert kept.count() == 1 and current_liabilities(spark, path).count() == 4


def test_a_silent_feed_fails_without_a_row_of_any(spark, lending, thresholds, tmp_path):
    """Only ticks arrive while the clock moves on; a restart goes on from the counts it had."""
    lending.liabilities.filter("source_system = 'BUREAU_EQ'").coalesce(1).write.parquet(f"{tmp_path}/in")
    ticks = spark.createDataFrame([(AS_OF,)], "t string").selectExpr("CAST(t AS TIMESTAMP) AS loaded_at")
    seen = []

    def run(now):
        ticks.write.mode("append").parquet(f"{tmp_path}/ticks")
        read = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")
        start_liveness(
            read("in", lending.liabilities.schema), "RAW.LIABILITIES", thresholds, f"{tmp_path}/cp",
            lambda df, epoch: seen.append({r.feed_name: (r.record_count, r.trust_status) for r in df.collect()}),
            lambda: now, beat=read("ticks", ticks.schema)).awaitTermination(120)

    for day, status in (("2024-03-01", "PASS"), ("2024-03-04", "WARN"), ("2024-03-08", "FAIL")):
        run(f"{day} 23:30:00")
        assert seen[-1] == {"BUREAU_EQ": (113, status)}


def test_late_rows_are_counted(spark, lending, thresholds, tmp_path):
    lending.liabilities.selectExpr("*", f"TIMESTAMP '{AS_OF}' AS came").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(lending.liabilities.schema.add("came", "timestamp")).parquet(f"{tmp_path}/in")
    seen = []
    start_liveness(stream, "RAW.LIABILITIES", thresholds, f"{tmp_path}/cp", lambda df, epoch: seen.extend(df.collect()), lambda: AS_OF,
                   arrived="came", late_after="30 days").awaitTermination(120)
    assert {r.feed_name: r.late_records for r in seen} == {"BUREAU_EQ": 0, "BUREAU_TU": 53}


def test_the_heartbeat_ticks(spark, lending, thresholds, tmp_path):
    lending.liabilities.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(lending.liabilities.schema).parquet(f"{tmp_path}/in")
    seen = []
    q = start_liveness(stream, "RAW.LIABILITIES", thresholds, f"{tmp_path}/cp", lambda df, epoch: seen.append(df.count()), lambda: AS_OF,
                       beat=heartbeat(spark), processingTime="0 seconds")
    try:
        for _ in range(120):
            if len(seen) >= 3:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert len(seen) >= 3 and seen[-1] == 2


def test_sessions_across_midnight_and_at_the_very_gap(spark):
    def at(day, hour, minute=0, second=0):
        return f"2024-01-{day:02d} {hour:02d}:{minute:02d}:{second:02d}"

    rows = [("a", at(1, 23, 30)), ("a", at(2, 0, 10)), ("a", at(2, 1, 10)), ("a", at(2, 2, 10, 1)), ("a", None), ("b", at(1, 5)), ("b", at(1, 5)), (None, at(3, 0))]
    df = spark.createDataFrame(rows, "source_system string, t string").selectExpr("source_system", "CAST(t AS TIMESTAMP) AS loaded_at")
    got = {(r.feed_name, str(r.first_load_at)): (str(r.last_load_at), r.records, r.silent_seconds, r.still_silent)
           for r in feed_gaps(df, at(3, 0)).collect()}
    assert got == {
        ("a", at(1, 23, 30)): (at(2, 1, 10), 3, 3601, False), ("a", at(2, 2, 10, 1)): (at(2, 2, 10, 1), 1, 78599, True),
        ("b", at(1, 5)): (at(1, 5), 2, 154800, True), (None, at(3, 0)): (at(3, 0), 1, 0, True)}
    assert feed_gaps(df.limit(0), at(3, 0)).count() == 0
