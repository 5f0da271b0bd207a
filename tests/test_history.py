"""Record versions and joins as of each row's own time, against plain loops; equal instants; hot entities."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from surety.operators import history, late
from surety.operators.audit import source_lineage
from surety.plans.assess import assess
from surety.sources import generator
from surety.sources.offsets import apply_offsets

T0 = datetime(2024, 1, 1)


def hours(n):
    return T0 + timedelta(hours=n)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("bin_days", [1, 30, 10_000])
def test_as_of_join_against_a_loop(spark, bin_days):
    rng = random.Random(bin_days)
    known = [(f"k{n}", rng.choice(["hot", "hot", "a", "b", None]), hours(24 * rng.randint(0, 9)), n) for n in range(120)]
    known += [(f"k{n}", next(r[1] for r in known if r[0] == f"k{n}"), hours(24 * 10 + rng.randint(0, 999)), 1000 + n) for n in range(0, 120, 2)]
    table = history.versions(spark.createDataFrame(known, "key string, who string, valid_from timestamp, v long"), "key")
    asked = [(n, rng.choice(["hot", "a", "b", "none", None]), rng.choice([hours(rng.randint(-30, 2000)), rng.choice(known)[2], None]))
             for n in range(150)]
    got = history.as_of_join(spark.createDataFrame(asked, "id long, who string, at timestamp"), table, "who", "at", bin_days)
    want = []
    for i, who, at in asked:
        for key, owner, start, v in known:
            ends = [s for k, _, s, _ in known if k == key and s > start]
            if who is not None and who == owner and at is not None and start <= at and (not ends or at < min(ends)):
                want.append((i, v))
    assert rows_of(got.select("id", "v")) == sorted(want, key=repr) and len(want) > 200


def test_a_version_begins_at_its_instant_and_ends_before_the_next(spark):
    known = [("r", "e", hours(0), "old"), ("r", "e", hours(48), "new")]
    table = history.versions(spark.createDataFrame(known, "key string, who string, valid_from timestamp, v string"), "key")
    second = timedelta(microseconds=1)
    asked = [(1, hours(0) - second), (2, hours(0)), (3, hours(48) - second), (4, hours(48)), (5, hours(9999))]
    rows = spark.createDataFrame([(i, "e", t) for i, t in asked], "id long, who string, at timestamp")
    assert rows_of(history.as_of_join(rows, table, "who", "at").select("id", "v")) == [(2, "old"), (3, "old"), (4, "new"), (5, "new")]
    for i, t in asked:
        assert rows_of(history.as_of(table, t).select("v")) == [(v,) for n, v in [(2, "old"), (3, "old"), (4, "new"), (5, "new")] if n == i]


def test_two_versions_of_one_instant_fail(spark):
    rows = spark.createDataFrame([("r", hours(0)), ("r", hours(0))], "key string, valid_from timestamp")
    with pytest.raises(Exception, match="two versions of one time"):
        history.versions(rows, "key").collect()


def test_bins_are_join_keys_and_only_those_asked_in_are_filled(spark):
    asked = spark.createDataFrame([(n, "hot", hours(24 * 40 * n)) for n in range(3)], "id long, who string, at timestamp")
    known = spark.createDataFrame([(f"k{n}", "hot", hours(0)) for n in range(5)], "key string, who string, valid_from timestamp")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = history.as_of_join(asked, history.versions(known, "key"), "who", "at")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 15
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("SortMergeJoin [who#" in line and "_bin#" in line for line in plan.splitlines())
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_replay_of_the_published_case(spark, thresholds, lending, by):
    """Two late batches later, the first decision still shows the figures and records it was made on."""
    first, second, third = "2024-03-01 23:30:00", "2024-03-01 23:45:00", "2024-03-05 12:00:00"
    batch = apply_offsets(generator.late_batch(spark), first)
    correction = batch.filter("liability_id = 'LIA-80044'").withColumn("outstanding_balance", F.lit(1).cast("decimal(12,2)"))
    kept = history.record_history(lending.liabilities, first, [
        history.Arrival(batch, second, "BUREAU_TU"), history.Arrival(correction, third)])
    after = lending.with_liabilities(late.apply_late(lending.liabilities, batch, "BUREAU_TU", second))
    rounds = [assess(lending, "AGENT", first, thresholds), assess(after, "AGENT", second, thresholds)]
    audit = rounds[0].audit.unionByName(rounds[1].audit)
    replayed = history.profile_as_of(audit, kept, lending, thresholds)
    assert replayed.count() == 120 and replayed.filter("not replays").count() == 0
    webb = {str(r.decided_at)[11:16]: (str(r.outstanding_exposure), str(r.dti_pct), r.liability_count)
            for r in replayed.filter("applicant_id = 'APP-10042'").collect()}
    assert webb == {"23:30": ("421500.00", "31.97", 2), "23:45": ("493800.00", "50.16", 4)}
    mine = history.lineage_as_of(audit, kept).drop("version_from", "version_to")
    recorded = source_lineage(rounds[0].audit, rounds[0].sources).unionByName(source_lineage(rounds[1].audit, rounds[1].sources))
    assert rows_of(mine.select(*sorted(mine.columns))) == rows_of(recorded.select(*sorted(mine.columns)))
    now = history.as_of(kept, third)
    assert str(by(now, "liability_id")["LIA-80044"].outstanding_balance) == "1.00" and now.count() == 168
    assert history.as_of(kept, first).count() == 166 and history.as_of(kept, "2024-03-01 23:29:59").count() == 0


def test_a_tampered_record_does_not_replay(spark, thresholds, lending):
    at = "2024-03-01 23:30:00"
    made = assess(lending, "AGENT", at, thresholds)
    wrong = F.when(F.col("applicant_id") == "APP-10011", F.col("outstanding_exposure") + 1).otherwise(F.col("outstanding_exposure"))
    audit = made.audit.withColumn("outstanding_exposure", wrong.cast("decimal(22,2)"))
    out = history.profile_as_of(audit, history.record_history(lending.liabilities, at, []), lending, thresholds)
    assert [r.applicant_id for r in out.filter("not replays").collect()] == ["APP-10011"]
