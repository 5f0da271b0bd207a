"""Keeping records: append once, read back, trace, replay."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import AS_OF
from surety.operators import audit as au
from surety.operators import decide
from surety.operators.late import apply_late
from surety.plans.assess import (
    _not_yet_stored, append_late, assess, compact_late, current_liabilities, record, recorded, recover_feed)
from surety.plans.views import register_views
from surety.sources import csv_feed, generator, sinks
from surety.sources.offsets import apply_offsets
from surety.model import SEED_LIABILITIES
from test_boundaries import debt


def test_recording_twice_adds_nothing(spark, lending, thresholds, tmp_path):
    folder = str(tmp_path)
    made = assess(lending, "AGENT", AS_OF, thresholds)
    record(spark, made, folder)
    record(spark, made, folder)
    kept = recorded(spark, folder)
    assert (kept.audit.count(), kept.sources.count(), kept.batch.count()) == (60, 165, 5)
    assert kept.snapshot().count() == 300
    record(spark, assess(lending, "AGENT", "2024-03-02 10:00:00", thresholds), folder)
    assert recorded(spark, folder).audit.count() == 120
    # one date is read when one date is asked for
    plan = kept.audit.filter("decision_date = '2024-03-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(decision_date" in plan
    # looking for rows stored before opens the directory of the batch, not the table
    again = _not_yet_stored(spark, made.audit, f"{folder}/decision_audit", made.keys, "decision_id")
    explained = spark._jvm.PythonSQLUtils.explainString(again._jdf.queryExecution(), "formatted")
    mine = [f for f in re.findall(r"PartitionFilters: \[(.*)\]", explained) if "decision_date" in f]
    assert len(mine) == 1 and "trust_batch_id" in mine[0] and "= BATCH-" in mine[0]


def test_second_population_of_a_batch_is_added(spark, lending, thresholds, tmp_path):
    for who in (("APP-10001", "APP-10002"), ("APP-10002", "APP-10003")):
        asked = spark.createDataFrame([(w,) for w in who], "applicant_id string")
        record(spark, assess(lending, "AGENT", AS_OF, thresholds, population=asked), str(tmp_path))
    kept = recorded(spark, str(tmp_path))
    assert sorted(r.applicant_id for r in kept.audit.collect()) == ["APP-10001", "APP-10002", "APP-10003"]
    assert kept.batch.count() == 5


def test_interrupted_recording_is_completed(spark, lending, thresholds, tmp_path):
    folder = str(tmp_path)
    made = assess(lending, "AGENT", AS_OF, thresholds)
    half = made.sources.filter("liability_id < 'LIA-70100'")
    sinks.append_batch(made.batch, f"{folder}/trust_batch")
    sinks.append_batch(half, f"{folder}/decision_sources")
    record(spark, made, folder)
    assert recorded(spark, folder).sources.count() == 165


def test_lineage_now_and_as_recorded(rounds):
    first, now = rounds.first, rounds.sources_now.liabilities
    pick = lambda df: {
        r.liability_record_id: (str(r.outstanding_balance), r.record_age_days_at_decision)
        for r in df.filter("applicant_id = 'APP-10042'").collect()}
    assert pick(au.source_lineage(first.audit, first.sources))["LIA-80042"] == ("410000.00", 42)
    assert pick(au.source_lineage(first.audit, first.sources, now))["LIA-80042"] == ("406800.00", 0)


def test_every_record_of_a_large_entity_is_recorded(spark, make, thresholds):
    import hashlib

    made = assess(make([debt(str(n), 500) for n in range(5000)]), "AGENT", AS_OF, thresholds)
    ids = sorted(r.liability_record_id for r in au.recorded_ids(made.sources).collect())
    assert ids == sorted(str(n) for n in range(5000))
    kept = made.audit.first().source_record_ids
    assert kept.liability_record_count == 5000
    assert int(kept.liability_record_digest) == sum(int(hashlib.md5(i.encode()).hexdigest()[:8], 16) for i in ids)


def test_entity_without_debts_has_empty_lists(make, thresholds):
    row = assess(make([debt("1", 5)], applicants=("A", "B")), "AGENT", AS_OF, thresholds).audit.filter("applicant_id = 'B'").first()
    assert row.source_feeds_used == [] and row.source_record_ids.liability_record_count == 0
    assert int(row.source_record_ids.liability_record_digest) == 0


def test_doubled_applicant_fails(make, thresholds):
    made = assess(make([debt("1", 5)], applicants=("A", "A")), "AGENT", AS_OF, thresholds)
    with pytest.raises(Exception, match="applicants table holds more than one row"):
        made.audit.collect()


def test_half_written_signals_are_completed(spark, lending, thresholds, tmp_path):
    made = assess(lending, "AGENT", AS_OF, thresholds)
    sinks.append_batch(made.batch.filter("feed_name in ('BUREAU_EQ', 'BUREAU_TU')"), f"{tmp_path}/trust_batch")
    record(spark, made, str(tmp_path))
    assert recorded(spark, str(tmp_path)).batch.count() == 5


def test_audit_rests_on_the_stored_sources(spark, make, thresholds, tmp_path):
    from dataclasses import replace

    made = assess(make([debt("1", 5)]), "AGENT", AS_OF, thresholds)
    reloaded = assess(make([debt("1", 5), debt("2", 5)]), "AGENT", AS_OF, thresholds)
    record(spark, replace(reloaded, sources=made.sources), str(tmp_path))  # facts grew between the two writes
    kept = recorded(spark, str(tmp_path))
    total = kept.sources.agg(F.sum("outstanding_balance")).first()[0]
    assert kept.audit.first().outstanding_exposure == total and kept.audit.first().source_record_ids.liability_record_count == 1


@pytest.mark.parametrize("feed", ["0042", None])
def test_stored_feed_names_keep_their_text(spark, make, tmp_path, feed):
    path = f"{tmp_path}/liabilities"
    sinks.replace_feeds(make([debt("1", 500, feed=feed), debt("2", 500, feed="ZZ")]).liabilities, path)
    for _ in range(2):
        recover_feed(spark, path, make([debt("1", 1, "5.00", feed=feed), debt("3", 1, feed=feed)]).liabilities)
        spark.catalog.refreshByPath(path)
    got = {r.liability_id: (str(r.outstanding_balance), r.source_system) for r in sinks.stored_table(spark, path).collect()}
    assert got == {"1": ("5.00", feed), "2": ("1000.00", "ZZ"), "3": ("1000.00", feed)}
    assert sinks.stored_table(spark, path).count() == 3


def test_late_versions_touch_no_stored_file(spark, make, tmp_path):
    path = f"{tmp_path}/liabilities"
    sinks.replace_feeds(make([debt(str(n), 500, feed="0042") for n in range(5)]).liabilities, path)
    files = lambda: sorted((p, os.path.getmtime(os.path.join(p, f))) for p, _, fs in os.walk(path) for f in fs)
    before = files()
    first = make([debt("1", 1, "5.00", feed="0042"), debt("9", 1, "7.00", feed="TU"), debt("2", 1, "6.00")]).liabilities
    for version, batch in ((1, first), (2, make([debt("9", 1, "8.00", feed="EQ")]).liabilities), (1, first)):
        append_late(batch, path, version)
    got = {r.liability_id: (str(r.outstanding_balance), r.source_system) for r in current_liabilities(spark, path).collect()}
    assert got == {"0": ("1000.00", "0042"), "1": ("5.00", "0042"), "2": ("6.00", "0042"), "3": ("1000.00", "0042"),
                   "4": ("1000.00", "0042"), "9": ("8.00", "TU")}
    assert files() == before
    compact_late(spark, path, f"{tmp_path}/compacted")
    assert sinks.stored_table(spark, f"{tmp_path}/compacted").count() == 6
    with pytest.raises(Exception, match="more than one row"):
        append_late(make([debt("1", 1), debt("1", 1)]).liabilities, path, 3)


def test_ids_of_different_parts_differ(spark):
    from surety.functions.ids import stable_id

    pairs = [("a|b", "c"), ("a", "b|c"), ("", "x"), (None, "x"), ("1:a", "")]
    ids = [r.i for r in spark.createDataFrame(pairs, "a string, b string").select(stable_id("X-", F.col("a"), F.col("b")).alias("i")).collect()]
    assert len(set(ids)) == len(pairs)


def test_record_signals_meet_their_own_decision_only(spark, lending, thresholds):
    from surety.model import PARTNER_SIGNALS

    rows = [(f"S{n}", "RAW.APPLICANTS", "P", f"APP-1000{n}", "RULE", "ACCURACY", None, None, "PASS", False, None, "x") for n in (1, 2)]
    partner = spark.createDataFrame(rows, PARTNER_SIGNALS)
    made = assess(lending, "AGENT", AS_OF, thresholds, partner)
    assert made.batch.count() == 7
    snap = made.snapshot()
    assert snap.count() == 60 * 5 + 2 and snap.select("snapshot_id").distinct().count() == 302
    assert [r.applicant_id for r in snap.filter("signal_source = 'PARTNER'").orderBy("applicant_id").collect()] == ["APP-10001", "APP-10002"]


def test_snapshot_pairs_every_decision_with_every_signal(rounds):
    snap = rounds.first.snapshot()
    assert snap.count() == 60 * 5 and snap.select("snapshot_id").distinct().count() == 300
    seen = au.trust_at_decision(snap, rounds.first.audit).filter("applicant_id = 'APP-10042'")
    assert seen.filter("trust_status = 'FAIL'").first().feed_name == "BUREAU_TU"
    assert seen.filter("trust_verdict <> 'NOT_TRUSTED'").count() == 0
    view = au.frozen_trust(rounds.first.audit, rounds.first.batch).select(*au.trust_at_decision(snap, rounds.first.audit).columns)
    assert view.exceptAll(au.trust_at_decision(snap, rounds.first.audit)).count() == 0 and view.count() == 300


def test_ids_do_not_change_between_runs(rounds):
    a = {r.decision_id for r in rounds.first.audit.select("decision_id").collect()}
    assert a == {r.decision_id for r in rounds.first.sources.select("decision_id").collect()}


def test_views(spark, lending, rounds, thresholds):
    names = register_views(spark, lending, rounds.first, AS_OF, thresholds)
    assert len(names) == 7
    row = spark.sql("SELECT risk_tier FROM v_applicant_credit_profile WHERE applicant_id = 'APP-10042'").first()
    assert row.risk_tier == "TIER_2_MODERATE"
    assert spark.table("v_trust_at_decision").count() == 300
    assert spark.table("v_decision_drift").filter("drift_finding LIKE 'STABLE%'").count() == 58


def test_feeds_through_csv(spark, lending, tmp_path):
    seeds = generator.seed_sources(spark)
    for (name, df), key in zip(seeds.items(), ("liability_id", "income_record_id", "applicant_id", "payment_record_id")):
        csv_feed.write_feed(df, f"{tmp_path}/{csv_feed.FEED_FILES[name][0]}", key)
    back = csv_feed.read_sources(spark, str(tmp_path), AS_OF)
    for (name, a), (_, b) in zip(lending.items(), back.items()):
        assert a.schema == b.schema or [f.dataType for f in a.schema] == [f.dataType for f in b.schema], name
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name
    csv_feed.write_feed(generator.late_batch(spark), f"{tmp_path}/late.csv", "liability_id")
    late = csv_feed.read_late_batch(spark, f"{tmp_path}/late.csv", AS_OF)
    assert late.exceptAll(apply_offsets(generator.late_batch(spark), AS_OF)).count() == 0


def test_bad_row_aborts_the_load(spark, tmp_path):
    (tmp_path / "bad.csv").write_text(
        ",".join(f.name for f in SEED_LIABILITIES) + '\n"L","A","T","C",12.00,not a number,1,"F",1\n')
    with pytest.raises(Exception):
        csv_feed.read_feed(spark, str(tmp_path / "bad.csv"), SEED_LIABILITIES).collect()


def test_reload_is_idempotent(spark, lending, tmp_path):
    sinks.replace_sources(lending, str(tmp_path))
    sinks.replace_sources(lending, str(tmp_path))
    back = sinks.stored_sources(spark, str(tmp_path))
    assert back.liabilities.count() == 166


def test_recovery_rewrites_only_the_feeds_it_touches(spark, lending, rounds, tmp_path):
    sinks.replace_sources(lending, str(tmp_path))
    path = f"{tmp_path}/liabilities"
    eq_files = lambda: sorted(os.listdir(f"{path}/source_system=BUREAU_EQ"))
    before = eq_files()
    batch = apply_offsets(generator.late_batch(spark), "2024-03-01 23:45:00")
    for _ in range(2):
        assert recover_feed(spark, path, batch, "BUREAU_TU", "2024-03-01 23:45:00") == ["BUREAU_TU"]
        spark.catalog.refreshByPath(path)
    assert eq_files() == before
    now = spark.read.parquet(path).select(*lending.liabilities.columns)
    in_flight = apply_late(lending.liabilities, batch, "BUREAU_TU", "2024-03-01 23:45:00")
    assert now.count() == 168 and now.exceptAll(in_flight).count() == 0


def test_recovery_follows_a_row_into_another_feed(spark, make, tmp_path):
    path = f"{tmp_path}/liabilities"
    sinks.replace_feeds(make([debt("1", 500), debt("2", 500, feed="EQ"), debt("3", 500, feed="ZZ")]).liabilities, path)
    batch = make([debt("2", 1, "5.00", feed="TU")]).liabilities
    assert recover_feed(spark, path, batch) == ["EQ", "TU"]
    got = {r.liability_id: (str(r.outstanding_balance), r.source_system) for r in spark.read.parquet(path).collect()}
    assert got == {"1": ("1000.00", "TU"), "2": ("5.00", "EQ"), "3": ("1000.00", "ZZ")}


def test_bucketed_tables_are_decided_without_an_exchange(spark, lending, thresholds, tmp_path):
    sinks.bucket_sources(lending, str(tmp_path), "bucketed_test", 4)
    limits = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = decide.decisions(sinks.bucketed_sources(spark, "bucketed_test"), AS_OF, thresholds).select(
            "applicant_id", "outstanding_exposure", "dti_pct", "verdict", "decision")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 0, plan
        flat = decide.decisions(lending, AS_OF, thresholds).select(*df.columns)
        assert df.exceptAll(flat).count() == 0 and df.count() == 60
    finally:
        for k, v in limits.items():
            spark.conf.set(k, v)
        for name, _ in lending.items():
            spark.sql(f"DROP TABLE bucketed_test_{name}")


def test_generator_scales(spark):
    big = generator.seed_sources(spark, 1000)
    assert big.applicants.count() == 1000
    assert big.liabilities.select("liability_id").distinct().count() == big.liabilities.count()
    assert big.liabilities.filter(F.col("monthly_payment").isNull()).count() == 0
