"""Lines set aside with their reasons: nothing is lost, nothing bad is loaded."""

from __future__ import annotations

from surety.model import EMPLOYMENT_DOMAIN, SEED_APPLICANTS, SEED_LIABILITIES
from surety.sources.csv_feed import read_feed, write_feed
from surety.sources.generator import seed_sources
from surety.sources.rejects import contract_rules, judge_lines, read_judged, reject_counts

GOOD = "L1,A1,MORTGAGE,Lender,100.00,5.00,1,EQ,3"


def judged(spark, *lines, **rules):
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    return judge_lines(rows, SEED_LIABILITIES, **(rules or contract_rules("liabilities")))


def test_every_kind_of_fault_is_named(spark):
    cases = {
        GOOD: None, '"L1","A1","MORT, GAGE","Say ""so""",100.00,5.00,1,EQ,3': None, "L1,A1,,,,,,EQ,": None,
        "": ["COLUMN_COUNT"], "L1,A1": ["COLUMN_COUNT"], GOOD + ",more": ["COLUMN_COUNT"],
        ",A1,MORTGAGE,Lender,100.00,5.00,1,EQ,3": ["NOT_NULL:liability_id"],
        "L1,A1,MORTGAGE,Lender,lots,5.00,1.5,EQ,3": ["TYPE:effective_days_ago", "TYPE:outstanding_balance"],
        f"{'L' * 21},A1,MORTGAGE,Lender,12345678901.00,5.00,1,,x": [
            "MAX_LENGTH:liability_id", "NOT_NULL:source_system", "TYPE:loaded_hours_ago", "TYPE:outstanding_balance"],
    }
    out = judged(spark, *cases)
    assert {r.line: r.reasons for r in out.rejects.collect()} == {k: v for k, v in cases.items() if v}
    assert out.good.schema.simpleString() == SEED_LIABILITIES.simpleString()
    assert sorted(r.liability_type or "" for r in out.good.collect()) == ["", "MORT, GAGE", "MORTGAGE"]


def test_null_lines_repeated_lines_and_no_lines(spark):
    out = judged(spark, None, "x", "x", GOOD, GOOD)
    assert out.rejects.count() == 3 and out.good.count() == 2
    assert {r.reason: r.lines for r in reject_counts(out.rejects).collect()} == {"COLUMN_COUNT": 3}
    empty = judged(spark, GOOD)
    assert empty.rejects.count() == 0 and reject_counts(empty.rejects).count() == 0


def test_a_written_feed_reads_back_whole_and_by_domain(spark, tmp_path):
    people = seed_sources(spark).applicants
    write_feed(people, f"{tmp_path}/feed", "applicant_id")
    out = read_judged(spark, f"{tmp_path}/feed", SEED_APPLICANTS, **contract_rules("applicants"))
    strict = read_feed(spark, f"{tmp_path}/feed", SEED_APPLICANTS)
    assert out.rejects.count() == 0 and out.good.exceptAll(strict).count() == 0 and out.good.count() == 60
    narrow = read_judged(spark, f"{tmp_path}/feed", SEED_APPLICANTS, domains={"employment_status": EMPLOYMENT_DOMAIN})
    assert narrow.good.count() == 58 and [r.reasons for r in narrow.rejects.collect()] == [["DOMAIN:employment_status"]] * 2


def test_judging_is_one_scan_without_a_shuffle(spark, tmp_path):
    write_feed(seed_sources(spark).liabilities, f"{tmp_path}/feed", "liability_id")
    out = read_judged(spark, f"{tmp_path}/feed", SEED_LIABILITIES, **contract_rules("liabilities"))
    for df in (out.good, out.rejects):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan text") == 1 and "Exchange" not in plan and "Python" not in plan
