"""Rollups kept by change sets against full recomputation, over rounds of random batches, and what their plans read."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.model import APPLICANTS, INCOME, LIABILITIES, REPAYMENT, Sources
from surety.operators import decide, incremental, late
from surety.operators.exposure import content_duplicates, exposure
from surety.plans.assess import assess, redecide_affected

AS_OF = "2024-03-01 23:30:00"
SCHEMA = T.StructType([T.StructField(f.name, f.dataType, True) for f in LIABILITIES])
START = datetime(2024, 3, 1, 23, 30)


def facts_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def record(rng, key):
    """A liability with every column but the key sometimes null; a hot entity, and equal figures for content duplicates."""
    amount = lambda: rng.choice([None, Decimal("100.00"), Decimal("200.50"), Decimal(rng.randint(0, 9)).quantize(Decimal("0.01"))])
    who = rng.choice(["hot", "hot", "a", "b", "c", "d", None])
    age = rng.choice([0, 1, 6, 7, 8, 9, 42])
    return (key, who, rng.choice(["X", "Y", None]), "Lender", amount(), amount(), date(2024, 2, 1), rng.choice(["BUREAU_TU", "BUREAU_EQ", None]),
            rng.choice([START - timedelta(days=age, hours=rng.randint(0, 9)), START - timedelta(days=age), None]))


def bag(df):
    return Counter(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("seed, feed", [(1, "BUREAU_TU"), (2, None)])
def test_two_batches_equal_full_recomputation(spark, thresholds, seed, feed):
    rng = random.Random(seed)
    facts = facts_of(spark, [record(rng, f"L{n}") for n in range(60)] + [record(rng, None), record(rng, None)])
    kept = incremental.start(facts)
    for n in range(2):
        names = rng.sample(range(90), 8)
        batch = facts_of(spark, [record(rng, f"L{k}") for k in names])
        as_of = f"2024-03-0{1 + n} 23:30:00"
        kept = incremental.maintain(kept, facts, batch, feed, as_of)
        after = late.apply_late(facts, batch, feed, as_of) if feed else late.merge_late(facts, batch)
        facts = spark.createDataFrame(after.collect(), SCHEMA)
        assert bag(kept.exposure(as_of, thresholds)) == bag(exposure(facts, as_of, thresholds))
        assert bag(kept.copies) == bag(content_duplicates(facts))
        assert bag(kept.state) == bag(incremental.rollup_state(facts))
        kept = incremental.Maintained(*[spark.createDataFrame(df.collect(), df.schema) for df in (kept.state, kept.copies)])


def test_change_set_takes_the_table_from_before_to_after(spark):
    rng = random.Random(5)
    facts = facts_of(spark, [record(rng, f"L{n}") for n in range(40)])
    batch = facts_of(spark, [record(rng, f"L{n}") for n in range(30, 50)])
    changes = incremental.change_set(facts, batch, "BUREAU_TU", AS_OF)
    removed, added = (bag(changes.filter(f"sign = {s}").drop("sign")) for s in (-1, 1))
    before = bag(facts)
    assert not removed - before
    assert before - removed + added == bag(late.apply_late(facts, batch, "BUREAU_TU", AS_OF))


def test_an_empty_batch_or_table_changes_nothing(spark, thresholds):
    rng = random.Random(7)
    facts = facts_of(spark, [record(rng, f"L{n}") for n in range(20)])
    none = facts.limit(0)
    kept = incremental.maintain(incremental.start(facts), facts, none)
    assert bag(kept.state) == bag(incremental.rollup_state(facts)) and kept.affected.count() == 0
    grown = incremental.maintain(incremental.start(none), none, facts)
    assert bag(grown.exposure(AS_OF, thresholds)) == bag(exposure(facts, AS_OF, thresholds))


def test_a_doubled_key_in_the_batch_fails(spark):
    rng = random.Random(8)
    facts = facts_of(spark, [record(rng, "L1")])
    twice = facts_of(spark, [record(rng, "L1"), record(rng, "L1")])
    with pytest.raises(Exception, match="more than one row"):
        incremental.change_set(facts, twice).collect()


def test_affected_applicants_are_decided_as_in_a_full_round(spark, thresholds, lending):
    from surety.sources import generator
    from surety.sources.offsets import apply_offsets

    batch = apply_offsets(generator.late_batch(spark), AS_OF)
    later = "2024-03-01 23:45:00"
    made, kept = redecide_affected(
        lending, incremental.start(lending.liabilities), batch, "BUREAU_TU", "AGENT", later, thresholds)
    now = lending.with_liabilities(late.apply_late(lending.liabilities, batch, "BUREAU_TU", later))
    full = assess(now, "AGENT", later, thresholds, population=kept.affected)
    assert bag(made.audit) == bag(full.audit) and made.audit.count() == 20
    assert bag(made.sources) == bag(full.sources) and bag(made.snapshot()) == bag(full.snapshot())
    everybody = decide.decisions(lending, later, thresholds, kept=kept)
    assert bag(everybody.select("applicant_id", "decision", "outstanding_exposure", "verdict")) == bag(
        decide.decisions(now, later, thresholds).select("applicant_id", "decision", "outstanding_exposure", "verdict"))


# What the plans read --------------------------------------------------------
def walk(node, above=()):
    yield node, above
    children = node.children()
    for i in range(children.size()):
        yield from walk(children.apply(i), (*above, node))


def unguarded(df):
    """Aggregates that take in rows of the stored facts with neither a semi-join nor a filter by feed between."""
    found = []
    for node, above in walk(df._jdf.queryExecution().optimizedPlan()):
        if node.children().size() or "fact_mark" not in node.toString():
            continue
        for up in reversed(above):
            text = up.simpleString(10000)
            if text.startswith("Join LeftSemi") or text.startswith("Filter") and "= BUREAU_TU" in text and "NOT" not in text:
                break
            if up.nodeName() == "Aggregate":
                found.append(text[:200])
                break
    return found


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(4)
    folder = str(tmp_path_factory.mktemp("kept"))
    facts = facts_of(spark, [record(rng, f"L{n}") for n in range(50)])
    facts.withColumn("fact_mark", F.lit(1)).write.parquet(f"{folder}/facts")
    kept = incremental.start(facts)
    kept.state.write.parquet(f"{folder}/state")
    kept.copies.write.parquet(f"{folder}/copies")
    batch = facts_of(spark, [record(rng, f"L{n}") for n in (3, 70)])
    batch.write.parquet(f"{folder}/batch")
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    return incremental.Maintained(read("state"), read("copies")), read("facts").drop("fact_mark"), read("batch")


def test_facts_of_others_are_not_aggregated(spark, stored, thresholds):
    kept, facts, batch = stored
    assert unguarded(exposure(facts, AS_OF, thresholds)) and unguarded(content_duplicates(facts))    # full passes are found
    now = incremental.maintain(kept, facts, batch, "BUREAU_TU", AS_OF)
    assert not unguarded(now.exposure(AS_OF, thresholds)) and not unguarded(now.copies)
    assert "fact_mark" in now.copies._jdf.queryExecution().optimizedPlan().toString()
    assert not unguarded(decide.decisions(no_sources(facts), AS_OF, thresholds, kept=now))


def no_sources(facts):
    empty = lambda schema: facts.sparkSession.createDataFrame([], schema)
    return Sources(empty(APPLICANTS), empty(INCOME), facts, empty(REPAYMENT))
