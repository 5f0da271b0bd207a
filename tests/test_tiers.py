"""Trust tiers over whole lineages: chains, diamonds, cycles; and frozen snapshots that explain each verdict."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime
from decimal import Decimal

import pytest

from surety.model import PARTNER_SIGNALS, TRUST_TIERS, input_edges, seed_tags
from surety.operators import tags
from surety.plans.assess import assess
from surety.sources.staging import shared_folder, staged

AS_OF = "2024-03-01 23:30:00"
C, P, U = TRUST_TIERS


def tag(name, tier):
    return (name, "CREDIT_RISK", tier, "TRUE")


def result(spark, tagged, edges):
    out = tags.transitive_tiers(seed_tags(spark, [tag(n, t) for n, t in tagged]), input_edges(spark, edges))
    return {r.object_name: (r.inherited_tier, r.circular, r.tier_consistent) for r in out.collect()}


def test_chain_of_five(spark):
    names = "abcde"
    got = result(spark, [(n, U if n == "e" else C) for n in names], list(zip(names, names[1:])))
    assert got == {n: (U, False, n == "e") for n in names}


def test_diamond_and_objects_known_only_by_edges(spark):
    got = result(spark, [("top", C), ("left", P), ("base", C), ("other", C)],
                 [("top", "left"), ("top", "untagged"), ("left", "base"), ("untagged", "bad"), ("untagged", "base"), ("other", "base")])
    assert got == {"top": (P, False, False), "left": (P, False, True), "base": (C, False, True), "other": (C, False, True)}


def test_cycles_end_and_are_reported(spark):
    got = result(spark, [(n, C) for n in "abcdxyz"] + [("w", U)],
                 [("a", "b"), ("b", "c"), ("c", "a"), ("c", "w"), ("d", "a"), ("x", "y"), ("z", "z"), ("y", "z")])
    assert {n for n, (_, circular, _) in got.items() if circular} == {"a", "b", "c", "z"}
    assert {n for n, (tier, _, _) in got.items() if tier == U} == {"a", "b", "c", "d", "w"}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_against_a_search(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(25)]
    tagged = [(n, rng.choice([C, C, C, P, U])) for n in names]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(28)]
    inputs = defaultdict(set)
    for a, b in edges:
        inputs[a].add(b)

    def reach(n):
        seen, todo = set(), list(inputs[n])
        while todo:
            if (m := todo.pop()) not in seen:
                seen.add(m)
                todo += inputs[m]
        return seen

    rank = {n: TRUST_TIERS.index(t) for n, t in tagged}
    want = {n: (TRUST_TIERS[max(rank[m] for m in {n, *reach(n)})], n in reach(n)) for n in names}
    assert {n: r[:2] for n, r in result(spark, tagged, edges).items()} == want


def test_no_edges_no_tags(spark):
    assert result(spark, [("a", P)], []) == {"a": (P, False, True)}
    assert result(spark, [], [("a", "b")]) == {}


def test_staging_needs_a_shared_folder_on_a_cluster(spark):
    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            class getConf:  # noqa: N801
                @staticmethod
                def get(_):
                    return None

        class conf:  # noqa: N801
            @staticmethod
            def get(_, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Elsewhere)
    assert staged(spark.range(3)).count() == 3


def test_blocking_failures_can_be_recomputed_from_the_frozen_snapshot(spark, lending, thresholds):
    """Also those of liability-scoped assessments of single records, which count for everybody."""
    def signal(n, scope, record, rule, status="FAIL", blocking=True):
        return (f"s{n}", scope, "P", record, rule, "ACCURACY", Decimal(1), Decimal("50.00"), status, blocking, datetime(2024, 3, 1), "x")

    partner = spark.createDataFrame([
        signal(1, "RAW.LIABILITIES", "APP-10001", "R1"), signal(2, "RAW.LIABILITIES", "APP-10002", "R1"),
        signal(3, "RAW.LIABILITIES", None, "R2"), signal(4, "RAW.LIABILITIES", "LIA-70001", "R2"),
        signal(5, "RAW.APPLICANTS", "APP-10001", "R3"), signal(6, "RAW.APPLICANTS", "APP-10001", "R3", "PASS"),
        signal(7, "RAW.LIABILITIES", "APP-10003", "R4", "WARN"), signal(8, None, "APP-10002", "R5"),
        signal(9, "RAW.LIABILITIES", "APP-10003", "R6", "FAIL", False)], PARTNER_SIGNALS)
    made = assess(lending, "AGENT", AS_OF, thresholds, partner)
    counted = defaultdict(Counter)
    for r in made.snapshot().filter("signal_source = 'PARTNER' and trust_status = 'FAIL' and is_blocking").collect():
        counted[r.decision_id][r.signal_name] += int(r.measured_value) if r.detail.endswith("of single records.") else 1
    audit = made.audit.collect()
    assert len(audit) == 60
    for r in audit:
        kept = {p.signal_name: p.occurrences for p in r.trust_detail.partner_blocking_failures}
        assert kept == dict(counted[r.decision_id])
    assert dict(counted[next(r.decision_id for r in audit if r.applicant_id == "APP-10001")]) == {"R1": 2, "R2": 2, "R3": 1}
