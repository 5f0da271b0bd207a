"""Whole decisions against plain Python over random records, with one entity owning a third of them."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal as D

from conftest import AS_OF
from surety.operators import decide

NOW = datetime.fromisoformat(AS_OF)


def records(seed: int = 7, entities: int = 150, debts: int = 900):
    rnd = random.Random(seed)
    names = [f"E{n}" for n in range(entities)]
    owner = lambda: "E0" if rnd.random() < 1 / 3 else rnd.choice(names[:-5])
    rows = [
        (f"L{n}", owner(), rnd.choice(["A", "B", None]),
         rnd.choice([None, *(f"{rnd.randint(0, 40)}000.00" for _ in range(9))]), f"{rnd.randint(0, 900)}.55",
         rnd.choice(["EQ", "TU"]), rnd.choice([1, 1, 1, 20, 100, 143, 167, 168]) if rnd.random() < 0.2 else 3)
        for n in range(debts)
    ]
    incomes = [(e, rnd.choice([None, "0.00", *(f"{rnd.randint(1, 90)}123.45" for _ in range(8))]), 1)
               for e in names if rnd.random() < 0.95]
    repaid = [(e, rnd.choice([0, 0, 1, 2, 3, None])) for e in names if rnd.random() < 0.9]
    return names, rows, incomes, repaid


def decide_one(debts, income, missed):
    days = lambda hours: (NOW.date() - (NOW - timedelta(hours=hours)).date()).days
    known = [D(d[3]) for d in debts if d[3] is not None]
    exposure = sum(known) if known else None
    monthly = sum(D(d[4]) for d in debts) if debts else None
    worst = max((days(d[6]) for d in debts), default=0)
    stale = sorted({d[5] for d in debts if days(d[6]) >= 7})
    copies = sum(n > 1 for n in Counter((d[2], d[3]) for d in debts).values())
    ratio = None
    if income is not None and D(income) > 0 and monthly is not None:
        ratio = (monthly * 1200 / D(income)).quantize(D("0.01"), ROUND_HALF_UP)
    blocking = []
    if worst >= 7:
        blocking.append("LIABILITY_FEED_STALENESS")
    if income is None:
        blocking.append("INCOME_COMPLETENESS")
    if copies:
        blocking.append("LIABILITY_UNIQUENESS")
    late = missed or 0
    if blocking:
        outcome = "REFER_TO_HUMAN"
    elif ratio is not None and ratio < 40 and late <= 1:
        outcome = "APPROVE"
    elif ratio is not None and ratio < 50 and late <= 2:
        outcome = "REFER_TO_HUMAN"
    else:
        outcome = "DECLINE"
    return exposure, monthly, ratio, worst, stale, copies, blocking, outcome


def test_decisions_match(make, thresholds):
    names, debts, incomes, repaid = records()
    src = make(debts, incomes=incomes, applicants=names, repayments=repaid)
    got = {
        r.applicant_id: (r.outstanding_exposure, r.monthly_obligations, r.dti_pct, r.worst_staleness_days,
                         r.stale_feeds, r.duplicate_liabilities, r.blocking_failures, r.decision)
        for r in decide.decisions(src, AS_OF, thresholds).collect()
    }
    mine = defaultdict(list)
    for d in debts:
        mine[d[1]].append(d)
    income, missed = {i[0]: i[1] for i in incomes}, dict(repaid)
    want = {e: decide_one(mine[e], income.get(e), missed.get(e)) for e in names}
    assert got == want
    assert len({w[-1] for w in want.values()}) == 3 and len({tuple(w[-2]) for w in want.values()}) >= 5
