"""Verdict, decision and metrics as SQL functions, for readers who come with ``spark.sql``.

Each is a temporary function with an SQL body over views of the operators, so Catalyst inlines it: asked for one entity its
key reaches every scan, asked for a column of entities it becomes one join. None of them runs Python.

    entity_trust(id)               the verdict with its evidence, as a struct; also for ids that nobody knows
    entity_trust_of(id)            the same as a table of one row, none for ids that no table knows
    assess(id, decided_by)         the answer to a request for a decision, as a struct; null for an unknown applicant
    assess_of(id, decided_by)      the same as a table of one row
    lagging_records(scope)         records more than seven days behind the newest load of the table with that scope name
    lagging_by_feed(scope)         the same by feed, with record counts
    metric_value(scope, column, metric)    a bound metric; null where no such binding exists
    feed_status(scope, feed)       PASS, WARN, FAIL or UNGOVERNED; null for a feed that never delivered

Functions only answer. Keeping the records of a decision is :func:`surety.plans.assess.record`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.functions.clock import AsOf, instant
from surety.functions.ids import id_part
from surety.model import Sources
from surety.operators import metrics
from surety.operators.decide import POLICY_VERSION, decisions
from surety.operators.profile import entity_state
from surety.operators.signals import feed_trust, scoped
from surety.operators.trust import entity_trust, with_verdict

FUNCTIONS = ("entity_trust", "entity_trust_of", "assess", "assess_of", "lagging_records", "lagging_by_feed", "metric_value",
             "feed_status")


def _everybody(sources: Sources) -> DataFrame:
    """Applicants, and ids that only other tables hold: a verdict can be asked for on them too."""
    known = sources.applicants.select("applicant_id", "loaded_at")
    others = reduce(DataFrame.union, [df.select("applicant_id") for n, df in sources.items() if n != "applicants"])
    strangers = others.distinct().join(known.select("applicant_id"), "applicant_id", "left_anti")
    return known.unionByName(strangers.withColumn("loaded_at", F.lit(None).cast("timestamp")))


def _verdicts(sources: Sources, as_of: AsOf, thresholds: DataFrame, partner: DataFrame | None, strict: bool) -> DataFrame:
    state = entity_state(Sources(_everybody(sources), sources.income, sources.liabilities, sources.repayment), as_of, thresholds)
    return with_verdict(state, sources, as_of, thresholds, partner, strict).select("trust_detail.*")


def _nobody(sources: Sources, as_of: AsOf, thresholds: DataFrame, partner: DataFrame | None, strict: bool) -> DataFrame:
    """The verdict on an id that no table holds: one row, with what table-wide signals say of everybody."""
    spark = sources.applicants.sparkSession
    one = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in sources.applicants.schema])
    none = {n: df.filter(F.lit(False)) for n, df in sources.items()}
    return entity_trust(Sources(**none | {"applicants": one}), as_of, thresholds, partner, strict)


def _outcomes(sources: Sources, as_of: AsOf, thresholds: DataFrame, partner: DataFrame | None, strict: bool) -> DataFrame:
    """What a request is answered with, and the parts of the decision's id that are known before it is asked."""
    made = decisions(sources, as_of, thresholds, partner, strict)
    parts = F.concat_ws("|", id_part(F.col("applicant_id")), id_part(F.col("application_id")), id_part(instant(as_of)))
    return made.select(
        "applicant_id", "decision", F.col("decision_reason").alias("reason"), F.col("verdict").alias("trust_verdict"), "dti_pct",
        "risk_tier", "outstanding_exposure", "worst_staleness_days", F.lit(POLICY_VERSION).alias("policy_version"),
        parts.alias("id_parts"))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _typed(df: DataFrame, *names: str) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names or df.columns)


def _struct(names: Sequence[str], source: str, changed: dict[str, str] | None = None) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {(changed or {}).get(n, f'{source}.{n}')}" for n in names) + ")"


def register_functions(
    spark: SparkSession, sources: Sources, as_of: AsOf, thresholds: DataFrame, partner: DataFrame | None = None,
    strict: bool = False, bindings: Sequence[metrics.MetricBinding] = (), tables: dict[str, DataFrame] | None = None,
    parents: dict[str, tuple[DataFrame, str]] | None = None,
) -> list[str]:
    """Create the functions in the session, over these tables and this instant; registering again replaces them.

    ``tables``: further tables with a feed and a load time, by scope name, that the metric functions know besides the four.
    """
    known = scoped(sources) | (tables or {})
    verdicts = _verdicts(sources, as_of, thresholds, partner, strict)
    outcomes = _outcomes(sources, as_of, thresholds, partner, strict)
    views = {"_surety_verdicts": verdicts, "_surety_nobody": _nobody(sources, as_of, thresholds, partner, strict),
             "_surety_outcomes": outcomes, "_surety_feeds": feed_trust(known, as_of, thresholds)}
    key = sources.applicants.schema["applicant_id"].dataType.simpleString()
    for n, (scope, df) in enumerate(known.items()):
        views[f"_surety_lag_{n}"] = metrics.lagging_records(df)
        views[f"_surety_lag_feeds_{n}"] = metrics.lagging_by_feed(df).withColumn("scope_object", F.lit(scope))
    for n, b in enumerate(bindings):
        views[f"_surety_metric_{n}"] = metrics.evaluate(known, [b], as_of, parents).select("measured")
    for name, df in views.items():
        df.createOrReplaceTempView(name)

    def function(signature: str, returns: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {returns} RETURN {body}")

    evidence = verdicts.columns
    shape = f"struct<{', '.join(f'{n}:{verdicts.schema[n].dataType.simpleString()}' for n in evidence)}>"
    # the verdict on nobody is one row that does not depend on the id: a subquery of its own, to which the id is added outside
    function(f"_surety_told(id {key}, known {shape}, nobody {shape})", shape,
             f"coalesce(known, {_struct(evidence, 'nobody', {'applicant_id': 'id'})})")
    function(f"entity_trust(id {key})", shape, "_surety_told(id, "
             f"(SELECT any_value({_struct(evidence, 'v')}) FROM _surety_verdicts v WHERE v.applicant_id = id), "
             f"(SELECT {_struct(evidence, 'w')} FROM _surety_nobody w))")
    function(f"entity_trust_of(id {key})", f"TABLE({_typed(verdicts)})",
             f"SELECT {', '.join(f'v.{n}' for n in evidence)} FROM _surety_verdicts v WHERE v.applicant_id = id")

    answer = ["decision_id", "applicant_id", "decision", "reason", "trust_verdict", "dti_pct", "risk_tier", "outstanding_exposure",
              "worst_staleness_days", "policy_version"]
    by = "coalesce(concat(length(decided_by), ':', decided_by), '-')"
    minted = f"concat('DEC-', substring(sha2(concat(o.id_parts, '|', {by}), 256), 1, 48))"
    own = {n: outcomes.schema[n].dataType.simpleString() for n in answer[1:]}
    types = {"decision_id": "string", **own}
    request = f"id {key}, decided_by STRING"
    # a correlated subquery may not aggregate its own and outer columns together: the decider's name is added outside of it
    found = (f"(SELECT any_value({_struct([*answer[1:], 'id_parts'], 'x')}) FROM _surety_outcomes x WHERE x.applicant_id = id)")
    returned = f"struct<{', '.join(f'{n}:{types[n]}' for n in answer)}>"
    outcome = f"struct<{', '.join(f'{n}:{t}' for n, t in own.items())}, id_parts:string>"
    function(f"_surety_answer(o {outcome}, decided_by STRING)", returned,
             f"CASE WHEN o IS NOT NULL THEN {_struct(answer, 'o', {'decision_id': minted})} END")
    function(f"assess({request})", returned, f"_surety_answer({found}, decided_by)")
    function(f"assess_of({request})", f"TABLE({', '.join(f'{n} {types[n]}' for n in answer)})",
             f"SELECT {minted}, {', '.join(f'o.{n}' for n in answer[1:])} FROM _surety_outcomes o WHERE o.applicant_id = id")

    def chosen(cases: list[tuple[str, str]]) -> str:
        """One of several scalar subqueries; a constant argument leaves the others out of the plan."""
        return "CASE " + " ".join(f"WHEN {when} THEN {value}" for when, value in cases) + " END" if cases else "CAST(NULL AS BIGINT)"

    scopes = list(known)
    function("lagging_records(scope STRING)", "BIGINT", chosen(
        [(f"scope = {_quoted(s)}", f"(SELECT lagging_records FROM _surety_lag_{n})") for n, s in enumerate(scopes)]))
    parts = " UNION ALL ".join(f"SELECT scope_object, feed_name, record_count, lagging_records FROM _surety_lag_feeds_{n}"
                               for n in range(len(scopes)))
    function("lagging_by_feed(scope STRING)", "TABLE(feed_name STRING, record_count BIGINT, lagging_records BIGINT)",
             f"SELECT feed_name, record_count, lagging_records FROM ({parts}) p WHERE p.scope_object = scope")
    function("metric_value(scope STRING, column_name STRING, metric STRING)", "BIGINT", chosen(
        [(f"scope = {_quoted(b.scope_object)} AND column_name = {_quoted(b.column)} AND metric = {_quoted(b.kind)}",
          f"(SELECT measured FROM _surety_metric_{n})") for n, b in enumerate(bindings)]))
    function("feed_status(scope STRING, feed STRING)", "STRING",
             "(SELECT any_value(f.trust_status) FROM _surety_feeds f WHERE f.scope_object = scope AND f.feed_name = feed)")
    return list(FUNCTIONS)

