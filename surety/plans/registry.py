"""Every operator as a named query over the star tables, in a shape plain SQL can match.

Instants are shown as text, lists as joined text and totals in fixed decimal
types, so that another engine's answer can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surety.model import SCOPES, input_edges, seed_tags, seed_thresholds
from surety.operators import audit as au
from surety.operators import dashboard, decide, exposure, gaps, history, incremental, late, metrics, profile, signals, tags, trust
from surety.plans.assess import Redecision, assess, redecide, redecide_affected
from surety.plans.semantic import LENDING
from surety.plans.sql_functions import register_functions
from surety.sources import conformance, csv_feed, generator, rejects as judged, star
from surety.sources.offsets import load_sources

AS_OF = star.AS_OF
BEFORE = "2024-02-29 23:30:00"  # load time and first round of decisions, where there are two
AFTER = "2024-03-09 23:30:00"   # a second late batch and a third round
DECIDER = "LENDING_AGENT_V1"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Presentation ---------------------------------------------------------------
def ts(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def text_list(c: str | Column) -> Column:
    return F.array_join(F.transform(F.sort_array(c), lambda x: x.cast("string")), ",")


def money(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(22,2)")


def show(df: DataFrame, **changed: Column) -> DataFrame:
    """The frame with some columns replaced by their displayed form."""
    return df.withColumns(changed)


def big(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# Common inputs --------------------------------------------------------------
def _src(spark, d):
    return star.sources(spark, d, AS_OF)


def _thr(spark):
    return seed_thresholds(spark)


def _tables(spark, d):
    return signals.scoped(_src(spark, d), events=star.event_log(spark, d))


def _feeds(spark, d):
    return signals.feed_trust(_tables(spark, d), AS_OF, _thr(spark))


def _decided(spark, d):
    return assess(_src(spark, d), DECIDER, AS_OF, _thr(spark))


def _two_rounds(spark, d) -> Redecision:
    return redecide(
        star.sources(spark, d, BEFORE), star.late_batch(spark, d, AS_OF), "BUREAU_TU", DECIDER,
        BEFORE, AS_OF, _thr(spark))


def _drift(spark, d) -> DataFrame:
    return _two_rounds(spark, d).drift()


def _first_lineage(spark, d, as_recorded=False) -> DataFrame:
    made = _decided(spark, d)
    now = None if as_recorded else _src(spark, d).liabilities
    return au.source_lineage(made.audit, made.sources, now)


# Sources --------------------------------------------------------------------
@query
def load_offsets(spark, d):
    return _src(spark, d).liabilities.select(
        "liability_id", "source_system", "effective_date", ts("loaded_at").alias("loaded_at"))


@query
def schema_conformance(spark, d):
    return conformance.conformance_report(_src(spark, d))


@query
def row_counts(spark, d):
    return conformance.row_counts({SCOPES[n]: df for n, df in _src(spark, d).items()})


@query
def csv_format(spark, d):
    seed = star.seeds(spark, d).income
    line = csv_feed.as_csv_line(*[F.col(c) for c in seed.columns])
    parsed = csv_feed.from_csv_line(F.col("line"), seed.schema).alias("row")
    return seed.select(line.alias("line")).select(parsed).select("row.*")


def _spoilt_lines(spark, d) -> judged.Judged:
    """Income records as lines of a feed, one in ten of them spoilt in one of five ways."""
    seed = star.seeds(spark, d).income
    way = F.col("applicant_id") % 50
    text = {c: F.col(c).cast("string") for c in seed.columns}
    text["gross_annual_income"] = F.when(way == 0, "n/a").otherwise(text["gross_annual_income"])
    text["applicant_id"] = F.when(way == 2, F.lit(None)).otherwise(text["applicant_id"])
    text["verification_method"] = F.when(way.isin(3, 4), F.repeat(F.lit("x"), 41)).otherwise(text["verification_method"])
    text["loaded_hours_ago"] = F.when(way == 4, "soon").otherwise(text["loaded_hours_ago"])
    line = F.concat_ws(",", *[F.coalesce(text[c], F.lit("")) for c in seed.columns])
    cut = F.when(way == 1, F.substring_index(line, ",", len(seed.columns) - 2)).otherwise(line)
    return judged.judge_lines(seed.select(cut.alias("line")), seed.schema, **judged.contract_rules("income"))


@query
def csv_rejects(spark, d):
    """Lines that cannot be loaded, with every reason."""
    return show(_spoilt_lines(spark, d).rejects, reasons=F.array_join("reasons", ","))


@query
def csv_accepted(spark, d):
    return _spoilt_lines(spark, d).good


@query
def csv_reject_counts(spark, d):
    return judged.reject_counts(_spoilt_lines(spark, d).rejects)


def _index(spark, d):
    return star.table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("i"))


def _generated(spark, d):
    """The four feeds over as many entities as there are customers, with example, duplicate and orphan."""
    customer = star.table(spark, d, "customer")
    n = customer.agg(F.count(F.lit(1)).alias("n")).scalar()
    grid = customer.select(
        (F.col("c_custkey") + 1).alias("applicant_idx"),
        F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("slot"),
    ).withColumn("i", F.col("slot") * n + F.col("applicant_idx"))
    return generator.planted(spark, _index(spark, d), grid)


@query
def gen_liabilities(spark, d):
    return _generated(spark, d).liabilities


@query
def gen_applicants(spark, d):
    return _generated(spark, d).applicants


@query
def gen_income(spark, d):
    return _generated(spark, d).income


@query
def gen_repayment(spark, d):
    return _generated(spark, d).repayment


@query
def gen_late_batch(spark, d):
    """The late batch, and whether each of its records is among the generated ones."""
    known = _generated(spark, d).liabilities.select("liability_id", F.lit(True).alias("known"))
    return generator.late_batch(spark).join(known, "liability_id", "left").withColumn(
        "already_known", F.coalesce("known", F.lit(False))).drop("known")


@query
def late_merge(spark, d):
    merged = late.merge_late(_src(spark, d).liabilities, star.late_batch(spark, d, AS_OF))
    return show(merged, loaded_at=ts("loaded_at"))


@query
def feed_catch_up(spark, d):
    caught = late.feed_catch_up(_src(spark, d).liabilities, "BUREAU_TU", AS_OF)
    return caught.select("liability_id", "source_system", ts("loaded_at").alias("loaded_at"))


@query
def late_apply(spark, d):
    done = late.apply_late(
        _src(spark, d).liabilities, star.late_batch(spark, d, AS_OF), "BUREAU_TU", AS_OF)
    return show(done, loaded_at=ts("loaded_at"))


# Data quality ---------------------------------------------------------------
@query
def freshness(spark, d):
    parts = [
        df.agg(metrics.freshness(F.col("loaded_at"), AS_OF).cast("bigint").alias("seconds_behind"))
        .select(F.lit(scope).alias("scope_object"), "seconds_behind")
        for scope, df in _tables(spark, d).items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def lagging_records(spark, d):
    return metrics.lagging_records(_src(spark, d).liabilities)


@query
def lagging_by_feed(spark, d):
    return metrics.lagging_by_feed(star.event_log(spark, d)).unionByName(
        metrics.lagging_by_feed(_src(spark, d).liabilities))


@query
def feed_gaps(spark, d):
    """Spells of deliveries in the event log, and how long each feed was silent after them."""
    out = gaps.feed_gaps(star.event_log(spark, d), AS_OF)
    return show(out, first_load_at=ts("first_load_at"), last_load_at=ts("last_load_at"))


@query
def null_count(spark, d):
    return _src(spark, d).income.agg(
        metrics.null_count(F.col("gross_annual_income")).alias("null_incomes"))


@query
def dup_key_count(spark, d):
    return metrics.duplicate_key_count(star.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query
def key_collisions(spark, d):
    return metrics.key_collisions(star.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query
def content_dups(spark, d):
    return exposure.content_duplicates(_src(spark, d).liabilities)


@query
def invalid_domain(spark, d):
    return _src(spark, d).applicants.agg(metrics.accepted_values(
        F.col("employment_status"), star.SEGMENT_DOMAIN).alias("invalid_values"))


@query
def entity_completeness(spark, d):
    s = _src(spark, d)
    return metrics.entity_completeness(s.applicants, s.income, "applicant_id", "gross_annual_income")


@query
def orphans(spark, d):
    t = lambda name: star.table(spark, d, name)
    links = [
        ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("events", "user_id", "customer", "c_custkey"),
        ("documents", "doc_id", "labels", "doc_id"),
    ]
    out = None
    for child, ck, parent, pk in links:
        part = metrics.orphan_count(t(child), t(parent), ck, pk).select(
            F.lit(child).alias("child"), F.lit(parent).alias("parent"), "orphan_records", "orphan_keys")
        out = part if out is None else out.unionByName(part)
    return out


BINDINGS = (
    metrics.MetricBinding("RAW.LIABILITIES", "loaded_at", "FRESHNESS", "TIMELINESS"),
    metrics.MetricBinding("RAW.LIABILITIES", "loaded_at", "LAGGING_RECORD_COUNT", "TIMELINESS"),
    metrics.MetricBinding("RAW.LIABILITIES", "liability_id", "DUPLICATE_COUNT", "UNIQUENESS"),
    metrics.MetricBinding("RAW.LIABILITIES", "applicant_id", "ORPHAN_COUNT", "INTEGRITY"),
    metrics.MetricBinding("RAW.INCOME_VERIFICATION", "gross_annual_income", "NULL_COUNT", "COMPLETENESS"),
    metrics.MetricBinding("RAW.INCOME_VERIFICATION", "loaded_at", "FRESHNESS", "TIMELINESS"),
    metrics.MetricBinding("RAW.APPLICANTS", "employment_status", "INVALID_VALUE_COUNT", "VALIDITY",
                          star.SEGMENT_DOMAIN),
    metrics.MetricBinding("RAW.REPAYMENT_HISTORY", "missed_payments_12m", "NULL_COUNT", "COMPLETENESS"),
)


def _measured(spark, d):
    s = _src(spark, d)
    return metrics.evaluate(
        signals.scoped(s), BINDINGS, AS_OF, {"applicant_id": (s.applicants, "applicant_id")})


@query
def metric_batch(spark, d):
    return show(_measured(spark, d), evaluated_at=ts("evaluated_at"))


@query
def metric_grading(spark, d):
    return metrics.grade_metrics(_measured(spark, d), _thr(spark)).drop("evaluated_at")


# Trust signals --------------------------------------------------------------
@query
def feed_trust(spark, d):
    return big(show(_feeds(spark, d), last_loaded_at=ts("last_loaded_at")),
               "staleness_days", "staleness_hours")


@query
def thresholds(spark, d):
    return signals.governed_thresholds(_thr(spark), signals.feed_loads(_tables(spark, d)))


@query
def unified_signals(spark, d):
    both = signals.unified_signals(_feeds(spark, d), star.partner_signals(spark, d))
    return show(both, evaluated_at=ts("evaluated_at"))


@query
def tier_inheritance(spark, d):
    return tags.effective_tiers(seed_tags(spark), input_edges(spark), _feeds(spark, d))


@query
def tier_lineage(spark, d):
    """The weakest tier in the whole lineage of every report, up to four levels away."""
    return tags.transitive_tiers(*star.report_lineage(spark, d)).select("object_name", "trust_tier", "inherited_tier", "circular")


@query
def tag_vs_signal(spark, d):
    return tags.tag_agreement(seed_tags(spark), _feeds(spark, d))


@query
def entity_trust(spark, d):
    out = trust.entity_trust(_src(spark, d), AS_OF, _thr(spark), star.partner_signals(spark, d))
    pairs = F.transform("partner_blocking_failures",
                        lambda p: F.concat_ws(":", p["signal_name"], p["occurrences"].cast("string")))
    return big(show(
        out, evaluated_at=ts("evaluated_at"), stale_feeds=text_list("stale_feeds"),
        partner_blocking_failures=F.array_join(pairs, ","),
        blocking_failures=F.array_join("blocking_failures", ",")), "worst_staleness_days")


@query
def entity_trust_strict(spark, d):
    out = trust.entity_trust(
        _src(spark, d), AS_OF, _thr(spark), star.partner_signals(spark, d), strict=True)
    return out.select("applicant_id", F.array_join("blocking_failures", ",").alias("blocking_failures"),
                      "verdict")


# Profile and decision -------------------------------------------------------
@query
def liability_rollup(spark, d):
    out = profile.liability_rollup(_src(spark, d).liabilities, AS_OF, _thr(spark))
    return big(show(
        out, liability_feeds_used=text_list("liability_feeds_used"),
        oldest_liability_loaded_at=ts("oldest_liability_loaded_at"),
        newest_liability_loaded_at=ts("newest_liability_loaded_at")), "max_liability_staleness_days")


@query
def credit_profile(spark, d):
    out = profile.credit_profile(_src(spark, d), AS_OF, _thr(spark))
    return big(show(
        out, liability_feeds_used=text_list("liability_feeds_used"),
        oldest_liability_loaded_at=ts("oldest_liability_loaded_at"),
        newest_liability_loaded_at=ts("newest_liability_loaded_at")),
        "max_liability_staleness_days", "worst_staleness_days_any_source")


def _outcomes(spark, d):
    return decide.decisions(_src(spark, d), AS_OF, _thr(spark))


@query
def decisions(spark, d):
    return big(_outcomes(spark, d).select(
        "applicant_id", "gross_annual_income", "outstanding_exposure", "monthly_obligations", "dti_pct",
        "risk_tier", "missed_payments_12m", "worst_staleness_days", "pct_exposure_stale", "verdict",
        "decision", "policy_note"), "worst_staleness_days")


@query
def decision_reasons(spark, d):
    return _outcomes(spark, d).select("applicant_id", "decision_reason")


@query
def counterfactual(spark, d):
    from surety.functions.rules import counterfactual as policy_alone

    return _outcomes(spark, d).select(
        "applicant_id", "decision",
        policy_alone(F.col("dti_pct"), F.col("missed_payments_12m")).alias("without_trust_signal"))


@query
def decision_audit(spark, d):
    made = _decided(spark, d)
    return _audit_rows(made.audit)


def _audit_rows(audit: DataFrame) -> DataFrame:
    ids = F.col("source_record_ids")
    return big(audit.select(
        "decision_id", "applicant_id", "application_id", ts("decided_at").alias("decided_at"), "decided_by",
        "gross_annual_income", "outstanding_exposure", "monthly_obligations", "dti_pct", "risk_tier",
        "missed_payments_12m", "trust_verdict",
        F.to_json("trust_detail.blocking_failures").alias("blocking_failures"),
        "worst_staleness_days", "pct_exposure_stale", "decision", "decision_reason", "policy_version",
        ids["applicant_record"].alias("applicant_record"), ids["income_record"].alias("income_record"),
        ids["repayment_record"].alias("repayment_record"),
        ids["liability_record_count"].alias("liability_record_count"),
        ids["liability_record_digest"].cast("bigint").alias("liability_record_digest"),
        text_list("source_feeds_used").alias("source_feeds_used")), "worst_staleness_days")


@query
def decision_sources(spark, d):
    return _decided(spark, d).sources.select(
        "decision_id", "applicant_id", "liability_id", "outstanding_balance", "source_system",
        ts("loaded_at").alias("loaded_at"))


@query
def recorded_ids(spark, d):
    return au.recorded_ids(_decided(spark, d).sources).select("applicant_id", "liability_record_id")


@query
def trust_snapshot(spark, d):
    return show(_decided(spark, d).snapshot(), captured_at=ts("captured_at"))


@query
def trust_snapshot_partner(spark, d):
    made = assess(_src(spark, d), DECIDER, AS_OF, _thr(spark), star.partner_signals(spark, d))
    return show(made.snapshot(), captured_at=ts("captured_at"))


@query
def decision_audit_partner(spark, d):
    made = assess(_src(spark, d), DECIDER, AS_OF, _thr(spark), star.partner_signals(spark, d))
    pairs = F.transform("trust_detail.partner_blocking_failures",
                        lambda p: F.concat_ws(":", p["signal_name"], p["occurrences"].cast("string")))
    return made.audit.select(
        "decision_id", "applicant_id", "trust_verdict", "decision",
        F.col("trust_detail.partner_trust_index").alias("partner_trust_index"),
        F.array_join(pairs, ",").alias("partner_blocking_failures"),
        F.col("source_record_ids.liability_record_count").alias("liability_record_count"))


def _asked(spark, d):
    """Ids of events as a requested population; most of them belong to no applicant."""
    wanted = star.table(spark, d, "events").select(F.col("event_id").alias("applicant_id"))
    return assess(_src(spark, d), DECIDER, AS_OF, _thr(spark), population=wanted)


@query
def assess_population(spark, d):
    return _asked(spark, d).audit.select("applicant_id", "decision", "trust_verdict", "dti_pct", "outstanding_exposure")


@query
def rejects(spark, d):
    return _asked(spark, d).rejects


@query
def point_filter(spark, d):
    last = star.table(spark, d, "orders").agg(F.max("o_custkey").alias("k")).scalar()
    return _decided(spark, d).audit.filter(F.col("applicant_id") == last).select(
        "applicant_id", "decision", "trust_verdict", "dti_pct")


@query
def newest_decisions(spark, d):
    return au.newest_decisions(_two_rounds(spark, d).audit(), 100).select(
        "applicant_id", ts("decided_at").alias("decided_at"), "decision", "trust_verdict")


@query
def largest_records(spark, d):
    return au.largest_records(_first_lineage(spark, d), 100).select(
        "applicant_id", "liability_record_id", "outstanding_balance", "supplying_feed")


@query
def assess_result(spark, d):
    return big(decide.assess_result(_decided(spark, d).audit), "worst_staleness_days")


# Audit ----------------------------------------------------------------------
@query
def audit_trail(spark, d):
    made = _decided(spark, d)
    out = au.audit_trail(made.audit, _src(spark, d).applicants).drop("source_record_ids")
    return big(show(out, decided_at=ts("decided_at"), source_feeds_used=text_list("source_feeds_used")),
               "worst_staleness_days")


@query
def source_lineage(spark, d):
    out = show(_first_lineage(spark, d), decided_at=ts("decided_at"),
               record_loaded_at=ts("record_loaded_at"))
    return big(out, "record_age_days_at_decision")


@query
def lineage_as_recorded(spark, d):
    rounds = _two_rounds(spark, d)
    out = au.source_lineage(rounds.first.audit, rounds.first.sources)
    return big(out.select("decision_id", "liability_record_id", "outstanding_balance", "supplying_feed",
                          "record_age_days_at_decision", "pct_of_total_exposure"),
               "record_age_days_at_decision")


@query
def trust_at_decision(spark, d):
    made = _decided(spark, d)
    return show(au.frozen_trust(made.audit, made.batch), captured_at=ts("captured_at"))


@query
def drift(spark, d):
    out = _drift(spark, d)
    return show(out, decided_at=ts("decided_at"), exposure_change=money("exposure_change"),
                dti_change=F.col("dti_change").cast("decimal(18,2)"))


@query
def redecided(spark, d):
    return big(_two_rounds(spark, d).audit().select(
        "applicant_id", ts("decided_at").alias("decided_at"), "dti_pct", "risk_tier", "outstanding_exposure",
        "worst_staleness_days", "trust_verdict", "decision"), "worst_staleness_days")


# Kept by change sets --------------------------------------------------------
def _maintained(spark, d) -> incremental.Maintained:
    """State of the first load, brought forward by the late batch and the feed's catching up."""
    facts = star.sources(spark, d, BEFORE).liabilities
    return incremental.maintain(incremental.start(facts), facts, star.late_batch(spark, d, AS_OF), "BUREAU_TU", AS_OF)


@query
def change_set(spark, d):
    """What the late batch changes: each touched record as it was and as it is."""
    out = incremental.change_set(
        star.sources(spark, d, BEFORE).liabilities, star.late_batch(spark, d, AS_OF), "BUREAU_TU", AS_OF)
    return show(out, loaded_at=ts("loaded_at"))


@query
def rollup_maintained(spark, d):
    """The rollup of everybody after the late batch, from the kept state."""
    out = _maintained(spark, d).exposure(AS_OF, _thr(spark))
    return big(out.select(
        "applicant_id", "outstanding_exposure", "monthly_obligations", "liability_count",
        text_list("liability_feeds_used").alias("liability_feeds_used"), text_list("stale_feeds").alias("stale_feeds"),
        ts("oldest_liability_loaded_at").alias("oldest_liability_loaded_at"),
        ts("newest_liability_loaded_at").alias("newest_liability_loaded_at"), "max_liability_staleness_days",
        "exposure_from_stale_feeds", "exposure_from_failed_records",
        F.col("liability_digest").cast("bigint").alias("liability_digest")), "max_liability_staleness_days")


@query
def content_dups_maintained(spark, d):
    return _maintained(spark, d).copies


@query
def decisions_maintained(spark, d):
    """Everybody decided after the late batch, from the kept state."""
    out = decide.decisions(star.sources(spark, d, BEFORE), AS_OF, _thr(spark), kept=_maintained(spark, d))
    return big(out.select(
        "applicant_id", "outstanding_exposure", "monthly_obligations", "dti_pct", "risk_tier", "worst_staleness_days",
        "pct_exposure_stale", "verdict", "decision", "decision_reason"), "worst_staleness_days")


@query
def redecided_affected(spark, d):
    """Only the applicants touched by the late batch are decided again."""
    before = star.sources(spark, d, BEFORE)
    made, _ = redecide_affected(
        before, incremental.start(before.liabilities), star.late_batch(spark, d, AS_OF), "BUREAU_TU", DECIDER, AS_OF, _thr(spark))
    return _audit_rows(made.audit)


# As it was ------------------------------------------------------------------
def _history(spark, d) -> DataFrame:
    """Record versions after two late batches; the second one corrects records of both feeds."""
    return history.record_history(
        star.sources(spark, d, BEFORE).liabilities, BEFORE,
        [history.Arrival(star.late_batch(spark, d, AS_OF), AS_OF, "BUREAU_TU"),
         history.Arrival(star.correction_batch(spark, d, AFTER), AFTER)])


def _three_rounds(spark, d) -> DataFrame:
    """Decision records of three rounds: at the load, with the first late batch, and with the second."""
    rounds = _two_rounds(spark, d)
    now = late.merge_late(rounds.sources_now.liabilities, star.correction_batch(spark, d, AFTER))
    third = assess(rounds.sources_now.with_liabilities(now), DECIDER, AFTER, _thr(spark))
    return rounds.audit().unionByName(third.audit)


@query
def record_versions(spark, d):
    return show(_history(spark, d), **{c: ts(c) for c in ("loaded_at", "valid_from", "valid_to")})


@query
def liabilities_as_of(spark, d):
    """The table as it read an hour before the second late batch."""
    return show(history.as_of(_history(spark, d), "2024-03-09 22:30:00"), loaded_at=ts("loaded_at"))


@query
def lineage_replayed(spark, d):
    """Records behind the decisions of all rounds, each as it read when its decision was made."""
    out = history.lineage_as_of(_three_rounds(spark, d), _history(spark, d))
    times = {c: ts(c) for c in ("decided_at", "record_loaded_at", "version_from", "version_to")}
    return big(show(out, **times), "record_age_days_at_decision")


@query
def profile_replayed(spark, d):
    """Figures of all rounds worked out again from the records of their time."""
    out = history.profile_as_of(_three_rounds(spark, d), _history(spark, d), star.sources(spark, d, BEFORE), _thr(spark))
    return big(show(out, decided_at=ts("decided_at")), "worst_staleness_days")


# From SQL -------------------------------------------------------------------
def _sql(spark, d, text: str, partner=None) -> DataFrame:
    """A query over the tables as views, with the engine's functions at hand."""
    s = _src(spark, d)
    for name, df in s.items():
        df.createOrReplaceTempView(f"lending_{name}")
    star.table(spark, d, "events").createOrReplaceTempView("lending_events")
    register_functions(spark, s, AS_OF, _thr(spark), partner, bindings=BINDINGS, tables={"RAW.EVENTS": star.event_log(spark, d)},
                       parents={"applicant_id": (s.applicants, "applicant_id")})
    return spark.sql(text)


@query
def sql_entity_trust(spark, d):
    """Verdicts of all applicants through the table function, by a lateral join."""
    return _sql(spark, d, """
        SELECT t.applicant_id, date_format(t.evaluated_at, 'yyyy-MM-dd HH:mm:ss') AS evaluated_at,
          CAST(t.worst_staleness_days AS BIGINT) AS worst_staleness_days, array_join(t.stale_feeds, ',') AS stale_feeds,
          t.pct_exposure_from_stale_feeds, t.income_missing, t.duplicate_liabilities, t.partner_trust_index,
          array_join(transform(t.partner_blocking_failures, p -> concat_ws(':', p.signal_name, p.occurrences)), ',')
            AS partner_blocking_failures,
          array_join(t.blocking_failures, ',') AS blocking_failures, t.verdict
        FROM lending_applicants a, LATERAL entity_trust_of(a.applicant_id) t""", star.partner_signals(spark, d))


@query
def sql_assess(spark, d):
    """Every applicant assessed through the scalar function."""
    return _sql(spark, d, f"""
        SELECT r.decision_id, r.applicant_id, r.decision, r.reason, r.trust_verdict, r.dti_pct, r.risk_tier, r.outstanding_exposure,
          CAST(r.worst_staleness_days AS BIGINT) AS worst_staleness_days, r.policy_version
        FROM (SELECT assess(applicant_id, '{DECIDER}') AS r FROM lending_applicants)""")


@query
def sql_trust_of_any_id(spark, d):
    """The verdict on ids that mostly belong to nobody, through the scalar function; and whether a decision could be made."""
    return _sql(spark, d, f"""
        SELECT e.event_id, entity_trust(e.event_id).verdict AS verdict, entity_trust(e.event_id).income_missing AS income_missing,
          assess(e.event_id, '{DECIDER}').decision AS decision
        FROM lending_events e""")


@query
def sql_metrics(spark, d):
    """Lag of every table and feed, and the feed's grade, from SQL."""
    return _sql(spark, d, """
        SELECT s.scope_object, f.feed_name, f.record_count, f.lagging_records, lagging_records(s.scope_object) AS lagging_in_table,
          feed_status(s.scope_object, f.feed_name) AS trust_status,
          metric_value(s.scope_object, 'loaded_at', 'FRESHNESS') AS seconds_behind
        FROM VALUES ('RAW.LIABILITIES'), ('RAW.INCOME_VERIFICATION'), ('RAW.EVENTS') AS s(scope_object),
          LATERAL lagging_by_feed(s.scope_object) f""")


# Metric model ---------------------------------------------------------------
def _logical(spark, d):
    return dict(_src(spark, d).items())


@query
def semantic_query(spark, d):
    out = LENDING.query(
        _logical(spark, d), ["applicant_id", "applicant_name"],
        ["total debt", "monthly_obligations", "liabilities.worst_staleness_days", "stale_exposure",
         "income", "missed_payments"], AS_OF)
    return big(show(out, outstanding_exposure=money("outstanding_exposure"),
                    monthly_obligations=money("monthly_obligations"),
                    stale_exposure=money("stale_exposure")), "worst_staleness_days")


@query
def semantic_by_purpose(spark, d):
    out = LENDING.query(
        _logical(spark, d), ["loan_purpose", "employment_status"],
        ["outstanding_exposure", "verified_annual_income", "missed_payments"], AS_OF)
    return show(out, outstanding_exposure=money("outstanding_exposure"))


@query
def semantic_by_feed(spark, d):
    out = LENDING.query(
        _logical(spark, d), ["bureau feed", "debt type", "loan_purpose"],
        ["outstanding_exposure", "worst_staleness_days"], AS_OF)
    return big(show(out, outstanding_exposure=money("outstanding_exposure")), "worst_staleness_days")


@query
def semantic_total(spark, d):
    out = LENDING.query(
        _logical(spark, d), [], ["debts.total debt", "worst_staleness_days", "income", "missed_payments"], AS_OF)
    return big(show(out, outstanding_exposure=money("outstanding_exposure")), "worst_staleness_days")


@query
def semantic_by_synonym(spark, d):
    out = LENDING.query(_logical(spark, d), ["borrowers.employment_status"], ["credit commitments.total debt"], AS_OF)
    return show(out, outstanding_exposure=money("outstanding_exposure"))


# Reviewer's figures ---------------------------------------------------------
@query
def kpis(spark, d):
    return big(dashboard.kpis(_feeds(spark, d), _decided(spark, d).audit), "worst_staleness_days")


@query
def three_outcomes(spark, d):
    rows = _two_rounds(spark, d).drift(dashboard.outcome_columns())
    return big(dashboard.three_outcomes_of(rows), "first_worst_staleness_days")


@query
def blocked_only(spark, d):
    trail = au.audit_trail(_decided(spark, d).audit, _src(spark, d).applicants)
    return au.blocked_only(trail).select(
        "applicant_id", "applicant_name", "decision", "dti_pct", "pct_exposure_stale", "audit_assessment")


@query
def breach_summary(spark, d):
    return dashboard.breach_summary(_first_lineage(spark, d)).drop("decision_id")


@query
def exposure_by_feed(spark, d):
    return dashboard.exposure_by_feed(_first_lineage(spark, d)).drop("decision_id")


@query
def understated(spark, d):
    out = dashboard.understated(_drift(spark, d))
    return show(out, largest_dti_gap=F.col("largest_dti_gap").cast("decimal(18,2)"))


@query
def dti_long(spark, d):
    return show(dashboard.dti_long(_drift(spark, d)),
                decided_at=ts("decided_at")).drop("decision_id")


@query
def feed_list_ranked(spark, d):
    return big(signals.ranked_feeds(_feeds(spark, d)).select(
        "scope_object", "feed_name", "record_count", "staleness_days", "signal_name", "fail_at",
        "trust_status"), "staleness_days")


@query
def threshold_list_ranked(spark, d):
    governed = signals.governed_thresholds(_thr(spark), signals.feed_loads(_tables(spark, d)))
    return signals.ranked_thresholds(governed).select(
        "signal_name", "is_blocking", "warn_at", "fail_at", "owner_team", "governed_feeds")


@query
def worst_feed(spark, d):
    return big(signals.worst_failing_feed(_feeds(spark, d)).select(
        "scope_object", "feed_name", "record_count", "staleness_days", "fail_at", "owner_team"),
        "staleness_days")
