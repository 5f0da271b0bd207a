"""End to end: decide a population, keep the records, decide again later."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surety.functions.clock import AsOf, instant
from surety.model import LIABILITIES, Sources
from surety.operators import decide, incremental, late
from surety.operators.audit import drift_of_rounds
from surety.operators.incremental import Maintained
from surety.operators.signals import feed_trust, scoped, unified_signals
from surety.sources.sinks import BATCH_KEYS, append_batch, replace_feeds, stored_table


@dataclass(frozen=True)
class Decisions:
    """The records of one batch. ``rejects`` are requested ids with no applicant."""

    audit: DataFrame
    sources: DataFrame
    batch: DataFrame
    rejects: DataFrame | None = None
    keys: dict[str, Column] = field(default_factory=dict)  # date and id of the batch, as constants
    audit_on: Callable[[DataFrame], DataFrame] | None = None  # the audit on given liability records

    def snapshot(self) -> DataFrame:
        return decide.trust_snapshot(self.audit, self.batch)


def assess(
    sources: Sources,
    decided_by: str,
    as_of: AsOf,
    thresholds: DataFrame,
    partner: DataFrame | None = None,
    population: DataFrame | None = None,
    strict: bool = False,
) -> Decisions:
    """Decide every applicant, or only those listed in ``population(applicant_id)``.

    An applicant listed twice in the sources fails the job: both rows would get
    one decision id, and lineage would multiply.
    """
    sources = replace(sources, applicants=late.one_row_per_key(sources.applicants, "applicant_id", "applicants table"))
    rejects, scope = None, sources
    if population is not None:
        # Only the applicants are restricted by a join with the list. The other tables are reduced to one row per applicant
        # and joined to them anyway; restricting each of their raw tables would sort the whole list again for every one.
        scope = replace(sources, applicants=sources.applicants.join(
            population.select("applicant_id"), "applicant_id", "left_semi"))
        rejects = (
            population.select("applicant_id").distinct()
            .join(sources.applicants.select("applicant_id"), "applicant_id", "left_anti")
            .withColumn("reason", F.lit("UNKNOWN_APPLICANT"))
        )

    def audit_on(liabilities: DataFrame) -> DataFrame:
        decided = decide.decisions(scope.with_liabilities(liabilities), as_of, thresholds, partner, strict)
        return decide.audit_records(decided, as_of, decided_by)

    # feed signals describe the whole feeds, also when few applicants are decided
    signals = unified_signals(feed_trust(scoped(sources), as_of, thresholds), partner, with_ids=True)
    return Decisions(
        audit=audit_on(scope.liabilities),
        # joining the plain applicants gives the ids without deciding twice
        sources=decide.decision_sources(
            decide.decision_keys(scope.applicants, as_of, decided_by), scope.liabilities),
        batch=decide.trust_batch(signals, as_of, decided_by),
        rejects=rejects,
        keys={"decision_date": F.to_date(instant(as_of)),
              "trust_batch_id": decide.trust_batch_id(as_of, decided_by)},
        audit_on=audit_on,
    )


def _not_yet_stored(
    spark: SparkSession, df: DataFrame, path: str, batch: dict[str, Column], *key: str
) -> DataFrame:
    """Rows whose key is not in the table yet, so that a repeated run adds nothing.

    Date and batch are constants and the table is laid out by them: the first
    run of a batch looks at no stored file, a repeated one only at its own.
    Keys are compared null-safe.
    """
    try:
        stored = stored_table(spark, path, df.schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return df
    for name, value in batch.items():
        stored = stored.filter(F.col(name) == value)
    there = stored.select(*[F.col(k).alias(f"_stored_{k}") for k in key])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_stored_{k}")) for k in key])
    return df.join(there, same, "left_anti")


SIGNAL_KEY = ("trust_batch_id", "signal_source", "signal_id", "scope_object", "feed_name", "record_identifier", "signal_name")


def record(spark: SparkSession, decisions: Decisions, folder: str) -> None:
    """Append the batch. Signals and sources go first; the audit row is the commit mark.

    The audit is computed on the liability records as they were stored with the
    batch, so its figures and its lineage are of one state even if the facts
    are reloaded in between. Ids do not depend on when a plan runs, so a run
    repeated after a failure completes what is missing and changes nothing
    that is there.
    """
    def append(name: str, df: DataFrame, *key: str) -> None:
        path = f"{folder}/{name}"
        append_batch(_not_yet_stored(spark, df, path, decisions.keys, *key), path)

    append("trust_batch", decisions.batch, *SIGNAL_KEY)
    append("decision_sources", decisions.sources, "decision_id", "liability_id")
    audit = decisions.audit
    if decisions.audit_on is not None:
        kept = stored_table(spark, f"{folder}/decision_sources", decisions.sources.schema)
        for name, value in decisions.keys.items():
            kept = kept.filter(F.col(name) == value)
        audit = decisions.audit_on(kept.select("liability_id", "applicant_id", *decide.RECORDED_COLUMNS[1:]))
    append("decision_audit", audit, "decision_id")


def recorded(spark: SparkSession, folder: str) -> Decisions:
    audit = stored_table(spark, f"{folder}/decision_audit")
    # rows of a batch that never reached its commit mark are not shown; there is
    # one row per batch on the right, and the left is laid out by the same key
    done = audit.select(*BATCH_KEYS).distinct()
    return Decisions(
        audit=audit,
        sources=stored_table(spark, f"{folder}/decision_sources").join(done, list(BATCH_KEYS), "left_semi"),
        batch=stored_table(spark, f"{folder}/trust_batch").join(done, list(BATCH_KEYS), "left_semi"),
    )


@dataclass(frozen=True)
class Redecision:
    """Both rounds of decisions over one population, and the sources as they ended up."""

    first: Decisions
    second: Decisions
    sources_now: Sources

    def audit(self) -> DataFrame:
        return self.first.audit.unionByName(self.second.audit)

    def drift(self, carry: Sequence[str | Column] = ()) -> DataFrame:
        """Both rounds against the second one's figures, which are those of now."""
        return drift_of_rounds(self.first.audit, self.second.audit, carry)


def redecide(
    sources: Sources, batch: DataFrame, feed: str, decided_by: str,
    first_as_of: AsOf, second_as_of: AsOf, thresholds: DataFrame,
) -> Redecision:
    """Decide, let the stalled feed recover, decide again."""
    before = assess(sources, decided_by, first_as_of, thresholds)
    now = sources.with_liabilities(late.apply_late(sources.liabilities, batch, feed, second_as_of))
    return Redecision(before, assess(now, decided_by, second_as_of, thresholds), now)


def redecide_affected(
    sources: Sources, kept: Maintained, batch: DataFrame, feed: str | None, decided_by: str, as_of: AsOf,
    thresholds: DataFrame, partner: DataFrame | None = None, strict: bool = False,
) -> tuple[Decisions, Maintained]:
    """Decide again only the applicants a late batch touches, and hand back the state for the next batch.

    ``sources`` and ``kept`` are those before the batch. Figures come from the
    kept rollup corrected by the change set; facts of applicants the batch does
    not touch are not aggregated. The records written are like those of
    :func:`assess` for that population after the batch.
    """
    now = incremental.maintain(kept, sources.liabilities, batch, feed, as_of)
    mine = now.restricted()
    whole = replace(sources, applicants=late.one_row_per_key(sources.applicants, "applicant_id", "applicants table"))
    scope = whole.restrict(now.affected)
    theirs = late.merge_late(scope.liabilities.select(*sources.liabilities.columns), batch)
    feeds = late.merge_late(sources.liabilities, batch)
    if feed is not None:
        theirs, feeds = (late.feed_catch_up(df, feed, as_of) for df in (theirs, feeds))
    decided = decide.decisions(scope, as_of, thresholds, partner, strict, kept=mine)
    signals = unified_signals(feed_trust(scoped(sources.with_liabilities(feeds)), as_of, thresholds), partner, with_ids=True)
    made = Decisions(
        audit=decide.audit_records(decided, as_of, decided_by),
        sources=decide.decision_sources(decide.decision_keys(scope.applicants, as_of, decided_by), theirs),
        batch=decide.trust_batch(signals, as_of, decided_by),
        keys={"decision_date": F.to_date(instant(as_of)), "trust_batch_id": decide.trust_batch_id(as_of, decided_by)},
    )
    return made, now


def recover_feed(
    spark: SparkSession, path: str, batch: DataFrame, feed: str | None = None, as_of: AsOf | None = None
) -> list[str]:
    """Apply a late batch to a stored liabilities table, rewriting only the feeds it touches.

    Touched are the feeds named in the batch, the feeds of rows it refreshes,
    and ``feed`` if that one catches up as a whole. Their names are the only
    thing brought to the driver. A repeated run changes nothing.
    """
    schema = batch.schema if set(batch.columns) == set(LIABILITIES.names) else LIABILITIES
    stored = stored_table(spark, path, schema)
    incoming = batch.select(late.KEY, "source_system")
    refreshed = stored.select(late.KEY, "source_system").join(incoming.select(late.KEY), late.KEY, "left_semi")
    names = incoming.select("source_system").union(refreshed.select("source_system")).distinct()
    touched = {r.source_system for r in names.collect()} | ({feed} if feed else set())
    own = F.col("source_system").isin(*(touched - {None})) if touched - {None} else F.lit(False)
    if None in touched:
        own = own | F.col("source_system").isNull()
    facts = stored.filter(F.coalesce(own, F.lit(False))).select(*batch.columns)
    merged = late.merge_late(facts, batch)
    if feed:
        merged = late.feed_catch_up(merged, feed, as_of)
    replace_feeds(merged, path)
    return sorted(touched, key=lambda n: (n is None, n or ""))


def late_path(path: str) -> str:
    """Where the late batches of a stored liabilities table are kept."""
    return f"{path.rstrip('/')}_late"


def append_late(batch: DataFrame, path: str, version: int) -> None:
    """Keep a late batch beside the stored table, as one version; no file that exists is touched.

    Versions count upwards. A batch with a doubled key fails. Appending a
    version again, as after a failure, changes nothing that is read.
    """
    rows = late.one_row_per_key(batch).withColumn("version", F.lit(version).cast("bigint"))
    rows.write.mode("append").partitionBy("version").parquet(late_path(path))


def current_liabilities(spark: SparkSession, path: str) -> DataFrame:
    """The stored table with all late versions applied, the latest figures of each key winning.

    Versions are reduced to one row per key first: figures of the latest, all
    else of the earliest one, which is what applying them one after the other
    gives. Then they meet the facts in one merge.
    """
    facts = stored_table(spark, path)
    schema = T.StructType([*facts.schema.fields, T.StructField("version", T.LongType())])
    try:
        versions = stored_table(spark, late_path(path), schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return facts
    fixed = [c for c in facts.columns if c not in (late.KEY, *late.REFRESHED)]
    latest = versions.groupBy(late.KEY).agg(
        F.min_by(F.struct(*fixed), "version").alias("_first"), F.max_by(F.struct(*late.REFRESHED), "version").alias("_last"))
    return late.merge_late(facts, latest.select(late.KEY, "_first.*", "_last.*").select(*facts.columns))


def compact_late(spark: SparkSession, path: str, target: str) -> None:
    """Write the table with its late versions applied to a new place, laid out by feed."""
    current_liabilities(spark, path).write.partitionBy("source_system").parquet(target)
