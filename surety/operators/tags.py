"""Trust-tier tags: allowed values, inheritance from inputs, agreement with live signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.model import CRITICALITY, DATA_DOMAINS, TRUST_TIERS
from surety.sources.staging import staged


def tier_rank(tier: Column) -> Column:
    """Position from strongest to weakest; unknown text ranks weakest."""
    out = F.lit(len(TRUST_TIERS) - 1)
    for rank, name in reversed(list(enumerate(TRUST_TIERS))):
        out = F.when(tier == name, rank).otherwise(out)
    return out


def tier_name(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for i, name in enumerate(TRUST_TIERS):
        out = F.when(rank == i, name).otherwise(out)
    return out


def tags_allowed(tags: DataFrame) -> DataFrame:
    ok = (
        F.col("data_domain").isin(*DATA_DOMAINS)
        & F.col("trust_tier").isin(*TRUST_TIERS)
        & F.col("decision_critical").isin(*CRITICALITY)
    )
    return tags.withColumn("values_allowed", F.coalesce(ok, F.lit(False)))


def inherited_tiers(tags: DataFrame, edges: DataFrame) -> DataFrame:
    """Tags with the weakest tier among declared inputs; objects without inputs keep their own."""
    weakest = (
        edges.join(
            tags.select(F.col("object_name").alias("input_object"),
                        tier_rank(F.col("trust_tier")).alias("rank")),
            "input_object")
        .groupBy("object_name").agg(F.max("rank").alias("rank"))
    )
    return (
        tags_allowed(tags).join(weakest, "object_name", "left")
        .withColumn("inherited_tier",
                    F.coalesce(tier_name(F.col("rank")), F.col("trust_tier")))
        .withColumn("tier_consistent", F.col("inherited_tier") == F.col("trust_tier"))
        .drop("rank")
    )


def effective_tiers(tags: DataFrame, edges: DataFrame, feeds: DataFrame) -> DataFrame:
    """Tags with the tier that live feeds leave them: declared, lowered by what the feeds show now.

    A table with a failing feed is UNCERTIFIED and one with a feed in warning
    at most PROVISIONAL; an object with inputs is as weak as the weakest of
    them, at best its own declared tier.
    """
    worst = F.max(F.when(F.col("trust_status") == "FAIL", 2).when(F.col("trust_status") == "WARN", 1).otherwise(0))
    live = feeds.groupBy(F.col("scope_object").alias("object_name")).agg(
        worst.alias("live_rank"), F.count(F.lit(1)).alias("feeds"), F.sum("record_count").alias("records"))
    own = tags_allowed(tags).join(live, "object_name", "left").withColumn(
        "own_rank", F.greatest(tier_rank(F.col("trust_tier")), F.coalesce("live_rank", F.lit(0))))
    inputs = (
        edges.join(own.select(F.col("object_name").alias("input_object"), F.col("own_rank").alias("input_rank")), "input_object")
        .groupBy("object_name").agg(F.max("input_rank").alias("input_rank"))
    )
    rank = F.greatest("own_rank", F.coalesce("input_rank", F.lit(0)))
    return (
        own.join(inputs, "object_name", "left")
        .withColumn("effective_tier", tier_name(rank))
        .withColumn("tier_holds", F.col("effective_tier") == F.col("trust_tier"))
        .drop("own_rank", "live_rank", "input_rank")
    )


def propagated_ranks(own: DataFrame, edges: DataFrame) -> DataFrame:
    """object_name, rank: the weakest rank among an object and everything it is built from, however far away.

    ``own``: object_name, rank of each object, one row an object. ``edges``:
    object_name, input_object; inputs without a row of their own pass on what
    reaches them. A fixed point by semi-naive rounds: only objects whose rank
    went down in a round are joined with the edges in the next. Ranks are few
    and only get weaker, so cycles end too, and a diamond is no more work than
    its edges. Runs a few jobs a round; rounds are at most the longest chain.
    """
    links = edges.filter("object_name is not null and input_object is not null").select("object_name", "input_object").distinct()
    links = links.filter("object_name <> input_object")
    names = links.select("object_name").union(links.select(F.col("input_object").alias("object_name"))).distinct()
    known = own.select("object_name", F.col("rank").cast("int").alias("rank"))
    passing = names.join(known, "object_name", "left_anti").withColumn("rank", F.lit(0))
    state = staged(known.unionByName(passing))
    frontier = state.filter("rank > 0")
    while True:
        reached = (
            links.join(frontier.select(F.col("object_name").alias("input_object"), "rank"), "input_object")
            .groupBy("object_name").agg(F.max("rank").alias("_reached"))
        )
        state = staged(
            state.drop("changed").join(reached, "object_name", "left")
            .withColumn("changed", F.coalesce(F.col("_reached") > F.col("rank"), F.lit(False)))
            .withColumn("rank", F.greatest("rank", "_reached")).drop("_reached"))
        frontier = state.filter("changed").drop("changed")
        if frontier.isEmpty():
            return state.drop("changed")


def cyclic_objects(edges: DataFrame) -> DataFrame:
    """object_name of every object that is, through others or itself, an input of its own.

    Objects that end a chain on either side are peeled off round by round, as
    they are on no cycle; what stays is small, and there each object's reach is
    worked out by pairs until nothing new is found.
    """
    links = edges.filter("object_name is not null and input_object is not null").select(
        F.col("object_name").alias("a"), F.col("input_object").alias("b")).distinct()
    links, size = staged(links), -1
    while size != (size := links.count()):
        links = staged(links.join(links.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b")
                       .join(links.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b"))
    reach, fresh = links, links
    while not fresh.isEmpty():
        further = fresh.join(links.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
        fresh = staged(further.join(reach, ["a", "b"], "left_anti"))
        reach = staged(reach.unionByName(fresh))
    return reach.filter("a = b").select(F.col("a").alias("object_name"))


def transitive_tiers(tags: DataFrame, edges: DataFrame) -> DataFrame:
    """Tags with the weakest tier in the whole lineage of each object, and whether that lineage is circular.

    Objects that only the edges name are not listed, but hand on what reaches
    them. An object listed twice counts with its weaker tag.
    """
    tagged = tags_allowed(tags)
    own = tagged.groupBy("object_name").agg(F.max(tier_rank(F.col("trust_tier"))).alias("rank"))
    ranks = propagated_ranks(own, edges)
    circular = cyclic_objects(edges).withColumn("circular", F.lit(True))
    return (
        tagged.join(ranks, "object_name").join(circular, "object_name", "left")
        .withColumns({"inherited_tier": tier_name(F.col("rank")), "circular": F.coalesce("circular", F.lit(False))})
        .withColumn("tier_consistent", F.coalesce(F.col("inherited_tier") == F.col("trust_tier"), F.lit(False)))
        .drop("rank")
    )


def tag_agreement(tags: DataFrame, feeds: DataFrame) -> DataFrame:
    """Declared tier against live feeds: CERTIFIED with a failing feed disagrees."""
    live = feeds.groupBy(F.col("scope_object").alias("object_name")).agg(
        F.count(F.lit(1)).alias("feeds"),
        F.count_if(F.col("trust_status") == "FAIL").alias("failing_feeds"),
    )
    clash = (F.col("trust_tier") == "CERTIFIED") & (F.col("failing_feeds") > 0)
    return tags.select("object_name", "trust_tier").join(live, "object_name").withColumn(
        "agreement", F.when(clash, "DISAGREE").otherwise("AGREE"))
