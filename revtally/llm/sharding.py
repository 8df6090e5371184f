"""Sharding by balanced label propagation.

Linked documents start in random shards. In every round each asks for the shard in which most of
its senior neighbours are (more links, or as many and a smaller id). Between two shards as many may
move one way as the other, and more as far as a shard's quota has room. Seniority gives the moves a direction, so that neighbours don't swap places for
ever. Afterwards documents without links and those beyond a quota fill the shards up, so that
row counts are at most one apart.

Members of a group larger than a quota can't be together. They begin, one after another, in the
stretch of shards that the group's weight spans, and stay there, so that they take no room that
smaller groups need; where a shard is over its quota, they leave first.

Defined results: a null text is an empty one; repeated ids are rows of their own and share the
links of that id; links to unknown ids and to oneself count for nothing; an empty table gives an
empty result; a group larger than a shard is spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running, saved, unit_hash

ROUNDS = 6


def equal_text_links(documents: DataFrame) -> DataFrame:
    """(src, dst) from every document to the first one with the same text; `documents` has
    doc_id and the columns size, text_crc32 and text_hash that stand for the text."""
    text = ["size", "text_crc32", "text_hash"]
    first = documents.groupBy(*text).agg(F.min("doc_id").alias("dst"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return documents.select("doc_id", *text).join(first, text).filter("doc_id != dst").select(F.col("doc_id").alias("src"), "dst").distinct()


def propagate(ids: DataFrame, links: DataFrame, shards: int, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, shard, large) of the linked ids after some rounds of label propagation; large are
    members of groups larger than a quota, but for the first ones."""
    both = links.filter("src != dst").select("src", "dst").union(links.filter("src != dst").select(F.col("dst"), F.col("src"))).distinct()
    known = ids.select("doc_id").distinct()
    both = both.join(known.withColumnRenamed("doc_id", "src"), "src", "left_semi").join(known.withColumnRenamed("doc_id", "dst"), "dst", "left_semi")
    both = saved(both, "links")
    degree = both.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    ours = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("degree").alias("_theirs")), "dst")
    senior = (F.col("_theirs") > F.col("degree")) | ((F.col("_theirs") == F.col("degree")) & (F.col("dst") < F.col("src")))
    upward = saved(ours.filter(senior).select("src", "dst"), "upward")
    # those without a senior neighbour stay where they begin, so they begin evenly, by their links
    roots = degree.join(upward.select("src").distinct(), "src", "left_anti").withColumn("_all", F.lit(0)).withColumn("_weight", F.col("degree") + 1)
    total = roots.agg(F.sum("_weight")).first()[0] or 1
    begun = saved(running(roots, "_all", ["src"], F.col("_weight"), "_before").select("src", "_weight", "_before"), "begun")
    large = begun.filter(F.col("_weight") > quota).select(F.col("src").alias("dst"), "_before")
    member = upward.join(large, "dst").groupBy("src").agg(F.max(F.struct("_before", "dst")).alias("_first")).select("src", "_first.*")
    stretch = running(saved(member, "members"), "dst", ["src"], F.lit(1), "_place").withColumn("_at", F.col("_before") + F.col("_place") + 1)
    stretch = saved(stretch.select(F.col("src").alias("doc_id"), F.floor(F.col("_at") * shards / total).cast("int").alias("shard"), F.lit(True).alias("large")), "stretch")
    others = upward.select(F.col("src").alias("doc_id")).distinct().join(stretch, "doc_id", "left_anti")
    first = begun.select(F.col("src").alias("doc_id"), F.floor(F.col("_before") * shards / total).cast("int").alias("shard"), F.lit(False).alias("large"))
    others = others.select("doc_id", F.floor(unit_hash(F.lit("shard"), F.col("doc_id")) * shards).cast("int"), F.lit(False))
    labels = saved(first.union(stretch).union(others), "labels")
    for turn in range(rounds):
        votes = upward.join(labels.select(F.col("doc_id").alias("dst"), "shard"), "dst").groupBy("src", "shard").agg(F.count(F.lit(1)).alias("_votes"))
        wish = votes.groupBy("src").agg(F.max(F.struct("_votes", (-F.col("shard")).alias("_shard"))).alias("_best")).select(F.col("src").alias("doc_id"), (-F.col("_best._shard")).cast("int").alias("_to"))
        asked = labels.join(wish, "doc_id", "left").withColumn("_moves", ~F.col("large") & F.coalesce(F.col("_to") != F.col("shard"), F.lit(False)))
        # per pair of shards: as many as want to go the other way may go, and more where there is room
        here = asked.groupBy("shard").agg(F.count(F.lit(1)).alias("_here")).withColumnRenamed("shard", "_to")
        flows = saved(asked.filter("_moves").groupBy("shard", "_to").agg(F.count(F.lit(1)).alias("_go")), "flows")
        back = flows.select(F.col("_to").alias("shard"), F.col("shard").alias("_to"), F.col("_go").alias("_come"))
        traded = flows.join(back, ["shard", "_to"], "left").withColumn("_traded", F.least("_go", F.coalesce("_come", F.lit(0))))
        more = Window.partitionBy("_to")
        room = F.greatest(F.lit(quota) - F.coalesce("_here", F.lit(0)), F.lit(0)) / F.greatest(F.sum(F.col("_go") - F.col("_traded")).over(more), F.lit(1))
        odds = traded.join(here, "_to", "left").select("shard", "_to", ((F.col("_traded") + F.least(room, F.lit(1.0)) * (F.col("_go") - F.col("_traded"))) / F.col("_go")).alias("_odds"))
        accepted = F.col("_moves") & (unit_hash(F.lit(f"turn {turn}"), F.col("doc_id")) < F.coalesce("_odds", F.lit(0.0)))
        moved = saved(asked.join(odds, ["shard", "_to"], "left").select("doc_id", F.when(accepted, F.col("_to")).otherwise(F.col("shard")).alias("shard"), "large", accepted.alias("_moved")), "labels")
        labels = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            break
    return labels


def balanced_shards(documents: DataFrame, links: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """`documents` (doc_id, more) with shard and slot (gapless from 0 in its shard); counts of
    the shards are at most one apart, and as few links as possible are cut."""
    slim = documents.drop("shard", "slot")
    total = slim.count()
    quotas = [total // shards + (k < total % shards) for k in range(shards)]
    labels = propagate(slim, links, shards, total // shards, rounds)
    placed = saved(slim.join(labels, "doc_id", "left"), "placed")
    key = ["doc_id"]
    # members of large groups come last in their shard
    ordered = placed.filter("shard is not null").withColumn("_half", 2 * F.col("shard") + F.col("large").cast("int"))
    ranked = saved(running(ordered, "_half", key, F.lit(1), "slot"), "ranked")
    # bounded by the number of shards
    n = {r["_half"]: r["n"] for r in ranked.groupBy("_half").agg(F.count(F.lit(1)).alias("n")).collect()}
    kept = [min(n.get(2 * k, 0) + n.get(2 * k + 1, 0), quotas[k]) for k in range(shards)]
    before = F.element_at(F.array(*[F.lit(n.get(2 * k, 0)) for k in range(shards)]), F.col("shard") + 1)
    ranked = ranked.withColumn("slot", F.col("slot") + F.when(F.col("large"), before).otherwise(0)).drop("_half", "large")
    limit = F.element_at(F.array(*map(F.lit, kept)), F.col("shard") + 1)
    stays = ranked.filter(F.col("slot") < limit)
    free = placed.filter("shard is null").drop("shard", "large").unionByName(ranked.filter(F.col("slot") >= limit).drop("shard", "slot"))
    numbered = running(free.withColumn("_all", F.lit(0)), "_all", key, F.lit(1), "_no").drop("_all")
    begins = [0]
    for quota, k in zip(quotas, kept):
        begins.append(begins[-1] + quota - k)
    starts = F.array(*[F.lit(b).cast("long") for b in begins])
    shard = F.size(F.filter(F.slice(starts, 2, shards), lambda end: end <= F.col("_no")))
    filled = numbered.withColumn("shard", shard).withColumn("slot", F.col("_no") - F.element_at(starts, F.col("shard") + 1) + F.element_at(F.array(*map(F.lit, kept)), F.col("shard") + 1)).drop("_no")
    columns = [*slim.columns, "shard", "slot"]
    return stays.select(*columns).unionByName(filled.select(*columns)).withColumn("slot", F.col("slot").cast("long"))
