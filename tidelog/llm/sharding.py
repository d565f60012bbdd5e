"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked.  Every document starts in the shard its id hashes to; in each round a linked
document wants to move to the shard that holds most of its group, or, for a group larger than a shard, to one of as many
such shards as the group fills.  A shard takes no more than it has room for, counting what leaves it in the same round: movers
pass by a hash under the ratio of room to demand, which needs no order among them.  Rounds end when no fewer rows than in the
round before want to move, or after `rounds`.  At the end whole shards are made even: what exceeds a shard's quota, unlinked
documents first, goes to shards that lack rows.  So the counts are at most one apart, and a group is cut only where it
must be.

No group is gathered in one task: groups are counted per shard (at most `shards` rows each), only counts are joined back, and
the rows of a group that holds a thousandth of the corpus or more are salted for those joins; there are at most a thousand
such groups, which bounds what is broadcast.  Slots come from counts per (shard, bucket) and a rank within each bucket of bounded expected size.

A null text has size 16, the checksum of no bytes, and is linked with the empty text.  Null and repeated doc_ids keep all
their rows.  An empty table gives an empty result.  Further columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import common

#: Rows in one ranking bucket, about.
BUCKET_ROWS = 50_000


#: Salts of a large group's rows.
SALTS = 64


def _salted(groups: DataFrame, large: DataFrame) -> DataFrame:
    """One row a salt for the groups in `large` (own), and salt 0 for the others."""
    known = groups.join(F.broadcast(large.withColumnRenamed("own", "big")), F.col("own") == F.col("big"), "left")  # a thousand rows at most
    salts = F.when(F.col("big").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return known.withColumn("own_salt", F.explode(salts)).drop("big")


def _chance(*cols):
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def start(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, group, shard): each document in the shard of its id."""
    return common.texts(docs).select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("group"),
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"),
    )


def passing(load: dict[int, int], wants: dict[tuple[int, int], int], capacity: int, shards: int) -> list[float]:
    """For each shard the share of those who want to come that may, such that none ends above its capacity.

    Begins with all and takes back what a shard has no room for, until what leaves makes room for what comes.
    """
    share = [1.0] * shards
    for _ in range(200):
        leaves, comes = [0.0] * shards, [0] * shards
        for (a, b), n in wants.items():
            leaves[a] += n * share[b]
            comes[b] += n
        new = [min(share[j], max(0.0, capacity - load.get(j, 0) + leaves[j]) / comes[j]) if comes[j] else 1.0 for j in range(shards)]
        if max(a - b for a, b in zip(share, new)) < 1e-4:
            return new
        share = new
    return share


def propagate(linked: DataFrame, large: DataFrame, total: int, shards: int, round_no: int) -> tuple[DataFrame, DataFrame, int]:
    """One round of moves among (…, group, salt, shard) rows that have a partner.

    Gives the rows after it, the table they are read from, and the number of rows that wanted to move.  Equal counts of a
    group rank anew in each round, so a group that found its shard full tries another.
    """
    capacity = -(-total // shards)
    per_shard = linked.groupBy("group", "shard").agg(F.count("*").alias("n"))
    order = Window.partitionBy("group").orderBy(F.desc("n"), F.xxhash64("group", "shard", F.lit(round_no)))  # at most `shards` rows a group
    ranked = per_shard.withColumn("k", F.row_number().over(order)).withColumn("all", F.sum("n").over(Window.partitionBy("group")))
    wanted = (
        ranked.filter(F.col("k") <= F.ceil(F.col("all") / (0.9 * capacity)))
        .groupBy("group")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "shard"))), lambda x: x["shard"]).alias("targets"))
        .withColumnRenamed("group", "own")
    )
    at = F.pmod(F.xxhash64("doc_id", F.lit(round_no)), F.size("targets")).cast("int")
    wishes = linked.join(_salted(wanted, large), (F.col("group") == F.col("own")) & (F.col("salt") == F.col("own_salt"))).withColumn(
        "to", F.when(F.array_contains("targets", F.col("shard")), F.col("shard")).otherwise(F.element_at("targets", at + 1))
    )
    wishes = common.materialise(wishes.drop("own", "own_salt"), "wishes")
    load = {r.shard: r.n for r in wishes.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row a shard
    wants = {(r.shard, r.to): r.n for r in wishes.filter("to <> shard").groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}  # shards² rows at most
    quota = F.element_at(F.array(*map(F.lit, passing(load, wants, capacity, shards))), F.col("to") + 1)
    # a group that fits one shard moves whole, a larger one row by row
    draw = F.when(F.size("targets") == 1, _chance("group", F.lit(round_no))).otherwise(_chance("doc_id", F.lit(round_no + 1000)))
    moved = wishes.withColumn("shard", F.when(draw < quota, F.col("to")).otherwise(F.col("shard"))).drop("to", "targets")
    return moved, wishes, sum(wants.values())


def assign(docs: DataFrame, shards: int = 40, rounds: int = 12) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, linked, home): every document's shard and gapless place in it; home is where it began."""
    rows = rows_table = common.materialise(start(docs, shards).withColumn("home", F.col("shard")), "shard-rows")
    total = rows.count()
    shared = shared_table = common.materialise(rows.groupBy("group").agg(F.count("*").alias("copies")).filter("copies > 1").select(F.col("group").alias("own"), "copies"), "shard-groups")
    large = common.materialise(shared.filter(F.col("copies") >= max(1000, -(-total // 1000))).select("own"), "shard-large")
    shared = shared.select("own")
    rows = rows.join(F.broadcast(large.withColumnRenamed("own", "big")), F.col("group") == F.col("big"), "left")  # a thousand rows at most
    rows = rows.withColumn("salt", F.when(F.col("big").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int")).drop("big")
    flagged = rows.join(_salted(shared, large), (F.col("group") == F.col("own")) & (F.col("salt") == F.col("own_salt")), "left")
    flagged = flagged.withColumn("linked", F.col("own").isNotNull()).drop("own", "own_salt")
    flagged = common.materialise(flagged, "shard-flagged")
    linked = flagged.filter("linked")
    before, tables = total + 1, []
    for k in range(rounds):
        linked, table, moving = propagate(linked, large, total, shards, k)
        tables.append(table)
        if k:
            common.drop(tables[k - 1])
        if not moving or moving >= before:
            break
        before = moving
    placed = common.materialise(flagged.filter("not linked").unionByName(linked).drop("group", "salt"), "shard-placed")
    common.drop(rows_table, shared_table, large, flagged, *tables[-1:])
    return balance(placed, total, shards)


def balance(placed: DataFrame, total: int, shards: int) -> DataFrame:
    """Exact quotas and gapless slots."""
    buckets = max(1, -(-total // (shards * BUCKET_ROWS)))
    placed = placed.withColumn("bucket", F.when(F.col("linked"), 0).otherwise(buckets) + F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = common.materialise(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "shard-counts")
    sizes = [0] * shards
    for r in first.groupBy("shard").agg(F.sum("n").alias("n")).collect():  # one row a shard
        sizes[r.shard] = r.n
    quota = [total // shards + (j < total % shards) for j in range(shards)]
    over = [0, *accumulate(max(0, s - q) for s, q in zip(sizes, quota))]
    lack = [0, *accumulate(max(0, q - s) for s, q in zip(sizes, quota))]
    pick = lambda xs, at: F.element_at(F.array(*(F.lit(x).cast("long") for x in xs)), at.cast("int") + 1)
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "home")
    ranked = placed.join(first.select("shard", "bucket", "first"), ["shard", "bucket"]).withColumn("rank", F.col("first") + F.row_number().over(within) - 1)
    spare = F.col("rank") - pick(quota, F.col("shard"))
    ranked = ranked.withColumn("k", F.when(spare >= 0, pick(over, F.col("shard")) + spare))
    ends = F.array(*(F.lit(x).cast("long") for x in lack[1:]))
    to = F.size(F.filter(ends, lambda x: x <= F.col("k")))
    ranked = ranked.withColumn("to", F.when(F.col("k").isNotNull(), to))
    slot = F.when(F.col("to").isNull(), F.col("rank")).otherwise(pick(sizes, F.col("to")) + F.col("k") - pick(lack, F.col("to")))
    return ranked.select("doc_id", "size", "text_crc32", F.coalesce("to", "shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), "linked", "home")
