"""Balanced label propagation: documents move to the shards of their neighbours under quotas.

Links are memberships (row, group): rows of one group are neighbours of each other, through
the group, so that a group of any size costs one row for each member and is never expanded
into pairs. Every round counts the members of each group by shard, lets every row prefer the
shard where most of its neighbours are, and grants moves only as far as the target has room or
other rows leave it. A last step evens the counts out exactly, moving rows without neighbours
first, and numbers the rows of each shard without gaps. Ranks over a whole shard are built
from ranks in small buckets and sums over bucket sizes, so no task orders a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

#: Rounds go on as long as each joins this share of the cuts that can be joined, or one at least.
PROGRESS = 0.01
#: Rows of one bucket of a rank, about.
BUCKET = 4096


def numbered(rows: DataFrame, by: str, first: str, total: int) -> DataFrame:
    """`rows` with _rank: 0, 1, ... without gaps in every `by`, in the order of `first` (a
    small whole number), then of a hash of the row."""
    buckets = max(1, -(-total // BUCKET))
    placed = rows.withColumn("_bucket", F.pmod(F.xxhash64("row", F.lit(31)), F.lit(buckets)))
    sizes = placed.groupBy(by, first, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy(first, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each bucket: a table of (rows / BUCKET) rows.
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(by, first, "_bucket").orderBy("row")
    return (
        placed.withColumn("_in", F.row_number().over(inside) - 1)
        .join(starts, [by, first, "_bucket"])
        .withColumn("_rank", F.col("_in") + F.col("_start"))
        .drop("_bucket", "_in", "_start")
    )


def _wishes(state: DataFrame, linked: DataFrame, share: int, room: dict[int, int]) -> DataFrame:
    """(row, group, shard, wish): of the shards with room, where most of a linked row's
    neighbours are, itself not counted. A group above a shard's share has as many such shards
    as it needs, and its rows are dealt to them. A cut group that none of them holds a member
    of moves as a whole to one that has room for it: of the roomiest, one by its hash."""
    open_shards = list(room)
    placed = linked.join(state, "row")
    counts = placed.groupBy("group", "size", "shard").agg(F.count("*").alias("n"))
    tie = F.pmod(F.xxhash64("group", "shard"), F.lit(1 << 20))
    # One entry for each shard at most.
    tops = counts.where(F.col("shard").isin(open_shards)).groupBy("group").agg(
        F.sort_array(F.collect_list(F.struct(F.col("n"), tie.alias("tie"), F.col("shard"))), asc=False).alias("tops"))
    # As many of the roomiest as there are shards with at least half of the most room.
    roomy = [s for s in open_shards if 2 * room[s] >= max(room.values())]
    if roomy:
        at = (F.pmod(F.xxhash64("group", F.lit(3)), F.lit(len(roomy))) + 1).cast("int")
        shard = F.element_at(F.array(*map(F.lit, roomy)), at)
        space = F.element_at(F.array(*[F.lit(room[s]) for s in roomy]), at)
        stuck = counts.groupBy("group").agg(
            F.first("size").alias("size"), F.count("*").alias("_cut"),
            F.max(F.col("shard").isin(open_shards)).alias("_open")).where(
            (F.col("_cut") > 1) & ~F.col("_open") & (F.col("size") <= space))
        tops = tops.unionByName(stuck.select("group", F.array(F.struct(
            F.col("size").alias("n"), F.lit(0).cast("long").alias("tie"), shard.alias("shard"))).alias("tops")))
    own = placed.join(tops, "group").join(counts.drop("size"), ["group", "shard"])
    needed = F.least(F.ceil(F.col("size") / share), F.size("tops"))
    best = F.element_at("tops", (F.pmod(F.xxhash64("row", F.lit(5)), needed) + 1).cast("int"))
    asked = own.withColumn("_best", best).select(
        "row", "group", "shard", F.col("_best.shard").alias("wish"),
        (F.col("_best.n") - (F.col("n") - 1)).alias("gain")
    ).where((F.col("wish") != F.col("shard")) & (F.col("gain") > 0))
    return asked.groupBy("row").agg(
        F.max(F.struct("gain", "wish", "group")).alias("best"), F.first("shard").alias("shard")).select(
        "row", F.col("best.group").alias("group"), "shard", F.col("best.wish").alias("wish"))


def _cuts(linked: DataFrame, state: DataFrame, share: int) -> int:
    """How many more shards groups lie in than their sizes need."""
    parts = linked.join(state, "row").select("group", "shard", "size").distinct()
    spare = parts.groupBy("group").agg(
        (F.count("*") - F.ceil(F.first("size") / F.lit(share))).alias("_spare"))
    return spare.agg(F.coalesce(F.sum("_spare"), F.lit(0))).first()[0]


def balanced_shards(rows: DataFrame, members: DataFrame, shards: int = 16) -> DataFrame:
    """(row, shard, slot) for every row: sizes at most one apart, few links cut.

    `rows` has a unique row; `members` has row and group (a row may be in many groups or none;
    nulls are ignored). An empty table gives no rows. Groups above a shard's share are spread
    over as few shards as the shares allow. Rounds end when no move is granted or a round has
    joined too few cuts; one that joins none is undone, so they end for any links.
    """
    groups = members.where(F.col("group").isNotNull() & F.col("row").isNotNull()).distinct()
    sizes = groups.groupBy("group").agg(F.count("*").alias("_size")).where("_size > 1")
    linked = stored(groups.join(sizes, "group").select("row", "group", F.col("_size").alias("size")))
    state = stored(rows.select("row", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard")))
    total = state.count()
    share = max(1, -(-total // shards))
    cuts = _cuts(linked, state, share)
    while cuts > 0:
        held = linked.select("row").distinct().join(state, "row").groupBy("shard").count()
        room = dict.fromkeys(range(shards), share) | {r["shard"]: share - r["count"] for r in held.collect()}
        wishes = stored(_wishes(state, linked, share, {s: n for s, n in room.items() if n > 0}))
        # Quotas by whole groups: a group's movers ask together, the larger the first.
        asked = wishes.groupBy("wish", "group").agg(F.count("*").alias("n"))
        taken = stored(_granted(asked, state, linked, share))
        if taken.isEmpty():
            break
        moved = (
            numbered(wishes.withColumn("_same", F.lit(0)).withColumn("_key", F.xxhash64("wish", "group")),
                     "_key", "_same", total)
            .join(taken, ["wish", "group"]).where(F.col("_rank") < F.col("granted")).select("row", "wish")
        )
        after = stored(state.join(moved, "row", "left").select(
            "row", F.coalesce("wish", "shard").alias("shard")))
        left = _cuts(linked, after, share)
        if left >= cuts:
            drop_stored(after)
            break
        drop_stored(state)
        state, joined, cuts = after, cuts - left, left
        if joined < PROGRESS * cuts:
            break
    return _evened(state, linked, shards, total)


def _granted(asked: DataFrame, state: DataFrame, linked: DataFrame, share: int) -> DataFrame:
    """How many of a group's movers a shard takes: its quota is the share less the linked rows
    it holds (rows without neighbours make way), dealt to the groups in order of size.

    The running sum is over the sums of 4096 hashed parts first, so no task orders all groups.
    """
    held = linked.select("row").distinct().join(state, "row").groupBy("shard").agg(F.count("*").alias("held"))
    level = F.floor(F.log2("n")).cast("int")
    parts = asked.withColumn("_level", -level).withColumn("_part", F.pmod(F.xxhash64("group"), F.lit(4096)))
    sums = parts.groupBy("wish", "_level", "_part").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy("wish").orderBy("_level", "_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("wish", "_level", "_part").orderBy(F.desc("n"), "group").rowsBetween(
        Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(0), F.lit(share) - F.coalesce("held", F.lit(0)))
    return (
        parts.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(starts, ["wish", "_level", "_part"])
        .join(held.withColumnRenamed("shard", "wish"), "wish", "left")
        .select("wish", "group", F.greatest(F.lit(0), F.least(
            F.col("n"), room - F.col("_in") - F.col("_start"))).alias("granted"))
        .where("granted > 0")
    )


def _evened(state: DataFrame, linked: DataFrame, shards: int, total: int) -> DataFrame:
    """Rows above a shard's share move to the shards below theirs; then slots."""
    spark = state.sparkSession
    bound = linked.select("row").distinct().withColumn("_bound", F.lit(1))
    # Rows that must stay longest come first.
    order = state.join(bound, "row", "left").withColumn("_order", F.when(F.col("_bound") == 1, 0).otherwise(1))
    ranked = stored(numbered(order.drop("_bound"), "shard", "_order", total).drop("_order"))
    counts = {r["shard"]: r["count"] for r in ranked.groupBy("shard").count().collect()}
    # The shards that hold most keep the rows left over.
    fullest = sorted(range(shards), key=lambda s: (-counts.get(s, 0), s))
    share = {s: total // shards + (1 if i < total % shards else 0) for i, s in enumerate(fullest)}
    free, at = [], 0
    for s in range(shards):
        missing = share[s] - counts.get(s, 0)
        if missing > 0:
            free.append((at, at + missing, s, counts.get(s, 0)))
            at += missing
    # Tables of one row for each shard.
    over, first = [], 0
    for s in range(shards):
        over.append((s, share[s], first))
        first += max(0, counts.get(s, 0) - share[s])
    shares = F.broadcast(spark.createDataFrame(over, "shard INT, _share BIGINT, _first BIGINT"))
    gaps = F.broadcast(spark.createDataFrame(free, "_from BIGINT, _to BIGINT, _target INT, _held BIGINT"))
    marked = ranked.join(shares, "shard")
    staying = marked.where(F.col("_rank") < F.col("_share")).select("row", "shard", F.col("_rank").alias("slot"))
    place = F.col("_first") + F.col("_rank") - F.col("_share")
    moving = marked.where(F.col("_rank") >= F.col("_share")).withColumn("_place", place)
    placed = moving.join(gaps, (F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_to"))).select(
        "row", F.col("_target").alias("shard"), (F.col("_place") - F.col("_from") + F.col("_held")).alias("slot"))
    return staying.unionByName(placed)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Documents in shards with even row counts, equal texts together where a share allows.

    Returns one row for each row of `docs`: doc_id, size (UTF-8 bytes and 1; a null text has
    none), text_crc32, law `rows`, shard, slot, grown_shard (null). Null texts are linked with
    nothing; empty texts are equal texts. Rows that repeat a doc_id are rows of their own.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.md5(text.cast("binary"))).alias("group"),
    ).withColumn("row", F.monotonically_increasing_id()))
    found = balanced_shards(rows.select("row"), rows.select("row", "group"), shards)
    return rows.drop("group").join(found, "row").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
